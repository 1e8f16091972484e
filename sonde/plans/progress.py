"""Progress of long work: events for whoever listens, and what a stream has taken in."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener

log = logging.getLogger("sonde")
Listener = Callable[[str, int, float], None]


def to_log(step: str, n: int, seconds: float) -> None:
    log.info("%s: %d, %.1f s", step, n, seconds)


class Progress:
    """Tells a listener (step, how many, seconds since the start)."""

    def __init__(self, listener: Listener = to_log):
        self.listener, self.began = listener, time.time()

    def __call__(self, step: str, n: int) -> None:
        self.listener(step, n, time.time() - self.began)


class StreamProgress(StreamingQueryListener):
    """Tells a listener the rows of each batch of a stream; add it with ``spark.streams.addListener``."""

    def __init__(self, listener: Listener = to_log):
        self.tell = Progress(listener)

    def onQueryStarted(self, event) -> None:  # noqa: N802 - the names are Spark's
        self.tell("stream started", 0)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.tell(f"batch {event.progress.batchId}", int(event.progress.numInputRows))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.tell("stream ended", 0)
