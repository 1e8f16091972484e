"""Intermediate tables, written once to a folder that all executors share and read back.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Only where that
setting is absent and all tasks run on this machine (tests, a laptop) is a folder of our own made.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def staging_root(spark: SparkSession) -> str:
    """The shared folder for this application's tables; an error on a cluster that names none."""
    context = spark.sparkContext
    base, app = context.getConf().get("spark.checkpoint.dir", None), context.applicationId
    if not base:
        if context.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="sonde-")
        base = _OWN[app]
    return f"{base.rstrip('/')}/sonde-{app}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it back: what follows starts from files, so a lost executor costs a re-read and
    not a recomputation, and non-deterministic columns are fixed."""
    path = f"{staging_root(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
