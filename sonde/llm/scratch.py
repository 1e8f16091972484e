"""Scratch tables in the shared folder, and how work is dealt to tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..staging import staged as materialize
from ..staging import staging_root as scratch_root

__all__ = ["fresh_name", "longs", "many_tasks", "materialize", "scratch_root", "small_batches"]


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, longer until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def many_tasks(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` into as many tasks as the session shuffles to, however few bytes they are:
    for work that costs more than its bytes show."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound the rows of an Arrow batch, as one text may be megabytes long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def longs(df: DataFrame) -> list[np.ndarray]:
    """The columns (longs, none null) of a table of bounded size, by way of Arrow whatever the session's settings."""
    table = df.toArrow()
    return [table.column(c).to_numpy().astype(np.int64, copy=False) for c in df.columns]
