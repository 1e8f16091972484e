"""Chunk quality: five structural checks, coherence with the tier above, flags and drift."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text, vectors

#: Groups that a task adds up before it sends them.
GROUPS_HELD = 20_000


def structural_scores(chunks: DataFrame) -> DataFrame:
    """``chunks`` (tier, token_count, content) with the five checks in hundredths, and structural (their sum).

    They are made by a generator, so that a filter on them does not work them out a second time.
    """
    t, n, c = F.col("tier"), F.col("token_count"), F.col("content")
    checks = {"c_tokens": vectors.check_tokens(t, n), "c_ending": vectors.check_ending(c), "c_brackets": vectors.check_brackets(c), "c_blanks": vectors.check_blanks(c), "c_repeats": vectors.check_repeats(c)}
    made = chunks.select("*", F.inline(F.array(F.struct(*(v.alias(k) for k, v in checks.items())))))
    return made.withColumn("structural", sum((F.col(k) for k in checks), F.lit(0)))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file_id, tier, n, total) of rows (file_id, tier, n, total), groups merged within the task."""
    held: dict[tuple, list] = {}

    def out() -> pa.RecordBatch:
        keys = list(held)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int32()), pa.array([held[k][0] for k in keys], pa.int64()), pa.array([held[k][1] for k in keys], pa.list_(pa.float64()))],
            names=["file_id", "tier", "n", "total"],
        )

    for batch in batches:
        totals = batch.column("total")
        rows = zip(batch.column("file_id").to_pylist(), batch.column("tier").to_pylist(), batch.column("n").to_pylist(), totals, strict=True)
        for file_id, tier, n, total in rows:
            if not total.is_valid:
                continue
            x = total.values.to_numpy(zero_copy_only=False)
            own = held.setdefault((file_id, tier), [0, np.zeros(len(x))])
            own[0] += n
            own[1] += x
        if len(held) > GROUPS_HELD:
            yield out()
            held.clear()
    if held:
        yield out()


def parent_means(embedded: DataFrame) -> DataFrame:
    """``embedded`` (file_id, tier, vector) -> (file_id, tier, mean), the element-wise mean.

    Tasks add up their own groups before the one shuffle, so a group that most rows are in sends one row a task.
    """
    shape = "file_id long, tier int, n long, total array<double>"
    rows = embedded.select(F.col("file_id").cast("long"), F.col("tier").cast("int"), F.lit(1).cast("long").alias("n"), vectors.doubles(F.col("vector")).alias("total"))
    parts = rows.where("total IS NOT NULL").mapInArrow(_sums, shape).repartition("file_id", "tier").mapInArrow(_sums, shape)
    # A task that held too many groups gives some of them in parts.
    again = parts.groupBy("file_id", "tier").agg(F.sum("n").alias("n"), F.collect_list("total").alias("totals"))
    added = F.aggregate(F.slice("totals", 2, 1 << 30), F.get("totals", 0), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
    return again.select("file_id", "tier", F.transform(added, lambda x: x / F.col("n")).alias("mean"))


def coherence_scores(embedded: DataFrame) -> DataFrame:
    """``embedded`` (chunk_id, file_id, tier, vector) with coherence: the cosine with the mean
    of the same file's vectors one tier up; null for tier 3 and without such vectors."""
    up = parent_means(embedded).select("file_id", (F.col("tier") - 1).alias("tier"), "mean")
    return embedded.join(up, ["file_id", "tier"], "left").withColumn("coherence", vectors.cosine(vectors.doubles(F.col("vector")), F.col("mean"))).drop("mean")


def flag(scored: DataFrame) -> DataFrame:
    """With is_flagged: structural at most the threshold, or coherence below its own."""
    weak = F.coalesce(F.col("coherence") < fixed.COHERENCE_THRESHOLD, F.lit(False))
    return scored.withColumn("is_flagged", (F.col("structural") <= fixed.STRUCTURAL_THRESHOLD) | weak)


def score_all(chunks: DataFrame, embedded: DataFrame | None = None, rescore: bool = False) -> DataFrame:
    """``chunks`` with structural_score, coherence_score and is_flagged for the unscored (or all) of them."""
    todo = chunks if rescore else chunks.where("structural_score IS NULL")
    done = chunks.limit(0) if rescore else chunks.where("structural_score IS NOT NULL")
    scored = structural_scores(todo.drop("structural_score", "coherence_score", "is_flagged"))
    if embedded is None:
        scored = scored.withColumn("coherence", F.lit(None).cast("double"))
    else:
        scored = scored.join(coherence_scores(embedded).select("chunk_id", "coherence"), "chunk_id", "left")
    new = flag(scored).withColumns({"structural_score": F.col("structural") / 100.0, "coherence_score": F.col("coherence")})
    return done.unionByName(new.select(*chunks.columns))


def unscored(chunks: DataFrame) -> DataFrame:
    """Chunks without a score, by id."""
    return chunks.where("structural_score IS NULL").orderBy("chunk_id")


def run_counts(scored: DataFrame) -> DataFrame:
    """One row: total, flagged, structural_only, coherence_only, both."""
    s, c = F.col("structural") <= fixed.STRUCTURAL_THRESHOLD, F.coalesce(F.col("coherence") < fixed.COHERENCE_THRESHOLD, F.lit(False))
    return scored.agg(
        F.count("*").alias("total"), F.count_if(s | c).alias("flagged"), F.count_if(s & ~c).alias("structural_only"), F.count_if(~s & c).alias("coherence_only"), F.count_if(s & c).alias("both")
    )


def flagged_summary(chunks: DataFrame, files: DataFrame) -> DataFrame:
    joined = chunks.select("file_id", "chunker_method", "is_flagged").join(files.select("file_id", "mime_type"), "file_id")
    out = joined.groupBy("mime_type", F.coalesce("chunker_method", F.lit("_default")).alias("method")).agg(F.sum(F.col("is_flagged").cast("int")).alias("flagged"), F.count("*").alias("total"))
    return out.withColumn("percent", F.when(F.col("total") == 0, 0).otherwise(F.expr("flagged * 100 div total")))


def flagged_files(chunks: DataFrame, files: DataFrame) -> DataFrame:
    return chunks.where("is_flagged").select("file_id", "chunker_method").join(files.select("file_id", "file_uri", "mime_type"), "file_id").select("file_uri", "mime_type", "chunker_method").distinct()


def drifted_files(flagged: DataFrame, methods: dict[str, str] | None = None) -> DataFrame:
    """Files with flagged chunks whose method is no longer the current one: file_uri, old, new (one row a file)."""
    now = text.method_for(text.normal_mime(F.col("mime_type")), methods)
    moved = flagged.withColumn("new", now).where(~F.col("chunker_method").eqNullSafe(F.col("new")))
    return moved.groupBy("file_uri").agg(F.min(F.coalesce("chunker_method", F.lit("_default"))).alias("old"), F.min("new").alias("new"))


def drift_skipped(drifted: DataFrame, flagged: DataFrame) -> DataFrame:
    """One row: the flagged files that need no new chunks, as their method is the current one."""
    return flagged.select("file_uri").distinct().join(drifted.select("file_uri"), "file_uri", "left_anti").agg(F.count("*").alias("skipped"))


def drift_tally(drifted: DataFrame) -> DataFrame:
    return drifted.groupBy("old", "new").agg(F.count("*").alias("files"))


def worst_first(chunks: DataFrame, limit: int, flagged: bool = False, tier: int | None = None) -> DataFrame:
    rows = chunks.where("structural_score IS NOT NULL")
    if flagged:
        rows = rows.where("is_flagged")
    if tier is not None:
        rows = rows.where(F.col("tier") == tier)
    return rows.orderBy("structural_score", "chunk_id").limit(limit)
