"""Near-duplicate documents by min-max hashing.

Every hash function keeps both its minimum and its maximum over a document's shingle
set, so 90 evaluations give 180 signature values; each is an unbiased indicator of the
Jaccard similarity, and the two of one function vary against each other. Bands of them make
the buckets, as long as keeps the chance to miss a pair at the asked similarity below 1e-6:
30 of six values at 0.85 (7e-7), 36 of five at 0.8 (6e-7).

Groups are never expanded into pairs:

1. equal sets collapse to one representative before banding;
2. in each bucket the member that shares most buckets overall, the centre of a cloud
   of near copies, becomes the pivot, and the others are candidates of that pivot only:
   a number linear in the members;
3. a pivot's candidates are dealt into blocks of at most ``BLOCK_ROWS``. A block computes
   the full shingle sets and confirms links to the pivot exactly; then whoever is not
   joined to the pivot is compared, exactly, with the others. Pivot groups of several
   blocks do the same over pairs of blocks. Only confirmed links leave a block, and no
   candidate is dropped, whatever the size of a group. Texts of any length are whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .kernels import U64, mix, runs, shingle_sets, utf8
from .scratch import many_tasks, materialize, small_batches

HASHES, MISS = 90, 1e-6
BLOCK_ROWS = 256
#: ... and about so many shingles, unless one document alone has more.
BLOCK_SHINGLES = 1_000_000
#: Up to so many candidate documents (16 bytes each) are broadcast to pick their texts; beyond, a shuffled join does it.
PICK_ROWS = 400_000

_rng = np.random.Generator(np.random.PCG64(7))
_A = _rng.integers(0, 2**63, HASHES, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_B = _rng.integers(0, 2**63, HASHES, dtype=np.int64).astype(U64)
_DEAL = _rng.permutation(2 * HASHES)
_SEED = mix(np.arange(1, 2 * HASHES + 1, dtype=U64))


def band_rows(percent: int) -> int:
    """The most values in a band (6 at most) that keep the chance to miss a pair at this similarity below ``MISS``."""
    return next((r for r in range(6, 1, -1) if (1 - (percent / 100) ** r) ** (2 * HASHES // r) < MISS), 1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """All minima, then all maxima, of ``HASHES`` linear maps over the set."""
    low, high = np.full(HASHES, ~U64(0)), np.zeros(HASHES, U64)
    for i in range(0, len(shingles), 2048):
        m = shingles[i : i + 2048, None] * _A
        m += _B
        low, high = np.minimum(low, m.min(0)), np.maximum(high, m.max(0))
    return np.concatenate([low, high])


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """64-bit bucket keys of a signature, from ``rows`` of its values each."""
    bands = 2 * HASHES // rows
    deal, key = sig[_DEAL[: bands * rows].reshape(bands, rows)], _SEED[:bands].copy()
    for k in range(rows):
        key = mix(key + deal[:, k])
    return key


def _digest(x: np.uint64) -> int:
    return int(mix(np.array([x], U64)).view(np.int64)[0])


def _sketch(width: int, band: int):
    schema = pa.schema([("doc_id", pa.int64()), ("rk", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = utf8(batch.column("text"))
            for i, j in runs(offs):
                n, f1, f2, keys = [], [], [], []
                for s in shingle_sets(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], width):
                    n.append(len(s))
                    if len(s):
                        f1.append(_digest(np.bitwise_xor.reduce(mix(s))))
                        f2.append(_digest(np.add.reduce(mix(s ^ U64(0x5851F42D4C957F2D)))))
                        keys.append(band_keys(signature(s), band).view(np.int64))
                    else:
                        f1.append(0), f2.append(0), keys.append(None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), batch.column("rk").slice(i, j - i), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                    schema=schema,
                )

    return run


class _Sets:
    """The shingle sets of some texts, numbered compactly, for counting overlaps."""

    def __init__(self, texts: list[str], width: int):
        raw, offs = utf8(pa.array(texts, pa.large_string()))
        sets = [s for i, j in runs(offs) for s in shingle_sets(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], width)]
        self.size = np.array([len(s) for s in sets], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        flat, self.ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.flag = np.zeros(len(flat), bool)

    def linked(self, i: int, percent: int) -> np.ndarray:
        """Whether set i reaches the similarity with each set (no set is empty)."""
        own = self.ids[self.start[i] : self.start[i + 1]]
        self.flag[own] = True
        both = np.add.reduceat(self.flag[self.ids].astype(np.int64), self.start[:-1])
        self.flag[own] = False
        return 100 * both >= percent * (self.size + self.size[i] - both)


def _links(pivot: int | None, left: pd.DataFrame, right: pd.DataFrame | None, width: int, percent: int) -> tuple[list, set]:
    """Exact links of a block. Row 0 of ``left`` is the pivot if ``right`` is None;
    else links between rows of ``left`` that the pivot lacks and rows of ``right``."""
    if right is None:
        sets, ids = _Sets(left["text"].tolist(), width), left["m"].to_numpy()
        to_pivot = sets.linked(0, percent)
        root = np.where(to_pivot, 0, np.arange(len(ids)))
        out = [(int(ids[0]), int(x)) for x in ids[np.flatnonzero(to_pivot)] if x != ids[0]]
        for i in np.flatnonzero(~to_pivot):
            for j in np.flatnonzero(sets.linked(i, percent)):
                if root[i] != root[j]:
                    out.append((int(ids[i]), int(ids[j])))
                    root[root == root[i]] = root[j]
        return out, {int(x) for x in ids[~to_pivot]}
    lone = left[~left["joined"]]
    both = pd.concat([lone, right], ignore_index=True)
    sets, ids = _Sets(both["text"].tolist(), width), both["m"].to_numpy()
    root = np.where(both["joined"].to_numpy(bool), -1, np.arange(len(ids)))
    out = []
    for i in range(len(lone)):
        for j in np.flatnonzero(sets.linked(i, percent)):
            if root[i] != root[j]:
                out.append((int(ids[i]), int(ids[j])))
                root[root == root[i]] = root[j]
    return out, set()


def shingle_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 85) -> DataFrame:
    """(doc_id, rk, n, f1, f2, bands) per row: set size, 128-bit set fingerprint, bucket keys."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("rk"))
    return rows.mapInArrow(_sketch(width, band_rows(percent)), "doc_id long, rk long, n long, f1 long, f2 long, bands array<long>")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 85) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept, text_hash (xxhash64 of the text).

    Documents whose shingle sets satisfy 100 * |A ∩ B| >= percent * |A ∪ B| are linked;
    component_id is the smallest doc_id reachable. Null, empty or wordless text: an empty
    set, linked with nothing. Null doc_id: its row takes no part in links, component_id
    null, kept true. Repeated rows share a component. Other columns are ignored; an empty
    table gives an empty result.
    """
    width, percent = int(width), int(percent)
    sketch = materialize(shingle_documents(docs, doc_id, text, width, percent), "mm-sketch")
    some = sketch.where("n > 0 AND doc_id IS NOT NULL")
    reps = materialize(some.groupBy("f1", "f2", "n").agg(F.min(F.struct("doc_id", "rk")).alias("r"), F.first("bands").alias("bands")), "mm-reps")
    banded = reps.select(F.col("r.doc_id").alias("rep"), F.col("r.rk").alias("rk"), "n", F.explode("bands").alias("h"))
    shared = banded.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    members = materialize(banded.join(shared, "h"), "mm-members")

    degree = members.groupBy("rep", "rk").agg(F.sum("c").alias("degree"))
    ranked = members.join(degree, ["rep", "rk"])
    pivots = ranked.groupBy("h").agg(F.max(F.struct("degree", -F.col("rep"), "rk", "rep", "n")).alias("p"))
    stars = (
        members.join(pivots, "h")
        .select(F.col("p.rep").alias("p"), F.col("p.rk").alias("prk"), F.col("rep").alias("m"), "rk", members["n"])
        .where("p <> m OR prk <> rk")
        .distinct()
    )
    stars = materialize(stars, "mm-stars")
    # Written first, so that the join reads two plain tables and a hot pivot can be split.
    sizes = materialize(stars.groupBy("p", "prk").agg(F.count("*").alias("k"), F.sum("n").alias("all_n")), "mm-sizes")
    dealt = stars.join(sizes, ["p", "prk"]).withColumn("blocks", F.greatest(F.ceil(F.col("k") / BLOCK_ROWS), F.ceil(F.col("all_n") / BLOCK_SHINGLES)).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("m", "rk"), F.col("blocks")).cast("int"))
    dealt = materialize(dealt.select("p", "prk", "m", "rk", "block", "blocks"), "mm-dealt")

    pivot_rows = dealt.select("p", "prk", F.col("p").alias("m"), F.col("prk").alias("rk"), "block", "blocks").distinct().withColumn("first", F.lit(0))
    wanted = pivot_rows.unionByName(dealt.withColumn("first", F.lit(1)))
    texts = materialize(_texts(docs, doc_id, text, dealt), "mm-texts")
    rows = wanted.join(texts, ["m", "rk"])
    first = materialize(_first_pass(rows, width, percent), "mm-links")
    links = first.where("b IS NOT NULL").select("a", "b")

    # Pivot groups of several blocks: what the pivot does not hold is compared with the other blocks.
    many = dealt.where("blocks > 1")
    if not many.limit(1).isEmpty():
        lone = first.where("b IS NULL").select("p", "prk", F.col("a").alias("m"), F.lit(False).alias("joined")).distinct()
        part = materialize(many.join(lone, ["p", "prk", "m"], "left").withColumn("joined", F.coalesce("joined", F.lit(True))), "mm-part")
        links = links.unionByName(_second_pass(_sides(part).join(texts, ["m", "rk"]), width, percent))

    labels = connected_components(links, "mm-cc")
    classes = reps.select("f1", "f2", "n", F.col("r.doc_id").alias("v")).join(labels, "v", "left")
    # Written first, so that the join below reads two plain tables and a hot class can be split.
    classes = materialize(classes.select("f1", "f2", "n", F.coalesce("component", "v").alias("component_id")), "mm-classes")
    out = sketch.select("doc_id", "rk", "n", "f1", "f2").join(classes, ["f1", "f2", "n"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.cast("long").alias("component_id"), "rk").select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), F.col("rk").alias("text_hash")
    )


def _sides(part: DataFrame) -> DataFrame:
    """Members of blocks i and j (side 0 and 1) to compare: those of i that the pivot does not hold with all of j.
    Blocks without such members, as side 0, bring no rows."""
    left = part.where("NOT joined").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("block <> j")
    asking = part.where("NOT joined").select("p", "prk", F.col("block").alias("i")).distinct()
    right = part.join(asking, ["p", "prk"]).where("block <> i")
    rows = left.select("p", "prk", "m", "rk", "joined", F.col("block").alias("i"), "j", F.lit(0).alias("side"))
    return rows.unionByName(right.select("p", "prk", "m", "rk", "joined", "i", F.col("block").alias("j"), F.lit(1).alias("side")))


def _texts(docs: DataFrame, doc_id: str, text: str, dealt: DataFrame) -> DataFrame:
    """(m, rk, text) of the candidate documents, one row each."""
    need = dealt.select("m", "rk").unionByName(dealt.select(F.col("p").alias("m"), F.col("prk").alias("rk"))).distinct()
    rows = docs.select(F.col(doc_id).cast("long").alias("m"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("rk"))
    if need.count() <= PICK_ROWS:
        need = F.broadcast(need)
    return rows.join(need, ["m", "rk"], "left_semi").groupBy("m", "rk").agg(F.first("text").alias("text"))


def _first_pass(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b), and rows (a, null) for members the pivot of a split group lacks."""

    def block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["first", "m", "rk"], ignore_index=True)
        links, lone = _links(None, pdf, None, width, percent)
        if int(pdf["blocks"].iloc[0]) > 1:
            links = [*links, *((x, None) for x in sorted(lone))]
        return pd.DataFrame({"p": int(key[0]), "prk": int(key[1]), "a": pd.array([x for x, _ in links], "Int64"), "b": pd.array([y for _, y in links], "Int64")})

    return many_tasks(rows, "p", "prk", "block").groupBy("p", "prk", "block").applyInPandas(block, "p long, prk long, a long, b long")


def _second_pass(rows: DataFrame, width: int, percent: int) -> DataFrame:
    def pair(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        links = _links(None, left, right, width, percent)[0] if len(left) and len(right) else []
        return pd.DataFrame({"a": pd.array([x for x, _ in links], "Int64"), "b": pd.array([y for _, y in links], "Int64")})

    return many_tasks(rows, "p", "prk", "i", "j").groupBy("p", "prk", "i", "j").applyInPandas(pair, "a long, b long")
