"""Best-fit packing of tokenised documents, after Martello-Toth reduction.

The instance is a histogram: at most ``capacity`` distinct lengths with counts, whatever
the corpus. The driver therefore solves it exactly as it would the full list of items, in
time that depends on the number of lengths and not on the number of documents:

* ``reduce_instance`` fixes, for a longest item j, a set of one to three items that
  dominates every other set which could hold j (Martello and Toth 1990), and removes it;
  equal sets are fixed many at a time;
* ``best_fit_decreasing`` places the remainder, longest first, each in the fullest open
  sequence that still has room, again for all items of one length together.

Both give patterns (lengths of a sequence) with multiplicities. Executors tokenise, number
the pieces of each length within their task, and add the counts of the tasks before them;
a piece's number among its length then names its sequence and place. No group of pieces is
collected, and equal lengths or copies need no salting: numbers come from counts.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize, small_batches

CAPACITY = 1024
#: Longer runs of white space are encoded apart.
BLANK_RUN = 100_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def _encoder(path: str):
    """A function from text to token ids of the tokenizer file, without special tokens added.

    A byte-level BPE file is also read as ranks, which gives the same ids at several times the speed.
    Text with an added token in it, or characters beyond U+024F (where the two
    libraries' Unicode tables might differ), goes to the tokenizer itself. The pattern backtracks
    over white space, so a run of more than ``BLANK_RUN`` is cut out as the one word (without its last
    character, if more text follows) that it is to the pattern.
    """
    import tiktoken
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    spec = json.loads(own.to_str())
    slow = lambda text: own.encode(text, add_special_tokens=False).ids
    pre = spec.get("pre_tokenizer") or {}
    if spec["model"]["type"] != "BPE" or pre != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} or spec.get("normalizer"):
        return slow
    added = [t["content"] for t in spec["added_tokens"]]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    ranks = {bytes(byte_of[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in added}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    ranked = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    other = regex.compile("|".join([r"[^\x00-ɏ]", *map(regex.escape, added)]))
    blanks = regex.compile(rf"[\t-\r \x85\xa0]{{{BLANK_RUN},}}+")

    def fast(text: str) -> list[int]:
        ids, done = [], 0
        for run in blanks.finditer(text) if len(text) >= BLANK_RUN else ():
            end = run.end() - (run.end() < len(text))
            ids += ranked.encode_ordinary(text[done : run.start()]) + ranked._encode_single_piece(text[run.start() : end])
            done = end
        return ids + ranked.encode_ordinary(text[done:]) if done else ranked.encode_ordinary(text)

    return lambda text: slow(text) if other.search(text) else fast(text)


def _tokenise(path: str, end_id: int, capacity: int):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("nth", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = _encoder(path), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows: list[list] = [[] for _ in schema]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                first = len(ids) % capacity or capacity
                for piece, (lo, hi) in enumerate(zip([0, *range(first, len(ids), capacity)], range(first, len(ids) + 1, capacity), strict=True)):
                    row = (doc, piece, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes()), int(seen[hi - lo]))
                    seen[hi - lo] += 1
                    for out, x in zip(rows, row, strict=True):
                        out.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, schema, strict=True)], schema=schema)

    return run


def reduce_instance(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """(fixed patterns with multiplicities, counts left).

    For every length j, longest first, with a the longest item that fits beside it:
    j alone if none fits; j and a if they fill the sequence, if no two items fit beside j,
    or if a is at least the largest pair that fits (with no three fitting); j, a and b, b the
    longest that fits beside both, if no three items fit beside j and no pair of items
    longer than b does. Every set holding j is then dominated by the one fixed.
    """
    left = {k: n for k, n in counts.items() if n > 0}
    if any(not 0 < k <= capacity for k in left):
        raise ValueError("a length is not in 1..capacity")
    order, fixed = sorted(left), []

    def take(sizes: tuple[int, ...], times: int) -> None:
        fixed.append((sizes, times))
        for k in sizes:
            left[k] -= times
            if not left[k]:
                del left[k]
                order.pop(bisect_left(order, k))

    def largest(room: int, used: dict[int, int]) -> int | None:
        """The longest item not used up that fits in ``room``."""
        i = bisect_left(order, room + 1) - 1
        while i >= 0 and left[order[i]] <= used.get(order[i], 0):
            i -= 1
        return order[i] if i >= 0 else None

    def smallest(n: int, used: dict[int, int], above: int = 0) -> list[int]:
        """The n shortest items longer than ``above`` (fewer if there are not so many)."""
        out: list[int] = []
        for k in order[bisect_left(order, above + 1) :]:
            out += [k] * min(n - len(out), left[k] - used.get(k, 0))
            if len(out) >= n:
                break
        return out

    for j in sorted(left, reverse=True):
        while left.get(j):
            room, me = capacity - j, {j: 1}
            a = largest(room, me)
            if a is None:
                take((j,), left[j] if order[0] > room else 1)
                continue
            if a == room:
                take((j, a), min(left[j], left[a]) if a != j else left[j] // 2)
                continue
            two, three = smallest(2, me), smallest(3, me)
            if len(two) < 2 or sum(two) > room:
                take((j, a), max(1, (min(left[j], left[a]) if a != j else left[j] // 2) - 2))
                continue
            if len(three) == 3 and sum(three) <= room:
                break
            b = largest(room - a, {j: 1, a: 1 + (a == j)})
            pair = _best_pair(order, left, room, me)
            if a >= pair:
                take((j, a), 1)
                continue
            longer = smallest(2, me, b) if b is not None else []
            if b is None or len(longer) == 2 and sum(longer) <= room:
                break
            least = min(left[k] // (j, a, b).count(k) for k in {j, a, b})
            take((j, a, b), max(1, least - 2))
    return fixed, left


def _best_pair(order: list[int], left: dict[int, int], room: int, used: dict[int, int]) -> int:
    best, lo, hi = 0, 0, len(order) - 1
    have = lambda k: left[k] - used.get(k, 0)
    while lo <= hi:
        x, y = order[lo], order[hi]
        if x + y > room or have(y) < 1:
            hi -= 1
        elif have(x) < 1 or (lo == hi and have(x) < 2):
            lo += 1
        else:
            best, lo = max(best, x + y), lo + 1
    return best


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with multiplicities: longest first, each item into the least room that holds it."""
    open_bins: dict[int, list[list]] = {}
    rooms: list[int] = []

    def put(room: int, sizes: tuple[int, ...], times: int) -> None:
        if not times:
            return
        if room not in open_bins:
            open_bins[room] = []
            insort(rooms, room)
        open_bins[room].append([sizes, times])

    for k in sorted(counts, reverse=True):
        n = counts[k]
        while n:
            i = bisect_left(rooms, k)
            if i == len(rooms):
                each = capacity // k
                put(capacity - each * k, (k,) * each, n // each)
                put(capacity - (n % each) * k, (k,) * (n % each), int(n % each > 0))
                break
            room = rooms[i]
            sizes, times = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room], rooms[i]
            each = room // k
            full = min(times, n // each)
            rest = min(n - full * each, each) if full < times else 0
            put(room - each * k, sizes + (k,) * each, full)
            put(room - rest * k, sizes + (k,) * rest, int(rest > 0))
            put(room, sizes, times - full - int(rest > 0))
            n -= full * each + rest
    return [(sizes, times) for group in open_bins.values() for sizes, times in group]


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """Where the items of each length go: item number n of ``length``, with first <= n and
    first the greatest such, is in sequence ``sequence`` + (n - first) // each, at offset
    ``offset`` + (n - first) % each * length. Rows: a few per pattern, whatever the counts."""
    fixed, left = reduce_instance(counts, capacity)
    rows, used, sequence = [], dict.fromkeys(counts, 0), 0
    for sizes, times in [*fixed, *best_fit_decreasing(left, capacity)]:
        offset = 0
        for k in sorted(set(sizes), reverse=True):
            each = sizes.count(k)
            rows.append((k, used[k], each, sequence, offset))
            used[k] += each * times
            offset += each * k
        sequence += times
    return pd.DataFrame(rows, columns=["length", "first", "each", "sequence", "offset"]).sort_values(["length", "first"], ignore_index=True).astype("int64")


def _place(plan: pd.DataFrame):
    first, where = plan["first"].to_numpy(), plan["length"].to_numpy()
    start = np.searchsorted(where, np.arange(where.max(initial=0) + 2))
    each, sequence, offset = (plan[c].to_numpy() for c in ("each", "sequence", "offset"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            size, nth = pdf["length"].to_numpy(), pdf["nth"].to_numpy()
            row = np.zeros(len(pdf), np.int64)
            for k in np.unique(size):
                own = size == k
                row[own] = start[k] + np.searchsorted(first[start[k] : start[k + 1]], nth[own], "right") - 1
            past = nth - first[row]
            yield pdf.drop(columns="nth").assign(sequence_id=sequence[row] + past // each[row], offset=offset[row] + past % each[row] * size)

    return run


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Pack all rows of ``docs`` into sequences of at most ``capacity`` tokens.

    Returns one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    A document is its ids and then ``end_id``; only longer ones are cut, into full pieces
    after a first one that may be shorter. Null and empty texts are the end id alone. A null
    doc_id stays null, repeated rows are packed each; other columns are ignored; an empty table
    gives no rows. Texts of any length are whole.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = rows.mapInArrow(_tokenise(tokenizer or default_tokenizer(), end_id, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, nth long")
    pieces = materialize(pieces.withColumn("task", F.spark_partition_id()), "pack-pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("k"))
    before = F.sum("k").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    shift = by_task.withColumn("shift", F.coalesce(before, F.lit(0)))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("k").alias("n")).collect()}  # at most `capacity` rows
    plan = plan_sequences(counts, capacity)
    numbered = pieces.join(shift.select("length", "task", "shift"), ["length", "task"])
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("shift")).alias("nth"))
    return numbered.mapInPandas(_place(plan), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
