"""Line deduplication by a log-template tree.

Parsing has a fixed depth, as in Drain (He et al. 2017): a line goes by its number of tokens
and its ``LEADING`` first tokens to a leaf; tokens with a digit are variable from the start.
Where leading words themselves vary, the way is by a node's wildcard child, which all lines
of that many tokens enter, and on by their ``LEADING`` last tokens. So a template is found if
its first or its last three tokens are fixed; one with variable fields at both ends is not.

In a leaf, a token is part of a template if at least ``MIN_DOCS`` documents have it at its
place; other places are variable fields. (Drain compares lines with a leaf's clusters one
by one; support per place gives the same generalisation as counts, whatever the order of
lines, and never gathers a leaf.) A template is kept if at least half its tokens are fixed.

A template that recurs across documents is boilerplate, and its lines are dropped. Copies of a
document are not evidence: documents whose sets of three-word shingles are alike (one-permutation
min-hashes of ``BINS`` bins; banded, then compared in full with the least member of each bucket;
``ALIKE`` of them must be equal, so that a pair at similarity 0.8 is missed with chance 1e-4, and two
documents that share less than about 3/4 of their words are not joined) form a group, and a group has
one vote, however large it is. A template needs ``MIN_DOCS`` votes. Whole copies are for near-duplicate
removal, which keeps one of them whole. Of the votes for one line only the ``MIN_DOCS`` least go on:
whether a union of such sets reaches ``MIN_DOCS`` does not depend on the rest, as one full set suffices.

A long exact repeat needs no such support: a line goes if it lies wholly in a run of ``LONG`` or
more words, wherever its lines break, that ``LONG_DOCS`` votes hold word for word. Candidates
are runs of ``GRAM`` words picked by winnowing (Schleimer et al. 2003), which picks one in every
``LONG`` words, the same in all texts; around those that recur, all windows of ``LONG`` words are
compared. Lines that a passage covers in part stay, and so does a passage inside one line.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .kernels import U64, Keys, mix, runs, utf8, word_table
from .scratch import fresh_name, longs, materialize, small_batches
from .support import Arrays, least_values

LEADING, MIN_DOCS, FIXED_SHARE = 3, 10, 0.5
LONG, GRAM, LONG_DOCS = 50, 10, 2
#: Min-hashes of a document, in bands of ``ROWS``: a pair at similarity 0.8 misses all 20 bands with chance 3e-5.
BINS, ROWS, ALIKE = 80, 4, 0.6
#: Up to so many 64-bit keys (of lines, fields, passages) go to the scanning tasks; beyond, a shuffled join.
SENT_KEYS = 2_000_000

_VARIABLE = U64(0x2A)
_rng = np.random.Generator(np.random.PCG64(11))
_POWER = _rng.integers(1, 2**63, 5, dtype=np.int64).astype(U64) * U64(2) + U64(1)
#: For each bin all others, in an order of its own: where an empty bin takes its value from.
_ELSEWHERE = np.stack([_rng.permutation(np.delete(np.arange(BINS), i)) for i in range(BINS)], 1)
_EMPTY = np.uint32(2**32 - 1)



def _lines(raw: np.ndarray, offs: np.ndarray, h: np.ndarray, at: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """For every line with a token: text, number in it, first token, tokens, hash; and all tokens' hashes, variables masked."""
    token = h.copy()
    digit = np.flatnonzero((raw - np.uint8(48)) < 10)
    token[np.searchsorted(at, digit, "right") - 1] = _VARIABLE
    breaks = np.flatnonzero(raw == 10)
    head = np.zeros(len(h) + 1, bool)
    head[np.searchsorted(at, breaks)] = True
    head[start] = True
    first = np.flatnonzero(head[:-1])
    count = np.diff(np.append(first, len(h)))
    text = np.searchsorted(start, first, "right") - 1
    number = np.searchsorted(breaks, at[first]) - np.searchsorted(breaks, offs[text])
    place = np.arange(len(h)) - np.repeat(first, count)
    spread = mix(token + place.astype(U64) * _POWER[0])
    whole = mix(np.add.reduceat(spread, first) + count.astype(U64)) if len(first) else np.zeros(0, U64)
    return text, number, first, count, whole, token


def _leaves(first: np.ndarray, count: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The leaf that each line reaches by its first tokens, and the one by the wildcard child and its last (one leaf for short lines)."""
    lead, tail = count.astype(U64) * _POWER[3], count.astype(U64) * _POWER[4]
    for k in range(LEADING):
        some = count > k
        lead[some] = mix(lead[some] + token[first[some] + k] * _POWER[1])
        tail[some] = mix(tail[some] + token[(first + count)[some] - 1 - k] * _POWER[2])
    return lead, np.where(count > LEADING, tail, lead)


def _spread(x: np.ndarray, width: int, join: Callable) -> np.ndarray:
    """``join`` over x[i : i + width] for every i, as far as x goes; join(left, right, items on the right)."""
    out, have, part, size = None, 0, x, 1
    while True:
        if width & size:
            out, have = (part, size) if out is None else (join(part[: len(x) - have - size + 1], out[size:], have), have + size)
        size *= 2
        if size > width:
            return out
        part = join(part[: max(0, len(part) - size // 2)], part[size // 2 :], size // 2)


def _windows(h: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``width`` words from each word on, and whether its text (``start``: first words, len+1) has so many."""
    if len(h) < width:
        return np.zeros(0, U64), np.zeros(0, bool)
    key = _spread(h, width, lambda x, y, n: x * U64(pow(int(_POWER[1]), n, 2**64)) + y)
    left = np.repeat(start[1:], np.diff(start)) - np.arange(len(h))
    return mix(key ^ _POWER[3]) + U64(width), left[: len(key)] >= width


def _picked(h: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of the runs that winnowing picks, and their hashes."""
    if len(h) < LONG:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    key, _ = _windows(h, start, GRAM)
    least = _spread(key, LONG - GRAM + 1, lambda x, y, _: np.minimum(x, y))
    left = np.repeat(start[1:], np.diff(start)) - np.arange(len(h))
    least[left[: len(least)] < LONG] = 0
    pad = np.zeros(LONG - GRAM, U64)
    run = np.flatnonzero(_spread(np.concatenate([pad, least, pad]), LONG - GRAM + 1, lambda x, y, _: np.maximum(x, y)) == key)
    return run, key[run]


def _sketches(h: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The least hash in each bin of each text's three-word shingles (of its words, if it has fewer); empty bins
    take the value of another. Texts have words."""
    n = np.diff(start)
    three = mix(h * _POWER[0] + np.roll(h, -1) * _POWER[1] + np.roll(h, -2) * _POWER[2])
    for back in (1, 2):  # a text's last two words begin no shingle: the one before, or the word itself, stands in
        last = start[1:][n >= 3] - back
        three[last] = three[start[1:][n >= 3] - 3]
    short = np.repeat(n < 3, n)
    three[short] = h[short]
    own = np.full(len(n) * BINS, _EMPTY)
    slot = np.repeat(np.arange(len(n)) * BINS, n) + ((three >> U64(32)) * U64(BINS) >> U64(32)).astype(np.int64)
    np.minimum.at(own, slot, np.minimum(three & U64(0xFFFFFFFF), U64(_EMPTY - 1)).astype(np.uint32))
    own = own.reshape(len(n), BINS)
    out = own.copy()
    row, bin_ = np.nonzero(own == _EMPTY)
    for other in _ELSEWHERE:
        if not len(row):
            break
        out[row, bin_] = own[row, other[bin_]]
        left = out[row, bin_] == _EMPTY
        row, bin_ = row[left], bin_[left]
    return out


def _bands(sketch: np.ndarray) -> np.ndarray:
    deal = sketch.astype(U64).reshape(len(sketch), BINS // ROWS, ROWS)
    key = np.broadcast_to(mix(np.arange(1, BINS // ROWS + 1, dtype=U64)), deal.shape[:2])
    for k in range(ROWS):
        key = mix(key * _POWER[0] + deal[:, :, k])
    return key


def _parts(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, their offsets, word hashes, word starts, first word of each text) of blocks of texts."""
    raw, offs = utf8(batch.column(column))
    for i, j in runs(offs):
        part, own = raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        h, at = word_table(part, own)
        yield i, j, part, own, h, at, np.searchsorted(at, own)


def _ints(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _record(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


#: A row is a block of texts: its documents with their bands and sketches, their lines, and their picked runs of words.
_SCAN = ("doc", "bands", "sketch", "line_doc", "line", "lead", "tail", "run_doc", "run")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc = batch.column("doc").to_numpy(zero_copy_only=False)
        for i, j, raw, offs, h, at, start in _parts(batch, "text"):
            if not len(h):
                continue
            text, _, first, count, whole, token = _lines(raw, offs, h, at, start)
            lead, tail = _leaves(first, count, token)
            run, key = _picked(h, start)
            worded = np.flatnonzero(np.diff(start))
            sketch, own = _sketches(h, np.append(start[worded], len(h))), doc[i:j]
            columns = (own[worded], _bands(sketch), sketch, own[text], whole, lead, tail, own[np.searchsorted(start, run, "right") - 1], key)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in columns], names=list(_SCAN))


def _blobs(batch: pa.RecordBatch, *names: str) -> Iterator[tuple[np.ndarray, ...]]:
    """The 64-bit numbers in the columns of each row."""
    for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
        yield tuple(np.frombuffer(x, U64) for x in row)


def _scan_windows(wanted: np.ndarray | None):
    """(hash, doc) of the windows of ``LONG`` words around the ``wanted`` runs; None: around each text's own, in ``runs``."""

    among = None if wanted is None else Keys(wanted)

    def arrays(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        doc = batch.column("doc").to_numpy(zero_copy_only=False)
        for i, j, _, _, h, _, start in _parts(batch, "text"):
            key, whole = _windows(h, start, LONG)
            if not len(key):
                continue
            grams = _windows(h, start, GRAM)[0]
            if among is not None:
                near = among(grams)
            else:
                own = [np.array(x, np.int64).view(U64) for x in batch.column("runs").slice(i, j - i).to_pylist()]
                near = _own_keys(own, grams, np.searchsorted(start, np.arange(len(grams)), "right") - 1)
            some = np.flatnonzero(whole & _spread(near, LONG - GRAM + 1, lambda x, y, _: x | y))
            yield key[some], doc[i:j][np.searchsorted(start, some, "right") - 1]

    return arrays


def _scan_tokens(wanted: np.ndarray | None):
    """hash, leaf and tokens of the ``wanted`` lines, each once a task (None: of all lines), for both their leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        among = None if wanted is None else Keys(wanted)
        seen = None if wanted is None else np.zeros(len(wanted), bool)
        for batch in batches:
            for _, _, raw, offs, h, at, start in _parts(batch, "text"):
                _, _, first, count, whole, token = _lines(raw, offs, h, at, start)
                take = np.arange(len(whole))
                if among is not None:
                    take = np.flatnonzero(among(whole))
                    place, once = np.unique(among.place(whole[take]), return_index=True)
                    take = np.sort(take[once[~seen[place]]])
                    seen[place] = True
                lead, tail = _leaves(first, count, token)
                size = count[take]
                at_ = np.repeat(first[take] - np.cumsum(size) + size, size) + np.arange(size.sum())
                ends = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
                yield _record(hash=_ints(whole[take]), lead=_ints(lead[take]), tail=_ints(tail[take]), tokens=pa.ListArray.from_arrays(ends, _ints(token[at_])))

    return run


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All items of a list column, and how many each row has."""
    return lists.flatten().to_numpy(zero_copy_only=False).view(U64), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _fields(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lines (leaf, tokens): each token's field (a hash of leaf, place and token; 0 for variables), tokens per line, places."""
    token, count = _flat(batch.column("tokens"))
    place = np.arange(len(token)) - np.repeat(np.cumsum(count) - count, count)
    leaf = np.repeat(batch.column("leaf").to_numpy(zero_copy_only=False).view(U64), count)
    field = mix(mix(leaf + place.astype(U64) * _POWER[0]) + token * _POWER[1])
    field[token == _VARIABLE] = 0
    return field, count, place


def _times(key: np.ndarray, line: np.ndarray, votes: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Each key with each vote of its line."""
    vote, size = _flat(votes)
    times = size[line]
    first = np.repeat((np.cumsum(size) - size)[line], times)
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return np.repeat(key, times), vote[first + nth]


def _field_votes(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for at in range(0, batch.num_rows, 64):
        part = batch.slice(at, 64)
        field, count, _ = _fields(part)
        line = np.repeat(np.arange(part.num_rows), count)
        yield _times(field[field > 0], line[field > 0], part.column("votes"))


def _template_votes(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    template = batch.column("template").to_numpy(zero_copy_only=False).view(U64)
    yield _times(template, np.arange(batch.num_rows), batch.column("votes"))


def _templates(fixed: np.ndarray):
    """(hash, votes, template) of lines (leaf, hash, tokens, votes) of whose tokens enough are ``fixed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        among = Keys(fixed)
        for batch in batches:
            field, count, place = _fields(batch)
            held = among(field) & (field > 0)
            first = np.cumsum(count) - count
            n = np.add.reduceat(held.astype(np.int64), first) if len(count) else count
            whole = np.add.reduceat(np.where(held, field, mix(place.astype(U64) + _POWER[2])), first) if len(count) else np.zeros(0, U64)
            leaf = batch.column("leaf").to_numpy(zero_copy_only=False).view(U64)
            out = _record(hash=batch.column("hash"), votes=batch.column("votes"), template=_ints(mix(whole + leaf * _POWER[4])))
            yield out.filter(pa.array(n >= FIXED_SHARE * count))

    return run


def _sent(keys: DataFrame, name: str) -> tuple[DataFrame, np.ndarray | None]:
    """``keys`` (one column of longs) written once, and their values if there are few enough."""
    keys = materialize(keys, name)
    return keys, longs(keys)[0] if keys.count() <= SENT_KEYS else None


def _groups(scan: DataFrame) -> DataFrame:
    """(doc, vote) of the documents that are alike to others, vote the least document of the group."""

    def banded(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for doc, bands in _blobs(batch, "doc", "bands"):
            yield bands, np.repeat(doc, BINS // ROWS)

    docs = scan.select("doc", "bands", "sketch")
    shared = materialize(least_values(docs, banded, 2).select(F.col("key").alias("h"), F.col("held")[0].alias("p")), "line-shared")
    keys = first = None
    if shared.count() <= SENT_KEYS:
        keys, first = longs(shared)
        order = np.argsort(keys)
        keys, first = keys[order], first[order]

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each document with the first one of its shared buckets; of all its buckets (h, doc), if these are not at hand."""
        for batch in batches:
            for h, doc in banded(batch):
                if keys is None:
                    yield _record(p=_ints(h), doc=_ints(doc))
                    continue
                at = np.minimum(np.searchsorted(keys, h.ravel().view(np.int64)), max(0, len(keys) - 1))
                hit = keys[at] == h.ravel().view(np.int64) if len(keys) else np.zeros(len(doc), bool)
                both = np.unique(np.stack([first[at[hit]], doc[hit].view(np.int64)], 1), axis=0)
                yield _record(p=_ints(both[:, 0]), doc=_ints(both[:, 1]))

    pairs = docs.mapInArrow(members, "p long, doc long")
    if keys is None:
        pairs = pairs.withColumnRenamed("p", "h").join(shared, "h").select("p", "doc")
    pairs = materialize(pairs.where("p <> doc").distinct(), "line-pairs")
    need, wanted = _sent(pairs.select("doc").unionByName(pairs.select(F.col("p").alias("doc"))).distinct(), "line-need")

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        among = None if wanted is None else Keys(wanted)
        for batch in batches:
            for doc, sketch in _blobs(batch, "doc", "sketch"):
                rows = np.arange(len(doc)) if among is None else np.flatnonzero(among(doc))
                yield _record(doc=_ints(doc[rows]), sketch=pa.array([x.tobytes() for x in sketch.view(np.uint32).reshape(-1, BINS)[rows]], pa.binary()))

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, BINS) for c in ("sketch", "other"))
            yield batch.select(["p", "doc"]).filter(pa.array((x == y).sum(1) >= ALIKE * BINS))

    # One sketch for each document, whatever the copies of its text.
    own = materialize(docs.mapInArrow(sketches, "doc long, sketch binary").groupBy("doc").agg(F.first("sketch").alias("sketch")), "line-sketches")
    both = pairs.join(own, "doc").join(own.select(F.col("doc").alias("p"), F.col("sketch").alias("other")), "p")
    links = both.select("p", "doc", "sketch", "other").mapInArrow(alike, "a long, b long")
    return connected_components(links, "line-cc").select(F.col("v").alias("doc"), F.col("component").alias("vote"))


class _Voting:
    """Supports counted in votes: a document's is that of its group, or its own."""

    def __init__(self, groups: DataFrame):
        self.groups = materialize(groups, "line-groups")
        self.docs = self.votes = None
        if self.groups.count() <= SENT_KEYS:
            docs, votes = longs(self.groups.select("doc", "vote"))
            order = np.argsort(docs)
            self.docs, self.votes = docs[order], votes[order]

    def reach(self, source: DataFrame, arrays: Arrays, k: int, need: int | None = None) -> DataFrame:
        """``least_values`` of the votes for each key; ``arrays`` gives keys and documents."""
        docs, votes = self.docs, self.votes
        if docs is None:

            def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for key, doc in arrays(batch):
                        yield _record(key=_ints(key), doc=_ints(doc))

            def joined(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
                yield tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "vote"))

            held = source.mapInArrow(rows, "key long, doc long").join(self.groups, "doc", "left")
            return least_values(held.select("key", F.coalesce("vote", "doc").alias("vote")), joined, k, need)

        def voted(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for key, doc in arrays(batch):
                doc = np.array(doc).view(np.int64)
                if len(docs):
                    at = np.minimum(np.searchsorted(docs, doc), len(docs) - 1)
                    doc = np.where(docs[at] == doc, votes[at], doc)
                yield key, doc

        return least_values(source, voted, k, need)


def recurring_lines(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """(hash): the lines, their variables masked, whose template recurs across documents, and the passages that do."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("doc"))  # copies of a text are one document here
    scan = materialize(rows.mapInArrow(_scan, ", ".join(f"{c} binary" for c in _SCAN)), "line-scan")
    voting = _Voting(_groups(scan))

    def runs_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield from _blobs(batch, "run", "run_doc")

    picked = scan.select("run", "run_doc")
    again, around = _sent(voting.reach(picked, runs_of, LONG_DOCS).select("key"), "line-runs")
    texts = rows
    if around is None:  # each text brings its own

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for key, doc in runs_of(batch):
                    yield _record(key=_ints(key), doc=_ints(doc))

        own = picked.mapInArrow(pairs, "key long, doc long").distinct().join(again, "key").groupBy("doc").agg(F.collect_list("key").alias("runs"))
        texts = rows.join(own, "doc")
    passages = voting.reach(texts, _scan_windows(around), LONG_DOCS).select(F.col("key").alias("hash"))

    def leaves_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for lead, tail, doc in _blobs(batch, "lead", "tail", "line_doc"):
            other = lead != tail
            yield np.concatenate([lead, tail[other]]), np.concatenate([doc, doc[other]])

    lined = scan.select("line", "lead", "tail", "line_doc")
    leaves, crowded = _sent(voting.reach(lined, leaves_of, min_docs).select(F.col("key").alias("leaf")), "line-leaves")

    among = None if crowded is None else Keys(crowded)

    def lines_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for line, lead, tail, doc in _blobs(batch, "line", "lead", "tail", "line_doc"):
            some = slice(None) if among is None else among(lead) | among(tail)
            yield line[some], doc[some]

    # Votes of each line in these leaves, and its tokens from a text that holds it.
    held = materialize(voting.reach(lined, lines_of, min_docs, 1).select(F.col("key").alias("hash"), F.col("held").alias("votes")), "line-votes")
    keys = longs(held.select("hash"))[0] if held.count() <= SENT_KEYS else None
    worded = rows.select("text").mapInArrow(_scan_tokens(keys), "hash long, lead long, tail long, tokens array<long>")
    worded = held.join(worded.groupBy("hash").agg(*(F.first(c).alias(c) for c in ("lead", "tail", "tokens"))), "hash")
    inside = worded.select("hash", "votes", "tokens", F.explode(F.array_distinct(F.array("lead", "tail"))).alias("leaf"))
    if crowded is None:
        inside = inside.join(leaves, "leaf", "left_semi")
    inside = materialize(inside.select("leaf", "hash", "votes", "tokens"), "line-worded")
    fixed, fields = _sent(least_values(inside.select("leaf", "votes", "tokens"), _field_votes, min_docs).select(F.col("key").alias("field")), "line-fields")
    if fields is not None:
        templates = inside.mapInArrow(_templates(fields), "hash long, votes array<long>, template long")
    else:
        templates = _joined_templates(inside, fixed)
    seen = materialize(templates, "line-seen")
    dropped = least_values(seen.select("template", "votes"), _template_votes, min_docs).select(F.col("key").alias("template"))
    return seen.join(dropped, "template", "left_semi").select("hash").unionByName(passages).distinct()


def _joined_templates(inside: DataFrame, fixed: DataFrame) -> DataFrame:
    """What ``_templates`` gives, by a join with the fixed fields."""

    def fields(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            field, count, place = _fields(batch)
            of = np.repeat(np.arange(batch.num_rows), count)
            yield _record(leaf=batch.column("leaf").take(of), hash=batch.column("hash").take(of), place=pa.array(place), field=_ints(field))

    placed = inside.mapInArrow(fields, "leaf long, hash long, place long, field long")
    marked = placed.join(fixed.withColumn("fixed", F.lit(True)), "field", "left")
    field = F.struct("place", F.when(F.col("fixed"), F.col("field")).alias("field"))
    whole = F.xxhash64("leaf", F.array_sort(F.collect_list(field)))
    named = marked.groupBy("leaf", "hash").agg(F.count("fixed").alias("f"), F.count("*").alias("k"), whole.alias("template"))
    return named.where(F.col("f") >= FIXED_SHARE * F.col("k")).select("leaf", "hash", "template").join(inside, ["leaf", "hash"]).select("hash", "votes", "template")


def drop_recurring_lines(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` without the lines whose template, or a passage they are in, recurs across documents: all columns, ``text``
    rebuilt from the lines left, and n_lines and n_dropped (columns of these names are replaced).

    Lines end at newlines; blank lines are never dropped. A null text stays null (0 lines), an
    empty one is one line. Texts of any length are whole. Equal texts are treated alike and count
    as one document; null ids and repeated rows are kept as they are; other columns may have any
    names; an empty table gives no rows. Ties do not arise: a support is reached or not.
    """
    drop, hashes = _sent(recurring_lines(docs, text, min_docs), "line-drop")
    keep = [c for c in docs.columns if c not in (text, "n_lines", "n_dropped")]
    order = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    mine = fresh_name(docs, "drop")
    named = docs.select(*(F.col(f"`{c}`") for c in [*keep, text]))
    if hashes is not None:
        rows = named.withColumn(mine, F.lit(None).cast("array<long>"))
    else:  # each text brings the hashes that it has among those dropped
        key = fresh_name(docs, "key")
        texts = docs.select(F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("doc"))
        own = texts.mapInArrow(_scan_hashes, "doc long, hash long").distinct().join(drop, "hash", "left_semi").groupBy(F.col("doc").alias(key)).agg(F.collect_list("hash").alias(mine))
        rows = named.withColumn(key, F.xxhash64(F.col(text))).join(own, key, "left").drop(key)

    among = None if hashes is None else Keys(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, made, size, lines, lost = batch.column(text), [], [], [], []
            for i, j, raw, offs, h, at, start in _parts(batch, text):
                which, number, first, _, whole, _ = _lines(raw, offs, h, at, start)
                key, some = _windows(h, start, LONG)
                if among is not None:
                    hit, some = among(whole), np.flatnonzero(some & among(key))
                else:
                    own = [np.array(x or [], np.int64).view(U64) for x in batch.column(mine).slice(i, j - i).to_pylist()]
                    hit, some = _own_keys(own, whole, which), np.flatnonzero(some)
                    some = some[_own_keys(own, key[some], np.searchsorted(start, some, "right") - 1)]
                if len(some):  # lines whose every word is in such a window
                    cover = np.zeros(len(h) + 1, np.int64)
                    cover[some] += 1
                    cover[some + LONG] -= 1
                    hit |= np.minimum.reduceat(np.cumsum(cover[:-1]), first) > 0
                left, ends, had = _without(raw, offs, which[hit], number[hit])
                made.append(left), size.append(np.diff(ends)), lines.append(had), lost.append(np.bincount(which[hit], minlength=j - i))
            ends = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *size]))]).astype(np.int64)
            data = np.concatenate([np.zeros(0, np.uint8), *made])
            texts = pa.Array.from_buffers(pa.large_string(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(data)]).cast(pa.string())
            texts = pc.if_else(column.is_valid(), texts, pa.scalar(None, pa.string()))
            counts = [np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (lines, lost)]
            counts[0][column.is_null().to_numpy(zero_copy_only=False)] = 0
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), texts, *map(pa.array, counts)], names=[*keep, text, "n_lines", "n_dropped"])

    schema = [*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), f"`{text}` string", "n_lines long", "n_dropped long"]
    return rows.mapInArrow(run, ", ".join(schema)).select(*(F.col(f"`{c}`") for c in [*order, "n_lines", "n_dropped"]))


def _without(raw: np.ndarray, offs: np.ndarray, which: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts without some lines (text and number, in order), their offsets, and how many lines each text had."""
    breaks = np.flatnonzero(raw == 10)
    before = np.searchsorted(breaks, offs)
    had = np.diff(before) + 1
    if not len(which):
        return raw, offs, had
    edge = np.append(breaks, len(raw))
    own = before[which] + number
    lo = np.where(number > 0, edge[own - 1], offs[which])  # with the newline before, if there is one
    hi = np.where(number < had[which] - 1, edge[own], offs[which + 1])
    # Where first lines go, so does the newline before the first one left.
    nth = np.arange(len(which)) - np.searchsorted(which, which)
    leading = np.bincount(which[nth == number], minlength=len(had))
    some = np.flatnonzero((leading > 0) & (leading < had))
    newline = edge[before[some] + leading[some] - 1]
    lo, hi = np.concatenate([lo, newline]), np.concatenate([hi, newline + 1])
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], hi[order]  # apart from each other, each within a text
    left = [raw[a:b] for a, b in zip([0, *hi.tolist()], [*lo.tolist(), len(raw)], strict=True) if a < b]
    lost = np.concatenate([[0], np.cumsum(hi - lo)])
    return np.concatenate([raw[:0], *left]), offs - lost[np.searchsorted(hi, offs, "right")], had


def _scan_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc and hash of all lines and all windows of ``LONG`` words."""
    for batch in batches:
        doc = batch.column("doc").to_numpy(zero_copy_only=False)
        for i, j, raw, offs, h, at, start in _parts(batch, "text"):
            text, _, _, _, whole, _ = _lines(raw, offs, h, at, start)
            key, some = _windows(h, start, LONG)
            some = np.flatnonzero(some)
            of = np.concatenate([text, np.searchsorted(start, some, "right") - 1])
            yield _record(doc=pa.array(doc[i:j][of]), hash=_ints(np.concatenate([whole, key[some]])))


def _own_keys(own: list[np.ndarray], keys: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Whether each key is among those of its text; keys come text by text."""
    out, ends = np.zeros(len(keys), bool), np.searchsorted(text, np.arange(len(own) + 1))
    for mine, a, b in zip(own, ends[:-1], ends[1:], strict=True):
        if b > a and len(mine):
            out[a:b] = np.isin(keys[a:b], mine)
    return out
