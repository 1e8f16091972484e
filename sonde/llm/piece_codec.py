"""SentencePiece encoding and decoding by a max-plus parallel scan.

A segmentation of a text into pieces scores the sum of its pieces' scores; the best one is
found by dynamic programming (ties: the longer last piece). That recursion is linear in the
max-plus semiring, so a long text is cut into chunks, anywhere:

1. each chunk yields a transfer matrix between boundary states. State i at a cut is the
   number of characters by which the piece across it reaches beyond; entry (i, j) is the
   best score of the chunk's pieces when it is entered in i and left in j;
2. matrices combine associatively (``combine``). Blocks of ``BLOCK`` chunks are combined in parallel,
   matrix by matrix; a scan over a text's blocks gives the scores of all states at the start of each
   block, and each block, by itself again, those at every cut;
3. with these each chunk backtraces by itself, for every state it could be left in: a map from the
   state it is left in to the one it is entered in. Maps compose associatively too, and the same three
   steps from the end of the text pick the state that each chunk is left in.

Where no piece spans a word start (checked when a model is loaded; pieces with a space
inside that always lose to their parts are set aside), a chunk's inner words are independent
and each different one is segmented once. Characters in no piece become byte pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import many_tasks, materialize, small_batches

SPACE, LOST = "▁", float("-inf")
#: Trainers mark pieces that are never merged by a score below this. Such a single character counts as the rarest
#: piece; longer ones (runs of spaces) are not used, as one such score would swamp all others.
NEVER = -1e8
#: Characters in a chunk; longer texts than two chunks are scanned in parallel.
CHUNK = 16_384
#: Chunks that are combined in one task before a text's blocks are scanned.
BLOCK = 32
MEMO = 50_000
#: Longest words that are segmented many at a time.
WORD = 40


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces and scores of a SentencePiece model with identity normalisation and a leading space."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int]):
        self.byte_ids, self.text_of = byte_ids, {}
        for p, (i, _) in pieces.items():
            self.text_of[i] = p.replace(SPACE, " ")
        least = min([0.0, *(x for _, x in pieces.values() if x > NEVER)])
        pieces = {p: (i, x if x > NEVER else least - 1.0) for p, (i, x) in pieces.items() if x > NEVER or len(p) == 1}
        whole = {p: x for p, x in pieces.items() if SPACE not in p[1:]}
        self.unknown = least - 10.0
        self.memo: dict[str, tuple[tuple[int, ...], float]] = {}
        self._index(whole)
        across = {}
        for p, x in pieces.items():
            if SPACE in p[1:] and x[1] >= sum(self.word(SPACE + w)[1] if k or p[0] == SPACE else self.word(w)[1] for k, w in enumerate(p.split(SPACE)[p[0] == SPACE :])):
                across[p] = x
        self.separable = not across
        if across:
            self._index(whole | across)
        self.memo.clear()

    def _index(self, pieces: dict[str, tuple[int, float]]) -> None:
        self.longest = max([1, *map(len, pieces)])
        self.trie: dict = {}
        for p, x in pieces.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = x

    def steps(self, text: str, start: int) -> Iterator[tuple[int, int, float]]:
        """(end, id or -1 for bytes, score) of each piece at ``start``, shortest first."""
        node, single = self.trie, False
        for end in range(start, min(len(text), start + self.longest)):
            node = node.get(text[end])
            if node is None:
                break
            if "" in node:
                single |= end == start
                yield end + 1, *node[""]
        if not single:
            yield start + 1, -1, self.unknown

    def forward(self, text: str, best: list[float], stop: int) -> list[tuple[int, int] | None]:
        """Relax all pieces that start before ``stop`` into ``best`` (scores by position; as long as the text plus 1).
        Returns (start, id) of the last piece by position; on ties the earlier start stays."""
        back: list[tuple[int, int] | None] = [None] * len(best)
        for start in range(stop):
            here = best[start]
            if here == LOST:
                continue
            for end, i, score in self.steps(text, start):
                if here + score > best[end]:
                    best[end], back[end] = here + score, (start, i)
        return back

    def emit(self, text: str, back: list[tuple[int, int] | None], end: int) -> tuple[int, list[int]]:
        """Backtrace from ``end``: the position where it stops, and the ids from there on."""
        parts = []
        while back[end] is not None:
            start, i = back[end]
            parts.append([i] if i >= 0 else [self.byte_ids[b] for b in text[start:end].encode()])
            end = start
        return end, [i for part in reversed(parts) for i in part]

    def word(self, word: str) -> tuple[tuple[int, ...], float]:
        """Ids and score of the best segmentation of a short text."""
        known = self.memo.get(word)
        if known is None:
            known = self._segment(word)
            if len(self.memo) >= MEMO:
                self.memo.clear()
            if len(word) < 64:
                self.memo[word] = known
        return known

    def _segment(self, word: str) -> tuple[tuple[int, ...], float]:
        """``forward`` and ``emit`` over the whole of a short text, in one loop."""
        n, trie, longest, unknown = len(word), self.trie, self.longest, self.unknown
        best, back, piece = [0.0] + [LOST] * n, [0] * (n + 1), [-1] * (n + 1)
        for start in range(n):
            here, node, single = best[start], trie, False
            for end in range(start + 1, min(n, start + longest) + 1):
                node = node.get(word[end - 1])
                if node is None:
                    break
                found = node.get("")
                if found is not None:
                    single |= end == start + 1
                    score = here + found[1]
                    if score > best[end]:
                        best[end], back[end], piece[end] = score, start, found[0]
            if not single and here + unknown > best[start + 1]:
                best[start + 1], back[start + 1], piece[start + 1] = here + unknown, start, -1
        out, end = [], n
        while end:
            start = back[end]
            out.append((piece[end],) if piece[end] >= 0 else tuple(self.byte_ids[b] for b in word[start:end].encode()))
            end = start
        return tuple(i for part in reversed(out) for i in part), best[n]

    def words(self, text: str) -> Iterator[str]:
        """Parts of a normalised text that are segmented independently of each other."""
        if not self.separable:
            yield text
            return
        first, *rest = text.split(SPACE)
        for part in [first] if first else []:
            yield from self._lines(part)
        for part in rest:
            yield from self._lines(SPACE + part)

    def _lines(self, part: str) -> Iterator[str]:
        if "\n" in part and "\n" not in self.trie:  # in no piece: a byte of its own
            pieces = part.split("\n")
            for k, x in enumerate(pieces):
                if k:
                    yield "\n"
                if x:
                    yield x
        else:
            yield part

    def encode(self, text: str) -> list[int]:
        return [i for w in self.words(normalise(text)) for i in self.word(w)[0]]

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` of all texts: their ids one after another, and where each text's begin (and the last ends)."""
        number: dict[str, int] = {}
        code, ends = [], [0]
        for t in texts:
            code.extend([number.setdefault(w, len(number)) for w in self.words(normalise(t))])
            ends.append(len(code))
        first, ids = self._segment_all(list(number))
        at = np.array(code, np.int64)
        size = first[at + 1] - first[at]
        places = np.concatenate([[0], np.cumsum(size)])
        take = np.repeat(first[at] - places[:-1], size) + np.arange(places[-1])
        return ids[take], places[ends]

    def _arrays(self) -> tuple[np.ndarray, ...]:
        """The trie in arrays: an open-addressed table of (node, character) -> node, the root's own row, and each node's piece."""
        if not hasattr(self, "_table"):
            edges, ids, scores, stack, count = [], [-1], [LOST], [(0, self.trie)], 1
            root = np.zeros(0x110000, np.int32)
            while stack:
                number, node = stack.pop()
                for c, below in node.items():
                    if c == "":
                        ids[number], scores[number] = below
                        continue
                    ids.append(-1), scores.append(LOST)
                    if number:
                        edges.append((number << 21 | ord(c), count))
                    else:
                        root[ord(c)] = count
                    stack.append((count, below))
                    count += 1
            bits = max(4, (4 * len(edges)).bit_length())
            keys, values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
            for key, value in edges:
                at = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> (64 - bits)
                while keys[at] != -1:
                    at = (at + 1) & ((1 << bits) - 1)
                keys[at], values[at] = key, value
            self._table = keys, values, np.uint64(64 - bits), root, np.array(ids, np.int32), np.array(scores)
        return self._table

    def _segment_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``_segment`` of each word: where its ids begin (and the last ends), and all ids."""
        _, _, _, root, ids, _ = self._arrays()
        lengths = np.array([len(w) for w in words], np.int64)
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(lengths)])
        strange = np.concatenate([[0], np.cumsum(ids[root[chars]] < 0)])  # characters that are no piece
        many = (strange[begin[1:]] == strange[begin[:-1]]) & (lengths <= WORD) & (lengths > 0)
        order = np.flatnonzero(many)
        order = order[np.argsort(-lengths[order], kind="stable")]
        found = [self._segment_some(chars, begin[o], lengths[o], o) for o in (order[i : i + 4096] for i in range(0, len(order), 4096))]
        for i in np.flatnonzero(~many):
            one = self.word(words[i])[0]
            found.append((np.full(len(one), i), np.array(one, np.int32)))
        which = np.concatenate([np.zeros(0, np.int64), *(w for w, _ in found)])
        piece = np.concatenate([np.zeros(0, np.int32), *(x for _, x in found)])
        return np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(words)))]), piece[np.argsort(which, kind="stable")]

    def _segment_some(self, chars: np.ndarray, begin: np.ndarray, size: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, id) of all pieces, a word's in order. All words go through one position at a time, the longest first;
        every character of theirs is a piece."""
        keys, values, shift, root, ids, scores = self._arrays()
        n, longest, mask = len(size), int(size[0]), np.int64(len(keys) - 1)
        reach = np.searchsorted(-size, -np.arange(longest + 1), "left")  # words longer than a position
        best = np.full((longest + 1, n), LOST)
        best[0] = 0.0
        back, piece = np.zeros((longest + 1, n), np.int16), np.zeros((longest + 1, n), np.int32)
        text = [chars[begin[: reach[at]] + at] for at in range(longest)]
        for start in range(longest):
            row, node = np.arange(reach[start]), root[text[start]].astype(np.int64)
            for at in range(start, min(longest, start + self.longest)):
                if at > start:
                    live = row < reach[at]
                    row, node = row[live], node[live]
                    key = node << 21 | text[at][row]
                    slot = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> shift).view(np.int64)
                    have = keys[slot]
                    while len(clash := np.flatnonzero((have != key) & (have != -1))):
                        slot[clash] = (slot[clash] + 1) & mask
                        have = keys[slot]
                    live = have == key
                    row, node = row[live], values[slot[live]].astype(np.int64)
                    if not len(row):
                        break
                score = best[start][row] + scores[node]
                better = score > best[at + 1][row]
                r = row[better]
                best[at + 1][r], back[at + 1][r], piece[at + 1][r] = score[better], start, ids[node[better]]
        word, end, parts = np.arange(n), size.copy(), []
        while len(word):
            parts.append((word, piece[end, word]))
            end = back[end, word].astype(np.int64)
            word, end = word[end > 0], end[end > 0]
        which, out = (np.concatenate([p[k] for p in reversed(parts)]) for k in (0, 1))  # last pieces came first
        return names[which], out

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of ids: spaces for their marks, byte pieces joined as UTF-8 (bad bytes as U+FFFD), the leading space off."""
        parts, run, byte_of = [], bytearray(), {i: b for b, i in enumerate(self.byte_ids)}
        for i in ids:
            b = byte_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                parts.append(run.decode("utf-8", "replace"))
                run = bytearray()
            parts.append(self.text_of.get(i, ""))
        if run:
            parts.append(run.decode("utf-8", "replace"))
        return "".join(parts).removeprefix(" ")

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """``decode`` of many: all ``ids`` one after another, and where each text's begin (and the last ends)."""
        if not hasattr(self, "_bytes"):
            spelt = {i: t.encode() for i, t in self.text_of.items()} | {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
            pieces = [spelt.get(i, b"") for i in range(max(spelt, default=-1) + 2)]  # the last stands for any other id
            self._bytes = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum([0, *map(len, pieces)])
        raw, first = self._bytes
        ids = np.where((ids >= 0) & (ids < len(first) - 1), ids, len(first) - 2)
        size = first[ids + 1] - first[ids]
        at = np.concatenate([[0], np.cumsum(size)])
        data = raw[np.repeat(first[ids] - at[:-1], size) + np.arange(at[-1])]
        cuts = at[ends]
        begin, stop = cuts[:-1], cuts[1:]
        begin = begin + ((stop > begin) & (data[np.minimum(begin, len(data) - 1)] == 32) if len(data) else 0)
        whole = data.tobytes()
        return pa.array([whole[b:e].decode("utf-8", "replace") for b, e in zip(begin.tolist(), stop.tolist(), strict=True)], pa.string())

    # --- chunks

    def _split(self, text: str, size: int) -> tuple[int, int]:
        """First and last word start inside a chunk of ``size`` characters, or (-1, -1)."""
        if not self.separable:
            return -1, -1
        return text.find(SPACE, 0, size), text.rfind(SPACE, 0, size)

    def transfer(self, text: str, size: int) -> np.ndarray:
        """The chunk's matrix; ``text`` goes ``longest`` - 1 characters beyond its ``size``, if there are so many."""
        n, (first, last) = self.longest, self._split(text, size)
        out = np.full((n, n), LOST)
        if first < 0:
            for i in range(n):
                out[i] = self._leave(text, size, i, 0.0)
            return out
        head = np.full(n, LOST)
        for i in range(min(n, first + 1)):
            best = [LOST] * (first + 1)
            best[i] = 0.0
            self.forward(text[:first], best, first)
            head[i] = best[first]
        inner = sum(self.word(w)[1] for w in self.words(text[first:last]))
        return head[:, None] + inner + self._leave(text[last:], size - last, 0, 0.0)[None, :]

    def _leave(self, text: str, size: int, entry: int, score: float) -> np.ndarray:
        best = [LOST] * max(len(text) + 1, size + self.longest)
        best[entry] = score
        self.forward(text, best, size)
        return np.array(best[size : size + self.longest])

    def backtrace(self, text: str, size: int, scores: np.ndarray) -> tuple[list[int], list[tuple[int, int, list[int]]]]:
        """Given the scores of the states at its start: ids that all exits share, and (exit, entry, further ids) of each possible exit."""
        n, (first, last) = self.longest, self._split(text, size)
        if first < 0:
            best = [*scores, *[LOST] * max(0, max(len(text) + 1, size + n) - n)]
            back = self.forward(text, best, size)
            ends = [(j, *self.emit(text, back, size + j)) for j in range(n) if size + j < len(best) and best[size + j] > LOST]
            return [], ends
        best = ([*scores] + [LOST] * (first + 1))[: first + 1]
        entry, trunk = self.emit(text, self.forward(text[:first], best, first), first)
        for w in self.words(text[first:last]):
            trunk.extend(self.word(w)[0])
        rest, size = text[last:], size - last
        best = [0.0] + [LOST] * max(len(rest), size + n - 1)
        back = self.forward(rest, best, size)
        return trunk, [(j, entry, self.emit(rest, back, size + j)[1]) for j in range(n) if best[size + j] > LOST]


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product: associative, for vectors and matrices."""
    return (a[..., :, None] + b).max(-2)


def normalise(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


@lru_cache(maxsize=2)
def load_vocabulary(path: str) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    probe = "A  bé ﬁ\tc"
    if sp.decode(sp.encode(probe)) != probe:
        raise ValueError("the model normalises its text")
    n = sp.get_piece_size()
    pieces = {sp.id_to_piece(i): (i, sp.get_score(i)) for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))}
    return Vocabulary(pieces, [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])


# --- tables


def encode_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, ids) for every row of ``docs``.

    The segmentation of the best total score; ties go to the longer last piece. Where a model declares merges of
    byte pairs, its pieces and scores are read as a unigram model's, and these are not the ids of merging. Null and
    empty texts have no ids; texts of any length are whole, long ones in chunks; null ids stay null; repeated rows
    are encoded each; other columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession, 256)
    path = model or default_model()
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    long = F.length("text") > 2 * chunk

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_vocabulary(path).encode_all
        for batch in batches:
            ids, ends = encode(batch.column("text").to_pylist())
            flat = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), flat], names=["doc_id", "ids"])

    encoded = rows.where(~long).mapInArrow(short, "doc_id long, ids array<int>")
    giants = rows.where(long)
    done = _encode_giants(giants.select("text").distinct(), path, chunk)
    return encoded.unionByName(giants.withColumn("key", F.sha2("text", 256)).select("doc_id", "key").join(done, "key").select("doc_id", "ids"))


def _rows(frames: Iterator[pd.DataFrame], *columns: str) -> Iterator[list[tuple]]:
    for pdf in frames:
        yield list(zip(*(pdf[c] for c in columns), strict=True))


def combine_blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The matrix of each block: the product of its chunks' (key, b, c, m), which come in order."""
    last, whole = None, None
    for rows in _rows(frames, "key", "b", "m"):
        out = []
        for key, b, m in rows:
            matrix = np.frombuffer(m).reshape(-1, int((len(m) // 8) ** 0.5))
            if (key, b) == last:
                whole = combine(whole, matrix)
                continue
            if last:
                out.append((*last, whole.tobytes()))
            last, whole = (key, b), matrix
        yield pd.DataFrame(out, columns=["key", "b", "m"])
    if last:
        yield pd.DataFrame([(*last, whole.tobytes())], columns=["key", "b", "m"])


def scan_blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The scores of all states at the start of each block (key, b, m) of a text; blocks come in order."""
    last, state = None, None
    for rows in _rows(frames, "key", "b", "m"):
        out = []
        for key, b, m in rows:
            matrix = np.frombuffer(m).reshape(-1, int((len(m) // 8) ** 0.5))
            if key != last:
                last, state = key, np.where(np.arange(len(matrix)) == 0, 0.0, LOST)
            out.append((key, b, state.tobytes()))
            state = combine(state, matrix)
        yield pd.DataFrame(out, columns=["key", "b", "scores"])


def expand_blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The scores at the start of each chunk (key, b, c, m), given those of its block; chunks come in order."""
    last, state = None, None
    for rows in _rows(frames, "key", "b", "c", "m", "scores"):
        out = []
        for key, b, c, m, scores in rows:
            if (key, b) != last:
                last, state = (key, b), np.frombuffer(scores)
            out.append((key, c, state.tobytes()))
            state = combine(state, np.frombuffer(m).reshape(len(state), -1))
        yield pd.DataFrame(out, columns=["key", "c", "scores"])


def compose_blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The map of each block, from the state it is left in to the one it is entered in; chunks (key, b, back) come last first."""
    last, whole = None, None
    for rows in _rows(frames, "key", "b", "back"):
        out = []
        for key, b, back in rows:
            back = np.asarray(back, np.int64)
            if (key, b) == last:
                whole = np.where(whole < 0, -1, back[whole])
                continue
            if last:
                out.append((*last, whole.tolist()))
            last, whole = (key, b), back
        yield pd.DataFrame(out, columns=["key", "b", "back"])
    if last:
        yield pd.DataFrame([(*last, whole.tolist())], columns=["key", "b", "back"])


def leave_blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The state that each block (key, b, back) is left in; a text's blocks come last first, and it is left in state 0."""
    last, leave = None, 0
    for rows in _rows(frames, "key", "b", "back"):
        out = []
        for key, b, back in rows:
            leave = 0 if key != last else leave
            out.append((key, b, leave))
            last, leave = key, int(back[leave])
        yield pd.DataFrame(out, columns=["key", "b", "leave"])


def choose_ids(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The ids of each chunk (key, b, c, trunk, ends), given the state that its block is left in; chunks come last first."""
    last, state = None, 0
    for rows in _rows(frames, "key", "b", "c", "trunk", "ends", "leave"):
        out = []
        for key, b, c, trunk, ends, leave in rows:
            state = leave if (key, b) != last else state
            end = next(e for e in ends if e["j"] == state)
            out.append((key, c, np.concatenate([np.asarray(trunk, np.int32), np.asarray(end["ids"], np.int32)])))
            last, state = (key, b), end["entry"]
        yield pd.DataFrame(out, columns=["key", "c", "ids"])


def _encode_giants(texts: DataFrame, path: str, chunk: int) -> DataFrame:
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        more = load_vocabulary(path).longest - 1
        for pdf in batches:
            for key, text in zip(pdf["key"], pdf["text"], strict=True):
                plain = normalise(text)
                for c, lo in enumerate(range(0, len(plain), chunk)):
                    yield pd.DataFrame({"key": [key], "b": [c // BLOCK], "c": [c], "size": [min(chunk, len(plain) - lo)], "part": [plain[lo : lo + chunk + more]]})

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = load_vocabulary(path)
        for pdf in batches:
            yield pdf[["key", "b", "c"]].assign(m=[v.transfer(p, n).tobytes() for p, n in zip(pdf["part"], pdf["size"], strict=True)])

    def traces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = load_vocabulary(path)
        for pdf in batches:
            for at in range(0, len(pdf), 16):  # ids of few chunks at a time
                some = pdf.iloc[at : at + 16]
                got = [v.backtrace(p, n, np.frombuffer(s)) for p, n, s in zip(some["part"], some["size"], some["scores"], strict=True)]
                back = [[-1] * v.longest for _ in got]
                for row, (_, ends) in zip(back, got, strict=True):
                    for j, entry, _ in ends:
                        row[j] = entry
                ends = [[{"j": j, "entry": i, "ids": np.array(x, np.int32)} for j, i, x in e] for _, e in got]
                yield some[["key", "b", "c"]].assign(trunk=[np.array(t, np.int32) for t, _ in got], ends=ends, back=back)

    def blocks(df: DataFrame, *order) -> DataFrame:
        # By a hash of the two: a partitioning equal to that of a join before it would be taken for redundant and
        # left out, and when the join then becomes a broadcast, the rows of a block are in several tasks.
        return df.repartition(F.xxhash64("key", "b")).sortWithinPartitions("key", "b", *order)

    chunks = texts.withColumn("key", F.sha2("text", 256)).mapInPandas(cut, "key string, b int, c int, size int, part string")
    chunks = materialize(many_tasks(chunks, "key", "c"), "piece-chunks")
    m = materialize(chunks.mapInPandas(matrices, "key string, b int, c int, m binary"), "piece-matrices")
    whole = blocks(m, "c").mapInPandas(combine_blocks, "key string, b int, m binary")
    started = whole.repartition("key").sortWithinPartitions("key", "b").mapInPandas(scan_blocks, "key string, b int, scores binary")
    scores = blocks(m.join(started, ["key", "b"]), "c").mapInPandas(expand_blocks, "key string, c int, scores binary")
    traced = chunks.join(scores, ["key", "c"]).mapInPandas(traces, "key string, b int, c int, trunk array<int>, ends array<struct<j:int,entry:int,ids:array<int>>>, back array<int>")
    traced = materialize(traced, "piece-traces")
    maps = blocks(traced.select("key", "b", "c", "back"), F.desc("c")).mapInPandas(compose_blocks, "key string, b int, back array<int>")
    left = maps.repartition("key").sortWithinPartitions("key", F.desc("b")).mapInPandas(leave_blocks, "key string, b int, leave int")
    chosen = blocks(traced.drop("back").join(left, ["key", "b"]), F.desc("c")).mapInPandas(choose_ids, "key string, c int, ids array<int>")
    return chosen.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("c", "ids"))).alias("x")).select("key", F.flatten(F.col("x.ids")).alias("ids"))


def decode_pieces(rows: DataFrame, ids: str = "ids", text: str = "text", model: str | None = None) -> DataFrame:
    """``rows`` with the text of ``ids`` in ``text`` in their place, and n_ids and ids_crc32 (of the ids as
    little-endian unsigned 32-bit numbers); columns of these names are replaced, others kept.

    Null ids give a null text and 0s, empty ones the empty text, ids that name no piece nothing; rows may
    repeat and have any length; an empty table gives no rows.
    """
    small_batches(rows.sparkSession, 256)
    path, keep = model or default_model(), [c for c in rows.columns if c not in (ids, text, "n_ids", "ids_crc32")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = load_vocabulary(path).decode_all
        for batch in batches:
            lists = batch.column(ids)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(size)])
            out = pc.if_else(lists.is_valid(), decode(flat, ends), None)
            narrow = flat.astype("<u4")
            crc = [zlib.crc32(narrow[a:b].tobytes()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), out, pa.array(size.astype(np.int64)), pa.array(crc, pa.int64())], names=[*keep, text, "n_ids", "ids_crc32"])

    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep), f"`{text}` string, n_ids long, ids_crc32 long"])
    return rows.select(*keep, ids).mapInArrow(run, schema)
