import random
import zlib
from collections import Counter

import numpy as np
import pytest

from sonde.llm import packing as p


def patterns(counts, capacity):
    fixed, left = p.reduce_instance(counts, capacity)
    return fixed + p.best_fit_decreasing(left, capacity)


@pytest.mark.parametrize("seed", range(60))
def test_all_items_are_placed_and_no_worse_than_best_fit(seed):
    r = random.Random(seed)
    capacity, counts = r.choice([10, 100, 1024]), Counter()
    for _ in range(r.randint(0, 150)):
        counts[r.randint(1 if seed % 2 else capacity // 4, capacity)] += r.choice([1, 1, 3, 50])
    counts.pop(0, None)
    found = patterns(dict(counts), capacity)
    assert Counter({k: sum(s.count(k) * m for s, m in found) for k in counts}) == counts
    assert all(sum(s) <= capacity for s, _ in found)
    assert sum(m for _, m in found) <= sum(m for _, m in p.best_fit_decreasing(dict(counts), capacity)) + 1


def test_reduction_is_optimal_on_small_instances():
    def best(items, capacity):
        bins = []

        def go(i, most):
            if i == len(items):
                return len(bins)
            found = most
            for k in range(len(bins)):
                if bins[k] + items[i] <= capacity and bins[k] not in bins[:k]:
                    bins[k] += items[i]
                    found = min(found, go(i + 1, found))
                    bins[k] -= items[i]
            if len(bins) + 1 < found:
                bins.append(items[i])
                found = min(found, go(i + 1, found))
                bins.pop()
            return found

        return go(0, len(items) + 1)

    for seed in range(40):
        r = random.Random(seed)
        items = sorted((r.randint(20, 100) for _ in range(9)), reverse=True)
        fixed, left = p.reduce_instance(Counter(items), 100)
        rest = [k for k, n in left.items() for _ in range(n)]
        # What is fixed belongs to some best packing.
        assert sum(m for _, m in fixed) + (best(sorted(rest, reverse=True), 100) if rest else 0) == best(items, 100)


def test_pieces_are_gapless_and_exact(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(p.default_tokenizer())
    r = random.Random(3)
    texts = [" ".join(r.choice(["the", "Ünder", "x<|endoftext|>y", "日本", "a\n\nb", "word's", "  "]) for _ in range(r.choice([0, 1, 5, 300, 1500]))) for _ in range(60)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, None, "x"), (5, texts[5], "x")]
    got = p.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, length string")).toPandas()
    for i, t in enumerate(texts):
        ids = np.array([*own.encode(t, add_special_tokens=False).ids, 2], "<u4")
        mine = got[got.doc_id == i].drop_duplicates("piece").sort_values("piece")
        assert mine.length.sum() == len(ids) and (mine.length[1:] == 1024).all() and mine.start.tolist() == [0, *mine.length.cumsum()[:-1]]
        assert mine.ids_crc32.tolist() == [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(mine.start, mine.length)]
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum()[:-1]] and s.length.sum() <= 1024
    assert len(got[got.doc_id.isna()]) == 1 and got[got.doc_id == 5].piece.value_counts().eq(2).all()


def test_both_libraries_agree_on_all_characters_of_the_fast_path():
    from tokenizers import Tokenizer

    own, fast = Tokenizer.from_file(p.default_tokenizer()), p._encoder(p.default_tokenizer())
    for c in map(chr, range(0x250)):
        for text in (c, f"a{c}b", f" {c} ", f"{c}{c}\n{c}", f"1{c}'s", f"{c}  x", f"x {c}"):
            assert fast(text) == own.encode(text, add_special_tokens=False).ids, repr(text)


def test_runs_of_white_space_are_words_of_their_own(monkeypatch):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(p.default_tokenizer())
    monkeypatch.setattr(p, "BLANK_RUN", 3)
    p._encoder.cache_clear()
    encode, r = p._encoder(p.default_tokenizer()), random.Random(5)
    for _ in range(3000):
        text = "".join(r.choice(["a", "1", "!", " ", "  ", "\n", "\t", "\x85", "\xa0", "\x1c", "é", "'s", "    "]) for _ in range(r.randint(0, 12)))
        assert encode(text) == own.encode(text, add_special_tokens=False).ids, repr(text)
    p._encoder.cache_clear()


def test_texts_of_ten_million_characters(spark):
    from tokenizers import Tokenizer

    own, n = Tokenizer.from_file(p.default_tokenizer()), 10_000_000
    units = ["\n \t", " ", "a", "!", "ab  \n"]
    texts = spark.range(len(units) + 1, numPartitions=len(units) + 1).selectExpr(
        "id AS doc_id", "CASE id " + " ".join(f"WHEN {i} THEN repeat('{u}', {n // len(u)})".replace("\n", "\\n").replace("\t", "\\t") for i, u in enumerate(units)) + f" ELSE repeat('\U0001f600', {n // 20}) END AS text"
    )
    got = p.pack_documents(texts).orderBy("doc_id", "piece").toPandas()
    for i, u in enumerate([*units, "\U0001f600"]):
        mine, text = got[got.doc_id == i], u * (n // len(u) if i < len(units) else n // 20)
        assert mine.length.sum() == mine.start.iloc[-1] + mine.length.iloc[-1]
        if i in (0, 2, 5):
            ids = np.array([*own.encode(text, add_special_tokens=False).ids, 2], "<u4")
            assert mine.length.sum() == len(ids)
            assert mine.ids_crc32.tolist() == [zlib.crc32(ids[a : a + k].tobytes()) for a, k in zip(mine.start, mine.length)]


def test_empty_table(spark):
    assert p.pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
