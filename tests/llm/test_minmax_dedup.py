import random

import pytest

from sonde.llm import minmax_dedup as mm
from sonde.llm.components import connected_components

from .test_kernels import shingles


def brute(rows, percent=85):
    ids = sorted(i for i, _ in rows if i is not None)
    sets, parent = {i: shingles(t) for i, t in rows if i is not None}, {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in ids:
        for j in ids:
            if j < i and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * len(sets[i] | sets[j]):
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(120)]
    texts = [" ".join(word() for _ in range(r.choice([1, 3, 8, 60]))) for _ in range(60)]
    for edits in [0, 1, 1, 2, 2, 3, 3, 4, 5, 8] * 6:  # a cloud of near copies, many not linked to each other
        w = list(base)
        for _ in range(edits):
            w[r.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += ["", "  \n", "One Two", "one  two", "one two three"] + texts[:10]
    return list(enumerate(texts))


def result(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {(r["doc_id"]): (r["n_shingles"], r["component_id"]) for r in mm.near_duplicates(df, **more).collect()}


@pytest.mark.parametrize("block", [256, 7])
def test_components_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(mm, "BLOCK_ROWS", block)  # small blocks take the second pass
    rows = corpus()
    assert result(spark, rows) == brute(rows)


def test_shuffled_texts_and_shingle_blocks(spark, monkeypatch):
    monkeypatch.setattr(mm, "PICK_ROWS", 0)
    monkeypatch.setattr(mm, "BLOCK_SHINGLES", 500)
    rows = corpus(2)
    assert result(spark, rows) == brute(rows)


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (None, "a b c d e f"), (3, "A B c d e f"), (None, None)]
    df = spark.createDataFrame([(*r, 0, "x", 1) for r in rows], "doc_id long, text string, n int, rk string, p int")
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in mm.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True), (None, 2, None, True), (3, 2, 1, False), (None, 0, None, True)], key=str)


def test_empty_table(spark):
    assert mm.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 200), (None, 5), (129, 300)]
    got = {r["v"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 130)) and got[300] == 100 and 200 not in got
