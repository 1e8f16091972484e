import random
import struct

import numpy as np
import pytest

from sonde.llm import piece_codec as pc
from sonde.llm import rp_forest as rf


def exact(vectors, every, k):
    out = {}
    for i, q in vectors:
        if i % every == 0:
            near = sorted((-float(np.dot(q, v)), j) for j, v in vectors if j != i)
            out[i] = [(j, -s) for s, j in near[:k]]
    return out


def test_small_tables_ties_and_copies_are_exact(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(-3, 4, (30, 8)).astype(float)
    base[(base == 0).all(1)] = 1
    vectors = [(i, base[i % 30] if i % 3 else base[0]) for i in range(200)]
    odd = [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] * 8), (1060, [1.0, None] + [0.0] * 6), (1080, [1.0]), (None, [1.0] * 8), (20, list(map(float, vectors[20][1])))]
    rows = [(i, list(map(float, v)), 7) for i, v in vectors] + [(*o, 7) for o in odd]
    got = {}
    for r in rf.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == exact(vectors, 20, 20)


def test_few_candidates_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rf.nearest_neighbours(df).collect())
    assert got == [(0, 1, 1, 0.5), (0, 2, 20, 0.0), (20, 1, 1, 0.5), (20, 2, 0, 0.0)]
    assert rf.nearest_neighbours(df.limit(0)).collect() == []
    assert rf.nearest_neighbours(df.where("vec_id = 0")).collect() == []


def found_by(spark, x, every, **more):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in rf.nearest_neighbours(df, every=every, **more).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = exact(list(enumerate(x)), every, 20)
    assert all(len(v) == 20 for v in got.values()) and set(got) == set(want)
    return sum(len(got[q] & {j for j, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


def share_of(x, every):
    """The share of rows in the leaves of a query, under the default settings."""
    x = x.astype(np.float32)
    forest = rf.Forest(x)
    place = forest.place(x)
    return np.mean([np.isin(place, leaves).any(1).mean() for leaves, _, _ in forest.search(x[::every], *rf.tune(forest, x, len(x), 20))])


def test_default_recall_and_a_falling_share(spark):
    rng, shares = np.random.default_rng(1), []
    for n, every in ((1500, 20), (12_000, 200)):  # no clusters at all: the hardest case
        x = rng.normal(size=(n, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        assert found_by(spark, x, every) >= 0.9
        shares.append(share_of(x, every))
    assert shares[1] < 0.85 * shares[0] and shares[1] < 0.7
    centres = rng.normal(size=(40, 64))
    x = centres[rng.integers(0, 40, 6000)] + 0.3 * rng.normal(size=(6000, 64))
    assert found_by(spark, x, 100) >= 0.9 and share_of(x, 100) < 0.2


def test_small_samples_crowded_leaves_and_busy_buckets(spark, monkeypatch):
    for name, value in (("BUCKET", 150), ("ASKING", 7)):
        monkeypatch.setattr(rf, name, value)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 24))
    x[1000:2000] = x[0] + 0.05 * rng.normal(size=(1000, 24))
    assert found_by(spark, x, 50, sample=300, leaf=20) >= 0.9


def rows_made(spark, operator, run):
    """How many rows the plan nodes of a name made during a run, and what it returned."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    before, out, made = store.executionsCount(), run(), 0
    bus.waitUntilEmpty()
    executions = store.executionsList(before, 1000)
    for i in range(executions.size()):
        e = executions.apply(i)
        values, nodes = store.executionMetrics(e.executionId()), store.planGraph(e.executionId()).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            metrics = node.metrics()
            for metric in (metrics.apply(j) for j in range(metrics.size())):
                if node.name().strip() == operator and metric.name() == "number of output rows":
                    value = values.get(metric.accumulatorId())
                    made += int(value.get().replace(",", "")) if value.isDefined() else 0
    return made, out


def test_rows_from_the_buckets_do_not_grow_with_queries_times_buckets(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    made, answers = [], []
    for n, bucket in ((1200, 1 << 20), (1200, 500), (6000, 500)):  # 1, 20 and 103 buckets; without clusters most are visited
        monkeypatch.setattr(rf, "BUCKET", bucket)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:n])], "vec_id long, embedding array<double>")
        rows, found = rows_made(spark, "FlatMapCoGroupsInPandas", lambda: sorted(map(tuple, rf.nearest_neighbours(df, every=60).collect())))  # noqa: B023
        made.append(rows), answers.append(found)
    assert answers[0] == answers[1]  # rounds lose nothing that one bucket with all leaves has
    assert made[0] == 42 * 20
    assert 5 * made[1] <= made[2] < 9 * made[1], made  # five times the queries, which each visit five times the buckets


def test_an_id_with_two_vectors_is_found_by_its_best(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [3.0, 0.0]), (2, [0.0, 2.0]), (2, [0.5, 0.0]), (3, None)], "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rf.nearest_neighbours(df).collect()]
    assert sorted(got) == [(0, 1, 1, 3.0), (0, 2, 2, 2.0)]


@pytest.fixture(scope="module")
def vocabulary():
    return pc.load_vocabulary(pc.default_model())


@pytest.fixture(scope="module")
def library():
    """The model's own pieces and scores, read by the library as a unigram model; scores that mean never are set as this module reads them."""
    import sentencepiece as spm

    path = pc.default_model()
    own, raw = spm.SentencePieceProcessor(model_file=path), open(path, "rb").read()
    name = b"\x12\x06tok_v0\x18"
    at = raw.rfind(name + b"\x02") + len(name)
    raw = raw[:at] + b"\x01" + raw[at + 1 :]
    least = min(s for s in map(own.get_score, range(own.get_piece_size())) if s > pc.NEVER)
    for i in range(own.get_piece_size()):
        if own.get_score(i) <= pc.NEVER:
            piece = own.id_to_piece(i).encode()
            field = b"\x0a" + bytes([len(piece)]) + piece + b"\x15"
            score = least - 1 if len(own.id_to_piece(i)) == 1 else (least - 1) * len(piece)
            raw = raw.replace(field + struct.pack("<f", own.get_score(i)), field + struct.pack("<f", score))
    return spm.SentencePieceProcessor(model_proto=raw)


def sample_texts(sf_dir):
    import pyarrow.parquet as pq

    return pq.read_table(f"{sf_dir}/documents.parquet")["text"].to_pylist()


def test_same_ids_as_the_library(vocabulary, library, sf_dir):
    texts = [t[:500] for t in sample_texts(sf_dir)] + ["", " ", "a  b   c", "\n\n x", "日本語😀 x", " lead", "▁x"]
    ids, ends = vocabulary.encode_all(texts)
    for k, t in enumerate(texts):
        want = library.encode(t)
        assert vocabulary.encode(t) == want == ids[ends[k] : ends[k + 1]].tolist(), t


def chunked(v, text, size):
    plain, state, steps = pc.normalise(text), np.where(np.arange(v.longest) == 0, 0.0, pc.LOST), []
    for lo in range(0, len(plain), size):
        part, n = plain[lo : lo + size + v.longest - 1], min(size, len(plain) - lo)
        steps.append((part, n, state))
        state = pc.combine(state, v.transfer(part, n))
    leave, out = 0, []
    for part, n, scores in reversed(steps):
        trunk, ends = v.backtrace(part, n, scores)
        end = next(e for e in ends if e[0] == leave)
        out, leave = [*trunk, *end[2], *out], end[1]
    return out


@pytest.mark.parametrize("size", [1, 3, 16, 50])
def test_scan_equals_the_sequential_search(vocabulary, sf_dir, size):
    r = random.Random(size)
    for t in r.sample(sample_texts(sf_dir), 30):
        for text in (t[:200], t[:120].replace(" ", "")):
            assert chunked(vocabulary, text, size) == vocabulary.encode(text)


def test_combine_is_associative(vocabulary):
    text = pc.normalise("the quick brown fox jumps over it")
    a, b, c = (vocabulary.transfer(text[i : i + 8 + vocabulary.longest - 1], 8) for i in (0, 8, 16))
    assert np.array_equal(pc.combine(pc.combine(a, b), c), pc.combine(a, pc.combine(b, c)))


def test_pieces_across_words_are_searched_whole():
    pieces = {p: (i, s) for i, (p, s) in enumerate([("▁a", -1.0), ("▁b", -1.0), ("▁a▁b", -1.5), ("▁", -3.0), ("a", -3.0), ("b", -3.0)])}
    v = pc.Vocabulary(pieces, list(range(100, 356)))
    assert not v.separable and v.encode("a b") == [2] and v.encode("a bb") == [2, 5] and v.encode("a a") == [0, 0]
    assert all(chunked(v, "a b a b bb a", n) == v.encode("a b a b bb a") for n in (1, 2, 3, 5))


def test_blocks_of_matrices_and_maps_give_the_same(vocabulary, sf_dir):
    import pandas as pd

    text, size = pc.normalise(" ".join(sample_texts(sf_dir)[:6])[:4000]), 100
    parts = [(c, text[lo : lo + size + vocabulary.longest - 1], min(size, len(text) - lo)) for c, lo in enumerate(range(0, len(text), size))]
    m = pd.DataFrame([("k", c // 7, c, vocabulary.transfer(p, n).tobytes()) for c, p, n in parts], columns=["key", "b", "c", "m"])
    whole = pd.concat(pc.combine_blocks(iter([m[:20], m[20:]])))
    started = pd.concat(pc.scan_blocks(iter([whole])))
    scores = pd.concat(pc.expand_blocks(iter([m.merge(started, on=["key", "b"])])))
    assert len(whole) == len(started) == -(-len(parts) // 7) and len(scores) == len(parts)
    state = np.where(np.arange(vocabulary.longest) == 0, 0.0, pc.LOST)
    for (_, p, n), mine in zip(parts, scores["scores"]):
        assert np.allclose(state, np.frombuffer(mine))
        state = pc.combine(state, vocabulary.transfer(p, n))


def test_giants_go_by_blocks(spark, vocabulary, sf_dir, monkeypatch):
    monkeypatch.setattr(pc, "BLOCK", 3)
    texts = sample_texts(sf_dir)
    rows = [(i, " ".join(texts[i : i + 9])[:9000]) for i in range(4)] + [(9, "x" * 5000), (10, " " * 3000)]
    got = {r["doc_id"]: r["ids"] for r in pc.encode_pieces(spark.createDataFrame(rows, "doc_id long, text string"), chunk=128).collect()}
    assert got == {i: vocabulary.encode(t) for i, t in rows}


def test_tables_round_trip(spark, vocabulary, sf_dir):
    long = " ".join(sample_texts(sf_dir)[:30])
    rows = [(1, long), (2, None), (3, ""), (4, "a\u0000b\nc é😀"), (None, "x y"), (1, long)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, ids int")
    coded = pc.encode_pieces(df, chunk=512)
    got = sorted(((r["doc_id"], r["text"], r["n_ids"]) for r in pc.decode_pieces(coded).collect()), key=str)
    assert got == sorted(((i, t or "", len(vocabulary.encode(t or ""))) for i, t in rows), key=str)
    assert [r["ids"] for r in coded.where("doc_id = 1").collect()] == [vocabulary.encode(long)] * 2
    assert pc.decode_pieces(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")).select("text", "n_ids").collect() == [(None, 0), ("", 0)]
    assert pc.encode_pieces(df.limit(0)).collect() == []
