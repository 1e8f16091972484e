"""What queries send through shuffles and hold in memory must not grow faster than their input."""

import tracemalloc

import numpy as np
import pytest

from sonde import queries as engine
from sonde.operators import bm25, embed, knn


def shuffled_rows(spark, run):
    """Rows written to shuffles during a run, and what it returned."""
    context, bus = spark.sparkContext._jsc.sc(), spark.sparkContext._jsc.sc().listenerBus()

    def written():
        bus.waitUntilEmpty()
        stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before, out, after = written(), run(), written()
    return sum(n for stage, n in after.items() if stage not in before), out


SPARSE = ["sparse_search_topk", "sparse_search_tier", "hybrid_search", "rrf_fuse", "unique_paths", "sparse_truncate_then_cap", "sparse_search_porter", "sparse_phrase"]


@pytest.mark.parametrize("name", SPARSE)
def test_sparse_searches_send_no_row_for_each_query_and_document(spark, sf_dir, name):
    rows, _ = shuffled_rows(spark, lambda: engine.CATALOGUE[name][0](spark, sf_dir).collect())
    assert rows < 15_000  # 200 documents and 40 queries: some 2,500 counts of phrases, and limits times queries


def test_texts_and_postings_score_alike_in_any_blocks(spark, monkeypatch):
    texts = [(i, " ".join(("a-b", "ab", "b", "a b", "c", "ña")[(i * 7 + k * k) % 6] for k in range(i % 9))) for i in range(60)]
    chunks = spark.createDataFrame([*texts, (60, None)], "chunk_id long, content string").repartition(3)
    asked = spark.createDataFrame([(0, "a-b b"), (1, "a-b-a c c"), (2, "b-a b-a"), (3, "absent"), (5, ""), (9, "ña a")], "query_id long, query string")
    for analyzer in bm25.ANALYZERS:
        rows = lambda df: sorted(map(tuple, df.collect()))
        index = bm25.build_index(chunks, analyzer)
        want = rows(bm25.score_queries(index, asked))
        best = sorted((q, c, s) for q in {x[0] for x in want} for q, s, c in sorted((q2, s2, c2) for q2, c2, s2 in want if q2 == q)[:4])
        assert {q for q, _, _ in want} == {0, 1, 2, 9} and rows(bm25.score_texts(chunks, asked, analyzer)) == want
        assert [x[:3] for x in rows(bm25.search_texts(chunks, asked, 4, analyzer))] == best == [x[:3] for x in rows(bm25.search_index(index, asked, 4))]
        with monkeypatch.context() as m:
            for k, v in {"WORDS_HELD": 5, "CELLS_HELD": 3, "FOUND_HELD": 2, "BLOCK": 4}.items():
                m.setattr(bm25, k, v)
            assert rows(bm25.score_texts(chunks, asked, analyzer)) == want
            assert [x[:3] for x in rows(bm25.search_texts(chunks, asked, 4, analyzer))] == best


@pytest.mark.parametrize("name", ["script_chunks", "rust_chunks"])
def test_sources_made_of_a_small_file_are_parsed_by_all_cores(spark, sf_dir, name):
    df = engine.CATALOGUE[name][0](spark, sf_dir)
    assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().toString()
    rows, found = shuffled_rows(spark, df.collect)
    assert len(found) == 5 * rows  # only the parts travel, not their chunks


def test_nearest_rows_hold_no_matrix_of_all_queries_and_rows():
    rng = np.random.default_rng(2)
    x, q = rng.integers(-3, 4, (20_000, 8)).astype(float), rng.integers(-3, 4, (600, 8)).astype(float)
    tracemalloc.start()
    who, ids, d = knn._nearest_rows(x, np.arange(20_000), q, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6  # the matrix has 96 MB
    for k in range(0, 600, 97):
        away = np.round(np.sqrt(((x - q[k]) ** 2).sum(1)), 9)
        assert ids[who == k].tolist() == np.lexsort((np.arange(20_000), away))[:5].tolist()


def test_embedders_get_a_few_texts_at_once(spark):
    def encode(texts):
        assert len(texts) <= 512
        return np.array([[len(t), 1] for t in texts])

    rows = spark.range(1500).selectExpr("id", "repeat('x', cast(id % 7 AS int)) AS content").coalesce(1)
    got = embed._map(rows, "content", "> ", "vector", encode).collect()
    assert sorted((r["id"], r["vector"]) for r in got) == [(i, [2.0 + i % 7, 1.0]) for i in range(1500)]


def test_checks_are_worked_out_once_and_chunks_not_shuffled(spark, sf_dir):
    df = engine.CATALOGUE["scores_worst_first"][0](spark, sf_dir)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct") == 1 and "Join" not in plan
    rows, _ = shuffled_rows(spark, lambda: engine.CATALOGUE["scores_worst_first"][0](spark, sf_dir).collect())
    assert rows <= 50 * spark.sparkContext.defaultParallelism
