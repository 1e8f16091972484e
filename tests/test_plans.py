import json
import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from sonde import cli
from sonde.errors import DimensionMismatch, FileTooLarge, NotFound
from sonde.functions import fixed
from sonde.operators import bm25, fusion, knn, maintenance, quality
from sonde.operators.embed import HashEmbedder
from sonde.operators.fusion import SearchOptions, Weights
from sonde.plans import reports
from sonde.plans.indexer import Indexer
from sonde.plans.methods import load_or_create
from sonde.plans.search import Searcher
from sonde.plans.store import Store
from sonde.sources import records, walk
from sonde.streaming.ingest import start_ingest


def index_of(spark, texts, analyzer="porter"):
    return bm25.build_index(spark.createDataFrame(list(enumerate(texts, 1)), "chunk_id long, content string"), analyzer)


def scores(spark, index, query):
    asked = spark.createDataFrame([(0, query)], "query_id long, query string")
    return {r["chunk_id"]: r["score"] for r in bm25.score_queries(index, asked).collect()}


TEXTS = [
    "quarterly revenue report shows growth", "unrelated document about weather", "quarterly earnings and revenue summary", "The tree-sitter parses; a sitter in a tree runs", "Running naïve runners run",
    "c++ and snake_case identifiers", "weather weather weather", "nothing here", "more filler words", "even more filler",
]


@pytest.mark.parametrize("query", ["quarterly revenue", "tree-sitter", "run", "+ weather", "weather weather", "naive", "snake case", "C++", "the of", "absent"])
def test_bm25_equals_sqlite(spark, query):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61')")
    con.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", list(enumerate(TEXTS, 1)))
    from sonde.functions.text import match_expression

    expression = spark.range(1).select(match_expression(F.lit(query)).alias("m")).first()["m"]
    want = dict(con.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (expression,)).fetchall())
    got = scores(spark, index_of(spark, TEXTS), query)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-9 for k in want)


def test_index_maintenance_equals_a_new_index(spark):
    index = index_of(spark, TEXTS, "plain")
    changed = spark.createDataFrame([(2, "now about revenue"), (11, "a new one")], "chunk_id long, content string")
    gone = spark.createDataFrame([(1,)], "chunk_id long")
    after = bm25.update_index(index, changed, gone)
    fresh = {i: t for i, t in enumerate(TEXTS, 1) if i not in (1, 2)} | {2: "now about revenue", 11: "a new one"}
    want = bm25.build_index(spark.createDataFrame(list(fresh.items()), "chunk_id long, content string"), "plain")
    assert sorted(map(str, after.postings.collect())) == sorted(map(str, want.postings.collect()))


def hits(spark, rows, rank):
    return spark.createDataFrame(rows, f"query_id long, chunk_id long, file_uri string, tier int, content string, {rank}_score double, {rank}_rank int")


def test_rrf_and_path_boost(spark):
    none = hits(spark, [], "sparse")
    asked = spark.createDataFrame([(0, "tidal sounding of old harbour walls")], "query_id long, query string")
    dense = hits(spark, [(0, 1, "/d/notes.md", 1, "", 0.1, 1), (0, 2, "/d/tidal_sounder.py", 1, "", 0.2, 2)], "dense")
    got = fusion.rrf_fuse(dense, none, asked).orderBy("fused_rank").collect()
    assert [r["chunk_id"] for r in got] == [2, 1]
    assert got[0]["rrf_score"] == pytest.approx(1 / 62 + 1.5 / 61) and got[1]["rrf_score"] == pytest.approx(1 / 61)
    plain = fusion.rrf_fuse(dense, hits(spark, [(0, 2, "x", 1, "", -1.0, 1), (0, 3, "z", 1, "", -0.5, 2)], "sparse"), asked, Weights(1, 1, 0)).collect()
    assert {r["chunk_id"]: round(r["rrf_score"], 9) for r in plain} == {1: round(1 / 61, 9), 2: round(1 / 62 + 1 / 61, 9), 3: round(1 / 62, 9)}
    assert all(r["file_uri"] != "x" for r in plain) and Weights.resolve({"SONDE_W_PATH": "2", "SONDE_W_DENSE": "no"}) == Weights(1.0, 0.4, 2.0)
    best = fusion.rrf_fuse(hits(spark, [(0, 1, "/tidal.py", 1, "", 0.0, 1)], "dense"), hits(spark, [(0, 1, "/tidal.py", 1, "", -1.0, 1)], "sparse"), asked).first()
    assert best["normalized_score"] == pytest.approx(1.0)


def test_tier_and_file_rules(spark):
    rows = [(0, i, uri, tier, "", 0.1, i) for i, (uri, tier) in enumerate([("a", 3), ("a", 1), ("a", 1), ("a", 2), ("a", 1), ("b", 3)], 1)]
    kept = fusion.post_process(hits(spark, rows, "dense"), "dense_rank", 3).collect()
    assert sorted(r["chunk_id"] for r in kept) == [2, 3, 4, 6]
    with pytest.raises(ValueError):
        SearchOptions(tier=4)


def test_filters_come_after_the_cut(spark):
    chunks = spark.createDataFrame([(i, i, f"f{i}.{'rs' if i > 4 else 'md'}", 1, "") for i in range(1, 9)], "chunk_id long, lance_id long, file_uri string, tier int, content string")
    near = spark.createDataFrame([(0, i, i / 10) for i in range(1, 5)], "query_id long, id long, distance double")
    assert fusion.dense_channel(near, chunks, 2, ext="rs").count() == 0 and fusion.dense_channel(near, chunks, 2, ext=".MD").count() == 2


def test_nearest_and_cells(spark):
    one_hot = [(i + 1, [1.0 if k == i else 0.0 for k in range(10)]) for i in range(10)]
    vectors = spark.createDataFrame(one_hot, "id long, vector array<double>")
    asked = spark.createDataFrame([(0, one_hot[0][1]), (1, one_hot[4][1])], "query_id long, vector array<double>")
    got = {r["query_id"]: r["id"] for r in knn.nearest(vectors, asked, 1).collect()}
    assert got == {0: 1, 1: 5}
    assert [r["id"] for r in knn.nearest(vectors, asked.where("query_id = 0"), 3).orderBy("place").collect()] == [1, 2, 3]
    cells, centres = knn.build_cells(vectors, cells=3)
    assert {r["query_id"]: r["id"] for r in knn.nearest_in_cells(cells, centres, asked, 1, probes=3).collect()} == {0: 1, 1: 5}
    left = maintenance.without(vectors, spark.createDataFrame([(2,)], "id long"), "id")
    assert left.count() == 9 and 2 not in {r["id"] for r in knn.nearest(left, asked, 9).collect()}


def test_nearest_over_many_batches_and_ties(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.integers(-2, 3, (700, 6)).astype(float)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").repartition(3)
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 700, 50)], "query_id long, vector array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    got = {}
    for r in knn.nearest(vectors, asked, 7).orderBy("query_id", "place").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    for q in range(0, 700, 50):
        d = np.round(np.sqrt(((x - x[q]) ** 2).sum(1)), 9)
        assert got[q] == np.lexsort((np.arange(700), d))[:7].tolist()


def test_means_of_more_groups_than_a_task_holds(spark, monkeypatch):
    monkeypatch.setattr(quality, "GROUPS_HELD", 3)
    rows = [(i % 11, i % 3 + 1, [float(i), 1.0]) for i in range(300)] + [(0, 1, None)]
    df = spark.createDataFrame(rows, "file_id long, tier int, vector array<double>").repartition(4)
    got = {(r["file_id"], r["tier"]): r["mean"] for r in quality.parent_means(df).collect()}
    for key in {r[:2] for r in rows}:
        own = [v for f, t, v in rows if (f, t) == key and v]
        assert got[key] == pytest.approx([sum(v[0] for v in own) / len(own), 1.0])


def test_recall_of_search_in_cells(spark):
    from sonde import queries

    sf = "/root/testdata/sf0.01"
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    true = {(r["query_id"], r["id"]) for r in knn.nearest(v, queries._vector_queries(spark, sf), 10).collect()}
    found = {(r["query_id"], r["id"]) for r in queries.ivf_search(spark, sf).collect()}
    print("recall", len(true & found) / len(true))
    assert len(true & found) >= 0.9 * len(true)


def test_quality_runs(spark):
    chunks = spark.createDataFrame([(1, 1, 1, "Fine words that end well.", 40), (2, 1, 1, "bad (", 2)], "chunk_id long, file_id long, tier int, content string, token_count long")
    chunks = chunks.withColumns({"structural_score": F.lit(None).cast("double"), "coherence_score": F.lit(None).cast("double"), "is_flagged": F.lit(False)})
    embedded = spark.createDataFrame([(1, 1, 1, [1.0, 0.0]), (2, 1, 1, [0.0, 1.0]), (9, 1, 2, [1.0, 0.1])], "chunk_id long, file_id long, tier int, vector array<double>")
    got = {r["chunk_id"]: r for r in quality.score_all(chunks, embedded).collect()}
    assert got[1]["structural_score"] == 1.0 and not got[1]["is_flagged"] and got[1]["coherence_score"] > 0.9
    assert got[2]["structural_score"] == 0.3 and got[2]["is_flagged"] and got[2]["coherence_score"] < 0.6
    again = quality.score_all(spark.createDataFrame(list(got.values()), chunks.schema), None)
    assert {r["chunk_id"]: r["coherence_score"] for r in again.collect()}[1] > 0.9  # scored rows are left alone


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for name in ["README.md", "main.rs", "data.csv", "src/lib.rs", "binary.exe", "build.lock", ".env", "Cargo.lock", ".env.local", "node_modules/lib.js", ".hidden.txt", "functions/a.py", "firebase/functions/b.py"]:
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text({"README.md": "# Merkle\n\nThe drift of merkle trees is detected. See [lib](src/lib.rs).\n", "data.csv": "a,b\n1,2\n"}.get(name, f"fn {path.stem.strip('.')}() {{}}\n"))
    return root


def test_walk(tree):
    listed = {os.path.relpath(p, tree) for p in walk.walk(str(tree))}
    assert listed == {"README.md", "main.rs", "data.csv", "src/lib.rs", ".hidden.txt", "firebase/functions/b.py"}
    (tree / ".git").mkdir()
    (tree / ".gitignore").write_text("*.csv\n/src/\n!main.rs\n# x\n")
    listed = {os.path.relpath(p, tree) for p in walk.walk(str(tree), exclude=("firebase",))}
    assert listed == {"README.md", "main.rs", ".hidden.txt", ".gitignore"}
    (tree / ".git" / "info").mkdir()
    (tree / ".git" / "info" / "exclude").write_text("lib.rs\n")
    (tree / ".gitignore").write_text("*.csv\n")
    (tree / ".ignore").write_text("src/odd.txt\n")
    for name in ("odd.txt", "even.txt", "a.csv"):
        (tree / "src" / name).write_text("x")
    assert {os.path.relpath(p, tree) for p in walk.walk(str(tree / "src"))} == {"src/even.txt"}  # rules from above the root
    with pytest.raises(NotFound):
        list(walk.walk(str(tree / "none")))
    big = tree / "big.txt"
    with big.open("wb") as f:
        f.truncate(fixed.MAX_FILE_SIZE + 1)
    assert str(big) not in set(walk.walk(str(tree)))
    with pytest.raises(FileTooLarge):
        walk.read_bytes(str(big))


def ask(spark, text):
    return spark.createDataFrame([(0, text)], "query_id long, query string")


def test_index_search_and_update(spark, tree, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    indexer = Indexer(store, HashEmbedder(32))
    assert indexer.index_root(str(tree)).indexed == 6
    again = indexer.index_root(str(tree))
    assert (again.indexed, again.skipped, again.removed) == (0, 6, 0)
    searcher = Searcher(store, HashEmbedder(32))
    top = searcher.search(ask(spark, "merkle drift detection")).orderBy("final_rank").first()
    assert top["file_uri"].endswith("README.md") and 0 < top["normalized_score"] <= 1
    for mode in ("dense", "sparse"):
        assert searcher.search(ask(spark, "merkle"), SearchOptions(mode, 5, ext_filter="md")).count() >= 1
    pre = SearchOptions("sparse", 1, tier=2, filter_mode="pre")
    assert [r["tier"] for r in searcher.search(ask(spark, "merkle"), pre).collect()] == [2]
    readme = str(tree / "README.md")
    like = searcher.like((tree / "README.md").read_bytes(), readme)
    assert like.where(F.col("file_uri") == readme).count() == 0
    text = reports.explain_report(searcher.explain(readme))
    assert "LINKS_TO" in text and "README.md" in text
    stats = reports.stats_report(store.table("files"), store.table("chunks"), store.table("edges"))
    assert "files: 6" in stats and "coverage: 100 %" in stats
    with pytest.raises(NotFound):
        searcher.explain("nope")

    (tree / "main.rs").write_text("fn renamed_entry() {}\n")
    os.utime(tree / "main.rs", (1, 1))
    (tree / "data.csv").unlink()
    done = Indexer(store, HashEmbedder(32)).index_root(str(tree))
    assert (done.indexed, done.removed) == (1, 1)
    fresh = Searcher(store, HashEmbedder(32))
    assert fresh.search(ask(spark, "renamed entry"), SearchOptions("sparse")).first()["file_uri"].endswith("main.rs")
    assert store.table("chunks").where(F.col("file_uri").endswith("data.csv")).count() == 0
    assert store.table("chunks").where("lance_id IS NULL").count() == 0
    with pytest.raises(DimensionMismatch):
        Indexer(store, HashEmbedder(16)).index_uris([readme])
    assert Indexer(store, HashEmbedder(32)).index_uris([readme, "/no/such"]).errors == 1

    scored = Indexer(store, HashEmbedder(32)).score()
    assert scored.where("structural_score IS NULL").count() == 0
    store.commit({"chunks": scored.withColumn("is_flagged", F.lit(True))})
    tally, counts = Indexer(store, HashEmbedder(32), methods=fixed.METHODS | {"text/markdown": "markdown/v2"}).recheck()
    assert [(r["old"], r["new"], r["files"]) for r in tally.collect()] == [("markdown/v1", "markdown/v2", 1)] and counts.indexed == 1
    assert store.vacuum() > 0 and store.table("files").count() == 5


def test_sparse_only_without_embedder(spark, tree, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    Indexer(store).index_root(str(tree))
    assert Indexer(store).index_root(str(tree)).skipped == 6  # not embedded, and that is no reason to work again
    hits = Searcher(store).search(ask(spark, "merkle"))
    assert hits.count() >= 1 and "README.md" in reports.as_table(hits) and json.loads(reports.as_json(hits))[0]["rank"] == 1 and reports.as_markdown(hits).startswith("## 1. ")
    from sonde.errors import EmbedderMissing

    with pytest.raises(EmbedderMissing):
        Searcher(store).search(ask(spark, "merkle"), SearchOptions("dense"))


LINES = [
    '{"uri":"change://105/etc/nginx.conf@1","content":"upstream backend","mime_type":"text/plain","modified_at":1.5,"meta":{"tool":"write_file","vmid":105}}',
    '{"uri":"doc://1","content":"alpha token original","mime_type":"text/plain; charset=utf-8"}',
    '{"uri":"doc://2","mime_type":"text/plain"}',
    "not json at all",
    "   ",
]


def test_records(spark):
    good, bad = records.split_records(records.parse_lines(spark.createDataFrame([(x,) for x in LINES], "value string")))
    assert good.count() == 2 and bad.count() == 2
    docs = {r["file_uri"]: r for r in records.as_documents(good).collect()}
    assert docs["change://105/etc/nginx.conf@1"]["name"] == "nginx.conf@1" and docs["doc://1"]["mime_type"] == "text/plain"


def test_stream_and_overwrite(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.ndjson").write_text("\n".join(LINES))
    store = Store(spark, str(tmp_path / "store"))
    start_ingest(spark, str(inbox), Indexer(store), str(tmp_path / "check"), str(tmp_path / "bad")).awaitTermination()
    assert store.table("files").count() == 2 and spark.read.parquet(str(tmp_path / "bad")).count() == 2
    meta = store.table("chunks").where("file_uri LIKE 'change%' AND tier = 1").first()["meta"]
    assert json.loads(meta)["record"]["tool"] == "write_file"
    assert Searcher(store).search(ask(spark, "backend")).count() >= 1
    (inbox / "b.ndjson").write_text(LINES[1].replace("original", "older") + "\n" + LINES[1].replace("original", "replacement"))
    start_ingest(spark, str(inbox), Indexer(store), str(tmp_path / "check")).awaitTermination()
    found = Searcher(store)
    assert found.search(ask(spark, "replacement")).count() >= 1 and found.search(ask(spark, "original")).count() == 0 and found.search(ask(spark, "older")).count() == 0


def test_method_map(tmp_path):
    methods = load_or_create(str(tmp_path))
    assert methods["text/markdown"] == "markdown/v1" and methods == load_or_create(str(tmp_path))
    path = tmp_path / "chunker_map.toml"
    path.write_text(path.read_text().replace("xlsx/v1", "xlsx/v2"))
    assert "xlsx/v2" in load_or_create(str(tmp_path)).values()


def test_commands_parse():
    args = cli.parser().parse_args(["search", "x", "--mode", "sparse", "--tier", "2", "--output", "md"])
    assert (args.query, args.mode, args.tier, args.output) == ("x", "sparse", 2, "md")
    assert cli.parser().parse_args(["ingest", "in"]).batch == 128


def test_reservoir(spark):
    assert maintenance.reservoir(spark.range(100), 10).count() == 10 and maintenance.reservoir(spark.range(5), 10).count() == 5


def test_probed_search_over_stored_cells_and_progress(spark, tmp_path):
    from sonde.operators.embed import HashEmbedder
    from sonde.plans.progress import Progress

    told = []
    store = Store(spark, str(tmp_path / "store"))
    indexer = Indexer(store, HashEmbedder(16), analyzer="plain", progress=Progress(lambda step, n, _: told.append((step, n))))
    rows = [(f"doc://{i}", f"buoy number {i} of harbour {i % 7} is lit at {i * 3}", "text/plain", 0.0, None) for i in range(60)]
    records = spark.createDataFrame(rows, "uri string, content string, mime_type string, modified_at double, meta string")
    indexer.index_records(records)
    assert told == [("documents parsed", 60), ("snapshot written", 60)]
    searcher, asked = Searcher(store, HashEmbedder(16)), ask(spark, "buoy number 5 of harbour 5")
    options = SearchOptions("dense", top_k=5)
    exact = [(r["chunk_id"], r["final_rank"]) for r in searcher.search(asked, options).collect()]
    assert searcher._cells() is None
    probes = indexer.build_cells(4)
    assert 1 <= probes <= 4 and searcher._cells() is not None
    found = [(r["chunk_id"], r["final_rank"]) for r in searcher.search(asked, options).collect()]
    assert len(found) == len(exact) and len({c for c, _ in found} & {c for c, _ in exact}) >= 4
    indexer.index_records(records.limit(1).withColumn("uri", F.lit("doc://new")))
    assert searcher._cells() is None  # vectors changed: all are scanned


def test_a_cluster_must_name_a_shared_folder(spark):
    from types import SimpleNamespace

    from sonde.staging import staging_root

    def session(master, **conf):
        context = SimpleNamespace(getConf=lambda: SimpleNamespace(get=lambda k, d: conf.get(k.replace(".", "_"), d)), applicationId="app-1", master=master)
        return SimpleNamespace(sparkContext=context)

    assert staging_root(session("yarn", spark_checkpoint_dir="hdfs://x/y/")) == "hdfs://x/y/sonde-app-1"
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]", "k8s://h"):
        with pytest.raises(RuntimeError):
            staging_root(session(master))
    own = staging_root(session("local[4]"))
    assert own == staging_root(session("local[*]")) and own.endswith("/sonde-app-1")
