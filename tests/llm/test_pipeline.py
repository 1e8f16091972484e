import random

import corpus_pipeline as cp


def test_stages_keep_clean_documents_and_run_end_to_end(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    toxic = {r[0] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").select("doc_id").collect()}
    before = {r[0] for r in docs.select("doc_id").collect()}
    assert [n for n, _ in cp.STAGES] == ["toxicity", "language_id", "line_dedup", "minhash_dedup", "packing"]
    kept = cp.toxicity(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    after = {r[0] for r in kept.select("doc_id").collect()}
    assert len(before - after - toxic) <= 0.03 * len(before) and len(toxic - after) >= 0.6 * len(toxic)
    named = cp.language_id(spark, docs, sf_dir)
    assert named.columns == docs.columns and named.count() >= 0.97 * docs.count()
    assert cp.line_dedup(spark, docs, sf_dir).count() == docs.count()
    packed = cp.run(spark, sf_dir).toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 1024 and len(packed) >= 100


def test_one_of_each_group_stays(spark, sf_dir):
    r = random.Random(1)
    words = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    base, rows = words(200), []
    for i in range(20):
        near = list(base)
        near[i] = "edit"
        rows.append((i, " ".join(near), "en", "s", 1))
    rows += [(i, " ".join(words(50)), "en", "s", 1) for i in range(20, 30)]
    rows += [(30, rows[25][1], None, "s", 1), (31, None, "en", "s", None), (31, None, "en", "s", None)]
    rows += [rows[0], rows[0], rows[22], (0, rows[3][1], "en", "s", 1)]  # repeated rows, and an id with two alike texts
    lone = " ".join(words(80))
    rows += [(None, rows[23][1], "en", "s", 1), (None, lone, "en", "s", 1), (None, lone, "en", "s", 1), (None, lone + " end", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = cp.minhash_dedup(spark, docs, sf_dir).collect()
    kept = {x["doc_id"] for x in out}
    assert kept == {0, *range(20, 30), 31, None}
    assert sorted(str(x["doc_id"]) for x in out) == sorted(map(str, [0, *range(20, 30), 31, 31, None]))
    cp.REJECTED_ROWS, old = -1, cp.REJECTED_ROWS
    try:
        assert {x["doc_id"] for x in cp.minhash_dedup(spark, docs, sf_dir).collect()} == kept
    finally:
        cp.REJECTED_ROWS = old


def test_a_pair_at_082_is_a_near_duplicate(spark, sf_dir):
    w = [f"w{i}" for i in range(104)]  # 100 shingles, 90 of them in both: 90 / 110
    near = [*w[:-10], *(f"x{i}" for i in range(10))]
    far = [*w[:-13], *(f"y{i}" for i in range(13))]  # 87 / 113
    docs = spark.createDataFrame([(i, " ".join(x), "en", "s", 1) for i, x in enumerate((w, near))] + [(5, " ".join(f"a{x}" for x in w), "en", "s", 1), (6, " ".join(f"a{x}" for x in far), "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {x["doc_id"] for x in cp.minhash_dedup(spark, docs, sf_dir).collect()} == {0, 5, 6}


def test_stages_on_empty_tables_and_clashing_columns(spark, tmp_path):
    from pyspark.sql import functions as F

    labels = spark.createDataFrame([(i, int(i % 2 == 0), int(i % 3 == 0)) for i in range(12)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(i, f"the words of document number {i}\nsecond line" if i != 4 else None, "en" if i % 4 else None, "s", 9, 0.5, "x", "y") for i in range(10)] + [(None, "the words of nobody", "de", "s", 1, 0.5, "x", "y"), (3, "", "en", "s", 0, 0.5, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, text_hash string")
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() <= docs.count()
        assert out.where("score <> 0.5 OR lang_pred <> 'x' OR text_hash <> 'y'").count() == 0
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
    assert cp.line_dedup(spark, docs, str(tmp_path)).where(F.col("text").isNull()).count() == 1
    assert cp.packing(spark, docs, str(tmp_path)).count() == len(rows)
