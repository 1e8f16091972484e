import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonde.llm import language_id as li
from sonde.llm import toxicity as tox
from sonde.llm.features import doc_grams, padded
from sonde.llm.queries import fold


def prose(r, n, letters):
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(n))


def test_toxic_words_are_learnt_and_clean_text_left_alone(spark):
    r, rows = random.Random(1), []
    for i in range(400):
        w, bad = prose(r, r.choice([5, 40, 200]), "aeiostnrl").split(), i % 4 == 0
        for _ in range(3 if bad else 0):
            w.insert(r.randrange(len(w)), r.choice(["zorgle", "Wumpus,", "fizzbad."]))
        rows.append((i, " ".join(w), int(bad)))
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(x[0], x[2]) for x in rows if x[0] % 3], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in tox.score_toxicity(docs, tox.train_toxicity(docs, labels)).collect()}
    held = [(got[i] >= 0.7) == bool(y) for i, _, y in rows if i % 3 == 0]
    assert np.mean(held) > 0.97


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (None, "bad", "s"), (1, None, "s")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = tox.score_toxicity(docs, tox.train_toxicity(docs, none)).collect()
    assert len(rows) == 4 and all(0 <= r["score"] < 0.01 for r in rows)
    only = spark.createDataFrame([(1, 1), (1, None), (None, 1)], "doc_id long, toxic int")
    assert all(r["score"] > 0.99 for r in tox.score_toxicity(docs, tox.train_toxicity(docs, only)).collect())
    assert tox.score_toxicity(docs.limit(0), tox.train_toxicity(docs, only)).collect() == []


def test_held_out_language_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = li.identify_languages(docs, li.train_languages(docs.where(fold(4) != 2)))
    test = got.join(docs, "doc_id").where(fold(4) == 2)
    assert test.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.95


def test_und_and_edges(spark):
    train = spark.createDataFrame([(i, "the house of " * 3, "en") for i in range(20)] + [(50 + i, "das Haus der ßä " * 3, "de") for i in range(20)] + [(99, None, "en"), (98, "x", None)], "doc_id long, text string, lang string")
    model = li.train_languages(train)
    asked = spark.createDataFrame([(1, None), (2, "123 !!"), (3, ""), (4, "das Haus"), (None, "the house"), (4, "das Haus")], "doc_id long, text string")
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in li.identify_languages(asked, model).collect()]
    assert [g[1] for g in got] == ["und", "und", "und", "de", "en", "de"] and got[0][2] == 0 and 0.5 < got[3][2] <= 1
    nothing = li.train_languages(train.limit(0))
    assert {r["lang_pred"] for r in li.identify_languages(asked, nothing).collect()} == {"und"}
    one = li.train_languages(train.where("lang = 'en'"))
    assert [r["lang_pred"] for r in li.identify_languages(asked, one).collect()][3:5] == ["en", "en"]


@pytest.mark.parametrize("n", [2, 3, 4, 7, 12, 40])
def test_codewords_are_far_apart_and_no_bit_is_constant(n):
    code = li.codewords(n)
    apart = (code.shape[1] - code @ code.T) / 2 + code.shape[1] * np.eye(n)
    assert apart.min() >= (code.shape[1] / 2 if n <= 7 else code.shape[1] / 5) and (np.abs(code.sum(0)) < n).all()


def test_grams_do_not_cross_texts_and_steps_lose_none():
    raw = np.frombuffer(b"abcdefgh", np.uint8)
    text, starts = padded(raw, np.array([0, 3, 8]))
    whole = [(n.tolist(), b.tolist()) for n, b in doc_grams(text, starts, (2, 3), 12)]
    both = sorted(x for r, b in whole for x in zip(r, b))
    parts = sorted(x for r, b in doc_grams(text, starts, (2, 3), 12, step=3) for x in zip(r.tolist(), b.tolist()))
    alone = []
    for k, t in enumerate((b"abc", b"defgh")):
        p, s = padded(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        alone += [(k, x) for r, b in doc_grams(p, s, (2, 3), 12) for x in b.tolist()]
    assert both == parts == sorted(alone)


def test_repeated_rows_do_not_widen_the_sample(spark, monkeypatch):
    seen, kind = [], type(spark.range(1))
    real = kind.toPandas
    monkeypatch.setattr(kind, "toPandas", lambda self: seen.append(real(self)) or seen[-1])
    monkeypatch.setattr(tox, "MAX_TRAIN", 50)
    monkeypatch.setattr(li, "MAX_TRAIN", 200)
    r = random.Random(1)
    texts = [(i, prose(r, 20, "aeiostnrl") + (" zorgle" * 3 if i % 2 else "")) for i in range(300)]
    one = spark.createDataFrame(texts, "doc_id long, text string")
    many = one.unionByName(spark.range(20_000).selectExpr("1 AS doc_id", f"'{texts[1][1]}' AS text")).unionByName(spark.range(5_000).selectExpr("2 AS doc_id", "concat('other text ', id) AS text"))
    labels = spark.createDataFrame([(i, i % 2) for i, _ in texts], "doc_id long, toxic int")
    model = tox.train_toxicity(many, labels)
    assert len(seen[-1]) == 50 and len(model.buckets)
    named = many.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de"))
    noisy = named.unionByName(spark.range(150).selectExpr("id AS doc_id", "concat('x', id) AS text", "concat('l', id) AS lang"))
    model = li.train_languages(noisy)
    assert len(model.languages) == li.MAX_LANGUAGES and {"en", "de"} <= set(model.languages) and len(seen[-1]) <= 200


def test_columns_named_like_results(spark):
    docs = spark.createDataFrame([(1, "a b", "x", "y")], "doc_id long, text string, scored_text string, asked_text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    kept = ("doc_id", "scored_text", "asked_text")
    assert tox.score_toxicity(docs, tox.train_toxicity(docs, none), kept).first()["scored_text"] == "x"
    model = li.train_languages(docs.withColumn("lang", F.lit(None).cast("string")))
    assert li.identify_languages(docs, model, kept).first()["asked_text"] == "y"
    with pytest.raises(ValueError):
        tox.score_toxicity(docs.withColumn("Score", F.lit(1)), tox.train_toxicity(docs, none), ("Score",))
    with pytest.raises(ValueError):
        li.identify_languages(docs.withColumn("lang_pred", F.lit(1)), model, ("lang_pred",))


def test_toxicity_features_by_hand(spark):
    """Scores of a fitted model are those of counts taken one by one."""
    from sonde.llm.kernels import gram_buckets

    r = random.Random(3)
    texts = [(i, prose(r, 12, "aeiostnrl") + (" zorgle zorgle" if i % 2 else "")) for i in range(80)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    model = tox.train_toxicity(docs, spark.createDataFrame([(i, i % 2) for i, _ in texts], "doc_id long, toxic int"))
    got = {x["doc_id"]: x["score"] for x in tox.score_toxicity(docs, model).collect()}
    for i, t in texts:
        plain = " " + "".join(c.lower() if c.isascii() and c.isalpha() else " " for c in t) + " "
        counts = {}
        for n in tox.SIZES:
            for k in range(len(plain) - n + 1):
                own = np.frombuffer(plain[k : k + n].encode(), np.uint8)
                b = int(dict(gram_buckets(own, (n,), tox.BITS))[n][0])
                counts[b] = counts.get(b, 0) + 1
        total = model.bias + sum(w * min(tox.CAP, counts.get(int(b), 0)) for b, w in zip(model.buckets, model.weights))
        assert abs(got[i] - 1 / (1 + np.exp(-total))) < 1e-9


def test_language_decoding_by_hand(spark):
    """Predictions of a fitted model are those of losses summed one by one."""
    from sonde.llm.kernels import gram_buckets

    r = random.Random(4)
    letters = {"aa": "abcde", "bb": "efghi", "cc": "ijklm"}
    rows = [(i, prose(r, 15, letters[k]), k) for i, k in enumerate(["aa", "bb", "cc"] * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.train_languages(docs)
    asked = [(i, prose(r, 8, "abcdefghijklm")) for i in range(30)]
    got = {x["doc_id"]: x for x in li.identify_languages(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    for i, t in asked:
        plain, counts = np.frombuffer(f" {t} ".encode(), np.uint8), np.zeros(1 << li.BITS)
        for n, b in gram_buckets(plain, li.SIZES, li.BITS):
            np.add.at(counts, b[:-1] if n == 1 else b, 1)  # the space after a text is no gram of its own
        margins = np.sqrt(counts / counts.sum()) @ model.weights[:-1] + model.weights[-1]
        loss = {k: sum(np.log1p(np.exp(-m * c)) for m, c in zip(margins, word)) for k, word in zip(model.languages, model.code)}
        best = min(loss, key=loss.get)
        assert got[i]["lang_pred"] == best and abs(got[i]["score"] - 1 / sum(np.exp(loss[best] - x) for x in loss.values())) < 1e-3
