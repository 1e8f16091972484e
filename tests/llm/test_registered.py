"""Every registered query on a small fixture with nulls, repeated rows and long texts, against results worked out here."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonde.llm import packing, piece_codec, queries

from .test_kernels import LOWER, WORD
from .test_lines_urls import by_hand
from .test_minmax_dedup import brute


@pytest.fixture(scope="module")
def folder(spark, sf_dir, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    for table in ("documents", "labels", "conversations", "embeddings", "pages"):
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        if table == "documents":
            n = df.selectExpr("max(doc_id)").first()[0]
            long = " ".join(f"word{i % 977} of a long text" for i in range(12_000))
            more = [(n + 1, None), (n + 2, ""), (n + 3, " \n\n "), (n + 4, long), (n + 5, long + " end"), (n + 6, "né ü 日本 😀" * 40), (n + 6, "né ü 日本 😀" * 40)]
            df = df.unionByName(spark.createDataFrame([(i, t, None, "extra", len(t or "")) for i, t in more], "doc_id long, text string, lang string, source string, n_chars long").select(*(F.col(c).cast(k).alias(c) for c, k in df.dtypes)))
            df = df.unionByName(df.limit(5))
        if table == "conversations":
            df = df.unionByName(df.limit(3)).unionByName(df.limit(1).selectExpr(*(f"CAST(NULL AS {k}) AS {c}" if c == "text" else c for c, k in df.dtypes)))
        df.coalesce(3).write.parquet(f"{out}/{table}.parquet")
    return out


@pytest.fixture(scope="module")
def texts(spark, folder):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


def test_op1(spark, folder, texts):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.default_tokenizer())
    want = []
    for i, t in texts:
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    got = queries.op1_best_fit_packing(spark, folder).toPandas()
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got[columns].itertuples(index=False, name=None))) == sorted(want)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum()[:-1]] and s.length.sum() <= 1024
    assert got.sequence_id.nunique() <= 1.02 * -(-got.length.sum() // 1024) + 1


def test_op2(spark, folder, texts):
    want = brute(texts)
    got = queries.op2_minmax_near_dedup(spark, folder).collect()
    assert len(got) == len(texts)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_op3(spark, folder):
    rows = spark.read.parquet(f"{folder}/conversations.parquet").collect()
    says, turns = "<|im_end|><|im_start|>assistant ok", {}
    for r in rows:
        turns.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"] or ""))
    turns[-1] = [(0, "user", says), (1, "assistant", says)]
    got = {r["conv_id"]: r for r in queries.op3_chat_format(spark, folder).collect()}
    assert set(got) == set(turns)
    for k, own in turns.items():
        own = sorted(own)
        learnt = "".join(t for _, role, t in own if role == "assistant")
        assert got[k]["n_turns"] == len(own) and got[k]["loss_chars"] == len(learnt)
        assert got[k]["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in own).encode()).hexdigest()
        assert got[k]["loss_sha256"] == hashlib.sha256(learnt.encode()).hexdigest()


def test_op4(spark, folder, texts):
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = queries.op4_toxicity(spark, folder).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, _ in texts)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    held = [(r["predicted"], toxic[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in toxic]
    assert sum(p == y for p, y in held) >= 0.85 * len(held)
    alike = {}
    for r in got:
        alike.setdefault(dict(texts)[r["doc_id"]], set()).add(r["score"])
    assert all(len(s) == 1 for s in alike.values())


def test_op6(spark, folder, texts):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = queries.op6_language_id(spark, folder).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, _ in texts)
    known, text = {x for x in lang.values() if x}, dict(texts)
    for r in got:
        letters = any(c.isalpha() for c in text[r["doc_id"]] or "")
        assert (r["lang_pred"] in known) if letters else (r["lang_pred"] == "und" and r["score"] == 0)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [r["lang_pred"] == lang[r["doc_id"]] for r in got if r["held_out"] and lang[r["doc_id"]] and r["lang_pred"] != "und"]
    assert np.mean(held) >= 0.95


def groups(texts, likeness):
    """A vote for each text: texts whose three-word shingles are so alike, by links, share one."""
    sets = []
    for t in texts:
        w = WORD.findall(t.translate(LOWER))
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} or set(w))
    vote = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and vote[i] != vote[j] and len(sets[i] & sets[j]) >= likeness * len(sets[i] | sets[j]):
                vote = [vote[j] if v == vote[i] else v for v in vote]
    return vote


def test_op8(spark, folder, texts):
    distinct = sorted({t for _, t in texts if t})
    # Documents about as alike as the operator's threshold may share a vote or not.
    surely, perhaps = (by_hand(distinct, 10, groups(distinct, x)) for x in (0.45, 0.8))
    got = {r["doc_id"]: r for r in queries.op8_line_templates(spark, folder).collect()}
    assert surely and surely <= perhaps
    for i, t in texts:
        assert got[i]["n_lines"] == (t.count("\n") + 1 if t is not None else 0) and (t is None) == (got[i]["text"] is None)
        if t:
            k, lines, left = distinct.index(t), t.split("\n"), got[i]["text"].split("\n") if got[i]["n_dropped"] < got[i]["n_lines"] else []
            assert len(left) + got[i]["n_dropped"] == len(lines)
            at = 0
            for n, x in enumerate(lines):
                stays = at < len(left) and left[at] == x
                assert stays or (k, n) in perhaps
                assert not stays or (k, n) not in surely
                at += stays
            assert at == len(left)


def test_op9(spark, folder):
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got, hit, all_ = {}, 0, 0
    for r in queries.op9_rp_forest(spark, folder).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    by_id = dict(rows)
    assert set(got) == {i for i, _ in rows if i % 20 == 0}
    for q, found in got.items():
        true = sorted((-float(np.dot(by_id[q], v)), i) for i, v in rows if i != q)[:20]
        assert len(found) == 20 and all(abs(s - float(np.dot(by_id[q], by_id[i]))) < 1e-9 for i, s in found)
        assert [(-s, i) for i, s in found] == sorted((-s, i) for i, s in found)
        hit, all_ = hit + len({i for _, i in true} & {i for i, _ in found}), all_ + 20
    assert hit >= 0.9 * all_


def test_op10(spark, folder, texts):
    v = piece_codec.load_vocabulary(piece_codec.default_model())
    got = sorted(tuple(r) for r in queries.op10_sentencepiece(spark, folder).select("doc_id", "n_ids", "ids_crc32", "n_chars", "text_sha256").collect())
    want = []
    for i, t in texts:
        ids = v.encode(t or "")
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), len(t or ""), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
