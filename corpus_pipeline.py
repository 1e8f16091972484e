"""A training-data pipeline over ``documents``: five stages, each an operator of ``sonde.llm``.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of ``docs``;
``run`` writes each result as Parquet in the shared scratch folder and reads it for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonde.llm.language_id import identify_languages, train_languages
from sonde.llm.line_templates import drop_recurring_lines
from sonde.llm.minmax_dedup import near_duplicates
from sonde.llm.packing import pack_documents
from sonde.llm.queries import fold
from sonde.llm.scratch import materialize
from sonde.llm.toxicity import score_toxicity, train_toxicity

TOXIC = 0.7
#: Documents of this similarity (in percent) are near duplicates.
ALIKE = 80
#: An ambiguous prediction with less confidence than this is no language that was learnt.
LEAST_CONFIDENCE = 0.4
#: Up to so many rejected rows (16 bytes each) are broadcast; beyond, a shuffled join.
REJECTED_ROWS = 2_000_000


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under names that nothing an operator adds can clash with, and the new name of each column."""
    names = {c: f"doc_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _back(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*(F.col(new).alias(old) for old, new in names.items()))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that score as toxic; learns from the labels of the folds that op4 learns from.

    Null and empty texts score as no n-gram at all and stay; null ids and repeated rows are judged by their
    text like others; without labels of both classes all documents get one score; an empty table gives no rows.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train_toxicity(docs, labels.where(fold(3) != 1))
    plain, names = _plain(docs)
    return _back(score_toxicity(plain, model, tuple(names.values()), names["text"]).where(F.col("score") < TOXIC), names)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents in no learnt language; a null lang becomes the prediction.

    Null texts and texts without a letter are in none, and go; null ids and repeated rows are judged by their text
    like others; an empty table gives no rows.
    """
    model = train_languages(docs.where(fold(4) != 2))
    plain, names = _plain(docs)
    named = identify_languages(plain, model, tuple(names.values()), names["text"])
    named = named.where((F.col("lang_pred") != "und") & ~(F.col("ambiguous") & (F.col("score") < LEAST_CONFIDENCE)))
    return _back(named.withColumn(names["lang"], F.coalesce(names["lang"], "lang_pred")), names)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that recur across them; n_chars follows the text.

    Null and empty texts, null ids and repeated rows stay; a document all of whose lines go has an empty text.
    """
    plain, names = _plain(docs)
    cleaned = drop_recurring_lines(plain, names["text"])
    n_chars = F.when(F.col("n_dropped") > 0, F.length(names["text"]).cast("long")).otherwise(F.col(names["n_chars"]))
    return _back(cleaned.withColumn(names["n_chars"], n_chars), names)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the least doc_id (null ids stand behind all others), of an id's
    texts that of the least hash, of repeated rows one. Rows without words are all kept; an empty table gives no rows."""
    plain, names = _plain(docs)
    text_hash = F.xxhash64(names["text"])
    behind = text_hash.bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    keyed = plain.withColumns({"doc_id": F.coalesce(F.col(names["doc_id"]).cast("long"), behind), "text_hash": text_hash})
    classes = materialize(near_duplicates(keyed.select("doc_id", F.col(names["text"]).alias("text")), percent=ALIKE).where("n_shingles > 0"), "pipeline-classes")
    first = classes.where("kept").groupBy("doc_id").agg(F.min("text_hash").alias("lo"), F.max("text_hash").alias("hi"), F.count("*").alias("n"))
    again = materialize(first.where("n > 1").select("doc_id", "lo"), "pipeline-again")  # ids whose kept texts repeat, or are several
    others = classes.where("kept").join(again, "doc_id").where("text_hash <> lo").select("doc_id", "text_hash")
    rejected = materialize(classes.where("NOT kept").select("doc_id", "text_hash").unionByName(others).distinct(), "pipeline-rejected")
    left = keyed.join(_few(rejected), ["doc_id", "text_hash"], "left_anti")
    repeated = again.select("doc_id", F.col("lo").alias("text_hash"))
    single, twice = (left.join(_few(repeated), ["doc_id", "text_hash"], how) for how in ("left_anti", "left_semi"))
    return _back(single.unionByName(twice.dropDuplicates(["doc_id", "text_hash"])), names)


def _few(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= REJECTED_ROWS else keys


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences; null and empty texts are an end id alone, null ids
    stay null, repeated rows are packed each, an empty table gives no rows."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("minhash_dedup", minhash_dedup),
    ("packing", packing),
]

#: Classifiers and hashing can't be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *filters, (_, last) = STAGES
    for name, stage in filters:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return last(spark, docs, sf_dir)
