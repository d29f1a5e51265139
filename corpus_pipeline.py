"""The corpus pipeline: toxicity, near-duplicates, benchmark passages, personal data, then token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. The stages' rules for nulls, empty texts, ties and
repeated rows are those of their operators; a repeated row is a copy, of which the second stage keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import keep, pick, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    return pick(docs, *COLUMNS)


def _keyed(docs: DataFrame) -> DataFrame:
    """With k and h, never null, which tell rows of different ids or texts apart."""
    return docs.withColumn("k", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).withColumn("h", F.md5(F.coalesce("text", F.lit(""))))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    from lodestone.llm.toxicity_gbt import not_toxic, train

    docs = _documents(docs)
    return not_toxic(docs, train(docs, table(spark, sf_dir, "labels")), COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the one with the least doc_id, a null being the largest; of rows that tie, the first by text hash, lang, source and n_chars."""
    from lodestone.llm.icws_dedup import classes

    docs = _documents(docs)
    rows = classes(docs, more=True).select("root", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.lower(F.hex("h")).alias("h")).alias("r"))
    kept = keep(rows.groupBy("root").agg(F.min("r").alias("r")).select(F.coalesce(F.col("r.doc_id").cast("string"), F.lit("")).alias("k"), "r.h"), "kept")
    one = _keyed(docs).join(kept, ["k", "h"], "left_semi")
    tie = Window.partitionBy("k", "h").orderBy("lang", "source", "n_chars")
    return one.withColumn("place", F.row_number().over(tie)).where("place = 1").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs, however long they are."""
    from lodestone.llm.decontaminate import decontaminate

    docs = _documents(docs)
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), more=True).where("n_hit > 0")
    found = keep(found.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("k"), "h"), "contaminated")
    return _keyed(docs).join(found, ["k", "h"], "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in the text replaced by its kind."""
    from lodestone.llm.pii_crf import redact

    return redact(_documents(docs), COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document."""
    from lodestone.llm.queries import _tokenizer
    from lodestone.llm.sentencepiece_prefix import encode

    return encode(_documents(docs), _tokenizer())


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("personal_data", personal_data), ("token_ids", token_ids)]

#: No SQL states a trained classifier or a tokenizer; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
