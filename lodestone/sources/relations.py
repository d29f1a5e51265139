"""The engine's relations over the tables at hand: chunks, vectors, typed edges, symbols and changes.

Chunks are documents (one each); edges are orders, from customer to part, typed by return flag; symbols are part names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as X

#: Languages that count as code here.
CODE = ("en", "de")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, path, language, name, content, start_line and end_line of each document."""
    d = table(spark, sf_dir, "documents")
    name = F.regexp_extract("text", r"^[^\p{L}\p{N}]*([\p{L}\p{N}]+)", 1)
    return d.select(
        F.col("doc_id").alias("id"),
        F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.col("lang").alias("language"),
        name.alias("name"),
        F.col("text").alias("content"),
        F.lit(1).alias("start_line"),
        X.line_count(F.col("text")).alias("end_line"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, embedding and family."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("family"))


def typed_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """from_id, to_id, edge_type: one row for each order line, so pairs repeat."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    kind = F.when(F.col("l_returnflag") == "A", "calls").when(F.col("l_returnflag") == "R", "imports").otherwise("mentions")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("from_id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("to_id"), kind.alias("edge_type"))


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and module of both sides of the edges."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.concat(F.lit("nation"), F.col("c_nationkey").cast("string")).alias("module"))
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("module"))
    return c.union(p)


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, path, name (qualified by brand), kind: parts of odd keys are definitions, the others forward declarations."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("chunk_id"),
        F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".h")).alias("path"),
        F.concat("p_brand", F.lit("::"), F.regexp_extract("p_type", r"([^ ]+)$", 1)).alias("name"),
        F.when(F.col("p_partkey") % 2 == 1, "definition").otherwise("forward_declaration").alias("kind"),
        (F.col("p_partkey") % 500 + 1).cast("int").alias("start_line"),
        (F.col("p_partkey") % 500 + 1 + F.col("p_size")).cast("int").alias("end_line"),
    )


def states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states of a keyed table (path, content_hash): the last event of each key before and after the middle of the time."""
    e = table(spark, sf_dir, "events").select(F.concat(F.col("user_id").cast("string"), F.lit("/"), "event_type").alias("path"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "event_id", F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), "props"), 256).alias("content_hash"))
    mid = e.agg((F.min("ts") + F.expr("(max(ts) - min(ts)) div 2")).alias("mid"))
    e = e.crossJoin(F.broadcast(mid)).withColumn("late", F.col("ts") > F.col("mid"))  # mid is one row
    last = lambda df: df.groupBy("path").agg(F.max_by("content_hash", F.struct("ts", "event_id")).alias("content_hash"))
    return last(e.where(~F.col("late"))), last(e.where("late"))
