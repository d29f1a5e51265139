"""Iterative retrieval: seeds from vectors, expansion through the graph and by symbols, until the top no longer improves."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as X
from . import fusion, graph, text, vectors

CAP, SEEDS, NEAR, HUB, TOP_TEXTS, SYMBOLS, PER_SYMBOL, STOP = 500, 20, 5, 50, 30, 10, 10, 0.15
# Endings of names that stand for a kind of thing.
KINDS = ("Manager", "Handler", "Controller", "Service", "Factory", "Builder", "Provider", "Processor", "Runner", "Worker", "Loader", "Parser")
WEIGHTS = {"calls": 1.0, "imports": 0.7, "inherits": 0.9, "xlang": 0.6, "associated": 0.5, "mentions": 0.3}


@dataclass
class Result:
    hits: DataFrame
    iterations: int
    degraded: bool = False
    notes: list[str] = field(default_factory=list)


def symbols_in(texts: DataFrame, most: int = SYMBOLS) -> list[str]:
    """Names in the texts of a short ranked list: qualified, with a second capital, or ending in one of KINDS; the first by rank."""
    name = r"\b(?:[A-Z]\w+(?:::\w+)+|[A-Z][a-z0-9_]*[A-Z]\w*|[A-Za-z]\w{2,}(?:%s))\b" % "|".join(KINDS)
    found = F.filter(F.regexp_extract_all("content", F.lit(name), F.lit(0)), lambda x: F.char_length(x) > 2)
    rows = texts.select("rank", F.posexplode(found).alias("pos", "name")).groupBy("name").agg(F.min(F.struct("rank", "pos")).alias("at")).orderBy("at", "name").limit(most)
    return [r.name for r in rows.collect()]


def holders(chunks: DataFrame, names: list[str], each: int = PER_SYMBOL) -> DataFrame:
    """id and name of the first chunks that hold each of a few names as a whole word, in one pass over the texts."""
    word = lambda n: F.col("content").contains(n) & F.rlike("content", F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), n, F.lit(r"\E(?![A-Za-z0-9_])")))
    hits = chunks.select("id", F.explode(F.filter(F.array(*[F.lit(n) for n in names]), word)).alias("name"))
    return hits.withColumn("place", F.row_number().over(graph.Window.partitionBy("name").orderBy("id"))).where(F.col("place") <= each).select("id", "name")


def expand(seeds: DataFrame, edges: DataFrame, neighbours: DataFrame, degrees: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """id and evidence: nearest chunks and chunks referred to of the seeds, without hubs and the seeds themselves."""
    place = F.row_number().over(graph.Window.partitionBy("donor").orderBy("distance", "id"))
    near = neighbours.select(F.col("id").alias("donor"), F.col("neighbor_id").alias("id"), "distance").join(seeds.select(F.col("id").alias("donor")), "donor", "left_semi")
    near = near.withColumn("place", place).where(F.col("place") <= NEAR).select("id", "donor", F.lit("semantic").alias("evidence"), F.lit(1).alias("o"))
    refs = edges.join(seeds.select(F.col("id").alias("from_id")), "from_id", "left_semi").where(X.lookup(weights, F.col("edge_type"), 0.0) > 0)
    refs = refs.select(F.col("to_id").alias("id"), F.col("from_id").alias("donor"), F.col("edge_type").alias("evidence"), F.lit(0).alias("o"))
    hubs = degrees.groupBy(F.col("to_id").alias("id")).agg(F.sum("n").alias("n")).where(F.col("n") > HUB)
    both = refs.unionByName(near).join(seeds.select("id"), "id", "left_anti").join(hubs, "id", "left_anti")
    return both.groupBy("id").agg(F.min_by("evidence", F.struct("o", "evidence", "donor")).alias("evidence"))


def research(
    chunks: DataFrame, vecs: DataFrame, query: list[float] | None, words: list[str], edges: DataFrame, neighbours: DataFrame, top_k: int = 20, iterations: int = 3, beta: float = 0.5
) -> Result:
    """The whole loop over chunks (id, path, name, content) and vectors (id, embedding). Without a query vector: words only, scores 0."""
    spark: SparkSession = chunks.sparkSession
    notes: list[str] = []
    if query is None:
        hits = text.keyword_fill(chunks, words, top_k).select("id", F.lit(0.0).alias("score"))
        return Result(hits.join(chunks.select("id", "path"), "id"), 0, True, ["no query vector: words only"])
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = lambda ids: ids.join(vecs.select("id", "embedding"), "id", "left").withColumn("score", F.coalesce(X.cosine(F.col("embedding"), q), F.lit(0.0))).drop("embedding")
    pool = vectors.knn(vecs, query, 3 * top_k).withColumn("evidence", F.lit("seed"))
    pool = graph.keep(pool.withColumn("seq", F.lit(0)))
    degrees = graph.indegree(edges)
    before, done = None, 0
    for i in range(iterations):
        done = i + 1
        seeds = pool.orderBy(F.desc("score"), "id").limit(SEEDS)
        new = scored(expand(seeds, edges, neighbours, degrees)).withColumn("seq", F.lit(2 * i + 1))
        top = fusion.ranked(pool.orderBy(F.desc("score"), "id").limit(TOP_TEXTS), F.desc("score"), "id").join(chunks.select("id", "content"), "id")
        names = symbols_in(top)
        if names:
            more = holders(chunks, names).select("id", F.lit("symbol").alias("evidence")).distinct()
            new = new.unionByName(scored(more).withColumn("seq", F.lit(2 * i + 2)))
        pool = graph.keep(fusion.pool(pool.unionByName(new.select(*pool.columns)), CAP))
        now = pool.orderBy(F.desc("score"), "id").limit(5).agg(F.avg("score")).first()[0] or 0.0
        if before is not None and now - before < STOP:
            break
        before = now
    seeds = pool.orderBy(F.desc("score"), "id").limit(TOP_TEXTS).select(F.col("id").alias("donor"), F.col("score").alias("seed_score"))
    out = edges.select(F.col("from_id").alias("donor"), F.col("to_id").alias("id"), X.lookup(WEIGHTS, F.col("edge_type"), 0.0).alias("weight"))
    back = edges.select(F.col("to_id").alias("donor"), F.col("from_id").alias("id"), X.lookup(WEIGHTS, F.col("edge_type"), 0.0).alias("weight"))
    near = neighbours.select(F.col("id").alias("donor"), F.col("neighbor_id").alias("id"), (1 - F.col("distance")).alias("weight"))
    boosted = fusion.boost(pool.select("id", "score", "evidence"), out.unionByName(back).unionByName(near).join(seeds, "donor"), beta)
    ranked = fusion.ranked(boosted.join(chunks.select("id", "path"), "id"), F.desc("score"), "id")
    if pool.count() >= CAP:
        notes.append(f"the pool is cut at {CAP}")
    return Result(fusion.interleave(ranked, top_k), done, False, notes)


def connections(hits: DataFrame, edges: DataFrame, most: int = 40) -> DataFrame:
    """Edges with both ends among the hits."""
    e = edges.join(hits.select(F.col("id").alias("from_id")), "from_id", "left_semi").join(hits.select(F.col("id").alias("to_id")), "to_id", "left_semi")
    return e.select("from_id", "to_id", "edge_type").distinct().orderBy("from_id", "to_id", "edge_type").limit(most)
