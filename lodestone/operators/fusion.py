"""Rank fusion, caps and the selectors of iterative retrieval; all over ranked lists (id, rank or score)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 60
OR_RANKS = 20


def ranked(df: DataFrame, *order, by: tuple[str, ...] = ()) -> DataFrame:
    """With rank from 1, within each of ``by``. A list of its own is one that a cut has made short: one task ranks it."""
    return df.withColumn("rank", F.row_number().over((Window.partitionBy(*by) if by else Window).orderBy(*order)))


def _first(df: DataFrame, top_k: int, by: tuple[str, ...], *order) -> DataFrame:
    """The first top_k rows, of each of ``by``."""
    if not by:
        return df.orderBy(*order).limit(top_k)
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= top_k).drop("place")


def rrf_many(semantic: DataFrame, keyword: DataFrame, top_k: int, by: tuple[str, ...]) -> DataFrame:
    """rrf() of many queries at once: both lists have the columns of ``by``."""
    s, w = semantic.select(*by, "id", F.col("rank").alias("rs")), keyword.select(*by, "id", F.col("rank").alias("rk"))
    one = lambda c: F.coalesce(1.0 / (K + F.col(c)), F.lit(0.0))
    both = s.join(w, [*by, "id"], "full_outer").select(*by, "id", F.round(one("rs") + one("rk"), 12).alias("score"))
    return _first(both, top_k, by, F.desc("score"), "id")


def rrf(semantic: DataFrame, keyword: DataFrame, starved: DataFrame | None, top_k: int) -> DataFrame:
    """id and score by reciprocal rank fusion of two ranked lists.

    starved: ranked hits of any word, given where fewer than top_k rows hold all words; its first 20 count for ids of the
    semantic list only, behind the keyword list.
    """
    if starved is not None:
        n_and = keyword.count()
        more = starved.where(F.col("rank") <= OR_RANKS).join(semantic.select("id"), "id", "left_semi").join(keyword.select("id"), "id", "left_anti")
        keyword = keyword.select("id", "rank").unionByName(more.select("id", (F.col("rank") + n_and).alias("rank")))
    s, w = semantic.select("id", F.col("rank").alias("rs")), keyword.select("id", F.col("rank").alias("rk"))
    one = lambda c: F.coalesce(1.0 / (K + F.col(c)), F.lit(0.0))
    return s.join(w, "id", "full_outer").select("id", (one("rs") + one("rk")).alias("score")).orderBy(F.desc("score"), "id").limit(top_k)


def rerank_fuse(first: DataFrame, second: DataFrame, weight: float = 2.0, candidates: int = 50, by: tuple[str, ...] = ()) -> DataFrame:
    """Order of a first list (rank) corrected by another scorer's (rank): 1/(60+i) + weight/(60+r)."""
    a = first.where(F.col("rank") <= candidates).select(*by, "id", F.col("rank").alias("i"))
    both = a.join(second.select(*by, "id", F.col("rank").alias("r")), [*by, "id"], "left")
    return both.select(*by, "id", (1.0 / (K + F.col("i")) + F.coalesce(weight / (K + F.col("r")), F.lit(0.0))).alias("score"))


def folder_blend(hits: DataFrame, folders: DataFrame, alpha: float = 1.0, beta: float = 0.2, by: tuple[str, ...] = ()) -> DataFrame:
    """Hits' score (with dirname) blended with their folder's score."""
    both = hits.join(folders.select(*by, F.col("path").alias("dirname"), F.col("score").alias("folder_score")), [*by, "dirname"], "left")
    return both.withColumn("score", alpha * F.col("score") + beta * F.coalesce("folder_score", F.lit(0.0))).drop("folder_score")


def file_cap(hits: DataFrame, cap: int, top_k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """At most ``cap`` rows of each path in rank order, then top_k; ``by``: of each query."""
    place = F.row_number().over(Window.partitionBy(*by, "path").orderBy("rank", "id"))
    return _first(hits.withColumn("place", place).where(F.col("place") <= cap).drop("place"), top_k, by, "rank", "id")


def file_ranking(hits: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """path with its best score, number of hits and first rank."""
    return hits.groupBy(*by, "path").agg(F.max("score").alias("best"), F.count("*").alias("hits"), F.min("rank").alias("first_rank"))


def pool(candidates: DataFrame, cap: int = 500) -> DataFrame:
    """Each id at its first place (seq), by score, cut at the cap."""
    first = candidates.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("seq"))).where("place = 1").drop("place")
    return first.orderBy(F.desc("score"), "seq", "id").limit(cap)


def boost(candidates: DataFrame, links: DataFrame, beta: float = 0.5) -> DataFrame:
    """Score plus beta times the largest weight x seed score of the links (id, donor, weight, seed_score) to it."""
    best = links.groupBy("id").agg(F.max(F.col("weight") * F.col("seed_score")).alias("boost"), F.max_by("donor", F.struct(F.col("weight") * F.col("seed_score"), "donor")).alias("donor"))
    return candidates.join(best, "id", "left").withColumn("boost", beta * F.coalesce("boost", F.lit(0.0))).withColumn("score", F.col("score") + F.col("boost"))


def interleave(hits: DataFrame, top_k: int, cap: int = 3, rescues: int = 40) -> DataFrame:
    """Of each path at most cap rows; of the first top_k the firsts of their paths, then rows of new paths by boost, then the rest."""
    kept = hits.withColumn("own", F.row_number().over(Window.partitionBy("path").orderBy("rank", "id"))).where(F.col("own") <= cap)
    window = kept.orderBy("rank", "id").limit(top_k)
    firsts, again = window.where("own = 1").withColumn("part", F.lit(0)), window.where("own > 1").withColumn("part", F.lit(2))
    others = kept.where("own = 1").join(window.select("path").distinct(), "path", "left_anti").where("boost > 0")
    saved = others.orderBy(F.desc("boost"), "rank", "id").limit(rescues).withColumn("part", F.lit(1))
    return firsts.unionByName(saved).unionByName(again).orderBy("part", F.when(F.col("part") == 1, -F.col("boost")), "rank", "id").limit(top_k)


def best_of_scopes(lists: DataFrame, top_k: int) -> DataFrame:
    """Lists of several scopes (id, score, scope): the best score of each id."""
    return lists.groupBy("id").agg(F.max("score").alias("score"), F.max_by("scope", F.struct("score", "scope")).alias("scope")).orderBy(F.desc("score"), "id").limit(top_k)
