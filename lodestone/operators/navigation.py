"""Symbols, usages, outgoing edges and impact, as queries over chunks, symbols, edges and PageRank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from .filters import definitions_first
from .graph import keep


def find_symbol(symbols: DataFrame, name: str, prefix: bool = False) -> DataFrame:
    """Exact name; a bare name also as the last component of qualified ones; or all names with the prefix. Definitions first."""
    if prefix:
        hits = symbols.where(F.col("name").startswith(name)).withColumn("priority", F.lit(0))
    else:
        exact = F.col("name") == name
        suffix = F.lit(False) if ("::" in name or "." in name) else F.col("name").endswith("::" + name) | F.col("name").endswith("." + name)
        hits = symbols.where(exact | suffix).withColumn("priority", F.when(exact, 0).otherwise(1))
        # where an exact definition exists, the qualified ones are not asked for
        hits = hits.join(F.broadcast(hits.agg(F.min("priority").alias("priority"))), "priority", "left_semi")  # one row
    return definitions_first(hits)


def usages(edges: DataFrame, targets: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """One row for each referring chunk: its surest edge type, whether a recorded reference bears it out, and targets.

    references: (from_id, to_id, class_name) of entries that resolve to the target.
    """
    hits = edges.join(targets.select(F.col("id").alias("to_id")), "to_id", "left_semi").join(targets.select(F.col("id").alias("from_id")), "from_id", "left_anti")
    if references is not None:
        hits = hits.join(references, ["from_id", "to_id"], "left")
    else:
        hits = hits.withColumn("class_name", F.lit(None).cast("string"))
    rank = X.trace_rank(F.col("edge_type"))
    return hits.groupBy("from_id").agg(
        F.min_by("edge_type", F.struct(rank, "edge_type")).alias("edge_type"),
        F.min(rank).alias("rank"),
        F.bool_or(F.col("class_name").isNotNull()).alias("verified"),
        F.countDistinct("to_id").alias("n_targets"),
        F.array_sort(F.collect_set("class_name")).alias("classes"),
    )


def outgoing(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """One row for each chunk that the sources refer to, with the surest edge type."""
    hits = edges.join(sources.select(F.col("id").alias("from_id")), "from_id", "left_semi").join(sources.select(F.col("id").alias("to_id")), "to_id", "left_anti")
    rank = X.trace_rank(F.col("edge_type"))
    return hits.groupBy("to_id").agg(F.min_by("edge_type", F.struct(rank, "edge_type")).alias("edge_type"), F.min(rank).alias("rank"), F.count("*").alias("n_edges"))


def impact(edges: DataFrame, targets: DataFrame, chunks: DataFrame, pagerank: DataFrame, top: int = 3) -> DataFrame:
    """Of each file that refers to the targets: edges by type, chunks, their PageRank (each once) and the top referrers."""
    hits = edges.join(targets.select(F.col("id").alias("to_id")), "to_id", "left_semi")
    located = hits.join(chunks.select(F.col("id").alias("from_id"), "path"), "from_id").join(pagerank.select(F.col("id").alias("from_id"), "score"), "from_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    by_chunk = located.groupBy("path", "from_id").agg(F.count("*").alias("n"), F.max("score").alias("score"), F.count_if(F.col("edge_type") == "calls").alias("calls"), F.count_if(F.col("edge_type") == "imports").alias("imports"), F.count_if(F.col("edge_type") == "mentions").alias("mentions"))
    # the top referrers by window, so that a file of many chunks gathers no more than these
    order = Window.partitionBy("path").orderBy(F.desc("n"), F.desc("score"), "from_id")
    by_chunk = by_chunk.withColumn("place", F.row_number().over(order))
    return by_chunk.groupBy("path").agg(
        F.sum("n").alias("n_edges"),
        F.count("*").alias("n_chunks"),
        F.sum("score").alias("pagerank_sum"),
        F.sum("calls").alias("calls"),
        F.sum("imports").alias("imports"),
        F.sum("mentions").alias("mentions"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= top, F.struct("place", "from_id")))), lambda s: s["from_id"]), ",").alias("top"),
    )


def omitted(hits: DataFrame, limit: int) -> DataFrame:
    """Rows of a collapsed list by class that a limit would leave out."""
    place = F.row_number().over(Window.orderBy("rank", "from_id"))
    return hits.withColumn("place", place).groupBy("edge_type").agg(F.count_if(F.col("place") > limit).alias("omitted"), F.count("*").alias("n"))


def bases_closure(bases: DataFrame, most: int = 16) -> DataFrame:
    """owner, base, depth: all bases of each class, breadth first."""
    bases = keep(bases.select("owner", "base").distinct())
    level = bases.withColumn("depth", F.lit(1))
    out = level
    for depth in range(2, most + 1):
        level = level.select("owner", F.col("base").alias("mid")).join(bases.select(F.col("owner").alias("mid"), "base"), "mid").select("owner", "base", F.lit(depth).alias("depth")).distinct()
        level = keep(level.join(out.select("owner", "base"), ["owner", "base"], "left_anti"))
        if not level.limit(1).count():
            break
        out = out.unionByName(level)
    return out


def qualified_lookup(members: DataFrame, bases: DataFrame, owner: str, name: str) -> DataFrame:
    """Members of that name in the class, or else in its nearest bases."""
    own = members.where((F.col("owner") == owner) & (F.col("name") == name)).withColumn("depth", F.lit(0))
    above = bases_closure(bases).where(F.col("owner") == owner).select(F.col("base").alias("owner"), "depth").join(members.where(F.col("name") == name), "owner")
    both = own.unionByName(above.select(*own.columns))
    return both.join(F.broadcast(both.agg(F.min("depth").alias("depth"))), "depth", "left_semi")  # one row


def stitch(pieces: DataFrame) -> DataFrame:
    """Source of each (path, name) from its pieces in order of lines, with a mark where lines are missing."""
    own = Window.partitionBy("path", "name").orderBy("start_line", "end_line")
    reached = F.max("end_line").over(own.rowsBetween(Window.unboundedPreceding, -1))
    text = F.when(F.col("start_line") > reached + 1, F.concat(F.lit("…\n"), "content")).otherwise(F.col("content"))
    marked = pieces.withColumn("text", text)
    return marked.groupBy("path", "name").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "end_line", "text"))), lambda s: s["text"]), "\n").alias("source"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line")
    )


def locate(symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each symbol's chunk: of those of its path that hold its first line the one that starts last."""
    both = symbols.alias("s").join(chunks.select(F.col("path").alias("p2"), F.col("id").alias("located"), F.col("start_line").alias("a"), F.col("end_line").alias("b")), (F.col("path") == F.col("p2")) & F.col("start_line").between(F.col("a"), F.col("b")))
    place = F.row_number().over(Window.partitionBy("path", "name", "start_line").orderBy(F.desc("a"), "located"))
    return both.withColumn("place", place).where("place = 1").select("path", "name", "start_line", "located")
