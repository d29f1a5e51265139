"""Measures of retrieval quality over ranked results and gold sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import keep
from .graph import placed


def first_hits(results: DataFrame, gold: DataFrame) -> DataFrame:
    """query_id, mode and the rank of the first gold hit (null without one). results: (query_id, mode, id, rank); gold: (query_id, id)."""
    hit = results.join(gold, ["query_id", "id"], "left_semi").groupBy("query_id", "mode").agg(F.min("rank").alias("rank"))
    return results.select("query_id", "mode").distinct().join(hit, ["query_id", "mode"], "left")


def recall_mrr(hits: DataFrame, ks=(1, 5, 10)) -> DataFrame:
    """Of each mode: queries, share with a hit within k, and mean reciprocal rank."""
    return hits.groupBy("mode").agg(F.count("*").alias("n"), *[F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))).alias(f"recall_{k}") for k in ks], F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def consolidation(hits: DataFrame, k: int = 10) -> DataFrame:
    """Of each mode: queries with a hit within k, and those that no other mode hits."""
    h = hits.where(F.col("rank") <= k).select("query_id", "mode")
    n = F.count("*").over(Window.partitionBy("query_id"))
    return h.withColumn("n", n).groupBy("mode").agg(F.count("*").alias("covered"), F.count_if(F.col("n") == 1).alias("unique_wins"))


def class_gold(returned: DataFrame, queries: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gold that is a query's whole class but for itself, without its pairs: the returned rows (query_id, id) that are gold, and
    query_id and n_gold of queries that have any. queries: query_id and family, of members (id, family)."""
    members = members.where("family IS NOT NULL").select("id", "family").distinct()
    asked = queries.select("query_id", "family")
    hits = returned.where("query_id <> id").select("query_id", "id").distinct().join(asked, "query_id").join(members, ["id", "family"], "left_semi").select("query_id", "id").distinct()
    sizes = members.groupBy("family").agg((F.count("*") - 1).alias("n_gold")).where("n_gold > 0")
    return hits, asked.distinct().join(sizes, "family").groupBy("query_id").agg(F.sum("n_gold").alias("n_gold"))


def set_recall(returned: DataFrame, gold: DataFrame, k: int | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """query_id, n_gold and recall of a returned set (query_id, id, rank). With ``sizes`` (query_id, n_gold), gold needs no more than the returned rows that are gold."""
    r = returned if k is None else returned.where(F.col("rank") <= k)
    found = gold.join(r.select("query_id", "id").distinct(), ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("found"))
    sizes = gold.groupBy("query_id").agg(F.countDistinct("id").alias("n_gold")) if sizes is None else sizes
    return sizes.join(found, "query_id", "left").select("query_id", "n_gold", (F.coalesce("found", F.lit(0)) / F.col("n_gold")).alias("recall"))


def win_tie_loss(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.select("query_id", F.col("recall").alias("ra")).join(b.select("query_id", F.col("recall").alias("rb")), "query_id")
    return both.agg(F.avg("ra").alias("mean_a"), F.avg("rb").alias("mean_b"), F.median("ra").alias("median_a"), F.median("rb").alias("median_b"), F.count_if(F.col("rb") > F.col("ra")).alias("wins"), F.count_if(F.col("rb") == F.col("ra")).alias("ties"), F.count_if(F.col("rb") < F.col("ra")).alias("losses"))


def edge_precision(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Of each edge type: edges, those in the truth, and the share."""
    t = truth.select("from_id", "to_id").distinct().withColumn("true", F.lit(1))
    return found.join(t, ["from_id", "to_id"], "left").groupBy("edge_type").agg(F.count("*").alias("n"), F.count("true").alias("n_true"), (F.count("true") / F.count("*")).alias("precision"))


def edge_recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of the true edges that are found, by any type and by typed ones."""
    f = found.groupBy("from_id", "to_id").agg(F.max(F.col("edge_type").isin("calls", "imports", "inherits").cast("int")).alias("typed"))
    both = truth.select("from_id", "to_id").distinct().join(f, ["from_id", "to_id"], "left")
    return both.agg(F.count("*").alias("n"), F.count("typed").alias("any"), F.coalesce(F.sum("typed"), F.lit(0)).alias("typed"))


def interval_union(spans: DataFrame) -> DataFrame:
    """Of each key: the length that its [start, end) spans cover together."""
    w = Window.partitionBy("key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.max("end").over(w)
    new = F.greatest(F.col("end") - F.greatest(F.col("start"), F.coalesce(reached, F.col("start"))), F.lit(0))
    return spans.withColumn("new", new).groupBy("key").agg(F.sum("new").alias("covered"), F.count("*").alias("n_spans"))


def resolve_gold(gold: DataFrame, chunks: DataFrame) -> DataFrame:
    """key_id, n and id: a gold key (path, name, chunk_type, content_hash) narrowed by name, then type, then hash; ambiguous ones have no id.

    A key meets counts of the chunks of its name, of that name and type, and so on, never the chunks themselves: a name of
    many chunks and many keys makes no pairs. There may be as many hashes as chunks, whatever the size of their files, so
    counts are met by shuffle and never pass through the driver.
    """
    c = chunks.where("id IS NOT NULL").select("id", "path", "name", F.col("chunk_type").alias("ct"), F.col("content_hash").alias("ch"))
    finest = c.groupBy("path", "name", "ct", "ch").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    both = gold.select("key_id", "path", "name", "chunk_type", "content_hash")
    for at, more in (("named", []), ("typed", [("ct", "chunk_type")]), ("hashed", [("ch", "content_hash")]), ("exact", [("ct", "chunk_type"), ("ch", "content_hash")])):
        part = finest.groupBy(F.col("path").alias("p"), F.col("name").alias("m"), *[F.col(x).alias(f"of_{x}") for x, _ in more]).agg(F.struct(F.sum("n").alias("n"), F.min("id").alias("id")).alias(at))
        same = (F.col("path") == F.col("p")) & (F.col("name") == F.col("m"))
        for x, y in more:
            same = same & F.col(f"of_{x}").eqNullSafe(F.col(y))
        both = both.join(part.hint("merge"), same, "left").drop("p", "m", *[f"of_{x}" for x, _ in more])
    w = Window.partitionBy("key_id")
    n = lambda c: F.coalesce(F.col(f"{c}.n"), F.lit(0))

    def narrowed(wide: str, narrow: str) -> Column:
        """Whether a key keeps only what ``narrow`` counts: it has several of ``wide``, and some of these."""
        return (F.sum(n(wide)).over(w) > 1) & (F.max(n(narrow)).over(w) > 0)

    both = both.withColumn("by_type", narrowed("named", "typed"))
    both = both.withColumn("wide", F.when(F.col("by_type"), F.col("typed")).otherwise(F.col("named"))).withColumn("narrow", F.when(F.col("by_type"), F.col("exact")).otherwise(F.col("hashed")))
    both = both.withColumn("by_hash", narrowed("wide", "narrow"))
    both = both.withColumn("got", F.when(F.col("by_hash"), F.col("narrow")).otherwise(F.col("wide")))
    return both.groupBy("key_id").agg(F.sum(n("got")).alias("n"), F.when(F.sum(n("got")) == 1, F.min("got.id")).alias("id"))


def sample_targets(chunks: DataFrame, stratum: str, stride: int) -> DataFrame:
    """Every stride-th row of each stratum in order of path and id."""
    return placed(chunks, stratum, "path", "id").where(F.pmod(F.col("place") - 1, F.lit(stride)) == 0)


def interval_owner(points: DataFrame, spans: DataFrame) -> DataFrame:
    """path, line and id of points that just one span of their path holds."""
    both = points.join(spans.select("path", "id", "start_line", "end_line"), "path").where("line BETWEEN start_line AND end_line")
    return both.groupBy("path", "line").agg(F.countDistinct("id").alias("n"), F.min("id").alias("id")).where("n = 1").drop("n")


def judge_medians(rows: DataFrame) -> DataFrame:
    """Of each condition: runs, median turns and cost, and verdicts that hold when the sides are swapped."""
    return rows.groupBy("condition").agg(F.count("*").alias("n"), F.median("num_turns").alias("turns"), F.median("cost_usd").alias("cost"), F.count_if(F.col("verdict") == F.col("swapped_verdict")).alias("consistent"))


def neighbourhood(returned: DataFrame, gold: DataFrame, anchors: DataFrame, ks=(10, 20, 50), sizes: DataFrame | None = None) -> DataFrame:
    """Of each mode (query_id, mode, id, rank): mean share of the gold set within k, and share of queries whose anchor is found. ``sizes``: as for set_recall."""
    hit = returned.join(gold, ["query_id", "id"], "left_semi").groupBy("query_id", "mode").agg(*[F.count_if(F.col("rank") <= k).alias(f"f{k}") for k in ks])
    found = returned.join(anchors, ["query_id", "id"], "left_semi").select("query_id", "mode").distinct().withColumn("anchor", F.lit(1))
    size = gold.groupBy("query_id").agg(F.countDistinct("id").alias("n_gold")) if sizes is None else sizes
    rows = returned.select("query_id", "mode").distinct().join(size, "query_id").join(hit, ["query_id", "mode"], "left").join(found, ["query_id", "mode"], "left")
    return rows.groupBy("mode").agg(F.count("*").alias("n"), *[F.avg(F.coalesce(F.col(f"f{k}"), F.lit(0)) / F.col("n_gold")).alias(f"recall_{k}") for k in ks], F.avg(F.coalesce("anchor", F.lit(0))).alias("anchor_rate"))


def definition_of(references: DataFrame, definitions: DataFrame) -> DataFrame:
    """Each reference (ref_id, symbol, path, line) with one definition of its symbol: of the same file first, then the nearest line.

    A reference looks in one scope of its symbol: its file, else the definitions that have a file, else all of them. The
    nearest line above and below come from one pass over a scope's distinct lines, so no symbol makes pairs.
    """
    d = definitions.where("symbol IS NOT NULL").groupBy("symbol", "path", "line").agg(F.min("def_id").alias("def_id")).where("def_id IS NOT NULL")
    scope = lambda kind, path=None: F.struct(F.lit(kind).alias("kind"), (F.lit(None).cast("string") if path is None else path).alias("of"))
    filed = F.col("path").isNotNull()
    scopes = F.array(F.when(filed, scope("file", F.col("path"))), F.when(filed, scope("files")), scope("all"))
    d = d.select("symbol", F.explode(F.filter(scopes, lambda s: s.isNotNull())).alias("scope"), "line", "def_id").groupBy("symbol", "scope", "line").agg(F.min("def_id").alias("def_id"))
    keys = references.where("symbol IS NOT NULL").select("symbol", "path", "line").distinct()
    files = d.where("scope.kind = 'file'").select("symbol", F.col("scope.of").alias("path"), F.lit(True).alias("same")).distinct()
    named = d.where("scope.kind = 'files'").select("symbol", F.lit(True).alias("named")).distinct()
    keys = keys.join(files, ["symbol", "path"], "left").join(named, "symbol", "left")
    tier = F.when(~filed, 2).when(F.col("same"), 0).when(F.col("named"), 1).otherwise(2)
    own = F.when(filed & F.col("same"), scope("file", F.col("path"))).when(filed & F.col("named"), scope("files")).otherwise(scope("all"))
    keys = keep(keys.select("symbol", "path", "line", own.alias("scope"), tier.alias("tier")), "lookups")
    asked = keys.select("symbol", "scope", "line").distinct().withColumn("def_id", F.lit(None).cast(d.schema["def_id"].dataType))
    lines = asked.unionByName(d).groupBy("symbol", "scope", "line").agg(F.min("def_id").alias("def_id"))
    here = F.when(F.col("def_id").isNotNull() & F.col("line").isNotNull(), F.struct("line", "def_id"))
    reached = lambda order: F.last(here, ignorenulls=True).over(Window.partitionBy("symbol", "scope").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("above", reached(F.asc("line"))).withColumn("below", reached(F.desc("line")))
    found = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("line") - F.col(f"{c}.line")).alias("away"), F.col(f"{c}.def_id").alias("def_id")))
    lines = lines.where("line IS NOT NULL").select("symbol", "scope", "line", F.least(found("above"), found("below")).alias("near"))
    least = d.groupBy("symbol", "scope").agg(F.min("def_id").alias("any"))  # where no line tells them apart
    got = keys.join(lines, ["symbol", "scope", "line"], "left").join(least, ["symbol", "scope"], "left")
    got = got.select(F.col("symbol").alias("s"), F.col("path").alias("p"), F.col("line").alias("l"), "tier", F.col("near.away").alias("away"), F.coalesce("near.def_id", "any").alias("def_id")).where("def_id IS NOT NULL")
    both = references.join(got, (F.col("symbol") == F.col("s")) & F.col("path").eqNullSafe(F.col("p")) & F.col("line").eqNullSafe(F.col("l")))
    best = F.min(F.struct("tier", F.col("away").isNull().alias("far"), "away", "def_id"))
    return both.groupBy("ref_id").agg(best.alias("b")).select("ref_id", "b.def_id")


def equal_graphs(a: DataFrame, b: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Rows of two neighbour graphs that differ, with both distances."""
    x, y = a.select("id", "neighbor_id", F.col("distance").alias("a")), b.select("id", "neighbor_id", F.col("distance").alias("b"))
    return x.join(y, ["id", "neighbor_id"], "full_outer").where(F.col("a").isNull() | F.col("b").isNull() | (F.abs(F.col("a") - F.col("b")) > tolerance))


def relational_targets(edges: DataFrame, modules: DataFrame, degrees: DataFrame, hub: int = 50, stride: int = 5) -> DataFrame:
    """Callees in another module than their caller's that are no hubs, every stride-th of each module."""
    m = modules.select("id", "module")
    e = edges.where("edge_type = 'calls'").join(m.toDF("from_id", "fm"), "from_id").join(m.toDF("to_id", "module"), "to_id").where("fm <> module")
    big = degrees.groupBy("to_id").agg(F.sum("n").alias("n")).where(F.col("n") > hub)
    t = e.select("to_id", "module").distinct().join(big, "to_id", "left_anti")
    place = F.row_number().over(Window.partitionBy("module").orderBy("to_id"))
    return t.withColumn("place", place).where(F.pmod(F.col("place") - 1, F.lit(stride)) == 0)
