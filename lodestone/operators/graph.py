"""The reference graph: names, mentions, typed edges and their merge; degrees, PageRank, hierarchy and path traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..functions.scratch import forget, keep, sent

MOST_DEFINERS, SHORTEST = 8, 3
BUCKETS_PER_DOUBLING = 4


# names and mentions


def name_index(names: DataFrame) -> DataFrame:
    """name and id of definers: names of three characters or more, and bare names of qualified ones, with 8 definers at most.

    The bare names of a name count for all its definers or for none.
    """
    names = names.where(F.char_length("name") >= SHORTEST).select("name", "id")
    own = names.distinct()
    bare = names.select(X.bare_name(F.col("name")).alias("name"), "id").where("name IS NOT NULL")
    everyone = own.union(bare).distinct()
    few = everyone.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") <= MOST_DEFINERS)
    return everyone.join(few, "name", "left_semi").select("name", "id")


def words(chunks: DataFrame, but: Column | None = None) -> DataFrame:
    """id and each different word of its content, of three characters or more; without those of an array of the chunk, if given."""
    found = F.array_distinct(F.regexp_extract_all("content", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    return chunks.select("id", F.explode(found if but is None else F.array_except(found, but)).alias("name")).where(F.char_length("name") >= SHORTEST)


def mentions(chunks: DataFrame, index: DataFrame, own: DataFrame | Column) -> DataFrame:
    """from_id, to_id, name: words of a chunk that another chunk defines and that are not its own names (a table of id and name, or an array of each chunk)."""
    index = sent(keep(index.select("name", "id"), "index"), "name", "id")
    return mentioned(words(chunks), index, own) if isinstance(own, DataFrame) else mentioned(words(chunks, own), index)


def mentioned(words: DataFrame, index: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """mentions of words (id, name)."""
    found = words.join(index.withColumnRenamed("id", "to_id"), "name").withColumnRenamed("id", "from_id").where("from_id <> to_id").select("from_id", "to_id", "name")
    return without(found, own.withColumnRenamed("id", "from_id"), "from_id", "name") if own is not None else found


def without(found: DataFrame, own: DataFrame, *keys: str) -> DataFrame:
    """found without the rows whose keys own has. An anti join would be made before the joins that make found, on all words."""
    own = own.select(*keys).distinct().withColumn("own", F.lit(True))
    return found.join(own, list(keys), "left").where("own IS NULL").select(*found.columns)


def keyed(pairs: DataFrame) -> DataFrame:
    """id, name, n (names of the id) and df (ids of the name) of distinct (id, name) pairs.

    Pointwise mutual information is log(all pairs / (n * df)): the pairs of the least n * df are the surest, at any total.
    """
    pairs = pairs.select("id", "name").where("id IS NOT NULL AND name IS NOT NULL").repartition("id").distinct()  # moved once: an id's rows are counted and met where they lie
    n = pairs.groupBy("id").agg(F.count("*").alias("n"))
    df = pairs.groupBy("name").agg(F.count("*").alias("df"))
    return pairs.join(n, "id").join(df, "name").select("id", "name", "n", "df")


def is_sure(pairs: DataFrame, fraction: float = 0.02) -> Column:
    """Whether a keyed pair is of the surest share, ties by name, then id: up to the last pair of this share, so flags need no join.

    Counts by bucket of n * df find the bucket in which the share ends; only that one is put in order.
    """
    bucket = F.floor(F.log2(F.col("n") * F.col("df")) * BUCKETS_PER_DOUBLING)
    rows = pairs.withColumn("bucket", bucket)
    counts = sorted((r.bucket, r["count"]) for r in rows.groupBy("bucket").count().collect())  # some hundred at most
    left = int(fraction * sum(c for _, c in counts))
    for cut, c in counts:
        if c > left:
            break
        left -= c
    else:
        return F.lit(True)
    if not left:
        return bucket < cut
    size = F.col("n") * F.col("df")
    last = first_rows(rows.where(F.col("bucket") == cut), [size, F.asc("name"), F.asc("id")], left).agg(F.max(F.struct(size.alias("size"), "name", "id")).alias("last")).first()["last"]
    name, id_ = F.lit(last["name"]), F.lit(last["id"]).cast(pairs.schema["id"].dataType)
    return (size < last["size"]) | ((size == last["size"]) & ((F.col("name") < name) | ((F.col("name") == name) & (F.col("id") <= id_))))


def surest(pairs: DataFrame, fraction: float = 0.02) -> DataFrame:
    """The surest share of keyed pairs, ties by name, then id."""
    return pairs.where(is_sure(pairs, fraction))


def pmi(pairs: DataFrame, fraction: float = 0.02) -> DataFrame:
    """id, name and score of the surest share of (id, name) pairs by pointwise mutual information."""
    pairs = keep(keyed(pairs), "pairs")
    total = pairs.count()
    return surest(pairs, fraction).select("id", "name", F.log2(F.lit(float(total)) / (F.col("n") * F.col("df"))).alias("score"))


def first_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows, where n grows with the data: rows are dealt by ranges of the order, and only one range is cut."""
    part = keep(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    before, cut, left = 0, -1, 0
    for r in sorted(part.groupBy("part").count().collect(), key=lambda r: r.part):  # a row for each range
        if before + r["count"] > n:
            cut, left = r.part, n - before
            break
        before += r["count"]
    if cut < 0:
        return part.drop("part")
    return part.where(F.col("part") < cut).drop("part").unionByName(part.where(F.col("part") == cut).drop("part").orderBy(*order).limit(left))


def placed(df: DataFrame, by: str, *order: str) -> DataFrame:
    """With place from 1 within each value of ``by``, ascending by order, where a value may have any share of all rows.

    Rows are dealt by ranges and numbered as they lie; only the counts of each range are summed up.
    """
    rows = keep(df.repartitionByRange(by, *order).sortWithinPartitions(by, *order).withColumn("at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("at", 33)  # the partition; the rest is the place in it
    parts = rows.groupBy(F.col(by).alias("of"), part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("of").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    parts = keep(parts.select("of", "part", "first", before.alias("before")), "ranges")
    return rows.join(parts, F.col(by).eqNullSafe(F.col("of")) & (part == F.col("part"))).withColumn("place", F.col("at") - F.col("first") + F.col("before") + 1).drop("at", "of", "part", "first", "before")


def xlang_named(definers: DataFrame) -> DataFrame:
    """name, from_id, to_id: definers of one name in different languages, where the name has 8 definers at most."""
    d = definers.select("name", "id", "language").distinct()
    few = d.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n").between(2, MOST_DEFINERS))
    d = d.join(few, "name", "left_semi")
    a, b = d.select("name", F.col("id").alias("from_id"), F.col("language").alias("la")), d.select("name", F.col("id").alias("to_id"), F.col("language").alias("lb"))
    return a.join(b, "name").where("la <> lb AND from_id <> to_id").select("name", "from_id", "to_id").distinct()


def xlang(definers: DataFrame) -> DataFrame:
    """from_id, to_id of xlang_named."""
    return xlang_named(definers).select("from_id", "to_id").distinct()


def typed_edges(entries: DataFrame, definers: DataFrame, reach: DataFrame) -> DataFrame:
    """from_id, to_id, edge_type: entries (id, language, edge_type, name) joined with definers in languages that theirs reaches."""
    e = entries.join(reach, "language").select(F.col("id").alias("from_id"), "edge_type", "name", F.col("target").alias("language"))
    hit = e.join(definers.select("name", F.col("id").alias("to_id"), "language"), ["name", "language"]).where("from_id <> to_id")
    order = F.when(F.col("edge_type") == "calls", 0).when(F.col("edge_type") == "imports", 1).otherwise(2)
    return hit.groupBy("from_id", "to_id").agg(F.min_by("edge_type", order).alias("edge_type"))


def discriminate(calls: DataFrame) -> DataFrame:
    """Of each call's definers (flags exact, suffix, arity) those of the best tier: receiver's class, and of these a fitting arity."""
    w = Window.partitionBy("call_id")
    tier = F.when(F.max(F.col("exact").cast("int")).over(w) == 1, F.col("exact")).when(F.max(F.col("suffix").cast("int")).over(w) == 1, F.col("suffix")).otherwise(True)
    got = calls.withColumn("tier", tier).where("tier").drop("tier")
    fits = F.max(F.col("arity").cast("int")).over(w)
    return got.withColumn("fits", fits).where((F.col("fits") == 0) | F.col("arity")).drop("fits")


def merge(edges: DataFrame) -> DataFrame:
    """One edge for each pair, of the surest type; none from a chunk to itself."""
    rank = X.merge_rank(F.col("edge_type"))
    return edges.where("from_id <> to_id").groupBy("from_id", "to_id").agg(F.min_by("edge_type", F.struct(rank, "edge_type")).alias("edge_type"))


def associated(mentions_: DataFrame, top: DataFrame) -> DataFrame:
    """Mention edges, those whose (from_id, name) is among the surest pairs relabelled."""
    t = sent(keep(top.select(F.col("id").alias("from_id"), "name", F.lit(True).alias("sure")), "sure"), "from_id", "name")
    return mentions_.join(t, ["from_id", "name"], "left").select("from_id", "to_id", F.when(F.col("sure"), "associated").otherwise("mentions").alias("edge_type"))


# degrees and roll-ups


def indegree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("to_id", "edge_type").agg(F.count("*").alias("n"))


def hubs(degrees: DataFrame, pagerank: DataFrame | None, top_k: int, types: list[str] | None = None) -> DataFrame:
    """id, in_degree and score of the chunks most referred to, ties by PageRank, then id."""
    d = degrees if types is None else degrees.where(F.col("edge_type").isin(*types))
    d = d.groupBy(F.col("to_id").alias("id")).agg(F.sum("n").alias("in_degree"))
    d = d.join(pagerank, "id", "left").withColumn("score", F.coalesce("score", F.lit(0.0))) if pagerank is not None else d.withColumn("score", F.lit(0.0))
    return d.orderBy(F.desc("in_degree"), F.desc("score"), "id").limit(top_k)


def module_edges(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """Edges between different modules, counted by type."""
    a, b = modules.toDF("from_id", "from_module"), modules.toDF("to_id", "to_module")
    return edges.join(a, "from_id").join(b, "to_id").where("from_module <> to_module").groupBy("from_module", "to_module", "edge_type").agg(F.count("*").alias("n"))


def orphans(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges of which an end is missing."""
    known = ids.select("id").distinct()
    no_from = edges.join(known.withColumnRenamed("id", "from_id"), "from_id", "left_anti")
    no_to = edges.join(known.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(known.withColumnRenamed("id", "to_id"), "to_id", "left_anti")
    return no_from.select(*edges.columns).unionByName(no_to.select(*edges.columns))


def without_orphans(edges: DataFrame, ids: DataFrame) -> DataFrame:
    known = ids.select("id").distinct()
    return edges.join(known.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(known.withColumnRenamed("id", "to_id"), "to_id", "left_semi")


def provenance_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy(X.provenance(F.col("edge_type")).alias("provenance")).agg(F.count("*").alias("n"))


# PageRank


def pagerank(edges: DataFrame, ids: DataFrame, weights: Column | None = None, alpha: float = 0.85, iterations: int | None = None, most: int = 100) -> DataFrame:
    """id and score. Edges (from_id, to_id) may carry a weight; ends of no out-edge give to all alike.

    Stops when the change is under n·1e-6, or after a fixed number of iterations; each is one join and one sum.
    """
    n = ids.count()
    w = keep(edges.select("from_id", "to_id", (weights if weights is not None else F.lit(1.0)).cast("double").alias("w")).where("w > 0"), "weighted")
    out = keep(w.groupBy("from_id").agg(F.sum("w").alias("total"), F.count("*").alias("links")), "totals")
    # a row has some 1,024 links of a node, so that its id and score are met once for all of them
    part = F.pmod(F.xxhash64("to_id"), F.expr("links div 1024 + 1"))
    links = w.join(out, "from_id").groupBy("from_id", part.alias("part")).agg(F.collect_list(F.struct("to_id", (F.col("w") / F.col("total")).alias("share"))).alias("links"))
    links = keep(links.select("from_id", "links"), "links")
    forget(w)
    x = ids.select("id").join(out.select(F.col("from_id").alias("id"), F.lit(False).alias("dangling")), "id", "left").select("id", F.coalesce("dangling", F.lit(True)).alias("dangling"), F.lit(1.0 / max(n, 1)).alias("score"))
    x = keep(x, "scores")
    for _ in range(iterations if iterations is not None else most):
        lost = x.where("dangling").agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0]
        into = x.select(F.col("id").alias("from_id"), "score").join(links, "from_id").select("score", F.explode("links").alias("l"))
        into = into.groupBy(F.col("l.to_id").alias("id")).agg(F.sum(F.col("score") * F.col("l.share")).alias("got"))
        score = alpha * (F.coalesce("got", F.lit(0.0)) + lost / max(n, 1)) + (1 - alpha) / max(n, 1)
        # kept at each step: the scores are read three times by the next one
        new = keep(x.withColumnRenamed("score", "before").join(into, "id", "left").select("id", "dangling", score.alias("score"), "before"), "scores")
        if iterations is None and new.agg(F.sum(F.abs(F.col("score") - F.col("before")))).first()[0] < n * 1e-6:
            return new.select("id", "score")
        forget(x)
        kept_at, x = new.kept_at, new.drop("before")
        x.kept_at = kept_at
    return x.select("id", "score") if iterations else x.select("id", F.lit(1.0).alias("score"))


# hierarchy


def hierarchy(files: DataFrame) -> DataFrame:
    """id, kind, path and parent_id of every file and of every directory above one."""
    up = files.select("path", X.ancestors(F.col("path")).alias("up"))
    own = up.select(F.concat(F.lit("file:"), "path").alias("id"), F.lit("file").alias("kind"), "path", F.concat(F.lit("dir:"), F.element_at("up", 1)).alias("parent_id"))
    dirs = up.select(F.explode("up").alias("path")).distinct()
    above = F.when(F.col("path") != ".", F.concat(F.lit("dir:"), F.element_at(X.ancestors(F.col("path")), 1)))
    return own.unionByName(dirs.select(F.concat(F.lit("dir:"), "path").alias("id"), F.lit("dir").alias("kind"), "path", above.alias("parent_id")))


def subtree_counts(files: DataFrame) -> DataFrame:
    """Files below each directory."""
    return files.select(F.explode(X.ancestors(F.col("path"))).alias("dir")).groupBy("dir").agg(F.count("*").alias("n_files"))


def paired_files(files: DataFrame, headers: list[str], sources: list[str]) -> DataFrame:
    """Header and implementation of one directory and stem, in both directions."""
    f = files.select("path", X.dirname(F.col("path")).alias("dir"), X.stem(F.col("path")).alias("stem"), X.extension(F.col("path")).alias("ext"))
    h = f.where(F.col("ext").isin(*headers)).select("dir", "stem", F.col("path").alias("header"))
    c = f.where(F.col("ext").isin(*sources)).select("dir", "stem", F.col("path").alias("source"))
    both = h.join(c, ["dir", "stem"])
    return both.select(F.col("header").alias("from_path"), F.col("source").alias("to_path")).union(both.select("source", "header"))


# paths through the graph


def trace(edges: DataFrame, start: DataFrame, goal: DataFrame, most: int = 6, fan_out: int = 25) -> DataFrame:
    """id, depth and parent of all that a breadth-first search from start (id) meets until it meets a goal, against or along edges.

    Of each node the fan_out edges of the surest type are followed. Each level is one join with the frontier.
    """
    both = edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"), "edge_type").unionByName(edges.select(F.col("to_id").alias("a"), F.col("from_id").alias("b"), "edge_type"))
    both = both.groupBy("a", "b").agg(F.min(X.trace_rank(F.col("edge_type"))).alias("rank"))
    place = F.row_number().over(Window.partitionBy("a").orderBy("rank", "b"))
    both = keep(both.withColumn("place", place).where(F.col("place") <= fan_out).select("a", "b"))
    seen = keep(start.select("id").distinct().select("id", F.lit(0).alias("depth"), F.lit(None).cast(dict(start.dtypes)["id"]).alias("parent")))
    for depth in range(1, most + 1):
        if seen.join(goal.select("id"), "id", "left_semi").limit(1).count():
            break
        next_ = seen.where(F.col("depth") == depth - 1).select(F.col("id").alias("a")).join(both, "a").groupBy("b").agg(F.min("a").alias("parent"))
        next_ = next_.select(F.col("b").alias("id"), F.lit(depth).alias("depth"), "parent").join(seen.select("id"), "id", "left_anti")
        next_ = keep(next_)
        if not next_.limit(1).count():
            break
        seen = seen.unionByName(next_)
    return seen


def path_to(seen: DataFrame, goal: DataFrame) -> list:
    """Ids from the start to the least of the nearest goals; one lookup for each step, at most as many as the depth."""
    end = seen.join(goal.select("id"), "id", "left_semi").orderBy("depth", "id").first()
    out = []
    while end is not None:
        out.append(end.id)
        end = seen.where(F.col("id") == end.parent).first() if end.parent is not None else None
    return out[::-1]


def trace_pairs(edges: DataFrame, ends: DataFrame, most: int = 6, fan_out: int | None = 25) -> DataFrame:
    """pair, hops and path (ids) of a shortest way between the two sides of each pair, against or along edges.

    ends: pair, side (0 or 1) and id; a side may have several ids, and the way leads from any of side 0 to any of side 1.
    All pairs are searched at once, each from both ends: a level expands the end with the smaller frontier, and a pair ends
    when its sides meet. Of each node the fan_out edges of the surest type are followed. A pair has at most ``most`` hops or no row.
    Only edges of frontiers are ranked; both sides keep parents, from which the paths are put together.
    """
    both = edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"), "edge_type").unionByName(edges.select(F.col("to_id").alias("a"), F.col("from_id").alias("b"), "edge_type"))
    both = keep(both.select("a", "b", X.trace_rank(F.col("edge_type")).alias("rank")), "both")
    ends = ends.select("pair", "side", "id").where("id IS NOT NULL").distinct()
    front = keep(ends.select("pair", "side", "id", F.lit(0).alias("depth"), F.lit(None).cast(ends.schema["id"].dataType).alias("parent")), "front")
    common = front.groupBy("pair", "id").agg(F.count("*").alias("n")).where("n = 2")
    seen, met = front, keep(common.groupBy("pair").agg(F.min("id").alias("id")).select("pair", F.lit(0).alias("hops"), "id"), "met")
    front = front.join(met, "pair", "left_anti")
    for _ in range(most):
        sizes = front.groupBy("pair", "side").agg(F.count("*").alias("n"))
        turn = sizes.groupBy("pair").agg(F.min(F.struct("n", "side")).alias("s"), F.count("*").alias("sides")).where("sides = 2").select("pair", F.col("s.side").alias("side"))
        turn = keep(turn, "turn")
        if turn.isEmpty():
            break
        steps = sent(keep(front.join(turn, ["pair", "side"]).select("pair", "side", F.col("id").alias("a"), "depth"), "frontier"), "pair", "a").join(both, "a")
        steps = steps.groupBy("pair", "side", "a", "b", "depth").agg(F.min("rank").alias("rank"))
        if fan_out is not None:
            place = F.row_number().over(Window.partitionBy("pair", "side", "a").orderBy("rank", "b"))
            steps = steps.withColumn("place", place).where(F.col("place") <= fan_out)
        found = steps.groupBy("pair", "side", F.col("b").alias("id")).agg((F.min("depth") + 1).alias("depth"), F.min("a").alias("parent"))
        found = keep(found.join(seen.select("pair", "side", "id"), ["pair", "side", "id"], "left_anti"), "front")
        other = seen.select("pair", (F.lit(1) - F.col("side")).alias("side"), "id", F.col("depth").alias("beyond"))
        now = found.join(other, ["pair", "side", "id"]).groupBy("pair").agg(F.min(F.struct((F.col("depth") + F.col("beyond")).alias("hops"), "id")).alias("m"))
        now = keep(now.select("pair", "m.hops", "m.id"), "met")
        seen, met = seen.unionByName(found), met.unionByName(now)
        waiting = front.join(turn.select("pair", (F.lit(1) - F.col("side")).alias("side")), ["pair", "side"])
        front = keep(waiting.unionByName(found).join(now, "pair", "left_anti"), "front")
    path = met.select("pair", "hops", F.array("id").alias("path"), F.col("id").alias("head"), F.col("id").alias("tail"))
    parents = seen.where("parent IS NOT NULL").select("pair", "side", "id", "parent")
    for _ in range(most):
        up = parents.where("side = 0").select("pair", F.col("id").alias("head"), F.col("parent").alias("before"))
        down = parents.where("side = 1").select("pair", F.col("id").alias("tail"), F.col("parent").alias("after"))
        path = path.join(up, ["pair", "head"], "left").join(down, ["pair", "tail"], "left")
        grown = F.concat(F.when(F.col("before").isNotNull(), F.array("before")).otherwise(F.array().cast(path.schema["path"].dataType)), "path", F.when(F.col("after").isNotNull(), F.array("after")).otherwise(F.array().cast(path.schema["path"].dataType)))
        # an end whose parent is not known is the start or the goal: a null finds nothing from then on
        path = keep(path.select("pair", "hops", grown.alias("path"), F.col("before").alias("head"), F.col("after").alias("tail")), "paths")
        if path.where("head IS NOT NULL OR tail IS NOT NULL").isEmpty():
            break
    return path.select("pair", "hops", "path")
