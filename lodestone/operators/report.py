"""Maps, summaries and health figures of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X

CHARS_PER_TOKEN = 4


def family_stats(chunks: DataFrame, code: tuple[str, ...]) -> DataFrame:
    """Of each first path segment: chunks, files, chunks of docs, and the file with most chunks."""
    docs = F.col("language").isNull() | ~F.col("language").isin(*code)
    by_file = chunks.groupBy(X.path_family(F.col("path")).alias("family"), "path").agg(F.count("*").alias("n"), F.count_if(docs).alias("docs"))
    return by_file.groupBy("family").agg(F.sum("n").alias("n_chunks"), F.count("*").alias("n_files"), F.sum("docs").alias("n_docs"), F.min_by("path", F.struct(-F.col("n"), "path")).alias("top_file"), F.max("n").alias("top_chunks"))


def dominance(stats: DataFrame, most: float = 0.80, docs: float = 0.40, file: float = 0.50) -> DataFrame:
    """Families with their share of all chunks, and what of it is worth a warning."""
    total = stats.agg(F.sum("n_chunks").alias("total"))
    s = stats.crossJoin(F.broadcast(total)).withColumn("share", F.col("n_chunks") / F.col("total"))  # total is one row
    return s.select("family", "n_chunks", "share", (F.col("share") >= most).alias("dominates"), ((F.col("n_docs") / F.col("total") >= docs)).alias("docs_heavy"), ((F.col("top_chunks") / F.col("n_chunks") >= file) & (F.col("n_chunks") > 1)).alias("one_file"))


def dotdir_stats(chunks: DataFrame) -> DataFrame:
    n = F.count("*")
    d = chunks.withColumn("dotdir", X.dotdir(F.col("path"))).where("dotdir IS NOT NULL")
    return d.groupBy("dotdir").agg(n.alias("n_chunks"), F.countDistinct("path").alias("n_files"))


def extension_histogram(files: DataFrame, known: list[str], top: int = 50) -> DataFrame:
    """Files of unknown extensions, the most frequent first, the rest as one row."""
    e = files.select(X.extension(F.col("path")).alias("ext")).where(~F.col("ext").isin(*known)).groupBy("ext").agg(F.count("*").alias("n"))
    e = e.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "ext")))  # one row for each extension
    return e.groupBy(F.when(F.col("place") <= top, F.col("ext")).otherwise("(rest)").alias("ext")).agg(F.sum("n").alias("n"))


def folder_hash(chunks: DataFrame) -> DataFrame:
    """Hash of each folder's contents, whatever their order."""
    per = chunks.select(X.dirname(F.col("path")).alias("folder"), X.content_hash(F.col("content")).alias("h"))
    return per.groupBy("folder").agg(F.substring(F.sha2(F.concat(F.array_join(F.array_sort(F.collect_list("h")), "\n"), F.lit("\n")), 256), 1, 16).alias("folder_hash"), F.count("*").alias("n"))


def folder_summary(chunks: DataFrame, scores: DataFrame, top: int = 12) -> DataFrame:
    """Text of each folder: names of its chunks of the highest score, in order."""
    both = chunks.select("id", X.dirname(F.col("path")).alias("folder"), "name").where("name <> ''").join(scores, "id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    best = both.groupBy("folder", "name").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("folder").orderBy(F.desc("score"), "name"))
    cut = best.withColumn("place", place).where(F.col("place") <= top)
    return cut.groupBy("folder").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda s: s["name"]), ", ").alias("summary"))


def changed_folders(now: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Folders to summarise anew, and folders that are gone."""
    s = stored.select("folder", F.col("folder_hash").alias("old"))
    new = now.join(s, "folder", "left").where("old IS NULL OR old <> folder_hash").drop("old")
    return new, stored.join(now.select("folder"), "folder", "left_anti")


def file_scores(chunks: DataFrame, scores: DataFrame) -> DataFrame:
    """Sum of scores of each file; a chunk without one counts as its file's mean, or the mean of all."""
    both = chunks.select("id", "path").join(scores, "id", "left")
    per = both.groupBy("path").agg(F.sum("score").alias("known"), F.count("score").alias("n_known"), F.count("*").alias("n"))
    mean = scores.agg(F.avg("score").alias("mean"))
    per = per.crossJoin(F.broadcast(mean))  # one row
    fallback = F.coalesce(F.col("known") / F.nullif(F.col("n_known"), F.lit(0)), F.col("mean"), F.lit(1.0))
    return per.select("path", (F.coalesce("known", F.lit(0.0)) + (F.col("n") - F.col("n_known")) * fallback).alias("score"))


def budgeted(lines: DataFrame, tokens: int, top: int = 10_000) -> DataFrame:
    """The first lines (rank, text) that fit a token budget together, one at least.

    A line has 1 token or more, so lines of a rank beyond the budget never fit; what the window sees is that short.
    """
    short = lines.orderBy("rank").limit(min(top, max(tokens, 1)))
    w = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    cost = F.greatest(F.ceil(F.char_length("text") / CHARS_PER_TOKEN), F.lit(1))
    used = short.withColumn("tokens", cost).withColumn("used", F.sum("tokens").over(w))
    return used.where((F.col("used") <= tokens) | (F.col("rank") == 1))


def symbol_map(symbols: DataFrame, scores: DataFrame, tokens: int = 1000) -> DataFrame:
    """rank, path, score, block and used: files by the sum of their symbols' scores, each with its symbols by score, line, name and kind (none first), while they fit.

    symbols: path, name, kind, start_line, chunk_id; scores: id, score. A symbol without a score counts as the mean of its
    file, or of all. A block's cost is its characters and a blank line; the first that does not fit ends the map, but one
    file is always shown. Blocks are built for no more files than the budget could hold if each had but a short line.
    """
    chars = tokens * CHARS_PER_TOKEN
    both = symbols.join(scores.select(F.col("id").alias("chunk_id"), "score"), "chunk_id", "left")
    per = both.groupBy("path").agg(F.avg("score").alias("file_mean"), F.sum("score").alias("known"), F.count("score").alias("n_known"), F.count("*").alias("n"))
    mean = both.agg(F.avg("score").alias("mean"))
    per = per.crossJoin(F.broadcast(mean)).withColumn("other", F.coalesce("file_mean", "mean", F.lit(1.0)))  # one row
    total = F.round(F.coalesce("known", F.lit(0.0)) + (F.col("n") - F.col("n_known")) * F.col("other"), 4)
    first = per.select("path", total.alias("file_score"), "other").orderBy(F.desc("file_score"), "path").limit(max(chars // 4, 1))
    own = both.join(first, "path").withColumn("score", F.round(F.coalesce("score", "other"), 6))
    line = F.concat(F.lit("  "), F.when(F.col("kind").isNotNull(), F.concat("kind", F.lit(" "))).otherwise(""), "name", F.lit("  (line "), F.col("start_line").cast("string"), F.lit(")"))
    lines = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "start_line", "name", "kind", line.alias("text"))))
    blocks = own.groupBy("path", "file_score").agg(F.concat("path", F.lit("\n"), F.array_join(F.transform(lines, lambda x: x["text"]), "\n")).alias("block"))
    order = Window.orderBy(F.desc("file_score"), "path")  # the short list of files above
    blocks = blocks.select("path", F.col("file_score").alias("score"), "block", F.row_number().over(order).alias("rank"), F.sum(F.char_length("block") + 2).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("used"))
    return blocks.where((F.col("used") <= chars) | (F.col("rank") == 1))


def repomap(chunks: DataFrame, scores: DataFrame, tokens: int = 1000) -> str:
    """Overview of directories, then files by score with their names by score, cut to a token budget, and what was left out."""
    dirs = chunks.select("path").distinct().select(F.explode(X.ancestors(F.col("path"))).alias("dir")).groupBy("dir").agg(F.count("*").alias("n")).where(F.size(F.split("dir", "/")) <= 2)
    head = [f"{r.dir}/ ({r.n} files)" for r in dirs.orderBy(F.desc("n"), "dir").limit(20).collect()]
    while head and sum(map(len, head)) > tokens * CHARS_PER_TOKEN // 4:
        head.pop()
    symbols = chunks.where("name IS NOT NULL").select("path", "name", F.lit(None).cast("string").alias("kind"), "start_line", F.col("id").alias("chunk_id"))
    body = symbol_map(symbols, scores, max(tokens - sum(map(len, head)) // CHARS_PER_TOKEN, 1)).orderBy("rank").collect()  # as many as fit
    paths = chunks.select("path").distinct()
    left = paths.where(~F.col("path").isin(*[r.path for r in body])) if body else paths
    n = left.count()
    told = ", ".join(f"{r.subtree} ({r.n})" for r in omitted_subtrees(left).orderBy(F.col("subtree") == "(rest)", F.desc("n"), "subtree").collect()) if n else ""
    return "\n\n".join(["\n".join(head), *(r.block for r in body), *([f"… {n} more files: {told}"] if n else [])])


def vitals(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("n_chunks"), F.countDistinct("path").alias("n_files"), F.countDistinct("language").alias("n_languages"), F.sum(F.char_length("content")).alias("n_chars"), F.max("end_line").alias("longest"))


def language_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("language").agg(F.count("*").alias("n"))


def coverage(chunks: DataFrame, files: DataFrame, flag: float = 0.70) -> DataFrame:
    """Share of each file's bytes that its chunks hold, and whether it is too low."""
    held = chunks.groupBy("path").agg(F.sum(F.octet_length("content")).alias("held"))
    share = F.coalesce("held", F.lit(0)) / F.nullif(F.col("size"), F.lit(0))
    return files.join(held, "path", "left").select("path", F.least(share, F.lit(1.0)).alias("coverage"), (share < flag).alias("low"))


def top_report(hubs: DataFrame, modules: DataFrame, per_group: int = 8) -> DataFrame:
    """The hubs of each group with the highest in-degree."""
    both = hubs.join(modules, "id")
    place = F.row_number().over(Window.partitionBy("module").orderBy(F.desc("in_degree"), "id"))
    return both.withColumn("place", place).where(F.col("place") <= per_group).select("module", "place", "id", "in_degree")


def markdown(title: str, sections: dict[str, DataFrame], rows: int = 15) -> str:
    """A report of the first rows of each small table, cut by the caller's order."""
    out = [f"# {title}"]
    for name, df in sections.items():
        got = df.limit(rows).collect()
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns), *("| " + " | ".join(str(x) for x in r) + " |" for r in got)]
    return "\n".join(out) + "\n"


def doctor(chunks: DataFrame, edges: DataFrame, vectors: DataFrame, meta: dict[str, str], expected: dict[str, str]) -> list[str]:
    """Findings on the state of an index, each one line; none if all is well."""
    out = [f"{k}: {meta.get(k)!r}, not {v!r}" for k, v in expected.items() if meta.get(k) != v]
    n = chunks.count()
    if not n:
        out.append("no chunks")
    lost = chunks.join(vectors.select("id"), "id", "left_anti").count()
    if lost:
        out.append(f"{lost} of {n} chunks have no vector")
    known = chunks.select("id")
    bad = edges.join(known.withColumnRenamed("id", "from_id"), "from_id", "left_anti").count() + edges.join(known.withColumnRenamed("id", "to_id"), "to_id", "left_anti").count()
    if bad:
        out.append(f"{bad} edge ends are missing")
    return out


def omitted_subtrees(left_out: DataFrame, top: int = 5) -> DataFrame:
    """The groups (first two path segments) with most files that a map leaves out, and the rest as one row."""
    g = left_out.select(F.array_join(F.slice(F.split("path", "/"), 1, 2), "/").alias("subtree")).groupBy("subtree").agg(F.count("*").alias("n"))
    g = g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "subtree")))  # one row for each subtree of two segments
    return g.groupBy(F.when(F.col("place") <= top, F.col("subtree")).otherwise("(rest)").alias("subtree")).agg(F.sum("n").alias("n"))


def idle_entries(entries: list[str], paths: DataFrame) -> list[str]:
    """Include or exclude entries that fit no path."""
    from ..sources.files import glob_pattern

    flags = paths.agg(*[F.max(F.col("path").rlike(glob_pattern(e)).cast("int")).alias(f"e{i}") for i, e in enumerate(entries)]).first() if entries else []
    return [e for e, hit in zip(entries, flags, strict=True) if not hit]


def subsystems(paths: DataFrame, named: DataFrame) -> DataFrame:
    """path and subsystem: the name of the longest prefix (prefix, name) that the path is in, else the path's first segment."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    hit = paths.select("path", F.explode(above).alias("prefix")).join(named.select("prefix", "name"), "prefix")
    best = hit.groupBy("path").agg(F.max_by("name", F.struct(F.char_length("prefix"), "name")).alias("name"))
    return paths.select("path").join(best, "path", "left").select("path", F.coalesce("name", F.element_at(parts, 1)).alias("subsystem"))
