"""Finding the source literal of a runtime message: substrings first, then templates with holes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X

LEAST, MOST_SUBSTRING, MOST_SKELETON, GAP = 6, 2000, 600, 80
#: First characters that literals without an inner word are found by.
START = 3


def exact(literals: DataFrame, message: str) -> DataFrame:
    """Literals that the message holds or that hold it; where none, the same with the message's first line."""
    for text in dict.fromkeys([message, message.split("\n", 1)[0]]):
        if LEAST <= len(text) < MOST_SUBSTRING:
            hit = literals.where((F.char_length("text") >= LEAST) & (F.lit(text).contains(F.col("text")) | F.col("text").contains(text)) & (X.message_shaped(F.col("text")) | (F.col("text") == text)))
            if hit.limit(1).count():
                return hit
    return literals.limit(0)


def skeleton_pattern(skel: Column) -> Column:
    """A pattern of the fragments in order, with gaps of 80 characters at most."""
    return F.concat(F.lit(r"(?s)\Q"), F.array_join(X.fragments(skel), r"\E.{0,%d}?\Q" % GAP), F.lit(r"\E"))


def by_skeleton(literals: DataFrame, message: str) -> DataFrame:
    """Literals whose template matches within the message, the longest fragment first; its longest fragment must occur as it is."""
    s = literals.withColumn("skeleton", X.skeleton(F.col("text"))).where("skeleton IS NOT NULL").withColumn("longest", X.longest_fragment(F.col("skeleton")))
    if len(message) > MOST_SKELETON:
        return s.limit(0)
    s = s.where((F.char_length("longest") >= LEAST) & F.lit(message).contains(F.col("longest")))
    return s.where(F.rlike(F.lit(message), skeleton_pattern(F.col("skeleton"))))


def dedupe(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row for each (path, line, text), of the chunk whose lines hold it if there is one."""
    both = hits.join(chunks.select(F.col("id").alias("chunk_id"), "path", "start_line", "end_line"), "chunk_id")
    inside = F.col("line").between(F.col("start_line"), F.col("end_line"))
    place = F.row_number().over(Window.partitionBy("path", "line", "text").orderBy(F.desc(inside), "chunk_id"))
    return both.withColumn("place", place).where("place = 1").drop("place")


def find_by_message(literals: DataFrame, chunks: DataFrame, message: str, limit: int = 20) -> tuple[DataFrame, list[str]]:
    """path, line, text and tier of the literals that may have made the message, and notes on what was left out."""
    notes = []
    if len(message) >= MOST_SUBSTRING:
        notes.append("the message is too long for substring search")
    if len(message) > MOST_SKELETON:
        notes.append("the message is too long for templates")
    one = dedupe(exact(literals, message), chunks).select("path", "line", "text", F.lit("exact").alias("tier"), F.lit(0).alias("o"))
    two = dedupe(by_skeleton(literals, message).drop("skeleton"), chunks).select("path", "line", "text", F.lit("skeleton").alias("tier"), (-F.char_length("longest")).alias("o"))
    two = two.join(one.select("path", "line", "text"), ["path", "line", "text"], "left_anti")
    both = one.unionByName(two.select(*one.columns)).orderBy(F.when(F.col("tier") == "exact", 0).otherwise(1), "o", "path", "line", "text")
    n = both.count()
    if n > limit:
        notes.append(f"{n - limit} more left out")
    return both.limit(limit).drop("o"), notes


def occurrences(literals: DataFrame, messages: DataFrame) -> DataFrame:
    """id and literal_id of all messages (id, content) that hold a literal (literal_id, text) whole.

    A message that holds a literal has its inner words (all but the first and the last, which may be parts of longer
    ones) as words of its own: the longest is joined, the rest verified. Literals without an inner word are joined by
    their first START characters (or all, of shorter ones) to the messages' runs of as many.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    lits = literals.where("text <> ''").select("literal_id", F.col("text").alias("literal"), words(F.col("text")).alias("w"))
    inner = F.slice("w", 2, F.greatest(F.size("w") - 2, F.lit(0)))
    longest = F.aggregate(inner, F.lit(""), lambda a, x: F.when(F.char_length(x) > F.char_length(a), x).otherwise(a))
    lits = lits.withColumn("word", F.nullif(longest, F.lit("")))
    seen = messages.select("id", F.explode(F.array_distinct(words(F.col("content")))).alias("word"))
    pairs = seen.join(lits.where("word IS NOT NULL").select("literal_id", "literal", "word"), "word").select("id", "literal_id", "literal")
    short = lits.where("word IS NULL").select("literal_id", "literal", F.substring("literal", 1, START).alias("start"))
    for n in sorted(r.n for r in short.select(F.char_length("start").alias("n")).distinct().collect()):  # START numbers at most
        runs = F.transform(F.sequence(F.lit(1), F.char_length("content") - (n - 1)), lambda i: F.substring(F.col("content"), i, F.lit(n)))
        held = messages.where(F.char_length("content") >= n).select("id", F.explode(F.array_distinct(runs)).alias("start"))
        pairs = pairs.unionByName(held.join(short.where(F.char_length("start") == n), "start").select("id", "literal_id", "literal"))
    return pairs.join(messages.select("id", "content"), "id").where(F.col("content").contains(F.col("literal"))).select("id", "literal_id")
