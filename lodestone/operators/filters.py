"""Filters, first-wins unions and per-group caps, each with a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X


def scope(df: DataFrame, prefix: str, path: str = "path") -> DataFrame:
    return df.where(X.in_scope(F.col(path), prefix))


def kind(df: DataFrame, which: str, code: tuple[str, ...]) -> DataFrame:
    """code, docs (also without a language) or any."""
    if which == "code":
        return df.where(F.col("language").isin(*code))
    return df.where(F.col("language").isNull() | ~F.col("language").isin(*code)) if which == "docs" else df


def regex(df: DataFrame, pattern: str, top_k: int) -> DataFrame:
    """Rows whose content or name matches, the first by id."""
    return df.where(F.col("content").rlike(pattern) | F.coalesce(F.col("name").rlike(pattern), F.lit(False))).orderBy("id").limit(top_k)


def substring(df: DataFrame, text: str) -> DataFrame:
    return df.where(F.col("content").contains(text))


def word(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col("content").contains(name) & X.whole_word(F.col("content"), name))


def definitions_first(symbols: DataFrame) -> DataFrame:
    """Without forward declarations of names that have a definition."""
    forward = F.coalesce(F.col("kind") == "forward_declaration", F.lit(False))
    defined = symbols.where(~forward).select("name").distinct()
    return symbols.where(~forward).unionByName(symbols.where(forward).join(defined, "name", "left_anti").select(*symbols.columns))


def line_range(df: DataFrame, path: str, after: int, upto: int) -> DataFrame:
    return df.where((F.col("path") == path) & (F.col("end_line") > after) & (F.col("start_line") <= upto))


def cap(df: DataFrame, by: str, most: int, *order: Column) -> DataFrame:
    """The first rows of each group."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place") <= most).drop("place")


def first_then_fill(first: DataFrame, second: DataFrame, order: list[Column], top_k: int, key: str = "id") -> DataFrame:
    """Rows of the first, then those of the second that are not in it, cut at top_k."""
    both = first.withColumn("branch", F.lit(0)).unionByName(second.withColumn("branch", F.lit(1)))
    own = Window.partitionBy(key).orderBy("branch", *order)
    return both.withColumn("place", F.row_number().over(own)).where("place = 1").drop("place").orderBy("branch", *order).limit(top_k)


def suggest_scopes(df: DataFrame, typed: str, most: int = 3) -> DataFrame:
    """Path heads as deep as the typed scope that hold its last segment or begin alike, for 'did you mean'."""
    depth = typed.strip("/").count("/") + 1
    head = F.array_join(F.slice(F.split("path", "/"), 1, depth), "/")
    last = typed.strip("/").split("/")[-1].lower()
    return df.select(head.alias("scope")).distinct().where(F.lower("scope").contains(last) | F.lower("scope").startswith(typed.lower()[:3])).orderBy(F.levenshtein("scope", F.lit(typed)), "scope").limit(most)


def with_entry(df: DataFrame, key: str, names: DataFrame, metadata: str = "metadata") -> DataFrame:
    """Rows whose metadata, a map of lists, has one of the names (name) in its list of that key; null lists have none."""
    own = df.select("id", F.explode(F.col(metadata)[key]).alias("name"))
    return df.join(own.join(names.select("name"), "name", "left_semi").select("id"), "id", "left_semi")
