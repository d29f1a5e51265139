"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

A window is 13 consecutive words of a benchmark item (an item of fewer words, but not none, is one window).
A window's tokens are its shingles of three words (of fewer, where the window is shorter). All tokens must occur
in a document that holds the window, so by the prefix filter one token is enough to find the candidates: the
window's rarest token over all documents. A candidate must leave room for the window before and behind the token
(the positional and length bounds) and is then verified word for word over the window.

Words are the runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lower-cased. Null and empty texts have no
words and are clean. Repeated rows get the same result each. A null item id counts as the id ''. Windows that
several items share count for each of them. With an empty benchmark all documents are clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, pick

WINDOW, TOKEN = 13, 3
#: Rows, and bytes of their strings, of a table up to which it is broadcast; beyond, the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 1 << 25
#: Stands before each text's tokens, so that one pass over the texts also counts their words.
MARK = -(2**63)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words in order, A-Z lower-cased."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def _raw_words(text: Column) -> Column:
    """The same words at the same places in their own case, in half the time."""
    return F.regexp_extract_all(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))


def _hashed(w: Column, n: int) -> Column:
    """Hash of each shingle of n words of an array."""
    return F.when(
        F.size(w) >= n,
        F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)])),
    ).otherwise(F.array().cast("array<bigint>"))


def _tokens(text: Column, n: int) -> Column:
    """size: words of the text; t: MARK, then the hash of each shingle of n words.

    Lower case here may join more than A-Z does; the verification decides. It leaves the words at their places.
    """
    one = lambda w: F.struct(F.size(w).alias("size"), F.concat(F.array(F.lit(MARK)), _hashed(w, n)).alias("t"))
    return F.element_at(F.transform(F.array(_raw_words(F.lower(text))), one), 1)


def _small(df: DataFrame, size: Column) -> DataFrame:
    """df, to be broadcast if it is proven small: size is about the bytes of a row beyond its numbers."""
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and total <= BROADCAST_BYTES else df


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: win (words joined by spaces), len, items (distinct ids as strings)."""
    b = pick(benchmark, "item_id", "text").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.coalesce("text", F.lit(""))).alias("w"))
    b = b.where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    b = b.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("w"))
    return b.groupBy(F.array_join("w", " ").alias("win"), F.size("w").alias("len")).agg(F.collect_set("item").alias("items"))


def occurrences(docs: DataFrame, wins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A row for each row of docs: doc_id, h (of the text), n_words; and one for each text that holds a window: doc_id, h, n_hit and wins (distinct)."""
    key = ["doc_id", "h"]
    wins = wins.withColumn("q", F.least(F.lit(TOKEN), "len"))
    sizes = sorted(r.q for r in wins.select("q").distinct().collect()) or [TOKEN]  # TOKEN numbers at most
    toks = None
    for q in sizes:
        part = wins.where(F.col("q") == q).select("win", "len", "q", F.posexplode(_hashed(F.split(F.lower("win"), " "), q)).alias("off", "token"))
        toks = part if toks is None else toks.union(part)
    toks = keep(toks, "tokens")
    hits = None
    for q in sizes:
        asked = toks.where(F.col("q") == q).select("token")
        if hits is None:
            asked = asked.union(docs.sparkSession.range(1).select(F.lit(MARK).alias("token")))
        d = docs.select("doc_id", F.md5("text").alias("h"), _tokens(F.col("text"), q).alias("s"))
        d = d.select(*key, F.col("s.size").alias("n"), F.posexplode("s.t").alias("pos", "token"))
        d = d.join(_small(asked.distinct(), F.lit(8)), "token", "left_semi").select(*key, F.lit(q).alias("q"), "n", (F.col("pos") - 1).alias("pos"), "token")
        hits = d if hits is None else hits.union(d)
    hits = keep(hits, "hits")
    rows = hits.where((F.col("token") == MARK) & (F.col("pos") == -1)).select(*key, F.col("n").cast("long").alias("n_words"))
    hits = hits.where("pos >= 0")
    frequency = hits.groupBy("q", "token").count()
    rarest = toks.join(frequency, ["q", "token"], "left").groupBy("win", "len", "q").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "off", "token")).alias("r"))
    prefix = keep(rarest.where("r.count > 0").select("win", "len", "q", "r.off", "r.token"), "prefix")
    found = hits.join(_small(prefix, F.octet_length("win")), ["q", "token"]).select(*key, "n", (F.col("pos") - F.col("off")).alias("start"), "len", "win").where("start >= 0 AND start + len <= n")
    found = keep(found.groupBy(*key).agg(F.collect_set(F.struct("start", "len", "win")).alias("found")), "found")
    texts = docs.select("doc_id", F.md5("text").alias("h"), "text")
    found = _small(found.select(F.col("doc_id").alias("d2"), F.col("h").alias("h2"), "found"), F.aggregate("found", F.lit(0), lambda n, c: n + F.octet_length(c["win"])))
    both = texts.join(found, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2")))
    true = lambda w: F.filter("found", lambda c: F.array_join(F.slice(w, c["start"] + 1, c["len"]), " ") == c["win"])
    both = both.select(*key, F.element_at(F.transform(F.array(words(F.col("text"))), true), 1).alias("found")).where(F.size("found") > 0)
    places = F.array_distinct(F.flatten(F.transform("found", lambda c: F.sequence(c["start"], c["start"] + c["len"] - 1))))
    return rows, both.select(*key, F.size(places).cast("long").alias("n_hit"), F.array_distinct(F.transform("found", lambda c: c["win"])).alias("wins")).dropDuplicates(key)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, more: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for each row of docs; more: also h, the text's MD5."""
    docs = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    wins = keep(windows(benchmark, window), "windows")
    rows, held = occurrences(docs, wins)
    held = keep(held, "occurrences")
    items = held.select("doc_id", "h", F.explode("wins").alias("win")).join(_small(wins.select("win", "items"), F.octet_length("win") + F.octet_length(F.array_join("items", ","))), "win").select("doc_id", "h", F.explode("items").alias("item"))
    items = items.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = held.select(F.col("doc_id").alias("d1"), F.col("h").alias("h1"), "n_hit").join(items.withColumnsRenamed({"doc_id": "d2", "h": "h2"}), F.col("d1").eqNullSafe(F.col("d2")) & (F.col("h1") == F.col("h2"))).drop("d2", "h2")
    n_hit, ids = F.coalesce("n_hit", F.lit(0)), F.coalesce("items", F.array().cast("array<string>"))
    return rows.join(found, F.col("doc_id").eqNullSafe(F.col("d1")) & (F.col("h") == F.col("h1")), "left").select(
        "doc_id",
        "n_words",
        n_hit.cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        *(["h"] if more else []),
    )
