"""Full-text search: postings, a boolean query language and BM25 with column weights.

Tokens are runs of letters and digits, in lower case. A corpus's statistics cover all its rows, also for scoped queries.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import first_then_fill

TOKEN = r"[\p{L}\p{N}]+"
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
WEIGHTS = {"name": 5.0, "content": 1.0}


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def query_tokens(query: str) -> list[str]:
    return [w for w in (m.lower() for m in re.findall(r"[^\W_]+", query))]


def postings(df: DataFrame, columns=("name", "content")) -> DataFrame:
    """term, id, col and positions."""
    out = None
    for c in columns:
        part = df.select("id", F.lit(c).alias("col"), F.posexplode(tokens(F.col(c))).alias("pos", "term"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("term", "id", "col").agg(F.array_sort(F.collect_list("pos")).alias("positions"))


def _is(term: str):
    return lambda x: x == term


def _phrase_count(bag: Column, words: list[str]) -> Column:
    def at(x: Column, i: Column) -> Column:
        ok = x == words[0]
        for k, w in enumerate(words[1:], 1):
            ok = ok & F.coalesce(F.get(bag, i + k) == w, F.lit(False))
        return ok

    return F.size(F.filter(bag, at))


@dataclass
class Query:
    """A parsed query: operator (term, phrase, prefix, near, and, or, not) and its parts."""

    op: str
    parts: list
    distance: int = 10


def parse(text: str) -> Query:
    """Bare words (and), AND, OR, NOT, NEAR(a b, n), "phrases", prefix*; raises ValueError on bad syntax."""
    lexemes = re.findall(r'"[^"]*"|NEAR\([^)]*\)|\(|\)|[^\s()"]+', text)
    if "".join(lexemes).replace(" ", "") != re.sub(r"\s", "", text):
        raise ValueError("unbalanced quote")
    at = 0

    def either() -> Query:
        nonlocal at
        parts = [both()]
        while at < len(lexemes) and lexemes[at] == "OR":
            at += 1
            parts.append(both())
        return parts[0] if len(parts) == 1 else Query("or", parts)

    def both() -> Query:
        nonlocal at
        left = single()
        while at < len(lexemes) and lexemes[at] not in ("OR", ")"):
            if lexemes[at] == "NOT":
                at += 1
                left = Query("not", [left, single()])
            else:
                at += lexemes[at] == "AND"
                left = Query("and", [*(left.parts if left.op == "and" else [left]), single()])
        return left

    def single() -> Query:
        nonlocal at
        if at >= len(lexemes) or lexemes[at] in ("AND", "OR", "NOT", ")"):
            raise ValueError(f"a term is missing in {text!r}")
        x = lexemes[at]
        at += 1
        if x == "(":
            inner = either()
            if at >= len(lexemes) or lexemes[at] != ")":
                raise ValueError("unbalanced bracket")
            at += 1
            return inner
        if x.startswith("NEAR("):
            words, _, n = x[5:-1].partition(",")
            return Query("near", query_tokens(words), int(n or 10))
        words = query_tokens(x)
        if not words or not re.fullmatch(r'"[^"]*"|[\w]+\*?', x):
            raise ValueError(f"bad term {x!r}")
        if x.endswith("*"):
            return Query("prefix", words)
        return Query("term" if len(words) == 1 else "phrase", words)

    if not lexemes:
        raise ValueError("empty query")
    got = either()
    if at < len(lexemes):
        raise ValueError("unbalanced bracket")
    return got


def leaves_of(q: Query, negated: bool = False) -> list[Query]:
    """The leaves of a query; with or without those after a NOT."""
    return [q] if q.op in ("term", "phrase", "prefix", "near") else [x for p in (q.parts[:1] if q.op == "not" and not negated else q.parts) for x in leaves_of(p, negated)]


def _leaf_count(bag: Column, q: Query) -> Column:
    if q.op == "prefix":
        return F.size(F.filter(bag, lambda x: x.startswith(q.parts[0])))
    if q.op == "near":
        near = F.lit(1)
        for w in q.parts[1:]:
            close = F.exists(F.transform(bag, lambda x, i: F.when(x == q.parts[0], F.exists(F.slice(bag, F.greatest(i + 1 - q.distance, F.lit(1)), F.least(i, F.lit(q.distance)) + (q.distance + 1)), _is(w))).otherwise(False)), lambda x: x)
            near = near * close.cast("int")
        return near * F.size(F.filter(bag, _is(q.parts[0])))
    return _phrase_count(bag, q.parts)


def _holds(q: Query, bags: list[Column]) -> Column:
    if q.op == "and":
        out = F.lit(True)
        for p in q.parts:
            out = out & _holds(p, bags)
        return out
    if q.op == "or":
        out = F.lit(False)
        for p in q.parts:
            out = out | _holds(p, bags)
        return out
    if q.op == "not":
        return _holds(q.parts[0], bags) & ~_holds(q.parts[1], bags)
    out = F.lit(False)
    for b in bags:
        out = out | (_leaf_count(b, q) > 0)
    return out


def _facts(df: DataFrame, columns, leaves: list[Query], holds) -> DataFrame:
    """id, n (tokens of all columns), holds, and the count of each leaf in each column (tf{i}_{column}).

    A text is tokenised once for all of them: the generator keeps conditions on its result from being pushed below it.
    """

    def of(b: Column) -> Column:
        bags = [b[c] for c in columns]
        counts = [_leaf_count(b[c], leaf).alias(f"tf{i}_{c}") for i, leaf in enumerate(leaves) for c in columns]
        return F.struct(sum((F.size(x) for x in bags), F.lit(0)).alias("n"), holds(bags).alias("holds"), *counts)

    bags = F.array(F.struct(*[tokens(F.col(c)).alias(c) for c in columns]))
    return df.select("id", F.explode(F.transform(bags, of)).alias("f")).select("id", "f.*")


def _may_hold(leaves: list[Query], columns, every: bool = False) -> Column:
    """Whether a row has the first word of any (every) leaf somewhere, be it within a longer word: cheap, and never false for a row that holds."""
    out = F.lit(every)
    for leaf in leaves:
        has = F.lit(False)
        for c in columns:
            has = has | F.lower(F.coalesce(F.col(c), F.lit(""))).contains(leaf.parts[0])
        out = out & has if every else out | has
    return out


def _ranked(df: DataFrame, leaves: list[Query], holds, weights: dict[str, float], every: bool, top_k: int | None) -> DataFrame:
    """id and score (negative, the best first) of the rows that hold. The corpus's statistics are one row, read first."""
    columns = list(weights)
    has = [F.greatest(*[F.col(f"tf{i}_{c}") for c in columns], F.lit(0)) > 0 for i in range(len(leaves))]
    stats = _facts(df, columns, leaves, holds).agg(F.count("*").alias("rows"), F.avg("n").alias("mean"), *[F.sum(h.cast("int")).alias(f"df{i}") for i, h in enumerate(has)]).first()
    total = F.lit(0.0)
    for i in range(len(leaves)):
        rows, held = F.lit(stats["rows"]), F.lit(stats[f"df{i}"])
        idf = F.log((rows - held + 0.5) / (held + 0.5))
        f = sum((F.col(f"tf{i}_{c}") * w for c, w in weights.items()), F.lit(0.0))
        total = total + F.when(f > 0, F.when(idf > 0, idf).otherwise(LEAST_IDF) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("n") / F.lit(stats["mean"])))).otherwise(0.0)
    out = _facts(df.where(_may_hold(leaves, columns, every)), columns, leaves, holds).where("holds").select("id", (-total).alias("score"))
    return out.orderBy("score", "id").limit(top_k) if top_k else out


def bm25(df: DataFrame, terms: list[str], every: bool = True, weights: dict[str, float] = WEIGHTS, top_k: int | None = 20) -> DataFrame:
    """id and score of rows that hold all (or any) terms, the best first."""
    leaves = [Query("term", [t]) for t in terms]
    q = Query("and" if every else "or", leaves)
    return _ranked(df, leaves, lambda bags: _holds(q, bags), weights, every, top_k)


def search(df: DataFrame, query: str, weights: dict[str, float] = WEIGHTS, top_k: int | None = 20) -> DataFrame:
    """id and score for a query in the boolean language; leaves count as terms of BM25."""
    q = parse(query)
    return _ranked(df, leaves_of(q), lambda bags: _holds(q, bags), weights, False, top_k)


def fts(df: DataFrame, query: str, **kw) -> tuple[DataFrame, list[str]]:
    """search(); where the syntax is bad, all its words are asked for instead, with a note."""
    try:
        return search(df, query, **kw), []
    except ValueError as e:
        return bm25(df, query_tokens(query), **kw), [f"read as plain words: {e}"]


def fts_or_any(df: DataFrame, query: str, **kw) -> tuple[DataFrame, list[str]]:
    """All words, or any of them where no row has all."""
    words = query_tokens(query)
    got = bm25(df, words, **kw)
    return (got, []) if got.limit(1).count() else (bm25(df, words, every=False, **kw), ["no row has all words; any of them"])


def keyword_fill(df: DataFrame, terms: list[str], top_k: int) -> DataFrame:
    """Rows with all terms by score, then rows with any."""
    return first_then_fill(bm25(df, terms, True, top_k=top_k), bm25(df, terms, False, top_k=top_k), [F.col("score"), F.col("id")], top_k)


def literal_candidates(literals: DataFrame, message: str, most: int = 12, cap: int = 20_000) -> DataFrame:
    """Literals that share one of the message's longest words, the best first."""
    words = sorted(set(query_tokens(message)), key=lambda w: (-len(w), w))[:most]
    return bm25(literals.withColumnRenamed("text", "content"), words, every=False, weights={"content": 1.0}, top_k=cap)


def headings(df: DataFrame) -> DataFrame:
    """path, line, level and title of ATX headings outside fences of the same sign; section: their running number."""
    lines = df.select("path", F.posexplode(F.split("content", "\n")).alias("at", "line_text"))
    own = Window.partitionBy("path").orderBy("at")
    sign = F.regexp_extract("line_text", r"^ {0,3}(`{3}|~{3})", 1)
    fence = F.when(sign != "", F.substring(sign, 1, 1))
    # state of the fence before each line: the sign that opened it, or none
    marks = lines.withColumn("fence", fence).withColumn("marks", F.array_join(F.collect_list("fence").over(own.rowsBetween(Window.unboundedPreceding, -1)), ""))
    opened = F.regexp_replace("marks", r"`[^`]*`|~[^~]*~", "")
    title = F.trim(F.regexp_replace(F.regexp_extract("line_text", r"^ {0,3}#{1,6}(?:[ \t]+(.*))?$", 1), r"[ \t]+#+[ \t]*$|^#+$", ""))
    heads = marks.where((opened == "") & F.col("line_text").rlike(r"^ {0,3}#{1,6}([ \t]|$)"))
    return heads.select("path", (F.col("at") + 1).alias("line"), F.char_length(F.regexp_extract("line_text", r"(#{1,6})", 1)).alias("level"), F.when(title != "", title).alias("title"), F.row_number().over(Window.partitionBy("path").orderBy("at")).alias("section"))
