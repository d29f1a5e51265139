"""Scalar functions as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sign of a hole, the holes of templates (printf, shell, braces), and the parts of a mixed-case word.
HOLE = "␀*"
PRINTF_HOLE = r"%[-+0 #]*(?:\d+|\*)?(?:\.(?:\d+|\*))?[hlLqjzt]*[diouxXeEfFgGaAcsp]"
DOLLAR_HOLE = r"\$\{[^{}]*\}|\$[A-Za-z_][A-Za-z0-9_]*"
BRACE_HOLE = r"\{[^{}]*\}"
CAMEL = r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+"
#: Edge types from the surest to the least sure, with where they come from.
PROVENANCE = {"calls": "extracted", "imports": "extracted", "inherits": "extracted", "contains": "extracted", "mentions": "inferred", "associated": "inferred", "semantic": "inferred", "xlang": "paired"}
MERGE_RANK = {"calls": 0, "imports": 0, "inherits": 0, "xlang": 1, "associated": 2, "mentions": 3}
TRACE_RANK = {"calls": 0, "imports": 0, "inherits": 0, "xlang": 0, "associated": 1, "mentions": 2, "semantic": 3}
SHORTEST_NAME, MOST_HOLES = 3, 8


def lookup(table: dict, key: Column, default) -> Column:
    """The table's value for key, or the default."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(default))


def provenance(edge_type: Column) -> Column:
    return lookup(PROVENANCE, edge_type, "inferred")


def merge_rank(edge_type: Column) -> Column:
    return lookup(MERGE_RANK, edge_type, 4)


def trace_rank(edge_type: Column) -> Column:
    return lookup(TRACE_RANK, edge_type, 4)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def chunk_id(path: Column, start_line: Column, content: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", path, start_line.cast("string"), content), 256), 1, 16)


def gold_hash(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


# paths


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-cased, with its dot; empty for names without one and for dot files."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def path_family(path: Column) -> Column:
    return F.when(path.contains("/"), F.substring_index(path, "/", 1)).otherwise("(root)")


def dotdir(path: Column) -> Column:
    """The first two segments of a path in a dot directory other than .git, else null."""
    parts = F.split(path, "/")
    return F.when(path.startswith(".") & path.contains("/") & ~path.startswith(".git/"), F.array_join(F.slice(parts, 1, F.least(F.lit(2), F.size(parts) - 1)), "/"))


def ancestors(path: Column) -> Column:
    """All directories above a path, from the nearest to '.'."""
    parts = F.split(path, "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.size(parts) - 1, F.lit(1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))
    return F.concat(above, F.array(F.lit(".")))


def in_scope(path: Column, scope: str) -> Column:
    """The path itself or below it; an empty scope is everything."""
    scope = scope.rstrip("/")
    return F.lit(True) if not scope else (path == scope) | path.startswith(scope + "/")


def file_role(path: Column) -> Column:
    low = F.lower(path)
    return (
        F.when(low.rlike(r"(^|/)(tests?|specs?|__tests__)(/|$)|(^|/)test_|[._]test\.|[._]spec\."), "test")
        .when(low.rlike(r"(^|/)docs?(/|$)|\.(md|rst|txt)$"), "docs")
        .when(low.rlike(r"(^|/)(gen|generated)(/|$)|\.(pb|generated)\."), "gen")
        .otherwise("impl")
    )


def module_name(path: Column) -> Column:
    return F.when(path.endswith(".py"), F.replace(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"/__init__$", ""), F.lit("/"), F.lit(".")))


def age(seconds: Column) -> Column:
    s = F.greatest(F.floor(seconds), F.lit(0))
    unit = lambda n, u: F.concat(F.floor(s / n).cast("string"), F.lit(u))
    return F.when(s < 60, unit(1, "s")).when(s < 3600, unit(60, "m")).when(s < 86400, unit(3600, "h")).otherwise(unit(86400, "d"))


# names


def bare_name(name: Column) -> Column:
    """The last component of a qualified name if it is long enough, else null; null also for a name without qualifier."""
    last = F.element_at(F.split(name, r"::|\."), -1)
    return F.when(name.rlike(r"::|\.") & (F.char_length(last) >= SHORTEST_NAME), last)


def class_name(name: Column) -> Column:
    """Without template arguments, up to four deep, and qualifiers."""
    for _ in range(4):
        name = F.regexp_replace(name, r"<[^<>]*>", "")
    return F.trim(F.element_at(F.split(name, r"::|\."), -1))


def qualifier(name: Column) -> Column:
    """Ns::Cls::m gives Cls; null without a qualifier."""
    parts = F.split(name, r"::|\.")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2))


def clean_name(name: Column) -> Column:
    return name.rlike(r"^\p{L}..") & ~name.contains("operator")


def camel_parts(word: Column) -> Column:
    """Parts of a mixed-case word without underscores, of two characters or more; else none."""
    parts = F.filter(F.regexp_extract_all(word, F.lit(CAMEL), F.lit(0)), lambda p: F.char_length(p) > 1)
    return F.when(~word.contains("_") & word.rlike("[a-z][A-Z]"), parts).otherwise(F.array().cast("array<string>"))


def query_words(text: Column) -> Column:
    """Words in order with the parts of mixed-case words behind them, each once without regard to case."""
    words = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.array_distinct(F.transform(F.flatten(F.transform(words, lambda w: F.concat(F.array(w), camel_parts(w)))), lambda w: F.lower(w)))


def whole_word(content: Column, word: str) -> Column:
    return content.rlike(r"(?<![A-Za-z0-9_])\Q" + word + r"\E(?![A-Za-z0-9_])")


# texts


def line_count(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def embed_text(path: Column, name: Column, content: Column) -> Column:
    """Stripped lines, blank runs collapsed, under a header of path and name."""
    lines = F.array_join(F.transform(F.split(content, "\n"), lambda x: F.trim(x)), "\n")
    return F.concat(path, F.when(name.isNotNull(), F.concat(F.lit(" :: "), name)).otherwise(""), F.lit("\n"), F.regexp_replace(lines, "\n{3,}", "\n\n"))


def truncated(query: Column, tokens: int, chars_per_token: float = 2.0) -> Column:
    return F.substring(query, 1, int(tokens * chars_per_token))


def skeleton(text: Column) -> Column:
    """A template with each hole as one mark; null without holes or with too many."""
    kept = F.replace(F.replace(F.replace(text, F.lit("%%"), F.lit("\u0001")), F.lit("{{"), F.lit("\u0002")), F.lit("}}"), F.lit("\u0003"))
    holes = F.regexp_replace(kept, "|".join((PRINTF_HOLE, DOLLAR_HOLE, BRACE_HOLE)), HOLE)
    back = F.replace(F.replace(F.replace(holes, F.lit("\u0001"), F.lit("%")), F.lit("\u0002"), F.lit("{")), F.lit("\u0003"), F.lit("}"))
    n = F.size(F.split(back, r"\Q" + HOLE + r"\E")) - 1
    return F.when((n > 0) & (n <= MOST_HOLES), back)


def fragments(skel: Column) -> Column:
    return F.split(skel, r"\Q" + HOLE + r"\E")


def longest_fragment(skel: Column) -> Column:
    """The longest piece between holes; of equals the first."""
    return F.aggregate(fragments(skel), F.lit(""), lambda a, x: F.when(F.char_length(x) > F.char_length(a), x).otherwise(a))


def message_shaped(literal: Column) -> Column:
    return literal.contains(" ") | (F.char_length(literal) >= 20)


# vectors


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def quantised(v: Column) -> Column:
    """Unit vector to whole numbers of -127 to 127, rounded half away from zero."""
    return F.transform(v, lambda x: F.round(F.least(F.greatest(x.cast("double"), F.lit(-1.0)), F.lit(1.0)) * 127).cast("int"))
