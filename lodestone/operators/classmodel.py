"""The class model: members, bases and macro definitions of files, and calls resolved through them."""

from __future__ import annotations

import ast
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MEMBERS = "path string, owner string, name string, kind string, arity_min int, arity_max int, variadic boolean, line int"
BASES = "path string, owner string, base string, line int"
MACROS = "path string, name string, params array<string>, body string, line int"
DEEPEST_CHAIN = 4


def _python_members(path: str, text: str):
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    for node in ast.walk(tree):
        if not isinstance(node, ast.ClassDef):
            continue
        for b in node.bases:
            name = ast.unparse(b)
            yield "base", (path, node.name, name, node.lineno)
        for n in node.body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                a = n.args
                static = any(isinstance(d, ast.Name) and d.id == "staticmethod" for d in n.decorator_list)
                most = len(a.posonlyargs) + len(a.args) - (0 if static else 1)
                least = max(most - len(a.defaults), 0)
                yield "member", (path, node.name, n.name, "method_def", least, most, a.vararg is not None, n.lineno)
            elif isinstance(n, (ast.Assign, ast.AnnAssign)):
                for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                    if isinstance(t, ast.Name):
                        yield "member", (path, node.name, t.id, "field", None, None, False, n.lineno)


def _extracted(files: DataFrame, extract, schema: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [r for p, t in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True) for r in extract(p, t or "")]
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    return files.select("path", "content").mapInArrow(run, schema)


def members(files: DataFrame) -> DataFrame:
    """Methods with their arity and fields of classes in Python files (path, content)."""
    return _extracted(files, lambda p, t: [r for k, r in _python_members(p, t) if k == "member"], MEMBERS)


def bases(files: DataFrame) -> DataFrame:
    return _extracted(files, lambda p, t: [r for k, r in _python_members(p, t) if k == "base"], BASES)


def macros(files: DataFrame) -> DataFrame:
    """#define lines, with continuations, of files in the C family."""

    def extract(path, text):
        for m in re.finditer(r"^[ \t]*#[ \t]*define[ \t]+(\w+)(\(([^)]*)\))?[ \t]*((?:.*\\\n)*.*)$", text, re.M):
            params = [p.strip() for p in m[3].split(",")] if m[2] else None
            yield path, m[1], params, m[4].replace("\\\n", " ").strip(), text.count("\n", 0, m.start()) + 1

    return _extracted(files, extract, MACROS)


def classified_macros(defs: DataFrame) -> DataFrame:
    """name and class of each macro: an alias of another takes its class (four deep at most); of several definitions the most cautious counts.

    veto (unbalanced brackets), code (braces or statements), type (one name or keyword), wrapper (of its argument), attribute (no body).
    """
    body = F.col("body")
    balance = lambda a, b: F.char_length(F.regexp_replace(body, f"[^{a}]", "")) != F.char_length(F.regexp_replace(body, f"[^{b}]", ""))
    kind = F.when(balance(r"\(", r"\)") | balance("{", "}"), 0).when(body.rlike("[{};]"), 1).when(body == "", 4).when(F.col("params").isNotNull() & body.rlike(r"^\w*\(?\w+\)?$"), 3).when(body.rlike(r"^[\w:<>*& ]+$"), 2).otherwise(1)
    d = defs.select("name", kind.alias("rank"), F.when(body.rlike(r"^\w+$"), body).alias("alias"))
    for _ in range(DEEPEST_CHAIN):
        known = d.groupBy(F.col("name").alias("alias")).agg(F.min("rank").alias("other"))
        d = d.join(known, "alias", "left").select("name", F.least("rank", F.coalesce("other", "rank")).alias("rank"), "alias")
    names = F.array(*[F.lit(x) for x in ("veto", "code", "type", "wrapper", "attribute")])
    return d.groupBy("name").agg(F.get(names, F.min("rank")).alias("class"))


def frequent_macros(healed: DataFrame, least: int = 2) -> DataFrame:
    """Macros that were healed in so many files."""
    return healed.groupBy("name").agg(F.countDistinct("path").alias("n_files")).where(F.col("n_files") >= least)


def resolve_calls(calls: DataFrame, members_: DataFrame, closure: DataFrame) -> DataFrame:
    """Each call (call_id, owner, receiver, name, arity) with the class that defines its target and how it was found.

    self and super look in the caller's class and its bases, nearest first (closure: owner, base, depth); a receiver that
    names a class looks there; any other by name alone. Outcomes: own, base, named, unique, ambiguous, arity, none.
    """
    own = calls.where("receiver IN ('self', 'this')").select("call_id", "name", "arity", F.col("owner").alias("cls"), F.lit(0).alias("depth"), F.lit("own").alias("how"))
    up = calls.where("receiver IN ('self', 'this', 'super')").join(closure, "owner").select("call_id", "name", "arity", F.col("base").alias("cls"), "depth", F.lit("base").alias("how"))
    owners = members_.select(F.col("owner").alias("receiver")).distinct()
    named = calls.join(owners, "receiver").select("call_id", "name", "arity", F.col("receiver").alias("cls"), F.lit(0).alias("depth"), F.lit("named").alias("how"))
    m = members_.where("kind <> 'field'").select(F.col("owner").alias("cls"), "name", "arity_min", "arity_max", "variadic")
    hit = own.unionByName(up).unionByName(named).join(m, ["cls", "name"])
    fits = F.col("arity").isNull() | ((F.col("arity") >= F.col("arity_min")) & (F.col("variadic") | (F.col("arity") <= F.col("arity_max"))))
    hit = hit.withColumn("fits", fits)
    nearest = Window.partitionBy("call_id").orderBy(F.desc("fits"), "depth", "cls")
    hit = hit.withColumn("place", F.row_number().over(nearest)).where("place = 1").select("call_id", "cls", F.when(F.col("fits"), F.col("how")).otherwise("arity").alias("outcome"))
    rest = calls.join(hit, "call_id", "left_anti").select("call_id", "name")
    n = m.select("name", "cls").distinct().groupBy("name").agg(F.count("*").alias("n"), F.min("cls").alias("one"))
    loose = rest.join(n, "name", "left").select("call_id", F.when(F.col("n") == 1, F.col("one")).alias("cls"), F.when(F.col("n") == 1, "unique").when(F.col("n") > 1, "ambiguous").otherwise("none").alias("outcome"))
    return hit.unionByName(loose)


def within(members_: DataFrame, spans: DataFrame) -> DataFrame:
    """Members (path, line) that stand within a span (path, start_line, end_line) of their file."""
    s = spans.select(F.col("path").alias("in_path"), "start_line", "end_line")
    return members_.join(s, (F.col("path") == F.col("in_path")) & F.col("line").between(F.col("start_line"), F.col("end_line")), "left_semi")


def owners(members_: DataFrame, spans: DataFrame, bases_: DataFrame) -> DataFrame:
    """Distinct owner of members within class spans, and of base clauses."""
    return within(members_, spans).select("owner").union(bases_.select("owner")).distinct()


def to_classes(edges: DataFrame, classes: DataFrame, kinds: tuple[str, ...] = ("inherits", "constructs")) -> DataFrame:
    """Edges without those of the kinds that end outside the class symbols (id)."""
    held = classes.select(F.col("id").alias("to_id")).distinct()
    typed = F.col("edge_type").isin(*kinds)
    return edges.where(~typed | F.col("edge_type").isNull()).unionByName(edges.where(typed).join(held, "to_id", "left_semi").select(*edges.columns))
