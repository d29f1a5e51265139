"""Scalar functions against plain values."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import scalars as X


@pytest.mark.parametrize(
    ("text", "skeleton"),
    [
        ("got %s of %d", "got ␀* of ␀*"),
        ("at %03.2f%% done", "at ␀*% done"),
        ("100%% sure", None),
        ("{name} is {0}", "␀* is ␀*"),
        ("no {0:D4} left", "no ␀* left"),
        ("{}", "␀*"),
        ("a {{x}} b", None),
        ("$NAME here", "␀* here"),
        ("run ${a.b} now", "run ␀* now"),
        ("%.*s", "␀*"),
        ("%-*.3f", "␀*"),
        ("none at all", None),
        ("%d" * 9, None),
        (None, None),
    ],
)
def test_skeleton(spark, text, skeleton):
    assert spark.createDataFrame([(text,)], "t string").select(X.skeleton(F.col("t"))).first()[0] == skeleton


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


def test_paths(spark):
    assert one(spark, "a/b/c.tar.GZ", X.extension) == ".gz"
    assert one(spark, ".hidden", X.extension) == ""
    assert one(spark, "a/b/c.py", X.stem) == "c"
    assert one(spark, "x.py", X.path_family) == "(root)"
    assert one(spark, ".github/workflows/x.yml", X.dotdir) == ".github/workflows"
    assert one(spark, ".git/config", X.dotdir) is None
    assert one(spark, "a/b/c.py", X.ancestors) == ["a/b", "a", "."]
    assert one(spark, "x.py", X.ancestors) == ["."]
    assert one(spark, "pkg/sub/__init__.py", X.module_name) == "pkg.sub"
    assert [one(spark, p, lambda c: X.in_scope(c, "a/b")) for p in ("a/b", "a/b/c", "a/bc")] == [True, True, False]
    assert [one(spark, p, X.file_role) for p in ("src/a.py", "tests/a.py", "docs/a.md", "gen/a.py")] == ["impl", "test", "docs", "gen"]


def test_names(spark):
    assert one(spark, "Ns::Cls::method", X.bare_name) == "method"
    assert one(spark, "Ns::go", X.bare_name) is None
    assert one(spark, "plain", X.bare_name) is None
    assert one(spark, "Ns::Map<K, List<V>>", X.class_name) == "Map"
    assert one(spark, "Ns::Cls::m", X.qualifier) == "Cls"
    assert one(spark, "parseHTTPRequest2", X.camel_parts) == ["parse", "HTTP", "Request"]
    assert one(spark, "snake_case", X.camel_parts) == []
    assert one(spark, "Load loadTexture", X.query_words) == ["load", "loadtexture", "texture"]
    assert [one(spark, t, lambda c: X.whole_word(c, "a.b")) for t in ("x a.b y", "xa.b", "a.b_", "(a.b)")] == [True, False, False, True]


def test_ages_and_hashes(spark):
    assert [one(spark, s, X.age, "double") for s in (5.0, 65.0, 7200.0, 200000.0)] == ["5s", "1m", "2h", "2d"]
    import hashlib

    got = spark.createDataFrame([("p", 3, "c")], "p string, n int, c string").select(X.chunk_id(F.col("p"), F.col("n"), F.col("c"))).first()[0]
    assert got == hashlib.sha256(b"p:3:c").hexdigest()[:16]


def test_edges(spark):
    assert one(spark, "calls", X.provenance) == "extracted"
    assert one(spark, "something", X.provenance) == "inferred"
    assert one(spark, [1.0, 0.0], lambda v: X.cosine(v, F.array(F.lit(0.0), F.lit(0.0))), "array<double>") == 0.0
    assert one(spark, [1.0, -1.0, 0.5], X.quantised, "array<double>") == [127, -127, 64]
