"""Graph, text and change operators against plain versions."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from lodestone.operators import evalkit, filters, fusion, graph, incremental, message, navigation, report, text, vectors


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_bm25_equals_the_textbook_engine(spark):
    r = random.Random(2)
    data = [(i, r.choice(["load", "texture", "init main"]), " ".join(r.choice("load texture the a b shader load_texture".split()) for _ in range(r.randint(1, 30)))) for i in range(60)]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(name, content)")
    con.executemany("INSERT INTO t(rowid, name, content) VALUES (?,?,?)", data)
    df = spark.createDataFrame(data, "id long, name string, content string")
    for query, terms, every in (("load AND texture", ["load", "texture"], True), ("shader OR main", ["shader", "main"], False)):
        want = {i: s for i, s in con.execute("SELECT rowid, bm25(t, 5.0, 1.0) FROM t WHERE t MATCH ?", (query,))}
        got = {x.id: x.score for x in text.bm25(df, terms, every, top_k=None).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)
    for query in ('"load texture"', "sha* NOT main", "(load OR shader) AND texture"):
        want = {i for (i,) in con.execute("SELECT rowid FROM t WHERE t MATCH ?", (query,))}
        assert {x.id for x in text.search(df, query, top_k=1000).collect()} == want, query
    got, notes = text.fts(df, 'load "texture', top_k=5)
    assert notes and got.count() == 5


@pytest.mark.parametrize("bad", ["", "a AND", '"x', "(a", "a)", "OR a"])
def test_bad_queries(bad):
    with pytest.raises(ValueError):
        text.parse(bad)


def test_pagerank_equals_numpy(spark):
    import numpy as np

    r = random.Random(3)
    edges = sorted({(r.randrange(40), r.randrange(40)) for _ in range(120)})
    a = np.zeros((40, 40))
    for i, j in edges:
        a[i, j] = 1
    out = a.sum(1)
    x = np.full(40, 1 / 40)
    for _ in range(100):
        new = 0.85 * (a.T @ (x / np.maximum(out, 1)) + x[out == 0].sum() / 40) + 0.15 / 40
        done = np.abs(new - x).sum() < 40e-6
        x = new
        if done:
            break
    got = graph.pagerank(spark.createDataFrame(edges, "from_id long, to_id long"), spark.range(40))
    assert max(abs(s.score - x[s.id]) for s in got.collect()) < 1e-5


def test_merge_takes_the_surest_type(spark):
    e = spark.createDataFrame([("a", "b", "mentions"), ("a", "b", "calls"), ("a", "a", "calls"), ("b", "a", "associated"), ("b", "a", "xlang")], "from_id string, to_id string, edge_type string")
    assert rows(graph.merge(e)) == [("a", "b", "calls"), ("b", "a", "xlang")]


def test_name_caps_are_all_or_nothing(spark):
    names = spark.createDataFrame([(f"N{i}::reset", f"r{i}") for i in range(9)] + [("A::start", "a"), ("B::start", "b"), ("go", "c")], "name string, id string")
    got = rows(graph.name_index(names))
    assert ("start", "a") in got and ("start", "b") in got
    assert not any(n == "reset" for n, _ in got) and not any(n == "go" for n, _ in got)


def test_discriminate(spark):
    c = spark.createDataFrame([(1, "x", True, True, False), (1, "y", False, True, True), (2, "x", False, True, True), (2, "y", False, True, False), (3, "x", False, False, False)], "call_id int, id string, exact boolean, suffix boolean, arity boolean")
    assert rows(graph.discriminate(c).select("call_id", "id")) == [(1, "x"), (2, "x"), (3, "x")]


def test_trace_finds_a_shortest_path(spark):
    e = spark.createDataFrame([("a", "b", "calls"), ("c", "b", "calls"), ("c", "d", "calls"), ("a", "x", "mentions"), ("x", "y", "mentions"), ("y", "z", "calls"), ("z", "d", "calls")], "from_id string, to_id string, edge_type string")
    one = lambda i: spark.createDataFrame([(i,)], "id string")
    assert graph.path_to(graph.trace(e, one("a"), one("d")), one("d")) == ["a", "b", "c", "d"]
    assert graph.path_to(graph.trace(e, one("a"), one("nowhere")), one("nowhere")) == []


def test_rrf_starved(spark):
    s = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "id long, rank int")
    k = spark.createDataFrame([(9, 1)], "id long, rank int")
    o = spark.createDataFrame([(2, 1), (7, 2), (9, 3)], "id long, rank int")
    got = {r.id: r.score for r in fusion.rrf(s, k, o, 10).collect()}
    assert set(got) == {1, 2, 3, 9} and abs(got[2] - (1 / 62 + 1 / 62)) < 1e-12


@pytest.mark.parametrize("seed", [1, 2])
def test_knn_incremental_equals_full(spark, seed):
    import numpy as np

    r = np.random.default_rng(seed)
    v = r.integers(-1, 2, (80, 6)).astype(float)  # many ties
    v[:, 0] += 0.5
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    old = {i: v[i].tolist() for i in range(60)}
    new = {i: x for i, x in old.items() if i % 7} | {i: v[i].tolist() for i in range(55, 80)}
    frame = lambda d: spark.createDataFrame(sorted(d.items()), "id long, embedding array<double>")
    changed = spark.createDataFrame([(i,) for i in new if old.get(i) != new[i]], "id long")
    gone = spark.createDataFrame([(i,) for i in old if i not in new], "id long")
    before = vectors.knn_graph(frame(old), 5, block_rows=25)
    got = vectors.knn_incremental(before, frame(new), changed, gone, 5)
    assert rows(got) == rows(vectors.knn_graph(frame(new), 5))


def test_interval_union_and_sampling(spark):
    s = spark.createDataFrame([("a", 0, 10), ("a", 5, 12), ("a", 20, 21), ("a", 1, 2), ("b", 3, 3)], "key string, start int, end int")
    assert rows(evalkit.interval_union(s).select("key", "covered")) == [("a", 13), ("b", 0)]


def test_stitch_marks_gaps(spark):
    p = spark.createDataFrame([("p", "n", 1, 2, "one"), ("p", "n", 3, 4, "two"), ("p", "n", 9, 9, "three")], "path string, name string, start_line int, end_line int, content string")
    assert navigation.stitch(p).first().source == "one\ntwo\n…\nthree"


def test_messages(spark):
    lits = spark.createDataFrame([("c1", "cannot open %s: %d", 5), ("c1", "cannot open", 6), ("c2", "done", 1), ("c2", "file {name} missing on {host}", 2)], "chunk_id string, text string, line int")
    chunks = spark.createDataFrame([("c1", "a.py", 1, 9), ("c2", "b.py", 1, 9)], "id string, path string, start_line int, end_line int")
    got, _ = message.find_by_message(lits, chunks, "cannot open /tmp/x: 13")
    assert [(r.text, r.tier) for r in got.collect()] == [("cannot open", "exact"), ("cannot open %s: %d", "skeleton")]
    got, notes = message.find_by_message(lits, chunks, "file a missing on b" + " " * 700)
    assert got.count() == 0 and notes


def test_budget_keeps_one(spark):
    lines = spark.createDataFrame([(1, "x" * 100), (2, "y")], "rank int, text string")
    assert [r.rank for r in report.budgeted(lines, 5).collect()] == [1]
    lines = spark.createDataFrame([(1, "x" * 8), (2, "y" * 8), (3, "z" * 8)], "rank int, text string")
    assert [r.rank for r in report.budgeted(lines, 4).orderBy("rank").collect()] == [1, 2]


def test_upsert_and_cascade(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "path string, n int")
    new = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1)], "path string, n int, seq int")
    assert rows(incremental.upsert(t, new, ["path"], [F.desc("seq")])) == [("a", 1), ("b", 4), ("c", 5)]
    tables = {"chunks": spark.createDataFrame([("1", "a"), ("2", "b")], "id string, path string"), "vectors": spark.createDataFrame([("1",), ("2",)], "id string")}
    left, gone = incremental.delete_cascade(tables, spark.createDataFrame([("a",)], "path string"))
    assert rows(left["vectors"]) == [("2",)] and rows(gone) == [("1",)]
    assert incremental.stale_after(15, 10, 100) == (0, True) and incremental.stale_after(5, 10, 100) == (15, False)


def test_kinds_and_caps(spark):
    df = spark.createDataFrame([(1, "en", "p"), (2, None, "p"), (3, "fr", "p")], "id int, language string, path string")
    assert [r.id for r in filters.kind(df, "docs", ("en",)).orderBy("id").collect()] == [2, 3]
    assert filters.cap(df, "path", 2, F.col("id")).count() == 2


def test_nearest_of_many_queries(spark):
    """As one query at a time, with ties, a filter, several blocks, and fewer rows than asked for."""
    import random

    r = random.Random(6)
    rows = [(i, [float(r.randint(-2, 2)) for _ in range(4)], i % 3) for i in range(60)] + [(60, [0.0] * 4, 0), (61, [1.0, 0.0, 0.0, 0.0], 1), (62, [2.0, 0.0, 0.0, 0.0], 1)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>, family int").repartition(3)
    queries = v.where("id % 10 = 1").select(F.col("id").alias("query_id"), "embedding")
    for where, k in ((None, 5), (F.col("family") == 1, 30)):
        got = {}
        for x in vectors.knn_many(v, queries, k, where, block=2).collect():
            got.setdefault(x.query_id, []).append((x.rank, x.id, round(x.score, 9)))
        for q in queries.collect():
            cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / ((sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5 or 1)
            want = sorted((-round(cosine(q.embedding, e), 9), i) for i, e, f in rows if where is None or f == 1)[:k]
            assert sorted(got[q.query_id]) == [(n, i, -s) for n, (s, i) in enumerate(want, 1)]


def test_names_in_texts(spark):
    from lodestone.operators import research

    t = spark.createDataFrame([(1, "see ns::Tex::load and parserRunner, TexLoader or Manager; Alpha"), (2, "TexLoader httpHandler X")], "rank int, content string")
    assert research.symbols_in(t) == ["Tex::load", "parserRunner", "TexLoader", "httpHandler"]
    c = spark.createDataFrame([(i, f"x TexLoader{'s' if i % 2 else ''} y_") for i in range(30)], "id int, content string")
    assert {(r.id, r.name) for r in research.holders(c, ["TexLoader", "none"], 3).collect()} == {(0, "TexLoader"), (2, "TexLoader"), (4, "TexLoader")}
