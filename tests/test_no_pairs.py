"""Operators that once joined all pairs of a name or a symbol, against plain versions, and the rows that they make."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import scratch
from lodestone.operators import evalkit, graph, postings, report


def largest_join(df):
    """Most rows that a join of the plan makes."""
    df.collect()
    plan, most = df._jdf.queryExecution().executedPlan(), 0
    todo = [plan]
    while todo:
        p = todo.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        if p.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(p.plan())
        if "Join" in p.nodeName() and p.metrics().contains("numOutputRows"):
            most = max(most, p.metrics().apply("numOutputRows").value())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return most


@pytest.mark.parametrize("seed", range(4))
def test_definition_of_equals_all_pairs(spark, seed):
    r = random.Random(seed)
    pick = lambda *x: r.choice(x)
    line = lambda: r.choice([None, *range(12)])
    refs = [(i, pick("a", "b", "c", "d", None), pick("x", "y", "z", None), line()) for i in range(120)]
    refs += [(i, pick("a", "b"), pick("x", "z"), line()) for i in range(5)]  # a reference of several rows
    defs = [(pick("a", "b"), pick("x", "y", None), line(), i) for i in range(25)] + [("c", None, line(), 90 + i) for i in range(3)] + [(None, "x", 1, 99), ("d", "y", None, 98)]
    want = {}
    for i, s, p, n in refs:
        for s2, p2, n2, d in defs:
            if s is not None and s == s2:
                tier = 2 if p is None or p2 is None else int(p != p2)
                away = (1, 0) if n is None or n2 is None else (0, abs(n - n2))
                want[i] = min(want.get(i, (9,)), (tier, away, d))
    got = evalkit.definition_of(spark.createDataFrame(refs, "ref_id long, symbol string, path string, line int"), spark.createDataFrame(defs, "symbol string, path string, line int, def_id long"))
    assert sorted(got.collect()) == sorted((i, b[-1]) for i, b in want.items())


def test_definition_of_makes_no_pairs(spark):
    refs = spark.range(600).selectExpr("id AS ref_id", "'s' AS symbol", "'x' AS path", "int(id % 50) AS line")
    defs = spark.range(400).selectExpr("'s' AS symbol", "'y' AS path", "int(id) AS line", "id AS def_id")
    assert largest_join(evalkit.definition_of(refs, defs)) <= 600


@pytest.mark.parametrize("seed", range(4))
def test_gold_resolution_equals_all_pairs(spark, seed):
    r = random.Random(seed)
    row = lambda i: (i, r.choice(["x", "y", None]), r.choice(["f", "g", "h", None]), r.choice(["t", "u", None]), r.choice(["1", "2", "3", None]))
    gold = [row(i) for i in range(60)] + [row(i) for i in range(4)]  # a key of several rows
    chunks = [row(i) for i in range(r.choice([8, 40]))] + [(None, "x", "f", "t", "1")]
    want = {}
    for key in {g[0] for g in gold}:
        left = [(g, c) for g in gold for c in chunks if g[0] == key and c[0] is not None and None not in g[1:3] and g[1:3] == c[1:3]]
        for k in (3, 4):
            ok = [(g, c) for g, c in left if g[k] == c[k]]
            left = ok if len(left) > 1 and ok else left
        want[key] = (len(left), left[0][1][0] if len(left) == 1 else None)
    kinds = "path string, name string, chunk_type string, content_hash string"
    got = evalkit.resolve_gold(spark.createDataFrame(gold, f"key_id long, {kinds}"), spark.createDataFrame(chunks, f"id long, {kinds}"))
    assert sorted(got.collect()) == sorted((k, *v) for k, v in want.items())


def test_gold_resolution_makes_no_pairs(spark):
    row = lambda k: spark.range(300).selectExpr(f"id AS {k}", "'x' AS path", "'f' AS name", "'t' AS chunk_type", "string(id) AS content_hash")
    assert largest_join(evalkit.resolve_gold(row("key_id"), row("id"))) <= 300


def test_gold_resolution_sends_no_counts_through_the_driver(spark):
    row = lambda k: spark.range(300).selectExpr(f"id AS {k}", "string(id % 2) AS path", "string(id % 3) AS name", "string(id % 5) AS chunk_type", "string(id) AS content_hash")
    got = evalkit.resolve_gold(row("key_id"), row("id"))
    assert {(r.key_id, r.n, r.id) for r in got.collect()} == {(i, 1, i) for i in range(300)}
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_symbols_of_a_file_without_kind_come_first(spark):
    symbols = spark.createDataFrame([("f", "zeta", "definition", 3, "a"), ("f", "zeta", None, 3, "b")], "path string, name string, kind string, start_line int, chunk_id string")
    scores = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "id string, score double")
    assert report.symbol_map(symbols, scores).first().block == "f\n  zeta  (line 3)\n  definition zeta  (line 3)"


def test_an_index_moves_the_texts_once_and_an_update_the_postings_once(spark, monkeypatch):
    plans, real = {}, postings.keep

    def keep(df, name="table", *folders):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, name, *folders)

    monkeypatch.setattr(postings, "keep", keep)
    monkeypatch.setattr(postings, "BLOCKS_OF_A_TASK", 1, raising=False)
    rows = spark.createDataFrame([(i, "name", f"w{i % 7} w{i % 5} alpha") for i in range(40)], "id long, name string, content string")
    index = postings.build(rows, block_size=8)
    assert plans["index-postings"].count("Exchange hashpartitioning") == 1 and "Exchange rangepartitioning" not in plans["index-postings"]
    assert "Aggregate" not in plans["index-postings"]
    postings.update(index, rows.where("id % 3 = 0").select("id"), rows.where("id % 3 = 1"))
    moved = [x for x in plans["index-postings"].split("\n") if "Exchange hashpartitioning(block" in x]
    assert len(moved) == 2 and "Exchange rangepartitioning" not in plans["index-postings"]  # the postings, and what changes them


def test_blocks_of_long_documents_have_fewer(spark, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK_TOKENS", 50, raising=False)
    rows = spark.createDataFrame([(i, None, "alpha " * 20) for i in range(20)], "id long, name string, content string")
    index = postings.build(rows)
    assert index.sums["blocks"] == 8 and index.postings.selectExpr("sum(df)").first()[0] == 20


def test_recall_of_a_class_makes_no_pairs(spark):
    members = spark.createDataFrame([(i, None if i % 17 == 0 else i % 3 if i < 290 else i) for i in range(300)], "id long, family long")
    queries = members.where("id % 5 = 0").withColumnRenamed("id", "query_id")
    returned = queries.selectExpr("query_id", "explode(array(query_id, query_id + 1, query_id + 3, query_id + 6)) AS id").selectExpr("*", "int(id) AS rank")
    hits, sizes = evalkit.class_gold(returned, queries, members)
    got = evalkit.set_recall(returned, hits, sizes=sizes)
    assert largest_join(got) <= 240
    pairs = queries.join(members, "family").where("query_id <> id").select("query_id", "id")
    assert sorted(got.collect()) == sorted(evalkit.set_recall(returned, pairs).collect())


@pytest.mark.parametrize("most", [200_000, 0])
def test_phrases_move_the_words_postings_once_as_they_lie(spark, monkeypatch, most):
    monkeypatch.setattr(scratch, "BROADCAST_ROWS", most, raising=False)
    r = random.Random(5)
    texts = {f"d{i}": [r.choice("abcdef") for _ in range(r.randrange(30))] for i in range(60)}
    index = postings.build(spark.createDataFrame([(k, "a b", " ".join(t)) for k, t in texts.items()], "id string, name string, content string"), block_size=9)
    names = [("a",), ("a a",), ("a b a b",), ("f e d",), ("b zzz",), (None,), ("a",)]
    got = postings.phrases(index, spark.createDataFrame(names, "name string"))
    want = sorted((n, k) for n in {n for (n,) in names if n} for k, t in texts.items() if f" {n} " in f" {' '.join(t)} ")
    assert sorted(got.collect()) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "df_content" in plan  # no document's places are dealt out one by one


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_own_names_are_dropped_after_words_meet_definers(spark, monkeypatch, most):
    monkeypatch.setattr(scratch, "BROADCAST_ROWS", most, raising=False)
    chunks = spark.createDataFrame([(i, f"name{i}" if i % 3 else None, " ".join(f"name{j} w{j}" for j in range(i % 7, i % 7 + 9))) for i in range(40)], "id long, name string, content string")
    own = chunks.where("name IS NOT NULL").select("id", "name")
    got = graph.mentions(chunks, graph.name_index(own), own)
    names = {r.id: r.name for r in own.collect()}
    want = sorted((r.id, i, n) for r in chunks.collect() for i, n in names.items() if n in r.content.split() and i != r.id and names.get(r.id) != n)
    assert sorted(got.collect()) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and plan.index("LeftOuter") < plan.index("Inner")  # words are not moved by their chunk
    assert sorted(graph.mentions(chunks, graph.name_index(own), F.array("name")).collect()) == want
    pairs = got.select(F.col("from_id").alias("id"), "name")
    keyed = graph.keyed(pairs.localCheckpoint())
    keyed.collect()
    assert keyed._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("ReusedExchange") >= 2  # pairs are moved once


def kept_names(monkeypatch):
    names, real = [], graph.keep

    def keep(df, name="table", *folders):
        names.append(name)
        return real(df, name, *folders)

    monkeypatch.setattr(graph, "keep", keep)
    return names


def test_pagerank_keeps_each_step(spark, monkeypatch):
    names = kept_names(monkeypatch)
    edges = [("hub", f"n{i}") for i in range(1500)] + [(f"n{i}", "hub") for i in range(0, 1500, 2)]
    ids = ["hub", *[f"n{i}" for i in range(1500)]]
    got = {r.id: r.score for r in graph.pagerank(spark.createDataFrame(edges, "from_id string, to_id string"), spark.createDataFrame([(i,) for i in ids], "id string"), iterations=3).collect()}
    x, out = dict.fromkeys(ids, 1 / len(ids)), {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    for _ in range(3):
        lost, new = sum(s for i, s in x.items() if i not in out), dict.fromkeys(ids, 0.0)
        for a, to in out.items():
            for b in to:
                new[b] += x[a] / len(to)
        x = {i: 0.85 * (s + lost / len(ids)) + 0.15 / len(ids) for i, s in new.items()}
    assert got == pytest.approx(x) and names.count("scores") == 4


def test_a_trace_makes_its_edges_once(spark, monkeypatch):
    names = kept_names(monkeypatch)
    edges = spark.createDataFrame([(i, i + 1, "calls") for i in range(6)], "from_id int, to_id int, edge_type string")
    ends = spark.createDataFrame([(0, 0, 0), (0, 1, 3)], "pair int, side int, id int")
    assert [(r.pair, r.hops, r.path) for r in graph.trace_pairs(edges, ends, 4, None).collect()] == [(0, 3, [0, 1, 2, 3])]
    assert names.count("both") == 1
