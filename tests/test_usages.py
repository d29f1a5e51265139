"""References resolved by tiers, edges that callers explain, and edges kept up by changes, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import edgeset, graph, incremental, usages

ENTRY = "entry_id string, from_id string, language string, kind string, name string, receiver string, arity int"
DEFINER = "name string, to_id string, language string, qualifier string, arity_min int, arity_max int, variadic boolean"


def test_tiers(spark):
    d = [("go", "a", "py", "Car", 1, 1, False), ("go", "b", "py", "FastCar", 1, 2, False), ("go", "c", "py", "Boat", 2, 2, False), ("one", "d", "py", None, None, None, None), ("go", "e", "lua", "Car", 1, 1, False)]
    d += [("hot", f"h{i}", "py", None, None, None, None) for i in range(9)]
    e = [("1", "x", "py", "calls", "go", "Car", 1), ("2", "x", "py", "calls", "go", "car", 1), ("3", "x", "py", "calls", "go", None, 2), ("4", "x", "py", "calls", "go", "", 7), ("5", "x", "py", "imports", "one", None, None), ("6", "x", "py", "calls", "hot", None, None), ("7", "d", "py", "calls", "one", None, None), ("8", "x", "py", "calls", "go", "Boat", 9)]
    got = usages.resolved(spark.createDataFrame(e, ENTRY), spark.createDataFrame(d, DEFINER)).collect()
    assert {(r.entry_id, r.to_id, r.how) for r in got} == {("1", "a", "receiver"), ("2", "a", "suffix"), ("2", "b", "suffix"), ("3", "b", "name+arity"), ("3", "c", "name+arity"), ("4", "a", "name"), ("4", "b", "name"), ("4", "c", "name"), ("5", "d", "only"), ("8", "c", "receiver")}
    refs = usages.references(spark.createDataFrame(e, ENTRY), usages.resolved(spark.createDataFrame(e, ENTRY), spark.createDataFrame(d, DEFINER)))
    assert {(r.kind, r.name, tuple(r.placed or ())) for r in refs.where("from_id = 'x'").collect()} >= {("calls", "go", ("a",)), ("calls", "go", ("a", "b")), ("calls", "go", ()), ("imports", "one", ("d",)), ("calls", "hot", ())}
    both = spark.createDataFrame([("p", "q", "imports", "only"), ("p", "q", "calls", "suffix"), ("p", "q", "calls", "receiver")], "from_id string, to_id string, kind string, how string")
    assert [tuple(r) for r in usages.typed(both).collect()] == [("p", "q", "calls", "receiver")]


def test_explained(spark):
    t = spark.createDataFrame([("K::run", "t1"), ("K::run", "t2")], "query string, to_id string")
    refs = spark.createDataFrame([("a", "calls", "run", ["t1"]), ("b", "calls", "run", None), ("c", "calls", "other", ["t1"]), ("d", "imports", "helper", None), ("m2", "calls", "run", ["zz"]), ("m3", "calls", "run", ["t2"]), ("m6", "calls", "run", None)], "from_id string, kind string, name string, placed array<string>")
    members = spark.createDataFrame([("t2", "run", "helper"), ("m4", "Q", "run")], "chunk_id string, owner string, name string")
    chunks = spark.createDataFrame([(f"m{i}", "n", "calls run here") for i in range(1, 5)] + [("m5", "Q.run", "def run"), ("m6", "n", "run"), ("m7", "n", "rerun running"), ("x", "n", "run")], "id string, name string, content string")
    edges = [("a", "t1", "calls"), ("a", "t2", "calls"), ("b", "t1", "calls"), ("c", "t1", "calls"), ("d", "t2", "imports"), ("d", "t1", "imports"), ("m1", "t1", "mentions"), ("m2", "t1", "mentions"), ("m3", "t2", "associated"), ("m3", "t1", "mentions"), ("m4", "t1", "mentions"), ("m4", "t2", "xlang"), ("m5", "t1", "mentions"), ("m6", "t1", "mentions"), ("m7", "t1", "mentions"), ("x", "t1", "other"), ("t1", "t2", "calls")]
    got = usages.explained(spark.createDataFrame(edges, "from_id string, to_id string, edge_type string"), t, refs, members, chunks)
    assert {tuple(r) for r in got.select("from_id", "to_id", "edge_type", "verified").collect()} == {("a", "t1", "calls", True), ("b", "t1", "calls", False), ("d", "t2", "imports", None), ("m1", "t1", "mentions", None), ("m3", "t2", "associated", None), ("m4", "t2", "xlang", None), ("m6", "t1", "mentions", None), ("x", "t1", "other", None)}
    one = {r.from_id: (r.edge_type, r.verified, r.n_targets) for r in usages.collapsed(got).collect()}
    assert one["a"] == ("calls", True, 1) and one["b"] == ("calls", False, 1)


def bfs(edges, start, goal, most):
    near = {}
    for a, b, _ in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    level, seen, n = {start}, {start}, 0
    while level and n <= most:
        if goal in level:
            return n
        level = {y for x in level for y in near.get(x, ())} - seen
        seen |= level
        n += 1
    return None


@pytest.mark.parametrize(("seed", "n"), [(1, 30), (2, 60)])
def test_trace_of_many_pairs(spark, seed, n):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60), r.choice(["calls", "mentions"])) for _ in range(n)]
    pairs = [(i, r.randrange(60), r.randrange(60)) for i in range(40)] + [(40, 5, 5), (41, None, 3), (42, 999, 3)]
    e = spark.createDataFrame(edges, "from_id int, to_id int, edge_type string")
    ends = spark.createDataFrame([(p, s, x) for p, a, b in pairs for s, x in ((0, a), (1, b))], "pair int, side int, id int")
    got = {x.pair: x for x in graph.trace_pairs(e, ends, 5, None).collect()}
    linked = {frozenset((a, b)) for a, b, _ in edges}
    for p, a, b in pairs:
        want = bfs(edges, a, b, 5) if a is not None else None
        assert (got[p].hops if p in got else None) == want, (p, a, b)
        if want is not None:
            path = list(got[p].path)
            assert path[0] == a and path[-1] == b and len(path) == want + 1 and all(frozenset(x) in linked for x in zip(path, path[1:]))
    # as the search from one end
    for p, a, b in pairs[:3]:
        if a != b:
            one = lambda x: spark.createDataFrame([(x,)], "id int")
            path = graph.path_to(graph.trace(e, one(a), one(b), 5, 100), one(b))
            assert (len(path) - 1 if path else None) == (got[p].hops if p in got else None)


def test_trace_between_sets_follows_the_surest_edges(spark):
    edges = [("a", "b", "mentions"), ("a", "c", "calls"), ("c", "Z", "calls"), ("b", "Z", "calls")]
    e = spark.createDataFrame(edges, "from_id string, to_id string, edge_type string")
    ends = spark.createDataFrame([(0, 0, "a"), (0, 0, "q"), (0, 1, "Z"), (0, 1, "Y")], "pair int, side int, id string")
    assert list(graph.trace_pairs(e, ends, 6, 1).first().path) == ["a", "c", "Z"]


CHUNK = "id string, path string, language string, name string, content string, calls array<struct<name:string,receiver:string,arity:int>>, imports array<string>, inherits array<string>"
MEMBER = "chunk_id string, owner string, name string, arity_min int, arity_max int, variadic boolean"
NAMES = [f"name{i}" for i in range(14)]


def random_chunk(r, i):
    name = r.choice([None, r.choice(NAMES), f"{r.choice(['Car', 'Boat'])}.{r.choice(NAMES)}"])
    calls = [(r.choice(NAMES), r.choice([None, "Car", "boat", "x"]), r.choice([None, 1, 2])) for _ in range(r.randint(0, 3))]
    return (f"c{i}", f"p{i}", r.choice(["python", "cpp"]), name, " ".join(r.choice(NAMES) for _ in range(r.randint(0, 6))), calls, [f"m.{r.choice(NAMES)}" for _ in range(r.randint(0, 1))], [])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_refreshed_edges_equal_built_ones(spark, seed):
    r = random.Random(seed)
    old = [random_chunk(r, i) for i in range(80)]
    new = [c for i, c in enumerate(old) if i not in (3, 17)] + [random_chunk(r, 100 + i) for i in range(2)]
    make = lambda rows: spark.createDataFrame(rows, CHUNK)
    members = lambda rows: spark.createDataFrame([(c[0], c[3].split(".")[0], c[3].split(".")[1], 1, 1, False) for c in rows if c[3] and "." in c[3]], MEMBER)
    parts = edgeset.build(make(old), members(old))
    got, edges, by_change = edgeset.refresh(parts, graph.keep(edgeset.edges(parts)), make(old), make(new), (members(old), members(new)), most=1.0)
    want = edgeset.build(make(new), members(new))
    flat = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert by_change
    for part in edgeset.PARTS:
        assert flat(got[part]) == flat(want[part]), part
    assert flat(edges) == flat(edgeset.edges(want))
    again, _, by_change = edgeset.refresh(parts, graph.keep(edgeset.edges(parts)), make(old), make(new), (members(old), members(new)), most=0.0)
    assert not by_change and flat(again["pairs"]) == flat(want["pairs"])


def test_surest_pairs_are_the_best_by_pmi(spark):
    import math

    r = random.Random(4)
    pairs = {(r.randrange(30), f"w{int(r.random() ** 2 * 40)}") for _ in range(400)}
    n, df = {}, {}
    for i, w in pairs:
        n[i], df[w] = n.get(i, 0) + 1, df.get(w, 0) + 1
    for share in (0.02, 0.3, 1.0, 0.0):
        want = sorted(pairs, key=lambda p: (n[p[0]] * df[p[1]], p[1], p[0]))[: int(share * len(pairs))]
        got = graph.pmi(spark.createDataFrame(list(pairs), "id int, name string"), share).collect()
        assert {(x.id, x.name) for x in got} == set(want)
        assert all(math.isclose(x.score, math.log2(len(pairs) / (n[x.id] * df[x.name]))) for x in got)
    assert graph.pmi(spark.createDataFrame([], "id int, name string").select("id", F.col("name"))).count() == 0


def test_a_refresh_meets_words_with_touched_names_before_changed_chunks(spark):
    words = spark.createDataFrame([(i, f"n{j}") for i in range(30) for j in range(i % 5, i % 5 + 4)], "id long, name string")
    index = lambda k: spark.createDataFrame([(f"n{j}", 100 + j + (k if j == 3 else 0)) for j in range(8)], "name string, id long")
    changed = spark.createDataFrame([(2,), (9,)], "id long")
    full = lambda w, x: {(r.id, t.id, r.name) for r in w.collect() for t in x.collect() if t.name == r.name}
    stored = spark.createDataFrame(sorted(full(words, index(0))), "from_id long, to_id long, name string")
    fresh = spark.createDataFrame([(2, "n7"), (9, "n3")], "id long, name string")
    now = words.where("id NOT IN (2, 9)").unionByName(fresh)
    got = incremental.mentions_refresh(stored, words, index(0), index(50), changed, fresh)
    assert sorted(got.collect()) == sorted(full(now, index(50)))
    plan = incremental.mentions_refresh(stored, words, index(0), index(50), changed, fresh).where("name = 'n3'")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" in plan
    assert sorted(incremental.mentions_refresh(stored, now, index(0), index(50), changed).collect()) == sorted(full(now, index(50)))


def test_a_refresh_reads_contents_for_names_once_and_rewrites_neither_words_nor_flags(spark, monkeypatch):
    plans, real = [], edgeset.keep

    def keep(df, name="table", *folders):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return real(df, name, *folders)

    monkeypatch.setattr(edgeset, "keep", keep)
    r = random.Random(6)
    rows = [(f"c{i}", f"p{i}", r.choice(["python", "cpp"]), " ".join(r.choice(NAMES) for _ in range(r.randint(1, 6))), [], [], []) for i in range(60)]
    chunks = spark.createDataFrame(rows, CHUNK.replace("name string, content", "content", 1)).withColumn("name", F.regexp_extract("content", r"^(\w+)", 1))
    old, new = chunks.where("id NOT IN ('c3', 'c8')"), chunks.where("id NOT IN ('c4', 'c9')")
    parts = edgeset.build(old)
    edges = graph.keep(edgeset.edges(parts))
    plans.clear()
    got, edges, by_change = edgeset.refresh(parts, edges, old, new, most=1.0)
    assert by_change and [n for n, p in plans if "regexp_extract(" in p] == ["heads", "heads"]
    assert "words" not in [n for n, _ in plans] and [n for n, _ in plans].count("pairs") == 1
    want = edgeset.build(new)
    flat = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert all(flat(got[p]) == flat(want[p]) for p in edgeset.PARTS) and flat(edges) == flat(edgeset.edges(want))


@pytest.mark.parametrize("seed", [1, 2])
def test_counts_of_pairs_go_up_and_down_with_the_change(spark, seed):
    r = random.Random(seed)
    old = {(r.randrange(20), f"w{r.randrange(15)}") for _ in range(120)}
    ids, names = [1, 4, 90, 91], ["w2", "w7", "v0"]
    new = {p for p in old if p[0] not in ids and p[1] not in names} | {(i, f"w{r.randrange(15)}") for i in (4, 90) for _ in range(6)} | {(r.randrange(24), n) for n in names[1:] for _ in range(9)}
    df = lambda rows: spark.createDataFrame(sorted(rows), "id int, name string")
    got = incremental.pairs_refresh(graph.keyed(df(old)), df(new), spark.createDataFrame([(i,) for i in ids], "id int"), spark.createDataFrame([(n,) for n in names], "name string"))
    assert sorted(got.collect()) == sorted(graph.keyed(df(new)).collect())
