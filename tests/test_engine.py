"""The engine over a small tree: index, queries, a change, and equality with an index made anew."""

import pytest

from lodestone.plans.engine import Engine
from lodestone.plans.requests import Search, augmented, commit_gold, config, fan_out, identifiers

FILES = {
    "app/loader.py": '"""Loading."""\nimport json\n\n\nclass TextureLoader:\n    def load_texture(self, path):\n        raise ValueError("cannot load texture %s from disk" % path)\n\n\ndef open_settings(path):\n    loader = TextureLoader()\n    return loader.load_texture(path)\n',
    "app/main.py": "from app.loader import TextureLoader, open_settings\n\n\ndef run_application(argv):\n    open_settings(argv[0])\n    return TextureLoader()\n",
    "app/other.py": "def unrelated_helper(x):\n    return x + 1\n",
    "docs/guide.md": "# Guide\n\nHow to load a texture with open_settings.\n\n## Usage\n\n```\n# not a heading\n```\n",
    "node_modules/x.js": "var a = 1;\n",
    "big.json": "{" + " " * 300_000 + "}",
    "notes.xyz": "unknown",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for p, t in FILES.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)
    return root


@pytest.fixture(scope="module")
def engine(spark, tree, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("tables")))
    assert e.index(str(tree), excludes=["node_modules"]) == {"insert": 4}
    return e


def test_index_and_search(engine):
    got = engine.search(Search("load texture", "fts", 5))
    assert {r.path for r in got.rows.collect()} >= {"app/loader.py"}
    assert engine.search(Search("open_settings", "hybrid", 5)).rows.count() > 0
    assert {r.path for r in engine.search(Search("open_settings", "semantic", 5, "docs")).rows.collect()} == {"docs/guide.md"}
    assert engine.search(Search("x \\+ 1", "regex", 5)).rows.first().path == "app/other.py"
    assert "did you mean" in " ".join(engine.search(Search("a", "fts", 5, "ap")).notes)
    assert engine.doctor() == []


def test_navigation(engine):
    assert engine.find_symbol("open_settings").rows.first().path == "app/loader.py"
    assert {r.path for r in engine.find_usages("open_settings").rows.collect()} >= {"app/main.py"}
    assert engine.find_outgoing("run_application").rows.count() >= 1
    assert engine.impact("open_settings").rows.first().n_edges >= 1
    path, _ = engine.trace("run_application", "TextureLoader")
    assert len(path) >= 2
    assert engine.hubs().rows.count() > 0
    assert set(engine.investigate("open_settings")) == {"definitions", "source", "usages", "outgoing", "impact"}
    hit = engine.find_by_message("cannot load texture a.png from disk").rows.collect()
    assert [(r.path, r.tier) for r in hit] == [("app/loader.py", "skeleton")]
    assert engine.research("load texture", 5).hits.count() > 0
    assert "app/loader.py" in engine.repomap(200)
    assert "## Vitals" in engine.report()


def test_usages_are_explained(engine):
    """A caller whose reference is placed at the definition is verified; all tables of an index move by one pointer."""
    rows = {(r.path, r.edge_type, r.verified) for r in engine.find_usages("open_settings").rows.collect()}
    assert ("app/main.py", "calls", True) in rows and ("app/main.py", "imports", False) in rows
    assert engine.catalog.meta()["edges"] == "built"
    assert {"postings", "terms", "references", "members", "meta"} <= set(engine.catalog.versions())


def test_change_equals_a_new_index(spark, engine, tree, tmp_path_factory):
    (tree / "app/other.py").write_text("from app.loader import open_settings\n\n\ndef unrelated_helper(x):\n    return open_settings(x)\n")
    (tree / "docs/guide.md").unlink()
    assert engine.index(str(tree), excludes=["node_modules"]) == {"update": 1, "delete": 1}
    fresh = Engine(spark, str(tmp_path_factory.mktemp("fresh")))
    fresh.index(str(tree), excludes=["node_modules"])
    for t in ("chunks", "edges", "neighbours", "indegree", "hierarchy", "folders"):
        rows = lambda e: sorted(map(str, e.catalog.read(t).select(*sorted(e.catalog.read(t).columns)).collect()))  # noqa: B023, E731
        assert rows(engine) == rows(fresh), t
    assert engine.index(str(tree), excludes=["node_modules"]) == {}
    gone = engine.catalog.vacuum(keep=1)
    assert gone and engine.catalog.vacuum(keep=1) == [] and engine.catalog.read("chunks").count() == fresh.catalog.read("chunks").count()


def test_small_changes_are_folded_in(spark, tmp_path):
    """Few changes in many files take the edges and the index from the change, and give what a new index gives."""
    root = tmp_path / "many"
    root.mkdir()
    for i in range(40):
        (root / f"m{i}.py").write_text(f"from m{(i + 1) % 40} import work{(i + 1) % 40}\n\n\ndef work{i}(x):\n    return work{(i + 1) % 40}(x) + shared_name{i % 3}(x)\n")
    a, b = Engine(spark, str(tmp_path / "a")), Engine(spark, str(tmp_path / "b"))
    a.index(str(root))
    (root / "m7.py").write_text("def work7(x, y):\n    return work20(x)\n")
    (root / "m31.py").unlink()
    assert a.index(str(root)) == {"update": 1, "delete": 1}
    assert a.catalog.meta()["edges"] == "refreshed"
    b.index(str(root))
    flat = lambda e, t, *drop: sorted(map(str, e.catalog.read(t).drop(*drop).select(*sorted(set(e.catalog.read(t).columns) - set(drop))).collect()))
    for t in ("edges", "references", "typed", "mentions", "pairs", "xlang", "words", "lengths", "terms", "members", "indegree"):
        assert flat(a, t) == flat(b, t), t
    hits = lambda e: [(r.path, round(r.score, 9)) for r in e.search(Search("work20", "fts", 9)).rows.collect()]
    assert hits(a) == hits(b) and hits(a)


def test_requests(tmp_path):
    for bad in ({"query": ""}, {"query": "a", "mode": "x"}, {"query": "a", "top_k": 0}, {"query": "(", "mode": "regex"}, {"query": "a", "chunk_kind": "x"}):
        with pytest.raises(ValueError):
            Search(**bad)
    assert identifiers("see Ns::Cls::go, MAX_SIZE and load_texture, e.g. parseJson or 3.10") == ["Ns::Cls::go", "MAX_SIZE", "load_texture", "parseJson"]
    assert augmented("fix parseJson").startswith("fix parseJson") and "Json" in augmented("fix parseJson").split()
    assert fan_out("@ui draw it", {"ui": ["a", "b"]}) == ("draw it", ["a", "b"])
    (tmp_path / "bad.json").write_text("[")
    (tmp_path / "ok.json").write_text('{"a": 1}')
    got, problems = config([str(tmp_path / n) for n in ("none.json", "bad.json", "ok.json")])
    assert got == {"a": 1} and len(problems) == 1
    log = "commit:1:Add loader\n1\t2\ta.py\n3\t0\tb.py\n1\t1\tc.png\ncommit:2:Revert x\n1\t1\ta.py\n1\t1\tb.py\ncommit:3:One\n1\t1\ta.py\n"
    assert commit_gold(log, {".py": "python"}) == [{"sha": "1", "query": "Add loader", "gold_files": ["a.py", "b.py"], "languages": ["python"]}]
    assert commit_gold(log, {".py": "python"}, several_languages=True) == []
    assert len(commit_gold(log, {".py": "python", ".png": "image"}, several_languages=True)) == 1
    assert identifiers("scene/3d/light_3d.cpp, my-dir/file-name.py at 1.2/3") == ["scene/3d/light_3d.cpp", "my-dir/file-name.py"]


def test_catalog_always_has_a_whole_pointer(spark, tmp_path):
    """A write that stops before its pointer is in place leaves the tables that held; old pointers don't pile up."""
    from lodestone.sources.files import Catalog

    c = Catalog(spark, str(tmp_path / "project"))
    assert c.versions() == {}
    for i in range(4):
        c.write(numbers=spark.range(i + 1))
        assert c.read("numbers").count() == i + 1
    (tmp_path / "project" / "next-unfinished").write_text("{")
    assert c.read("numbers").count() == 4 and len(c._pointers()) == 2


def test_scoped_keyword_search_reads_all_hits(spark):
    from lodestone.operators import message, text

    rows = [(f"{i:04d}", "a/x.py" if i % 7 else "b/y.py", "n", "common words here" + " more" * (i % 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, path string, name string, content string")
    assert text.search(df, "common", top_k=None).count() == 300
    assert text.search(df, '"words here" NOT more', top_k=None).count() == 60
    lits = spark.createDataFrame([(i, f"w{i}") for i in range(1500)] + [(5000, "é"), (5001, "a b")], "literal_id long, text string")
    msgs = spark.createDataFrame([("m1", "see w77 and w1499x"), ("m2", "é"), ("m3", "xa bx"), ("m4", "")], "id string, content string")
    got = {(r.id, r.literal_id) for r in message.occurrences(lits, msgs).collect()}
    want = {(m.id, x.literal_id) for m in msgs.collect() for x in lits.collect() if x.text in m.content}
    assert got == want


def test_small_changes_are_folded_in(spark, tmp_path):
    """Where few chunks change, neighbours and in-degrees come from the change, and equal an index made anew; scores wait."""
    from lodestone.plans import engine as module

    root = tmp_path / "tree"
    root.mkdir()
    body = lambda i, extra="": f"def function_{i}(x):\n    # {'filler words ' * 30}{i}\n    return function_{(i + 1) % 24}(x, {i}){extra}\n"
    for i in range(24):
        (root / f"m{i}.py").write_text(body(i))
    e = Engine(spark, str(tmp_path / "tables"))
    e.index(str(root))
    ranks = {(r.id, r.score) for r in e.catalog.read("pagerank").collect()}
    (root / "m3.py").write_text(body(3, " + function_9(x)"))
    rebuilt, module.vectors.knn_graph = module.vectors.knn_graph, None
    calls = []
    try:
        module.vectors.knn_graph = lambda v, k=10, rows=None, **kw: calls.append(rows is not None) or rebuilt(v, k, rows, **kw)
        assert e.index(str(root)) == {"update": 1}
    finally:
        module.vectors.knn_graph = rebuilt
    assert calls == [True]  # only rows that lost or changed a neighbour
    anew = Engine(spark, str(tmp_path / "anew"))
    anew.index(str(root))
    for name in ("neighbours", "indegree", "edges"):
        rows = lambda x, n=name: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in x.catalog.read(n).select(*sorted(x.catalog.read(n).columns)).collect())
        assert rows(e) == rows(anew), name
    assert {(r.id, r.score) for r in e.catalog.read("pagerank").collect()} < ranks and int(e.catalog.meta()["stale"]) > 0
    assert {r.name for r in e.catalog.read("symbols").collect()} == {f"function_{i}" for i in range(24)}
