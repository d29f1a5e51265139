"""Members, bases, macros and calls resolved through them."""

from lodestone.operators import classmodel, navigation

CODE = """
class Base:
    limit = 3
    def run(self, a, b=1): pass
    @staticmethod
    def make(x, *rest): pass
class Child(Base):
    def go(self): self.run(1)
"""


def test_members_and_calls(spark):
    files = spark.createDataFrame([("a.py", CODE), ("bad.py", "class :"), ("none.py", None)], "path string, content string")
    m, b = classmodel.members(files), classmodel.bases(files)
    assert {(r.owner, r.name, r.kind, r.arity_min, r.arity_max, r.variadic) for r in m.collect()} == {("Base", "limit", "field", None, None, False), ("Base", "run", "method_def", 1, 2, False), ("Base", "make", "method_def", 1, 1, True), ("Child", "go", "method_def", 0, 0, False)}
    closure = navigation.bases_closure(b.select("owner", "base"))
    calls = spark.createDataFrame([(1, "Child", "self", "run", 1), (2, "Child", "self", "go", 0), (3, "x", "Base", "make", 5), (4, "Child", "self", "run", 9), (5, "x", "thing", "go", 0), (6, "x", "thing", "nope", 0)], "call_id int, owner string, receiver string, name string, arity int")
    got = {r.call_id: (r.cls, r.outcome) for r in classmodel.resolve_calls(calls, m, closure).collect()}
    assert got == {1: ("Base", "base"), 2: ("Child", "own"), 3: ("Base", "named"), 4: ("Base", "arity"), 5: ("Child", "unique"), 6: (None, "none")}
    assert [r.owner for r in navigation.qualified_lookup(m, b.select("owner", "base"), "Child", "run").collect()] == ["Base"]


def test_macros(spark):
    text = "#define A int\n#define B A\n#define OPEN {\n#define WRAP(x) x\n#define NONE\n#define LOOP(a, b) \\\n  for (;;) { a; }\n"
    d = classmodel.macros(spark.createDataFrame([("x.h", text)], "path string, content string"))
    assert {r.name: r.line for r in d.collect()} == {"A": 1, "B": 2, "OPEN": 3, "WRAP": 4, "NONE": 5, "LOOP": 6}
    got = {r["name"]: r["class"] for r in classmodel.classified_macros(d).collect()}
    assert got == {"A": "type", "B": "type", "OPEN": "veto", "WRAP": "wrapper", "NONE": "attribute", "LOOP": "code"}
