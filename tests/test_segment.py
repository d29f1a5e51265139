"""Segments: spans cover the file in order, sizes hold, and files come back from them."""

import random

import pytest

from lodestone.operators import segment as s
from lodestone.sources import files


def test_tiles_cover_all_lines():
    r = random.Random(1)
    text = "".join("x" * r.randint(0, 300) + "\n" for _ in range(500))
    parts = list(s.tile(text))
    assert [p.start_line for p in parts] == [1, *(p.end_line + 1 for p in parts[:-1])]
    assert parts[-1].end_line == 500


def test_markdown_sections():
    got = [(p.name, p.start_line, p.end_line) for p in s.markdown("intro\n# One ##\ntext\n```\n# no\n~~~\n```\n##\nx\n####### seven\n### Three\n")]
    assert got == [(None, 1, 1), ("One", 2, 7), (None, 8, 10), ("Three", 11, 11)]


def test_python_segments():
    text = "import a.b\nfrom c import d\n\nX = 'a long literal'\n\n\n@deco\ndef f(x, *, y=1):\n    return g(x, 2) + a.b.h(*x)\n\n\nclass C(Base, m.Other):\n    def go(self):\n        self.f(1, 2, 3)\n"
    parts = {p.name: p for p in s.python(text)}
    assert (parts["f"].start_line, parts["f"].end_line) == (7, 9)
    assert set(parts["f"].calls) == {("g", "", 2), ("h", "a.b", None)}
    assert parts["C"].inherits == ["Base", "m.Other"] and ("f", "self", 3) in parts["C"].calls
    assert parts["<module>"].imports == ["a.b", "c.d"] and parts["<module>"].literals == [("a long literal", 4)]
    language, fallback = s.segment("def broken(:\n", "x.py")
    assert language == "python" and [p.chunk_type for p in fallback] == ["text"]


def test_ceiling_and_merge():
    text = "".join(chr(0xC0 + i % 301) for i in range(9000))
    for p in s.segment(text, "a.txt")[1]:
        assert len(p.content.encode()) <= s.MOST_BYTES
    assert "".join(p.content for p in s.segment(text, "a.txt")[1]) == text
    _, parts = s.segment("# A\nx\n# B\ny\n", "a.md")
    assert [(p.name, p.start_line, p.end_line) for p in parts] == [("A", 1, 4)]
    with pytest.raises(ValueError):
        s.register(".py", "python", s.python)


def test_signatures():
    assert s.signatures("def f(self, a, b=1, *rest):", "f") == [(1, None)]
    assert s.signatures("void f(int a, std::map<int, int> b = {1, 2});", "f") == [(1, 2)]
    assert s.accepts(3, [(1, 2)]) is False and s.accepts(None, [(1, 2)]) and s.accepts(2, [])


def test_files_come_back(spark):
    text = "\n".join(f"line {i} " + "x" * (i % 90) for i in range(400))
    chunks = s.segment_files(spark.createDataFrame([("a.txt", text)], "path string, content string"))
    assert files.rebuilt(chunks).first().content == text


@pytest.mark.parametrize(("path", "ok"), [("a/b.py", True), ("node_modules/x.py", False), ("a/node_modules/x.py", True), ("vendor/x.py", False), ("vendor/keep/x.py", True), ("build1/a", False)])
def test_globs(spark, path, ok):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(path,)], "path string")
    assert df.select(files.allowed(F.col("path"), ["vendor/keep"], ["node_modules", "vendor", "build?"])).first()[0] == ok


CPP = """#include <vector>
#include "a/b.h"

class Fwd;

// Loads things.
// In two lines.
namespace gfx {
/* A texture. */
template <typename T>
class Texture : public Base<T>, private other::Thing {
public:
    Texture(int w, int h) : w_(w) { init(w, h); }
    ~Texture();
    void load(const char* path) { auto x = open(path, "rb" "mode"); x->read(1, {2, 3}); log("could not load %s" + name); }
};
int Texture<int>::size(int a) const { return std::max(a, 3); }
static const int table[] = {1, 2, 3};
}  // namespace gfx
int main() { if (x) { run(); } return 0; }
"""
TS = """import { a } from "./mod";
const b = require('other');

/** Adds. */
export async function add(x: number, ...rest: number[]): Promise<void> {
  await foo.bar?.baz(x, ...rest);
}
export const sub = (x, y) => {
  return add(x);
};
class A extends B implements C, D {
  constructor(x) { super(x); this.go(`long template`, 2); }
  private go(s: string, n = {a: 1}) { if (n) { call(); } }
}
const table = { one: 1, two: { three: 3 } };
"""


def test_braces_cpp():
    parts = {p.name: p for p in s.braced(CPP, "x.cpp")}
    t = parts["Texture"]
    assert (t.start_line, t.end_line, t.inherits) == (9, 16, ["Base", "other::Thing"])
    assert {("init", "", 2), ("open", "", 2), ("read", "x", 2), ("log", "", 1)} <= set(t.calls)
    assert t.literals == [("rbmode", 15), ("could not load %s", 15)]
    assert parts["Texture::size"].calls == [("max", "std", 2)] and parts["main"].calls == [("run", "", 0)]
    first = next(iter(s.braced(CPP, "x.cpp")))
    assert first.name == "<module>" and first.imports == ["vector", "a/b.h"]
    assert s.symbols(CPP, "x.cpp") == [("Texture", "class", 10, 16), ("Texture::Texture", "function", 13, 13), ("Texture::load", "function", 15, 15), ("Texture::size", "function", 17, 17), ("main", "function", 20, 20), ("Fwd", "forward_declaration", 4, 4)]


def test_braces_scripts_and_csharp():
    parts = {p.name: p for p in s.braced(TS, "x.ts")}
    assert (parts["add"].start_line, parts["add"].end_line, parts["add"].calls) == (4, 7, [("baz", "foo.bar", None)])
    assert parts["A"].inherits == ["B", "C", "D"] and parts["A"].literals == [("long template", 12)]
    assert ("go", "this", 2) in parts["A"].calls and ("call", "", 0) in parts["A"].calls
    assert [x[:2] for x in s.symbols(TS, "x.ts")] == [("add", "function"), ("sub", "function"), ("A", "class"), ("A.constructor", "function"), ("A.go", "function")]
    cs = 'using System.Text;\nnamespace N {\n  public class P : Q, IR<T> where T : new() {\n    public int X { get; set; }\n    public override void Run(string s) { Console.WriteLine(@"a ""b"" c:\\dir", s); }\n  }\n}\n'
    p = next(x for x in s.braced(cs, "x.cs") if x.name == "P")
    assert p.inherits == ["Q", "IR"] and ("WriteLine", "Console", 2) in p.calls and p.literals == [('a "b" c:\\dir', 5)]
    assert s.symbols("class A:\n    def f(self):\n        def g(): pass\n", "x.py") == [("A", "class", 1, 3), ("A.f", "function", 2, 3), ("A.f.g", "function", 3, 3)]


def test_braces_cover_the_file_and_refuse_what_is_broken():
    r = random.Random(7)
    for n in range(60):
        code = "".join(r.choice([CPP, TS.replace("`", '"'), "struct S" + str(n) + " { int a; };\n", "// c\n", "\n", "int f() {\n" + "  g(1);\n" * r.randint(0, 900) + "}\n", "enum E { A, B };\n"]) for _ in range(4))
        parts = list(s.braced(code, "x.cpp"))
        lines = code.splitlines(keepends=True)
        covered = set()
        for p in parts:
            covered |= set(range(p.start_line, p.end_line + 1))
        assert all(i + 1 in covered or not x.strip() for i, x in enumerate(lines))
    assert [p.chunk_type for p in s.segment("int f() { {", "x.c")[1]] == ["text"]
    assert [p.chunk_type for p in s.segment("} int f();", "x.c")[1]] == ["text"]
    assert s.segment("", "x.js") == ("javascript", [])
    big = "class Big {\n" + "".join(f"  void m{i}() {{ call{i}(); }}\n" for i in range(400)) + "};\n"
    got = s.segment(big, "x.hpp")[1]
    assert all(len(p.content.encode()) <= s.MOST_BYTES for p in got) and got[0].name == "Big" and any((p.name or "").startswith("Big::m") for p in got)


def test_calls_have_eight_variants_of_a_name_at_most():
    text = "int f() { " + " ".join(f"g({', '.join('x' * (i + 1))});" for i in range(20)) + " }"
    assert len(next(iter(s.braced(text, "x.c"))).calls) == s.MOST_VARIANTS


@pytest.mark.parametrize("read", [s.segment_files, s.symbol_table])
def test_files_of_one_part_are_dealt_out(spark, read):
    files = spark.range(0, 40, 1, 1).selectExpr("concat('f', id, '.cpp') AS path", "concat('void go', id, '() { }') AS content")
    got = read(files)
    assert got.rdd.getNumPartitions() > 1 and got.where("name IS NOT NULL").count() == 40
