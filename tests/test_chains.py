"""Receiver chains against a plain interpreter of the same rules, on written cases and on random class models."""

import random
import re
import zlib

import pytest

from lodestone.operators import chains

CLASSES = "name string"
MEMBERS = "owner string, name string, kind string, type_text string, arity_min int, arity_max int, variadic boolean, chunk_id string"
BASES = "owner string, base string"
CALLS = "call_id int, cls string, access string, via string, head string, steps array<string>, name string, arity int"


class Plain:
    """One call at a time, with dictionaries."""

    def __init__(self, classes, members, bases):
        self.known, self.members, self.raw = set(classes), list(dict.fromkeys(members)), bases
        self.up = {c: [] for c in classes}
        self.lost = set()
        for owner, base in dict.fromkeys(bases):
            found = self.meaning(self.type(base), self.scopes(owner)[1:])
            if not found:
                self.lost.add(owner)
            self.up.setdefault(owner, []).extend(b for b in found if b != owner)

    @staticmethod
    def scopes(name):
        parts = name.split("::")
        return ["::".join(parts[:i]) for i in range(len(parts), -1, -1)]

    @staticmethod
    def type(text):
        if text is None:
            return None
        bare = re.sub(r"\b(?:const|volatile|struct|class|typename|static|mutable)\b", "", re.sub(r"<.*>", "", text))
        return re.sub(r"^::", "", re.sub(r"[*&\s]+", " ", bare).strip()) or None

    def meaning(self, name, scopes):
        if name is None:
            return []
        for s in scopes:
            if (q := f"{s}::{name}" if s else name) in self.known:
                return [q]
        return sorted(k for k in self.known if k.endswith("::" + name))

    def layers(self, cls):
        seen, layer = {cls}, [cls]
        for _ in range(16):
            if not layer:
                return
            yield layer
            layer = [b for b in dict.fromkeys(b for c in layer for b in self.up.get(c, ())) if b not in seen]
            seen.update(layer)

    def written(self, name, cls):
        if cls in self.known:
            own = [c for layer in self.layers(cls) for c in sorted(layer)]
            return self.meaning(name, [*own, *self.scopes(cls)])
        return self.meaning(name, self.scopes(cls or ""))

    def find(self, classes, name):
        best = []
        for c in classes:
            if c not in self.known:
                continue
            for depth, layer in enumerate(self.layers(c)):
                best += [(depth, k, m) for k in layer for m in self.members if m[0] == k and m[1] == name]
        least = min((d for d, _, _ in best), default=0)
        return list(dict.fromkeys((k, m) for d, k, m in best if d == least))

    def types(self, hits):
        return {(c, m[3].count("*") if "<" not in m[3] else re.sub(r"<.*>", "", m[3]).count("*")) for k, m in hits if m[3] is not None for c in self.written(self.type(m[3]), k)}

    def around(self, own, name):
        for c in self.scopes(own):
            if c in self.known and (hits := self.find([c], name)):
                return hits
        return []

    def complete(self, classes):
        return all(c in self.known and not any(b in self.lost or b not in self.known for layer in self.layers(c) for b in layer) for c in classes)

    def step(self, state, step):
        if step in chains.OPERATORS:
            out = {(c, p - 1) for c, p in state if p}
            flat = [c for c, p in state if not p]
            over = [h for h in self.find(flat, chains.OPERATORS[step]) if h[1][2] != "field"]
            if step == "[]" and not over:
                return out | {(c, 0) for c in flat}
            return out | self.types(over)
        name, call = (step[:-2], True) if step.endswith("()") else (step, False)
        hits = self.find([c for c, _ in state], name)
        flat = [c for c, p in state if not p]
        if not hits and flat:
            arrow = [h for h in self.find(flat, "operator->") if h[1][2] != "field"]
            hits = self.find([c for c, _ in self.types(arrow)], name)
        return self.types([h for h in hits if (h[1][2] != "field") == call])

    def pick(self, hits, arity, how):
        fits = lambda m: arity is None or m[4] is None or (arity >= m[4] and (bool(m[6]) or arity <= m[5]))
        methods = [m for _, m in hits if m[2] != "field"]
        if not methods:
            return "field", []
        defs, decls = [m for m in methods if m[2] == "method_def"], [m for m in methods if m[2] == "method_decl"]
        wide = {(m[5], m[6]) for m in decls if fits(m)}
        good = [m for m in defs if fits(m) or (m[5], m[6]) in wide]
        rows, outcome = (good, how) if good else ([m for m in decls if fits(m)], "declaration") if any(map(fits, decls)) else (defs or decls, "no_fit")
        return outcome, sorted({m[7] for m in rows if m[7]}) or None

    def missing(self, classes):
        return ("not_in_class" if self.complete(classes) else "no_class"), None

    def resolve(self, cls, access, via, head, steps, name, arity):
        own = (self.meaning(cls, [""]) or [None])[0] if cls else None
        at = own or cls
        if access is None:
            hits = self.around(own, name) if own else []
            return self.pick(hits, arity, "calling_class") if hits else ("bare", None)
        if access == "::":
            if not head:
                hits = self.find([name], name) if name in self.known else []
                return self.pick(hits, arity, "static") if hits else ("global", None)
            classes = self.written(self.type(head), at)
            if not classes:
                return "not_a_class", None
            if nested := [f"{c}::{name}" for c in classes if f"{c}::{name}" in self.known]:
                hits = self.find(nested, name)
                return self.pick(hits, arity, "static") if hits else ("not_a_class", None)
            hits = self.find(classes, name)
            return self.pick(hits, arity, "static") if hits else self.missing(classes)
        how = "calling_class"
        if via == "this":
            if not own:
                return "no_class", None
            state = {(own, 1)}
        elif via in ("type", "typed"):
            how, state = "typed", {(c, self.type and re.sub(r"<.*>", "", head).count("*")) for c in self.written(self.type(head), at)}
            if not state:
                return "no_class", None
        elif via == "unknown":
            call, word = head.endswith("()"), head.removesuffix("()")
            made = self.written(word, at) if call else []
            if made:
                state = {(c, 0) for c in made}
            else:
                hits = [h for h in (self.around(own, word) if own else []) if (h[1][2] != "field") == call]
                state = self.types(hits)
                if not state:
                    return ("no_class" if hits and not call else "untyped"), None
        else:
            return "untyped", None
        for s in steps or []:
            if not (state := self.step(state, s)):
                return "no_class", None
        if access == "->" and not any(p for _, p in state):
            over = [h for h in self.find([c for c, _ in state], "operator->") if h[1][2] != "field"]
            if over and not (state := self.types(over)):
                return "no_class", None
        classes = sorted({c for c, _ in state})
        hits = self.find(classes, name)
        return self.pick(hits, arity, how) if hits else self.missing(classes)


def run(spark, classes, members, bases, calls):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    model = chains.Model(make([(c,) for c in classes], CLASSES), make(members, MEMBERS), make(bases, BASES))
    got = chains.resolve(make([(i, *c) for i, c in enumerate(calls)], CALLS), model).collect()
    assert len({r.call_id for r in got}) == len(got) == len(calls)
    return {r.call_id: (r.outcome, list(r.targets) if r.targets is not None else None) for r in got}


def test_written_cases(spark):
    classes = ["ns::Tex", "ns::Base", "Box", "Ptr", "ns::Tex::Inner"]
    m = lambda owner, name, kind, type_, n, chunk: (owner, name, kind, type_, n, n, False, chunk)
    members = [
        m("ns::Base", "load", "method_decl", "void", 1, "d1"), m("ns::Base", "load", "method_def", "void", 1, "c1"), m("ns::Tex", "size", "method_def", "int", 0, "c2"), m("ns::Tex", "size", "method_def", "int", 1, "c3"),
        m("Box", "get", "method_def", "const ns::Tex *", 0, "c4"), m("Box", "items", "field", "ns::Tex*", None, "c5"), m("Ptr", "operator->", "method_def", "Box *", 0, "c6"), m("ns::Tex", "box", "field", "Box", None, "c7"),
        m("ns::Tex::Inner", "Inner", "method_def", None, 0, "c8"), m("Box", "only", "method_decl", "int", 0, "d9"), ("Box", "many", "method_def", None, 1, 1, True, "c10"),
    ]
    calls = [
        ("ns::Tex", None, None, None, [], "load", 1), ("ns::Tex", "->", "this", None, [], "size", 1), ("ns::Tex", ".", "unknown", "box", ["get()"], "load", 1), (None, "->", "typed", "Ptr", [], "get", 0),
        (None, ".", "typed", "Box", ["items", "[]"], "size", 0), (None, "::", "type", "ns::Tex", [], "Inner", 0), (None, "::", "type", "ns::Tex", [], "nope", 0), (None, "::", None, "", [], "Box", 0),
        (None, "::", "type", "std", [], "sort", 2), (None, ".", "typed", "std::vector<int>", [], "size", 0), (None, ".", "typed", "Box", [], "only", 0), (None, ".", "typed", "Box", [], "get", 5),
        (None, ".", "typed", "Box", [], "items", 0), (None, ".", "unknown", "thing", [], "size", 0), (None, None, None, None, [], "free", 0), (None, ".", "typed", "Box", [], "many", 9),
    ]
    got = run(spark, classes, members, [("ns::Tex", "Base")], calls)
    assert [got[i] for i in range(len(calls))] == [
        ("calling_class", ["c1"]), ("calling_class", ["c3"]), ("calling_class", ["c1"]), ("typed", ["c4"]), ("typed", ["c2"]), ("static", ["c8"]), ("not_in_class", None), ("global", None),
        ("not_a_class", None), ("no_class", None), ("declaration", ["d9"]), ("no_fit", ["c4"]), ("field", []), ("untyped", None), ("bare", None), ("typed", ["c10"]),
    ]
    plain = Plain(classes, members, [("ns::Tex", "Base")])
    assert [plain.resolve(*c) for c in calls] == [got[i] for i in range(len(calls))]


@pytest.mark.parametrize("seed", [2])
def test_random_models(spark, seed):
    r = random.Random(seed)
    classes = [f"{r.choice(['', 'a::', 'a::b::', 'C1::'])}C{i}" for i in range(9)]
    short = [c.rsplit("::", 1)[-1] for c in classes]
    types = lambda: r.choice([None, "int", *[f"{r.choice(['', 'const '])}{r.choice(short + classes)}{r.choice(['', '*', ' &', '<int>'])}" for _ in range(6)]])
    names = ["f", "g", "h", "x", "operator->", "operator[]", "operator*"]
    members = []
    for i in range(60):
        n, kind = r.randint(0, 2), r.choice(["method_def", "method_def", "method_decl", "field"])
        members.append((r.choice(classes), r.choice(names), kind, types(), *((None, None) if kind == "field" else (n, n + r.randint(0, 1))), r.random() < 0.1, r.choice([f"k{i}", f"k{i}", None])))
    members.append(members[0])
    bases = [(r.choice(classes), r.choice([*short, *classes, "Gone"])) for _ in range(7)]
    calls = []
    for _ in range(250):
        access = r.choice([None, ".", ".", "->", "::"])
        via = r.choice(["this", "typed", "unknown", "type", None])
        head = r.choice([*classes, *short, "nowhere", "x", "f()", "C1()", "x"]) + (r.choice(["", "*"]) if via == "typed" else "")
        if via in ("typed", "type", None) or access == "::":
            head = head.removesuffix("()") if head else head
        steps = [r.choice(["f()", "g()", "x", "h", "[]", "->", "*"]) for _ in range(r.choice([0, 0, 1, 2, 3]))]
        calls.append((r.choice([None, *classes, *short]), access, via, r.choice([head, head, ""]) if access == "::" else head, steps, r.choice([*names[:4], *short]), r.choice([None, 0, 1, 2])))
    got, plain = run(spark, classes, members, bases, calls), Plain(classes, members, bases)
    wrong = [(c, got[i], plain.resolve(*c)) for i, c in enumerate(calls) if got[i] != plain.resolve(*c)]
    assert not wrong, wrong[:3]
    assert len({o for o, _ in got.values()}) >= 9


def test_nothing(spark):
    assert run(spark, [], [], [], [(None, ".", "typed", "A", ["x"], "f", None)]) == {0: ("no_class", None)}


def test_odd_models(spark):
    """A name of the same signature on the way, more bases than count, a cycle, and more classes of a name than lie in its row."""
    twin = next(f"t{i}" for i in range(1000) if zlib.crc32(f"t{i}".encode()) % 64 == zlib.crc32(b"f") % 64)
    deep, homes = [f"D{i}" for i in range(20)], [f"n{i}::T" for i in range(11)]
    classes = [*deep, *homes, "n3::U", "n3::T::In", "A", "B", "C"]
    m = lambda owner, name, type_=None: (owner, name, "method_def", type_, 0, 0, False, f"{owner}.{name}")
    members = [m("D0", "f"), m("D4", "f"), m("D19", twin), m("D10", twin), m("A", "g"), m("C", "f"), m("B", twin), *[m(h, "f") for h in homes], m("n3::U", "make", "T*"), m("A", "make", "T"), m("n3::T::In", "In")]
    bases = [*[(f"D{i}", f"D{i - 1}") for i in range(1, 20)], ("A", "B"), ("B", "C"), ("C", "A"), ("n3::U", "n3::T"), ("B", "Gone")]
    calls = [(c, "->", "this", None, [], n, 0) for c in ("D19", "D16", "D3", "A", "B", "C") for n in ("f", twin, "g", "none")]
    calls += [(c, ".", "typed", t, s, n, 0) for c in ("n3::U", "A", None) for t, s in (("T", []), ("In", []), ("n3::U", ["make()", "*"]), ("A", ["make()"])) for n in ("f", "In")]
    calls += [(c, a, None, h, [], n, 0) for c in ("n3::U", "A", "n3::T::In", "T", None) for a, h in ((None, None), ("::", "T"), ("::", "n3::T")) for n in ("f", "In")]
    got, plain = run(spark, classes, members, bases, calls), Plain(classes, members, bases)
    wrong = [(c, got[i], plain.resolve(*c)) for i, c in enumerate(calls) if got[i] != plain.resolve(*c)]
    assert not wrong, wrong[:3]


def test_rows_moved_do_not_grow_with_bases(spark):
    """Rows shuffled for each call of a class with a long way of bases, all of which have the name."""
    sc = spark.sparkContext
    store, gateway = sc._jsc.sc().statusStore(), sc._gateway

    def moved(since):
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        stages = [stages.apply(i) for i in range(stages.size())]
        return max((s.stageId() for s in stages), default=-1), sum(s.shuffleWriteRecords() for s in stages if s.stageId() > since)

    classes = [f"D{i}" for i in range(14)]
    members = [(c, "f", "method_def", None, 0, 0, False, c) for c in classes]
    before, limit = moved(1 << 40)[0], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = run(spark, classes, members, [(f"D{i}", f"D{i - 1}") for i in range(1, 14)], [("D13", "->", "this", None, [], "f", 0)] * 1000)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert set(map(str, got.values())) == {"('calling_class', ['D13'])"}
    assert moved(before)[1] < 9 * 1000
