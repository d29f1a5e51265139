"""Merkle manifest, substring dedup and vector codes against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import merkle_manifest as merkle
from lodestone.llm import product_codes as codes
from lodestone.llm import substring_dedup as sub

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def clashing(df):
    """With a name that differs by case, and one that repeats."""
    return df.select("*", F.lit("x").alias("TEXT"), F.lit(1).alias("h"), F.lit(2).alias("h"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# merkle manifest


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(r, more=0):
    n = r["n_chars"] if r["n_chars"] is None else r["n_chars"] + more
    return sha(*map(field, (r["doc_id"], r["source"], r["lang"], n, r["text"])))


def tree(nodes):
    """Root, and for each node the siblings and sides of its way up, level by level."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            other = p ^ 1
            ways[i].append((nodes[other], p % 2) if other < len(nodes) else None)
        nodes = [sha(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        at = [p // 2 for p in at]
    return nodes[0], ways


def manifest_of(rows):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["lang"]].append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    subs = {}
    for lang in langs:
        own = sorted(by[lang], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        subs[lang] = (own, *tree([leaf_of(r) for r in own]))
    root, up = tree([subs[x][1] for x in langs])
    out = []
    for lang, above in zip(langs, up):
        own, subroot, ways = subs[lang]
        for r, way in zip(own, ways):
            changed = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            d = leaf_of(r, 1 if changed else 0)
            for step in way + above:
                d = sha(d) if step is None else sha(step[0], d) if step[1] else sha(d, step[0])
            out.append((r["doc_id"], leaf_of(r), subroot, root, sha(*[s[0] for s in way + above if s]), d, d == root))
    return collections.Counter(out)


def some_docs(n, seed):
    r = random.Random(seed)
    rows = [(i * 3, r.choice(["é", "", "a b", None, "x" * r.randint(0, 50)]), r.choice(["en", "en", "en", "de", "", None, "é", "zz"]), r.choice(["s", None]), r.choice([None, 5, 2**62, 0])) for i in range(n)]
    return rows + [(6, "same", "en", "s", 1), (6, "same", "en", "s", 1), (6, "other", "en", "s", 1), (None, None, None, None, None), (None, "t", "en", "s", 4), (9, "only one", "solo", "s", 1)]


@pytest.mark.parametrize(("n", "levels"), [(0, 12), (1, 1), (37, 1), (70, 2), (90, 12)])
def test_manifest(spark, n, levels, monkeypatch):
    monkeypatch.setattr(merkle.build, "__defaults__", (levels,))
    docs = spark.createDataFrame(some_docs(n, n), DOCS)
    got = merkle.manifest(clashing(docs)).collect()
    assert collections.Counter(map(tuple, got)) == manifest_of([r.asDict() for r in docs.collect()])
    assert any(not r.verified for r in got) == any(r.n_chars is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0 for r in docs.collect())


def test_manifest_of_nothing(empty):
    assert merkle.manifest(empty).count() == 0


def test_walk_and_fold():
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(13)]
    root, siblings, sides = merkle.walk(leaves, 4)
    assert all(merkle.fold(d, bytes(p), bytes(s)) == root for d, p, s in zip(leaves, siblings, sides))
    assert merkle.fold(leaves[0], bytes(siblings[1]), bytes(sides[1])) != root


# substring dedup


def split(text):
    return [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]


def without(rows):
    words = [split(t) for _, t in rows]
    windows = collections.Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for (i, _), w in zip(rows, words):
        gone = {p for a in range(len(w) - 34) if windows[tuple(w[a : a + 35])] > 1 for p in range(a, a + 35)}
        out.append((i, len(w), len(gone), sha(" ".join(x for p, x in enumerate(w) if p not in gone))))
    return collections.Counter(out)


def passages(seed):
    r = random.Random(seed)
    vocab = [chr(97 + i % 26) * (1 + i % 5) + ("é" if i % 7 == 0 else "") for i in range(60)]
    prose = lambda n: r.choice([" ", "  ", "\n", " \t"]).join(r.choice(vocab) for _ in range(n))
    shared, short = prose(60), prose(34)
    rows = [(i, prose(r.randint(0, 120))) for i in range(30)]
    rows += [(100 + i, f"{prose(r.randint(0, 40))} {shared} {prose(r.randint(0, 40))}") for i in range(6)]
    rows += [(200 + i, f"{prose(20)} {short} {prose(20)}") for i in range(4)]
    rows += [(300, "a " * 35), (301, "b " * 36), (302, "c d " * 60), (303, None), (304, ""), (305, " \n "), (306, "x"), (306, "x"), (None, None), (307, shared), (307, shared), (308, "\xa0   " * 40), (309, "w" * 5000), (310, prose(20_000))]
    near = rows[30][1].split()
    return rows + [(311, " ".join([*near[:50], "changed", *near[51:]]))]


def test_substring_dedup(spark, empty, monkeypatch):
    rows = passages(3)
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert collections.Counter(map(tuple, sub.without_repeats(docs).collect())) == without(rows)
    # a sketch that is far too small takes nearly all windows for repeated, and the exact pass takes them back
    monkeypatch.setattr(sub, "LEAST_CELLS", sub.BLOCK)
    monkeypatch.setattr(sub, "_twice", lambda sketch, anchors: np.ones(len(anchors), bool))
    got = sub.dedup(docs, sub.BLOCK).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))
    assert collections.Counter(map(tuple, got.collect())) == without(rows)
    assert sub.without_repeats(empty).count() == 0


def test_sketch_never_counts_too_little():
    import pyarrow as pa

    w = sub.Windows(pa.array([t for _, t in passages(8)], pa.string()))
    anchors = w.anchors()
    cells = sub.LEAST_CELLS
    count = np.zeros(sub.DEPTH * cells, int)
    for row in range(sub.DEPTH):
        np.add.at(count, sub._cells(anchors, row, cells), 1)
    sketch = np.packbits(count > 1)
    words = [w.data[a:b].tobytes() for a, b in zip(w.starts, w.ends)]
    windows = collections.Counter(tuple(words[i : i + 35]) for i in w.valid)
    repeated = {int(i) for i in w.valid if windows[tuple(words[i : i + 35])] > 1}
    assert repeated and repeated <= set(w.repeated(sketch).tolist())
    assert len(anchors) < 0.2 * len(w.valid)


# vector codes


def coded(rows):
    rows = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(rows[0][1]) // 8
    cut = lambda v, p: v[p * w : p * w + w]
    books = [[cut(v, p) for _, v, _ in rows[:16]] for p in range(8)]
    near = lambda part, book: min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))
    for _ in range(6):
        for p in range(8):
            held = collections.defaultdict(list)
            for _, v, _ in rows:
                held[near(cut(v, p), books[p])[1]].append(cut(v, p))
            for k, parts in held.items():
                books[p][k] = [sum(x) // len(parts) for x in zip(*parts)]
    digest = sha(",".join(str(x) for b in books for e in b for x in e))
    out, per = [], collections.Counter()
    for i, v, label in rows:
        best = [near(cut(v, p), books[p]) for p in range(8)]
        out.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), label))
        per[label] += out[-1][2]
    return collections.Counter((i, c, e, per[label], digest) for i, c, e, label in out)


@pytest.mark.parametrize(("n", "dim"), [(3, 8), (40, 16), (90, 24)])
def test_vector_codes(spark, n, dim, monkeypatch):
    r = random.Random(n)
    f32 = lambda x: float(np.float32(x))
    rows = [(i * 2, [f32(r.choice([r.uniform(-1, 1), 0.25, -0.5])) for _ in range(dim)], r.choice([1, 2, None])) for i in range(n)]
    rows += [(5, rows[0][1], 1), (5, rows[0][1], 1), (None, rows[1][1], None)]
    bad = [(1001, None, 1), (1002, [*rows[0][1][:-1], None], 1), (1003, [*rows[0][1][:-1], math.nan], 2), (1004, [math.inf, *rows[0][1][1:]], 2), (1005, [], 2), (1006, [0.5] * (dim + 1), 2)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int").repartition(3).select("*", F.lit(1).alias("Label"), F.lit(2).alias("code"), F.lit(3).alias("code"))
    expected = coded(rows)
    assert collections.Counter(map(tuple, codes.compress(df).collect())) == expected
    monkeypatch.setattr(codes, "small", lambda table, size: table)  # sums of labels too many to broadcast
    assert collections.Counter(map(tuple, codes.compress(df).collect())) == expected


def test_vector_codes_of_nothing(spark):
    none = spark.createDataFrame([(1, None, 2)], "vec_id long, embedding array<float>, label int")
    assert codes.compress(none).count() == 0 and codes.compress(none.limit(0)).count() == 0
    with pytest.raises(Exception, match="too large"):
        codes.compress(spark.createDataFrame([(1, [1e9] * 8, 1)], "vec_id long, embedding array<double>, label int")).collect()


def test_decoded_vectors_are_the_entries():
    books = np.arange(8 * 16 * 2).reshape(8, 16, 2)
    assert codes.decode(["00" * 8, "0f" * 8], books).tolist() == [books[:, 0].ravel().tolist(), books[:, 15].ravel().tolist()]
