"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles, banded and verified.

* Shingles are five words. A shingle weighs its count in the text times a normalised inverse document frequency: 1 for
  one in all documents, 2 for one in less than 1 of 2,048, the logarithm between. It is counted over all documents in
  2^20 hashed buckets, whose resolution is the same share of the documents at any size. The usual unbounded logarithm
  would let a group of thousands of near copies make its own shingles common, weigh an edit ten times what the group
  shares, and fall apart; here an edit weighs twice that at most.
* ICWS draws, for each of 64 samples, one shingle of the text with a chance in proportion to its weight, the same
  one in texts where it weighs the same. Two texts agree in a sample with their weighted Jaccard similarity.
* 16 bands of 4 samples: texts of weighted similarity 0.8 share a band key with a chance of 0.9998.
* A link holds if the weighted Jaccard similarity of two texts of one band key is 0.8 or more; nothing else decides.
* Each key's hub is the text that meets most others over all its keys. All texts of a key are verified against the hub,
  which is linear in the key's size.
* No other pair of a key is made unless it can hold. Let dx be the signed difference of x's weights from the hub's.
  x and y are linked only if dx and dy agree in weight by o = (|dx| + |dy| - (Wx + Wy) / 9) / 2. Differences that no other
  text of the hub has can't agree; the others are put in order, those of fewest texts first. By the prefix filter a
  pair that can hold shares a difference that has o or more at and behind it on both sides, which is the condition of
  the join. A text's difference goes before the join if no other text that has it, of another component, can need so
  little. What the pair shares, and the least that lies behind the last of it, bounds the agreement and prunes pairs
  before their texts are verified. The filter is exact: it drops no link between texts that were tried with one hub.

Classes are the connected components; a class's id is the least doc_id in it.

Equal texts are one class, also those without words. A null is an empty text. Repeated rows are each returned.
A null doc_id counts as the largest for the class id. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textmath as tm
from .common import forget, keep, lengths, map_arrow, pick, release

SHINGLE, SIMILAR = 5, 0.8
#: Bands and samples of each.
BANDS, ROWS = 16, 4
BUCKET_BITS, CHUNK_BITS = 20, 14
DRAWS = 1 << 16
#: What a shingle in hardly any document weighs more than one in all, and the share from which on it is that rare.
RARE_WEIGHT, RARE_SHARE = 1.0, 1 / 2048
_BLOCK = 1 << 14


def _frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents of each shingle bucket, and documents. What reaches the driver is a table of fixed size."""

    def count(batches):
        import zlib

        import pyarrow as pa

        from .common import steps

        table, n = np.zeros(1 << BUCKET_BITS, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for a, b in steps(lengths(batch.column("text"))):
                words, counts, _, _ = tm.word_hashes(batch.column("text").slice(a, b - a))
                s, per = tm.shingles(words, counts, SHINGLE)
                bucket = (s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
                once = np.unique(np.repeat(np.arange(len(per)), per) << BUCKET_BITS | bucket)
                table += np.bincount(once & ((1 << BUCKET_BITS) - 1), minlength=1 << BUCKET_BITS)
            release()
        if n:
            parts = table.reshape(-1, 1 << CHUNK_BITS)
            used = [i for i, p in enumerate(parts) if p.any()]
            ids, data = [*used, -1], [*(zlib.compress(parts[i].tobytes(), 1) for i in used), zlib.compress(np.array([n]).tobytes())]
            salt = int(np.random.default_rng(int(table.sum() + n)).integers(64))
            yield pa.record_batch([pa.array(ids, pa.int32()), pa.array([salt] * len(ids), pa.int32()), pa.array(data, pa.binary())], names=["chunk", "salt", "data"])

    def add(key, table):
        import zlib

        import pyarrow as pa

        total = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in table.column("data").to_pylist())
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "salt": pa.array([0], pa.int32()), "data": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    schema = "chunk int, salt int, data binary"
    parts = docs.select("text").mapInArrow(count, schema).groupBy("chunk", "salt").applyInArrow(add, schema).groupBy("chunk").applyInArrow(add, schema)
    import zlib

    table, n = np.zeros(1 << BUCKET_BITS, np.int64), 0
    for r in parts.collect():
        got = np.frombuffer(zlib.decompress(r.data), np.int64)
        if r.chunk < 0:
            n = int(got[0])
        else:
            table[r.chunk << CHUNK_BITS : (r.chunk + 1) << CHUNK_BITS] = got
    return table, n


def inverse_frequency(docs: DataFrame) -> np.ndarray:
    """1 for a bucket in all documents, 2 for a rare one; the resolution of the buckets is about RARE_SHARE at any size."""
    table, n = _frequencies(docs)
    return (1 + RARE_WEIGHT * np.minimum(1, np.log((1 + n) / (1 + table)) / np.log(1 / RARE_SHARE))).astype(np.float32)


def weighted(column, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in order, their weights, and their number for each text."""
    words, counts, _, _ = tm.word_hashes(column)
    s, per = tm.shingles(words, counts, SHINGLE)
    text = np.repeat(np.arange(len(per)), per)
    order = np.lexsort((s, text))
    s, text = s[order], text[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(s)))
    s = s[at]
    return s, tf * idf[(s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)].astype(np.float64), np.bincount(text[at], minlength=len(per))


_draws = None


def _drawn() -> tuple[np.ndarray, ...]:
    """r and log c from Gamma(2, 1), beta uniform, as ICWS has them; a shingle picks an entry anew for each sample."""
    global _draws
    if _draws is None:
        g = np.random.default_rng(20100614)
        r = g.gamma(2.0, 1.0, DRAWS)
        a = g.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        b = g.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)
        _draws = r, np.log(g.gamma(2.0, 1.0, DRAWS)) - r, g.random(DRAWS), a, b
    return _draws


def _blocks(per: np.ndarray):
    """Slices of the shingles and of the texts: blocks of whole texts that stay in the cache; a longer text is one block."""
    ends, first = np.cumsum(per), 0
    while first < len(per):
        last = max(int(np.searchsorted(ends, (ends[first - 1] if first else 0) + _BLOCK, "right")), first + 1)
        yield slice(ends[first] - per[first], ends[last - 1]), slice(first, last)
        first = last


def band_keys(s: np.ndarray, w: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Keys of each text's bands, as int64; a text without shingles has none that count."""
    r, log_c_r, beta, a, b = _drawn()
    out = np.empty((len(per), BANDS), np.uint64)
    log_w = np.log(w)
    for x, y in _blocks(per):
        for band in range(BANDS):
            key = np.full(y.stop - y.start, band + 1, np.uint64)
            for k in range(band * ROWS, (band + 1) * ROWS):
                h = tm.mix(s[x] * a[k] + b[k])
                i = (h >> np.uint64(48)).view(np.int64)
                rk, bk, value = r.take(i), beta.take(i), log_c_r.take(i)
                # log a of the ICWS paper: log c - r - r (t - beta), t = floor(log w / r + beta)
                t = log_w[x] / rk
                t += bk
                np.floor(t, out=t)
                t -= bk
                t *= rk
                value -= t
                # lower bits of the hash keep apart shingles that picked the same entry
                value += (h & np.uint64(0xFFFFFFFFFFFF)).view(np.int64) * 1e-18
                key = tm.mix(key * np.uint64(0x9E3779B97F4A7C15) + tm.segment_reduce(np.minimum, value, per[y], np.inf).view(np.uint64))
            out[y, band] = key
    return out.view(np.int64)


def _signatures(docs: DataFrame, idf) -> DataFrame:
    """doc_id, h (hash of the text) and the band keys; no keys for a text without words."""

    def step(batch):
        s, w, per = weighted(batch.column("text"), idf.value)
        return {"doc_id": batch.column("doc_id"), "h": batch.column("h"), "keys": [k if n else [] for k, n in zip(band_keys(s, w, per).tolist(), per.tolist(), strict=True)]}

    return map_arrow(docs, step, f"doc_id {dict(docs.dtypes)['doc_id']}, h binary, keys array<bigint>")


def differences(hubs, texts, idf: np.ndarray) -> dict[str, np.ndarray]:
    """How each text differs from the hub beside it, for many pairs at once.

    good: whether they are linked. token, weight: the differences, ``many`` for each pair; a shingle that the text lacks
    has another token than one that it has besides. u: the text's part of the agreement that a link to another text
    needs. need: the least agreement of any link that the hub has not made (with texts that are not linked to the hub, for
    a text that is).
    """
    import pyarrow as pa

    n = len(hubs)
    s, w, per = weighted(pa.concat_arrays([hubs, texts]), idf)
    row = np.repeat(np.arange(2 * n), per)
    total = np.bincount(row, w, minlength=2 * n)
    hub, own = total[:n], total[n:]
    v, pair = np.where(row < n, -w, w), row % max(n, 1)
    order = np.lexsort((s, pair))
    s, v, pair = s[order], v[order], pair[order]
    second = np.zeros(len(s), bool)
    second[1:] = (s[1:] == s[:-1]) & (pair[1:] == pair[:-1])
    at = np.flatnonzero(second)
    v[at - 1] += v[at]
    some = ~second & (np.abs(v) > 1e-9)
    s, v, pair = s[some], v[some], pair[some]
    d = np.bincount(pair, np.abs(v), minlength=n)
    good = (d <= (hub + own) / 9 * (1 + 1e-9)) & (hub > 0) & (own > 0)
    need = np.where(good, d + (hub - own) / 9, d - (own + hub) / 9) / 2
    token = np.where(v < 0, tm.mix(s ^ np.uint64(0x5851F42D4C957F2D)), s).view(np.int64)
    return {"good": good, "token": token, "weight": np.abs(v), "many": np.bincount(pair, minlength=n), "need": need, "u": (d - own / 9) / 2}


def _judged(pairs: DataFrame, idf, tokens: bool) -> DataFrame:
    """a (the hub), b and good for each pair with texts ta and tb; with ``tokens`` also what differences() has."""

    def run(batches):
        import pyarrow as pa

        from .common import steps

        for batch in batches:
            ta, tb = batch.column("ta"), batch.column("tb")
            for x, y in steps((p + q for p, q in zip(lengths(ta), lengths(tb), strict=True))):
                got = differences(ta.slice(x, y - x), tb.slice(x, y - x), idf.value)
                columns = {"a": batch.column("a").slice(x, y - x), "b": batch.column("b").slice(x, y - x), "good": pa.array(got["good"])}
                if tokens:
                    at = pa.array(np.concatenate(([0], np.cumsum(got["many"]))), pa.int32())
                    columns |= {k: pa.ListArray.from_arrays(at, pa.array(got[k])) for k in ("token", "weight")}
                    columns |= {k: pa.array(got[k]) for k in ("need", "u")}
                yield pa.RecordBatch.from_pydict(columns)
            del ta, tb, batch
            release()

    more = ", token array<bigint>, weight array<double>, need double, u double" if tokens else ""
    return pairs.select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary, good boolean" + more)


def _needed(u: Column, v: Column) -> Column:
    """The least agreement of linked texts, from the parts of both; it grows with each."""
    return (u + v) * (1 - 1e-9) - 1e-6


def _met(first: DataFrame, who: str) -> DataFrame:
    """Rows of _possible that can meet one of another ``who``: what lies at and behind the row suffices with the least u of those.

    It drops no row that the join on a and token would match, and is one pass over the rows of a token, not over their pairs.
    """
    token, parts = Window.partitionBy("a", "token"), {"any": F.col("u"), "bad": F.when(~F.col("good"), F.col("u"))}
    least = {k: F.min(F.when(u.isNotNull(), F.struct(u.alias("u"), F.col(who).alias("who")))).over(token) for k, u in parts.items()}
    second = {f"{k}2": F.min(F.when(F.col(who) != F.col(f"{k}.who"), u)).over(token) for k, u in parts.items()}
    other = {k: F.when(F.col(f"{k}.who") == F.col(who), F.col(f"{k}2")).otherwise(F.col(f"{k}.u")) for k in parts}
    # two texts that are linked to the hub are linked already
    u = F.when(F.col("good"), other["bad"]).otherwise(other["any"])
    return first.withColumns(least).withColumns(second).where(F.col("behind") >= _needed(F.col("u"), u)).drop(*least, *second)


def _possible(judged: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts with one hub, in different components, that may be linked, by the prefix filter on their differences."""
    rows = judged.select("a", "b", "good", "need", "u", F.explode(F.arrays_zip("token", "weight")).alias("t")).select("a", "b", "good", "need", "u", "t.*")
    often = rows.groupBy("a", "token").agg(F.count("*").alias("often")).where("often > 1")
    rarest = Window.partitionBy("a", "b").orderBy(F.desc("often"), F.desc("token"))
    first = rows.join(often, ["a", "token"]).withColumn("behind", F.sum("weight").over(rarest.rowsBetween(Window.unboundedPreceding, 0)))
    first = first.where(F.col("behind") >= F.col("need") * (1 - 1e-9) - 1e-6).select("a", "token", "b", "good", "u", "weight", "behind")
    first = _met(first, "b").join(roots.withColumnsRenamed({"h": "b"}), "b", "left").withColumn("root", F.coalesce("root", "b"))
    first = keep(_met(first, "root"), "first")
    p, q = first.where("NOT good").alias("p"), first.alias("q")
    needed = _needed(F.col("p.u"), F.col("q.u"))
    on = (F.col("p.a") == F.col("q.a")) & (F.col("p.token") == F.col("q.token")) & (F.col("p.root") != F.col("q.root")) & (F.col("q.good") | (F.col("p.b") < F.col("q.b")))
    both = p.join(q, on & (F.least("p.behind", "q.behind") >= needed))
    rest = F.least(F.col("p.behind") - F.col("p.weight"), F.col("q.behind") - F.col("q.weight"))
    both = both.select("p.a", F.col("p.b").alias("x"), F.col("q.b").alias("y"), F.least("p.weight", "q.weight").alias("shared"), rest.alias("rest"), needed.alias("needed"))
    both = both.groupBy("a", "x", "y").agg(F.sum("shared").alias("shared"), F.min("rest").alias("rest"), F.first("needed").alias("needed"))
    return both.where("shared + rest >= needed").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """h and root (the least of its component) for each end of an edge (a, b), by alternating large and small stars."""
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    size = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(30,0)"))).first())
    seen = size(edges)
    while True:
        before = edges
        all_ = both(edges)
        m = all_.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = all_.join(m, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = keep(large.distinct(), "large")
        m = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(m, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(m.select("a", F.col("m").alias("b")))
        edges = keep(small.distinct(), "small")
        now = size(edges)
        forget(large, before)
        if now == seen:
            return edges.select(F.col("a").alias("h"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("h"), F.col("b").alias("root"))).distinct()
        seen = now


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    return pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: bool = False) -> DataFrame:
    """doc_id, class_id and kept (the one row of its class that stays, in a table without repeated ids) for each row.

    more: also h and root, the MD5 of the row's text and the least one of its class.
    """
    docs = pick(docs, id_col, text_col).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.unhex(F.md5("text")))
    spark = docs.sparkSession
    idf = spark.sparkContext.broadcast(inverse_frequency(docs))
    signed = keep(_signatures(docs, idf), "signatures")
    nodes = keep(signed.groupBy("h").agg(F.min("doc_id").alias("first"), F.first("keys").alias("keys")), "texts")
    rows = nodes.select("h", "first", F.explode("keys").alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = keep(rows.join(sizes, "key"), "shared")
    # how often a text meets others, over all its keys: texts with few edits of their own lead
    met = keep(shared.groupBy("h").agg(F.sum("size").alias("met"), F.min("first").alias("first")), "met")
    hubs = shared.select("key", "h").join(met.select("h", "met"), "h").groupBy("key").agg(F.max_by("h", F.struct("met", "h")).alias("hub"))
    tried = keep(shared.select("key", "h").join(hubs, "key").where("h <> hub").select(F.col("hub").alias("a"), F.col("h").alias("b")).distinct(), "tried")
    # one plan at every size: a small table would be broadcast, and what is shuffled would not tell what a large one takes
    ends = met.select(F.col("h").alias("h2"), F.col("first").alias("d2")).hint("merge")
    same: Column = F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2"))
    texts = keep(docs.join(ends, same, "left_semi").select("h", "text").dropDuplicates(["h"]), "candidates")
    judged = keep(_judged(_with_texts(tried, texts), idf, True), "judged")
    forget(shared, met, tried)
    links = judged.where("good").select("a", "b")
    roots = keep(components(links), "roots")
    rest = keep(_possible(judged, roots), "possible")
    found = keep(_judged(_with_texts(rest, texts), idf, False).where("good").select("a", "b"), "found")
    forget(judged, texts, rest)
    if found.limit(1).count():
        roots = keep(components(roots.select(F.col("h").alias("a"), F.col("root").alias("b")).union(found)), "roots")
    ids = nodes.select("h", "first").join(roots, "h")
    least = ids.groupBy("root").agg(F.min("first").alias("class_id"))
    named = nodes.select("h", "first").join(ids.join(least, "root").select("h", "root", "class_id"), "h", "left")
    named = named.select("h", F.coalesce("class_id", "first").alias("class_id"), F.coalesce("root", "h").alias("root"))
    out = signed.select("doc_id", "h").join(named, "h")
    return out.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"), *(["h", "root"] if more else []))
