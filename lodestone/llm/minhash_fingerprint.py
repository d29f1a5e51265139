"""Document fingerprints: MinHash by universal hash permutations over shingles, in vectorised numpy.

A fingerprint has 128 slots of 16 bits: slot k is the least of (a_k x + b_k) mod 2^64 over the hashes x of the
text's shingles (five words), of whose upper half the lower 16 bits are kept. The likeness of two fingerprints is
their share of equal slots, an estimate of the Jaccard similarity of the shingle sets. search() joins bands of
slots in Spark and verifies the exact Jaccard similarity of what it finds; it works on distinct texts, of which each
result stands for all copies.

Equal texts have equal fingerprints. A null is an empty text; texts without words have the fingerprint of all ones and
are similar to their copies only. Rows of one doc_id are ordered by text. A null doc_id comes first. A table of one row is followed by itself.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import NumericType, StructType

from . import textmath as tm
from .common import STEP_BYTES, keep, lengths, map_arrow, pick, release, steps

SLOTS, SHINGLE = 128, 5
BANDS, ROWS = 32, 4
#: Ids for each range that bounds of ids other than numbers are taken from.
IDS_A_RANGE = 50
_g = np.random.default_rng(19970611)
_A = _g.integers(0, 2**63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _g.integers(0, 2**64, SLOTS, dtype=np.uint64)
_BLOCK = 1 << 14


def fingerprints(column) -> np.ndarray:
    """Slots (uint16) of each text of a string column."""
    words, counts, _, _ = tm.word_hashes(column)
    s, per = tm.shingles(words, counts, SHINGLE)
    out = np.full((len(per), SLOTS), 0xFFFFFFFF, np.uint32)
    ends = np.cumsum(per)
    # blocks of whole texts that stay in the cache; a longer text is one block
    a = 0
    while a < len(per):
        b = max(int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _BLOCK, "right")), a + 1)
        x = s[ends[a] - per[a] : ends[b - 1]]
        for k in range(SLOTS):
            out[a:b, k] = tm.segment_reduce(np.minimum, ((x * _A[k] + _B[k]) >> np.uint64(32)).astype(np.uint32), per[a:b], 0xFFFFFFFF)
        a = b
    return out.astype(np.uint16)


def as_text(slots: np.ndarray) -> list[str]:
    big = slots.astype(">u2")
    return [row.tobytes().hex() for row in big]


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of each row."""
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text")
    return map_arrow(rows, lambda b: {"doc_id": b.column("doc_id"), "fingerprint": as_text(fingerprints(b.column("text")))}, f"doc_id {dict(rows.dtypes)['doc_id']}, fingerprint string")


def _part(value: Column, bounds: list) -> Column:
    """How many of the ascending bounds are at most the value, by binary steps; 0 for null."""
    if not bounds:
        return F.lit(0)
    if isinstance(bounds[0], float):
        at = F.split(F.lit(",".join(map(repr, bounds))), ",").cast("array<double>")
    else:
        at = F.array(*[F.lit(b) for b in bounds])
    halves = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    step = lambda lo, s: F.when((lo + s <= len(bounds)) & (F.get(at, lo + s - 1) <= value), lo + s).otherwise(lo)
    return F.coalesce(F.aggregate(halves, F.lit(0), step), F.lit(0))


def _bounds(docs: DataFrame, n: int) -> tuple[Column, list]:
    """What doc_id is compared by, and up to n - 1 values of it that cut the rows in even ranges."""
    kind = docs.schema["doc_id"].dataType
    if isinstance(kind, NumericType):
        number = F.col("doc_id").cast("double")
        return number, sorted(set(docs.select(number.alias("x")).approxQuantile("x", [i / n for i in range(1, n)], 0.2 / n)))
    some = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("doc_id").alias("draw")).orderBy("draw").limit(IDS_A_RANGE * n).collect()
    ids = sorted(r.doc_id for r in some)
    return F.col("doc_id"), sorted({ids[i * len(ids) // n] for i in range(1, n)} if ids else ())


def _dealt(spark: SparkSession, n: int) -> Column:
    """An array of n numbers, of which each goes to a partition of its own where n are made by hash."""
    made = spark.range(32 * n).select(F.col("id").cast("int").alias("i"))
    rows = made.groupBy(F.pmod(F.hash("i"), F.lit(n)).alias("to")).agg(F.min("i").alias("i")).collect()
    numbers = {r.to: r.i for r in rows}
    return F.split(F.lit(",".join(str(numbers.get(k, k)) for k in range(n))), ",").cast("array<int>")


def in_order(docs: DataFrame) -> DataFrame:
    """Rows in partitions by ranges of doc_id, sorted, each range followed by the first rows of the next (look = 1)."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    value, bounds = _bounds(docs, n)
    docs = docs.withColumn("part", _part(value, bounds))
    # the first row of each range: one small row for each partition comes to the driver
    firsts = sorted((r.part, r.first.doc_id) for r in docs.groupBy("part").agg(F.min(F.struct("doc_id")).alias("first")).collect())
    used = [p for p, _ in firsts]
    back = {p: used[i - 1] for i, p in enumerate(used)}  # the first range's first rows also follow the last
    if not firsts:
        return docs.withColumn("look", F.lit(0))
    table = spark.createDataFrame([(p, i, back[p]) for p, i in firsts], f"part int, first {dict(docs.dtypes)['doc_id']}, back int")
    docs = docs.join(F.broadcast(table), "part")
    places = F.when(F.col("doc_id").eqNullSafe(F.col("first")), F.array(F.struct(F.col("part"), F.lit(0).alias("look")), F.struct(F.col("back").alias("part"), F.lit(1).alias("look")))).otherwise(
        F.array(F.struct(F.col("part"), F.lit(0).alias("look")))
    )
    docs = docs.select("doc_id", "text", F.explode(places).alias("p")).select("p.part", "p.look", "doc_id", "text")
    docs = docs.withColumn("part", F.get(_dealt(spark, n), F.col("part")))
    return docs.repartition(n, "part").sortWithinPartitions("part", "look", "doc_id", "text")


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint beside those of its edited text and of the next document's text."""
    docs = pick(docs, id_col, text_col).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        import pyarrow as pa

        def done(ids: list, texts: list[str]):
            """Rows of all texts but the last, which only follows."""
            n = len(ids)
            new = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, texts[1:])]
            prints = fingerprints(pa.array([*texts, *new], pa.large_string()))
            own, next_, edited = prints[:n], prints[1 : n + 1], prints[n + 1 :]
            columns = [ids, list(map(len, texts[:n])), [hashlib.sha256(t.encode()).hexdigest() for t in new], as_text(own), as_text(edited), (own == edited).mean(1), (own == next_).mean(1)]
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

        ids, texts, part, size = [], [], None, 0
        for batch in batches:
            for p, look, i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != part:
                    ids, texts, part, size, over = [], [], p, 0, False
                if over:
                    continue
                texts.append(t)
                size += len(t)
                if look or size > STEP_BYTES:
                    if ids:
                        yield done(ids, texts)
                    ids, texts, size, over = [], [t], len(t), bool(look)
                ids.append(i)

    return in_order(docs).mapInArrow(run, schema)


def _bands(slots: np.ndarray) -> list[list[int]]:
    wide = slots.astype(np.uint64).reshape(len(slots), BANDS, ROWS)
    key = np.zeros(wide.shape[:2], np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = tm.mix(key * np.uint64(0x9E3779B97F4A7C15) + wide[:, :, k])
    return key.view(np.int64).tolist()


def search(queries: DataFrame, docs: DataFrame, similar: float = 0.8) -> DataFrame:
    """For each query, the distinct texts of docs of at least that Jaccard similarity: query_id, doc_id (the least of the
    text's documents), copies (their number) and jaccard.

    Equal bands find the candidates (a pair of similarity 0.8 with a chance above 1 - 1e-7), once for each pair of
    distinct texts, and the texts verify them. A query's own text is found too where docs has it.
    """
    # columns by exact names; a query with a null text has the empty one
    rows = lambda df: pick(df, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.md5("text"))
    asked, all_ = rows(queries), rows(docs)

    def banded(df: DataFrame) -> DataFrame:
        """h and key of distinct texts; none for a text without words."""

        def step(b):
            prints = fingerprints(b.column("text"))
            none = (prints == 0xFFFF).all(1).tolist()
            return {"h": b.column("h"), "key": [[] if x else k for k, x in zip(_bands(prints), none, strict=True)]}

        got = map_arrow(df.select("h", "text"), step, "h string, key array<bigint>")
        return got.groupBy("h").agg(F.first("key").alias("key")).select("h", F.explode("key").alias("key"))

    found = keep(all_.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")), "texts")
    pairs = banded(asked).withColumnRenamed("h", "q").join(banded(all_).withColumnRenamed("h", "d"), "key").where("q <> d").select("q", "d").distinct()
    pairs = keep(pairs, "pairs")
    text = lambda df, h, t, side: df.select(F.col("h").alias(h), F.col("text").alias(t)).join(pairs.select(F.col(side).alias(h)).distinct(), h, "left_semi").dropDuplicates([h])
    both = pairs.join(text(asked, "q", "t_q", "q"), "q").join(text(all_, "d", "t_d", "d"), "d")

    def verify(batches):
        import pyarrow as pa

        for batch in batches:
            tq, td = batch.column("t_q"), batch.column("t_d")
            for x, y in steps((a + b for a, b in zip(lengths(tq), lengths(td), strict=True))):
                n = y - x
                words, counts, _, _ = tm.word_hashes(pa.concat_arrays([tq.slice(x, n), td.slice(x, n)]))
                s, per = tm.shingles(words, counts, SHINGLE)
                ends, out = np.cumsum(per), []
                for i in range(n):
                    a, b = (np.unique(s[ends[k] - per[k] : ends[k]]) for k in (i, n + i))
                    m = len(np.intersect1d(a, b, True))
                    out.append(m / (len(a) + len(b) - m))
                yield pa.record_batch([batch.column("q").slice(x, n), batch.column("d").slice(x, n), pa.array(out, pa.float64())], names=["q", "d", "jaccard"])
            del tq, td, batch
            release()

    near = both.select("q", "d", "t_q", "t_d").mapInArrow(verify, "q string, d string, jaccard double").where(F.col("jaccard") >= similar)
    same = asked.select(F.col("h").alias("q"), F.col("h").alias("d"), F.lit(1.0).alias("jaccard")).distinct()
    out = asked.select(F.col("doc_id").alias("query_id"), F.col("h").alias("q")).join(near.union(same), "q")
    return out.join(found.withColumnRenamed("h", "d"), "d").select("query_id", "doc_id", "copies", "jaccard")
