"""Product quantisation of vectors in exact integers: eight codebooks of sixteen entries, trained by rounds of k-means.

A component x becomes floor(4096 * x), and a vector is cut into PARTS equal parts. A part's codebook starts as that part
of the ENTRIES vectors of smallest id. Each round sends the codebooks to all tasks; Arrow batches compute all squared
distances by the norm expansion, with int64 matrix products, and take the first least one. A task adds up its parts for
each entry, and a grouped shuffle merges these sums, of which only PARTS x ENTRIES x width reach the driver. An entry
becomes the floor of its mean; one that no part chose stays.

Rows: a vector that is null, is empty, or holds a null or a non-finite component is dropped, and so is one whose length
is no multiple of PARTS or not that of the kept vector of smallest id. Of equal ids the lesser vector comes first; a
null id comes last. With fewer than ENTRIES vectors the codebooks have as many entries. An empty table has no rows. A
component too large for exact 64-bit distances (beyond 46,000 where a part has eight) is refused with a ValueError.
Repeated rows each count and get the same code. Other columns, also of clashing names, are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, pick
from .decontaminate import _small as small

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Components that one vectorised step handles at once.
STEP = 1 << 20
#: Parts into which the rows of a label go where the labels' sums are too many to broadcast.
SALT = 64


def integers(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of an Arrow list column: the scaled integers of the vectors that are kept, and which are."""
    import pyarrow as pa
    import pyarrow.compute as pc

    whole = pc.fill_null(pc.equal(pc.list_value_length(column), width), False)
    flat = column.filter(whole).flatten().cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)
    x = flat.reshape(-1, width)
    good = np.isfinite(x).all(axis=1)
    kept = whole.to_numpy(zero_copy_only=False).copy()
    kept[np.flatnonzero(kept)[~good]] = False
    x = np.floor(x[good] * SCALE)
    if x.size and np.abs(x).max() > math.isqrt(2**60 // width):
        raise ValueError("a component is too large for exact 64-bit distances")
    return x.astype(np.int64), kept


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row, the first of equal ones, and the squared distance."""
    d = (entries * entries).sum(axis=1) - 2 * (x @ entries.T)
    at = d.argmin(axis=1)
    return at, (x * x).sum(axis=1) + d[np.arange(len(x)), at]


def _steps(batches: Iterator, width: int) -> Iterator:
    rows = max(1, STEP // width)
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def first_entries(vectors: DataFrame) -> np.ndarray | None:
    """The starting codebooks (part, entry, position), of vec_id and embedding; None if no vector is kept."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    x = F.col("embedding").cast("array<double>")
    kept = vectors.select("vec_id", x.alias("x")).where((F.size("x") > 0) & (F.size("x") % PARTS == 0) & F.forall("x", finite))
    order = [F.col("vec_id").asc_nulls_last(), F.col("x")]
    if (least := kept.orderBy(*order).first()) is None:
        return None
    rows = kept.where(F.size("x") == len(least.x)).orderBy(*order).limit(ENTRIES).collect()
    x = np.floor(np.array([r.x for r in rows]) * SCALE).astype(np.int64)
    return np.ascontiguousarray(x.reshape(len(rows), PARTS, -1).swapaxes(0, 1))


def _round(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round."""
    import pyarrow as pa

    parts, n, size = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, n, size), np.int64), np.zeros((parts, n), np.int64)
        for batch in _steps(batches, parts * size):
            x, _ = integers(batch.column("embedding"), parts * size)
            for p in range(parts):
                part = x[:, p * size : (p + 1) * size]
                at, _ = nearest(part, books[p])
                np.add.at(total[p], at, part)
                count[p] += np.bincount(at, minlength=n)
        p, e = np.nonzero(count)
        at = np.arange(size)
        yield pa.RecordBatch.from_arrays(
            [pa.array(v) for v in (np.repeat(p, size).astype(np.int32), np.repeat(e, size).astype(np.int32), np.tile(at, len(p)).astype(np.int32), total[p, e].ravel(), np.repeat(count[p, e], size))],
            ["part", "entry", "at", "total", "n"],
        )

    got = vectors.select("embedding").mapInArrow(sums, "part int, entry int, at int, total long, n long")
    got = got.groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()
    p, e, at, total, count = (got.column(c).to_numpy() for c in ("part", "entry", "at", "total", "n"))
    books = books.copy()
    books[p, e, at] = total // count  # floors, also below zero
    return books


def train(vectors: DataFrame, rounds: int = ROUNDS) -> np.ndarray | None:
    """The codebooks (part, entry, position) after so many rounds over all vectors (vec_id, embedding)."""
    books = first_entries(vectors)
    for _ in range(rounds if books is not None else 0):
        books = _round(vectors, books)
    return books


def encode(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code and error of each kept vector (vec_id, embedding, label)."""
    import pyarrow as pa

    parts, _, size = books.shape
    schema = vectors.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches, parts * size):
            x, kept = integers(batch.column("embedding"), parts * size)
            code, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                at, d = nearest(x[:, p * size : (p + 1) * size], books[p])
                code[:, p] = at
                error += d
            digits, w = code.tobytes().hex(), 2 * parts
            kept = pa.array(kept)
            ids, labels = batch.column("vec_id").filter(kept), batch.column("label").filter(kept)
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array([digits[i : i + w] for i in range(0, len(digits), w)], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return vectors.select("vec_id", "label", "embedding").mapInArrow(run, schema)


def decode(codes: list[str], books: np.ndarray) -> np.ndarray:
    """The vectors that codes stand for, in units of 1 / SCALE."""
    at = np.frombuffer(bytes.fromhex("".join(codes)), np.uint8).reshape(len(codes), len(books))
    return np.concatenate([books[p][at[:, p]] for p in range(len(books))], axis=1)


def with_label_error(coded: DataFrame) -> DataFrame:
    """With label_error: error summed over rows of the same label, nulls together.

    The sums are broadcast if counted to be few; else each label's rows are spread over SALT keys.
    """
    sums = keep(coded.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error")), "label-errors")
    few = small(sums, F.lit(16))
    same = F.col("label").eqNullSafe(F.col("l"))
    if few is not sums:
        return coded.join(few, same, "left").drop("l")
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALT)))
    spread = sums.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))).withColumn("s", F.col("s").cast("long"))
    return salted.join(spread, same & (F.col("salt") == F.col("s")), "left").drop("l", "s", "salt")


def compress(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each kept vector."""
    import hashlib

    vectors = pick(vectors, "vec_id", "embedding", "label")
    books = train(vectors)
    digest = hashlib.sha256(",".join(map(str, [] if books is None else books.ravel())).encode()).hexdigest()
    coded = vectors.where("false").select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")) if books is None else encode(vectors, books)
    return with_label_error(keep(coded, "codes")).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
