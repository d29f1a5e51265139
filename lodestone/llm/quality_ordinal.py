"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w . x) with one weight vector for all grades and ascending thresholds. x holds three
groups of hashed features of the whole text, each scaled to unit length: words, runs of signs, and shapes of words
(case and length). Expected grade and the chance of the top grades follow and select documents.

Learns from a bounded sample of rated rows, chosen by hash; rows that repeat an id and a text count once. Ratings are any
integers, of MOST_GRADES values at most (more is an error); grades are their ranks. With ratings
of one value only, or none, every row is expected at that value (null without any) with tail probability 1.
A null is an empty text. Repeated rows are scored each. Other columns are ignored. Texts are scored whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textmath as tm
from .common import map_arrow, pick

SAMPLE_ROWS, BITS, EPOCHS, BATCH, RATE, DECAY = 5000, 16, 12, 64, 0.3, 1e-2
MOST_GRADES = 100
_WORD, _UPPER, _SIGN = tm._WORD, np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_SIGN[[*range(33, 48), *range(58, 65), *range(91, 95), 96, *range(123, 127)]] = True


def features(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and value of each feature in order of texts, and features of each text (count)."""
    data, offsets = tm.buffers(column)
    low, low_offsets = tm.buffers(tm.lowered(column))
    n = len(offsets) - 1
    mask = np.uint64((1 << BITS) - 1)
    rows, keys = [], []

    def group(hashes: np.ndarray, starts: np.ndarray, at: np.ndarray, salt: int) -> None:
        keys.append(tm.mix(hashes ^ np.uint64(salt)) & mask)
        rows.append(np.searchsorted(at, starts, "right") - 1)

    s, e = tm.runs(_WORD[low], low_offsets)
    group(tm.hashes(low, s, e), s, low_offsets, 1)
    s, e = tm.runs(_SIGN[data], offsets)
    group(tm.hashes(data, s, e), s, offsets, 2)
    s, e = tm.runs(_WORD[data], offsets)
    upper = np.concatenate(([0], np.cumsum(_UPPER[data])))
    capitals = np.minimum(upper[e] - upper[s], 3) + 4 * (upper[e] - upper[s] == e - s)
    group((capitals * 32 + np.minimum(e - s, 31)).astype(np.uint64), s, offsets, 3)
    out = []
    for g, (r, k) in enumerate(zip(rows, keys, strict=True)):
        both, count = np.unique(r.astype(np.int64) << (BITS + 2) | np.int64(g) << BITS | k.astype(np.int64), return_counts=True)
        r = both >> (BITS + 2)
        norm = np.sqrt(np.bincount(r, count.astype(float) ** 2, n))
        out.append((both, count / norm[r]))
    both, value = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(both, kind="stable")
    both, value = both[order], value[order]
    return both & ((1 << BITS) - 1), value, np.bincount(both >> (BITS + 2), minlength=n)


class Ordinal:
    def __init__(self, grades: list[int]):
        self.grades, self.w = grades, np.zeros(1 << BITS)
        self.gaps = np.linspace(-1, 1, len(grades) - 1) if len(grades) > 2 else np.zeros(len(grades) - 1)
        self.gaps[1:] = np.log(np.expm1(np.maximum(np.diff(np.linspace(-1, 1, len(grades) - 1)), 0.1))) if len(grades) > 2 else self.gaps[1:]

    def thresholds(self) -> np.ndarray:
        """The first is free; each next one is above it by a softplus."""
        return np.concatenate([self.gaps[:1], self.gaps[:1] + np.cumsum(np.log1p(np.exp(self.gaps[1:])))])

    def fit(self, f, y: np.ndarray) -> Ordinal:
        keys, value, per = f
        ends = np.cumsum(per)
        g = np.random.default_rng(7)
        square_w, square_t = np.full(len(self.w), 1e-6), np.full(len(self.gaps), 1e-6)
        sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
        for _ in range(EPOCHS):
            order = g.permutation(len(y))
            for a in range(0, len(y), BATCH):
                rows = order[a : a + BATCH]
                at = np.concatenate([np.arange(ends[r] - per[r], ends[r]) for r in rows])
                text = np.repeat(np.arange(len(rows)), per[rows])
                z = np.bincount(text, self.w[keys[at]] * value[at], len(rows))
                t = np.concatenate([[-30.0], self.thresholds(), [30.0]])
                up, lo = sig(t[y[rows] + 1] - z), sig(t[y[rows]] - z)
                p = np.maximum(up - lo, 1e-9)
                du, dl = up * (1 - up) / p, lo * (1 - lo) / p
                dz = (du - dl) / len(rows)  # of minus the log-likelihood
                dt = np.bincount(y[rows], dl, len(t) - 1)[1:] - np.bincount(y[rows], du, len(t) - 1)[:-1]
                dt /= len(rows)
                dg = np.concatenate([[dt.sum()], np.cumsum(dt[::-1])[::-1][1:] * sig(self.gaps[1:])])
                grad = np.bincount(keys[at], dz[text] * value[at], len(self.w)) + DECAY * self.w / len(self.w)
                square_w += grad**2
                square_t += dg**2
                self.w -= RATE * grad / np.sqrt(square_w)
                self.gaps -= RATE * dg / np.sqrt(square_t)
        return self

    def tails(self, f) -> np.ndarray:
        """P(grade > k) for each threshold."""
        keys, value, per = f
        z = tm.segment_reduce(np.add, self.w[keys] * value, per, 0.0)
        return 1 / (1 + np.exp(np.clip(self.thresholds()[None, :] - z[:, None], -30, 30)))


def train(docs: DataFrame, ratings: DataFrame, rating: str = "quality"):
    """The model, or the only rating there is (None without any)."""
    ratings = pick(ratings, "doc_id", rating).toDF("doc_id", "grade").where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
    grades = sorted(r.grade for r in ratings.select("grade").distinct().limit(MOST_GRADES + 1).collect())
    if len(grades) > MOST_GRADES:
        raise ValueError(f"more than {MOST_GRADES} grades: give ratings in steps")
    if len(grades) < 2:
        return grades[0] if grades else None
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("quality")), F.lit(1_000_000_000))
    some = ratings.where(draw < int(min(1.0, SAMPLE_ROWS / ratings.count()) * 1_000_000_000)).limit(2 * SAMPLE_ROWS)
    rows = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.join(F.broadcast(some), "doc_id").dropDuplicates(["doc_id", "h"]).select("h", "text", "grade")  # a bounded number of ratings
    many = rows.select("h").count()
    if many > 2 * SAMPLE_ROWS:  # rated ids of many different texts
        rows = rows.where(F.pmod(F.xxhash64("h", F.lit("quality")), F.lit(1_000_000_000)) < int(SAMPLE_ROWS / many * 1_000_000_000))
    step = lambda b: {"h": b.column("h"), "grade": b.column("grade"), **_packed(b)}
    got = map_arrow(rows, step, "h bigint, grade int, keys array<int>, vals array<float>").collect()
    if len({r.grade for r in got}) < 2:
        return grades[0]
    got.sort(key=lambda r: (r.h, r.grade, r["keys"]))
    f = np.concatenate([np.array(r["keys"], np.int64) for r in got]), np.concatenate([np.array(r["vals"], float) for r in got]), np.array([len(r["keys"]) for r in got])
    return Ordinal(grades).fit(f, np.array([grades.index(r.grade) for r in got]))


def _packed(batch) -> dict:
    keys, value, per = features(batch.column("text"))
    at = np.cumsum(per)[:-1]
    return {"keys": [x.tolist() for x in np.split(keys, at)], "vals": [x.tolist() for x in np.split(value, at)]}


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id, expected_grade, tail_prob (of the top grade) and keep (tail_prob of one half or more)."""
    rows = pick(docs, "doc_id", "text")
    kind = dict(rows.dtypes)["doc_id"]
    if not isinstance(model, Ordinal):
        return rows.select("doc_id", F.lit(model).cast("double").alias("expected_grade"), F.lit(1.0).alias("tail_prob"), F.lit(True).alias("keep"))
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def step(batch):
        m = shipped.value
        tails = m.tails(features(batch.column("text")))
        return {"doc_id": batch.column("doc_id"), "expected_grade": m.grades[0] + tails @ np.diff(m.grades), "tail_prob": tails[:, -1], "keep": tails[:, -1] >= 0.5}

    return map_arrow(rows, step, f"doc_id {kind}, expected_grade double, tail_prob double, keep boolean")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def select(docs: DataFrame, ratings: DataFrame, rating: str = "quality") -> DataFrame:
    """doc_id, held_out, expected_grade, tail_prob and keep, learnt from ratings of rows whose crc32(doc_id as text) mod 5 is not 0."""
    seen = pick(ratings, "doc_id", rating).where(~held_out(F.col("doc_id")))
    return score(docs, train(docs, seen, rating)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", "tail_prob", "keep")
