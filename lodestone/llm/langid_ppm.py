"""Language identification by prediction by partial matching.

Each language has a byte context tree of variable order, up to 3, from a bounded sample of its texts. The code
length of a byte follows from the longest context that the tree has: with an escape of method C (a context that saw n
bytes, d of them different, escapes with d / (n + d)), down to order 0 and then to equal chances of all symbols. The
counts are frozen after training, so each byte's code length is exact and depends on the three bytes before it only:
a table of (context, byte) holds it for all languages. The language of the least total wins; the score is its
posterior under equal priors.

Bytes are lower-cased text in UTF-8. Bytes that training never saw are one symbol. A text that is null or has no
letter is ``und`` with score 0. Ties go to the name that sorts first. With no training rows all rows are ``und``.
Repeated rows are judged each; other columns are ignored; texts are scored whole.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textmath as tm
from .common import lengths, map_arrow, pick, release, steps

ORDER = 3
#: About so many texts, whole, are what a language's tree learns from at most; they are drawn by hash.
SAMPLE_TEXTS = 400
#: Digits of a counted context: 0 stands before a text's first byte, else it is the byte and 1.
BASE = 257
UNKNOWN = "und"
_letter = re.compile(r"[^\W\d_]").search


def _keys(column) -> tuple[np.ndarray, np.ndarray]:
    """Each byte with the ORDER bytes before it as one number, and bytes of each text (count)."""
    data, offsets = tm.buffers(tm.lowered(column))
    counts = np.diff(offsets)
    inner = np.arange(len(data)) - np.repeat(offsets[:-1], counts)
    one = data.astype(np.int64) + 1
    key = one.copy()
    for k in range(1, ORDER + 1):
        before = np.zeros(len(one), np.int64)
        before[k:] = one[: len(one) - k]
        key += np.where(inner >= k, before, 0) * BASE**k
    return key, counts


class ContextTrees:
    """Frozen trees of all languages: symbol of each byte, state of each context, bits of each state and symbol."""

    @classmethod
    def of(cls, samples: dict[str, list[str]]) -> ContextTrees:
        import pyarrow as pa

        return cls({k: np.unique(_keys(pa.array(v, pa.large_string()))[0], return_counts=True) for k, v in samples.items()})

    def __init__(self, counted: dict[str, tuple[np.ndarray, np.ndarray]]):
        """counted: contexts (as _keys() has them) and their counts for each language."""
        self.languages = sorted(counted)
        seen = np.unique(np.concatenate([np.zeros(0, np.int64), *(keys % BASE for keys, _ in counted.values())])) - 1
        self.symbol = np.full(256, len(seen) + 1, np.int32)  # the last symbol: bytes never seen
        self.symbol[seen] = np.arange(1, len(seen) + 1)  # 0 stands before a text's first byte
        n = self.size = len(seen) + 2
        digit = np.concatenate([[0], self.symbol]).astype(np.int64)
        trees = []
        for name in self.languages:
            keys, counts = counted[name]
            own = np.zeros(len(keys), np.int64)
            for k in range(ORDER, -1, -1):
                own = own * n + digit[keys // BASE**k % BASE]
            tree = []
            for order in range(ORDER + 1):
                some, at = np.unique(own % n ** (order + 1), return_inverse=True)
                tree.append((some, np.bincount(at, counts, len(some))))
            trees.append(tree)
        # states: all contexts that some language saw, shorter ones first; 0 is the empty context
        states = [np.unique(np.concatenate([t[order][0] // n for t in trees])) for order in range(ORDER + 1)]
        first = np.cumsum([0, *map(len, states)])
        self.bits = np.empty((int(first[-1]), n, len(trees)), np.float32)
        for lang, tree in enumerate(trees):
            below = np.full((1, n), np.log2(n))
            for order, (keys, counts) in enumerate(tree):
                own = states[order]
                # where this context was never seen, the next shorter one codes without an escape
                table = below.copy() if not order else below[self._place(states[order - 1], own % n ** (order - 1) if order > 1 else own * 0)].copy()
                row = np.searchsorted(own, keys // n)
                total, different = np.bincount(row, counts, len(own)), np.bincount(row, minlength=len(own))
                there = total > 0
                table[there] += -np.log2(different[there] / (total[there] + different[there]))[:, None]
                table[row, keys % n] = -np.log2(counts / (total[row] + different[row]))
                self.bits[first[order] : first[order + 1], :, lang] = table
                below = table
        # state of each triple of symbols: its longest known ending
        self.state = np.zeros(n**ORDER, np.int32)
        triple = np.arange(n**ORDER, dtype=np.int64)
        for order in range(1, ORDER + 1):
            ending = triple % n**order
            at = np.minimum(np.searchsorted(states[order], ending), len(states[order]) - 1)
            hit = states[order][at] == ending
            self.state[hit] = first[order] + at[hit]

    @staticmethod
    def _place(states: np.ndarray, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(states, keys)

    def code_lengths(self, column) -> np.ndarray:
        """Bits of each text in each language."""
        data, offsets = tm.buffers(tm.lowered(column))
        counts = np.diff(offsets)
        s = self.symbol[data]
        n = self.size
        before = []
        for k in range(1, ORDER + 1):
            b = np.zeros(len(s), np.int32)
            b[k:] = s[:-k]
            # nothing stands before a text's first byte
            starts = offsets[:-1][counts > 0]
            for j in range(k):
                at = starts + j
                at = at[at < len(s)]
                at = at[np.searchsorted(offsets, at, "right") - 1 == np.searchsorted(offsets, at - j, "right") - 1]
                b[at] = 0
            before.append(b)
        context = (before[2] * n + before[1]) * n + before[0]
        flat = self.bits.reshape(-1, len(self.languages))
        place = self.state[context].astype(np.int64) * n + s
        return np.stack([tm.segment_reduce(np.add, flat[place, k].astype(np.float64), counts, 0.0) for k in range(len(self.languages))], 1)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ContextTrees | None:
    """Trees from a sample of the rows whose language is given; the sample is chosen by hash of the id."""
    rows = pick(docs, id_col, text_col, lang_col).toDF("doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language")), F.lit(1_000_000_000))
    some = F.lit(False)
    for lang, n in counts.items():
        some = some | ((F.col("lang") == lang) & (draw < int(min(1.0, SAMPLE_TEXTS / n) * 1_000_000_000)))

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b in steps(lengths(batch.column("text"))):
                part = batch.slice(a, b - a)
                names = np.array(part.column("lang").to_pylist(), object)
                keys, per = _keys(part.column("text"))
                of = np.repeat(names, per)
                for name in sorted(set(names)):
                    k, n = np.unique(keys[of == name], return_counts=True)
                    yield pa.record_batch([pa.array([name] * len(k), pa.string()), pa.array(k), pa.array(n)], names=["lang", "context", "n"])
            release()

    # a row for each context of ORDER bytes and its byte: as many as a language's spelling has, however long the texts
    rows = rows.where(some).select("lang", "text").mapInArrow(count, "lang string, context bigint, n bigint").groupBy("lang", "context").agg(F.sum("n").alias("n"))
    counted: dict[str, list[tuple[int, int]]] = {}
    for r in rows.collect():
        counted.setdefault(r.lang, []).append((r.context, r.n))
    return ContextTrees({k: tuple(np.array(sorted(v), np.int64).T) for k, v in counted.items()}) if counted else None


def predict(docs: DataFrame, trees: ContextTrees | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score for each row."""
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text")
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double"
    if trees is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shipped = docs.sparkSession.sparkContext.broadcast(trees)

    def step(batch):
        t = shipped.value
        bits = t.code_lengths(batch.column("text"))
        best = bits.argmin(1)
        share = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
        known = [bool(x and _letter(x)) for x in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "lang_pred": [t.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], "score": [float(x) if k else 0.0 for x, k in zip(share, known, strict=True)]}

    return map_arrow(rows, step, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score, learnt from rows whose crc32(doc_id as text) mod 4 is not 2."""
    held = (F.crc32(F.col("doc_id").cast("string")) % 4) == 2
    rows = pick(docs, "doc_id", "text", "lang")
    trees = train(rows.where(~held))
    return predict(rows, trees).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")
