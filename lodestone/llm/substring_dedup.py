"""Removal of passages that repeat: every word inside a window of WINDOW words that also starts anywhere else.

A word is a longest run of characters other than space and U+0009..U+000D, unchanged. All windows are judged on the
input. Three passes over the texts:

1. Each partition counts windows in a count-min sketch, and the sketches are merged by a grouped shuffle. A window is
   counted through its anchor: the least hash of its runs of ANCHOR words. Windows of the same words have the same
   anchor at the same place within them, so two starts of a window are two occurrences of its anchor, and the least
   cell of the anchor is never below the window's count. Neighbouring windows share anchors: a tenth of the places is
   counted. Counts stop at two, which is all that is asked of them; only which cells have two is sent to the tasks.
2. Only windows that the sketch takes for repeated are grouped exactly, by a 128-bit hash of all their words. The counts
   are added up before the shuffle, so a passage in a third of all rows is one row from each task. What comes out are
   the windows that the sketch was wrong about: each has one start, and is listed for its row.
3. Each row again: windows that the sketch takes for repeated, less its listed ones, cover the words that go.

The sketch has DEPTH rows of cells, as many as the bytes of all texts / 8 (a power of two from LEAST_CELLS to
MOST_CELLS, which bounds what is broadcast: DEPTH * MOST_CELLS / 8 bytes). Where texts outgrow it, more windows go through
the exact pass, and the result is the same.

Rows: null and empty texts have no words. Texts of fewer words than a window keep all. Repeated rows are other places
of the same windows, so their windows all go. Windows never cross rows, but may overlap themselves within one
("a a a ..." goes from WINDOW + 1 words on). Other columns, also of clashing names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, lengths, map_arrow, pick, release, steps
from .textmath import buffers, hashes, mix, runs

WINDOW, ANCHOR = 35, 16
DEPTH, LEAST_CELLS, MOST_CELLS = 2, 1 << 20, 1 << 29
#: Cells of a block, the unit in which sketches are merged.
BLOCK = 1 << 16

_WORD = np.ones(256, bool)
_WORD[[32, *range(9, 14)]] = False
_rng = np.random.default_rng(7)
_ODD = _rng.integers(0, 2**63, (2, 8, 3), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEED = _rng.integers(0, 2**64, DEPTH, dtype=np.uint64)


def _words(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, start and end of each word, and words of each text (count)."""
    data, offsets = buffers(column)
    starts, ends = runs(_WORD[data], offsets)
    return data, starts, ends, np.diff(np.searchsorted(starts, offsets))


def _row_hashes(h: np.ndarray, n: int, kind: int) -> np.ndarray:
    """Hash of each n words in a row, by runs of 1, 2, 4, ... words."""
    out, covered, run, size = None, 0, h, 1
    for level in range(n.bit_length()):
        a, b, c = _ODD[kind, level]
        if n & size:
            out = run if out is None else out[: len(run) - covered] * c + run[covered:]
            covered += size
        if size * 2 <= n:
            run = mix(run[:-size] * a + run[size:] * b)
            size *= 2
    return mix(out)


def _slide(f: np.ufunc, x: np.ndarray, n: int) -> np.ndarray:
    """f over each n values in a row."""
    size = 1
    while size * 2 <= n:
        x = f(x[:-size], x[size:])
        size *= 2
    return f(x[: len(x) - (n - size)], x[n - size :]) if size < n else x


class Windows:
    """The windows of a step's texts: valid (starts of windows among all words), anchor of each, and text of each word."""

    def __init__(self, column) -> None:
        self.data, self.starts, self.ends, self.counts = _words(column)
        self.text = np.repeat(np.arange(len(self.counts)), self.counts)
        n = len(self.starts)
        self.valid = np.zeros(0, np.int64)
        if n < WINDOW:
            return
        self.valid = np.flatnonzero(self.text[WINDOW - 1 :] == self.text[: n - WINDOW + 1])
        self.hashes = hashes(self.data, self.starts, self.ends)
        self._grams = _row_hashes(self.hashes, ANCHOR, 0) | np.uint64(1)  # never 0
        self._least = _slide(np.minimum, self._grams, WINDOW - ANCHOR + 1)

    def anchors(self) -> np.ndarray:
        """Hash of each place that is the anchor of a window."""
        if not len(self.valid):
            return np.zeros(0, np.uint64)
        width = WINDOW - ANCHOR + 1
        padded = np.zeros(len(self._least) + 2 * (width - 1), np.uint64)
        padded[self.valid + width - 1] = self._least[self.valid]
        return self._grams[_slide(np.maximum, padded, width) == self._grams]

    def repeated(self, sketch: np.ndarray) -> np.ndarray:
        """Starts of the windows whose anchor has two in all of the sketch's cells."""
        if not len(self.valid):
            return self.valid
        least = self._least[self.valid]
        change = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
        return self.valid[np.repeat(_twice(sketch, least[change]), np.diff(np.append(change, len(least))))]

    def exact(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of hash of the windows that start there."""
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        second = mix(self.hashes * _ODD[1, 7, 0])
        return tuple(_row_hashes(h, WINDOW, kind)[at].view(np.int64) for kind, h in enumerate((self.hashes, second)))

    def first_word(self) -> np.ndarray:
        """Of each text: the place of its first word among all words."""
        return np.concatenate(([0], np.cumsum(self.counts)[:-1])).astype(np.int64)

    def without(self, at: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """Words of each text that the windows starting there cover, and the other words, joined by spaces."""
        n, texts = len(self.starts), len(self.counts)
        edge = np.zeros(n + WINDOW + 1, np.int32)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + WINDOW, -1)
        kept = np.flatnonzero(np.cumsum(edge)[:n] == 0)
        text = self.text[kept]
        starts, size = self.starts[kept], self.ends[kept] - self.starts[kept]
        spaced = np.append(text[1:] == text[:-1], False) if len(kept) else np.zeros(0, bool)
        taken = size + spaced
        end = np.cumsum(taken)
        total = int(end[-1]) if len(end) else 0
        out = np.append(self.data, np.uint8(32))[np.arange(total) + np.repeat(starts - (end - taken), taken)]
        out[(end - 1)[spaced]] = 32
        per_text = np.bincount(text, minlength=texts)
        ends = np.append(0, end)[np.append(0, np.cumsum(per_text))].astype(np.int64)
        joined = pa.LargeStringArray.from_buffers(texts, pa.py_buffer(ends.tobytes()), pa.py_buffer(out.tobytes()))
        return self.counts - per_text, joined.cast(pa.string())


def _cells(anchors: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (mix(anchors ^ _SEED[row]) & np.uint64(cells - 1)).astype(np.int64) + row * cells


def _twice(sketch: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Whether all cells of each anchor have two."""
    out, cells = np.ones(len(anchors), bool), len(sketch) * 8 // DEPTH
    for row in range(DEPTH):
        at = _cells(anchors, row, cells)
        out &= (sketch[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return out


def _packed(cells: np.ndarray) -> bytes:
    """Cells of a block as 16-bit numbers, or as bits where that is shorter."""
    if len(cells) * 2 < BLOCK // 8:
        return cells.astype(np.uint16).tobytes()
    bits = np.zeros(BLOCK, np.uint8)
    bits[cells] = 1
    return np.packbits(bits).tobytes()


def _add(count: np.ndarray, packed: bytes) -> None:
    if len(packed) == BLOCK // 8:
        count += np.unpackbits(np.frombuffer(packed, np.uint8))
    else:
        count[np.frombuffer(packed, np.uint16)] += 1


def _partial(cells: int):
    """A partition's sketch, by blocks: which cells have one, and which have two or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = []
        for batch in batches:
            for a, b in steps(lengths(batch.column("text"))):
                anchors.append(Windows(batch.slice(a, b - a).column("text")).anchors())
            del batch
            release()
        anchors = np.concatenate(anchors) if anchors else np.zeros(0, np.uint64)
        for row in range(DEPTH):
            at, n = np.unique(_cells(anchors, row, cells), return_counts=True)
            blocks, first = np.unique(at // BLOCK, return_index=True)
            inner, twice = at % BLOCK, n > 1
            ends = np.append(first[1:], len(at))
            for i in range(0, len(blocks), 256):
                some = [(_packed(inner[a:b]), _packed(inner[a:b][twice[a:b]])) for a, b in zip(first[i : i + 256], ends[i : i + 256], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(blocks[i : i + 256]), pa.array([s[0] for s in some], pa.binary()), pa.array([s[1] for s in some], pa.binary())], ["block", "one", "two"])

    return run


def _merge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count, block = np.zeros(BLOCK, np.uint8), None
    for part in parts:
        block = part.column("block")[0].as_py()
        for name in ("one", "two"):
            for packed in part.column(name).to_pylist():
                _add(count, packed)
                np.minimum(count, 2, out=count)
    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.packbits(count > 1).tobytes()], pa.binary())], ["block", "bits"])


def sketch(docs: DataFrame, most_cells: int = MOST_CELLS) -> np.ndarray:
    """Bits of the merged sketch's cells that have two or more, of the texts of docs."""
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    cells = min(max(LEAST_CELLS, 1 << (int(total) // 8).bit_length()), max(most_cells, BLOCK))
    merged = docs.select("text").mapInArrow(_partial(cells), "block long, one binary, two binary").groupBy("block").applyInArrow(_merge, "block long, bits binary")
    out = np.zeros((DEPTH * cells // BLOCK, BLOCK // 8), np.uint8)
    got = merged.toArrow()
    for at, bits in zip(got.column("block").to_pylist(), got.column("bits").to_pylist(), strict=True):
        out[at] = np.frombuffer(bits, np.uint8)
    return out.ravel()


def dedup(docs: DataFrame, most_cells: int = MOST_CELLS) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by spaces) of each row of docs."""
    docs = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64(F.lit(1), "doc_id", "text")})
    bits = docs.sparkSession.sparkContext.broadcast(sketch(docs, most_cells))

    def candidates(batch):
        w = Windows(batch.column("text"))
        at = w.repeated(bits.value)
        text = w.text[at]
        h1, h2 = w.exact(at)
        k1, k2 = (batch.column(c).to_numpy()[text] for c in ("k1", "k2"))
        return {"h1": h1, "h2": h2, "k1": k1, "k2": k2, "at": (at - w.first_word()[text]).astype(np.int32)}

    found = map_arrow(docs.select("k1", "k2", "text"), candidates, "h1 long, h2 long, k1 long, k2 long, at int")
    once = found.groupBy("h1", "h2").agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in ("k1", "k2", "at")]).where("n = 1")
    once = keep(once.groupBy("k1", "k2").agg(F.collect_list("at").alias("once")), "single-windows")

    def rest(batch):
        w = Windows(batch.column("text"))
        listed = batch.column("once")
        at = w.repeated(bits.value)
        single = listed.flatten().to_numpy() + np.repeat(w.first_word(), _sizes(listed))
        removed, kept = w.without(at[~np.isin(at, single)])
        return {"doc_id": batch.column("doc_id"), "n_words": w.counts, "n_removed": removed, "kept": kept}

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept string"
    return map_arrow(docs.join(once, ["k1", "k2"], "left").select("doc_id", "text", "once"), rest, schema)


def _sizes(lists) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy()


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row of docs."""
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
