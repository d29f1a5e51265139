"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: density and weight of lexicon words, their nearness to words of the second person, shares of
capitals and of signs, exclamation, and words that turn into lexicon words when look-alike signs are read as letters.
The lexicon is learnt: words whose document frequency among toxic labelled texts exceeds that among the others by far.

Learning uses a bounded sample of labelled rows, chosen by hash; a label above 0 is toxic, documents that repeat an id and
a text count once. The lexicon and the trees are fitted on three quarters of it, the isotonic calibration on the rest. With no labels, or one kind only, each score is the share of toxic labels (0 without any).
A null is an empty text. Repeated rows are scored each. Other columns are ignored. Texts are scored whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textmath as tm
from .common import keep, lengths, map_arrow, pick, release, steps

SAMPLE_ROWS, LEXICON_WORDS = 12_000, 400
TREES, DEPTH, RATE, BINS, LEAST = 80, 3, 0.15, 32, 8
# Words of the second person in the languages at hand.
SECOND_PERSON = ["dein", "deine", "dich", "dir", "du", "eres", "euch", "ihr", "te", "ti", "toi", "ton", "tu", "tus", "usted", "vos", "votre", "vous", "you", "your", "yours", "yourself"]
# Signs that are read as letters.
LOOKALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
FEATURES = ["hits", "density", "weight", "heaviest", "kinds", "near", "capitals", "signs", "shouts", "hidden", "digits", "log_words"]

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_CAPITAL, _DIGIT, _SIGN, _SHOUT = (np.zeros(256, bool) for _ in range(4))
_CAPITAL[65:91] = True
_DIGIT[48:58] = True
_SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_SHOUT[33] = True
_READ = np.arange(256, dtype=np.uint8)
for _a, _b in LOOKALIKE.items():
    _READ[ord(_a)] = ord(_b)
_READABLE = _LETTER.copy()
_READABLE[[ord(a) for a in LOOKALIKE]] = True


def word_hash(words: list[str]) -> np.ndarray:
    data = [w.encode() for w in words]
    ends = np.cumsum([len(d) for d in data], dtype=np.int64)
    return tm.hashes(np.frombuffer(b"".join(data), np.uint8), np.append(0, ends[:-1]).astype(np.int64), ends) if words else np.zeros(0, np.uint64)


def _near(at: np.ndarray, to: np.ndarray, text_at: np.ndarray, text_to: np.ndarray, most: int = 4) -> np.ndarray:
    """Which of the sorted places ``at`` have one of ``to`` within ``most`` in the same text."""
    if not len(to):
        return np.zeros(len(at), bool)
    i = np.searchsorted(to, at)
    out = np.zeros(len(at), bool)
    for j in (np.maximum(i - 1, 0), np.minimum(i, len(to) - 1)):
        out |= (np.abs(to[j] - at) <= most) & (text_to[j] == text_at)
    return out


def features(column, lexicon: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A row for each text; lexicon: sorted word hashes and their weights."""
    data, offsets = tm.buffers(column)
    size = np.maximum(np.diff(offsets), 1)
    share = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask[data])))[offsets])
    low, low_offsets = tm.buffers(tm.lowered(column))
    starts, ends = tm.runs(_LETTER[low], low_offsets)
    words = tm.hashes(low, starts, ends)
    n = np.diff(np.searchsorted(starts, low_offsets))
    text = np.repeat(np.arange(len(n)), n)
    keys, weights = lexicon
    place = np.minimum(np.searchsorted(keys, words), max(len(keys) - 1, 0))
    hit = np.flatnonzero(keys[place] == words) if len(keys) else np.zeros(0, np.int64)
    w, t = weights[place[hit]] if len(keys) else np.zeros(0), text[hit]
    second = np.flatnonzero(np.isin(words, word_hash(SECOND_PERSON)))
    near = _near(hit, second, t, text[second])
    count = np.bincount(t, minlength=len(n))
    heaviest = np.zeros(len(n))
    np.maximum.at(heaviest, t, w)
    kinds = np.bincount(np.unique(t * (len(keys) + 1) + place[hit]) // (len(keys) + 1), minlength=len(n)) if len(hit) else count
    # look-alikes: a run with letters and other readable signs that reads as a lexicon word
    read = _READ[low]
    starts, ends = tm.runs(_READABLE[low], low_offsets)
    plain = np.concatenate(([0], np.cumsum(_LETTER[low])))
    letters = plain[ends] - plain[starts]
    odd = (letters > 0) & (letters < ends - starts)
    starts, ends = starts[odd], ends[odd]
    lit = read[ends - 1] != low[ends - 1] if len(ends) else np.zeros(0, bool)
    hidden = np.zeros(len(n), np.int64)
    for tail in (False, True):  # a closing mark may be one: "idiot!"
        s, e = (starts[lit], ends[lit] - 1) if tail else (starts, ends)
        s, e = s[e > s], e[e > s]
        if len(s) and len(keys):
            changed = np.concatenate(([0], np.cumsum(read != low)))
            ok = changed[e] > changed[s]
            s, e = s[ok], e[ok]
            h = tm.hashes(read, s, e)
            p = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            at = np.searchsorted(low_offsets, s[keys[p] == h], "right") - 1
            hidden += np.bincount(at, minlength=len(n))
    m = np.maximum(n, 1)
    out = [count, count / m, np.bincount(t, w, minlength=len(n)) / m, heaviest, kinds, np.bincount(t[near], minlength=len(n)), share(_CAPITAL) / size, share(_SIGN) / size, share(_SHOUT) / size, hidden, share(_DIGIT) / size, np.log1p(n)]
    return np.stack(out, 1).astype(np.float64)


class Trees:
    """Boosted trees of one depth on binned features, and the calibration of their sums."""

    def __init__(self, x: np.ndarray, y: np.ndarray, calibrate: np.ndarray):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        fit = ~calibrate
        bins = self._bins(x)
        b, t = bins[fit], y[fit].astype(float)
        self.base = float(np.log((t.mean() + 1e-6) / (1 - t.mean() + 1e-6)))
        total = np.full(len(t), self.base)
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-total))
            tree = self._tree(b, t - p, p * (1 - p))
            self.trees.append(tree)
            total += self._values(tree, b)
        raw = self._raw(bins[calibrate])
        order = np.argsort(raw, kind="stable")
        self._isotonic(raw[order], y[calibrate][order].astype(float))

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, "right") for c, v in zip(self.cuts, x.T, strict=True)], 1)

    @staticmethod
    def _tree(b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature and bin of each inner node, by level from the left, and the leaves' values."""
        nodes = 2**DEPTH - 1
        feature, cut, node = np.zeros(nodes, np.int64), np.full(nodes, BINS), np.zeros(len(g), np.int64)
        for level in range(DEPTH):
            first, n = 2**level - 1, 2**level
            best = np.full(n, 1e-9)
            for f in range(b.shape[1]):
                at = (node - first) * (BINS + 1) + b[:, f]
                sums = [np.bincount(at, v, n * (BINS + 1)).reshape(n, -1).cumsum(1) for v in (g, h, np.ones(len(g)))]
                (gl, hl, nl), (ga, ha, na) = sums, (s[:, -1:] for s in sums)
                gain = gl**2 / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga**2 / (ha + 1)
                gain[(nl < LEAST) | (na - nl < LEAST)] = -1
                k = gain.argmax(1)
                better = gain[np.arange(n), k] > best
                best = np.where(better, gain[np.arange(n), k], best)
                feature[first : first + n][better] = f
                cut[first : first + n][better] = k[better]
            node = 2 * node + 1 + (b[np.arange(len(g)), feature[node]] > cut[node])
        leaf = node - nodes
        value = RATE * np.bincount(leaf, g, nodes + 1) / (np.bincount(leaf, h, nodes + 1) + 1)
        return feature, cut, value

    @staticmethod
    def _values(tree, b: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(b), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (b[np.arange(len(b)), feature[node]] > cut[node])
        return value[node - len(feature)]

    def _raw(self, bins: np.ndarray) -> np.ndarray:
        return self.base + sum(self._values(t, bins) for t in self.trees)

    def _isotonic(self, raw: np.ndarray, y: np.ndarray) -> None:
        """Pools neighbours until the means ascend, and those of equal sums."""
        blocks: list[list[float]] = []
        for x, v in zip(raw, y, strict=True):
            blocks.append([v, 1.0, x])
            while len(blocks) > 1 and (blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1] or blocks[-2][2] == blocks[-1][2]):
                v2, n2, x2 = blocks.pop()
                blocks[-1] = [blocks[-1][0] + v2, blocks[-1][1] + n2, x2]
        self.steps = np.array([b[2] for b in blocks])
        self.share = np.array([b[0] / b[1] for b in blocks])

    def score(self, x: np.ndarray) -> np.ndarray:
        """The calibrated chance of label 1; the trees' own order is kept within a step by a hundredth of it."""
        if not len(x):
            return np.zeros(0)
        raw = self._raw(self._bins(x))
        step = self.share[np.minimum(np.searchsorted(self.steps, raw, "left"), len(self.share) - 1)]
        inner = 1 / (1 + np.exp(-raw))
        mixed = 0.99 * step + 0.01 * inner
        # the small part must not carry a score over one half
        return np.where(step >= 0.5, np.maximum(mixed, 0.5), np.minimum(mixed, 0.4999))


def train(docs: DataFrame, labels: DataFrame):
    """(lexicon, trees), or the share of toxic labels where there is nothing to tell apart."""
    labels = pick(labels, "doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    total = labels.count()
    draw = lambda *of: F.pmod(F.xxhash64(*of), F.lit(1_000_000_000))
    share = lambda n: int(min(1.0, SAMPLE_ROWS / max(n, 1)) * 1_000_000_000)
    some = labels.where(draw(F.col("doc_id").cast("string"), F.lit("toxicity")) < share(total)).limit(2 * SAMPLE_ROWS)
    rows = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    sample = rows.join(F.broadcast(some), "doc_id").dropDuplicates(["doc_id", "h"])  # a bounded number of labels
    calibrate = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("calibration")), F.lit(4)) == 0
    sample = keep(sample.withColumn("calibrate", calibrate), "toxicity-sample")
    many = sample.count()
    if many > 2 * SAMPLE_ROWS:  # labelled ids of many different texts
        sample = sample.where(draw("h", F.lit("toxicity")) < share(many))
    sizes = {(r.toxic, r.calibrate): r["count"] for r in sample.groupBy("toxic", "calibrate").count().collect()}
    yes, no = sizes.get((1, False), 0), sizes.get((0, False), 0)
    if min(yes, no) < 8 or not sizes.get((1, True)) or not sizes.get((0, True)):
        return sum(n for (k, _), n in sizes.items() if k) / max(sum(sizes.values()), 1)

    def words(batches):
        import pyarrow as pa

        for batch in batches:
            out, tox = [], []
            for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                low = text.lower().encode()
                a = np.frombuffer(low, np.uint8)
                s, e = tm.runs(_LETTER[a], np.array([0, len(a)]))
                found = {low[i:j] for i, j in zip(s.tolist(), e.tolist(), strict=True)}
                out += [w.decode() for w in found]
                tox += [y] * len(found)
            yield pa.record_batch([pa.array(out, pa.string()), pa.array(tox, pa.int32())], names=["word", "toxic"])

    counts = sample.where(~F.col("calibrate")).select("text", "toxic").mapInArrow(words, "word string, toxic int").groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    ratio = F.log(((F.col("a") + 0.5) / (yes + 1)) / ((F.col("b") + 0.5) / (no + 1)))
    top = counts.withColumn("ratio", ratio).where((F.col("a") >= max(4, yes // 200)) & (F.col("ratio") > 2.0)).orderBy(F.desc(F.col("a") * F.col("ratio")), "word").limit(LEXICON_WORDS).collect()
    keys, weights = word_hash([r.word for r in top]), np.array([r.ratio for r in top], np.float64)
    order = np.argsort(keys)
    lexicon = keys[order], weights[order]
    step = lambda b: {"h": b.column("h"), "x": features(b.column("text"), lexicon).tolist(), "toxic": b.column("toxic"), "calibrate": b.column("calibrate")}
    got = map_arrow(sample.select("h", "text", "toxic", "calibrate"), step, "h bigint, x array<double>, toxic int, calibrate boolean").collect()
    got.sort(key=lambda r: (r.h, r.x, r.toxic))
    return lexicon, Trees(np.array([r.x for r in got]), np.array([r.toxic for r in got]), np.array([r.calibrate for r in got]))


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id, score and predicted for each row."""
    rows = pick(docs, "doc_id", "text")
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def step(batch):
        m = shipped.value
        s = np.full(batch.num_rows, m) if isinstance(m, float) else m[1].score(features(batch.column("text"), m[0]))
        return {"doc_id": batch.column("doc_id"), "score": s, "predicted": (s >= 0.5).astype(np.int32)}

    return map_arrow(rows, step, f"doc_id {dict(rows.dtypes)['doc_id']}, score double, predicted int")


def not_toxic(docs: DataFrame, model, columns: list[str]) -> DataFrame:
    """The rows, with the named columns, that are not predicted toxic."""
    rows = pick(docs, *columns)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        m = shipped.value
        for batch in batches:
            text = batch.column("text")
            for a, b in steps(lengths(text)):
                s = np.full(b - a, m) if isinstance(m, float) else m[1].score(features(text.slice(a, b - a), m[0]))
                yield batch.slice(a, b - a).filter(pa.array(s < 0.5))
            del text, batch
            release()

    return rows.mapInArrow(run, rows.schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted, learnt from labels of rows whose crc32(doc_id as text) mod 5 is not 0."""
    model = train(docs, pick(labels, "doc_id", "toxic").where(~held_out(F.col("doc_id"))))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")

