"""Personal data by fixed patterns and a skip-chain conditional random field.

The patterns find e-mail and IP addresses, card and phone numbers. The field labels every token that holds a digit or
an @ (email, ip, card, phone or none). Neighbouring tokens share a chain potential; tokens of one document that repeat
(the same digits, or the same letters and signs), however far apart, share a skip potential with their next repetition.
What the patterns found is observed. A token of the same six digits or more, or of the same whole e-mail address, as a
found one shares a star potential with the first of them, and so do similar ones: numbers in a row whose digits together
are the whole of a found card or phone number, or its last seven digits or more (other spacing, no plus, no country
code). Through these potentials alone, and the messages between tokens, an entity gets one label in the whole document;
with all of them zero the field adds nothing.

An observed end of an edge is evidence for the other end, so messages run between unobserved tokens only, of which each
has four neighbours at most. Chain and skip potentials are fitted within the range in which message passing on such a
graph is a contraction (its strength, tanh of a quarter of the log-odds range, times three neighbours is CONTRACTION), so
messages settle, and a document's stop when none of its own moves by SETTLED. Tokens of a marginal of 0.9 or more become
spans of their own; neighbours of one kind are joined. Spans of the patterns always stay, and no other span overlaps them.

Weights are fitted by pseudo-likelihood to the patterns' labels on a bounded sample of documents, chosen by hash. Half
of the found forms are held back in fitting: they keep their label, but not the features that repeat the pattern's own
test (plus, check sum, four parts, domain), and are mentioned once more, with the shape and surroundings of a token of the
document that was not found, so that repetition alone explains them. Tokens that repeat a found form, but were not found, have no known
label and are left out of the fit. recovered() measures how many such mentions the field labels alike.
Offsets are code points, the end exclusive. Null and empty texts have no spans. Repeated rows get the same result
each. With no training token the field adds nothing. Texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, pick

KINDS = ("email", "ip", "card", "phone")
NONE = len(KINDS)
LABELS = NONE + 1
#: Documents that the weights are fitted to at most, sizes of the tables, and steps.
SAMPLE_ROWS, WIDTH, SURE = 4000, 1 << 12, 0.9
SETTLED, CONTRACTION, NEIGHBOURS = 1e-5, 0.9, 4
#: Digits that the end of a found number must share with other numbers in a row.
ALIKE = 7
_TESTS = ("plus", "domain", "at", "luhn True", "quad True")

# The patterns of the contract; lookbehinds and possessive quantifiers only spare time.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_domain = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+").match
_ip = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++").finditer
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])++").finditer
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
_token = re.compile(r"[0-9@]").search
_candidates = re.compile(r"\S+").finditer
_digit = re.compile(r"[0-9]").search
_not_digit = re.compile(r"[^0-9]+")
_EDGE = " .,;:!?()[]{}<>\"'|`*#"


def luhn(digits: str) -> bool:
    odd = digits[-1::-2]
    even = digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(rank of the kind, start, end) of what the patterns find, by kind, then start."""
    out = []
    end, at = 0, text.find("@")
    floor = 0
    while at >= 0:
        before = text[max(end, floor) : at]
        local = len(before) - len(before.rstrip(_LOCAL))
        m = _domain(text, at + 1) if local else None
        if m:
            out.append((0, at - local, m.end()))
            end = m.end()
        floor = at + 1
        at = text.find("@", max(at + 1, end))
    if not _digit(text):
        return out
    out += [(1, *m.span()) for m in _ip(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    for m in _card(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _phone(text) if 9 <= len(_not_digit.sub("", m[0])) <= 15]
    return out


def _shape(token: str) -> str:
    s = re.sub(r"[^\W\d_]+", "a", token)
    return re.sub(r"[0-9]+", lambda m: str(min(len(m[0]), 20)) + "d", s)[:40]


def nodes(text: str):
    """Tokens with a digit or an @: (start, end without signs at the edges), features, form to compare, place among all tokens."""
    spans, features, forms, places = [], [], [], []
    before, pending, place = "", None, 0
    shapes: list[str] = []
    for m in _candidates(text):
        token = m[0]
        if pending is not None:
            features[pending].append("next " + (_shape(token) if _token(token) else token.lower()[:20]))
            pending = None
        if _token(token):
            core = token.strip(_EDGE)
            a = m.start() + (token.find(core) if core else 0)
            digits = _not_digit.sub("", core)
            shape = _shape(token)
            f = ["bias", "shape " + shape, "core " + _shape(core), f"digits {min(len(digits), 20)}", "before " + before]
            if "@" in core:
                f.append("at")
                if _domain(core, core.find("@") + 1):
                    f.append("domain")
            if token[0] == "+" or core[:1] == "+":
                f.append("plus")
            if 13 <= len(digits) <= 19:
                f.append(f"luhn {luhn(digits)}")
            if re.fullmatch(r"\d+(\.\d+){3}", core):
                f.append(f"quad {all(int(p[-4:]) <= 255 for p in core.split('.'))}")
            spans.append((a, a + len(core)))
            features.append(f)
            forms.append(("d", digits) if len(digits) >= 6 else ("s", core.lower()))
            places.append(place)
            shapes.append(shape)
            pending = len(features) - 1
            before = shape
        else:
            before = token.lower()[:20]
        place += 1
    return spans, features, forms, places


def _strong(form: tuple[str, str], kind: int) -> bool:
    """Whether a repetition of this form of a found token is the same entity: short parts of numbers are not."""
    return "@" in form[1] if kind == 0 else form[0] == "d"


class Graph:
    """Nodes and edges of the fields of several documents.

    given: labels by the patterns. seen: which nodes are observed. known: which have a label to be fitted to.
    star edges lead from an observed node to another.
    """

    def __init__(self, texts: list[str], held_back: int = 0):
        """held_back: of two forms that the patterns found, one (1) or both (2) don't show the pattern's test and are mentioned again."""
        self.text, self.spans, self.given, self.seen, self.known, self.base = [], [], [], [], [], []
        self.mentions: list[int] = []
        rows, cols, chain, skip, star = [], [], [], [], []

        def feature(node: int, names: list[str]) -> None:
            rows.extend([node] * len(names))
            cols.extend(zlib.crc32(x.encode()) % WIDTH for x in names)

        for n, text in enumerate(texts):
            base = base_spans(text) if text else []
            self.base.append(base)
            if not text or not _token(text):
                continue
            spans, features, forms, places = nodes(text)
            first = len(self.spans)
            last: dict = {}
            found: dict = {}  # the first token of each form that the patterns found
            cover = sorted((s, e, k) for k, s, e in base)
            c = 0
            reach = -1  # the widest end so far, as kinds may overlap
            best = NONE
            hidden = []
            for i, ((a, b), f, form) in enumerate(zip(spans, features, forms, strict=True)):
                here = first + i
                while c < len(cover) and cover[c][0] < b:
                    if cover[c][1] > reach:
                        reach, best = cover[c][1], cover[c][2]
                    c += 1
                self.given.append(best if a < reach else NONE)
                if held_back and a < reach and (held_back > 1 or zlib.crc32(form[1].encode()) % 2):
                    f = [x for x in f if x not in _TESTS]
                    hidden.append(i)
                feature(here, f)
                if i and places[i] == places[i - 1] + 1:
                    chain.append((here - 1, here))
                if form in last:
                    skip.append((last[form], here))
                last[form] = here
                if self.given[here] < NONE and _strong(form, self.given[here]):
                    found.setdefault(form, here)
            alike = dict(self._alike(text, first, spans, places, cover))
            for i, form in enumerate(forms):
                here = first + i
                hub = found.get(form, alike.get(here))
                loose = hub is not None and hub != here and self.given[here] == NONE
                if loose or held_back and hub is not None and hub != here:
                    star.append((hub, here))
                self.known.append(not loose)
                self.seen.append(self.given[here] < NONE)
            self.spans += spans
            self.text += [n] * len(spans)
            plain = [i for i in range(len(spans)) if self.given[first + i] == NONE] or range(len(spans))
            for i in hidden:
                hub = found.get(forms[i])
                if hub is None:
                    continue
                other = features[plain[zlib.crc32(forms[i][1].encode()) % len(plain)]]
                here = len(self.spans)
                feature(here, [x for x in other if x not in _TESTS])
                star.append((hub, here))
                self.spans.append(spans[i])
                self.text.append(n)
                self.given.append(self.given[hub])
                self.known.append(True)
                self.seen.append(False)
                self.mentions.append(here)
        self.rows, self.cols = np.array(rows, np.int64), np.array(cols, np.int64)
        beside = set(star)
        skip = [(a, b) for a, b in skip if (a, b) not in beside and (b, a) not in beside]
        self.chain, self.skip, self.star = (np.array(x, np.int64).reshape(-1, 2) for x in (chain, skip, star))
        self.given, self.text = np.array(self.given, np.int64), np.array(self.text, np.int64)
        self.seen, self.known = np.array(self.seen, bool), np.array(self.known, bool)

    def _alike(self, text: str, first: int, spans, places, cover) -> list[tuple[int, int]]:
        """(other token, found token) where the other's digits, with those beside it, end a found card or phone number."""
        ends: dict[str, int] = {}
        starts = [a for a, _ in spans]
        longest = 0
        for a, b, k in cover:
            i = bisect_left(starts, a)
            if KINDS[k] in ("card", "phone") and i < len(spans) and self.given[first + i] < NONE:
                digits = _not_digit.sub("", text[a:b])
                longest = max(longest, len(digits))
                for n in range(ALIKE, len(digits) + 1):
                    ends.setdefault(digits[-n:], first + i)
        out = []
        if ends:
            digits = [_not_digit.sub("", text[a:b]) for a, b in spans]
            for i in range(len(spans)):
                joined = ""
                for j in range(i, len(spans)):  # a token has a digit, so this ends by the longest found number
                    if self.given[first + j] < NONE or not digits[j] or j > i and places[j] != places[j - 1] + 1 or len(joined) + len(digits[j]) > longest:
                        break
                    joined += digits[j]
                    if (hub := ends.get(joined)) is not None:
                        out += [(first + m, hub) for m in range(i, j + 1)]
                        break
        return out

    def unary(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.spans), LABELS))
        np.add.at(out, self.rows, weights[self.cols])
        return out

    def marginals(self, weights, chain, skip, star) -> np.ndarray:
        """Of each node and label, by loopy message passing between what is not observed; an observed node has its label."""
        own = self.unary(weights)
        src, dst, pots = [], [], []
        for edges, pot in ((self.chain, chain), (self.skip, skip), (self.star, star)):
            for a, b, p in ((edges[:, 0], edges[:, 1], pot), (edges[:, 1], edges[:, 0], pot.T)):
                told = self.seen[a]
                np.add.at(own, b[told], p[self.given[a[told]]])
                free = ~self.seen[a] & ~self.seen[b]
                src.append(a[free])
                dst.append(b[free])
                pots.append(np.exp(p))
        passed = self._passed(own, src, dst, pots)
        own[self.seen] = -50.0
        own[self.seen, self.given[self.seen]] = 50.0
        return _softmax(own + passed)

    def _passed(self, own: np.ndarray, src: list, dst: list, pots: list) -> np.ndarray:
        """Sum of the settled messages into each node. Lists by kind of edge, each kind followed by its reverse."""
        total = np.zeros_like(own)
        sizes = [len(s) for s in src]
        ends = np.cumsum([0, *sizes])
        back = np.concatenate([np.arange(ends[k ^ 1], ends[k ^ 1] + n) for k, n in enumerate(sizes)]).astype(np.int64)
        kind = np.repeat(np.arange(len(sizes)), sizes)
        src, dst = np.concatenate(src), np.concatenate(dst)
        document = self.text[src] if len(src) else np.zeros(0, np.int64)
        message = np.zeros((len(src), LABELS))
        while len(src):
            belief = own.copy()
            np.add.at(belief, dst, message)
            out = belief[src] - message[back]
            out = np.exp(out - out.max(1, keepdims=True))
            new = np.empty_like(message)
            for k, p in enumerate(pots):
                of = kind == k
                new[of] = np.log(out[of] @ p)
            new -= new.max(1, keepdims=True)
            moved = np.abs(new - message).max(1)
            message = new
            busy = np.zeros(len(self.base), bool)
            busy[document[moved >= SETTLED]] = True
            going = busy[document]
            if going.sum() <= len(src) // 2:  # documents that have settled leave the loop
                np.add.at(total, dst[~going], message[~going])
                place = np.cumsum(going) - 1
                back = place[back[going]]
                src, dst, kind, document, message = src[going], dst[going], kind[going], document[going], message[going]
        return total


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _contracting(pot: np.ndarray) -> np.ndarray:
    """The potential, scaled down to the range in which messages between unobserved tokens contract."""
    rows = (pot[:, None, :] - pot[None, :, :]).reshape(-1, pot.shape[1])
    odds = (rows.max(1) - rows.min(1)).max()
    most = 4 * np.arctanh(CONTRACTION / (NEIGHBOURS - 1))
    return pot if odds <= most else pot * (most / odds)


def fit(texts: list[str], steps: int = 500, rate: float = 0.2, decay: float = 1e-3):
    """Weights of features, chain, skip and star potentials by pseudo-likelihood (neighbours' labels as given), with Adam."""
    g = Graph(texts, 1)
    params = [np.zeros((WIDTH, LABELS)), *(np.zeros((LABELS, LABELS)) for _ in range(3))]
    n = int(g.known.sum()) if len(g.spans) else 0
    if not n:
        return params
    y = np.eye(LABELS)[g.given]
    known = lambda e: e[g.known[e].all(axis=1)]
    kinds = [known(e) for e in (g.chain, g.skip, g.star)]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    for t in range(1, steps + 1):
        logits = g.unary(params[0])
        for edges, pot, both in zip(kinds, params[1:], (True, True, False), strict=True):
            a, b = edges.T
            np.add.at(logits, b, pot[g.given[a]])
            if both:
                np.add.at(logits, a, pot[:, g.given[b]].T)
        d = (_softmax(logits) - y) / n
        d[~g.known] = 0
        grads = [np.zeros_like(p) for p in params]
        np.add.at(grads[0], g.cols, d[g.rows])
        for grad, edges, both in zip(grads[1:], kinds, (True, True, False), strict=True):
            a, b = edges.T
            np.add.at(grad, g.given[a], d[b])
            if both:
                np.add.at(grad.T, g.given[b], d[a])
        grads[2] = (grads[2] + grads[2].T) / 2  # repetition has no direction
        for p, m, grad in zip(params, moments, grads, strict=True):
            grad = grad + decay / n * p
            m[0] = 0.9 * m[0] + 0.1 * grad
            m[1] = 0.99 * m[1] + 0.01 * grad**2
            p -= rate * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.99**t)) + 1e-8)
        params[1], params[2] = _contracting(params[1]), _contracting(params[2])
    return params


def recovered(texts: list[str], params) -> tuple[int, int, int]:
    """Further mentions of found forms that look like other tokens, those of them that the field labels alike, and labels it gives to other tokens."""
    g = Graph(texts, 2)
    if not len(g.spans):
        return 0, 0, 0
    p = g.marginals(*params)
    best = np.where(p.max(1) >= SURE, p.argmax(1), NONE)
    again = np.array(g.mentions, np.int64)
    others = g.known & (g.given == NONE)
    return len(again), int((best == g.given)[again].sum()), int((best < NONE)[others].sum())


def find(texts: list[str | None], params) -> list[tuple[list, list]]:
    """Spans of the patterns, and those that the field adds, for each text."""
    g = Graph([t or "" for t in texts])
    added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if len(g.spans):
        p = g.marginals(*params)
        best = p.argmax(1)
        for i in np.flatnonzero((best < NONE) & (p.max(1) >= SURE) & (g.given == NONE)).tolist():
            (a, b), k, out = g.spans[i], int(best[i]), added[g.text[i]]
            if b <= a:
                continue
            if out and out[-1][0] == k and not texts[g.text[i]][out[-1][2] : a].strip(" ()-"):
                out[-1] = (k, out[-1][1], b)
            else:
                out.append((k, a, b))
    return [(base, _apart(extra, base)) for base, extra in zip(g.base, added, strict=True)]


def _apart(extra: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those of the spans that overlap none of base, in order."""
    starts = sorted((a, b) for _, a, b in base)
    reach, most = [], -1
    for _, b in starts:
        most = max(most, b)
        reach.append(most)
    out = []
    for k, a, b in sorted(extra):
        i = bisect_left(starts, (b, -1))  # those that start before the span ends
        if not i or reach[i - 1] <= a:
            out.append((k, a, b))
    return out


def train(docs: DataFrame):
    docs = pick(docs, "doc_id", "text")
    share = min(1.0, SAMPLE_ROWS / max(docs.count(), 1))
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("personal")), F.lit(1_000_000_000))
    # by hash, so that a draw beyond twice the size asked for is cut alike in every run
    rows = docs.where((draw < int(share * 1_000_000_000)) & F.col("text").rlike("[0-9@]")).orderBy(draw, "doc_id", "text").select("doc_id", "text").limit(2 * SAMPLE_ROWS).collect()
    return fit([r.text for r in sorted(rows, key=lambda r: (r.doc_id, r.text)) if r.text])


def show(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame, params=None) -> DataFrame:
    """doc_id, counts of the patterns' kinds, base_sha256, spans and n_added for each row."""
    rows = pick(docs, "doc_id", "text")
    shipped = docs.sparkSession.sparkContext.broadcast(train(rows) if params is None else params)

    def step(batch):
        got = find(batch.column("text").to_pylist(), shipped.value)
        out = {"doc_id": batch.column("doc_id"), "base_sha256": [hashlib.sha256(show(b).encode()).hexdigest() for b, _ in got], "spans": [show(sorted(b + x)) for b, x in got], "n_added": [len(x) for _, x in got]}
        return out | {f"n_{k}": [sum(s[0] == i for s in b) for b, _ in got] for i, k in enumerate(KINDS)}

    return map_arrow(rows, step, f"doc_id {dict(rows.dtypes)['doc_id']}, {', '.join(f'n_{k} bigint' for k in KINDS)}, base_sha256 string, spans string, n_added bigint")


def redact_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or union of overlapping spans, replaced by [KIND] of the first."""
    out, end = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"[{KINDS[k].upper()}]"]
        end = max(end, b)
    return "".join(out) + text[end:]


def redact(docs: DataFrame, columns: list[str], params=None) -> DataFrame:
    """The named columns of docs with the spans in text replaced; a null text stays null, n_chars follows the text."""
    rows = pick(docs, *columns)
    shipped = docs.sparkSession.sparkContext.broadcast(train(rows) if params is None else params)

    def step(batch):
        texts = batch.column("text").to_pylist()
        new = [t if t is None else redact_text(t, b + x) for t, (b, x) in zip(texts, find(texts, shipped.value), strict=True)]
        out = {c: batch.column(c) for c in columns} | {"text": new}
        if "n_chars" in columns:
            out["n_chars"] = [old if t is None else len(t) for t, old in zip(new, batch.column("n_chars").to_pylist(), strict=True)]
        return out

    return map_arrow(rows, step, ", ".join(f"{c} {k}" for c, k in rows.dtypes))
