"""SentencePiece encoding and decoding by a table of each prefix's last token (merge-type models).

In a merge-type model the encoding of a text's prefix ends with one token that no longer text behind it alters
once the prefix's own end is a token end. So one pass finds, for each prefix, the one vocabulary match that ends
there and goes with the last token of the prefix before it; the ids are then read off backwards.

* Matches come from an Aho-Corasick automaton over the reachable tokens, one pass over the new words of a batch. Words
  that a worker remembers are not encoded again.
* Two tokens go together if undoing their merges along the seam, latest first, never shows a pair that would have
  merged across the seam earlier.
* Runs of the space mark merge after everything else and from the left, so they are cut off by rule.
* A character outside the vocabulary is spelt in byte tokens, and nothing merges across it.

Null and empty texts have no ids and decode to the empty text. Repeated rows are encoded each. Other columns
are ignored. Texts are encoded whole, at any length.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

from pyspark.sql import DataFrame

from .common import map_arrow, pick

MARK = "▁"
#: A worker remembers this many encoded units, and as many of the time before.
MEMORY = 100_000
#: Units in one pass of the automaton.
AT_ONCE = 4096
FOREVER = 1 << 60
#: Stands between units in one pass of the automaton; no token of a supported model holds it.
GAP = "\0"


class PrefixTable:
    """The tables of one model file, and encode() and decode() over them."""

    def __init__(self, model: bytes):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        spec, norm = proto.trainer_spec, proto.normalizer_spec
        if spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces):
            raise ValueError("only BPE models without text normalisation are supported")
        self.unk = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        usual = [(i, p.piece, p.score) for i, p in enumerate(proto.pieces) if p.type == 1]
        self.runs = {len(s): i for i, s, _ in usual if len(s) > 1 and not s.strip(MARK)}
        merged = [(i, s, x) for i, s, x in usual if not (len(s) > 1 and not s.strip(MARK))]
        scores = [x for _, s, x in merged if len(s) > 1]
        run_scores = [x for i, s, x in usual if i in self.runs.values()]
        if any(MARK in s[1:] for _, s, _ in merged) or len(set(scores)) < len(scores) or run_scores and (len(set(run_scores)) > 1 or max(run_scores) >= min(scores)):
            raise ValueError("the space marks of this model's tokens, or its scores, are not of the supported form")
        self.longest_run = max(self.runs, default=1)
        self.runs[1] = next(i for i, s, _ in merged if s == MARK)
        self.rest = [self._run(n) for n in range(self.longest_run)]
        if any(self._run(self.longest_run * m + n) != [self.runs[self.longest_run]] * m + r for m in (1, 2) for n, r in enumerate(self.rest)):
            raise ValueError("runs of space marks don't repeat in this model")
        rank = {i: 0 if len(s) == 1 else r + 1 for r, (i, s, _) in enumerate(sorted(merged, key=lambda t: -t[2]))}
        self.rank = [rank.get(i, FOREVER) for i in range(len(proto.pieces))]
        self.left, self.right = [-1] * len(self.rank), [-1] * len(self.rank)
        self.piece = [p.piece for p in proto.pieces]
        self.join: dict[tuple[int, int], int] = {}
        self._reach(sorted(merged, key=lambda t: rank[t[0]]))
        self.automaton = ahocorasick.Automaton()
        for s, i in self.id.items():
            if len(s) > 1:
                self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        self.known = {s for s in self.id if len(s) == 1}
        if any(GAP in x for x in self.id):
            raise ValueError("a token of this model holds the character that stands between units")
        self.size = [len(p) for p in self.piece]
        self.lone = {GAP: -1, **{s: i for s, i in self.id.items() if len(s) == 1}}.__getitem__
        self.paired: list[dict[int, bool] | None] = [None] * len(self.piece)
        self.tested = 0
        self.spelling = [b""] * len(self.piece)
        for i, s in enumerate(self.piece):
            self.spelling[i] = s.replace(MARK, " ").encode()
        for b, i in self.byte_ids.items():
            self.spelling[i] = bytes([b])
        for i, p in enumerate(proto.pieces):
            if p.type == 3:
                self.spelling[i] = b""
            elif p.type == 2:
                self.spelling[i] = spec.unk_surface.encode()
        self.text_id = [str(i) for i in range(len(self.piece))]
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.cut = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall

    def _run(self, n: int) -> list[int]:
        """Ids of n space marks by merging as the model does: all merges rank alike, so the leftmost goes first."""
        parts = [1] * n
        while (i := next((i for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in self.runs), -1)) >= 0:
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.runs[x] for x in parts]

    def _reach(self, merged: list) -> None:
        """Tokens that merging can make, with the two parts of their last merge; in order of rank, so parts come first."""
        self.id: dict[str, int] = {}
        spelt: dict[str, int] = {s: i for i, s, _ in merged}
        for i, s, _ in merged:
            if len(s) == 1:
                self.id[s] = i
                continue
            for c in range(1, len(s)):
                a, b = self.id.get(s[:c]), self.id.get(s[c:])
                if a is not None and b is not None and self._apart(a, b, spelt, self.rank[i]):
                    self.left[i], self.right[i], self.id[s] = a, b, i
                    break
        self.join = {(a, b): self.rank[self.id[x]] for s, i in self.id.items() for x, a, b in self._joins(s)}

    def _joins(self, s: str):
        for c in range(1, len(s)):
            a, b = self.id.get(s[:c]), self.id.get(s[c:])
            if a is not None and b is not None:
                yield s, a, b

    def _apart(self, a: int, b: int, spelt: dict[str, int] | None = None, limit: int = FOREVER) -> bool:
        """Whether a and b, side by side, are both made before any merge across their seam of a rank under ``limit``."""
        rank, left, right = self.rank, self.left, self.right
        while True:
            if spelt is None:
                across = self.join.get((a, b), FOREVER)
            else:
                t = spelt.get(self.piece[a] + self.piece[b])
                across = FOREVER if t is None else rank[t]
            if across < limit:
                return False
            if left[a] < 0 and left[b] < 0:
                return True
            # undo the later of the two merges; of the two, the left one ran first when ranks are equal
            if rank[a] > rank[b]:
                limit, a = rank[a], right[a]
            else:
                limit, b = rank[b] + 1, left[b]

    def _units(self, units: list[str]) -> list[list[int]]:
        """Ids of many units of known characters, none empty and without runs of the space mark.

        One pass of the automaton over all of them yields the tokens of two or more characters that end at each place,
        the longest first. The prefix table keeps the first that stands at the unit's start or goes with the last token
        of the prefix before it; where none does, the character's own token is the last one.
        """
        text = GAP + GAP.join(units)
        last = [*map(self.lone, text)]  # token that ends the prefix up to each place; -1 for the empty prefix
        ends, at = [], 0
        for u in units:
            at += len(u) + 1
            ends.append(at - 1)
        paired, size, done = self.paired, self.size, 0
        if self.tested > 300_000:
            paired[:], self.tested = [None] * len(paired), 0
        for end, t in self.automaton.iter(text):
            if end != done:
                before = last[end - size[t]]
                if before >= 0:
                    row = paired[before]
                    if row is None:
                        row = paired[before] = {}
                    ok = row.get(t)
                    if ok is None:
                        ok = row[t] = self._apart(before, t)
                        self.tested += 1
                    if ok:
                        last[end], done = t, end
                else:
                    last[end], done = t, end
        out = []
        for end in ends:
            ids = []
            while (t := last[end]) >= 0:
                ids.append(t)
                end -= size[t]
            ids.reverse()
            out.append(ids)
        return out

    def _unit(self, unit: str) -> tuple[int, ...]:
        marks = len(unit) - len(unit.lstrip(MARK))
        body = unit[marks - 1 :] if marks else unit
        ids: list[int] = []
        a = 0
        if not self.known.issuperset(body):
            for b, c in enumerate(body):
                if c not in self.known:
                    if b > a:
                        ids += self._units([body[a:b]])[0]
                    spelt = [self.byte_ids.get(x) for x in c.encode()]
                    ids += spelt if None not in spelt else [self.unk]
                    a = b + 1
        if a < len(body):
            ids += self._units([body[a:]])[0]
        if marks > 1:
            free = ids[0] == self.runs[1]
            n = marks if free else marks - 1
            full, rest = divmod(n, self.longest_run)
            ids = [self.runs[self.longest_run]] * full + self.rest[rest] + ids[free:]
        return tuple(ids)

    def _learn(self, words: set[str]) -> None:
        """Puts the ids of all words into the younger memory. A word that begins with NUL has no space mark before it."""
        if len(self.young) >= MEMORY:
            self.old, self.young = self.young, {}
        plain, places = [], []
        for w in words - self.young.keys():
            got = self.old.get(w)
            if got is None:
                u = w[1:] if w[:1] == "\0" else w if w == "\n" else MARK + w
                if u and self.known.issuperset(u):
                    plain.append(u)
                    places.append(w)
                else:
                    self.young[w] = self._unit(u) if u else ()
            else:
                self.young[w] = got
        for a in range(0, len(plain), AT_ONCE):
            for w, ids in zip(places[a : a + AT_ONCE], self._units(plain[a : a + AT_ONCE])):
                self.young[w] = tuple(ids)

    def encode_all(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; words that several texts share are encoded once."""
        split = []
        for text in texts:
            if not text or "  " in text or text[0] == " " or MARK in text or "\0" in text or "\n" in self.known:
                split.append(None)
            else:
                split.append(text.replace("\n", " \n \0").split(" "))
        self._learn(set(chain.from_iterable(w for w in split if w)))
        get = self.young.__getitem__
        return [self.encode(t) if w is None else list(chain.from_iterable(map(get, w))) for t, w in zip(texts, split)]

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        if text:
            for unit in self.cut(MARK + text.replace(" ", MARK)):
                ids += self._unit(unit)
        return ids

    def decode(self, ids: list[int]) -> str:
        out = b"".join(map(self.spelling.__getitem__, ids))
        if ids and out[:1] == b" " and self.piece[ids[0]][:1] == MARK:
            out = out[1:]
        return out.decode("utf-8", "replace")


_tables: dict[str, PrefixTable] = {}


def prefix_table(model: bytes) -> PrefixTable:
    """One table for each model and process; it takes about a second to build."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _tables:
        _tables[key] = PrefixTable(model)
    return _tables[key]


def encode(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 for each row, with the ids and the decoded text where ``ids`` is set."""
    shipped = df.sparkSession.sparkContext.broadcast(model)
    kind = dict(df.dtypes)[id_col] if id_col in df.columns else "bigint"
    more = ", ids array<int>, decoded string" if ids else ""

    def step(batch):
        t = prefix_table(shipped.value)
        sha, text_id = hashlib.sha256, t.text_id.__getitem__
        n, a, b, all_ids, texts = [], [], [], [], []
        for got in t.encode_all(batch.column("text").to_pylist()):
            back = t.decode(got)
            n.append(len(got))
            a.append(sha(",".join(map(text_id, got)).encode()).hexdigest())
            b.append(sha(back.encode()).hexdigest())
            if ids:
                all_ids.append(got)
                texts.append(back)
        return {"doc_id": batch.column("doc_id"), "n_tokens": n, "ids_sha256": a, "decoded_sha256": b, "ids": all_ids, "decoded": texts}

    rows = pick(df, id_col, text_col).toDF("doc_id", "text")
    return map_arrow(rows, step, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}")
