"""Requests with their limits, query reformulation and configuration; all on the driver."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field

# Limits of a request.
MOST_TOP_K, MOST_QUERY, MOST_PREFIX, MOST_PATHS = 200, 2000, 500, 100
MODES, KINDS = ("semantic", "fts", "regex", "hybrid"), ("code", "docs", "any")


@dataclass
class Search:
    query: str
    mode: str = "hybrid"
    top_k: int = 20
    path_prefix: str = ""
    chunk_kind: str = "any"
    min_score: float | None = None
    file_cap: int | None = None
    weights: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        check(0 < len(self.query) <= MOST_QUERY, f"query must have 1 to {MOST_QUERY} characters")
        check(self.mode in MODES, f"mode must be one of {MODES}")
        check(1 <= self.top_k <= MOST_TOP_K, f"top_k must be 1 to {MOST_TOP_K}")
        check(len(self.path_prefix) <= MOST_PREFIX, f"path_prefix must have {MOST_PREFIX} characters at most")
        check(self.chunk_kind in KINDS, f"chunk_kind must be one of {KINDS}")
        check(self.file_cap is None or self.file_cap > 0, "file_cap must be positive")
        check(all(w >= 0 for w in self.weights.values()), "weights must not be negative")
        if self.mode == "regex":
            try:
                re.compile(self.query)
            except re.error as e:
                raise ValueError(f"bad pattern: {e}") from e


def check(ok: bool, why: str) -> None:
    if not ok:
        raise ValueError(why)


def identifiers(text: str, most: int = 20) -> list[str]:
    """Names in a text: paths and dotted names, constants, names with underscores and of mixed case, each at its longest.

    Abbreviations (e.g) and numbers with points (3.10) are no names.
    """
    segment = r"[A-Za-z0-9_-]+"
    pattern = rf"\b{segment}(?:(?:::|[./]){segment})+|\b[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)+|\b[a-z]+[A-Z]\w*|\b[A-Z][a-z0-9]+[A-Z]\w*"

    def is_name(found: str) -> bool:
        parts = re.split(r"::|[./]", found)
        return len(parts) == 1 or not (all(len(p) == 1 and p.isalpha() for p in parts) or all(p.isdigit() for p in parts))

    return list(dict.fromkeys(filter(is_name, re.findall(pattern, text))))[:most]


def augmented(query: str, budget: int = MOST_QUERY) -> str:
    """The query with its names once more behind it, as far as the budget allows."""
    out = query
    for name in identifiers(query):
        for part in (name, *re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)):
            if len(part) > 1 and len(out) + 1 + len(part) <= budget and f" {part}" not in f" {out}":
                out += f" {part}"
    return out


def fan_out(query: str, groups: dict[str, list[str]]) -> tuple[str, list[str]]:
    """'@group query' to the query and the group's paths; raises ValueError for a group that isn't known."""
    m = re.match(r"@(\S+)\s+(.*)", query, re.S)
    if not m:
        return query, []
    check(m[1] in groups, f"no group {m[1]!r}; known: {', '.join(sorted(groups))}")
    return m[2], groups[m[1]]


def config(paths: list[str]) -> tuple[dict, list[str]]:
    """The first of the files that can be read as a JSON object, and what was wrong with those before it."""
    problems = []
    for p in paths:
        if not os.path.exists(p):
            continue
        try:
            with open(p, encoding="utf-8") as f:
                got = json.load(f)
            check(isinstance(got, dict), "not an object")
            return got, problems
        except (OSError, ValueError) as e:
            problems.append(f"{p}: {e}")
    return {}, problems


# Subjects with one of these tell of no feature.
SKIPPED_SUBJECTS = ("nfc", "revert", "reformat", "clang-format", "typo", "whitespace", "rename", "bump", "regenerate")


def commit_gold(log: str, known: dict[str, str], least: int = 2, most: int = 20, several_languages: bool = False) -> list[dict]:
    """Commits of `git log --no-merges --numstat --format=commit:%H:%s` as queries with the files they touch and these files' languages.

    known: language by extension. Commits of too few or too many files of known extensions are left out, and, if asked for,
    those of one language.
    """
    commits: list[dict] = []
    for line in log.splitlines():
        if line.startswith("commit:"):
            _, sha, subject = line.split(":", 2)
            commits.append({"sha": sha, "query": subject, "gold_files": [], "languages": set()})
        elif commits and (m := re.match(r"(?:\d+|-)\t(?:\d+|-)\t(.+)", line)) and (language := known.get(os.path.splitext(m[1])[1].lower())):
            commits[-1]["gold_files"].append(m[1])
            commits[-1]["languages"].add(language)
    told = (c for c in commits if not any(w in c["query"].lower() for w in SKIPPED_SUBJECTS))
    return [c | {"gold_files": sorted(c["gold_files"]), "languages": sorted(c["languages"])} for c in told if least <= len(c["gold_files"]) <= most and len(c["languages"]) > int(several_languages)]


#: Edge weights for exploring: typed edges first.
EXPLORE = {"calls": 8.0, "imports": 8.0, "inherits": 8.0, "xlang": 8.0, "associated": 1.0, "mentions": 1.0}


def embed_timeout(n_texts: int) -> float:
    """Seconds that a batch of texts may take: one for each, 120 at least and 900 at most."""
    return float(min(max(120, n_texts), 900))


def worth_a_retry(status: int | None) -> bool:
    """Whether a service's answer may differ next time: no answer, or an error on its side."""
    return status is None or status >= 500


def without_meta(text: str, markers: tuple[str, ...] = ("## Meta", "## Notes", "---")) -> str:
    """The text up to a closing section about itself, if one starts in its last two fifths."""
    cuts = [i for i in (text.rfind("\n" + m) for m in markers) if i >= 0.6 * len(text)]
    return text[: min(cuts)].rstrip() if cuts else text


class Projects:
    """Engines of named projects, opened when first asked for."""

    def __init__(self, folders: dict[str, str], open_):
        self.folders, self.open, self.engines = folders, open_, {}

    def get(self, name: str | None = None):
        if name is None and len(self.folders) == 1:
            name = next(iter(self.folders))
        check(name in self.folders, f"no project {name!r}; known: {', '.join(sorted(self.folders))}")
        if name not in self.engines:
            self.engines[name] = self.open(self.folders[name])
        return self.engines[name]
