"""Cutting files into size-bounded chunks, one file at a time: Markdown sections, definitions of Python and of languages
with braces, else runs of lines.

A segmenter is a function of (text, path) that yields segments; register() adds one for an extension.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from . import braces

TARGET_CHARS, LEAST_BYTES, MOST_BYTES, OVERLAP = 4500, 300, 6000, 5
MOST_NAMES, MOST_VARIANTS, LEAST_LITERAL = 200, 8, 6
SCHEMA = "path string, language string, chunk_type string, name string, start_line int, end_line int, content string, calls array<struct<name:string,receiver:string,arity:int>>, imports array<string>, inherits array<string>, literals array<struct<text:string,line:int>>"


@dataclass
class Segment:
    chunk_type: str
    name: str | None
    start_line: int
    end_line: int
    content: str
    calls: list = field(default_factory=list)
    imports: list = field(default_factory=list)
    inherits: list = field(default_factory=list)
    literals: list = field(default_factory=list)


def tile(text: str, first_line: int = 1, chunk_type: str = "text", name: str | None = None) -> Iterator[Segment]:
    """Runs of lines, closed at the target size; a piece's content starts with five lines of the one before, its span doesn't."""
    lines = text.splitlines(keepends=True)
    start, size = 0, 0
    for i, line in enumerate(lines):
        size += len(line)
        if size >= TARGET_CHARS or i == len(lines) - 1:
            yield Segment(chunk_type, name, first_line + start, first_line + i, "".join(lines[max(0, start - OVERLAP) : i + 1]))
            start, size = i + 1, 0


def markdown(text: str, path: str = "") -> Iterator[Segment]:
    """Sections at ATX headings outside fences; long ones in runs of lines."""
    lines = text.splitlines(keepends=True)
    cuts: list[tuple[int, str | None]] = [(0, None)]
    fence = ""
    for i, line in enumerate(lines):
        mark = re.match(r" {0,3}(`{3,}|~{3,})", line)
        if mark:
            if not fence:
                fence = mark[1]
            elif mark[1][0] == fence[0] and len(mark[1]) >= len(fence):
                fence = ""
        elif not fence and (head := re.match(r" {0,3}#{1,6}(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$", line.rstrip("\r\n"))):
            title = (head[1] or "").strip()
            cuts.append((i, title if title.strip("#") else None))
    for (a, name), (b, _) in zip(cuts, [*cuts[1:], (len(lines), None)]):
        part = "".join(lines[a:b])
        if part.strip():
            if len(part.encode()) <= MOST_BYTES:
                yield Segment("section", name, a + 1, b, part)
            else:
                yield from tile(part, a + 1, "section", name)


def python(text: str, path: str = "") -> Iterator[Segment]:
    """Top-level functions and classes (methods apart where a class is too long), and what is left as <module>."""
    tree = ast.parse(text)
    lines = text.splitlines(keepends=True)
    taken: list[tuple[int, int]] = []

    def span(node) -> tuple[int, int]:
        return min([node.lineno, *(d.lineno for d in node.decorator_list)]), node.end_lineno

    def visit(node, outer: str) -> Iterator[Segment]:
        a, b = span(node)
        name = f"{outer}.{node.name}" if outer else node.name
        part = "".join(lines[a - 1 : b])
        kind = "class" if isinstance(node, ast.ClassDef) else "function"
        inner = [n for n in node.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))] if kind == "class" else []
        if len(part.encode()) <= MOST_BYTES or not inner:
            got = [Segment(kind, name, a, b, part)] if len(part.encode()) <= MOST_BYTES else list(tile(part, a, kind, name))
            yield from (_with_refs(s, node) for s in got)
            return
        end = a
        for n in inner:
            c, d = span(n)
            if c > end and "".join(lines[end - 1 : c - 1]).strip():
                yield from tile("".join(lines[end - 1 : c - 1]), end, kind, name)
            yield from visit(n, name)
            end = d + 1
        if end <= b and "".join(lines[end - 1 : b]).strip():
            yield from tile("".join(lines[end - 1 : b]), end, kind, name)

    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            taken.append(span(node))
            yield from visit(node, "")
    end = 1
    rest = []
    for a, b in [*taken, (len(lines) + 1, 0)]:
        if a > end and "".join(lines[end - 1 : a - 1]).strip():
            rest += list(tile("".join(lines[end - 1 : a - 1]), end, "module", "<module>"))
        end = b + 1
    loose = [n for n in tree.body if not isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
    for s in rest:
        yield _with_refs(s, ast.Module([n for n in loose if s.start_line <= n.lineno <= s.end_line], []))


def _variants(calls) -> list:
    """Distinct calls in order: MOST_NAMES names at most, and MOST_VARIANTS of each."""
    by: dict[str, list] = {}
    out = []
    for c in calls:
        own = by.get(c[0])
        if own is None and len(by) < MOST_NAMES:
            own = by[c[0]] = []
        if own is not None and c not in own and len(own) < MOST_VARIANTS:
            own.append(c)
            out.append(c)
    return out


def braced(text: str, path: str) -> Iterator[Segment]:
    """Types and functions with the comments right above them (members apart where a type is too long), and what is left as <module>."""
    language = braces.LANGUAGES["." + path.rpartition(".")[2].lower()]
    tokens = braces.lex(text, language)
    found = braces.blocks(tokens, language)
    own = braces.names_at(tokens, found)
    lines = text.splitlines(keepends=True)
    between = lambda a, b: "".join(lines[a - 1 : b])

    def refs(s: Segment, bases: list[str]) -> Segment:
        at = [i for i, t in enumerate(tokens) if s.start_line <= t.line <= s.end_line]
        if at:
            calls, s.imports, literals = braces.references(tokens[at[0] : at[-1] + 1], {i - at[0] for i in own if i >= at[0]})
            s.calls, s.imports, s.literals = _variants(calls), s.imports[:MOST_NAMES], literals[:MOST_NAMES]
        s.inherits = list(dict.fromkeys(bases))[:MOST_NAMES]
        return s

    def every_base(b) -> list[str]:
        return b.bases + [x for c in b.inner for x in every_base(c)]

    def visit(b, a: int) -> Iterator[Segment]:
        part = between(a, b.end)
        if len(part.encode()) <= MOST_BYTES:
            yield refs(Segment(b.kind, b.name, a, b.end, part), every_base(b))
            return
        end, bases = a, b.bases
        for c in b.inner if b.kind == "class" else []:
            start = max(braces.attached(tokens, c), end)
            if c.end < start:
                continue
            if between(end, start - 1).strip():
                for s in tile(between(end, start - 1), end, b.kind, b.name):
                    yield refs(s, bases)
                    bases = []
            yield from visit(c, start)
            end = c.end + 1
        if end <= b.end and between(end, b.end).strip():
            for s in tile(between(end, b.end), end, b.kind, b.name):
                yield refs(s, bases)
                bases = []

    end = 1
    for b in [*found, None]:
        start = max(braces.attached(tokens, b), end) if b else len(lines) + 1
        if start > end and between(end, start - 1).strip():
            yield from (refs(s, []) for s in tile(between(end, start - 1), end, "module", "<module>"))
        if b and b.end >= start:
            yield from visit(b, start)
            end = b.end + 1
        else:
            end = max(end, start)


def symbols(text: str, path: str) -> list[tuple[str, str, int, int]]:
    """(name, kind, start, end) of every named definition, also inner ones, and of types that are only named; kind is class, function or forward_declaration."""
    ext = "." + path.rpartition("/")[2].rpartition(".")[2].lower()
    out: list[tuple[str, str, int, int]] = []
    if ext == ".py":

        def walk(node, outer: str) -> None:
            for n in ast.iter_child_nodes(node):
                if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    name = f"{outer}.{n.name}" if outer else n.name
                    out.append((name, "class" if isinstance(n, ast.ClassDef) else "function", min([n.lineno, *(d.lineno for d in n.decorator_list)]), n.end_lineno))
                    walk(n, name)
                else:
                    walk(n, outer)

        walk(ast.parse(text), "")
    elif ext in braces.LANGUAGES:
        tokens = braces.lex(text, braces.LANGUAGES[ext])
        found = braces.blocks(tokens, braces.LANGUAGES[ext])

        def down(blocks) -> None:
            for b in blocks:
                out.append((b.name, b.kind, b.start, b.end))
                down(b.inner)

        down(found)
        out += [(name, "forward_declaration", line, line) for name, line in braces.forward(tokens, found)]
    return out


def _spread(files: DataFrame) -> DataFrame:
    """path and content, dealt out by path where the input has fewer parts than cores keep busy: a small table can take long to read through."""
    spark, files = files.sparkSession, files.select("path", "content")
    few = files.rdd.getNumPartitions() < 2 * spark.sparkContext.defaultParallelism
    return files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path") if few else files


def symbol_table(files: DataFrame) -> DataFrame:
    """path, name, kind, start_line and end_line of the symbols of files (path, content); files that can't be read have none."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    got = symbols(text or "", path or "")
                except (SyntaxError, ValueError, RecursionError):
                    got = []
                if got:
                    columns = [[path] * len(got), *zip(*got)]
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()))], names=["path", "name", "kind", "start_line", "end_line"])

    return _spread(files).mapInArrow(run, "path string, name string, kind string, start_line int, end_line int")


def _dotted(node) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        left = _dotted(node.value)
        return f"{left}.{node.attr}" if left else node.attr
    return None


def _with_refs(s: Segment, node) -> Segment:
    """Calls with receiver and arity (none where it isn't fixed), imports, bases and string literals of a node."""
    calls = []
    for n in ast.walk(node):
        line = getattr(n, "lineno", s.start_line)
        if not s.start_line <= line <= s.end_line:
            continue
        if isinstance(n, ast.Call):
            name = _dotted(n.func)
            if name:
                left, _, last = name.rpartition(".")
                fixed = not n.keywords and not any(isinstance(a, ast.Starred) for a in n.args)
                calls.append((last, left, len(n.args) if fixed else None))
        elif isinstance(n, ast.Import):
            s.imports += [a.name for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            s.imports += [f"{n.module or ''}.{a.name}".lstrip(".") for a in n.names]
        elif isinstance(n, ast.ClassDef):
            s.inherits += [b for b in map(_dotted, n.bases) if b]
        elif isinstance(n, ast.Constant) and isinstance(n.value, str) and len(n.value) >= LEAST_LITERAL and any(c.isalpha() for c in n.value) and len(s.literals) < MOST_NAMES:
            s.literals.append((n.value, line))
    s.calls = _variants(calls)
    s.imports, s.inherits = list(dict.fromkeys(s.imports))[:MOST_NAMES], list(dict.fromkeys(s.inherits))[:MOST_NAMES]
    return s


def merged(parts: list[Segment]) -> list[Segment]:
    """Neighbours that are both small become one, under the first name; only where nothing stands between them."""
    out: list[Segment] = []
    for s in parts:
        size = lambda x: len(x.content.encode())
        if out and size(out[-1]) < LEAST_BYTES and size(s) < LEAST_BYTES and out[-1].end_line + 1 == s.start_line:
            last = out[-1]
            out[-1] = Segment(last.chunk_type, last.name or s.name, last.start_line, s.end_line, last.content + s.content, last.calls + s.calls, last.imports + s.imports, last.inherits + s.inherits, last.literals + s.literals)
        else:
            out.append(s)
    return out


def ceiling(s: Segment) -> Iterator[Segment]:
    """Windows of at most the byte limit that cut no character, with lines in proportion; none of white space only."""
    data = s.content.encode()
    if len(data) <= MOST_BYTES:
        if s.content.strip():
            yield s
        return
    span, a, line = s.end_line - s.start_line + 1, 0, s.start_line
    while a < len(data):
        b = min(a + MOST_BYTES, len(data))
        while b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        last = s.start_line + max(0, min(span, -(-span * b // len(data))) - 1)
        part = data[a:b].decode()
        if part.strip():
            yield Segment(s.chunk_type, s.name, min(line, last), last, part, s.calls if a == 0 else [], s.imports if a == 0 else [], s.inherits if a == 0 else [], s.literals if a == 0 else [])
        a, line = b, last + (part.endswith("\n"))


SEGMENTERS: dict[str, tuple[str, Callable[[str, str], Iterator[Segment]]]] = {".md": ("markdown", markdown), ".markdown": ("markdown", markdown), ".py": ("python", python), **{ext: (language, braced) for ext, language in braces.LANGUAGES.items()}}


def register(extension: str, language: str, segmenter: Callable[[str, str], Iterator[Segment]]) -> None:
    """Adds a segmenter; an extension that has one already is refused."""
    if extension in SEGMENTERS:
        raise ValueError(f"{extension} has a segmenter")
    SEGMENTERS[extension] = language, segmenter


def segment(text: str, path: str, segmenters=None) -> tuple[str | None, list[Segment]]:
    """Language and segments of a file; a file that its parser refuses is cut by lines."""
    ext = "." + path.rpartition("/")[2].rpartition(".")[2].lower()
    language, f = (segmenters or SEGMENTERS).get(ext, (None, lambda t, p: tile(t)))
    try:
        parts = list(f(text, path))
    except (SyntaxError, ValueError, RecursionError):
        parts = list(tile(text))
    seen, out = set(), []
    for s in merged(parts):
        for x in ceiling(s):
            if (x.start_line, x.content) not in seen:
                seen.add((x.start_line, x.content))
                out.append(x)
    return language, out


def segment_files(files: DataFrame) -> DataFrame:
    """Chunks of files (path, content as text), one file at a time."""
    segmenters = dict(SEGMENTERS)

    def run(batches):
        import pyarrow as pa

        names = ["path", "language", "chunk_type", "name", "start_line", "end_line", "content", "calls", "imports", "inherits", "literals"]
        entry = pa.list_(pa.struct([("name", pa.string()), ("receiver", pa.string()), ("arity", pa.int32())]))
        kinds = [pa.string()] * 4 + [pa.int32()] * 2 + [pa.string(), entry, pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.struct([("text", pa.string()), ("line", pa.int32())]))]
        for batch in batches:
            rows = []
            for path, text in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                language, parts = segment(text or "", path or "", segmenters)
                for s in parts:
                    calls = [dict(zip(("name", "receiver", "arity"), c)) for c in s.calls]
                    rows.append((path, language, s.chunk_type, s.name, s.start_line, s.end_line, s.content, calls, s.imports, s.inherits, [{"text": t, "line": n} for t, n in s.literals]))
                if len(rows) >= 1000:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                    rows = []
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return _spread(files).mapInArrow(run, SCHEMA)


# signatures


def signatures(content: str, name: str) -> list[tuple[int, int | None]]:
    """(least, most) arguments of each signature of the name in a definition; most is None where it is open."""
    out = []
    for m in re.finditer(r"(?<![A-Za-z0-9_])" + re.escape(name) + r"\s*\(", content):
        depth, part, parts = 1, "", []
        for c in content[m.end() :]:
            depth += (c in "([{<") - (c in ")]}>")
            if not depth:
                break
            if c == "," and depth == 1:
                parts.append(part)
                part = ""
            else:
                part += c
        parts = [p.strip() for p in [*parts, part] if p.strip() and p.strip() not in ("self", "cls", "void")]
        open_ = any(p.startswith(("*", "...", "params ")) or p.endswith("...") for p in parts)
        fixed = [p for p in parts if not p.startswith("*") and "..." not in p and not p.startswith("params ")]
        least = sum("=" not in p for p in fixed)
        out.append((least, None if open_ else len(fixed)))
    return out


def accepts(arity: int | None, sigs: list[tuple[int, int | None]]) -> bool:
    return arity is None or not sigs or any(a <= arity and (b is None or arity <= b) for a, b in sigs)
