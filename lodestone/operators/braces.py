"""Segments, references and symbols of languages whose blocks stand in braces: C, C++, C#, HLSL, JavaScript and TypeScript.

There is no grammar here: a lexer tells comments, strings, directives, words and signs apart, and what stands before a
brace tells what the block is. Types and functions are found at any depth of namespaces and types; other blocks
(initialisers, statements) belong to what holds them. A text whose braces don't match is refused, and is then cut by lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

# Words of these languages that look like a name before a bracket, or that begin a type or a namespace.
NO_CALL = frozenset("if for while switch catch return sizeof alignof decltype typeof new delete throw else do case using lock foreach fixed when await yield in of not and or static_assert defined nameof default checked unchecked function constructor super".split())
TYPES = frozenset("class struct union enum interface record".split())
SPACES = frozenset("namespace module extern cbuffer".split())
ACCESS = frozenset("public private protected virtual internal".split())
LANGUAGES = {".c": "c", ".h": "cpp", ".hpp": "cpp", ".cpp": "cpp", ".cc": "cpp", ".cs": "c_sharp", ".hlsl": "hlsl", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "tsx"}
SCRIPTS = ("javascript", "typescript", "tsx")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b", "f": "\f", "v": "\v", "a": "\a"}

_LEX = re.compile(
    r"""(?P<comment>//[^\n]*|/\*(?s:.*?)\*/)
|(?P<directive>^[ \t]*\#(?:[^\n\\]|\\[^\n]|\\\n)*)
|(?P<string>R"(?P<mark>[^()\\ \n]{0,16})\((?s:.*?)\)(?P=mark)"|\$?@\$?"(?:[^"]|"")*"|\$?"(?:[^"\\\n]|\\(?s:.))*"|'(?:[^'\\\n]|\\(?s:.))*'|`(?:[^`\\]|\\(?s:.))*`)
|(?P<word>[A-Za-z_$][A-Za-z0-9_$]*|[0-9][A-Za-z0-9_.']*)
|(?P<sign>::|->|=>|\.\.\.|\?\.|[^\s])""",
    re.M | re.X,
)


@dataclass
class Token:
    kind: str
    text: str
    line: int
    last: int  # line that it ends on


@dataclass
class Block:
    """A type or function: name with what holds it, kind (class or function), lines, tokens from its head to its last brace, bases, inner blocks."""

    name: str
    kind: str
    start: int
    end: int
    first: int
    last: int
    bases: list[str]
    inner: list[Block]


def lex(text: str, language: str) -> list[Token]:
    out, line, at = [], 1, 0
    for m in _LEX.finditer(text):
        line += text.count("\n", at, m.start())
        at = m.start()
        kind, word = m.lastgroup if m.lastgroup != "mark" else "string", m[0]
        if kind == "directive" and language in SCRIPTS:
            kind = "sign"
        if kind == "directive":
            word = word.lstrip()
        out.append(Token(kind, word, line, line + m[0].count("\n")))
    return out


def _head(tokens: list[Token], a: int, b: int, outer: str, language: str) -> tuple[str, str, list[str]] | None:
    """(kind, name, bases) of the block that opens at token b, from its head a..b; None for a block that is no declaration."""
    head = [t for t in tokens[a:b] if t.kind not in ("comment", "directive")]
    words = [t.text for t in head]
    if not words:
        return None
    depth = 0
    flat = []  # the head without what stands in brackets; "()" where round ones were
    for w in words:
        if w in "([":
            if not depth and w == "(":
                flat.append("()")
            depth += 1
        elif w in ")]":
            depth -= 1
        elif not depth:
            flat.append(w)
    kind = next((w for w in flat if w in TYPES), None)
    if kind and "()" not in flat[: flat.index(kind)] and ("=" not in flat or flat.index("=") > flat.index(kind)) and "=>" not in flat:
        rest = flat[flat.index(kind) + 1 :]
        rest = rest[1:] if rest[:1] and rest[0] in TYPES else rest
        stop = next((i for i, w in enumerate(rest) if w in (":", "extends", "implements", "<", "where", "()")), len(rest))
        names = [w for w in rest[:stop] if re.match(r"[A-Za-z_$]", w) and w != "final"]
        name = names[-1] if names else ""
        return "class", name, _bases(rest[stop:])
    if not flat:
        return None
    if flat[0] in SPACES or flat[:2] == ["export", "namespace"] or flat[0] == "inline" and "namespace" in flat[:2] or flat[0] == "declare" and len(flat) > 1 and flat[1] in SPACES:
        return "space", "", []
    if "=>" in flat or "function" in flat:
        eq = next((i for i, w in enumerate(flat) if w in ("=", ":")), -1)
        if "function" in flat:
            i = flat.index("function")
            name = next((w for w in flat[i + 1 : i + 3] if re.match(r"[A-Za-z_$]", w)), "")
            if name:
                return "function", name, []
        name = flat[eq - 1] if eq > 0 else ""
        return ("function", name, []) if re.fullmatch(r"[A-Za-z_$][\w$]*", name) else None
    if "()" in flat:
        i = flat.index("()")
        if not i or "=" in flat[:i] or flat[0] in NO_CALL and flat[0] != "constructor" or not re.match(r"[A-Za-z_$]", flat[i - 1]) or flat[i - 1] in NO_CALL - {"constructor"}:
            return None
        name, i = flat[i - 1], i - 2
        if i >= 0 and flat[i] == "~":
            name, i = "~" + name, i - 1
        while i >= 1 and flat[i] == "::":
            i -= 1
            if flat[i] == ">":  # template arguments
                while i > 0 and flat[i] != "<":
                    i -= 1
                i -= 1
            name, i = f"{flat[i]}::{name}", i - 1
        return "function", name, []
    return None


def _bases(words: list[str]) -> list[str]:
    out, part, depth = [], [], 0
    for w in [*words, ","]:
        depth += (w == "<") - (w == ">")
        if w in (",", "extends", "implements", ":", "where", "{") and depth <= 0:
            if part and (not out or part[0] != out[-1]):
                out.append("".join(part))
            part = []
            if w == "where":
                break
        elif depth <= 0 and w not in ACCESS and w not in ("<", ">", "()"):
            part.append(w)
    return out


def blocks(tokens: list[Token], language: str) -> list[Block]:
    """Types and functions in order, inner ones within; raises ValueError where braces don't match."""
    joint = "." if language in (*SCRIPTS, "c_sharp") else "::"
    top = Block("", "space", 0, 0, 0, 0, [], [])
    # what an open brace opened, the block that holds what is in it, and the brackets and the head that were open before it
    stack: list[tuple[Block | None, Block, int, int]] = [(top, top, 0, 0)]
    start, round_ = 0, 0
    for i, t in enumerate(tokens):
        if t.kind == "directive" or t.kind == "comment" and start == i:
            start = i + 1 if start == i else start
        elif t.kind != "sign":
            continue
        elif t.text in "([":
            round_ += 1
        elif t.text in ")]":
            round_ -= 1
        elif t.text == "{":
            holder = stack[-1][1]
            found = _head(tokens, start, i, holder.name, language) if stack[-1][0] is not None and round_ <= 0 else None
            if found and found[0] != "space" and found[1]:
                kind, name, bases = found
                b = Block(f"{holder.name}{joint}{name}" if holder.name else name, kind, tokens[start].line, 0, start, 0, bases, [])
                holder.inner.append(b)
                stack.append((b if kind == "class" else None, b, round_, start))
            else:
                stack.append((holder if found and found[0] == "space" else None, holder, round_, start))
            round_, start = 0, i + 1
        elif t.text == "}":
            if len(stack) < 2:
                raise ValueError("a brace closes nothing")
            _, b, round_, before = stack.pop()
            if b is not stack[-1][1]:
                b.end, b.last = t.last, i
            start = before if round_ > 0 else i + 1
        elif t.text == ";" and round_ <= 0:
            start = i + 1
        elif t.text == ":" and i and tokens[i - 1].text in ("public", "private", "protected") and start == i - 1:
            start = i + 1
    if len(stack) > 1:
        raise ValueError("a brace is not closed")
    return top.inner


def attached(tokens: list[Token], block: Block) -> int:
    """First line of the block with the comments right above it."""
    line, i = block.start, block.first - 1
    while i >= 0 and tokens[i].kind == "comment" and tokens[i].last == line - 1 and (i == 0 or tokens[i - 1].last < tokens[i].line):
        line, i = tokens[i].line, i - 1
    return line


def literal(token: str) -> str:
    """What a string token says."""
    if token.startswith("R"):
        return token[token.index("(") + 1 : token.rindex(")")]
    quote = token.lstrip("$@")[0]
    body = token.lstrip("$@")[1:-1]
    if "@" in token[:2]:
        return body.replace('""', '"')
    return re.sub(r"\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[3] is None else ESCAPES.get(m[3], m[3]), body, flags=re.S) if quote else body


def references(tokens: list[Token], own: set[int]) -> tuple[list, list[str], list[tuple[str, int]]]:
    """Calls (name, receiver, arity), imports and literals (text, line) among tokens; own: places of names that are declared there."""
    calls, imports, literals = [], [], []
    code = [(i, t) for i, t in enumerate(tokens) if t.kind != "comment"]
    closing, open_ = {}, []
    commas: dict[int, int] = {}
    for n, (_, t) in enumerate(code):
        if t.kind != "sign":
            continue
        if t.text in "([{":
            open_.append(n)
        elif t.text in ")]}" and open_:
            closing[open_.pop()] = n
        elif t.text == "," and open_:
            commas[open_[-1]] = commas.get(open_[-1], 0) + 1
        elif t.text == "..." and open_:
            commas[open_[-1]] = -(10**6)
    last_end = -2
    for n, (i, t) in enumerate(code):
        following = code[n + 1][1].text if n + 1 < len(code) else ""
        if t.kind == "directive" and (m := re.match(r'#\s*(?:include|import)\s*[<"]([^>"]+)', t.text)):
            imports.append(m[1])
        elif t.kind == "word" and t.text == "using" and n + 1 < len(code) and code[n + 1][1].kind == "word" and code[n + 1][1].text != "namespace":
            words = []
            for _, x in code[n + 1 :]:
                if x.text in (";", "(", "="):
                    words = words if x.text == ";" else []
                    break
                words.append(x.text)
            if words:
                imports.append("".join(w for w in words if w != "static"))
        elif t.kind == "word" and t.text in ("from", "import", "require") and n + 1 < len(code):
            after = code[n + 2][1] if following == "(" and n + 2 < len(code) else code[n + 1][1]
            if after.kind == "string":
                imports.append(literal(after.text))
        elif t.kind == "word" and following == "(" and t.text not in NO_CALL and not t.text[0].isdigit() and i not in own and (not n or code[n - 1][1].text != "~"):
            names, k = [], n - 1
            while k >= 1 and code[k][1].text in (".", "->", "::", "?.") and code[k - 1][1].kind == "word":
                names.append(code[k - 1][1].text)
                k -= 2
            count = commas.get(n + 1, 0)
            empty = closing.get(n + 1) == n + 2
            calls.append((t.text, ".".join(reversed(names)), None if count < 0 or n + 1 not in closing else 0 if empty else count + 1))
        elif t.kind == "string" and not t.text.startswith("'") or t.kind == "string" and len(t.text) > 3:
            text = literal(t.text)
            joined = n - 1 == last_end or code[n - 1][1].text == "+" and n - 2 == last_end
            if joined and literals:
                literals[-1] = (literals[-1][0] + text, literals[-1][1])
            else:
                literals.append((text, t.line))
            last_end = n
    return calls, list(dict.fromkeys(imports)), [(x, n) for x, n in literals if len(x) >= 6 and any(c.isalpha() for c in x)]


def names_at(tokens: list[Token], found: list[Block]) -> set[int]:
    """Places of the names that the blocks declare."""
    out = set()
    for b in found:
        name = re.split(r"::|\.", b.name)[-1].lstrip("~")
        for i in range(b.first, b.last):
            if tokens[i].text == "{" and tokens[i].kind == "sign":
                break
            if tokens[i].text == name:
                out.add(i)
                break
        out |= names_at(tokens, b.inner)
    return out


def forward(tokens: list[Token], found: list[Block]) -> Iterator[tuple[str, int]]:
    """Types that are only named (class X;), with their line."""
    for i, t in enumerate(tokens[:-2]):
        if t.kind == "word" and t.text in TYPES and tokens[i + 1].kind == "word" and tokens[i + 2].text == ";":
            yield tokens[i + 1].text, t.line
