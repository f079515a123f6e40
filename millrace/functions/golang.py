"""Declarations, calls and documentation comments of Go sources.

Works on a mask of the source in which comments and literals are blank but every line end stays, so that brackets,
keywords and names can be found by position. Sources whose brackets or literals don't close are not Go.
"""

from __future__ import annotations

import re
from bisect import bisect_right

LITERAL = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|`[^`]*(?:`|\Z)|\"(?:[^\"\\\n]|\\.)*(?:\"|$)|'(?:[^'\\\n]|\\.)*(?:'|$)", re.S | re.M)
START = re.compile(r"^[ \t]*(func|type|var|const|import)\b", re.M)
BRACKET = re.compile(r"[(\[{}\])]")
CALL = re.compile(r"([^\W\d]\w*)[ \t]*(\[[^\[\]\n]*\])?\(")
NAME = re.compile(r"[^\W\d]\w*")
#: Words of the language that a bracket may follow (fixed values).
NOT_CALLED = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
DIRECTIVE = re.compile(r"//(?:line |extern |export |[a-z0-9]+:[a-z0-9])")


class Source:
    """One text, masked and with its bracket pairs."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.comments: list[tuple[int, int]] = []
        self.whole = True
        self.mask = LITERAL.sub(self._blank, text)
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.pairs: dict[int, int] = {}
        self.depth_at: list[tuple[int, int]] = [(0, 0)]
        stack: list[int] = []
        for m in BRACKET.finditer(self.mask):
            if m.group() in "([{":
                stack.append(m.start())
            elif stack and self.mask[stack[-1]] + m.group() in ("()", "[]", "{}"):
                self.pairs[stack.pop()] = m.start()
            else:
                self.whole = False
            self.depth_at.append((m.start() + 1, len(stack)))
        self.whole = self.whole and not stack
        self._positions = [p for p, _ in self.depth_at]

    def _blank(self, m: re.Match) -> str:
        raw = m.group()
        if raw.startswith(("//", "/*")):
            self.comments.append((m.start(), m.end()))
            self.whole = self.whole and (raw.startswith("//") or (raw.endswith("*/") and len(raw) > 3))
        elif len(raw) < 2 or raw[0] != raw[-1]:
            self.whole = False
        return re.sub(r"[^\r\n]", " ", raw)

    def line(self, at: int) -> int:
        return bisect_right(self.breaks, at - 1) + 1 if at else 1

    def depth(self, at: int) -> int:
        return self.depth_at[bisect_right(self._positions, at) - 1][1]

    def statement_end(self, at: int) -> int:
        """Offset behind the statement at ``at``: the first line end outside brackets that doesn't continue it."""
        i = at
        while i < len(self.mask):
            c = self.mask[i]
            if c in "([{":
                if i not in self.pairs:
                    return len(self.mask)
                i = self.pairs[i] + 1
                continue
            if c in "\n;" and self.mask[at:i].rstrip()[-1:] not in tuple("=,.+-*/|&<>^%!:"):
                return i
            i += 1
        return len(self.mask)

    def comment_above(self, at: int) -> list[tuple[int, int]]:
        """The comments that end on the line above the statement at ``at``, without gaps, first one first."""
        out: list[tuple[int, int]] = []
        top = self.text.rfind("\n", 0, at) + 1
        k = bisect_right(self.comments, (top, 0)) - 1
        while k >= 0:
            s, e = self.comments[k]
            begins = self.text.rfind("\n", 0, s) + 1
            if e > top or self.text[e:top].count("\n") > 1 or self.text[e:top].strip() or self.mask[begins:s].strip():
                break
            out.insert(0, (s, e))
            top, k = begins, k - 1
        return out


def declarations(source: Source) -> list[tuple[str, str, int, int, int, int]]:
    """(kind, symbol, first line with documentation, last line, offset, end offset) of top-level declarations but imports."""
    out, behind = [], 0
    for m in START.finditer(source.mask):
        at = m.start(1)
        if at < behind or source.depth(at):
            continue
        kind = m.group(1)
        end = source.statement_end(at)
        behind = end
        if kind == "import":
            continue
        if kind == "func":
            symbol = _func_name(source, m.end(1))
            if symbol is None:
                continue
        else:
            names = NAME.search(source.mask, m.end(1), end)
            symbol = names.group() if names else ""
        doc = source.comment_above(at)
        last = source.line(max(at, len(source.mask[:end].rstrip()) - 1))
        out.append((kind, symbol, source.line(doc[0][0] if doc else at), last, at, end))
    return out


def documented(source: Source) -> list[tuple[str, str, str, str, int, int, int, bool]]:
    """(kind, symbol, ``decl`` or ``spec``, text of the comment, first line with it, first line without, last line, grouped).

    Declarations with a comment above them, and the members of bracketed groups that have one of their own.
    """
    out = []
    for kind, symbol, first, last, at, end in declarations(source):
        bracket = re.match(r"\s*\(", source.mask[at + len(kind) : end]) if kind != "func" else None
        if doc := source.comment_above(at):
            out.append((kind, symbol, "decl", comment_text(source, doc), first, source.line(at), last, bool(bracket)))
        if not bracket:
            continue
        begin = at + len(kind) + bracket.end()
        depth = source.depth(begin)
        for m in re.finditer(r"^[ \t]*([^\W\d]\w*)", source.mask[begin:end], re.M):
            s = begin + m.start(1)
            if source.depth(s) == depth and (doc := source.comment_above(s)):
                last_line = source.line(max(s, len(source.mask[: source.statement_end(s)].rstrip()) - 1))
                out.append((kind, m.group(1), "spec", comment_text(source, doc), source.line(doc[0][0]), source.line(s), last_line, True))
    return out


def comment_text(source: Source, comments: list[tuple[int, int]]) -> str:
    """What comments say: without marks and tool directives, in one line."""
    parts = []
    for s, e in comments:
        raw = source.text[s:e]
        if raw.startswith("//"):
            if not DIRECTIVE.match(raw):
                parts.append(raw[2:])
        else:
            parts.append(re.sub(r"(?m)^\s*\*", "", raw[2:-2]))
    return " ".join(" ".join(parts).split())


def _func_name(source: Source, at: int) -> str | None:
    """``Type.Name`` or ``Name`` of the function whose keyword ends at ``at``; None for a literal."""
    bracket = source.mask.find("(", at)
    if bracket < 0:
        return None
    own = NAME.search(source.mask, at, bracket)
    if own:
        return own.group()
    close = source.pairs.get(bracket)
    if close is None:
        return None
    receiver = NAME.findall(re.sub(r"\[.*\]", "", source.mask[bracket + 1 : close], flags=re.S))
    named = re.match(r"\s*([^\W\d]\w*)\s*[(\[]", source.mask[close + 1 :])
    return f"{receiver[-1]}.{named.group(1)}" if receiver and named else None


def calls(source: Source) -> list[tuple[str, str, int, int]]:
    """(caller, name called, line, offset) of calls inside top-level functions."""
    out = []
    for kind, symbol, _, _, at, end in declarations(source):
        if kind != "func":
            continue
        body = source.mask.find("{", at, end)
        while body >= 0 and re.search(r"\b(?:interface|struct)\s*\Z", source.mask[at:body]) and body in source.pairs:
            body = source.mask.find("{", source.pairs[body], end)
        if body < 0:
            continue
        for m in CALL.finditer(source.mask, body, end):
            if m.group(1) not in NOT_CALLED:
                out.append((symbol, m.group(1), source.line(m.start(1)), m.start(1)))
    return out


def without_docs(text: str) -> str | None:
    """The text without its documentation comments, line ends and tool directives kept; None if it isn't whole."""
    source = Source(text)
    if not source.whole:
        return None
    drop: list[tuple[int, int]] = []
    for _, _, _, _, at, _ in declarations(source):
        drop += source.comment_above(at)
    for kind, _, _, _, at, end in declarations(source):
        if kind != "func":  # documentation of specs and fields inside a declaration
            for s, e in source.comments:
                if at < s < end and not source.mask[source.text.rfind("\n", 0, s) + 1 : s].strip():
                    drop.append((s, e))
    out, at = [], 0
    for s, e in sorted(set(drop)):
        if DIRECTIVE.match(text, s):
            continue
        out += [text[at:s], re.sub(r"[^\r\n]", "", text[s:e])]
        at = e
    return "".join([*out, text[at:]])
