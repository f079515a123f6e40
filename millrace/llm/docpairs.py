"""Functions paired with their documentation.

Every Go function or method that stands whole in a source text is paired with a documentation comment. Comments and
functions of a text are the two sides of a bipartite graph: a comment between two declarations is a candidate of the
function below it and of the one above it. Weights come from distance, names and parameter tags; the pairs are the
assignment of greatest total weight. Implausible pairs, and comments that say nothing, are rejected afterwards.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources.tables import only

#: Words that describe nothing. Fixed values.
EMPTY_WORDS = frozenset("a an the is of to in and for it this".split())
LEAST_WORDS = 4
#: Openings of paragraphs that are notes to the authors. Fixed values.
NOTE = re.compile(r"(?:TODO|FIXME|XXX)\b")
DIRECTIVE = re.compile(r"//(?:[a-z0-9]+:[a-z0-9]|line |extern |export )|//\s*\+build\b")

LINE, BLOCK, TEXT, OPEN, CLOSE, FUNC, STRAY = 1, 2, 3, 4, 5, 6, 7
TOKEN = re.compile(
    r"""(//[^\n]*)|(/\*(?:[^*]|\*(?!/))*+(?:\*/|\Z))|(`[^`]*(?:`|\Z)|"(?:[^"\\\n]|\\.)*+"?|'(?:[^'\\\n]|\\.)*+'?)|([{(\[])|([})\]])|(\bfunc\b)|(\*/)"""
)
WORD = re.compile(r"[^\W\d_]+")
#: A parameter's tag: ``@param name`` or ``name:`` or ``- name`` at the beginning of a comment line.
TAG = re.compile(r"@param\s+(\w+)|^[ \t]*(?://|\*)?[ \t]*(?:-[ \t]+)?(\w+)[ \t]*(?::|-[ \t])", re.M)
NAME = re.compile(r"[^\W\d]\w*")
CAMEL = re.compile(r"(?<=[a-z\d])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
COMMENTS = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)", re.S)
OPENS_RAW = re.compile(r"(?:[=(\[{,:+]|\breturn|\bcase)[ \t]*\Z")
#: A struct tag of key:"value" pairs; the names and the type of a field before a tag; any tag, up to the end of its line.
STRUCT_TAG = re.compile(r'`(?:[\w.-]+:"(?:[^"\\\n`]|\\.)*"[ \t]*)+`')
FIELD = re.compile(r"[ \t]*[^\W\d]\w*(?:[ \t]*,[ \t]*\w+)*[ \t]+[*\[\]\w.]+[ \t]+\Z")
ANY_TAG = re.compile(r"`[^`\s+,)][^`\n]*`[ \t\r]*(?://[^\n]*)?(?:\n|\Z)")
#: Weights: a comment that describes and ends on the line above (more than any two other links together), another one there, nearness
#: of other comments above and below, the function's name at its beginning and elsewhere, all parameters named, and tagged.
ADJACENT, TOUCHING, ABOVE, BELOW = 80.0, 6.0, 6.0, 4.0
OPENS_WITH_NAME, NAMED, PARAMETERS, TAGGED = 8.0, 2.0, 6.0, 4.0
TOP_LEVEL = re.compile(r"(?:\s|//[^\n]*(?:\n|\Z)|/\*.*?\*/)*+(?:package|import|type|var|const|func)\b", re.S)


def symbol_words(symbol: str) -> set[str]:
    """The words of a symbol: dotted parts whole and split at underscores and case changes, in lower case."""
    words: set[str] = set()
    for part in symbol.split("."):
        words.add(part.lower())
        for piece in part.split("_"):
            words.update(x.lower() for x in CAMEL.split(piece))
    for word in list(words):
        words.update(WORD.findall(word))
    return words


def describes(paragraphs: list[str], symbol: str, least: int = LEAST_WORDS) -> bool:
    """Whether the paragraphs hold ``least`` different words that are neither empty nor the symbol's own."""
    words = {w.lower() for p in paragraphs for w in WORD.findall(p)} - EMPTY_WORDS
    return len(words) >= least and len(words - symbol_words(symbol)) >= least


def comment_paragraphs(tokens: list[tuple[int, str]]) -> list[str]:
    """The paragraphs of a comment group, without markers, tool directives and notes to the authors."""
    lines: list[str] = []
    for kind, raw in tokens:
        if kind == LINE:
            if not DIRECTIVE.match(raw):
                lines.append(raw[2:])
        else:
            body = raw[2:-2] if raw.endswith("*/") and len(raw) >= 4 else raw[2:]
            lines += [re.sub(r"\A\s*\*+", "", x, count=1) for x in body.split("\n")]
    paragraphs, now = [], []
    for line in [*lines, ""]:
        if line := line.strip():
            now.append(line)
        elif now:
            paragraphs.append(" ".join(now))
            now = []
    return [p for p in paragraphs if not NOTE.match(p)]


def assign(weights: dict[tuple[int, int], float]) -> dict[int, int]:
    """The matching of greatest weight of a bipartite graph given as {(left, right): weight above 0}; who gains nothing stays single.

    An edge that weighs as much as the best other edges of its two ends together belongs to some best matching and
    is taken first, which leaves small components; these are solved by augmenting paths of greatest gain (the
    Hungarian method on sparse rows). Equal weights are decided by the smaller numbers.
    """
    left: dict[int, dict[int, float]] = {}
    right: dict[int, set[int]] = {}
    for (a, b), w in sorted(weights.items()):
        left.setdefault(a, {})[b] = w
        right.setdefault(b, set()).add(a)
    pairs: dict[int, int] = {}
    todo = sorted(left, reverse=True)
    while todo:
        a = todo.pop()
        if a in pairs or not left.get(a):
            continue
        b = min(left[a], key=lambda x: (-left[a][x], x))
        others = max((w for x, w in left[a].items() if x != b), default=0.0) + max((left[x][b] for x in right[b] if x != a), default=0.0)
        if left[a][b] >= others:
            pairs[a] = b
            for x in left.pop(a):
                right[x].discard(a)
            for x in right.pop(b):
                left[x].pop(b)
                todo.append(x)
    owner: dict[int, int] = {}
    held: dict[int, int] = {}
    for a in sorted(x for x in left if left[x]):
        gain, way = {a: 0.0}, {}
        best, end = 0.0, None  # staying single
        queue = [a]
        while queue:
            u = queue.pop(0)
            for b, w in left[u].items():
                if held.get(u) == b:
                    continue
                g = gain[u] + w
                v = owner.get(b)
                if v is None:
                    if g > best + 1e-9:
                        best, end = g, (u, b)
                elif g - left[v][b] > gain.get(v, -1e18) + 1e-9:
                    gain[v], way[v] = g - left[v][b], (u, b)
                    queue.append(v)
                    if gain[v] > best + 1e-9:  # v stays single instead
                        best, end = gain[v], (v, None)
        if end is None:
            continue
        u, b = end
        if b is None:
            held.pop(u)
            u, b = way[u]
        while True:
            before = held.get(u)
            held[u], owner[b] = b, u
            if u == a:
                break
            u, b = way[u] if before is None else (way[u][0], before)
    return {**pairs, **held}


def _tokens(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of comments, literals, brackets and ``func``.

    A text cut out of a file may begin inside a raw string or a block comment. It did so where the first back
    quote stands where none can open a string, or where a comment closes that never opened; lexing then starts
    behind that mark. A text that opens with a declaration and is whole from there on began in neither.
    """
    start, tick = 0, text.find("`")
    while True:
        found = []
        again = False
        for m in TOKEN.finditer(text, start):
            kind = m.lastindex
            if kind == STRAY:
                start, again = m.end(), True
                break
            if kind == TEXT and m.start() == tick and start <= tick:
                if not _opens_raw(text, tick) and not (start == 0 and TOP_LEVEL.match(text) and _whole(text)):
                    start, again = tick + 1, True
                    tick = -1
                    break
            found.append((kind, m.start(), m.end()))
        if not again:
            return found


def _opens_raw(text: str, tick: int) -> bool:
    """Whether the back quote stands where a raw string or a struct tag can open."""
    before = text[text.rfind("\n", 0, tick) + 1 : tick]
    if OPENS_RAW.search(before) or (before.strip() and STRUCT_TAG.match(text, tick)):
        return True
    return bool(FIELD.match(before) and ANY_TAG.match(text, tick))


def _whole(text: str) -> bool:
    """Whether a text, lexed from its start, ends outside literals and comments with every bracket closed by its own kind."""
    open_ones = []
    for m in TOKEN.finditer(text):
        kind, raw = m.lastindex, m.group()
        if kind == STRAY or (kind == TEXT and (len(raw) < 2 or raw[-1] != raw[0])) or (kind == BLOCK and (len(raw) < 4 or not raw.endswith("*/"))):
            return False
        if kind == OPEN:
            open_ones.append(raw)
        elif kind == CLOSE and (not open_ones or open_ones.pop() + raw not in ("()", "[]", "{}")):
            return False
    return not open_ones


def _closings(tokens: list[tuple[int, int, int]]) -> list[int]:
    """For each token the index of the one that closes the bracket it opens, or -1."""
    out, open_ones = [-1] * len(tokens), []
    for k, (kind, _, _) in enumerate(tokens):
        if kind == OPEN:
            open_ones.append(k)
        elif kind == CLOSE and open_ones:
            out[open_ones.pop()] = k
    return out


def _function(text: str, tokens: list[tuple[int, int, int]], closes: list[int], i: int) -> tuple[str, str, int] | None:
    """(symbol, parameters, index of the closing brace) of the declaration whose ``func`` is token ``i``."""
    n, at, receiver = len(tokens), tokens[i][2], ""
    j = i + 1
    while j < n and tokens[j][0] == BLOCK:
        at, j = tokens[j][2], j + 1
    if j < n and tokens[j][0] == OPEN and text[tokens[j][1]] == "(" and not text[at : tokens[j][1]].strip():
        k = closes[j]
        if k < 0:
            return None
        inside = COMMENTS.sub(" ", text[tokens[j][2] : tokens[k][1]])
        inside = re.sub(r"\[.*\]", " ", inside, flags=re.S)
        names = NAME.findall(inside)
        if not names:
            return None
        receiver, at, j = names[-1] + ".", tokens[k][2], k + 1
        while j < n and tokens[j][0] == BLOCK:
            at, j = tokens[j][2], j + 1
    if j >= n or tokens[j][0] != OPEN:
        return None
    name = text[at : tokens[j][1]].strip()
    if not NAME.fullmatch(name):
        return None
    if text[tokens[j][1]] == "[":
        k = closes[j]
        if k < 0 or k + 1 >= n or tokens[k + 1][0] != OPEN or text[tokens[k][2] : tokens[k + 1][1]].strip():
            return None
        j = k + 1
    if text[tokens[j][1]] != "(":
        return None
    k = closes[j]
    if k < 0:
        return None
    parameters = text[tokens[j][2] : tokens[k][1]]
    at, j = tokens[k][2], k + 1
    while j < n:
        kind, s, e = tokens[j]
        between = text[at:s]
        if "\n" in between or kind == LINE or kind == CLOSE:
            return None
        if kind == OPEN:
            k = closes[j]
            if k < 0:
                return None
            if text[s] == "{" and not re.search(r"\b(?:interface|struct)\s*\Z", between):
                return receiver + name, parameters, k
            e, j = tokens[k][2], k
        elif kind == BLOCK and "\n" in text[s:e]:
            return None
        at, j = e, j + 1
    return None


class _Comment:
    """A group of comments without a blank line between them, on lines of its own."""

    __slots__ = ("first", "last", "members")

    def __init__(self, first: int, last: int, members: list[tuple[int, int, int]]) -> None:
        self.first, self.last, self.members = first, last, members


class _Function:
    __slots__ = ("symbol", "parameters", "first", "last", "above", "below")

    def __init__(self, symbol: str, parameters: str, first: int, last: int) -> None:
        self.symbol, self.parameters, self.first, self.last = symbol, parameters, first, last
        self.above: list[_Comment] = []
        self.below: list[_Comment] = []


def _top_level(text: str, tokens: list[tuple[int, int, int]]) -> list[_Function]:
    """The functions at top level with all comments between them and the declarations before and after."""
    closes = _closings(tokens)
    ends = [m.start() for m in re.finditer("\n", text)]
    line = lambda at: bisect_right(ends, at - 1) + 1 if at else 1
    functions: list[_Function] = []
    slot: list[list[tuple[int, int, int]]] = []  # comment groups since the last declaration
    above: _Function | None = None  # the last declaration, if it is a function
    at, i, n = -1, 0, len(tokens)  # index of the last comment token

    def comments(before: int | None = None) -> list[_Comment]:
        out = []
        for group in slot:
            members = [t for t in group if before is None or line(t[1]) < before]
            if members:
                out.append(_Comment(line(members[0][1]), line(members[-1][2] - 1), members))
        return out

    while i < n:
        kind, s, e = tokens[i]
        if kind in (LINE, BLOCK):
            if slot and at == i - 1 and text.count("\n", tokens[i - 1][2], s) <= 1 and not text[tokens[i - 1][2] : s].strip():
                slot[-1].append(tokens[i])
                at = i
            elif not text[text.rfind("\n", 0, s) + 1 : s].strip():
                slot.append([tokens[i]])
                at = i
            i += 1
            continue
        if kind == FUNC:
            before = text[text.rfind("\n", 0, s) + 1 : s].rstrip()
            if (not before.strip() or before.endswith((";", "}", "*/"))) and (found := _function(text, tokens, closes, i)):
                symbol, parameters, last = found
                own = _Function(symbol, parameters, line(s), line(tokens[last][1]))
                own.above = comments(own.first)
                if above:
                    above.below = own.above
                functions.append(own)
                above, slot, i = own, [], last + 1
                continue
            i += 1
            continue
        if kind == OPEN:
            k = closes[i]
            if k < 0:
                i += 1  # cut off: look at what is inside, a declaration there is none at top level
                if text[s] == "{":
                    break
                continue
            if above:
                above.below = comments(line(s))
            above, slot, i = None, [], k + 1
            continue
        i += 1
    if above and not above.below:
        above.below = comments()
    return functions


def candidates(text: str, least: int = LEAST_WORDS) -> tuple[list[_Function], list[_Comment], dict[tuple[int, int], float]]:
    """(functions, comments, weights of the graph) of a text: every comment next to a function is a candidate."""
    functions = _top_level(text, _tokens(text))
    numbers: dict[int, int] = {}
    comments: list[_Comment] = []
    weights: dict[tuple[int, int], float] = {}
    for f, own in enumerate(functions):
        for side in (own.above, own.below):
            for c in side:
                first = c.members[0][1]
                if first not in numbers:
                    numbers[first] = len(comments)
                    comments.append(c)
                weights[f, numbers[first]] = weight(text, own, c, least)
    return functions, comments, weights


def weight(text: str, function: _Function, comment: _Comment, least: int = LEAST_WORDS) -> float:
    """How well a comment fits a function."""
    raw = text[comment.members[0][1] : comment.members[-1][2]]
    if comment.last < function.first:
        gap = function.first - comment.last - 1
        if gap == 0:
            out = ADJACENT if describes(_paragraphs(text, comment), function.symbol, least) else TOUCHING
        else:
            out = ABOVE / (1 + gap)
    else:
        out = BELOW / (1 + comment.first - function.last)
    names = NAME.findall(raw)
    words = set(names)
    name = function.symbol.rpartition(".")[2]
    out += OPENS_WITH_NAME * bool(names and names[0] == name) + NAMED * (name in words)
    wanted = {m for m in NAME.findall(COMMENTS.sub(" ", function.parameters)) if len(m) > 1}
    if wanted:
        tagged = {a or b for a, b in TAG.findall(raw)}
        out += (PARAMETERS * len(wanted & words) + TAGGED * len(wanted & tagged)) / len(wanted)
    return out


def _paragraphs(text: str, comment: _Comment) -> list[str]:
    return comment_paragraphs([(kind, text[s:e]) for kind, s, e in comment.members])


def pairs_in(text: str, max_gap: int = 0, least: int = LEAST_WORDS) -> list[tuple[str, str, int, int]]:
    """(symbol, description, line of ``func``, gap) of each documented function that stands whole in ``text``.

    The gap is the number of lines between the comment's last line and the function's, or minus the distance of a comment
    below from the function's end. Each comment serves one function at most. A link over more than ``max_gap`` lines is
    rejected, and one over any gap unless the comment opens with the function's name.
    """
    functions, comments, weights = candidates(text, least)
    out = []
    for f, c in sorted(assign(weights).items()):
        own, comment = functions[f], comments[c]
        gap = own.first - comment.last - 1 if comment.last < own.first else own.last - comment.first
        if abs(gap) > max_gap:
            continue
        if gap and (first := NAME.search(text, comment.members[0][1], comment.members[-1][2])) is not None and first.group() != own.symbol.rpartition(".")[2]:
            continue
        kind, _, end = comment.members[-1]
        if kind == BLOCK and not text[:end].endswith("*/"):
            continue
        paragraphs = _paragraphs(text, comment)
        if describes(paragraphs, own.symbol, least):
            out.append((own.symbol, "\n\n".join(paragraphs), own.first, gap))
    return out


PAIR_SCHEMA = "span_id string, symbol string, description string, decl_line int, gap int"


def function_doc_pairs(spans: DataFrame, id_col: str = "id", path_col: str = "path", text_col: str = "text", suffix: str = ".go", max_gap: int = 0, least: int = LEAST_WORDS) -> DataFrame:
    """``span_id, symbol, description, decl_line, gap`` of the documented functions in each text.

    Rows with a null id, path or text, and texts without a function, give nothing; repeated rows count once; other
    columns are ignored. Texts are scanned whole, one at a time, so nothing grows with a group of rows.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, str, str, int, int]] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out += [(key, *pair) for pair in pairs_in(text, max_gap, least)]
            columns = list(zip(*out)) or [(), (), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.int32())],
                ["span_id", "symbol", "description", "decl_line", "gap"],
            )

    comment_above = r"(?:\*/|//[^\n]*)[ \t\r]*\n" if max_gap == 0 else r"(?:\*/|//)"
    return (
        only(spans, id_col, path_col, text_col)
        .where(F.col(path_col).endswith(suffix) & F.col(id_col).isNotNull())
        .select(F.col(id_col).cast("string").alias("span_id"), F.col(text_col).alias("text"))
        .where(F.col("text").contains("func") & F.col("text").rlike(comment_above))
        .mapInArrow(scan, PAIR_SCHEMA)
        .distinct()
    )


def listed_pairs(pairs: DataFrame, spans: DataFrame, cases: DataFrame) -> DataFrame:
    """``repo_id, listed, paired`` for a list of documented functions (``repo_id, path, symbol, kind, doc_of``), counted once each.

    Kinds and symbols of the list are read in any spelling; a row without repository, path or symbol is not listed. Spans
    without repository or path are in no list.
    """
    plain = lambda c: F.lower(F.regexp_replace(c, r"[()*\s]", ""))
    cases, spans = only(cases, "repo_id", "path", "symbol", "kind", "doc_of"), only(spans, "id", "repo_id", "path")
    func = F.coalesce(plain(F.col("kind")), F.lit("func")).isin("func", "method") & (F.coalesce(plain(F.col("doc_of")), F.lit("decl")) == "decl")
    listed = cases.where(func & (plain(F.col("symbol")) != "")).select("repo_id", "path", plain(F.col("symbol")).alias("symbol")).dropna().distinct()
    where = spans.where(F.col("id").isNotNull()).select(F.col("id").cast("string").alias("span_id"), "repo_id", "path").dropna().distinct()
    found = pairs.join(where, "span_id").select("repo_id", "path", plain(F.col("symbol")).alias("symbol")).distinct().withColumn("_there", F.lit(1))
    return listed.join(found, ["repo_id", "path", "symbol"], "left").groupBy("repo_id").agg(F.count(F.lit(1)).alias("listed"), F.count("_there").alias("paired"))
