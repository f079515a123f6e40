"""Cutting sources into line-addressed spans."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import golang, text as T


def check_windows(width: int, overlap: int, longest: int | None = None) -> None:
    """Refuses options that can't tile."""
    if width < 1 or not 0 <= overlap < width or (longest is not None and longest < 1):
        raise ValueError("a window needs at least one line and an overlap below its length")


def tiles(first: Column, last: Column, width: int, overlap: int) -> Column:
    """Starts of windows of ``width`` lines over ``first..last``; the last one ends at ``last``."""
    return F.sequence(first, F.greatest(first, last - F.lit(overlap)), F.lit(width - overlap))


def windows(sources: DataFrame, keys: list[str], text: str, width: int = 40, overlap: int = 10) -> DataFrame:
    """``keys, kind, symbol, start_line, end_line, text`` of every window with a letter or digit in it."""
    check_windows(width, overlap)
    lines = sources.select(*keys, T.lines_of(F.col(text)).alias("_lines")).where(F.size("_lines") > 0)
    cut = lines.withColumn("start_line", F.explode(tiles(F.lit(1), F.size("_lines"), width, overlap)))
    cut = cut.withColumn("end_line", F.least(F.col("start_line") + width - 1, F.size("_lines")))
    body = F.array_join(F.slice("_lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    out = cut.select(*keys, F.lit("file").alias("kind"), F.lit("").alias("symbol"), "start_line", "end_line", body.alias("text"))
    return out.where(T.has_tokens(F.col("text")))


def _over_sources(sources: DataFrame, key: str, schema: str, each) -> DataFrame:
    """Rows that ``each(path, text)`` gives, behind the key; batches are bounded by Arrow."""
    names = [c.split()[0] for c in schema.split(", ")]
    target = sources.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        for batch in batches:
            rows = [(k, *row) for k, p, t in zip(*(batch.column(i).to_pylist() for i in range(3))) for row in each(p, t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], names)

    return sources.where(F.col("text").isNotNull() & F.col(key).isNotNull()).select(key, F.coalesce("path", F.lit("")).alias("path"), "text").mapInArrow(run, schema)


def declaration_chunks(sources: DataFrame, key: str, width: int = 40, overlap: int = 10, longest: int = 200) -> DataFrame:
    """One chunk for each top-level declaration of a Go source, with its documentation; windows for longer ones, for
    sources that aren't Go and for Go that doesn't parse."""
    check_windows(width, overlap, longest)

    def tile(first: int, last: int) -> Iterator[tuple[int, int]]:
        while True:
            end = min(first + width - 1, last)
            yield first, end
            if end == last:
                return
            first = end - overlap + 1

    def each(path: str, text: str) -> Iterator[tuple[str, str, int, int, str]]:
        if not text.strip():
            return
        lines = text.removesuffix("\n").split("\n")
        found = None
        if path.endswith(".go"):
            source = golang.Source(text)
            if source.whole:
                found = golang.declarations(source)
        ranges = []
        for kind, symbol, a, b, _, _ in found or []:
            ranges += [(kind, symbol, a, b)] if b - a < longest else [("file", "", *t) for t in tile(a, b)]
        if found is None:
            ranges = [("file", "", *t) for t in tile(1, len(lines))]
        for kind, symbol, a, b in ranges:
            body = "\n".join(lines[a - 1 : b])
            if any(c.isalnum() for c in body):
                yield kind, symbol, a, b, body

    return _over_sources(sources, key, f"{key} string, kind string, symbol string, start_line int, end_line int, text string", each)


def golden_cases(sources: DataFrame, key: str) -> DataFrame:
    """Questions with known answers: the comments of exported declarations and group members of Go sources that parse.

    ``symbol, kind, doc_of, question, start_line, end_line, raw_start, raw_end, grouped``; lines without and with the comment,
    which takes no lines away. Comments without a word give no case.
    """

    def each(path: str, text: str) -> Iterator[tuple]:
        if not path.endswith(".go"):
            return
        source = golang.Source(text)
        for kind, symbol, of, question, raw, first, last, grouped in golang.documented(source) if source.whole else ():
            if symbol and all(p[:1].isupper() for p in symbol.split(".")) and any(c.isalpha() for c in question):
                yield symbol, kind, of, question, first, last, raw, last, grouped

    return _over_sources(sources, key, f"{key} string, symbol string, kind string, doc_of string, question string, start_line int, end_line int, raw_start int, raw_end int, grouped boolean", each)


def golden_ledger(sources: DataFrame, key: str) -> DataFrame:
    """``reason, n`` for each source: documented declarations that gave a case (``case``), that are not exported, or whose comment has
    no word; a Go source that doesn't parse counts once."""

    def each(path: str, text: str) -> Iterator[tuple[str, int]]:
        if not path.endswith(".go"):
            return
        source = golang.Source(text)
        if not source.whole:
            yield "unparsed", 1
            return
        counts: dict[str, int] = {}
        for _, symbol, _, question, *_ in golang.documented(source):
            exported = symbol and all(p[:1].isupper() for p in symbol.split("."))
            reason = "case" if exported and any(c.isalpha() for c in question) else "empty" if exported else "unexported"
            counts[reason] = counts.get(reason, 0) + 1
        yield from counts.items()

    return _over_sources(sources, key, f"{key} string, reason string, n int", each)


def go_calls(sources: DataFrame, key: str) -> DataFrame:
    """``caller, callee, line, offset`` of the calls in Go sources that parse."""

    def each(path: str, text: str) -> list[tuple[str, str, int, int]]:
        if not path.endswith(".go"):
            return []
        source = golang.Source(text)
        return golang.calls(source) if source.whole else []

    return _over_sources(sources, key, f"{key} string, caller string, callee string, line int, offset int", each)


def go_units(sources: DataFrame, key: str, longest: int = 200) -> DataFrame:
    """Functions and calls of Go sources from one parse: rows with a null ``callee`` are functions ``symbol, start_line, end_line``, the
    others the calls of the function ``symbol`` with ``callee, line, offset``. Functions longer than ``longest`` lines, or without a letter
    or digit, aren't listed, their calls are."""

    def each(path: str, text: str) -> Iterator[tuple]:
        source = golang.Source(text) if path.endswith(".go") and text.strip() else None
        if source is None or not source.whole:
            return
        lines = text.removesuffix("\n").split("\n")
        for kind, symbol, a, b, _, _ in golang.declarations(source) or []:
            if kind == "func" and b - a < longest and any(c.isalnum() for x in lines[a - 1 : b] for c in x):
                yield symbol, a, b, None, None, None
        for caller, callee, line, offset in golang.calls(source):
            yield caller, None, None, callee, line, offset

    return _over_sources(sources, key, f"{key} string, symbol string, start_line int, end_line int, callee string, line int, offset int", each)


def strip_doc_comments(sources: DataFrame, key: str) -> DataFrame:
    """Texts without documentation comments, line for line; a Go source that doesn't parse is left out, others stay."""

    def each(path: str, text: str) -> list[tuple[str]]:
        if not path.endswith(".go"):
            return [(text,)]
        bare = golang.without_docs(text)
        return [] if bare is None else [(bare,)]

    return _over_sources(sources, key, f"{key} string, text string", each)
