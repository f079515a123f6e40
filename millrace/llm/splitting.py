"""Splitting oversized items at natural boundaries.

Every line end of a text has a boundary strength. A sparse table answers "where in these lines is the strongest
boundary" in constant time, so each piece ends at the strongest one of its permissible window, the rightmost where
several are equally strong, and the next piece begins a fixed overlap before that end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources.tables import only

MAX_RULES = 1000
UNIT = re.compile(r"(?:func|type|var|const|import|package|class|def|async def|@\w|#{1,6}\s|---\s*$|\S[^:\n]*:\s*(?:$|[^/\s]))")
COMMENT = re.compile(r"\s*(?://|/\*|\*/|\*\s|#(?!#*\s))")
OPENERS = ("{", "(", "[", ",", ":")
CLOSES = re.compile(r"[})\]]+[;,]?\s*$")


def split_lines(text: str) -> list[str]:
    """Lines with their terminators; only ``\\n`` ends a line and one at the very end opens no new line."""
    lines = text.split("\n")
    last = lines.pop()
    out = [x + "\n" for x in lines]
    return [*out, last] if last else out


def boundary_strengths(lines: list[str]) -> np.ndarray:
    """Strength of a cut behind each line.

    Blank lines, ends of top-level blocks and beginnings of top-level units are strong, deeper indentation is
    weaker; cuts behind an opening bracket or before a closing one are weaker still, and those between a comment and what it
    stands above the weakest.
    """
    n = len(lines)
    strength = np.zeros(n, np.int32)
    following = 0  # indentation of the next line that isn't blank, the text's end counting as top level
    follower = ""
    for i in range(n - 1, -1, -1):
        line = lines[i]
        bare = line.strip()
        s = 40 - 4 * min(following, 10)
        nearest = lines[i + 1].strip() if i + 1 < n else ""
        if not bare:
            s += 100 if nearest or i + 1 == n else 60
        elif not nearest:
            s += 30
        if following == 0 and nearest and UNIT.match(follower):
            s += 80
        if bare and CLOSES.match(bare):
            s += 10 if line[0].isspace() else 120
        if bare.endswith(OPENERS):
            s -= 25
        if nearest and CLOSES.match(nearest):
            s -= 25
        if bare and COMMENT.match(line) and nearest:
            s -= 90
        if bare:
            following = sum(4 if c == "\t" else 1 for c in line[: len(line) - len(line.lstrip())])
            follower = line
        strength[i] = s
    return strength


class RangeMax:
    """Sparse table: index of the rightmost greatest value of any range, in constant time."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        self.rows = [np.arange(len(values))]
        width = 1
        while 2 * width <= len(values):
            a, b = self.rows[-1][:-width], self.rows[-1][width:]
            self.rows.append(np.where(values[b] >= values[a], b, a))
            width *= 2

    def rightmost(self, low: int, high: int) -> int:
        """Of ``values[low..high]``, both included."""
        level = (high - low + 1).bit_length() - 1
        a, b = int(self.rows[level][low]), int(self.rows[level][high - (1 << level) + 1])
        return b if self.values[b] >= self.values[a] else a


def pieces(strength: np.ndarray, window: int, overlap: int) -> list[tuple[int, int]]:
    """Line ranges (0-based, end excluded) of at most ``window`` lines that cover all lines, sharing ``overlap``."""
    n = len(strength)
    if not 0 <= overlap < window:
        raise ValueError("window_overlap must be at least 0 and below window_lines")
    if n <= window:
        return [(0, n)] if n else []
    table, out, start = RangeMax(strength), [], 0
    shortest = max(overlap + 1, (window + 1) // 2)
    while start + window < n:
        end = table.rightmost(start + shortest - 1, start + window - 1) + 1
        out.append((start, end))
        start = end - overlap
    return [*out, (start, n)]


PIECE_SCHEMA = "arm_name string, span_id string, piece_no int, start_line int, end_line int, text string"


def split_oversized(items: DataFrame, rules: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Pieces of every text with more lines than a rule's ``max_decl_lines``; ``rules`` has the columns of arm_configs.

    A rule without a window has one of ``max_decl_lines`` lines, without an overlap none; an overlap as long as the window is
    one line shorter. Rules without a ``max_decl_lines`` or name, null texts and null ids give nothing; repeated rows count once;
    lines are 1-based and both ends included; joining a text's pieces without their overlaps gives the text back,
    byte for byte. ``rules`` is configuration: more than ``MAX_RULES`` rows are refused.
    """
    items = only(items, id_col, text_col)
    rules = only(rules, "arm_name", "window_lines", "window_overlap", "max_decl_lines")
    rows = rules.where(F.col("max_decl_lines").isNotNull() & F.col("arm_name").isNotNull()).distinct().limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    arms = set()
    for r in rows:
        window = max(1, r.max_decl_lines if r.window_lines is None else r.window_lines)
        arms.add((r.arm_name, window, min(max(0, r.window_overlap or 0), window - 1), r.max_decl_lines))
    arms = sorted(arms)
    spark = items.sparkSession
    if not arms:
        return spark.createDataFrame([], PIECE_SCHEMA)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lines = split_lines(text)
                strength = boundary_strengths(lines)
                out: list[list] = [[], [], [], [], [], []]
                for arm, window, overlap, most in arms:
                    if len(lines) > most:
                        for k, (a, b) in enumerate(pieces(strength, window, overlap)):
                            for column, x in zip(out, (arm, key, k + 1, a + 1, b, "".join(lines[a:b]))):
                                column.append(x)
                if out[0]:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, t) for x, t in zip(out, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()))],
                        ["arm_name", "span_id", "piece_no", "start_line", "end_line", "text"],
                    )

    text = F.col(text_col)
    n_lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + F.when(text.endswith("\n") | (text == ""), 0).otherwise(1)
    return (
        items.where(F.col(id_col).isNotNull() & (n_lines > min(a[3] for a in arms)))
        .select(F.col(id_col).cast("string").alias("span_id"), text.alias("text"))
        .distinct()
        .mapInArrow(cut, PIECE_SCHEMA)
    )
