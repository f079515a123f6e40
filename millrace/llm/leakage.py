"""Evaluation texts leaking into training text.

Wu-Manber search with words as symbols. The patterns are all runs of ``RUN`` words of the test items. A shift table
over blocks of two words says how far the search may jump, a block that ends a pattern leads to the bucket of the
patterns with that suffix, those with the same prefix are compared word by word. Occurrences are joined to runs and
runs of one item, in its order and close to one another, to a chain, whose share of the item's words decides.
"""

from __future__ import annotations

import html
import re
import unicodedata
from array import array
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources.tables import only

#: Words in a row that count, least words of an item, and the least share of it.
RUN, LEAST_WORDS, LEAST_SHARE = 6, 20, 0.5
#: Foreign words between two runs, beside those the item itself has there.
MAX_GAP = 25
#: Bytes of passages of one search table, whose objects take some hundred times as many; more are searched in several passes over the documents.
BYTES_A_TABLE = 1_000_000

WORD = re.compile(r"[^\W_]+")
BREAKS = re.compile(r"</?(?:p|br|div|li|ul|ol|td|th|tr|table|h[1-6]|pre|blockquote|hr)\b[^<>]*>", re.I)
TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,300}>")
ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|([nrtbf])|([\"'/\\]))")
#: A word broken at a line end; the next line may open with a comment or quote mark.
BROKEN = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n(?:[ \t]|//|--|[>#*|])*(?=[^\W\d_])")
INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe00-\ufe0f\ufeff]")


def plain(text: str) -> str:
    """The text as it reads: without mark-up, escapes, invisible characters and breaks inside words; lower case."""
    if "\\" in text:
        text = ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else (m[3] or "\n"), text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = TAG.sub("", BREAKS.sub(" ", text))
    if not text.isascii():
        text = INVISIBLE.sub("", unicodedata.normalize("NFKD", text))
        text = "".join(c for c in text if not unicodedata.combining(c)) if not text.isascii() else text
    if "-" in text:
        text = BROKEN.sub("", text)
    return text.lower()


def words(text: str) -> list[str]:
    """The words of a text as it reads."""
    return WORD.findall(plain(text))


class WuManber:
    """All runs of ``run`` words of the items, ready for search."""

    def __init__(self, items: list[tuple[int, list[str]]], run: int = RUN) -> None:
        self.run = run
        self.lengths = {key: len(own) for key, own in items}
        self.ids = {w: i for i, w in enumerate(sorted({w for _, own in items for w in own}), 1)}
        self.base = len(self.ids) + 1
        self.shift: dict[int, int] = {}
        found: list[tuple[int, tuple[int, ...], int, int]] = []
        for number, (_, own) in enumerate(items):
            codes = [self.ids[w] for w in own]
            for at in range(len(codes) - run + 1):
                pattern = tuple(codes[at : at + run])
                for j in range(run - 1):
                    block = pattern[j] * self.base + pattern[j + 1]
                    if (away := run - 2 - j) < self.shift.get(block, run - 1):
                        self.shift[block] = away
                found.append((self._bucket(pattern), pattern, number, at))
        # Patterns lie in flat arrays, those of a bucket (suffix and prefix block) together.
        found.sort()
        self.keys = [key for key, _ in items]
        self.words = array("l", [w for _, p, _, _ in found for w in p])
        self.item, self.at = array("l", [i for _, _, i, _ in found]), array("l", [a for _, _, _, a in found])
        self.first: dict[int, int] = {}
        self.last: dict[int, int] = {}
        for i, (bucket, *_) in enumerate(found):
            self.first.setdefault(bucket, i)
            if i - self.first[bucket]:
                self.last[bucket] = i  # kept for buckets of several patterns only

    def _bucket(self, pattern: tuple[int, ...] | list[int]) -> int:
        return ((pattern[-2] * self.base + pattern[-1]) * self.base + pattern[0]) * self.base + pattern[1]

    def occurrences(self, text_words: list[str]) -> dict[int, list[tuple[int, int]]]:
        """For each item (word of the text, word of the item) at which a pattern begins, in the text's order."""
        get, shift, base, run = self.ids.get, self.shift.get, self.base, self.run
        codes = [get(w, 0) for w in text_words]
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        i, n, far = run - 1, len(codes), run - 1
        while i < n:
            block = codes[i - 1] * base + codes[i]
            away = shift(block, far)
            if away:
                i += away
                continue
            lo = self.first.get(((block * base) + codes[i - far]) * base + codes[i - far + 1])
            if lo is not None:
                here = array("l", codes[i - far : i + 1])
                for k in range(lo, self.last.get(((block * base) + codes[i - far]) * base + codes[i - far + 1], lo) + 1):
                    if self.words[k * run : (k + 1) * run] == here:
                        found[self.keys[self.item[k]]].append((i - far, self.at[k]))
            i += 1
        return found


def best_chain(hits: list[tuple[int, int]], length: int, run: int = RUN, max_gap: int = MAX_GAP) -> tuple[int, int, int]:
    """(item words covered, first word, word behind the last one) of the best chain of runs.

    A run follows another one if it lies behind it in the text and in the item, and if the text has at most
    ``max_gap`` words more between them than the item has.
    """
    runs: list[list[int]] = []  # item from, item to, text from, text to
    latest: dict[int, list[int]] = {}
    for at, own in hits:
        last = latest.get(at - own)
        if last and at <= last[3]:
            last[1], last[3] = own + run, at + run
        else:
            runs.append(last := [own, own + run, at, at + run])
            latest[at - own] = last
    runs.sort(key=lambda r: (r[2], r[0]))
    best = (0, 0, 0)
    covered = [r[1] - r[0] for r in runs]
    start = [r[2] for r in runs]
    floor = 0
    for j, (a, b, s, e) in enumerate(runs):
        while runs[floor][2] < s - 4 * length - 2 * max_gap:
            floor += 1
        for i in range(floor, j):
            pa_, pb, _, pe = runs[i]
            if pa_ < a and pb < b and pe < e and s - pe <= max(a - pb, 0) + max_gap:
                overlap = max(0, pb - a, pe - s)
                if covered[i] + (b - a) - overlap > covered[j]:
                    covered[j], start[j] = covered[i] + (b - a) - overlap, start[i]
        if covered[j] > best[0]:
            best = (covered[j], start[j], e)
    return best


LEAKS = "doc_id long, item_id long, covered_words int, item_words int, word_from int, word_to int"


def leaked_items(documents: DataFrame, items: DataFrame, run: int = RUN, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE, max_gap: int = MAX_GAP, bytes_a_table: int = BYTES_A_TABLE) -> DataFrame:
    """Documents that hold at least ``least_share`` of an item of ``least_words`` words or more, with the place.

    Null ids, null texts and null or shorter passages give nothing; repeated rows count once; of several passages
    under one id the longest holds. The items are a stated set: they go to every task in tables of about ``bytes_a_table``
    bytes of passages, one pass over the documents for each. Documents are searched whole.
    """
    documents = only(documents, "doc_id", "text")
    numbers = only(items, "item_id", "passage").where(F.col("item_id").isNotNull() & F.col("passage").isNotNull()).groupBy("item_id").agg(F.max_by("passage", F.struct(F.length("passage"), "passage")).alias("passage"))
    size = numbers.agg(F.sum(F.octet_length("passage"))).first()[0] or 0
    tables = max(1, -(-size // bytes_a_table))
    out = None
    for block in range(tables):
        rows = numbers.where(F.pmod(F.xxhash64("item_id"), F.lit(tables)) == block).collect()
        own = [(r.item_id, w) for r in rows if len(w := words(r.passage)) >= least_words]
        one = _search(documents, WuManber(own, run), least_share, max_gap)
        out = one if out is None else out.unionByName(one)
    return out


def _search(documents: DataFrame, table: WuManber, least_share: float, max_gap: int) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(table)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for item, hits in own.occurrences(words(text)).items():
                    length = own.lengths[item]
                    if len(hits) + own.run - 1 < least_share * length / own.run:
                        continue
                    covered, a, b = best_chain(hits, length, own.run, max_gap)
                    if covered >= least_share * length:
                        out.append((key, item, covered, length, a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()))], ["doc_id", "item_id", "covered_words", "item_words", "word_from", "word_to"])

    found = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(search, LEAKS)
    best = F.max_by(F.struct("covered_words", "item_words", "word_from", "word_to"), F.struct("covered_words", -F.col("word_from")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("_b")).select("doc_id", "item_id", "_b.*")
