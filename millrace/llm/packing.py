"""Filling fixed-capacity containers with items.

Best-two-fit: a bin is filled greedily with the largest documents that fit; then its smallest document is replaced
by the two unpacked ones that fill the gap so widened best, if they fill it better. Documents are spread over groups
of bounded size by a hash of their id, and each group is packed on its own. Bins with room left are emptied and their
documents packed again in other groups of the same bounded size, as long as that saves containers.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import cut
from millrace.sources.tables import only

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splitting pattern of the byte-level vocabularies (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
GROUP_ITEMS = 50_000
MAX_PACKS = 1000
#: Bins filled less than this share are packed again with those of other groups.
LOOSE = 0.995
#: A further level is packed only if the one before saved this share of the containers that it packed again.
LEAST_GAIN = 0.01
_ENCODERS: dict[str, object] = {}


def encoder(vocabulary: str):
    """The tokenizer of a rank file, loaded once a process."""
    if vocabulary not in _ENCODERS:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[vocabulary] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[vocabulary]


def token_sizes(documents: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_key, n_tokens`` of every text that isn't blank: one row for each different text of an id, told apart by ``xxhash64(text)``.

    The vocabulary is read where the session is and shipped to the workers with the job.
    """
    documents.sparkSession.sparkContext.addFile(vocabulary)
    shipped = os.path.basename(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(SparkFiles.get(shipped))
        for batch in batches:
            sizes = [len(own.encode_ordinary(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), pa.array(sizes, pa.int64())], ["doc_id", "text_key", "n_tokens"])

    return (
        only(documents, id_col, text_col)
        .where(F.col(id_col).isNotNull() & F.col(text_col).rlike(r"\S"))
        .select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
        .mapInArrow(count, "doc_id long, text_key long, n_tokens long")
        .groupBy("doc_id", "text_key")
        .agg(F.max("n_tokens").alias("n_tokens"))
    )


def best_two_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Number of each item's bin. ``sizes``: from 1 to ``capacity``.

    Works on counts by size: unpacked items of equal size are interchangeable, so the search for the largest that
    fits and for the best two runs over at most ``capacity`` different sizes, however many items there are.
    """
    order = np.argsort(-sizes, kind="stable")
    starts: dict[int, int] = {}
    counts = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    at = 0
    for s in np.flatnonzero(counts)[::-1]:
        starts[int(s)] = at
        at += int(counts[s])
    bins = np.empty(len(sizes), np.int64)
    left, b = len(sizes), 0
    below = _Below(counts)
    while left:
        content: list[int] = []
        gap = capacity
        while gap and (s := below.upto(gap)):
            fit = min(int(counts[s]), gap // s)
            below.take(s, fit)
            content += [s] * fit
            gap -= fit * s
        if gap and content:
            smallest = content[-1]
            pair = below.best_two(gap + smallest, smallest)
            if pair:
                content.pop()
                below.put(smallest)
                for s in pair:
                    below.take(s, 1)
                content += pair
        for s in content:
            bins[order[starts[s]]] = b
            starts[s] += 1
        left -= len(content)
        b += 1
    return bins


class _Below:
    """Unpacked sizes with their counts: the largest up to a bound, and the two with the largest sum up to a bound."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts
        self.sizes = np.flatnonzero(counts)

    def _clean(self) -> None:
        self.sizes = self.sizes[self.counts[self.sizes] > 0]

    def upto(self, most: int) -> int:
        """0 if there is none."""
        k = int(np.searchsorted(self.sizes, most, "right"))
        return int(self.sizes[k - 1]) if k else 0

    def take(self, size: int, n: int) -> None:
        self.counts[size] -= n
        if not self.counts[size]:
            self._clean()

    def put(self, size: int) -> None:
        self.counts[size] += 1
        if self.counts[size] == 1:
            self.sizes = np.flatnonzero(self.counts)

    def best_two(self, room: int, more_than: int) -> list[int] | None:
        """Two sizes with the greatest sum from ``more_than + 1`` to ``room``."""
        sizes = self.sizes[: np.searchsorted(self.sizes, room, "left")]
        if not len(sizes):
            return None
        other = np.searchsorted(sizes, room - sizes, "right") - 1
        valid = other >= 0
        partner = sizes[np.maximum(other, 0)]
        alone = valid & (partner == sizes) & (self.counts[sizes] < 2)
        lower = np.maximum(other - 1, 0)
        partner = np.where(alone, np.where(other > 0, sizes[lower], 0), partner)
        valid &= partner > 0
        total = np.where(valid, sizes + partner, -1)
        k = int(np.argmax(total))
        return [int(max(sizes[k], partner[k])), int(min(sizes[k], partner[k]))] if total[k] > more_than else None


PACKED = "pack_name string, capacity_tokens int, container_id long, doc_id long, part_no int, token_from long, token_to long, n_tokens long, text_key long"


def _parts(tokens: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the text, first token, size) of each part; only what exceeds the capacity has more than one."""
    n = np.maximum(1, -(-tokens // capacity))
    doc = np.repeat(np.arange(len(tokens)), n)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    start = number * capacity
    return doc, start, np.minimum(capacity, tokens[doc] - start)


def _pack(keys: tuple, batch: pa.Table) -> pa.Table:
    """Packs one group of parts; containers get the group's number in their upper bits."""
    name, capacity, group = (k.as_py() for k in keys)
    order = np.lexsort((batch["token_from"].to_numpy(), batch["text_key"].to_numpy(), batch["doc_id"].to_numpy()))
    batch = batch.take(pa.array(order))
    bins = best_two_fit(batch["n_tokens"].to_numpy().astype(np.int64), capacity)
    n = len(bins)
    filled = np.bincount(bins, weights=batch["n_tokens"].to_numpy())[bins] if n else np.zeros(0)
    return pa.table(
        {
            "pack_name": pa.array([name] * n, pa.string()), "capacity_tokens": pa.array([capacity] * n, pa.int32()), "container_id": pa.array(bins + (group << 32), pa.int64()),
            "doc_id": batch["doc_id"].cast(pa.int64()), "text_key": batch["text_key"].cast(pa.int64()), "token_from": batch["token_from"].cast(pa.int64()), "n_tokens": batch["n_tokens"].cast(pa.int64()), "loose": pa.array(filled < LOOSE * capacity),
        }
    )


def pack(sizes: DataFrame, packs: DataFrame, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Containers for each row of ``packs`` (``pack_name, capacity_tokens``): one row for each part of a document.

    ``sizes``: ``doc_id, n_tokens`` and, where an id has several texts, their ``text_key`` (0 if there is no such column). A document within the capacity is one part, a longer one is cut every
    ``capacity_tokens`` tokens. ``part_no`` counts from 1, ``token_to`` is excluded. Rows without a capacity above 0,
    a name or a size above 0 give nothing. Groups hold about ``group_items`` parts each, whatever the number of rows and
    however much room is left.
    """
    sizes = only(sizes, "doc_id", "n_tokens", "text_key") if "text_key" in sizes.columns else only(sizes, "doc_id", "n_tokens").withColumn("text_key", F.lit(0).cast("long"))
    rows = only(packs, "pack_name", "capacity_tokens").where((F.col("capacity_tokens") > 0) & F.col("pack_name").isNotNull()).select("pack_name", F.col("capacity_tokens").cast("int").alias("capacity")).distinct().limit(MAX_PACKS + 1).collect()
    if len(rows) > MAX_PACKS:
        raise ValueError(f"more than {MAX_PACKS} container sizes")
    wanted = sorted((r.pack_name, r.capacity) for r in rows)
    spark = sizes.sparkSession
    if not wanted:
        return spark.createDataFrame([], PACKED)
    sizes = cut(sizes.where(F.col("doc_id").isNotNull() & (F.col("n_tokens") > 0)).select("doc_id", "text_key", "n_tokens"))
    stat = sizes.agg(F.count(F.lit(1)), F.sum("n_tokens")).first()
    groups = {name: max(1, -(-(stat[0] + (stat[1] or 0) // capacity) // group_items)) for name, capacity in wanted}

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, tokens = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for name, capacity in wanted:
                for lo in range(0, len(ids), 20_000):
                    doc, start, size = _parts(tokens[lo : lo + 20_000], capacity)
                    n = len(doc)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.full(n, capacity, np.int32)), pa.array(ids[lo + doc]), pa.array(texts[lo + doc]), pa.array(start), pa.array(size)], ["pack_name", "capacity", "doc_id", "text_key", "token_from", "n_tokens"])

    all_parts = sizes.mapInArrow(parts, "pack_name string, capacity int, doc_id long, text_key long, token_from long, n_tokens long")
    number = F.lit(0)
    for name, n in groups.items():
        number = F.when(F.col("pack_name") == name, F.pmod(F.xxhash64("doc_id", "text_key", "token_from"), F.lit(n))).otherwise(number)
    schema = "pack_name string, capacity_tokens int, container_id long, doc_id long, text_key long, token_from long, n_tokens long, loose boolean"
    now = cut(all_parts.withColumn("bin_group", number.cast("long")).groupBy("pack_name", "capacity", "bin_group").applyInArrow(_pack, schema))
    packed, level = None, 0
    open_packs = {name for name, n in groups.items() if n > 1}
    while open_packs:
        level += 1
        loose = F.col("loose") & F.col("pack_name").isin(*sorted(open_packs))
        counted = {r.pack_name: r for r in now.where(loose).groupBy("pack_name").agg(F.count(F.lit(1)).alias("parts"), F.countDistinct("container_id").alias("bins")).collect()}
        todo = {name: r for name, r in counted.items() if r.bins > 1}
        if not todo:
            break
        again, group = F.col("loose") & F.col("pack_name").isin(*sorted(todo)), F.lit(0)
        sets = {name: max(1, -(-r.parts // group_items)) for name, r in todo.items()}
        for name, n in sets.items():  # containers stay together, so that a group holds what whole containers held
            group = F.when(F.col("pack_name") == name, F.pmod(F.xxhash64("container_id", F.lit(level)), F.lit(n))).otherwise(group)
        kept = now.where(~again)
        packed = kept if packed is None else packed.unionByName(kept)
        before = now.where(again).withColumn("bin_group", (F.lit(level << 24) + group).cast("long")).withColumnRenamed("capacity_tokens", "capacity").drop("container_id", "loose")
        now = cut(before.groupBy("pack_name", "capacity", "bin_group").applyInArrow(_pack, schema))
        bins = {r.pack_name: r.bins for r in now.groupBy("pack_name").agg(F.countDistinct("container_id").alias("bins")).collect()}
        open_packs = {name for name, r in todo.items() if sets[name] > 1 and bins[name] <= (1 - LEAST_GAIN) * r.bins}
    packed = now if packed is None else packed.unionByName(now)
    return packed.select(
        "pack_name", "capacity_tokens", "container_id", "doc_id", (F.col("token_from") / F.col("capacity_tokens") + 1).cast("int").alias("part_no"),
        "token_from", (F.col("token_from") + F.col("n_tokens")).alias("token_to"), "n_tokens", "text_key",
    )


def pack_report(packed: DataFrame) -> DataFrame:
    """For each container size: containers, tokens, the fewest containers there could be, and the share of room left."""
    filled = packed.groupBy("pack_name", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("filled"))
    return (
        filled.groupBy("pack_name", "capacity_tokens")
        .agg(F.count(F.lit(1)).alias("containers"), F.sum("filled").alias("tokens"), F.max("filled").alias("fullest"))
        .withColumn("least_possible", F.ceil(F.col("tokens") / F.col("capacity_tokens")).cast("long"))
        .withColumn("unused_share", 1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))
    )
