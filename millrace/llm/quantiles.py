"""Percentiles of very large numeric columns.

Digests are tables of weighted centroids. Sorted values are clustered under a size function that allows few values
to a cluster near the ends and many in the middle; digests are merged by clustering their centroids again, so the
digest of a long period comes from the digests of its days. A second pass over the values counts those below and
up to each estimate, which gives its true rank and thereby an error that is measured, not assumed.

The values cross the network once: all parts of a group meet in one task, which clusters each part, merges the parts'
digests and counts. Groups too large for one task are cut into salts; each salt gives digests, which are merged by SQL
windows, and the values are counted in a join. Both ways compute the same function of digests.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.skew import hot_keys
from millrace.session import cut
from millrace.sources.tables import only

#: Most clusters of a digest are about COMPRESSION / 2.
COMPRESSION = 200.0
QUANTILES = {"p10": 0.1, "median": 0.5, "p90": 0.9}
#: Columns by which repeated rows are told.
OUTCOMES = ("case_id", "repo_id", "arm_name", "top_score", "hits", "vector_ran", "gold_rank", "answer_has_gold", "scoreable", "recorded_at", "arrived_at")
#: The rank error promised for every estimate, as a share of the group's values (or one value, where that is more).
PROMISED = 0.02


def cluster_of(q: Column, compression: float) -> Column:
    """Number of the cluster of the value at quantile ``q``: floor of the arcsine scale function."""
    return F.floor(F.asin(F.least(F.greatest(2 * q - 1, F.lit(-1.0)), F.lit(1.0))) * (compression / (2 * math.pi))).cast("int")


def digest(values: DataFrame, keys: list[str], value: str, compression: float = COMPRESSION) -> DataFrame:
    """Centroids ``keys, mean, weight, low, high`` of each group's values."""
    ones = values.select(*keys, F.col(value).cast("double").alias("mean"), F.lit(1).cast("long").alias("weight"))
    return recluster(ones.withColumns({"low": F.col("mean"), "high": F.col("mean")}), keys, compression)


def recluster(centroids: DataFrame, keys: list[str], compression: float = COMPRESSION) -> DataFrame:
    """The merged digest of all centroids of a group."""
    group = Window.partitionBy(*keys)
    before = group.orderBy("mean", "low", "high", "weight").rowsBetween(Window.unboundedPreceding, -1)
    middle = (F.coalesce(F.sum("weight").over(before), F.lit(0)) + F.col("weight") / 2) / F.sum("weight").over(group)
    return (
        centroids.withColumn("_cluster", cluster_of(middle, compression))
        .groupBy(*keys, "_cluster")
        .agg((F.sum(F.col("mean") * F.col("weight")) / F.sum("weight")).alias("mean"), F.sum("weight").alias("weight"), F.min("low").alias("low"), F.max("high").alias("high"))
        .drop("_cluster")
    )


def estimates(centroids: DataFrame, keys: list[str], quantiles: dict[str, float]) -> DataFrame:
    """``keys, n`` and an estimate for each quantile, interpolated between the middles of neighbouring centroids."""
    order = Window.partitionBy(*keys).orderBy("mean", "low", "high", "weight")
    total = F.sum("weight").over(Window.partitionBy(*keys))
    placed = centroids.withColumns({"_n": total, "_to": F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    placed = placed.withColumn("_at", F.col("_to") - F.col("weight") / 2)
    placed = placed.withColumns({"_next": F.lead("mean").over(order), "_next_at": F.lead("_at").over(order), "_first": F.row_number().over(order) == 1})
    picked = {}
    for name, q in quantiles.items():
        target = F.col("_n") * q
        between = F.col("mean") + (F.col("_next") - F.col("mean")) * (target - F.col("_at")) / (F.col("_next_at") - F.col("_at"))
        picked[name] = F.coalesce(
            F.max(F.when((F.col("_at") <= target) & (F.col("_next_at") > target), between)),
            F.max(F.when(F.col("_first") & (target < F.col("_at")), F.col("low"))),
            F.max("high"),
        )
    return placed.groupBy(*keys).agg(F.max("_n").alias("n"), *(e.alias(name) for name, e in picked.items()))


def _starts(*codes: np.ndarray) -> np.ndarray:
    """Where a new run of equal codes begins; empty for no rows."""
    n = len(codes[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in codes:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """A number for each value, -1 for null."""
    encoded = column.combine_chunks().dictionary_encode()
    return encoded.indices.fill_null(-1).to_numpy(zero_copy_only=False)


class Digests:
    """Digests of many groups one after the other: centroids, ordered by mean within each, and where each begins."""

    def __init__(self, mean: np.ndarray, weight: np.ndarray, low: np.ndarray, high: np.ndarray, starts: np.ndarray) -> None:
        self.mean, self.weight, self.low, self.high, self.starts = mean, weight, low, high, starts
        self.n = np.add.reduceat(weight, starts) if len(starts) else np.zeros(0, np.int64)
        self.owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(mean))))
        self.base = np.cumsum(self.n) - self.n
        self.at = np.cumsum(weight) - weight / 2  # middle of each centroid, counted over all groups

    def clustered(self, compression: float) -> Digests:
        """The same groups, clustered under the size function."""
        q = (self.at - self.base[self.owner]) / np.maximum(self.n, 1)[self.owner]
        cluster = np.floor(np.arcsin(np.clip(2 * q - 1, -1.0, 1.0)) * (compression / (2 * math.pi)))
        cut = _starts(self.owner, cluster)
        weight = np.add.reduceat(self.weight, cut) if len(cut) else self.weight
        mean = np.add.reduceat(self.mean * self.weight, cut) / weight if len(cut) else self.mean
        low, high = (f.reduceat(x, cut) if len(cut) else x for f, x in ((np.minimum, self.low), (np.maximum, self.high)))
        return Digests(np.clip(mean, low, high), weight, low, high, np.searchsorted(cut, self.starts))

    def merged(self, groups: np.ndarray, compression: float) -> Digests:
        """One digest for each run of equal ``groups`` (a number for each digest, ascending)."""
        owner = groups[self.owner]
        order = np.lexsort((self.weight, self.high, self.low, self.mean, owner))
        return Digests(*(x[order] for x in (self.mean, self.weight, self.low, self.high)), _starts(owner[order])).clustered(compression)

    def estimate(self, q: float) -> np.ndarray:
        """Each group's estimate, interpolated between the middles of neighbouring centroids."""
        if not len(self.starts):
            return np.zeros(0)
        target = self.base + self.n * q
        after = np.searchsorted(self.at, target, "right")
        ends = np.append(self.starts[1:], len(self.mean))
        a, b = np.clip(after - 1, 0, len(self.mean) - 1), np.clip(after, 0, len(self.mean) - 1)
        gap = self.at[b] - self.at[a]
        between = self.mean[a] + (self.mean[b] - self.mean[a]) * (target - self.at[a]) / np.where(gap > 0, gap, 1)
        return np.where(after <= self.starts, self.low[self.starts], np.where(after >= ends, np.maximum.reduceat(self.high, self.starts), between))


def _rank_error(values: np.ndarray, starts: np.ndarray, n: np.ndarray, estimate: np.ndarray, q: float) -> np.ndarray:
    """Distance of the wanted rank from the ranks the estimates really hold, by counting the values below and up to them."""
    each = np.repeat(estimate, n)
    below, upto = (np.add.reduceat(x.astype(np.int64), starts) for x in (values < each, values <= each))
    return np.maximum(np.maximum(below - n * q, n * q - upto), 0) / n


def _whole_groups(rows: DataFrame, keys: list[str], part: str, quantiles: dict[str, float], compression: float, schema: str) -> DataFrame:
    """Percentiles of groups that fit in one task; ``rows``: ``keys, part, _value, _h1, _h2``, equal hashes being repeats."""

    def percentiles(table: pa.Table) -> Iterator[pa.RecordBatch]:
        h1, h2, value = (table[c].to_numpy() for c in ("_h1", "_h2", "_value"))
        group, day = [_codes(table[k]) for k in keys], _codes(table[part])
        first = _starts(*group, day, value, h1, h2)
        value, day, group = value[first], day[first], [g[first] for g in group]
        days, wholes = _starts(*group, day), _starts(*group)
        ones = np.ones(len(value), np.int64)
        by_day = Digests(value, ones, value, value, days).clustered(compression)
        group_of_day = np.searchsorted(wholes, days, "right") - 1
        over = by_day.merged(group_of_day, compression)
        for digests, starts, null_part in ((by_day, days, False), (over, wholes, True)):
            heads = table.select([*keys, part]).take(pa.array(first[starts]))
            out = [*(heads[k].combine_chunks() for k in keys), pa.nulls(len(starts), heads[part].type) if null_part else heads[part].combine_chunks(), pa.array(digests.n)]
            estimates = [digests.estimate(q) for q in quantiles.values()]
            out += [pa.array(e) for e in estimates]
            out += [pa.array(_rank_error(value, starts, digests.n, e, q)) for e, q in zip(estimates, quantiles.values())]
            whole = pa.table(out, names=[c.split("`")[1] for c in schema.split(", ")])
            yield from whole.to_batches(max_chunksize=10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of groups that may go on in the next batch
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < 50_000:
                continue
            table = pa.Table.from_batches(held)
            last = int(_starts(*[_codes(table[k]) for k in keys])[-1])
            if last:
                yield from percentiles(table.slice(0, last))
            held = table.slice(last).combine_chunks().to_batches()
            size = table.num_rows - last
        if size:
            yield from percentiles(pa.Table.from_batches(held))

    return rows.repartition(*keys).sortWithinPartitions(*keys, part, "_value", "_h1", "_h2").mapInArrow(run, schema)


def grouped_percentiles(
    values: DataFrame, keys: list[str], part: str, value: str, spread: list[str], quantiles: dict[str, float] | None = None, compression: float = COMPRESSION, least_hot: int = 100_000, repeats: bool = False
) -> DataFrame:
    """Percentiles of ``value`` for each ``keys, part`` and, from the parts' digests, for each ``keys`` (``part`` null).

    Columns: ``keys, part, n``, an estimate for each quantile and ``<quantile>_rank_error``, the distance of its true
    rank from the wanted one as a share of n, and ``rank_error_bound``, the promise. Null and NaN values don't count;
    a null key is a group of its own; ``part`` must not be null. With ``repeats``, rows equal in ``spread``, group, part and
    value count once. A group of ``least_hot`` rows or more, if it also has at least 1/1024 of all, is cut by the hash of ``spread`` into digests of
    its own, which are merged; its rows never meet in one task.
    """
    quantiles = quantiles or QUANTILES
    kinds = dict(values.dtypes)
    known = values.where(F.col(value).isNotNull() & ~F.isnan(value))
    hashes = (F.xxhash64(*spread), F.hash(*[F.struct(c) for c in spread])) if repeats else (F.monotonically_increasing_id(), F.lit(0))
    rows = known.select(*keys, part, F.col(value).cast("double").alias("_value"), hashes[0].alias("_h1"), hashes[1].alias("_h2"))
    names = [*((k, kinds[k]) for k in keys), (part, kinds[part]), ("n", "bigint"), *((q, "double") for q in quantiles), *((f"{q}_rank_error", "double") for q in quantiles)]
    schema = ", ".join(f"`{name}` {kind}" for name, kind in names)
    hot = hot_keys(rows.select(F.struct(*keys).alias("_g")), ["_g"], least_hot).select("_g").collect()  # 1,024 at most
    if not hot:
        out = _whole_groups(rows, keys, part, quantiles, compression, schema)
    else:
        wanted = f"_hot struct<{', '.join(f'`{k}`: {kinds[k]}' for k in keys)}>"
        table = rows.sparkSession.createDataFrame([(tuple(r._g),) for r in hot], wanted)
        marked = rows.withColumn("_g", F.struct(*keys)).join(F.broadcast(table), F.col("_g").eqNullSafe(F.col("_hot")), "left").drop("_g")
        cold = marked.where(F.col("_hot").isNull()).drop("_hot")
        big = marked.where(F.col("_hot").isNotNull()).drop("_hot")
        big = big.dropDuplicates([*keys, part, "_value", "_h1", "_h2"]) if repeats else big
        out = _whole_groups(cold, keys, part, quantiles, compression, schema).unionByName(_cut_groups(big, keys, part, quantiles, compression, least_hot))
    return out.withColumn("rank_error_bound", F.greatest(F.lit(PROMISED), 1 / F.col("n")))


def _cut_groups(values: DataFrame, keys: list[str], part: str, quantiles: dict[str, float], compression: float, least_hot: int) -> DataFrame:
    """The same for groups of any size: digests of salts, merged by windows; the values are read again for the count."""
    rows = cut(values.select(F.struct(*keys).alias("_g"), part, "_value", F.xxhash64("_h1").alias("_spread")))
    hot = F.broadcast(hot_keys(rows.select("_g", part), ["_g", part], least_hot))
    rows = rows.join(hot, ["_g", part], "left").withColumn("_salt", F.pmod("_spread", F.coalesce("_salts", F.lit(1))).cast("int")).drop("_spread", "_salts")
    by_salt = digest(rows, ["_g", part, "_salt"], "_value", compression)
    by_part = cut(recluster(by_salt.drop("_salt"), ["_g", part], compression))
    whole = recluster(by_part.drop(part), ["_g"], compression)
    each = estimates(by_part, ["_g", part], quantiles)
    over = estimates(whole, ["_g"], quantiles)
    over_names = {q: f"_over_{q}" for q in quantiles}
    wanted = each.select("_g", part, *quantiles).join(over.select("_g", *(F.col(a).alias(b) for a, b in over_names.items())), "_g")
    wanted = wanted.join(hot, ["_g", part], "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    tried = [*quantiles, *over_names.values()]
    below = {f"_lt_{e}": F.sum((F.col("_value") < F.col(e)).cast("long")) for e in tried}
    upto = {f"_le_{e}": F.sum((F.col("_value") <= F.col(e)).cast("long")) for e in tried}
    counted = rows.join(wanted, ["_g", part, "_salt"]).groupBy("_g", part, "_salt").agg(*(e.alias(a) for a, e in {**below, **upto}.items()))
    counts = [*below, *upto]
    counted = counted.groupBy("_g", part).agg(*(F.sum(c).alias(c) for c in counts))

    def certified(table: DataFrame, names: dict[str, str]) -> dict[str, Column]:
        """Distance of the wanted rank from the ranks the estimate really holds, as a share of n."""
        out = {}
        for q, e in names.items():
            rank = F.col("n") * quantiles[q]
            out[f"{q}_rank_error"] = F.greatest(F.col(f"_lt_{e}") - rank, rank - F.col(f"_le_{e}"), F.lit(0.0)) / F.col("n")
        return out

    finish = lambda df, names: df.withColumns(certified(df, names)).select(*(F.col(f"_g.{k}").alias(k) for k in keys), part, "n", *quantiles, *(f"{q}_rank_error" for q in quantiles))
    day_rows = finish(each.join(counted, ["_g", part]), {q: q for q in quantiles})
    all_counts = counted.groupBy("_g").agg(*(F.sum(c).alias(c) for c in counts))
    kind = dict(values.dtypes)[part]
    all_rows = finish(over.join(all_counts, "_g").withColumn(part, F.lit(None).cast(kind)), over_names)
    return day_rows.unionByName(all_rows)


def score_percentiles(outcomes: DataFrame, least_hot: int = 100_000) -> DataFrame:
    """Percentiles of valid ``top_score`` for each repository and arm, by day and over all days.

    Valid are numbers from -1 to 1; repeated rows count once; rows without ``recorded_at`` belong to no day and are left out.
    """
    names = [c for c in OUTCOMES if c.lower() in {x.lower() for x in outcomes.columns}]
    rows = only(outcomes, *names).where(F.col("top_score").between(-1.0, 1.0) & F.col("recorded_at").isNotNull()).withColumn("day", F.to_date("recorded_at"))
    return grouped_percentiles(rows, ["repo_id", "arm_name"], "day", "top_score", names, least_hot=least_hot, repeats=True)
