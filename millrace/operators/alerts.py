"""Counters, histograms and alert rules over events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded_counts(events: DataFrame, label: str, closed: list[str]) -> DataFrame:
    """A count for every value of a closed set of labels, zero for those that did not occur; others are not counted."""
    seed = events.sparkSession.createDataFrame([(x,) for x in closed], f"{label} string")
    return seed.join(events.groupBy(label).agg(F.count(F.lit(1)).alias("n")), label, "left").select(label, F.coalesce("n", F.lit(0)).alias("n"))


def cumulative_histogram(values: DataFrame, keys: list[str], value: str, bounds: list[float]) -> DataFrame:
    """``keys, le, n``: values up to each bound, the last bound being infinity. NaN and null are no observations."""
    rows = values.where(F.col(value).isNotNull() & ~F.isnan(value))
    wide = rows.groupBy(*keys).agg(*[F.count_if(F.col(value) <= b).alias(f"_{i}") for i, b in enumerate(bounds)], F.count(F.lit(1)).alias("_inf"))
    each = [F.struct(F.lit(float(b)).alias("le"), F.col(f"_{i}").alias("n")) for i, b in enumerate(bounds)] + [F.struct(F.lit(float("inf")).alias("le"), F.col("_inf").alias("n"))]
    return wide.select(*keys, F.explode(F.array(*each)).alias("_b")).select(*keys, "_b.le", "_b.n")


def histogram_quantile(histogram: DataFrame, keys: list[str], q: float) -> DataFrame:
    """``keys, value``: the quantile read off a cumulative histogram, linear inside a bucket; in the last bucket its lower bound."""
    order = Window.partitionBy(*keys).orderBy("le")
    placed = histogram.withColumns({"_below": F.coalesce(F.lag("n").over(order), F.lit(0)), "_from": F.coalesce(F.lag("le").over(order), F.lit(0.0)), "_all": F.max("n").over(Window.partitionBy(*keys))})
    rank = F.lit(q) * F.col("_all")
    inside = placed.where((F.col("_all") > 0) & (F.col("n") >= rank) & ((F.col("_below") < rank) | ((rank == 0) & (F.col("_below") == 0))))
    value = F.when(F.col("le") == float("inf"), F.col("_from")).otherwise(F.col("_from") + (F.col("le") - F.col("_from")) * F.coalesce(F.try_divide(rank - F.col("_below"), F.col("n") - F.col("_below")), F.lit(0.0)))
    return inside.groupBy(*keys).agg(F.min_by(value, "le").alias("value"))


def ratio_rule(events: DataFrame, bad: Column, ts: str, window: str, slide: str, bound: float, least: int) -> DataFrame:
    """``at, bad, total, ratio, firing`` of sliding windows: the share of bad events is above ``bound``, of more than ``least``."""
    # Counted by slide first, so that sliding does not multiply the events.
    slides = events.groupBy(F.window(ts, slide).alias("_w")).agg(F.count_if(bad).alias("_b"), F.count(F.lit(1)).alias("_n"))
    slid = slides.select(F.window(F.col("_w.start"), window, slide).alias("_w"), "_b", "_n").groupBy("_w").agg(F.sum("_b").alias("bad"), F.sum("_n").alias("total"))
    ratio = F.try_divide(F.col("bad"), F.col("total"))
    return slid.select(F.col("_w.end").alias("at"), "bad", "total", F.round(ratio, 9).alias("ratio"), ((ratio > bound) & (F.col("total") > least)).alias("firing"))


def held(evaluations: DataFrame, at: str, firing: str, step_s: int, hold_s: int) -> DataFrame:
    """``starts, ends, evaluations`` of stretches in which a rule fired at every step for ``hold_s`` seconds at least."""
    on = evaluations.where(F.col(firing)).select((F.unix_micros(at) / 1_000_000).cast("long").alias("_t"))
    on = on.withColumn("_island", F.col("_t") - F.row_number().over(Window.orderBy("_t")) * step_s)
    runs = on.groupBy("_island").agg(F.min("_t").alias("starts"), F.max("_t").alias("ends"), F.count(F.lit(1)).alias("evaluations"))
    return runs.where(F.col("ends") - F.col("starts") >= hold_s).select("starts", "ends", "evaluations")


def absent(events: DataFrame, expected: list[str], label: str, ts: str, width: str) -> DataFrame:
    """``at, label`` of windows in which an expected label did not occur, between the first and the last window."""
    windows = events.select(F.window(ts, width)["start"].alias("at"), label).distinct()
    step = f"INTERVAL {width}"
    grid = windows.agg(F.min("at").alias("a"), F.max("at").alias("b")).where("a IS NOT NULL").select(F.explode(F.expr(f"sequence(a, b, {step})")).alias("at"))
    wanted = grid.withColumn(label, F.explode(F.array(*[F.lit(x) for x in expected])))
    return wanted.join(windows, ["at", label], "left_anti")


def rolling_spend(events: DataFrame, key: str, ts: str, amount: str, seconds: int = 3600) -> DataFrame:
    """Each event with what its key spent in the ``seconds`` up to it."""
    # Each event also stands in the next stretch of time, so that a stretch of a key is all its window needs.
    second = (F.unix_micros(ts) / 1_000_000).cast("long")
    own = F.floor(F.col("_s") / (seconds + 1)).cast("long")
    both = events.withColumn("_s", second).withColumn("_own", own).withColumn("_stretch", F.explode(F.array("_own", F.col("_own") + 1)))
    frame = Window.partitionBy(key, "_stretch").orderBy("_s").rangeBetween(-seconds, 0)
    return both.withColumn("spent", F.sum(amount).over(frame)).where(F.col("_own") == F.col("_stretch")).drop("_s", "_own", "_stretch")


def count_rule(events: DataFrame, bad: Column, ts: str, width: str, least: int) -> DataFrame:
    """``at, bad, firing`` of tumbling windows: more than ``least`` bad events. Windows without a bad event don't occur."""
    counted = events.where(bad).groupBy(F.window(ts, width)["end"].alias("at")).agg(F.count(F.lit(1)).alias("bad"))
    return counted.withColumn("firing", F.col("bad") > least)


def gauge_rule(samples: DataFrame, label: str, ts: str, value: str, width: str, below: float, tie: str) -> DataFrame:
    """``at, label, value, firing``: the last sample of each label in a window is below a bound, or is no number.

    ``up == 0`` is ``below=1``. Of samples at one time the greatest ``tie`` is the last.
    """
    last = samples.groupBy(F.window(ts, width)["end"].alias("at"), label).agg(F.max_by(value, F.struct(ts, tie)).alias("value"))
    return last.withColumn("firing", F.col("value").isNull() | F.isnan("value") | (F.col("value") < below))
