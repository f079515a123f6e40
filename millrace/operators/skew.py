"""Joins and limits that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of all rows; so there are at most HOT_SHARE hot keys, whatever the data.
HOT_SHARE = 1024


def hot_keys(df: DataFrame, keys: list[str], least: int = 100_000) -> DataFrame:
    """Keys with at least ``max(least, rows / HOT_SHARE)`` rows, with ``_salts``, the parts to cut them into.

    By the pigeonhole principle never more than ``HOT_SHARE`` rows, which is what makes it safe to broadcast.
    """
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counted.agg(F.sum("_n").alias("_total"))
    hot = (F.col("_n") >= least) & (F.col("_n") * HOT_SHARE >= total.scalar())
    return counted.where(hot).select(*keys, F.ceil(F.col("_n") / least).cast("int").alias("_salts"))


def salted_join(big: DataFrame, unique: DataFrame, keys: list[str], spread: Column, how: str = "inner", least: int = 100_000, hot: DataFrame | None = None) -> DataFrame:
    """``big`` joined to ``unique`` (few rows a key) on ``keys``, hot keys of ``big`` cut into salts.

    ``spread`` is a column of ``big`` whose hash chooses the salt; ``hot`` are the :func:`hot_keys` of ``big`` where they are
    known. Nulls in the keys match nothing.
    """
    hot = F.broadcast(hot_keys(big.select(*keys), keys, least) if hot is None else hot)  # HOT_SHARE rows at most
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    left = big.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), salts).cast("int")).drop("_salts")
    right = unique.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
