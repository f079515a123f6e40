"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just the named columns, found by exact name and first place, so that other columns may clash with them or with
    each other in any way. A column that is missing in this spelling is taken in another case."""
    columns = df.columns
    folded = [c.lower() for c in columns]
    at = [columns.index(n) if n in columns else folded.index(n.lower()) for n in names]
    return df.toDF(*[f"_{i}" for i in range(len(columns))]).select(*[F.col(f"_{i}").alias(n) for i, n in zip(at, names)])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``folder/name.parquet`` (a file or a folder of parts).

    Zone-less timestamps are cast to TIMESTAMP, read in the session's zone: event-time operators
    reject TIMESTAMP_NTZ.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    zoneless = {c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"}
    return df.withColumns(zoneless) if zoneless else df
