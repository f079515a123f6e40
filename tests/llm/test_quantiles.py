import numpy as np
from pyspark.sql import functions as F

from millrace.llm.quantiles import PROMISED, digest, grouped_percentiles, recluster, score_percentiles


def exact(values, q):
    return np.quantile(values, q)


def test_errors_are_bounded_and_certified(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", f"d{i % 3}", float(x)) for i, x in enumerate(rng.normal(size=9000))] + [("few", "d0", float(x)) for x in (3, 1, 2)] + [("one", "d1", 5.0), (None, "d1", 7.0)]
    rows += [("same", "d0", 4.0)] * 500
    df = spark.createDataFrame(rows, "k string, part string, v double").withColumn("i", F.monotonically_increasing_id())
    got = {(r.k, r.part): r for r in grouped_percentiles(df, ["k"], "part", "v", ["i"], least_hot=1000).collect()}
    assert set(got) == {("hot", "d0"), ("hot", "d1"), ("hot", "d2"), ("hot", None), ("few", "d0"), ("few", None), ("one", "d1"), ("one", None), (None, "d1"), (None, None), ("same", "d0"), ("same", None)}
    hot = np.sort([r[2] for r in rows if r[0] == "hot"])
    for name, q in (("p10", 0.1), ("median", 0.5), ("p90", 0.9)):
        row = got["hot", None]
        true = np.searchsorted(hot, row[name]) / len(hot)
        assert abs(true - q) <= PROMISED
        assert abs(true - q) - 1 / len(hot) <= row[f"{name}_rank_error"] + 1e-9
    assert all(r[f"{q}_rank_error"] <= r.rank_error_bound for r in got.values() for q in ("p10", "median", "p90"))
    assert got["one", None].median == 5.0 and got["same", None].p10 == 4.0 and got["few", "d0"].median == 2.0
    assert got["hot", None].n == 9000


def test_merging_is_as_good_as_one_digest(spark):
    df = spark.range(20_000).select(F.lit("k").alias("k"), F.pmod("id", F.lit(7)).alias("p"), F.rand(5).alias("v"))
    merged = recluster(digest(df, ["k", "p"], "v").drop("p"), ["k"])
    assert merged.agg(F.sum("weight")).first()[0] == 20_000
    assert merged.count() <= 130


def test_invalid_scores_and_empty_tables(spark):
    schema = "case_id string, repo_id string, arm_name string, top_score double, hits int, vector_ran boolean, gold_rank int, answer_has_gold boolean, scoreable boolean, recorded_at timestamp, arrived_at timestamp, day int, DAY int"
    t = "2025-01-01 00:00:00"
    rows = [("a", "r", "x", s, 1, True, 1, True, True, None, None, 0, 0) for s in (0.5, 0.5, 1.5, float("nan"), None)]
    df = spark.createDataFrame(rows, schema).withColumn("recorded_at", F.lit(t).cast("timestamp"))
    got = score_percentiles(df).collect()
    assert len(got) == 2 and all(r.n == 1 and r.median == 0.5 for r in got)  # the repeated row counts once
    assert score_percentiles(df.limit(0)).count() == 0
    assert score_percentiles(df.withColumn("recorded_at", F.lit(None).cast("timestamp"))).count() == 0
