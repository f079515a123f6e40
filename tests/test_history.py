import random
from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators import history as H

few = settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
T0 = datetime(2025, 1, 1)
REPOS = "id string, remote string, ref_name string, commit_sha string, size_bytes long, file_count int, indexed_at timestamp, last_queried_at timestamp, seen_at timestamp"
STALE = "repo_id string, state string, forge_checked boolean, checked_at timestamp, newer_commit string, newer_indexed_at timestamp, note string"
A, B, C = "a" * 40, "b" * 40, "c" * 40


def at(hours):
    return T0 + timedelta(hours=hours)


def log(*rows):
    return [(i, r, "main", c, 1, 1, None if t is None else at(t), None, None if s is None else at(s)) for i, r, c, t, s in rows]


def periods(spark, repos, stale=(), **kw):
    out = H.commit_history(spark.createDataFrame(repos, REPOS), spark.createDataFrame(list(stale), STALE), **kw)
    hours = lambda t: None if t is None else int((t - T0).total_seconds() // 3600)
    return sorted((r.remote, r.commit_sha[0], hours(r.valid_from), hours(r.valid_to)) for r in out.collect())


def test_spellings_and_dirt(spark):
    r = "https://Code.example//Own/Name.git/"
    rows = log(("1", r, A, 1, 2), ("1", r, A, 1, 2), ("2", "  http://code.example/own/name", "AAAAAAA", 5, 6), ("3", "code.example/own/name", B, 10, 11), ("4", r, A, 20, 21), ("5", r, C, 30, 29), ("6", r, None, 31, 32), ("7", r, C, None, 33), ("8", None, C, 3, 4), ("9", r, "dddd", 3, 4))
    rows += log(("x", r, C, 10, 10.5))  # put right later: seen before B
    stale = [("4", "superseded", False, at(50), "CCCCCCCC", at(40), None), ("gone", "superseded", False, at(50), B, at(45), None), ("1", "unknown", False, at(50), None, None, None), (None, None, None, None, None, None, None)]
    want = [("code.example/own/name", "a", 1, 10), ("code.example/own/name", "a", 20, 40), ("code.example/own/name", "b", 10, 20), ("code.example/own/name", "c", 40, None)]
    for period in ("month", "hour"):
        assert periods(spark, rows, stale, period=period) == want


def test_remote_spellings(spark):
    same = ["https://code.example/a/b", "HTTP://Code.Example/A/B.git/", "git@code.example:a/b.git", "ssh://git@code.example:22/a/b", " https://code.example//a/b/ ", "code.example/a/b"]
    df = spark.createDataFrame([(x,) for x in same], "r string")
    assert {r.k for r in df.select(H.remote_key(F.col("r")).alias("k")).collect()} == {"code.example/a/b"}


def test_empty_and_clashing(spark):
    assert periods(spark, []) == []
    repos = spark.createDataFrame(log(("1", "https://h/a/b", A, 1, 2)), REPOS).select("*", F.lit(1).alias("ID"), F.lit(2).alias("known_in"), F.lit(3).alias("seen"))
    stale = spark.createDataFrame([], STALE).select("*", F.lit(1).alias("Repo_ID"))
    assert H.commit_history(repos, stale).count() == 1


@few
@given(st.integers(0, 10_000))
def test_against_a_plain_model(spark, seed):
    r = random.Random(seed)
    rows = log(*[(str(i), f"https://h/o/{r.randrange(2)}", r.choice("ab") * 40, t, t + r.randrange(900)) for i in range(30) for t in [r.randrange(0, 2000)]])
    want = []
    for key in {x[1] for x in rows}:
        held = {}
        for x in sorted((x for x in rows if x[1] == key), key=lambda x: (x[8], x[3])):
            held[x[6]] = x[3]
        last = None
        for t in sorted(held):
            if held[t] != last:
                if last is not None:
                    want[-1] = (*want[-1][:3], int((t - T0).total_seconds() // 3600))
                want.append((key.removeprefix("https://"), held[t][0], int((t - T0).total_seconds() // 3600), None))
                last = held[t]
    assert periods(spark, rows) == sorted(want, key=lambda x: (x[0], x[1], x[2]))


@few
@given(st.integers(0, 10_000))
def test_changed_rows_are_the_difference(spark, seed):
    r = random.Random(seed)
    old = {(i, r.choice([None, "x", "y"])) for i in range(40)}
    new = {(i, v if r.random() < 0.9 else "z") for i, v in old if r.random() < 0.95} | {(100, None)}
    schema = "k int, v string"
    o, n = spark.createDataFrame(sorted(old, key=str), schema), spark.createDataFrame(sorted(new, key=str) * 2, schema)
    got = {((x.k, x.v), x.change) for x in H.changed_rows(o, n, ["k"], ["v"], 4, 2).collect()}
    assert got == {(x, "added") for x in new - old} | {(x, "removed") for x in old - new}


def test_equal_snapshots_end_at_the_root(spark):
    df = spark.range(100).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    tree = H.merkle_tree(df, ["k"], ["v"], 4, 3)
    assert tree.where("level = 0").count() == 1
    assert H.changed_leaves(tree, H.merkle_tree(df.orderBy(F.desc("k")).unionByName(df), ["k"], ["v"], 4, 3), 4, 3).count() == 0
    other = df.withColumn("v", F.when(F.col("k") == 7, 0).otherwise(F.col("v")))
    assert H.changed_leaves(tree, H.merkle_tree(other, ["k"], ["v"], 4, 3), 4, 3).count() == 1


def test_snapshots_are_compared_tree_by_tree(spark, monkeypatch):
    rows = [(k, k * 10 + s, s) for s in (1, 2, 5) for k in range(60) if s == 1 or k % (10 * s) == 3]
    df = spark.createDataFrame(rows, "k long, v long, s int")
    placed = df.withColumnRenamed("s", "_s").withColumn("_leaf", H.leaf_of(["k"], 4, 3))
    trees = {(r["_s"], r.level, r.node): r.hash for r in H.snapshot_trees(placed, ["k", "v"], 4, 3).collect()}
    assert trees == {(s, r.level, r.node): r.hash for s in (1, 2, 5) for r in H.merkle_tree(df.where(F.col("s") <= s), ["k"], ["v"], 4, 3).collect()}
    compared = []
    whole = H.changed_leaves

    def watched(old, new, *args):
        compared.append(whole(old, new, *args))
        return compared[-1]

    monkeypatch.setattr(H, "changed_leaves", watched)
    got = H.appended_by_snapshot(df.unionByName(df), ["k"], ["v"], "s", 4, leaf_rows=1)  # 68 rows: three levels
    assert sorted((r.k, r.v, r.s) for r in got.collect()) == sorted(rows)
    found = {(r["_s"], r.node) for r in compared[0].collect()}
    assert found == {(r["_s"], r["_leaf"]) for r in placed.collect()}
    assert len({n for s, n in found if s == 5}) < len({n for s, n in found if s == 1})


def test_unchanged_branches_are_not_descended(spark):
    # Trees whose hashes disagree with what lies below: a leaf differs under a node that does not.
    schema = "level int, node long, hash long"
    old = spark.createDataFrame([(0, 0, 1), (1, 0, 10), (1, 1, 11), (2, 0, 20), (2, 1, 21), (2, 2, 22), (2, 3, 23)], schema)
    new = spark.createDataFrame([(0, 0, 2), (1, 0, 10), (1, 1, 99), (2, 0, 77), (2, 1, 21), (2, 2, 88), (2, 3, 23)], schema)
    assert [r.node for r in H.changed_leaves(old, new, 2, 2).collect()] == [2]  # leaf 0 differs too, but is never reached


def test_rows_of_unchanged_leaves_are_not_compared(spark):
    old = spark.range(200).select(F.col("id").alias("k"), F.lit("a").alias("v"))
    new = old.withColumn("v", F.when(F.col("k").isin(3, 150), "b").otherwise(F.col("v")))
    kept = H.merkle_tree(old, ["k"], ["v"]), H.merkle_tree(old.withColumn("v", F.when(F.col("k") == 3, "b").otherwise(F.col("v"))), ["k"], ["v"])
    got = {(r.k, r.v, r.change) for r in H.changed_rows(old, new, ["k"], ["v"], trees=kept).collect()}
    assert got == {(3, "a", "removed"), (3, "b", "added")}  # the trees don't know of 150


def test_leaves_grow_with_the_rows():
    assert [H.depth_for(n) for n in (0, 2047, 2048, 40_000, 10_000_000)] == [1, 1, 2, 3, 5]


def test_plain_and_other_spellings_of_a_remote(spark):
    spellings = ["host.example/own/name", "https://Host.example/own/name.git", "git@host.example:own/name", "ssh://git@host.example:22/own//name/", " host.example/own/name", "host.example/own/name.git", "HOST.example/own/name"]
    got = spark.createDataFrame([(x,) for x in spellings], "r string").select(H.remote_key(F.col("r")).alias("k")).distinct().collect()
    assert [r.k for r in got] == ["host.example/own/name"]
