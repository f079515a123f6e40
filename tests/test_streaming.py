from datetime import datetime, timedelta
from uuid import uuid4

from pyspark.sql import functions as F

from millrace.streaming import stateful, windows


def stream_of(spark, tmp_path, df):
    at = str(tmp_path / uuid4().hex)
    df.coalesce(1).write.parquet(at)
    return spark.readStream.schema(df.schema).parquet(at)


def drained(df, mode):
    name = "t" + uuid4().hex
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


def test_job_machine():
    j = stateful.Job()
    step = lambda kind, job="j1", worker="w", at=0: j.step(kind, job, worker, at, 10, 2)
    assert [step("submit"), step("submit", "j2"), step("lease"), step("lease", worker="v", at=5), step("complete", worker="v"), step("fail"), step("lease", at=20), step("lease", at=30), step("fail", at=31), step("submit", "j3")] == [
        "queued", "joined j1", "leased", "refused", "refused", "retry", "refused", "leased", "failed", "queued"
    ]
    assert j.id == "j3" and j.attempts == 0


def test_budget_machine():
    b = stateful.RollingBudget(100)
    assert [b.step("ask", "a", 60, 0), b.step("ask", "b", 60, 1), b.step("done", "a", 30, 2), b.step("ask", "b", 60, 3), b.step("ask", "c", 11, 4), b.step("done", "x", 1, 5), b.step("ask", "c", 40, 3602)] == [
        "admitted", "refused", "spent", "admitted", "refused", "unknown", "admitted"
    ]
    assert b.total(3602) == 100


def test_reservations_expire():
    b = stateful.RollingBudget(100)
    assert [b.step("ask", "a", 90, 0), b.step("ask", "b", 90, 3599), b.step("ask", "b", 90, 3601), b.step("done", "a", 90, 3602), b.step("done", "b", 10, 3603)] == ["admitted", "refused", "admitted", "unknown", "spent"]
    assert b.total(3604) == 10


def test_queue_stream(spark, tmp_path):
    rows = [("k", 1, "submit", "j1", "", 0), ("k", 2, "submit", "j2", "", 1), ("k", 3, "lease", "", "w", 2), ("k", 4, "complete", "", "w", 3), ("l", 5, "lease", "", "w", 4)]
    df = spark.createDataFrame(rows, "key string, event_id long, kind string, job_id string, worker string, at long")
    got = {r.event_id: (r.result, r.status) for r in drained(stateful.run_queue(stream_of(spark, tmp_path, df)), "update")}
    assert got == {1: ("queued", "pending"), 2: ("joined j1", "pending"), 3: ("leased", "leased"), 4: ("done", "done"), 5: ("refused", "")}


def test_budget_stream(spark, tmp_path):
    df = spark.createDataFrame([("p", 1, "ask", "a", 80, 0), ("p", 2, "ask", "b", 30, 1), ("p", 3, "done", "a", 10, 2), ("p", 4, "ask", "b", 30, 3)], "key string, event_id long, kind string, request string, tokens long, at long")
    got = {r.event_id: (r.result, r.remaining) for r in drained(stateful.run_budget(stream_of(spark, tmp_path, df), 100), "update")}
    assert got == {1: ("admitted", 20), 2: ("refused", 20), 3: ("spent", 90), 4: ("admitted", 60)}


def test_windows_on_streams_equal_tables(spark, tmp_path):
    t = datetime(2025, 1, 1)
    df = spark.createDataFrame([(t + timedelta(minutes=7 * i), "u" if i % 3 else "v", i % 4 == 0) for i in range(60)], "ts timestamp_ntz, u string, bad boolean")
    for make in (
        lambda s: windows.sliding_ratio(s, "ts", F.col("bad"), "30 minutes", "10 minutes", 0.2, 2),
        lambda s: windows.tumbling(s, "ts", ["u"], "1 hour"),
        lambda s: windows.sessions(s, "ts", ["u"], "8 minutes"),
    ):
        streamed = drained(make(windows.event_time(stream_of(spark, tmp_path, df), "ts", "0 minutes")), "append")
        table = make(df.withColumn("ts", F.col("ts").cast("timestamp"))).collect()
        assert set(map(tuple, streamed)) <= set(map(tuple, table)) and len(streamed) >= 0.8 * len(table)
