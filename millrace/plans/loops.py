"""Queries on conversations with tools, and on streams run to their end."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import udfs
from millrace.operators import toolloop
from millrace.session import ensure_checkpoint_dir
from millrace.sources.tables import table
from millrace.streaming import stateful, windows

TOOL_OF = {"click": "search_code", "view": "read_span", "purchase": "definition_of", "signup": "callers_of"}


def transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events as a conversation: a step for each event with one call of the tool its type stands for; errors call a
    tool there is none of, and a value above 150 ends with an answer that cites the first two spans."""
    e = table(spark, sf, "events")
    tool = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in TOOL_OF.items()], F.lit("delete_repo"))
    e = e.withColumns({"conversation": F.col("user_id"), "step": F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")), "tool_name": tool})
    final = F.col("value") > 150
    text = F.when(final, F.concat(F.lit("See [1] and [2], also x[3] and [9] for "), "props"))
    nothing = lambda t: F.lit(None).cast(t)
    response = e.select(
        "conversation", "step", F.lit(0).alias("ord"), F.lit("response").alias("kind"), F.when(final, "final").otherwise("calls").alias("ending"), text.alias("text"), (F.col("step") * 100).alias("request_tokens"), (F.col("step") * 100).alias("input_tokens"), F.lit(60).alias("output_tokens"), (F.col("step") * 900).alias("elapsed_ms"),
        nothing("string").alias("tool"), nothing("string").alias("args"), nothing("string").alias("outcome"), nothing("string").alias("span_id"),
    )
    call = e.where(~final).select(
        "conversation", "step", F.lit(1).alias("ord"), F.lit("call").alias("kind"), nothing("string").alias("ending"), nothing("string").alias("text"), nothing("int").alias("request_tokens"), nothing("int").alias("input_tokens"), nothing("int").alias("output_tokens"), nothing("int").alias("elapsed_ms"),
        F.col("tool_name").alias("tool"), F.col("props").alias("args"), F.when(F.pmod("event_id", F.lit(11)) == 0, "malformed").when(F.pmod("event_id", F.lit(23)) == 0, "error").otherwise("ok").alias("outcome"), F.when(F.col("tool_name") == "read_span", F.concat(F.lit("s"), "event_id")).alias("span_id"),
    )
    return response.unionByName(call)


def bounded_loops(spark: SparkSession, sf: str) -> DataFrame:
    found = toolloop.conversations(toolloop.judge(transcripts(spark, sf)), udfs.cited_markers)
    return found.select("conversation", "stop", "steps", "calls", F.size("read").alias("read"), F.array_join(F.col("cited").cast("array<string>"), ",").alias("cited"), "dropped")


def _drained(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream gives when it is run to its end; each run writes to a folder of its own below the checkpoint folder."""
    spark = stream.sparkSession
    at = f"{ensure_checkpoint_dir(spark)}/stream-{uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    if not spark.streams.active:  # closes the native stores instead of leaving them to the end of the process
        spark._jvm.org.apache.spark.sql.execution.streaming.state.StateStore.stop()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{at}/out")


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def stream_error_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Sliding windows over the stream of events, closed by the watermark."""
    stream = windows.event_time(_event_stream(spark, sf), "ts", "10 minutes")
    return _drained(windows.sliding_ratio(stream, "ts", F.col("event_type") == "error", "6 hours", "1 hour", 0.2, 8), "append").withColumns({"starts": F.unix_micros("starts"), "ends": F.unix_micros("ends")})


def stream_queue(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as events of a queue, keyed by remote and ref, through the state machine."""
    schema = spark.read.parquet(f"{sf}/orders.parquet").schema
    o = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(sf)
    kind = F.element_at(F.array(*[F.lit(x) for x in ("submit", "lease", "complete", "fail")]), (F.pmod("o_orderkey", F.lit(4)) + 1).cast("int"))
    at = (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1_000_000).cast("long")
    events = o.select(F.concat(F.lit("code.example/c"), F.pmod("o_custkey", F.lit(50))).alias("key"), F.col("o_orderkey").alias("event_id"), kind.alias("kind"), F.col("o_orderkey").cast("string").alias("job_id"), F.lit("worker").alias("worker"), at.alias("at"))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.ROCKSDB)
    try:
        return _drained(stateful.run_queue(events), "update")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old) if old else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def stream_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Events as requests of 50 clients for tokens: an even one asks, the next odd one of the same number settles it; reservations
    that nobody settles expire."""
    e = _event_stream(spark, sf)
    even = F.pmod("event_id", F.lit(2)) == 0
    events = e.select(
        F.pmod("user_id", F.lit(50)).cast("string").alias("key"), "event_id", F.when(even, "ask").otherwise("done").alias("kind"), F.floor(F.col("event_id") / 2).cast("string").alias("request"),
        F.ceil(F.coalesce("value", F.lit(1.0))).cast("long").alias("tokens"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long").alias("at"),
    )
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.ROCKSDB)
    try:
        return _drained(stateful.run_budget(events, 300), "update")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old) if old else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


_Q = (bounded_loops, stream_error_windows, stream_queue, stream_budget)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _Q}
SQL: dict[str, str] = {
    "stream_error_windows": """
        WITH s AS (SELECT epoch_us(ts) // 3600000000 AS h, count(*) FILTER (event_type = 'error') AS b, count(*) AS n FROM events GROUP BY 1),
        w AS (SELECT h + k AS e, sum(b)::BIGINT AS bad, sum(n)::BIGINT AS total FROM s, generate_series(1, 6) g(k) GROUP BY 1)
        SELECT (e - 6) * 3600000000 AS starts, e * 3600000000 AS ends, bad, total, bad / total > 0.2 AND total > 8 AS firing FROM w WHERE e * 3600000000 <= (SELECT max(epoch_us(ts)) FROM events) - 600000000
    """,
    "bounded_loops": """
        WITH e AS (SELECT user_id AS c, event_id, value > 150 AS fin, props, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step,
                     CASE event_type WHEN 'click' THEN 'search_code' WHEN 'view' THEN 'read_span' WHEN 'purchase' THEN 'definition_of' WHEN 'signup' THEN 'callers_of' END AS tool,
                     CASE WHEN event_id % 11 = 0 THEN 'malformed' WHEN event_id % 23 = 0 THEN 'error' ELSE 'ok' END AS outcome FROM events),
        r AS (SELECT *, row_number() OVER (PARTITION BY c, fin, coalesce(tool, ''), props ORDER BY step) - 1 AS rep, coalesce(sum((step - 1) * 100) OVER (PARTITION BY c ORDER BY step ROWS UNBOUNDED PRECEDING), 0) AS used FROM e),
        x AS (SELECT *, sum(CASE WHEN NOT fin THEN 1 ELSE 0 END) OVER w AS calls, sum(CASE WHEN NOT fin AND (rep > 0 OR tool IS NULL OR outcome = 'malformed') THEN 1 ELSE 0 END) OVER w AS errs FROM r WINDOW w AS (PARTITION BY c ORDER BY step ROWS UNBOUNDED PRECEDING)),
        y AS (SELECT *, CASE WHEN step > 6 THEN 'step_limit' WHEN step * 900 >= 60000 THEN 'deadline' WHEN used + step * 100 > 12000 OR (step - 1) * 60 >= 1500 THEN 'token_budget' WHEN fin THEN 'final' WHEN calls > 12 THEN 'tool_call_limit'
                     WHEN rep > 2 OR (rep > 0 AND errs > 2) THEN 'repeated_tool_call' WHEN rep = 0 AND (tool IS NULL OR outcome = 'malformed') AND errs > 2 THEN 'malformed_tool_call' WHEN rep = 0 AND tool IS NOT NULL AND outcome = 'error' THEN 'tool_error' END AS stop FROM x),
        k AS (SELECT c, min(step) FILTER (stop IS NOT NULL) AS at_ FROM y GROUP BY 1),
        l AS (SELECT y.*, at_ FROM y JOIN k USING (c) WHERE at_ IS NULL OR step <= at_),
        f AS (SELECT c, coalesce(max(stop), 'step_limit') AS stop, count(*) FILTER (stop IS DISTINCT FROM 'step_limit') AS steps, count(*) FILTER (NOT fin AND stop IS DISTINCT FROM 'step_limit') AS calls,
                count(*) FILTER (NOT fin AND stop IS NULL AND tool = 'read_span' AND rep = 0 AND outcome = 'ok')::INTEGER AS read FROM l GROUP BY 1)
        SELECT c AS conversation, CASE WHEN stop = 'final' AND read = 0 THEN 'uncited' ELSE stop END AS stop, steps, calls, read, CASE WHEN stop <> 'final' OR read = 0 THEN '' WHEN read = 1 THEN '1' ELSE '1,2' END AS cited,
               CASE WHEN stop = 'final' THEN 3 - least(read, 2) ELSE 0 END::INTEGER AS dropped FROM f
    """,
}
