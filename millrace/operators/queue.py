"""The work queue as transitions of a table of jobs.

A job: ``id, remote, ref_name, status, attempts, leased_by, leased_until, error, created_at, updated_at``. Every
operation takes the table and returns the rows it changes; the caller merges them by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BASE_S, MOST_S, MOST_DOUBLINGS = 30, 600, 16
#: Seconds waited so far → seconds to the next poll; none from half an hour on (fixed values).
POLLS = ((15, 1), (120, 2), (600, 5), (1800, 15))


def retry_delay(attempts: Column, base_s: int = BASE_S, most_s: int = MOST_S) -> Column:
    """Seconds before another attempt: doubled with each one, up to a bound."""
    doublings = F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(MOST_DOUBLINGS))
    return F.least(F.lit(base_s) * F.pow(F.lit(2), doublings), F.lit(most_s)).cast("int")


def poll_interval(waited_s: Column) -> Column:
    """Seconds to the next poll, null: stop. A time on a boundary belongs to the slower stage."""
    out = F.lit(None).cast("int")
    for until, interval in reversed(POLLS):
        out = F.when(waited_s < until, interval).otherwise(out)
    return out.cast("int")


def transport_backoff(failures: Column) -> Column:
    """Seconds after so many failed requests in a row, null from the tenth on."""
    return F.when(failures < 10, F.least(F.pow(F.lit(2), failures - 1), F.lit(30)).cast("int"))


def active_jobs(jobs: DataFrame) -> DataFrame:
    """One active job for each (remote without case, ref): the earliest by (created_at, id)."""
    active = jobs.where(F.col("status").isin("pending", "leased"))
    first = F.min_by(F.struct("id", "status", "created_at"), F.struct("created_at", "id"))
    return active.groupBy(F.lower("remote").alias("remote_key"), "ref_name").agg(first.alias("_j"), F.count(F.lit(1)).alias("submitted")).select("remote_key", "ref_name", "_j.*", "submitted")


def enqueue(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (a new job each) with ``job_id``: the active job of its key, or itself where there is none."""
    new = wanted.withColumn("_new", F.lit(True)).unionByName(jobs.where(F.col("status").isin("pending", "leased")).select(*wanted.columns).withColumn("_new", F.lit(False)))
    key = Window.partitionBy(F.lower("remote"), "ref_name").orderBy("_new", "created_at", "id")
    return new.withColumn("job_id", F.first("id").over(key)).where("_new").drop("_new")


def claimable(jobs: DataFrame, now: Column, workers: int) -> DataFrame:
    """The ``workers`` oldest jobs that wait or whose lease ran out, each with its worker's number from 1."""
    ready = jobs.where(F.col("status").isin("pending", "leased") & (F.col("leased_until").isNull() | (F.col("leased_until") < now)))
    oldest = ready.orderBy("created_at", "id").limit(workers)  # a top-k: at most `workers` rows
    return oldest.withColumn("worker", F.row_number().over(Window.orderBy("created_at", "id")))


def lease(jobs: DataFrame, now: Column, workers: int, lease_s: int) -> DataFrame:
    """Claimed jobs: leased to their worker for ``lease_s`` seconds, with one attempt more."""
    return claimable(jobs, now, workers).withColumns({"status": F.lit("leased"), "attempts": F.col("attempts") + 1, "leased_by": F.concat(F.lit("worker-"), F.col("worker")), "leased_until": now + F.make_interval(secs=F.lit(lease_s)), "updated_at": now}).drop("worker")


def finish(jobs: DataFrame, results: DataFrame, now: Column, most_attempts: int) -> DataFrame:
    """Jobs after ``results`` (``id, leased_by, error``, null for success); only the holder of the lease may report.

    A failed job waits for its delay, or has failed for good after ``most_attempts``.
    """
    reported = jobs.where(F.col("status") == "leased").drop("error").join(results.select("id", "leased_by", "error"), ["id", "leased_by"])
    over = F.col("attempts") >= most_attempts
    status = F.when(F.col("error").isNull(), "done").when(over, "failed").otherwise("pending")
    wait = F.when(F.col("error").isNotNull() & ~over, now + F.make_interval(secs=retry_delay(F.col("attempts"))))
    return reported.withColumns({"status": status, "leased_until": wait, "leased_by": F.lit(None).cast("string"), "updated_at": now})


def sweep(jobs: DataFrame, now: Column, hours: int) -> DataFrame:
    """Jobs that stay: ended ones older than ``hours`` go, active ones never do."""
    ended = F.col("status").isin("done", "failed") & (F.col("updated_at") < now - F.make_interval(hours=F.lit(hours)))
    return jobs.where(~F.coalesce(ended, F.lit(False)))


def abandoned(attempts: DataFrame, touched: str, now: Column, deadline_s: int) -> DataFrame:
    """Attempts nobody touched for longer than a worker can hold a job: twice the deadline and a minute. Never touched ones stay."""
    return attempts.where(F.col(touched) < now - F.make_dt_interval(secs=F.lit(2 * deadline_s + 60)))
