"""Queries on what the service answers and watches: scans, citations, corpus checks, ledgers, alerts, budgets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import cite
from millrace.functions.ids import content_id
from millrace.operators import alerts, chunking, corpus, evaluate, graph, queue
from millrace.plans.evaluation import jobs
from millrace.plans.graphs import source_units
from millrace.plans.lifecycle import NOW, latest
from millrace.sources.tables import table

FORGES = {"code.example": "/blob/", "forge.example": "/src/commit/"}


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "spans").where("id IS NOT NULL").groupBy("id").agg(*[F.min(c).alias(c) for c in ("repo_id", "file_id", "path", "start_line", "end_line", "digest")])


SCAN_AFTER, SCAN_LIMIT = ("lib/", 0, ""), 300


def span_scan_ordered(spark: SparkSession, sf: str) -> DataFrame:
    """A page of all spans by path, first line and id, behind a cursor."""
    rows = _spans(spark, sf).where("path IS NOT NULL AND start_line IS NOT NULL")
    return corpus.page(rows, ["path", "start_line", "id"], SCAN_AFTER, SCAN_LIMIT).select("path", "start_line", "id")


def citations(spark: SparkSession, sf: str) -> DataFrame:
    """Every span's citation, with an ampersand and a space in its path so that links must be escaped."""
    r = latest(spark, sf).where("remote_key IS NOT NULL AND commit_sha IS NOT NULL AND indexed_at IS NOT NULL").select("id", "remote_key", "ref_name", "commit_sha", "indexed_at")
    r = r.join(corpus.newer_commits(r), "id", "left").withColumnRenamed("id", "repo_id")
    s = _spans(spark, sf).withColumn("path", F.concat(F.lit("a&b c%/"), "path"))
    cited = s.join(r, "repo_id").select("id", cite.citation(F.lit(NOW).cast("timestamp"), FORGES).alias("c"))
    return cited.select("id", "c.remote", "c.commit", "c.ref", "c.digest", "c.permalink", F.col("c.staleness.state").alias("state"), "c.staleness.newer_commit", F.unix_micros("c.staleness.newer_indexed_at").alias("newer_indexed_us"))


def _arms(spark: SparkSession, sf: str) -> tuple[tuple, tuple, DataFrame]:
    """Two arms of all repositories with spans; the second differs by the first digit of the repository's id: 0 has the first arm's
    database, 1 another commit, 2 and 3 other bytes in tests, 4 and 5 a source with other bytes there, 6 and 7 the same spans, the rest windows only."""
    digit = F.substring("repo_id", 1, 1)
    files = table(spark, sf, "files").where("repo_id IS NOT NULL AND path IS NOT NULL").groupBy("repo_id", "path").agg(F.max("blob").alias("blob"))
    spans = table(spark, sf, "spans").where("repo_id IS NOT NULL AND id IS NOT NULL").select("repo_id", "id", "kind").distinct()
    repos = spans.select("repo_id").distinct()
    other = lambda digits: files.withColumn("blob", F.when(digit.isin(*digits) & F.col("path").endswith("_test.go"), F.concat(F.lit("x"), F.coalesce("blob", F.lit("")))).otherwise(F.col("blob")))
    a = repos.select("repo_id", F.lit("one").alias("database"), F.lit("c1").alias("commit_sha")), files, spans
    b = repos.select("repo_id", F.when(digit == "0", "one").otherwise("two").alias("database"), F.when(digit == "1", "c2").otherwise("c1").alias("commit_sha")), other(("2", "3")), spans.where(digit.isin("6", "7") | (F.col("kind") == "file"))
    return a, b, other(("4", "5"))


def corpus_verify(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.verified(*_arms(spark, sf))


def repo_graph_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of each repository with those of its call graph."""
    symbols, edges = graph.build(*source_units(spark, sf))
    spans = table(spark, sf, "spans").select("id", "repo_id", "file_id", "kind", *[F.when(F.col(c).isNotNull(), 1).alias(c) for c in ("text", "embedding")]).distinct()
    return corpus.repo_stats(table(spark, sf, "repos"), table(spark, sf, "files").select("id", "repo_id", "n_lines").distinct(), spans, symbols, edges)


def golden_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Golden cases of all Go spans with the id of each."""
    s = table(spark, sf, "spans").where("text IS NOT NULL").select("id", "path", "text").distinct()
    cases = chunking.golden_cases(s, "id").join(s.select("id", "path"), "id")
    return cases.select(content_id(F.col("id"), F.col("path"), F.col("symbol"), F.col("doc_of")).alias("case_id"), "id", "symbol", "kind", "doc_of", "start_line", "end_line")


def golden_refused(spark: SparkSession, sf: str) -> DataFrame:
    """How many declarations of each repository's Go spans gave a case, and why the others did not."""
    s = table(spark, sf, "spans").where("text IS NOT NULL").select("id", "repo_id", "path", "text").distinct()
    return chunking.golden_ledger(s, "id").join(s.select("id", "repo_id"), "id").groupBy("repo_id", "reason").agg(F.sum("n").alias("n"))


def golden_ledger_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Ledgers by repository and kind, merged to one for each repository."""
    cases = table(spark, sf, "cases").distinct()
    return evaluate.merged_ledger(evaluate.golden_ledger(cases, ["repo_id", "kind"]).drop("kind"), ["repo_id"], cases)


def error_count_windows(spark: SparkSession, sf: str) -> DataFrame:
    return alerts.count_rule(table(spark, sf, "events"), F.col("event_type") == "error", "ts", "1 day", 5).withColumn("at", F.unix_micros("at"))


def gauge_below(spark: SparkSession, sf: str) -> DataFrame:
    return alerts.gauge_rule(table(spark, sf, "events"), "event_type", "ts", "value", "1 day", 20.0, "event_id").withColumn("at", F.unix_micros("at"))


def abandoned_attempts(spark: SparkSession, sf: str) -> DataFrame:
    return queue.abandoned(jobs(spark, sf).where("status = 'leased'"), "updated_at", F.lit("1997-01-01 00:00:00").cast("timestamp"), 3600).select("id", F.unix_micros("updated_at").alias("updated_at"))


def wire_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores as they may stand in JSON, with the pause after as many failed requests as there were hits."""
    o = table(spark, sf, "outcomes").distinct()
    return o.groupBy(cite.wire_number(F.col("top_score")).isNull().alias("missing"), queue.transport_backoff(F.col("hits")).alias("pause_s")).agg(F.count(F.lit(1)).alias("n"))


_Q = (span_scan_ordered, citations, corpus_verify, repo_graph_stats, golden_ids, golden_refused, golden_ledger_merged, error_count_windows, gauge_below, abandoned_attempts, wire_scores)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _Q}

_KEY = r"regexp_replace(regexp_replace(regexp_replace(lower(trim(remote)), '^[a-z+]+://', ''), '/+', '/', 'g'), '(\.git|/)+$', '')"
_SPANS = "(SELECT id, min(repo_id) AS repo_id, min(path) AS path, min(start_line) AS a, min(end_line) AS b, min(digest) AS digest FROM spans WHERE id IS NOT NULL GROUP BY 1)"

SQL: dict[str, str] = {
    "span_scan_ordered": f"SELECT path, a AS start_line, id FROM {_SPANS} WHERE path IS NOT NULL AND a IS NOT NULL AND (path, a, id) > ('lib/', 0, '') ORDER BY 1, 2, 3 LIMIT 300",
    "citations": rf"""
        WITH d AS (SELECT *, {_KEY} AS key, row_number() OVER (PARTITION BY id ORDER BY seen_at DESC NULLS LAST, indexed_at DESC NULLS LAST, lower(commit_sha) DESC NULLS LAST, last_queried_at DESC NULLS LAST, remote DESC NULLS LAST) AS n FROM (SELECT DISTINCT * FROM repos) WHERE id IS NOT NULL),
        l AS (SELECT id, key, ref_name, lower(commit_sha) AS c, indexed_at AS at_ FROM d WHERE n = 1 AND key IS NOT NULL AND commit_sha IS NOT NULL AND indexed_at IS NOT NULL),
        w AS (SELECT x.id, arg_max(y.c, (y.at_, y.c)) AS nc, max(y.at_) AS nat FROM l x JOIN (SELECT key, ref_name, c, max(at_) AS at_ FROM l GROUP BY ALL) y ON y.key = x.key AND y.ref_name = x.ref_name AND y.c <> x.c AND y.at_ > x.at_ GROUP BY 1)
        SELECT s.id, key AS remote, c AS commit, ref_name AS ref, s.digest, CASE WHEN split_part(key, '/', 1) IN ('code.example', 'forge.example') THEN 'https://' || key || CASE split_part(key, '/', 1) WHEN 'code.example' THEN '/blob/' ELSE '/src/commit/' END || c || '/a&b%20c%25/' || s.path || '#L' || a || '-L' || b ELSE '' END AS permalink,
               CASE WHEN nc IS NULL THEN 'unknown' ELSE 'superseded' END AS state, nc AS newer_commit, epoch_us(nat) AS newer_indexed_us
        FROM {_SPANS} s JOIN l ON l.id = s.repo_id LEFT JOIN w ON w.id = l.id
    """,
    "corpus_verify": """
        WITH f AS (SELECT repo_id, path, max(blob) AS blob, repo_id[1] AS d FROM files WHERE repo_id IS NOT NULL AND path IS NOT NULL GROUP BY 1, 2),
        t AS (SELECT repo_id, min(path) AS path FROM f WHERE suffix(path, '_test.go') GROUP BY 1),
        s AS (SELECT DISTINCT repo_id, id, kind, repo_id[1] AS d FROM spans WHERE repo_id IS NOT NULL AND id IS NOT NULL),
        n AS (SELECT repo_id, d, count(DISTINCT id) AS a, count(DISTINCT id) FILTER (d IN ('6', '7') OR kind = 'file') AS b FROM s GROUP BY 1, 2),
        c AS (SELECT repo_id, count(*) AS files FROM f GROUP BY 1),
        r AS (SELECT n.*, coalesce(files, 0) AS files, t.path AS p,
                CASE WHEN d = '0' THEN 'same_database' WHEN d = '1' THEN 'commits' WHEN d IN ('2', '3') AND t.path IS NOT NULL THEN 'files' WHEN d IN ('4', '5') AND t.path IS NOT NULL THEN 'source' WHEN a = b THEN 'identical_spans' END AS refused
              FROM n LEFT JOIN c ON c.repo_id = n.repo_id LEFT JOIN t ON t.repo_id = n.repo_id)
        SELECT repo_id, refused, CASE WHEN refused IN ('files', 'source') THEN p END AS path, files AS files_a, files AS files_b, a AS spans_a, b AS spans_b, b AS shared_ids FROM r
    """,
    "golden_ledger_merged": """
        SELECT repo_id, count(*) AS cases, count(*) FILTER (grouped) AS grouped, count(*) FILTER (start_line <> raw_start) AS moved, count(*) FILTER (coalesce(trim(question), '') = '') AS empty, count(question) - count(DISTINCT question) AS duplicates
        FROM (SELECT DISTINCT * FROM cases) GROUP BY 1
    """,
    "error_count_windows": "SELECT (epoch_us(ts) // 86400000000 + 1) * 86400000000 AS at, count(*) AS bad, count(*) > 5 AS firing FROM events WHERE event_type = 'error' GROUP BY 1",
    "gauge_below": """
        WITH l AS (SELECT (epoch_us(ts) // 86400000000 + 1) * 86400000000 AS at_, event_type, value, row_number() OVER (PARTITION BY epoch_us(ts) // 86400000000, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events)
        SELECT at_ AS at, event_type, value, value IS NULL OR isnan(value) OR value < 20 AS firing FROM l WHERE n = 1
    """,
    "abandoned_attempts": "SELECT o_orderkey AS id, epoch_us(o_orderdate) AS updated_at FROM orders WHERE o_orderstatus NOT IN ('F', 'O') AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00' - INTERVAL 7260 SECOND",
    "wire_scores": """
        SELECT top_score IS NULL OR isnan(top_score) AS missing, CASE WHEN hits < 10 THEN trunc(least(pow(2, hits - 1), 30))::INTEGER END AS pause_s, count(*) AS n FROM (SELECT DISTINCT * FROM outcomes) GROUP BY 1, 2
    """,
}
