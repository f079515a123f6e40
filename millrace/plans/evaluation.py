"""Queries that score the arms, and alert queries on events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators import alerts, evaluate, queue
from millrace.functions.udfs import hashed_bow
from millrace.operators import retrieval as R
from millrace.plans.graphs import _cases, _ranges
from millrace.plans.search import DEPTH, FLOOR, LIMIT
from millrace.session import cut
from millrace.sources.tables import table

TYPES = ["click", "error", "purchase", "signup", "view"]
#: Upper bounds of durations and scores (fixed values).
SCORE_BOUNDS = [round(0.05 * i, 2) for i in range(21)]
DURATIONS = [float(2**i) for i in range(14)]


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "outcomes").distinct()


def arm_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The arms' scores with what is known of their cases: how many had moved lines or were grouped, and their exact score quantiles."""
    known = table(spark, sf, "cases").where("id IS NOT NULL").groupBy(F.col("id").alias("case_id")).agg(F.max(F.col("start_line") != F.col("raw_start")).alias("moved"), F.max("grouped").alias("grouped"))
    o = _outcomes(spark, sf)
    scores = o.where("scoreable AND top_score BETWEEN -1 AND 1 AND arm_name IS NOT NULL")
    q = evaluate.order_statistics(scores, ["arm_name"], "top_score", {"score_least": 0.0, "score_p10": 0.1, "score_median": 0.5, "score_p90": 0.9, "score_greatest": 1.0}, -1.0, 1.0).drop("n")
    return evaluate.summaries(o.join(known, "case_id", "left"), ["arm_name"]).join(q, "arm_name", "left")


def hit_at_k(spark: SparkSession, sf: str) -> DataFrame:
    s = evaluate.summaries(_outcomes(spark, sf), ["repo_id", "arm_name"])
    return s.select("repo_id", "arm_name", "cases", "hit_at_1", "hit_at_3", "hit_at_5", "hit_at_10")


def mrr_all_cases(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.summaries(_outcomes(spark, sf), ["repo_id", "arm_name"]).select("repo_id", "arm_name", "mrr", "unscoreable")


def floor_sweep_201(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.floor_sweep(_outcomes(spark, sf), ["arm_name"])


def score_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    o = _outcomes(spark, sf).where("top_score BETWEEN -1 AND 1 AND arm_name IS NOT NULL")
    return evaluate.order_statistics(o, ["arm_name"], "top_score", {"least": 0.0, "p10": 0.1, "median": 0.5, "p90": 0.9, "greatest": 1.0}, -1.0, 1.0)


def gold_lenient_strict(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.gold(_cases(spark, sf), _ranges(spark, sf), ["repo_id", "path"])


def _grouped(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(cases, spans), one row an id."""
    spans = table(spark, sf, "spans").where("start_line BETWEEN 1 AND end_line AND text IS NOT NULL").groupBy("id").agg(*[F.min(c).alias(c) for c in ("repo_id", "path", "symbol", "start_line", "end_line", "text")])
    whole = table(spark, sf, "cases").where("raw_start BETWEEN 1 AND raw_end AND question IS NOT NULL")
    cases = whole.groupBy(F.col("id").alias("query_id")).agg(*[F.min(c).alias(c) for c in ("repo_id", "path", "symbol", "doc_of", "question")], F.max("grouped").alias("grouped"), F.min("raw_start").alias("start_line"), F.min("raw_end").alias("end_line"), F.min("start_line").alias("_from"))
    return cases.withColumn("moved", F.col("_from") != F.col("start_line")).drop("_from"), spans


def _recorded(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cases, spans, terms asked); cases and spans are grouped once, as they are read several times."""
    cases, spans = map(cut, _grouped(spark, sf))
    return cases, spans, R.question_terms(cases.select("query_id", F.col("repo_id").alias("tenant"), F.col("question").alias("q")))


RECORD = ("query_id", "hits", "gold", "scoreable", "gold_rank", "gold_rank_strict", "gold_found", "citations", "answer_has_gold", "outcome", "reason", "moved", "grouped")


def case_records(spark: SparkSession, sf: str) -> DataFrame:
    """Every case's question asked of its repository's spans by terms, in the order of path, first line, symbol and comment kind.

    Without vectors no floor is read: a case is answered as soon as there is a hit.
    """
    cases, spans, asked = _recorded(spark, sf)
    hits = R.lexical_scan(spans.withColumn("tenant", F.col("repo_id")), asked, LIMIT).select("query_id", "rank", "id", F.lit(0).alias("vector_rank"), F.col("rank").alias("lexical_rank"))
    found = evaluate.records(cases, spans, hits, R.Budget(), FLOOR)
    return found.orderBy("path", "start_line", "symbol", "doc_of", "query_id").select(*RECORD)


def _both_arms(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cases, spans, hits of both arms); texts and questions are embedded by hashed words, whatever vectors are stored.

    Hits are those of the fused or of the lexical order within ``LIMIT``, with the best similarity of their question,
    ``top_score``. Spans are numbered in the order of path, first line and id, so that every tie goes by their number, and
    cases are numbered too, with their own id in ``case``: only numbers are sent about.
    """
    cases, spans = _grouped(spark, sf)
    own = lambda c, n: F.when(F.col(c).isNotNull(), n)
    spans = cut(spans.orderBy("path", "start_line", "id").withColumn("id", own("id", F.monotonically_increasing_id())))
    cases = cut(cases.withColumnRenamed("query_id", "case").withColumn("query_id", own("case", F.monotonically_increasing_id())))
    embed = hashed_bow(64)
    corpus = spans.select("id", F.col("repo_id").alias("tenant"), "symbol", "text", embed(F.concat_ws(" ", "symbol", "text")).alias("embedding"))
    questions = cases.select("query_id", F.col("repo_id").alias("tenant"), F.col("question").alias("q"), embed("question").alias("embedding"))
    return cases, spans, R.both_arms(corpus, questions, DEPTH, R.Fusion(), LIMIT)


def case_records_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    cases, spans, hits = _both_arms(spark, sf)
    top = hits.where("rank = 1 AND top_score IS NOT NULL").select("query_id", "top_score")
    found = evaluate.records(cases, spans, hits.where(F.col("rank") <= LIMIT).drop("top_score"), R.Budget(), FLOOR, top)
    return found.withColumn("query_id", F.col("case")).select(*RECORD, "gold_vector_rank", "gold_lexical_rank", "top_score", "vector_ran")


def arm_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """One run of both arms over all cases: the summary of each with lenient and strict scores and who found the gold."""
    cases, spans, hits = _both_arms(spark, sf)
    within = lambda rank: F.when(F.col(rank) <= LIMIT, F.col(rank)).alias("rank")
    modes = {"lexical": F.struct(within("lexical_rank"), F.lit(0).alias("vector_rank"), "lexical_rank"), "hybrid": F.struct(within("rank"), "vector_rank", "lexical_rank")}
    both = evaluate.scored(cases, spans, hits.drop("top_score"), R.Budget(), modes)
    return evaluate.summaries(both, ["mode"]).withColumn("floor_applicable", F.col("mode") != "lexical")


def leak_probe(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "eval_items").where("passage IS NOT NULL").select(F.col("item_id").alias("needle_id"), F.col("passage").alias("phrase"))
    docs = table(spark, sf, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("text_id"), F.col("text").alias("body")).distinct()
    return evaluate.leaks(items, docs)


def bootstrap_mrr_diff(spark: SparkSession, sf: str) -> DataFrame:
    o = _outcomes(spark, sf).where("scoreable AND arm_name IN ('ast_wide', 'window_base')").groupBy("case_id").pivot("arm_name", ["ast_wide", "window_base"]).agg(F.max(F.coalesce("gold_rank", F.lit(0))))
    found = evaluate.bootstrap_difference(o.where("ast_wide IS NOT NULL AND window_base IS NOT NULL").select(F.col("window_base").alias("rank_a"), F.col("ast_wide").alias("rank_b")))
    return spark.createDataFrame([tuple(found.values())], "cases long, difference double, error double, threshold double, verdict string")


def golden_ledger(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.golden_ledger(table(spark, sf, "cases").distinct(), ["repo_id"])


def shared_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Cases that two arms have in common, for every pair of arms."""
    o = _outcomes(spark, sf).where("arm_name IS NOT NULL").select("arm_name", "case_id").distinct()
    arms = o.groupBy("case_id").agg(F.array_sort(F.collect_set("arm_name")).alias("arms"))  # a handful of arms
    pairs = arms.select(F.explode("arms").alias("a"), "arms").select("a", F.explode("arms").alias("b")).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def metric_counts_seeded(spark: SparkSession, sf: str) -> DataFrame:
    return alerts.seeded_counts(_events(spark, sf), "event_type", [*TYPES, "refund"])


def score_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return alerts.cumulative_histogram(_outcomes(spark, sf), ["arm_name"], "top_score", SCORE_BOUNDS)


def error_rate_windows(spark: SparkSession, sf: str) -> DataFrame:
    return alerts.ratio_rule(_events(spark, sf), F.col("event_type") == "error", "ts", "6 hours", "1 hour", 0.2, 8).withColumn("at", F.unix_micros("at"))


def alert_hold(spark: SparkSession, sf: str) -> DataFrame:
    rule = alerts.ratio_rule(_events(spark, sf), F.col("event_type") == "error", "ts", "6 hours", "1 hour", 0.2, 8)
    return alerts.held(rule, "at", "firing", 3600, 3 * 3600)


def absent_services(spark: SparkSession, sf: str) -> DataFrame:
    return alerts.absent(_events(spark, sf), TYPES, "event_type", "ts", "1 hour").withColumn("at", F.unix_micros("at"))


def p95_by_type(spark: SparkSession, sf: str) -> DataFrame:
    h = alerts.cumulative_histogram(_events(spark, sf), ["event_type"], "value", DURATIONS)
    return alerts.histogram_quantile(h, ["event_type"], 0.95).withColumn("value", F.round("value", 6))


def rolling_spend_1h(spark: SparkSession, sf: str) -> DataFrame:
    cents = _events(spark, sf).withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return alerts.rolling_spend(cents, "user_id", "ts", "cents").select("event_id", "user_id", "spent")


def tumbling_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).groupBy(F.window("ts", "1 day")["start"].alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value")).withColumn("day", F.unix_micros("day"))


def user_sessions(spark: SparkSession, sf: str) -> DataFrame:
    s = _events(spark, sf).groupBy("user_id", F.session_window("ts", "6 hours").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.unix_micros("s.start").alias("starts"), F.unix_micros("s.end").alias("ends"), "n")


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as jobs of the work queue."""
    o = table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "pending").otherwise("leased")
    day = F.col("o_orderdate")
    return o.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("Code.example/c"), (F.col("o_custkey") / 4).cast("long")).alias("remote"), F.col("o_orderpriority").alias("ref_name"), status.alias("status"), F.pmod("o_orderkey", F.lit(5)).cast("int").alias("attempts"),
        F.when(status == "leased", F.concat(F.lit("worker-"), F.pmod("o_custkey", F.lit(7)))).alias("leased_by"), F.when(status == "leased", day + F.expr("INTERVAL 1 DAY")).alias("leased_until"), F.lit(None).cast("string").alias("error"), day.alias("created_at"), day.alias("updated_at"),
    )


QUEUE_NOW = "1997-01-01 00:00:00"


def _now() -> Column:
    return F.lit(QUEUE_NOW).cast("timestamp")


def queue_active_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return queue.active_jobs(jobs(spark, sf)).withColumn("created_at", F.unix_micros("created_at"))


def queue_claimable(spark: SparkSession, sf: str) -> DataFrame:
    return queue.claimable(jobs(spark, sf), _now(), 25).select("id", "worker", F.unix_micros("created_at").alias("created_at"))


def queue_lease(spark: SparkSession, sf: str) -> DataFrame:
    return queue.lease(jobs(spark, sf), _now(), 25, 600).select("id", "status", "attempts", "leased_by", F.unix_micros("leased_until").alias("leased_until"))


def queue_fail_backoff(spark: SparkSession, sf: str) -> DataFrame:
    """Every leased job reported by its holder, by a stranger for one remote in seven, failed for odd ids."""
    j = jobs(spark, sf)
    results = j.where("status = 'leased'").select("id", F.when(F.pmod("id", F.lit(7)) == 0, "stranger").otherwise(F.col("leased_by")).alias("leased_by"), F.when(F.pmod("id", F.lit(2)) == 1, "broken").alias("error"))
    return queue.finish(j, results, _now(), 4).select("id", "status", "attempts", "error", F.unix_micros("leased_until").alias("leased_until"))


def queue_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return queue.sweep(jobs(spark, sf), _now(), 24).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


_Q = (
    arm_summary, hit_at_k, mrr_all_cases, floor_sweep_201, score_quantiles, gold_lenient_strict, case_records, case_records_hybrid, arm_comparison, leak_probe, bootstrap_mrr_diff, golden_ledger, shared_ids, metric_counts_seeded, score_histogram,
    error_rate_windows, alert_hold, absent_services, p95_by_type, rolling_spend_1h, tumbling_counts, user_sessions, queue_active_dedupe, queue_claimable, queue_lease, queue_fail_backoff, queue_sweep,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _Q}

_SUMMARY = """count(*) AS cases, count(*) FILTER (NOT scoreable) AS unscoreable,
  round(avg(CASE WHEN gold_rank BETWEEN 1 AND 1 THEN 1.0 ELSE 0.0 END::DOUBLE) FILTER (scoreable), 9) AS hit_at_1, round(avg(CASE WHEN gold_rank BETWEEN 1 AND 3 THEN 1.0 ELSE 0.0 END::DOUBLE) FILTER (scoreable), 9) AS hit_at_3,
  round(avg(CASE WHEN gold_rank BETWEEN 1 AND 5 THEN 1.0 ELSE 0.0 END::DOUBLE) FILTER (scoreable), 9) AS hit_at_5, round(avg(CASE WHEN gold_rank BETWEEN 1 AND 10 THEN 1.0 ELSE 0.0 END::DOUBLE) FILTER (scoreable), 9) AS hit_at_10,
  round(coalesce(avg(CASE WHEN gold_rank > 0 THEN 1.0::DOUBLE / gold_rank ELSE 0.0 END::DOUBLE) FILTER (scoreable), 0), 9) AS mrr, count(*) FILTER (scoreable AND answer_has_gold) AS answers_with_gold"""
_O = "(SELECT DISTINCT * FROM outcomes)"
_RATIO = """
    s AS (SELECT epoch_us(ts) // 3600000000 AS h, count(*) FILTER (event_type = 'error') AS b, count(*) AS n FROM events GROUP BY 1),
    w AS (SELECT h + k AS e, sum(b)::BIGINT AS bad, sum(n)::BIGINT AS total FROM s, generate_series(1, 6) g(k) GROUP BY 1),
    r AS (SELECT e * 3600000000 AS at_, bad, total, round(bad / total, 9) AS ratio, bad / total > 0.2 AND total > 8 AS firing FROM w)"""
_JOBS = """
    j AS (SELECT o_orderkey AS id, 'code.example/c' || floor(o_custkey / 4)::BIGINT AS remote_key, o_orderpriority AS ref_name, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'leased' END AS status, (o_orderkey % 5)::INTEGER AS attempts,
            CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN o_orderdate + INTERVAL 1 DAY END AS until, o_orderdate AS created FROM orders),
    c AS (SELECT * FROM j WHERE status IN ('pending', 'leased') AND (until IS NULL OR until < TIMESTAMP '1997-01-01 00:00:00') ORDER BY created, id LIMIT 25)"""

SQL: dict[str, str] = {
    "arm_summary": f"""
        WITH k AS (SELECT id, bool_or(start_line <> raw_start) AS moved, bool_or(grouped) AS grouped FROM cases WHERE id IS NOT NULL GROUP BY 1),
        v AS (SELECT arm_name, top_score AS x, row_number() OVER (PARTITION BY arm_name ORDER BY top_score) - 1 AS i, count(*) OVER (PARTITION BY arm_name) AS n FROM {_O} WHERE scoreable AND top_score BETWEEN -1 AND 1 AND arm_name IS NOT NULL),
        q AS (SELECT arm_name, max(x) FILTER (i = 0) AS score_least, max(x) FILTER (i = floor(0.1::DOUBLE * (n - 1))) AS score_p10, max(x) FILTER (i = floor(0.5::DOUBLE * (n - 1))) AS score_median, max(x) FILTER (i = floor(0.9::DOUBLE * (n - 1))) AS score_p90, max(x) FILTER (i = n - 1) AS score_greatest FROM v GROUP BY 1),
        s AS (SELECT arm_name, {_SUMMARY}, count(*) FILTER (moved) AS moved_cases, count(*) FILTER (k.grouped) AS grouped_cases FROM {_O} o LEFT JOIN k ON k.id = o.case_id GROUP BY 1)
        SELECT s.*, score_least, score_p10, score_median, score_p90, score_greatest FROM s LEFT JOIN q ON q.arm_name = s.arm_name
    """,
    "hit_at_k": f"SELECT repo_id, arm_name, cases, hit_at_1, hit_at_3, hit_at_5, hit_at_10 FROM (SELECT repo_id, arm_name, {_SUMMARY} FROM {_O} GROUP BY 1, 2)",
    "mrr_all_cases": f"SELECT repo_id, arm_name, mrr, unscoreable FROM (SELECT repo_id, arm_name, {_SUMMARY} FROM {_O} GROUP BY 1, 2)",
    "floor_sweep_201": f"""
        WITH o AS (SELECT *, CASE WHEN NOT isnan(top_score) THEN top_score::FLOAT::DOUBLE END AS t FROM {_O}),
        f AS (SELECT k, k * 0.01::DOUBLE - 1 AS floor FROM generate_series(0, 200) g(k)),
        d AS (SELECT arm_name, k, floor, answer_has_gold AS good, vector_ran,
                CASE WHEN NOT scoreable THEN 'unscoreable' WHEN hits = 0 THEN 'no_spans' WHEN NOT vector_ran THEN 'answered' WHEN t IS NULL THEN 'unscored' WHEN t < floor THEN 'below_floor' ELSE 'answered' END AS v FROM o, f)
        SELECT arm_name, round(floor, 2) AS floor, count(*) FILTER (v = 'answered' AND good) AS answered_with_gold, count(*) FILTER (v = 'answered' AND NOT good) AS answered_without_gold,
               count(*) FILTER (v IN ('no_spans', 'unscored', 'below_floor') AND good) AS refused_with_gold, count(*) FILTER (v IN ('no_spans', 'unscored', 'below_floor') AND NOT good) AS refused_without_gold,
               count(*) FILTER (v = 'unscoreable') AS unscoreable, count(*) FILTER (v = 'no_spans') AS no_spans, count(*) FILTER (v = 'unscored') AS unscored, count(*) FILTER (v = 'below_floor') AS below_floor, bool_or(vector_ran) AS applicable
        FROM d GROUP BY arm_name, k, floor
    """,
    "score_quantiles": f"""
        WITH v AS (SELECT arm_name, top_score AS x, row_number() OVER (PARTITION BY arm_name ORDER BY top_score) - 1 AS i, count(*) OVER (PARTITION BY arm_name) AS n FROM {_O} WHERE top_score BETWEEN -1 AND 1 AND arm_name IS NOT NULL)
        SELECT arm_name, max(n) AS n, max(x) FILTER (i = 0) AS least, max(x) FILTER (i = floor(0.1::DOUBLE * (n - 1))) AS p10, max(x) FILTER (i = floor(0.5::DOUBLE * (n - 1))) AS median, max(x) FILTER (i = floor(0.9::DOUBLE * (n - 1))) AS p90, max(x) FILTER (i = n - 1) AS greatest FROM v GROUP BY 1
    """,
    "gold_lenient_strict": """
        WITH r AS (SELECT DISTINCT repo_id, path, id, start_line AS s, end_line AS e FROM spans WHERE start_line BETWEEN 1 AND end_line),
        c AS (SELECT DISTINCT concat_ws('|', id, raw_start, raw_end) AS case_id, repo_id, path, raw_start AS a, raw_end AS b FROM cases WHERE raw_start BETWEEN 1 AND raw_end),
        m AS (SELECT case_id, r.id, least(b, e) - greatest(a, s) + 1 AS shared, s, e FROM c JOIN r ON r.repo_id = c.repo_id AND r.path = c.path AND a <= e AND b >= s),
        k AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY shared DESC, s, e, id) AS n, count(*) OVER (PARTITION BY case_id) AS lenient FROM (SELECT DISTINCT * FROM m))
        SELECT case_id, (SELECT count(DISTINCT id) FROM m WHERE m.case_id = k.case_id) AS lenient, id AS strict, shared::INTEGER AS shared_lines FROM k WHERE n = 1
    """,
    "case_records": r"""
        WITH s AS (SELECT id, min(repo_id) AS repo_id, min(path) AS path, min(symbol) AS symbol, min(start_line) AS a, min(end_line) AS b, min(text) AS text FROM spans WHERE start_line BETWEEN 1 AND end_line AND text IS NOT NULL GROUP BY 1),
        c AS (SELECT id, min(repo_id) AS repo_id, min(path) AS path, min(question) AS question, min(raw_start) AS a, min(raw_end) AS b, min(start_line) <> min(raw_start) AS moved, bool_or(grouped) AS grouped FROM cases WHERE raw_start BETWEEN 1 AND raw_end AND question IS NOT NULL GROUP BY 1),
        pt AS (SELECT id, lower(unnest(regexp_extract_all(symbol, '[\p{L}\p{Nd}]+'))) AS term, 10 AS w FROM s WHERE symbol IS NOT NULL UNION ALL SELECT id, lower(unnest(regexp_extract_all(text, '[\p{L}\p{Nd}]+'))), 4 FROM s),
        po AS (SELECT s.id, s.repo_id, term, sum(w) AS w FROM pt JOIN s ON s.id = pt.id GROUP BY ALL),
        qt AS (SELECT id, repo_id, list_transform(flatten(list_transform(regexp_extract_all(question, '[\p{L}\p{Nd}]+'), lambda w: list_concat([w], string_split(regexp_replace(regexp_replace(w, '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g'), '([^\p{Lu} ])(\p{Lu})', '\1 \2', 'g'), ' ')))), lambda x: lower(x)) AS t FROM c),
        tm AS (SELECT id AS query_id, repo_id, unnest(list_transform(list_sort(list_transform(list_distinct(t), lambda x: struct_pack(p := list_position(t, x), x := x)))[1:32], lambda y: y.x)) AS term FROM qt),
        sc AS (SELECT query_id, po.id, sum(w)::BIGINT AS v FROM tm JOIN po ON po.repo_id = tm.repo_id AND po.term = tm.term GROUP BY ALL),
        h AS (SELECT * FROM (SELECT query_id, sc.id, row_number() OVER (PARTITION BY query_id ORDER BY v DESC, path, a, s.id) AS rank FROM sc JOIN s ON s.id = sc.id) WHERE rank <= 10),
        g AS (SELECT DISTINCT c.id AS query_id, s.id FROM c JOIN s ON s.repo_id = c.repo_id AND s.path = c.path AND c.a <= s.b AND c.b >= s.a),
        m AS (SELECT c.id AS query_id, s.id, row_number() OVER (PARTITION BY c.id ORDER BY least(c.b, s.b) - greatest(c.a, s.a) DESC, s.a, s.b, s.id) AS k FROM c JOIN s ON s.repo_id = c.repo_id AND s.path = c.path AND c.a <= s.b AND c.b >= s.a),
        z AS (SELECT h.*, g.id IS NOT NULL AS gold, coalesce(m.k = 1, false) AS strict, sum(strlen(text)) OVER w AS total FROM h LEFT JOIN g ON g.query_id = h.query_id AND g.id = h.id LEFT JOIN m ON m.query_id = h.query_id AND m.id = h.id JOIN s ON s.id = h.id WINDOW w AS (PARTITION BY h.query_id ORDER BY rank)),
        y AS (SELECT *, rank = 1 OR bool_and(rank = 1 OR (rank <= 5 AND total <= 8000)) OVER (PARTITION BY query_id ORDER BY rank) AS cited FROM z),
        f AS (SELECT query_id, count(*) AS hits, min(rank) FILTER (gold) AS gold_rank, min(rank) FILTER (strict) AS gold_rank_strict, count(*) FILTER (gold) AS gold_found, count(*) FILTER (cited) AS citations, bool_or(gold AND cited) AS answer_has_gold FROM y GROUP BY 1),
        n AS (SELECT query_id, count(*) AS gold FROM g GROUP BY 1)
        SELECT c.id AS query_id, coalesce(hits, 0) AS hits, coalesce(gold, 0) AS gold, coalesce(gold, 0) > 0 AS scoreable, coalesce(gold_rank, 0)::INTEGER AS gold_rank, coalesce(gold_rank_strict, 0)::INTEGER AS gold_rank_strict, coalesce(gold_found, 0) AS gold_found, coalesce(citations, 0) AS citations,
               coalesce(answer_has_gold, false) AS answer_has_gold, CASE WHEN hits IS NULL THEN 'refused' ELSE 'answered' END AS outcome, CASE WHEN hits IS NULL THEN 'no_spans' END AS reason, moved, grouped
        FROM c LEFT JOIN f ON f.query_id = c.id LEFT JOIN n ON n.query_id = c.id
    """,
    "leak_probe": r"""
        WITH n AS (SELECT item_id, trim(regexp_replace(lower(passage), '[^\p{L}\p{Nd}]+', ' ', 'g')) AS p FROM eval_items WHERE passage IS NOT NULL),
        t AS (SELECT DISTINCT doc_id, trim(regexp_replace(lower(text), '[^\p{L}\p{Nd}]+', ' ', 'g')) AS b FROM documents WHERE text IS NOT NULL)
        SELECT DISTINCT item_id AS needle_id, doc_id AS text_id FROM n JOIN t ON contains(' ' || b || ' ', ' ' || p || ' ') WHERE len(string_split(p, ' ')) >= 4
    """,
    "golden_ledger": """
        SELECT repo_id, count(*) AS cases, count(*) FILTER (grouped) AS grouped, count(*) FILTER (start_line <> raw_start) AS moved, count(*) FILTER (coalesce(trim(question), '') = '') AS empty, count(question) - count(DISTINCT question) AS duplicates
        FROM (SELECT DISTINCT * FROM cases) GROUP BY 1
    """,
    "shared_ids": f"WITH o AS (SELECT DISTINCT arm_name, case_id FROM {_O} WHERE arm_name IS NOT NULL) SELECT a.arm_name AS a, b.arm_name AS b, count(*) AS shared FROM o a JOIN o b ON a.case_id = b.case_id AND a.arm_name < b.arm_name GROUP BY 1, 2",
    "metric_counts_seeded": "SELECT t AS event_type, count(event_id) AS n FROM (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view', 'refund']) AS t) LEFT JOIN events ON event_type = t GROUP BY 1",
    "score_histogram": f"""
        WITH o AS (SELECT arm_name, top_score AS x FROM {_O} WHERE top_score IS NOT NULL AND NOT isnan(top_score)), b AS (SELECT round(0.05 * k, 2)::DOUBLE AS le FROM generate_series(0, 20) g(k) UNION ALL SELECT 'inf'::DOUBLE)
        SELECT arm_name, le, count(*) FILTER (x <= le) AS n FROM o, b GROUP BY 1, 2
    """,
    "error_rate_windows": f"WITH {_RATIO} SELECT at_ AS at, bad, total, ratio, firing FROM r",
    "alert_hold": f"""
        WITH {_RATIO}, i AS (SELECT at_ // 1000000 AS t, at_ // 1000000 - row_number() OVER (ORDER BY at_) * 3600 AS island FROM r WHERE firing)
        SELECT min(t) AS starts, max(t) AS ends, count(*) AS evaluations FROM i GROUP BY island HAVING max(t) - min(t) >= 10800
    """,
    "absent_services": """
        WITH w AS (SELECT DISTINCT epoch_us(ts) // 3600000000 AS h, event_type FROM events), g AS (SELECT unnest(generate_series((SELECT min(h) FROM w), (SELECT max(h) FROM w))) AS h)
        SELECT g.h * 3600000000 AS at, t AS event_type FROM g, (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS t) x WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.h = g.h AND w.event_type = t)
    """,
    "p95_by_type": """
        WITH b AS (SELECT pow(2, k)::DOUBLE AS le FROM generate_series(0, 13) g(k) UNION ALL SELECT 'inf'::DOUBLE), h AS (SELECT event_type, le, count(*) FILTER (value <= le) AS n FROM events, b WHERE value IS NOT NULL GROUP BY 1, 2),
        p AS (SELECT *, coalesce(lag(n) OVER w, 0) AS below, coalesce(lag(le) OVER w, 0) AS lo, max(n) OVER (PARTITION BY event_type) AS total FROM h WINDOW w AS (PARTITION BY event_type ORDER BY le))
        SELECT event_type, round(arg_min(CASE WHEN le = 'inf'::DOUBLE THEN lo ELSE lo + (le - lo) * (0.95::DOUBLE * total - below) / (n - below) END, le), 6) AS value FROM p WHERE total > 0 AND n >= 0.95::DOUBLE * total AND below < 0.95::DOUBLE * total GROUP BY 1
    """,
    "rolling_spend_1h": """
        WITH e AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS s, round(value * 100)::BIGINT AS c FROM events)
        SELECT event_id, user_id, sum(c) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW)::BIGINT AS spent FROM e
    """,
    "tumbling_counts": "SELECT (epoch_us(ts) // 86400000000) * 86400000000 AS day, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
    "user_sessions": """
        WITH e AS (SELECT user_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
        s AS (SELECT user_id, t, sum(CASE WHEN p IS NULL OR t - p >= 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM e)
        SELECT user_id, min(t) AS starts, max(t) + 21600000000 AS ends, count(*) AS n FROM s GROUP BY user_id, k
    """,
    "queue_active_dedupe": f"""
        WITH {_JOBS}, a AS (SELECT *, row_number() OVER (PARTITION BY remote_key, ref_name ORDER BY created, id) AS n, count(*) OVER (PARTITION BY remote_key, ref_name) AS submitted FROM j WHERE status IN ('pending', 'leased'))
        SELECT remote_key, ref_name, id, status, epoch_us(created) AS created_at, submitted FROM a WHERE n = 1
    """,
    "queue_claimable": f"WITH {_JOBS} SELECT id, row_number() OVER (ORDER BY created, id)::INTEGER AS worker, epoch_us(created) AS created_at FROM c",
    "queue_lease": f"WITH {_JOBS} SELECT id, 'leased' AS status, attempts + 1 AS attempts, 'worker-' || row_number() OVER (ORDER BY created, id) AS leased_by, epoch_us(TIMESTAMP '1997-01-01 00:10:00') AS leased_until FROM c",
    "queue_fail_backoff": f"""
        WITH {_JOBS} SELECT id, CASE WHEN id % 2 = 0 THEN 'done' WHEN attempts >= 4 THEN 'failed' ELSE 'pending' END AS status, attempts, CASE WHEN id % 2 = 1 THEN 'broken' END AS error,
          CASE WHEN id % 2 = 1 AND attempts < 4 THEN epoch_us(TIMESTAMP '1997-01-01 00:00:00') + 1000000 * least(30 * pow(2, greatest(attempts - 1, 0)), 600)::BIGINT END AS leased_until
        FROM j WHERE status = 'leased' AND id % 7 <> 0
    """,
    "queue_sweep": f"WITH {_JOBS} SELECT status, count(*) AS n FROM j WHERE NOT (status IN ('done', 'failed') AND created < TIMESTAMP '1996-12-31 00:00:00') GROUP BY 1",
}
