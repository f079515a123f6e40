import itertools
import random
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators import admission, alerts, chunking, corpus, evaluate, graph, queue, toolloop
from millrace.operators.skew import hot_keys, salted_join
from millrace.functions.udfs import cited_markers

few = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


# ---- chunking ----


def spans_of(spark, n, width, overlap):
    df = spark.createDataFrame([("k", "".join(f"l{i}\n" for i in range(n)))], "id string, text string")
    return [(r.start_line, r.end_line) for r in chunking.windows(df, ["id"], "text", width, overlap).orderBy("start_line").collect()]


def test_windows(spark):
    assert spans_of(spark, 100, 40, 10) == [(1, 40), (31, 70), (61, 100)]
    assert spans_of(spark, 40, 40, 10) == [(1, 40)] and spans_of(spark, 41, 40, 10) == [(1, 40), (31, 41)]
    assert spans_of(spark, 10, 4, 1) == [(1, 4), (4, 7), (7, 10)]
    got = spans_of(spark, 20, 5, 2)
    assert all(b[0] == a[1] - 1 for a, b in itertools.pairwise(got)) and got[-1][1] == 20
    with pytest.raises(ValueError):
        spans_of(spark, 5, 4, 4)
    blank = spark.createDataFrame([("a", " \n\n"), ("b", None), ("c", "---\n")], "id string, text string")
    assert chunking.windows(blank, ["id"], "text").count() == 0


def test_declaration_chunks(spark):
    go = "package a\n\n// A is one.\nfunc A() {\n}\n\nvar B = 1\n"
    long = "func L() {\n" + "x()\n" * 30 + "}\n"
    rows = [("g", "a.go", go), ("l", "l.go", long), ("b", "b.go", "func {\n"), ("m", "m.md", "x\n" * 3), ("n", None, "x"), ("e", "e.go", "")]
    df = spark.createDataFrame(rows, "id string, path string, text string")
    got = {}
    for r in chunking.declaration_chunks(df, "id", 20, 5, 25).orderBy("start_line").collect():
        got.setdefault(r.id, []).append((r.kind, r.symbol, r.start_line, r.end_line))
    assert got == {"g": [("func", "A", 3, 5), ("var", "B", 7, 7)], "l": [("file", "", 1, 20), ("file", "", 16, 32)], "b": [("file", "", 1, 1)], "m": [("file", "", 1, 3)], "n": [("file", "", 1, 1)]}


# ---- graph ----

EDGES = [
    ("outer", "main", "a.go", 16), ("main", "a", "a.go", 8), ("main", "c", "a.go", 9), ("a", "b", "a.go", 4), ("b", "target", "z.go", 4), ("c", "target", "z.go", 8), ("target", "target", "z.go", 16),
    ("d", "e", "a.go", 12), ("e", "d", "z.go", 12), ("e", "target", "z.go", 13), ("g", "Store.Get", "store.go", 8), ("h", "Cache.Get", "cache.go", 12),
]


def edge_table(spark, edges):
    return spark.createDataFrame([(*e,) for e in edges], "from_id string, to_id string, path string, line int")


def test_callers_of_the_fixture(spark):
    got = {r.id: (r.depth, r.call_path, r.call_line) for r in graph.callers(edge_table(spark, EDGES), spark.createDataFrame([("target",)], "target string"), 3).collect()}
    assert {k: v[0] for k, v in got.items()} == {"b": 1, "c": 1, "e": 1, "target": 1, "a": 2, "main": 2, "d": 2, "outer": 3}
    assert got["main"] == (2, "a.go", 9) and got["outer"] == (3, "a.go", 16)


@few
@given(st.integers(0, 10_000), st.integers(1, 4))
def test_breadth_first_equals_recursion(spark, seed, depth):
    r = random.Random(seed)
    edges = [(f"n{r.randrange(6)}", f"n{r.randrange(6)}", f"p{r.randrange(3)}", r.randrange(9)) for _ in range(r.randrange(1, 16))]
    table, targets = edge_table(spark, edges), spark.createDataFrame([("n0",), ("n1",)], "target string")
    rows = lambda df: sorted(map(tuple, df.select("target", "id", "depth", "call_path", "call_line").collect()))
    assert rows(graph.callers(table, targets, depth)) == rows(graph.callers_recursive(table, targets, depth))


def test_recursive_callers_have_no_row_limit(spark):
    table, targets = edge_table(spark, [(f"n{i}", "n0", "p", i) for i in range(1, 9)]), spark.createDataFrame([("n0",)], "target string")
    most = spark.conf.get(graph.ROW_LIMIT)
    spark.conf.set(graph.ROW_LIMIT, "5")
    try:
        assert graph.callers_recursive(table, targets, 2).count() == 8
        assert spark.conf.get(graph.ROW_LIMIT) == "5"
    finally:
        spark.conf.set(graph.ROW_LIMIT, most)


def test_edges_are_checked(spark):
    bad = spark.createDataFrame([("1", None, "resolved")], "id string, to_id string, provenance string")
    with pytest.raises(Exception, match="edge 1"):
        graph.check_edges(bad).collect()


@few
@given(st.integers(0, 10_000))
def test_range_joins(spark, seed):
    r = random.Random(seed)
    ranges = [("k", i, s, s + r.randrange(200)) for i in range(12) for s in [r.randrange(1, 300)]]
    items = [("k", f"i{i}", s, s + r.randrange(150)) for i in range(8) for s in [r.randrange(1, 400)]]
    rdf, idf = spark.createDataFrame(ranges, "k string, id int, r_start int, r_end int"), spark.createDataFrame(items, "k string, item string, start_line int, end_line int")
    first, around, best = {}, {}, {}
    for _, item, a, b in items:
        met = [(s, e, i) for _, i, s, e in ranges if s <= b and e >= a]
        inside = [(-s, e, i) for s, e, i in met if s <= a <= e]
        if met:
            first[item] = min(met)[2]
            best[item] = min(inside)[2] if inside else min(met)[2]
        if inside:
            around[item] = min(inside)[2]
    as_dict = lambda df: {x.item: x.id for x in df.collect()}
    assert as_dict(graph.first_overlapping(idf, rdf, ["k"], "item")) == first
    assert as_dict(graph.span_for(idf, rdf, ["k"], "item")) == best
    assert as_dict(graph.containing(idf.select("k", "item", F.col("start_line").alias("line")), rdf, ["k"], "item")) == around


# ---- admission ----


@pytest.mark.parametrize(
    ("url", "rule", "key"),
    [
        ("https://Code.example/Own/Name.git.git/", None, "code.example/own/name"), ("", "form", None), (None, "form", None), ("http://code.example/a/b", "scheme", None), ("https://me@code.example/a/b", "form", None), ("https://code.example:443/a/b", "form", None),
        ("https://evil.example/a/b", "host", None), ("https://code.example/a", "form", None), ("https://code.example/a/b/c", "form", None), ("https://code.example/a/.git", "form", None), ("https://code.example/a b/c", "form", None), ("git@code.example:a/b", "scheme", None),
    ],
)
def test_admission(spark, url, rule, key):
    a = spark.createDataFrame([(url,)], "u string").select(admission.admitted(F.col("u"), ["code.example"]).alias("a")).first().a
    assert (a.rule, a.key) == (rule, key)


def test_refs_and_commits(spark):
    refs = ["main", "a/b-1.2", "", ".", "-x", "a..b", "a b", "x" * 256, None]
    got = [r.x for r in spark.createDataFrame([(r,) for r in refs], "r string").select(admission.valid_ref(F.col("r")).alias("x")).collect()]
    assert got == [True, True, *[False] * 7]
    commits = ["a" * 40, "A" * 64, "a" * 39, "g" * 40, None]
    got = [r.x for r in spark.createDataFrame([(c,) for c in commits], "c string").select(admission.valid_commit(F.col("c")).alias("x")).collect()]
    assert got == [True, True, False, False, False]


# ---- queue ----


def test_queue(spark):
    t0 = datetime(2025, 1, 1)
    schema = "id long, remote string, ref_name string, status string, attempts int, leased_by string, leased_until timestamp, error string, created_at timestamp, updated_at timestamp"
    at = lambda m: t0 + timedelta(minutes=m)
    jobs = spark.createDataFrame(
        [
            (1, "H/a", "m", "pending", 0, None, None, None, at(0), at(0)), (2, "h/A", "m", "leased", 1, "w1", at(5), None, at(1), at(1)), (3, "h/b", "m", "leased", 5, "w2", at(90), None, at(2), at(2)),
            (4, "h/b", "n", "pending", 2, None, at(50), None, at(3), at(3)), (5, "h/c", "m", "done", 1, None, None, None, at(-9000), at(-9000)), (6, "h/c", "m", "failed", 1, None, None, None, at(4), at(4)),
        ],
        schema,
    )
    now = F.lit(at(30)).cast("timestamp")
    assert [(r.id, r.worker) for r in queue.claimable(jobs, now, 5).collect()] == [(1, 1), (2, 2)]
    leased = {r.id: r for r in queue.lease(jobs, now, 1, 60).collect()}
    assert set(leased) == {1} and leased[1].attempts == 1 and leased[1].leased_until == at(31)
    active = {(r.remote_key, r.ref_name): (r.id, r.submitted) for r in queue.active_jobs(jobs).collect()}
    assert active == {("h/a", "m"): (1, 2), ("h/b", "m"): (3, 1), ("h/b", "n"): (4, 1)}
    results = spark.createDataFrame([(2, "w1", "x"), (3, "w2", "x"), (4, "w1", None)], "id long, leased_by string, error string")
    done = {r.id: (r.status, r.leased_until) for r in queue.finish(jobs, results, now, 5).collect()}
    assert done == {2: ("pending", at(30) + timedelta(seconds=30)), 3: ("failed", None)}
    assert sorted(r.id for r in queue.sweep(jobs, now, 24).collect()) == [1, 2, 3, 4, 6]
    new = spark.createDataFrame([(10, "H/B", "m", at(40)), (11, "h/z", "m", at(40)), (12, "h/Z", "m", at(41))], "id long, remote string, ref_name string, created_at timestamp")
    assert {r.id: r.job_id for r in queue.enqueue(jobs, new).collect()} == {10: 3, 11: 11, 12: 11}


# ---- evaluation ----


def test_metrics(spark):
    df = spark.createDataFrame([("a", r, s, True) for r, s in ((1, True), (3, True), (0, True), (5, False))], "arm string, gold_rank int, scoreable boolean, answer_has_gold boolean")
    got = evaluate.summaries(df, ["arm"]).first()
    assert got.mrr == pytest.approx(4 / 9) and (got.hit_at_1, got.hit_at_3) == (pytest.approx(1 / 3), pytest.approx(2 / 3)) and got.unscoreable == 1
    assert evaluate.summaries(df.limit(0), ["arm"]).count() == 0


def test_gold(spark):
    spans = spark.createDataFrame([("a", "w1", 1, 12), ("a", "w2", 11, 19), ("a", "w3", 18, 30), ("a", "w4", 31, 40), ("b", "b1", 10, 20)], "path string, id string, r_start int, r_end int")
    case = spark.createDataFrame([("a", "c", 10, 20)], "path string, case_id string, start_line int, end_line int")
    got = evaluate.gold(case, spans, ["path"]).first()
    assert (got.lenient, got.strict, got.shared_lines) == (3, "w2", 9)
    tie = spark.createDataFrame([("a", "x", 16, 22), ("a", "y", 6, 14)], "path string, id string, r_start int, r_end int")
    assert evaluate.gold(case, tie, ["path"]).first().strict == "y"


def test_quantiles_are_exact(spark):
    values = [random.Random(5).uniform(-1, 1) for _ in range(74)] + [0.25] * 30
    df = spark.createDataFrame([("k", v) for v in values] + [("k", None), ("k", float("nan"))], "k string, v double")
    got = evaluate.order_statistics(df, ["k"], "v", {"p10": 0.1, "p50": 0.5, "p90": 0.9, "top": 1.0}, -1, 1).first()
    ranked = sorted(values)
    assert got.n == len(ranked) and [got.p10, got.p50, got.p90, got.top] == [ranked[int(p * (len(ranked) - 1))] for p in (0.1, 0.5, 0.9, 1.0)]


def test_bootstrap(spark):
    schema = "rank_a int, rank_b int"
    better = evaluate.bootstrap_difference(spark.createDataFrame([(2, 1)] * 200 + [(1, 1)] * 50, schema))
    assert better["verdict"] == "better" and better["difference"] == pytest.approx(0.4)
    assert evaluate.bootstrap_difference(spark.createDataFrame([(1, 1)] * 5, schema))["verdict"] == "undecided"
    assert evaluate.bootstrap_difference(spark.createDataFrame([], schema))["cases"] == 0


# ---- corpus ----


def test_eviction_and_lookup(spark):
    t = datetime(2025, 1, 1)
    repos = spark.createDataFrame([(f"r{i}", t + timedelta(days=i // 2)) for i in range(6)], "id string, last_used timestamp")
    gone = corpus.evicted(repos, 3)
    assert sorted(r.id for r in gone.collect()) == ["r0", "r1", "r2"]
    buried = corpus.tombstones(spark.createDataFrame([("old", t)], "id string, evicted_at timestamp"), gone, F.lit(t + timedelta(days=9)).cast("timestamp"), 3)
    assert sorted(r.id for r in buried.collect()) == ["r0", "r1", "r2"]
    wanted = spark.createDataFrame([("r0",), ("r5",), ("none",)], "repo_id string")
    assert {r.repo_id: r.status for r in corpus.lookup(wanted, corpus.kept(repos, 3), buried).collect()} == {"r0": 410, "r5": 200, "none": 404}
    child = spark.createDataFrame([("r0",), ("r5",)], "repo_id string")
    assert [r.repo_id for r in corpus.cascade(child, gone).collect()] == ["r5"]


def test_upsert_keeps_first_values(spark):
    schema = "id string, commit string, n int"
    got = corpus.merged(spark.createDataFrame([("a", "c1", 1), ("b", "c2", 2)], schema), spark.createDataFrame([("a", "c9", 5), ("c", "c3", None)], schema), "id", ["commit"])
    assert {tuple(r) for r in got.collect()} == {("a", "c1", 5), ("b", "c2", 2), ("c", "c3", None)}


def test_changed_files(spark):
    files = spark.createDataFrame([("n", "a", "1"), ("n", "b", "2"), ("n", "c", "3"), ("o", "a", "1"), ("o", "b", "9"), ("x", "a", "1")], "repo_id string, path string, blob string")
    previous = spark.createDataFrame([("n", "o"), ("o", None), ("x", None)], "id string, previous_id string")
    assert {r.repo_id: r.changed for r in corpus.changed_files(files, previous).collect()} == {"n": 2, "o": -1, "x": -1}


# ---- alerts ----


def test_histograms(spark):
    df = spark.createDataFrame([("k", float(v)) for v in range(1, 101)] + [("k", None), ("k", float("nan"))], "k string, v double")
    h = alerts.cumulative_histogram(df, ["k"], "v", [10.0, 50.0, 90.0])
    assert {r.le: r.n for r in h.collect()} == {10.0: 10, 50.0: 50, 90.0: 90, float("inf"): 100}
    assert alerts.histogram_quantile(h, ["k"], 0.5).first().value == 50.0
    assert alerts.histogram_quantile(h, ["k"], 0.99).first().value == 90.0
    counts = alerts.seeded_counts(df.select(F.col("k").alias("label")), "label", ["k", "none"])
    assert {r.label: r.n for r in counts.collect()} == {"k": 102, "none": 0}


def test_hold(spark):
    t = datetime(2025, 1, 1)
    on = [0, 1, 2, 3, 6, 7]
    df = spark.createDataFrame([(t + timedelta(minutes=i), i in on) for i in range(10)], "at timestamp, firing boolean")
    got = alerts.held(df, "at", "firing", 60, 120).collect()
    assert [r.evaluations for r in got] == [4]


# ---- loops ----


def transcript(spark, rows):
    schema = "conversation string, step int, ord int, kind string, ending string, text string, request_tokens int, input_tokens int, output_tokens int, elapsed_ms int, tool string, args string, outcome string, span_id string"
    return spark.createDataFrame(rows, schema)


def said(c, step, ending="calls", text=None, tokens=10, ms=0):
    return (c, step, 0, "response", ending, text, tokens, tokens, tokens, ms, None, None, None, None)


def called(c, step, n=1, tool="read_span", args="{}", outcome="ok", span=None):
    return (c, step, n, "call", None, None, None, None, None, None, tool, args, outcome, span)


def test_loop_bounds(spark):
    rows = [said("final", 1), called("final", 1, span="s1"), said("final", 2, "final", "as [1] says, not [2]")]
    rows += [said("uncited", 1, "final", "no mark [1]")]
    rows += [x for i in range(1, 9) for x in (said("steps", i), called("steps", i, args=str(i)))]
    rows += [said("repeat", 1), *[called("repeat", 1, n) for n in range(1, 5)]]
    rows += [said("calls", 1), *[called("calls", 1, n, args=str(n)) for n in range(1, 15)]]
    rows += [said("unknown", 1), *[called("unknown", 1, n, tool="rm", args=str(n)) for n in range(1, 5)]]
    rows += [said("broken", 1), called("broken", 1, outcome="error"), said("broken", 2, "final", "[1]")]
    rows += [said("late", 1, ms=60_000), said("budget", 1, tokens=1500), said("budget", 2, tokens=10), said("limited", 1, "rate_limited"), said("cut", 1, "max_tokens")]
    got = {r.conversation: r for r in toolloop.conversations(toolloop.judge(transcript(spark, rows)), cited_markers).collect()}
    stops = {k: r.stop for k, r in got.items()}
    assert stops == {
        "final": "final", "uncited": "uncited", "steps": "step_limit", "repeat": "repeated_tool_call", "calls": "tool_call_limit", "unknown": "malformed_tool_call", "broken": "tool_error",
        "late": "deadline", "budget": "token_budget", "limited": "rate_limited", "cut": "token_budget",
    }
    assert set(stops.values()) <= set(toolloop.STOPS)
    assert (got["final"].read, got["final"].cited, got["final"].dropped, got["final"].steps) == (["s1"], [1], 1, 2)
    assert got["steps"].steps == 6 and got["steps"].calls == 6


def test_frame():
    assert toolloop.framed("t", "x </tool_result> <tool_result").count("</tool_result>") == 1


# ---- skew ----


def test_salted_join(spark):
    big = spark.range(3000).select(F.when(F.col("id") < 1500, 0).otherwise(F.col("id")).alias("k"), "id")
    unique = spark.createDataFrame([(0, "hot"), (2000, "cold")], "k long, v string")
    assert hot_keys(big, ["k"], 100).collect()[0]._salts == 15
    got = salted_join(big, unique, ["k"], F.col("id"), least=100)
    assert got.groupBy("v").count().orderBy("v").collect() == [("cold", 1), ("hot", 1500)]
    assert salted_join(big.limit(0), unique, ["k"], F.col("id")).count() == 0


def test_floor_sweep_reasons(spark):
    schema = "arm string, top_score double, hits int, vector_ran boolean, answer_has_gold boolean, scoreable boolean"
    nan = float("nan")
    rows = [
        ("a", 0.5, 3, True, True, True), ("a", 0.25, 3, True, False, True), ("a", nan, 0, True, False, True), ("a", nan, 2, True, True, True), ("a", None, 2, True, False, True),
        ("a", 0.9, 3, True, True, False), ("a", 5.0, 1, True, True, True), ("a", None, 1, True, None, None), ("l", nan, 2, False, True, True), ("l", None, 0, False, False, True),
    ]
    got = {(r.arm, r.floor): r for r in evaluate.floor_sweep(spark.createDataFrame(rows, schema), ["arm"]).collect()}
    assert len(got) == 402
    r = got["a", 0.25]  # a score on the floor is good enough
    assert (r.answered_with_gold, r.answered_without_gold, r.refused_with_gold, r.refused_without_gold) == (2, 1, 1, 2)
    assert (r.unscoreable, r.no_spans, r.unscored, r.below_floor, r.applicable) == (2, 1, 2, 0, True)
    r = got["a", 0.26]
    assert (r.answered_with_gold, r.answered_without_gold, r.refused_with_gold, r.refused_without_gold, r.below_floor) == (2, 0, 1, 3, 1)
    assert got["a", 1.0].answered_with_gold == 1
    # Without a vector arm nothing reads the floor: what has a hit is answered at every one.
    assert {(got["l", f].answered_with_gold, got["l", f].no_spans, got["l", f].applicable) for f in (-1.0, 0.0, 1.0)} == {(1, 1, False)}
    assert evaluate.floor_sweep(spark.createDataFrame([], schema), ["arm"]).count() == 0


def test_case_records(spark):
    from millrace.operators.retrieval import Budget

    cases = spark.createDataFrame([("q1", "r", "f", 5, 8), ("q2", "r", "f", 90, 95), ("q3", "r", "f", 1, 9)], "query_id string, repo_id string, path string, start_line int, end_line int")
    spans = spark.createDataFrame([("r", "x", "f", 1, 5, "aa"), ("r", "y", "f", 5, 9, "b" * 90), ("r", "z", "g", 5, 9, "c")], "repo_id string, id string, path string, start_line int, end_line int, text string")
    hits = spark.createDataFrame([("q1", 1, "z", 1, 0), ("q1", 2, "gone", 2, 1), ("q1", 3, "x", 0, 2), ("q1", 4, "y", 3, 3), ("q2", 1, "x", 1, 1)], "query_id string, rank int, id string, vector_rank int, lexical_rank int")
    top = spark.createDataFrame([("q1", 0.1), ("q2", 0.9)], "query_id string, top_score double")
    got = {r.query_id: r for r in evaluate.records(cases, spans, hits, Budget(5, 50), 0.25, top).collect()}
    r = got["q1"]
    assert (r.gold, r.gold_rank, r.gold_rank_strict, r.gold_vector_rank, r.gold_lexical_rank, r.hits, r.gold_found) == (2, 3, 4, 0, 2, 4, 2)
    assert (r.citations, r.answer_has_gold, r.outcome, r.reason) == (2, True, "refused", "below_floor")
    assert (got["q2"].scoreable, got["q2"].gold_rank, got["q2"].outcome) == (False, 0, "answered")
    assert (got["q3"].hits, got["q3"].scoreable, got["q3"].reason) == (0, True, "no_spans")
    s = evaluate.summaries(evaluate.records(cases, spans, hits, Budget(5, 50), 0.25, top).withColumn("arm", F.lit("h")), ["arm"], (1, 3)).first()
    assert (s.cases, s.unscoreable, s.hit_at_3, s.strict_hit_at_3, s.gold_found_by_lexical_only, s.gold_not_found, s.mean_gold) == (3, 1, 0.5, 0.0, 1, 1, 2.0)
    assert (round(s.mrr, 6), s.strict_mrr) == (round(1 / 6, 6), 0.125)


def test_pages_and_cursors(spark):
    df = spark.createDataFrame([("b", 2, "x"), ("a", 9, "y"), ("b", 1, "z"), ("b", 2, "a")], "path string, line int, id string")
    keys, seen, after = ["path", "line", "id"], [], None
    while True:
        rows = corpus.page(df, keys, after, 3)
        seen += [r.id for r in rows.collect()]
        if (after := corpus.next_cursor(rows, keys, 3)) is None:
            break
    assert seen == ["y", "z", "a", "x"]


def test_corpus_refusals_come_most_specific_first(spark):
    repos = lambda db, c: spark.createDataFrame([(r, db if r != "same" else "d", c if r == "commit" else "c") for r in ("same", "commit", "files", "source", "spans", "fine", "none")], "repo_id string, database string, commit_sha string")
    files = spark.createDataFrame([(r, p, "x") for r in ("same", "commit", "files", "source", "spans", "fine") for p in ("a", "b")], "repo_id string, path string, blob string")
    other = files.withColumn("blob", F.when(F.col("repo_id").isin("same", "commit", "files"), "y").otherwise(F.col("blob")))
    source = files.where("NOT (repo_id = 'source' AND path = 'b')")
    spans = spark.createDataFrame([(r, f"{r}{i}") for r in ("same", "spans", "fine") for i in range(3)], "repo_id string, id string")
    got = {r.repo_id: r for r in corpus.verified((repos("d", "c"), files, spans), (repos("e", "k"), other, spans.where("id <> 'fine2'")), source).collect()}
    assert {k: r.refused for k, r in got.items()} == {"same": "same_database", "commit": "commits", "files": "files", "source": "source", "spans": "identical_spans", "fine": None, "none": "identical_spans"}
    assert (got["files"].path, got["source"].path, got["fine"].path) == ("a", "b", None)
    assert (got["fine"].spans_a, got["fine"].spans_b, got["fine"].shared_ids, got["fine"].files_a) == (3, 2, 2, 2)


def test_rules_ledgers_and_sweeps(spark):
    t = datetime(2025, 1, 1)
    at = lambda m: t + timedelta(minutes=m)
    samples = spark.createDataFrame([("a", at(1), 1.0, 1), ("a", at(50), 0.0, 2), ("b", at(50), 0.0, 1), ("b", at(50), 1.0, 2), ("c", at(70), None, 1)], "job string, ts timestamp, up double, n int")
    got = {r.job: r.firing for r in alerts.gauge_rule(samples, "job", "ts", "up", "1 hour", 1.0, "n").collect()}
    assert got == {"a": True, "b": False, "c": True}
    counted = alerts.count_rule(samples, F.col("up") == 0, "ts", "1 hour", 1).collect()
    assert [(r.bad, r.firing) for r in counted] == [(2, True)]
    touched = spark.createDataFrame([(1, at(0)), (2, at(100)), (3, None)], "id int, at timestamp")
    assert [r.id for r in queue.abandoned(touched, "at", F.lit(at(150)), 3600).collect()] == [1]
    ledgers = spark.createDataFrame([("r", "a", 2, 1), ("r", "b", 1, 0)], "repo string, file string, cases int, duplicates int")
    cases = spark.createDataFrame([("r", "q"), ("r", "q"), ("r", "q")], "repo string, question string")
    assert [tuple(r) for r in evaluate.merged_ledger(ledgers.drop("file"), ["repo"], cases).select("repo", "cases", "duplicates").collect()] == [("r", 3, 2)]


def test_graph_counts(spark):
    repos = spark.createDataFrame([("r",), ("s",)], "id string")
    none = spark.createDataFrame([], "id string, repo_id string, file_id string, n_lines int, kind string, text string, embedding string")
    edges = spark.createDataFrame([("r", "resolved"), ("r", "syntactic"), ("r", "syntactic")], "repo_id string, provenance string")
    got = {r.repo_id: r for r in corpus.repo_stats(repos, none, none, spark.createDataFrame([("r", "f")], "repo_id string, id string"), edges).collect()}
    assert (got["r"].symbols, got["r"].edges, got["r"].edges_resolved, got["r"].edges_syntactic, got["s"].edges) == (1, 3, 1, 2, 0)
