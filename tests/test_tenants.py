"""Many questions meet the rows of their tenants: the same as by index and by broadcast."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import retrieval as R
from millrace.operators import tenants


@pytest.fixture
def parts(monkeypatch):
    """Every set of questions is too large to be broadcast, and tenants are cut into parts."""
    monkeypatch.setattr(R, "MOST_BROADCAST", 0)
    for name, n in (("QUESTIONS_A_PART", 3), ("ROWS_A_PART", 10), ("ROWS_A_GROUP", 4)):
        monkeypatch.setattr(tenants, name, n)


def spans_of(spark, r):
    word = lambda: r.choice(["the", "Store", "span", "loads", "x1", "É", "of"])
    rows = [(r.choice(["t", "t", "t", "u", None]), f"s{i:02}", r.choice(["a.go", "b.go", None]), r.randrange(3), r.choice([None, "", "Store.Span"]), r.choice(["", None, *[" -".join(word() for _ in range(r.randrange(1, 9))) for _ in range(6)]])) for i in range(60)]
    return spark.createDataFrame(rows, "tenant string, id string, path string, start_line int, symbol string, text string")


@pytest.mark.parametrize("seed", [1, 2])
def test_terms(spark, parts, seed):
    r = random.Random(seed)
    spans = spans_of(spark, r)
    asked = [(q, r.choice(["t", "t", "u", "none", None]), " ".join(r.sample(["the", "store", "span", "É", "zebra", "of", "x1"], 3))) for q in range(20)]
    terms = R.question_terms(spark.createDataFrame(asked, "query_id int, tenant string, q string"))
    index = R.postings(spans, ["tenant", "id", "path", "start_line"], "symbol", "text")
    rows = lambda df: sorted(map(tuple, df.collect()))
    for limit in (1, 4, 50):
        expected = rows(R.lexical_topk(index, terms, limit))
        assert expected and rows(R.lexical_scan(spans, terms, limit)) == expected
    assert R.lexical_scan(spans.where(F.lit(False)), terms, 4).count() == 0


def test_vectors(spark, parts):
    r = random.Random(3)
    vectors = [[1.0, 0.0], [0.0, 0.0], [0.6, 0.8], [3.0, 4.0], [-1.0, 0.5], [1.0], None]
    rows = [(r.choice(["t", "t", "u", None]), f"s{i:02}", r.choice(["a", None]), r.randrange(3), r.choice(vectors)) for i in range(60)]
    corpus = spark.createDataFrame(rows, "tenant string, id string, path string, start_line int, embedding array<float>")
    asked = spark.createDataFrame([(q, r.choice(["t", "u", "none", None]), r.choice(vectors)) for q in range(20)], "query_id int, tenant string, embedding array<float>")
    met = {limit: sorted((*x[:3], repr(round(x[3], 6))) for x in R.vector_topk(corpus, asked, limit).collect()) for limit in (1, 5, 50)}
    R.MOST_BROADCAST = 100  # put back by the fixture
    for limit, found in met.items():
        assert found and found == sorted((*x[:3], repr(round(x[3], 6))) for x in R.vector_topk(corpus, asked, limit).collect())


def test_arms_compared(spark, sf, monkeypatch):
    from millrace.plans import evaluation

    scans = []
    scan = R.lexical_scan
    monkeypatch.setattr(R, "lexical_scan", lambda *a: scans.append(1) or scan(*a))
    got = {r["mode"]: r for r in evaluation.arm_comparison(spark, sf).collect()}
    assert len(scans) == 1  # both summaries from one scan
    alone = evaluation.case_records(spark, sf).selectExpr("count(*) AS cases", "count_if(answer_has_gold AND scoreable) AS good", "count_if(scoreable AND gold_rank > 0) AS found").first()
    assert (got["lexical"].cases, got["lexical"].answers_with_gold, got["lexical"].gold_found_by_lexical_only) == tuple(alone) and got["hybrid"].cases == alone.cases


@pytest.mark.parametrize("rows", [10, 1000])
def test_arms_meet_once(spark, sf, parts, monkeypatch, rows):
    """Rows of a tenant that are cut into parts, and that are not, give what the arms give by broadcast."""
    from millrace.plans import evaluation

    met = []
    by_tenant = tenants.by_tenant
    monkeypatch.setattr(tenants, "by_tenant", lambda *a: met.append(1) or by_tenant(*a))
    monkeypatch.setattr(tenants, "ROWS_OF_ARMS", rows)
    monkeypatch.setattr(tenants, "QUESTIONS_OF_ARMS", 3)
    monkeypatch.setattr(tenants, "ROWS_A_BLOCK", 7)
    got = sorted(map(tuple, evaluation.arm_comparison(spark, sf).collect()))
    assert len(met) == 1  # both arms
    records = sorted(map(repr, evaluation.case_records_hybrid(spark, sf).collect()))
    R.MOST_BROADCAST = 20_000  # put back by the fixture
    assert got == sorted(map(tuple, evaluation.arm_comparison(spark, sf).collect())) and len(met) == 2
    assert records == sorted(map(repr, evaluation.case_records_hybrid(spark, sf).collect()))


@pytest.mark.parametrize("rows", [10, 1000])
def test_arms_of_odd_rows(spark, parts, monkeypatch, rows):
    r = random.Random(5)
    vectors = [[1.0, 0.0], [0.0, 0.0], [0.6, 0.8], [3.0, 4.0], [-1.0, 0.5], None]
    spans = spans_of(spark, r).select("tenant", F.substring("id", 2, 2).cast("long").alias("id"), "symbol", "text")
    spans = spans.join(spark.createDataFrame([(i, r.choice(vectors)) for i in range(60)], "id long, embedding array<float>"), "id")
    asked = [(q or None, r.choice(["t", "t", "u", "none", None]), r.choice(["", "-", "the store É", "zebra", "of x1 span"]), r.choice(vectors)) for q in range(40)]
    questions = spark.createDataFrame(asked, "query_id long, tenant string, q string, embedding array<float>")
    monkeypatch.setattr(tenants, "ROWS_OF_ARMS", rows)
    monkeypatch.setattr(tenants, "QUESTIONS_OF_ARMS", 3)
    for depth, limit in ((40, 10), (4, 2)):
        found = []
        for R.MOST_BROADCAST in (0, 100):  # put back by the fixture
            both = R.both_arms(spans, questions, depth, R.Fusion(10.0, 1.0, 0.5), limit)
            found.append(sorted((x[:5], repr(round(x[5], 6)) if x[5] is not None else None) for x in map(tuple, both.collect())))
        assert found[0] and found[0] == found[1]
    R.MOST_BROADCAST = 0
    assert R.both_arms(spans.where(F.lit(False)), questions, 4, R.Fusion(), 2).count() == 0
