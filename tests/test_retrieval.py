import pytest
from pyspark.sql import functions as F

from millrace.api import Engine
from millrace.operators import retrieval as R


def test_vector_order(spark):
    sparse = {"A": {0: 10.0}, "B": {0: 1.0, 1: 0.1}, "D": {0: 2.0, 1: 5.0}, "C": {1: 1.0}, "Z": {}}
    rows = [("t", k, k + ".go", 1, [v.get(i, 0.0) for i in range(8)]) for k, v in sparse.items()] + [("other", "X", "a", 1, [1.0] + [0.0] * 7), ("t", "N", "n", 1, None), ("t", "W", "w", 1, [1.0])]
    corpus = spark.createDataFrame(rows, "tenant string, id string, path string, start_line int, embedding array<float>")
    asked = spark.createDataFrame([(1, "t", [1.0] + [0.0] * 7), (2, "t", None)], "query_id int, tenant string, embedding array<float>")
    got = R.vector_topk(corpus, asked, 5).orderBy("rank").collect()
    assert [r.id for r in got] == ["A", "B", "D", "C", "Z"]
    assert [round(r.similarity, 5) for r in got[:4]] == [1.0, 0.99504, 0.37139, 0.0]
    assert R.vector_topk(corpus.limit(0), asked, 5).count() == 0


def test_lexical(spark):
    filler = "filler word here " * 30
    rows = [
        ("t", 1, "a_body.go", 10, None, filler * 2 + " parseConfig"), ("t", 2, "d_prose.go", 20, None, "// parse the config file and return it"), ("t", 3, "e_method.go", 30, "Store.Get", "unrelated body"), ("t", 4, "y_cover.go", 40, None, "alpha beta " + filler),
        ("t", 5, "x_repeat.go", 50, None, "alpha " * 6 + filler), ("t", 6, "c_symbol.go", 60, "parseConfig", "unrelated body"), ("u", 7, "a", 1, "parseConfig", "alpha"),
    ]
    spans = spark.createDataFrame(rows, "tenant string, id int, path string, start_line int, symbol string, text string")
    index = R.postings(spans, ["tenant", "id", "path", "start_line"], "symbol", "text")

    def ask(q, split=True):
        terms = R.question_terms(spark.createDataFrame([(1, "t", q)], "query_id int, tenant string, q string"), split)
        by_index = [(r.id, r.score) for r in R.lexical_topk(index, terms, 10).orderBy("rank").collect()]
        assert by_index == [(r.id, r.score) for r in R.lexical_scan(spans, terms, 10).orderBy("rank").collect()]
        assert by_index[:1] == [(r.id, r.score) for r in R.lexical_scan(spans, terms, 1).collect()]
        return by_index

    assert ask("alpha beta", False) == [(5, 2.4), (4, 0.8)]
    assert ask("get") == [(3, 1.0)]
    assert [i for i, _ in ask("parseConfig")] == [6, 2, 1]
    assert ask("...") == []


def fused(spark, vector, lexical, fusion):
    v = spark.createDataFrame([(1, i + 1, x, 0.5) for i, x in enumerate(vector)], "query_id int, rank int, id string, similarity double")
    lex = spark.createDataFrame([(1, i + 1, x, 1.0) for i, x in enumerate(lexical)], "query_id int, rank int, id string, score double")
    places = spark.createDataFrame([(x, x, 1) for x in {*vector, *lexical}], "id string, path string, start_line int")
    return R.fuse(v, lex, places, fusion, 10).orderBy("rank").collect()


def test_fusion(spark):
    got = fused(spark, "ABCD", "CAE", R.Fusion())
    assert [r.id for r in got] == ["A", "C", "B", "E", "D"]
    assert (got[0].vector_rank, got[0].lexical_rank) == (1, 2) and got[3].vector_rank == 0
    assert got[0].score == 0.03252247488101534
    for weights, first in (((2, 1), "X"), ((1, 2), "Z"), ((1, 1), "X")):
        assert fused(spark, "XYZ", "ZYX", R.Fusion(60, *weights))[0].id == first
    got = fused(spark, "XY", "Z", R.Fusion(60, 0, 1))
    assert [r.id for r in got] == ["Z", "X", "Y"] and got[1].score == 0
    for bad in ((-1, 1, 1), (60, 0, 0), (60, float("nan"), 1)):
        with pytest.raises(ValueError):
            R.Fusion(*bad)


def test_decide(spark):
    rows = [("none", 0, None, True), ("edge", 3, 0.5, True), ("below", 3, 0.4, True), ("nan", 3, float("nan"), True), ("lexical", 3, None, False)]
    got = {r.k: (r.outcome, r.reason) for r in R.decide(spark.createDataFrame(rows, "k string, hits int, top_score double, vector_ran boolean"), 0.5).collect()}
    assert got == {"none": ("refused", "no_spans"), "edge": ("answered", None), "below": ("refused", "below_floor"), "nan": ("refused", "unscored"), "lexical": ("answered", None)}


def assembled(spark, lengths, budget, missing=()):
    ranked = spark.createDataFrame([(1, i + 1, f"s{i}") for i in range(len(lengths))], "query_id int, rank int, id string")
    spans = spark.createDataFrame([(f"s{i}", "p", "", 1, 2, "x" * n) for i, n in enumerate(lengths) if i not in missing], "id string, path string, symbol string, start_line int, end_line int, text string")
    return R.assemble(ranked, spans, budget).first()


def test_assemble(spark):
    got = assembled(spark, [4000, 3500, 3000], R.Budget(5, 9000))
    assert (got.cited, got.dropped) == (2, 1) and got.answer.startswith("[1] p:1-2\nx") and "\n\n[2] p:1-2\n" in got.answer
    got = assembled(spark, [5000, 10], R.Budget(5, 100))
    assert (got.cited, got.dropped) == (1, 1) and len(got.answer) > 5000
    got = assembled(spark, [10, 10, 10], R.Budget(1, 1000), missing=(0,))
    assert (got.cited, got.dropped) == (1, 2) and got.answer.startswith("[1]")


def test_validation():
    assert R.check_question("  x ") == "x"
    for bad in ("", "   ", "??", "é" * 501):
        with pytest.raises(ValueError):
            R.check_question(bad)
    with pytest.raises(ValueError):
        R.check_question("x", 51)
    with pytest.raises(ValueError):
        R.check_search("both", 1, 1)


def test_embedder(spark):
    schema = "embed_model string, embed_dim int, embedding array<float>"
    assert R.embedder_of(spark.createDataFrame([("m", 1, [1.0]), ("n", 2, None)], schema)) == ("m", 1)
    with pytest.raises(ValueError):
        R.embedder_of(spark.createDataFrame([("m", 1, [1.0]), ("n", 2, [1.0, 2.0])], schema))
    with pytest.raises(LookupError):
        R.embedder_of(spark.createDataFrame([], schema))
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    x, y = (r.x for r in df.select(R.cosine_similarity(F.col("a"), F.col("b")).alias("x")).collect())
    assert x != x and y == pytest.approx(0.70710678)


def test_engine(spark):
    t = "timestamp'2025-01-01 00:00:00'"
    repos = spark.sql(f"SELECT * FROM VALUES ('r1', 'github.com/o/n', 'main', repeat('a', 40), {t}, {t}), ('r2', 'github.com/o/n', 'main', repeat('b', 40), {t} + INTERVAL 1 DAY, {t}) AS x(id, remote_key, ref_name, commit_sha, indexed_at, last_used)")
    spans = spark.sql("SELECT * FROM VALUES ('s1', 'r1', 'f1', 'a.go', 'func', 'Load', 1, 3, 'func Load() {}', array(1.0F, 0.0F)), ('s2', 'r1', 'f1', 'a.go', 'func', 'Store', 5, 9, 'func Store() { Load() }', array(0.0F, 1.0F)), ('s3', 'r2', 'f2', 'a.go', 'func', 'Load', 1, 3, 'func Load() {}', array(1.0F, 0.0F)) AS x(id, repo_id, file_id, path, kind, symbol, start_line, end_line, text, embedding)")
    files = spark.createDataFrame([("f1", "r1", 9), ("f2", "r2", 3)], "id string, repo_id string, n_lines int")
    symbols = spans.select("id", "repo_id", "path", F.col("symbol").alias("name"), F.lit("p").alias("pkg"), "start_line")
    edges = spark.createDataFrame([("r1", "e1", "s2", "s1", "Load", "resolved", "a.go", 6), ("r1", "e2", "s2", None, "Load", "syntactic", "a.go", 7)], "repo_id string, id string, from_id string, to_id string, to_name string, provenance string, path string, line int")
    e = Engine(repos, spans, files, symbols, edges)
    assert [r.id for r in e.list_repos().collect()] == ["r1", "r2"]
    one = e.get_repo("r1", "2025-01-03 00:00:00").first()
    assert one.spans == 2 and one.staleness.state == "superseded" and one.newer_commit == "b" * 40
    assert e.get_span("r1", "s1").first().permalink.endswith("/blob/" + "a" * 40 + "/a.go#L1-L3") and e.get_span("r1", "s3").count() == 0
    q = spark.sql("SELECT 1 AS query_id, 'r1' AS tenant, 'load' AS q, array(1.0F, 0.0F) AS embedding")
    assert [r.id for r in e.search(q).orderBy("rank").collect()] == ["s1", "s2"]
    answer = e.ask(q).first()
    assert (answer.outcome, answer.cited) == ("answered", 2) and answer.answer.startswith("[1] a.go:1-3 (Load)")
    assert e.ask(q.withColumn("q", F.lit("nothing")), mode="lexical").first().reason == "no_spans"
    precise, approximate = e.callers("r1", "s1", 2)
    assert [(r.id, r.depth) for r in precise.collect()] == [("s2", 1)] and [r.edge_id for r in approximate.collect()] == ["e2"]
    assert [r.id for r in e.find_symbols("r1", "Load").collect()] == ["s1"]
    urls = spark.sql(f"SELECT * FROM VALUES ('j1', 'https://github.com/O/N', 'main', {t}), ('j2', 'https://github.com/o/n.git', 'main', {t} + INTERVAL 1 HOUR), ('j3', 'ftp://x', 'main', {t}) AS x(id, url, ref_name, created_at)")
    assert {r.id: (r.rule, r.job_id) for r in e.submit(urls, ["github.com"]).collect()} == {"j1": (None, "j1"), "j2": (None, "j1"), "j3": ("scheme", None)}
