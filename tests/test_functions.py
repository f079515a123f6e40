import hashlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.functions import cite, golang, ids, text, udfs
from millrace.functions.udfs import fnv1a

DOCS = """//go:build linux

// Package a is documented.
package a

// imports
import "fmt"

/* Block
comment. */
type (
	// T has a comment.
	T struct {
		// F is a field.
		F int // trailing
	}
)

// Walk walks.
//
//go:noinline
func (t *T[K]) Walk(f func(int) bool) interface{ Len() int } {
	// inside
	fmt.Println("// not a comment", f(1))
	go func() { t.F.Do() }()
	return nil
}
"""


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first().x


def test_ids(spark):
    assert one(spark, ids.content_id(F.col("a"), F.col("b")), a="ab", b="c") == hashlib.sha256(b"ab\0c\0").hexdigest()[:32]
    assert one(spark, ids.content_id(F.col("a"), F.col("b")), a="ab", b=7) == hashlib.sha256(b"ab\x007\0").hexdigest()[:32]
    assert one(spark, ids.git_blob(F.col("a")), a="hé\n") == hashlib.sha1(b"blob 4\0h\xc3\xa9\n").hexdigest()
    assert one(spark, ids.text_digest(F.col("a")), a="x") == hashlib.sha256(b"x").hexdigest()


@pytest.mark.parametrize(
    ("question", "split", "want"),
    [
        ("parseConfig", True, ["parseconfig", "parse", "config"]),
        ("HTTPServer", True, ["httpserver", "http", "server"]),
        ("v2", True, ["v2"]),
        ("parse_config", False, ["parse", "config"]),
        ("x.y", False, ["x", "y"]),
        ("where is parseConfig() defined? (a & b)", False, ["where", "is", "parseconfig", "defined", "a", "b"]),
        ("...", True, []),
    ],
)
def test_terms(spark, question, split, want):
    assert one(spark, text.terms(F.col("q"), split), q=question) == want


def test_terms_are_bounded(spark):
    got = one(spark, text.terms(F.col("q"), True), q=" ".join(f"wordOne{i}" for i in range(40)))
    assert len(got) == 32 and got[:2] == ["wordone0", "word"]


@pytest.mark.parametrize(("body", "n"), [("", 0), ("a", 1), ("a\n", 1), ("a\nb", 2), ("\n\n", 2)])
def test_line_count(spark, body, n):
    assert one(spark, text.line_count(F.col("t")), t=body) == n


def test_text(spark):
    assert one(spark, text.normalised(F.col("t")), t="  A-b, Cé! ") == "a b cé"
    assert one(spark, text.holds_phrase(F.col("t"), F.col("p")), t="a bc d", p="bc d") and not one(spark, text.holds_phrase(F.col("t"), F.col("p")), t="a bc d", p="c d")
    assert not one(spark, text.holds_phrase(F.col("t"), F.col("p")), t="a", p="")
    assert one(spark, text.lines_of(F.col("t")), t="a\r\nb\n") == ["a\r", "b"] and one(spark, text.lines_of(F.col("t")), t=" \n ") == []
    assert one(spark, text.language_of(F.col("t")), t="a/b.TSX") == "typescript" and one(spark, text.language_of(F.col("t")), t="Makefile") == ""
    assert one(spark, text.slug(F.col("t")), t="https://h/Own/na me.git") == "own-na-me"
    assert one(spark, text.exported(F.col("t")), t="Set.Walk") and not one(spark, text.exported(F.col("t")), t="Set.walk")
    assert one(spark, text.token_estimate(F.col("t")), t="éééé") == 2
    assert not one(spark, text.indexable(F.col("p"), F.col("t")), p="a.go", t="a\0b") and one(spark, text.indexable(F.col("p"), F.col("t")), p="a.go", t="ab")


def test_citations(spark):
    now = datetime(2025, 6, 1)
    for back, want in ((timedelta(minutes=-5), "less than an hour"), (timedelta(minutes=59), "less than an hour"), (timedelta(hours=1), "1 hour"), (timedelta(hours=23), "23 hours"), (timedelta(hours=24), "1 day"), (timedelta(days=40), "40 days")):
        assert one(spark, cite.age_phrase(F.col("a"), F.col("b")), a=now - back, b=now) == want
    link = cite.permalink(F.col("h"), F.lit("o"), F.lit("n"), F.lit("abc"), F.lit("d e/f#g$+.go"), F.lit(1), F.lit(9))
    assert one(spark, link, h="github.com") == "https://github.com/o/n/blob/abc/d%20e/f%23g$+.go#L1-L9"
    assert one(spark, link, h="codeberg.org") == "https://codeberg.org/o/n/src/commit/abc/d%20e/f%23g$+.go#L1-L9"
    assert one(spark, link, h="else.where") == ""
    state = cite.staleness(F.lit("0123456789"), F.lit("main"), F.col("a"), F.col("n"), F.col("b"))
    fresh = one(spark, state, a=now, b=now, n=None)
    assert (fresh.state, fresh.forge_checked) == ("unknown", False) and "0123456," in fresh.note
    assert one(spark, state, a=now, b=now, n="ffffffffff").state == "superseded"


def test_hashed_embedding(spark):
    assert fnv1a(b"") == 14695981039346656037 and fnv1a(b"a") == 0xAF63DC4C8601EC8C
    v = one(spark, udfs.hashed_bow(768)(F.col("t")), t="func (s *Store) PutSpans")
    assert [i for i, x in enumerate(v) if x] == [34, 423, 543, 654] and set(v) == {0.0, 0.5}
    assert one(spark, udfs.hashed_bow(8)(F.col("t")), t="...") is None


def test_markers_and_keys(spark):
    assert one(spark, udfs.cited_markers(F.col("t")), t="both agree [1][2], x[3] f()[4] it.[5] [6") == [1, 2, 5]
    assert one(spark, udfs.canonical_json(F.col("t")), t='{"b": 1.50, "a": [1e3, "x"]}') == '{"a":[1e3,"x"],"b":1.50}'
    assert one(spark, udfs.canonical_json(F.col("t")), t="{not json") == "{not json"


def test_go_declarations():
    got = [(k, s, a, b) for k, s, a, b, _, _ in golang.declarations(golang.Source(DOCS))]
    assert got == [("type", "T", 9, 17), ("func", "T.Walk", 19, 27)]


def test_go_calls():
    got = [(c, f, line) for c, f, line, _ in golang.calls(golang.Source(DOCS))]
    assert got == [("T.Walk", "Println", 24), ("T.Walk", "f", 24), ("T.Walk", "Do", 25)]


def test_go_without_docs():
    bare = golang.without_docs(DOCS)
    assert bare.count("\n") == DOCS.count("\n")
    for gone in ("Walk walks", "T has a comment", "F is a field", "Block"):
        assert gone not in bare
    for stays in ("//go:build linux", "//go:noinline", "// inside", "// trailing", '"// not a comment"'):
        assert stays in bare
    assert golang.without_docs("func a() {") is None and golang.without_docs("x := `") is None


def test_golden_cases(spark):
    from millrace.operators.chunking import golden_cases

    go = "package a\n\n// Both are limits.\nconst (\n\t// Low is the floor.\n\tLow = 1\n\t// high is not exported.\n\thigh = 2\n)\n\n// Walk walks.\n// Twice.\nfunc (t *T) Walk() {\n}\n\n// hidden\nfunc walk() {}\n"
    got = {(r.symbol, r.kind, r.doc_of, r.question, r.start_line, r.raw_start, r.end_line, r.grouped) for r in golden_cases(spark.createDataFrame([("1", "a.go", go)], "id string, path string, text string"), "id").collect()}
    assert got == {("Low", "const", "decl", "Both are limits.", 4, 3, 9, True), ("Low", "const", "spec", "Low is the floor.", 6, 5, 6, True), ("T.Walk", "func", "decl", "Walk walks. Twice.", 13, 11, 14, False)}


def test_config():
    from millrace import config

    env = {"A": " x ", "L": "a, ,b", "N": "7", "B": "True", "E": ",,"}
    assert config.text(env, "A") == "x" and config.items(env, "L") == ["a", "b"] and config.integer(env, "N", least=7) == 7 and config.boolean(env, "B") is True
    assert config.text(env, "Z", "d") == "d" and config.integer(env, "Z", 3) == 3 and config.boolean(env, "Z", False) is False
    for bad in (lambda: config.text(env, "Z"), lambda: config.items(env, "E"), lambda: config.integer(env, "A"), lambda: config.integer(env, "N", least=8), lambda: config.boolean(env, "N")):
        with pytest.raises(ValueError):
            bad()


def test_vectors_and_limits(spark):
    from millrace.operators import retrieval as R
    from millrace.session import TimedOut, bounded

    assert one(spark, R.vector_from_text(F.col("t")), t="[1,-0.5]") == [1.0, -0.5] and one(spark, R.vector_from_text(F.col("t")), t="x") is None
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", None)], "id string, embedding array<float>")
    assert R.check_width(df, 2).count() == 2
    with pytest.raises(Exception, match="not 3 wide: a"):
        R.check_width(df, 3).collect()
    assert R.clipped(df.orderBy("id"), 1)[1] is True and R.clipped(df, 2)[1] is False
    assert bounded(spark, 60, lambda: df.count()) == 2
    with pytest.raises(TimedOut):
        bounded(spark, 1, lambda: spark.range(10**12).selectExpr("sum(sqrt(id))").collect())
