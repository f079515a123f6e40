import os

import pytest

from millrace.sources import sinks, tree
from millrace.sources.tables import only


def test_only_takes_exact_names(spark):
    from pyspark.sql import functions as F

    df = spark.range(1).select(F.lit("a").alias("X"), F.lit("b").alias("x"), F.lit("c").alias("x"))
    assert only(df, "x", "X").first() == ("b", "a") and only(df.limit(1), "X").columns == ["X"]


def test_walk(tmp_path):
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git/config").write_text("x")
    (tmp_path / "a").mkdir()
    (tmp_path / "a/b.go").write_text("package a\n")
    (tmp_path / "big.md").write_text("x" * 100)
    os.symlink(tmp_path / "a/b.go", tmp_path / "link.go")
    assert [os.path.basename(p) for p in tree.regular_files(str(tmp_path), 10, 50)] == ["b.go"]
    with pytest.raises(tree.TooManyFiles):
        tree.regular_files(str(tmp_path), 1, 500)
    with pytest.raises(ValueError):
        tree.regular_files(str(tmp_path), 0, 5)
    with pytest.raises(OSError):
        tree.read_regular(str(tmp_path / "link.go"), 500)
    with pytest.raises(OSError):
        tree.read_regular(str(tmp_path / "big.md"), 50)


def test_checkout(spark, tmp_path):
    (tmp_path / "a.go").write_bytes(b"package a\n\nvar x")
    (tmp_path / "bin.go").write_bytes(b"\xff\xfe")
    (tmp_path / "nul.go").write_bytes(b"a\0b")
    (tmp_path / "LICENSE").write_bytes(b"text\n")
    got = {r.path: r for r in tree.checkout(spark, str(tmp_path)).collect()}
    assert {p: r.indexable for p, r in got.items()} == {"a.go": True, "bin.go": False, "nul.go": False, "LICENSE": False}
    assert (got["a.go"].n_lines, got["a.go"].bytes, got["a.go"].lang) == (3, 16, "go") and got["bin.go"].text is None


def test_refs(spark):
    refs = spark.createDataFrame([("main", "a" * 40), ("main", "a" * 40), ("dev", "b" * 40), ("dev", "c" * 40), ("v1", "short")], "ref_name string, commit_sha string")
    assert tree.refs_to_commit(refs, "main") == "a" * 40
    for ref, error in (("dev", LookupError), ("none", LookupError), ("v1", ValueError)):
        with pytest.raises(error):
            tree.refs_to_commit(refs, ref)


def test_replace(spark, tmp_path):
    at = str(tmp_path / "t")
    df = lambda *rows: spark.createDataFrame(list(rows), "id string, repo_id string, n int")
    sinks.replace_repos(df(("1", "a", 1), ("2", "b", 2)), at, ["a", "b"])
    sinks.replace_repos(df(("3", "a", 3), ("3", "a", 4)), at, ["a"], order="n")
    read = lambda: sorted((r.id, r.repo_id, r.n) for r in spark.read.parquet(at).collect())
    assert read() == [("2", "b", 2), ("3", "a", 4)]
    sinks.replace_repos(df(), at, ["a"])
    assert read() == [("2", "b", 2)]
    with pytest.raises(ValueError):
        sinks.replace_repos(df(("9", "z", 1)), at, ["a"])


def test_report(tmp_path):
    out = sinks.write_report(str(tmp_path), "o-n", "mechanics", "bow", {"mrr": 0.5})
    assert out.read_text().startswith('{\n  "quality": "mechanics"') and out.parent.name == "bow"


def test_replace_graph_and_widths(spark, tmp_path):
    symbols = spark.createDataFrame([("a", "f"), ("a", "g")], "repo_id string, id string")
    edge = lambda *rows: spark.createDataFrame(list(rows), "repo_id string, id string, from_id string, to_id string, provenance string")
    at = str(tmp_path / "graph")
    sinks.replace_graph(symbols, edge(("a", "e1", "f", "g", "resolved"), ("a", "e2", "g", None, "syntactic")), at, ["a"])
    assert spark.read.parquet(f"{at}/edges").count() == 2 and spark.read.parquet(f"{at}/symbols").count() == 2
    with pytest.raises(ValueError, match="no caller"):
        sinks.replace_graph(symbols, edge(("a", "e3", "gone", None, "syntactic")), at, ["a"])
    with pytest.raises(Exception, match="disagree"):
        sinks.replace_graph(symbols, edge(("a", "e4", "f", None, "resolved")), at, ["a"])
    assert {r.id for r in spark.read.parquet(f"{at}/edges").collect()} == {"e1", "e2"}  # a refused write leaves the table as it was
    vectors = spark.createDataFrame([("a", "s", [1.0, 2.0])], "repo_id string, id string, embedding array<float>")
    with pytest.raises(ValueError, match="not 3 wide"):
        sinks.replace_repos(vectors, str(tmp_path / "v"), ["a"], dim=3)
