import base64

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.helpers import with_extra
from millrace.llm.packing import best_two_fit, pack, pack_report, token_sizes

PACKS = "pack_name string, capacity_tokens int"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=80))
def test_bins_hold(sizes):
    bins = best_two_fit(np.array(sizes, np.int64), 30)
    filled = np.bincount(bins, weights=sizes) if sizes else np.zeros(0)
    assert len(bins) == len(sizes) and (filled <= 30).all() and (filled > 0).all()
    assert len(filled) <= max(2 * -(-sum(sizes) // 30), 1) if sizes else True


def test_two_fill_the_gap_better_than_one():
    # Greedy takes 6, then 3 (gap 1); 2 and 2 fill the gap of 4 whole.
    bins = best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert bins[0] == bins[2] == bins[3] != bins[1]


def test_whole_documents(spark):
    rng = np.random.default_rng(1)
    sizes = [(i, int(x)) for i, x in enumerate(rng.integers(1, 700, 3000))] + [(9000, 5000), (9001, 512), (9002, 1024)]
    df = with_extra(spark.createDataFrame([*sizes, (9003, 0), (None, 5)], "doc_id long, n_tokens long"), "DOC_ID", "pack_name")
    packs = spark.createDataFrame([("s", 512), ("m", 2048), ("m", 2048), ("bad", 0), ("none", None), (None, 5)], PACKS)
    for group in (100, 10_000):
        out = pack(df, packs, group_items=group).cache()
        assert {r.pack_name for r in out.select("pack_name").distinct().collect()} == {"s", "m"}
        by = out.groupBy("pack_name", "doc_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("parts"), F.max("capacity_tokens").alias("c")).collect()
        want = dict(sizes)
        assert len(by) == 2 * len(want)
        assert all(r.t == want[r.doc_id] and r.parts == max(1, -(-r.t // r.c)) for r in by)
        report = {r.pack_name: r for r in pack_report(out).collect()}
        assert all(r.fullest <= r.capacity_tokens for r in report.values())
        assert report["s"].unused_share < 0.05 and report["m"].unused_share < 0.01
        out.unpersist()


def test_tokens(spark):
    docs = with_extra(spark.createDataFrame([(1, "hello world"), (1, "hello world"), (2, " \n\t"), (3, None), (None, "x"), (4, ""), (5, "a" * 100_000)], "doc_id long, text string"), "Text")
    got = {r.doc_id: r.n_tokens for r in token_sizes(docs).collect()}
    assert got[1] == 2 and set(got) == {1, 5}
    packs = spark.createDataFrame([("s", 512)], PACKS)
    assert pack(token_sizes(docs.limit(0)), packs).count() == 0
    assert pack(token_sizes(docs), packs.limit(0)).count() == 0


def test_every_text_of_an_id_is_packed(spark):
    docs = spark.createDataFrame([(1, "hello world"), (1, "hello world"), (1, "hello"), (1, "world hello"), (2, "hello")], "doc_id long, text string")
    sizes = token_sizes(docs)
    assert sorted((r.doc_id, r.n_tokens) for r in sizes.collect()) == [(1, 1), (1, 2), (1, 2), (2, 1)]
    for group in (1, 10_000):
        out = pack(sizes, spark.createDataFrame([("s", 2)], PACKS), group_items=group).collect()
        assert sorted((r.doc_id, r.part_no, r.n_tokens) for r in out) == [(1, 1, 1), (1, 1, 2), (1, 1, 2), (2, 1, 1)]
        assert len({(r.doc_id, r.text_key) for r in out}) == 4


def test_loose_bins_never_meet_in_one_task(spark, tmp_path, monkeypatch):
    from millrace.llm import packing

    own = packing._pack
    folder = str(tmp_path)

    def watched(keys, batch):
        with open(f"{folder}/{keys[0].as_py()}-{keys[2].as_py()}-{batch.num_rows}", "w"):
            return own(keys, batch)

    monkeypatch.setattr(packing, "_pack", watched)
    sizes = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(300).cast("long").alias("n_tokens"))
    out = packing.pack(sizes, spark.createDataFrame([("s", 512)], PACKS), group_items=100)
    assert out.count() == 20_000 and out.select("container_id").distinct().count() == 20_000
    rows = [int(p.name.rsplit("-", 1)[1]) for p in tmp_path.iterdir()]
    assert 100 < len(rows) and max(rows) <= 200


def test_vocabulary_is_a_parameter(spark, tmp_path):
    words = b"".join(base64.b64encode(bytes([b])) + b" %d\n" % b for b in range(256))
    (tmp_path / "bytes.tiktoken").write_bytes(words)
    docs = spark.createDataFrame([(1, "hello")], "doc_id long, text string")
    assert token_sizes(docs, str(tmp_path / "bytes.tiktoken")).first().n_tokens == 5
