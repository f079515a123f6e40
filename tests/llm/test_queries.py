import glob
import os

import duckdb
import pytest

from millrace.llm.queries import QUERIES, SQL
from millrace.sources.tables import table

FOUND = {
    "p1_found": ["span_id", "symbol"],
    "p3_found": ["span_id_a", "span_id_b"],
    "p4_found": ["arm_name", "span_id"],
    "p7_found": ["doc_id", "item_id"],
    "p8_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    unknown = name == "p8_found" and not table(spark, sf, "level_labels").where("level_no = 3").count()  # a level no rater gave can't be learnt
    assert rows or unknown
    if name == "p8_levels":
        assert any(r.level_no is not None for r in rows)
    if name in FOUND:
        assert df.columns == FOUND[name]
        assert len(set(rows)) == len(rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = QUERIES[name](spark, sf)
    result = con.execute(SQL[name])
    order = [df.columns.index(d[0]) for d in result.description]
    assert sorted((tuple(r[i] for i in order) for r in df.collect()), key=str) == sorted(result.fetchall(), key=str)


def test_found_follows_the_full_result(spark, sf):
    leaks = {(r.doc_id, r.item_id) for r in QUERIES["p7_leaks"](spark, sf).collect()}
    assert leaks == {(r.doc_id, r.item_id) for r in QUERIES["p7_found"](spark, sf).collect()}
    hard = {r.doc_id for r in QUERIES["p8_levels"](spark, sf).collect() if r.level_no == 3}
    assert hard == {r.doc_id for r in QUERIES["p8_found"](spark, sf).collect()}
