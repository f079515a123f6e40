"""Graph queries.

Call graph of the star schema: an order is a symbol, each of its lines calls the order that has the part's number; returned
lines ("R") know their target by name only. Ranges: spans of a file, and cases as the items that lie in them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from millrace.operators import chunking, graph
from millrace.session import cut
from millrace.sources.tables import table


def symbols(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(F.lit("r").alias("repo_id"), F.col("o_orderkey").alias("id"), F.concat(F.lit("c"), "o_custkey").alias("path"), F.concat("o_orderpriority", F.lit("."), "o_orderkey").alias("name"), F.col("o_orderpriority").alias("pkg"), F.col("o_orderkey").cast("int").alias("start_line"))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    named = F.col("l_returnflag") == "R"
    return li.select(
        F.lit("r").alias("repo_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.col("l_orderkey").alias("from_id"), F.when(~named, F.col("l_partkey")).alias("to_id"),
        F.concat(F.lit("p"), "l_partkey").alias("to_name"), F.when(named, "syntactic").otherwise("resolved").alias("provenance"), F.concat(F.lit("s"), "l_suppkey").alias("path"), F.col("l_linenumber").alias("line"),
    )


def _targets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("target"))


def callers_bfs_depth3(spark: SparkSession, sf: str) -> DataFrame:
    return graph.callers(graph.check_edges(edges(spark, sf)), _targets(spark, sf), 3)


def callers_cte_depth3(spark: SparkSession, sf: str) -> DataFrame:
    return graph.callers_recursive(edges(spark, sf), _targets(spark, sf), 3)


def callers_with_symbols(spark: SparkSession, sf: str) -> DataFrame:
    found = graph.callers(edges(spark, sf), _targets(spark, sf), 2)
    return found.join(symbols(spark, sf), "id").select("target", "id", "depth", "name", F.col("path").alias("symbol_path"), "call_path", "call_line")


def callers_approximate(spark: SparkSession, sf: str) -> DataFrame:
    names = _targets(spark, sf).select(F.lit("r").alias("repo_id"), F.concat(F.lit("p"), "target").alias("name"))
    return graph.approximate_callers(edges(spark, sf), symbols(spark, sf), names, 5).select("name", "n", "from_id", "call_path", "call_line")


def definitions_exact(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    named = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("pkg"), F.col("c_mktsegment").alias("path"), F.lit(1).alias("start_line"))
    return graph.definitions(named, "Customer#000000017").select("id", "name", "path")


def definitions_suffix(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "spans").where("symbol IS NOT NULL").select("id", "path", "symbol", "start_line", "repo_id").distinct()
    return graph.definitions(s.select("id", "path", F.col("symbol").alias("name"), F.col("repo_id").alias("pkg"), "start_line"), "StoreSpan", by_suffix=True, limit=50).select("id", "name", "path", "start_line")


def _ranges(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "spans").where("start_line BETWEEN 1 AND end_line").select("repo_id", "path", "id", F.col("start_line").alias("r_start"), F.col("end_line").alias("r_end")).distinct()


def _cases(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "cases").where("raw_start BETWEEN 1 AND raw_end").select(F.concat_ws("|", "id", "raw_start", "raw_end").alias("case_id"), "repo_id", "path", F.col("raw_start").alias("start_line"), F.col("raw_end").alias("end_line")).distinct()


def most_specific_span(spark: SparkSession, sf: str) -> DataFrame:
    return graph.containing(_cases(spark, sf).withColumn("line", F.col("end_line")).drop("start_line", "end_line"), _ranges(spark, sf), ["repo_id", "path"], "case_id")


def first_overlapping_span(spark: SparkSession, sf: str) -> DataFrame:
    return graph.first_overlapping(_cases(spark, sf), _ranges(spark, sf), ["repo_id", "path"], "case_id")


def span_for(spark: SparkSession, sf: str) -> DataFrame:
    return graph.span_for(_cases(spark, sf), _ranges(spark, sf), ["repo_id", "path"], "case_id")


def source_units(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What :func:`graph.build` takes, of all Go spans; a call is resolved where its file defines the name."""
    s = table(spark, sf, "spans").where("text IS NOT NULL").select("id", "repo_id", "file_id", "path", "text").distinct()
    units = cut(chunking.go_units(s, "id"))  # parsed once for definitions and calls
    decl = units.where("callee IS NULL").join(s.select("id", "repo_id", "path"), "id")
    defs = decl.select("repo_id", F.concat("path", F.lit("#"), "id").alias("path"), F.col("symbol").alias("name"), F.lit("").alias("pkg"), F.lit("func").alias("kind"), "start_line", "end_line")
    made = units.where("callee IS NOT NULL").select("id", F.col("symbol").alias("caller"), "callee", "line", "offset")
    made = made.join(decl.select("id", "repo_id", "path", F.col("symbol").alias("caller"), F.col("start_line").alias("from_start")), ["id", "caller"])
    calls = made.select("repo_id", F.concat("path", F.lit("#"), "id").alias("path"), "offset", "from_start", F.col("callee").alias("to_name"), "line")
    first = defs.groupBy("repo_id", "path", F.substring_index("name", ".", -1).alias("to_name")).agg(F.min("start_line").alias("target_line"))
    targets = calls.join(first, ["repo_id", "path", "to_name"]).select("repo_id", "path", "offset", F.col("path").alias("target_path"), "target_line")
    spans = s.select("repo_id", F.concat("path", F.lit("#"), "id").alias("path"), "id", F.lit(1).alias("start_line"), (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("end_line"))
    return defs, calls, spans, targets


def source_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of the call graph of all Go spans."""
    return graph.build(*source_units(spark, sf))[1]


_Q = (callers_bfs_depth3, callers_cte_depth3, callers_with_symbols, callers_approximate, definitions_exact, definitions_suffix, most_specific_span, first_overlapping_span, span_for, source_graph)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _Q}

_CALLS = """
    e AS (SELECT l_orderkey AS from_id, l_partkey AS to_id, 's' || l_suppkey AS path, l_linenumber AS line FROM lineitem WHERE l_returnflag <> 'R'),
    t AS (SELECT p_partkey AS target FROM part WHERE p_partkey % 20 = 0),
    l1 AS (SELECT target, from_id AS id, min(struct_pack(p := path, l := line)) AS s FROM t JOIN e ON to_id = target GROUP BY ALL),
    l2 AS (SELECT l1.target, e.from_id AS id, min(struct_pack(p := path, l := line)) AS s FROM l1 JOIN e ON to_id = l1.id WHERE l1.id <> l1.target AND e.from_id <> l1.target
             AND NOT EXISTS (SELECT 1 FROM l1 x WHERE x.target = l1.target AND x.id = e.from_id) GROUP BY ALL),
    l3 AS (SELECT l2.target, e.from_id AS id, min(struct_pack(p := path, l := line)) AS s FROM l2 JOIN e ON to_id = l2.id WHERE e.from_id <> l2.target
             AND NOT EXISTS (SELECT 1 FROM l1 x WHERE x.target = l2.target AND x.id = e.from_id) AND NOT EXISTS (SELECT 1 FROM l2 x WHERE x.target = l2.target AND x.id = e.from_id) GROUP BY ALL)"""
_DEPTH3 = f"""
    WITH {_CALLS}
    SELECT target, id, 1 AS depth, s.p AS call_path, s.l AS call_line FROM l1 UNION ALL SELECT target, id, 2, s.p, s.l FROM l2 UNION ALL SELECT target, id, 3, s.p, s.l FROM l3
"""
_RANGED = """
    r AS (SELECT DISTINCT repo_id, path, id, start_line AS s, end_line AS e FROM spans WHERE start_line BETWEEN 1 AND end_line),
    c AS (SELECT DISTINCT concat_ws('|', id, raw_start, raw_end) AS case_id, repo_id, path, raw_start AS a, raw_end AS b FROM cases WHERE raw_start BETWEEN 1 AND raw_end)"""

SQL: dict[str, str] = {
    "callers_bfs_depth3": _DEPTH3,
    "callers_cte_depth3": _DEPTH3,
    "callers_with_symbols": f"""
        WITH {_CALLS}, f AS (SELECT target, id, 1 AS depth, s.p AS call_path, s.l AS call_line FROM l1 UNION ALL SELECT target, id, 2, s.p, s.l FROM l2)
        SELECT target, id, depth, o_orderpriority || '.' || o_orderkey AS name, 'c' || o_custkey AS symbol_path, call_path, call_line FROM f JOIN orders ON o_orderkey = id
    """,
    "callers_approximate": """
        SELECT name, n::INTEGER AS n, from_id, call_path, call_line FROM (
          SELECT 'p' || l_partkey AS name, l_orderkey AS from_id, 's' || l_suppkey AS call_path, l_linenumber AS call_line,
                 row_number() OVER (PARTITION BY l_partkey ORDER BY 'c' || o_custkey, o_orderkey, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS n
          FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' AND l_partkey IN (SELECT p_partkey FROM part WHERE p_partkey % 20 = 0)) WHERE n <= 5
    """,
    "definitions_exact": "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS path FROM customer WHERE c_name = 'Customer#000000017'",
    "definitions_suffix": "SELECT id, symbol AS name, path, start_line FROM (SELECT DISTINCT id, path, symbol, start_line, repo_id FROM spans WHERE symbol = 'StoreSpan' OR ends_with(symbol, '.StoreSpan')) ORDER BY path, start_line, id LIMIT 50",
    "most_specific_span": f"WITH {_RANGED} SELECT case_id, id FROM (SELECT case_id, r.id, row_number() OVER (PARTITION BY case_id ORDER BY s DESC, e, r.id) AS n FROM c JOIN r ON r.repo_id = c.repo_id AND r.path = c.path AND b BETWEEN s AND e) WHERE n = 1",
    "first_overlapping_span": f"WITH {_RANGED} SELECT case_id, id FROM (SELECT case_id, r.id, row_number() OVER (PARTITION BY case_id ORDER BY s, e, r.id) AS n FROM c JOIN r ON r.repo_id = c.repo_id AND r.path = c.path AND a <= e AND b >= s) WHERE n = 1",
    "span_for": f"""
        WITH {_RANGED}, m AS (SELECT case_id, r.id, s, e, a BETWEEN s AND e AS inside FROM c JOIN r ON r.repo_id = c.repo_id AND r.path = c.path AND a <= e AND b >= s)
        SELECT case_id, id FROM (SELECT case_id, id, row_number() OVER (PARTITION BY case_id ORDER BY inside DESC, CASE WHEN inside THEN -s ELSE s END, e, id) AS n FROM m) WHERE n = 1
    """,
}
