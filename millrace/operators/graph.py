"""The call graph: building it, and who calls what.

Vertices: ``repo_id, id, path, name, pkg, start_line, end_line, span_id``. Edges: ``repo_id, id, from_id, to_id``
(null where the target is known by name only), ``to_name, provenance, path, line``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.ids import content_id
from millrace.operators.skew import hot_keys, salted_join
from millrace.session import cut

PROVENANCES = ("resolved", "syntactic")
MOST_DEPTH = 10
#: Setting of the rows a recursive query may have.
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"
#: Lines of a bucket in range joins.
BUCKET = 64


def check_edges(edges: DataFrame) -> DataFrame:
    """The edges; raises, on use, for one whose target doesn't agree with its provenance."""
    fine = F.col("provenance").isin(*PROVENANCES) & (F.col("to_id").isNotNull() == (F.col("provenance") == "resolved"))
    message = F.concat(F.lit("edge "), F.coalesce(F.col("id").cast("string"), F.lit("?")), F.lit(": target and provenance disagree"))
    return edges.withColumn("provenance", F.when(F.coalesce(fine, F.lit(False)), F.col("provenance")).otherwise(F.raise_error(message)))


def callers(edges: DataFrame, targets: DataFrame, depth: int) -> DataFrame:
    """``target, id, depth, call_path, call_line`` of everything that reaches a target over resolved edges.

    ``edges``: ``from_id, to_id, path, line`` (others may be there); ``targets``: ``target``. Breadth first, a level at a
    time over sets of nodes: paths are never enumerated. The depth is the shortest one, the call site the first by path
    and line among the calls into the level before. A target is its own caller only by calling itself directly.
    """
    if not 1 <= depth <= MOST_DEPTH:
        raise ValueError(f"depth is 1 to {MOST_DEPTH}")
    calls = edges.where(F.col("to_id").isNotNull()).select("from_id", F.col("to_id").alias("node"), F.col("path").alias("_p"), F.col("line").alias("_l"))
    hot = cut(hot_keys(calls, ["node"]))  # a callee with a share of all calls is cut by its callers
    frontier = targets.select("target", F.col("target").alias("node")).distinct()
    seen: DataFrame | None = None
    for level in range(1, depth + 1):
        site = F.min(F.struct("_p", "_l"))
        step = salted_join(calls, frontier, ["node"], F.col("from_id"), hot=hot).groupBy("target", F.col("from_id").alias("id")).agg(site.alias("_s"))
        if level > 1:
            step = step.where(F.col("id") != F.col("target")).join(seen.select("target", "id"), ["target", "id"], "left_anti")
        step = cut(step.select("target", "id", F.lit(level).alias("depth"), F.col("_s._p").alias("call_path"), F.col("_s._l").alias("call_line")))
        seen = step if seen is None else seen.unionByName(step)
        frontier = step.where(F.col("id") != F.col("target")).select("target", F.col("id").alias("node"))
    return seen


CALLERS_SQL = """
    WITH RECURSIVE walk(target, id, depth, call_path, call_line, trail) AS (
      SELECT t.target, e.from_id, 1, e.path, e.line, array(t.target, e.from_id) FROM {targets} t JOIN {edges} e ON e.to_id = t.target
      UNION ALL
      SELECT w.target, e.from_id, w.depth + 1, e.path, e.line, array_append(w.trail, e.from_id)
      FROM walk w JOIN {edges} e ON e.to_id = w.id WHERE w.depth < {depth} AND NOT array_contains(w.trail, e.from_id))
    SELECT target, id, min(depth) AS depth, min(struct(depth, call_path, call_line)) AS site FROM walk GROUP BY target, id
"""


def callers_recursive(edges: DataFrame, targets: DataFrame, depth: int) -> DataFrame:
    """:func:`callers` by a recursive query that enumerates paths; for small graphs and as a test of the other one.

    Spark refuses recursions of more than a million rows; the query is run here, without that limit.
    """
    if not 1 <= depth <= MOST_DEPTH:
        raise ValueError(f"depth is 1 to {MOST_DEPTH}")
    spark = edges.sparkSession
    edges.where(F.col("to_id").isNotNull()).select("from_id", "to_id", "path", "line").createOrReplaceTempView("_walk_edges")
    targets.select("target").distinct().createOrReplaceTempView("_walk_targets")
    most = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        found = cut(spark.sql(CALLERS_SQL.format(targets="_walk_targets", edges="_walk_edges", depth=int(depth))))
    finally:
        spark.conf.set(ROW_LIMIT, most)
    return found.select("target", "id", "depth", F.col("site.call_path").alias("call_path"), F.col("site.call_line").alias("call_line"))


def approximate_callers(edges: DataFrame, symbols: DataFrame, names: DataFrame, limit: int) -> DataFrame:
    """Callers known by name only, at most ``limit`` for each ``repo_id, name``: one row a call, never mixed with resolved ones."""
    met = edges.where(F.col("to_id").isNull()).join(names, (edges["to_name"] == names["name"]) & (edges["repo_id"] == names["repo_id"])).drop(names["repo_id"])
    met = met.select("repo_id", "name", F.col("id").alias("edge_id"), "from_id", F.col("path").alias("call_path"), F.col("line").alias("call_line"))
    who = symbols.select(F.col("id").alias("from_id"), F.col("path"), "start_line")
    order = Window.partitionBy("repo_id", "name").orderBy("path", "start_line", "from_id", "edge_id")
    return met.join(who, "from_id").withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit)


def definitions(symbols: DataFrame, name: str, by_suffix: bool = False, pkg: str | None = None, limit: int = 50) -> DataFrame:
    """Definitions of a name, or also of anything that ends in ``.name``; compared as text, never as a pattern."""
    if limit < 1:
        raise ValueError("the limit is at least 1")
    fits = F.col("name") == F.lit(name)
    if by_suffix:
        fits = fits | F.col("name").endswith("." + name)
    if pkg is not None:
        fits = fits & (F.col("pkg") == F.lit(pkg))
    return symbols.where(fits).orderBy("path", "start_line", "id").limit(limit)


def _buckets(start: Column, end: Column) -> Column:
    return F.sequence(F.floor(start / BUCKET), F.floor(end / BUCKET))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs whose line ranges meet: ``left`` has ``start_line, end_line``, ``right`` ``r_start, r_end``.

    An equi-join on the keys and a bucket of lines; a pair is reported in the first bucket both have, so once.
    """
    a = left.withColumn("_b", F.explode(_buckets(F.col("start_line"), F.col("end_line"))))
    b = right.withColumn("_b", F.explode(_buckets(F.col("r_start"), F.col("r_end"))))
    met = a.join(b, [*keys, "_b"]).where((F.col("start_line") <= F.col("r_end")) & (F.col("end_line") >= F.col("r_start")))
    return met.where(F.col("_b") == F.floor(F.greatest("start_line", "r_start") / BUCKET)).drop("_b")


def containing(points: DataFrame, ranges: DataFrame, keys: list[str], point_id: str) -> DataFrame:
    """``point_id, id`` of the most specific range around a line: greatest start, smallest end, smallest id.

    ``points``: ``keys, point_id, line``; ``ranges``: ``keys, id, r_start, r_end``.
    """
    met = overlapping(points.withColumns({"start_line": F.col("line"), "end_line": F.col("line")}), ranges, keys)
    best = F.min(F.struct((-F.col("r_start")).alias("a"), F.col("r_end").alias("b"), F.col("id").alias("id")))
    return met.groupBy(point_id).agg(best.alias("_b")).select(point_id, F.col("_b.id").alias("id"))


def first_overlapping(items: DataFrame, ranges: DataFrame, keys: list[str], item_id: str) -> DataFrame:
    """``item_id, id`` of the first range that meets an item's lines: earliest start, smallest end, smallest id."""
    met = overlapping(items, ranges, keys)
    best = F.min(F.struct(F.col("r_start").alias("a"), F.col("r_end").alias("b"), F.col("id").alias("id")))
    return met.groupBy(item_id).agg(best.alias("_b")).select(item_id, F.col("_b.id").alias("id"))


def span_for(items: DataFrame, ranges: DataFrame, keys: list[str], item_id: str) -> DataFrame:
    """The range around an item's first line, else the first that meets its lines."""
    met = overlapping(items, ranges, keys)
    inside = (F.col("r_start") <= F.col("start_line")) & (F.col("r_end") >= F.col("start_line"))
    around = F.min(F.when(inside, F.struct((-F.col("r_start")).alias("a"), F.col("r_end").alias("b"), F.col("id").alias("id"))))
    first = F.min(F.struct(F.col("r_start").alias("a"), F.col("r_end").alias("b"), F.col("id").alias("id")))
    return met.groupBy(item_id).agg(around.alias("_i"), first.alias("_f")).select(item_id, F.coalesce("_i.id", "_f.id").alias("id"))


def build(defs: DataFrame, calls: DataFrame, spans: DataFrame, resolutions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbols, edges) of parsed sources.

    ``defs``: ``repo_id, path, name, pkg, kind, start_line, end_line``; ``calls``: ``repo_id, path, offset, from_start, to_name, line``;
    ``spans``: ``repo_id, path, id, start_line, end_line``; ``resolutions``: ``repo_id, path, offset, target_path, target_line``.
    A call belongs to the definition that begins at ``from_start`` (the smallest symbol id of several); it is resolved if its
    offset has a target that lies in a definition, and known by name otherwise, each call for itself.
    """
    base = defs.withColumn("id", content_id(F.col("repo_id"), F.col("path"), F.col("name"), F.col("start_line")))
    ranges = spans.select("repo_id", "path", F.col("id"), F.col("start_line").alias("r_start"), F.col("end_line").alias("r_end"))
    own = span_for(base.select(F.col("id").alias("symbol"), "repo_id", "path", "start_line", "end_line"), ranges, ["repo_id", "path"], "symbol")
    symbols = base.join(own.withColumnRenamed("id", "span_id"), F.col("id") == F.col("symbol"), "left").drop("symbol")
    by_start = base.groupBy("repo_id", "path", F.col("start_line").alias("from_start")).agg(F.min("id").alias("from_id"))
    made = calls.join(by_start, ["repo_id", "path", "from_start"]).withColumn("id", content_id(F.col("repo_id"), F.col("path"), F.col("offset"), F.col("to_name")))
    bodies = base.select("repo_id", F.col("path"), "id", F.col("start_line").alias("r_start"), F.col("end_line").alias("r_end"))
    points = made.select("repo_id", "path", "offset", F.col("id").alias("edge")).join(resolutions, ["repo_id", "path", "offset"]).select("repo_id", F.col("target_path").alias("path"), F.col("target_line").alias("line"), "edge")
    hit = containing(points, bodies, ["repo_id", "path"], "edge").withColumnRenamed("id", "to_id")
    edges = made.join(hit, F.col("id") == F.col("edge"), "left").select(
        "repo_id", "id", "from_id", "to_id", "to_name", F.lit("calls").alias("kind"), F.when(F.col("to_id").isNull(), "syntactic").otherwise("resolved").alias("provenance"), "path", "line"
    )
    return symbols, edges
