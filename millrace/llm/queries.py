"""Queries of the operators for training data, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import docpairs, leakage, neighbors, packing, quantiles, reading, splitting
from millrace.sources.tables import table


#: Lines that may stand between a comment and its function in ``p1_pairs``.
MAX_GAP = 2


def p1_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return docpairs.function_doc_pairs(table(spark, sf, "spans"), max_gap=MAX_GAP)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs whose comment ends on the line directly above the function."""
    return p1_pairs(spark, sf).where("gap = 0").select("span_id", "symbol").distinct()


def p1_listed(spark: SparkSession, sf: str) -> DataFrame:
    """How many of each repository's listed functions the pairs hold, of those whose listed question says something."""
    return docpairs.listed_pairs(p1_pairs(spark, sf), table(spark, sf, "spans"), table(spark, sf, "cases"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return neighbors.neighbor_pairs(p3_neighbors(spark, sf))


def p3_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    return neighbors.nearest_vectors(neighbors.usable_vectors(table(spark, sf, "spans"), table(spark, sf, "retrieval_configs")))


def p3_recall(spark: SparkSession, sf: str) -> DataFrame:
    usable = neighbors.usable_vectors(table(spark, sf, "spans"), table(spark, sf, "retrieval_configs"))
    return neighbors.exact_recall(usable, neighbors.nearest_vectors(usable))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_pieces(spark, sf).where("piece_no = 1").select("arm_name", "span_id").distinct()


def p4_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf, "spans"), table(spark, sf, "arm_configs"))


def p4_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Of each cut span and arm the lines covered, and the pieces that break a rule: too long, or sharing other than the overlap's lines with the piece before."""
    rules = table(spark, sf, "arm_configs").where("arm_name IS NOT NULL").groupBy("arm_name").agg(F.max("window_lines").alias("w"), F.max("window_overlap").alias("o"))
    before = F.lag("end_line").over(Window.partitionBy("arm_name", "span_id").orderBy("piece_no"))
    pieces = p4_pieces(spark, sf).withColumn("_before", before).join(F.broadcast(rules), "arm_name")
    wrong = (F.col("end_line") - F.col("start_line") + 1 > F.col("w")) | (F.col("_before").isNotNull() & (F.col("_before") - F.col("start_line") + 1 != F.col("o")))
    return pieces.groupBy("arm_name", "span_id").agg(F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line"), F.count_if(wrong).alias("wrong"))


def p5_certified(spark: SparkSession, sf: str) -> DataFrame:
    """For each group and day, and over all days (null): the number of values, and whether every measured rank error keeps the promise."""
    errors = F.greatest(*[f"{q}_rank_error" for q in quantiles.QUANTILES])
    return p5_percentiles(spark, sf).select("repo_id", "arm_name", F.unix_date("day").alias("day"), "n", (errors <= F.col("rank_error_bound")).alias("kept"))


def p5_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return quantiles.score_percentiles(table(spark, sf, "outcomes"))


def p6_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(packing.token_sizes(table(spark, sf, "documents")), table(spark, sf, "pack_sizes"))


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_report(p6_containers(spark, sf))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_leaks(spark, sf).select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaked_items(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_levels(spark, sf).where("level_no = 3").select("doc_id").distinct()


def p8_levels(spark: SparkSession, sf: str) -> DataFrame:
    return reading.reading_levels(table(spark, sf, "documents"), table(spark, sf, "level_labels"))


def p8_profile(spark: SparkSession, sf: str) -> DataFrame:
    """How many documents of each source stand at each level."""
    levels = p8_levels(spark, sf).groupBy("doc_id").agg(F.max("level_no").alias("level_no"), F.max("expected_level").alias("expected_level"))
    source = table(spark, sf, "documents").where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("source").alias("source"))
    return levels.join(source, "doc_id").groupBy("source", "level_no").agg(F.count(F.lit(1)).alias("documents"), F.avg("expected_level").alias("mean_expected_level"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_pairs, p1_listed, p3_found, p3_neighbors, p3_recall, p4_found, p4_pieces, p4_coverage, p5_percentiles, p5_certified, p6_containers, p6_report, p7_found, p7_leaks, p8_found, p8_levels, p8_profile)
}

SQL: dict[str, str] = {
    "p4_found": r"""
        SELECT DISTINCT a.arm_name, s.id AS span_id
        FROM (SELECT DISTINCT id, text FROM spans WHERE id IS NOT NULL AND text IS NOT NULL) s
        JOIN arm_configs a ON length(s.text) - length(replace(s.text, chr(10), '')) + CASE WHEN s.text = '' OR suffix(s.text, chr(10)) THEN 0 ELSE 1 END > a.max_decl_lines
    """,
    "p4_coverage": r"""
        WITH t AS (SELECT a.arm_name, s.id AS span_id, length(s.text) - length(replace(s.text, chr(10), '')) + CASE WHEN s.text = '' OR suffix(s.text, chr(10)) THEN 0 ELSE 1 END AS n, a.max_decl_lines AS m
                   FROM (SELECT DISTINCT id, text FROM spans WHERE id IS NOT NULL AND text IS NOT NULL) s CROSS JOIN arm_configs a)
        SELECT arm_name, span_id, 1::INTEGER AS first_line, max(n)::INTEGER AS last_line, 0 AS wrong FROM t WHERE n > m GROUP BY 1, 2
    """,
    "p5_certified": """
        WITH o AS (SELECT DISTINCT * FROM outcomes), v AS (SELECT repo_id, arm_name, datediff('day', DATE '1970-01-01', recorded_at::TIMESTAMP::DATE)::INTEGER AS day FROM o WHERE top_score BETWEEN -1 AND 1 AND NOT isnan(top_score) AND recorded_at IS NOT NULL)
        SELECT repo_id, arm_name, day, count(*) AS n, true AS kept FROM v GROUP BY 1, 2, 3 UNION ALL SELECT repo_id, arm_name, NULL, count(*), true FROM v GROUP BY 1, 2
    """,
}
