"""Retrieval queries.

The corpus is all documents (a span each, with the vector of the same number where there is one), or all vectors by
label; the questions are all evaluation passages, each with the vector of its place in the order of ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators import retrieval as R
from millrace.session import cut
from millrace.sources.tables import table

DEPTH, LIMIT, FLOOR = 40, 10, 0.25


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """``tenant, id, path, symbol, start_line, end_line, text, embedding`` of every document with text."""
    d = table(spark, sf, "documents").where("text IS NOT NULL").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("source").alias("source"), F.min("doc_kind").alias("doc_kind"))
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return d.join(e, "doc_id", "left").select(F.lit("all").alias("tenant"), F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("path"), F.col("doc_kind").alias("symbol"), F.lit(1).alias("start_line"), lines.cast("int").alias("end_line"), "text", "embedding")


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """``query_id, tenant, q, embedding``; the number of questions is fixed."""
    i = table(spark, sf, "eval_items").groupBy("item_id").agg(F.max("passage").alias("q"))
    place = i.withColumn("vec_id", (F.row_number().over(Window.orderBy("item_id")) - 1).cast("long"))
    return place.join(table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id", "left").select(F.col("item_id").alias("query_id"), F.lit("all").alias("tenant"), "q", "embedding")


def _vector(spark: SparkSession, sf: str, limit: int = DEPTH) -> DataFrame:
    return R.vector_topk(corpus(spark, sf), questions(spark, sf), limit)


def _index(spark: SparkSession, sf: str) -> DataFrame:
    return R.postings(corpus(spark, sf), ["tenant", "id", "path", "start_line"], "symbol", "text")


def _lexical(spark: SparkSession, sf: str, limit: int = DEPTH) -> DataFrame:
    return R.lexical_scan(corpus(spark, sf), R.question_terms(questions(spark, sf)), limit)


def _hybrid(spark: SparkSession, sf: str, fusion: R.Fusion = R.Fusion(), limit: int = LIMIT) -> DataFrame:
    return R.fuse(_vector(spark, sf), _lexical(spark, sf), corpus(spark, sf).select("id", "path", "start_line"), fusion, limit)


def postings_tf(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf).groupBy("term", "weight").agg(F.sum("tf").alias("occurrences"), F.count(F.lit(1)).alias("spans"))


def vector_topk_batch(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest of its own label for every vector whose number is divisible by 20."""
    e = table(spark, sf, "embeddings").select(F.col("label").alias("tenant"), F.col("vec_id").alias("id"), F.lit("").alias("path"), F.lit(1).alias("start_line"), "embedding")
    asked = e.where("id % 20 = 0").select(F.col("id").alias("query_id"), "tenant", "embedding")
    return R.vector_topk(e, asked, LIMIT).withColumn("similarity", F.round("similarity", 5))


def vector_topk_questions(spark: SparkSession, sf: str) -> DataFrame:
    return _vector(spark, sf, LIMIT).withColumn("similarity", F.round("similarity", 5))


def lexical_topk_batch(spark: SparkSession, sf: str) -> DataFrame:
    return _lexical(spark, sf, LIMIT)


def rrf_hybrid_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _hybrid(spark, sf).select("query_id", "rank", "id", F.round("score", 9).alias("score"))


def rrf_weighted_sweep(spark: SparkSession, sf: str) -> DataFrame:
    out, vector, lexical, places = None, cut(_vector(spark, sf)), cut(_lexical(spark, sf)), corpus(spark, sf).select("id", "path", "start_line")
    for i, f in enumerate((R.Fusion(60, 1, 1), R.Fusion(60, 2, 1), R.Fusion(60, 1, 2), R.Fusion(60, 0, 1), R.Fusion(10, 1, 1))):
        one = R.fuse(vector, lexical, places, f, LIMIT).select(F.lit(i).alias("setting"), "query_id", "rank", "id", F.round("score", 9).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


def arm_rank_audit(spark: SparkSession, sf: str) -> DataFrame:
    return _hybrid(spark, sf).select("query_id", "rank", "id", "vector_rank", "lexical_rank", F.round("vector_score", 5).alias("vector_score"))


def decide_floor(spark: SparkSession, sf: str) -> DataFrame:
    top = _vector(spark, sf, 1).select("query_id", F.col("similarity").alias("top_score"))
    asked = questions(spark, sf).select("query_id", F.col("embedding").isNotNull().alias("vector_ran"))
    hits = _lexical(spark, sf).groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    summary = asked.join(top, "query_id", "left").join(hits, "query_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return R.decide(summary, FLOOR).select("query_id", "hits", F.round("top_score", 5).alias("top_score"), "outcome", "reason")


def assemble_budget(spark: SparkSession, sf: str) -> DataFrame:
    spans = corpus(spark, sf).select("id", "path", "symbol", "start_line", "end_line", "text")
    return R.assemble(_lexical(spark, sf, LIMIT), spans, R.Budget()).select("query_id", F.md5(F.col("answer").cast("binary")).alias("answer_md5"), "cited", "dropped")


_Q = (postings_tf, vector_topk_batch, vector_topk_questions, lexical_topk_batch, rrf_hybrid_topk, rrf_weighted_sweep, arm_rank_audit, decide_floor, assemble_budget)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _Q}

_CORPUS = """
    d AS (SELECT doc_id AS id, min(text) AS text, coalesce(min(source), '') AS path, min(doc_kind) AS symbol FROM documents WHERE text IS NOT NULL GROUP BY 1),
    q AS (SELECT item_id AS query_id, passage AS q, row_number() OVER (ORDER BY item_id) - 1 AS vec_id FROM (SELECT item_id, max(passage) AS passage FROM eval_items GROUP BY 1)),
    cv AS (SELECT d.id, d.path, e.embedding::DOUBLE[] AS v FROM d JOIN embeddings e ON e.vec_id = d.id),
    qv AS (SELECT q.query_id, e.embedding::DOUBLE[] AS v FROM q JOIN embeddings e ON e.vec_id = q.vec_id),
    vs AS (SELECT qv.query_id, cv.id, cv.path, list_cosine_similarity(qv.v, cv.v) AS s FROM qv, cv),
    vec AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY 1 - s, path, id) AS rank, s::FLOAT::DOUBLE AS similarity FROM vs)"""
_LEX = r"""
    pt AS (SELECT id, path, lower(unnest(regexp_extract_all(symbol, '[\p{L}\p{Nd}]+'))) AS term, 10 AS w FROM d WHERE symbol IS NOT NULL
           UNION ALL SELECT id, path, lower(unnest(regexp_extract_all(text, '[\p{L}\p{Nd}]+'))), 4 FROM d),
    po AS (SELECT id, path, term, w, count(*) AS tf FROM pt GROUP BY ALL),
    qt AS (SELECT query_id, list_transform(flatten(list_transform(regexp_extract_all(q, '[\p{L}\p{Nd}]+'), lambda w: list_concat([w], string_split(regexp_replace(regexp_replace(w, '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g'), '([^\p{Lu} ])(\p{Lu})', '\1 \2', 'g'), ' ')))), lambda x: lower(x)) AS t FROM q WHERE q IS NOT NULL),
    tm AS (SELECT query_id, unnest(list_transform(list_sort(list_transform(list_distinct(t), lambda x: struct_pack(p := list_position(t, x), x := x)))[1:32], lambda y: y.x)) AS term FROM qt),
    ls AS (SELECT query_id, id, path, sum(w * tf)::BIGINT AS s FROM po JOIN tm USING (term) GROUP BY ALL),
    lex AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, path, id) AS rank, s / 10 AS score FROM ls)"""


def _fused(k: int, wv: int, wl: int) -> str:
    return f"""(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, id) AS rank FROM (
        SELECT coalesce(v.query_id, l.query_id) AS query_id, coalesce(v.id, l.id) AS id,
               CASE WHEN v.rank IS NULL THEN 0 ELSE {wv}::DOUBLE / ({k}::DOUBLE + v.rank) END + CASE WHEN l.rank IS NULL THEN 0 ELSE {wl}::DOUBLE / ({k}::DOUBLE + l.rank) END AS score,
               coalesce(v.rank, 0)::INTEGER AS vector_rank, coalesce(l.rank, 0)::INTEGER AS lexical_rank, v.similarity AS vector_score
        FROM (SELECT * FROM vec WHERE rank <= 40) v FULL JOIN (SELECT * FROM lex WHERE rank <= 40) l ON v.query_id = l.query_id AND v.id = l.id) f JOIN (SELECT id, path FROM d) USING (id))"""


SQL: dict[str, str] = {
    "postings_tf": f"WITH {_CORPUS}, {_LEX} SELECT term, w / 10 AS weight, sum(tf)::BIGINT AS occurrences, count(*) AS spans FROM po GROUP BY term, w",
    "vector_topk_batch": """
        WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS s FROM embeddings q JOIN embeddings c ON c.label = q.label WHERE q.vec_id % 20 = 0)
        SELECT query_id, rank::INTEGER AS rank, id, round(s::FLOAT::DOUBLE, 5) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY 1 - s, id) AS rank FROM s) WHERE rank <= 10
    """,
    "vector_topk_questions": f"WITH {_CORPUS} SELECT query_id, rank::INTEGER AS rank, id, round(similarity, 5) AS similarity FROM vec WHERE rank <= 10",
    "lexical_topk_batch": f"WITH {_CORPUS}, {_LEX} SELECT query_id, rank::INTEGER AS rank, id, score FROM lex WHERE rank <= 10",
    "rrf_hybrid_topk": f"WITH {_CORPUS}, {_LEX} SELECT query_id, rank::INTEGER AS rank, id, round(score, 9) AS score FROM {_fused(60, 1, 1)} WHERE rank <= 10",
    "rrf_weighted_sweep": f"WITH {_CORPUS}, {_LEX} "
    + " UNION ALL ".join(f"SELECT {i} AS setting, query_id, rank::INTEGER AS rank, id, round(score, 9) AS score FROM {_fused(*x)} WHERE rank <= 10" for i, x in enumerate(((60, 1, 1), (60, 2, 1), (60, 1, 2), (60, 0, 1), (10, 1, 1)))),
    "arm_rank_audit": f"WITH {_CORPUS}, {_LEX} SELECT query_id, rank::INTEGER AS rank, id, vector_rank, lexical_rank, round(vector_score, 5) AS vector_score FROM {_fused(60, 1, 1)} WHERE rank <= 10",
    "decide_floor": f"""
        WITH {_CORPUS}, {_LEX}, x AS (SELECT q.query_id, (SELECT count(*) FROM lex WHERE lex.query_id = q.query_id AND rank <= 40) AS hits, (SELECT max(similarity) FROM vec WHERE vec.query_id = q.query_id AND rank = 1) AS top,
            q.query_id IN (SELECT query_id FROM qv) AS ran FROM q),
        y AS (SELECT *, CASE WHEN hits = 0 THEN 'no_spans' WHEN NOT ran THEN NULL WHEN top IS NULL OR isnan(top) THEN 'unscored' WHEN top < {FLOOR} THEN 'below_floor' END AS reason FROM x)
        SELECT query_id, hits, round(top, 5) AS top_score, CASE WHEN reason IS NULL THEN 'answered' ELSE 'refused' END AS outcome, reason FROM y
    """,
    "assemble_budget": f"""
        WITH {_CORPUS}, {_LEX},
        b AS (SELECT l.query_id, l.rank AS n, d.text, '[' || l.rank || '] ' || d.path || ':1-' || (length(d.text) - length(replace(d.text, chr(10), '')) + 1) || CASE WHEN coalesce(d.symbol, '') <> '' THEN ' (' || d.symbol || ')' ELSE '' END || chr(10) || d.text AS block,
                     sum(strlen(d.text)) OVER (PARTITION BY l.query_id ORDER BY l.rank) AS total FROM lex l JOIN d ON d.id = l.id WHERE l.rank <= 10),
        c AS (SELECT *, max(CASE WHEN n > 1 AND (n > 5 OR total > 8000) THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY n) AS over FROM b)
        SELECT query_id, md5(coalesce(string_agg(block, chr(10) || chr(10) ORDER BY n) FILTER (over = 0), '')) AS answer_md5, count(*) FILTER (over = 0) AS cited, count(*) FILTER (over = 1) AS dropped FROM c GROUP BY 1
    """,
}
