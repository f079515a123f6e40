"""Queries on identities, lines, terms, languages and windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import cite, ids, text, udfs
from millrace.operators import chunking
from millrace.operators.history import remote_key
from millrace.sources.tables import table

#: Hosts of the test data in the shape of known forges.
FORGES = {"code.example": "/blob/", "forge.example": "/src/commit/"}
NOW = "2026-01-01 00:00:00"


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "spans").drop("embedding").distinct()


def ids_repo_file_span(spark: SparkSession, sf: str) -> DataFrame:
    s = _spans(spark, sf).where("text IS NOT NULL")
    digest = ids.text_digest(F.col("text"))
    return s.select("id", ids.repo_id(F.col("repo_id"), F.lit("main"), F.col("file_id")).alias("repo"), ids.file_id(F.col("repo_id"), F.col("path")).alias("file"), digest.alias("text_digest"), ids.span_id(F.col("repo_id"), F.col("path"), F.col("start_line"), F.col("end_line"), digest).alias("span"), (digest == F.col("digest")).alias("digest_holds"))


def blob_hash_git(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text IS NOT NULL").distinct().select("doc_id", ids.git_blob(F.col("text")).alias("blob"), text.line_count(F.col("text")).alias("n_lines"), F.octet_length("text").cast("int").alias("bytes"))


def lang_and_indexable(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "files").select("path", "lang").distinct()
    s = _spans(spark, sf).where("text IS NOT NULL").groupBy("path").agg(F.count_if(text.has_tokens(F.col("text"))).alias("kept"), F.count_if(~text.has_tokens(F.col("text"))).alias("dropped"), F.count_if(text.indexable(F.col("path"), F.col("text"))).alias("indexable"))
    return f.groupBy("path").agg(F.count("lang").alias("rows_with_lang")).withColumn("language", text.language_of(F.col("path"))).join(s, "path", "left")


def terms_plain(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "cases").where("question IS NOT NULL").select("id", "question").distinct().select("id", F.array_join(text.terms(F.col("question"), False), " ").alias("terms"))


def terms_camel(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "cases").where("symbol IS NOT NULL").select("id", "symbol").distinct().select("id", F.array_join(text.terms(F.col("symbol"), True), " ").alias("terms"))


def symbol_names(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("symbol")
    return _spans(spark, sf).where("symbol IS NOT NULL").select("symbol").distinct().select("symbol", text.last_segment(s).alias("name"), text.exported(s).alias("exported"), text.slug(F.concat(F.lit("https://code.example/x/"), s)).alias("slug"))


def normalised_questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "cases").where("question IS NOT NULL").select("id", "question").distinct().select("id", text.normalised(F.col("question")).alias("phrase"), text.token_estimate(F.col("question")).alias("tokens"), text.line_count(F.col("question")).alias("n_lines"))


def _windows(spark: SparkSession, sf: str, width: int, overlap: int) -> DataFrame:
    docs = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", "text").distinct()
    return chunking.windows(docs, ["doc_id"], "text", width, overlap).select("doc_id", "start_line", "end_line", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def chunk_windows_40_10(spark: SparkSession, sf: str) -> DataFrame:
    return _windows(spark, sf, 40, 10)


def chunk_windows_10_3(spark: SparkSession, sf: str) -> DataFrame:
    return _windows(spark, sf, 10, 3)


def chunk_declarations(spark: SparkSession, sf: str) -> DataFrame:
    """Declarations of the Go sources, long ones and other sources in windows; texts are whole spans."""
    s = _spans(spark, sf).where("text IS NOT NULL").select("id", "path", "text")
    return chunking.declaration_chunks(s, "id").select("id", "kind", "symbol", "start_line", "end_line")


def golden_cases(spark: SparkSession, sf: str) -> DataFrame:
    s = _spans(spark, sf).where("text IS NOT NULL").select("id", "path", "text")
    return chunking.golden_cases(s, "id")


def go_calls(spark: SparkSession, sf: str) -> DataFrame:
    s = _spans(spark, sf).where("text IS NOT NULL").select("id", "path", "text")
    return chunking.go_calls(s, "id")


def stripped_docs(spark: SparkSession, sf: str) -> DataFrame:
    s = _spans(spark, sf).where("text IS NOT NULL").select("id", "path", "text")
    return chunking.strip_doc_comments(s, "id").select("id", F.md5(F.col("text").cast("binary")).alias("text_md5"), text.line_count(F.col("text")).alias("n_lines"))


def hashed_bow_embed(spark: SparkSession, sf: str) -> DataFrame:
    return _spans(spark, sf).where("text IS NOT NULL").select("id", udfs.hashed_bow(48)("text").alias("embedding"))


def citation_markers(spark: SparkSession, sf: str) -> DataFrame:
    """Marks and repeat keys in texts as they are, of every document."""
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", "text").distinct().select("doc_id", udfs.cited_markers("text").alias("markers"), F.md5(udfs.canonical_json("text").cast("binary")).alias("key_md5"))


def permalinks(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "repos").where("remote IS NOT NULL AND commit_sha IS NOT NULL").select(F.col("id").alias("repo_id"), remote_key(F.col("remote")).alias("key"), F.lower("commit_sha").alias("commit_sha")).groupBy("repo_id").agg(F.min("key").alias("key"), F.max("commit_sha").alias("commit_sha"))
    s = _spans(spark, sf).select("id", "repo_id", "path", "start_line", "end_line")
    parts = F.split("key", "/")
    return s.join(r, "repo_id").select("id", cite.permalink(parts[0], parts[1], parts[2], F.col("commit_sha"), F.col("path"), F.col("start_line"), F.col("end_line"), FORGES).alias("url"), cite.short_commit(F.col("commit_sha")).alias("short"))


def repo_age(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "repos").groupBy("id").agg(F.max("indexed_at").alias("indexed_at"), F.max("last_queried_at").alias("last_queried_at"))
    now = F.lit(NOW).cast("timestamp")
    return r.select("id", cite.age_phrase(F.col("indexed_at"), now).alias("age"), cite.age_phrase(F.col("last_queried_at"), now).alias("used"))


def retry_schedule(spark: SparkSession, sf: str) -> DataFrame:
    """Delays before another attempt, and poll intervals by seconds waited, for every order as a job."""
    from millrace.operators import queue

    o = table(spark, sf, "orders")
    attempts = (F.col("o_orderkey") % 20).cast("int")
    waited = (F.col("o_totalprice") / 1000).cast("double")
    return o.select("o_orderkey", queue.retry_delay(attempts).alias("delay_s"), queue.poll_interval(waited).alias("poll_s"))


_Q = (ids_repo_file_span, blob_hash_git, lang_and_indexable, terms_plain, terms_camel, symbol_names, normalised_questions, chunk_windows_40_10, chunk_windows_10_3, chunk_declarations, golden_cases, go_calls, stripped_docs, hashed_bow_embed, citation_markers, permalinks, repo_age, retry_schedule)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _Q}

_S = "(SELECT DISTINCT id, repo_id, file_id, path, kind, symbol, start_line, end_line, text, digest, embed_model, embed_dim FROM spans)"


def _sql_windows(width: int, overlap: int) -> str:
    return f"""
        WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '[^ \\t\\n\\r\\f\\x0b]')),
        l AS (SELECT doc_id, string_split(CASE WHEN suffix(text, chr(10)) THEN text[:-2] ELSE text END, chr(10)) AS lines FROM d),
        w AS (SELECT doc_id, lines, unnest(generate_series(1, greatest(1, len(lines) - {overlap}), {width - overlap})) AS s FROM l)
        SELECT doc_id, s::INTEGER AS start_line, least(s + {width} - 1, len(lines))::INTEGER AS end_line,
               md5(array_to_string(lines[s:least(s + {width} - 1, len(lines))], chr(10))) AS text_md5
        FROM w WHERE regexp_matches(array_to_string(lines[s:least(s + {width} - 1, len(lines))], chr(10)), '[\\p{{L}}\\p{{Nd}}]')
    """


_CAMEL = r"regexp_replace(regexp_replace(w, '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g'), '([^\p{Lu} ])(\p{Lu})', '\1 \2', 'g')"
_FIRST = "array_to_string(list_transform(list_sort(list_transform(list_distinct(t), lambda x: struct_pack(p := list_position(t, x), x := x)))[1:32], lambda y: y.x), ' ')"

SQL: dict[str, str] = {
    "ids_repo_file_span": f"""
        SELECT id, sha256(repo_id || chr(0) || 'main' || chr(0) || file_id || chr(0))[1:32] AS repo, sha256(repo_id || chr(0) || path || chr(0))[1:32] AS file, sha256(text) AS text_digest,
               sha256(repo_id || chr(0) || path || chr(0) || start_line::VARCHAR || chr(0) || end_line::VARCHAR || chr(0) || sha256(text) || chr(0))[1:32] AS span, sha256(text) = digest AS digest_holds
        FROM {_S} WHERE text IS NOT NULL
    """,
    "blob_hash_git": r"""
        SELECT doc_id, sha1('blob ' || strlen(text)::VARCHAR || chr(0) || text) AS blob,
               (length(text) - length(replace(text, chr(10), '')) + CASE WHEN text = '' OR suffix(text, chr(10)) THEN 0 ELSE 1 END)::INTEGER AS n_lines, strlen(text)::INTEGER AS bytes
        FROM (SELECT DISTINCT * FROM documents) WHERE text IS NOT NULL
    """,
    "lang_and_indexable": rf"""
        WITH f AS (SELECT path, count(lang) AS rows_with_lang FROM (SELECT DISTINCT path, lang FROM files) GROUP BY 1),
        g AS (SELECT *, CASE lower(regexp_extract(path, '\.[^./]+$')) {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in text.LANGUAGES.items())} ELSE '' END AS language FROM f),
        s AS (SELECT path, count(*) FILTER (regexp_matches(text, '[\p{{L}}\p{{Nd}}]')) AS kept, count(*) FILTER (NOT regexp_matches(text, '[\p{{L}}\p{{Nd}}]')) AS dropped, count(*) FILTER (position(chr(0) IN text) = 0) AS clean FROM {_S} WHERE text IS NOT NULL GROUP BY 1)
        SELECT g.path, rows_with_lang, language, kept, dropped, CASE WHEN language = '' THEN clean * 0 ELSE clean END AS indexable FROM g LEFT JOIN s ON s.path = g.path
    """,
    "terms_plain": rf"SELECT id, {_FIRST} AS terms FROM (SELECT id, list_transform(regexp_extract_all(question, '[\p{{L}}\p{{Nd}}]+'), lambda x: lower(x)) AS t FROM (SELECT DISTINCT id, question FROM cases WHERE question IS NOT NULL))",
    "terms_camel": rf"SELECT id, {_FIRST} AS terms FROM (SELECT id, list_transform(flatten(list_transform(regexp_extract_all(symbol, '[\p{{L}}\p{{Nd}}]+'), lambda w: list_concat([w], string_split({_CAMEL}, ' ')))), lambda x: lower(x)) AS t FROM (SELECT DISTINCT id, symbol FROM cases WHERE symbol IS NOT NULL))",
    "symbol_names": rf"""
        SELECT symbol, string_split(symbol, '.')[-1] AS name, len(list_filter(string_split(symbol, '.'), lambda s: NOT regexp_matches(s, '^\p{{Lu}}'))) = 0 AS exported,
               'x-' || regexp_replace(lower(symbol), '[^a-z0-9._-]', '-', 'g') AS slug
        FROM (SELECT DISTINCT symbol FROM {_S} WHERE symbol IS NOT NULL)
    """,
    "normalised_questions": r"""
        SELECT id, trim(regexp_replace(lower(question), '[^\p{L}\p{Nd}]+', ' ', 'g')) AS phrase, (strlen(question) // 4)::INTEGER AS tokens,
               (length(question) - length(replace(question, chr(10), '')) + CASE WHEN question = '' OR suffix(question, chr(10)) THEN 0 ELSE 1 END)::INTEGER AS n_lines
        FROM (SELECT DISTINCT id, question FROM cases WHERE question IS NOT NULL)
    """,
    "chunk_windows_40_10": _sql_windows(40, 10),
    "chunk_windows_10_3": _sql_windows(10, 3),
    "permalinks": rf"""
        WITH r AS (SELECT id AS repo_id, min(regexp_replace(regexp_replace(regexp_replace(lower(trim(remote)), '^[a-z+]+://', ''), '/+', '/', 'g'), '(\.git|/)+$', '')) AS key, max(lower(commit_sha)) AS c
                   FROM repos WHERE remote IS NOT NULL AND commit_sha IS NOT NULL GROUP BY 1)
        SELECT s.id, CASE split_part(key, '/', 1)
            WHEN 'code.example' THEN 'https://' || split_part(key, '/', 1) || '/' || split_part(key, '/', 2) || '/' || split_part(key, '/', 3) || '/blob/' || c || '/' || path || '#L' || start_line || '-L' || end_line
            WHEN 'forge.example' THEN 'https://' || split_part(key, '/', 1) || '/' || split_part(key, '/', 2) || '/' || split_part(key, '/', 3) || '/src/commit/' || c || '/' || path || '#L' || start_line || '-L' || end_line
            ELSE '' END AS url, left(c, 7) AS short
        FROM {_S} s JOIN r ON r.repo_id = s.repo_id
    """,
    "repo_age": """
        WITH r AS (SELECT id, max(indexed_at) AS i, max(last_queried_at) AS q FROM repos GROUP BY 1),
        a AS (SELECT id, (epoch_us(TIMESTAMPTZ '2026-01-01 00:00:00+00') - epoch_us(i)) / 1000000 AS si, (epoch_us(TIMESTAMPTZ '2026-01-01 00:00:00+00') - epoch_us(q)) / 1000000 AS sq FROM r)
        SELECT id, CASE WHEN si IS NULL THEN NULL WHEN si < 3600 THEN 'less than an hour' WHEN si < 86400 THEN floor(si / 3600)::INTEGER || ' hour' || CASE WHEN floor(si / 3600) = 1 THEN '' ELSE 's' END
                   ELSE floor(si / 86400)::INTEGER || ' day' || CASE WHEN floor(si / 86400) = 1 THEN '' ELSE 's' END END AS age,
                   CASE WHEN sq IS NULL THEN NULL WHEN sq < 3600 THEN 'less than an hour' WHEN sq < 86400 THEN floor(sq / 3600)::INTEGER || ' hour' || CASE WHEN floor(sq / 3600) = 1 THEN '' ELSE 's' END
                   ELSE floor(sq / 86400)::INTEGER || ' day' || CASE WHEN floor(sq / 86400) = 1 THEN '' ELSE 's' END END AS used FROM a
    """,
    "retry_schedule": """
        SELECT o_orderkey, least(30 * pow(2, least(greatest((o_orderkey % 20)::INTEGER - 1, 0), 16)), 600)::INTEGER AS delay_s,
               CASE WHEN o_totalprice < 15000 THEN 1 WHEN o_totalprice < 120000 THEN 2 WHEN o_totalprice < 600000 THEN 5 WHEN o_totalprice < 1800000 THEN 15 END::INTEGER AS poll_s
        FROM orders
    """,
}
