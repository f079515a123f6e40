"""Queries on the history of repositories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import cite
from millrace.operators import admission, corpus, history
from millrace.sources.tables import table


def p2_history(spark: SparkSession, sf: str) -> DataFrame:
    return history.commit_history(table(spark, sf, "repos"), table(spark, sf, "staleness"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p2_history(spark, sf).select(
        "remote", "ref_name", "commit_sha", F.unix_micros("valid_from").alias("valid_from_us"), F.coalesce(F.unix_micros("valid_to"), F.lit(-1)).cast("long").alias("valid_to_us")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_found, p2_history)}

SQL: dict[str, str] = {
    "p2_found": r"""
        WITH log AS (
          SELECT DISTINCT id, regexp_replace(regexp_replace(regexp_replace(lower(trim(remote)), '^[a-z+]+://', ''), '/+', '/', 'g'), '(\.git|/)+$', '') AS remote,
                 ref_name, lower(commit_sha) AS c, indexed_at AS at_, seen_at AS seen, NOT coalesce(indexed_at > seen_at, false) AS holds FROM repos),
        checks AS (
          SELECT DISTINCT p.remote, p.ref_name, lower(s.newer_commit) AS c, s.newer_indexed_at AS at_, s.checked_at AS seen, true AS holds
          FROM staleness s JOIN (SELECT DISTINCT id, remote, ref_name FROM log) p ON p.id = s.repo_id
          WHERE s.newer_commit IS NOT NULL AND s.newer_indexed_at IS NOT NULL),
        said AS (SELECT remote, ref_name, c, at_, seen, holds FROM log WHERE c IS NOT NULL UNION ALL SELECT * FROM checks),
        fulls AS (SELECT DISTINCT remote, ref_name, c AS f FROM said WHERE length(c) = 40),
        meant AS (SELECT s.remote, s.ref_name, s.c, min(f.f) AS f FROM (SELECT DISTINCT remote, ref_name, c FROM said) s
                  JOIN fulls f ON f.remote = s.remote AND f.ref_name = s.ref_name AND starts_with(f.f, s.c)
                  GROUP BY ALL HAVING count(DISTINCT f.f) = 1),
        held AS (SELECT s.remote, s.ref_name, s.at_, arg_max(m.f, s.seen) AS f FROM said s JOIN meant m ON m.remote = s.remote AND m.ref_name = s.ref_name AND m.c = s.c
                 WHERE s.at_ IS NOT NULL AND s.holds GROUP BY ALL),
        turns AS (SELECT * FROM (SELECT *, lag(f) OVER (PARTITION BY remote, ref_name ORDER BY at_) AS before FROM held) WHERE before IS DISTINCT FROM f)
        SELECT remote, ref_name, f AS commit_sha, epoch_us(at_) AS valid_from_us,
               coalesce(epoch_us(lead(at_) OVER (PARTITION BY remote, ref_name ORDER BY at_)), -1) AS valid_to_us
        FROM turns
    """,
    "p2_history": r"""
        WITH log AS (
          SELECT DISTINCT id, regexp_replace(regexp_replace(regexp_replace(lower(trim(remote)), '^[a-z+]+://', ''), '/+', '/', 'g'), '(\.git|/)+$', '') AS remote,
                 ref_name, lower(commit_sha) AS c, indexed_at AS at_, seen_at AS seen, NOT coalesce(indexed_at > seen_at, false) AS holds FROM repos),
        checks AS (
          SELECT DISTINCT p.remote, p.ref_name, lower(s.newer_commit) AS c, s.newer_indexed_at AS at_, s.checked_at AS seen, true AS holds
          FROM staleness s JOIN (SELECT DISTINCT id, remote, ref_name FROM log) p ON p.id = s.repo_id
          WHERE s.newer_commit IS NOT NULL AND s.newer_indexed_at IS NOT NULL),
        said AS (SELECT remote, ref_name, c, at_, seen, holds FROM log WHERE c IS NOT NULL UNION ALL SELECT * FROM checks),
        fulls AS (SELECT DISTINCT remote, ref_name, c AS f FROM said WHERE length(c) = 40),
        meant AS (SELECT s.remote, s.ref_name, s.c, min(f.f) AS f FROM (SELECT DISTINCT remote, ref_name, c FROM said) s
                  JOIN fulls f ON f.remote = s.remote AND f.ref_name = s.ref_name AND starts_with(f.f, s.c)
                  GROUP BY ALL HAVING count(DISTINCT f.f) = 1),
        held AS (SELECT s.remote, s.ref_name, s.at_, arg_max(struct_pack(f := m.f, k := date_trunc('month', coalesce(s.seen, s.at_))::DATE), s.seen) AS x FROM said s JOIN meant m ON m.remote = s.remote AND m.ref_name = s.ref_name AND m.c = s.c
                 WHERE s.at_ IS NOT NULL AND s.holds GROUP BY ALL),
        turns AS (SELECT * FROM (SELECT *, x.f AS f, x.k AS k, lag(x.f) OVER (PARTITION BY remote, ref_name ORDER BY at_) AS before FROM held) WHERE before IS DISTINCT FROM f)
        SELECT remote, ref_name, f AS commit_sha, at_ AS valid_from, lead(at_) OVER (PARTITION BY remote, ref_name ORDER BY at_) AS valid_to, k AS known_in FROM turns
    """,
}


def latest(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each id of the log: what was seen last, with its remote in one spelling."""
    r = table(spark, sf, "repos").distinct()
    r = r.where("id IS NOT NULL").withColumn("remote_key", history.remote_key(F.col("remote"))).withColumn("commit_sha", F.lower("commit_sha"))
    out = corpus.last_by(r, ["id"], ["seen_at", "indexed_at", "commit_sha", "last_queried_at", "remote"])
    return out.withColumn("last_used", F.coalesce("last_queried_at", "indexed_at", "seen_at"))


def admission_rules(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "repos").select("remote", "ref_name", "commit_sha").distinct()
    return r.withColumn("a", admission.admitted(F.col("remote"), HOSTS)).select("remote", "ref_name", "commit_sha", "a.rule", "a.url", "a.key", admission.valid_ref(F.col("ref_name")).alias("ref_ok"), admission.valid_commit(F.col("commit_sha")).alias("commit_ok"))


def repo_stats(spark: SparkSession, sf: str) -> DataFrame:
    there = lambda c: F.when(F.col(c).isNotNull(), 1).alias(c)
    spans = table(spark, sf, "spans").select("id", "repo_id", "file_id", "kind", there("text"), there("embedding"))
    return corpus.repo_stats(table(spark, sf, "repos"), table(spark, sf, "files").select("id", "repo_id", "n_lines").distinct(), spans.distinct())


def embedder_guard(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "spans").where("embedding IS NOT NULL AND embed_model IS NOT NULL")
    found = s.groupBy("repo_id").agg(F.countDistinct("embed_model", "embed_dim").alias("embedders"), F.min("embed_model").alias("first_model"))
    return found.withColumn("state", F.when(F.col("embedders") > 1, "mixed").otherwise("one"))


def staleness_newer(spark: SparkSession, sf: str) -> DataFrame:
    r = latest(spark, sf).where("remote_key IS NOT NULL AND commit_sha IS NOT NULL AND indexed_at IS NOT NULL")
    found = corpus.newer_commits(r.select("id", "remote_key", "ref_name", "commit_sha", "indexed_at"))
    state = cite.staleness(F.col("commit_sha"), F.col("ref_name"), F.col("indexed_at"), F.col("newer_commit"), F.lit(NOW).cast("timestamp"))
    return found.join(r.select("id", "ref_name", "commit_sha", "indexed_at"), "id").select("id", "newer_commit", F.unix_micros("newer_at").alias("newer_at_us"), state["state"].alias("state"), state["note"].alias("note"))


def evict_keep_n(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.evicted(latest(spark, sf), KEEP).select("id", F.unix_micros("last_used").alias("last_used_us"))


def tombstones_trim(spark: SparkSession, sf: str) -> DataFrame:
    old = table(spark, sf, "staleness").where("repo_id IS NOT NULL").groupBy(F.col("repo_id").alias("id")).agg(F.max("checked_at").alias("evicted_at"))
    return corpus.tombstones(old, corpus.evicted(latest(spark, sf), KEEP), F.lit("2025-06-01 00:00:00").cast("timestamp"), 300).select("id", F.unix_micros("evicted_at").alias("evicted_at_us"))


def repo_gone(spark: SparkSession, sf: str) -> DataFrame:
    r = latest(spark, sf)
    gone = corpus.evicted(r, KEEP)
    return corpus.lookup(table(spark, sf, "staleness").where("repo_id IS NOT NULL"), corpus.kept(r, KEEP), gone)


def list_repos_lru(spark: SparkSession, sf: str) -> DataFrame:
    r = latest(spark, sf).orderBy(F.desc("last_used"), "id").limit(50)
    return r.select("id", "remote_key", "ref_name", F.unix_micros("last_used").alias("last_used_us"))


def upsert_merge(spark: SparkSession, sf: str) -> DataFrame:
    """The log up to March merged with the log from then on."""
    r = table(spark, sf, "repos").distinct().where("id IS NOT NULL").select("id", F.lower("commit_sha").alias("commit_sha"), "size_bytes", "file_count", "seen_at")
    cutoff = F.lit("2025-04-01 00:00:00").cast("timestamp")
    one = lambda df: corpus.last_by(df, ["id"], ["seen_at", "size_bytes", "file_count", "commit_sha"])
    out = corpus.merged(one(r.where(F.col("seen_at") < cutoff)), one(r.where(F.col("seen_at") >= cutoff)), "id", ["commit_sha"])
    return out.select("id", "commit_sha", "size_bytes", "file_count", F.unix_micros("seen_at").alias("seen_us"))


def empty_repos(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.without_spans(table(spark, sf, "repos").select("id").distinct(), table(spark, sf, "spans"))


def index_fast_path(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.fast_path(table(spark, sf, "repos"), table(spark, sf, "spans").drop("embedding").distinct(), "lodestar-text", 64)


def embedding_reuse_split(spark: SparkSession, sf: str) -> DataFrame:
    """For each repository: digests without a vector, and how many of them another span's vector serves."""
    s = table(spark, sf, "spans").where("digest IS NOT NULL")
    wanted = s.where("embedding IS NULL").select("repo_id", "digest").distinct()
    found = corpus.reusable(wanted, s, "lodestar-text", 64).select("digest", F.lit(1).alias("_have"))
    return wanted.join(found, "digest", "left").groupBy("repo_id").agg(F.count(F.lit(1)).alias("wanted"), F.count("_have").alias("reused"), F.count_if(F.col("_have").isNull()).alias("to_embed"))


def _previous(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.previous_repo(latest(spark, sf).where("remote_key IS NOT NULL AND indexed_at IS NOT NULL").select("id", "remote_key", "indexed_at"))


def previous_blobs(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "files").groupBy("repo_id", "path").agg(F.max("blob").alias("blob"))
    p = _previous(spark, sf).where("previous_id IS NOT NULL")
    return f.join(p, f["repo_id"] == p["previous_id"]).select(F.col("id").alias("repo_id"), "previous_id", "path", "blob")


def changed_files(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.changed_files(table(spark, sf, "files"), _previous(spark, sf))


def corpus_verify_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Where the files of a repository and those its spans name disagree."""
    left = table(spark, sf, "files").groupBy("repo_id", "path").agg(F.max("id").alias("blob"))
    right = table(spark, sf, "spans").groupBy("repo_id", "path").agg(F.max("file_id").alias("blob"))
    return corpus.first_disagreement(left, right, ["repo_id"])


def span_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The first page of a scan by id from the middle of the ids on."""
    s = table(spark, sf, "spans").select("id", "path", "start_line").distinct()
    return corpus.page(s, "id", "8", 200)


HOSTS = ["code.example", "forge.example"]
KEEP = 200
NOW = "2026-01-01 00:00:00"

_L = r"""
    l AS (SELECT id, x.* FROM (SELECT id, arg_max(struct_pack(remote := remote, ref_name := ref_name, commit_sha := lower(commit_sha), indexed_at := indexed_at, q := last_queried_at, seen_at := seen_at),
            struct_pack(a := seen_at, b := indexed_at, c := lower(commit_sha), d := last_queried_at, e := remote)) AS x FROM (SELECT DISTINCT * FROM repos WHERE id IS NOT NULL) GROUP BY 1)),
    latest AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(trim(remote)), '^[a-z+]+://', ''), '/+', '/', 'g'), '(\.git|/)+$', '') AS remote_key, coalesce(q, indexed_at, seen_at) AS last_used FROM l),
    kept AS (SELECT * FROM latest ORDER BY last_used DESC, id DESC LIMIT 200),
    gone AS (SELECT * FROM latest WHERE id NOT IN (SELECT id FROM kept)),
    prev AS (SELECT id, lag(id) OVER (PARTITION BY remote_key ORDER BY indexed_at, id) AS previous_id FROM latest WHERE remote_key IS NOT NULL AND indexed_at IS NOT NULL)"""

_AGE = "CASE WHEN sec < 3600 THEN 'less than an hour' WHEN sec < 86400 THEN floor(sec / 3600)::INTEGER || ' hour' || CASE WHEN floor(sec / 3600) = 1 THEN '' ELSE 's' END ELSE floor(sec / 86400)::INTEGER || ' day' || CASE WHEN floor(sec / 86400) = 1 THEN '' ELSE 's' END END"

QUERIES |= {
    f.__name__: f
    for f in (
        admission_rules, repo_stats, embedder_guard, staleness_newer, evict_keep_n, tombstones_trim, repo_gone, list_repos_lru, upsert_merge,
        empty_repos, index_fast_path, embedding_reuse_split, previous_blobs, changed_files, corpus_verify_diff, span_scan,
    )
}

SQL |= {
    "admission_rules": r"""
        WITH r AS (SELECT DISTINCT remote, ref_name, commit_sha, trim(coalesce(remote, '')) AS raw FROM repos),
        p AS (SELECT *, lower(regexp_extract(raw, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, regexp_extract(raw, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS auth,
                regexp_replace(regexp_extract(raw, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g') AS path FROM r),
        o AS (SELECT *, lower(auth) AS host, regexp_extract(path, '^([^/]+)/[^/]+$', 1) AS owner, regexp_replace(regexp_extract(path, '^[^/]+/([^/]+)$', 1), '(\.git)+$', '') AS name FROM p),
        z AS (SELECT *, CASE WHEN raw = '' THEN 'form' WHEN scheme <> 'https' THEN 'scheme' WHEN contains(auth, '@') OR regexp_matches(auth, ':\d+$') THEN 'form' WHEN host NOT IN ('code.example', 'forge.example') THEN 'host'
                WHEN owner = '' OR name = '' OR NOT regexp_matches(owner, '^[A-Za-z0-9._-]+$') OR NOT regexp_matches(name, '^[A-Za-z0-9._-]+$') THEN 'form' END AS rule FROM o)
        SELECT remote, ref_name, commit_sha, rule, CASE WHEN rule IS NULL THEN 'https://' || host || '/' || owner || '/' || name END AS url, CASE WHEN rule IS NULL THEN host || '/' || lower(owner) || '/' || lower(name) END AS key,
               coalesce(ref_name <> '.' AND strlen(ref_name) <= 255 AND NOT starts_with(ref_name, '-') AND NOT contains(ref_name, '..') AND regexp_matches(ref_name, '^[A-Za-z0-9._/-]+$'), false) AS ref_ok,
               coalesce(regexp_matches(commit_sha, '^([0-9a-fA-F]{40}|[0-9a-fA-F]{64})$'), false) AS commit_ok FROM z
    """,
    "repo_stats": """
        WITH f AS (SELECT repo_id, count(DISTINCT id) AS files, sum(n_lines)::BIGINT AS n_lines FROM (SELECT DISTINCT id, repo_id, n_lines FROM files) GROUP BY 1),
        s AS (SELECT repo_id, count(*) AS spans, count(DISTINCT file_id) AS files_with_spans, count(embedding) AS vectors, count(*) FILTER (kind = 'func') AS functions, count(*) FILTER (text IS NULL) AS without_text FROM (SELECT DISTINCT * FROM spans) GROUP BY 1)
        SELECT r.id AS repo_id, coalesce(files, 0) AS files, coalesce(n_lines, 0) AS n_lines, coalesce(spans, 0) AS spans, coalesce(files_with_spans, 0) AS files_with_spans, coalesce(vectors, 0) AS vectors, coalesce(functions, 0) AS functions, coalesce(without_text, 0) AS without_text
        FROM (SELECT DISTINCT id FROM repos) r LEFT JOIN f ON f.repo_id = r.id LEFT JOIN s ON s.repo_id = r.id
    """,
    "embedder_guard": """
        SELECT repo_id, count(DISTINCT (embed_model, embed_dim)) AS embedders, min(embed_model) AS first_model, CASE WHEN count(DISTINCT (embed_model, embed_dim)) > 1 THEN 'mixed' ELSE 'one' END AS state
        FROM spans WHERE embedding IS NOT NULL AND embed_model IS NOT NULL AND embed_dim IS NOT NULL GROUP BY 1
    """,
    "staleness_newer": f"""
        WITH {_L}, r AS (SELECT * FROM latest WHERE remote_key IS NOT NULL AND commit_sha IS NOT NULL AND indexed_at IS NOT NULL),
        n AS (SELECT * FROM (SELECT a.id, b.commit_sha AS c, b.indexed_at AS t, row_number() OVER (PARTITION BY a.id ORDER BY b.indexed_at DESC, b.commit_sha) AS k FROM r a JOIN r b ON a.remote_key = b.remote_key AND a.ref_name = b.ref_name AND a.commit_sha <> b.commit_sha AND b.indexed_at > a.indexed_at) WHERE k = 1),
        y AS (SELECT r.*, n.c AS nc, n.t AS nt, (epoch_us(TIMESTAMPTZ '2026-01-01 00:00:00+00') - epoch_us(indexed_at)) / 1000000 AS sec FROM r LEFT JOIN n ON n.id = r.id)
        SELECT id, nc AS newer_commit, epoch_us(nt) AS newer_at_us, CASE WHEN nc IS NULL THEN 'unknown' ELSE 'superseded' END AS state,
               'Indexed at ' || left(commit_sha, 7) || ', ' || {_AGE} || ' ago. ' || CASE WHEN nc IS NULL THEN 'Whether ' || ref_name || ' moved since was not checked.' ELSE ref_name || ' is indexed at the later commit ' || left(nc, 7) || ' too.' END AS note FROM y
    """,
    "evict_keep_n": f"WITH {_L} SELECT id, epoch_us(last_used) AS last_used_us FROM gone",
    "tombstones_trim": f"""
        WITH {_L}, t AS (SELECT repo_id AS id, max(checked_at) AS e FROM staleness WHERE repo_id IS NOT NULL AND repo_id NOT IN (SELECT id FROM gone) GROUP BY 1 UNION ALL SELECT id, TIMESTAMPTZ '2025-06-01 00:00:00+00' FROM gone)
        SELECT id, epoch_us(e) AS evicted_at_us FROM t ORDER BY e DESC, id DESC LIMIT 300
    """,
    "repo_gone": f"WITH {_L} SELECT repo_id, CASE WHEN repo_id IN (SELECT id FROM kept) THEN 200 WHEN repo_id IN (SELECT id FROM gone) THEN 410 ELSE 404 END AS status FROM (SELECT DISTINCT repo_id FROM staleness WHERE repo_id IS NOT NULL)",
    "list_repos_lru": f"WITH {_L} SELECT id, remote_key, ref_name, epoch_us(last_used) AS last_used_us FROM latest ORDER BY last_used DESC, id LIMIT 50",
    "upsert_merge": """
        WITH r AS (SELECT DISTINCT id, lower(commit_sha) AS c, size_bytes AS b, file_count AS f, seen_at AS s, seen_at >= TIMESTAMPTZ '2025-04-01 00:00:00+00' AS late FROM repos WHERE id IS NOT NULL),
        m AS (SELECT id, late, x.* FROM (SELECT id, late, arg_max(struct_pack(c := c, b := b, f := f, s := s), struct_pack(s := s, b := b, f := f, c := c)) AS x FROM r GROUP BY 1, 2))
        SELECT coalesce(o.id, n.id) AS id, coalesce(o.c, n.c) AS commit_sha, coalesce(n.b, o.b) AS size_bytes, coalesce(n.f, o.f) AS file_count, epoch_us(coalesce(n.s, o.s)) AS seen_us
        FROM (SELECT * FROM m WHERE NOT late) o FULL JOIN (SELECT * FROM m WHERE late) n ON o.id = n.id
    """,
    "empty_repos": "SELECT DISTINCT id FROM repos WHERE id NOT IN (SELECT repo_id FROM spans WHERE repo_id IS NOT NULL)",
    "index_fast_path": """
        WITH h AS (SELECT repo_id, count(*) AS n, count(*) FILTER (embed_model IS NOT NULL AND NOT (embed_model = 'lodestar-text' AND embed_dim = 64)) AS o
                   FROM (SELECT DISTINCT id, repo_id, file_id, path, kind, symbol, start_line, end_line, text, digest, embed_model, embed_dim FROM spans) GROUP BY 1)
        SELECT r.id, coalesce(n, 0) AS spans, coalesce(n > 0 AND o = 0, false) AS skip FROM (SELECT DISTINCT id FROM repos) r LEFT JOIN h ON h.repo_id = r.id
    """,
    "embedding_reuse_split": """
        WITH w AS (SELECT DISTINCT repo_id, digest FROM spans WHERE digest IS NOT NULL AND embedding IS NULL),
        h AS (SELECT DISTINCT digest FROM spans WHERE digest IS NOT NULL AND embed_model = 'lodestar-text' AND embed_dim = 64 AND len(embedding) = 64)
        SELECT repo_id, count(*) AS wanted, count(h.digest) AS reused, count(*) FILTER (h.digest IS NULL) AS to_embed FROM w LEFT JOIN h ON h.digest = w.digest GROUP BY 1
    """,
    "previous_blobs": f"WITH {_L} SELECT p.id AS repo_id, previous_id, f.path, f.blob FROM prev p JOIN (SELECT repo_id, path, max(blob) AS blob FROM files GROUP BY ALL) f ON f.repo_id = p.previous_id",
    "changed_files": f"""
        WITH {_L}, b AS (SELECT repo_id, path, max(blob) AS blob FROM files GROUP BY ALL)
        SELECT b.repo_id, CASE WHEN max(previous_id) IS NULL THEN -1 ELSE count(*) FILTER (b.blob IS DISTINCT FROM o.blob) END::BIGINT AS changed, count(*) AS files
        FROM b JOIN prev p ON p.id = b.repo_id LEFT JOIN b o ON o.repo_id = p.previous_id AND o.path = b.path GROUP BY 1
    """,
    "corpus_verify_diff": """
        WITH a AS (SELECT repo_id, path, max(id) AS x, 1 AS l FROM files GROUP BY ALL), b AS (SELECT repo_id, path, max(file_id) AS y, 1 AS r FROM spans GROUP BY ALL),
        m AS (SELECT coalesce(a.repo_id, b.repo_id) AS repo_id, coalesce(a.path, b.path) AS path, CASE WHEN l IS NULL THEN 'only right' WHEN r IS NULL THEN 'only left' WHEN x IS DISTINCT FROM y THEN 'other bytes' END AS why
              FROM a FULL JOIN b ON a.repo_id = b.repo_id AND a.path = b.path)
        SELECT repo_id, min(path) AS path, arg_min(why, path) AS why, count(*) AS disagreements FROM m WHERE why IS NOT NULL GROUP BY 1
    """,
    "span_scan": "SELECT id, path, start_line FROM (SELECT DISTINCT id, path, start_line FROM spans) WHERE id > '8' ORDER BY id LIMIT 200",
}
