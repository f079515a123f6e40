"""The life of a corpus: merging, replacing, evicting, reusing, comparing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged(existing: DataFrame, incoming: DataFrame, key: str, keep_first: list[str]) -> DataFrame:
    """Upsert by ``key``: incoming values win where they are not null, but those of ``keep_first`` stay as they were."""
    a, b = existing.alias("a"), incoming.alias("b")
    columns = [F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key)]
    for c in existing.columns:
        if c != key:
            first, second = ("a", "b") if c in keep_first else ("b", "a")
            columns.append(F.coalesce(F.col(f"{first}.{c}"), F.col(f"{second}.{c}")).alias(c))
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(*columns)


def last_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``: of rows given twice the later one wins."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_l")).select(*keys, *[F.col(f"_l.{c}").alias(c) for c in rest])


def page(df: DataFrame, key: str | list[str], after: str | tuple | None, limit: int) -> DataFrame:
    """The next ``limit`` rows by the key columns behind the key values ``after``; a short page ends the scan."""
    if limit < 1:
        raise ValueError("a page has at least one row")
    keys = [key] if isinstance(key, str) else key
    rows = df
    if after is not None:
        values = (after,) if isinstance(key, str) else after
        rows = df.where(F.struct(*keys) > F.struct(*[F.lit(v).cast(dict(df.dtypes)[k]).alias(k) for k, v in zip(keys, values)]))
    return rows.orderBy(*keys).limit(limit)


def next_cursor(rows: DataFrame, key: str | list[str], limit: int) -> tuple | None:
    """What to pass as ``after`` for the page behind this one, None where it was short: the last one."""
    keys = [key] if isinstance(key, str) else key
    last = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(*keys)).alias("last")).first()
    return tuple(last["last"]) if last.n == limit else None


def repo_stats(repos: DataFrame, files: DataFrame, spans: DataFrame, symbols: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """Counts for each repository, zeros where there is nothing; those of the call graph where it is given.

    Each provenance is counted by its own name, so that another one would show as a difference from ``edges``.
    """
    f = files.groupBy("repo_id").agg(F.countDistinct("id").alias("files"), F.sum("n_lines").alias("n_lines"))
    s = spans.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("spans"), F.countDistinct("file_id").alias("files_with_spans"), F.count("embedding").alias("vectors"), F.count_if(F.col("kind") == "func").alias("functions"), F.count_if(F.col("text").isNull()).alias("without_text")
    )
    out = repos.select(F.col("id").alias("repo_id")).distinct().join(f, "repo_id", "left").join(s, "repo_id", "left")
    if symbols is not None:
        out = out.join(symbols.groupBy("repo_id").agg(F.count(F.lit(1)).alias("symbols")), "repo_id", "left")
    if edges is not None:
        counts = [F.count_if(F.col("provenance") == p).alias(f"edges_{p}") for p in ("resolved", "syntactic")]
        out = out.join(edges.groupBy("repo_id").agg(F.count(F.lit(1)).alias("edges"), *counts), "repo_id", "left")
    return out.na.fill(0)


def newer_commits(repos: DataFrame) -> DataFrame:
    """``id, newer_commit, newer_at``: the last other commit of the same (remote, ref) that was indexed later.

    ``repos``: ``id, remote_key, ref_name, commit_sha, indexed_at``. The two latest commits of a key are enough to answer for
    all its rows, so the self-join never pairs rows with each other.
    """
    last = repos.groupBy("remote_key", "ref_name", "commit_sha").agg(F.max("indexed_at").alias("at"))
    two = Window.partitionBy("remote_key", "ref_name").orderBy(F.desc("at"), "commit_sha")
    top = last.withColumn("_n", F.row_number().over(two)).where(F.col("_n") <= 2)
    pair = top.groupBy("remote_key", "ref_name").agg(*[F.max(F.when(F.col("_n") == n, F.struct("commit_sha", "at"))).alias(f"_{n}") for n in (1, 2)])
    met = repos.join(pair, ["remote_key", "ref_name"], "left")
    other = F.when(F.col("_1.commit_sha") != F.col("commit_sha"), F.col("_1")).otherwise(F.col("_2"))
    later = F.when(other["at"] > F.col("indexed_at"), other)
    return met.select("id", later["commit_sha"].alias("newer_commit"), later["at"].alias("newer_at"))


def kept(repos: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` repositories used last; of equals the greater id stays."""
    return repos.orderBy(F.desc("last_used"), F.desc("id")).limit(keep)


def evicted(repos: DataFrame, keep: int) -> DataFrame:
    """All but the ``keep`` used last. What is kept is found as a top-k, so no task sorts everything."""
    return repos.join(kept(repos, keep).select("id"), "id", "left_anti")


def tombstones(old: DataFrame, gone: DataFrame, now: Column, keep: int) -> DataFrame:
    """Tombstones after an eviction: those of ``gone`` anew, then the ``keep`` latest of all."""
    new = gone.select("id", now.alias("evicted_at"))
    both = old.select("id", "evicted_at").join(new.select("id"), "id", "left_anti").unionByName(new)
    return both.orderBy(F.desc("evicted_at"), F.desc("id")).limit(keep)


def lookup(wanted: DataFrame, repos: DataFrame, buried: DataFrame) -> DataFrame:
    """``repo_id, status``: 200 for what is there, 410 for what was evicted, 404 for what never was."""
    r, t = repos.select(F.col("id").alias("repo_id")).distinct().withColumn("_r", F.lit(1)), buried.select(F.col("id").alias("repo_id")).distinct().withColumn("_t", F.lit(1))
    out = wanted.select("repo_id").distinct().join(r, "repo_id", "left").join(t, "repo_id", "left")
    return out.select("repo_id", F.when(F.col("_r").isNotNull(), 200).when(F.col("_t").isNotNull(), 410).otherwise(404).alias("status"))


def without_spans(repos: DataFrame, spans: DataFrame) -> DataFrame:
    """Repositories nothing was kept of."""
    return repos.join(spans.select(F.col("repo_id").alias("id")), "id", "left_anti")


def cascade(child: DataFrame, gone: DataFrame) -> DataFrame:
    """What stays of a child table when repositories go."""
    return child.join(gone.select(F.col("id").alias("repo_id")), "repo_id", "left_anti")


def fast_path(repos: DataFrame, spans: DataFrame, model: str, dim: int) -> DataFrame:
    """``id, spans, skip``: a repository is done when it has spans and all its vectors are of this embedder."""
    have = spans.groupBy(F.col("repo_id").alias("id")).agg(F.count(F.lit(1)).alias("spans"), F.count_if(F.col("embed_model").isNotNull() & ~((F.col("embed_model") == model) & (F.col("embed_dim") == dim))).alias("_other"))
    out = repos.select("id").distinct().join(have, "id", "left")
    return out.select("id", F.coalesce("spans", F.lit(0)).alias("spans"), F.coalesce((F.col("spans") > 0) & (F.col("_other") == 0), F.lit(False)).alias("skip"))


def reusable(wanted: DataFrame, spans: DataFrame, model: str, dim: int) -> DataFrame:
    """``digest, embedding``: for each wanted digest the vector of the smallest span id that has one of this embedder."""
    have = spans.where((F.col("embed_model") == model) & (F.col("embed_dim") == dim) & F.col("embedding").isNotNull() & (F.size("embedding") == dim) & F.col("digest").isNotNull())
    have = have.join(wanted.select("digest").distinct(), "digest", "left_semi")
    return have.groupBy("digest").agg(F.min_by("embedding", "id").alias("embedding"))


def previous_repo(repos: DataFrame) -> DataFrame:
    """``id, previous_id``: the repository of the same remote indexed before it, null for the first one.

    ``repos``: ``id, remote_key, indexed_at``, one row an id.
    """
    order = Window.partitionBy("remote_key").orderBy("indexed_at", "id")
    return repos.select("id", F.lag("id").over(order).alias("previous_id"))


def changed_files(files: DataFrame, previous: DataFrame) -> DataFrame:
    """``repo_id, changed, files``: files whose blob is new or another one, -1 where there is no repository before."""
    blobs = files.groupBy("repo_id", "path").agg(F.max("blob").alias("blob"))
    before = blobs.select(F.col("repo_id").alias("previous_id"), "path", F.col("blob").alias("_old"))
    met = blobs.join(previous.select(F.col("id").alias("repo_id"), "previous_id"), "repo_id").join(before, ["previous_id", "path"], "left")
    differs = ~F.col("blob").eqNullSafe(F.col("_old"))
    return met.groupBy("repo_id").agg(F.when(F.max("previous_id").isNull(), F.lit(-1)).otherwise(F.count_if(differs)).cast("long").alias("changed"), F.count(F.lit(1)).alias("files"))


def first_disagreement(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """For each key the first path on which two path → blob maps disagree, and how many do; no row where they agree."""
    a, b = left.select(*keys, "path", F.col("blob").alias("_a")), right.select(*keys, "path", F.col("blob").alias("_b"))
    met = a.withColumn("_l", F.lit(1)).join(b.withColumn("_r", F.lit(1)), [*keys, "path"], "full")
    why = F.when(F.col("_l").isNull(), "only right").when(F.col("_r").isNull(), "only left").when(~F.col("_a").eqNullSafe(F.col("_b")), "other bytes")
    first = met.withColumn("why", why).where(F.col("why").isNotNull())
    return first.groupBy(*keys).agg(F.min("path").alias("path"), F.min_by("why", "path").alias("why"), F.count(F.lit(1)).alias("disagreements"))


def _differing(left: DataFrame, right: DataFrame) -> DataFrame:
    return first_disagreement(left, right, ["repo_id"]).select("repo_id", F.struct("path", "why").alias("d"))


def verified(a: tuple[DataFrame, DataFrame, DataFrame], b: tuple[DataFrame, DataFrame, DataFrame], source: DataFrame) -> DataFrame:
    """Whether two arms hold one corpus: ``repo_id, refused, path, files_a, files_b, spans_a, spans_b, shared_ids``.

    An arm is (repos ``repo_id, database, commit_sha``; files ``repo_id, path, blob``; spans ``repo_id, id``); ``source`` holds the files the
    questions came from. The first rule that fails is named, most specific first: ``same_database, commits, files, source,
    identical_spans``; ``path`` is the first one in dispute. Only repositories of both arms are judged.
    """
    (ra, fa, sa), (rb, fb, sb) = a, b
    both = ra.select("repo_id", F.col("database").alias("_da"), F.col("commit_sha").alias("_ca")).join(rb.select("repo_id", F.col("database").alias("_db"), F.col("commit_sha").alias("_cb")), "repo_id")
    count = lambda df, name: df.groupBy("repo_id").agg(F.count(F.lit(1)).alias(name))
    ids_a, ids_b = sa.select("repo_id", "id").distinct(), sb.select("repo_id", "id").distinct()
    parts = [
        count(fa.select("repo_id", "path").distinct(), "files_a"), count(fb.select("repo_id", "path").distinct(), "files_b"), count(ids_a, "spans_a"), count(ids_b, "spans_b"),
        count(ids_a.join(ids_b, ["repo_id", "id"]), "shared_ids"), _differing(fa, fb).withColumnRenamed("d", "_files"), _differing(source, fa).withColumnRenamed("d", "_source"),
    ]
    for part in parts:
        both = both.join(part, "repo_id", "left")
    both = both.na.fill(0, ["files_a", "files_b", "spans_a", "spans_b", "shared_ids"])
    same = (F.col("spans_a") == F.col("spans_b")) & (F.col("shared_ids") == F.col("spans_a"))
    refused = (
        F.when(F.col("_da").eqNullSafe(F.col("_db")), "same_database").when(~F.col("_ca").eqNullSafe(F.col("_cb")), "commits").when(F.col("_files").isNotNull(), "files")
        .when(F.col("_source").isNotNull(), "source").when(same, "identical_spans")
    )
    path = F.when(refused == "files", F.col("_files.path")).when(refused == "source", F.col("_source.path"))
    return both.select("repo_id", refused.alias("refused"), path.alias("path"), "files_a", "files_b", "spans_a", "spans_b", "shared_ids")
