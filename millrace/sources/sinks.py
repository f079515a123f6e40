"""Writing tables partitioned by repository."""

from __future__ import annotations

import json
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.corpus import last_by
from millrace.operators.graph import check_edges
from millrace.session import cut


def replace_repos(rows: DataFrame, folder: str, repos: list[str], id_col: str = "id", order: str | None = None, dim: int | None = None) -> None:
    """Replaces what ``folder`` holds of ``repos`` by ``rows``; a repository without rows is emptied.

    Rows of other repositories and vectors that aren't ``dim`` wide are refused before anything is written. Of rows with the same id the last by ``order`` stays. ``rows`` are
    computed once and written to a folder beside the table; only when they are whole is each repository's partition put in
    the place of the old one, so that a failed write leaves the table as it was. The number of repositories of one call is bounded by the caller.
    """
    rows = cut(last_by(rows, ["repo_id", id_col], [order]) if order else rows)
    stray = rows.where(~F.coalesce(F.col("repo_id").isin(repos), F.lit(False))).limit(1).collect()
    if stray:
        raise ValueError(f"row of another repository: {stray[0]['repo_id']}")
    if dim is not None and rows.where(F.col("embedding").isNotNull() & (F.size("embedding") != dim)).limit(1).count():
        raise ValueError(f"a vector is not {dim} wide")
    session = rows.sparkSession
    jvm = session._jvm.org.apache.hadoop.fs
    table, staged = jvm.Path(folder), jvm.Path(f"{folder.rstrip('/')}.staged-{uuid4().hex}")
    files = table.getFileSystem(session._jsc.hadoopConfiguration())
    rows.repartition("repo_id").write.partitionBy("repo_id").parquet(staged.toString())
    files.mkdirs(table)
    for repo in repos:
        name = session._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString("repo_id", repo)
        files.delete(jvm.Path(table, name), True)
        if files.exists(jvm.Path(staged, name)):
            files.rename(jvm.Path(staged, name), jvm.Path(table, name))
    files.delete(staged, True)


def replace_graph(symbols: DataFrame, edges: DataFrame, folder: str, repos: list[str]) -> None:
    """Replaces the call graph of ``repos`` in ``folder/symbols`` and ``folder/edges``.

    Refused are edges whose target disagrees with their provenance, and calls from a symbol that isn't there.
    """
    edges = cut(check_edges(edges))
    orphan = edges.join(symbols.select(F.col("id").alias("from_id")), "from_id", "left_anti").limit(1).collect()
    if orphan:
        raise ValueError(f"edge {orphan[0]['id']} has no caller")
    replace_repos(symbols, f"{folder}/symbols", repos)
    replace_repos(edges, f"{folder}/edges", repos)


def write_report(folder: str, name: str, flag: str, embedder: str, body: dict) -> Path:
    """One JSON file, the quality flag first, in a folder named after the embedder."""
    target = Path(folder) / embedder
    target.mkdir(parents=True, exist_ok=True)
    out = target / f"{name}.json"
    out.write_text(json.dumps({"quality": flag, "embedder": embedder, **body}, indent=2) + "\n")
    return out
