"""Source files of a checkout."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.ids import git_blob

SKIPPED = (".git",)


class TooManyFiles(ValueError):
    """The checkout has more files than allowed."""


def regular_files(root: str, most_files: int, most_bytes: int) -> list[str]:
    """Regular files below ``root`` in order, without links, ``.git``, names that aren't UTF-8 and oversized files.

    Both bounds must be above 0; more files than ``most_files`` is an error, not a shorter list.
    """
    if most_files < 1 or most_bytes < 1:
        raise ValueError("both limits are above 0")
    out: list[str] = []
    for at, folders, names in os.walk(os.fsencode(root), followlinks=False):
        folders[:] = sorted(d for d in folders if d not in {os.fsencode(s) for s in SKIPPED})
        for name in sorted(names):
            path = os.path.join(at, name)
            info = os.lstat(path)
            if not stat.S_ISREG(info.st_mode) or info.st_size > most_bytes:
                continue
            try:
                out.append(path.decode("utf-8"))
            except UnicodeDecodeError:
                continue
            if len(out) > most_files:
                raise TooManyFiles(f"more than {most_files} files")
    return out


def read_regular(path: str, most_bytes: int) -> bytes:
    """The bytes of a regular file, never through a link and never more than ``most_bytes``."""
    handle = os.open(path, os.O_RDONLY | getattr(os, "O_NOFOLLOW", 0))
    with os.fdopen(handle, "rb") as f:
        if not stat.S_ISREG(os.fstat(f.fileno()).st_mode):
            raise OSError(f"not a regular file: {path}")
        body = f.read(most_bytes + 1)
    if len(body) > most_bytes:
        raise OSError(f"more than {most_bytes} bytes: {path}")
    return body


def _plain(folder: str) -> str:
    """A folder as the reader names it."""
    return os.path.join(os.path.realpath(folder), "") if os.path.isdir(folder) else folder


def checkout(spark: SparkSession, root: str, most_files: int = 20_000, most_bytes: int = 1 << 20) -> DataFrame:
    """``path, bytes, n_lines, lang, blob, text, indexable`` of the files below ``root``.

    A local folder is listed on the driver, to refuse links, and only the files listed are read; in a shared store, where
    there are none, the executors list and read. ``text`` is null for files that are not UTF-8.
    """
    if most_files < 1 or most_bytes < 1:
        raise ValueError("both limits are above 0")
    local = os.path.isdir(root)
    base = os.path.join(root, "")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).where(F.col("length") <= most_bytes)
    # The reader's names are URIs; what follows the folder is a file's path.
    name = F.url_decode(F.replace(F.regexp_replace(F.col("path"), "^file:/+", "/"), F.lit("+"), F.lit("%2B")))
    files = found.select(F.substr(name, F.lit(len(_plain(base)) + 1)).alias("path"), F.col("content").alias("body"))
    files = files.where(~F.concat(F.lit("/"), "path").contains("/.git/"))
    if local:
        listed = [(os.path.relpath(p, root),) for p in regular_files(root, most_files, most_bytes)]
        files = files.join(F.broadcast(spark.createDataFrame(listed, "path string")), "path", "left_semi")  # most_files rows at most
    elif files.limit(most_files + 1).count() > most_files:
        raise TooManyFiles(f"more than {most_files} files")
    body = F.col("body")
    valid = F.is_valid_utf8(body.cast("string"))
    out = files.withColumn("text", F.when(valid, body.cast("string")))
    return out.select(
        "path", F.octet_length("body").alias("bytes"), T.line_count(F.coalesce("text", F.lit(""))).alias("n_lines"), T.language_of(F.col("path")).alias("lang"), git_blob(body).alias("blob"), "text",
        F.coalesce(T.indexable(F.col("path"), F.col("text")), F.lit(False)).alias("indexable"),
    )


def refs_to_commit(refs: DataFrame, ref: str) -> str:
    """The commit a ref stands for; refuses none and several, and what is no full lower-case commit."""
    found = refs.where(F.col("ref_name") == ref).select("commit_sha").distinct().limit(2).collect()
    if len(found) != 1:
        raise LookupError(f"{ref}: {'no' if not found else 'more than one'} commit")
    commit = found[0].commit_sha
    if commit is None or len(commit) != 40 or set(commit) - set("0123456789abcdef"):
        raise ValueError(f"{ref}: not a commit: {commit}")
    return commit
