"""Content-addressed identities, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def content_id(*parts: Column) -> Column:
    """32 hex digits of SHA-256 over the parts, each followed by a NUL; numbers go in as decimal text."""
    sep = F.decode(F.unhex(F.lit("00")), "UTF-8")
    joined = F.concat(*[x for p in parts for x in (p.cast("string"), sep)])
    return F.substring(F.sha2(joined.cast("binary"), 256), 1, 32)


def repo_id(remote: Column, ref: Column, commit: Column) -> Column:
    return content_id(remote, ref, commit)


def file_id(repo: Column, path: Column) -> Column:
    return content_id(repo, path)


def span_id(repo: Column, path: Column, start: Column, end: Column, digest: Column) -> Column:
    return content_id(repo, path, start, end, digest)


def text_digest(text: Column) -> Column:
    """Full SHA-256 of a text."""
    return F.sha2(text.cast("binary"), 256)


def git_blob(body: Column) -> Column:
    """The object id git gives a file with this body."""
    head = F.concat(F.lit("blob "), F.octet_length(body).cast("string"), F.decode(F.unhex(F.lit("00")), "UTF-8"))
    return F.sha1(F.concat(head.cast("binary"), body.cast("binary")))
