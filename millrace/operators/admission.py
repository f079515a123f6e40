"""Which remotes and refs are admitted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_REF = 255
SEGMENT = r"^[A-Za-z0-9._-]+$"


def admitted(url: Column, hosts: list[str]) -> Column:
    """Struct ``rule`` (null: admitted), ``url``, ``key``, ``host``, ``owner``, ``name``.

    Rules in order: form (empty, no URL), scheme, form (user, port), host, form (path of owner and name, plain names).
    ``.git`` is taken off a name as often as it stands there.
    """
    raw = F.regexp_replace(F.coalesce(url, F.lit("")), r"^\s+|\s+$", "")
    scheme = F.lower(F.regexp_extract(raw, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.regexp_extract(raw, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_replace(F.regexp_extract(raw, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"^/+|/+$", "")
    bare = F.regexp_replace(authority, r"^.*@", "")
    host = F.lower(F.regexp_replace(bare, r":\d*$", ""))
    owner = F.regexp_extract(path, r"^([^/]+)/[^/]+$", 1)
    name = F.regexp_replace(F.regexp_extract(path, r"^[^/]+/([^/]+)$", 1), r"(\.git)+$", "")
    plain = lambda s: s.rlike(SEGMENT) & ~s.isin(".", "..")
    rule = (
        F.when(raw == "", "form")
        .when(scheme != "https", "scheme")
        .when(authority.contains("@") | bare.rlike(r":\d+$"), "form")
        .when(~host.isin(hosts), "host")
        .when((owner == "") | (name == "") | ~plain(owner) | ~plain(name), "form")
    )
    fine = lambda c: F.when(rule.isNull(), c)
    return F.struct(
        rule.alias("rule"),
        fine(F.concat(F.lit("https://"), host, F.lit("/"), owner, F.lit("/"), name)).alias("url"),
        fine(F.concat(host, F.lit("/"), F.lower(owner), F.lit("/"), F.lower(name))).alias("key"),
        fine(host).alias("host"), fine(owner).alias("owner"), fine(name).alias("name"),
    )


def valid_ref(ref: Column) -> Column:
    """Not empty, not a dot, no dash in front, no two dots in a row, 255 bytes at most, plain characters."""
    return F.coalesce((ref != ".") & (F.octet_length(ref) <= MOST_REF) & ~ref.startswith("-") & ~ref.contains("..") & ref.rlike("^[A-Za-z0-9._/-]+$"), F.lit(False))


def valid_commit(commit: Column) -> Column:
    """40 or 64 hex digits of any case."""
    return F.coalesce(commit.rlike("^([0-9a-fA-F]{40}|[0-9a-fA-F]{64})$"), F.lit(False))
