"""Citations: ages, short commits, permalinks, staleness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHORT = 7
#: Forges whose links are known (fixed values).
FORGES = {
    "github.com": "/blob/",
    "codeberg.org": "/src/commit/",
}


def short_commit(commit: Column) -> Column:
    return F.left(commit, F.lit(SHORT))


def age_phrase(since: Column, now: Column) -> Column:
    """Coarse on purpose: below an hour, hours below a day, days. A clock that runs behind counts as below an hour."""
    seconds = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(since.cast("timestamp"))) / 1_000_000
    unit = lambda n, name: F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n == 1, "").otherwise("s"))
    hours, days = F.floor(seconds / 3600).cast("int"), F.floor(seconds / 86400).cast("int")
    return F.when(since.isNull(), None).when(seconds < 3600, "less than an hour").when(seconds < 86400, unit(hours, "hour")).otherwise(unit(days, "day"))


def escaped_path(path: Column) -> Column:
    """Each segment percent-encoded, slashes kept; ``$&+:=@`` stay as they are in a path."""
    encoded = F.array_join(F.transform(F.split(path, "/"), F.url_encode), "/")
    for code, char in (("%24", "$"), ("%26", "&"), ("%2B", "+"), ("%3A", ":"), ("%3D", "="), ("%40", "@"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(code), F.lit("\0" if char == "+" else char))
    encoded = F.replace(F.replace(encoded, F.lit("+"), F.lit("%20")), F.lit("\0"), F.lit("+"))
    return F.replace(encoded, F.lit("*"), F.lit("%2A"))


def permalink(host: Column, owner: Column, name: Column, commit: Column, path: Column, start: Column, end: Column, forges: dict[str, str] | None = None) -> Column:
    """URL of lines at a commit on a forge in ``forges`` (host → what stands before the commit), empty elsewhere."""
    out = F.lit("")
    for known, middle in (forges or FORGES).items():
        url = F.concat(F.lit(f"https://{known}/"), owner, F.lit("/"), name, F.lit(middle), commit, F.lit("/"), escaped_path(path), F.lit("#L"), start.cast("string"), F.lit("-L"), end.cast("string"))
        out = F.when(host == known, url).otherwise(out)
    return out


def staleness(commit: Column, ref: Column, indexed_at: Column, newer_commit: Column, now: Column, newer_at: Column | None = None) -> Column:
    """State of a citation: ``superseded`` where a later commit of the ref is indexed, else ``unknown``: nobody asked the forge."""
    base = F.concat(F.lit("Indexed at "), short_commit(commit), F.lit(", "), age_phrase(indexed_at, now), F.lit(" ago. "))
    newer = F.concat(base, ref, F.lit(" is indexed at the later commit "), short_commit(newer_commit), F.lit(" too."))
    return F.struct(
        F.when(newer_commit.isNotNull(), "superseded").otherwise("unknown").alias("state"),
        F.lit(False).alias("forge_checked"),
        F.when(newer_commit.isNotNull(), newer).otherwise(F.concat(base, F.lit("Whether "), ref, F.lit(" moved since was not checked."))).alias("note"),
        indexed_at.cast("timestamp").alias("indexed_at"),
        newer_commit.alias("newer_commit"),
        (F.lit(None) if newer_at is None else F.when(newer_commit.isNotNull(), newer_at)).cast("timestamp").alias("newer_indexed_at"),
    )


def citation(now: Column, forges: dict[str, str] | None = None) -> Column:
    """What identifies a span to a reader, of a row with the columns of a span and of its repository (``remote_key, ref_name,
    commit_sha, indexed_at, newer_commit, newer_at``)."""
    part = F.split("remote_key", "/")
    link = permalink(part[0], part[1], part[2], F.col("commit_sha"), F.col("path"), F.col("start_line"), F.col("end_line"), forges)
    state = staleness(F.col("commit_sha"), F.col("ref_name"), F.col("indexed_at"), F.col("newer_commit"), now, F.col("newer_at"))
    return F.struct("repo_id", F.col("remote_key").alias("remote"), F.col("commit_sha").alias("commit"), F.col("ref_name").alias("ref"), "path", "start_line", "end_line", "digest", link.alias("permalink"), state.alias("staleness"))


def wire_number(x: Column) -> Column:
    """NaN becomes null; JSON has no NaN."""
    return F.when(~F.isnan(x), x)
