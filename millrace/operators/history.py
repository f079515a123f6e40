"""History of changing entity attributes.

Periodic snapshots of a keyed table are compared through Merkle trees: rows are hashed, the hashes of a bucket of
keys are combined into its leaf, leaves into nodes, up to the root. Only branches whose hashes differ between two
snapshots are descended, only leaves that changed are read again, and what they hold that is new is appended to the
history as versions with the period in which each was valid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import cut
from millrace.sources.tables import only

#: Children of a node, levels below the root where none are given (FANOUT ** DEPTH leaves), and rows of a leaf where their number is known.
FANOUT, DEPTH, LEAF_ROWS = 16, 3, 8


def row_hash(columns: list[str]) -> Column:
    """64 bits of a row; a null differs from every value."""
    return F.xxhash64(*[F.struct(F.col(c).isNull(), F.col(c)) for c in columns])


def leaf_of(keys: list[str], fanout: int = FANOUT, depth: int = DEPTH) -> Column:
    """The leaf bucket of a row's key."""
    return F.pmod(F.xxhash64(*keys), F.lit(fanout**depth)).cast("long")


def merkle_tree(rows: DataFrame, keys: list[str], values: list[str], fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """``level, node, hash`` of one snapshot, level 0 being the root. The order and the repetition of rows don't matter."""
    leaves = rows.select(*dict.fromkeys(keys + values)).distinct().groupBy(leaf_of(keys, fanout, depth).alias("node")).agg(F.bit_xor(row_hash(keys + values)).alias("hash"))
    return _grown(leaves, fanout, depth)


def _grown(leaves: DataFrame, fanout: int, depth: int, by: tuple[str, ...] = ()) -> DataFrame:
    """``by, level, node, hash``: the trees above ``by, node, hash`` of leaves, one for each value of ``by``."""
    out = leaves.select(*by, F.lit(depth).alias("level"), "node", "hash")
    below = leaves
    for level in range(depth - 1, -1, -1):
        below = below.groupBy(*by, F.floor(F.col("node") / fanout).cast("long").alias("node")).agg(F.bit_xor(F.xxhash64("node", "hash")).alias("hash"))
        out = out.unionByName(below.select(*by, F.lit(level).alias("level"), "node", "hash"))
    return out


def changed_leaves(old: DataFrame, new: DataFrame, fanout: int = FANOUT, depth: int = DEPTH, by: tuple[str, ...] = ()) -> DataFrame:
    """``by, node``: the leaves in which two trees differ, found by descending differing branches only; for each value of ``by``."""
    differing = None
    for level in range(depth + 1):
        a, b = (t.where(F.col("level") == level).select(*by, "node", F.col("hash").alias(h)) for t, h in ((old, "_old"), (new, "_new")))
        if differing is not None:
            parents = differing.select(*by, F.col("node").alias("_parent"))
            a, b = (t.withColumn("_parent", F.floor(F.col("node") / fanout).cast("long")).join(parents, [*by, "_parent"], "left_semi").drop("_parent") for t in (a, b))
        differing = a.join(b, [*by, "node"], "full").where(~F.col("_old").eqNullSafe(F.col("_new"))).select(*by, "node")
    return differing


def depth_for(rows: int, fanout: int = FANOUT, leaf_rows: int = LEAF_ROWS) -> int:
    """Levels below the root, so that a leaf keeps between ``leaf_rows`` and ``fanout`` times as many rows however many there are."""
    depth = 1
    while fanout ** (depth + 1) * leaf_rows <= rows:
        depth += 1
    return depth


def changed_rows(old: DataFrame, new: DataFrame, keys: list[str], values: list[str], fanout: int = FANOUT, depth: int = DEPTH, trees: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``keys, values, change`` (``added`` or ``removed``) between two snapshots; only changed leaves are compared.

    ``trees`` are the two snapshots' trees where they were kept; then no row of an unchanged leaf is looked at.
    """
    a, b = trees or (merkle_tree(old, keys, values, fanout, depth), merkle_tree(new, keys, values, fanout, depth))
    leaves = changed_leaves(a, b, fanout, depth)
    columns = list(dict.fromkeys(keys + values))
    a, b = (t.select(*columns).distinct().join(leaves, leaf_of(keys, fanout, depth) == F.col("node"), "left_semi") for t in (old, new))
    return b.exceptAll(a).withColumn("change", F.lit("added")).unionByName(a.exceptAll(b).withColumn("change", F.lit("removed")))


def snapshot_trees(rows: DataFrame, columns: list[str], fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """``_s, level, node, hash``: the whole tree of every snapshot, nodes in which nothing arrived included.

    ``rows`` holds ``columns, _s, _leaf``, each row once. A leaf's hash runs over the snapshots, so the rows are read
    once for all trees; there are at most fanout ** depth leaves a snapshot.
    """
    arrived = cut(rows.groupBy("_s", F.col("_leaf").alias("node")).agg(F.bit_xor(row_hash(columns)).alias("hash")))
    everywhere = arrived.select("node").distinct().crossJoin(F.broadcast(arrived.select("_s").distinct()))  # a row a snapshot
    running = F.bit_xor("hash").over(Window.partitionBy("node").orderBy("_s").rowsBetween(Window.unboundedPreceding, 0))
    leaves = everywhere.join(arrived, ["_s", "node"], "left").withColumn("hash", running).where(F.col("hash").isNotNull())
    return _grown(cut(leaves.select("_s", "node", "hash")), fanout, depth, ("_s",))


def appended_by_snapshot(rows: DataFrame, keys: list[str], values: list[str], snapshot: str, fanout: int = FANOUT, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """What each snapshot of a growing table adds: the rows of changed leaves that the snapshot before had not.

    ``rows`` holds each row with a ``snapshot`` that contains it; a snapshot is everything up to its number. The tree of
    each snapshot is compared with that of the one before, and only the leaves that differ are read. The number of leaves
    grows with the rows.
    """
    columns = list(dict.fromkeys(keys + values))
    rows = cut(rows.groupBy(*columns).agg(F.min(snapshot).alias("_s")))
    depth = depth_for(rows.count(), fanout, leaf_rows)
    rows = rows.withColumn("_leaf", leaf_of(keys, fanout, depth))
    trees = cut(snapshot_trees(rows, columns, fanout, depth))
    numbers = trees.where("level = 0").select("_s")  # a row a snapshot
    steps = numbers.select("_s", F.lag("_s").over(Window.orderBy("_s")).alias("_before"))
    before = trees.withColumnRenamed("_s", "_before").join(F.broadcast(steps), "_before").drop("_before")
    leaves = changed_leaves(before, trees, fanout, depth, ("_s",)).withColumnRenamed("node", "_leaf")
    # A changed leaf of snapshot s holds rows up to s, in the one before up to the number before s. No number lies
    # between the two, so what it holds beyond the one before are its rows of just this number.
    return rows.join(leaves, ["_s", "_leaf"], "left_semi").drop("_leaf").withColumnRenamed("_s", snapshot)


def neighbour(df: DataFrame, keys: list[str], chunk: str, order: str, value: str, out: str, ahead: bool = False) -> DataFrame:
    """``df`` with ``out``, the ``value`` of the row before (or ahead) by ``order`` among rows with the same ``keys``.

    ``chunk`` grows with ``order``. Rows are ordered within (keys, chunk) only, and one value for each chunk is
    carried over, so that a key with a third of all rows never meets in one task.
    """
    step = F.lead if ahead else F.lag
    inside = Window.partitionBy(*keys, chunk).orderBy(order)
    pick = F.min_by if ahead else F.max_by
    ends = df.groupBy(*keys, chunk).agg(pick(value, order).alias("_end"), (F.min if ahead else F.max)(order).alias("_at"))
    edge = (F.max if ahead else F.min)(order).over(Window.partitionBy(*keys, chunk))
    carried = ends.withColumn("_carried", step("_end").over(Window.partitionBy(*keys).orderBy(chunk))).select(*keys, chunk, "_carried")
    placed = df.withColumns({"_inside": step(value).over(inside), "_edge": edge == F.col(order)})
    return placed.join(carried, [*keys, chunk]).withColumn(out, F.when(F.col("_edge"), F.col("_carried")).otherwise(F.col("_inside"))).drop("_inside", "_edge", "_carried")


def versions(statements: DataFrame, keys: list[str], value: str, at: str) -> DataFrame:
    """Unbroken periods ``keys, value, valid_from, valid_to`` (null for the last) of statements unique by (keys, at).

    A period runs from the first time its value is known to the first time another one is; a value may come back.
    Rows with a null key, value or time say nothing.
    """
    known = statements.where(F.col(at).isNotNull() & F.col(value).isNotNull())
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    known = known.withColumn("_day", F.to_date(at))
    turns = neighbour(cut(known), keys, "_day", at, value, "_before").where(~F.col(value).eqNullSafe(F.col("_before")))
    return neighbour(cut(turns), keys, "_day", at, at, "valid_to", ahead=True).withColumnRenamed(at, "valid_from").drop("_before", "_day")


def remote_key(remote: Column) -> Column:
    """host/owner/project in lower case, of the spellings of a remote with scheme, user, port, ``.git`` or slashes."""
    plain = remote.rlike(r"^[a-z0-9.-]+(/[a-z0-9_~.-]+)+$") & ~remote.endswith(".git")  # most need no further work
    r = F.lower(F.regexp_replace(remote, r"\s", ""))
    r = F.regexp_replace(r, r"^[a-z][a-z0-9+.-]*://", "")
    r = F.regexp_replace(r, r"^[^/@]*@", "")
    r = F.regexp_replace(r, r"^([^/:]+):[0-9]+(/|$)", "$1/")
    r = F.regexp_replace(r, r"^([^/:]+):", "$1/")
    r = F.regexp_replace(r, r"[?#].*$", "")
    r = F.regexp_replace(r, r"/+", "/")
    return F.when(plain, remote).otherwise(F.regexp_replace(r, r"(\.git|/)+$", ""))


def commit_statements(repos: DataFrame, staleness: DataFrame) -> DataFrame:
    """``remote, ref_name, commit_sha, at, seen``: what the log and the later checks say was indexed when.

    A row without commit or time says nothing, nor does a log row with a time after it was seen. A shortened commit stands for the
    full one of the same (remote, ref); one that fits none or several says nothing. Checks of repos that are gone
    say nothing.
    """
    repos, staleness = only(repos, "id", "remote", "ref_name", "commit_sha", "indexed_at", "seen_at"), only(staleness, "repo_id", "checked_at", "newer_commit", "newer_indexed_at")
    commit = lambda c: F.lower(F.trim(c))
    log = repos.select("id", remote_key(F.col("remote")).alias("remote"), "ref_name", commit(F.col("commit_sha")).alias("c"), F.col("indexed_at").alias("at"), F.col("seen_at").alias("seen"))
    log = cut(log.where(F.col("remote").isNotNull() & F.col("ref_name").isNotNull()).distinct())  # read and spelled out once for all uses
    places = log.where(F.col("id").isNotNull()).select(F.col("id").alias("repo_id"), "remote", "ref_name").distinct()
    checks = staleness.where(F.col("newer_commit").isNotNull() & F.col("newer_indexed_at").isNotNull()).select("repo_id", commit(F.col("newer_commit")).alias("c"), F.col("newer_indexed_at").alias("at"), F.col("checked_at").alias("seen")).distinct()
    checks = checks.join(places, "repo_id").drop("repo_id")
    log = log.withColumn("holds", ~F.coalesce(F.col("at") > F.col("seen"), F.lit(False)))
    said = log.where(F.col("c").isNotNull()).drop("id").unionByName(checks.withColumn("holds", F.lit(True))).where(F.col("c").rlike("^[0-9a-f]{4,40}$"))
    said = cut(said)
    full = said.where(F.length("c") == 40).select("remote", "ref_name", F.col("c").alias("commit_sha"), F.left("c", F.lit(4)).alias("head")).distinct()
    short = said.where(F.length("c") < 40).select("remote", "ref_name", "c", F.left("c", F.lit(4)).alias("head")).distinct()
    meant = (
        short.join(full, ["remote", "ref_name", "head"]).where(F.col("commit_sha").startswith(F.col("c")))
        .groupBy("remote", "ref_name", "c").agg(F.min("commit_sha").alias("commit_sha"), F.max("commit_sha").alias("_last"))
        .where(F.col("commit_sha") == F.col("_last")).drop("_last")
    )
    said = said.where(F.col("at").isNotNull() & F.col("holds")).drop("holds")
    whole = said.where(F.length("c") == 40).withColumnRenamed("c", "commit_sha")
    spelt_out = said.where(F.length("c") < 40).join(meant, ["remote", "ref_name", "c"]).drop("c")
    return whole.unionByName(spelt_out).select("remote", "ref_name", "commit_sha", "at", "seen")


def commit_history(repos: DataFrame, staleness: DataFrame, period: str = "month", fanout: int = FANOUT, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``remote, ref_name, commit_sha, valid_from, valid_to, known_in``: which commit was the indexed one from when to when.

    Snapshots are what had been seen up to the end of each ``period``; ``known_in`` is the one that brought the
    statement a version opens with. Of statements on one (remote, ref) and time the last seen holds. Empty tables give
    no row; other columns are ignored.
    """
    rows = commit_statements(repos, staleness).withColumn("known_in", F.date_trunc(period, F.coalesce("seen", "at")).cast("date"))
    keys = ["remote", "ref_name"]
    added = appended_by_snapshot(rows, keys, ["at", "commit_sha", "seen"], "known_in", fanout, leaf_rows)
    holds = added.groupBy(*keys, "at").agg(F.max_by(F.struct("commit_sha", "known_in"), F.struct("seen", "commit_sha")).alias("_h"))
    stated = holds.select(*keys, "at", "_h.commit_sha", "_h.known_in")
    return versions(stated, keys, "commit_sha", "at")
