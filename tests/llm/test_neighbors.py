import numpy as np
import pytest

from tests.llm.helpers import with_extra
from millrace.llm import neighbors as N

CONFIG = "embed_model string, embed_dim int, retrieval_mode string, candidates int, nearest_k int"
SPANS = "id string, embed_model string, embed_dim int, embedding array<float>"


def brute(rows, k):
    ids = [r[0] for r in rows]
    v = np.array([r[3] for r in rows], np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    sim = (v @ v.T).round(6)
    out = {}
    for i, a in enumerate(ids):
        order = sorted((-sim[i, j], ids[j]) for j in range(len(ids)) if j != i)
        out[a] = [b for _, b in order[:k]]
    return out


def cloud(n, dim, seed, groups=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    return [(f"{i:06d}", "m", dim, [float(x) for x in np.float32(centres[i % groups] + rng.normal(scale=0.4, size=dim))]) for i in range(n)]


@pytest.mark.parametrize(("n", "region"), [(40, 2000), (900, 2000), (900, 64)])
def test_recall(spark, monkeypatch, n, region):
    monkeypatch.setattr(N, "REGION_ROWS", region)
    rows = cloud(n, 12, 4)
    config = spark.createDataFrame([("m", 12, "vector", 40, 5)], CONFIG)
    usable = N.usable_vectors(spark.createDataFrame(rows, SPANS), config)
    got = N.nearest_vectors(usable).collect()
    want = brute(rows, 5)
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r.id, []).append(r.neighbor_id)
    assert all(len(x) == 5 for x in found.values()) and len(found) == n
    assert sum(len(set(want[a]) & set(found[a])) for a in want) >= 0.97 * 5 * n
    report = N.exact_recall(usable, N.nearest_vectors(usable), every=2).collect()
    assert report[0].recall >= 0.95


def test_copies_ties_and_dirt(spark):
    e = lambda *x: [float(v) for v in x]
    rows = [(f"c{i:03d}", "m", 2, e(1, 1)) for i in range(300)] + [("x", "m", 2, e(1, 0)), ("x", "m", 2, e(1, 0)), ("y", "m", 2, e(0, 3)), ("z", "m", 2, e(2, 2))]
    rows += [("n1", "m", 2, None), ("n2", "m", 2, e(0, 0)), ("n3", "m", 2, e(1, float("nan"))), ("n4", "m", 2, e(1, float("inf"))), ("n5", "m", 3, e(1, 2, 3)), ("n6", "other", 2, e(1, 2)), (None, "m", 2, e(1, 2)), ("n7", None, 2, e(1, 2)), ("n8", "m", 2, [1.0, None])]
    df = with_extra(spark.createDataFrame(rows, SPANS), "ID", "number", "rank", "c1")
    config = spark.createDataFrame([("m", 2, "vector", 40, 3), ("m", 2, "vector", 40, 3), (None, 2, "", 1, 3), ("w", None, "", 1, 3)], CONFIG)
    got = {}
    for r in N.nearest_vectors(N.usable_vectors(df, config)).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.neighbor_id)
    assert len(got) == 303
    assert got["c000"] == ["c001", "c002", "c003"] and got["c150"] == ["c000", "c001", "c002"]
    assert got["y"] == ["c000", "c001", "c002"] and "x" not in got["x"]
    pairs = N.neighbor_pairs(N.nearest_vectors(N.usable_vectors(df, config)))
    assert pairs.where("span_id_a >= span_id_b").count() == 0


def test_empty(spark):
    config = spark.createDataFrame([("m", 2, "vector", 40, 3)], CONFIG)
    none = spark.createDataFrame([], SPANS)
    assert N.nearest_vectors(N.usable_vectors(none, config)).count() == 0
    one = spark.createDataFrame([("a", "m", 2, [1.0, 2.0])], SPANS)
    assert N.nearest_vectors(N.usable_vectors(one, config)).count() == 0
    assert N.nearest_vectors(N.usable_vectors(one, config.limit(0))).count() == 0


def test_footrule_of_rank_classes():
    rng = np.random.default_rng(3)
    orders = np.array([rng.permutation(9)[:6] for _ in range(8)])
    rows = N.rank_classes(orders, 9, (1, 3, 6)).astype(int)
    weight = lambda order, p: sum(p in order[:most] for most in (1, 3, 6))
    footrule = [[sum(abs(weight(x, p) - weight(y, p)) for p in range(9)) for y in orders.tolist()] for x in orders.tolist()]
    assert (2 * (1 + 3 + 6) - 2 * rows @ rows.T).tolist() == footrule


def test_footrule_chooses_what_is_compared():
    rows = np.array([r[3] for r in cloud(3000, 16, 8)], np.float32)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    pivots = rows[N.local_pivots(np.arange(3000), N.LOCAL_PIVOTS)]
    asking = np.arange(0, 3000, 10)
    q, other, cosine, compared = N.search_region(rows, pivots, asking, 5, 256)
    assert compared <= 256 * len(asking) < 0.1 * 3000 * len(asking)
    exact = N.search_region(rows, pivots, asking, 5, None)
    assert exact[3] == 2999 * len(asking)
    both = set(zip(q.tolist(), other.tolist())) & set(zip(exact[0].tolist(), exact[1].tolist()))
    assert len(both) >= 0.95 * len(exact[0])
    # The rows compared are the nearest by footrule, not any others.
    weights = N.rank_classes(N.nearest_pivots(rows, pivots, N.RANKS[-1]), len(pivots)).astype(int)
    for i in asking[:20]:
        affinity = weights @ weights[i]
        affinity[i] = -1
        worst = np.sort(affinity)[-256]
        assert (affinity[other[q == i]] >= worst).all()


def test_regions_hold_few_pivots():
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(800, 8)).astype(np.float32)
    rows[:500] = rows[0] + 1e-3 * rows[:500]  # most pivots are close together
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    groups = N.regions_of(rows, 20)
    assert np.bincount(groups).max() <= 80 and sorted(set(groups)) == list(range(groups.max() + 1))


def test_nothing_is_cut_silently(spark):
    rows = cloud(1510, 4, 5, groups=3)
    config = spark.createDataFrame([("m", 4, "vector", 40, 1500)], CONFIG)
    got = N.nearest_vectors(N.usable_vectors(spark.createDataFrame(rows, SPANS), config))
    assert got.groupBy("id").count().where("count = 1500").count() == 1510


def test_many_models(spark, monkeypatch):
    monkeypatch.setattr(N, "PASS_PIVOTS", 900)  # several passes
    rows = [(f"{m}-{i}", f"m{m}", 3, [float(i + 1), float(m + 1), float((i * m) % 5)]) for m in range(1001) for i in range(3)]
    config = spark.createDataFrame([(f"m{m}", 3, "vector", 40, 2) for m in range(1001)], CONFIG)
    got = N.nearest_vectors(N.usable_vectors(spark.createDataFrame(rows, SPANS), config))
    assert got.groupBy("id").count().where("count = 2").count() == 3003
