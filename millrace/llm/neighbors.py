"""Most similar vectors for every vector.

A permutation index. Each vector is represented by its nearest pivots in order of nearness and posted in the inverted
files of the ``PREFIX`` nearest ones; files of neighbouring pivots lie together in a region, where a vector is posted
once. A query asks in the regions of its nearest pivots, ``ASKED`` of them. There everything posted is ranked by the
footrule distance of its order of the region's own pivots from the query's, and only the ``RERANK`` best are compared by
cosine. Equal vectors are one class, so copies cost nothing and appear in the result through the class.

Scale: a region is one task. Pivots and regions grow with the collection, so that a region keeps about ``REGION_ROWS``
vectors that ask there first and some eight times as many rows; what is compared by cosine is the same at every size. The global
pivots are centres of a bounded sample, the only vectors collected; they are broadcast, at most ``PASS_PIVOTS`` in a pass
over the collection. Every vector is posted, none is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import retrieval
from millrace.operators.skew import salted_join
from millrace.session import cut
from millrace.sources.tables import only

#: Nearest pivots in whose files a vector is posted, and regions in which it asks.
PREFIX, ASKED = 20, 2
#: Vectors that ask first in a region, and rows for a pivot.
REGION_ROWS, PIVOT_ROWS = 2_000, 25
LEAST_PIVOTS, PASS_PIVOTS = 512, 65_536
#: Rows sampled for a pivot, the most rows sampled, and the rounds in which pivots move to the centre of theirs.
SAMPLE_A_PIVOT, MAX_SAMPLE, ROUNDS = 7, 65_536, 3
#: A region's own pivots, and the classes of ranks that the footrule distance tells apart: nearest 10, nearest 30, nearest 90, the rest.
LOCAL_PIVOTS, RANKS = 256, (10, 30, 90)
#: Candidates compared by cosine for each query in a region, the best by footrule; 4 x ``nearest_k`` where that is more.
RERANK = 256


def usable_vectors(spans: DataFrame, configs: DataFrame) -> DataFrame:
    """``embed_model, id, embedding, nearest_k`` of vectors with exactly their model's width, all finite, not all zero.

    Repeated rows count once. Models without a configuration, null ids and null vectors give nothing.
    """
    spans, configs = only(spans, "id", "embed_model", "embedding"), only(configs, "embed_model", "embed_dim", "nearest_k")
    wanted = configs.where(F.col("embed_model").isNotNull() & (F.col("embed_dim") > 0) & (F.col("nearest_k") > 0)).groupBy("embed_model").agg(F.max("embed_dim").alias("_dim"), F.max("nearest_k").alias("nearest_k"))
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        spans.where(F.col("id").isNotNull() & v.isNotNull())
        .select("embed_model", "id", "embedding")
        .join(F.broadcast(wanted), "embed_model")  # a row a model
        .where((F.size(v) == F.col("_dim")) & finite & F.exists(v, lambda x: x != 0))
        .groupBy("embed_model", "id", "nearest_k")
        .agg(F.min("embedding").alias("embedding"))
    )


def _matrix(column: pa.ChunkedArray | pa.Array, dtype: str = "<f4") -> np.ndarray:
    """Rows of equally long binaries as a matrix."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype).reshape(len(values), -1)


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, first by their greatest element, so that no length over- or underflows."""
    rows = rows.astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _rows_at_once(pivots: int) -> int:
    """Rows whose distances to all pivots fit in some tens of MB."""
    return max(64, 2_000_000 // max(1, pivots))


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Numbers of the ``prefix`` nearest pivots of each vector, nearest first."""
    out = np.empty((len(vectors), min(prefix, len(pivots))), np.int32)
    step = _rows_at_once(len(pivots))
    for lo in range(0, len(vectors), step):
        near = vectors[lo : lo + step] @ pivots.T
        width = out.shape[1]
        top = np.argpartition(-near, width - 1, axis=1)[:, :width] if width < near.shape[1] else np.tile(np.arange(near.shape[1]), (len(near), 1))
        order = np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable")
        out[lo : lo + step] = np.take_along_axis(top, order, 1)
    return out


def centres(sample: np.ndarray, wanted: int, rounds: int = ROUNDS) -> np.ndarray:
    """``wanted`` pivots: the first rows of the sample, moved to the centres of the rows nearest to them."""
    pivots = sample[:wanted]
    for _ in range(rounds if len(sample) > wanted else 0):
        total = np.zeros_like(pivots)
        step = _rows_at_once(len(pivots))
        for lo in range(0, len(sample), step):
            part = sample[lo : lo + step]
            np.add.at(total, (part @ pivots.T).argmax(axis=1), part)
        length = np.sqrt((total * total).sum(axis=1, keepdims=True))
        pivots = np.where(length > 1e-9, total / np.maximum(length, 1e-9), pivots)
    return pivots


def regions_of(pivots: np.ndarray, wanted: int) -> np.ndarray:
    """The region of each pivot: about ``wanted`` groups of neighbouring pivots, none with more than twice the mean number."""
    out = (pivots @ centres(pivots, max(1, min(wanted, len(pivots))), 8).T).argmax(axis=1)
    most = max(1, 2 * len(pivots) // max(1, wanted))
    todo, made = [np.flatnonzero(out == g) for g in np.unique(out)], 0
    while todo:
        rows = todo.pop()
        if len(rows) > most:  # halved across the line between two far members
            own = pivots[rows]
            a = own[(own @ own[0]).argmin()]
            b = own[(own @ a).argmin()]
            order = rows[np.argsort(own @ (b - a), kind="stable")]
            todo += [order[len(order) // 2 :], order[: len(order) // 2]]
            continue
        out[rows] = made
        made += 1
    return out.astype(np.int32)


def rank_classes(order: np.ndarray, pivots: int, ranks: tuple[int, ...] = RANKS) -> np.ndarray:
    """For each order (one a row) and each of ``ranks`` a row of 0 and 1: which pivots are among the nearest so many.

    The weight of a pivot in an order is the number of ``ranks`` it is within. With these weights the footrule distance
    of two orders is a constant less twice the sum of the smaller weights, and that sum is the product of their rows.
    """
    out = np.zeros((len(order), len(ranks) * pivots), np.uint8)
    rows = np.arange(len(order))[:, None]
    for i, most in enumerate(ranks):
        out[rows, i * pivots + order[:, :most]] = 1
    return out


def local_pivots(number: np.ndarray, wanted: int) -> np.ndarray:
    """Row numbers of a region's pivots, chosen by a hash of the rows' own numbers."""
    mixed = number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.argsort(mixed, kind="stable")[:wanted]


def search_region(vectors: np.ndarray, pivots: np.ndarray, asking: np.ndarray, k: int, rerank: int | None = RERANK) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, neighbour, cosine, pairs compared by cosine) of the ``asking`` rows of a region, given as row numbers.

    Rows come in the order in which ties are decided. Without ``rerank`` (for measurements only) all rows are compared.
    """
    n = len(vectors)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    compared = 0
    classes = rank_classes(nearest_pivots(vectors, pivots, RANKS[-1]), len(pivots)) if rerank and rerank < n - 1 else None
    step = max(1, min(1024, 64_000_000 // max(n, 1)))
    for lo in range(0, len(asking), step):
        some = asking[lo : lo + step]
        if classes is not None:
            affinity = np.empty((len(some), n), np.uint8)
            mine = classes[some].astype(np.float32)
            for at in range(0, n, 8192):
                affinity[:, at : at + 8192] = mine @ classes[at : at + 8192].astype(np.float32).T
            affinity[np.arange(len(some)), some] = 0
        for i, q in enumerate(some):
            near = np.argpartition(affinity[i], n - rerank)[n - rerank :] if classes is not None else np.arange(n)
            near = np.sort(near[near != q])
            compared += len(near)
            cosine = vectors[near] @ vectors[q]
            if k < len(near):
                first = np.flatnonzero(cosine >= np.partition(cosine, len(near) - k)[len(near) - k])
                near, cosine = near[first], cosine[first]
            best = np.argsort(-cosine, kind="stable")[:k]
            out.append((np.full(len(best), q), near[best], cosine[best]))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.float32), 0
    return *(np.concatenate([x[i] for x in out]) for i in range(3)), compared


class _Pass:
    """Global pivots and their regions for the models of one pass over the collection; regions are numbered over all its models."""

    def __init__(self, models: list[tuple[str, int, int]], samples: dict[str, np.ndarray]) -> None:
        self.pivots, self.region_of, self.ks = [], [], []
        self.model_of: list[int] = []
        for i, (model, n, k) in enumerate(models):
            own = centres(samples[model], _pivots_for(n))
            groups = regions_of(own, -(-n // max(REGION_ROWS, 4 * k)))
            self.pivots.append(own)
            self.region_of.append(groups + len(self.model_of))
            self.model_of += [i] * (int(groups.max()) + 1)
            self.ks.append(k)

    def regions(self, i: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(unit vectors, row, region, whether it asks there) of what is to be posted of rows of model ``i``."""
        unit = _unit(rows).astype(np.float32)
        region = self.region_of[i][nearest_pivots(unit, self.pivots[i], PREFIX)]
        seen = np.zeros(region.shape, bool)  # whether the region stands further to the left too
        for j in range(1, region.shape[1]):
            seen[:, j] = (region[:, :j] == region[:, j : j + 1]).any(axis=1)
        row, column = np.nonzero(~seen)
        first = np.searchsorted(row, row, "left")
        return unit, row, region[row, column], np.arange(len(row)) - first < ASKED


def _pivots_for(n: int) -> int:
    return int(min(PASS_PIVOTS, max(min(LEAST_PIVOTS, -(-n // 4)), n // PIVOT_ROWS)))


def _passes(models: list[tuple[str, int, int]]) -> list[list[tuple[str, int, int]]]:
    """The models in groups of at most ``PASS_PIVOTS`` pivots."""
    out: list[list[tuple[str, int, int]]] = []
    room = 0
    for m in models:
        if (pivots := _pivots_for(m[1])) > room:
            out.append([])
            room = PASS_PIVOTS
        out[-1].append(m)
        room -= pivots
    return out


def _samples(classes: DataFrame, models: list[tuple[str, int, int]]) -> dict[str, np.ndarray]:
    """Unit vectors of some rows of each model, chosen by the hash of their smallest id, in the order of that hash."""
    share = [(model, int(min(1.0, 1.2 * min(MAX_SAMPLE, _pivots_for(n) * SAMPLE_A_PIVOT) / n) * (1 << 30)) + 1) for model, n, _ in models]
    wanted = F.broadcast(classes.sparkSession.createDataFrame(share, "embed_model string, _share long"))  # a row a model
    picked = classes.withColumn("_h", F.xxhash64("rep")).join(wanted, "embed_model").where(F.pmod("_h", F.lit(1 << 30)) < F.col("_share"))
    rows = picked.select("embed_model", "_h", "rep", "embedding").toArrow()
    names = np.array(rows["embed_model"].to_pylist(), object)
    order = np.lexsort((np.array(rows["rep"].to_pylist(), str), rows["_h"].to_numpy()))
    vectors = rows["embedding"].combine_chunks()
    out = {}
    for model, n, _ in models:
        own = order[names[order] == model]
        if len(own) < min(n, _pivots_for(n)):
            raise RuntimeError(f"the sample of {model} is too small")
        out[model] = _unit(vectors.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)).astype(np.float32)
    return out


def nearest_vectors(vectors: DataFrame, rerank: int | None = RERANK) -> DataFrame:
    """``embed_model, id, rank, neighbor_id, similarity`` for rows of :func:`usable_vectors`.

    Ranks go by cosine, equal similarities to the smaller id. Each of equal vectors has its copies as neighbours
    first, the smallest ids ``nearest_k`` at most. A model with one vector gives no row.
    """
    members = cut(vectors.select("embed_model", "id", "nearest_k", "embedding", F.xxhash64("embed_model", "embedding").alias("c1"), F.hash(F.reverse("embedding"), "embed_model").alias("c2")))
    classes = members.groupBy("embed_model", "c1", "c2", "nearest_k").agg(F.min("id").alias("rep"), F.min("embedding").alias("embedding"), F.count(F.lit(1)).alias("copies"))
    # Numbers that order as the ids do, so that ties can be decided on them.
    classes = cut(classes.repartitionByRange("embed_model", "rep").sortWithinPartitions("embed_model", "rep").withColumn("number", F.monotonically_increasing_id()))
    counted = classes.groupBy("embed_model", "nearest_k").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a model
    met = None
    for group in _passes(sorted((r.embed_model, r.n, r.nearest_k) for r in counted)):
        one = _searched(classes, [m for m, *_ in group], _Pass(group, _samples(classes, group)), rerank)
        met = one if met is None else met.unionByName(one)
    if met is None:
        met = classes.sparkSession.createDataFrame([], "number long, other long, similarity float")
    return _expand(members, classes, met)


def _searched(classes: DataFrame, models: list[str], index: _Pass, rerank: int | None) -> DataFrame:
    """``number, other, similarity`` of the classes of some models."""
    spark = classes.sparkSession
    shared = spark.sparkContext.broadcast(index)
    numbers = F.broadcast(spark.createDataFrame(list(enumerate(models)), "model int, embed_model string"))  # a row a model

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            which = batch.column(0).to_numpy(zero_copy_only=False)
            ids = batch.column(1).to_numpy(zero_copy_only=False)
            for i in np.unique(which):
                at = np.flatnonzero(which == i)
                unit, row, to, asks = index.regions(i, batch.column(2).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1))
                raw = [r.tobytes() for r in unit]
                for lo in range(0, len(row), 16_384):
                    part = row[lo : lo + 16_384]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(to[lo : lo + 16_384]), pa.array(ids[at][part]), pa.array(asks[lo : lo + 16_384]), pa.array([raw[r] for r in part], pa.binary())], ["region", "number", "asks", "vector"]
                    )

    def search(keys: tuple, group: pa.Table) -> pa.Table:
        index = shared.value
        k = index.ks[index.model_of[keys[0].as_py()]]
        number = group["number"].to_numpy()
        by_number = np.argsort(number, kind="stable")
        number = number[by_number]
        rows = _matrix(group["vector"])[by_number]
        asking = np.flatnonzero(group["asks"].to_numpy()[by_number])
        q, other, cosine, _ = search_region(rows, rows[local_pivots(number, LOCAL_PIVOTS)], asking, k, rerank and max(rerank, 4 * k))
        return pa.table({"number": pa.array(number[q]), "other": pa.array(number[other]), "similarity": pa.array(cosine.astype(np.float32))})

    posted = classes.join(numbers, "embed_model").select("model", "number", "embedding").mapInArrow(post, "region int, number long, asks boolean, vector binary")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(index.model_of))
    return posted.repartition(tasks, "region").groupBy("region").applyInArrow(search, "number long, other long, similarity float")


def _expand(members: DataFrame, classes: DataFrame, met: DataFrame) -> DataFrame:
    """From the classes' neighbours, ``nearest_k`` at most for each in each region, to ranked neighbours of every row."""
    pairs = met.repartition("number").groupBy("number", "other").agg(F.max("similarity").alias("similarity"))
    info = classes.select("number", "embed_model", "nearest_k", "c1", "c2", "copies", "rep")
    best = Window.partitionBy("number").orderBy(F.desc("similarity"), "other")
    top = pairs.join(info.select("number", "nearest_k"), "number").withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= F.col("nearest_k"))
    # The nearest_k + 1 smallest ids of each class; most classes have one row only and need no window.
    several = info.where("copies > 1").select("number", "c1", "c2", "nearest_k", "embed_model")
    of_class = salted_join(members.select("c1", "c2", "embed_model", "id"), several, ["embed_model", "c1", "c2"], F.col("id"))
    first = of_class.withColumn("_r", F.row_number().over(Window.partitionBy("number").orderBy("id"))).where(F.col("_r") <= F.col("nearest_k") + 1).groupBy("number").agg(F.collect_list("id").alias("ids"))
    ids = info.select("number", "rep", "nearest_k", "copies").join(first, "number", "left").select("number", "nearest_k", F.coalesce("ids", F.array("rep")).alias("ids"))
    near = top.select("number", "other", "similarity").join(ids.select(F.col("number").alias("other"), "ids"), "other").select("number", "similarity", F.explode("ids").alias("neighbor_id"))
    own = ids.where(F.size("ids") > 1).select("number", F.lit(1.0).cast("float").alias("similarity"), F.explode("ids").alias("neighbor_id"))
    ranked = (
        near.unionByName(own)
        .groupBy("number")
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("far"), "neighbor_id"))).alias("near"))  # at most (nearest_k + 1)^2 of a class
        .join(info.select("number", "nearest_k", "c1", "c2", "embed_model"), "number")
        .select("embed_model", "c1", "c2", F.expr("slice(near, 1, nearest_k + 1)").alias("near"))
    )
    each = salted_join(members.select("embed_model", "c1", "c2", "id", "nearest_k"), ranked, ["embed_model", "c1", "c2"], F.col("id"))
    others = F.expr("slice(filter(near, x -> x.neighbor_id <> id), 1, nearest_k)")
    return each.select("embed_model", "id", F.posexplode(others).alias("_p", "_n")).select(
        "embed_model", "id", (F.col("_p") + 1).cast("int").alias("rank"), F.col("_n.neighbor_id").alias("neighbor_id"), (-F.col("_n.far")).cast("float").alias("similarity")
    )


def neighbor_pairs(neighbors: DataFrame) -> DataFrame:
    """``span_id_a, span_id_b`` (smaller first) of rows of which one is a neighbour of the other."""
    return neighbors.select(F.least("id", "neighbor_id").alias("span_id_a"), F.greatest("id", "neighbor_id").alias("span_id_b")).distinct()


def exact_recall(vectors: DataFrame, neighbors: DataFrame, every: int = 20) -> DataFrame:
    """``embed_model, queries, wanted, found, recall`` against brute force.

    Queries are the rows whose id's hash is divisible by ``every``; they are compared with all vectors, in blocks and in
    as many passes as their number takes.
    """
    corpus = vectors.select(F.col("embed_model").alias("tenant"), "id", F.lit("").alias("path"), F.lit(0).alias("start_line"), "embedding")
    asked = vectors.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0)
    most = vectors.agg(F.max("nearest_k")).first()[0] or 0
    near = retrieval.vector_topk(corpus, asked.select(F.col("id").alias("query_id"), F.col("embed_model").alias("tenant"), "embedding"), most + 1)
    near = near.where(F.col("id") != F.col("query_id")).withColumnRenamed("id", "neighbor_id").withColumnRenamed("query_id", "id")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("rank"))
    truth = near.withColumn("_r", rank).join(asked.select("embed_model", "id", "nearest_k"), "id").where(F.col("_r") <= F.col("nearest_k"))
    hit = truth.join(neighbors.select("embed_model", "id", "neighbor_id", F.lit(1).alias("_hit")), ["embed_model", "id", "neighbor_id"], "left")
    return hit.groupBy("embed_model").agg(F.countDistinct("id").alias("queries"), F.count(F.lit(1)).alias("wanted"), F.count("_hit").alias("found"), (F.count("_hit") / F.count(F.lit(1))).alias("recall"))
