"""The best rows of each question within its tenant, for sets of questions that grow with the corpus.

Questions and rows of a tenant meet in one task, small tenants many at a time, large ones cut into a grid of parts of
questions and parts of rows, so that a task is bounded whatever a tenant holds. Every pair is scored; a block of scores is
held at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import cut

#: Questions and rows of one part of a large tenant, rows of a group of small ones.
QUESTIONS_A_PART, ROWS_A_PART, ROWS_A_GROUP = 16_000, 32_000, 8_000
#: The same where both arms are asked at once: they are fused where they meet unless the rows of a tenant are cut.
QUESTIONS_OF_ARMS, ROWS_OF_ARMS = 8_000, 128_000
#: Rows whose words are looked up at once.
ROWS_A_BLOCK = 4_000
#: Scores held at once.
SCORES_A_BLOCK = 4_000_000
#: A term that this share of all pairs has is multiplied as a matrix, a rarer one is added where it occurs.
DENSE_SHARE = 0.001
#: Single precision is off by less in a cosine; what it leaves is compared in double precision.
MARGIN = 1e-4

Score = Callable[[pa.Table, pa.Table, int], pa.Table]
#: (question, row, value) of the best of one tenant, of where its questions and its rows are and how many.
Best = Callable[[int, int, int, int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]


def by_tenant(corpus: DataFrame, questions: DataFrame, score: Score, limit: int, schema: str, parts: tuple[int, int] | None = None) -> DataFrame:
    """What ``score(questions, rows, limit)`` gives of each group. Both frames have ``tenant, width``, which must agree in a pair.

    ``corpus`` has ``id``, ``questions`` ``query_id``. A question of a large tenant is answered once for each part of its rows;
    the rows that ``score`` gets have ``whole``, false where they are only a part of their tenant's. ``parts``: most questions
    and rows of a part.
    """
    most_questions, most_rows = parts or (QUESTIONS_A_PART, ROWS_A_PART)
    counts = corpus.groupBy("tenant").agg(F.count(F.lit(1)).alias("_n"))
    groups = max(1, -(-(counts.agg(F.sum("_n")).first()[0] or 0) // ROWS_A_GROUP))
    asked = questions.groupBy("tenant").agg(F.count(F.lit(1)).alias("_q"))
    large = asked.join(counts, "tenant").where((F.col("_q") > most_questions) | (F.col("_n") > most_rows))
    # At most one for each part's worth of questions or rows.
    large = F.broadcast(cut(large.select("tenant", F.ceil(F.col("_q") / most_questions).alias("_qs"), F.ceil(F.col("_n") / most_rows).alias("_rs"))))

    def placed(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        met = df.join(large, "tenant", "left").withColumns({
            "whole": F.coalesce("_rs", F.lit(1)) == 1,
            "_g": F.when(F.col("_qs").isNull(), F.pmod(F.xxhash64("tenant"), F.lit(groups))).otherwise(F.xxhash64("tenant")),
            f"{own}_part": F.pmod(F.xxhash64(key), F.coalesce(own, F.lit(1))),
        })
        return met.withColumn(f"{other}_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(other, F.lit(1)) - 1))).drop("_qs", "_rs")

    keys = ["_g", "_qs_part", "_rs_part"]
    left, right = placed(questions, "query_id", "_qs", "_rs").groupBy(*keys), placed(corpus, "id", "_rs", "_qs").groupBy(*keys)
    names = [c.split()[0] for c in schema.split(", ")]

    def meet(q: pa.Table, rows: pa.Table) -> pa.Table:
        return score(q, rows, limit).select(names)

    return left.cogroup(right).applyInArrow(meet, schema)


def _sorted(table: pa.Table, *ties: str) -> tuple[pa.Table, dict[tuple, tuple[int, int]]]:
    """The table by tenant, width and ``ties``, and where each (tenant, width) is."""
    table = table.take(pc.sort_indices(table, [(c, "ascending") for c in ("tenant", "width", *ties)], null_placement="at_start")).combine_chunks()
    n = table.num_rows
    if not n:
        return table, {}
    new = np.ones(n, bool)
    tenant, width = (_flat(table, c) for c in ("tenant", "width"))
    new[1:] = pc.or_(pc.not_equal(tenant.slice(1), tenant.slice(0, n - 1)), pc.not_equal(width.slice(1), width.slice(0, n - 1))).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(new)
    names = zip(tenant.take(pa.array(first)).to_pylist(), width.take(pa.array(first)).to_pylist())
    return table, dict(zip(names, zip(first.tolist(), [*first[1:].tolist(), n])))


def _flat(table: pa.Table, column: str) -> pa.Array:
    chunks = table[column].combine_chunks()
    return pa.concat_arrays(chunks.chunks) if isinstance(chunks, pa.ChunkedArray) else chunks


class _Top:
    """The ``limit`` best of each question seen so far: the greatest value, then the first row."""

    def __init__(self, questions: int, limit: int) -> None:
        self.limit, self.edge = limit, np.full(questions, -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size, self.most = 0, 3 * max(questions * limit, 10_000)

    def add(self, question: np.ndarray, row: np.ndarray, value: np.ndarray) -> None:
        self.held.append((question, row, value))
        self.size += len(question)
        if self.size > self.most:
            self.rows()

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        question, row, value = (np.concatenate(x) for x in zip(*self.held)) if self.held else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.lexsort((row, -value, question))
        question, row, value = question[order], row[order], value[order]
        place = np.arange(len(question)) - np.searchsorted(question, question, "left")
        last = place == self.limit - 1
        self.edge[question[last]] = value[last]
        kept = place < self.limit
        self.held = [(question[kept], row[kept], value[kept])]
        self.size = int(kept.sum())
        return self.held[0]


def _chosen(found: np.ndarray, at_least: np.ndarray, limit: int, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """(question, row) of a block that may be among the best: not below ``at_least`` nor ``limit`` others of the block."""
    mask = found >= at_least[:, None]
    if limit < found.shape[1] and np.count_nonzero(mask) > 4 * limit * len(found):
        mask &= found >= (np.partition(found, -limit, axis=1)[:, -limit] - found.dtype.type(margin))[:, None]
    return np.divmod(np.flatnonzero(mask), found.shape[1])


def _pairs(questions: pa.Table, rows: pa.Table) -> tuple[pa.Table, pa.Table, Iterator[tuple[int, int, int, int]]]:
    """Both in order, rows by path, first line and id, and where the questions and the rows of a tenant are."""
    questions, asked = _sorted(questions)
    rows, there = _sorted(rows, "path", "start_line", "id")
    return questions, rows, ((*at, *there[k]) for k, at in asked.items() if k in there)


def _table(questions: pa.Table, rows: pa.Table, found: list[tuple], value: str, kind: pa.DataType) -> pa.Table:
    question, row, values = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    at = pa.array(row)
    return pa.table({"query_id": questions["query_id"].take(pa.array(question)), **{c: rows[c].take(at) for c in ("id", "path", "start_line")}, value: pa.array(values).cast(kind)})


def terms_score(weights: dict[str, int]) -> Score:
    """Every occurrence of an asked term adds its column's weight. Questions have ``terms``; the columns hold words between single spaces."""

    def score(questions: pa.Table, rows: pa.Table, limit: int) -> pa.Table:
        questions, rows, pairs = _pairs(questions, rows)
        best = _terms(questions, rows, weights)
        return _table(questions, rows, [best(*at, limit) for at in pairs], "tenths", pa.int64())

    return score


def _terms(questions: pa.Table, rows: pa.Table, weights: dict[str, int]) -> Best:
    lists = _flat(questions, "terms")
    words = lists.flatten()
    vocabulary = pc.unique(words)
    asked = pc.index_in(words, value_set=vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    size, held = max(1, len(vocabulary)), ([], [], [])
    for first in range(0, max(1, rows.num_rows), ROWS_A_BLOCK):
        met, weight = [], []
        for column, w in weights.items():
            split = pc.split_pattern(_flat(rows.slice(first, ROWS_A_BLOCK), column), " ")
            term = pc.index_in(split.flatten(), value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(first, first + len(split)), split.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            met.append((row * size + term)[term >= 0])
            weight.append(np.full(len(met[-1]), w, np.float64))
        pair, at = np.unique(np.concatenate(met), return_inverse=True)
        for column, x in zip(held, (pair // size, pair % size, np.bincount(at, weights=np.concatenate(weight), minlength=len(pair)))):
            column.append(x.astype(np.int32))
    row, term, weight = np.concatenate(held[0]), np.concatenate(held[1]), np.concatenate(held[2])
    del held

    def best(qa: int, qb: int, ra: int, rb: int, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lo, hi = np.searchsorted(row, (ra, rb))
        q, r, value = _best_terms(asked[ends[qa] : ends[qb]], np.diff(ends[qa : qb + 1]), row[lo:hi] - ra, term[lo:hi], weight[lo:hi], rb - ra, limit)
        return q + qa, r + ra, value

    return best


def _best_terms(asked: np.ndarray, lengths: np.ndarray, row: np.ndarray, term: np.ndarray, weight: np.ndarray, rows: int, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(question, row, score) of one tenant: ``asked`` are the questions' terms one after another, (row, term, weight) the rows' by row."""
    n = len(lengths)
    best, known = _Top(n, limit), np.unique(asked)
    if not len(known):
        return best.rows()
    place = np.full(1 + max(int(known[-1]), int(term.max(initial=0))), -1, np.int32)
    place[known] = np.arange(len(known))
    place = place[term]
    if not (here := place >= 0).all():
        row, place, weight = row[here], place[here], weight[here]
    asker, asked = np.repeat(np.arange(n), lengths), np.searchsorted(known, asked)
    askers, holders = np.bincount(asked, minlength=len(known)), np.bincount(place, minlength=len(known))
    dense = (holders > 0) & (askers * holders.astype(np.float64) >= DENSE_SHARE * n * rows) if n * rows > 100_000 else holders > 0
    # Sums are whole numbers; single precision holds them up to 2 ** 24.
    exact = np.float32 if np.bincount(row, weights=weight, minlength=1).max() < 2**24 else np.float64
    column = np.cumsum(dense) - 1
    wanted = np.zeros((n, int(dense.sum())), exact)
    wanted[asker[dense[asked]], column[asked[dense[asked]]]] = 1
    by_term = np.argsort(asked, kind="stable")
    asker, starts = asker[by_term], np.concatenate([[0], np.cumsum(askers)])
    step = max(64, SCORES_A_BLOCK // n)
    for first in range(0, rows, step):
        last = min(rows, first + step)
        lo, hi = np.searchsorted(row, (first, last))
        r, t, w = row[lo:hi] - first, place[lo:hi], weight[lo:hi].astype(exact)
        held = np.zeros((last - first, wanted.shape[1]), exact)
        common = dense[t]
        held[r[common], column[t[common]]] = w[common]
        found = wanted @ held.T
        r, t, w = r[~common], t[~common], w[~common]
        times = askers[t]
        at = np.repeat(starts[t] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        np.add.at(found.reshape(-1), asker[at] * (last - first) + np.repeat(r, times), np.repeat(w, times))
        # Rows come in the order of ties: one that only equals the last of the best comes behind it.
        question, r = _chosen(found, np.maximum(best.edge, 0) + 1, limit, 0)
        best.add(question, r + first, found[question, r].astype(np.float64))
    return best.rows()


def cosine_score(questions: pa.Table, rows: pa.Table, limit: int) -> pa.Table:
    """Cosine of ``embedding``, ``width`` wide; NaN, which comes last, where one has no direction."""
    questions, rows, pairs = _pairs(questions, rows)
    best = _cosines(questions, rows)
    return _table(questions, rows, [best(*at, limit) for at in pairs], "similarity", pa.float64())


def _cosines(questions: pa.Table, rows: pa.Table) -> Best:
    def nearest(qa: int, qb: int, ra: int, rb: int, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        (q_at, q, q_norm, q_unit, q_lost), (v_at, v, v_norm, v_unit, v_lost) = (_vectors(t, a, b) for t, a, b in ((questions, qa, qb), (rows, ra, rb)))
        best = _Top(len(q_at), limit)
        for first in range(0, len(v_at) if len(q_at) else 0, step := max(64, SCORES_A_BLOCK // max(1, len(q_at)))):
            near = q_unit @ v_unit[first : first + step].T
            near[q_lost] = near[:, v_lost[(v_lost >= first) & (v_lost < first + step)] - first] = -3.0
            question, r = _chosen(near, (1 + best.edge - MARGIN).astype(np.float32), limit, MARGIN)
            for at in range(0, len(question), 100_000):  # each pair by itself, so that equal vectors are equally far
                i, j = question[at : at + 100_000], r[at : at + 100_000] + first
                with np.errstate(divide="ignore", invalid="ignore"):
                    far = 1 - (q[i].astype(np.float64) * v[j].astype(np.float64)).sum(1) / (q_norm[i] * v_norm[j])
                best.add(i, j, -np.where(np.isnan(far), np.inf, far))
        i, j, value = best.rows()
        return q_at[i], v_at[j], np.where(np.isinf(value), np.nan, 1 + value)

    return nearest


def _vectors(table: pa.Table, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(where one is, vectors, their norms, unit vectors in single precision, which have no direction) of some rows."""
    lists = _flat(table.slice(first, last - first), "embedding")
    at = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
    v = lists.flatten().to_numpy(zero_copy_only=False)
    v = v.reshape(len(at), len(v) // max(1, len(at)))
    norm, unit = np.empty(len(v)), np.empty(v.shape, np.float32)
    for lo in range(0, len(v), ROWS_A_BLOCK):
        block = v[lo : lo + ROWS_A_BLOCK].astype(np.float64)
        norm[lo : lo + len(block)] = length = np.sqrt((block * block).sum(1))
        with np.errstate(divide="ignore", invalid="ignore"):
            unit[lo : lo + len(block)] = block / length[:, None]
    lost = np.flatnonzero(np.isnan(unit).any(1))
    unit[lost] = 0
    return at + first, v, norm, unit, lost


def arms_score(weights: dict[str, int], depth: int, k: float, vector: float, lexical: float) -> Score:
    """Both arms, ``depth`` deep: what is within ``limit`` of the fused or of the lexical order, as :func:`retrieval.fuse` orders it.

    Of rows that are not ``whole`` everything that an arm found, to be ranked when all parts are there. Questions have ``terms,
    embedding``, rows ``whole, embedding`` and the columns of ``weights``; their order decides ties.
    """

    def score(questions: pa.Table, rows: pa.Table, limit: int) -> pa.Table:
        questions, rows, pairs = _pairs(questions, rows)
        pairs = list(pairs)

        def found(best: Best) -> list[np.ndarray]:
            return [np.concatenate(x) for x in zip(*[best(*at, depth) for at in pairs])] or [np.zeros(0, np.int64)] * 3

        lq, lr, tenths = found(_terms(questions, rows, weights))  # one arm's arrays are freed before the other's are made
        rows = rows.drop_columns(list(weights))
        vq, vr, similarity = found(_cosines(questions, rows))
        v_rank, l_rank = _ranks(vq, np.where(np.isnan(similarity), np.inf, 1 - similarity), vr), _ranks(lq, -tenths, lr)
        n = max(1, rows.num_rows)
        pair, at = np.unique(np.concatenate([vq * n + vr, lq * n + lr]), return_inverse=True)
        question, row = pair // n, pair % n
        in_v, in_l = at[: len(vq)], at[len(vq) :]
        by_v, by_l, value, sums = (np.zeros(len(pair), kind) for kind in (np.int32, np.int32, np.float64, np.int64))
        by_v[in_v], by_l[in_l], value[in_v], sums[in_l] = v_rank, l_rank, similarity, tenths
        fused = np.where(by_v > 0, vector / (k + by_v), 0.0) + np.where(by_l > 0, lexical / (k + by_l), 0.0)
        rank = _ranks(question, -fused, row)
        top, ran = np.zeros(questions.num_rows), np.zeros(questions.num_rows, bool)
        top[vq[v_rank == 1]], ran[vq] = similarity[v_rank == 1], True
        whole = _flat(rows, "whole").to_numpy(zero_copy_only=False)[row]
        kept = ~whole | (rank <= limit) | ((by_l > 0) & (by_l <= limit))
        question, row, by_v, by_l = question[kept], row[kept], by_v[kept], by_l[kept]
        masked = lambda x, missing: pa.array(x, mask=missing, from_pandas=False)
        return pa.table({
            "query_id": questions["query_id"].take(pa.array(question)), "id": rows["id"].take(pa.array(row)), "whole": pa.array(whole[kept]), "rank": pa.array(rank[kept]), "vector_rank": pa.array(by_v), "lexical_rank": pa.array(by_l),
            "top_score": masked(top[question].astype(np.float32).astype(np.float64), ~ran[question]), "similarity": masked(value[kept], by_v == 0), "tenths": masked(sums[kept], by_l == 0),
        })

    return score


def _ranks(question: np.ndarray, value: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Ranks within a question from 1 on: the least value, then the first row."""
    order = np.lexsort((row, value, question))
    sorted_question = question[order]
    out = np.empty(len(order), np.int32)
    out[order] = np.arange(len(order)) - np.searchsorted(sorted_question, sorted_question, "left") + 1
    return out
