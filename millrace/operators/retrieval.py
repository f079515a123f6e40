"""Ranked retrieval for many questions at once: vectors, weighted terms, fusion, decision, assembly.

Corpora are not bounded. Each arm broadcasts a stated set of questions and scans the corpus; a task keeps the best of each
question over all its rows, so that at most questions x limit x tasks rows are shuffled. Sets of more than
``MOST_BROADCAST`` questions meet the rows of their tenants (:mod:`millrace.operators.tenants`). Ranks are total: distance or
score, then path, first line and id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from millrace.functions import text as T
from millrace.operators import tenants
from millrace.session import cut

#: Weights of a term in a symbol and in a text (fixed values).
SYMBOL_WEIGHT, TEXT_WEIGHT = 1.0, 0.4
SYMBOL_TENTHS, TEXT_TENTHS = 10, 4
TENTHS = {"symbol": SYMBOL_TENTHS, "text": TEXT_TENTHS}
#: Questions that are broadcast; more meet the rows by tenant.
MOST_BROADCAST = 20_000


@dataclass(frozen=True)
class Fusion:
    """Reciprocal-rank fusion: constant and weights of the two arms."""

    k: float = 60.0
    vector: float = 1.0
    lexical: float = 1.0

    def __post_init__(self) -> None:
        values = (self.k, self.vector, self.lexical)
        if any(math.isnan(x) or x < 0 for x in values) or not (self.vector or self.lexical):
            raise ValueError("k and weights are at least 0, and not both weights are 0")


@dataclass(frozen=True)
class Budget:
    """Most spans and most bytes of an answer."""

    spans: int = 5
    size: int = 8000

    def __post_init__(self) -> None:
        if self.spans < 1 or self.size < 1:
            raise ValueError("an answer needs room for a span")


def check_search(mode: str, candidates: int, limit: int) -> None:
    if mode not in ("vector", "lexical", "hybrid"):
        raise ValueError(f"no such mode: {mode}")
    if candidates < 1 or limit < 1:
        raise ValueError("depth and limit are at least 1")


def check_question(question: str, limit: int = 10) -> str:
    """The question without space around it: 1 to 1000 bytes, with a term, at most 50 results."""
    bare = question.strip()
    if not 1 <= len(bare.encode()) <= 1000:
        raise ValueError("a question has 1 to 1000 bytes")
    if not any(c.isalnum() for c in bare):
        raise ValueError("a question has a letter or a digit")
    if not 1 <= limit <= 50:
        raise ValueError("the limit is 1 to 50")
    return bare


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine in double precision, NaN for a zero vector, null for vectors of different length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) != F.size(b), None).otherwise(F.coalesce(F.try_divide(dot(a, b), norm), F.lit(float("nan"))))


def check_width(vectors: DataFrame, dim: int) -> DataFrame:
    """The vectors; raises, on use, for one of another width. Missing ones pass."""
    wrong = F.col("embedding").isNotNull() & (F.size("embedding") != dim)
    message = F.concat(F.lit(f"not {dim} wide: "), F.col("id").cast("string"))
    return vectors.withColumn("embedding", F.when(wrong, F.raise_error(message)).otherwise(F.col("embedding")))


def vector_from_text(text: Column) -> Column:
    """``[1,-0.5]`` as a vector, null for anything else."""
    return F.from_json(text, "array<float>")


def vector_to_text(vector: Column) -> Column:
    return F.to_json(vector)


def clipped(rows: DataFrame, limit: int) -> tuple[list, bool]:
    """At most ``limit`` rows in their order, and whether there are more."""
    found = rows.limit(limit + 1).collect()
    return found[:limit], len(found) > limit


def embedder_of(corpus: DataFrame) -> tuple[str, int]:
    """Model and width of a corpus; refuses one without vectors and one that mixes them."""
    found = corpus.where(F.col("embedding").isNotNull()).select("embed_model", "embed_dim").distinct().limit(2).collect()
    if not found:
        raise LookupError("the corpus has no vectors")
    if len(found) > 1:
        raise ValueError("the corpus mixes embedders")
    return found[0].embed_model, found[0].embed_dim


def vector_topk(corpus: DataFrame, questions: DataFrame, limit: int) -> DataFrame:
    """``query_id, rank, id, similarity`` of the ``limit`` nearest of a question's tenant.

    ``corpus``: ``tenant, id, path, start_line, embedding``; ``questions``: ``query_id, tenant, embedding``. Rows without a vector
    or with another width are no candidates; a zero vector has no direction: its distance is NaN and comes last.
    """
    asked = questions.where(F.col("embedding").isNotNull() & F.col("tenant").isNotNull()).select("query_id", "tenant", "embedding")
    if asked.count() > MOST_BROADCAST:
        rows = corpus.where(F.col("embedding").isNotNull() & F.col("id").isNotNull()).select("tenant", F.size("embedding").alias("width"), "id", "path", F.col("start_line").cast("int").alias("start_line"), "embedding")
        schema = f"query_id {dict(asked.dtypes)['query_id']}, id {dict(corpus.dtypes)['id']}, path string, start_line int, similarity double"
        out = tenants.by_tenant(rows, asked.withColumn("width", F.size("embedding")), tenants.cosine_score, limit, schema)
    else:
        out = _vector_pass(corpus, questions, [(r.query_id, r.tenant, r.embedding) for r in asked.collect()], limit)
    return _nearest(out, limit, "path", "start_line", "id")


def _nearest(found: DataFrame, limit: int, *ties: str) -> DataFrame:
    far = F.when(F.isnan("similarity"), float("inf")).otherwise(1 - F.col("similarity"))
    order = Window.partitionBy("query_id").orderBy(far, *ties)
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return ranked.select("query_id", "rank", "id", F.col("similarity").cast("float").cast("double").alias("similarity"))


class _Best:
    """The best ``limit`` rows of each question seen so far: the smallest ``far``, then path, first line and id."""

    def __init__(self, questions: int, limit: int) -> None:
        self.limit, self.edge = limit, np.full(questions, np.inf)
        self.held: list[pa.Table] = []
        self.most = 2 * max(questions * limit, 10_000)
        self.size = 0

    def add(self, question: np.ndarray, far: np.ndarray, at: np.ndarray, batch: pa.RecordBatch) -> None:
        """Rows ``at`` of a batch (id, path and first line in its columns 1 to 3); those beyond ``edge`` need not come."""
        if not len(question):
            return
        where = pa.array(at)
        self.held.append(pa.table([pa.array(question), pa.array(far), *(batch.column(c).take(where) for c in (1, 2, 3))], names=["question", "far", "id", "path", "start_line"]))
        self.size += len(question)
        if self.size > self.most:
            self._shrink()

    def _shrink(self) -> None:
        rows = pa.concat_tables(self.held)
        order = pc.sort_indices(rows, [(c, "ascending") for c in ("question", "far", "path", "start_line", "id")], null_placement="at_start")
        question = rows["question"].to_numpy()[order.to_numpy()]
        place = np.arange(len(question)) - np.searchsorted(question, question, "left")
        rows = rows.take(pc.filter(order, pa.array(place < self.limit))).combine_chunks()
        last = place == self.limit - 1
        self.edge[question[last]] = rows["far"].to_numpy()[last[place < self.limit]]
        self.held, self.size = [rows], rows.num_rows

    def rows(self) -> pa.Table | None:
        if self.held:
            self._shrink()
        return self.held[0] if self.held else None


def _vector_pass(corpus: DataFrame, questions: DataFrame, asked: list[tuple], limit: int) -> DataFrame:
    groups: dict[tuple, list[tuple]] = {}
    for q, tenant, v in asked:
        groups.setdefault((tenant, len(v)), []).append((q, v))
    shared = corpus.sparkSession.sparkContext.broadcast({g: ([q for q, _ in rows], np.array([v for _, v in rows], np.float64)) for g, rows in groups.items()})
    kinds = dict(corpus.dtypes)
    query_kind = dict(questions.dtypes)["query_id"]
    query_type = to_arrow_type(questions.schema["query_id"].dataType)
    schema = f"query_id {query_kind}, id {kinds['id']}, path string, start_line int, similarity double"

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrices, best = shared.value, {}
        for batch in batches:
            tenants, widths = batch.column(0).to_pylist(), batch.column(4).value_lengths().to_pylist()
            keys: dict[tuple, list[int]] = {}
            for i, g in enumerate(zip(tenants, widths)):
                if g in matrices:
                    keys.setdefault(g, []).append(i)
            for g, rows in keys.items():
                ids, q = matrices[g]
                own = best.setdefault(g, _Best(len(ids), limit))
                for lo in range(0, len(rows), step := max(1, 4_000_000 // len(ids))):
                    at = np.array(rows[lo : lo + step])
                    block = batch.column(4).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1).astype(np.float64)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        sim = (q @ block.T) / (np.sqrt((q * q).sum(1))[:, None] * np.sqrt((block * block).sum(1))[None, :])
                    far = np.where(np.isnan(sim), np.inf, 1 - sim)
                    edge = np.minimum(own.edge, np.partition(far, limit - 1, axis=1)[:, limit - 1]) if limit < len(at) else own.edge
                    row, col = np.nonzero(far <= edge[:, None])  # ties with the last one stay until all are in order
                    own.add(row, far[row, col], at[col], batch)
        for g, own in best.items():
            if (rows := own.rows()) is not None:
                ids = matrices[g][0]
                far = rows["far"].to_numpy()
                similarity = pa.array(np.where(np.isinf(far), np.nan, 1 - far))
                out = pa.table([pa.array([ids[i] for i in rows["question"].to_pylist()], query_type), rows["id"], rows["path"], rows["start_line"], similarity], names=["query_id", "id", "path", "start_line", "similarity"])
                yield from out.to_batches(max_chunksize=10_000)

    rows = corpus.where(F.col("embedding").isNotNull() & F.col("id").isNotNull()).select("tenant", "id", "path", F.col("start_line").cast("int"), "embedding")
    return rows.mapInArrow(nearest, schema)


def _words(column: str) -> Column:
    """Letter and digit runs in lower case."""
    return F.transform(F.regexp_extract_all(F.coalesce(F.col(column), F.lit("")), F.lit(r"([\p{L}\p{Nd}]+)"), 1), F.lower)


def _spaced(column: str) -> Column:
    """The words between single spaces."""
    return F.array_join(_words(column), " ").alias(column)


def postings(spans: DataFrame, keys: list[str], symbol: str, text: str) -> DataFrame:
    """``keys, term, weight, tf``: letter and digit runs in lower case, of symbol and text; no stop words, no stems."""
    both = F.concat(
        F.transform(_words(symbol), lambda w: F.struct(w.alias("term"), F.lit(SYMBOL_WEIGHT).alias("weight"))),
        F.transform(_words(text), lambda w: F.struct(w.alias("term"), F.lit(TEXT_WEIGHT).alias("weight"))),
    )
    return spans.select(*keys, F.explode(both).alias("_p")).groupBy(*keys, "_p.term", "_p.weight").agg(F.count(F.lit(1)).alias("tf"))


def question_terms(questions: DataFrame, split_identifiers: bool = True) -> DataFrame:
    """``query_id, tenant, term`` of ``query_id, tenant, q``."""
    return questions.select("query_id", "tenant", F.explode(T.terms(F.col("q"), split_identifiers)).alias("term"))


def lexical_topk(index: DataFrame, asked: DataFrame, limit: int) -> DataFrame:
    """``query_id, rank, id, score``: any term may match, every occurrence adds its weight.

    ``index``: postings with ``tenant, id, path, start_line``; ``asked``: :func:`question_terms`.
    """
    # Counted in tenths, so that the sum doesn't depend on the order of rows.
    tenths = F.round(F.col("weight") * 10).cast("long") * F.col("tf")
    scored = index.join(asked, ["tenant", "term"]).groupBy("query_id", "id", "path", "start_line").agg(F.sum(tenths).alias("_s"))
    order = Window.partitionBy("query_id").orderBy(F.desc("_s"), "path", "start_line", "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "rank", "id", (F.col("_s") / 10).alias("score"))


#: Scores held at once while a block is scanned.
SCORES_A_BLOCK = 4_000_000


def lexical_scan(corpus: DataFrame, asked: DataFrame, limit: int) -> DataFrame:
    """What :func:`lexical_topk` gives, by one scan of ``corpus`` (``tenant, id, path, start_line, symbol, text``) without an index.

    The questions' terms go to every task, each keeps the best of each question over all its rows; nothing is shuffled but
    those. For a stated set of questions this saves the join in which frequent terms meet; a larger set meets the rows
    of its tenants.
    """
    questions = asked.where(F.col("tenant").isNotNull() & (F.col("term") != "")).groupBy("query_id", "tenant").agg(F.collect_set("term").alias("terms"))
    few = questions.limit(MOST_BROADCAST + 1).collect()
    if len(few) > MOST_BROADCAST:
        rows = corpus.where(F.col("id").isNotNull()).select("tenant", F.lit(0).alias("width"), "id", "path", F.col("start_line").cast("int").alias("start_line"), _spaced("symbol"), _spaced("text"))
        schema = f"query_id {dict(asked.dtypes)['query_id']}, id {dict(corpus.dtypes)['id']}, path string, start_line int, tenths long"
        out = tenants.by_tenant(rows, cut(questions.withColumn("width", F.lit(0))), tenants.terms_score(TENTHS), limit, schema)
    else:
        out = _lexical_pass(corpus, asked, [(r.query_id, r.tenant, term) for r in few for term in r.terms], limit)
    return _most(out, limit, "path", "start_line", "id")


def _most(found: DataFrame, limit: int, *ties: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("tenths"), *ties)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "rank", "id", (F.col("tenths") / 10).alias("score"))


def _asked(rows: list[tuple]) -> tuple[list, list[str], np.ndarray, np.ndarray]:
    """(questions, terms, where each term's questions begin, their numbers) of (question, term) rows."""
    queries = sorted({q for q, _ in rows}, key=repr)
    number = {q: i for i, q in enumerate(queries)}
    askers: dict[str, list[int]] = {}
    for q, term in rows:
        askers.setdefault(term, []).append(number[q])
    counts = [len(x) for x in askers.values()]
    return queries, list(askers), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), np.array([q for x in askers.values() for q in x], np.int64)


def _lexical_pass(corpus: DataFrame, asked: DataFrame, wanted: list[tuple], limit: int) -> DataFrame:
    grouped: dict[object, list[tuple]] = {}
    for q, tenant, term in wanted:
        grouped.setdefault(tenant, []).append((q, term))
    shared = corpus.sparkSession.sparkContext.broadcast({t: _asked(rows) for t, rows in grouped.items()})
    kinds = dict(corpus.dtypes)
    query_type = to_arrow_type(asked.schema["query_id"].dataType)
    schema = f"query_id {dict(asked.dtypes)['query_id']}, id {kinds['id']}, path string, start_line int, tenths long"

    def scores(batch: pa.RecordBatch, at: np.ndarray, terms: pa.Array, starts: np.ndarray, askers: np.ndarray, queries: int) -> np.ndarray:
        """(row, question) scores of some rows: every occurrence of a term adds its weight to the questions that ask for it."""
        out = np.zeros(len(at) * queries)
        for column, weight in ((4, SYMBOL_TENTHS), (5, TEXT_TENTHS)):
            words = batch.column(column).take(pa.array(at))
            term = pc.index_in(words.flatten(), value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(at)), words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))[term >= 0]
            pair, times = np.unique(row * len(terms) + term[term >= 0], return_counts=True)
            row, term = pair // len(terms), pair % len(terms)
            n = starts[term + 1] - starts[term]
            first = np.repeat(starts[term] - (np.cumsum(n) - n), n)
            question = askers[first + np.arange(int(n.sum()))]
            out += np.bincount(np.repeat(row, n) * queries + question, weights=np.repeat(times, n) * weight, minlength=len(out))
        return out.astype(np.int64).reshape(len(at), queries)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_tenant, kept = shared.value, {}
        for batch in batches:
            rows_of: dict[object, list[int]] = {}
            for i, tenant in enumerate(batch.column(0).to_pylist()):
                if tenant in of_tenant:
                    rows_of.setdefault(tenant, []).append(i)
            for tenant, rows in rows_of.items():
                queries, terms, starts, askers = of_tenant[tenant]
                own = kept.setdefault(tenant, _Best(len(queries), limit))
                terms = pa.array(terms, pa.string())
                for lo in range(0, len(rows), step := max(1, SCORES_A_BLOCK // len(queries))):
                    at = np.array(rows[lo : lo + step])
                    found = scores(batch, at, terms, starts, askers, len(queries))
                    edge = np.maximum(1, np.where(np.isinf(own.edge), 1, -own.edge))
                    if limit < len(found):
                        edge = np.maximum(edge, -np.partition(-found, limit - 1, axis=0)[limit - 1])
                    row, col = np.nonzero(found >= edge[None, :])
                    own.add(col, -found[row, col].astype(np.float64), at[row], batch)
        for tenant, own in kept.items():
            if (rows := own.rows()) is not None:
                queries = of_tenant[tenant][0]
                tenths = pa.array(-rows["far"].to_numpy()).cast(pa.int64())
                out = pa.table([pa.array([queries[i] for i in rows["question"].to_pylist()], query_type), rows["id"], rows["path"], rows["start_line"], tenths], names=["query_id", "id", "path", "start_line", "tenths"])
                yield from out.to_batches(max_chunksize=10_000)

    return corpus.where(F.col("id").isNotNull()).select("tenant", "id", "path", F.col("start_line").cast("int"), _words("symbol").alias("symbol"), _words("text").alias("text")).mapInArrow(best, schema)


def fuse(vector: DataFrame, lexical: DataFrame, places: DataFrame | None, fusion: Fusion, limit: int) -> DataFrame:
    """Weighted reciprocal-rank fusion: ``query_id, rank, id, score, vector_score, vector_rank, lexical_rank``.

    An arm that did not return a span adds nothing and has rank 0; a weight of 0 keeps the arm's rows. ``places``: ``id, path,
    start_line`` for the ties; without them ties go by id.
    """
    v = vector.select("query_id", "id", F.col("rank").alias("vector_rank"), F.col("similarity").alias("vector_score"))
    lex = lexical.select("query_id", "id", F.col("rank").alias("lexical_rank"))
    share = lambda w, r: F.when(F.col(r).isNull(), 0.0).otherwise(F.lit(w) / (F.lit(fusion.k) + F.col(r)))
    arms = v.unionByName(lex, allowMissingColumns=True).repartition("query_id")  # for the span and for the rank, in one
    both = arms.groupBy("query_id", "id").agg(*[F.max(c).alias(c) for c in ("vector_rank", "vector_score", "lexical_rank")])
    both = both.withColumn("score", share(fusion.vector, "vector_rank") + share(fusion.lexical, "lexical_rank"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *(["id"] if places is None else ["path", "start_line", "id"]))
    ranked = (both if places is None else both.join(places, "id")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return ranked.select("query_id", "rank", "id", "score", "vector_score", F.coalesce("vector_rank", F.lit(0)).alias("vector_rank"), F.coalesce("lexical_rank", F.lit(0)).alias("lexical_rank"))


def both_arms(corpus: DataFrame, questions: DataFrame, depth: int, fusion: Fusion, limit: int) -> DataFrame:
    """``query_id, id, rank, vector_rank, lexical_rank, top_score`` of what is within ``limit`` of the fused or of the lexical order.

    Both arms go ``depth`` deep; ``top_score`` is the best similarity of the question, null where the vector arm found nothing.
    ``corpus``: ``tenant, id, symbol, text, embedding`` with numbers as ids, whose order decides ties; ``questions``: ``query_id,
    tenant, q, embedding``, all vectors of one width. Many questions meet the rows of their tenant once for both arms.
    """
    asked = questions.where(F.col("tenant").isNotNull() & F.col("query_id").isNotNull())
    rows = corpus.where(F.col("id").isNotNull()).withColumns({"path": F.lit(""), "start_line": F.lit(0)})

    def leading(vector: DataFrame, lexical: DataFrame) -> DataFrame:
        top = F.max(F.when(F.col("vector_rank") == 1, F.col("vector_score"))).over(Window.partitionBy("query_id"))
        both = fuse(vector, lexical, None, fusion, 2 * depth).withColumn("top_score", top)
        return both.where((F.col("rank") <= limit) | F.col("lexical_rank").between(1, limit)).select("query_id", "id", "rank", "vector_rank", "lexical_rank", "top_score")

    if asked.count() <= MOST_BROADCAST:
        return cut(leading(vector_topk(rows, asked, depth), lexical_scan(rows, question_terms(asked), depth)))
    terms = F.filter(T.terms(F.col("q"), True), lambda w: w != "").alias("terms")
    width = F.lit(0).alias("width")
    schema = "query_id long, id long, whole boolean, rank int, vector_rank int, lexical_rank int, top_score double, similarity double, tenths long"
    met = cut(tenants.by_tenant(
        rows.select("tenant", width, F.col("id").cast("long").alias("id"), "path", "start_line", _spaced("symbol"), _spaced("text"), "embedding"),
        asked.select("tenant", width, F.col("query_id").cast("long").alias("query_id"), terms, "embedding"),
        tenants.arms_score(TENTHS, depth, fusion.k, fusion.vector, fusion.lexical), limit, schema, (tenants.QUESTIONS_OF_ARMS, tenants.ROWS_OF_ARMS),
    ))
    done, parts = met.where("whole").drop("whole", "similarity", "tenths"), met.where("NOT whole")
    if not parts.limit(1).count():
        return done
    vector, lexical = _nearest(parts.where("similarity IS NOT NULL"), depth, "id"), _most(parts.where("tenths IS NOT NULL"), depth, "id")
    return done.unionByName(cut(leading(vector, lexical)))


def decide(summary: DataFrame, floor: float) -> DataFrame:
    """``outcome, reason`` for rows with ``hits, top_score, vector_ran``; a score on the floor is good enough."""
    top = F.col("top_score").cast("float").cast("double")
    why = (
        F.when(F.col("hits") == 0, "no_spans")
        .when(~F.col("vector_ran"), F.lit(None))
        .when(top.isNull() | F.isnan(top), "unscored")
        .when(top < F.lit(floor), "below_floor")
    )
    return summary.withColumn("reason", why).withColumn("outcome", F.when(F.col("reason").isNull(), "answered").otherwise("refused"))


def assemble(ranked: DataFrame, spans: DataFrame, budget: Budget) -> DataFrame:
    """``query_id, answer, cited, dropped``: numbered blocks of the best spans that fit.

    Blocks go in by rank until one would exceed the number of spans or of bytes; the first always goes in. Hits
    without a span are dropped and don't count. ``spans``: ``id, path, symbol, start_line, end_line, text``.
    """
    met = ranked.select("query_id", "rank", "id").join(spans.withColumn("_there", F.lit(True)), "id", "left")
    by_rank = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    met = met.withColumn("n", F.count("_there").over(by_rank))
    name = F.when(F.coalesce("symbol", F.lit("")) != "", F.concat(F.lit(" ("), F.col("symbol"), F.lit(")"))).otherwise("")
    head = F.concat(F.lit("["), F.col("n"), F.lit("] "), F.col("path"), F.lit(":"), F.col("start_line"), F.lit("-"), F.col("end_line"), name, F.lit("\n"))
    met = met.withColumn("block", F.when(F.col("_there"), F.concat(head, F.col("text"))))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    met = met.withColumn("_total", F.sum(size).over(by_rank))
    too_much = F.col("_there") & (F.col("n") > 1) & ((F.col("n") > budget.spans) | (F.col("_total") > budget.size))
    met = met.withColumn("_over", F.coalesce(F.max(too_much.cast("int")).over(by_rank), F.lit(0)))
    kept = F.col("_there") & (F.col("_over") == 0)
    return met.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(kept, F.struct("n", "block")))), lambda x: x.block), "\n\n").alias("answer"),
        F.count_if(F.coalesce(kept, F.lit(False))).alias("cited"),
        F.count_if(~F.coalesce(kept, F.lit(False))).alias("dropped"),
    )
