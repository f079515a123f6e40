"""Scoring a retriever: gold spans, hits, reciprocal ranks, refusal floors, exact quantiles, leaks, bootstrap."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators.graph import overlapping
from millrace.operators.retrieval import Budget, decide

#: Buckets of the first pass of exact quantiles.
QUANTILE_BUCKETS = 4096


def gold(cases: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """``case_id, lenient, strict``: how many spans meet a case's lines, and the one that shares most of them.

    Equal shares go to the earlier start, then the earlier end, then the smaller id. ``cases``: ``keys, case_id, start_line,
    end_line``; ``spans``: ``keys, id, r_start, r_end``.
    """
    met = overlapping(cases, spans, keys)
    shared = F.least("end_line", "r_end") - F.greatest("start_line", "r_start") + 1
    best = F.min(F.struct((-shared).alias("s"), F.col("r_start").alias("a"), F.col("r_end").alias("b"), F.col("id").alias("id")))
    found = met.groupBy("case_id").agg(F.countDistinct("id").alias("lenient"), best.alias("_b"))
    return found.select("case_id", "lenient", F.col("_b.id").alias("strict"), (-F.col("_b.s")).cast("int").alias("shared_lines"))


def summaries(records: DataFrame, keys: list[str], ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """The scores of each arm over its scoreable cases, and how many were not.

    ``records`` has ``scoreable, gold_rank, answer_has_gold``. Further scores are added for the columns that are there:
    ``gold_rank_strict`` (rank of the one best span), ``gold`` (spans that meet the case), ``gold_vector_rank`` and
    ``gold_lexical_rank`` (which arm found the gold), ``moved`` and ``grouped`` (counted over all cases). Rank 0 or null is
    a miss and counts 0 in a mean; without scoreable cases rates are null and means 0.
    """
    have, scored = set(records.columns), F.coalesce("scoreable", F.lit(False))
    rate = lambda rank, k: F.round(F.avg(F.when(scored, F.coalesce(F.col(rank).between(1, k), F.lit(False)).cast("double"))), 9)
    reciprocal = lambda rank: F.round(F.coalesce(F.avg(F.when(scored, F.when(F.col(rank) > 0, F.lit(1.0) / F.col(rank)).otherwise(0.0))), F.lit(0.0)), 9)
    out = [F.count(F.lit(1)).alias("cases"), F.count_if(~scored).alias("unscoreable"), *[rate("gold_rank", k).alias(f"hit_at_{k}") for k in ks], reciprocal("gold_rank").alias("mrr")]
    if "gold_rank_strict" in have:
        out += [*[rate("gold_rank_strict", k).alias(f"strict_hit_at_{k}") for k in ks], reciprocal("gold_rank_strict").alias("strict_mrr")]
    if "gold" in have:
        out.append(F.round(F.coalesce(F.avg(F.when(scored, F.col("gold").cast("double"))), F.lit(0.0)), 9).alias("mean_gold"))
    if {"gold_vector_rank", "gold_lexical_rank"} <= have:
        found, vector, lexical = scored & (F.col("gold_rank") > 0), F.coalesce(F.col("gold_vector_rank") > 0, F.lit(False)), F.coalesce(F.col("gold_lexical_rank") > 0, F.lit(False))
        by = {"by_both": vector & lexical, "by_vector_only": vector & ~lexical, "by_lexical_only": ~vector & lexical}
        out += [F.count_if(found & which).alias(f"gold_found_{name}") for name, which in by.items()]
        out.append(F.count_if(scored & ~F.coalesce(F.col("gold_rank") > 0, F.lit(False))).alias("gold_not_found"))
    out += [F.count_if(F.col(c)).alias(f"{c}_cases") for c in ("moved", "grouped") if c in have]
    return records.groupBy(*keys).agg(*out, F.count_if(scored & F.col("answer_has_gold")).alias("answers_with_gold"))


def floor_sweep(outcomes: DataFrame, keys: list[str], floors: int = 201) -> DataFrame:
    """What the refusal rule would have done at each floor from -1 to 1, and for which reasons.

    A case without gold is unscoreable, whatever else holds. Of the others those without hits are refused (``no_spans``),
    those whose vector arm did not run are answered, those without a score are refused (``unscored``), and the score
    decides the rest (``below_floor``). ``with_gold`` and ``without_gold`` are about the answer, not the ranks. ``applicable``
    is false where no vector arm ever ran, so that no floor is read. Outcomes are counted once by the highest floor
    they pass; the sweep is a running sum over ``floors`` and a few more rows a key.
    """
    step = 2.0 / (floors - 1)
    top = F.col("top_score").cast("float").cast("double")
    numbered = F.col("top_score").isNotNull() & ~F.isnan("top_score")
    passed = F.floor((F.least(F.greatest(top, F.lit(-2.0)), F.lit(2.0)) + 1) / step + F.lit(1e-9)).cast("int")
    # The division may be off by one at a floor; compare with the floors themselves.
    exact = F.when(top < -1, -1).when(top >= (passed + 1) * F.lit(step) - 1, passed + 1).when(top < passed * F.lit(step) - 1, passed - 1).otherwise(passed)
    scored, good = F.coalesce("scoreable", F.lit(False)), F.coalesce("answer_has_gold", F.lit(False))
    ran = F.coalesce("vector_ran", F.lit(False))
    why = F.when(~scored, "unscoreable").when(F.coalesce("hits", F.lit(0)) == 0, "no_spans").when(~ran, "answered").when(~numbered, "unscored").otherwise("score")
    reached = F.when(why == "answered", floors - 1).when(why == "score", F.least(exact, F.lit(floors - 1))).otherwise(-1)
    kinds = {f"_{name}": why == name for name in ("unscoreable", "no_spans", "unscored")}
    counted = outcomes.groupBy(*keys, reached.alias("_to")).agg(F.count_if(scored & good).alias("_g"), F.count_if(scored & ~good).alias("_b"), F.max(ran).alias("_ran"), *[F.count_if(k).alias(n) for n, k in kinds.items()])
    grid = counted.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(floors - 1))).alias("_to"))
    both = grid.withColumns({"_g": F.lit(0), "_b": F.lit(0), "_ran": F.lit(False), **{n: F.lit(0) for n in kinds}, "_grid": F.lit(True)}).unionByName(counted.withColumn("_grid", F.lit(False)))
    whole = Window.partitionBy(*keys)
    running = whole.orderBy(F.desc("_to"), "_grid").rowsBetween(Window.unboundedPreceding, 0)
    swept = both.withColumns({
        "answered_with_gold": F.sum("_g").over(running), "answered_without_gold": F.sum("_b").over(running), "_all_g": F.sum("_g").over(whole), "_all_b": F.sum("_b").over(whole),
        "applicable": F.max("_ran").over(whole), **{n: F.sum(n).over(whole) for n in kinds},
    }).where("_grid")
    refused = {"refused_with_gold": F.col("_all_g") - F.col("answered_with_gold"), "refused_without_gold": F.col("_all_b") - F.col("answered_without_gold")}
    return swept.withColumns(refused).select(
        *keys, F.round(F.col("_to") * F.lit(step) - 1, 2).alias("floor"), "answered_with_gold", "answered_without_gold", *refused, *[F.col(n).alias(n[1:]) for n in kinds],
        (F.col("refused_with_gold") + F.col("refused_without_gold") - F.col("_no_spans") - F.col("_unscored")).alias("below_floor"), "applicable",
    )


def records(cases: DataFrame, spans: DataFrame, hits: DataFrame, budget: Budget, floor: float, top: DataFrame | None = None) -> DataFrame:
    """What one retrieval did for each case: ranks of its gold, the answer that fits the budget, the decision.

    ``cases``: ``query_id, repo_id, path, start_line, end_line`` (others are kept); ``spans``: ``repo_id, id, path, start_line,
    end_line, text``; ``hits``: ``query_id, rank, id, vector_rank, lexical_rank`` of :func:`retrieval.fuse` or of one arm with
    the other's rank 0; ``top``: ``query_id, top_score`` of cases whose vector arm ran. A case that no span meets is not
    scoreable. A hit counts as gold if it meets the case's lines (lenient) or is the one that shares most of them (strict).
    """
    out = scored(cases, spans, hits, budget)
    out = out.join(top.withColumn("vector_ran", F.lit(True)), "query_id", "left").withColumn("vector_ran", F.coalesce("vector_ran", F.lit(False))) if top is not None else out.withColumns({"top_score": F.lit(None).cast("double"), "vector_ran": F.lit(False)})
    return decide(out, floor)


def scored(cases: DataFrame, spans: DataFrame, hits: DataFrame, budget: Budget, modes: dict[str, Column] | None = None) -> DataFrame:
    """:func:`records` without the decision.

    With ``modes``, structs of ``rank, vector_rank, lexical_rank`` over ``hits``, there is a record for each case and ``mode``, of
    the hits whose rank there is above 0. Hits are sent to their case once, however many modes there are.
    """
    ranges = spans.select("repo_id", "path", "id", F.col("start_line").alias("r_start"), F.col("end_line").alias("r_end"))
    met = overlapping(cases.select("query_id", "repo_id", "path", "start_line", "end_line"), ranges, ["repo_id", "path"]).dropDuplicates(["query_id", "id"])
    shared = F.least("end_line", "r_end") - F.greatest("start_line", "r_start") + 1
    of_case = met.groupBy("query_id").agg(F.count(F.lit(1)).alias("gold"), F.min(F.struct((-shared).alias("s"), F.col("r_start").alias("a"), F.col("r_end").alias("b"), "id")).alias("_best"), F.collect_list("id").alias("_met"))
    sized = hits.join(spans.where("id IS NOT NULL").select("id", F.octet_length("text").alias("_size")), "id", "left")
    ranked = sized.join(of_case.select("query_id", "_met", F.col("_best.id").alias("_strict")), "query_id", "left")
    ranked = ranked.withColumn("_g", F.coalesce(F.array_contains("_met", F.col("id")), F.lit(False))).drop("_met")
    by = ["query_id"]
    if modes:
        by.append("mode")
        runs = F.array(*[F.struct(F.lit(mode).alias("mode"), *[at[c].alias(c) for c in ("rank", "vector_rank", "lexical_rank")]) for mode, at in modes.items()])
        ranked = ranked.select("query_id", "id", "_size", "_g", "_strict", F.explode(runs).alias("_r")).where("_r.rank > 0").select("*", "_r.*").drop("_r")
    by_rank = Window.partitionBy(*by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    there = F.col("_size").isNotNull()
    ranked = ranked.withColumns({"_n": F.count("_size").over(by_rank), "_total": F.sum(F.coalesce("_size", F.lit(0))).over(by_rank)})
    over = there & (F.col("_n") > 1) & ((F.col("_n") > budget.spans) | (F.col("_total") > budget.size))
    ranked = ranked.withColumn("_cited", there & (F.coalesce(F.max(over.cast("int")).over(by_rank), F.lit(0)) == 0))
    strict = F.coalesce(F.col("id") == F.col("_strict"), F.lit(False))
    first = F.min(F.when(F.col("_g"), F.struct("rank", "vector_rank", "lexical_rank")))
    found = ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("hits"), first.alias("_first"), F.min(F.when(strict, F.col("rank"))).alias("gold_rank_strict"), F.count_if("_g").alias("gold_found"),
        F.coalesce(F.max(F.col("_g") & F.col("_cited")), F.lit(False)).alias("answer_has_gold"), F.count_if("_cited").alias("citations"),
    )
    out = cases.join(of_case.select("query_id", "gold"), "query_id", "left")
    if modes:
        out = out.withColumn("mode", F.explode(F.array(*map(F.lit, modes))))
    out = out.join(found, by, "left")
    for c in ("rank", "vector_rank", "lexical_rank"):
        out = out.withColumn(f"gold_{c}", F.coalesce(F.col(f"_first.{c}"), F.lit(0)))
    out = out.drop("_first").na.fill(0, ["hits", "gold_rank_strict", "gold_found", "citations", "gold"])
    return out.withColumns({"answer_has_gold": F.coalesce("answer_has_gold", F.lit(False)), "scoreable": F.col("gold") > 0})


def order_statistics(values: DataFrame, keys: list[str], value: str, ranks: dict[str, float], low: float, high: float) -> DataFrame:
    """Element ``int(p * (n - 1))`` of each group's sorted values, exactly.

    Two passes: counts by bucket of the value's range find the bucket that holds a rank; only the values of those buckets
    are counted and ordered. Nulls and NaN don't count.
    """
    rows = values.where(F.col(value).isNotNull() & ~F.isnan(value))
    width = (high - low) / QUANTILE_BUCKETS
    bucket = F.least(F.greatest(F.floor((F.col(value) - low) / width), F.lit(0)), F.lit(QUANTILE_BUCKETS - 1)).cast("int")
    counts = rows.groupBy(*keys, bucket.alias("_k")).agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(*keys).orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumns({"_to": F.sum("_c").over(upto), "_n": F.sum("_c").over(Window.partitionBy(*keys))})
    wanted = counts.withColumn("_q", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.floor(F.lit(p) * (F.col("_n") - 1)).alias("at")) for name, p in ranks.items()])))
    wanted = wanted.where((F.col("_q.at") < F.col("_to")) & (F.col("_q.at") >= F.col("_to") - F.col("_c"))).select(*keys, "_k", F.col("_q.name").alias("_name"), (F.col("_q.at") - (F.col("_to") - F.col("_c"))).alias("_at"), "_n")
    inside = rows.withColumn("_k", bucket).join(wanted.select(*keys, "_k").distinct(), [*keys, "_k"], "left_semi").groupBy(*keys, "_k", value).agg(F.count(F.lit(1)).alias("_c"))
    inside = inside.withColumn("_to", F.sum("_c").over(Window.partitionBy(*keys, "_k").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    hit = inside.join(wanted, [*keys, "_k"]).where((F.col("_at") < F.col("_to")) & (F.col("_at") >= F.col("_to") - F.col("_c")))
    return hit.groupBy(*keys).agg(F.max("_n").alias("n"), *[F.max(F.when(F.col("_name") == name, F.col(value))).alias(name) for name in ranks])


def leaks(needles: DataFrame, texts: DataFrame, least_words: int = 4) -> DataFrame:
    """``needle_id, text_id`` of texts that hold a needle as a whole phrase in normal form.

    A needle is looked for only where its rarest word occurs; needles below ``least_words`` words are left out.
    ``needles``: ``needle_id, phrase``; ``texts``: ``text_id, body``.
    """
    n = needles.select("needle_id", T.normalised(F.col("phrase")).alias("_p")).where(F.size(F.split("_p", " ")) >= least_words)
    t = texts.select("text_id", T.normalised(F.col("body")).alias("_t"))
    vocabulary = n.select(F.explode(F.split("_p", " ")).alias("_w")).distinct()
    words = t.select("text_id", F.explode(F.array_distinct(F.split("_t", " "))).alias("_w")).join(vocabulary, "_w", "left_semi")
    common = words.groupBy("_w").agg(F.count(F.lit(1)).alias("_n"))
    rarest = n.select("needle_id", "_p", F.explode(F.array_distinct(F.split("_p", " "))).alias("_w")).join(common, "_w", "left").groupBy("needle_id", "_p").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_w")).alias("_r"))
    tried = rarest.select("needle_id", "_p", F.col("_r._w").alias("_w")).join(words, "_w")
    return tried.join(t, "text_id").where(T.holds_phrase(F.col("_t"), F.col("_p"))).select("needle_id", "text_id").distinct()


def bootstrap_difference(pairs: DataFrame, draws: int = 1000, seed: int = 7, least_effect: float = 0.02) -> dict[str, float | str]:
    """Difference of two arms' mean reciprocal rank over the same cases, its bootstrap error and a verdict.

    ``pairs``: ``rank_a, rank_b`` of a case (0: a miss). Resampling cases is resampling the counts of their rank pairs, of which
    there are at most as many as ranks squared, so only those counts come to the driver; more than a million are refused.
    """
    counts = pairs.groupBy("rank_a", "rank_b").agg(F.count(F.lit(1)).alias("n"))
    rows = sorted(counts.limit(1_000_001).collect(), key=lambda r: (r.rank_a or 0, r.rank_b or 0))
    if len(rows) > 1_000_000:
        raise ValueError("more than a million different pairs of ranks")
    n = np.array([r.n for r in rows], np.int64)
    if not n.sum():
        return {"cases": 0, "difference": 0.0, "error": 0.0, "threshold": least_effect, "verdict": "undecided"}
    value = lambda r: 1.0 / r if r and r > 0 else 0.0
    effect = np.array([value(r.rank_b) - value(r.rank_a) for r in rows])
    random = np.random.default_rng(seed)
    samples = random.multinomial(n.sum(), n / n.sum(), size=draws) @ effect / n.sum()
    difference, error = float(n @ effect / n.sum()), float(samples.std(ddof=1))
    threshold = max(2 * error, least_effect)
    verdict = "better" if difference > threshold else "worse" if difference < -threshold else "undecided"
    return {"cases": int(n.sum()), "difference": difference, "error": error, "threshold": threshold, "verdict": verdict}


def golden_ledger(cases: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of a golden set, with the questions that occur more than once."""
    return cases.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(F.col("grouped")).alias("grouped"), F.count_if(F.col("start_line") != F.col("raw_start")).alias("moved"), F.count_if(F.coalesce(F.trim("question"), F.lit("")) == "").alias("empty"),
        (F.count("question") - F.countDistinct("question")).alias("duplicates"),
    )


def merged_ledger(ledgers: DataFrame, keys: list[str], cases: DataFrame) -> DataFrame:
    """One ledger of several for each key: counters are added, duplicates counted again over all ``cases``, as a question may occur in two of them."""
    counters = [c for c, kind in ledgers.dtypes if c not in keys and kind in ("int", "bigint") and c != "duplicates"]
    total = ledgers.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters])
    again = cases.groupBy(*keys).agg((F.count("question") - F.countDistinct("question")).alias("duplicates"))
    return total.join(again, keys, "left").na.fill(0, ["duplicates"])
