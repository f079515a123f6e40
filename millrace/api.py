"""The engine's operations over one set of tables, each a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import cite
from millrace.operators import admission, corpus, graph, queue
from millrace.operators import retrieval as R
from millrace.session import bounded

#: Deepest walk to callers that is answered.
MOST_CALLER_DEPTH = 3

@dataclass
class Engine:
    """``repos`` (``id, remote_key, ref_name, commit_sha, indexed_at, last_used``), ``spans``, ``files``, ``symbols``, ``edges`` and ``jobs``."""

    repos: DataFrame
    spans: DataFrame
    files: DataFrame
    symbols: DataFrame | None = None
    edges: DataFrame | None = None
    jobs: DataFrame | None = None
    fusion: R.Fusion = field(default_factory=R.Fusion)
    budget: R.Budget = field(default_factory=R.Budget)
    floor: float = -1.0
    candidates: int = 40
    timeout_s: float = 60.0

    def list_repos(self, limit: int = 50) -> DataFrame:
        """Used last first."""
        return self.repos.orderBy(F.desc("last_used"), "id").limit(limit)

    def get_repo(self, repo: str, now: str) -> DataFrame:
        """One repository with its counts and what is newer."""
        one = self.repos.where(F.col("id") == repo)
        counts = corpus.repo_stats(one, self.files.where(F.col("repo_id") == repo), self.spans.where(F.col("repo_id") == repo)).withColumnRenamed("repo_id", "id")
        newer = corpus.newer_commits(self.repos.select("id", "remote_key", "ref_name", "commit_sha", "indexed_at")).where(F.col("id") == repo)
        state = cite.staleness(F.col("commit_sha"), F.col("ref_name"), F.col("indexed_at"), F.col("newer_commit"), F.lit(now).cast("timestamp"))
        return one.join(counts, "id").join(newer, "id", "left").withColumn("staleness", state)

    def get_span(self, repo: str, span: str) -> DataFrame:
        """A span of a repository with its citation; a span of another repository is not there."""
        one = self.spans.where((F.col("repo_id") == repo) & (F.col("id") == span))
        return self._cited(one)

    def _cited(self, spans: DataFrame, now: str | None = None) -> DataFrame:
        """The spans with ``citation`` and its ``permalink``."""
        r = self.repos.select("id", "remote_key", "ref_name", "commit_sha", "indexed_at")
        r = r.join(corpus.newer_commits(r), "id", "left").withColumnRenamed("id", "repo_id")
        spans = spans if "digest" in spans.columns else spans.withColumn("digest", F.lit(None).cast("string"))
        cited = spans.join(r, "repo_id").withColumn("citation", cite.citation(F.lit(now).cast("timestamp") if now else F.current_timestamp()))
        return cited.withColumn("permalink", F.col("citation.permalink"))

    def _corpus(self) -> DataFrame:
        return self.spans.withColumn("tenant", F.col("repo_id"))

    def search(self, questions: DataFrame, limit: int = 10, mode: str = "hybrid") -> DataFrame:
        """Ranked spans for ``query_id, tenant`` (a repository), ``q`` and, for the vector arm, ``embedding``."""
        R.check_search(mode, self.candidates, limit)
        spans = self._corpus()
        if mode != "lexical":
            self._check_embedder(questions)
        empty_v = questions.sparkSession.createDataFrame([], f"query_id {dict(questions.dtypes)['query_id']}, rank int, id string, similarity double")
        empty_l = questions.sparkSession.createDataFrame([], f"query_id {dict(questions.dtypes)['query_id']}, rank int, id string, score double")
        vector = R.vector_topk(spans, questions, self.candidates) if mode != "lexical" else empty_v
        lexical = empty_l
        if mode != "vector":
            lexical = R.lexical_scan(spans, R.question_terms(questions), self.candidates)
        return R.fuse(vector, lexical, spans.select("id", "path", "start_line"), self.fusion, limit)

    def _check_embedder(self, questions: DataFrame) -> None:
        """Refuses questions whose vectors are of another width, or of another ``embed_model`` where they name one, than those of the spans searched."""
        asked = questions.where(F.col("embedding").isNotNull())
        width, model = F.size("embedding").alias("dim"), (F.col("embed_model") if "embed_model" in questions.columns else F.lit(None).cast("string")).alias("model")
        wanted = asked.select(F.col("tenant").alias("repo_id"), width, model).distinct()
        here = self.spans.where(F.col("embedding").isNotNull())
        own = F.col("embed_model") if "embed_model" in self.spans.columns else F.lit(None).cast("string")
        there = here.join(wanted.select("repo_id").distinct(), "repo_id", "left_semi").groupBy("repo_id").agg(F.collect_set(F.size("embedding")).alias("dims"), F.collect_set(own).alias("models"))
        wrong = wanted.join(there, "repo_id").where(~F.array_contains("dims", F.col("dim")) | (F.size("dims") > 1) | (F.size("models") > 1) | ((F.size("models") == 1) & F.col("model").isNotNull() & ~F.array_contains("models", F.col("model"))))
        if bad := wrong.limit(1).collect():
            raise ValueError(f"questions and spans of {bad[0]['repo_id']} are of different embedders")

    def ask(self, questions: DataFrame, limit: int = 10, mode: str = "hybrid") -> DataFrame:
        """``query_id, outcome, reason, answer, cited, dropped``: refused where nothing good enough was found."""
        hits = self.search(questions, limit, mode)
        top = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.max("vector_score").alias("top_score"))
        summary = questions.select("query_id").join(top, "query_id", "left").withColumns({"hits": F.coalesce("hits", F.lit(0)), "vector_ran": F.lit(mode != "lexical")})
        decided = R.decide(summary, self.floor)
        answers = R.assemble(hits, self.spans.select("id", "path", "symbol", "start_line", "end_line", "text"), self.budget)
        fine = F.col("outcome") == "answered"
        return decided.join(answers, "query_id", "left").select("query_id", "outcome", "reason", F.when(fine, F.col("answer")).alias("answer"), F.when(fine, F.col("cited")).alias("cited"), F.when(fine, F.col("dropped")).alias("dropped"))

    def find_symbols(self, repo: str, name: str, by_suffix: bool = False, pkg: str | None = None, limit: int = 50) -> DataFrame:
        return graph.definitions(self.symbols.where(F.col("repo_id") == repo), name, by_suffix, pkg, limit)

    def get_symbol(self, repo: str, symbol: str) -> DataFrame:
        return self.symbols.where((F.col("repo_id") == repo) & (F.col("id") == symbol))

    def callers(self, repo: str, symbol: str, depth: int = 1, limit: int = 50) -> tuple[DataFrame, DataFrame]:
        """(resolved callers, callers by the symbol's last name): two tables, never one; depth 1 to 3, within ``timeout_s``.

        Resolved callers carry the ``citation`` of their span, null for one whose span is not there.
        """
        if not 1 <= depth <= MOST_CALLER_DEPTH:
            raise ValueError(f"depth is 1 to {MOST_CALLER_DEPTH}")
        edges = self.edges.where(F.col("repo_id") == repo)
        own = self.get_symbol(repo, symbol)
        # Walking runs a job a level; it ends at the deadline.
        reached = bounded(edges.sparkSession, self.timeout_s, lambda: graph.callers(edges, own.select(F.col("id").alias("target")), depth))
        precise = reached.join(self.symbols.where(F.col("repo_id") == repo), "id").orderBy("depth", "path", "start_line", "id").limit(limit)
        if "span_id" in precise.columns:
            cited = self._cited(self.spans.where(F.col("repo_id") == repo)).select(F.col("id").alias("span_id"), "citation")
            precise = precise.join(cited, "span_id", "left")
        names = own.select("repo_id", F.substring_index("name", ".", -1).alias("name"))
        return precise, graph.approximate_callers(edges, self.symbols, names, limit)

    def submit(self, urls: DataFrame, hosts: list[str]) -> DataFrame:
        """``id, url, ref_name, created_at`` as admitted jobs, with the active job each belongs to or the rule that refuses it."""
        checked = urls.withColumn("a", admission.admitted(F.col("url"), hosts)).withColumn("rule", F.when(~admission.valid_ref(F.col("ref_name")), "ref").otherwise(F.col("a.rule")))
        wanted = checked.where(F.col("rule").isNull()).select("id", F.col("a.url").alias("remote"), "ref_name", "created_at")
        jobs = self.jobs if self.jobs is not None else wanted.limit(0).withColumn("status", F.lit("pending"))
        return checked.select("id", "rule").join(queue.enqueue(jobs, wanted).select("id", "job_id"), "id", "left")

    def get_job(self, job: str) -> DataFrame:
        return self.jobs.where(F.col("id") == job)
