"""Keyed state machines on streams: the work queue and the rolling token budget."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.operators.queue import BASE_S, MOST_DOUBLINGS, MOST_S

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WINDOW_S = 3600


@dataclass
class Job:
    """The active job of a key, driven by events in the order of their time."""

    id: str = ""
    status: str = ""
    attempts: int = 0
    holder: str = ""
    until: int = 0

    def step(self, kind: str, job: str, worker: str, at: int, lease_s: int, most: int) -> str:
        """Applies an event and says what became of it."""
        active = self.status in ("pending", "leased")
        if kind == "submit":
            if active:
                return f"joined {self.id}"
            self.id, self.status, self.attempts, self.holder, self.until = job, "pending", 0, "", 0
            return "queued"
        if kind == "lease":
            if not active or self.until > at:
                return "refused"
            self.status, self.attempts, self.holder, self.until = "leased", self.attempts + 1, worker, at + lease_s
            return "leased"
        if self.status != "leased" or self.holder != worker:
            return "refused"
        if kind == "complete":
            self.status, self.holder = "done", ""
            return "done"
        self.holder = ""
        if self.attempts >= most:
            self.status = "failed"
            return "failed"
        self.status, self.until = "pending", at + min(BASE_S * 2 ** min(max(self.attempts - 1, 0), MOST_DOUBLINGS), MOST_S)
        return "retry"


class QueueProcessor(StatefulProcessor):
    """One active job a key: submissions join it, leases exclude each other, only the holder reports."""

    def __init__(self, lease_s: int = 600, most: int = 5) -> None:
        self.lease_s, self.most = lease_s, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("job", "id string, status string, attempts int, holder string, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        job = Job(*self.state.get()) if self.state.exists() else Job()
        events = pd.concat(rows).sort_values(["at", "event_id"])
        out = [(key[0], e.event_id, job.step(e.kind, e.job_id, e.worker, int(e.at), self.lease_s, self.most), job.status) for e in events.itertuples()]
        self.state.update((job.id, job.status, job.attempts, job.holder, job.until))
        yield pd.DataFrame(out, columns=["key", "event_id", "result", "status"])

    def close(self) -> None:
        pass


def run_queue(events: DataFrame, lease_s: int = 600, most: int = 5) -> DataFrame:
    """``key, event_id, result, status`` for a stream of ``key, event_id, kind, job_id, worker, at`` (seconds)."""
    return events.groupBy("key").transformWithStateInPandas(QueueProcessor(lease_s, most), "key string, event_id long, result string, status string", "Update", "None")


@dataclass
class RollingBudget:
    """Tokens of the last hour: what was spent and what is reserved stay within a limit. A reservation nobody settles is freed after an hour."""

    limit: int
    spent: list[tuple[int, int]] = field(default_factory=list)
    reserved: dict[str, tuple[int, int]] = field(default_factory=dict)

    def total(self, at: int) -> int:
        self.spent = [(t, n) for t, n in self.spent if t > at - WINDOW_S]
        self.reserved = {r: x for r, x in self.reserved.items() if x[0] > at - WINDOW_S}
        return sum(n for _, n in self.spent) + sum(n for _, n in self.reserved.values())

    def step(self, kind: str, request: str, tokens: int, at: int) -> str:
        """``ask`` reserves if there is room, ``done`` turns a reservation into what was really spent."""
        if kind == "ask":
            if self.total(at) + tokens > self.limit:
                return "refused"
            self.reserved[request] = (at, tokens)
            return "admitted"
        self.total(at)  # frees what has expired
        if request not in self.reserved:
            return "unknown"
        del self.reserved[request]
        self.spent.append((at, tokens))
        return "spent"


class BudgetProcessor(StatefulProcessor):
    def __init__(self, limit: int) -> None:
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("budget", "body string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        budget = RollingBudget(self.limit)
        if self.state.exists():
            body = json.loads(self.state.get()[0])
            budget.spent, budget.reserved = [tuple(x) for x in body["spent"]], body["reserved"]
        out = []
        for e in pd.concat(rows).sort_values(["at", "event_id"]).itertuples():
            result = budget.step(e.kind, e.request, int(e.tokens), int(e.at))
            out.append((key[0], e.event_id, result, self.limit - min(self.limit, budget.total(int(e.at)))))
        self.state.update((json.dumps({"spent": budget.spent, "reserved": budget.reserved}),))
        yield pd.DataFrame(out, columns=["key", "event_id", "result", "remaining"])

    def close(self) -> None:
        pass


def run_budget(events: DataFrame, limit: int) -> DataFrame:
    """``key, event_id, result, remaining`` for a stream of ``key, event_id, kind, request, tokens, at`` (seconds)."""
    return events.groupBy("key").transformWithStateInPandas(BudgetProcessor(limit), "key string, event_id long, result string, remaining long", "Update", "None")
