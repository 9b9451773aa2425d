"""A coalescing job queue as keyed state: equal requests share one run, recent good results are reused."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CACHE_MS = 600_000
MAX_ATTEMPTS = 2
SCHEMA = "job string, seq long, requester string, answer string, run long"
STATE = "status string, run long, attempts int, fingerprint string, finished long"


class Job:
    """State of one job key: idle, queued or running, with the last good result's fingerprint and time."""

    def __init__(self, status: str = "idle", run: int = 0, attempts: int = 0, fingerprint: str = "", finished: int = -1):
        self.status, self.run, self.attempts, self.fingerprint, self.finished = status, run, attempts, fingerprint, finished

    def apply(self, kind: str, at: int, fingerprint: str) -> str:
        """Answer to a request, start, success, failure or crash of the job."""
        if kind == "request":
            if self.finished >= 0 and fingerprint == self.fingerprint and at - self.finished <= CACHE_MS:
                return "cached"
            if self.status != "idle":
                return "joined" if self.status == "running" else "coalesced"
            self.status, self.run, self.attempts = "queued", self.run + 1, 0
            return "queued"
        if kind == "start" and self.status == "queued":
            self.status, self.attempts = "running", self.attempts + 1
            return "started"
        if kind == "success" and self.status == "running":
            self.status, self.fingerprint, self.finished = "idle", fingerprint, at
            return "done"
        if kind in ("failure", "crash") and self.status == "running":
            retry = kind == "crash" and self.attempts < MAX_ATTEMPTS
            self.status, self.finished = ("queued", self.finished) if retry else ("idle", -1)
            return "requeued" if retry else "failed"
        return "ignored"


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    job = Job(*state.get) if state.exists else Job()
    rows = [(key[0], r.seq, r.requester, job.apply(r.kind, r.at, r.fingerprint or ""), job.run) for r in pd.concat(list(batches)).sort_values(["at", "seq"]).itertuples()]
    state.update((job.status, job.run, job.attempts, job.fingerprint, job.finished))
    yield pd.DataFrame(rows, columns=["job", "seq", "requester", "answer", "run"])


def job_answers(messages: DataFrame) -> DataFrame:
    """Answers to a stream of ``messages`` (job, seq LONG, at LONG, kind, requester, fingerprint), in order of (at, seq) within a batch."""
    known = messages.where("job IS NOT NULL AND at IS NOT NULL")
    return known.groupBy("job").applyInPandasWithState(_step, SCHEMA, STATE, "append", GroupStateTimeout.NoTimeout)


def undelivered(answers: DataFrame, delivered: DataFrame) -> DataFrame:
    """Answers that no delivery receipt (job, seq) confirms: redelivered at least once, deduplicated by key at the receiver."""
    return answers.join(delivered.select("job", "seq"), ["job", "seq"], "left_anti")
