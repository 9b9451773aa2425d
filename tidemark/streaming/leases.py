"""Leases on files as keyed state: grant, first-in-first-out queue by priority, renewal, release, expiry and promotion."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TTL_MS = 300_000
SCHEMA = "file string, seq long, at long, event string, agent string"
STATE = "holder string, expires long, waiting string"


class Lease:
    """State of one file. waiting: [agent, priority, place, last seen]; a waiter not seen for twice the TTL is stale."""

    def __init__(self, holder: str | None = None, expires: int = 0, waiting: list | None = None):
        self.holder, self.expires, self.waiting = holder, expires, waiting or []

    def _promote(self, at: int, out: list) -> None:
        stale = [w for w in self.waiting if w[3] + 2 * TTL_MS < at]
        self.waiting = [w for w in self.waiting if w not in stale]
        out += [("stale", w[0]) for w in stale]
        if self.waiting:
            w = min(self.waiting, key=lambda w: (w[1], w[2]))
            self.waiting.remove(w)
            self.holder, self.expires = w[0], at + TTL_MS
            out.append(("promoted", w[0]))
        else:
            self.holder, self.expires = None, 0

    def sweep(self, at: int) -> list[tuple[str, str]]:
        """Expire a lease whose time has passed and promote the next waiter."""
        out: list[tuple[str, str]] = []
        while self.holder is not None and self.expires <= at:
            out.append(("expired", self.holder))
            self._promote(self.expires if self.waiting else at, out)
        return out

    def apply(self, kind: str, agent: str, at: int, priority: int, seq: int) -> list[tuple[str, str]]:
        """Events that a request, renewal or release brings forth."""
        out = self.sweep(at)
        if kind == "release":
            if self.holder == agent:
                out.append(("released", agent))
                self._promote(at, out)
            elif any(w[0] == agent for w in self.waiting):
                self.waiting = [w for w in self.waiting if w[0] != agent]
                out.append(("left", agent))
            else:
                out.append(("ignored", agent))
        elif self.holder in (None, agent):
            out.append(("renewed" if self.holder == agent else "granted", agent))
            self.holder, self.expires = agent, max(self.expires, at + TTL_MS)
        elif kind == "renew":
            out.append(("refused", agent))
        else:
            own = [w for w in self.waiting if w[0] == agent]
            if own:
                own[0][3] = at
            else:
                self.waiting.append([agent, priority, seq, at])
            out.append(("waiting" if own else "queued", agent))
        return out


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    lease = Lease()
    if state.exists:
        holder, expires, waiting = state.get
        lease = Lease(holder, expires, json.loads(waiting))
    rows = []
    if state.hasTimedOut:
        at = state.getCurrentWatermarkMs()
        rows += [(key[0], -1, at, e, a) for e, a in lease.sweep(at)]
    else:
        for r in pd.concat(list(batches)).sort_values(["at", "seq"]).itertuples():
            rows += [(key[0], r.seq, r.at, e, a) for e, a in lease.apply(r.kind, r.agent, r.at, r.priority, r.seq)]
    if lease.holder is None and not lease.waiting:
        if state.exists:
            state.remove()
    else:
        state.update((lease.holder, lease.expires, json.dumps(lease.waiting)))
        state.setTimeoutTimestamp(max(lease.expires, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame(rows, columns=["file", "seq", "at", "event", "agent"])


def lease_events(requests: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Lease events of a stream of ``requests`` (file, seq LONG, at LONG, kind request/renew/release, agent, priority INT, ts TIMESTAMP).

    Requests later than the watermark ``delay`` are dropped by the engine; within a batch they are applied by (at, seq). Leases that nobody
    touches expire by event-time timer. Rows with a null file, agent or instant are left out.
    """
    known = requests.where("file IS NOT NULL AND agent IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", delay)
    return known.groupBy("file").applyInPandasWithState(_step, SCHEMA, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def replay(requests: list[tuple[int, int, str, str, int]]) -> list[tuple[int, int, str, str]]:
    """The same events for one file's requests (seq, at, kind, agent, priority), as a plain fold."""
    lease, out = Lease(), []
    for seq, at, kind, agent, priority in sorted(requests, key=lambda r: (r[1], r[0])):
        out += [(seq, at, e, a) for e, a in lease.apply(kind, agent, at, priority, seq)]
    return out
