"""Admission to queues: token buckets and concurrency limits of queues and of tenants in them.

The outcome of a request depends on all earlier ones of its queue, so a queue is folded in order of
time. Batch: queues are dealt to tasks, sorted there and folded row by row in Arrow batches, holding
a few numbers a queue and tenant, never a queue's rows. Streaming: see streaming.stateful.

A request takes the queue's token first, then checks its concurrency, then the tenant's token, then
the tenant's concurrency: one refused for concurrency has spent its token. Queues and tenants
without limits admit everything. Releases lower the counts, to 0 at least.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame


@dataclass
class Limit:
    """rate tokens a second (0: none), up to ``burst``; at most ``concurrency`` at once (0: any number)."""

    rate: float = 0.0
    burst: int = 1
    concurrency: int = 0


@dataclass
class Gate:
    """The state of one limit. Times are seconds."""

    limit: Limit
    tokens: float = field(default=-1.0)
    last: float = 0.0
    active: int = 0

    def take_token(self, now: float) -> bool:
        if self.limit.rate <= 0:
            return True
        most = max(self.limit.burst, 1)
        self.tokens = most if self.tokens < 0 else min(most, self.tokens + max(0.0, now - self.last) * self.limit.rate)
        self.last = max(self.last, now)
        if self.tokens < 1:
            return False
        self.tokens -= 1
        return True

    def has_room(self) -> bool:
        return self.limit.concurrency <= 0 or self.active < self.limit.concurrency


class Queue:
    """One queue's gates. ``tenants`` maps tenant ids to limits."""

    def __init__(self, limit: Limit | None, tenants: dict[str, Limit]):
        self.own = Gate(limit) if limit else None
        self.tenants = {k: Gate(v) for k, v in tenants.items()}

    def acquire(self, tenant: str | None, now: float) -> bool:
        gate = self.tenants.get(tenant) if tenant else None
        for g in (self.own, gate):
            if g is not None and not (g.take_token(now) and g.has_room()):
                return False
        for g in (self.own, gate):
            if g is not None:
                g.active += 1
        return True

    def release(self, tenant: str | None) -> None:
        for g in (self.own, self.tenants.get(tenant) if tenant else None):
            if g is not None and g.active > 0:
                g.active -= 1

    def reconfigure(self, limit: Limit) -> None:
        """A full bucket under the new limit; what runs stays counted."""
        active = self.own.active if self.own else 0
        self.own = Gate(limit, active=active)


def admit(requests: DataFrame, queues: dict[str, Limit], tenants: dict[tuple[str, str], Limit] | None = None) -> DataFrame:
    """``requests`` (queue, tenant, ts, kind, id) with ``admitted``; kind is acquire or release, and the
    result of a release is null. Rows of one time go releases first, then by id."""
    by_queue: dict[str, dict[str, Limit]] = {}
    for (queue, tenant), limit in (tenants or {}).items():
        by_queue.setdefault(queue, {})[tenant] = limit

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, queue = None, None
        for pdf in batches:
            seconds = pdf["ts"].astype("datetime64[us]").astype("int64") / 1e6
            out = []
            for q, tenant, now, kind in zip(pdf["queue"], pdf["tenant"], seconds, pdf["kind"], strict=True):
                if queue is None or q != name:
                    name, queue = q, Queue(queues.get(q), by_queue.get(q, {}))
                if kind == "release":
                    queue.release(tenant)
                    out.append(None)
                else:
                    out.append(queue.acquire(tenant, now))
            yield pdf.assign(admitted=pd.Series(out, index=pdf.index, dtype="object"))

    rows = requests.select("queue", "tenant", "ts", "kind", "id")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", admitted boolean"
    return rows.repartition("queue").sortWithinPartitions("queue", "ts", rows["kind"].desc(), "id").mapInPandas(fold, schema)
