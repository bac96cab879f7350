"""Streaming operators with state of their own: admission, credits, and waits for events.

State is a few numbers a key. Rows of a key are taken in order of time within a micro-batch, so
results equal the batch form's for input that arrives in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerflow.operators.admission import Limit, Queue

_GATE = "tokens array<double>, last array<double>, active array<bigint>"


def admit(requests: DataFrame, queues: dict[str, Limit], tenants: dict[tuple[str, str], Limit] | None = None) -> DataFrame:
    """Streaming form of operators.admission.admit: requests (queue, tenant, ts, kind, id) with admitted."""
    limits = tenants or {}

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name = key[0]
        own = {t: v for (q, t), v in sorted(limits.items()) if q == name}
        queue = Queue(queues.get(name), own)
        gates = [g for g in (queue.own, *queue.tenants.values()) if g is not None]
        if state.exists:
            for g, tokens, last, active in zip(gates, *state.get, strict=True):
                g.tokens, g.last, g.active = float(tokens), float(last), int(active)
        rows = pd.concat(list(batches)).sort_values(["ts", "kind", "id"], ascending=[True, False, True])
        seconds = rows["ts"].astype("datetime64[us]").astype("int64") / 1e6
        out = []
        for tenant, now, kind in zip(rows["tenant"], seconds, rows["kind"], strict=True):
            if kind == "release":
                queue.release(tenant)
                out.append(None)
            else:
                out.append(queue.acquire(tenant, now))
        state.update(([g.tokens for g in gates], [g.last for g in gates], [g.active for g in gates]))
        yield rows.assign(admitted=pd.Series(out, index=rows.index, dtype="object"))[["queue", "id", "kind", "admitted"]]

    schema = "queue string, id string, kind string, admitted boolean"
    return requests.groupBy("queue").applyInPandasWithState(step, schema, _GATE, "append", GroupStateTimeout.NoTimeout)


def credit_flow(messages: DataFrame, default: int = 1000) -> DataFrame:
    """``messages`` (subscriber, ts, kind, event_id, credits): kind is event or credit. Gives the events
    that are delivered; an event takes a credit, credit rows add some, and events without one are dropped."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        left = int(state.get[0]) if state.exists else default
        rows = pd.concat(list(batches)).sort_values(["ts", "kind", "event_id"])
        sent = []
        for kind, event, credits in zip(rows["kind"], rows["event_id"], rows["credits"], strict=True):
            if kind == "credit":
                left += int(credits)
            elif left > 0:
                left -= 1
                sent.append(event)
        state.update((left,))
        yield pd.DataFrame({"subscriber": [key[0]] * len(sent), "event_id": sent})

    return messages.groupBy("subscriber").applyInPandasWithState(step, "subscriber string, event_id string", "credits bigint", "append", GroupStateTimeout.NoTimeout)


def wait_for_events(messages: DataFrame) -> DataFrame:
    """``messages`` (name, ts, kind, id, timeout_ms) with an event-time watermark on ts; kind is wait or event.
    Gives (name, wait_id, event_id): each wait's first event since it began, null once its time is over."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, since, until = (list(x) for x in state.get) if state.exists else ([], [], [])
        out = []
        frames = [] if state.hasTimedOut else list(batches)
        for row in (pd.concat(frames).sort_values(["ts", "kind", "id"], ascending=[True, False, True]).itertuples(index=False) if frames else ()):
            now = int(row.ts.timestamp() * 1000)
            if row.kind == "wait":
                ids.append(row.id)
                since.append(now)
                until.append(now + int(row.timeout_ms))
                continue
            met = [i for i in range(len(ids)) if since[i] <= now <= until[i]]
            out += [(key[0], ids[i], row.id) for i in met]
            ids, since, until = ([v for i, v in enumerate(x) if i not in met] for x in (ids, since, until))
        mark = state.getCurrentWatermarkMs()
        over = [i for i in range(len(ids)) if until[i] <= mark]
        out += [(key[0], ids[i], None) for i in over]
        ids, since, until = ([v for i, v in enumerate(x) if i not in over] for x in (ids, since, until))
        if ids:
            state.update((ids, since, until))
            state.setTimeoutTimestamp(max(min(until), mark + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["name", "wait_id", "event_id"])

    schema = "name string, wait_id string, event_id string"
    return messages.groupBy("name").applyInPandasWithState(step, schema, "ids array<string>, since array<bigint>, until array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
