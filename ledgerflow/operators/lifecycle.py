"""The lifecycle event stream: events from state changes, topics, deliveries, audit records, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.functions.scalar import resolve_topics
from ledgerflow.operators import scan
from ledgerflow.operators.changelog import latest
from ledgerflow.session import cut

# The event types, with severity, outcome, resource and group of each.
EVENTS = {
    "job.enqueued": ("info", "success", "job", "jobs"),
    "job.started": ("info", "success", "job", "jobs"),
    "job.completed": ("info", "success", "job", "jobs"),
    "job.failed": ("critical", "failure", "job", "jobs"),
    "job.retrying": ("warning", "failure", "job", "jobs"),
    "job.dlq": ("critical", "failure", "job", "jobs"),
    "workflow.started": ("info", "success", "workflow_run", "workflows"),
    "workflow.step_completed": ("info", "success", "workflow_run", "workflows"),
    "workflow.step_failed": ("warning", "failure", "workflow_run", "workflows"),
    "workflow.completed": ("info", "success", "workflow_run", "workflows"),
    "workflow.failed": ("critical", "failure", "workflow_run", "workflows"),
    "cron.fired": ("info", "success", "cron_entry", "cron"),
}


def _by_type(place: int) -> Column:
    pairs = F.create_map(*[F.lit(x) for kind, facts in EVENTS.items() for x in (kind, facts[place])])
    return pairs[F.col("type")]


def state_changes(log: DataFrame) -> DataFrame:
    """Events from a job changelog (id, state, ts): one a row whose state differs from the job's row before."""
    before = F.lag("state").over(Window.partitionBy("id").orderBy("ts", "state"))
    kind = (
        F.when((F.col("state") == "pending") & F.col("before").isNull(), "job.enqueued")
        .when(F.col("state") == "running", "job.started")
        .when(F.col("state").isin("completed", "failed", "retrying"), F.concat(F.lit("job."), F.col("state")))
    )
    changed = log.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col("state")))
    return changed.select(kind.alias("type"), "ts", F.concat(F.lit("job:"), "id").alias("topic")).where("type IS NOT NULL")


#: What an event may carry besides type, ts, topic and the id of what it is about.
CARRIED = {
    "name": "string", "queue": "string", "scope_app_id": "string", "scope_org_id": "string", "step_name": "string", "elapsed_ms": "bigint", "error": "string",
    "attempt": "int", "next_run_at": "timestamp_ntz", "retry_count": "int", "max_retries": "int", "worker_id": "string", "job_id": "string",
}


def _events(rows: DataFrame, kind: Column, ts: str, topic: Column, id_: str, **carried: Column) -> DataFrame:
    """Whole events; what isn't given is the row's own column of that name, or null where it has none."""
    own = {c: carried.get(c, F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in CARRIED.items()}
    return rows.select(kind.alias("type"), F.col(ts).alias("ts"), topic.alias("topic"), F.col(id_).alias("id"), *own.values()).where("type IS NOT NULL")


def _changed(log: DataFrame) -> DataFrame:
    """The rows of a changelog (id, state, ts, and seq to break ties) whose state differs from the row before, with ``before``."""
    order = ["ts", "seq"] if "seq" in log.columns else ["ts", "state"]
    marked = log.withColumn("before", F.lag("state").over(Window.partitionBy("id").orderBy(*order)))
    return marked.where(F.col("before").isNull() | (F.col("before") != F.col("state")))


def _elapsed_ms(rows: DataFrame) -> Column:
    if not {"started_at", "completed_at"} <= set(rows.columns):
        return F.lit(None)
    return F.expr("timestampdiff(MILLISECOND, started_at, completed_at)")


def job_events(log: DataFrame) -> DataFrame:
    """Events of jobs from their changelog: five kinds. A finished job carries its time, a failed one its error, a retried one its attempt and next time."""
    rows = _changed(log)
    state = F.col("state")
    kind = (
        F.when((state == "pending") & F.col("before").isNull(), "job.enqueued")
        .when(state == "running", "job.started")
        .when(state.isin("completed", "failed", "retrying"), F.concat(F.lit("job."), state))
    )
    only = lambda when, c: F.when(state == when, F.col(c) if c in rows.columns else F.lit(None))
    return _events(
        rows, kind, "ts", F.concat(F.lit("job:"), "id"), "id", elapsed_ms=F.when(state == "completed", _elapsed_ms(rows)), error=only("failed", "error"), attempt=only("retrying", "retry_count"),
        next_run_at=only("retrying", "run_at"), retry_count=only("failed", "retry_count"), max_retries=only("failed", "max_retries"), worker_id=only("running", "worker_id"), job_id=F.lit(None),
    )


def run_events(log: DataFrame) -> DataFrame:
    """Events of runs from their changelog: started, also again, completed and failed."""
    rows = _changed(log)
    state = F.col("state")
    kind = F.when(state == "running", "workflow.started").when(state.isin("completed", "failed"), F.concat(F.lit("workflow."), state))
    return _events(rows, kind, "ts", F.concat(F.lit("workflow:"), "id"), "id", elapsed_ms=F.when(state == "completed", _elapsed_ms(rows)), error=F.when(state == "failed", F.col("error") if "error" in rows.columns else F.lit(None)))


def step_events(steps: DataFrame, runs: DataFrame) -> DataFrame:
    """Events of steps (run_id, step_name, ts, and elapsed_ms and error where known): failed with an error, else completed."""
    about = [c for c in ("name", "scope_app_id", "scope_org_id") if c in runs.columns]
    own = steps.select("run_id", "step_name", "ts", *(F.col(c) if c in steps.columns else F.lit(None).cast(CARRIED[c]).alias(c) for c in ("elapsed_ms", "error")))
    rows = own.join(runs.select(F.col("id").alias("__run"), *about), F.col("run_id") == F.col("__run"))
    failed = F.col("error").isNotNull()
    return _events(rows, F.when(failed, "workflow.step_failed").otherwise("workflow.step_completed"), "ts", F.concat(F.lit("workflow:"), "run_id"), "run_id", elapsed_ms=F.when(~failed, F.col("elapsed_ms")))


def letter_events(letters: DataFrame) -> DataFrame:
    """A job.dlq for each dead letter (job_id, job_name, queue, failed_at, ...)."""
    return _events(letters, F.lit("job.dlq"), "failed_at", F.concat(F.lit("job:"), "job_id"), "job_id", name=F.col("job_name"), max_retries=F.lit(None), job_id=F.lit(None))


def fire_events(fired: DataFrame) -> DataFrame:
    """A cron.fired for each (entry_name, job_id, ts); it has no topic of its own."""
    return _events(fired, F.lit("cron.fired"), "ts", F.lit(None).cast("string"), "entry_name", name=F.col("entry_name"))


def every_event(jobs: DataFrame, runs: DataFrame, steps: DataFrame, letters: DataFrame, fired: DataFrame) -> DataFrame:
    """All twelve kinds, from the changelogs of jobs and runs, the steps done and failed, the dead letters and what schedules fired."""
    newest = latest(runs, ["id"], [F.desc("ts"), F.desc("seq")]) if "seq" in runs.columns else latest(runs, ["id"], [F.desc("ts"), F.desc("state")])
    parts = [job_events(jobs), run_events(runs), step_events(steps, newest), letter_events(letters), fire_events(fired)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _said(*fields: tuple[str, Column]) -> Column:
    """JSON of the fields that aren't null."""
    return F.to_json(F.struct(*(value.alias(name) for name, value in fields)))


def _some(c: str) -> Column:
    """The value, null where it is empty or 0: such fields are left out."""
    return F.when(F.col(c).cast("string").isin("", "0"), None).otherwise(F.col(c))


def _next() -> Column:
    """RFC 3339, whole seconds, in UTC."""
    return F.date_format("next_run_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")


def envelope(events: DataFrame) -> DataFrame:
    """(type, ts, topic, data) as a stream sends them; data is JSON without empty fields but for those that name the entity."""
    scopes = [("scope_app_id", _some("scope_app_id")), ("scope_org_id", _some("scope_org_id"))]
    job = _said(("job_id", F.col("id")), ("job_name", F.col("name")), ("queue", F.col("queue")), *scopes, ("elapsed_ms", _some("elapsed_ms")), ("error", _some("error")), ("attempt", _some("attempt")), ("next_run_at", _next()))
    run = _said(("run_id", F.col("id")), ("name", F.col("name")), ("step_name", _some("step_name")), *scopes, ("elapsed_ms", _some("elapsed_ms")), ("error", _some("error")))
    fired = _said(("entry_name", F.col("id")), ("job_id", F.col("job_id")))
    data = F.when(F.col("type").startswith("job."), job).when(F.col("type").startswith("workflow."), run).otherwise(fired)
    return events.select("type", "ts", F.coalesce("topic", F.lit("")).alias("topic"), data.alias("data"))


def audit_records(events: DataFrame, actions: list[str] | None = None) -> DataFrame:
    """audit() of whole events, with the reason, which is the error of what failed, and metadata: JSON with its keys in order."""
    rows = events.where(F.col("type").isin(*(actions or EVENTS)))
    job, run = F.col("type").startswith("job."), F.col("type").startswith("workflow.")
    fields = {
        "attempt": F.col("attempt"), "elapsed_ms": F.col("elapsed_ms"), "error": F.col("error"), "job_id": F.col("job_id"), "job_name": F.when(job, F.col("name")), "max_retries": F.col("max_retries"),
        "next_run_at": _next(), "queue": F.when(job, F.col("queue")), "retry_count": F.col("retry_count"), "step_name": F.col("step_name"), "worker_id": F.col("worker_id"), "workflow_name": F.when(run, F.col("name")),
    }
    return rows.select(
        "ts", F.col("type").alias("action"), _by_type(2).alias("resource"), F.col("id").alias("resource_id"), F.substring_index("type", ".", 1).alias("category"), _by_type(1).alias("outcome"), _by_type(0).alias("severity"),
        F.coalesce("error", F.lit("")).alias("reason"), _said(*fields.items()).alias("metadata"),
    )


def webhook_events(events: DataFrame, enabled: list[str] | None = None) -> DataFrame:
    """(event, group, tenant, payload) for a webhook sink; the tenant is the entity's organisation. Events that took time always say how long."""
    rows = events.where(F.col("type").isin(*(enabled or EVENTS)))
    scopes = [("scope_app_id", _some("scope_app_id")), ("scope_org_id", _some("scope_org_id"))]
    failed = F.when(F.col("type").isin("job.failed", "job.dlq", "workflow.failed"), F.coalesce("error", F.lit(""))).otherwise(_some("error"))
    took = F.when(F.col("type").isin("job.completed", "workflow.completed"), F.coalesce("elapsed_ms", F.lit(0))).otherwise(_some("elapsed_ms"))
    job = _said(("job_id", F.col("id")), ("job_name", F.col("name")), ("queue", F.col("queue")), *scopes, ("elapsed_ms", took), ("error", failed), ("attempt", F.col("attempt")), ("next_run_at", _next()))
    run = _said(("run_id", F.col("id")), ("name", F.col("name")), *scopes, ("step_name", F.col("step_name")), ("elapsed_ms", took), ("error", failed))
    fired = _said(("entry_name", F.col("id")), ("job_id", F.col("job_id")))
    payload = F.when(F.col("type").startswith("job."), job).when(F.col("type").startswith("workflow."), run).otherwise(fired)
    return rows.select("ts", F.col("type").alias("event"), _by_type(3).alias("group"), F.coalesce("scope_org_id", F.lit("")).alias("tenant"), payload.alias("payload"))


def fan_out(events: DataFrame) -> DataFrame:
    """One row an event and topic."""
    return events.withColumn("to_topic", F.explode(resolve_topics("type", "topic")))


def deliveries(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(event_id, subscriber, type, ts): every subscriber of any of an event's topics gets it once."""
    met = fan_out(events).join(subscriptions.select(F.col("topic").alias("__topic"), "subscriber"), F.col("to_topic") == F.col("__topic"))
    return met.select("event_id", "subscriber", "type", "ts").distinct()


def with_credits(delivered: DataFrame, credits: DataFrame, default: int = 1000, wanted: Column | None = None) -> DataFrame:
    """Each subscriber's first deliveries, as many as it has credits; the rest are dropped silently. ``wanted`` is
    the subscribers' filter: what it refuses costs no credit.

    No subscriber has more than the largest number of credits, which is a constant of the plan: Spark keeps that
    many rows of a subscriber a task before it shuffles them."""
    passed = delivered if wanted is None else delivered.where(wanted)
    most = max(default, credits.agg(F.max("credits")).first()[0] or 0)
    rank = F.row_number().over(Window.partitionBy("subscriber").orderBy("ts", "event_id"))
    first = passed.withColumn("__rank", rank).where(F.col("__rank") <= most)
    known = credits.select(F.col("subscriber").alias("__sub"), F.col("credits").alias("__credits"))
    joined = first.join(known, F.col("subscriber") == F.col("__sub"), "left")
    return joined.where(F.col("__rank") <= F.coalesce("__credits", F.lit(default))).select(*delivered.columns)


def with_replenished_credits(delivered: DataFrame, grants: DataFrame, credits: DataFrame, default: int = 1000, wanted: Column | None = None) -> DataFrame:
    """The deliveries that find a credit, and ``credits_left``, what they leave. Each takes one; one that finds none is dropped.
    ``grants`` (subscriber, ts, n) add to what is left, never below 0; a grant counts for deliveries of its own time.
    A subscriber begins with its own ``credits`` or the default. ``wanted`` is the subscribers' filter, as in with_credits().

    What is left is a running sum less its running minimum, by parts of a subscriber: no task holds one whole."""
    passed = delivered if wanted is None else delivered.where(wanted)
    taken = passed.withColumn("__kind", F.lit(1)).withColumn("__change", F.lit(-1).cast("bigint"))
    added = grants.select("subscriber", "ts", F.lit(0).alias("__kind"), F.greatest(F.col("n"), F.lit(0)).cast("bigint").alias("__change"))
    known = credits.select(F.col("subscriber").alias("__sub"), F.col("credits").alias("__credits"))
    rows = scan.in_order(taken.unionByName(added, allowMissingColumns=True), ["subscriber"], [F.asc("ts"), F.asc("__kind"), F.asc("event_id")])
    rows = rows.join(known, F.col("subscriber") == F.col("__sub"), "left").withColumn("__start", F.greatest(F.coalesce("__credits", F.lit(default)), F.lit(0)).cast("bigint"))
    run = scan.running_floor(rows, ["subscriber"], "__change", F.col("__start"))
    return run.where("__kind = 1 AND __sum >= __floor").select(*delivered.columns, (F.col("__sum") - F.col("__floor")).alias("credits_left"))


#: Events of a topic in a slice of time.
SLICE_ROWS = 100_000


def subscription_spans(changes: DataFrame) -> DataFrame:
    """(subscriber, topic, since, until) in which subscriptions were in force, from a changelog (subscriber, topic, ts, seq, active); ``until``
    is the first time without it, null where it still is. A change without a topic ends all of the subscriber's subscriptions."""
    own = changes.where("topic IS NOT NULL").select("subscriber", "topic", "ts", "seq", "active")
    gone = changes.where("topic IS NULL AND NOT active").select(F.col("subscriber").alias("__sub"), "ts", "seq", "active")
    ended = own.select("subscriber", "topic").distinct().join(gone, F.col("subscriber") == F.col("__sub")).select("subscriber", "topic", "ts", "seq", "active")
    after = F.lead("ts").over(Window.partitionBy("subscriber", "topic").orderBy("ts", "seq"))
    return own.unionByName(ended).withColumn("until", after).where("active").select("subscriber", "topic", F.col("ts").alias("since"), "until").where("until IS NULL OR until > since")


def deliveries_in_force(events: DataFrame, changes: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(event_id, subscriber, type, ts): who was subscribed to any of an event's topics at the event's time gets it, once.

    Events meet spans by topic and slice of time: a topic's time is cut into slices of some ``slice_rows`` events, and a span
    stands in each slice that it reaches into, so a hot topic is many tasks' work and no event is held against
    spans of other times than its slice."""
    sent = fan_out(events)
    second = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / F.lit(1_000_000)
    sliced = sent.groupBy(F.col("to_topic").alias("__topic")).agg(F.min(second("ts")).alias("__first"), F.max(second("ts")).alias("__last"), F.ceil(F.count("*") / slice_rows).alias("__slices"))
    sliced = cut(sliced.withColumn("__width", F.greatest((F.col("__last") - F.col("__first")) / F.col("__slices"), F.lit(1.0))))
    number = lambda s: F.floor((s - F.col("__first")) / F.col("__width"))
    placed = sent.join(sliced, F.col("to_topic") == F.col("__topic")).withColumn("__slice", number(second("ts"))).select("event_id", "type", "ts", "to_topic", "__slice")
    spans = subscription_spans(changes).join(sliced, F.col("topic") == F.col("__topic"))
    spans = spans.withColumn("__from", F.greatest(second("since"), F.col("__first"))).withColumn("__to", F.least(F.coalesce(second("until"), F.col("__last")), F.col("__last"))).where("__from <= __to")
    spans = spans.select("subscriber", F.col("topic").alias("__on"), "since", "until", F.explode(F.sequence(number(F.col("__from")), number(F.col("__to")))).alias("__in"))
    same = (F.col("to_topic") == F.col("__on")) & (F.col("__slice") == F.col("__in")) & (F.col("ts") >= F.col("since")) & (F.col("until").isNull() | (F.col("ts") < F.col("until")))
    return placed.join(spans, same).select("event_id", "subscriber", "type", "ts").distinct()


def subscriptions_now(changes: DataFrame) -> DataFrame:
    """(subscriber, topic) in force, from a changelog (subscriber, topic, seq, active)."""
    return latest(changes, ["subscriber", "topic"], [F.desc("seq")]).where("active").select("subscriber", "topic")


def broker_stats(delivered: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Topics, subscribers and deliveries; dropped is always 0, as drops are not counted."""
    named = subscriptions.agg(F.count_distinct("topic").alias("topics"), F.count_distinct("subscriber").alias("subscribers"))
    return named.crossJoin(delivered.agg(F.count("*").alias("published"))).withColumn("dropped", F.lit(0).cast("bigint"))


def counters(events: DataFrame) -> DataFrame:
    return events.groupBy("type").agg(F.count("*").alias("n"))


def audit(events: DataFrame, actions: list[str] | None = None) -> DataFrame:
    """A flat audit record an event: action, resource, its id, category, outcome, severity. ``actions`` keeps only those."""
    rows = events.where(F.col("type").isin(*(actions or EVENTS)))
    return rows.select(
        "event_id", "ts", F.col("type").alias("action"), _by_type(2).alias("resource"), F.substring_index("topic", ":", -1).alias("resource_id"),
        F.substring_index("type", ".", 1).alias("category"), _by_type(1).alias("outcome"), _by_type(0).alias("severity"),
    )


def webhooks(events: DataFrame, tenant: Column | None = None) -> DataFrame:
    """Typed events for a webhook sink, with group and tenant."""
    rows = events.where(F.col("type").isin(*EVENTS))
    payload = F.to_json(F.struct("ts", "topic", "elapsed_ms"))
    return rows.select("event_id", F.col("type").alias("event"), _by_type(3).alias("group"), (F.lit("") if tenant is None else tenant).alias("tenant"), payload.alias("payload"))


def catalog(events: DataFrame) -> DataFrame:
    """The events a webhook can ask for that there are, with their groups and numbers."""
    rows = events.where(F.col("type").isin(*EVENTS))
    return rows.groupBy(F.col("type").alias("event"), _by_type(3).alias("group")).agg(F.count("*").alias("n"))
