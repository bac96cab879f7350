"""Reading, claiming and changing jobs. No function reads the clock: now is ``as_of``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.operators.changelog import change, page
from ledgerflow.schema import CLAIMABLE, JOB_STATES
from ledgerflow.sources.entities import plus


def null_ts() -> Column:
    return F.lit(None).cast("timestamp_ntz")


def eligible(jobs: DataFrame, queues: Sequence[str] | None, as_of: Column) -> DataFrame:
    """Jobs that can be claimed; no queues means every queue."""
    rows = jobs.where(F.col("state").isin(*CLAIMABLE) & (F.col("run_at") <= as_of))
    return rows.where(F.col("queue").isin(*queues)) if queues else rows


def claim(jobs: DataFrame, queues: Sequence[str] | None, limit: int, as_of: Column) -> DataFrame:
    """The first ``limit`` eligible jobs by priority, time and id, as running; a limit of 0 or less claims all."""
    order = [F.desc("priority"), F.asc("run_at"), F.asc("id")]
    return change(page(eligible(jobs, queues, as_of), order, max(limit, 0)), F.lit(True), state=F.lit("running"), started_at=as_of)


def get(jobs: DataFrame, id_: str) -> DataFrame:
    return jobs.where(F.col("id") == id_)


def list_by_state(rows: DataFrame, state: str, queue: str | None = None, limit: int = 0, offset: int = 0, newest: bool = False) -> DataFrame:
    """Rows of one state by creation, oldest first as in the engine's own lists."""
    rows = rows.where(F.col("state") == state)
    if queue:
        rows = rows.where(F.col("queue") == queue)
    return page(rows, [F.desc("created_at") if newest else F.asc("created_at"), F.asc("id")], limit, offset)


def stale(jobs: DataFrame, threshold: float, as_of: Column) -> DataFrame:
    """Running jobs whose heartbeat, or start where there is none, is older than the threshold."""
    return jobs.where((F.col("state") == "running") & (F.coalesce("heartbeat_at", "started_at") < plus(as_of, -threshold)))


def count(jobs: DataFrame, queue: str | None = None, state: str | None = None) -> DataFrame:
    for column, value in (("queue", queue), ("state", state)):
        if value:
            jobs = jobs.where(F.col(column) == value)
    return jobs.agg(F.count("*").alias("n"))


def counts_by_state(rows: DataFrame, states: Sequence[str] = JOB_STATES) -> DataFrame:
    """One row with a count a state, in one pass."""
    return rows.agg(*(F.count_if(F.col("state") == s).alias(s) for s in states))


def counts_pivot(jobs: DataFrame) -> DataFrame:
    """A row a queue with a count a state."""
    return jobs.groupBy("queue").pivot("state", list(JOB_STATES)).count().na.fill(0)


def first_per_state(jobs: DataFrame, states: Sequence[str], per_state: int, limit: int, newest: bool = False) -> DataFrame:
    """At most ``per_state`` jobs of each state, states in the order given, ``limit`` in all.

    Each state is a sorted limit of its own, so no window ranks a whole state in one task."""
    order = F.create_map(*[F.lit(x) for i, s in enumerate(states) for x in (s, i)])
    found = None
    for state in states:
        part = list_by_state(jobs, state, None, per_state, 0, newest)
        found = part if found is None else found.unionByName(part)
    return found.withColumn("__rank", order[F.col("state")]).orderBy("__rank", F.desc("created_at") if newest else F.asc("created_at"), "id").limit(limit).drop("__rank")


def recent(jobs: DataFrame, newest: bool = False) -> DataFrame:
    """Five each of running, completed and failed, ten in all; the oldest of each, as the dashboard lists them."""
    return first_per_state(jobs, ("running", "completed", "failed"), 5, 10, newest)


def all_states(jobs: DataFrame, limit: int) -> DataFrame:
    return first_per_state(jobs, JOB_STATES, limit, limit)


def queue_detail(jobs: DataFrame, queue: str, limit: int) -> DataFrame:
    """A queue's jobs of five states, and how many it has in all."""
    own = jobs.where(F.col("queue") == queue)
    states = ("pending", "running", "completed", "failed", "retrying")
    return first_per_state(own, states, limit, limit).crossJoin(F.broadcast(own.agg(F.count("*").alias("total"))))


def search(rows: DataFrame, text: str, *columns: str) -> DataFrame:
    """Rows with the text in any of the columns, in any case."""
    hit = F.lit(False)
    for c in columns or ("name",):
        hit = hit | F.lower(F.col(c)).contains(text.lower())
    return rows.where(hit)


def with_defaults(new: DataFrame, as_of: Column) -> DataFrame:
    """A raw request as a pending job: queue, retries, timeout, priority and time where they are null."""
    defaults = {"queue": F.lit("default"), "max_retries": F.lit(3), "timeout_ms": F.lit(300000).cast("bigint"), "priority": F.lit(0), "run_at": as_of}
    rows = new.select(*(F.coalesce(F.col(c), defaults[c]).alias(c) if c in defaults else F.col(c) for c in new.columns))
    return rows.withColumn("state", F.lit("pending")).withColumn("retry_count", F.lit(0)).withColumn("created_at", as_of)


def cancel(jobs: DataFrame, ids: Column, as_of: Column) -> DataFrame:
    """Only pending and retrying jobs are cancelled, with a completion time."""
    return change(jobs, ids & F.col("state").isin(*CLAIMABLE), state=F.lit("cancelled"), completed_at=as_of)


def cancel_any(jobs: DataFrame, ids: Column) -> DataFrame:
    """The wire protocol's cancel: any state, no completion time."""
    return change(jobs, ids, state=F.lit("cancelled"))


def retry(jobs: DataFrame, ids: Column) -> DataFrame:
    """Failed jobs start anew."""
    return change(jobs, ids & (F.col("state") == "failed"), state=F.lit("pending"), retry_count=F.lit(0), started_at=null_ts(), completed_at=null_ts())


def heartbeat(jobs: DataFrame, beats: DataFrame) -> DataFrame:
    """``beats`` (id, ts): each job takes its last one, whatever its state."""
    last = beats.groupBy(F.col("id").alias("__id")).agg(F.max("ts").alias("__ts"))
    joined = jobs.join(last, F.col("id") == F.col("__id"), "left")
    return joined.withColumn("heartbeat_at", F.coalesce("__ts", "heartbeat_at")).select(*jobs.columns)


def active_by_queue(jobs: DataFrame) -> DataFrame:
    return jobs.where("state = 'running'").groupBy("queue").agg(F.count("*").alias("active"))


def concurrency(jobs: DataFrame, end: Column) -> DataFrame:
    """(queue, ts, active): how many jobs of a queue run after each start or end. Open jobs end at ``end``.

    Starts and ends are first summed by queue and time, then by queue and day. Days are summed up a queue, moments
    within a day: no task has a queue's whole history."""
    ran = jobs.where("started_at IS NOT NULL")
    starts = ran.select("queue", F.col("started_at").alias("ts"), F.lit(1).alias("d"))
    ends = ran.select("queue", F.coalesce("completed_at", end).alias("ts"), F.lit(-1).alias("d"))
    moments = starts.unionByName(ends).groupBy("queue", "ts").agg(F.sum("d").alias("d")).withColumn("day", F.to_date("ts"))
    days = moments.groupBy(F.col("queue").alias("__queue"), F.col("day").alias("__day")).agg(F.sum("d").alias("n"))
    before = F.sum("n").over(Window.partitionBy("__queue").orderBy("__day")) - F.col("n")
    same = F.col("queue").eqNullSafe(F.col("__queue")) & (F.col("day") == F.col("__day"))
    running = F.sum("d").over(Window.partitionBy("queue", "day").orderBy("ts"))
    return moments.join(days.select("__queue", "__day", before.alias("before")), same).select("queue", "ts", (F.col("before") + running).alias("active"))
