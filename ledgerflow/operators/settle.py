"""What becomes of jobs that ran, were refused, or went stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.functions import scalar
from ledgerflow.operators import scan
from ledgerflow.operators.changelog import change
from ledgerflow.operators.jobs import null_ts, stale
from ledgerflow.sources.entities import plus


def outcomes(claimed: DataFrame, results: DataFrame) -> DataFrame:
    """``claimed`` with ``ok`` and ``error`` of ``results`` (id, ok, error); jobs without a result are left out."""
    named = results.select(F.col("id").alias("__id"), "ok", "error")
    return claimed.join(named, F.col("id") == F.col("__id")).drop("__id")


def succeed(done: DataFrame, as_of: Column) -> DataFrame:
    """Jobs with a good outcome, completed."""
    return change(done.where("ok"), F.lit(True), state=F.lit("completed"), completed_at=as_of).drop("ok", "error")


def failed(done: DataFrame) -> DataFrame:
    """Jobs with a bad outcome, one retry counted."""
    return change(done.where("NOT ok"), F.lit(True), retry_count=F.col("retry_count") + 1)


def schedule_retries(done: DataFrame, as_of: Column, delay: Column | None = None) -> DataFrame:
    """Failed jobs with retries left, due after a delay: full jitter of 1 s to 60 s unless given."""
    delay = scalar.backoff_jitter("retry_count", "id") if delay is None else delay
    left = failed(done).where("retry_count <= max_retries")
    return change(left, F.lit(True), state=F.lit("retrying"), run_at=plus(as_of, delay)).drop("ok", "error")


def give_up(done: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Failed jobs without retries left, and their dead letters: copies, with payload and scopes where jobs have them."""
    spent = failed(done).where("retry_count > max_retries")
    jobs = change(spent, F.lit(True), state=F.lit("failed"), completed_at=as_of).drop("ok", "error")
    letters = spent.select(
        F.concat(F.lit("dlq_"), F.substring_index("id", "_", -1)).alias("id"), F.col("id").alias("job_id"), F.col("name").alias("job_name"),
        "queue", "error", "retry_count", "max_retries", "scope_org_id", as_of.alias("failed_at"), null_ts().alias("replayed_at"), *(c for c in ("payload", "scope_app_id") if c in spent.columns),
    )
    return jobs, letters


def refuse(jobs: DataFrame, which: Column, as_of: Column, poll: float = 1.0) -> DataFrame:
    """Jobs refused by a rate limit wait a poll; their start is kept."""
    return change(jobs, which, state=F.lit("pending"), run_at=plus(as_of, poll))


def hand_back(jobs: DataFrame, which: Column, as_of: Column) -> DataFrame:
    """Claimed jobs that no worker took are due at once."""
    return change(jobs, which, state=F.lit("pending"), run_at=as_of, started_at=null_ts())


def reap(jobs: DataFrame, threshold: float, as_of: Column) -> DataFrame:
    """Stale jobs as pending ones, with no retry counted."""
    return change(stale(jobs, threshold, as_of), F.lit(True), state=F.lit("pending"), run_at=as_of, heartbeat_at=null_ts(), started_at=null_ts())


def metrics(done: DataFrame, part: float = 0.95) -> DataFrame:
    """Executions, failures and times by job name; failures count as executions.

    The percentile is exact and no task holds a name's times: they are ranked by ranges, and only the two around the
    wanted place are taken."""
    named = done.withColumn("__key", F.coalesce(F.concat(F.lit("="), "name"), F.lit("-")))
    sums = named.groupBy("__key", "name").agg(F.count("*").alias("executions"), F.count_if(~F.col("ok")).alias("failures"), F.count("elapsed_ms").alias("__timed"), F.max("elapsed_ms").alias("max_ms"))
    timed = scan.in_order(named.where("elapsed_ms IS NOT NULL").select(F.col("__key").alias("__name"), "elapsed_ms"), ["__name"], [F.asc("elapsed_ms")])
    placed = scan.numbered(timed, ["__name"], "__place").select("__name", "elapsed_ms", "__place")
    place = F.lit(part) * (F.col("__timed") - 1)
    near = placed.join(sums.select("__key", "__timed"), F.col("__name") == F.col("__key")).where(F.col("__place").isin(F.floor(place), F.ceil(place)))
    share = F.when(F.floor(place) == F.ceil(place), 1.0).otherwise(1 - F.abs(place - F.col("__place")))
    p95 = near.groupBy("__name").agg(F.sum(F.col("elapsed_ms") * share).alias("p95_ms"))
    return sums.join(p95, F.col("__key") == F.col("__name"), "left").select("name", "executions", "failures", "p95_ms", "max_ms")
