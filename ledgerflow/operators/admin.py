"""Reports of the admin pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.functions.scalar import health_label
from ledgerflow.operators.jobs import active_by_queue, counts_by_state
from ledgerflow.schema import RUN_STATES


def _prefixed(row: DataFrame, prefix: str) -> DataFrame:
    return row.select(*(F.col(c).alias(prefix + c) for c in row.columns))


def stats(jobs: DataFrame, runs: DataFrame, dlq: DataFrame) -> DataFrame:
    """Counts of jobs and runs by state, and of dead letters: three aggregates of a row each."""
    letters = dlq.agg(F.count("*").alias("dlq"))
    return _prefixed(counts_by_state(jobs), "jobs_").crossJoin(letters).crossJoin(_prefixed(counts_by_state(runs, RUN_STATES), "runs_"))


def overview(jobs: DataFrame, runs: DataFrame, dlq: DataFrame, crons: DataFrame, workers: DataFrame) -> DataFrame:
    total = sum((F.col(f"jobs_{s}") for s in ("running", "completed", "failed", "retrying", "cancelled")), F.col("jobs_pending"))
    rows = stats(jobs, runs, dlq).crossJoin(crons.agg(F.count("*").alias("crons"))).crossJoin(workers.agg(F.count("*").alias("workers")))
    return rows.withColumn("health", health_label(F.col("jobs_failed"), F.col("dlq"), total))


def run_detail(runs: DataFrame, checkpoints: DataFrame, run_id: str) -> DataFrame:
    """A run with how many checkpoints and children it has."""
    steps = checkpoints.where(F.col("run_id") == run_id).agg(F.count("*").alias("steps"))
    below = runs.where(F.col("parent_run_id") == run_id).agg(F.count("*").alias("children"))
    return runs.where(F.col("id") == run_id).select("id", "name", "state").crossJoin(steps).crossJoin(below)


def queue_info(jobs: DataFrame, config: DataFrame, slots: Column) -> DataFrame:
    """Every configured queue with its limit, what runs, and the slots idle over all queues.
    ``config``: (queue, max_concurrency), a row a queue."""
    active = active_by_queue(jobs).withColumnRenamed("queue", "__queue")
    rows = config.join(active, F.col("queue") == F.col("__queue"), "left").select("queue", "max_concurrency", F.coalesce("active", F.lit(0)).alias("active"))
    used = rows.agg(F.sum("active").alias("__used"))
    return rows.crossJoin(F.broadcast(used)).select("queue", "max_concurrency", "active", F.greatest(slots - F.col("__used"), F.lit(0)).cast("bigint").alias("idle"))
