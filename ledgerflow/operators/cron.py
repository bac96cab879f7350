"""Schedules: what is due, who may fire it, and what firing does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.functions.cron import next_run
from ledgerflow.operators.changelog import change, insert, page
from ledgerflow.operators.jobs import null_ts, search
from ledgerflow.sources.entities import plus


def due(crons: DataFrame, as_of: Column) -> DataFrame:
    return crons.where(F.col("enabled") & (F.col("next_run_at") <= as_of))


def register(crons: DataFrame, new: DataFrame, as_of: Column) -> DataFrame:
    """New entries by name, with their next time; a name that is taken or a bad schedule changes nothing."""
    ready = new.withColumn("next_run_at", next_run(F.col("schedule"), as_of)).withColumn("enabled", F.lit(True)).where("next_run_at IS NOT NULL")
    return insert(crons, ready, "name")


def fire(crons: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(crons, jobs) after firing all that is due once: missed times collapse, as the next one counts from now.

    A job goes to its entry's queue, ``default`` where the entry names none, with its payload and scopes; the entry
    keeps the time in last_run_at. Entries without those columns are taken to have none."""
    ready = F.coalesce(F.col("enabled") & (F.col("next_run_at") <= as_of), F.lit(False))
    jobs = crons.where(ready).select(
        F.concat(F.lit("job_"), F.substring_index("id", "_", -1)).alias("id"), F.col("job_name").alias("name"), _queue(crons).alias("queue"),
        F.lit("pending").alias("state"), as_of.alias("run_at"), as_of.alias("created_at"), *(c for c in ("payload", "scope_app_id", "scope_org_id") if c in crons.columns),
    )
    return change(crons, ready, next_run_at=next_run(F.col("schedule"), as_of), last_run_at=as_of), jobs


def fired(crons: DataFrame, as_of: Column) -> DataFrame:
    """(entry_name, job_id, ts) of what fire() fires."""
    return due(crons, as_of).select(F.col("name").alias("entry_name"), F.concat(F.lit("job_"), F.substring_index("id", "_", -1)).alias("job_id"), as_of.alias("ts"))


def _queue(crons: DataFrame) -> Column:
    named = F.col("queue") if "queue" in crons.columns else F.lit(None).cast("string")
    return F.coalesce(F.when(named != "", named), F.lit("default"))


def mark_run(crons: DataFrame, ids: Column, as_of: Column) -> DataFrame:
    """The time of the last run, set by itself."""
    return change(crons, ids, last_run_at=as_of)


def acquire_locks(crons: DataFrame, claims: DataFrame, as_of: Column, ttl: float = 30.0) -> DataFrame:
    """``crons`` with locked_by and locked_until; ``claims`` (cron_id, worker_id, claimed_at). A lock that is
    free, over or the worker's own goes to the first claim by time and worker; others change nothing."""
    first = claims.groupBy("cron_id").agg(F.min(F.struct("claimed_at", "worker_id")).alias("c"))
    own = claims.join(crons.select(F.col("id").alias("__id"), F.col("locked_by").alias("__holder"), "locked_until"), F.col("cron_id") == F.col("__id"))
    holds = own.where((F.col("worker_id") == F.col("__holder")) & (F.col("locked_until") >= as_of)).select(F.col("cron_id").alias("__held"), F.col("worker_id").alias("__own")).distinct()
    joined = crons.join(first, F.col("id") == F.col("cron_id"), "left").join(holds, F.col("id") == F.col("__held"), "left")
    free = F.col("locked_by").isNull() | (F.col("locked_until") < as_of)
    winner = F.when(free, F.col("c.worker_id")).otherwise(F.col("__own"))
    return change(joined.withColumn("__winner", winner), F.col("__winner").isNotNull(), locked_by=F.col("__winner"), locked_until=plus(as_of, ttl)).select(*crons.columns)


def release_locks(crons: DataFrame, worker: str) -> DataFrame:
    return change(crons, F.col("locked_by") == worker, locked_by=F.lit(None).cast("string"), locked_until=null_ts())


def toggle(crons: DataFrame, ids: Column, enabled: bool) -> DataFrame:
    """The flag only: an entry disabled for long is due at once when it comes back."""
    return change(crons, ids, enabled=F.lit(enabled))


def find(crons: DataFrame, text: str, limit: int, offset: int = 0) -> DataFrame:
    """By entry or job name, then a page of what is found."""
    return page(search(crons, text, "name", "job_name"), [F.asc("id")], limit, offset)
