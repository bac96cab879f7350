"""The engine's entities as views over a TPC-H-like schema, for tests, benches and demonstrations.

Each function reads one Parquet table and projects it, so filters and column choices reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2000-01-01 00:00:00"
AS_OF_EVENTS = "2024-01-31 00:00:00"


def at(text: str) -> Column:
    """A timestamp without time zone."""
    return F.lit(text).cast("timestamp_ntz")


def plus(ts: Column, seconds: Column | int | float) -> Column:
    """``ts`` and so many seconds, which may have a fraction."""
    seconds = seconds if isinstance(seconds, Column) else F.lit(seconds)
    zero = F.lit(0)
    return ts + F.make_interval(zero, zero, zero, zero, zero, zero, seconds)


def _pad(key: Column) -> Column:
    return F.lpad(key.cast("string"), 10, "0")


def _id(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), _pad(key))


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    state = (
        F.when(status == "F", F.when(k % 5 == 0, "failed").otherwise("completed"))
        .when(status == "O", F.when(k % 3 == 0, "retrying").otherwise("pending"))
        .otherwise(F.when(k % 7 == 0, "cancelled").otherwise("running"))
    )
    queue = F.element_at(F.array(*map(F.lit, ("default", "critical", "bulk", "email"))), (F.col("o_custkey") % 4 + 1).cast("int"))
    run_at = plus(F.col("o_orderdate"), k % 86400)
    started = plus(run_at, 5)
    rows = _read(spark, sf_dir, "orders").select(
        _id("job", k).alias("id"),
        F.concat(F.lit("handler_"), (k % 8).cast("string")).alias("name"),
        queue.alias("queue"),
        state.alias("state"),
        (6 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"),
        F.lit(3).alias("max_retries"),
        F.when(state == "failed", 4).when(state == "retrying", (1 + F.expr("o_orderkey div 3") % 3).cast("int")).otherwise(0).alias("retry_count"),
        F.concat(F.lit("org_"), (F.col("o_custkey") % 10).cast("string")).alias("scope_org_id"),
        F.col("o_orderdate").alias("created_at"),
        run_at.alias("run_at"),
        F.when(status != "O", started).alias("started_at"),
        F.when(status == "F", plus(run_at, 5 + F.floor(F.col("o_totalprice") / 1000))).alias("completed_at"),
        F.when((status == "P") & (k % 2 == 0), plus(run_at, 30)).alias("heartbeat_at"),
    )
    return rows


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, status, day = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderdate")
    return _read(spark, sf_dir, "orders").select(
        _id("wfrun", k).alias("id"),
        F.concat(F.lit("wf_"), (k % 5).cast("string")).alias("name"),
        (1 + k % 3).cast("int").alias("version"),
        F.when(status == "F", "completed").when(status == "P", "failed").otherwise("running").alias("state"),
        F.when(k % 4 != 0, _id("wfrun", k - k % 4)).alias("parent_run_id"),
        day.alias("started_at"),
        day.alias("created_at"),
        F.when(status != "O", plus(day, 60 + F.floor(F.col("o_totalprice") / 100))).alias("completed_at"),
    )


def checkpoint_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").select(
        _id("wfrun", F.col("l_orderkey")).alias("run_id"),
        F.concat(F.lit("step-"), F.col("l_linenumber").cast("string")).alias("step_name"),
        F.col("l_shipdate").alias("created_at"),
        F.col("l_partkey"),
        F.col("l_suppkey"),
        F.col("l_extendedprice"),
    )


def dlq(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = jobs(spark, sf_dir).where("state = 'failed'")
    key = F.substring("id", 5, 10)
    return failed.select(
        F.concat(F.lit("dlq_"), key).alias("id"),
        F.col("id").alias("job_id"),
        F.col("name").alias("job_name"),
        "queue", "retry_count", "max_retries", "scope_org_id",
        F.col("completed_at").alias("failed_at"),
        F.when(key.cast("bigint") % 10 == 0, plus(F.col("completed_at"), 86400)).alias("replayed_at"),
    )


def bus_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select(
        _id("evt", F.col("event_id")).alias("id"),
        F.col("event_type").alias("name"),
        F.col("props").alias("payload"),
        F.concat(F.lit("org_"), (F.col("user_id") % 10).cast("string")).alias("scope_org_id"),
        (F.col("event_id") % 2 == 1).alias("acked"),
        F.col("ts").alias("created_at"),
    )


def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return _read(spark, sf_dir, "events").select(
        _id("evt", F.col("event_id")).alias("event_id"),
        F.when(kind == "signup", "job.enqueued").when(kind == "view", "job.started").when(kind == "purchase", "job.completed").when(kind == "click", "job.retrying").otherwise("job.failed").alias("type"),
        F.col("ts"),
        F.concat(F.lit("job:"), F.col("user_id").cast("string")).alias("topic"),
        F.floor(F.col("value") * 1000).cast("bigint").alias("elapsed_ms"),
    )


def workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    second = F.element_at(F.array(*map(F.lit, ("critical", "bulk", "email"))), (k % 3 + 1).cast("int"))
    return _read(spark, sf_dir, "supplier").select(
        _id("wkr", k).alias("id"),
        F.col("s_name").alias("hostname"),
        F.array(F.lit("default"), second).alias("queues"),
        (10 + k % 5).cast("int").alias("concurrency"),
        F.when(k % 10 == 0, "dead").when(k % 10 == 1, "draining").otherwise("active").alias("state"),
        (k == 2).alias("is_leader"),
        F.when(k == 2, plus(at(AS_OF), 60)).alias("leader_until"),
        plus(at(AS_OF), -3 * k).alias("last_seen"),
    )


def crons(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    schedules = ("*/5 * * * *", "0 * * * *", "0 2 * * *", "30 9 * * 1-5", "0 */6 * * *", "0 0 1 * *", "@every 30s", "* * * * *")
    return _read(spark, sf_dir, "part").select(
        _id("cron", k).alias("id"),
        F.concat("p_name", F.lit("-"), k.cast("string")).alias("name"),
        F.col("p_name").alias("job_name"),
        F.element_at(F.array(*map(F.lit, schedules)), (k % 8 + 1).cast("int")).alias("schedule"),
        (k % 3 != 0).alias("enabled"),
        plus(at(AS_OF), 60 * (k % 120 - 60)).alias("next_run_at"),
    )
