"""Entities kept as append-only Parquet logs in a folder, and an engine over them.

A mutation appends the changed rows with the next sequence number; a table is the latest row per
key, without those marked deleted. One writer at a time: there is no transaction between writers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow.operators import admin, changelog, cluster, dlq, handlers, jobs, settle, workflow
from ledgerflow.schema import ENTITIES, MUTATION, EngineConfig


class Store:
    """Logs of the entities under ``root``, which every executor must see."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def log(self, entity: str) -> DataFrame:
        schema = T.StructType([*ENTITIES[entity].fields, *MUTATION])
        path = f"{self.root}/{entity}"
        # A log that nothing was written to yet is empty.
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
        return self.spark.read.schema(schema).parquet(path) if there else self.spark.createDataFrame([], schema)

    def table(self, entity: str) -> DataFrame:
        return changelog.latest(self.log(entity), ["id"], [F.desc("__seq")]).where("NOT __deleted").drop("__seq", "__deleted")

    def append(self, entity: str, rows: DataFrame, deleted: bool = False) -> int:
        """Append whole rows; columns that ``rows`` lacks are null. Gives their sequence number."""
        number = (self.log(entity).agg(F.max("__seq")).first()[0] or 0) + 1
        have = set(rows.columns)
        whole = rows.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in ENTITIES[entity].fields))
        whole.withColumn("__seq", F.lit(number).cast("bigint")).withColumn("__deleted", F.lit(deleted)).write.mode("append").parquet(f"{self.root}/{entity}")
        return number

    def delete(self, entity: str, ids: Sequence[str]) -> None:
        self.append(entity, self.table(entity).where(F.col("id").isin(*ids)), deleted=True)


class Engine:
    """The client's calls over a store. Every call that changes something takes ``as_of``."""

    def __init__(self, store: Store, registry: handlers.Registry | None = None, config: EngineConfig = EngineConfig()):
        self.store, self.registry, self.config = store, registry or handlers.Registry(), config

    def enqueue(self, requests: DataFrame, as_of: Column) -> None:
        """``requests`` (id, name, payload, and any job columns); ids that are taken are refused."""
        for name, kind in (("queue", "string"), ("max_retries", "int"), ("timeout_ms", "bigint"), ("priority", "int"), ("run_at", "timestamp_ntz")):
            if name not in requests.columns:
                requests = requests.withColumn(name, F.lit(None).cast(kind))
        new = jobs.with_defaults(requests, as_of)
        known = self.store.table("jobs").select(F.col("id").alias("__id"))
        self.store.append("jobs", new.join(known, F.col("id") == F.col("__id"), "left_anti"))

    def get_job(self, id_: str) -> DataFrame:
        return jobs.get(self.store.table("jobs"), id_)

    def cancel_job(self, id_: str, as_of: Column) -> None:
        self.store.append("jobs", jobs.cancel(self.get_job(id_), F.lit(True), as_of))

    def retry_job(self, id_: str) -> None:
        self.store.append("jobs", jobs.retry(self.get_job(id_), F.lit(True)))

    def cycle(self, as_of: Column, queues: Sequence[str] | None = None) -> int:
        """Claim as many jobs as there are slots, run their handlers on the executors, and settle them. Gives their number.

        The claim and the results are written before they are used twice, so handlers run once."""
        number = self.store.append("jobs", jobs.claim(self.store.table("jobs"), queues, self.config.concurrency, as_of))
        claimed = self.store.log("jobs").where(F.col("__seq") == number).drop("__seq", "__deleted")
        results = handlers.execute(claimed, self.registry.newest(), handlers.recover)
        rows = results.select("id", "ok", "error").collect()  # at most ``concurrency`` rows
        if not rows:
            return 0
        done = settle.outcomes(claimed, self.store.spark.createDataFrame(rows, "id string, ok boolean, error string"))
        failed, letters = settle.give_up(done, as_of)
        settled = settle.succeed(done, as_of).unionByName(settle.schedule_retries(done, as_of)).unionByName(failed)
        self.store.append("jobs", settled)
        self.store.append("dlq", letters)
        return len(rows)

    def reap(self, as_of: Column) -> None:
        self.store.append("jobs", settle.reap(self.store.table("jobs"), self.config.stale_after, as_of))

    def start_workflows(self, requests: DataFrame, versions: DataFrame, as_of: Column) -> None:
        self.store.append("runs", workflow.start(requests, versions, as_of))

    def get_run(self, id_: str) -> DataFrame:
        return jobs.get(self.store.table("runs"), id_)

    def replay_letters(self, as_of: Column) -> None:
        """Jobs from the first letters not replayed yet, which are then marked."""
        letters = self.store.table("dlq")
        first = changelog.page(letters, [F.asc("failed_at"), F.asc("id")], 1000).where("replayed_at IS NULL")
        self.store.append("jobs", dlq.as_jobs(first, as_of))
        self.store.append("dlq", first.withColumn("replayed_at", as_of))

    def publish(self, events: DataFrame, as_of: Column) -> None:
        """``events`` (id, name, payload)."""
        self.store.append("bus_events", events.withColumn("acked", F.lit(False)).withColumn("created_at", as_of))

    def subscribe(self) -> DataFrame:
        """The oldest event of each name that nobody acknowledged."""
        return cluster.oldest_unacked(self.store.table("bus_events"))

    def acknowledge(self, ids: Sequence[str]) -> None:
        self.store.append("bus_events", self.store.table("bus_events").where(F.col("id").isin(*ids)).withColumn("acked", F.lit(True)))

    def stats(self) -> DataFrame:
        return admin.stats(self.store.table("jobs"), self.store.table("runs"), self.store.table("dlq"))
