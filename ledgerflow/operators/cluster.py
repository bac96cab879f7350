"""Workers, their liveness, and the leader's lease; and the durable event bus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.operators.changelog import change, delete, latest
from ledgerflow.operators.jobs import null_ts
from ledgerflow.schema import WORKER_STATES
from ledgerflow.sources.entities import plus


def upsert(workers: DataFrame, new: DataFrame) -> DataFrame:
    """Registered workers by id: a new row replaces the old, but for its leadership."""
    kept = workers.select(F.col("id").alias("__id"), F.col("is_leader").alias("__leader"), F.col("leader_until").alias("__until"))
    rows = new.join(kept, F.col("id") == F.col("__id"), "left")
    rows = rows.withColumn("is_leader", F.coalesce("__leader", F.lit(False))).withColumn("leader_until", F.col("__until")).select(*workers.columns)
    both = workers.withColumn("__seq", F.lit(0)).unionByName(rows.withColumn("__seq", F.lit(1)))
    return latest(both, ["id"], [F.desc("__seq")]).drop("__seq")


def dead(workers: DataFrame, threshold: float, as_of: Column) -> DataFrame:
    return workers.where(F.col("last_seen") < plus(as_of, -threshold))


def without_dead(workers: DataFrame, threshold: float, as_of: Column) -> DataFrame:
    return workers.where(~(F.col("last_seen") < plus(as_of, -threshold)))


def heartbeat(workers: DataFrame, ids: Column, as_of: Column) -> DataFrame:
    """Workers heard from now."""
    return change(workers, ids, last_seen=as_of)


def deregister(workers: DataFrame, ids: DataFrame) -> DataFrame:
    """``workers`` without those of ``ids`` (id)."""
    return delete(workers, ids)


def listed(workers: DataFrame) -> DataFrame:
    """All workers, in order of registration where that is known, then of id."""
    return workers.orderBy(*(c for c in ("created_at", "id") if c in workers.columns))


def leader(workers: DataFrame, as_of: Column) -> DataFrame:
    """The worker whose lease is running."""
    return workers.where(F.col("is_leader") & (F.col("leader_until") >= as_of))


def acquire_leadership(workers: DataFrame, worker: str, as_of: Column, ttl: float = 60.0) -> DataFrame:
    """The next state: the lease goes to ``worker`` if nobody else holds a running one. An earlier leader loses its flag."""
    other = workers.agg(F.coalesce(F.bool_or(F.col("is_leader") & (F.col("leader_until") >= as_of) & (F.col("id") != worker)), F.lit(False)).alias("__taken"))
    joined = workers.crossJoin(F.broadcast(other))
    mine = F.col("id") == worker
    until = F.when(mine, plus(as_of, ttl)).otherwise(null_ts())
    return change(joined, ~F.col("__taken"), is_leader=mine, leader_until=until).select(*workers.columns)


def renew_leadership(workers: DataFrame, worker: str, as_of: Column, ttl: float = 60.0) -> DataFrame:
    """A leader's lease runs on, even one that is over; others change nothing."""
    return change(workers, (F.col("id") == worker) & F.col("is_leader"), leader_until=plus(as_of, ttl))


def state_counts(workers: DataFrame) -> DataFrame:
    return workers.agg(*(F.count_if(F.col("state") == s).alias(s) for s in WORKER_STATES), F.count_if("is_leader").alias("leaders"))


def capacity_by_queue(workers: DataFrame) -> DataFrame:
    """Workers and slots that serve each queue."""
    served = workers.where("state = 'active'").select(F.explode("queues").alias("queue"), "concurrency")
    return served.groupBy("queue").agg(F.count("*").alias("workers"), F.sum("concurrency").alias("slots"))


def publish(events: DataFrame, new: DataFrame, as_of: Column) -> DataFrame:
    """Events appended, not acknowledged."""
    return events.unionByName(new.withColumn("acked", F.lit(False)).withColumn("created_at", as_of).select(*events.columns))


def oldest_unacked(events: DataFrame) -> DataFrame:
    """(name, event_id, event_at): what a subscriber of each name would get."""
    found = events.where("NOT acked").groupBy("name").agg(F.min(F.struct("created_at", "id")).alias("e"))
    return found.select("name", F.col("e.id").alias("event_id"), F.col("e.created_at").alias("event_at"))


def acknowledge(events: DataFrame, acks: DataFrame) -> DataFrame:
    """Events in ``acks`` (id) acknowledged, once or more often."""
    named = acks.select(F.col("id").alias("__id")).distinct()
    joined = events.join(named, F.col("id") == F.col("__id"), "left")
    return change(joined, F.col("__id").isNotNull(), acked=F.lit(True)).select(*events.columns)


def peer_health(peers: DataFrame, as_of: Column, timeout: float = 45.0) -> DataFrame:
    """Peers with ``connected``: heard from within the timeout."""
    return peers.withColumn("connected", F.coalesce(F.col("last_seen") >= plus(as_of, -timeout), F.lit(False)))


def federation_stats(peers: DataFrame) -> DataFrame:
    """Peers (connected, forwarded), how many are connected, and what was forwarded to all."""
    return peers.agg(F.count("*").alias("peers"), F.count_if("connected").alias("connected"), F.coalesce(F.sum("forwarded"), F.lit(0)).alias("forwarded"))
