"""Entities, states and defaults.

Every entity is a DataFrame with the columns below. State is an append-only changelog: a mutation
appends the changed rows, and ``operators.changelog.latest`` gives the current ones.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import types as T

# The states of jobs, runs and workers, in the order reports list them.
JOB_STATES = ("pending", "running", "completed", "failed", "retrying", "cancelled")
RUN_STATES = ("running", "completed", "failed")
WORKER_STATES = ("active", "draining", "dead")
CLAIMABLE = ("pending", "retrying")

# Prefixes of ids.
ID_PREFIXES = ("job", "wf", "wfrun", "ckpt", "cron", "dlq", "evt", "wkr")

_S, _I, _L, _B, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.TimestampNTZType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


JOBS = _struct(
    id=_S, name=_S, queue=_S, payload=_S, state=_S, priority=_I, max_retries=_I, retry_count=_I, last_error=_S, scope_app_id=_S, scope_org_id=_S,
    worker_id=_S, run_at=_TS, started_at=_TS, completed_at=_TS, heartbeat_at=_TS, timeout_ms=_L, created_at=_TS, updated_at=_TS,
)
RUNS = _struct(id=_S, name=_S, version=_I, state=_S, input=_S, output=_S, error=_S, scope_app_id=_S, scope_org_id=_S, parent_run_id=_S, started_at=_TS, completed_at=_TS, created_at=_TS, updated_at=_TS)
CHECKPOINTS = _struct(id=_S, run_id=_S, step_name=_S, data=_S, created_at=_TS)
CRONS = _struct(
    id=_S, name=_S, schedule=_S, job_name=_S, queue=_S, payload=_S, scope_app_id=_S, scope_org_id=_S, last_run_at=_TS, next_run_at=_TS, locked_by=_S, locked_until=_TS, enabled=_B, created_at=_TS, updated_at=_TS
)
DLQ = _struct(id=_S, job_id=_S, job_name=_S, queue=_S, payload=_S, error=_S, retry_count=_I, max_retries=_I, scope_app_id=_S, scope_org_id=_S, failed_at=_TS, replayed_at=_TS, created_at=_TS)
EVENTS = _struct(id=_S, name=_S, payload=_S, scope_app_id=_S, scope_org_id=_S, acked=_B, created_at=_TS)
WORKERS = _struct(id=_S, hostname=_S, queues=T.ArrayType(_S), concurrency=_I, state=_S, is_leader=_B, leader_until=_TS, last_seen=_TS, metadata=T.MapType(_S, _S), created_at=_TS)
#: What a log has besides: the number of the mutation that wrote a row, and whether it deleted it.
MUTATION = (T.StructField("__seq", _L), T.StructField("__deleted", _B))
ENTITIES = {"jobs": JOBS, "runs": RUNS, "checkpoints": CHECKPOINTS, "crons": CRONS, "dlq": DLQ, "bus_events": EVENTS, "workers": WORKERS}


@dataclass(frozen=True)
class EngineConfig:
    """Defaults of the engine, in seconds where no unit is named."""

    concurrency: int = 10
    queues: tuple[str, ...] = ("default",)
    poll: float = 1.0
    max_poll: float = 30.0
    heartbeat: float = 10.0
    stale_after: float = 30.0
    max_retries: int = 3
    job_timeout: float = 300.0
    leader_ttl: float = 60.0
    lock_ttl: float = 30.0
    stream_buffer: int = 256
    stream_credits: int = 1000
    extra: dict = field(default_factory=dict)


def migrate(spark: SparkSession, database: str = "default") -> list[str]:
    """Create each entity's table unless it is there; running it again changes nothing."""
    for name, schema in ENTITIES.items():
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")
    return list(ENTITIES)
