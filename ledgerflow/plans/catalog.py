"""Named queries over the entity views, each with DuckDB SQL that gives the same rows.

Every query takes (spark, sf_dir). ``QUERIES`` has the callables, ``ORACLE`` the SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.functions import codec, scalar
from ledgerflow.operators import admin, admission, changelog, cluster, cron, dlq, jobs, lifecycle, settle, workflow
from ledgerflow.plans.views_sql import AS_OF as NOW
from ledgerflow.plans.views_sql import over
from ledgerflow.schema import JOB_STATES
from ledgerflow.session import shared_folder
from ledgerflow.sources import entities as e
from ledgerflow.streaming import lifecycle as streams
from ledgerflow.streaming import sink

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}
TIES = ["l_partkey", "l_suppkey", "l_extendedprice"]


def _now():
    return e.at(e.AS_OF)


def query(views: str, sql: str) -> Callable:
    """Registers a query under its function's name; the SQL starts behind the views' expressions."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = over(views, " " + sql) if views else sql
        return f

    return add


JOB_COLUMNS = "id, name, queue, state, priority, max_retries, retry_count, scope_org_id, created_at, run_at, started_at, completed_at, heartbeat_at"


def _job_columns(**new: str) -> str:
    """The columns of jobs, some of them replaced."""
    return ", ".join(f"{new[c]} AS {c}" if c in new else c for c in JOB_COLUMNS.split(", "))


def _case(when: str, **new: str) -> str:
    return _job_columns(**{c: f"CASE WHEN {when} THEN {v} ELSE {c} END" for c, v in new.items()})


_CLAIM = "ORDER BY priority DESC, run_at, id"
_READY = f"state IN ('pending', 'retrying') AND run_at <= {NOW}"


@query("jobs", f"SELECT {_job_columns(state=chr(39) + 'running' + chr(39), started_at=NOW)} FROM (SELECT * FROM jobs WHERE {_READY} AND queue IN ('default', 'critical') {_CLAIM} LIMIT 50)")
def job_claim_topk(spark, d):
    return jobs.claim(e.jobs(spark, d), ["default", "critical"], 50, _now())


@query("jobs", f"SELECT {_job_columns(state=chr(39) + 'running' + chr(39), started_at=NOW)} FROM (SELECT * FROM jobs WHERE {_READY} {_CLAIM} LIMIT 200)")
def job_claim_all_queues(spark, d):
    return jobs.claim(e.jobs(spark, d), None, 200, _now())


@query("jobs", "SELECT * FROM jobs WHERE state = 'completed' AND queue = 'bulk' ORDER BY created_at, id LIMIT 20 OFFSET 40")
def job_list_state_page(spark, d):
    return jobs.list_by_state(e.jobs(spark, d), "completed", "bulk", 20, 40)


@query("jobs", "SELECT * FROM jobs WHERE id = 'job_0000000042'")
def job_get(spark, d):
    return jobs.get(e.jobs(spark, d), "job_0000000042")


@query("jobs", f"SELECT * FROM jobs WHERE state = 'running' AND coalesce(heartbeat_at, started_at) < {NOW} - to_seconds(30)")
def job_reap_stale(spark, d):
    return jobs.stale(e.jobs(spark, d), 30, _now())


@query("jobs", "SELECT count(*) AS n FROM jobs WHERE queue = 'default' AND state = 'pending'")
def job_count_filtered(spark, d):
    return jobs.count(e.jobs(spark, d), "default", "pending")


_COUNTS = ", ".join(f"count(*) FILTER (state = '{s}') AS {s}" for s in JOB_STATES)


@query("jobs", f"SELECT {_COUNTS} FROM jobs")
def job_counts_by_state(spark, d):
    return jobs.counts_by_state(e.jobs(spark, d))


@query("jobs", f"SELECT queue, {_COUNTS} FROM jobs GROUP BY queue")
def job_counts_pivot(spark, d):
    return jobs.counts_pivot(e.jobs(spark, d))


def _per_state(states: tuple[str, ...], per_state: int, limit: int, where: str = "TRUE") -> str:
    rank = "CASE state " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(states)) + " END"
    named = ", ".join(f"'{s}'" for s in states)
    return (
        f"SELECT {JOB_COLUMNS} FROM (SELECT *, {rank} AS r, row_number() OVER (PARTITION BY state ORDER BY created_at, id) AS n FROM jobs "
        f"WHERE state IN ({named}) AND {where}) WHERE n <= {per_state} ORDER BY r, created_at, id LIMIT {limit}"
    )


@query("jobs", _per_state(("running", "completed", "failed"), 5, 10))
def job_recent(spark, d):
    return jobs.recent(e.jobs(spark, d))


@query("jobs", _per_state(JOB_STATES, 25, 25))
def job_all_states_page(spark, d):
    return jobs.all_states(e.jobs(spark, d), 25)


_FIVE = ("pending", "running", "completed", "failed", "retrying")


@query("jobs", f"SELECT *, (SELECT count(*) FROM jobs WHERE queue = 'critical') AS total FROM ({_per_state(_FIVE, 30, 30, chr(34) + 'queue' + chr(34) + ' = ' + chr(39) + 'critical' + chr(39))})")
def job_queue_detail(spark, d):
    return jobs.queue_detail(e.jobs(spark, d), "critical", 30)


@query("jobs", "SELECT * FROM jobs ORDER BY created_at DESC, id LIMIT 100 OFFSET (SELECT CAST(count(*) AS BIGINT) // 2 FROM jobs)")
def job_deep_page(spark, d):
    """A page from the middle of all jobs, found by ranges."""
    all_ = e.jobs(spark, d)
    return changelog.deep_page(all_, [F.desc("created_at"), F.asc("id")], 100, all_.count() // 2)


@query("jobs", "SELECT * FROM jobs WHERE contains(lower(name), lower('HANDLER_3'))")
def job_name_search(spark, d):
    return jobs.search(e.jobs(spark, d), "HANDLER_3", "name")


@query("jobs", "SELECT id, name, 'old' AS origin FROM jobs WHERE retry_count > 0 UNION ALL SELECT id, name, 'new' FROM jobs WHERE retry_count = 0 AND priority >= 4")
def job_enqueue_dedup(spark, d):
    all_ = e.jobs(spark, d)
    old = all_.where("retry_count > 0").select("id", "name", F.lit("old").alias("origin"))
    new = all_.where("priority >= 4").select("id", "name", F.lit("new").alias("origin"))
    return changelog.insert(old, new)


@query("jobs", "SELECT id, name FROM jobs WHERE priority >= 4 AND retry_count > 0")
def job_enqueue_conflicts(spark, d):
    all_ = e.jobs(spark, d)
    return changelog.conflicts(all_.where("retry_count > 0"), all_.where("priority >= 4").select("id", "name"))


@query(
    "jobs",
    f"SELECT id, name, CASE WHEN priority = 5 THEN queue ELSE 'default' END AS queue, CAST(CASE WHEN priority = 4 THEN 7 ELSE 3 END AS INTEGER) AS max_retries, CAST(300000 AS BIGINT) AS timeout_ms, "
    f"CASE WHEN priority > 2 THEN priority ELSE 0 END AS priority, CASE WHEN priority = 1 THEN run_at ELSE {NOW} END AS run_at, 'pending' AS state, 0 AS retry_count, {NOW} AS created_at FROM jobs",
)
def job_enqueue_defaults(spark, d):
    raw = e.jobs(spark, d).select(
        "id", "name", F.when(F.col("priority") == 5, F.col("queue")).alias("queue"), F.when(F.col("priority") == 4, 7).alias("max_retries"), F.lit(None).cast("bigint").alias("timeout_ms"),
        F.when(F.col("priority") > 2, F.col("priority")).alias("priority"), F.when(F.col("priority") == 1, F.col("run_at")).alias("run_at"),
    )
    return jobs.with_defaults(raw, _now())


_PICK = "CAST(substr(id, 5) AS BIGINT) % 11 = 0"


def _pick():
    return F.substring("id", 5, 10).cast("bigint") % 11 == 0


@query("jobs", "SELECT " + _case(f"{_PICK} AND state IN ('pending', 'retrying')", state="'cancelled'", completed_at=NOW) + " FROM jobs")
def job_cancel_http(spark, d):
    return jobs.cancel(e.jobs(spark, d), _pick(), _now())


@query("jobs", "SELECT " + _case(_PICK, state="'cancelled'") + " FROM jobs")
def job_cancel_wire(spark, d):
    return jobs.cancel_any(e.jobs(spark, d), _pick())


@query("jobs", "SELECT " + _case(f"{_PICK} AND state = 'failed'", state="'pending'", retry_count="0", started_at="NULL", completed_at="NULL") + " FROM jobs")
def job_manual_retry(spark, d):
    return jobs.retry(e.jobs(spark, d), _pick())


@query("jobs", f"SELECT {_job_columns(heartbeat_at='coalesce(b.ts, heartbeat_at)')} FROM jobs LEFT JOIN (SELECT 'job_' || lpad(CAST(user_id AS VARCHAR), 10, '0') AS bid, max(ts) AS ts FROM events GROUP BY 1) b ON id = bid")
def job_heartbeat_apply(spark, d):
    beats = spark.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("job_"), F.lpad(F.col("user_id").cast("string"), 10, "0")).alias("id"), "ts")
    return jobs.heartbeat(e.jobs(spark, d), beats)


_LOG = "log AS (SELECT id, state, run_at AS ts, 1 AS seq FROM jobs UNION ALL SELECT id, 'pending', created_at, 0 FROM jobs UNION ALL SELECT id, 'running', started_at, 2 FROM jobs WHERE completed_at IS NOT NULL)"


def _log(spark, d):
    all_ = e.jobs(spark, d)
    first = all_.select("id", F.lit("pending").alias("state"), F.col("created_at").alias("ts"), F.lit(0).alias("seq"))
    second = all_.select("id", "state", F.col("run_at").alias("ts"), F.lit(1).alias("seq"))
    third = all_.where("completed_at IS NOT NULL").select("id", F.lit("running").alias("state"), F.col("started_at").alias("ts"), F.lit(2).alias("seq"))
    return first.unionByName(second).unionByName(third)


@query("jobs", f", {_LOG} SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, seq DESC) = 1")
def job_latest_state(spark, d):
    return changelog.latest(_log(spark, d), ["id"], [F.desc("ts"), F.desc("seq")])


@query("jobs", f""", {_LOG} SELECT how, id, state, seq FROM (SELECT id, state, CASE seq WHEN 0 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS seq FROM log), (SELECT unnest(['batch', 'stream']) AS how) WHERE seq >= 2 AND state IN ('running', 'completed')""")
def job_log_source(spark, d):
    """The same mutations of a job log by a batch read with pushed filters and by a stream in order of their numbers."""
    from ledgerflow.sources import log
    from ledgerflow.store import Store

    log.register(spark)
    store = Store(spark, f"{shared_folder(spark)}/store_{uuid.uuid4().hex}")
    rows, whole = _log(spark, d), e.jobs(spark, d).drop("state")
    for seq in (0, 2, 1):
        store.append("jobs", rows.where(F.col("seq") == seq).select("id", "state").join(whole, "id"))
    wanted = lambda df: df.where("__seq >= 2 AND state IN ('running', 'completed')").select("id", "state", F.col("__seq").alias("seq"))
    options = {"path": store.root, "entity": "jobs"}
    batch = wanted(spark.read.format("entity_log").options(**options).load())
    stream = streams.finished(wanted(spark.readStream.format("entity_log").options(**options).load()))
    return batch.select(F.lit("batch").alias("how"), "*").unionByName(stream.select(F.lit("stream").alias("how"), "*"))


@query("jobs", f"SELECT {_case('priority = 5', state=chr(39) + 'completed' + chr(39))} FROM jobs")
def job_update(spark, d):
    all_ = e.jobs(spark, d)
    return changelog.replace(all_, all_.where("priority = 5").withColumn("state", F.lit("completed")))


@query("jobs", f"SELECT * FROM jobs WHERE NOT ({_PICK})")
def job_delete(spark, d):
    all_ = e.jobs(spark, d)
    return changelog.delete(all_, all_.where(_pick()).select("id"))


# --- settling ---------------------------------------------------------------


def _done(spark, d):
    running = e.jobs(spark, d).where("state IN ('running', 'retrying')")
    return running.withColumn("ok", F.substring("id", 5, 10).cast("bigint") % 2 == 0).withColumn("error", F.when(~F.col("ok"), "boom"))


_DONE = "done AS (SELECT *, CAST(substr(id, 5) AS BIGINT) % 2 = 0 AS ok, CASE WHEN CAST(substr(id, 5) AS BIGINT) % 2 <> 0 THEN 'boom' END AS error FROM jobs WHERE state IN ('running', 'retrying'))"


@query("jobs", f", {_DONE} SELECT {_job_columns(state=chr(39) + 'completed' + chr(39), completed_at=NOW)} FROM done WHERE ok")
def settle_success(spark, d):
    return settle.succeed(_done(spark, d), _now())


_JITTER = "CAST('0x' || substr(md5(id), 1, 8) AS BIGINT) / 4294967296.0 * least(pow(2, retry_count), 60)"


@query("jobs", f", {_DONE} SELECT {_job_columns(state=chr(39) + 'retrying' + chr(39), retry_count='retry_count + 1', run_at=f'{NOW} + to_microseconds(CAST(floor(CAST({_JITTER} AS DOUBLE) * 1000) AS BIGINT) * 1000)')} FROM done WHERE NOT ok AND retry_count + 1 <= max_retries")
def settle_retry(spark, d):
    delay = F.floor(scalar.backoff_jitter("retry_count", "id") * 1000) / 1000
    return settle.schedule_retries(_done(spark, d), _now(), delay.cast("decimal(18,6)"))


@query("jobs", f", {_DONE} SELECT {_job_columns(state=chr(39) + 'failed' + chr(39), retry_count='retry_count + 1', completed_at=NOW)} FROM done WHERE NOT ok AND retry_count + 1 > max_retries")
def settle_failed(spark, d):
    return settle.give_up(_done(spark, d), _now())[0]


@query("jobs", f", {_DONE} SELECT 'dlq_' || substr(id, 5) AS id, id AS job_id, name AS job_name, queue, error, retry_count + 1 AS retry_count, max_retries, scope_org_id, {NOW} AS failed_at, CAST(NULL AS TIMESTAMP) AS replayed_at FROM done WHERE NOT ok AND retry_count + 1 > max_retries")
def settle_dlq(spark, d):
    return settle.give_up(_done(spark, d), _now())[1]


@query("jobs", "SELECT " + _case(f"{_PICK} AND state = 'running'", state="'pending'", run_at=f"{NOW} + to_seconds(1)") + " FROM jobs")
def requeue_rate_limited(spark, d):
    return settle.refuse(e.jobs(spark, d), _pick() & (F.col("state") == "running"), _now())


@query("jobs", "SELECT " + _case(f"{_PICK} AND state = 'running'", state="'pending'", run_at=NOW, started_at="NULL") + " FROM jobs")
def requeue_undispatched(spark, d):
    return settle.hand_back(e.jobs(spark, d), _pick() & (F.col("state") == "running"), _now())


@query("jobs", f"SELECT {_job_columns(state=chr(39) + 'pending' + chr(39), run_at=NOW, heartbeat_at='CAST(NULL AS TIMESTAMP)', started_at='CAST(NULL AS TIMESTAMP)')} FROM jobs WHERE state = 'running' AND coalesce(heartbeat_at, started_at) < {NOW} - to_seconds(30)")
def reap_reset(spark, d):
    return settle.reap(e.jobs(spark, d), 30, _now())


@query("lifecycle", "SELECT type AS name, count(*) AS executions, count(*) FILTER (elapsed_ms % 7 = 0) AS failures, quantile_cont(elapsed_ms, 0.95) AS p95_ms, max(elapsed_ms) AS max_ms FROM lifecycle GROUP BY type")
def execution_metrics(spark, d):
    return settle.metrics(e.lifecycle(spark, d).select(F.col("type").alias("name"), "elapsed_ms", (F.col("elapsed_ms") % 7 != 0).alias("ok")))


# --- scalars ----------------------------------------------------------------


@query("jobs", "SELECT id, CAST(2 AS DOUBLE) AS seconds FROM jobs WHERE state = 'retrying'")
def backoff_constant(spark, d):
    return e.jobs(spark, d).where("state = 'retrying'").select("id", scalar.backoff_constant(2).alias("seconds"))


@query("jobs", "SELECT id, CAST(least(1.5 * retry_count, 4) AS DOUBLE) AS seconds FROM jobs WHERE state IN ('retrying', 'failed')")
def backoff_linear(spark, d):
    return e.jobs(spark, d).where("state IN ('retrying', 'failed')").select("id", scalar.backoff_linear("retry_count", 1.5, 4).alias("seconds"))


@query("jobs", "SELECT id, CAST(least(1.0 * pow(2, retry_count - 1), 5) AS DOUBLE) AS seconds FROM jobs WHERE state IN ('retrying', 'failed')")
def backoff_exponential(spark, d):
    return e.jobs(spark, d).where("state IN ('retrying', 'failed')").select("id", scalar.backoff_exponential("retry_count", 1, 5).alias("seconds"))


@query("jobs", "SELECT id, CAST(CAST('0x' || substr(md5(id), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 * least(pow(2, retry_count - 1), 60) AS seconds FROM jobs WHERE state IN ('retrying', 'failed')")
def backoff_jitter(spark, d):
    return e.jobs(spark, d).where("state IN ('retrying', 'failed')").select("id", scalar.backoff_jitter("retry_count", "id").alias("seconds"))


@query("jobs", "SELECT id, CAST(least(pow(2, priority), 30) AS DOUBLE) AS seconds FROM jobs")
def poll_backoff(spark, d):
    return e.jobs(spark, d).select("id", scalar.poll_wait("priority").alias("seconds"))


@query("jobs", "SELECT id, CASE WHEN regexp_matches(v, '^[a-z]+_.+$') THEN split_part(v, '_', 1) END AS prefix FROM (SELECT id, CASE priority WHEN 1 THEN '' WHEN 2 THEN 'plain' WHEN 3 THEN 'wf_' ELSE id END AS v FROM jobs)")
def id_prefix(spark, d):
    v = F.when(F.col("priority") == 1, "").when(F.col("priority") == 2, "plain").when(F.col("priority") == 3, "wf_").otherwise(F.col("id"))
    return e.jobs(spark, d).select("id", scalar.id_prefix(v).alias("prefix"))


@query("crons", "SELECT id, CASE schedule WHEN '*/5 * * * *' THEN 'Every 5 minutes' WHEN '0 * * * *' THEN 'Every hour at :00' WHEN '0 2 * * *' THEN 'Daily at 2:00' WHEN '30 9 * * 1-5' THEN 'Weekdays at 9:30' WHEN '0 */6 * * *' THEN 'Every 6 hours' WHEN '0 0 1 * *' THEN 'Monthly on day 1 at 0:00' WHEN '* * * * *' THEN 'Every minute' ELSE schedule END AS phrase FROM crons")
def cron_describe(spark, d):
    return e.crons(spark, d).select("id", scalar.describe_cron("schedule").alias("phrase"))


@query("", f"""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN ((ms + 50) // 100) // 10 || '.' || ((ms + 50) // 100) % 10 || 's'
 WHEN ms < 3600000 THEN (ms // 60000) || 'm' || CASE WHEN (ms // 1000) % 60 > 0 THEN ' ' || (ms // 1000) % 60 || 's' ELSE '' END ELSE (ms // 3600000) || 'h ' || (ms // 60000) % 60 || 'm' END AS duration
 FROM (SELECT *, CAST(floor(l_quantity * CASE l_linenumber % 4 WHEN 0 THEN 17 WHEN 1 THEN 1111 WHEN 2 THEN 52001 ELSE 900007 END) AS BIGINT) AS ms FROM lineitem)""")
def format_duration(spark, d):
    n = F.col("l_linenumber") % 4
    ms = F.floor(F.col("l_quantity") * F.when(n == 0, 17).when(n == 1, 1111).when(n == 2, 52001).otherwise(900007)).cast("bigint")
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", scalar.format_duration(ms).alias("duration"))


def _amount(unit: int, one: str, many: str) -> str:
    return f"CASE WHEN abs(s) // {unit} = 1 THEN '1 {one}' ELSE (abs(s) // {unit}) || '{many}' END"


@query("workers crons", f"""SELECT id, CASE WHEN s >= 0 AND s < 60 THEN 'just now' WHEN abs(s) < 60 THEN 'in a moment' WHEN s >= 0 THEN t || ' ago' ELSE 'in ' || t END AS phrase FROM (
 SELECT id, s, CASE WHEN abs(s) < 3600 THEN {_amount(60, "min", "m")} WHEN abs(s) < 86400 THEN {_amount(3600, "hour", "h")} ELSE {_amount(86400, "day", "d")} END AS t
 FROM (SELECT id, CAST(epoch({NOW}) - epoch(next_run_at) AS BIGINT) * (CAST(substr(id, 6) AS BIGINT) % 40) AS s FROM crons))""")
def relative_time(spark, d):
    shift = F.substring("id", 6, 10).cast("bigint") % 40
    gap = F.timestamp_diff("SECOND", F.col("next_run_at"), _now()) * shift
    return e.crons(spark, d).select("id", scalar.relative_time(e.plus(_now(), -gap), _now()).alias("phrase"))


@query("jobs", "SELECT queue, CASE WHEN f * 100.0 / n < 5 THEN 'Healthy' WHEN f * 100.0 / n < 20 THEN 'Degraded' ELSE 'Unhealthy' END AS health FROM (SELECT queue, count(*) AS n, count(*) FILTER (state = 'failed') * 2 AS f FROM jobs GROUP BY queue)")
def health_label(spark, d):
    counts = jobs.counts_pivot(e.jobs(spark, d))
    total = sum((F.col(s) for s in JOB_STATES[1:]), F.col(JOB_STATES[0]))
    return counts.select("queue", scalar.health_label(F.col("failed"), F.col("failed"), total).alias("health"))


@query("jobs", "SELECT queue, page_limit, CAST(greatest((n + page_limit - 1) // page_limit, 1) AS BIGINT) AS pages, CAST(off // page_limit + 1 AS BIGINT) AS page FROM (SELECT queue, count(*) AS n, CAST(CASE WHEN queue = 'bulk' THEN 20 ELSE 33 END AS BIGINT) AS page_limit, min(priority) * 50 AS off FROM jobs GROUP BY queue)")
def page_meta(spark, d):
    rows = e.jobs(spark, d).groupBy("queue").agg(F.count("*").alias("n"), (F.min("priority") * 50).alias("off"))
    return rows.select("queue", *(c.alias(name) for name, c in scalar.page_meta("n", F.when(F.col("queue") == "bulk", 0).otherwise(33), "off").items()))


@query("jobs", "SELECT id, CAST(CASE WHEN (priority - 2) * 400 <= 0 THEN 50 ELSE least((priority - 2) * 400, 1000) END AS BIGINT) AS page_limit FROM jobs")
def limit_clamp(spark, d):
    return e.jobs(spark, d).select("id", scalar.limit_clamp((F.col("priority") - 2) * 400).alias("page_limit"))


@query("jobs", "SELECT id, CAST(CASE WHEN regexp_full_match(v, '[+]?[0-9]+') THEN CAST(v AS BIGINT) ELSE 7 END AS BIGINT) AS n FROM (SELECT id, CASE priority WHEN 1 THEN 'x' WHEN 2 THEN '-3' WHEN 3 THEN NULL ELSE CAST(retry_count AS VARCHAR) END AS v FROM jobs)")
def parse_int_param(spark, d):
    v = F.when(F.col("priority") == 1, "x").when(F.col("priority") == 2, "-3").when(F.col("priority") != 3, F.col("retry_count").cast("string"))
    return e.jobs(spark, d).select("id", scalar.parse_int_param(v, 7).alias("n"))


@query("", "SELECT s_suppkey, CASE WHEN strlen(s_name) > 12 THEN substr(s_name, 1, 12) || '...' ELSE s_name END AS short FROM supplier")
def truncate_bytes(spark, d):
    return spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", scalar.truncate_bytes("s_name", 12).alias("short"))


@query("jobs", "SELECT id, -CAST(priority AS DOUBLE) + epoch_ms(run_at) / 1e15 AS score FROM jobs")
def redis_score(spark, d):
    return e.jobs(spark, d).select("id", scalar.redis_score("priority", "run_at").alias("score"))


@query("lifecycle", "SELECT event_id, CASE WHEN contains(t, ':') THEN split_part(t, ':', 1) ELSE t END AS kind, CASE WHEN contains(t, ':') THEN substr(t, strpos(t, ':') + 1) ELSE '' END AS entity FROM (SELECT event_id, CASE type WHEN 'job.failed' THEN 'firehose' ELSE topic END AS t FROM lifecycle)")
def topic_parse(spark, d):
    kind, entity = scalar.topic_parse(F.when(F.col("type") == "job.failed", "firehose").otherwise(F.col("topic")))
    return e.lifecycle(spark, d).select("event_id", kind.alias("kind"), entity.alias("entity"))


@query("lifecycle", "SELECT event_id, t IN ('jobs', 'workflows', 'firehose') OR regexp_matches(t, '^(job|workflow|queue):.+') AS valid FROM (SELECT event_id, CASE type WHEN 'job.failed' THEN 'unknown:x' WHEN 'job.started' THEN 'job:' WHEN 'job.retrying' THEN 'jobs' ELSE topic END AS t FROM lifecycle)")
def topic_validate(spark, d):
    kind = F.col("type")
    t = F.when(kind == "job.failed", "unknown:x").when(kind == "job.started", "job:").when(kind == "job.retrying", "jobs").otherwise(F.col("topic"))
    return e.lifecycle(spark, d).select("event_id", scalar.topic_valid(t).alias("valid"))


_METHOD = "CASE type WHEN 'job.enqueued' THEN 'job.get' WHEN 'job.started' THEN 'workflow.start' WHEN 'job.completed' THEN 'dlq.replay' WHEN 'job.retrying' THEN 'subscribe' ELSE 'federation.event' END"


def _method():
    k = F.col("type")
    return F.when(k == "job.enqueued", "job.get").when(k == "job.started", "workflow.start").when(k == "job.completed", "dlq.replay").when(k == "job.retrying", "subscribe").otherwise("federation.event")


@query("lifecycle", f"SELECT event_id, CASE {_METHOD} WHEN 'job.get' THEN 'job:read' WHEN 'workflow.start' THEN 'workflow:write' WHEN 'dlq.replay' THEN 'dlq:write' WHEN 'subscribe' THEN 'subscribe' ELSE 'admin' END AS scope FROM lifecycle")
def required_scope(spark, d):
    return e.lifecycle(spark, d).select("event_id", scalar.required_scope(_method()).alias("scope"))


@query("workers", "SELECT id, (list_contains(queues, '*') OR list_contains(queues, 'bulk')) AS allowed FROM workers")
def has_scope(spark, d):
    return e.workers(spark, d).select("id", scalar.has_scope("queues", F.lit("bulk")).alias("allowed"))


@query("jobs", "SELECT id, CASE WHEN priority = 2 THEN '' ELSE state END AS state FROM jobs")
def state_parse(spark, d):
    return e.jobs(spark, d).select("id", scalar.state_of(F.when(F.col("priority") == 2, "nonsense").otherwise(F.col("state"))).alias("state"))


@query("jobs", "SELECT id, date_diff('second', started_at, completed_at) AS seconds FROM jobs WHERE completed_at IS NOT NULL")
def job_duration(spark, d):
    return e.jobs(spark, d).where("completed_at IS NOT NULL").select("id", scalar.job_seconds("started_at", "completed_at").alias("seconds"))


@query("jobs", "SELECT id, CASE priority WHEN 1 THEN 404 WHEN 2 THEN 400 ELSE 500 END AS status FROM jobs")
def error_status(spark, d):
    kind = F.when(F.col("priority") == 1, "job_not_found").when(F.col("priority") == 2, "invalid_id").otherwise("boom")
    return e.jobs(spark, d).select("id", scalar.error_status(kind).alias("status"))


# --- workflows --------------------------------------------------------------


def _checkpoints(spark, d):
    return workflow.current_checkpoints(e.checkpoint_log(spark, d), TIES)


@query("checkpoints", "SELECT * FROM checkpoints")
def ckpt_upsert(spark, d):
    return _checkpoints(spark, d)


@query("checkpoints", "SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY created_at, step_name) AS INTEGER) AS position, step_name, created_at FROM checkpoints")
def ckpt_timeline(spark, d):
    return workflow.timeline(_checkpoints(spark, d))


@query("checkpoints", "SELECT * FROM checkpoints WHERE run_id = 'wfrun_0000000007' AND step_name = 'step-2'")
def ckpt_inspect(spark, d):
    return workflow.inspect_step(_checkpoints(spark, d), "wfrun_0000000007", "step-2")


_PIVOT = ", marker AS (SELECT run_id AS r, created_at AS t FROM checkpoints WHERE step_name = 'step-2')"


@query("checkpoints", f"{_PIVOT} SELECT c.* FROM checkpoints c LEFT JOIN marker ON run_id = r WHERE t IS NULL OR created_at <= t")
def ckpt_delete_after(spark, d):
    return workflow.delete_after(_checkpoints(spark, d), "step-2")


@query("checkpoints", f"{_PIVOT} SELECT c.* FROM checkpoints c LEFT JOIN marker ON run_id = r WHERE t IS NULL OR step_name = 'step-2' OR created_at < t")
def ckpt_delete_after_ties(spark, d):
    return workflow.delete_after(_checkpoints(spark, d), "step-2", ties=True)


@query("runs", "SELECT * FROM runs WHERE parent_run_id = 'wfrun_0000000100' ORDER BY created_at, id")
def run_children(spark, d):
    return workflow.children(e.runs(spark, d), "wfrun_0000000100")


@query("runs", ", t AS (SELECT id AS root_id, id, 0 AS depth FROM runs WHERE parent_run_id IS NULL UNION ALL SELECT parent_run_id, id, 1 FROM runs WHERE parent_run_id IS NOT NULL) SELECT * FROM t")
def run_tree(spark, d):
    return workflow.run_tree(e.runs(spark, d))


@query("runs", "SELECT " + ", ".join(f"count(*) FILTER (state = '{s}') AS {s}" for s in ("running", "completed", "failed")) + " FROM runs")
def run_counts(spark, d):
    return jobs.counts_by_state(e.runs(spark, d), ("running", "completed", "failed"))


@query("runs", "SELECT * FROM runs WHERE state = 'failed' ORDER BY created_at, id LIMIT 25 OFFSET 50")
def run_list_page(spark, d):
    return jobs.list_by_state(e.runs(spark, d), "failed", None, 25, 50)


@query("runs", "SELECT * FROM runs WHERE id = 'wfrun_0000000012'")
def run_get(spark, d):
    return jobs.get(e.runs(spark, d), "wfrun_0000000012")


def _registry(spark, d):
    return e.runs(spark, d).groupBy("name", "version").agg(F.count("*").alias("seq")).select("name", "version", "seq", F.concat_ws("@", "name", F.col("version").cast("string")).alias("handler"))


@query("runs", "SELECT name, max(version) AS version, name || '@' || max(version) AS handler FROM runs GROUP BY name")
def run_latest_version(spark, d):
    return workflow.newest_versions(_registry(spark, d))


@query("runs", "SELECT id, name, version, name || '@' || version AS handler, created_at FROM runs WHERE state = 'running'")
def run_resume_set(spark, d):
    return workflow.resume_set(e.runs(spark, d), _registry(spark, d))


@query("runs", "SELECT id, name, CASE WHEN name = 'wf_1' THEN 9 ELSE version END AS version, CASE WHEN name = 'wf_1' THEN 'running' ELSE state END AS state, parent_run_id, started_at, created_at, CASE WHEN name = 'wf_1' THEN NULL ELSE completed_at END AS completed_at FROM runs")
def run_migrate(spark, d):
    return workflow.restart(e.runs(spark, d), F.col("name") == "wf_1", F.lit(9))


@query("runs checkpoints", ", w AS (SELECT DISTINCT run_id AS r FROM checkpoints WHERE step_name = 'step-3'), v AS (SELECT name AS n, max(version) AS newest FROM runs GROUP BY name) SELECT id, name, CASE WHEN r IS NULL THEN version ELSE newest END AS version, CASE WHEN r IS NULL THEN state ELSE 'running' END AS state, parent_run_id, started_at, created_at, CASE WHEN r IS NULL THEN completed_at END AS completed_at FROM runs LEFT JOIN w ON id = r JOIN v ON name = n")
def run_replay_state(spark, d):
    return workflow.replay_from(e.runs(spark, d), _checkpoints(spark, d), "step-3", workflow.newest_versions(_registry(spark, d)))[0]


@query("runs", f"SELECT id, name, version, CASE WHEN state <> 'running' THEN state WHEN version = 2 THEN 'completed' ELSE 'failed' END AS state, parent_run_id, started_at, created_at, CASE WHEN state = 'running' THEN {NOW} ELSE completed_at END AS completed_at FROM runs")
def run_finish(spark, d):
    all_ = e.runs(spark, d)
    return workflow.finish(all_, all_.where("state = 'running'").select("id", (F.col("version") == 2).alias("ok")), _now())


@query("runs", f"SELECT r.id || '_next' AS id, r.name, v.version, 'running' AS state, {NOW} AS started_at, {NOW} AS created_at FROM runs r JOIN (SELECT name, max(version) AS version FROM runs GROUP BY name) v ON r.name = v.name WHERE r.state = 'failed'")
def run_start(spark, d):
    requests = e.runs(spark, d).where("state = 'failed'").select(F.concat("id", F.lit("_next")).alias("id"), "name")
    return workflow.start(requests, workflow.newest_versions(_registry(spark, d)), _now())


@query("runs", f"SELECT r.id || '_child' AS id, r.name, v.version, 'running' AS state, {NOW} AS started_at, {NOW} AS created_at, r.id AS parent_run_id FROM runs r JOIN (SELECT name, max(version) AS version FROM runs GROUP BY name) v ON r.name = v.name WHERE r.state = 'failed'")
def run_start_child(spark, d):
    requests = e.runs(spark, d).where("state = 'failed'").select(F.concat("id", F.lit("_child")).alias("id"), "name", F.col("id").alias("parent_run_id"))
    return workflow.start(requests, workflow.newest_versions(_registry(spark, d)), _now())


@query("runs", ", t AS (SELECT id AS root_id, id, 0 AS depth FROM runs WHERE version = 2 UNION ALL SELECT r.id, c.id, 1 FROM runs r JOIN runs c ON c.parent_run_id = r.id WHERE r.version = 2) SELECT * FROM t")
def run_tree_of(spark, d):
    return workflow.run_tree(e.runs(spark, d), F.col("version") == 2)


_PLANNED = ", planned AS (SELECT id AS run_id, 'step-' || s AS step_name, s AS seq FROM runs, (SELECT unnest([1, 2, 3]) AS s) WHERE state = 'running')"


def _planned(spark, d):
    steps = e.runs(spark, d).where("state = 'running'").select(F.col("id").alias("run_id"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("seq"))
    return steps.select("run_id", F.concat(F.lit("step-"), F.col("seq").cast("string")).alias("step_name"), "seq")


@query("runs checkpoints", f"{_PLANNED} SELECT p.* FROM planned p ANTI JOIN checkpoints c USING (run_id, step_name)")
def step_pending(spark, d):
    return workflow.pending_steps(_planned(spark, d), _checkpoints(spark, d))


@query("runs checkpoints", f"{_PLANNED} SELECT p.run_id, count(*) AS members, count(c.run_id) AS done, count(c.run_id) = count(*) AS complete FROM planned p LEFT JOIN checkpoints c ON p.run_id = c.run_id AND p.step_name = c.step_name GROUP BY p.run_id")
def parallel_group_status(spark, d):
    return workflow.group_status(_planned(spark, d), _checkpoints(spark, d))


_UNDONE = ", undone AS (SELECT run_id, step_name FROM checkpoints WHERE step_name = 'step-2' AND l_partkey % 2 = 0)"


@query("runs checkpoints", f"{_PLANNED}{_UNDONE} SELECT p.run_id, CAST(row_number() OVER (PARTITION BY p.run_id ORDER BY seq DESC) AS INTEGER) AS position, p.step_name FROM planned p SEMI JOIN checkpoints c ON p.run_id = c.run_id AND p.step_name = c.step_name ANTI JOIN undone u ON p.run_id = u.run_id AND p.step_name = u.step_name")
def compensation_order(spark, d):
    done = _checkpoints(spark, d)
    undone = done.where("step_name = 'step-2' AND l_partkey % 2 = 0").withColumn("step_name", F.concat(F.lit("compensate:"), "step_name"))
    return workflow.compensations(_planned(spark, d), done.unionByName(undone))


@query("runs", "SELECT parent_run_id AS run_id, CASE WHEN count(r) = count(*) THEN list(r ORDER BY idx) END AS results FROM (SELECT parent_run_id, CAST(substr(id, 7) AS BIGINT) % 4 AS idx, CASE WHEN state <> 'running' THEN state END AS r FROM runs WHERE parent_run_id IS NOT NULL) GROUP BY 1")
def fanout_ordered(spark, d):
    rows = e.runs(spark, d).where("parent_run_id IS NOT NULL").select(F.col("parent_run_id").alias("run_id"), (F.substring("id", 7, 10).cast("bigint") % 4).alias("idx"), F.when(F.col("state") != "running", F.col("state")).alias("result"))
    return workflow.fan_out(rows)


_WAITS = ", waits AS (SELECT id AS wait_id, k AS name, DATE '2024-01-01'::TIMESTAMP + to_seconds(CAST(substr(id, 7) AS BIGINT) * 120) AS since, 1800 AS timeout_s FROM runs, (SELECT unnest(['error', 'purchase']) AS k))"


def _found_sql(which: str = "NOT acked") -> str:
    """An as-of join: the first event of the name from the wait's start on, if it is in time."""
    return (
        f"{_WAITS}, opened AS (SELECT name AS n, created_at AS t, min(id) AS i FROM bus_events WHERE {which} GROUP BY 1, 2), found AS (SELECT wait_id, w.name, "
        "CASE WHEN t <= since + to_seconds(timeout_s) THEN struct_pack(t := t, i := i) END AS e FROM waits w ASOF LEFT JOIN opened o ON w.name = o.n AND w.since <= o.t)"
    )


_FOUND, _LARGE = _found_sql(), _found_sql("NOT acked AND CAST(json_extract(payload, '$.k') AS BIGINT) > 50")


def _found(spark, d, events=None):
    """Two waits of every run."""
    waits = e.runs(spark, d).select(F.col("id").alias("wait_id"), F.substring("id", 7, 10).cast("bigint").alias("k"))
    waits = waits.select("wait_id", F.explode(F.array(F.lit("error"), F.lit("purchase"))).alias("name"), e.plus(e.at("2024-01-01 00:00:00"), F.col("k") * 120).alias("since"), F.lit(1800).alias("timeout_s"))
    return workflow.first_event(waits, e.bus_events(spark, d) if events is None else events)


@query("runs bus_events", f"{_FOUND} SELECT wait_id, name, e.i AS event_id, e.t AS event_at FROM found")
def wait_event(spark, d):
    return _found(spark, d)


@query("runs bus_events", f"{_FOUND} SELECT wait_id, count(*) AS wanted, count(e.i) AS arrived, count(e.i) = count(*) AS complete, CASE WHEN count(e.i) = count(*) THEN max(e.t) END AS complete_at FROM found GROUP BY wait_id")
def wait_all(spark, d):
    return workflow.wait_all(_found(spark, d), ["wait_id"])


@query("runs bus_events", f"{_FOUND} SELECT wait_id, x.i AS event_id, x.n AS name FROM (SELECT wait_id, min(struct_pack(t := e.t, i := e.i, n := name)) FILTER (e.i IS NOT NULL) AS x FROM found GROUP BY wait_id)")
def wait_any(spark, d):
    return workflow.wait_any(_found(spark, d), ["wait_id"])


for _name in ("wait_event", "wait_all", "wait_any"):  # the names that had every run when these had not
    QUERIES[f"{_name}_every_run"], ORACLE[f"{_name}_every_run"] = QUERIES[_name], ORACLE[_name]


@query("runs bus_events", f"{_LARGE} SELECT wait_id, name, e.i AS event_id, e.t AS event_at FROM found")
def wait_match_timed(spark, d):
    events = e.bus_events(spark, d)
    return _found(spark, d, events.where(F.get_json_object("payload", "$.k").cast("bigint") > 50))


@query("runs bus_events", f"{_FOUND} SELECT wait_id AS run_id, 'wait:' || name AS step_name, coalesce(e.i, '') AS data, {NOW} AS created_at FROM found")
def wait_checkpoints(spark, d):
    return workflow.wait_checkpoints(_found(spark, d), _now())


@query("runs bus_events", f"{_FOUND} SELECT id, name, acked OR id IN (SELECT e.i FROM found WHERE e.i IS NOT NULL) AS acked FROM bus_events")
def wait_acknowledged(spark, d):
    found = _found(spark, d).where("event_id IS NOT NULL")
    return cluster.acknowledge(e.bus_events(spark, d).select("id", "name", "acked"), found.select(F.col("event_id").alias("id")))


@query("bus_events", "SELECT name, min(struct_pack(t := created_at, i := id)).i AS event_id FROM bus_events WHERE NOT acked AND CAST(json_extract(payload, '$.k') AS BIGINT) > 50 GROUP BY name")
def wait_match(spark, d):
    matching = e.bus_events(spark, d).where(F.get_json_object("payload", "$.k").cast("bigint") > 50)
    return cluster.oldest_unacked(matching).select("name", "event_id")


def _step_id(prefix: str) -> str:
    return f"'{prefix}_' || md5(strlen(run_id) || '|' || run_id || '|' || step_name)"


_CHILD_STEPS = """, planned AS (SELECT id AS run_id, kind || ':one' AS step_name, CASE version WHEN 1 THEN 'wf_0' WHEN 2 THEN 'wf_1' ELSE 'wf_unknown' END AS name, CAST(substr(id, 7) AS BIGINT) AS k
 FROM runs, (SELECT unnest(['child', 'spawn']) AS kind) WHERE state = 'running')"""


def _child_steps(spark, d, kind):
    """A step of every running run that starts another workflow, known or not, and the checkpoints that some have left."""
    name = F.when(F.col("version") == 1, "wf_0").when(F.col("version") == 2, "wf_1").otherwise("wf_unknown")
    runs = e.runs(spark, d).where("state = 'running'")
    planned = runs.select(F.col("id").alias("run_id"), F.lit(f"{kind}:one").alias("step_name"), name.alias("name"), F.lit("{}").alias("input"), F.substring("id", 7, 10).cast("bigint").alias("k"))
    done = planned.where("k % 10 = 0").select("run_id", "step_name", F.lit('"done"').alias("data"), _now().alias("created_at"))
    return planned, done


@query("runs", f"""{_CHILD_STEPS}, child AS (SELECT *, k % 3 <> 0 AND name <> 'wf_unknown' AND k % 10 <> 0 AS there, k % 10 = 0 AS cached FROM planned WHERE step_name = 'child:one'),
facts AS (SELECT *, CASE WHEN NOT cached AND there AND k % 4 = 2 THEN 'child workflow "' || name || '" failed: boom' WHEN NOT cached AND NOT there AND name = 'wf_unknown' THEN 'no workflow "' || name || '"' END AS error, there AND k % 4 IN (1, 3) AS ended FROM child)
SELECT run_id, step_name, cached, CASE WHEN cached OR ended THEN TRUE WHEN error IS NOT NULL THEN FALSE END AS ok, error, CASE WHEN cached THEN '"done"' WHEN ended THEN CASE k % 4 WHEN 1 THEN '{{"k":' || k || '}}' ELSE 'null' END END AS data FROM facts""")
def child_results(spark, d):
    """Steps that wait for a child run: from the checkpoint, from the child that ended, failed with it, or still open."""
    planned, done = _child_steps(spark, d, "child")
    versions = workflow.newest_versions(_registry(spark, d))
    started = workflow.start_children(planned.where("k % 3 <> 0"), done, e.runs(spark, d), versions, _now())
    k = F.substring("parent_run_id", 7, 10).cast("bigint")
    state = F.when(k % 4 == 0, "running").when(k % 4 == 2, "failed").otherwise("completed")
    ended = started.select("id", state.alias("state"), F.when(k % 4 == 1, F.concat(F.lit('{"k":'), k.cast("string"), F.lit("}"))).alias("output"), F.when(k % 4 == 2, "boom").alias("error"))
    return workflow.child_results(planned, done, ended, versions)


@query("runs", f"""{_CHILD_STEPS} SELECT run_id, step_name, k % 10 = 0 AS cached, k % 10 = 0 OR name <> 'wf_unknown' AS ok, CASE WHEN k % 10 <> 0 AND name = 'wf_unknown' THEN 'no workflow "' || name || '"' END AS error,
CASE WHEN k % 10 = 0 THEN '"done"' WHEN name <> 'wf_unknown' THEN {_step_id("wfrun")} END AS data FROM planned WHERE step_name = 'spawn:one'""")
def spawn_results(spark, d):
    """Steps that start a run and go on with its id."""
    planned, done = _child_steps(spark, d, "spawn")
    return workflow.spawn_results(planned, done, workflow.newest_versions(_registry(spark, d)))


@query("runs", f"SELECT id AS run_id, started_at AS since, version * 86400 AS seconds, started_at + to_seconds(version * 86400) AS wake_at FROM runs WHERE state = 'running' AND started_at + to_seconds(version * 86400) <= {NOW}")
def sleep_due(spark, d):
    sleeps = e.runs(spark, d).where("state = 'running'").select(F.col("id").alias("run_id"), F.col("started_at").alias("since"), (F.col("version") * 86400).alias("seconds"))
    return workflow.due_sleeps(sleeps, _now())


_K = "CAST(json_extract(payload, '$.k') AS BIGINT)"


@query("bus_events", f"SELECT id, {_K} AS k, '81A16B' || CASE WHEN {_K} < 128 THEN printf('%02X', {_K}) WHEN {_K} < 256 THEN 'CC' || printf('%02X', {_K}) WHEN {_K} < 65536 THEN 'CD' || printf('%04X', {_K}) ELSE 'CE' || printf('%08X', {_K}) END AS packed, hex(encode(payload)) AS plain FROM bus_events")
def event_codecs(spark, d):
    """Payloads as MessagePack and back, and by a name that no codec has, which is JSON."""
    rows = e.bus_events(spark, d).select("id", codec.encoded(F.col("payload"), "msgpack").alias("packed"), codec.encoded(F.col("payload"), "protobuf").alias("plain"))
    return rows.select("id", F.get_json_object(codec.decoded(F.col("packed"), "msgpack"), "$.k").cast("bigint").alias("k"), F.hex("packed").alias("packed"), F.hex("plain").alias("plain"))


# --- schedules --------------------------------------------------------------


@query("crons", f"SELECT * FROM crons WHERE enabled AND next_run_at <= {NOW}")
def cron_due(spark, d):
    return cron.due(e.crons(spark, d), _now())


@query("crons", f"SELECT id, {NOW} + to_seconds(30) AS next_at FROM crons WHERE schedule LIKE '@every%'")
def cron_next_every(spark, d):
    from ledgerflow.functions.cron import next_run

    return e.crons(spark, d).where("schedule LIKE '@every%'").select("id", next_run(F.col("schedule"), _now()).alias("next_at"))


_NEXT = f"""CASE schedule WHEN '*/5 * * * *' THEN {NOW} + to_seconds(300) WHEN '0 * * * *' THEN {NOW} + to_seconds(3600) WHEN '0 2 * * *' THEN {NOW} + to_seconds(7200)
 WHEN '30 9 * * 1-5' THEN TIMESTAMP '2000-01-03 09:30:00' WHEN '0 */6 * * *' THEN {NOW} + to_seconds(21600) WHEN '0 0 1 * *' THEN TIMESTAMP '2000-02-01 00:00:00'
 WHEN '@every 30s' THEN {NOW} + to_seconds(30) ELSE {NOW} + to_seconds(60) END"""


_OWNED = ", owned AS (SELECT *, CASE CAST(substr(id, 6) AS BIGINT) % 4 WHEN 0 THEN 'email' WHEN 1 THEN 'bulk' WHEN 2 THEN '' END AS queue, '{\"id\":\"' || id || '\"}' AS payload, CAST(NULL AS TIMESTAMP) AS last_run_at FROM crons)"


def _owned(spark, d):
    """Schedules with a queue of their own, an empty one or none, and a payload."""
    k = F.substring("id", 6, 10).cast("bigint") % 4
    queue = F.when(k == 0, "email").when(k == 1, "bulk").when(k == 2, "")
    return e.crons(spark, d).select("*", queue.alias("queue"), F.to_json(F.struct("id")).alias("payload"), F.lit(None).cast("timestamp_ntz").alias("last_run_at"))


@query("crons", f"{_OWNED} SELECT id, name, job_name, schedule, enabled, queue, payload, CASE WHEN enabled AND next_run_at <= {NOW} THEN {_NEXT} ELSE next_run_at END AS next_run_at, CASE WHEN enabled AND next_run_at <= {NOW} THEN {NOW} END AS last_run_at FROM owned")
def cron_fire_state(spark, d):
    return cron.fire(_owned(spark, d), _now())[0]


@query("crons", f"{_OWNED} SELECT 'job_' || substr(id, 6) AS id, job_name AS name, CASE WHEN queue <> '' THEN queue ELSE 'default' END AS queue, 'pending' AS state, {NOW} AS run_at, {NOW} AS created_at, payload FROM owned WHERE enabled AND next_run_at <= {NOW}")
def cron_fire_jobs(spark, d):
    return cron.fire(_owned(spark, d), _now())[1]


@query("crons", f"{_OWNED} SELECT id, CASE WHEN schedule LIKE '@every%' THEN {NOW} END AS last_run_at FROM owned")
def cron_mark_run(spark, d):
    return cron.mark_run(_owned(spark, d).select("id", "schedule", "last_run_at"), F.col("schedule").startswith("@every"), _now()).drop("schedule")


@query("crons", "SELECT * FROM crons WHERE id = 'cron_0000000007'")
def cron_get(spark, d):
    return jobs.get(e.crons(spark, d), "cron_0000000007")


@query("crons", "SELECT * FROM crons WHERE enabled")
def cron_delete(spark, d):
    all_ = e.crons(spark, d)
    return changelog.delete(all_, all_.where("NOT enabled").select("id"))


@query("crons", f"SELECT id, name, job_name, schedule, enabled, next_run_at FROM crons WHERE CAST(substr(id, 6) AS BIGINT) % 2 = 0 UNION ALL SELECT id, name, job_name, schedule, TRUE, {_NEXT} FROM crons WHERE CAST(substr(id, 6) AS BIGINT) % 2 = 1 AND CAST(substr(id, 6) AS BIGINT) % 5 = 0")
def cron_register(spark, d):
    all_ = e.crons(spark, d)
    key = F.substring("id", 6, 10).cast("bigint")
    return cron.register(all_.where(key % 2 == 0), all_.where(key % 5 == 0).drop("next_run_at", "enabled"), _now())


def _locked(spark, d):
    k = F.substring("id", 6, 10).cast("bigint")
    return e.crons(spark, d).select("id", F.when(k % 3 == 0, "w1").when(k % 3 == 1, "w2").alias("locked_by"), F.when(k % 3 != 2, e.plus(_now(), (k % 5 - 2) * 10)).alias("locked_until"))


_LOCKED = f", locked AS (SELECT id, CAST(substr(id, 6) AS BIGINT) AS k, CASE CAST(substr(id, 6) AS BIGINT) % 3 WHEN 0 THEN 'w1' WHEN 1 THEN 'w2' END AS locked_by, CASE WHEN CAST(substr(id, 6) AS BIGINT) % 3 <> 2 THEN {NOW} + to_seconds((CAST(substr(id, 6) AS BIGINT) % 5 - 2) * 10) END AS locked_until FROM crons)"


@query("crons", f"{_LOCKED} SELECT id, CASE WHEN k % 2 = 0 AND (locked_by IS NULL OR locked_until < {NOW} OR locked_by = 'w2') THEN 'w2' ELSE locked_by END AS locked_by, CASE WHEN k % 2 = 0 AND (locked_by IS NULL OR locked_until < {NOW} OR locked_by = 'w2') THEN {NOW} + to_seconds(30) ELSE locked_until END AS locked_until FROM locked")
def cron_lock(spark, d):
    all_ = _locked(spark, d)
    claims = all_.where(F.substring("id", 6, 10).cast("bigint") % 2 == 0).select(F.col("id").alias("cron_id"), F.explode(F.array(F.lit("w2"), F.lit("w3"))).alias("worker_id"))
    return cron.acquire_locks(all_, claims.withColumn("claimed_at", _now()), _now())


@query("crons", f"{_LOCKED} SELECT id, CASE WHEN locked_by = 'w1' THEN NULL ELSE locked_by END AS locked_by, CASE WHEN locked_by = 'w1' THEN NULL ELSE locked_until END AS locked_until FROM locked")
def cron_unlock(spark, d):
    return cron.release_locks(_locked(spark, d), "w1")


@query("crons", "SELECT * FROM crons ORDER BY id LIMIT 50 OFFSET 100")
def cron_page(spark, d):
    return changelog.page(e.crons(spark, d), [F.asc("id")], 50, 100)


@query("crons", "SELECT * FROM crons WHERE contains(lower(name), '12') OR contains(lower(job_name), '12') ORDER BY id LIMIT 20 OFFSET 5")
def cron_search(spark, d):
    return cron.find(e.crons(spark, d), "12", 20, 5)


@query("crons", "SELECT id, name, job_name, schedule, CASE WHEN CAST(substr(id, 6) AS BIGINT) % 4 = 0 THEN TRUE ELSE enabled END AS enabled, next_run_at FROM crons")
def cron_toggle(spark, d):
    return cron.toggle(e.crons(spark, d), F.substring("id", 6, 10).cast("bigint") % 4 == 0, True)


# --- dead letters -----------------------------------------------------------


@query("dlq", "SELECT * FROM dlq WHERE queue = 'email' ORDER BY failed_at, id LIMIT 30 OFFSET 10")
def dlq_list(spark, d):
    return dlq.list_letters(e.dlq(spark, d), "email", 30, 10)


@query("dlq", "SELECT * FROM dlq WHERE id = 'dlq_0000000010'")
def dlq_get(spark, d):
    return jobs.get(e.dlq(spark, d), "dlq_0000000010")


@query("dlq", "SELECT count(*) AS n FROM dlq")
def dlq_count(spark, d):
    return jobs.count(e.dlq(spark, d))


_PUSHED = "SELECT id, job_id, job_name || '!' AS job_name, queue, failed_at FROM dlq WHERE CAST(substr(id, 5) AS BIGINT) % 3 = 0"


@query("dlq", f", pushed AS ({_PUSHED}) SELECT * FROM pushed UNION ALL SELECT id, job_id, job_name, queue, failed_at FROM dlq WHERE queue <> 'bulk' AND id NOT IN (SELECT id FROM pushed)")
def dlq_push(spark, d):
    all_ = e.dlq(spark, d).select("id", "job_id", "job_name", "queue", "failed_at")
    new = all_.where(F.substring("id", 5, 10).cast("bigint") % 3 == 0).withColumn("job_name", F.concat("job_name", F.lit("!")))
    return dlq.push(all_.where("queue <> 'bulk'"), new.unionByName(new))


_REPLAYED = f"SELECT 'job_' || md5(id || '|2000-01-01 00:00:00') AS id, job_name AS name, queue, 'pending' AS state, 0 AS retry_count, max_retries, scope_org_id, {NOW} AS run_at, {NOW} AS created_at"


@query("dlq", f"{_REPLAYED} FROM dlq WHERE queue = 'bulk'")
def dlq_replay(spark, d):
    return dlq.replay(e.dlq(spark, d), F.col("queue") == "bulk", _now())[1]


@query("dlq", f"SELECT id, job_id, job_name, queue, retry_count, max_retries, scope_org_id, failed_at, CASE WHEN queue = 'bulk' THEN {NOW} ELSE replayed_at END AS replayed_at FROM dlq")
def dlq_replay_marks(spark, d):
    return dlq.replay(e.dlq(spark, d), F.col("queue") == "bulk", _now())[0]


@query("dlq", f"{_REPLAYED} FROM (SELECT * FROM dlq ORDER BY failed_at, id LIMIT 1000) WHERE replayed_at IS NULL")
def dlq_replay_all(spark, d):
    return dlq.replay_all(e.dlq(spark, d), _now())


@query("dlq", "SELECT * FROM dlq WHERE failed_at >= TIMESTAMP '1998-01-01 00:00:00'")
def dlq_purge(spark, d):
    return dlq.purge(e.dlq(spark, d), e.at("1998-01-01 00:00:00"))


@query("dlq", "SELECT count(*) FILTER (failed_at < TIMESTAMP '1998-01-01 00:00:00') AS purged FROM dlq")
def dlq_purge_count(spark, d):
    return dlq.purged(e.dlq(spark, d), e.at("1998-01-01 00:00:00"))


@query("dlq", "SELECT *, (SELECT count(*) FROM dlq) AS total FROM (SELECT * FROM dlq WHERE queue = 'default' ORDER BY failed_at, id LIMIT 50) WHERE contains(lower(job_name), '5')")
def dlq_page(spark, d):
    return dlq.letters_page(e.dlq(spark, d), "5", "default", 50)


@query("dlq", "SELECT (SELECT count(*) FROM dlq) AS dead_letters, (SELECT count(*) FROM jobs WHERE state = 'failed') AS failed_jobs")
def dlq_widget(spark, d):
    return dlq.widget(e.dlq(spark, d), e.jobs(spark, d))


# --- events and workers -----------------------------------------------------


@query("bus_events", "SELECT name, min(struct_pack(t := created_at, i := id)).i AS event_id, min(created_at) AS event_at FROM bus_events WHERE NOT acked GROUP BY name")
def event_subscribe(spark, d):
    return cluster.oldest_unacked(e.bus_events(spark, d))


@query("bus_events", "SELECT id, name, payload, scope_org_id, acked OR name = 'error' AS acked, created_at FROM bus_events")
def event_ack(spark, d):
    all_ = e.bus_events(spark, d)
    return cluster.acknowledge(all_, all_.where("name = 'error'").select("id"))


@query("bus_events", f"SELECT * FROM bus_events UNION ALL SELECT id || 'x', name, payload, scope_org_id, FALSE, {NOW} FROM bus_events WHERE name = 'signup'")
def event_publish(spark, d):
    all_ = e.bus_events(spark, d)
    return cluster.publish(all_, all_.where("name = 'signup'").withColumn("id", F.concat("id", F.lit("x"))), _now())


@query("workers", f"SELECT * FROM workers WHERE last_seen < {NOW} - to_seconds(60)")
def worker_reap(spark, d):
    return cluster.dead(e.workers(spark, d), 60, _now())


@query("workers", f"SELECT * FROM workers WHERE NOT last_seen < {NOW} - to_seconds(60)")
def worker_delete_stale(spark, d):
    return cluster.without_dead(e.workers(spark, d), 60, _now())


@query("workers", f"SELECT id, CASE WHEN k % 4 = 0 THEN 'moved' ELSE hostname END AS hostname, queues, concurrency, CASE WHEN k % 4 = 0 THEN 'active' ELSE state END AS state, is_leader, leader_until, last_seen FROM (SELECT *, CAST(substr(id, 5) AS BIGINT) AS k FROM workers)")
def worker_upsert(spark, d):
    all_ = e.workers(spark, d)
    new = all_.where(F.substring("id", 5, 10).cast("bigint") % 4 == 0).withColumn("hostname", F.lit("moved")).withColumn("state", F.lit("active"))
    return cluster.upsert(all_, new)


@query("workers", f"SELECT id, state, CASE WHEN state = 'draining' THEN {NOW} ELSE last_seen END AS last_seen FROM workers")
def worker_heartbeat(spark, d):
    return cluster.heartbeat(e.workers(spark, d).select("id", "state", "last_seen"), F.col("state") == "draining", _now())


@query("workers", "SELECT * FROM workers WHERE state <> 'dead'")
def worker_deregister(spark, d):
    all_ = e.workers(spark, d)
    return cluster.deregister(all_, all_.where("state = 'dead'").select("id"))


@query("workers", "SELECT * FROM workers")
def worker_list(spark, d):
    return cluster.listed(e.workers(spark, d))


@query("workers", "SELECT " + ", ".join(f"count(*) FILTER (state = '{s}') AS {s}" for s in ("active", "draining", "dead")) + ", count(*) FILTER (is_leader) AS leaders FROM workers")
def worker_states(spark, d):
    return cluster.state_counts(e.workers(spark, d))


@query("workers", f"SELECT * FROM workers WHERE is_leader AND leader_until >= {NOW}")
def worker_leader(spark, d):
    return cluster.leader(e.workers(spark, d), _now())


@query("workers", f"SELECT id, hostname, queues, concurrency, state, id = 'wkr_0000000005' AS is_leader, CASE WHEN id = 'wkr_0000000005' THEN {NOW} + to_seconds(120 + 60) END AS leader_until, last_seen FROM workers")
def leader_takeover(spark, d):
    return cluster.acquire_leadership(e.workers(spark, d), "wkr_0000000005", e.plus(_now(), 120))


@query("workers", f"SELECT id, hostname, queues, concurrency, state, is_leader, CASE WHEN id = 'wkr_0000000002' THEN {NOW} + to_seconds(90) ELSE leader_until END AS leader_until, last_seen FROM workers")
def leader_renew(spark, d):
    return cluster.renew_leadership(e.workers(spark, d), "wkr_0000000002", e.plus(_now(), 30))


@query("workers", "SELECT queue, count(*) AS workers, CAST(sum(concurrency) AS BIGINT) AS slots FROM (SELECT unnest(queues) AS queue, concurrency FROM workers WHERE state = 'active') GROUP BY queue")
def worker_queue_capacity(spark, d):
    return cluster.capacity_by_queue(e.workers(spark, d))


@query("workers", f"SELECT id, last_seen >= {NOW} - to_seconds(45) AS connected FROM workers")
def peer_health(spark, d):
    return cluster.peer_health(e.workers(spark, d).select("id", "last_seen"), _now()).select("id", "connected")


@query("workers", f"SELECT count(*) AS peers, count(*) FILTER (last_seen >= {NOW} - to_seconds(45)) AS connected, CAST(sum(concurrency) AS BIGINT) AS forwarded FROM workers")
def federation_stats(spark, d):
    peers = e.workers(spark, d).select("id", "last_seen", F.col("concurrency").alias("forwarded"))
    return cluster.federation_stats(cluster.peer_health(peers, _now()))


# --- queues -----------------------------------------------------------------


@query("jobs", "SELECT queue, count(*) AS active FROM jobs WHERE state = 'running' GROUP BY queue")
def queue_active(spark, d):
    return jobs.active_by_queue(e.jobs(spark, d))


@query("jobs", ", c AS (SELECT unnest(['default', 'critical', 'unused']) AS queue), r AS (SELECT c.queue, 5000 AS max_concurrency, count(j.id) AS active FROM c LEFT JOIN jobs j ON j.queue = c.queue AND j.state = 'running' GROUP BY 1) SELECT *, CAST(greatest(100000 - (SELECT sum(active) FROM r), 0) AS BIGINT) AS idle FROM r")
def queue_info(spark, d):
    config = spark.createDataFrame([("default", 5000), ("critical", 5000), ("unused", 5000)], "queue string, max_concurrency int")
    return admin.queue_info(e.jobs(spark, d), config, F.lit(100000))


@query("jobs", ", m AS (SELECT queue, ts, sum(d) AS d FROM (SELECT queue, started_at AS ts, 1 AS d FROM jobs WHERE started_at IS NOT NULL UNION ALL SELECT queue, coalesce(completed_at, TIMESTAMP '2002-01-01 00:00:00'), -1 FROM jobs WHERE started_at IS NOT NULL) GROUP BY 1, 2) SELECT queue, ts, CAST(sum(d) OVER (PARTITION BY queue ORDER BY ts) AS BIGINT) AS active FROM m")
def queue_concurrency_timeline(spark, d):
    return jobs.concurrency(e.jobs(spark, d), e.at("2002-01-01 00:00:00"))


def _requests(spark, d):
    rows = e.jobs(spark, d).where("started_at IS NOT NULL AND completed_at IS NOT NULL")
    begin = rows.select("queue", F.col("scope_org_id").alias("tenant"), F.col("started_at").alias("ts"), F.lit("acquire").alias("kind"), "id")
    end = rows.select("queue", F.col("scope_org_id").alias("tenant"), F.col("completed_at").alias("ts"), F.lit("release").alias("kind"), "id")
    return begin.unionByName(end)


@query("", "")
def queue_admission(spark, d):
    """Token buckets and concurrency over a queue's whole history; an ordered fold, so rows only."""
    limits = {"default": admission.Limit(0.001, 2, 3), "critical": admission.Limit(0, 0, 5), "bulk": admission.Limit(0.0005, 5, 0)}
    return admission.admit(_requests(spark, d), limits, {("critical", "org_1"): admission.Limit(0, 0, 1)})


def _behind(seconds: int) -> str:
    """The next time whose seconds since 1970 are a multiple of ``seconds``."""
    return f"TIMESTAMP '1970-01-01 00:00:00' + to_seconds((CAST(floor(epoch(next_run_at)) AS BIGINT) // {seconds} + 1) * {seconds})"


@query("crons", f"""SELECT id, schedule, CASE schedule WHEN '*/5 * * * *' THEN {_behind(300)} WHEN '0 * * * *' THEN {_behind(3600)} WHEN '0 2 * * *' THEN {_behind(86400).replace("next_run_at", "next_run_at - to_seconds(7200)")} + to_seconds(7200)
 WHEN '30 9 * * 1-5' THEN CASE WHEN next_run_at < TIMESTAMP '1999-12-31 09:30:00' THEN TIMESTAMP '1999-12-31 09:30:00' ELSE TIMESTAMP '2000-01-03 09:30:00' END WHEN '0 */6 * * *' THEN {_behind(21600)}
 WHEN '0 0 1 * *' THEN CASE WHEN next_run_at < {NOW} THEN {NOW} ELSE TIMESTAMP '2000-02-01 00:00:00' END WHEN '@every 30s' THEN next_run_at + to_seconds(30) ELSE {_behind(60)} END AS next_at FROM crons""")
def cron_next(spark, d):
    """The next time of every schedule, general ones included."""
    from ledgerflow.functions.cron import next_run

    return e.crons(spark, d).select("id", "schedule", next_run(F.col("schedule"), F.col("next_run_at")).alias("next_at"))


@query("jobs", "")
def handler_execution(spark, d):
    """Handlers run over a claimed batch; times differ between runs."""
    from ledgerflow.operators import handlers

    claimed = jobs.claim(e.jobs(spark, d), None, 500, _now()).withColumn("payload", F.to_json(F.struct("priority")))
    return handlers.execute(claimed, {f"handler_{i}": (lambda p: p["priority"] * 2) for i in range(7)}, handlers.recover).drop("elapsed_ms")


# --- lifecycle --------------------------------------------------------------


@query("jobs", f", {_LOG}, b AS (SELECT *, lag(state) OVER (PARTITION BY id ORDER BY ts, state) AS before FROM log), k AS (SELECT CASE WHEN state = 'pending' AND before IS NULL THEN 'job.enqueued' WHEN state = 'running' THEN 'job.started' WHEN state IN ('completed', 'failed', 'retrying') THEN 'job.' || state END AS type, ts, 'job:' || id AS topic FROM b WHERE before IS NULL OR before <> state) SELECT * FROM k WHERE type IS NOT NULL")
def lifecycle_diff(spark, d):
    return lifecycle.state_changes(_log(spark, d))


def _json(*fields: tuple[str, str, bool]) -> str:
    """SQL for JSON of (name, SQL, whether it is text), null fields left out."""
    parts = ", ".join(f"""'"{name}":"' || {sql} || '"'""" if text else f"""'"{name}":' || {sql}""" for name, sql, text in fields)
    return f"'{{' || concat_ws(',', {parts}) || '}}'"


_EVERY = """, every AS (
SELECT 'job.enqueued' AS type, created_at AS ts, 'job:' || id AS topic, id, name, queue, scope_org_id AS org, NULL AS step, NULL AS ms, NULL AS error, NULL AS attempt, NULL AS next_at, NULL AS tries, NULL AS most, NULL AS job_id FROM jobs
UNION ALL SELECT 'job.started', started_at, 'job:' || id, id, name, queue, scope_org_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM jobs WHERE started_at IS NOT NULL
UNION ALL SELECT 'job.completed', completed_at, 'job:' || id, id, name, queue, scope_org_id, NULL, date_diff('second', started_at, completed_at) * 1000, NULL, NULL, NULL, NULL, NULL, NULL FROM jobs WHERE state = 'completed'
UNION ALL SELECT 'job.failed', completed_at, 'job:' || id, id, name, queue, scope_org_id, NULL, NULL, 'exit ' || priority, NULL, NULL, retry_count, max_retries, NULL FROM jobs WHERE state = 'failed'
UNION ALL SELECT 'job.retrying', run_at, 'job:' || id, id, name, queue, scope_org_id, NULL, NULL, NULL, retry_count, strftime(run_at, '%Y-%m-%dT%H:%M:%SZ'), NULL, NULL, NULL FROM jobs WHERE state = 'retrying'
UNION ALL SELECT 'job.dlq', failed_at, 'job:' || job_id, job_id, job_name, queue, scope_org_id, NULL, NULL, 'out of tries', NULL, NULL, retry_count, NULL, NULL FROM dlq
UNION ALL SELECT 'workflow.started', started_at, 'workflow:' || id, id, name, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM runs
UNION ALL SELECT 'workflow.' || state, completed_at, 'workflow:' || id, id, name, NULL, NULL, NULL, CASE WHEN state = 'completed' THEN date_diff('second', started_at, completed_at) * 1000 END, CASE WHEN state = 'failed' THEN 'step-9: broken' END, NULL, NULL, NULL, NULL, NULL FROM runs WHERE state <> 'running'
UNION ALL SELECT 'workflow.step_completed', c.created_at, 'workflow:' || run_id, run_id, name, NULL, NULL, step_name, l_partkey, NULL, NULL, NULL, NULL, NULL, NULL FROM checkpoints c JOIN runs ON run_id = id
UNION ALL SELECT 'workflow.step_failed', completed_at, 'workflow:' || id, id, name, NULL, NULL, 'step-9', NULL, 'broken', NULL, NULL, NULL, NULL, NULL FROM runs WHERE state = 'failed'
UNION ALL SELECT 'cron.fired', """ + NOW + """, NULL, name, name, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'job_' || substr(id, 6) FROM crons WHERE enabled AND next_run_at <= """ + NOW + ")"
_EVERY_VIEWS = "jobs dlq runs checkpoints crons"


def _every(spark, d):
    """All twelve kinds of events, from changelogs of jobs and runs, checkpoints and broken steps, dead letters and fired schedules."""
    all_, runs = e.jobs(spark, d), e.runs(spark, d)
    about = ["id", "name", "queue", "scope_org_id", "retry_count", "max_retries", "run_at", "started_at", "completed_at", F.concat(F.lit("exit "), F.col("priority").cast("string")).alias("error")]
    ended = F.when(F.col("state") == "retrying", F.col("run_at")).otherwise(F.col("completed_at"))
    log = all_.select(*about, F.lit("pending").alias("state"), F.col("created_at").alias("ts"), F.lit(0).alias("seq"))
    log = log.unionByName(all_.where("started_at IS NOT NULL").select(*about, F.lit("running").alias("state"), F.col("started_at").alias("ts"), F.lit(1).alias("seq")))
    log = log.unionByName(all_.where("state IN ('completed', 'failed', 'retrying')").select(*about, "state", ended.alias("ts"), F.lit(2).alias("seq")))
    about = ["id", "name", "started_at", "completed_at", F.lit("step-9: broken").alias("error")]
    begun = runs.select(*about, F.lit("running").alias("state"), F.col("started_at").alias("ts"), F.lit(0).alias("seq"))
    run_log = begun.unionByName(runs.where("state <> 'running'").select(*about, "state", F.col("completed_at").alias("ts"), F.lit(1).alias("seq")))
    done = _checkpoints(spark, d).select("run_id", "step_name", F.col("created_at").alias("ts"), F.col("l_partkey").alias("elapsed_ms"), F.lit(None).cast("string").alias("error"))
    broken = runs.where("state = 'failed'").select(F.col("id").alias("run_id"), F.lit("step-9").alias("step_name"), F.col("completed_at").alias("ts"), F.lit(None).cast("bigint").alias("elapsed_ms"), F.lit("broken").alias("error"))
    letters = e.dlq(spark, d).withColumn("error", F.lit("out of tries"))
    return lifecycle.every_event(log, run_log, done.unionByName(broken), letters, cron.fired(e.crons(spark, d), _now()))


_ORG, _MS, _STEP = ("scope_org_id", "nullif(org, '')", True), ("elapsed_ms", "nullif(ms, 0)", False), ("step_name", "step", True)
_JOB_DATA = [("job_id", "id", True), ("job_name", "name", True), ("queue", "queue", True), _ORG, _MS, ("error", "error", True), ("attempt", "attempt", False), ("next_run_at", "next_at", True)]
_RUN_DATA = [("run_id", "id", True), ("name", "name", True), _STEP, _ORG, _MS, ("error", "error", True)]
_FIRED_DATA = [("entry_name", "id", True), ("job_id", "job_id", True)]


def _by_family(jobs: str, runs: str, fired: str) -> str:
    return f"CASE WHEN type LIKE 'job.%' THEN {jobs} WHEN type LIKE 'workflow.%' THEN {runs} ELSE {fired} END"


@query(_EVERY_VIEWS, f"{_EVERY} SELECT type, ts, coalesce(topic, '') AS topic, {_by_family(_json(*_JOB_DATA), _json(*_RUN_DATA), _json(*_FIRED_DATA))} AS data FROM every")
def lifecycle_every_event(spark, d):
    return lifecycle.envelope(_every(spark, d))


_METADATA = [("attempt", "attempt", False), ("elapsed_ms", "ms", False), ("error", "error", True), ("job_id", "job_id", True), ("job_name", "CASE WHEN type LIKE 'job.%' THEN name END", True), ("max_retries", "most", False), ("next_run_at", "next_at", True), ("queue", "queue", True), ("retry_count", "tries", False), _STEP, ("workflow_name", "CASE WHEN type LIKE 'workflow.%' THEN name END", True)]


@query(_EVERY_VIEWS, f"{_EVERY} SELECT ts, type AS action, CASE split_part(type, '.', 1) WHEN 'job' THEN 'job' WHEN 'workflow' THEN 'workflow_run' ELSE 'cron_entry' END AS resource, id AS resource_id, split_part(type, '.', 1) AS category, CASE WHEN type IN ('job.failed', 'job.retrying', 'job.dlq', 'workflow.step_failed', 'workflow.failed') THEN 'failure' ELSE 'success' END AS outcome, CASE WHEN type IN ('job.failed', 'job.dlq', 'workflow.failed') THEN 'critical' WHEN type IN ('job.retrying', 'workflow.step_failed') THEN 'warning' ELSE 'info' END AS severity, coalesce(error, '') AS reason, {_json(*_METADATA)} AS metadata FROM every WHERE type <> 'job.started'")
def audit_records(spark, d):
    return lifecycle.audit_records(_every(spark, d), [k for k in lifecycle.EVENTS if k != "job.started"])


_SENT = [("elapsed_ms", "CASE WHEN type LIKE '%.completed' THEN coalesce(ms, 0) ELSE nullif(ms, 0) END", False), ("error", "error", True)]


@query(_EVERY_VIEWS, f"{_EVERY} SELECT ts, type AS event, CASE WHEN type LIKE 'job.%' THEN 'jobs' WHEN type LIKE 'workflow.%' THEN 'workflows' ELSE 'cron' END AS \"group\", coalesce(org, '') AS tenant, {_by_family(_json(*_JOB_DATA[:4], *_SENT, *_JOB_DATA[6:]), _json(*_RUN_DATA[:2], _ORG, _STEP, *_SENT), _json(*_FIRED_DATA))} AS payload FROM every")
def webhook_events(spark, d):
    return lifecycle.webhook_events(_every(spark, d))


@query("lifecycle", "SELECT event_id, type, unnest(['firehose', 'jobs', topic]) AS to_topic FROM lifecycle")
def topic_fanout(spark, d):
    return lifecycle.fan_out(e.lifecycle(spark, d)).select("event_id", "type", "to_topic")


def _subscriptions(spark, d):
    own = spark.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.lit("sub_"), F.col("s_suppkey").cast("string")).alias("subscriber"), F.concat(F.lit("job:"), F.col("s_suppkey").cast("string")).alias("topic"))
    return own.unionByName(own.where("subscriber IN ('sub_1', 'sub_2')").withColumn("topic", F.lit("jobs")))


_SUBS = ", subs AS (SELECT 'sub_' || s_suppkey AS subscriber, 'job:' || s_suppkey AS topic FROM supplier UNION ALL SELECT 'sub_' || s_suppkey, 'jobs' FROM supplier WHERE s_suppkey IN (1, 2))"
_DELIVERED = f"{_SUBS}, delivered AS (SELECT DISTINCT event_id, subscriber, type, ts FROM lifecycle l JOIN subs s ON s.topic IN ('firehose', 'jobs', l.topic))"


@query("lifecycle", f"{_DELIVERED} SELECT * FROM delivered")
def subscriber_dedup(spark, d):
    return lifecycle.deliveries(e.lifecycle(spark, d), _subscriptions(spark, d))


@query("lifecycle", f"{_DELIVERED} SELECT * FROM delivered QUALIFY row_number() OVER (PARTITION BY subscriber ORDER BY ts, event_id) <= CASE WHEN subscriber = 'sub_1' THEN 25 ELSE 10 END")
def credit_limited(spark, d):
    credits = spark.createDataFrame([("sub_1", 25)], "subscriber string, credits int")
    return lifecycle.with_credits(lifecycle.deliveries(e.lifecycle(spark, d), _subscriptions(spark, d)), credits, 10)


@query("lifecycle", f"{_DELIVERED} SELECT * FROM delivered WHERE type <> 'job.started' QUALIFY row_number() OVER (PARTITION BY subscriber ORDER BY ts, event_id) <= CASE WHEN subscriber = 'sub_1' THEN 25 ELSE 10 END")
def credit_filtered(spark, d):
    """What a subscriber's filter refuses costs no credit."""
    credits = spark.createDataFrame([("sub_1", 25)], "subscriber string, credits int")
    return lifecycle.with_credits(lifecycle.deliveries(e.lifecycle(spark, d), _subscriptions(spark, d)), credits, 10, F.col("type") != "job.started")


def _grants(spark, d):
    """Two credits at each signup on a subscriber's own topic."""
    signups = e.lifecycle(spark, d).where("type = 'job.enqueued'").select("topic", "ts")
    own = _subscriptions(spark, d).where("topic LIKE 'job:%'")
    return signups.join(own, "topic").select("subscriber", "ts", F.lit(2).alias("n"))


_MOVES = f"{_DELIVERED}, moves AS (SELECT event_id, subscriber, type, ts, 1 AS kind, -1 AS c FROM delivered UNION ALL SELECT NULL, subscriber, NULL, ts, 0, 2 FROM lifecycle l JOIN subs s ON s.topic = l.topic WHERE type = 'job.enqueued')"
_BY_TIME = "OVER (PARTITION BY subscriber ORDER BY ts, kind, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND"


@query("lifecycle", f"{_MOVES}, sums AS (SELECT *, CASE WHEN subscriber = 'sub_1' THEN 25 ELSE 10 END + sum(c) {_BY_TIME} CURRENT ROW) AS s FROM moves), floors AS (SELECT *, least(0, coalesce(min(s) {_BY_TIME} 1 PRECEDING), 0)) AS f FROM sums) SELECT event_id, subscriber, type, ts, CAST(s - f AS BIGINT) AS credits_left FROM floors WHERE kind = 1 AND s >= f")
def credit_replenished(spark, d):
    """Credits that are granted again, by a scan over parts of a subscriber's time."""
    credits = spark.createDataFrame([("sub_1", 25)], "subscriber string, credits int")
    return lifecycle.with_replenished_credits(lifecycle.deliveries(e.lifecycle(spark, d), _subscriptions(spark, d)), _grants(spark, d), credits, 10)


def _subscription_changes(spark, d):
    """Subscribers come to their own topic, leave it for some days and come back; two are on all jobs for a while, and one leaves everything."""
    k, begin = F.col("s_suppkey"), e.at("2024-01-01 00:00:00")
    subs = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", F.concat(F.lit("sub_"), k.cast("string")).alias("subscriber"), F.concat(F.lit("job:"), k.cast("string")).alias("own"))
    come = e.plus(begin, k * 3600)
    change = lambda rows, topic, ts, seq, active: rows.select("subscriber", topic.alias("topic"), ts.alias("ts"), F.lit(seq).alias("seq"), F.lit(active).alias("active"))
    out = change(subs, F.col("own"), come, 1, True).unionByName(change(subs, F.col("own"), e.plus(come, (1 + k % 7) * 86400), 2, False))
    out = out.unionByName(change(subs.where("s_suppkey % 2 = 0"), F.col("own"), e.plus(begin, 15 * 86400), 3, True))
    out = out.unionByName(change(subs.where("s_suppkey IN (1, 2)"), F.lit("jobs"), e.plus(begin, 5 * 86400), 4, True))
    return out.unionByName(change(subs.where("s_suppkey = 1"), F.lit(None).cast("string"), e.plus(begin, 12 * 86400), 5, False))


_T0 = "TIMESTAMP '2024-01-01 00:00:00'"


@query("lifecycle", f""", changes AS (SELECT 'sub_' || s_suppkey AS subscriber, 'job:' || s_suppkey AS topic, {_T0} + to_hours(s_suppkey) AS since, 1 AS seq, TRUE AS active FROM supplier
UNION ALL SELECT 'sub_' || s_suppkey, 'job:' || s_suppkey, {_T0} + to_hours(s_suppkey) + to_days(CAST(1 + s_suppkey % 7 AS INTEGER)), 2, FALSE FROM supplier
UNION ALL SELECT 'sub_' || s_suppkey, 'job:' || s_suppkey, {_T0} + to_days(15), 3, TRUE FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT 'sub_' || s_suppkey, 'jobs', {_T0} + to_days(5), 4, TRUE FROM supplier WHERE s_suppkey IN (1, 2)
UNION ALL SELECT 'sub_1', unnest(['job:1', 'jobs']), {_T0} + to_days(12), 5, FALSE FROM supplier WHERE s_suppkey = 1),
last AS (SELECT * FROM changes QUALIFY row_number() OVER (PARTITION BY subscriber, topic, since ORDER BY seq DESC) = 1),
sent AS (SELECT l.event_id, l.type, l.ts, s.subscriber, s.topic FROM (SELECT *, unnest(['firehose', 'jobs', topic]) AS t FROM lifecycle) l JOIN (SELECT DISTINCT subscriber, topic FROM changes) s ON s.topic = l.t)
SELECT DISTINCT s.event_id, s.subscriber, s.type, s.ts FROM sent s ASOF JOIN last c ON s.subscriber = c.subscriber AND s.topic = c.topic AND s.ts >= c.since WHERE c.active""")
def deliveries_in_force(spark, d):
    """Deliveries by the subscriptions in force when each event came."""
    return lifecycle.deliveries_in_force(e.lifecycle(spark, d), _subscription_changes(spark, d))


@query("", "SELECT 'sub_' || s_suppkey AS subscriber, 'job:' || s_suppkey AS topic FROM supplier WHERE s_suppkey % 3 <> 0")
def subscriptions_current(spark, d):
    subs = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", F.concat(F.lit("sub_"), F.col("s_suppkey").cast("string")).alias("subscriber"), F.concat(F.lit("job:"), F.col("s_suppkey").cast("string")).alias("topic"))
    on = subs.select("subscriber", "topic", F.lit(1).alias("seq"), F.lit(True).alias("active"))
    off = subs.where("s_suppkey % 3 = 0").select("subscriber", "topic", F.lit(2).alias("seq"), F.lit(False).alias("active"))
    return lifecycle.subscriptions_now(on.unionByName(off))


@query("lifecycle", f"{_DELIVERED} SELECT (SELECT count(DISTINCT topic) FROM subs) AS topics, (SELECT count(DISTINCT subscriber) FROM subs) AS subscribers, (SELECT count(*) FROM delivered) AS published, CAST(0 AS BIGINT) AS dropped")
def broker_stats(spark, d):
    subs = _subscriptions(spark, d)
    return lifecycle.broker_stats(lifecycle.deliveries(e.lifecycle(spark, d), subs), subs)


@query("lifecycle", "SELECT type, count(*) AS n FROM lifecycle GROUP BY type")
def lifecycle_counters(spark, d):
    return lifecycle.counters(e.lifecycle(spark, d))


@query("lifecycle", "SELECT event_id, ts, type AS action, 'job' AS resource, substr(topic, 5) AS resource_id, 'job' AS category, CASE WHEN type IN ('job.failed', 'job.retrying') THEN 'failure' ELSE 'success' END AS outcome, CASE type WHEN 'job.failed' THEN 'critical' WHEN 'job.retrying' THEN 'warning' ELSE 'info' END AS severity FROM lifecycle WHERE type <> 'job.started'")
def audit_projection(spark, d):
    return lifecycle.audit(e.lifecycle(spark, d), [k for k in lifecycle.EVENTS if k != "job.started"])


@query("lifecycle", "SELECT event_id, type AS event, 'jobs' AS \"group\", topic AS tenant FROM lifecycle")
def webhook_projection(spark, d):
    return lifecycle.webhooks(e.lifecycle(spark, d), F.col("topic")).drop("payload")


@query(_EVERY_VIEWS, f"{_EVERY} SELECT type AS event, CASE WHEN type LIKE 'job.%' THEN 'jobs' WHEN type LIKE 'workflow.%' THEN 'workflows' ELSE 'cron' END AS \"group\", count(*) AS n FROM every GROUP BY 1, 2")
def webhook_catalog(spark, d):
    return lifecycle.catalog(_every(spark, d))


_PARTS = ("ts < TIMESTAMP '2024-01-11 00:00:00'", "ts >= TIMESTAMP '2024-01-11 00:00:00' AND ts < TIMESTAMP '2024-01-21 00:00:00'", "ts >= TIMESTAMP '2024-01-21 00:00:00'")
_LATE = "event_id LIKE '%7'"


def _stream(spark, d, late=False, twice=False):
    """The events as a stream of three batches. With ``late``, some of the first come with the last; with ``twice``, some come again in the second and the third."""
    rows = e.lifecycle(spark, d)
    parts = [rows.where(p) for p in _PARTS]
    if late:
        parts = [parts[0].where(f"NOT {_LATE}"), parts[1], parts[2].unionByName(parts[0].where(_LATE))]
    if twice:
        parts = [parts[0], parts[1].unionByName(parts[0].where(_LATE)), parts[2].unionByName(parts[1].where(_LATE)).unionByName(parts[0].where(_LATE))]
    return streams.read(spark, streams.in_batches(parts), 4)


_WINDOWS = "SELECT unnest([0, 900, 1800, 2700]) AS back"


@query("lifecycle", f""", w AS (SELECT max(ts) - INTERVAL 1 HOUR AS closed FROM lifecycle), w1 AS (SELECT max(ts) - INTERVAL 1 HOUR AS closed FROM lifecycle WHERE {_PARTS[0]} AND NOT {_LATE}),
spread AS (SELECT type, time_bucket(INTERVAL 15 MINUTE, ts) - to_seconds(back) AS start, {_PARTS[0]} AND {_LATE} AS late FROM lifecycle, ({_WINDOWS}))
SELECT start, type, count(*) AS n FROM spread WHERE start + INTERVAL 1 HOUR <= (SELECT closed FROM w) AND NOT (late AND start + INTERVAL 1 HOUR <= (SELECT closed FROM w1)) GROUP BY start, type""")
def stream_sliding(spark, d):
    """Sliding windows of a stream run to its end: those that its watermark closes, without what came too late for them."""
    return streams.finished(streams.sliding(_stream(spark, d, late=True))).select(F.col("start").cast("timestamp_ntz").alias("start"), "type", "n")


@query("lifecycle", "SELECT event_id, type, topic FROM lifecycle")
def stream_deduplicated(spark, d):
    """Each event of a stream once: copies within the watermark meet its state, later ones are late."""
    return streams.finished(streams.deduplicated(_stream(spark, d, twice=True))).select("event_id", "type", "topic")


@query("lifecycle", "SELECT a.topic, a.ts AS started, b.ts AS completed FROM lifecycle a JOIN lifecycle b ON a.topic = b.topic AND a.type = 'job.started' AND b.type = 'job.completed' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 6 HOUR")
def stream_latency(spark, d):
    """Starts of a stream joined with the completions that follow within six hours; both sides' state goes with the watermark."""
    found = streams.finished(streams.latency(_stream(spark, d), "6 HOURS"))
    return found.select("topic", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("started", "completed")))


@query("lifecycle", "SELECT event_id, ts, type AS action, 'job' AS resource, substr(topic, 5) AS resource_id, 'job' AS category, CASE WHEN type IN ('job.failed', 'job.retrying') THEN 'failure' ELSE 'success' END AS outcome, CASE type WHEN 'job.failed' THEN 'critical' WHEN 'job.retrying' THEN 'warning' ELSE 'info' END AS severity FROM lifecycle")
def audit_sink(spark, d):
    """Audit records of a stream through a sink to which every batch is delivered twice."""
    path = f"{shared_folder(spark)}/sink_{uuid.uuid4().hex}"
    put = sink.write_once(path, lifecycle.audit)
    again = lambda batch, number: (put(batch, number), put(batch, number))[0]
    rows = _stream(spark, d)
    rows.writeStream.foreachBatch(again).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return sink.written(spark, path, lifecycle.audit(e.lifecycle(spark, d)).schema)


@query("lifecycle", "SELECT date_trunc('hour', ts) AS hour, type, count(*) AS n FROM lifecycle GROUP BY 1, 2")
def hourly_counts(spark, d):
    rows = e.lifecycle(spark, d)
    return rows.groupBy(F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("hour"), "type").agg(F.count("*").alias("n"))


_SESSIONS = ", s AS (SELECT topic, ts, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY topic ORDER BY ts) AS k FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY topic ORDER BY ts) AS gap FROM lifecycle))"


@query("lifecycle", f"{_SESSIONS} SELECT topic, min(ts) AS began, max(ts) AS ended, count(*) AS n FROM s GROUP BY topic, k")
def session_counts(spark, d):
    rows = e.lifecycle(spark, d)
    return rows.groupBy("topic", F.session_window(F.col("ts").cast("timestamp"), "6 hours").alias("w")).agg(F.min("ts").alias("began"), F.max("ts").alias("ended"), F.count("*").alias("n")).drop("w")


# --- admin ------------------------------------------------------------------

_STATS = ", ".join([f"(SELECT count(*) FROM jobs WHERE state = '{s}') AS jobs_{s}" for s in JOB_STATES] + ["(SELECT count(*) FROM dlq) AS dlq"] + [f"(SELECT count(*) FROM runs WHERE state = '{s}') AS runs_{s}" for s in ("running", "completed", "failed")])


@query("dlq runs", f"SELECT {_STATS}")
def stats_summary(spark, d):
    return admin.stats(e.jobs(spark, d), e.runs(spark, d), e.dlq(spark, d))


@query("dlq runs crons workers", f"SELECT {_STATS}, (SELECT count(*) FROM crons) AS crons, (SELECT count(*) FROM workers) AS workers, (SELECT CASE WHEN r < 5 THEN 'Healthy' WHEN r < 20 THEN 'Degraded' ELSE 'Unhealthy' END FROM (SELECT count(*) FILTER (state = 'failed') * 200.0 / count(*) AS r FROM jobs)) AS health")
def overview(spark, d):
    return admin.overview(e.jobs(spark, d), e.runs(spark, d), e.dlq(spark, d), e.crons(spark, d), e.workers(spark, d))


@query("runs checkpoints", "SELECT id, name, state, (SELECT count(*) FROM checkpoints WHERE run_id = 'wfrun_0000000100') AS steps, (SELECT count(*) FROM runs WHERE parent_run_id = 'wfrun_0000000100') AS children FROM runs WHERE id = 'wfrun_0000000100'")
def run_detail(spark, d):
    return admin.run_detail(e.runs(spark, d), _checkpoints(spark, d), "wfrun_0000000100")


@query("jobs", "SELECT DISTINCT name FROM jobs")
def handler_names(spark, d):
    return e.jobs(spark, d).select("name").distinct()


@query("crons", "SELECT id, name, schedule FROM crons ORDER BY id LIMIT 10")
def cron_widget(spark, d):
    return changelog.page(e.crons(spark, d), [F.asc("id")], 10).select("id", "name", "schedule")


@query("runs", "SELECT * FROM runs ORDER BY created_at, id LIMIT 10")
def run_recent(spark, d):
    return changelog.page(e.runs(spark, d), [F.asc("created_at"), F.asc("id")], 10)
