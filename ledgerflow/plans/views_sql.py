"""The entity views of ``sources.entities`` in DuckDB SQL, as common table expressions."""

from __future__ import annotations

AS_OF = "TIMESTAMP '2000-01-01 00:00:00'"
AS_OF_EVENTS = "TIMESTAMP '2024-01-31 00:00:00'"


def _id(prefix: str, key: str) -> str:
    return f"'{prefix}_' || lpad(CAST({key} AS VARCHAR), 10, '0')"


_RUN_AT = "o_orderdate + to_seconds(o_orderkey % 86400)"

VIEWS = {
    "jobs": f"""jobs AS (SELECT {_id("job", "o_orderkey")} AS id, 'handler_' || CAST(o_orderkey % 8 AS VARCHAR) AS name,
  CASE o_custkey % 4 WHEN 0 THEN 'default' WHEN 1 THEN 'critical' WHEN 2 THEN 'bulk' ELSE 'email' END AS queue,
  CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'completed' END
    WHEN 'O' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'retrying' ELSE 'pending' END
    ELSE CASE WHEN o_orderkey % 7 = 0 THEN 'cancelled' ELSE 'running' END END AS state,
  6 - CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority, 3 AS max_retries,
  CAST(CASE WHEN o_orderstatus = 'F' AND o_orderkey % 5 = 0 THEN 4 WHEN o_orderstatus = 'O' AND o_orderkey % 3 = 0 THEN 1 + (o_orderkey // 3) % 3 ELSE 0 END AS INTEGER) AS retry_count,
  'org_' || CAST(o_custkey % 10 AS VARCHAR) AS scope_org_id, o_orderdate AS created_at, {_RUN_AT} AS run_at,
  CASE WHEN o_orderstatus <> 'O' THEN {_RUN_AT} + to_seconds(5) END AS started_at,
  CASE WHEN o_orderstatus = 'F' THEN {_RUN_AT} + to_seconds(5 + CAST(floor(o_totalprice / 1000) AS BIGINT)) END AS completed_at,
  CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN {_RUN_AT} + to_seconds(30) END AS heartbeat_at FROM orders)""",
    "runs": f"""runs AS (SELECT {_id("wfrun", "o_orderkey")} AS id, 'wf_' || CAST(o_orderkey % 5 AS VARCHAR) AS name, CAST(1 + o_orderkey % 3 AS INTEGER) AS version,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'running' END AS state,
  CASE WHEN o_orderkey % 4 <> 0 THEN {_id("wfrun", "(o_orderkey - o_orderkey % 4)")} END AS parent_run_id, o_orderdate AS started_at, o_orderdate AS created_at,
  CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + to_seconds(60 + CAST(floor(o_totalprice / 100) AS BIGINT)) END AS completed_at FROM orders)""",
    "checkpoint_log": f"""checkpoint_log AS (SELECT {_id("wfrun", "l_orderkey")} AS run_id, 'step-' || CAST(l_linenumber AS VARCHAR) AS step_name, l_shipdate AS created_at,
  l_partkey, l_suppkey, l_extendedprice FROM lineitem)""",
    "checkpoints": """checkpoints AS (SELECT * FROM checkpoint_log QUALIFY row_number() OVER (PARTITION BY run_id, step_name
  ORDER BY created_at DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1)""",
    "dlq": """dlq AS (SELECT 'dlq_' || substr(id, 5, 10) AS id, id AS job_id, name AS job_name, queue, retry_count, max_retries, scope_org_id, completed_at AS failed_at,
  CASE WHEN CAST(substr(id, 5, 10) AS BIGINT) % 10 = 0 THEN completed_at + to_seconds(86400) END AS replayed_at FROM jobs WHERE state = 'failed')""",
    "bus_events": f"""bus_events AS (SELECT {_id("evt", "event_id")} AS id, event_type AS name, props AS payload, 'org_' || CAST(user_id % 10 AS VARCHAR) AS scope_org_id,
  event_id % 2 = 1 AS acked, ts AS created_at FROM events)""",
    "lifecycle": f"""lifecycle AS (SELECT {_id("evt", "event_id")} AS event_id, CASE event_type WHEN 'signup' THEN 'job.enqueued' WHEN 'view' THEN 'job.started'
  WHEN 'purchase' THEN 'job.completed' WHEN 'click' THEN 'job.retrying' ELSE 'job.failed' END AS type, ts, 'job:' || CAST(user_id AS VARCHAR) AS topic,
  CAST(floor(value * 1000) AS BIGINT) AS elapsed_ms FROM events)""",
    "workers": f"""workers AS (SELECT {_id("wkr", "s_suppkey")} AS id, s_name AS hostname,
  ['default', CASE s_suppkey % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'bulk' ELSE 'email' END] AS queues, CAST(10 + s_suppkey % 5 AS INTEGER) AS concurrency,
  CASE s_suppkey % 10 WHEN 0 THEN 'dead' WHEN 1 THEN 'draining' ELSE 'active' END AS state, s_suppkey = 2 AS is_leader,
  CASE WHEN s_suppkey = 2 THEN {AS_OF} + to_seconds(60) END AS leader_until, {AS_OF} - to_seconds(3 * s_suppkey) AS last_seen FROM supplier)""",
    "crons": f"""crons AS (SELECT {_id("cron", "p_partkey")} AS id, p_name || '-' || CAST(p_partkey AS VARCHAR) AS name, p_name AS job_name,
  CASE p_partkey % 8 WHEN 0 THEN '*/5 * * * *' WHEN 1 THEN '0 * * * *' WHEN 2 THEN '0 2 * * *' WHEN 3 THEN '30 9 * * 1-5' WHEN 4 THEN '0 */6 * * *'
    WHEN 5 THEN '0 0 1 * *' WHEN 6 THEN '@every 30s' ELSE '* * * * *' END AS schedule, p_partkey % 3 <> 0 AS enabled,
  {AS_OF} + to_seconds(60 * (p_partkey % 120 - 60)) AS next_run_at FROM part)""",
}
#: Views that another one reads, in order.
NEEDS = {"dlq": ["jobs"], "checkpoints": ["checkpoint_log"]}


def over(views: str, body: str) -> str:
    """``body`` with the views it reads (names with spaces between) before it."""
    names: list[str] = []
    for view in views.split():
        for name in [*NEEDS.get(view, []), view]:
            if name not in names:
                names.append(name)
    return "WITH " + ",\n".join(VIEWS[n] for n in names) + body
