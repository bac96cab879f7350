import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerflow import schema
from ledgerflow.operators import admission, changelog, cluster, cron, dlq, handlers, jobs, settle, workflow
from ledgerflow.functions import scalar
from ledgerflow.functions.cron import next_run
from ledgerflow.plans import catalog
from ledgerflow.sources import entities as e
from ledgerflow.sources.entities import at
from tests.cron_plain import next_time, parse
from tests.conftest import values

T0 = datetime(2024, 1, 1, 12)

MINUTE = timedelta(minutes=1)


def NOW():  # noqa: N802  a column needs a session
    return at("2024-01-01 12:00:00")


def job(spark, *rows, **defaults):
    base = dict(id="job_1", name="n", queue="default", state="pending", priority=0, max_retries=3, retry_count=0, scope_org_id=None, created_at=T0, run_at=T0 - timedelta(seconds=1), started_at=None, completed_at=None, heartbeat_at=None) | defaults
    kinds = "id string, name string, queue string, state string, priority int, max_retries int, retry_count int, scope_org_id string, created_at timestamp_ntz, run_at timestamp_ntz, started_at timestamp_ntz, completed_at timestamp_ntz, heartbeat_at timestamp_ntz"
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], kinds)


def test_claim_order_and_queues(spark):
    rows = job(spark, {"id": "low", "priority": 1}, {"id": "high", "priority": 10}, {"id": "crit", "priority": 5, "queue": "critical"}, {"id": "later", "run_at": T0 + MINUTE})
    assert [r.id for r in jobs.claim(rows, ["default"], 10, NOW()).collect()] == ["high", "low"]
    assert [r.id for r in jobs.claim(rows, ["critical"], 10, NOW()).collect()] == ["crit"]
    claimed = jobs.claim(rows, None, 2, NOW()).collect()
    assert [(r.id, r.state, r.started_at) for r in claimed] == [("high", "running", T0), ("crit", "running", T0)]
    assert jobs.claim(rows, [], 0, NOW()).count() == 3
    assert jobs.claim(rows.limit(0), None, 5, NOW()).count() == 0


def test_stale(spark):
    rows = job(
        spark, {"id": "old", "state": "running", "heartbeat_at": T0 - MINUTE}, {"id": "beats", "state": "running", "started_at": T0 - MINUTE, "heartbeat_at": T0},
        {"id": "orphan", "state": "running", "started_at": T0 - MINUTE}, {"id": "never", "state": "running"}, {"id": "edge", "state": "running", "heartbeat_at": T0 - timedelta(seconds=30)},
    )
    assert values(jobs.stale(rows, 30, NOW()), "id") == [("old",), ("orphan",)]
    assert {r.retry_count for r in settle.reap(rows, 30, NOW()).collect()} == {0}
    beaten = jobs.heartbeat(rows, spark.createDataFrame([("old", T0), ("old", T0 - MINUTE)], "id string, ts timestamp_ntz"))
    assert values(jobs.stale(beaten, 30, NOW()), "id") == [("orphan",)]


def test_retry_budget(spark):
    rows = job(spark, {"id": "a_1", "max_retries": 2, "retry_count": 1}, {"id": "a_2", "max_retries": 2, "retry_count": 2}, {"id": "a_3", "max_retries": 0}, state="running")
    done = settle.outcomes(rows, spark.createDataFrame([(f"a_{i}", False, "boom") for i in (1, 2, 3)], "id string, ok boolean, error string"))
    retried = settle.schedule_retries(done, NOW(), F.lit(5)).collect()
    assert [(r.id, r.state, r.retry_count, r.run_at) for r in retried] == [("a_1", "retrying", 2, T0 + timedelta(seconds=5))]
    failed, letters = settle.give_up(done, NOW())
    assert values(failed, "id", "state") == [("a_2", "failed"), ("a_3", "failed")]
    assert values(letters, "job_id", "retry_count", "error") == [("a_2", 3, "boom"), ("a_3", 1, "boom")]


def test_transitions_conserve_rows(spark):
    rows = job(spark, *({"id": f"j_{i}", "state": s} for i, s in enumerate(schema.JOB_STATES)))
    for out in (jobs.cancel(rows, F.lit(True), NOW()), jobs.cancel_any(rows, F.lit(True)), jobs.retry(rows, F.lit(True)), settle.refuse(rows, F.lit(True), NOW())):
        assert out.count() == 6 and out.columns == rows.columns
    assert values(jobs.cancel(rows, F.lit(True), NOW()).where("state = 'cancelled'"), "id") == [("j_0",), ("j_4",), ("j_5",)]
    assert jobs.cancel_any(rows, F.lit(True)).where("state = 'cancelled' AND completed_at IS NULL").count() == 6


def test_changelog(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    new = spark.createDataFrame([("b", 9), ("c", 3), ("c", 3), ("c", 4)], "id string, v int")
    assert values(changelog.insert(old, new)) == [("a", 1), ("b", 2), ("c", 3)]
    assert values(changelog.conflicts(old, new)) == [("b", 9)]
    assert values(changelog.replace(old, new.where("v = 9"))) == [("a", 1), ("b", 9)]
    assert values(changelog.delete(old, new)) == [("a", 1)]
    assert changelog.page(old, [F.asc("id")], 5, 7).count() == 0


def test_backoffs(spark):
    n = spark.createDataFrame([(i,) for i in (1, 2, 3, 5, 10)], "n int")
    got = lambda c: [r[0] for r in n.orderBy("n").select(c).collect()]
    assert got(scalar.backoff_linear("n", 1, 60)) == [1, 2, 3, 5, 10]
    assert got(scalar.backoff_linear("n", 1, 5)) == [1, 2, 3, 5, 5]
    assert got(scalar.backoff_linear("n", 1)) == [1, 2, 3, 5, 10]
    assert got(scalar.backoff_exponential("n", 1, 3600)) == [1, 2, 4, 16, 512]
    assert got(scalar.backoff_exponential("n", 1, 10)) == [1, 2, 4, 10, 10]
    assert got(scalar.poll_wait("n"))[0] == 2
    assert all(0 <= x < 60 for x in got(scalar.backoff_jitter("n", F.col("n").cast("string"))))


def test_scalars(spark):
    one = spark.range(1)
    show = lambda c: one.select(c).first()[0]
    for ms, text in ((999, "999ms"), (1000, "1.0s"), (1250, "1.3s"), (59_949, "59.9s"), (60_000, "1m"), (125_000, "2m 5s"), (3_600_000, "1h 0m"), (7_380_000, "2h 3m")):
        assert show(scalar.format_duration(F.lit(ms))) == text
    for schedule, text in (
        ("*/5 * * * *", "Every 5 minutes"), ("0 * * * *", "Every hour at :00"), ("30 2 * * *", "Daily at 2:30"), ("0 9 * * 1-5", "Weekdays at 9:00"), ("0 9 * * 0,6", "Weekends at 9:00"),
        ("5 9 * * 2", "Every Tuesday at 9:05"), ("0 0 1 * *", "Monthly on day 1 at 0:00"), ("0 */6 * * *", "Every 6 hours"), ("@every 5s", "@every 5s"), ("1 2 3 4 5", "1 2 3 4 5"), ("* * * * *", "Every minute"),
    ):
        assert show(scalar.describe_cron(F.lit(schedule))) == text
    for seconds, text in ((0, "just now"), (-10, "in a moment"), (60, "1 min ago"), (-120, "in 2m"), (3600, "1 hour ago"), (7200, "2h ago"), (86400, "1 day ago"), (-3 * 86400, "in 3d")):
        when = T0 - timedelta(seconds=seconds)
        assert show(scalar.relative_time(F.lit(when).cast("timestamp_ntz"), NOW())) == text
    for topic, ok in (("jobs", True), ("workflows", True), ("firehose", True), ("job:x", True), ("workflow:x", True), ("queue:x", True), ("invalid", False), ("unknown:entity", False), ("", False)):
        assert show(scalar.topic_valid(F.lit(topic))) is ok
    for kind, topic, want in (("job.enqueued", "job:j1", ["firehose", "jobs", "job:j1"]), ("workflow.started", "workflow:r1", ["firehose", "workflows", "workflow:r1"]), ("cron.fired", "", ["firehose"])):
        assert show(scalar.resolve_topics(F.lit(kind), F.lit(topic))) == want
    assert show(scalar.truncate_bytes(F.lit("héllo"), 2)) == "h..."
    assert show(scalar.truncate_bytes(F.lit("short"), 12)) == "short"
    for text, n in (("5", 5), ("+5", 5), ("-1", 7), ("x", 7), (None, 7), ("", 7)):
        assert show(scalar.parse_int_param(F.lit(text).cast("string"), 7)) == n
    for method, scope in (("auth", ""), ("job.list", "job:read"), ("job.cancel", "job:write"), ("workflow.replay", "workflow:write"), ("cron.list", "cron:read"), ("dlq.list", "dlq:read"), ("nope", "admin")):
        assert show(scalar.required_scope(F.lit(method))) == scope
    assert show(scalar.id_prefix(F.lit("wfrun_0001"))) == "wfrun" and show(scalar.id_prefix(F.lit("plain"))) is None


def test_cron_times():
    at_ = datetime(2024, 2, 28, 23, 59, 30)
    assert next_time("@every 30s", at_) == datetime(2024, 2, 29)
    assert next_time("*/5 * * * *", at_) == datetime(2024, 2, 29)
    assert next_time("0 0 29 2 *", at_) == datetime(2024, 2, 29)
    assert next_time("0 12 13 * 5", datetime(2024, 9, 7)) == datetime(2024, 9, 13, 12)
    assert next_time("0 12 14 * 5", datetime(2024, 9, 7)) == datetime(2024, 9, 13, 12)
    assert next_time("0 9 * * mon-fri", datetime(2024, 3, 1, 10)) == datetime(2024, 3, 4, 9)
    assert next_time("@monthly", at_) == datetime(2024, 3, 1)
    assert next_time("0 0 31 2 *", at_) is None
    for bad in ("not-a-cron", "61 * * * *", "* * * *", "@every soon", "5-1 * * * *"):
        with pytest.raises(ValueError):
            parse(bad)


def test_cron_times_of_columns_are_those_of_the_plain_evaluator(spark):
    """Random schedules and times, awkward texts, and every hour around the changes of clocks."""
    r = random.Random(11)

    def field(low, high, names=()):
        one = lambda: r.choice(["*", "?", str(r.randint(low, high)), f"{r.randint(low, high)}-{r.randint(low, high + 1)}", f"*/{r.randint(0, 9)}", f"{r.randint(low, high)}/{r.randint(1, 9)}", "*/1", "*/", *([r.choice(names), r.choice(names).upper()] if names else [])])
        return "*" if r.random() < 0.4 else ",".join(one() for _ in range(r.randint(1, 3)))

    months, days = "jan feb mar dec".split(), "sun mon fri sat".split()
    rows = []
    for _ in range(400):
        schedule = " ".join([field(0, 59), field(0, 23), field(1, 31), field(1, 12, months), field(0, 6, days)])
        zone = r.choice(["", "", "", "TZ=America/New_York ", "CRON_TZ=Europe/Berlin ", "TZ=Asia/Kolkata ", "TZ=Australia/Lord_Howe  "])
        rows.append((zone + schedule, datetime(2023, 1, 1) + timedelta(seconds=r.randint(0, 3 * 366 * 86400))))
    for base in (datetime(2024, 3, 10, 5), datetime(2024, 11, 3, 3), datetime(2024, 4, 6, 13), datetime(2024, 10, 5, 13)):
        for k in range(0, 240, 17):
            for fields in ("30 1 * * *", "30 2 * * *", "*/20 * * * *", "5 1-2 * * *", "0 2 10 3 *"):
                for zone in ("America/New_York", "Australia/Lord_Howe"):
                    rows.append((f"TZ={zone} {fields}", base + timedelta(minutes=k)))
    texts = ["@every 30s", "@every 1h30m", "@every 1.5s", "@every 10ms", "@every 1.2.3s", "@every soon", "@every ", "@daily", " @weekly ", "@Daily", "@yearly", "TZ=UTC", "TZ=Nowhere/Land 0 0 * * *", "CRON_TZ=UTC @every 5m", "", " ", "* * * *", "* * * * * *", "0 0 31 2 *", "0 0 29 2 *", "0 0 30 2 mon", "1-2-3 * * * *", "*-5 * * * *", "a * * * *", "0 0 * jan-mar sun-tue", "60 * * * *", "99999999999999999999 * * * *", "0,0 0 1,15 */2 ?", "0 0 * * 7", "5-1 * * * *"]
    rows += [(t, datetime(2024, 2, 28, 23, 59, 30)) for t in texts] + [(None, datetime(2024, 1, 1)), ("* * * * *", None)]

    def plain(schedule, after):
        try:
            return next_time(schedule, after) if schedule and after else None
        except ValueError:
            return None

    frame = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, schedule string, after timestamp_ntz")
    got = frame.select("i", next_run(F.col("schedule"), F.col("after")).alias("at"))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString().split("LocalTableScan")[0]
    for i, found in got.collect():
        assert found == plain(*rows[i]), rows[i]


def test_cron_locks(spark):
    rows = spark.createDataFrame([("free", None, None), ("over", "w1", T0 - MINUTE), ("mine", "w2", T0 + MINUTE), ("theirs", "w1", T0 + MINUTE)], "id string, locked_by string, locked_until timestamp_ntz")
    claims = spark.createDataFrame([(i, w, T0) for i in ("free", "over", "mine", "theirs") for w in ("w2", "w3")], "cron_id string, worker_id string, claimed_at timestamp_ntz")
    got = dict(values(cron.acquire_locks(rows, claims, NOW()), "id", "locked_by"))
    assert got == {"free": "w2", "over": "w2", "mine": "w2", "theirs": "w1"}
    assert values(cron.release_locks(rows, "w1").where("locked_by IS NULL"), "id") == [("free",), ("over",), ("theirs",)]


def test_leadership(spark):
    rows = spark.createDataFrame([("a", True, T0 + MINUTE), ("b", False, None)], "id string, is_leader boolean, leader_until timestamp_ntz")
    assert values(cluster.leader(cluster.acquire_leadership(rows, "b", NOW()), NOW()), "id") == [("a",)]
    later = at("2024-01-01 12:02:00")
    assert values(cluster.leader(cluster.acquire_leadership(rows, "b", later), later), "id") == [("b",)]
    assert cluster.leader(rows, later).count() == 0
    assert values(cluster.leader(cluster.renew_leadership(rows, "a", later), later), "id") == [("a",)]


def test_dlq_limit_comes_first(spark):
    rows = spark.createDataFrame([(f"d_{i}", "n", "q", 3, None, T0 + timedelta(seconds=i), T0 if i < 2 else None) for i in range(4)], "id string, job_name string, queue string, max_retries int, scope_org_id string, failed_at timestamp_ntz, replayed_at timestamp_ntz")
    assert dlq.replay_all(rows, NOW(), 3).count() == 1
    marked, made = dlq.replay(rows, F.col("id") == "d_3", NOW())
    assert marked.where("replayed_at IS NOT NULL").count() == 3
    assert values(made, "state", "retry_count") == [("pending", 0)]


def test_workflow_replay_and_compensation(spark):
    log = spark.createDataFrame([("r", f"step-{i}", T0 + i * MINUTE) for i in (1, 2, 3)] + [("other", "step-9", T0)], "run_id string, step_name string, created_at timestamp_ntz")
    assert values(workflow.delete_after(log, "step-1"), "run_id", "step_name") == [("other", "step-9"), ("r", "step-1")]
    tied = log.withColumn("created_at", NOW())
    assert workflow.delete_after(tied, "step-1").count() == 4
    assert values(workflow.delete_after(tied, "step-1", ties=True), "step_name") == [("step-1",), ("step-9",)]
    steps = spark.createDataFrame([("r", f"step-{i}", i) for i in (1, 2, 3, 4)], "run_id string, step_name string, seq int")
    undone = log.unionByName(spark.createDataFrame([("r", "compensate:step-2", T0)], log.schema))
    assert values(workflow.compensations(steps, undone), "position", "step_name") == [(1, "step-3"), (2, "step-1")]
    assert values(workflow.pending_steps(steps, log), "step_name") == [("step-4",)]


def test_waits(spark):
    waits = spark.createDataFrame([("w1", "go", T0, 60), ("w1", "stop", T0, 60), ("w2", "go", T0 + MINUTE, 5)], "wait_id string, name string, since timestamp_ntz, timeout_s int")
    events = spark.createDataFrame([("e1", "go", T0 + timedelta(seconds=5), True), ("e2", "go", T0 + timedelta(seconds=9), False), ("e0", "go", T0 - MINUTE, False)], "id string, name string, created_at timestamp_ntz, acked boolean")
    found = workflow.first_event(waits, events)
    assert values(found, "wait_id", "name", "event_id") == [("w1", "go", "e2"), ("w1", "stop", None), ("w2", "go", None)]
    assert values(workflow.wait_all(found, ["wait_id"]), "wait_id", "complete") == [("w1", False), ("w2", False)]
    assert values(workflow.wait_any(found, ["wait_id"]), "wait_id", "event_id") == [("w1", "e2"), ("w2", None)]


def test_waits_equal_brute_force(spark):
    r = random.Random(5)
    some = lambda k: T0 + timedelta(milliseconds=r.randrange(k))
    waits = [(f"w{i}", r.choice("ab"), some(9_000_000), r.choice([0, 1, 59, 1800, 1800, 7200, -5])) for i in range(200)] + [("n", "a", T0, None)]
    events = [(f"e{i}", r.choice("abc"), some(12_000_000).replace(microsecond=0), r.random() < 0.3) for i in range(300)]
    found = workflow.first_event(spark.createDataFrame(waits, "wait_id string, name string, since timestamp_ntz, timeout_s int"), spark.createDataFrame(events, "id string, name string, created_at timestamp_ntz, acked boolean"))
    want = [(w, *min(((t, i) for i, m, t, acked in events if m == n and not acked and s is not None and o is not None and s <= t <= s + timedelta(seconds=o)), default=(None, None))[::-1]) for w, n, s, o in waits]
    assert values(found, "wait_id", "event_id", "event_at") == sorted(want, key=repr)


def test_waits_of_every_run(spark, data):
    n = e.runs(spark, data).count()
    got = {name: catalog.QUERIES[name](spark, data).count() for name in ("wait_event_every_run", "wait_all_every_run", "wait_any_every_run")}
    assert got == {"wait_event_every_run": 2 * n, "wait_all_every_run": n, "wait_any_every_run": n}


def test_run_tree_of_chains_rings_and_given_roots(spark):
    rows = [(f"c{i:04}", f"c{i - 1:04}" if i else None) for i in range(700)] + [("r1", "r2"), ("r2", "r1"), ("lost", "nobody"), ("x", "x")]
    runs = spark.createDataFrame(rows, "id string, parent_run_id string")
    assert values(workflow.run_tree(runs)) == [("c0000", f"c{i:04}", i) for i in range(700)]
    few = runs.where("id < 'c0006'")
    want = [("c0002", f"c{i:04}", i - 2) for i in range(2, 6)] + [("c0004", f"c{i:04}", i - 4) for i in range(4, 6)]
    assert values(workflow.run_tree(few, F.col("id").isin("c0002", "c0004"))) == want
    assert workflow.run_tree(runs.limit(0)).count() == 0


def test_cron_fields_as_the_parser_reads_them():
    at_ = datetime(2024, 1, 1)
    for schedule, want in (
        ("0 0 */2 * 1", datetime(2024, 1, 3)), ("0 0 */1 * 1", datetime(2024, 1, 8)), ("0 0 1,* * 1", datetime(2024, 1, 8)), ("0 0 13 * 5", datetime(2024, 1, 5)), ("0 0 ? * mon", datetime(2024, 1, 8)),
        ("CRON_TZ=America/New_York 0 9 * * *", datetime(2024, 1, 1, 14)), ("TZ=Asia/Tokyo 30 0 2 * *", datetime(2024, 1, 1, 15, 30)), ("CRON_TZ=UTC @daily", datetime(2024, 1, 2)),
    ):
        assert next_time(schedule, at_) == want, schedule
    # A clock that goes forward passes 02:30 over; one that goes back shows 01:30 twice.
    assert next_time("TZ=America/New_York 30 2 * * *", datetime(2024, 3, 10, 5)) == datetime(2024, 3, 11, 6, 30)
    assert next_time("TZ=America/New_York 30 1 * * *", datetime(2024, 11, 3, 5, 40)) == datetime(2024, 11, 4, 6, 30)
    for bad in ("0 0 * * 7", "CRON_TZ=Nowhere/Land 0 0 * * *", "TZ=UTC"):
        with pytest.raises(ValueError):
            parse(bad)


def test_a_missing_step_is_an_error(spark):
    rows = spark.createDataFrame([("r", "one", "5")], "run_id string, step_name string, data string")
    assert workflow.step_or_error(rows, "r", "one").data == "5"
    with pytest.raises(LookupError):
        workflow.step_or_error(rows, "r", "two")


def test_compensations_of_names_that_look_like_marks(spark):
    steps = spark.createDataFrame([("r", "one", 1), ("r", "compensate:one", 2), ("r", "two", 3), ("r", "never", 4)], "run_id string, step_name string, seq int")
    marks = spark.createDataFrame([("r", "one"), ("r", "compensate:one"), ("r", "two"), ("s", "compensate:two")], "run_id string, step_name string")
    assert values(workflow.compensations(steps, marks), "position", "step_name") == [(1, "two"), (2, "compensate:one")]


def test_run_tree_is_deep(spark):
    rows = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("z", None)], "id string, parent_run_id string")
    assert values(workflow.run_tree(rows)) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("z", "z", 0)]


def test_versions(spark):
    registry = spark.createDataFrame([("w", 1, 1, "old"), ("w", 2, 2, "two"), ("w", 1, 3, "new")], "name string, version int, seq int, handler string")
    assert values(workflow.newest_versions(registry)) == [("w", 2, "two")]
    runs = spark.createDataFrame([("r1", "w", 1, "running", T0), ("r2", "w", 2, "completed", T0)], "id string, name string, version int, state string, created_at timestamp_ntz")
    assert values(workflow.resume_set(runs, registry), "id", "handler") == [("r1", "new")]


def test_fan_out_keeps_input_order(spark):
    rows = spark.createDataFrame([("r", 1, "b"), ("r", 0, "a"), ("s", 0, None)], "run_id string, idx int, result string")
    assert values(workflow.fan_out(rows)) == [("r", ["a", "b"]), ("s", None)]


def test_token_bucket_and_tenants(spark):
    q = admission.Queue(admission.Limit(1, 1), {})
    assert [q.acquire(None, t) for t in (0, 0.1, 1.2)] == [True, False, True]
    q = admission.Queue(admission.Limit(0, 0, 100), {"orgA": admission.Limit(0, 0, 1)})
    assert [q.acquire("orgA", 0), q.acquire("orgA", 0), q.acquire("orgB", 0)] == [True, False, True]
    q.release("orgA")
    assert q.acquire("orgA", 0)
    # A request refused for concurrency has spent its token.
    q = admission.Queue(admission.Limit(0.001, 2, 1), {})
    assert [q.acquire(None, 0), q.acquire(None, 0)] == [True, False]
    q.release(None)
    assert not q.acquire(None, 1)
    q.reconfigure(admission.Limit(1, 1, 0))
    assert q.acquire(None, 2)
    rows = spark.createDataFrame([("q", None, T0, "acquire", "a"), ("q", None, T0 + MINUTE, "acquire", "b"), ("q", None, T0 + MINUTE, "release", "a"), ("free", None, T0, "acquire", "c")], "queue string, tenant string, ts timestamp_ntz, kind string, id string")
    got = admission.admit(rows, {"q": admission.Limit(0, 0, 1)})
    assert values(got, "id", "kind", "admitted") == [("a", "acquire", True), ("a", "release", None), ("b", "acquire", True), ("c", "acquire", True)]


def test_handlers_and_hooks(spark):
    registry = handlers.Registry()
    registry.register("double")(lambda p: p["x"] * 2)
    registry.register("double", 2)(lambda p: p["x"] * 20)
    registry.register("bad")(lambda p: 1 / 0)
    assert registry.names() == ["bad", "double"] and registry.get("double", 1)({"x": 1}) == 2
    rows = spark.createDataFrame([("1", "double", '{"x": 3}'), ("2", "bad", "{}"), ("3", "lost", None)], "id string, name string, payload string")
    got = values(handlers.execute(rows, registry.newest(), handlers.recover), "id", "ok", "error", "result")
    assert got == [("1", True, None, "60"), ("2", False, "panic in job bad: division by zero", None), ("3", False, "no handler for lost", None)]
    order = []
    wrap = lambda tag: lambda inner: lambda p: (order.append(tag), inner(p))[1]
    assert handlers.compose(lambda p: p, wrap("outer"), wrap("inner"))(7) == 7 and order == ["outer", "inner"]
    hooks, seen = handlers.Hooks(), []
    hooks.on("job.failed", lambda x: 1 / 0)
    hooks.on("*", seen.append)
    hooks.emit("job.failed", "x")
    assert seen == ["x"] and len(hooks.errors) == 1
    assert handlers.parse_id(handlers.new_id("job"), "job")[0] == "job"
    for bad in ("", "job_", "wf_1"):
        with pytest.raises(ValueError):
            handlers.parse_id(bad, "job")
    assert handlers.pretty_json('{"a":1}') == '{\n  "a": 1\n}' and handlers.pretty_json("x{") == "x{"


def test_migrate_twice(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS entities_test")
    assert schema.migrate(spark, "entities_test") == schema.migrate(spark, "entities_test")
    assert spark.table("entities_test.jobs").columns == schema.JOBS.names
    spark.sql("DROP DATABASE entities_test CASCADE")
