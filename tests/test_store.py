import tempfile

from ledgerflow.operators import workflow
from ledgerflow.operators.handlers import Registry
from ledgerflow.sources.entities import at
from ledgerflow.store import Engine, Store
from tests.conftest import values


def engine(spark):
    registry = Registry()
    registry.register("ok")(lambda p: p.get("x", 0) + 1)
    registry.register("bad")(lambda p: 1 / 0)
    return Engine(Store(spark, "file://" + tempfile.mkdtemp(prefix="spark-")), registry)


def test_jobs_through_the_engine(spark):
    e = engine(spark)
    now = at("2024-01-01 12:00:00")
    assert e.stats().first()["jobs_pending"] == 0 and e.cycle(now) == 0
    e.enqueue(spark.createDataFrame([("job_1", "ok", '{"x": 1}', 3), ("job_2", "bad", "{}", 0), ("job_3", "bad", "{}", 3)], "id string, name string, payload string, max_retries int"), now)
    e.enqueue(spark.createDataFrame([("job_1", "other", "{}"), ("job_4", "ok", "{}")], "id string, name string, payload string"), now)
    e.cancel_job("job_4", now)
    assert e.cycle(now) == 3
    assert values(e.store.table("jobs"), "id", "name", "state", "retry_count") == [("job_1", "ok", "completed", 0), ("job_2", "bad", "failed", 1), ("job_3", "bad", "retrying", 1), ("job_4", "ok", "cancelled", 0)]
    assert values(e.store.table("dlq"), "job_id", "error") == [("job_2", "panic in job bad: division by zero")]
    e.replay_letters(at("2024-01-01 13:00:00"))
    e.replay_letters(at("2024-01-01 14:00:00"))
    row = e.stats().first()
    assert (row.jobs_pending, row.jobs_failed, row.dlq) == (1, 1, 1)
    assert e.store.table("dlq").where("replayed_at IS NULL").count() == 0
    e.store.delete("jobs", ["job_1"])
    assert e.get_job("job_1").count() == 0


def test_a_job_that_is_not_due_does_not_run(spark):
    e = engine(spark)
    e.enqueue(spark.createDataFrame([("job_1", "ok", "{}")], "id string, name string, payload string").withColumn("run_at", at("2030-01-01 00:00:00")), at("2024-01-01 00:00:00"))
    for _ in range(2):
        assert e.cycle(at("2024-01-01 00:00:00")) == 0
    assert values(e.store.table("jobs"), "state") == [("pending",)]
    assert [e.cycle(at("2030-01-01 00:00:00")) for _ in range(2)] == [1, 0]


def test_workflows_and_events_through_the_engine(spark):
    e = engine(spark)
    now = at("2024-01-01 12:00:00")
    e.start_workflows(spark.createDataFrame([("wfrun_1", "w"), ("wfrun_2", "lost")], "id string, name string"), spark.createDataFrame([("w", 3)], "name string, version int"), now)
    assert values(e.store.table("runs"), "id", "version", "state") == [("wfrun_1", 3, "running")]
    assert e.get_run("wfrun_1").count() == 1
    e.publish(spark.createDataFrame([("evt_1", "go", "{}"), ("evt_2", "go", "{}")], "id string, name string, payload string"), now)
    assert values(e.subscribe(), "event_id") == [("evt_1",)]
    e.acknowledge(["evt_1", "evt_1"])
    assert values(e.subscribe(), "event_id") == [("evt_2",)]


def test_letters_and_replays_are_copies(spark):
    e = engine(spark)
    e.registry.register("picky")(lambda p: 1 / p["x"])
    now = at("2024-01-01 12:00:00")
    e.enqueue(spark.createDataFrame([("job_1", "picky", '{"x": 0}', 0, "app", "org")], "id string, name string, payload string, max_retries int, scope_app_id string, scope_org_id string"), now)
    assert e.cycle(now) == 1
    assert values(e.store.table("dlq"), "payload", "scope_app_id", "scope_org_id") == [('{"x": 0}', "app", "org")]
    e.replay_letters(at("2024-01-01 13:00:00"))
    assert values(e.store.table("jobs").where("state = 'pending'"), "payload", "scope_app_id", "scope_org_id") == [('{"x": 0}', "app", "org")]
    assert e.cycle(at("2024-01-01 14:00:00")) == 1
    assert values(e.store.table("dlq"), "error") == [("panic in job picky: division by zero",)] * 2


def test_steps_give_back_their_results(spark):
    store, now = engine(spark).store, at("2024-01-01 12:00:00")
    steps = spark.createDataFrame([("r", "one", 1, "add", "5"), ("r", "two", 2, "add", "7"), ("s", "one", 1, "bad", None), ("s", "two", 2, "add", "1")], "run_id string, step_name string, seq int, handler string, input string")
    add = {"add": lambda x, before: x + sum(before.values()), "bad": lambda x, before: 1 / 0}
    store.append("checkpoints", workflow.new_checkpoints(workflow.run_steps(steps, store.table("checkpoints"), add), now))
    assert values(store.table("checkpoints"), "run_id", "step_name", "data") == [("r", "one", "5"), ("r", "two", "12")]
    again = workflow.run_steps(steps, store.table("checkpoints"), {"add": lambda x, before: 1 / 0, "bad": lambda x, before: None})
    assert values(again, "run_id", "step_name", "cached", "data", "error") == [("r", "one", True, "5", None), ("r", "two", True, "12", None), ("s", "one", False, "null", None), ("s", "two", False, None, "division by zero")]
    assert workflow.new_checkpoints(again, now).count() == 1


def test_child_runs(spark):
    store, now = engine(spark).store, at("2024-01-01 12:00:00")
    versions = spark.createDataFrame([("w", 1), ("w2", 3)], "name string, version int")
    steps = spark.createDataFrame([(r, f"child:{n}", n, "1") for r, n in (("p", "w"), ("p", "w2"), ("p", "lost"), ("q", "w"))], "run_id string, step_name string, name string, input string")
    start = lambda: workflow.start_children(steps, store.table("checkpoints"), store.table("runs"), versions, now)
    results = lambda: workflow.child_results(steps, store.table("checkpoints"), store.table("runs"), versions)
    store.append("runs", start())
    assert values(store.table("runs"), "name", "version", "parent_run_id", "input") == [("w", 1, "p", "1"), ("w", 1, "q", "1"), ("w2", 3, "p", "1")] and start().count() == 0
    assert values(results().where("ok IS NULL"), "run_id", "step_name") == [("p", "child:w"), ("p", "child:w2"), ("q", "child:w")]
    ended = store.table("runs").where("parent_run_id = 'p'").selectExpr("id", "name", "version", "parent_run_id", "if(name = 'w', 'completed', 'failed') AS state", "if(name = 'w', '42', NULL) AS output", "if(name = 'w', NULL, 'broke') AS error")
    store.append("runs", ended)
    want = [("child:lost", False, False, 'no workflow "lost"', None), ("child:w", False, True, None, "42"), ("child:w2", False, False, 'child workflow "w2" failed: broke', None)]
    assert values(results().where("run_id = 'p'"), "step_name", "cached", "ok", "error", "data") == want
    store.append("checkpoints", workflow.new_checkpoints(results(), now))
    assert values(results().where("cached"), "run_id", "step_name", "data") == [("p", "child:w", "42")]
    spawned = workflow.spawn_results(steps, store.table("checkpoints").limit(0), versions)
    ids = {r.id for r in store.table("runs").collect()}
    assert {r.data for r in spawned.where("ok").collect()} == ids and values(spawned.where("NOT ok"), "step_name") == [("child:lost",)]
