import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerflow.operators import lifecycle as batch
from ledgerflow.operators import admission
from ledgerflow.operators.handlers import Hooks
from ledgerflow.sources import entities
from ledgerflow.streaming import lifecycle, stateful
from tests.conftest import values

T0 = datetime(2024, 1, 1, 12)


@pytest.fixture(scope="module")
def folder(spark, data):
    path = tempfile.mkdtemp(prefix="spark-") + "/events"
    rows = entities.lifecycle(spark, data).orderBy("ts")
    rows.repartitionByRange(3, "ts").write.parquet(path)
    return path


def run(spark, rows, mode="append", name="out"):
    lifecycle.run_now(rows, name, mode, tempfile.mkdtemp(prefix="spark-"))
    return spark.table(name)


def test_counters_equal_batch(spark, data, folder):
    got = run(spark, lifecycle.counters(lifecycle.read(spark, folder)), "complete", "counters")
    assert values(got) == values(batch.counters(entities.lifecycle(spark, data)))


def test_windows_equal_batch(spark, data, folder):
    rows = entities.lifecycle(spark, data).withColumn("ts", F.col("ts").cast("timestamp"))
    got = run(spark, lifecycle.tumbling(lifecycle.read(spark, folder), late="1000 days"), "complete", "tumbling")
    assert values(got) == values(rows.groupBy(F.window("ts", "1 hour").start.alias("start"), "type").agg(F.count("*").alias("n")))
    got = run(spark, lifecycle.sliding(lifecycle.read(spark, folder), late="1000 days"), "complete", "sliding")
    assert got.agg(F.sum("n")).first()[0] == 4 * rows.count()
    got = run(spark, lifecycle.sessions(lifecycle.read(spark, folder), late="1000 days"), "complete", "sessions")
    assert values(got) == values(rows.groupBy("topic", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("topic", F.col("w.start").alias("began"), "n"))


def test_dedup_and_latency(spark, data, folder):
    twice = tempfile.mkdtemp(prefix="spark-") + "/twice"
    rows = spark.read.parquet(folder)
    rows.unionByName(rows).coalesce(1).write.parquet(twice)
    got = run(spark, lifecycle.deduplicated(lifecycle.read(spark, twice), "1000 days"), "append", "dedup")
    assert got.count() == rows.count()
    got = run(spark, lifecycle.latency(lifecycle.read(spark, folder), "6 HOURS", "1000 days"), "append", "latency")
    want = rows.alias("a").join(rows.alias("b"), F.expr("a.topic = b.topic AND a.type = 'job.started' AND b.type = 'job.completed' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 6 HOURS"))
    assert got.count() == want.count()


def test_hooks_in_batches(spark, folder):
    hooks, counts = Hooks(), []
    hooks.on("job.failed", lambda rows, n: counts.append(rows.count()))
    hooks.on("*", lambda rows, n: 1 / 0)
    query = lifecycle.read(spark, folder).writeStream.foreachBatch(hooks.for_each_batch()).option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sum(counts) == spark.read.parquet(folder).where("type = 'job.failed'").count() and hooks.errors


def stream(spark, rows, schema):
    path = tempfile.mkdtemp(prefix="spark-") + "/in"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def test_admission_equals_batch(spark):
    schema = "queue string, tenant string, ts timestamp_ntz, kind string, id string"
    rows = [("q", "t", T0 + timedelta(seconds=i), "acquire" if i % 3 else "release", f"{i:03}") for i in range(40)]
    limits, tenants = {"q": admission.Limit(0.4, 2, 6)}, {("q", "t"): admission.Limit(0, 0, 4)}
    got = run(spark, stateful.admit(stream(spark, rows, schema), limits, tenants), "append", "admitted")
    want = admission.admit(spark.createDataFrame(rows, schema), limits, tenants)
    assert values(got, "id", "admitted") == values(want, "id", "admitted")


def test_credits_with_replenishing(spark):
    schema = "subscriber string, ts timestamp_ntz, kind string, event_id string, credits int"
    rows = [("s", T0 + timedelta(seconds=i), "event", f"e{i}", None) for i in range(4)] + [("s", T0 + timedelta(seconds=9), "credit", None, 5), ("s", T0 + timedelta(seconds=10), "event", "e9", None)]
    got = run(spark, stateful.credit_flow(stream(spark, rows, schema), 2), "append", "credits")
    assert values(got, "event_id") == [("e0",), ("e1",), ("e9",)]


def test_waits(spark):
    schema = "name string, ts timestamp, kind string, id string, timeout_ms bigint"
    second = timedelta(seconds=1)
    rows = [("go", T0, "wait", "w1", 60_000), ("go", T0 + 5 * second, "event", "e1", None), ("go", T0 + 6 * second, "event", "e2", None), ("no", T0, "wait", "w2", 1_000)]
    got = run(spark, stateful.wait_for_events(stream(spark, rows, schema).withWatermark("ts", "1 second")), "append", "waits")
    assert ("go", "w1", "e1") in values(got) and ("go", "w1", "e2") not in values(got)
