"""Operators whose work must not gather in one task: scans, as-of waits, trees, deliveries over time, Bloom-filtered inserts, deep pages."""

import random
import time
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerflow.operators import bloom, changelog, lifecycle, scan, workflow
from tests.conftest import values

T0 = datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def many_parts(spark):
    """Small ranges stay apart, so that values have parts to be carried over."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# --- scans ------------------------------------------------------------------


def test_running_last_carries_over_parts(spark):
    r = random.Random(1)
    rows = [(r.choice(["hot", "hot", "hot", "b", "c", None]), i, r.choice([None, None, i])) for i in range(600)]
    frame = spark.createDataFrame(rows, "g string, k int, v int")
    dealt = scan.in_order(frame, ["g"], [F.asc("k")])
    assert dealt.where("g = 'hot'").select("__part").distinct().count() > 1
    last, want = {}, {}
    for g, k, v in rows:
        last[g] = v if v is not None else last.get(g)
        want[k] = last[g]
    got = {x.k: x.out for x in scan.running_last(dealt, ["g"], "v", "out").collect() if x.g is not None}
    assert got == {k: want[k] for g, k, _ in rows if g is not None}


# --- waits ------------------------------------------------------------------


def plain_waits(waits, events):
    out = Counter()
    for w, name, since, timeout in waits:
        open_ = [(at, i) for i, n, acked, at in events if not acked and n is not None and n == name and since is not None and timeout is not None and since <= at <= since + timedelta(seconds=timeout)]
        out[(w, name, *(min(open_)[::-1] if open_ else (None, None)))] += 1
    return out


def test_waits_find_the_first_event_in_time(spark):
    r = random.Random(2)
    names = ["a", "a", "a", "b", None]
    at = lambda: T0 + timedelta(seconds=r.randint(0, 900))
    events = [(f"e{i}", r.choice(names), r.random() < 0.3, at()) for i in range(300)]
    waits = [(f"w{i}", r.choice([*names, "none"]), r.choice([at(), at(), None]), r.choice([0, 1, 30, 5000, None])) for i in range(300)]
    frame = spark.createDataFrame(waits, "wait_id string, name string, since timestamp_ntz, timeout_s int")
    log = spark.createDataFrame(events, "id string, name string, acked boolean, created_at timestamp_ntz")
    assert Counter(tuple(x) for x in workflow.first_event(frame, log).collect()) == plain_waits(waits, events)
    assert workflow.first_event(frame, log.limit(0)).where("event_id IS NOT NULL").count() == 0
    assert workflow.first_event(frame.limit(0), log).count() == 0


def test_waits_of_one_name_and_long_timeouts_are_linear(spark):
    """Twenty thousand waits and events of one name, all within the others' timeouts: four hundred million pairs."""
    n = 20_000
    ids = spark.range(n)
    second = lambda k: F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), k.cast("decimal(18,6)"))
    waits = ids.select(F.col("id").cast("string").alias("wait_id"), F.lit("one").alias("name"), second(F.col("id") * 3).alias("since"), F.lit(30 * 86400).alias("timeout_s"))
    events = ids.select(F.concat(F.lit("e"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("id"), F.lit("one").alias("name"), F.lit(False).alias("acked"), second(F.col("id") * 3 + 1).alias("created_at"))
    began = time.time()
    found = workflow.first_event(waits, events).where("event_id = concat('e', lpad(wait_id, 6, '0'))").count()
    assert found == n and time.time() - began < 60


# --- credits ----------------------------------------------------------------


def test_replenished_credits_are_those_of_a_plain_loop(spark):
    r = random.Random(3)
    kinds = "event_id string, subscriber string, type string, ts timestamp_ntz"
    sent = [(f"e{i:04}", r.choice(["hot", "hot", "hot", "b", "c"]), r.choice(["job.started", "job.failed"]), T0 + timedelta(seconds=r.randint(0, 400))) for i in range(900)]
    grants = [(r.choice(["hot", "b", "other"]), T0 + timedelta(seconds=r.randint(0, 400)), r.choice([0, 1, 5, 40, -3])) for _ in range(60)]
    credits = {"hot": 7, "c": 0}
    want, left = [], {}
    moves = [(ts, 0, "", s, n) for s, ts, n in grants] + [(ts, 1, e, s, None) for e, s, k, ts in sent if k != "job.started"]
    for ts, kind, event, s, n in sorted(moves, key=lambda x: x[:3]):
        left.setdefault(s, credits.get(s, 4))
        if kind == 0:
            left[s] += max(n, 0)
        elif left[s] > 0:
            left[s] -= 1
            want.append((event, s, left[s]))
    got = lifecycle.with_replenished_credits(
        spark.createDataFrame(sent, kinds), spark.createDataFrame(grants, "subscriber string, ts timestamp_ntz, n int"), spark.createDataFrame(list(credits.items()), "subscriber string, credits int"), 4, F.col("type") != "job.started"
    )
    assert values(got, "event_id", "subscriber", "credits_left") == sorted(want, key=repr)


def test_two_credits_then_five_more(spark):
    sent = spark.createDataFrame([(f"e{i}", "s", "job.started", T0 + timedelta(seconds=i)) for i in range(4)], "event_id string, subscriber string, type string, ts timestamp_ntz")
    grants = spark.createDataFrame([("s", T0 + timedelta(seconds=3), 5)], "subscriber string, ts timestamp_ntz, n int")
    got = lifecycle.with_replenished_credits(sent, grants, spark.createDataFrame([("s", 2)], "subscriber string, credits int"))
    assert values(got, "event_id", "credits_left") == [("e0", 1), ("e1", 0), ("e3", 4)]


# --- deliveries over time ---------------------------------------------------


@pytest.mark.parametrize("slice_rows", [7, 100_000])
def test_deliveries_follow_the_subscriptions_of_their_time(spark, slice_rows):
    r = random.Random(4)
    at = lambda: T0 + timedelta(microseconds=r.randint(0, 10**8))
    events = [(f"e{i}", r.choice(["job.started", "workflow.failed", "cron.fired"]), at(), r.choice(["job:1", "job:2", "", None])) for i in range(150)]
    changes = [(r.choice("abc"), r.choice(["jobs", "job:1", "firehose", "none"]), at(), i, r.random() < 0.6) for i in range(60)] + [("a", None, at(), 60, False), ("b", "jobs", T0, 61, True), ("b", "jobs", T0, 62, False), ("b", "jobs", T0, 63, True)]
    changes += [("c", "job:1", events[5][2], 70, True), ("c", "job:1", events[6][2], 71, False)]
    topics = lambda kind, topic: {"firehose", {"job": "jobs", "workflow": "workflows"}.get(kind.split(".")[0]), topic} - {None, ""}
    want = set()
    for i, kind, ts, topic in events:
        on = {}
        for s, t, when, _, active in sorted(changes, key=lambda c: (c[2], c[3])):
            if when <= ts:
                for x in [t] if t is not None else [k for k in on if k[0] == s]:
                    on[x if t is None else (s, t)] = active
        want |= {(i, s, kind, ts) for (s, t), active in on.items() if active and t in topics(kind, topic)}
    got = lifecycle.deliveries_in_force(spark.createDataFrame(events, "event_id string, type string, ts timestamp_ntz, topic string"), spark.createDataFrame(changes, "subscriber string, topic string, ts timestamp_ntz, seq int, active boolean"), slice_rows)
    assert sorted(map(tuple, got.collect())) == sorted(want)


# --- trees ------------------------------------------------------------------


def test_trees_of_given_roots_with_rings_and_lost_parents(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("d", "b"), ("e", "d"), ("x", "y"), ("y", "z"), ("z", "x"), ("under", "x"), ("self", "self"), ("o", "lost"), ("p", "o")]
    frame = spark.createDataFrame(rows, "id string, parent_run_id string")
    whole = [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 2), ("a", "e", 3)]
    assert values(workflow.run_tree(frame)) == whole
    every = workflow.run_tree(frame, F.lit(True))
    want = whole + [("b", "b", 0), ("b", "c", 1), ("b", "d", 1), ("b", "e", 2), ("c", "c", 0), ("d", "d", 0), ("d", "e", 1), ("e", "e", 0), ("o", "o", 0), ("o", "p", 1), ("p", "p", 0)]
    assert values(every) == sorted(want, key=repr)
    assert values(workflow.run_tree(frame, F.col("id").isin("x", "self", "under"))) == []
    assert values(workflow.run_tree(frame, F.col("id") == "d")) == [("d", "d", 0), ("d", "e", 1)]
    assert workflow.run_tree(frame.limit(0), F.lit(True)).count() == 0


def test_a_chain_of_ten_thousand_takes_few_rounds(spark, monkeypatch):
    n, rounds = 10_000, []
    cut = workflow.cut
    monkeypatch.setattr(workflow, "cut", lambda df: rounds.append(1) or cut(df))
    frame = spark.range(n).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent_run_id"))
    got = workflow.run_tree(frame, F.col("id").isin("0", "5000", "9990"))
    assert Counter(dict(got.groupBy("root_id").count().collect())) == {"0": n, "5000": 5000, "9990": 10}
    assert got.where("depth <> cast(id AS int) - cast(root_id AS int)").count() == 0
    assert len(rounds) <= 3 * 14 + 4


# --- inserts ----------------------------------------------------------------


def test_bloom_filter_keeps_all_that_are_there_and_few_others(spark):
    table = spark.range(200_000).select(F.concat(F.lit("job_"), F.col("id").cast("string")).alias("id"), F.lit(1).alias("__bits"))
    keys = spark.range(199_000, 205_000).select(F.concat(F.lit("job_"), F.col("id").cast("string")).alias("id"))
    got = bloom.may_have(table, "id", keys, "id", 6000)
    assert got.columns == table.columns
    ids = {int(r.id[4:]) for r in got.collect()}
    assert set(range(199_000, 200_000)) <= ids and len(ids) < 1000 + 200_000 * 0.01
    assert bloom.may_have(table, "id", keys.limit(0), "id", 0).count() == 0
    assert bloom.build(keys, "id", 1 << 40) is None


def test_inserts_shuffle_only_what_may_conflict(spark):
    table = spark.range(100_000).select(F.col("id").cast("string").alias("id"), F.lit("old").alias("v")).unionByName(spark.createDataFrame([(None, "old")], "id string, v string"))
    new = spark.createDataFrame([("5", "new"), ("100001", "b"), ("100001", "a"), (None, "n")], "id string, v string")
    assert values(changelog.conflicts(table, new), "id") == [("5",)]
    assert values(changelog.insert(table, new).where("v <> 'old'")) == [("100001", "a"), (None, "n")]
    assert bloom.taken(table, new, "id").count() <= 5


# --- logs as a source -------------------------------------------------------


def test_log_source_reads_by_number(spark, tmp_path):
    from ledgerflow.sources import log
    from ledgerflow.store import Store
    from ledgerflow.streaming import lifecycle as streams

    log.register(spark)
    store, options = Store(spark, f"file://{tmp_path}"), {"path": f"file://{tmp_path}", "entity": "jobs"}
    read = lambda: spark.read.format("entity_log").options(**options).load()
    assert read().count() == 0
    for k in range(1, 5):
        store.append("jobs", spark.createDataFrame([(f"job_{i}", f"n{k}", T0, i) for i in range(k)], "id string, name string, run_at timestamp_ntz, priority int").repartition(2))
    store.delete("jobs", ["job_0"])
    assert values(read(), "id", "name", "priority", "run_at", "__seq", "__deleted") == values(store.log("jobs"), "id", "name", "priority", "run_at", "__seq", "__deleted")
    some = read().where("__seq >= 3 AND __seq < 5 AND id IN ('job_0', 'job_2') AND name LIKE 'n%'")
    assert values(some, "id", "__seq") == [("job_0", 3), ("job_0", 4), ("job_2", 3), ("job_2", 4)]
    assert read().where("__seq = 2").rdd.getNumPartitions() <= 2 < read().rdd.getNumPartitions()
    plan = some._jdf.queryExecution().executedPlan().toString()
    left = plan.split("Filter", 1)[1].split("\n")[0]
    assert "StartsWith" in left and "__seq" not in left
    stream = spark.readStream.format("entity_log").options(**options).load().select("id", "__seq", "__deleted")
    assert values(streams.finished(stream)) == values(store.log("jobs"), "id", "__seq", "__deleted")
    begin, end = {"seq": 1}, {"seq": 3}
    reader = log.LogStream(log.EntityLog({"entity": "jobs"}).schema(), options)
    assert {tuple(r[c] for c in ("id", "__seq")) for p in reader.partitions(begin, end) for b in reader.read(p) for r in b.to_pylist()} == {(f"job_{i}", k) for k in (2, 3) for i in range(k)}
    assert reader.latestOffset() == {"seq": 5}


# --- sinks ------------------------------------------------------------------


def test_sink_forgets_tries_that_broke_off(spark, tmp_path):
    from ledgerflow.streaming import sink

    path, kind = f"file://{tmp_path}/sink", "id bigint"
    assert sink.written(spark, path, kind).count() == 0
    put = sink.write_once(path)

    def broken(batch):
        raise RuntimeError("broken")

    put(spark.range(3), 0)
    put(spark.range(100, 103), 0)  # delivered again: skipped
    spark.range(50).write.parquet(f"{path}/rows/batch=1")  # written, but the try ended before its mark
    assert values(sink.written(spark, path, kind)) == [(0,), (1,), (2,)]
    with pytest.raises(RuntimeError):
        sink.write_once(path, broken)(spark.range(9), 2)
    put(spark.range(10, 12), 1)
    put(spark.range(20, 21), 2)
    assert values(sink.written(spark, path, kind)) == [(0,), (1,), (10,), (11,), (2,), (20,)]


# --- codecs -----------------------------------------------------------------


def test_msgpack_bytes_of_the_public_format(spark):
    from ledgerflow.functions import codec

    known = {
        "null": "C0", "false": "C2", "true": "C3", "0": "00", "127": "7F", "128": "CC80", "256": "CD0100", "65536": "CE00010000", "4294967296": "CF0000000100000000", "-1": "FF", "-32": "E0", "-33": "D0DF", "-129": "D1FF7F",
        "-32769": "D2FFFF7FFF", "-2147483649": "D3FFFFFFFF7FFFFFFF", "1.5": "CB3FF8000000000000", '""': "A0", '"é"': "A2C3A9", "[]": "90", "[1,[2]]": "92019102", "{}": "80", '{"a":{"b":[null,true]}}': "81A16181A16292C0C3",
        '"' + "x" * 40 + '"': "D928" + "78" * 40, "[" + ",".join("1" * 20) + "]": "DC0014" + "01" * 20, '"' + "y" * 300 + '"': "DA012C" + "79" * 300, "{" + ",".join(f'"{chr(97 + i)}":0' for i in range(16)) + "}": "DE0010" + "".join(f"A1{97 + i:02X}00" for i in range(16)),
    }
    frame = spark.createDataFrame([(t,) for t in known] + [(None,)], "t string")
    got = frame.select("t", codec.encoded(F.col("t"), "msgpack").alias("b")).select("t", F.hex("b").alias("hex"), codec.decoded(F.col("b"), "msgpack").alias("back"), codec.decoded(codec.encoded(F.col("t"), "other"), None).alias("plain"))
    for row in got.collect():
        assert row.hex == (known[row.t] if row.t is not None else None) and row.back == row.t == row.plain
    assert codec.unpack(bytes.fromhex("CA3FC00000")) == 1.5 and codec.unpack(bytes.fromhex("C4026162")) == "ab"
    for bad in ("", "C1", "A5", "92 01", "C0 C0", "CD 00"):
        with pytest.raises(ValueError):
            codec.unpack(bytes.fromhex(bad))


def test_metrics_by_ranges_are_exact(spark):
    from ledgerflow.operators import settle

    r = random.Random(7)
    rows = [(r.choice(["hot", "hot", "hot", "b", None]), r.choice([None, r.randint(0, 50), r.randint(0, 10**6)]), r.random() < 0.8) for _ in range(700)] + [("none", None, True), ("one", 5, False)]
    frame = spark.createDataFrame(rows, "name string, elapsed_ms bigint, ok boolean")
    want = frame.groupBy("name").agg(F.count("*").alias("executions"), F.count_if(~F.col("ok")).alias("failures"), F.round(F.percentile("elapsed_ms", 0.95), 6).alias("p95_ms"), F.max("elapsed_ms").alias("max_ms"))
    assert values(settle.metrics(frame).withColumn("p95_ms", F.round("p95_ms", 6))) == values(want)


# --- pages ------------------------------------------------------------------


@pytest.mark.parametrize("offset, limit", [(0, 10), (37, 5), (95, 20), (500, 5), (90, 0), (0, 0)])
def test_deep_pages_are_those_of_a_sort(spark, offset, limit):
    rows = [(i, (i * 37) % 10 if i % 9 else None) for i in range(100)]
    frame = spark.createDataFrame(rows, "id int, k int").repartition(5)
    order = lambda: [F.desc_nulls_last("k"), F.asc("id")]
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))[offset:]
    got = changelog.deep_page(frame, order(), limit, offset)
    assert [tuple(r) for r in got.collect()] == (want[:limit] if limit else want)
    assert [tuple(r) for r in changelog.page(frame, order(), limit, offset).collect()] == (want[:limit] if limit else want)
