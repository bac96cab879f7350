"""Runs, checkpoints and waits. A checkpoint log is append-only; (run_id, step_name) is a step."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ledgerflow.operators import scan
from ledgerflow.operators.changelog import change, latest
from ledgerflow.operators.jobs import null_ts
from ledgerflow.session import cut
from ledgerflow.sources.entities import plus


def current_checkpoints(log: DataFrame, ties: list[str] = ()) -> DataFrame:
    """The last checkpoint of each step; ``ties`` order rows of one time, the largest last."""
    return latest(log, ["run_id", "step_name"], [F.desc("created_at"), *(F.desc(c) for c in ties)])


def timeline(checkpoints: DataFrame) -> DataFrame:
    """Each run's steps in order of time and name, numbered from 1."""
    order = Window.partitionBy("run_id").orderBy("created_at", "step_name")
    return checkpoints.select("run_id", F.row_number().over(order).alias("position"), "step_name", "created_at")


def inspect_step(checkpoints: DataFrame, run_id: str, step: str) -> DataFrame:
    return checkpoints.where((F.col("run_id") == run_id) & (F.col("step_name") == step))


def step_or_error(checkpoints: DataFrame, run_id: str, step: str) -> Row:
    """The step's checkpoint; LookupError if the run has none."""
    found = inspect_step(checkpoints, run_id, step).first()
    if found is None:
        raise LookupError(f"run {run_id} has no checkpoint of step {step}")
    return found


def delete_after(checkpoints: DataFrame, step: str, ties: bool = False) -> DataFrame:
    """Without the checkpoints later than ``step`` of the same run; with ``ties``, also those of its time.
    Runs without the step keep all. One shuffle, by run; of several checkpoints of the step the latest counts."""
    run = Window.partitionBy("run_id")
    marked = checkpoints.withColumn("__at", F.max(F.when(F.col("step_name") == step, F.col("created_at"))).over(run))
    keep = F.col("__at").isNull() | (F.col("step_name") == step) | ((F.col("created_at") < F.col("__at")) if ties else (F.col("created_at") <= F.col("__at")))
    return marked.where(keep).select(*checkpoints.columns)


def pending_steps(planned: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Planned (run_id, step_name, ...) that have no checkpoint yet."""
    done = checkpoints.select(F.col("run_id").alias("__run"), F.col("step_name").alias("__step"))
    return planned.join(done, (F.col("run_id") == F.col("__run")) & (F.col("step_name") == F.col("__step")), "left_anti")


def _with_checkpoints(planned: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """``planned`` with ``cached`` and ``saved`` of the steps' current checkpoints; the data may be null."""
    done = current_checkpoints(checkpoints).select(F.col("run_id").alias("__run"), F.col("step_name").alias("__step"), F.col("data").alias("saved"), F.lit(True).alias("__ok"))
    joined = planned.join(done, (F.col("run_id") == F.col("__run")) & (F.col("step_name") == F.col("__step")), "left")
    return joined.withColumn("cached", F.coalesce("__ok", F.lit(False))).drop("__run", "__step", "__ok")


def run_steps(planned: DataFrame, checkpoints: DataFrame, handlers: dict[str, Callable[[object, dict], object]]) -> DataFrame:
    """(run_id, step_name, seq, cached, ok, error, data) of planned steps (run_id, step_name, seq, handler, input as JSON).

    A step with a checkpoint gives back its data and doesn't run. The others run their handler in order,
    on their input and the results by name of the run's steps before; the first to fail ends its run's steps."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, results = [], {}
        for step in pdf.sort_values(["seq", "step_name"]).itertuples(index=False):
            data, error = step.saved, None
            if not step.cached:
                try:
                    if step.handler not in handlers:
                        raise LookupError(f"no handler for {step.handler}")
                    data = json.dumps(handlers[step.handler](json.loads(step.input or "null"), dict(results)))
                except Exception as e:  # noqa: BLE001  a handler may raise anything
                    data, error = None, str(e)
            rows.append((step.run_id, step.step_name, step.seq, step.cached, error is None, error, data))
            if error is not None:
                break
            results[step.step_name] = json.loads(data or "null")
        return pd.DataFrame(rows, columns=["run_id", "step_name", "seq", "cached", "ok", "error", "data"])

    joined = _with_checkpoints(planned.select("run_id", "step_name", F.col("seq").cast("bigint"), "handler", "input"), checkpoints)
    return joined.groupBy("run_id").applyInPandas(run, "run_id string, step_name string, seq bigint, cached boolean, ok boolean, error string, data string")


def new_checkpoints(results: DataFrame, as_of: Column) -> DataFrame:
    """Checkpoints of the good results that came from no checkpoint."""
    return results.where("ok AND NOT cached").select(_derived("ckpt").alias("id"), "run_id", "step_name", "data", as_of.alias("created_at"))


def _derived(prefix: str) -> Column:
    """An id that follows from a step's run and name."""
    return F.concat(F.lit(prefix + "_"), F.md5(F.concat_ws("|", F.length("run_id").cast("string"), "run_id", "step_name").cast("binary")))


def start_children(planned: DataFrame, checkpoints: DataFrame, runs: DataFrame, versions: DataFrame, as_of: Column) -> DataFrame:
    """New runs, linked to their parents, for planned child steps (run_id, step_name, name, input) that have
    neither a checkpoint nor a child yet. Unknown names are left out; child_results() fails their steps."""
    wanted = pending_steps(planned, checkpoints).select(_derived("wfrun").alias("id"), "name", F.col("run_id").alias("parent_run_id"), "input")
    fresh = wanted.join(runs.select(F.col("id").alias("__id")), F.col("id") == F.col("__id"), "left_anti")
    newest = versions.select(F.col("name").alias("__name"), "version")
    return fresh.join(newest, F.col("name") == F.col("__name")).select(
        "id", "name", "version", F.lit("running").alias("state"), "input", "parent_run_id", as_of.alias("started_at"), as_of.alias("created_at")
    )


def child_results(planned: DataFrame, checkpoints: DataFrame, runs: DataFrame, versions: DataFrame) -> DataFrame:
    """(run_id, step_name, cached, ok, error, data) of planned ``child:`` steps: the checkpoint's data, or the
    child's output when it is completed. A failed child fails the step; ``ok`` is null while the child runs."""
    child = runs.select(F.col("id").alias("__child"), F.col("state").alias("__state"), F.col("output").alias("__output"), F.col("error").alias("__error"))
    known = versions.select(F.col("name").alias("__known")).distinct()
    joined = _with_checkpoints(planned.withColumn("__id", _derived("wfrun")), checkpoints)
    joined = joined.join(child, F.col("__id") == F.col("__child"), "left").join(known, F.col("name") == F.col("__known"), "left")
    failed = F.when(F.col("__state") == "failed", F.concat(F.lit('child workflow "'), "name", F.lit('" failed: '), F.coalesce("__error", F.lit(""))))
    lost = F.when(F.col("__child").isNull() & F.col("__known").isNull(), F.concat(F.lit('no workflow "'), "name", F.lit('"')))
    error = F.when(~F.col("cached"), F.coalesce(failed, lost))
    ok = F.when(F.col("cached") | (F.col("__state") == "completed"), True).when(error.isNotNull(), False)
    data = F.when(F.col("cached"), F.col("saved")).when(F.col("__state") == "completed", F.coalesce("__output", F.lit("null")))
    return joined.select("run_id", "step_name", "cached", ok.alias("ok"), error.alias("error"), data.alias("data"))


def spawn_results(planned: DataFrame, checkpoints: DataFrame, versions: DataFrame) -> DataFrame:
    """As child_results() for ``spawn:`` steps, which don't wait: their data are the child's id."""
    known = versions.select(F.col("name").alias("__known")).distinct()
    joined = _with_checkpoints(planned, checkpoints).join(known, F.col("name") == F.col("__known"), "left")
    ok = F.col("cached") | F.col("__known").isNotNull()
    data = F.when(F.col("cached"), F.col("saved")).when(ok, _derived("wfrun"))
    return joined.select("run_id", "step_name", "cached", ok.alias("ok"), F.when(~ok, F.concat(F.lit('no workflow "'), "name", F.lit('"'))).alias("error"), data.alias("data"))


def group_status(members: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """(run_id, members, done, complete) of parallel groups: complete when every member has its checkpoint."""
    done = checkpoints.select(F.col("run_id").alias("__run"), F.col("step_name").alias("__step"), F.lit(True).alias("__ok")).distinct()
    joined = members.join(done, (F.col("run_id") == F.col("__run")) & (F.col("step_name") == F.col("__step")), "left")
    ok = F.coalesce("__ok", F.lit(False))
    return joined.groupBy("run_id").agg(F.count("*").alias("members"), F.count_if(ok).alias("done"), F.bool_and(ok).alias("complete"))


def compensations(steps: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """(run_id, position, step_name) still to undo, last step first; ``steps`` has run_id, step_name and seq.
    A step is undone once its ``compensate:`` checkpoint is there, and one that never ran needs no undoing."""
    step, undo = F.col("step_name"), F.col("step_name").startswith("compensate:")
    marks = F.array_compact(F.array(F.struct(step.alias("step"), F.lit(False).alias("undone")), F.when(undo, F.struct(F.substring(step, 12, 1 << 20).alias("step"), F.lit(True).alias("undone")))))
    there = checkpoints.select("run_id", F.explode(marks).alias("m")).select("run_id", F.col("m.step").alias("step_name"), F.lit(None).cast("bigint").alias("seq"), "m.undone")
    planned = steps.select("run_id", "step_name", F.col("seq").cast("bigint").alias("seq"), F.lit(None).cast("boolean").alias("undone"))
    met = planned.unionByName(there).groupBy("run_id", "step_name").agg(F.max("seq").alias("seq"), F.bool_or(~F.col("undone")).alias("ran"), F.bool_or("undone").alias("undone"))
    left = met.where("seq IS NOT NULL AND ran AND NOT undone")
    order = Window.partitionBy("run_id").orderBy(F.desc("seq"), F.asc("step_name"))
    return left.select("run_id", F.row_number().over(order).alias("position"), "step_name")


def children(runs: DataFrame, parent: str) -> DataFrame:
    return runs.where(F.col("parent_run_id") == parent).orderBy("created_at", "id")


def _tops(runs: DataFrame) -> DataFrame:
    """(id, up, depth): each run's topmost ancestor by pointer doubling, ``up`` null for runs on or below a ring.

    Each round joins a run with what its pointer points to, so rounds grow with the logarithm of the depth. A run whose
    depth is beyond a round's reach has an ancestor that the next round ends, so the first round that ends none is the last."""
    known = runs.select(F.col("id").alias("__known"))
    state = runs.select("id", F.col("parent_run_id").alias("parent")).join(known, F.col("parent") == F.col("__known"), "left")
    top = F.col("__known").isNull()
    state = cut(state.select("id", F.coalesce("__known", "id").alias("up"), F.when(top, 0).otherwise(1).alias("depth"), top.alias("done")))
    left = state.where("NOT done").count()
    while left:
        above = state.select(F.col("id").alias("__id"), F.col("up").alias("__up"), F.col("depth").alias("__depth"), F.col("done").alias("__done"))
        moved = state.where("NOT done").join(above, F.col("up") == F.col("__id")).select("id", F.col("__up").alias("up"), (F.col("depth") + F.col("__depth")).alias("depth"), F.col("__done").alias("done"))
        state = cut(state.where("done").unionByName(moved))
        before, left = left, state.where("NOT done").count()
        if left == before:
            break
    return state.select("id", F.when(F.col("done"), F.col("up")).alias("up"), F.when(F.col("done"), F.col("depth")).alias("depth"))


def run_tree(runs: DataFrame, roots: Column | None = None) -> DataFrame:
    """(root_id, id, depth) of every run below the roots, which are the runs without a parent unless they are given.

    Given roots may lie below one another. Then each round knows all of a run's ancestors among the roots up to a
    distance, and doubles it: what a run's pointer points to gives its own ancestors, farther by the pointer's length.
    So there are as many rounds as the depth has binary digits, and what is written adds up to the result. Runs on a ring, or
    below one, are below no root and no one's root; nor is a run without given roots whose parents are missing."""
    tops = _tops(runs)
    if roots is None:
        parentless = runs.where("parent_run_id IS NULL").select(F.col("id").alias("__top"))
        return tops.join(parentless, F.col("up") == F.col("__top")).select(F.col("up").alias("root_id"), "id", "depth")
    sound = tops.where("up IS NOT NULL").select(F.col("id").alias("__sound"), F.col("depth").alias("__deep"))
    known = runs.select("id", F.col("parent_run_id").alias("up"), F.coalesce(roots, F.lit(False)).alias("root")).join(sound, F.col("id") == F.col("__sound"))
    pointers = cut(known.select("id", "up", "root", "__deep"))
    deepest = pointers.agg(F.max("__deep")).first()[0] or 0
    found = pointers.where("root").select(F.col("id").alias("root_id"), "id", F.lit(0).alias("depth"))
    pointers, reach = pointers.select("id", F.when(F.col("__deep") > 0, F.col("up")).alias("up")), 1
    while reach <= deepest:
        near = found.select(F.col("id").alias("__id"), "root_id", "depth")
        new = pointers.join(near, F.col("up") == F.col("__id")).select("root_id", "id", (F.col("depth") + reach).cast("int").alias("depth"))
        found = found.unionByName(cut(new))
        above = pointers.select(F.col("id").alias("__id"), F.col("up").alias("__up"))
        pointers, reach = cut(pointers.join(above, F.col("up") == F.col("__id")).select("id", F.col("__up").alias("up")).where("up IS NOT NULL")), 2 * reach
    return found


def fan_out(results: DataFrame) -> DataFrame:
    """(run_id, results): children's results (run_id, idx, result) in input order, null if any is missing."""
    rows = F.transform(F.sort_array(F.collect_list(F.struct("idx", "result"))), lambda x: x["result"])
    return results.groupBy("run_id").agg(F.when(F.count("result") == F.count("*"), rows).alias("results"))


def first_event(waits: DataFrame, events: DataFrame) -> DataFrame:
    """``waits`` (wait_id, name, since, timeout_s), a row each, with the oldest unacknowledged event of the name in time, null
    where there is none; of events of one time the least id. It isn't claimed: two waits may see one event, and
    acknowledgements apply when the batch ends. Waits without a name, a start or a timeout get none.

    An as-of join: waits and events stand in one order, latest first, and the last event that a wait has seen there is the
    first one from its start on. Work is linear however many waits and events share a name, and a hot name is many parts."""
    opened = events.where("NOT acked AND name IS NOT NULL")
    nothing = F.lit(None).cast("struct<event_at: timestamp_ntz, event_id: string>")
    looking = waits.select("wait_id", "name", "since", "timeout_s", F.col("since").cast("timestamp_ntz").alias("__when"), F.lit(1).alias("__kind"), F.col("wait_id").cast("string").alias("__tie"), nothing.alias("__event"))
    event = F.struct(F.col("created_at").cast("timestamp_ntz").alias("event_at"), F.col("id").alias("event_id"))
    seen = opened.select("name", F.col("created_at").cast("timestamp_ntz").alias("__when"), F.lit(0).alias("__kind"), F.col("id").alias("__tie"), event.alias("__event"))
    rows = scan.in_order(looking.unionByName(seen, allowMissingColumns=True), ["name"], [F.desc("__when"), F.asc("__kind"), F.desc("__tie")])
    met = scan.running_last(rows, ["name"], "__event", "__found").where("__kind = 1")
    in_time = F.col("__found.event_at") <= plus(F.col("since"), F.col("timeout_s"))
    return met.select("wait_id", "name", F.when(in_time, F.col("__found.event_id")).alias("event_id"), F.when(in_time, F.col("__found.event_at")).alias("event_at"))


def wait_checkpoints(found: DataFrame, as_of: Column, kind: str = "wait") -> DataFrame:
    """The checkpoints that waits (wait_id: the run's id) leave: the event's id, empty after a timeout, so that a run
    which is resumed doesn't wait again. The events found are to be acknowledged (cluster.acknowledge)."""
    step = F.concat(F.lit(kind + ":"), F.col("name"))
    return found.select(F.col("wait_id").alias("run_id"), step.alias("step_name"), F.coalesce("event_id", F.lit("")).alias("data"), as_of.alias("created_at"))


def wait_all(found: DataFrame, groups: list[str]) -> DataFrame:
    """Whether each group of waits has all its events, and when the last came; a missing one is a timeout."""
    all_ = F.count("event_id") == F.count("*")
    return found.groupBy(*groups).agg(F.count("*").alias("wanted"), F.count("event_id").alias("arrived"), all_.alias("complete"), F.when(all_, F.max("event_at")).alias("complete_at"))


def wait_any(found: DataFrame, groups: list[str]) -> DataFrame:
    """The first event to arrive in each group of waits, null if none does."""
    got = F.min(F.when(F.col("event_id").isNotNull(), F.struct("event_at", "event_id", "name"))).alias("e")
    return found.groupBy(*groups).agg(got).select(*groups, F.col("e.event_id").alias("event_id"), F.col("e.name").alias("name"))


def due_sleeps(sleeps: DataFrame, as_of: Column) -> DataFrame:
    """Sleeps (run_id, since, seconds) that are over."""
    wake = plus(F.col("since"), F.col("seconds"))
    return sleeps.withColumn("wake_at", wake).where(F.col("wake_at") <= as_of)


def newest_versions(registry: DataFrame) -> DataFrame:
    """(name, version, handler): the largest version of each workflow; a version registered again takes the later handler."""
    return registry.groupBy("name").agg(F.max(F.struct("version", "seq", "handler")).alias("r")).select("name", "r.version", "r.handler")


def resume_set(runs: DataFrame, registry: DataFrame) -> DataFrame:
    """Running runs with the handler of their own version, in order of creation."""
    handlers = registry.groupBy(F.col("name").alias("__name"), F.col("version").alias("__version")).agg(F.max_by("handler", "seq").alias("handler"))
    rows = runs.where("state = 'running'").join(handlers, (F.col("name") == F.col("__name")) & (F.col("version") == F.col("__version")), "left")
    return rows.select("id", "name", "version", "handler", "created_at").orderBy("created_at", "id")


def restart(runs: DataFrame, which: Column, version: Column) -> DataFrame:
    """Runs set back to running on a version; checkpoints stay."""
    return change(runs, which, state=F.lit("running"), version=version, completed_at=null_ts())


def replay_from(runs: DataFrame, checkpoints: DataFrame, step: str, versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs that have the step start again behind it on their workflow's newest version: (runs, checkpoints)."""
    with_step = checkpoints.where(F.col("step_name") == step).select(F.col("run_id").alias("__run")).distinct()
    newest = versions.select(F.col("name").alias("__name"), F.col("version").alias("__newest"))
    joined = runs.join(with_step, F.col("id") == F.col("__run"), "left").join(newest, F.col("name") == F.col("__name"), "left")
    again = F.col("__run").isNotNull()
    out = restart(joined, again, F.coalesce("__newest", "version")).select(*runs.columns)
    return out, delete_after(checkpoints, step)


def finish(runs: DataFrame, results: DataFrame, as_of: Column) -> DataFrame:
    """Runs with a result (id, ok) completed or failed."""
    named = results.select(F.col("id").alias("__id"), "ok")
    joined = runs.join(named, F.col("id") == F.col("__id"), "left")
    return change(joined, F.col("ok").isNotNull(), state=F.when(F.col("ok"), "completed").otherwise("failed"), completed_at=as_of).select(*runs.columns)


def start(requests: DataFrame, versions: DataFrame, as_of: Column) -> DataFrame:
    """New runs from (id, name), stamped with their workflow's newest version; unknown names are left out. Requests
    that have them give the runs their parent_run_id and input too."""
    newest = versions.select(F.col("name").alias("__name"), "version")
    return requests.join(newest, F.col("name") == F.col("__name")).select("id", "name", "version", F.lit("running").alias("state"), as_of.alias("started_at"), as_of.alias("created_at"), *(c for c in ("parent_run_id", "input") if c in requests.columns))
