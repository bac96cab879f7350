"""Dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.operators.changelog import change, delete, latest, page
from ledgerflow.operators.jobs import search

_ORDER = (F.asc, "failed_at"), (F.asc, "id")


def _order() -> list[Column]:
    return [f(c) for f, c in _ORDER]


def list_letters(dlq: DataFrame, queue: str | None = None, limit: int = 0, offset: int = 0) -> DataFrame:
    """Oldest failure first."""
    return page(dlq.where(F.col("queue") == queue) if queue else dlq, _order(), limit, offset)


def push(dlq: DataFrame, new: DataFrame) -> DataFrame:
    """``dlq`` with the letters of ``new``: one whose id is there replaces it."""
    one = latest(new, ["id"], [F.desc("failed_at"), *(F.asc(c) for c in new.columns if c not in ("id", "failed_at"))])
    return delete(dlq, one).unionByName(one, allowMissingColumns=True)


def as_jobs(letters: DataFrame, as_of: Column) -> DataFrame:
    """New pending jobs from letters, with no retries counted, and payload and scopes where letters have them;
    the id is derived from the letter's and the time."""
    key = F.md5(F.concat_ws("|", F.col("id"), as_of.cast("string")).cast("binary"))
    return letters.select(
        F.concat(F.lit("job_"), key).alias("id"), F.col("job_name").alias("name"), "queue", F.lit("pending").alias("state"), F.lit(0).alias("retry_count"),
        "max_retries", "scope_org_id", as_of.alias("run_at"), as_of.alias("created_at"), *(c for c in ("payload", "scope_app_id") if c in letters.columns),
    )


def replay(dlq: DataFrame, ids: Column, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(dlq, jobs): replaying marks a letter; nothing keeps it from being replayed again."""
    return change(dlq, ids, replayed_at=as_of), as_jobs(dlq.where(ids), as_of)


def replay_all(dlq: DataFrame, as_of: Column, most: int = 1000) -> DataFrame:
    """Jobs from the first ``most`` letters that were not replayed yet: the limit comes before that filter."""
    return as_jobs(page(dlq, _order(), most).where("replayed_at IS NULL"), as_of)


def purge(dlq: DataFrame, before: Column) -> DataFrame:
    """What stays: letters that failed at ``before`` or later."""
    return dlq.where(~(F.col("failed_at") < before))


def purged(dlq: DataFrame, before: Column) -> DataFrame:
    return dlq.agg(F.count_if(F.col("failed_at") < before).alias("purged"))


def letters_page(dlq: DataFrame, text: str, queue: str | None, limit: int, offset: int = 0) -> DataFrame:
    """A page by queue, then those of it whose job has the text in its name; total counts all letters."""
    rows = search(list_letters(dlq, queue, limit, offset), text, "job_name")
    return rows.crossJoin(F.broadcast(dlq.agg(F.count("*").alias("total"))))


def widget(dlq: DataFrame, jobs: DataFrame) -> DataFrame:
    """Two counts, a row each side."""
    return dlq.agg(F.count("*").alias("dead_letters")).crossJoin(jobs.agg(F.count_if(F.col("state") == "failed").alias("failed_jobs")))
