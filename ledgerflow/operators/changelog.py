"""Rows as an append-only log: a mutation appends, the latest version per key is the state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.operators import bloom, scan


def latest(log: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row per key in ``order``; give enough columns to break every tie."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return log.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def insert(table: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``table`` with the rows of ``new`` whose key it lacks; of new rows with one key the first by all columns.
    A Bloom filter of the new keys goes over the table, so only possible conflicts are shuffled and checked."""
    new = latest(new, [key], [F.col(c).asc_nulls_last() for c in new.columns if c != key] or [F.lit(1)])
    fresh = new.join(bloom.taken(table, new, key), F.col(key) == F.col("__key"), "left_anti")
    return table.unionByName(fresh, allowMissingColumns=True)


def conflicts(table: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """The new rows that insert() refuses because their key is taken."""
    return new.join(bloom.taken(table, new, key), F.col(key) == F.col("__key"), "left_semi")


def replace(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """``table`` with whole rows replaced by those of ``rows`` with the same key; keys it lacks change nothing."""
    known = rows.join(table.select(F.col(key).alias("__key")), F.col(key) == F.col("__key"), "left_semi")
    return delete(table, rows, key).unionByName(known)


def delete(table: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """``table`` without the rows whose key is in ``keys``."""
    return table.join(keys.select(F.col(key).alias("__key")), F.col(key) == F.col("__key"), "left_anti")


#: The offset from which a page is found by ranges.
DEEP = 100_000


def deep_page(rows: DataFrame, order: list[Column], limit: int = 0, offset: int = 0) -> DataFrame:
    """page() for any offset: rows are dealt out by ranges, the ranges' sizes say which of them hold the page, and only their
    rows of it are read. No task holds more than a range, or the page if it has a limit."""
    dealt = scan.in_order(rows, [], order)
    sizes = dealt.groupBy("__part").agg(F.min("__at").alias("first"), F.count("*").alias("n")).orderBy("__part").collect()  # one row a range
    wanted, before = F.lit(False), 0
    for part in sizes:
        begin, end = max(offset - before, 0), part.n if limit <= 0 else min(offset + limit - before, part.n)
        if begin < end:
            wanted = wanted | F.col("__at").between(part.first + begin, part.first + end - 1)
        before += part.n
    return dealt.where(wanted).orderBy("__at").select(*(F.col(f"`{c}`") for c in rows.columns))


def page(rows: DataFrame, order: list[Column], limit: int = 0, offset: int = 0) -> DataFrame:
    """Sorted rows, offset first, then limit; a limit of 0 keeps all. A deep page is found by ranges."""
    if offset >= DEEP:
        return deep_page(rows, order, limit, offset)
    rows = rows.orderBy(*order)
    if offset:
        rows = rows.offset(offset)
    return rows.limit(limit) if limit > 0 else rows


def change(table: DataFrame, when: Column, **columns: Column) -> DataFrame:
    """The whole next state: where ``when`` holds, the given columns take new values."""
    return table.select(*(F.when(when, columns[c]).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns))
