"""Running values along an order, without a task that holds a whole group.

``in_order`` deals rows out by ranges and writes them; a hot group is many parts. A running value is then what a part's own
rows give and what the parts before it carry over: one small row a part and group, run over by a window of its own.
Rows that tie in the whole order are equal in it, so give an order that tells apart what must be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.session import cut

_WITHIN = Window.unboundedPreceding, 0
_BEFORE = Window.unboundedPreceding, -1


def in_order(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """``df`` with ``__at``, which ascends with (by, order), and ``__part``, its range. It is written once, so every use of it sees the same ranges."""
    keys = [*(F.col(c).asc_nulls_first() for c in by), *order]
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return cut(dealt.withColumn("__at", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__at", 33))


def _own(by: list[str]):
    return Window.partitionBy("__part", *by).orderBy("__at")


def _with_carried(rows: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with the columns of ``edges`` (part, by, carried ones); a null group carries nothing."""
    named = edges.withColumnsRenamed({c: f"__edge_{c}" for c in ["__part", *by]})
    same = [F.col(c) == F.col(f"__edge_{c}") for c in ["__part", *by]]
    return rows.join(named, same, "left").drop(*(f"__edge_{c}" for c in ["__part", *by]))


def running_last(rows: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """``rows`` of in_order() with the last non-null ``value`` of their group so far, their own included."""
    edges = rows.groupBy("__part", *by).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("__at"))).alias("__value"))
    across = Window.partitionBy(*by).orderBy("__part").rowsBetween(*_BEFORE)
    edges = edges.select("__part", *by, F.last("__value", ignorenulls=True).over(across).alias("__carried"))
    own = rows.withColumn("__own", F.last(value, ignorenulls=True).over(_own(by).rowsBetween(*_WITHIN)))
    return _with_carried(own, edges, by).withColumn(out, F.coalesce("__own", "__carried")).drop("__own", "__carried")


def numbered(rows: DataFrame, by: list[str], out: str) -> DataFrame:
    """``rows`` of in_order() with their place in their group, from 0."""
    across = Window.partitionBy(*by).orderBy("__part").rowsBetween(*_BEFORE)
    edges = rows.groupBy("__part", *by).agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    edges = edges.select("__part", *by, (F.coalesce(F.sum("__rows").over(across), F.lit(0)) - F.col("__first")).alias("__shift"))
    return _with_carried(rows, edges, by).withColumn(out, F.col("__at") + F.col("__shift")).drop("__shift")


def running_floor(rows: DataFrame, by: list[str], change: str, start: Column) -> DataFrame:
    """``rows`` of in_order() with ``__sum``, ``start`` and the changes of their group so far, and ``__floor``, the least that sum has
    been before the row, at most 0.

    What a counter that never falls below 0 holds after a row is the sum less the floor including that row: each
    change is a map x -> max(x + change, 0), such maps compose to ones of a sum and a floor, and so parts compose."""
    own = rows.withColumn("__own", F.sum(change).over(_own(by).rowsBetween(*_WITHIN)))
    own = own.withColumn("__low", F.min("__own").over(_own(by).rowsBetween(*_BEFORE)))
    edges = own.groupBy("__part", *by).agg(F.sum(change).alias("__total"), F.min("__own").alias("__least"))
    across = Window.partitionBy(*by).orderBy("__part").rowsBetween(*_BEFORE)
    edges = edges.withColumn("__base", F.coalesce(F.sum("__total").over(across), F.lit(0)))
    edges = edges.select("__part", *by, "__base", F.min(F.col("__base") + F.col("__least")).over(across).alias("__before"))
    met = _with_carried(own, edges, by).withColumn("__base", start + F.col("__base"))
    floor = F.least(F.lit(0), start + F.col("__before"), F.col("__base") + F.col("__low"))
    return met.withColumn("__sum", F.col("__base") + F.col("__own")).withColumn("__floor", floor).drop("__own", "__low", "__base", "__before")
