"""Mixing sources to target weights by hash thresholds.

A document's rank within its source is a hash of its id, then a hash of id and text, then its number as
a row. Words are summed by source and hash bucket; the bucket where a source's budget runs out is
split into finer buckets, and only that one, until it holds one hash; where several rows have that
hash, the next key goes on from there. A document below its source's threshold is taken once more than
the whole repeats its source is owed; the rest of the work is a filter. The document at which the budget runs
out is taken if that comes nearer to the target. Nothing is sorted, and thresholds are nested: a larger budget
takes all that a smaller one takes. So a source ends within half a document of its target, whatever ids repeat.

Defined results: a null text has size 0; a null source is a source of its own, last in order; null ids
share their first hash; of rows with the same id and text, which are alike, any may be the ones taken,
but reruns take as many; an empty table gives no rows; a source without words has target 0 and takes
nothing. A very long text is read once, its size and hash are kept. Columns of the input are kept only
on request, whatever their names; one called as the result (MIX) is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.llm.common import WORD, staged, text_of

HASH_BITS, LEVEL_BITS = 60, 10
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
MIX = "__mix"
#: What ranks a source's rows, one key after the other.
KEYS = ("h", "h2", "row")
#: So many sources may be broadcast with their thresholds, at under 100 bytes each.
SMALL = 50_000


def hash_of(column: Column) -> Column:
    """60 bits of a text's md5, as DuckDB can compute them too."""
    return F.conv(F.substring(F.md5(column.cast("binary")), 1, 15), 16, 10).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(src, source_size) -> with target. Sources in code point order, null last, weigh ``weights`` over and over.

    A source is capped if its cap is below its share by weight of what the capped ones leave; in
    order of cap by weight the capped ones come first, so running sums find the level at once. The
    windows run over one row a source, never over documents."""
    ordered = Window.orderBy(F.col("src").isNull(), F.col("src"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("src").isNull(), F.col("src"))
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * share - F.col("cap_before")) / F.col("weight_left")
    found = (
        ranked.withColumn("cap_before", F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", level)
        .withColumn("settled", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")))
        .withColumn("settled", F.min("settled").over(by_cap.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("final", F.first("settled", ignorenulls=True).over(by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    target = F.when(F.col("settled").isNull(), F.col("cap").cast("double")).otherwise(F.col("final") * F.col("weight"))
    return found.select("src", "source_size", F.least(target, F.col("cap").cast("double")).alias("target"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: bool = False, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(id, size, source_size, target, taken); with ``keep`` the input's columns and a struct MIX of
    these and copies, how often each row is taken."""
    size = F.regexp_count(text_of(text_col), F.lit(WORD)).cast("bigint")
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    facts = F.struct(
        F.col(source_col).alias("src"), size.alias("size"), hash_of(name).alias("h"), hash_of(F.concat(name, F.lit("\n"), text_of(text_col))).alias("h2"), F.monotonically_increasing_id().alias("row")
    )
    columns = [c for c in df.columns if c != MIX] if keep else [id_col]
    # Written once: the number of a row must be the same whenever it is read.
    rows = staged(df.select(*(F.col(f"`{c}`") for c in columns), facts.alias(MIX)))
    narrow = rows.select(f"{MIX}.*")
    goal = targets(narrow.groupBy("src").agg(F.sum("size").alias("source_size")), weights, share, most)
    goal = staged(
        goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
        .withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
        .select("*", *(F.lit(0).cast("bigint").alias(f"below_{k}") for k in KEYS), F.lit(False).alias("done"))
    )
    side = F.broadcast if goal.count() <= SMALL else (lambda x: x)
    for at, key in enumerate(KEYS):
        goal = _threshold(narrow, goal, at, side)
        if goal.where(~F.col("done")).isEmpty():
            break
    goal = goal.select(F.col("src").alias("__s"), F.struct("source_size", "target", "whole", *(f"below_{k}" for k in KEYS)).alias("__goal"))
    met = rows.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)), F.col(MIX)).join(side(goal), F.col(f"{MIX}.src").eqNullSafe(F.col("__s")))
    below = F.lit(False)
    for key in reversed(KEYS):
        own, limit = F.col(f"{MIX}.{key}"), F.col(f"__goal.below_{key}")
        below = (own < limit) | ((own == limit) & below)
    # A document without words may lie below the threshold of a source that is owed all its repeats.
    copies = F.least(F.col("__goal.whole") + F.when(below, F.lit(1)).otherwise(F.lit(0)), F.lit(most))
    size = F.col(f"{MIX}.size")
    found = [size.alias("size"), F.col("__goal.source_size").alias("source_size"), F.col("__goal.target").alias("target"), (size * copies).cast("bigint").alias("taken")]
    if not keep:
        return met.select(F.col("c0").alias(id_col), *found)
    return met.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)), F.struct(*found, copies.cast("int").alias("copies")).alias(MIX))


def _threshold(narrow: DataFrame, goal: DataFrame, at: int, side) -> DataFrame:
    """``goal`` with the threshold of one more key: of the rows that equal all thresholds of the keys before, those
    below it fit in what is left, but for the last one, of which half does. ``done``: no other row has the threshold's value."""
    key, limit = KEYS[at], f"below_{KEYS[at]}"
    goal = goal.withColumn("settled", F.col("done"))
    bits = HASH_BITS
    while bits:
        bits -= LEVEL_BITS
        width = 1 << bits
        # Only rows in the bucket still open count; it starts at the limit so far and is 2**LEVEL_BITS cells wide.
        lower = goal.where(~F.col("settled")).select(F.col("src").alias("s"), *(F.col(f"below_{k}") for k in KEYS[: at + 1]))
        inside = narrow.join(side(lower), F.col("src").eqNullSafe(F.col("s")))
        for before in KEYS[:at]:
            inside = inside.where(F.col(before) == F.col(f"below_{before}"))
        inside = inside.where((F.col(key) >= F.col(limit)) & (F.col(key) < F.col(limit) + F.lit(width << LEVEL_BITS)))
        cells = inside.groupBy("src", F.shiftright(key, bits).alias("cell")).agg(F.sum("size").alias("words"), F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("rows"))
        cells = cells.withColumn("upto", F.sum("words").over(Window.partitionBy("src").orderBy("cell"))).withColumnRenamed("src", "s")
        met = cells.join(side(goal.select("src", "left")), F.col("src").eqNullSafe(F.col("s")))
        # The boundary: the first cell that the budget does not cover whole.
        boundary = F.struct("cell", "words", (F.col("upto") - F.col("words")).alias("before"), "first", (F.col("first") == F.col("last")).alias("single"), (F.col("rows") == 1).alias("alone"))
        edge = met.where(F.col("upto") > F.col("left")).groupBy("src").agg(F.min_by(boundary, "cell").alias("edge")).withColumnRenamed("src", "s")
        joined = goal.join(side(edge), F.col("src").eqNullSafe(F.col("s")), "left")
        covered = F.col("edge").isNull() & ~F.col("settled")
        nearer = F.col("edge.alone") & (F.col("edge.words") < 2 * (F.col("left") - F.col("edge.before")))
        found = {
            "left": F.when(F.col("edge").isNull(), F.col("left")).otherwise(F.col("left") - F.col("edge.before")),
            limit: F.when(covered, F.col(limit) + F.lit(width << LEVEL_BITS)).when(F.col("edge").isNull(), F.col(limit)).when(F.col("edge.single"), F.col("edge.first") + nearer.cast("bigint")).otherwise(F.col("edge.cell") * width),
            "settled": F.col("settled") | F.coalesce(F.col("edge.single"), F.lit(True)),
            "done": F.col("done") | covered | F.coalesce(F.col("edge.alone"), F.lit(False)),
        }
        goal = staged(joined.select(*(found[c].alias(c) if c in found else F.col(c) for c in goal.columns)))
        if goal.where(~F.col("settled")).isEmpty():
            break
    return goal.drop("settled")


def _targets_sql(weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> str:
    choose = "CASE " + " ".join(f"WHEN (row_number() OVER (ORDER BY src IS NULL, src) - 1) % {len(weights)} = {i} THEN {w}" for i, w in enumerate(weights)) + " END"
    return f"""
sizes AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY src),
ranked AS (SELECT *, {choose} AS weight, source_size * {most} AS cap FROM sizes),
sums AS (SELECT *, CAST(coalesce(sum(cap) OVER (ORDER BY cap / weight, src IS NULL, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cap_before,
         CAST(sum(weight) OVER (ORDER BY cap / weight, src IS NULL, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS weight_left,
         CAST(sum(source_size) OVER () AS BIGINT) AS total FROM ranked),
levels AS (SELECT *, (CAST(total AS DOUBLE) * {share} - cap_before) / weight_left AS level FROM sums),
found AS (SELECT min(CASE WHEN level * weight <= cap THEN cap / weight END) AS from_ratio FROM levels),
final AS (SELECT level AS final FROM levels WHERE level * weight <= cap ORDER BY cap / weight, src IS NULL, src LIMIT 1),
goals AS (SELECT src, source_size, CASE WHEN level * weight <= cap OR cap / weight >= from_ratio AND final IS NOT NULL AND weight * final <= cap THEN least(final * weight, cap) ELSE CAST(cap AS DOUBLE) END AS target
          FROM levels CROSS JOIN found LEFT JOIN final ON TRUE)"""


def mix_sql(documents: str = "documents") -> str:
    """DuckDB SQL for mix(): a document is taken once more if the running words of its source, in order of
    the hashes, stay within what the whole repeats leave, or go beyond it by less than half the document."""
    digits = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)".format
    name = "coalesce(CAST(doc_id AS VARCHAR), '')"
    return f"""
WITH docs AS (SELECT doc_id, source AS src, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
                     {digits(name)} AS h, {digits(name + " || chr(10) || coalesce(text, '')")} AS h2 FROM {documents}),
{_targets_sql()},
met AS (SELECT d.*, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END AS whole,
               sum(d.size) OVER (PARTITION BY d.src ORDER BY d.h, d.h2 ROWS UNBOUNDED PRECEDING) AS upto
        FROM docs d JOIN goals g ON d.src IS NOT DISTINCT FROM g.src)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (whole + CASE WHEN upto <= target - whole * source_size OR upto - size < target - whole * source_size AND size < 2 * (target - whole * source_size - (upto - size)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM met"""
