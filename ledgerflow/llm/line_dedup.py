"""Line deduplication by winnowing, in DataFrame functions only.

A gram is the shortest stretch of lines from a line on that holds ``GRAM`` words. Over every span
of grams that start within ``SPAN`` words of one another, the one with the least hash is selected
as a fingerprint. So any passage of whole lines with at least ``GRAM + SPAN`` words holds a
selected gram, and holds the same one wherever it occurs: the guarantee of winnowing.

Each fingerprint's occurrences are joined with its first one in corpus order (id, then text hash,
then line). From there the match is extended line by line both ways, and the later run goes. The
first occurrence may stand among other lines than the run does; so a fingerprint has further keys,
for itself with the 1, 2, ... lines before it and with those behind it, up to ``GRAM + SPAN`` words,
and each key is joined with its own first occurrence. Beyond those words a run holds another
fingerprint. So every later run of at least ``GRAM + SPAN`` words is deleted whole, while each row is
joined with one other only: the work follows the number of lines, however often a passage repeats.

Defined results: blank lines count for nothing and go only inside a deleted run; a null text stays
null, an empty one empty; passages below ``GRAM`` words stay; rows with equal id and equal text
count as one document and are treated alike; a null id comes before all others; an empty table gives no rows.
A very long text is one row's arrays, its lines and for each fingerprint up to 100 keys, and one task's work in proportion to
its lines. Other columns pass
through, whatever their names but __id, __th and __runs; one called n_lines_cut is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import WORD, staged, text_of

GRAM, SPAN = 30, 20
REACH = GRAM + SPAN
#: Lines of a text that are joined as one row, besides those around them.
CHUNK = 256


def _lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, lines): the lines that are not blank, each with its place, hash and number of words."""
    cut = "filter(transform(split(__t, '\\n'), (x, p) -> named_struct('p', p, 'h', xxhash64(x), 'w', regexp_count(x, r'" + WORD + "'))), l -> l.w > 0)"
    rows = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("__t"))
    return rows.select("id", F.xxhash64("__t").alias("th"), F.expr(cut).alias("lines")).where(F.size("lines") > 0)


def _grams(lines: DataFrame) -> DataFrame:
    """(id, th, at, g): the keys of each selected gram, and its first line's number among ``lines``."""
    gram = (
        f"transform(sequence(1, size(lines)), s -> aggregate(slice(lines, s, {GRAM}), named_struct('w', 0, 'n', 0, 'g', 42L), "
        f"(a, l) -> CASE WHEN a.w >= {GRAM} THEN a ELSE named_struct('w', a.w + l.w, 'n', a.n + 1, 'g', xxhash64(a.g, l.h)) END, "
        f"a -> named_struct('s', s, 'w', lines[s - 1].w, 'n', a.n, 'g', CASE WHEN a.w >= {GRAM} THEN a.g END)))"
    )
    # The last grams of a text are too short and have no hash; a later equal hash wins, as in robust winnowing.
    least = (
        f"array_distinct(filter(transform(grams, x -> aggregate(slice(grams, x.s, {SPAN}), named_struct('w', 0, 'g', cast(null as bigint), 's', 0, 'n', 0), "
        f"(a, y) -> CASE WHEN a.w >= {SPAN} THEN a WHEN y.g IS NOT NULL AND (a.g IS NULL OR y.g <= a.g) THEN named_struct('w', a.w + y.w, 'g', y.g, 's', y.s, 'n', y.n) "
        "ELSE named_struct('w', a.w + y.w, 'g', a.g, 's', a.s, 'n', a.n) END, a -> named_struct('g', a.g, 's', a.s, 'n', a.n))), f -> f.g IS NOT NULL))"
    )
    fingerprints = lines.withColumn("grams", F.expr(gram)).select("id", "th", "lines", F.expr(least).alias("least"))

    def around(side: int, beside: str) -> str:
        """The keys with ever more lines on one side; ``beside``: those lines, nearest first."""
        return (
            f"aggregate(slice({beside}, 1, {REACH}), named_struct('w', 0, 'h', xxhash64(found.g, {side}), 'keys', cast(array() as array<bigint>)), (a, l) -> "
            f"CASE WHEN a.w >= {REACH} THEN a ELSE named_struct('w', a.w + l.w, 'h', xxhash64(a.h, l.h), 'keys', concat(a.keys, array(xxhash64(a.h, l.h)))) END, a -> a.keys)"
        )

    before, behind = "reverse(slice(lines, greatest(found.s - {0}, 1), least(found.s - 1, {0})))".format(REACH), "slice(lines, found.s + found.n, {0})".format(REACH)
    keys = f"concat(array(found.g), {around(1, before)}, {around(2, behind)})"
    # Keys are made beside the arrays that they come from; what is exploded carries none of these.
    keyed = fingerprints.select("id", "th", F.explode(F.expr(f"transform(least, found -> named_struct('at', found.s, 'keys', {keys}))")).alias("f"))
    return keyed.select("id", "th", "f.at", F.explode("f.keys").alias("g"))


def _same(a: str, b: str) -> str:
    """SQL for the number of leading entries that two arrays share."""
    return f"aggregate(array(zip_with({a}, {b}, (x, y) -> x <=> y)), 0, (n, z) -> cast(CASE WHEN array_position(z, false) = 0 THEN size(z) ELSE array_position(z, false) - 1 END as int))"


def repeated_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, runs): for each document with later repeated runs, their merged (first, last) lines."""
    lines = staged(_lines(df, id_col, text_col).dropDuplicates(["id", "th"]))
    grams = _grams(lines)
    place = F.struct("id", "th", "at")
    first = staged(grams.groupBy("g").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    pairs = staged(grams.join(first, "g").where(~place.eqNullSafe(F.col("first"))).select("id", "th", "at", F.col("first.id").alias("fid"), F.col("first.th").alias("fth"), F.col("first.at").alias("fat")).distinct())
    # The lines around both places: REACH before, and REACH behind the gram. A place meets the chunk of its text that has them.
    around = lambda at: f"slice(c.lines, greatest({at} - c.skip - {REACH}, 1), {2 * REACH + GRAM})"
    before = lambda at: f"{at} - c.skip - greatest({at} - c.skip - {REACH}, 1)"
    chunk = lambda at: F.floor((F.col(at) - 1) / CHUNK)
    skip = f"greatest(k * {CHUNK} - {REACH}, 0)"
    cut = f"transform(sequence(0, cast(floor((size(lines) - 1) / {CHUNK}) AS int)), k -> named_struct('k', k, 'skip', {skip}, 'lines', slice(lines, {skip} + 1, {CHUNK + 2 * REACH + GRAM})))"
    own = lines.select(F.col("id").alias("__id"), F.col("th").alias("__th"), F.explode(F.expr(cut)).alias("c")).withColumn("__k", F.col("c.k"))
    key = F.col("id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")) & (chunk("at") == F.col("__k"))
    here = pairs.join(own, key).select("id", "th", "fid", "fth", "fat", F.expr(f"transform({around('at')}, l -> l.h)").alias("h"), F.expr(f"transform({around('at')}, l -> l.p)").alias("p"), F.expr(before("at")).alias("left"))
    # Many places may have the same first one: a join that is split where it is skewed.
    key = F.col("fid").eqNullSafe(F.col("__id")) & (F.col("fth") == F.col("__th")) & (chunk("fat") == F.col("__k"))
    both = here.join(own, key).select("id", "th", "h", "p", "left", F.expr(f"transform({around('fat')}, l -> l.h)").alias("fh"), F.expr(before("fat")).alias("fleft"))
    right = _same("slice(h, left + 1, size(h))", "slice(fh, fleft + 1, size(fh))")
    back = _same("reverse(slice(h, 1, left))", "reverse(slice(fh, 1, fleft))")
    runs = both.select("id", "th", "p", "left", F.expr(right).alias("ahead"), F.expr(back).alias("behind"))
    runs = runs.select("id", "th", F.expr("named_struct('a', p[left - behind], 'b', p[left + ahead - 1])").alias("run"))
    merged = (
        "aggregate(array_sort(runs), cast(array() as array<struct<a: int, b: int>>), (m, r) -> CASE WHEN size(m) > 0 AND r.a <= element_at(m, -1).b + 1 "
        "THEN concat(slice(m, 1, size(m) - 1), array(named_struct('a', element_at(m, -1).a, 'b', greatest(element_at(m, -1).b, r.b)))) ELSE concat(m, array(r)) END)"
    )
    # A document's runs are at most as many as its lines.
    return runs.groupBy("id", "th").agg(F.collect_set("run").alias("runs")).select("id", "th", F.expr(merged).alias("runs"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with later repeated runs cut out of ``text_col``, and n_lines_cut: the lines gone (0 for most)."""
    runs = repeated_runs(df, id_col, text_col).select(F.col("id").alias("__id"), F.col("th").alias("__th"), F.col("runs").alias("__runs"))
    joined = df.join(runs, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_of(text_col)) == F.col("__th")), "left")
    kept = "filter(split(__t, '\\n'), (x, p) -> NOT exists(__runs, r -> p BETWEEN r.a AND r.b))"
    text = F.when(F.col("__runs").isNull(), F.col(text_col)).otherwise(F.expr(f"array_join({kept.replace('__t', f'`{text_col}`')}, '\\n')"))
    cut = F.coalesce(F.expr("aggregate(__runs, 0, (n, r) -> n + r.b - r.a + 1)"), F.lit(0)).cast("bigint")
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (text_col, "n_lines_cut")]
    return joined.select(*rest, text.alias(text_col), cut.alias("n_lines_cut"))
