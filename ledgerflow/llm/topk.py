"""Exact top-k search with a vector-approximation file.

Vectors are whole numbers, floor(256 x) of each component. The file is written once: each vector's
components, and its approximation, one byte a component: which of ``CELLS`` equal cells between the
vector's own least and greatest component it lies in. Least component and width of the cells are kept
with it, so one outlying vector doesn't widen the cells of the others.

1. Scan. Queries are taken in blocks of bounded size; for each, every task reads the approximations
   (and no exact vectors). One product with the cells gives a lower and an upper bound of every score.
   A task passes on what could still be among the k best: whose upper bound reaches the k-th best
   lower bound that it has seen. The same cut is then made over all tasks.
2. Read. What is left is read exactly in order of its bound, the best ``STEP`` first, then more, until
   the k-th exact score is above every bound left. Exact vectors come by a join on the row's number.

Nothing but queries is copied: vectors stay where they were written, and tables never meet whole.

Defined results: a null vector, or one with a null or non-finite component, or a null id, takes no
part; only vectors of equal length are compared, empty ones too (with score 0); rows with the query's
id are its own; equal scores go to the smaller id; repeated rows of a query are one query, those of
others count each; several vectors of one query's id are a query each. Scores are exact: where a
double could round, Python's integers are used; a score of the result that no long can hold raises an
error, and so does a component that no double can hold times 256. Fewer rows than k give fewer
results, an empty table none. Only the id and vector columns are read, whatever others there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.llm.common import appended, staged

CELLS = 256
SCALE = 256
#: Bytes of the queries that a task holds at once.
QUERY_BYTES = 16 << 20
#: Approximations, and queries, whose bounds are computed together.
ROWS, ASKED = 2048, 512
#: Vectors a query reads exactly in the first round; each further one reads four times as many.
STEP = 32

FILE = "rid bigint, id bigint, dim int, low double, width double, cells binary, v array<double>"
FOUND = "q bigint, rid bigint, lower double, upper double"


def _lists(column: pa.Array) -> Iterator[np.ndarray | None]:
    """Each list's values; None if it is null or holds a null or non-finite value."""
    for row in column:
        values = row.values if row.is_valid else None
        if values is None or values.null_count:
            yield None
            continue
        x = values.to_numpy(zero_copy_only=False).astype(np.float64)
        yield x if np.isfinite(x).all() else None


def approximate(v: np.ndarray) -> tuple[float, float, np.ndarray]:
    """(low, width, cells): component i is from low + cells[i] * width to less than a width above."""
    low, high = (float(v.min()), float(v.max())) if len(v) else (0.0, 0.0)
    width = max(float(np.ceil((high - low + 1) / CELLS)), 1.0)
    return low, width, np.clip((v - low) // width, 0, CELLS - 1).astype(np.uint8)


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for rid, name, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _lists(batch.column(2)), strict=True):
            if x is not None:
                with np.errstate(over="ignore"):
                    v = np.floor(x * SCALE)
                if not np.isfinite(v).all():
                    raise OverflowError(f"a component of vector {name} is too large")
                low, width, cells = approximate(v)
                rows.append((rid, name, len(v), low, width, cells.tobytes(), v))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.float64())]
        columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in FILE.split(", ")])


def write_file(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The vector-approximation file, see FILE. Parquet keeps columns apart, so a scan of the cells reads no vectors."""
    rows = df.where(F.col(id_col).isNotNull()).select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("x"))
    return staged(rows.mapInArrow(_write, FILE))


def bounds(cells: np.ndarray, low: np.ndarray, width: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all inner products, (vectors, queries)."""
    middle = (cells.astype(np.float64) @ queries.T) * width[:, None] + np.outer(low, queries.sum(axis=1))
    above, below = np.maximum(queries, 0).sum(axis=1), np.maximum(-queries, 0).sum(axis=1)
    # Sums beyond 2**53 are rounded, in proportion to what they add up.
    slack = np.outer(np.maximum(np.abs(low), np.abs(low + width * CELLS)), 1e-12 * (above + below))
    return middle - np.outer(width - 1, below) - slack, middle + np.outer(width - 1, above) + slack


def _scan(queries: list[tuple[int, int, list[float]]], k: int):
    """What of a task's approximations may be among the k best of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for dim in {len(v) for _, _, v in queries}:
            own = [x for x in queries if len(x[2]) == dim]
            vectors = np.array([v for _, _, v in own], dtype=np.float64).reshape(len(own), dim)
            asked[dim] = np.array([q for q, _, _ in own]), np.array([i for _, i, _ in own]), vectors, np.full((k, len(own)), -np.inf)
        for batch in batches:
            rid, ids, dims, low, width = (batch.column(i).to_numpy() for i in range(5))
            cells = batch.column(5)
            for dim in np.intersect1d(dims, list(asked)).tolist():
                numbers, names, vectors, best = asked[dim]
                at = np.flatnonzero(dims == dim)
                for a in range(0, len(at), ROWS):
                    some = at[a : a + ROWS]
                    block = np.frombuffer(b"".join(cells[i].as_py() for i in some.tolist()), dtype=np.uint8).reshape(len(some), dim)
                    for b in range(0, len(numbers), ASKED):
                        c = slice(b, b + ASKED)
                        lower, upper = bounds(block, low[some], width[some], vectors[c])
                        own = ids[some][:, None] == names[None, c]
                        lower[own], upper[own] = -np.inf, -np.inf
                        seen = np.concatenate([best[:, c], lower])
                        best[:, c] = np.partition(seen, len(seen) - k, axis=0)[len(seen) - k :]
                        i, j = np.nonzero((upper >= best[:, c].min(axis=0)) & ~own)
                        if len(i):
                            columns = [pa.array(x) for x in (numbers[c][j], rid[some][i], lower[i, j], upper[i, j])]
                            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in FOUND.split(", ")])

    return run


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact scores; where no long holds one, the nearest long, and ``over``."""
    for batch in batches:
        scores, over = [], []
        for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
            x, y = (c.values.to_numpy() for c in (a, b))
            if len(x) and np.abs(x).max() * np.abs(y).max() * len(x) >= 2.0**52:
                score = sum(int(s) * int(t) for s, t in zip(x.tolist(), y.tolist(), strict=True))
            else:
                score = int(np.dot(x, y))
            fits = -(1 << 63) <= score < 1 << 63
            over.append(not fits)
            scores.append(score if fits else ((1 << 63) - 1 if score > 0 else -(1 << 63)))
        columns = [*(batch.column(c) for c in ("q", "id")), pa.array(scores, pa.int64()), pa.array(over, pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, names=["q", "id", "score", "over"])


def _blocks(asked: DataFrame, size: int) -> Iterator[list[tuple[int, int, list[float]]]]:
    """The queries, so many at a time."""
    last = None
    while True:
        more = asked if last is None else asked.where(F.col("q") > last)
        block = [(r.q, r.id, r.v) for r in more.orderBy("q").limit(size).collect()]
        if block:
            yield block
        if len(block) < size:
            return
        last = block[-1][0]


def top_k(df: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", query_bytes: int = QUERY_BYTES, step: int = STEP) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of each row whose id is divisible by ``every``."""
    file = write_file(df, id_col, vector_col)
    asked = staged(file.where(F.pmod("id", F.lit(every)) == 0).groupBy("id", "v").agg(F.min("rid").alias("q")).select("q", "id", F.size("v").alias("dim"), "v"))
    longest = asked.agg(F.max("dim")).first()[0] or 1
    scan = file.select("rid", "id", "dim", "low", "width", "cells")
    found = appended(df.sparkSession, FOUND, (scan.mapInArrow(_scan(block, k), FOUND) for block in _blocks(asked, max(1, query_bytes // (8 * longest)))))
    # The cut of each task, over all of them: the k-th best lower bound of a query.
    by_lower, by_upper = Window.partitionBy("q").orderBy(F.desc("lower")), Window.partitionBy("q").orderBy(F.desc("upper"), "rid")
    least = found.select("q", "lower", F.row_number().over(by_lower).alias("r")).where(F.col("r") <= k).groupBy("q").agg(F.when(F.count("*") == k, F.min("lower")).alias("least"))
    left = found.join(least.withColumnRenamed("q", "p"), F.col("q") == F.col("p")).where("least IS NULL OR upper >= least")
    left = staged(left.select("q", "rid", "upper", F.row_number().over(by_upper).alias("place")))
    best, low, high = None, 0, step
    while True:
        some = left.where((F.col("place") > low) & (F.col("place") <= high))
        if best is not None:
            # What the exact scores found so far leave open.
            worst = best.groupBy("q").agg(F.when(F.count("*") == k, F.min("score")).alias("worst"))
            open_ = left.where(F.col("place") > low).join(worst.withColumnRenamed("q", "p"), F.col("q") == F.col("p")).where("worst IS NULL OR upper >= worst")
            if open_.isEmpty():
                break
            some = open_.where(F.col("place") <= high)
        pairs = some.select("q", "rid").join(file.select("rid", "id", F.col("v").alias("b")), "rid").join(asked.select("q", F.col("v").alias("a")), "q")
        scored = pairs.select("q", "id", "a", "b").mapInArrow(_score, "q bigint, id bigint, score bigint, over boolean")
        every_one = scored if best is None else scored.unionByName(best.drop("rank"))
        order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
        best = staged(every_one.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k))
        low, high = high, 4 * high
    score = F.when(F.col("over"), F.raise_error(F.lit("a score is too large for a long"))).otherwise(F.col("score")).cast("bigint")
    return best.join(asked.select("q", F.col("id").alias("query_id")), "q").select("query_id", "rank", F.col("id").alias("vec_id"), score.alias("score"))


def top_k_sql(k: int = 5, every: int = 50, embeddings: str = "embeddings") -> str:
    """DuckDB SQL for top_k() over vectors of one length without null or non-finite components."""
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS DOUBLE)) AS v FROM {embeddings}
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id % {every} = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= {k}"""
