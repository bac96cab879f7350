"""Near duplicates among vectors by an inverted multi-index: links of a cosine of 0.9 or more, and what they connect.

Equal vectors are one class. Vectors are scaled to length 1 and cut in halves; each half has a codebook of its own, and the
pairs of codewords are the cells of a product grid. Each class has a home cell, that of its nearest codewords.

1. Fit. The codebooks come from a sample of at most ``SAMPLE`` classes a vector length, the least by hash, by a fixed number of
   k-means rounds. They grow with the square root of the classes over ``CELL_ROWS``, up to ``CODEWORDS``.
2. Traverse. How far a vector is from a cell is known from its margins: in each half, how much farther the cell's
   codeword is than the nearest, in terms of the distance to the plane between the two. Squared margins of the halves add up,
   and no vector within a distance r has a home beyond r. Cells are visited in order of that sum by the multi-sequence
   walk over the two sorted lists. It ends at a radius that finds ``RECALL`` of the links: fitted on the sample, by each
   vector's partner at the limit in a random direction and by the real links within the sample, whichever needs more.
3. Verify. A class goes to those visited cells only that come after its home, so each pair meets at most once. A cell's
   vectors are dealt to blocks of ``BLOCK_ROWS``, so a hot cell is many tasks' work. A task takes a block and those
   that visit it (blocks after it included), and gets all cosines in double precision by products of matrices. It gives
   each class's number of links, weighted by the classes' rows, and ties it to the least that it reaches within the
   task: never a pair of a group. Connected components of these ties are found by Spark.

Defined results: a vector that is null, zero (or so small that its length has no inverse), or holds a null or non-finite component links
with nothing; it is a component of its own. Vectors of different lengths don't link. Rows without an id take no part: no links,
no component, not kept, and no one's link. Rows alike in id and vector, and other rows of one id, each count and get a
row; a component's id is its least id, and every row of that id with the component's vectors is kept. An empty table gives no rows.
Only the id and the vector are read, whatever other columns there are.

A hot cell, of more than ``BLOCK_ROWS`` classes, has a pivot. Whatever lies within half the limit's angle of it is linked among
itself, by the triangle inequality, so these links are sums and cost nothing more; only the rest of the cell, and what visits it from
farther away, meets them. So a large group of near copies costs work in proportion to its size. Only a hot cell that
is no such group costs the square of it, in blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import arrow_rows, staged
from ledgerflow.llm.graph import components

LEAST = 0.9
SAMPLE, CODEWORDS, CELL_ROWS, BLOCK_ROWS, ROUNDS = 4096, 1024, 256, 2048, 10
RECALL = 0.98
#: Rows whose cosines with others are computed together.
ROWS = 512


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all codewords."""
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * (x @ words.T) + (words * words).sum(axis=1), 0)


def codebook(x: np.ndarray, k: int) -> np.ndarray:
    """``k`` codewords at most; the first ones are rows evenly spread over the sample."""
    distinct = np.unique(x, axis=0)
    words = distinct[np.linspace(0, len(distinct) - 1, min(k, len(distinct))).astype(int)] if len(distinct) else x
    words = np.unique(words, axis=0)
    for _ in range(ROUNDS):
        own = _nearest(x, words).argmin(axis=1)
        number = np.bincount(own, minlength=len(words))
        sums = np.zeros_like(words)
        np.add.at(sums, own, x)
        words = np.where(number[:, None] > 0, sums / np.maximum(number, 1)[:, None], words)
    return words


def margins(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Squared distance of each row to the plane between each codeword and the row's nearest one, 0 for the nearest."""
    distance = _nearest(x, words)
    best = distance.argmin(axis=1)
    apart = _nearest(words, words)[best]
    gap = distance - distance[np.arange(len(x)), best][:, None]
    out = np.where(apart > 0, gap * gap / (4 * np.where(apart > 0, apart, 1)), 0)
    out[np.arange(len(x)), best] = 0
    return out


class Index:
    """Codebooks of both halves and the radius of the walk."""

    def __init__(self, sample: np.ndarray, k: int, least: float, recall: float):
        self.half = sample.shape[1] // 2
        self.words = [codebook(x, k) for x in self._halves(sample)]
        self.radius = self._radius(sample, least, recall)

    def _halves(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, : self.half], x[:, self.half :]]

    def homes(self, x: np.ndarray) -> np.ndarray:
        a, b = (_nearest(h, w).argmin(axis=1) for h, w in zip(self._halves(x), self.words, strict=True))
        return a * len(self.words[1]) + b

    def _radius(self, sample: np.ndarray, least: float, recall: float) -> float:
        random = np.random.default_rng(0).standard_normal(sample.shape)
        random -= (random * sample).sum(axis=1)[:, None] * sample
        random /= np.maximum(np.linalg.norm(random, axis=1), 1e-12)[:, None]
        need = [self._needed(sample, least * sample + np.sqrt(1 - least * least) * random)]
        linked = [np.argwhere(np.triu(sample[a : a + ROWS] @ sample.T >= least, a + 1)) + [a, 0] for a in range(0, len(sample), ROWS)]
        if len(pairs := np.concatenate(linked)):
            need.append(self._needed(sample[pairs[:, 0]], sample[pairs[:, 1]]))
        # A row alone has no partner at the limit to look for, but a walk's end is never before its home.
        return max(float(np.quantile(x, recall)) for x in need)

    def _needed(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How far the one with the lesser home must look to visit the other's."""
        a, b = self.homes(x), self.homes(y)
        first, home = np.where((a <= b)[:, None], x, y), np.maximum(a, b)
        near = [margins(h, w) for h, w in zip(self._halves(first), self.words, strict=True)]
        rows, k = np.arange(len(x)), len(self.words[1])
        return np.where(a == b, 0.0, near[0][rows, home // k] + near[1][rows, home % k])

    def visits(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """The cells that each row visits, nearest first."""
        k = len(self.words[1])
        near = [margins(h, w) for h, w in zip(self._halves(x), self.words, strict=True)]
        for left, right in zip(*near, strict=True):
            yield np.array([i * k + j for i, j in multi_sequence(left, right, self.radius)])


def multi_sequence(left: np.ndarray, right: np.ndarray, radius: float) -> Iterator[tuple[int, int]]:
    """Pairs of places in order of the sum of their values, up to ``radius``."""
    orders = [np.flatnonzero(x <= radius) for x in (left, right)]
    orders = [o[np.argsort(x[o], kind="stable")] for o, x in zip(orders, (left, right), strict=True)]
    a, b = (x[o].tolist() for x, o in zip((left, right), orders, strict=True))
    rows, columns = (o.tolist() for o in orders)
    heap = [(a[0] + b[0], 0, 0)] if a and b else []
    while heap:
        total, i, j = heapq.heappop(heap)
        if total > radius:
            return
        yield rows[i], columns[j]
        # (i, j + 1) is reached from (i, j) only, (i + 1, 0) from (i, 0) only: each pair once.
        if j + 1 < len(b):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of one length, scaled to length 1."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.maximum(np.abs(x).max(axis=1, initial=0), 1e-300)[:, None]  # no square overflows
    return x / np.linalg.norm(x, axis=1)[:, None]


def _usable(vector: Column) -> Column:
    x = vector.cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(x, lambda v: F.abs(v) > 1e-300), F.lit(False))


def fit(classes: DataFrame, least: float = LEAST, recall: float = RECALL) -> dict[int, Index]:
    """An index for each vector length, each from the ``SAMPLE`` classes with the least hashes."""
    out = {}
    for dim, n in classes.groupBy(F.size("v")).count().collect():
        some = classes.where(F.size("v") == dim).orderBy(F.xxhash64("v"), "c").select("v").limit(SAMPLE).toArrow()
        k = int(np.clip(round((n / CELL_ROWS) ** 0.5), 1, CODEWORDS))
        out[dim] = Index(_matrix(some["v"]), k, least, recall)
    return out


def _assign(index: dict[int, Index]):
    """Home and later cells of each row; cells of different lengths are told apart by the length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column("v").offsets.to_numpy())
            for dim in np.unique(sizes).tolist():
                rows = batch.take(pa.array(np.flatnonzero(sizes == dim)))
                x = _matrix(rows.column("v"))
                homes = index[dim].homes(x)
                later = [v[v > h] for v, h in zip(index[dim].visits(x), homes.tolist(), strict=True)]
                ends = np.concatenate([[0], np.cumsum([len(v) for v in later])]).astype(np.int32)
                cells = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(later).astype(np.int64) if later else np.empty(0, np.int64)))
                columns = [*(rows.column(c) for c in ("c", "rows", "v")), pa.array(np.full(len(x), dim, np.int32)), pa.array(homes.astype(np.int64)), cells]
                yield pa.RecordBatch.from_arrays(columns, names=["c", "rows", "v", "dim", "home", "later"])

    return run


def _reach(own: np.ndarray, met: np.ndarray) -> np.ndarray:
    """For rows and then visitors, the number of the component that each is in: ``own`` says which rows link, ``met`` rows and visitors."""
    n, labels = len(own), np.full(sum(met.shape), -1)
    for first in range(n):
        if labels[first] >= 0:
            continue
        rows, visitors = np.zeros(n, bool), np.zeros(met.shape[1], bool)
        new = np.zeros(n, bool)
        new[first] = True
        while new.any():
            rows |= new
            seen = met[new].any(axis=0) & ~visitors
            visitors |= seen
            new = (own[new].any(axis=0) | met[:, seen].any(axis=1)) & ~rows
        labels[:n][rows], labels[n:][visitors] = first, first
    return labels


def _verify(least: float):
    """Links between a block's vectors, and with its visitors: each one's number, weighted, and the least class it reaches."""

    def run(block: pa.Table) -> pa.Table:
        home = block["home"].to_numpy(zero_copy_only=False)
        block = block.take(pa.array(np.concatenate([np.flatnonzero(home), np.flatnonzero(~home)])))
        n, c, weight = int(home.sum()), block["c"].to_numpy(), block["rows"].to_numpy().astype(np.float64)
        x = _matrix(block["v"])
        links = np.zeros(len(c))
        mask = np.zeros((n, len(c)), bool)
        within = block["within"][0].as_py()
        for a in range(0, n, ROWS):
            b = min(a + ROWS, n)
            near = x[a:b] @ x.T >= least
            near[np.arange(b - a), np.arange(a, b)] = False
            if not within:
                near[:, :n] = False
            links[a:b] += near @ weight
            links[n:] += weight[a:b] @ near[:, n:]
            mask[a:b] = near
        there = np.flatnonzero(links)
        rows, guests = there[there < n], there[there >= n]
        labels = _reach(mask[np.ix_(rows, rows)], mask[np.ix_(rows, guests)])
        root = np.full(len(there), np.iinfo(np.int64).max)
        np.minimum.at(root, labels, c[there])
        return pa.table({"c": pa.array(c[there]), "n": pa.array(links[there].astype(np.int64)), "root": pa.array(root[labels])})

    return run


def links(classes: DataFrame, least: float = LEAST, recall: float = RECALL, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(c, n, root): parts of the classes' numbers of links, and the least class each reaches in that part. ``classes`` is a staged
    frame (c, rows, v) of distinct usable vectors."""
    with arrow_rows(classes.sparkSession, 2000):
        placed = staged(classes.mapInArrow(_assign(fit(classes, least, recall)), f"c bigint, rows bigint, v {dict(classes.dtypes)['v']}, dim int, home bigint, later array<bigint>"))
    visits = placed.select("c", "rows", "v", "dim", F.explode("later").alias("home"))
    row, cell = ["c", "rows", "v", "dim", "home"], ["dim", "home"]
    guests = visits.groupBy(*cell).agg(F.count("*").alias("guests"))
    cells = placed.groupBy(*cell).agg(F.count("*").alias("hosts")).join(guests, cell, "left").withColumn("guests", F.coalesce("guests", F.lit(0)))
    cells = staged(cells.select(F.col("dim").alias("d"), F.col("home").alias("cell"), "hosts", "guests"))
    balls = _balls(placed.select(*row), visits, cells.where(F.col("hosts") > block_rows), least)
    cells = cells.join(balls, ["d", "cell"], "left").fillna(0, ["ball_hosts", "ball_guests", "host_rows", "guest_rows"])
    number = lambda n, of: F.ceil(n / of).cast("int")
    apart = F.col("hosts") - F.col("ball_hosts")
    sizes = [number(F.col("ball_hosts"), block_rows).alias("blocks0"), number(apart, block_rows).alias("blocks1")]
    sizes += [F.greatest(number(n, 2 * block_rows), F.lit(1)).alias(f"parts{k}") for k, n in enumerate((apart + F.col("guests") - F.col("ball_guests"), apart + F.col("guests")))]
    cells = staged(cells.select("d", "cell", "pivot", "first", "host_rows", "guest_rows", *sizes))
    near = F.coalesce(_cosine("v", "pivot") >= _half(least), F.lit(False))
    here = lambda df: df.join(cells, (F.col("dim") == F.col("d")) & (F.col("home") == F.col("cell"))).withColumn("ball", near)
    hosts, guests = here(placed.select(*row)), here(visits)
    salt = F.xxhash64("c")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))

    def visiting(df: DataFrame, kind: int) -> DataFrame:
        """Rows that meet all blocks of a kind."""
        some = df.where(F.col(f"blocks{kind}") > 0)
        return some.select("c", "rows", "v", "d", "cell", F.lit(kind).alias("kind"), upto(F.col(f"blocks{kind}")).alias("block"), _part(kind, salt).alias("part"), F.lit(False).alias("home"))

    own = []
    for kind in (0, 1):
        some = hosts.where(F.col("ball") == (kind == 0)).withColumn("block", F.pmod(salt, F.col(f"blocks{kind}")).cast("int"))
        own.append(some.select("c", "rows", "v", "d", "cell", F.lit(kind).alias("kind"), "block", upto(F.col(f"parts{kind}")).alias("part"), F.lit(True).alias("home")))
        if kind:
            own.append(some.where("block > 0").select("c", "rows", "v", "d", "cell", F.lit(kind).alias("kind"), upto(F.col("block")).alias("block"), _part(kind, salt).alias("part"), F.lit(False).alias("home")))
    met = own + [visiting(hosts.where("NOT ball"), 0), visiting(guests.where("NOT ball"), 0), visiting(guests, 1)]
    whole = met[0]
    for some in met[1:]:
        whole = whole.unionByName(some)
    # The pairs within a block are those of one part; within a ball they are sums.
    whole = whole.withColumn("within", (F.col("part") == 0) & (F.col("kind") == 1))
    found = whole.groupBy("d", "cell", "kind", "block", "part").applyInArrow(_verify(least), "c bigint, n bigint, root bigint")
    sums = hosts.where("ball").select("c", (F.col("host_rows") - F.col("rows") + F.col("guest_rows")).alias("n"), F.col("first").alias("root"))
    sums = sums.unionByName(guests.where("ball").select("c", F.col("host_rows").alias("n"), F.col("first").alias("root")))
    return staged(found.unionByName(sums.where("n > 0")))


def _part(kind: int, salt: Column) -> Column:
    return F.pmod(F.xxhash64(salt), F.col(f"parts{kind}")).cast("int")


def _cosine(a: str, b: str) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(F.col(x).cast("array<double>"), F.col(y).cast("array<double>"), lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _half(least: float) -> float:
    """The cosine of half the limit's angle, and a little for rounding: what is that near to one vector is linked among itself."""
    return ((1 + max(least, -1.0)) / 2) ** 0.5 + 1e-9 if least < 1 else 2.0


def _balls(hosts: DataFrame, visits: DataFrame, hot: DataFrame, least: float) -> DataFrame:
    """(d, cell, pivot, first, ball_hosts, host_rows, ball_guests, guest_rows) of hot cells: the pivot is the vector with the least hash, its
    ball the hosts and guests within half the limit's angle."""
    key = (F.col("dim") == F.col("d")) & (F.col("home") == F.col("cell"))
    order = F.struct(F.xxhash64("c"), "c")
    pivots = staged(hosts.join(hot, key).groupBy("d", "cell").agg(F.min_by("v", order).alias("pivot"), F.min_by("c", order).alias("first")))
    near = lambda df, n, w: df.join(pivots, key).where(_cosine("v", "pivot") >= _half(least)).groupBy("d", "cell").agg(F.count("*").alias(n), F.sum("rows").alias(w))
    own, met = near(hosts, "ball_hosts", "host_rows"), near(visits, "ball_guests", "guest_rows")
    return staged(pivots.join(own, ["d", "cell"], "left").join(met, ["d", "cell"], "left"))


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST, recall: float = RECALL, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    rows = staged(df.select(F.col(id_col).alias("id"), F.when(_usable(F.col(vector_col)), F.col(vector_col)).alias("v")))
    some = rows.where("v IS NOT NULL AND id IS NOT NULL")
    classes = staged(some.groupBy("v").agg(F.count("*").alias("rows"), F.min("id").alias("first"))).withColumn("c", F.monotonically_increasing_id())
    classes = staged(classes)
    found = links(classes.select("c", "rows", "v"), least, recall, block_rows)
    number = found.groupBy(F.col("c").alias("linked")).agg(F.sum("n").alias("n"))
    tied = components(found.select(F.col("c").alias("a"), F.col("root").alias("b")))
    named = classes.join(tied, F.col("c") == F.col("node"), "left").select("c", "rows", "v", "first", F.coalesce("root", "c").alias("root"))
    named = staged(named.join(number, F.col("c") == F.col("linked"), "left").drop("linked"))
    least_id = staged(named.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("component")))
    known = staged(named.join(least_id, F.col("root") == F.col("r")).select(F.col("v").alias("w"), (F.coalesce("n", F.lit(0)) + F.col("rows") - 1).alias("n"), "component"))
    # Both sides are plain exchanges, so adaptive execution splits a vector that many rows have.
    met = rows.where("v IS NOT NULL AND id IS NOT NULL").join(known, F.col("v") == F.col("w")).select("id", "n", "component")
    alone = rows.where("v IS NULL OR id IS NULL").select("id", F.lit(0).cast("bigint").alias("n"), F.col("id").alias("component"))
    return met.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))


def near_vectors_sql(embeddings: str = "embeddings", least: float = LEAST) -> str:
    """DuckDB SQL for near_vectors() over vectors of one length and distinct ids, all pairs compared."""
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM {embeddings}
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= {least}),
reach AS (SELECT a AS x, b AS y FROM links UNION SELECT r.x, l.b FROM reach r JOIN links l ON r.y = l.a),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x), number AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(y, vec_id)) AS component_id, vec_id <= coalesce(y, vec_id) AS kept FROM {embeddings} LEFT JOIN number ON a = vec_id LEFT JOIN least ON x = vec_id"""
