"""Near duplicates: an exact n-gram Jaccard join with prefix filters under several token orders.

A text's set is its distinct shingles of ``words`` words, as 64-bit hashes; texts with equal sets are
one class. A pair of classes is linked when the sets' Jaccard similarity is at least SHARE.

1. Shingles are shuffled, packed, by leading bits, and counted. Where a shingle is in one class only, it can't
   be shared; a class keeps the others with their class counts. A class of which less than SHARE is
   shared can't be linked and goes; most texts go here. Shingles that a large share of the texts has are
   found as the texts are read first; they go to their classes with that count, and are never gathered.
   Likewise, of a class that makes up a large share of the rows, the row with the least id stands for all.
2. A linked pair shares a token of both prefixes under any one order of all tokens: the tokens but
   for those behind which too few are left. Under the first order, rarest first, prefix tokens
   become posting lists. A posting tells the largest partner that the tokens from there on still
   allow; a pair must be allowed both ways in the list of its first common token. Two more orders, by
   hash and the most frequent first, have longer prefixes, in which a linked pair shares a quarter of the
   tokens that it must share. What an order lets pass goes to the next one: the order by hash drops pairs
   with few common tokens, however rare, and the most frequent first those that have other templates
   around common passages. Only what all three let pass is verified.
3. In each list, every class is compared with the list's pivot, the class whose tokens are the most
   frequent: in a group of edited copies that is the text they come from. Links make components.
4. What is left are postings that allow a partner in another component of their list: those pairs
   are compared one by one. A pair inside a component needs no comparison, so results are exact and
   the work follows the number of classes rather than of pairs.

Lists of any length are joins, which Spark splits where they are skewed. A task that counts gets about
GROUP shingles, and for each shingle fewer classes than OFTEN of the texts.

Defined results: a text without words has no shingles, its own id as component, and no links; one
with fewer words has one shingle; a null text is empty; rows with the same id count as one node
when ids are compared; a row without an id has the least id of its component, or none; an empty table gives
no rows. A task holds all shingles of one text: a text of 100 MB needs some 3 GB. Only the id and text
columns are read, whatever others there are. Hashes of 64 bits stand for sets and shingles: at 10**9 distinct texts the
chance that any two sets are confused is about 3 in 100.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import arrow_rows, staged, text_of
from ledgerflow.llm.graph import components

WORDS = 5
#: The least similarity, as a fraction.
SHARE = (75, 100)
#: Shingles that a task gathers before it passes them on, and that a group of them holds on average.
PACK, GROUP = 2_000_000, 2_000_000
#: Rows of an Arrow batch: texts, or pairs with the tokens of both.
ROWS = 1000
#: A shingle is often met if that share of the texts that are read together has it, and at least MET of them; it is
#: hot if those make half that share of all. So at most 2 / OFTEN times a text's shingles are hot, on average.
OFTEN, MET = 1 / 32, 16
#: A class is hot from that share of the rows on: at most 1 / COPIES are.
COPIES = 1 / 1000
#: Postings of a list that one salt takes.
LIST = 1000
#: Salt of the order by hash.
SALT = 0x5851F42D4C957F2D
#: A linked pair shares that part of its common tokens in the prefixes of the orders behind the first: 1 in ASKED.
ASKED = 4

_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2**64."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        x = np.full(max(n, 1 << 17), base, dtype=np.uint64)
        x[0] = 1
        known = _POWERS[base] = np.cumprod(x)
    return known[:n]


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted distinct shingles of a text, ASCII letters in lower case."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    space = np.ones(len(data) + 2, dtype=bool)
    space[1:-1] = _SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    # A word's hash: its part of one running polynomial, moved to the front.
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), out=sums[1:])
    word = _mix((sums[ends] - sums[starts]) * _powers(pow(_BASE, -1, 1 << 64), len(data))[starts] + (ends - starts).astype(np.uint64))
    n = min(words, len(word))
    factor = _mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    out = np.full(len(word) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        out += word[k : len(word) - n + 1 + k] * factor[k]
    return np.unique(_mix(out))


def _key(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, n, key, text_hash, often): the size of each text's set, and its class; null for an empty set. Of the rows
    read together, the last has the shingles that they often have, with counts."""
    kind = pa.list_(pa.struct([("token", pa.int64()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x.as_py() or "", words) for x in batch.column(1)]
            key = [_key(x) if len(x) else None for x in sets]
            once = {k: x for k, x in zip(key, sets, strict=True) if k is not None}
            often = [None] * len(sets)
            if once:
                tokens, n = np.unique(np.concatenate(list(once.values())), return_counts=True)
                met = n >= max(MET, OFTEN * len(once))
                often[-1] = [{"token": t, "n": c} for t, c in zip(tokens[met].view(np.int64).tolist(), n[met].tolist(), strict=True)]
            columns = [batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(key, pa.int64()), batch.column(2), pa.array(often, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "key", "text_hash", "often"])

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), text_hash(text_col).alias("text_hash"))
    return rows.mapInArrow(run, "id bigint, n bigint, key bigint, text_hash bigint, often array<struct<token: bigint, n: bigint>>")


def hot(known: DataFrame) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
    """The hot shingles, sorted, with their counts, and the least id of each hot class. Both are bounded: see OFTEN, COPIES."""
    texts = known.where("key IS NOT NULL").count()
    met = known.where("often IS NOT NULL").select(F.explode("often").alias("o")).groupBy("o.token").agg(F.sum("o.n").alias("n"))
    found = sorted((r.token % (1 << 64), r.n) for r in met.where(F.col("n") >= OFTEN / 2 * texts).collect())
    copies = known.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    classes_ = {r.key: r.id for r in copies.where((F.col("n") >= COPIES * texts) & (F.col("n") > 1) & F.col("id").isNotNull()).collect()}
    return np.array([t for t, _ in found], dtype=np.uint64), np.array([n for _, n in found], dtype=np.int64), classes_


def text_hash(text_col: str = "text"):
    """What tells a row's text from others with its id."""
    return F.xxhash64(text_of(text_col))


_PACKED = "g bigint, keys binary, sizes binary, counts binary, tokens binary, dfs binary"
_NAMES = [x.split()[0] for x in _PACKED.split(", ")]


def _pack_rows(group: np.ndarray, doc: np.ndarray, tokens: np.ndarray, dfs: np.ndarray | None, keys: np.ndarray, sizes: np.ndarray) -> pa.Table:
    """Tokens, sorted by group and in it by doc, as one row a group."""
    kinds = [pa.int64()] + [pa.binary()] * 5
    if not len(tokens):
        return pa.Table.from_arrays([pa.array([], k) for k in kinds], names=_NAMES)
    firsts = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (group[1:] != group[:-1])]))
    lengths = np.diff(np.append(firsts, len(doc))).astype("<u4")
    group_at = group[firsts]
    bounds = np.append(np.flatnonzero(np.concatenate([[True], group_at[1:] != group_at[:-1]])), len(firsts))
    rows = []
    ends = np.append(firsts, len(doc))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        docs, part = doc[firsts[a:b]], slice(ends[a], ends[b])
        rows.append((int(group_at[a]), keys[docs].tobytes(), sizes[docs].astype("<u4").tobytes(), lengths[a:b].tobytes(), tokens[part].tobytes(), b"" if dfs is None else dfs[part].astype("<u4").tobytes()))
    return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_NAMES)


def _unpack(table: pa.Table) -> tuple[np.ndarray, ...]:
    """keys, sizes, counts, tokens, dfs of all rows of a group."""
    kinds = {"keys": "<i8", "sizes": "<u4", "counts": "<u4", "tokens": "<u8", "dfs": "<u4"}
    return tuple(np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=kind) for c, kind in kinds.items())


def _scatter(bits: int, groups: int, words: int, shared: Broadcast):
    """Texts to packed tokens by their leading bits; equal sets in a pack go once. Hot tokens go to their classes'
    groups, which have numbers below 0 here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, counts, copied = shared.value
        sets: dict[int, np.ndarray] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys, every = np.array(list(sets), dtype="<i8"), list(sets.values())
            sizes = np.array([len(x) for x in every])
            tokens, doc = np.concatenate(every), np.repeat(np.arange(len(every)), sizes)
            place = np.minimum(np.searchsorted(often, tokens), max(len(often) - 1, 0))
            is_hot = often[place] == tokens if len(often) else np.zeros(len(tokens), dtype=bool)
            group = (tokens >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(tokens), np.int64)
            group[is_hot] = -1 - keys[doc[is_hot]] % groups
            for which in (~is_hot, is_hot):
                at = np.flatnonzero(which)
                at = at[np.argsort(group[at], kind="stable")]
                yield from _pack_rows(group[at], doc[at], tokens[at], counts[place[at]] if which is is_hot else None, keys, sizes).to_batches()

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = shingles(text.as_py() or "", words)
                key = _key(found)
                if len(found) and key not in sets and copied.get(key, name) == name:
                    sets[key] = found
                    held += len(found)
                    if held >= PACK:
                        yield from flush()
                        sets, held = {}, 0
        if sets:
            yield from flush()

    return run


def _count(groups: int):
    """A group's tokens that several classes have, with the number of classes, packed by class."""

    def run(table: pa.Table) -> pa.Table:
        keys, sizes, counts, tokens, dfs = _unpack(table)
        keys, first, place = np.unique(keys, return_index=True, return_inverse=True)
        once = np.zeros(len(place), dtype=bool)
        once[first] = True
        kept = np.repeat(once, counts)
        tokens, doc, sizes = tokens[kept], np.repeat(place[once], counts[once]), sizes[first]
        if (g := table.column("g")[0].as_py()) < 0:  # hot ones, counted before
            order = np.argsort(doc, kind="stable")
            return _pack_rows(np.full(len(doc), -1 - g), doc[order], tokens[order], dfs[kept][order], keys, sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, doc = tokens[order], doc[order]
        starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        df = np.diff(np.append(starts, len(tokens)))
        df = np.repeat(df, df)
        shared = df >= 2
        tokens, doc, df = tokens[shared], doc[shared], df[shared]
        group = keys[doc] % groups
        order = np.lexsort((doc, group))
        return _pack_rows(group[order], doc[order], tokens[order], df[order], keys, sizes)

    return run


CORE = "key bigint, n bigint, tokens binary, prefix array<bigint>, most array<bigint>, frequent double, asked bigint, hashed array<int>, common array<int>"


def _need(n: np.ndarray) -> np.ndarray:
    """The size of the smallest partner."""
    return -(-SHARE[0] * n // SHARE[1])


def _classify(table: pa.Table) -> pa.Table:
    """Classes of which enough is shared: their shared tokens, postings, and prefixes under the other orders."""
    keys, sizes, counts, tokens, dfs = _unpack(table)
    keys, first, place = np.unique(keys, return_index=True, return_inverse=True)
    doc, n = np.repeat(place, counts), sizes[first].astype(np.int64)
    shared = np.bincount(doc, minlength=len(keys))
    kept = shared >= _need(n)
    chosen = np.flatnonzero(kept)
    tokens, dfs, doc = tokens[kept[doc]], dfs[kept[doc]].astype(np.int64), (np.cumsum(kept) - 1)[doc[kept[doc]]]
    keys, n, shared = keys[chosen], n[chosen], shared[chosen]
    # In every order tokens are sorted by class first, so places and ranks are the same in all.
    of = np.repeat(np.arange(len(keys)), shared)
    within = np.arange(len(tokens)) - np.repeat(np.cumsum(shared) - shared, shared)
    alone = n - shared  # tokens of no other class: the rarest, so first in every order
    both = SHARE[0] + SHARE[1]

    def split(values: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        return np.split(values, ends[:-1]) if len(ends) else []

    order = np.lexsort((tokens, dfs, doc))
    left = (n - alone)[of] - within
    most = both * left // SHARE[0] - n[of]
    use = most >= _need(n)[of]
    ends = np.cumsum(np.bincount(of[use], minlength=len(keys)))
    prefix = split(tokens[order][use].view(np.int64), ends)
    most = split(most[use], ends)
    # The first common tokens, as many as the smaller ``asked`` of a pair, lie in both prefixes: behind the last of them are
    # at most all but so many of the tokens that either one must share.
    asked = np.maximum(_need(n) // ASKED, 1)
    inside = alone[of] + within < (n - _need(n) + asked)[of]
    ends = np.cumsum(np.bincount(of[inside], minlength=len(keys)))
    hashed, common = (
        split((tokens[order][inside] >> np.uint64(32)).astype(np.uint32).view(np.int32), ends) for order in (np.lexsort((_mix(tokens ^ np.uint64(SALT)), doc)), np.lexsort((tokens, -dfs, doc)))
    )
    by_hash = tokens[np.lexsort((tokens, doc))]
    # Tokens of a class with the same leading half count as one in those prefixes.
    halves = by_hash >> np.uint64(32)
    asked -= np.bincount(of[1:][(halves[1:] == halves[:-1]) & (of[1:] == of[:-1])], minlength=len(keys))
    frequent = np.bincount(doc, weights=np.log(dfs), minlength=len(keys)) / np.maximum(n, 1)
    columns = [
        pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array([x.tobytes() for x in split(by_hash, np.cumsum(shared))], pa.binary()),
        pa.array(prefix, pa.list_(pa.int64())), pa.array(most, pa.list_(pa.int64())), pa.array(frequent, pa.float64()),
        pa.array(asked, pa.int64()), pa.array(hashed, pa.list_(pa.int32())), pa.array(common, pa.list_(pa.int32())),
    ]
    return pa.Table.from_arrays(columns, names=[x.split()[0] for x in CORE.split(", ")])


def candidates_core(df: DataFrame, known: DataFrame, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    """The classes that may be linked; see CORE. ``known``: classes() of ``df``."""
    total = known.agg(F.sum("n")).first()[0] or 0
    bits = max(0, (max(total, 1) // GROUP).bit_length())
    groups = max(1, (1 << bits) // 4)
    shared = df.sparkSession.sparkContext.broadcast(hot(known))
    packed = df.select(F.col(id_col).cast("bigint"), text_col).mapInArrow(_scatter(bits, groups, words, shared), _PACKED)
    counted = packed.groupBy("g").applyInArrow(_count(groups), _PACKED)
    return counted.groupBy("g").applyInArrow(_classify, CORE)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = []
        for na, nb, x, y in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "ta", "tb")), strict=True):
            same = len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True))
            linked.append(SHARE[1] * same >= SHARE[0] * (na + nb - same))
        chosen = pa.array(linked, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(chosen), batch.column("b").filter(chosen)], names=["a", "b"])


def agreed(pairs: DataFrame, core: DataFrame, orders: tuple[str, ...] = ("hashed", "common")) -> DataFrame:
    """The pairs (a, b) that share as much in their prefixes under each of the orders behind the first as linked ones do."""
    side = F.struct("asked", *orders)
    met = pairs.select("a", "b").join(core.select(F.col("key").alias("a"), side.alias("x")), "a").join(core.select(F.col("key").alias("b"), side.alias("y")), "b")
    for order in orders:
        met = met.where(F.size(F.array_intersect(f"x.{order}", f"y.{order}")) >= F.least("x.asked", "y.asked"))
    return met.select("a", "b")


def links(pairs: DataFrame, core: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    one = core.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    two = core.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    return staged(agreed(pairs, core).join(one, "a").join(two, "b").select("a", "b", "na", "nb", "ta", "tb").mapInArrow(_verify, "a bigint, b bigint"))


def _allowed(x: str, y: str):
    """Two postings of one token whose classes may be linked."""
    return F.expr(f"{y}.n <= {x}.most AND {x}.n <= {y}.most")


def _meetings(listed: DataFrame, among: str = "true") -> DataFrame:
    """(a, b), a < b: the classes with postings x in one list t that may be linked. Long lists are salted on one side."""
    lengths = listed.groupBy("t").agg(F.count("*").alias("length")).where("length > 1").select("t", F.ceil(F.col("length") / LIST).alias("salts"))
    salted = staged(listed.join(lengths, "t"))
    one = salted.select("t", "x", F.pmod(F.xxhash64("x.key"), "salts").alias("salt"))
    two = salted.select(F.col("t").alias("t2"), F.col("x").alias("y"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt2"))
    met = one.join(two, (F.col("t") == F.col("t2")) & (F.col("salt") == F.col("salt2")) & F.expr(f"x.key < y.key AND ({among})") & _allowed("x", "y"))
    return met.select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct()


def linked_components(core: DataFrame) -> DataFrame:
    """(node, root): the classes with links to other classes, by class key."""
    postings = core.select("key", "n", "frequent", F.explode(F.arrays_zip("prefix", "most")).alias("p"))
    postings = postings.select(F.col("p.prefix").alias("t"), "key", "n", F.col("p.most").alias("most"), "frequent")
    posting = F.struct("key", "n", "most")
    # Every list's pivot.
    pivots = staged(postings.groupBy("t").agg(F.max_by(posting, F.struct("frequent", "key")).alias("y"), F.count("*").alias("length")).where("length > 1").select("t", "y"))
    met = postings.select("t", posting.alias("x")).join(pivots, "t").where(F.expr("x.key <> y.key") & _allowed("x", "y"))
    pair = [F.expr("least(x.key, y.key)").alias("a"), F.expr("greatest(x.key, y.key)").alias("b")]
    tried = staged(met.select(*pair).distinct())
    found = links(tried, core)
    roots = staged(components(found))
    # Postings that still allow a partner in another component of their list.
    rooted = postings.join(roots, F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "key")).drop("node")
    sides = staged(rooted.groupBy("t", "root").agg(F.min("n").alias("least"), F.max("most").alias("largest")))
    best = sides.groupBy("t").agg(F.min(F.struct("least", "root")).alias("small"), F.max(F.struct("largest", "root")).alias("large"), F.count("*").alias("roots")).where("roots > 1")
    best = staged(best.drop("roots"))
    second = sides.join(best, "t").groupBy("t").agg(
        F.first("small").alias("small"), F.first("large").alias("large"),
        F.min(F.when(F.col("root") != F.col("small.root"), F.col("least"))).alias("small2"), F.max(F.when(F.col("root") != F.col("large.root"), F.col("largest"))).alias("large2"),
    )
    second = staged(second)
    active = rooted.join(second, "t").where(
        (F.when(F.col("root") == F.col("small.root"), F.col("small2")).otherwise(F.col("small.least")) <= F.col("most"))
        & (F.col("n") <= F.when(F.col("root") == F.col("large.root"), F.col("large2")).otherwise(F.col("large.largest")))
    )
    active = staged(active.select("t", F.struct("key", "n", "most", "root").alias("x")))
    rest = _meetings(active, "x.root <> y.root").join(tried, ["a", "b"], "left_anti")
    more = links(rest, core)
    return roots if more.isEmpty() else staged(components(found.union(more)))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id_col, n_shingles, component_id): a row a row of ``df``; the component is the least id reachable by links."""
    known, component = _components_of(df, id_col, text_col, words)
    # A class may hold any share of the rows: that join is split where it is skewed.
    out = known.join(component, F.col("key") == F.col("k"), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def _components_of(df: DataFrame, id_col: str, text_col: str, words: int) -> tuple[DataFrame, DataFrame]:
    """classes() of ``df``, and (k, component, root) for each class."""
    with arrow_rows(df.sparkSession, ROWS):
        known = staged(classes(df, id_col, text_col, words))
        core = staged(candidates_core(df, known, id_col, text_col, words))
        roots = linked_components(core)
        copies = known.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("least"))
        named = copies.join(roots, F.col("key") == F.col("node"), "left").select("key", "least", F.coalesce("root", "key").alias("root"))
        named = staged(named)
        reached = staged(named.groupBy("root").agg(F.min("least").alias("component")))
        return known, staged(named.join(reached, "root").select(F.col("key").alias("k"), "component", "root"))


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id_col, text_hash, group): a row a row of ``df``; texts of a group reach one another by links, whatever their
    ids. The group of a text without words is null."""
    known, component = _components_of(df, id_col, text_col, words)
    out = known.join(component, F.col("key") == F.col("k"), "left")
    return out.select(F.col("id").alias(id_col), "text_hash", F.col("root").alias("group"))


def candidates(core: DataFrame) -> DataFrame:
    """(a, b), a < b: the pairs of classes that the first order lets pass."""
    postings = core.select("key", "n", F.explode(F.arrays_zip("prefix", "most")).alias("p"))
    return _meetings(postings.select(F.col("p.prefix").alias("t"), F.struct("key", "n", F.col("p.most").alias("most")).alias("x")))


def linked_pairs(core: DataFrame) -> DataFrame:
    """(a, b), a < b: every link between classes, those inside a component too. Unlike linked_components(),
    the work follows the number of pairs, as the result does."""
    return links(candidates(core), core)


def near_links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(links, members): links (a, b) between classes, and members (id_col, key), a row a row of ``df``, the key
    null for a text without words. Documents of one class are copies, and linked by that."""
    with arrow_rows(df.sparkSession, ROWS):
        known = staged(classes(df, id_col, text_col, words))
        core = staged(candidates_core(df, known, id_col, text_col, words))
        return linked_pairs(core), known.select(F.col("id").alias(id_col), "key")


def link_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id_col, n_links): a row a row of ``df``, with the number of other documents that it is linked to: its
    copies, and all members of the classes linked to its own. Rows with the same id and set count as one."""
    pairs, members = near_links(df, id_col, text_col, words)
    # Rows without an id are each a document.
    size = F.count_distinct(F.col(id_col)) + F.count_if(F.col(id_col).isNull())
    sizes = staged(members.where("key IS NOT NULL").groupBy("key").agg(size.alias("size")))
    ways = pairs.union(pairs.select("b", "a"))
    other = ways.join(sizes, F.col("b") == F.col("key")).groupBy("a").agg(F.sum("size").alias("others"))
    counts = sizes.join(other, F.col("key") == F.col("a"), "left").select(F.col("key").alias("k"), (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("found"))
    out = members.join(staged(counts), F.col("key") == F.col("k"), "left")
    return out.select(id_col, F.coalesce("found", F.lit(0)).cast("bigint").alias("n_links"))


_LINKS_SQL = """
WITH RECURSIVE texts AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words
    FROM documents
),
places AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM texts WHERE len(words) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle FROM places),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m
    FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
    GROUP BY x.doc_id, y.doc_id
),
links AS (
    SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
    WHERE 100 * m >= 75 * (x.n + y.n - m)
)"""


def near_duplicates_sql() -> str:
    """near_duplicates() of documents, each with an id of its own, by comparing all that share a shingle."""
    return f"""{_LINKS_SQL},
reached AS (
    SELECT doc_id, doc_id AS other FROM documents
    UNION SELECT reached.doc_id, links.b FROM reached JOIN links ON reached.other = links.a
)
SELECT doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(other) AS component_id
FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id"""


def link_counts_sql() -> str:
    """link_counts() of documents, each with an id of its own."""
    return f"""{_LINKS_SQL}
SELECT doc_id, CAST(count(b) AS BIGINT) AS n_links FROM documents LEFT JOIN links ON doc_id = a GROUP BY doc_id"""
