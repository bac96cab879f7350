"""A Merkle manifest of a dataset: a tree for each group of rows, one tree over the groups' roots, and a proof for each row.

A leaf is the SHA-256 of a row's columns, each ``-`` if null, else its UTF-8 length, ``:`` and its text. While a tree has
several nodes, every two consecutive ones become the hash of their digests' lowercase hex text; the last run may be one
node, which is hashed alone. The groups' roots, in order of the group (null first), are the leaves of the last tree.

1. Leaves are hashed by Spark's own functions, written, and ranked within their group by ranges (``common.ranked``).
2. A tree is cut into aligned blocks of 2**HEIGHT nodes. Each block gives its top; the tops are the nodes of the next level
   of blocks, until each tree has one node: a job for each HEIGHT levels. No task sees more of a tree than a block.
3. Proofs come downwards. Each block meets the one proof of its own top and goes through its nodes by fractal traversal:
   of every ``STEP`` levels there is one existing subtree, which holds the current leaf's siblings, and one desired
   subtree, which the next leaves will need and which grows by two hashes a leaf, so that it is whole when the existing
   one is used up. A row's proof is the path in its block and then the proof of the block's top. So the traversal keeps
   2 * HEIGHT / STEP small subtrees, and the proofs themselves are never shuffled or written, but for those of tops.

Defined results: nulls may be in any column. Rows ascend by key, null first, then by leaf; rows alike in all of these are
interchangeable and each is a leaf. Empty texts are hashed as such (``0:``). A text is hashed whole by one task, in some
three times its size. A group of one row is its leaf, a dataset of one group that group's root; an empty one has no
rows and no root. Only the named columns are read, whatever others there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm.common import ranked, staged

#: Levels of a block, and of a stacked subtree.
HEIGHT, STEP = 12, 3
PATH = "array<struct<left: boolean, digest: string>>"
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

Node = bytes | None


def _written(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*values: Column) -> Column:
    """The digest of a row's values."""
    return F.sha2(F.concat(*map(_written, values)).cast("binary"), 256)


def combine(left: Node, right: Node) -> Node:
    """The node over one or two others, as hex text; None over none."""
    if left is None:
        return None
    return sha256(left if right is None else left + right).hexdigest().encode()


class Subtree:
    """Nodes of the levels from ``low`` up to below ``top``, of the ``index``-th subtree with that top, filled by treehash."""

    def __init__(self, low: int, top: int, index: int):
        self.low, self.top = low, top
        self.next, self.end = index << top, (index + 1) << top
        self.stack: list[tuple[int, int, Node]] = []
        self.nodes: dict[tuple[int, int], Node] = {}

    def grow(self, leaf: Callable[[int], Node]) -> bool:
        """One hash: two nodes of a level joined, or else the next leaf. False if there is nothing left to do."""
        stack = self.stack
        if len(stack) > 1 and stack[-1][0] == stack[-2][0]:
            (level, _, right), (_, at, left) = stack.pop(), stack.pop()
            node = (level + 1, at >> 1, combine(left, right))
        elif self.next < self.end:
            node = (0, self.next, leaf(self.next))
            self.next += 1
        else:
            return False
        stack.append(node)
        if self.low <= node[0] < self.top:
            self.nodes[node[:2]] = node[2]
        return True


def authentication_paths(count: int, height: int, leaf: Callable[[int], Node], step: int = STEP) -> Iterator[list[tuple[bool, Node]]]:
    """For each of the first ``count`` leaves in turn, its siblings bottom up (None where a node is hashed alone), and
    whether they stand left. ``leaf`` gives None from ``count`` on."""
    floors = [(low, min(low + step, height)) for low in range(0, height, step)]
    existing = []
    for low, top in floors:
        first = Subtree(low, top, 0)
        while first.grow(leaf):
            pass
        existing.append(first.nodes)
    below = floors[:-1]  # the highest subtree is the only one of its levels
    desired = [Subtree(low, top, 1) for low, top in below]
    for at in range(count):
        path = []
        for (low, top), nodes in zip(floors, existing, strict=True):
            for level in range(low, top):
                beside = (at >> level) ^ 1
                path.append((not beside & 1, nodes[level, beside]))
        yield path
        for k, (low, top) in enumerate(below):
            if not (at + 1) & ((1 << top) - 1):
                while desired[k].grow(leaf):
                    pass
                existing[k] = desired[k].nodes
                desired[k] = Subtree(low, top, ((at + 1) >> top) + 1)
            if desired[k].end <= 1 << height:
                desired[k].grow(leaf)
                desired[k].grow(leaf)


def _in_order(block: pa.Table, most: int) -> tuple[pa.Table, int, Callable[[int], Node]]:
    block = block.take(pa.array(np.argsort(block["pos"].to_numpy(), kind="stable")))
    digests = [x.encode() for x in block["digest"].to_pylist()]
    height = min((block["n"][0].as_py() - 1).bit_length(), most)  # of a tree that is one block, its own
    return block, height, lambda i: digests[i] if i < len(digests) else None


def _tops(most: int):
    """The node over a block, as a node of the next level."""

    def run(block: pa.Table) -> pa.Table:
        block, height, leaf = _in_order(block, most)
        tree = Subtree(0, height, 0)
        while tree.grow(leaf):
            pass
        n = (block["n"][0].as_py() + (1 << most) - 1) >> most
        return pa.table({"tree": block["tree"][:1], "pos": block["block"][:1], "n": pa.array([n]), "digest": pa.array([tree.stack[0][2].decode()])})

    return run


def _paths(keep: list[str], most: int):
    """The proofs of a block's nodes, given that of its top."""

    def run(block: pa.Table, above: pa.Table) -> pa.Table:
        block, height, leaf = _in_order(block, most)
        over = above["path"][0].as_py()
        left, digest, ends = [], [], [0]
        over_left, over_digest = [x["left"] for x in over], [x["digest"] for x in over]
        for path in authentication_paths(len(block), height, leaf):
            for side, node in path:
                left.append(side)
                digest.append(node and node.decode())
            left += over_left
            digest += over_digest
            ends.append(len(left))
        steps = pa.StructArray.from_arrays([pa.array(left, pa.bool_()), pa.array(digest, pa.string())], names=["left", "digest"])
        found = {c: block[c] for c in ["tree", "pos", "digest", *keep]}
        root = pa.array([above["subroot"][0].as_py()] * len(block), pa.string())
        return pa.table(found | {"path": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), steps), "subroot": root})

    return run


def _climb(nodes: DataFrame, height: int) -> tuple[list[DataFrame], DataFrame]:
    """Nodes of each level of blocks, and the tops of the trees; ``slot`` is what blocks are dealt out by."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    levels = []
    while True:
        # Dealt out once for both walks, up and down.
        blocks = nodes.withColumn("block", F.shiftright("pos", height)).withColumn("slot", F.xxhash64("tree", "block"))
        blocks = staged(blocks.repartition(parts, "slot"), bucket_by="slot")
        levels.append(blocks)
        nodes = staged(blocks.groupBy("slot", "tree", "block").applyInArrow(_tops(height), "tree string, pos bigint, n bigint, digest string"))
        if (nodes.agg(F.max("n")).first()[0] or 1) == 1:
            return levels, nodes


def _descend(levels: list[DataFrame], above: DataFrame, keep: dict[str, str], height: int) -> DataFrame:
    """The proofs of the lowest level's nodes; ``above`` (tree, pos, path, subroot) has those of the tops."""
    for k in range(len(levels) - 1, -1, -1):
        kept = keep if k == 0 else {}
        schema = ", ".join(["tree string", "pos bigint", "digest string", *(f"{c} {t}" for c, t in kept.items()), f"path {PATH}", "subroot string"])
        over = above.select("tree", F.col("pos").alias("block"), F.xxhash64("tree", "pos").alias("slot"), "path", "subroot")
        keys = ["slot", "tree", "block"]
        above = levels[k].groupBy(*keys).cogroup(over.groupBy(*keys)).applyInArrow(_paths(list(kept), height), schema)
        if k:
            above = staged(above)
    return above


def _no_path() -> Column:
    return F.array().cast(PATH).alias("path")


def manifest(leaves: DataFrame, keep: dict[str, str], height: int = HEIGHT) -> tuple[DataFrame, str | None]:
    """Proofs and the root. ``leaves`` is a staged frame (tree, key, digest and the columns of ``keep``, by name and type); proofs are
    (tree, pos, digest, the columns of ``keep``, path, subroot), one a leaf."""
    spark: SparkSession = leaves.sparkSession
    levels, tops = _climb(ranked(leaves, "tree", F.col("key").asc_nulls_first(), F.col("digest").asc()), height)
    groups = staged(tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"))
    above_levels, top = _climb(ranked(groups, "tree", F.col("name").asc()), height)
    root = top.first()
    if root is None:
        return spark.createDataFrame([], ", ".join(["tree string", "pos bigint", "digest string", *(f"{c} {t}" for c, t in keep.items()), f"path {PATH}", "subroot string"])), None
    over = _descend(above_levels, top.select("tree", "pos", _no_path(), F.lit(None).cast("string").alias("subroot")), {"name": "string"}, height)
    over = staged(over.select(F.col("name").alias("tree"), F.lit(0).cast("bigint").alias("pos"), "path", F.col("digest").alias("subroot")))
    return _descend(levels, over, keep, height), root.digest


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a proof come to."""

    def up(node: Column, step: Column) -> Column:
        pair = F.when(step["left"], F.concat(step["digest"], node)).otherwise(F.concat(node, step["digest"]))
        return F.when(step["digest"].isNull(), F.sha2(node.cast("binary"), 256)).otherwise(F.sha2(pair.cast("binary"), 256))

    return F.aggregate(path, leaf, up)


def proofs(df: DataFrame, key: str = "doc_id", group: str = "lang", columns: tuple[str, ...] = COLUMNS, tampered: tuple[str, Column] | None = None, height: int = HEIGHT) -> tuple[DataFrame, str | None]:
    """(key, group, leaf, path, subroot) of each row, and the root; with ``tampered``, a column and its changed value, also
    ``changed``: the leaf that rows have whose value differs."""
    same = leaf_of(*(F.col(c) for c in columns))
    other = F.lit(None).cast("string")
    if tampered is not None:
        name, value = tampered
        new = leaf_of(*(value if c == name else F.col(c) for c in columns))
        other = F.when(~value.eqNullSafe(F.col(name)), new)
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))  # null sorts before all others
    leaves = staged(df.select(tree.alias("tree"), F.col(key).alias("key"), same.alias("digest"), other.alias("changed")))
    kind = dict(leaves.dtypes)["key"]
    found, root = manifest(leaves, {"key": kind, "changed": "string"}, height)
    named = F.when(F.col("tree") != "-", F.substring("tree", 2, 1 << 30)).cast(dict(df.dtypes)[group])
    return found.select(F.col("key").alias(key), named.alias(group), F.col("digest").alias("leaf"), "path", "subroot", "changed"), root


def digest(df: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Each row's leaf, roots and digest of its proof, and whether the root follows from the row as it is, where some have been tampered with."""
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found, root = proofs(df, tampered=("n_chars", F.when(struck, F.col("n_chars") + 1).otherwise(F.col("n_chars"))), height=height)
    siblings = F.concat_ws("", F.transform("path", lambda x: x["digest"]))
    rows = found.select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), folded(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def digest_sql(documents: str = "documents", levels: int = 40) -> str:
    """DuckDB SQL for digest(): whole levels of nodes one after the other, and each leaf's siblings by their places."""
    part = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR) END"
    leaf = lambda n: "sha256(" + " || ".join(part(x) for x in ("doc_id", "source", "lang", n, "text")) + ")"
    # One step of CRC-32 for each byte and, as -1, for each of its bits.
    bits = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"xor(list_reduce(list_prepend(4294967295, CAST({bits} AS BIGINT[])), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295)"
    group = lambda rows: f"SELECT {rows} tree, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 2, n"
    return f"""
WITH RECURSIVE leaves AS (SELECT doc_id, lang, {leaf("n_chars")} AS leaf, CASE WHEN doc_id IS NOT NULL AND n_chars IS NOT NULL AND {crc} % 7 = 0 THEN {leaf("(n_chars + 1)")} END AS changed FROM {documents}),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n, coalesce('=' || lang, '-') AS tree FROM leaves),
nodes(tree, level, pos, n, node) AS (SELECT tree, 0, pos, n, leaf FROM placed UNION ALL {group("")}),
roots AS (SELECT tree, node AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
high(tree, level, pos, n, node) AS (SELECT '', 0, pos, n, subroot FROM roots UNION ALL {group("").replace("FROM nodes", "FROM high")}),
every AS (SELECT tree, level, pos, n, node FROM nodes UNION ALL SELECT '', level, pos, n, node FROM high),
steps AS (SELECT p.tree, p.pos, e.level AS step, CASE WHEN s.node IS NULL THEN '-' WHEN s.pos % 2 = 0 THEN 'l' || s.node ELSE 'r' || s.node END AS s
  FROM placed p JOIN every e ON e.tree = p.tree AND e.n > 1 AND e.pos = p.pos >> e.level LEFT JOIN every s ON s.tree = e.tree AND s.level = e.level AND s.pos = xor(e.pos, 1)),
over AS (SELECT r.tree, {levels} + e.level AS step, CASE WHEN s.node IS NULL THEN '-' WHEN s.pos % 2 = 0 THEN 'l' || s.node ELSE 'r' || s.node END AS s
  FROM roots r JOIN every e ON e.tree = '' AND e.n > 1 AND e.pos = r.pos >> e.level LEFT JOIN every s ON s.tree = '' AND s.level = e.level AND s.pos = xor(e.pos, 1)),
path AS (SELECT tree, pos, list(s ORDER BY step) AS path FROM (SELECT * FROM steps UNION ALL SELECT p.tree, p.pos, o.step, o.s FROM placed p JOIN over o USING (tree)) GROUP BY tree, pos),
found AS (SELECT p.doc_id, p.leaf, r.subroot, (SELECT node FROM high WHERE n = 1) AS root, coalesce(x.path, CAST([] AS VARCHAR[])) AS path, coalesce(changed, leaf) AS start
  FROM placed p JOIN roots r ON p.tree = r.tree LEFT JOIN path x ON x.tree = p.tree AND x.pos = p.pos),
up AS (SELECT *, list_reduce(list_prepend(start, path), lambda a, s: CASE WHEN s = '-' THEN sha256(a) WHEN s[1] = 'l' THEN sha256(s[2:] || a) ELSE sha256(a || s[2:]) END) AS folded_root FROM found)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(list_filter(path, lambda s: s <> '-'), lambda s: s[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM up"""
