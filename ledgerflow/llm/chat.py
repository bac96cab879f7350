r"""Chat formatting into prefix trees.

A turn is written ``### role: text</turn>`` and a line feed. In roles and texts a backslash is put
before every backslash and every control string (and before colons of roles), so that reading a
backslash with the character behind it as that character gives back the original.

Conversations with the same turns are formatted once. Those that share turns are merged into a tree
whose nodes are turns; a node is known by the hash of all turns up to it, so trees are counted and
cut by joins and sums over nodes, wherever their conversations lie. A tree is written in rows:

* a node that more than ``TREE`` different conversations pass is a row of its own;
* what hangs below it are subtrees of at most that many, dealt by their first node to rows of about
  that many conversations; a tree of no such node is one row.

In a row each node is written once, depth first. It has the place of its characters in the row's
text, the position id of its first character (how many characters its ancestors have), and its
ancestors' intervals in the row, neighbours merged. ``above`` has the rows of the nodes further up,
which are attended to whole. So a shared turn is written once over all rows, and no row or task
grows with the number of conversations. The loss interval of an assistant's turn is its text; that of
another turn is empty.

Defined results: rows go by turn, then role, then text; a null role or text is read as empty; a null
conv_id is a conversation; a conversation has a tree of its own if it shares nothing; repeated rows
are repeated turns; an empty table gives no trees. Offsets count code points. One conversation is one
task's work, as its digest is: very long turns and some hundred thousand turns are fine. Only conv_id,
turn, role and text are read, whatever other columns there are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import arrow_rows, staged

HEAD, END = "### ", "</turn>"
#: Conversations of a row, about.
TREE = 64
LOSS_ROLE = "assistant"
#: Rows of an Arrow batch.
ROWS = 500

TREES = (
    "tree string, above array<string>, text string, "
    "nodes array<struct<parent: int, start: int, end: int, position: bigint, loss_start: int, loss_end: int, ancestors: array<struct<start: int, end: int>>>>, "
    "leaves array<struct<content: string, node: int>>"
)

_CONTROL = re.compile(r"\\|###|</turn>")
_ROLE_CONTROL = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_PART = re.compile(r"(?:[^\\<:]|\\.|<(?!/turn>))*+", re.DOTALL)
_BODY = re.compile(r"(?:[^\\<]|\\.|<(?!/turn>))*+", re.DOTALL)


def escape(text: str, control: re.Pattern = _CONTROL) -> str:
    return control.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def write_turn(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its text begins and ends."""
    head, body = f"{HEAD}{escape(role, _ROLE_CONTROL)}: ", escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        role = _PART.match(formatted, at + len(HEAD))
        body = _BODY.match(formatted, role.end() + 2)
        if not formatted.startswith(HEAD, at) or not formatted.startswith(END + "\n", body.end()):
            raise ValueError("not a formatted conversation")
        out.append((unescape(role[0]), unescape(body[0])))
        at = body.end() + len(END) + 1
    return out


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths, ends = [], []
        for turns in batch.column(1):
            known, at, path, end = b"", 0, [], []
            roles, texts = (turns.values.field(k).to_pylist() for k in ("role", "text"))
            for role, text in zip(roles, texts, strict=True):
                name, body = role.encode(), text.encode()
                known = hashlib.blake2b(known + len(name).to_bytes(8, "big") + name + body, digest_size=16).digest()
                at += len(write_turn(role, text)[0])
                path.append(known.hex())
                end.append(at)
            paths.append(path)
            ends.append(end)
        columns = [batch.column(0), pa.array([x[-1] for x in paths], pa.string()), pa.array(paths, pa.list_(pa.string())), pa.array(ends, pa.list_(pa.int64())), batch.column(1)]
        yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "content", "path", "ends", "turns"])


def conversations(df: DataFrame) -> DataFrame:
    """(conv_id, content, path, ends, turns): each conversation's turns in order, the nodes they pass, of which the
    last stands for the whole, and how many characters are written up to each."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = F.transform(F.sort_array(F.collect_list(turn)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    kind = df.schema["conv_id"].dataType.simpleString()
    gathered = df.groupBy("conv_id").agg(turns.alias("turns"))
    return gathered.mapInArrow(_walk, f"conv_id {kind}, content string, path array<string>, ends array<bigint>, turns array<struct<role: string, text: string>>")


def _grow(table: pa.Table) -> pa.Table:
    """A row's conversations, from the first node of the row on, to its text and nodes."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("name", "content", "path", "turns", "above", "base")), strict=True), key=lambda x: (x[2], x[1] or ""))
    children: dict[str, dict[str, dict]] = {"": {}}
    leaves: dict[str, str] = {}
    for _, content, path, turns, _, _ in rows:
        up = ""
        for node, turn in zip(path, turns, strict=True):
            children[up].setdefault(node, turn)
            children.setdefault(node, {})
            up = node
        if content is not None:
            leaves[up] = content
    text, nodes, ends, at = [], [], [], 0
    todo = [(node, turn, -1) for node, turn in reversed(children[""].items())]
    while todo:
        node, turn, parent = todo.pop()
        written, begin, end = write_turn(turn["role"], turn["text"])
        above = nodes[parent] if parent >= 0 else None
        spans = list(above["ancestors"]) if above else []
        if above and spans and spans[-1]["end"] == above["start"]:
            spans[-1] = {"start": spans[-1]["start"], "end": above["end"]}
        elif above:
            spans.append({"start": above["start"], "end": above["end"]})
        nodes.append(
            {
                "parent": parent, "start": at, "end": at + len(written),
                "position": above["position"] + above["end"] - above["start"] if above else rows[0][5],
                "loss_start": at + (begin if turn["role"] == LOSS_ROLE else end), "loss_end": at + end,
                "ancestors": spans,
            }
        )
        if node in leaves:
            ends.append({"content": leaves[node], "node": len(nodes) - 1})
        text.append(written)
        at += len(written)
        todo += [(child, its, len(nodes) - 1) for child, its in reversed(children[node].items())]
    name = rows[0][0] or hashlib.sha256("".join(sorted(leaves.values())).encode()).hexdigest()
    kinds = [pa.string(), pa.list_(pa.string()), pa.string(), _NODES, _LEAVES]
    return pa.table([pa.array([x], k) for x, k in zip((name, rows[0][4], "".join(text), nodes, ends), kinds, strict=True)], names=["tree", "above", "text", "nodes", "leaves"])


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_NODES = pa.list_(pa.struct([("parent", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("position", pa.int64()), ("loss_start", pa.int32()), ("loss_end", pa.int32()), ("ancestors", pa.list_(_SPAN))]))
_LEAVES = pa.list_(pa.struct([("content", pa.string()), ("node", pa.int32())]))


def build_trees(convs: DataFrame, tree: int = TREE) -> DataFrame:
    """Trees of the distinct contents of ``convs``; see TREES. Joins on nodes, which may be hot, are split where skewed."""
    distinct = staged(convs.select("content", "path", "ends", "turns").dropDuplicates(["content"]))
    passed = distinct.select("content", F.posexplode("path").alias("d", "node"))
    large = staged(passed.groupBy("node").agg(F.count("*").alias("n"), F.min(F.struct("content", "d")).alias("some")).where(F.col("n") > tree))
    # How deep the nodes of their own row go, and how many rows what hangs below the last one is dealt to.
    deep = passed.join(large.select("node", "n"), "node").groupBy("content").agg((F.max("d") + 1).alias("depth"), F.min("n").alias("n"))
    placed = distinct.join(deep.withColumnRenamed("content", "c"), F.col("content") == F.col("c"), "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    rest = "slice({0}, depth + 1, size({0}) - depth)".format
    hanging = placed.where("depth < size(path)").select(
        F.expr("CASE WHEN depth = 0 THEN path[0] ELSE path[depth - 1] END").alias("key"),
        F.expr(f"CASE WHEN depth = 0 THEN -1 ELSE pmod(xxhash64(path[depth]), ceil(n / {tree})) END").alias("part"),
        F.lit(None).cast("string").alias("name"), "content", F.expr(rest("path")).alias("path"), F.expr(rest("turns")).alias("turns"),
        F.expr("slice(path, 1, depth)").alias("above"), F.expr("CASE WHEN depth = 0 THEN 0L ELSE ends[depth - 1] END").alias("base"),
    )
    ended = placed.where("depth = size(path)").select(F.col("content").alias("ended"))
    shown = large.select("node", "some.*").join(distinct, "content").drop("content").join(ended, F.col("node") == F.col("ended"), "left")
    own = shown.select(
        F.col("node").alias("key"), F.lit(-2).cast("bigint").alias("part"), F.col("node").alias("name"), F.col("ended").alias("content"), F.array("node").alias("path"),
        F.expr("slice(turns, d + 1, 1)").alias("turns"), F.expr("slice(path, 1, d)").alias("above"), F.expr("CASE WHEN d = 0 THEN 0L ELSE ends[d - 1] END").alias("base"),
    )
    return hanging.unionByName(own).groupBy("key", "part").applyInArrow(_grow, TREES)


FACTS = "content string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    for batch in batches:
        rows = []
        for text, nodes, leaves, above in zip(*(batch.column(c).to_pylist() for c in ("text", "nodes", "leaves", "read")), strict=True):
            head = "".join(x["text"] for x in above or ())
            lost = "".join(unescape(x["text"][x["loss_start"] : x["loss_end"]]) for x in above or ())
            for leaf in leaves:
                # What the last turn attends to, in order, then that turn.
                node = nodes[leaf["node"]]
                spans = [*((a["start"], a["end"]) for a in node["ancestors"]), (node["start"], node["end"])]
                formatted = head + "".join(text[a:b] for a, b in spans)
                path, at = [], leaf["node"]
                while at >= 0:
                    path.append(at)
                    at = nodes[at]["parent"]
                loss = lost + "".join(unescape(text[n["loss_start"] : n["loss_end"]]) for n in (nodes[i] for i in reversed(path)))
                turns = read_turns(formatted)
                digest = hashlib.sha256("".join(f"{role}\n{body}\n" for role, body in turns).encode()).hexdigest()
                rows.append((leaf["content"], len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
        columns = zip(*rows, strict=True) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in FACTS.split(", ")])


def read_back(trees: DataFrame) -> DataFrame:
    """Each content's facts, read from its row and the rows above it; see FACTS."""
    up = trees.where("size(above) > 0").select(F.col("tree").alias("below"), F.posexplode("above").alias("i", "up"))
    one = F.struct("i", "text", F.expr("nodes[0].loss_start").alias("loss_start"), F.expr("nodes[0].loss_end").alias("loss_end"))
    read = up.join(trees.select("tree", "text", "nodes"), F.col("up") == F.col("tree")).groupBy("below").agg(F.sort_array(F.collect_list(one)).alias("read"))
    columns = ["text", "nodes", "leaves", "read"]
    whole = trees.where("size(above) = 0").withColumn("read", F.lit(None).cast(read.schema["read"].dataType))
    hung = trees.where("size(above) > 0").join(read, F.col("tree") == F.col("below"))
    return whole.select(*columns).unionByName(hung.select(*columns)).mapInArrow(_read, FACTS)


def digest(df: DataFrame, tree: int = TREE) -> DataFrame:
    """Each conversation's facts, read from the stored rows. Many conversations may share a content: that join is split
    where it is skewed."""
    with arrow_rows(df.sparkSession, ROWS):
        convs = staged(conversations(df))
        trees = staged(build_trees(convs, tree))
        facts = staged(read_back(trees)).withColumnRenamed("content", "__content")
    return convs.select("conv_id", "content").join(facts, F.col("content") == F.col("__content")).drop("content", "__content")


def digest_sql(extra: str) -> str:
    """digest() of conversations and the rows of ``extra`` (conv_id, turn, role, text), from the turns themselves."""
    return rf"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS body
    FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL {extra})
),
written AS (
    SELECT *, '### ' || regexp_replace(role, '(\\|###|</turn>|:)', '\\\1', 'g') || ': ' || regexp_replace(body, '(\\|###|</turn>)', '\\\1', 'g') || '</turn>' || chr(10) AS formatted
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || body || chr(10), '' ORDER BY turn NULLS FIRST, role, body)) AS turns_sha256,
    CAST(coalesce(sum(length(body)) FILTER (role = '{LOSS_ROLE}'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(body, '' ORDER BY turn NULLS FIRST, body) FILTER (role = '{LOSS_ROLE}'), '')) AS loss_sha256,
    CAST(sum(length(formatted)) AS BIGINT) AS formatted_chars
FROM written GROUP BY conv_id"""
