"""Main text of web pages: structure first, then differencing against the page nearest by URL.

A page is cut into text lines, one a block element. Lines inside menus, footers, asides and what is hidden never
count. Of other elements, a name, a role or the words of a class or id may say that they are a sidebar, a notice, an
advert, a form or comments; whether they are left out is decided by what they hold: little of the page's
text, mostly links, and not the page's only marked article. So a wrapper named for its sidebar stays, and
comments in an article go. Where a page marks its article, the article's other lines are its text; of several marked parts all
count, but where one holds others, either its own lines or theirs, whichever are more text.

Every page is then paired with the one nearest by URL path on its host that has other lines (the neighbour in path order that
shares more of the path), both pages' lines are aligned by longest common subsequence, and of the lines left so far those
that they share are deleted. Two neighbouring articles may share paragraphs, so a mark protects its own lines from
this, but for lines that the markup speaks against as well: those that are mostly links and no heading, and those of a small
element whose words leave it open whether it belongs to the article. These go if they are shared, unless the nearest page
has half of the protected lines too: it then repeats the article and says nothing about it.

Neighbours come from a range partitioning of (host, path), so a host may hold any share of the pages. Pages of a host with
equal lines are aligned once. Pages are read twice, for their lines and for their text, so that no text is written down;
an input that differs between two reads (a limit without an order) keeps all rows of the second, and pages that the first lacked aren't cut.

Defined results: null html gives an empty text; a null url is a host and path of its own, both
empty; a page whose lines are all on its neighbour is not cut; copies on a host are cut alike; a marked part without protected lines is not cut; rows that
repeat an id each give a row; an empty table gives none. A tag that doesn't end before the next one starts
ends there; an element whose content is no text (a button, a video) and that is never closed ends at
the next block. Reading takes time in proportion to a page's length, whatever its markup; aligning, to
that and, where both pages repeat lines, to a 64th of the product of how many lines they have in common. Only the id, url and html columns are read.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.llm.common import staged

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:=\s*+(?:"[^"]*"|'[^']*')|[^<>])*+)(?:>|(?=<)|\Z)""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)\b""")
_WORDS = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg math object select button video audio canvas noframes noembed".split())
#: Of these, what is read as plain text even where it never ends.
PLAIN = frozenset("script style".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_NEXT_BLOCK = re.compile(rf"</?(?:{'|'.join(sorted(BLOCK))})(?=[\s/>])", re.IGNORECASE)
DROPPED = frozenset("nav footer aside head menu dialog search".split())
#: Words of a class or id that say what is not the article: those that say it of an element that they only occur in, ...
LIKELY = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot sponsor sponsored promo banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar "
    "cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup pagination pager copyright comment comments commentlist replies disqus".split()
)
#: ... and those that say it of an element that is mostly links, or has no other words.
MAYBE = frozenset("promotion notice notices login share sharing social related recommended recommendations reply respond skip widget".split())
MARKS = LIKELY | MAYBE
#: Words that may stand beside a mark.
BESIDE = frozenset("list box block bar buttons links area section thread wrapper container inner outer header title form".split())
CONTAINERS = frozenset("div ul ol dl table fieldset details center hgroup section form".split())
WHOLE = frozenset("article main body html".split())
HEADINGS = tuple("h1 h2 h3 h4 h5 h6".split())
COMMENTS = frozenset("comment comments commentlist reply replies respond disqus".split())
ROLES = frozenset("navigation banner complementary contentinfo search dialog alertdialog menu menubar toolbar".split())
MAIN_MARKS = frozenset("article articlebody article-body article-content post post-body post-content entry entry-content story story-body main-content".split())

# What marks an element as no part of the article: nothing, a word among others, one that counts for lists of links only, the element's own
# name, all its words, all its words and they mean comments, or something that leaves no doubt.
NO, MAYBE_SO, LIKELY_SO, BY_NAME, BY_WORDS, BY_COMMENTS, SURE = range(7)
#: Shares of a page's text that such an element may have, and of its own text that links must have.
LITTLE, HALF = 0.3, 0.5


def _words(value: str) -> set[str]:
    return {w.lower() for w in _WORDS.split(value) if w}


def _doubt(name: str, key: str, value: str, inside: bool) -> int:
    """What a class or id says against an element, in or outside a marked article."""
    if name in WHOLE:
        return BY_COMMENTS if name == "article" and _words(value) & COMMENTS else NO
    doubt = NO
    for token in value.split():
        words = _words(token)
        if marks := words & MARKS:
            if words <= MARKS | BESIDE:
                if name in CONTAINERS or not inside or key == "class" and not name.startswith("h"):
                    doubt = max(doubt, BY_COMMENTS if marks & COMMENTS else BY_WORDS)
            elif name in CONTAINERS:
                mostly = not inside or marks & COMMENTS or 2 * len(words & (MARKS | BESIDE)) > len(words)
                doubt = max(doubt, LIKELY_SO if marks & LIKELY and mostly else MAYBE_SO)
        elif "header" in words and not inside and not name.startswith("h"):
            doubt = max(doubt, BY_NAME)
    return doubt


def _kind(name: str, attributes: str, inside: bool) -> tuple[int, int]:
    """What speaks against an element, and the level of article marking it sets: 2 an article, 1 a main part, 0 none."""
    level = 2 if name == "article" else 1 if name == "main" else 0
    doubt = SURE if name in DROPPED else BY_NAME if name == "form" or name == "header" and not inside else NO
    if attributes.strip(" /"):
        for key, a, b, c, hidden in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), (a or b or c)
            if hidden or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
                doubt = SURE
            elif key in ("class", "id"):
                doubt = max(doubt, _doubt(name, key, value, inside))
                if name not in WHOLE and {w.lower() for w in value.split()} & MAIN_MARKS:
                    level = max(level, 1)
            elif key == "role":
                doubt = max(doubt, SURE if value.lower() in ROLES else BY_NAME if value.lower() == "form" else NO)
                level = max(level, 2 if value.lower() == "article" else 1 if value.lower() == "main" else 0)
            elif key == "itemprop" and value.lower() == "articlebody":
                level = max(level, 1)
    return doubt, 0 if doubt in (BY_COMMENTS, SURE) else level


class _Node:
    """An element that something is said about: against it, or that it is a part of the article."""

    __slots__ = ("above", "doubt", "inside", "level", "chars", "links", "parts", "out", "own")

    def __init__(self, above: int, doubt: int, inside: bool, level: int):
        self.above, self.doubt, self.inside, self.level = above, doubt, inside, level
        self.chars = self.links = self.parts = self.own = 0  # text in it, of that in links; marked parts in it, itself included; text in no part within
        self.out = False


def _left_out(node: _Node, whole: _Node) -> bool:
    """Whether an element is left out: by its share of the text, of links and of the marked parts, not by one word."""
    share, all_parts = node.chars / max(1, whole.chars), whole.parts > 0 and node.parts == whole.parts
    if node.doubt == SURE:
        return True
    if node.doubt in (BY_WORDS, BY_COMMENTS):
        return not all_parts if whole.parts else share <= HALF
    if node.doubt == BY_NAME:
        return not node.parts and share <= HALF
    if node.doubt == LIKELY_SO:
        return not all_parts and share <= LITTLE
    return node.doubt == MAYBE_SO and not node.parts and share <= LITTLE and node.links >= HALF * node.chars


def _judge(nodes: list[_Node], found: list[tuple[str, int, int, bool]]) -> list[tuple[str, int, bool, bool]]:
    """(text, level, left out, protected by a mark) of each line: ``nodes`` in page order, the first the page; ``found`` (text, node, characters in links, heading)."""
    for text, at, links, _ in found:
        nodes[at].chars += len(text)
        nodes[at].links += links
    for node in reversed(nodes[1:]):
        node.parts += node.level > 0
        above = nodes[node.above]
        above.chars += node.chars
        above.links += node.links
        if node.doubt != SURE:
            above.parts += node.parts
    for node in nodes[1:]:
        node.out = nodes[node.above].out or _left_out(node, nodes[0])
    # The innermost part that each node is in; a part is taken if its own text is more than that of the parts in it.
    part = [0] * len(nodes)
    for i, node in enumerate(nodes[1:], 1):
        part[i] = i if node.level and not node.out else part[node.above]
    for text, at, _, _ in found:
        if not nodes[at].out and part[at]:
            nodes[part[at]].own += len(text)
    within = [0] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        if part[i] == i:
            within[part[nodes[i].above]] += max(nodes[i].own, within[i])
    taken = [False] * len(nodes)
    settled = [False] * len(nodes)  # a part around it is taken
    for i in range(1, len(nodes)):
        if part[i] == i:
            settled[i] = settled[part[nodes[i].above]] or taken[part[nodes[i].above]]
            taken[i] = not settled[i] and nodes[i].own > within[i]
    # Elements in a part that may be something else, and hold little.
    open_ = [False] * len(nodes)
    for i, node in enumerate(nodes[1:], 1):
        open_[i] = part[i] != i and (open_[node.above] or node.doubt != NO and not node.parts and node.chars <= LITTLE * nodes[0].chars)
    lines = []
    for text, at, links, heading in found:
        level = nodes[part[at]].level if taken[part[at]] else 0
        lines.append((text, level, nodes[at].out, level > 0 and not open_[at] and (heading or links < HALF * len(text))))
    return lines


def lines_of(page: str) -> list[tuple[str, int, bool]]:
    """(text, level of marking, left out) of each block with text, in page order; the level is 0 outside the parts that are taken as the article."""
    return [line[:3] for line in _lines(page)]


def _lines(page: str) -> list[tuple[str, int, bool, bool]]:
    """The same, and whether a mark protects the line from differencing."""
    found: list[tuple[str, int, int, bool]] = []
    nodes = [_Node(0, NO, False, 0)]
    stack: list[tuple[str, int, int]] = []  # open blocks, and inline elements that something is said about: name, node, level of marking
    linked, in_link = 0, False  # characters in links since the block began
    parts: list[str] = []
    opened: Counter[str] = Counter()  # how many of a name the stack has
    never_closed: set[str] = set()  # elements without text that have no end tag from here on
    at = 0

    def end_block() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            found.append((text, stack[-1][1] if stack else 0, min(linked, len(text)), linked > 0 and any(opened[h] for h in HEADINGS)))
        linked = 0

    def push(name: str, doubt: int, level: int) -> None:
        """An element gets a node if something is said about it; a part in a part of its level is no part of its own."""
        above, level_above = stack[-1][1:] if stack else (0, 0)
        part = level if level > level_above else 0
        if doubt or part:
            nodes.append(_Node(above, doubt, level_above > 0, part))
            above = len(nodes) - 1
        stack.append((name, above, max(level, level_above)))
        opened[name] += 1

    def pop() -> str:
        name = stack.pop()[0]
        opened[name] -= 1
        return name

    def close(name: str) -> None:
        while opened[name] and pop() != name:
            pass

    def behind(name: str) -> int:
        """Where an element without text ends."""
        end = None if name in never_closed else re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(page, at)
        if end:
            return end.end()
        never_closed.add(name)
        block = None if name in PLAIN else _NEXT_BLOCK.search(page, at)
        return block.start() if block else len(page)

    while True:
        token = _TOKEN.search(page, at)
        parts.append(page[at : token.start() if token else len(page)])
        if in_link:
            linked += len(parts[-1].strip())
        if token is None:
            break
        at = token.end()
        name = (token[2] or "").lower()
        if not name:
            continue
        if name == "a":
            in_link = not token[1]
        if token[1]:
            if name in BLOCK:
                end_block()
            elif not opened[name]:
                continue
            else:
                end_block()
            close(name)
        elif name in RAW:
            # Its content is text up to its own end tag, whatever it looks like.
            if not token[3].rstrip().endswith("/"):
                at = behind(name)
        elif name == "br":
            parts.append(" ")
        elif name in VOID:
            if name == "hr":
                end_block()
        else:
            if name in BLOCK:
                end_block()
                if name != "head" and stack and stack[-1][0] == "head":
                    close("head")
                while stack and stack[-1][0] in ("p", "li", "dt", "dd", "td", "th", "tr", "h1", "h2", "h3", "h4", "h5", "h6") and _closes(name, stack[-1][0]):
                    pop()
                push(name, *_kind(name, token[3], bool(stack and stack[-1][2])))
            elif token[3].strip(" /"):
                doubt, _ = _kind(name, token[3], bool(stack and stack[-1][2]))
                if doubt > BY_NAME:
                    end_block()
                    push(name, doubt, 0)
    end_block()
    return _judge(nodes, found)


def _closes(name: str, top: str) -> bool:
    """Whether a block's start tag ends the open element ``top``, whose end tag may be left out."""
    if top in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
        return True
    return name == top or name in ("dt", "dd") and top in ("dt", "dd") or name in ("td", "th", "tr") and top in ("td", "th") or name in ("tbody", "tfoot") and top in ("td", "th", "tr")


#: So many pairs of equal lines are listed at once.
PAIRS = 1 << 18


def common(own: list[int], other: list[int]) -> list[int]:
    """Places in ``own`` of a longest common subsequence with ``other``. Lines at both ends that are equal belong to one, and
    lines that only one page has to none. Where what is left has too many pairs to list, ``own`` is
    halved, and ``other`` cut where both halves together have most in common (Hirschberg)."""
    least = min(len(own), len(other))
    head = next((i for i in range(least) if own[i] != other[i]), least)
    tail = next((i for i in range(least - head) if own[-1 - i] != other[-1 - i]), least - head)
    end = len(own) - tail
    counts = Counter(other[head : len(other) - tail])
    at = [i for i in range(head, end) if own[i] in counts]
    mine = [own[i] for i in at]
    both = set(mine)
    theirs = [x for x in other[head : len(other) - tail] if x in both]
    if len(mine) < 2 or sum(counts[x] for x in mine) <= PAIRS:
        found = _chain(mine, theirs)
    else:
        half = len(mine) // 2
        cut = int(np.argmax(_lengths(mine[:half], theirs) + _lengths(mine[half:][::-1], theirs[::-1])[::-1]))
        found = common(mine[:half], theirs[:cut]) + [half + i for i in common(mine[half:], theirs[cut:])]
    return [*range(head), *(at[i] for i in found), *range(end, len(own))]


def _lengths(own: list[int], other: list[int]) -> np.ndarray:
    """How long a longest common subsequence of ``own`` and the first 0, 1, 2, ... lines of ``other`` is: a bit a line of ``other``, which is off
    where the length grows; one row of the table after the other (Hyyrö)."""
    where: dict[int, list[int]] = {}
    for j, x in enumerate(other):
        where.setdefault(x, []).append(j)
    bits = lambda x: int.from_bytes(np.packbits(np.bincount(where[x], minlength=len(other)).astype(bool), bitorder="little").tobytes(), "little")
    often = {x: bits(x) for x, places in where.items() if len(places) > 64}
    whole = row = (1 << len(other)) - 1
    for x in own:
        if x in where:
            met = row & (often[x] if x in often else sum(1 << j for j in where[x]))
            row = ((row + met) | (row - met)) & whole
    grows = np.unpackbits(np.frombuffer(row.to_bytes(len(other) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(other)] == 0
    return np.concatenate([[0], np.cumsum(grows)])


def _chain(own: list[int], other: list[int]) -> list[int]:
    """The same from all pairs of equal lines, in order: the longest chain of them that rises in both (Hunt and Szymanski)."""
    where: dict[int, list[int]] = {}
    for j, x in enumerate(other):
        where.setdefault(x, []).append(j)
    ends: list[int] = []
    tails: list[int] = []
    links: list[tuple[int, int]] = []  # (place in own, link before)
    for i, x in enumerate(own):
        for j in reversed(where.get(x, ())):
            k = bisect_left(ends, j)
            links.append((i, tails[k - 1] if k else -1))
            if k == len(ends):
                ends.append(j)
                tails.append(len(links) - 1)
            else:
                ends[k] = j
                tails[k] = len(links) - 1
    out, at = [], tails[-1] if tails else -1
    while at >= 0:
        i, at = links[at]
        out.append(i)
    return out[::-1]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blocks, at, hashes = [], [], []
        for page in batch.column(1):
            lines = _lines(page.as_py() or "")
            best = any(level for _, level, out, _ in lines if not out)
            kept = [i for i, (_, level, out, _) in enumerate(lines) if not out and (level > 0) == best]
            alone = best and not any(lines[i][3] for i in kept)
            blocks.append([lines[i][0] for i in kept])
            at.append([-1 - i if alone or lines[i][3] else i for i in kept])
            hashes.append([xxhash.xxh3_64_intdigest(line[0]) - (1 << 63) for line in lines])
        columns = [batch.column(0), batch.column(2), pa.array(blocks, pa.list_(pa.string())), pa.array(at, pa.list_(pa.int32())), pa.array(hashes, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "blocks", "at", "lines"])


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shared = []
        for own, other in zip(batch.column("lines").to_pylist(), batch.column("near_lines").to_pylist(), strict=True):
            places = common(own, other or [])
            shared.append(places if len(places) < len(own) else [])
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("key"), pa.array(shared, pa.list_(pa.int32()))], names=["host", "key", "shared"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``at`` has the place of each block among the page's lines, or of a protected one -1 less it."""
    for batch in batches:
        text, n_shared = [], []
        for blocks, at, places in zip(*(batch.column(c).to_pylist() for c in ("blocks", "at", "shared")), strict=True):
            shared = set(places or ())
            n_shared.append(len(shared))
            firm = [-1 - i in shared for i in at if i < 0]
            if firm and 2 * sum(firm) >= len(firm):
                shared = set()
            text.append("\n\n".join(b for b, i in zip(blocks, at, strict=True) if i not in shared))
        columns = [batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array(n_shared, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_shared"])


def neighbours(pages: DataFrame) -> DataFrame:
    """(host, path, key) -> (host, key, near): the key of the nearest page by path on the host that has another
    key, null if there is none. Pages of one key are one class with one result: the nearest to any of them.
    What else ``pages`` has must follow from the key; it comes along, and the near one's as near_NAME."""
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["host", "path", "key"]
    more = [c for c in pages.columns if c not in order]
    dealt = staged(pages.select(*order, *more).distinct().repartitionByRange(n, *order).select(*order, *more, F.spark_partition_id().alias("pid")))
    place = F.struct(*order, *more)
    # One row a partition: what lies just before and just behind it.
    edges = dealt.groupBy("pid").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    edges = edges.select(F.col("pid").alias("p"), F.lag("last").over(Window.orderBy("pid")).alias("ahead"), F.lead("first").over(Window.orderBy("pid")).alias("behind"))
    own = Window.partitionBy("pid").orderBy(*order)
    near = dealt.withColumn("prev", F.lag(place).over(own)).withColumn("next", F.lead(place).over(own)).join(edges, F.col("pid") == F.col("p"))
    for side, beyond in (("prev", "ahead"), ("next", "behind")):
        met = F.coalesce(F.col(side), F.col(beyond))
        near = near.withColumn(side, F.when(met["host"] == F.col("host"), met))
    # How much of the path two pages share: equal leading segments.
    deep = lambda side: F.expr(f"coalesce(array_position(zip_with(split(path, '/'), split({side}.path, '/'), (x, y) -> x <=> y), false), 0)")
    shared = lambda side: F.when(F.col(side).isNull(), -1).when(deep(side) == 0, 1 << 20).otherwise(deep(side))
    # Where pages of one key lie side by side, the first meets what is before them and the last what is behind.
    for side in ("prev", "next"):
        near = near.withColumn(side, F.when(F.col(f"{side}.key") != F.col("key"), F.col(side)))
    met = [F.struct((-shared(side)).alias("far"), F.lit(i).alias("side"), F.col("path"), F.col(f"{side}.key").alias("near"), *(F.col(f"{side}.{c}").alias(f"near_{c}") for c in more)) for i, side in enumerate(("prev", "next"))]
    classes = near.groupBy("host", "key").agg(F.min(F.least(*met)).alias("m"), *(F.first(c).alias(c) for c in more))
    return classes.select("host", "key", "m.near", *more, *(f"m.near_{c}" for c in more))


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_shared): a row a page, with the number of its lines that it shares with the page nearest to it (0 if it shares all)."""
    schema = "page_id bigint, url string, blocks array<string>, at array<int>, lines array<bigint>"
    parsed = df.select(F.col(id_col).cast("bigint"), F.col(html_col), F.col(url_col)).mapInArrow(_parse, schema)
    address = F.coalesce("url", F.lit(""))
    host = F.lower(F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    pages = parsed.withColumn("host", host).withColumn("path", path).withColumn("key", F.xxhash64("lines"))
    near = neighbours(staged(pages.select("host", "path", "key", "lines")))
    # Staged, so that both sides of the join are plain exchanges and hot classes are split.
    aligned = staged(near.select("host", "key", "lines", "near_lines").mapInArrow(_align, "host string, key bigint, shared array<int>"))
    met = pages.select("page_id", "url", "blocks", "at", "host", "key").join(aligned.hint("merge"), ["host", "key"], "left")
    return met.select("page_id", "url", "blocks", "at", "shared").mapInArrow(_cut, "page_id bigint, url string, text string, n_shared bigint")


def digest(df: DataFrame) -> DataFrame:
    return main_text(df).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), "n_shared")
