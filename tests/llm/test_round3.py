"""Manifests, importance resampling, near vectors and scopes, against brute force on small awkward inputs."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerflow.llm import common, importance, merkle, mixing, near_vectors
from tests.compare import rows_of_duckdb, rows_of_spark
from tests.conftest import values
from tests.llm.test_operators import AWKWARD, DOCS, docs, vocabulary_text

# --- manifests --------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """Root, and each leaf's siblings as (stands left, digest or None)."""
    paths, places, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for i, at in enumerate(places):
            beside = at ^ 1
            paths[i].append((beside < at, nodes[beside] if beside < len(nodes) else None))
            places[i] = at // 2
        nodes = [sha(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0], paths


def plain_leaf(row, add=0):
    cells = (row.doc_id, row.source, row.lang, None if row.n_chars is None else row.n_chars + add, row.text)
    return sha(*("-" if c is None else f"{len(str(c).encode())}:{c}" for c in cells))


def plain_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, plain_leaf(r)))
        trees[name] = plain_tree([plain_leaf(r) for r in groups[name]])
    root, over = plain_tree([trees[n][0] for n in names])
    out = Counter()
    for name, above in zip(names, over, strict=True):
        for r, path in zip(groups[name], trees[name][1], strict=True):
            whole = path + above
            struck = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
            node = plain_leaf(r, int(struck))
            for left, beside in whole:
                node = sha(node) if beside is None else sha(beside, node) if left else sha(node, beside)
            out[(r.doc_id, plain_leaf(r), trees[name][0], root, sha(*(d for _, d in whole if d)), node, node == root)] += 1
    return out


def awkward_documents(spark, n=75):
    """Groups of many sizes, one of a single row, nulls in every column, repeated rows and rows of one id."""
    r = random.Random(5)
    rows = [(1000 + 37 * i, r.choice(["x", "", None, "é😀"]), r.choice(["en", "de", "", None]), r.choice(["s", None]), r.choice([3, 4, 5, None]), 0, "r", "x", "k") for i in range(n)]
    rows += [rows[3]] * 5 + [(1111, "other", "en", "s", 1, 0, "r", "x", "k"), (None, None, None, None, None, None, None, None, None), (900, "lone", "zz", "s", 4, 0, "r", "x", "k")]
    return spark.createDataFrame([(a, b, c, d, e, *rest) for a, b, c, d, e, *rest in rows], DOCS)


@pytest.mark.parametrize("height", [1, 2, 12])
def test_manifest_equals_plain_trees(spark, height):
    """Blocks of 2, 4 and 4096 leaves: many levels of blocks, and one."""
    frame = awkward_documents(spark)
    got = Counter(tuple(x) for x in merkle.digest(frame, height).collect())
    assert got == plain_manifest(frame.collect())
    assert {k[-1] for k in got} == {True, False}


def test_manifest_of_none_and_one(spark):
    one = docs(spark, {7: "only"})
    got = merkle.digest(one).first()
    assert got.leaf == got.subroot == got.root and got.proof_sha256 == sha("")
    none = merkle.digest(one.limit(0))
    assert none.count() == 0 and none.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("count", [1, 2, 3, 5, 8, 13, 64, 100])
def test_fractal_traversal_gives_each_path_with_few_nodes(count):
    leaves = [sha(str(i)).encode() for i in range(count)]
    height = (count - 1).bit_length()
    calls = []
    paths = list(merkle.authentication_paths(count, height, lambda i: calls.append(i) or (leaves[i] if i < count else None)))
    _, want = plain_tree([x.decode() for x in leaves])
    assert [[(s, d and d.decode()) for s, d in p] for p in paths] == want
    assert len(calls) <= (1 + height / merkle.STEP) * 2 ** (height + 1)


def test_proofs_are_real_paths(spark):
    frame = docs(spark, {i: f"text {i}" for i in range(9)})
    found, root = merkle.proofs(frame)
    rows = found.withColumn("up", merkle.folded(F.col("leaf"), F.col("path"))).collect()
    assert len(rows) == 9 and {r.up for r in rows} == {root} == {r.subroot for r in rows} and all(len(r.path) == 4 for r in rows)


# --- importance resampling --------------------------------------------------

IMPORTANCE_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_features(text):
    words = IMPORTANCE_WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def plain_resample(rows, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    ours, theirs = Counter(), Counter()
    for _, text in rows:
        ours.update(map(bucket, plain_features(text)[1]))
    for text in target:
        theirs.update(map(bucket, plain_features(text)[1]))
    s, t = sum(ours.values()), sum(theirs.values())
    out = []
    for i, text in rows:
        words, features = plain_features(text)
        weight = sum(math.floor(1000 * math.log((theirs[b] + 1) * (s + 10000) / ((ours[b] + 1) * (t + 10000)))) for b in map(bucket, features))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words) >= 20])
    drawn = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(drawn[: 5 * len(drawn) // 100])}
    return Counter((*r[:4], rank.get(id(r))) for r in out)


def test_importance_equals_plain_version(spark):
    r = random.Random(9)
    texts = AWKWARD + [vocabulary_text(i, r.randint(1, 60)) for i in range(120)] + ["ÀB c9 Ça;_x[y]`z{|}~\x00\x7f ٣٤", "w" * 70_000 + " a b", "Wörter-Bücher und　mehr"]
    frame = docs(spark, texts)
    frame = frame.unionByName(frame.where("doc_id in (6, 20)")).unionByName(frame.where("doc_id = 30").withColumn("doc_id", F.lit(None).cast("bigint")))
    target = [vocabulary_text(500, 50), "a b", None, ""]
    items = spark.createDataFrame([(t, 1) for t in target], "text string, n bigint")
    got = Counter(tuple(x) for x in importance.resample(frame, items).collect())
    assert got == plain_resample([(x.doc_id, x.text) for x in frame.collect()], target)
    assert sum(k[-1] is not None for k in got) == 5 * sum(n for k, n in Counter(len(plain_features(x.text)[0]) >= 20 for x in frame.collect()).items() if k) // 100
    assert importance.resample(frame.limit(0), items).count() == 0
    assert importance.resample(frame, items.limit(0)).count() == frame.count()


def test_tries_of_slices_add_up(monkeypatch):
    import pyarrow as pa

    texts = [vocabulary_text(i, n) for i, n in enumerate([0, 1, 2, 3, 50, 200])] + ["", "éé a", "x"]
    want = Counter(f for t in texts for f in plain_features(t)[1])
    crcs = Counter()
    for f, n in want.items():
        crcs[zlib.crc32(f.encode())] += n
    for size in (1, 2, 3, 7, 1000):
        monkeypatch.setattr(importance, "SLICE", size)
        for array in (pa.array(texts), pa.array(["zz zz", *texts, "q"])[1:-1], pa.array(texts, pa.large_string())):
            got = Counter()
            for trie, _ in importance.tries(array):
                for c, n in zip(trie.crcs, trie.counts, strict=True):
                    for k, m in zip(c.tolist(), n.tolist(), strict=True):
                        got[k] += m
            assert +got == crcs
    parts = [(b"", b"a"), (b"abc", b" word"), (b"x" * 300, b"y" * 1000)]
    a, b = (np.array([zlib.crc32(p[i]) for p in parts], np.uint32) for i in (0, 1))
    assert importance.extended(a, b, np.array([len(p[1]) for p in parts])).tolist() == [zlib.crc32(x + y) for x, y in parts]


# --- near vectors -----------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>, label int, id string, c string, home int, rows int"


def plain_links(rows, least=0.9):
    """(n_links, component_id, kept) by row, all pairs compared."""
    units = []
    for i, v in rows:
        x = None if v is None or i is None or any(c is None or not math.isfinite(c) for c in v) else np.array(v, np.float32).astype(float)
        units.append(None if x is None or not np.abs(x).max(initial=0) else x / np.linalg.norm(x))
    near = [[j for j, y in enumerate(units) if j != k and x is not None and y is not None and len(x) == len(y) and x @ y >= least] for k, x in enumerate(units)]
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        first = None if i is None else min(rows[j][0] for j in seen)
        out.append((i, len(near[k]), first, i is not None and first == i))
    return Counter(out)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y", 3, 4) for i, v in rows], VECTORS)


def noisy_groups(seed, groups, size, dim=24, noise=0.06):
    r = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        middle = r.standard_normal(dim)
        middle /= np.linalg.norm(middle)
        out += [(middle + noise * r.standard_normal(dim)).astype(np.float32).tolist() for _ in range(size)]
    return [(1000 - k, v) for k, v in enumerate(out)]


@pytest.mark.parametrize("block_rows", [16, 4096])
def test_near_vectors_equal_all_pairs(spark, block_rows, monkeypatch):
    """Chains, copies, awkward rows; with blocks of 16 rows a group is many tasks' work."""
    monkeypatch.setattr(near_vectors, "CELL_ROWS", 40)
    rows = noisy_groups(1, 6, 40) + noisy_groups(2, 40, 2)[:80]
    rows = [(i, v) for i, v in {i: v for i, v in rows}.items()]
    zero, one = [0.0] * 24, [1.0] + [0.0] * 23
    rows += [(5000, None), (5001, zero), (5002, [math.nan] * 24), (5003, [math.inf] + zero[1:]), (5004, [None] + zero[1:]), (5005, [])]
    rows += [(6000 + k, one) for k in range(50)] + [(6000, one), (6000, [-1.0] + zero[1:]), (None, one), (None, None), (7000, [1.0, 0.0]), (7001, [1.0, 0.1]), (7002, [3.0]), (7003, [1e-30] + zero[1:])]
    frame = vectors(spark, rows)
    got = Counter(tuple(x) for x in near_vectors.near_vectors(frame, block_rows=block_rows).collect())
    want = plain_links(rows)
    assert sum(got.values()) == len(rows)
    found, there = sum(k[1] * n for k, n in got.items()), sum(k[1] * n for k, n in want.items())
    assert 0.97 * there <= found <= there
    if found == there:
        assert got == want


def test_a_hot_group_of_near_copies_is_summed(spark):
    """A group over several cells, vectors around it and far away, copies of some; blocks of 50 rows."""
    r = np.random.default_rng(10)
    middle = r.standard_normal(24)
    middle /= np.linalg.norm(middle)
    near = [(middle + s * r.standard_normal(24)).tolist() for s in r.choice([0.005, 0.02, 0.03, 0.06, 0.09], 600, p=[0.3, 0.3, 0.2, 0.1, 0.1])]
    rows = list(enumerate(near + near[:40] + [v for _, v in noisy_groups(3, 60, 3)]))
    frame = vectors(spark, rows).withColumn("embedding", F.col("embedding").cast("array<float>"))
    got = Counter(tuple(x) for x in near_vectors.near_vectors(frame, block_rows=50).collect())
    want = plain_links([(x.vec_id, x.embedding) for x in frame.collect()])
    found, there = sum(k[1] * n for k, n in got.items()), sum(k[1] * n for k, n in want.items())
    assert 0.97 * there <= found <= there and (found < there or got == want)


def test_near_vectors_of_none(spark):
    assert near_vectors.near_vectors(vectors(spark, [(1, [1.0])]).limit(0)).count() == 0
    assert values(near_vectors.near_vectors(vectors(spark, [(1, [1.0]), (2, None)]))) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_multi_sequence_visits_in_order_and_all_within_the_radius():
    r = np.random.default_rng(4)
    for _ in range(20):
        a, b = r.random(r.integers(1, 9)), r.random(r.integers(1, 9))
        got = list(near_vectors.multi_sequence(a, b, 0.8))
        sums = [a[i] + b[j] for i, j in got]
        assert sums == sorted(sums) and set(got) == {(i, j) for i in range(len(a)) for j in range(len(b)) if a[i] + b[j] <= 0.8} and len(set(got)) == len(got)


def test_margins_bound_the_distance_to_a_cell():
    r = np.random.default_rng(6)
    words, x, y = r.standard_normal((12, 5)), r.standard_normal((200, 5)), r.standard_normal((200, 5))
    away = near_vectors.margins(x, words)[np.arange(200), near_vectors._nearest(y, words).argmin(axis=1)]
    assert (away <= ((x - y) ** 2).sum(axis=1) + 1e-9).all()


def test_recall_against_brute_force_with_links_at_the_limit(spark, monkeypatch):
    """Pairs of a cosine just above the limit, in random directions, over a grid of many cells: the hardest links there are."""
    monkeypatch.setattr(near_vectors, "CELL_ROWS", 8)
    r = np.random.default_rng(8)
    x = r.standard_normal((800, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = r.standard_normal(x.shape)
    side -= (side * x).sum(axis=1)[:, None] * x
    side /= np.linalg.norm(side, axis=1)[:, None]
    y = 0.901 * x + math.sqrt(1 - 0.901**2) * side
    rows = [(2 * i, v.tolist()) for i, v in enumerate(x)] + [(2 * i + 1, v.tolist()) for i, v in enumerate(y)]
    frame = vectors(spark, rows).withColumn("embedding", F.col("embedding").cast("array<double>"))
    got = near_vectors.near_vectors(frame).agg(F.sum("n_links")).first()[0]
    assert 0.95 * 1600 <= got <= 1600


# --- pages ------------------------------------------------------------------

LONG_TEXT = "Own text of the page that goes on and on. " * 9
LONG = f"<p>{LONG_TEXT}</p>"


@pytest.mark.parametrize(
    "html, want",
    [
        (f"<div class='layout has-sidebar'><article>{LONG}</article></div>", ["L"]),
        (f"<div id='page' class='no-sidebar'><article>{LONG}</article><div class='sidebar'>side</div></div>", ["L"]),
        (f"<div class='elementor-widget-wrap'><main>{LONG}</main></div>", ["L"]),
        (f"<form id='aspnetForm'><article>{LONG}</article></form>", ["L"]),
        (f"<div class='post-with-comments-count'>{LONG}</div>", ["L"]),
        (f"<p class='share-price'>Prices</p><h2 id='related-work'>Work</h2>{LONG}", ["Prices", "Work", "L"]),
        (f"<main>{LONG}<article class='card'>teaser</article></main>", ["L"]),
        (f"<main><h1>Posts</h1><article>{LONG}</article><article>two {LONG_TEXT}</article></main>", ["L", "two L"]),
        (f"<article>{LONG}<p class='ad'>Buy now</p><div class='cookie-consent-message'>c</div><div class='newsletter-signup-form-inline'>n</div><form>f</form></article>", ["L"]),
        (f"<article>{LONG}<div class='user-comment'>u</div><div class='comment-list-item'>l</div><section id='comments'><article>s</article></section></article>", ["L"]),
        (f"<main><article>{LONG}</article><div id='comments'><article>{LONG}</article><article>{LONG}</article></div></main>", ["L"]),
        (f"<article>{LONG}</article><aside><article>{LONG}</article></aside><div hidden><main>{LONG}</main></div>", ["L"]),
        (f"<div class='related-posts'><a href='x'>one</a> <a href='y'>two</a></div>{LONG}<div class='related-posts'>no links, some words</div>", ["L", "no links, some words"]),
        (f"<article><h1>Title</h1><div class='entry-content'>{LONG}</div><footer>by me</footer></article>", ["Title", "L"]),
        ("<div class='comments'><article>all there is</article></div>", ["all there is"]),
    ],
)
def test_html_marks_drop_little_text_only(html, want):
    from ledgerflow.llm import html_text

    lines = html_text.lines_of(html)
    marked = any(level for _, level, out in lines if not out)
    assert [t.replace(LONG_TEXT.strip(), "L") for t, level, out in lines if not out and (level > 0) == marked] == want


def site(*rows):
    """Marked pages of one host: (path, html of the article)."""
    return [(i, f"http://a.example/{path}", f"<nav>Menu {i}</nav><article>{body}</article><footer>Foot</footer>") for i, (path, body) in enumerate(rows)]


SHARED = "<p>Both articles say this.</p><h2><a href='x'>Part</a></h2><ul><li><a href='f'>Share it</a><li><a href='s'>Source</a> of all that is said here</ul><div class='house-notice-text'>We ask for money</div>"


def test_html_marked_pages_are_differenced(spark):
    """A shared line of a marked article goes where the markup speaks against it too; the article's own words stay."""
    from ledgerflow.llm import html_text

    own = lambda i: "".join(f"<p>{i} {k} {LONG_TEXT}</p>" for k in range(4))
    other = "<ul><li><a href='o'>Only here</a></ul><div class='house-notice-text'>Only here too</div>"
    rows = site(("x/1", own(1) + SHARED), ("x/2", own(2) + SHARED + other), ("y/1", own(3) + other), ("y/2", own(3) + other + "<p>Again</p>"), ("z/1", "<a href='1'>One</a>"), ("z/2", "<a href='1'>One</a><p><a href='2'>Two</a>"))
    got = {r.page_id: r for r in html_text.digest(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    words = lambda i: [f"{i} {k} {LONG_TEXT}".strip() for k in range(4)]
    both = ["Both articles say this.", "Part", "Source of all that is said here"]
    want = {
        0: words(1) + both,
        1: words(2) + both + ["Only here", "Only here too"],
        2: words(3) + ["Only here", "Only here too"],  # the nearest page repeats the article
        3: words(3) + ["Only here", "Only here too", "Again"],
        4: ["One"],  # marked, and nothing but links
        5: ["One", "Two"],
    }
    assert {i: r.text.split("\n\n") for i, r in got.items()} == want
    assert {i: (r.n_chars, r.n_shared) for i, r in got.items()} == {i: (len(r.text), n) for (i, r), n in zip(sorted(got.items()), (6, 6, 7, 7, 2, 2), strict=True)}


def test_html_every_page_is_aligned(spark, data):
    """The whole table against pairs and alignments by hand; every page of it marks its article."""
    from ledgerflow.llm import html_text, registry

    rows = spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url", "html").collect()
    seen = {r.page_id: (re.match(r"[^:]+://([^/?#]*)([^?#]*)", r.url).groups(), tuple(t for t, _, _ in html_text.lines_of(r.html))) for r in rows}
    lines_at = {}
    for place, lines in seen.values():
        lines_at.setdefault(place, set()).add(lines)

    def deep(a, b):
        a, b = a.split("/"), b.split("/")
        return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), 1 << 20)

    def longest(a, b):
        t = [0] * (len(b) + 1)
        for x in a:
            before, t = t, [0]
            for j, y in enumerate(b):
                t.append(before[j] + 1 if x == y else max(t[-1], before[j + 1]))
        return t[-1]

    order = sorted(lines_at)
    got = {r.page_id: r.n_shared for r in registry.queries()["op3_html_text"](spark, data).collect()}
    assert got.keys() == seen.keys() and sum(got.values()) > 0
    for page_id, (place, own) in seen.items():
        i = order.index(place)
        beside = [order[j] for j in (i - 1, i + 1) if 0 <= j < len(order) and order[j][0] == place[0]]
        near = max(beside, key=lambda p: deep(p[1], place[1]), default=None)  # noqa: B023
        # Of several pages at one place, those are the nearest to each other, and any of them may be to others.
        others = lines_at[place] - {own} or lines_at.get(near, {()})
        assert got[page_id] in {longest(own, other) for other in others}


def test_html_alignment_of_pages_that_repeat_lines(monkeypatch):
    """Two pages with one line ten thousand times: all pairs are too many to list."""
    from ledgerflow.llm import html_text

    r = random.Random(5)
    a, b = ([0 if r.random() < 0.8 else r.randint(1, 10**9) for _ in range(10_000)] for _ in range(2))
    began = time.perf_counter()
    assert len(html_text.common(a, b)) == min(a.count(0), b.count(0)) and time.perf_counter() - began < 20
    for pairs in (0, 8):
        monkeypatch.setattr(html_text, "PAIRS", pairs)
        for _ in range(100):
            a, b = ([r.randint(0, 4) for _ in range(r.randint(0, 40))] for _ in range(2))
            found = html_text.common(a, b)
            rest = iter(b)
            assert found == sorted(set(found)) and all(a[i] in rest for i in found) and len(found) == len(html_text._chain(a, b))


# --- lines ------------------------------------------------------------------


def test_line_dedup_is_linear_in_a_text(spark):
    from ledgerflow.llm import line_dedup

    def seconds(n):
        r = random.Random(n)
        text = "\n".join(" ".join(str(r.randint(0, 10**6)) for _ in range(8)) for _ in range(n))
        began = time.perf_counter()
        assert line_dedup.dedup_lines(docs(spark, {1: text + "\n" + text[: len(text) // 2], 2: text})).agg(F.sum("n_lines_cut")).first()[0] >= n
        return time.perf_counter() - began

    seconds(500)
    assert seconds(6_000) < 3 * seconds(3_000) + 2


# --- scopes -----------------------------------------------------------------


def test_scopes_free_their_own_folders_only(spark):
    held = mixing.mix(docs(spark, AWKWARD))
    with common.scope() as own:
        inner = mixing.mix(docs(spark, AWKWARD))
        kept = common.staged(docs(spark, ["a b"]))
    own.free(kept)
    assert held.count() == len(AWKWARD) and kept.count() == 1 and len(own.folders) == 1
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        inner.collect()


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_importance_resampling", "op13_near_vectors"])
def test_query_matches_sql_on_more_rows(spark, name):
    from ledgerflow.llm import registry

    data = "/root/testdata/sf0.01"
    assert rows_of_spark(registry.queries()[name](spark, data)) == rows_of_duckdb(registry.oracle_sql()[name], data)
