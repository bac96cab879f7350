"""Each operator against a brute-force version on small awkward inputs, and on the smallest tables."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerflow.llm import bpe, chat, common, graph, html_text, line_dedup, media, mixing, near_dup, pii, registry, topk, toxicity
from tests.compare import rows_of_duckdb, rows_of_spark

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, runs string, id string, key string"


def docs(spark, texts, sources=None):
    """Documents with extra columns, some of them named like the operators' own."""
    rows = [(i, t, "en", (sources or {}).get(i, "s"), len(t or ""), -1, "r", "x", "k") for i, t in (texts.items() if isinstance(texts, dict) else enumerate(texts))]
    return spark.createDataFrame(rows, DOCS)


def vocabulary_text(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["an", "the", "re", "st", "ou"]) for _ in range(r.randint(1, 3))) for _ in range(n))


LONG = vocabulary_text(0, 30_000)
AWKWARD = [None, "", " ", "\n\n", "a", "one two three four", LONG, "déjà vu 😀 naïve", "tab\tand\r\nreturn", "x" * 5000, "same text here again and again", "same text here again and again"]


# --- 1 ----------------------------------------------------------------------


def test_toxicity_learns_and_holds_out(spark):
    r = random.Random(3)
    texts, labels = {}, []
    for i in range(400):
        toxic = i % 3 == 0
        texts[i] = vocabulary_text(i, 40) + (" you " + r.choice(["idiot", "moron", "stupid"]) + " " + vocabulary_text(-i, 5) if toxic else "")
        labels.append((i, int(toxic)))
    texts |= {1000: None, 1001: "", 1002: LONG + " moron idiot stupid moron"}
    labels += [(1000, 0), (5000, 1), (2, None), (3, 1), (3, 1)]
    frame = docs(spark, texts).unionByName(docs(spark, {0: texts[0]}))
    got = toxicity.digest(frame, spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()
    assert len(got) == len(texts) + 1
    for row in got:
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 3 == 1)
        assert 0 <= row.score <= 1 and row.predicted == (row.score >= 0.7)
        if row.doc_id < 400 and row.held_out:
            assert row.predicted == (row.doc_id % 3 == 0)
    assert {r.score for r in got if r.doc_id == 1000} == {r.score for r in got if r.doc_id == 1001}


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r.score for r in toxicity.digest(docs(spark, AWKWARD), none).collect()} == {0.0}
    assert toxicity.digest(docs(spark, AWKWARD).limit(0), none).count() == 0


def test_toxicity_trains_on_so_many_rows(spark):
    rows = [(0, f"idiot {i}") for i in range(300)] + [(i, "fine words") for i in range(1, 60)]
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(60)], "doc_id bigint, toxic int")
    got = toxicity.sample(spark.createDataFrame(rows, "doc_id bigint, text string"), labels, toxic=60, clean=7)
    assert got.count() == 7 + sum(i % 2 == 0 and zlib.crc32(str(i).encode()) % 3 != 1 for i in range(60))


def test_toxicity_scores_equal_a_plain_scorer(spark):
    model = toxicity.Model(np.array([5, 70, 9000]), np.array([0.5, -1.25, 2.0]), -0.25)
    texts = [*AWKWARD, *(vocabulary_text(i, 300) for i in range(20))]

    def plain(text):
        padded, found = " " + " ".join((text or "").lower().split()) + " ", Counter()
        for n in range(toxicity.SHORTEST, toxicity.LONGEST + 1):
            for at in range(len(padded) - n + 1 if padded.strip() else 0):
                h = 0
                for k, c in enumerate(padded[at : at + n]):
                    x = (ord(c) + 1) * int(toxicity._M) % 2**64
                    h = x if k == 0 else (h * int(toxicity._R) + x) % 2**64
                found[((h ^ (h >> 29)) * int(toxicity._M) % 2**64) >> (64 - toxicity.BITS)] += 1
        z = model.bias + sum(w * (1 + math.log(found[f])) for f, w in zip(model.features.tolist(), model.weights.tolist(), strict=True) if found[f])
        return 1 / (1 + math.exp(-z))

    few = [t if len(t or "") < 3000 else t[:3000] for t in texts]
    got = docs(spark, few).select("doc_id", toxicity.score(model)(F.coalesce("text", F.lit(""))).alias("s")).collect()
    assert all(math.isclose(r.s, plain(few[r.doc_id]), rel_tol=1e-9) for r in got)


def test_toxicity_on_held_out_rows(spark):
    """At sf0.1, of 300 labels learned from: most held-out toxic rows are caught, and clean ones are left alone."""
    at = "/root/testdata/sf0.1"
    labels = common.table(spark, at, "labels")
    got = toxicity.digest(common.table(spark, at, "documents"), labels).where("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in got}
    assert n[1, 1] >= 0.82 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.006 * n[0, 0]


def test_toxicity_hashes_whole_texts():
    short, longer = toxicity._PIECE, LONG[:5000]
    whole = Counter(np.concatenate(list(toxicity.hashes(longer))).tolist())
    try:
        toxicity._PIECE = 700
        assert Counter(np.concatenate(list(toxicity.hashes(longer))).tolist()) == whole
    finally:
        toxicity._PIECE = short


# --- 2 ----------------------------------------------------------------------


def brute_sets(texts):
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    out = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").translate(lower))
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def brute_components(texts):
    sets, parent = brute_sets(texts), {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_texts():
    r = random.Random(9)
    texts = dict(enumerate(AWKWARD))
    base = vocabulary_text(77, 150).split()
    other = vocabulary_text(78, 60).split()
    for i in range(100, 190):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"edit{r.randint(0, 30)}"
        if r.random() < 0.4:
            w = w[: r.randint(90, 150)]
        texts[i] = " ".join(w)
    for i in range(200, 230):
        w = list(other)
        w[r.randrange(60)] = f"only{i}"
        texts[i] = "  ".join(w).upper() if i % 2 else "\n".join(w)
    for i in range(300, 320):  # a shared passage in different texts
        texts[i] = " ".join(base[:40]) + " " + vocabulary_text(i, r.choice([5, 12, 40, 90]))
    for i in range(400, 420):  # a chain
        texts[i] = " ".join(f"w{k}" for k in range(i, i + 60))
    return texts


def test_near_duplicates_equal_brute_force(spark):
    texts = near_texts()
    got = near_dup.near_duplicates(docs(spark, texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts)


def test_near_links_equal_brute_force(spark, monkeypatch):
    texts = near_texts()
    sets = brute_sets(texts)
    want = {i: sum(1 for j in sets if j != i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])) for i in sets}
    monkeypatch.setattr(near_dup, "LIST", 7)
    frame = docs(spark, texts)
    got = near_dup.link_counts(frame.unionByName(frame.where("doc_id = 150"))).collect()
    assert {r.doc_id: r.n_links for r in got} == want and len(got) == len(texts) + 1 and max(want.values()) > 20


def test_every_order_cuts_candidates(spark):
    """Texts of whole passages: common articles in other templates, rare passages in common, and near copies."""
    r = random.Random(4)
    passage = [vocabulary_text(5000 + i, 40) for i in range(200)]
    texts = {}
    for i in range(60):  # a template of five passages that ten texts share, and five passages that two share
        template, article = i % 6, i // 2
        texts[i] = " ".join(passage[template * 5 : template * 5 + 5] + passage[30 + article * 5 : 35 + article * 5])
    for i in range(100, 140):  # any eight of the passages
        texts[i] = " ".join(r.sample(passage, 8))
    for i in range(200, 220):  # a word of a text changed
        w = texts[i - 100].split()
        w[r.randrange(len(w))] = "changed"
        texts[i] = " ".join(w)
    frame = docs(spark, texts)
    core = common.staged(near_dup.candidates_core(frame, common.staged(near_dup.classes(frame)), "doc_id", "text"))
    pairs = common.staged(near_dup.candidates(core))
    passed = {orders: {tuple(x) for x in near_dup.agreed(pairs, core, orders).collect()} for orders in [(), ("hashed",), ("common",), ("hashed", "common")]}
    key = {r.doc_id: near_dup._key(near_dup.shingles(r.text)) for r in frame.collect()}
    sets = brute_sets(texts)
    linked = {tuple(sorted((key[a], key[b]))) for a in texts for b in texts if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    print({orders: len(found) for orders, found in passed.items()}, len(linked))
    one, two, both = passed[("hashed",)], passed[("common",)], passed[("hashed", "common")]
    assert both == one & two and linked <= both and len(linked) >= 20
    assert len(both) < min(len(one), len(two)) and max(len(one), len(two)) < len(passed[()])
    assert {tuple(x) for x in near_dup.linked_pairs(core).collect()} == linked


def test_near_duplicates_in_many_groups(spark, monkeypatch):
    texts = near_texts()
    frame = docs(spark, texts)
    total = sum(len(s) for s in brute_sets(texts).values())
    monkeypatch.setattr(near_dup, "GROUP", max(1, total // 40))
    got = near_dup.near_duplicates(frame).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts)


def test_near_duplicates_with_a_hot_passage_and_a_hot_class(spark):
    """One passage in a third of the texts, and one text a third of them: neither is gathered by token."""
    passage, copy = vocabulary_text(1, 30), vocabulary_text(2, 40)
    texts = {i: copy if i % 3 == 0 else (passage + " " if i % 3 == 1 else "") + vocabulary_text(10_000 + i // 6 * 6 + i % 3, 60) + (f" tail {i}" if i % 2 else "") for i in range(600)}
    frame = docs(spark, texts).repartition(4)
    known = common.staged(near_dup.classes(frame))
    often, counts, copied = near_dup.hot(known)
    of = {r.doc_id: near_dup.shingles(r.text) for r in frame.collect()}
    assert set(near_dup.shingles(passage).tolist()) <= set(often.tolist()) and min(counts) >= 16 and list(copied.values()) == [0]
    shared = spark.sparkContext.broadcast((often, counts, copied))
    rows = frame.select("doc_id", "text").mapInArrow(near_dup._scatter(0, 3, 5, shared), near_dup._PACKED).collect()
    gathered = Counter(t for r in rows if r.g >= 0 for t in np.frombuffer(r.tokens, "<u8").tolist())
    assert not set(gathered) & set(often.tolist()) and max(gathered.values()) < 40 and len(of) == 600
    got = near_dup.near_duplicates(frame).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts)


def test_near_duplicates_of_nothing_and_of_repeated_rows(spark):
    assert near_dup.near_duplicates(docs(spark, AWKWARD).limit(0)).count() == 0
    frame = docs(spark, {7: "a b c d e f g h"})
    assert [tuple(r) for r in near_dup.near_duplicates(frame.unionByName(frame)).collect()] == [(7, 4, 7)] * 2


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(r.randint(200, 230), r.randint(200, 230)) for _ in range(25)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        if a != b:
            parent[max(x, y)] = min(x, y)
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


# --- 3 ----------------------------------------------------------------------


def page(middle, menu="Home About"):
    return f"<html><head><title>T</title></head><body><div>{menu}</div><p>Site of examples</p>{middle}<div>Write to us</div></body></html>"


PAGES = {
    1: ("http://a.example/x/1", page("<div>First <b>text</b>&nbsp;&amp; more</div><p>Second")),
    2: ("http://a.example/x/2", page("<p>Another<br>text</p>")),
    3: ("http://b.example/", "<p>Only page of its host</p>"),
    4: (None, None),
    5: ("http://a.example/y/1", "<nav>Menu</nav><article><header><h1>Head</h1></header><p>One<p>Two <script>var x='<p>';</script><aside>Side</aside><div class='comment-list'>Rude</div><form><p>Form</p></form><footer>By me</footer></article><p>Outside"),
    6: ("http://c.example/same", page("<p>Equal</p>")),
    7: ("http://c.example/same", page("<p>Equal</p>")),
    8: ("http://d.example/1", "<main><div class=sidebar>S</div><p>Main &lt;text&gt;</p></main><div>Rest</div>"),
    9: ("http://d.example/2", "<p>Broken <b>markup <div>Inside</div><!-- comment -->tail <style>p{}</style> < 5 &"),
    10: ("", ""),
}


def test_html_main_text(spark):
    frame = spark.createDataFrame([(i, u, h, "extra", 1) for i, (u, h) in PAGES.items()], "page_id bigint, url string, html string, text string, marked int")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.digest(frame).collect()}
    want = {
        1: "First text & more\n\nSecond", 2: "Another text", 3: "Only page of its host", 4: "", 5: "Head\n\nOne\n\nTwo", 8: "Main <text>",
        6: "Home About\n\nSite of examples\n\nEqual\n\nWrite to us", 7: "Home About\n\nSite of examples\n\nEqual\n\nWrite to us", 9: "Broken markup\n\nInside\n\ntail < 5 &", 10: "",
    }
    assert got == {i: (t, len(t)) for i, t in want.items()}
    assert html_text.digest(frame.limit(0)).count() == 0


def test_html_copies_are_cut_by_another_page(spark):
    rows = [(i, f"http://c.example/{p}", page(f"<p>{t}</p>")) for i, (p, t) in enumerate([("x/1", "Equal"), ("x/1", "Equal"), ("x/2", "Equal"), ("x/3", "Other"), ("y/1", "Equal"), ("y/2", "Equal")])]
    rows += [(10 + i, "http://e.example/", page(f"<p>{t}</p>")) for i, t in enumerate(["Same"] * 3)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).repartition(3).collect()}
    whole = "Home About\n\nSite of examples\n\nSame\n\nWrite to us"
    assert got == {0: "Equal", 1: "Equal", 2: "Equal", 3: "Other", 4: "Equal", 5: "Equal", 10: whole, 11: whole, 12: whole}


def test_html_keeps_the_words_of_a_marked_article():
    kept = "<h2 id='related-work'>A</h2><section id='social-history'><p class='share-price'>B</p></section><section class='ad-hoc'>C</section><div class='notice-period'>D</div><h3 class='comments'>E</h3>"
    left = "<div class='share'>V</div><div class='lead comment-list'>W</div><ul class='relatedLinks'><li>X</ul><div id='comments'>Y</div><section class='related'>Z</section>"
    lines = html_text.lines_of(f"<article>{kept}{left}</article><div class='ad-hoc'>U</div>")
    assert [text for text, level, out in lines if level == 2 and not out] == list("ABCDE") and {text for text, _, out in lines if out} == set("UVWXYZ")


def test_html_unclosed_elements_end():
    kept = lambda page: [text for text, _, out in html_text.lines_of(page) if not out]
    assert kept("<article><p>a <button>x<p>b</p><p>c</p></article>") == ["a", "b", "c"]
    assert kept("<p>a<video><source src=x><p>b<object>c</object><p>d") == ["a", "b", "d"]
    assert kept("<p>a <b class=x <i>b</i></p><p title=don't>c it's</p><p title='>'>d</p>") == ["a b", "c it's", "d"]
    assert kept("<title>T<body><p>a") == ["a"] and kept("<p>a<script>x<p>y") == ["a"]


def test_html_reads_broken_markup_in_proportion():
    for piece in ("<a ", "<", "<a b=\"", "<div></b>", "<button>", "<button><p>", "<!-- ", "</a", "<a b='c\" ", "&", "<p>x"):
        page_ = piece * (1_000_000 // len(piece) // 4)
        began = time.perf_counter()
        html_text.lines_of(page_)
        assert time.perf_counter() - began < 8, piece


def test_html_common_subsequence():
    def brute(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    r = random.Random(2)
    for _ in range(200):
        a, b = ([r.randint(0, 5) for _ in range(r.randint(0, 12))] for _ in range(2))
        found = html_text.common(a, b)
        assert len(found) == brute(a, b) and found == sorted(set(found))


def test_html_neighbours_are_nearest(spark):
    rows = [(h, f"/{a}/{b}", i) for i, (h, a, b) in enumerate((h, a, b) for h in "pq" for a in range(6) for b in range(7))]
    got = {r.key: r.near for r in html_text.neighbours(spark.createDataFrame(rows, "host string, path string, key bigint")).collect()}
    by_key = {k: (h, p) for h, p, k in rows}
    assert all(by_key[got[k]][0] == h and by_key[got[k]][1].split("/")[1] == p.split("/")[1] for h, p, k in rows)


# --- 4 ----------------------------------------------------------------------

PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def brute_pii(text):
    spans = sorted((m.start(), k, m.end(), name) for k, (name, p, ok) in enumerate(PII) for m in re.finditer(p, text or "") if ok(m[0]))
    counts = [sum(s[3] == name for s in spans) for name, _, _ in PII]
    return (*counts, hashlib.sha256(",".join(f"{n}:{a}:{b}" for a, _, b, n in spans).encode()).hexdigest())


def test_pii_equals_brute_force(spark):
    r = random.Random(4)
    pieces = ["a@b.co", "@", ".", "..", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (415) 555-2671", "+", " ", "-", "é", "😀", "7", "_x%y@z-w.org", "0000000000000", "12", "\n", "(", "DE89370400440532013000"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 30))) for _ in range(300)]
    texts += [None, "", "a" * 20_000 + "@", "1" * 20_000, "a@b" + ".c" * 20_000, "+1" + " 2" * 9_999, "1.1.1.1." * 3_000, "x a@b.co, " * 1_300, "1.2.3.4 " * 1_000, *AWKWARD]
    got = pii.digest(docs(spark, texts)).collect()
    assert len(got) == len(texts)
    for row in got:
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone, row.base_sha256) == brute_pii(texts[row.doc_id])


def test_pii_added_kinds_and_context(spark):
    texts = ["pay to iban GB82 WEST 1234 5698 7654 32 now", "GB82WEST12345698765433", "ssn 123-45-6789", "number 123-45-6789", "call +1 415 555 2671 by phone", "x +1 415 555 2671"]
    got = {r.doc_id: r for r in pii.find(docs(spark, texts)).select("doc_id", "pii").collect()}
    kinds = {i: [s.kind for s in r.pii] for i, r in got.items()}
    assert kinds[0][-1] == "iban" or "iban" in kinds[0]
    assert "iban" not in kinds[1] and kinds[2] == ["ssn"] and kinds[3] == []
    assert got[4].pii[0].score > got[5].pii[0].score
    clash = docs(spark, texts).withColumn("__text", F.lit(1)).withColumn("pii", F.lit(2))
    assert pii.find(clash).columns == clash.columns and pii.find(clash).where("size(pii) > 0").count() == 4
    plan = pii.digest(docs(spark, texts))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- 5 ----------------------------------------------------------------------


def brute_top(rows, k=5, every=50):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in good if i % every == 0}:
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_top_k_equals_brute_force(spark):
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=8).astype(np.float32).tolist()) for i in range(150)]
    rows += [(i, rows[0][1]) for i in range(200, 240)] + [(300, None), (350, [1.0, None] * 4), (400, [float("nan")] * 8), (450, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (500, [1.0, 2.0]), (501, [2.0, 1.0]), (502, []), (700, []), (7, rows[7][1]), (550, [1e6] * 8), (551, [-1e6, 1e6] * 4)]
    rows += [(650, [1.0] * 8), (651, [3e6] + [0.0] * 7), (652, [1e7, -1e7, 1.0, 2.0] * 2)]
    frame = spark.createDataFrame([(i, v, 0, "b", 1) for i, v in rows], "vec_id bigint, embedding array<float>, label int, b string, q int")
    for sizes in (dict(), dict(query_bytes=130, step=2)):
        assert sorted(tuple(x) for x in topk.top_k(frame, **sizes).collect()) == brute_top(rows)
    few = frame.where("vec_id IN (0, 1, 2)")
    assert sorted(tuple(x) for x in topk.top_k(few).collect()) == brute_top(rows[:3])
    assert topk.top_k(frame.limit(0)).count() == 0
    huge = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 1.0])], "vec_id bigint, embedding array<float>")
    with pytest.raises(Exception, match="too large for a long"):
        topk.top_k(huge).collect()


def test_top_k_reads_few_exact_vectors():
    r = np.random.default_rng(6)
    vectors = np.floor(256 * r.normal(size=(2000, 16)))
    vectors[7] *= 1e5
    low, width, cells = (np.array(x) for x in zip(*map(topk.approximate, vectors), strict=True))
    query = np.floor(256 * r.normal(size=(1, 16)))
    lower, upper = (x[:, 0] for x in topk.bounds(cells, low, width, query))
    exact = vectors @ query[0]
    assert (lower <= exact).all() and (exact <= upper).all()
    assert (upper >= np.sort(lower)[-5]).sum() < 30


# --- 6 ----------------------------------------------------------------------


def grams(lines, need):
    rows = [(p, x, len(WORD.findall(x))) for p, x in enumerate(lines)]
    rows = [x for x in rows if x[2]]
    for s in range(len(rows)):
        words = 0
        for e in range(s, len(rows)):
            words += rows[e][2]
            if words >= need:
                yield rows[s][0], tuple(x for _, x, _ in rows[s : e + 1])
                break


def line_texts():
    r = random.Random(8)
    lines = [vocabulary_text(i, r.choice([2, 6, 12, 55])) for i in range(60)]
    texts = dict(enumerate(AWKWARD))
    for i in range(20, 90):
        own = [vocabulary_text(1000 * i + k, r.choice([3, 9, 20])) for k in range(r.randint(1, 8))]
        at = r.randrange(len(lines))
        own[r.randint(0, len(own)) : 0] = lines[at : at + r.randint(1, 9)]
        if r.random() < 0.3:
            own.insert(r.randint(0, len(own)), "")
        texts[i] = "\n".join(own)
    texts |= {95: texts[50], 96: texts[50], 97: "\n".join([lines[3] + " tail of its own " + vocabulary_text(3, 40)] * 4)}
    return texts


def test_line_dedup_keeps_the_winnowing_guarantee(spark):
    texts = line_texts()
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    assert got.keys() == texts.keys()
    seen, where = {}, Counter(g for t in texts.values() for _, g in grams((t or "").split("\n"), line_dedup.GRAM))
    for i in sorted(texts):
        before, after = (texts[i] or "").split("\n"), (got[i].text or "").split("\n")
        have, left = Counter(before), Counter(after)
        assert not left - have and got[i].n_lines_cut == len(before) - len(after) * (got[i].text != "" or texts[i] in (None, "")) or got[i].text == ""
        for p, g in grams(before, line_dedup.GRAM + line_dedup.SPAN):
            if seen.setdefault(g, (i, p)) != (i, p):
                assert all(left[x] < have[x] for x in g), (i, p)
        if got[i].n_lines_cut:
            assert any(where[g] > 1 for _, g in grams(before, line_dedup.GRAM))
    assert {x for t in texts.values() for x in (t or "").split("\n") if x} == {x for r in got.values() for x in (r.text or "").split("\n") if x}
    assert got[0].text is None and got[1].text == "" and got[96].text == ""
    assert set(docs(spark, texts).columns) | {"n_lines_cut"} == set(line_dedup.dedup_lines(docs(spark, texts)).columns)


def test_line_dedup_edges(spark):
    assert line_dedup.dedup_lines(docs(spark, AWKWARD).limit(0)).count() == 0
    text = vocabulary_text(1, 60)
    frame = docs(spark, {5: text})
    assert [r.text for r in line_dedup.dedup_lines(frame.unionByName(frame)).collect()] == [text, text]
    got = line_dedup.dedup_lines(docs(spark, {1: text, 2: f"mine\n{text}\n\nalso mine", 3: vocabulary_text(2, 20), 4: vocabulary_text(2, 20)}))
    assert {r.doc_id: r.text for r in got.collect()} == {1: text, 2: "mine\n\nalso mine", 3: vocabulary_text(2, 20), 4: vocabulary_text(2, 20)}
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


# --- 7 ----------------------------------------------------------------------


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    open_, target, left = set(names), {}, share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        target |= {s: float(most * sizes[s]) for s in over}
        left -= sum(most * sizes[s] for s in over)
        open_ -= over
    return target


def mix_input(spark):
    r = random.Random(11)
    texts = {i: vocabulary_text(i, r.choice([0, 1, 3, 10, 200])) for i in range(600)} | {1000: None, 1001: ""}
    sources = {i: r.choice(["a"] * 9 + ["b", "é", "z", "B", None]) for i in texts} | {1000: "empty", 1001: "empty"}
    return texts, sources, docs(spark, texts, sources)


def test_mixing_meets_its_targets(spark):
    texts, sources, frame = mix_input(spark)
    size = {i: len(WORD.findall(t or "")) for i, t in texts.items()}
    by_source = defaultdict(int)
    for i, n in size.items():
        by_source[sources[i]] += n
    target = brute_targets(by_source)
    got = mixing.mix(frame).collect()
    assert len(got) == len(texts)
    taken = defaultdict(int)
    for r in got:
        s = sources[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == by_source[s] and r.taken in (0, r.size, 2 * r.size)
        assert math.isclose(r.target, target[s], rel_tol=1e-9, abs_tol=1e-6)
        taken[s] += r.taken
    largest = max(size.values())
    assert all(abs(target[s] - taken[s]) <= largest / 2 + 1e-6 for s in by_source)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(frame.repartition(7)).collect()))


def test_mixing_splits_repeated_ids(spark):
    rows = [(1, vocabulary_text(i, 10), "a", 1, 2) for i in range(100)] + [(None, vocabulary_text(i, 10), "b", 1, 2) for i in range(100)] + [(3, "same words in all rows", "c", 1, 2)] * 100
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string, __h int, __size int").repartition(5)
    target = brute_targets({"a": 1000, "b": 1000, "c": 500})
    taken = Counter()
    for r in mixing.mix(frame).collect():
        taken[{1: "a", None: "b", 3: "c"}[r.doc_id]] += r.taken
    assert all(abs(target[s] - taken[s]) <= 5 + 1e-6 for s in target)
    assert set(mixing.mix(frame, keep=True).columns) == {*frame.columns, mixing.MIX}


def test_mixing_nests_and_keeps_columns(spark):
    _, _, frame = mix_input(spark)
    small = {r.doc_id: r.taken for r in mixing.mix(frame, share=0.5).collect()}
    large = {r.doc_id: r.taken for r in mixing.mix(frame, share=0.7).collect()}
    assert all(small[i] <= large[i] for i in small)
    kept = mixing.mix(frame, keep=True)
    assert set(kept.columns) == set(frame.columns) | {mixing.MIX}
    assert {r["size"] for r in kept.collect()} == {-1}
    assert mixing.mix(frame.limit(0)).count() == 0


# --- 8 ----------------------------------------------------------------------


def test_bpe_equals_the_library(spark):
    import tiktoken

    path, pattern = registry.vocabulary()
    library = tiktoken.Encoding("x", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    texts = [*AWKWARD, "it's  don't  ''s '\n\n x", "  lead", "trail  ", "\u3000wide\xa0nbsp", "1234 ½ ٣", "<|endoftext|>", "日本語 русский"]
    for size in (bpe.BATCH_TOKENS, 50):
        got = {r.doc_id: r.ids for r in bpe.encode(docs(spark, texts), path, pattern, batch_tokens=size, parts=5).collect()}
        assert got == {i: library.encode_ordinary(t or "") for i, t in enumerate(texts)}
    frame = docs(spark, texts)
    out = {r.doc_id: r for r in bpe.digest(frame.unionByName(frame.where("doc_id = 5")), path, pattern).collect()}
    assert {i: r.decoded_sha256 for i, r in out.items()} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in enumerate(texts)}
    assert bpe.digest(frame.limit(0), path, pattern).count() == 0
    assert bpe.encode(frame.unionByName(frame), path, pattern).count() == 2 * len(texts)


# --- 9 ----------------------------------------------------------------------

TALK = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"),
    (2, 0, "system", "be kind"), (2, 1, "user", "hi"), (2, 2, "assistant", "bye"), (2, 3, "user", "why"), (2, 4, "assistant", ""),
    (3, 0, "system", "be kind"), (3, 1, "user", "hi"), (3, 2, "assistant", "hello"),
    (4, 1, "assistant", None), (4, 0, "user", "### user: x</turn>\n### assistant: \\</turn>"), (5, 0, None, "\\"), (5, 0, "a:b\\", ":"), (5, 0, "a:b\\", ":"),
    (6, 0, "assistant", "😀" * 50), (None, 0, "user", "nobody"), (8, None, "user", "no turn"), (9, 0, "user", LONG),
]


def brute_talk(rows):
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append(((t is not None, t or 0), role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, role, x in turns if role == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("tree", [64, 2, 1])
def test_chat_trees_read_back(spark, tree):
    frame = spark.createDataFrame([(*r, "x", "y") for r in TALK], "conv_id bigint, turn bigint, role string, text string, content string, turns string")
    got = chat.digest(frame, tree).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == brute_talk(TALK)
    assert len(got) == len({r[0] for r in TALK})
    written = {r.conv_id: r.formatted_chars for r in got}
    assert written[1] == sum(len(chat.write_turn(role, text)[0]) for c, _, role, text in TALK if c == 1)
    assert chat.digest(frame.limit(0), tree).count() == 0


def hold_trees(rows, trees):
    """Every turn is written once over all rows, with the position, and attends to the characters, that its path has."""
    nodes = {()} | {tuple((x[2] or "", x[3] or "") for x in rows[: k + 1]) for rows in rows.values() for k in range(len(rows))}
    by_name = {t.tree: t for t in trees}
    assert len(by_name) == len(trees) and sum(len(t.nodes) for t in trees) == len(nodes) - 1
    seen = set()
    for t in trees:
        head = "".join(by_name[a].text for a in t.above)
        assert all(len(by_name[a].nodes) == 1 for a in t.above)
        for node in t.nodes:
            path = head + "".join(t.text[a.start : a.end] for a in node.ancestors)
            assert node.position == len(path) and all(a.end < b.start for a, b in zip(node.ancestors, node.ancestors[1:], strict=False))
            seen.add(tuple(chat.read_turns(path + t.text[node.start : node.end])))
    assert seen == nodes - {()}


@pytest.mark.parametrize("tree", [64, 1])
def test_chat_trees_share_turns_once(spark, tree):
    frame = spark.createDataFrame([r for r in TALK if r[0] in (1, 2, 3)], "conv_id bigint, turn bigint, role string, text string")
    trees = chat.build_trees(chat.conversations(frame), tree).collect()
    assert len(trees) in ((1,) if tree == 64 else (3, 4))
    hold_trees({i: [r for r in TALK if r[0] == i] for i in (1, 2, 3)}, trees)


def test_chat_trees_of_a_hot_first_turn(spark):
    r = random.Random(12)
    rows = [(i, k, "user", x) for i in range(2000) for k, x in enumerate(["be kind", f"q{r.randint(0, 4)}", f"r{r.randint(0, 30)}", f"s{r.randint(0, 300)}"][: r.randint(1, 4)])]
    rows += [(5000, k, "assistant", f"turn {k}") for k in range(1000)]
    trees = chat.build_trees(chat.conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))).collect()
    by_conv = defaultdict(list)
    for row in rows:
        by_conv[row[0]].append(row)
    hold_trees(by_conv, trees)
    assert max(len(t.leaves) for t in trees) <= 4 * chat.TREE and sum(t.text.count("be kind") for t in trees) == 1
    long = next(t for t in trees if len(t.nodes) == 1000)
    assert max(len(n.ancestors) for n in long.nodes) == 1


# --- 10 ---------------------------------------------------------------------


def test_media_round_trip(spark):
    texts = [*AWKWARD, *(vocabulary_text(i, 60) for i in range(20))]
    got = {r.doc_id: r for r in media.digest(docs(spark, texts)).collect()}
    kinds = set()
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        row = got[i]
        assert (row.n_bytes, row.payload_bytes, row.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert row.tail_crc32 == zlib.crc32(payload[-32:])
        kinds.add(row.feature.split(";")[0])
    assert len(kinds) == 3 and got[10].media_sha256 == got[11].media_sha256 and got[10].feature == got[11].feature
    assert media.digest(docs(spark, texts).limit(0)).count() == 0
    full = media.expand(media.store(docs(spark, texts)).withColumn("feature", F.lit("clash")))
    row = full.where("doc_id = 5").first()
    codec, rate, pcm = media.read_wav(row.pcm)
    assert codec == media.PCM and rate == 16000 and f"samples={len(pcm) // 2}" in row.feature


def test_media_are_stored(spark):
    texts = [*AWKWARD, *(vocabulary_text(i, 60) for i in range(20))]
    files = media.stored(docs(spark, texts))
    assert files.inputFiles()
    kept = {r.doc_id: r for r in files.collect()}
    for row in media.measured(files).collect():
        whole = kept[row.doc_id].media
        assert hashlib.sha256(whole).hexdigest() == row.media_sha256 and len(whole) == row.media_bytes
        codec, rate, data = media.read_wav(whole)
        audio = media.resample(media.decode([(codec, data)])[0], rate, 16000)
        got_rate, got = media.unpack_pcm(kept[row.doc_id].packed)
        assert got_rate == 16000 and (got == audio).all()
        x = audio.astype(object)
        turns = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))
        assert row.feature == f"codec={media.NAMES[codec]};rate=16000;samples={len(x)};rms={math.isqrt(sum(x * x) // len(x))};peak={max(map(abs, x))};sign_changes={turns}"


def test_media_pcm_is_packed_without_loss():
    r = np.random.default_rng(8)
    for n in (0, 1, 2, 3, 1000):
        made = [r.integers(-32768, 32768, n), np.cumsum(r.integers(-9, 9, n)), np.full(n, 32767)]
        for table in (media._MULAW, media._ALAW):
            made += [x := table[r.integers(0, 256, n)], media.resample(x, 8000, 16000)]
        for samples in made:
            samples = samples.astype(np.int16)
            rate, got = media.unpack_pcm(media.pack_pcm(samples, 11025))
            assert rate == 11025 and (got == samples).all() and got.dtype == np.int16
    for bad in (b"", b"RPCM", media.pack_pcm(np.zeros(9, np.int16), 8000)[:-2], media.pack_pcm(np.arange(9, dtype=np.int16), 8000)[:-2]):
        with pytest.raises(ValueError):
            media.unpack_pcm(bad)


def test_media_decoders_equal_plain_ones():
    # Known values of both companding tables.
    assert [int(media._MULAW[x]) for x in (0x00, 0x7F, 0x80, 0xFF)] == [-32124, 0, 32124, 0]
    assert [int(media._ALAW[x]) for x in (0x55, 0xD5, 0x2A, 0xAA)] == [-8, 8, -32256, 32256]
    r = np.random.default_rng(7)
    payload = r.integers(0, 256, media.BLOCK * 3, dtype=np.uint8).tobytes()
    _, _, data = media.read_wav(media.write_wav(payload, media.ADPCM))
    assert media.payload_of(media.ADPCM, data) == payload
    got = media.decode([(media.ADPCM, data), (media.MULAW, payload), (media.ADPCM, data)])
    want = []
    for b in range(3):
        value = index = 0
        want.append(0)
        for byte in payload[b * media.BLOCK : (b + 1) * media.BLOCK]:
            for nibble in (byte & 15, byte >> 4):
                step = int(media._STEPS[index])
                change = step >> 3
                for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                    change += part if nibble & bit else 0
                value = max(-32768, min(32767, value - change if nibble & 8 else value + change))
                index = max(0, min(88, index + int(media._INDEX[nibble])))
                want.append(value)
    assert got[0].tolist() == want == got[2].tolist() and len(got[1]) == len(payload)
    assert media.resample(np.array([0, 10, 20], np.int16), 8000, 16000).tolist() == [0, 5, 10, 15, 20, 20]
    assert media.resample(np.array([0, 10, 20, 30], np.int16), 16000, 8000).tolist() == [0, 20]
    assert media.resample(np.array([0, 30], np.int16), 8000, 24000).tolist() == [0, 10, 20, 30, 30, 30]
    for bad in (b"", b"RIFF0000WAVE", b"x" * 60):
        with pytest.raises(ValueError):
            media.read_wav(bad)


# --- whole tables -----------------------------------------------------------


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, data, name):
    assert rows_of_spark(registry.queries()[name](spark, data)) == rows_of_duckdb(registry.oracle_sql()[name], data)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_returns_a_row_an_input_row(spark, data, name):
    table = {"op3_html_text": "pages"}.get(name, "documents")
    n = spark.read.parquet(f"{data}/{table}.parquet").count()
    if name == "op9_chat_trees":
        n = spark.read.parquet(f"{data}/conversations.parquet").select("conv_id").distinct().count() + 1
    assert registry.queries()[name](spark, data).count() == n
