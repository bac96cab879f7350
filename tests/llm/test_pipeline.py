import re
from collections import Counter

import corpus_pipeline
from ledgerflow.llm import line_dedup, toxicity
from ledgerflow.llm.common import table
from tests.llm.test_operators import AWKWARD, DOCS, WORD, brute_components, brute_targets, docs, vocabulary_text


def apply(spark, data, name, frame):
    return dict(corpus_pipeline.STAGES)[name](spark, frame, data)


def test_stages_keep_columns_and_survive_anything(spark, data):
    frame = docs(spark, AWKWARD)
    frame = frame.unionByName(frame.where("doc_id < 6")).unionByName(spark.createDataFrame([(None, "no id", None, None, None, None, None, None, None)] * 2, DOCS))
    for source in (frame, frame.limit(0)):
        for name, _ in corpus_pipeline.STAGES[:-1]:
            out = apply(spark, data, name, source)
            assert out.columns == frame.columns
            assert out.count() <= 2 * frame.count()
        assert apply(spark, data, "byte_bpe", source).count() == source.count()


def test_toxic_documents_go(spark, data):
    documents, labels = table(spark, data, "documents"), table(spark, data, "labels")
    model = toxicity.train(documents, labels)
    scores = {r[0]: r[1] for r in documents.select("doc_id", toxicity.score(model)("text").alias("s")).collect()}
    kept = {r.doc_id for r in apply(spark, data, "toxicity", documents).collect()}
    assert kept == {i for i, s in scores.items() if s < toxicity.REJECT}
    clean = {r.doc_id for r in labels.where("toxic = 0").collect()}
    assert len(clean - kept) <= 0.02 * len(clean)


def test_one_of_each_group_stays(spark, data):
    base = vocabulary_text(5, 100)
    texts = {1: base, 2: base + " more", 3: "else entirely", 4: base.upper(), 5: "", 6: None}
    kept = {r.doc_id for r in apply(spark, data, "near_duplicates", docs(spark, texts)).collect()}
    assert kept == {i for i, (_, c) in brute_components(texts).items() if c == i}
    frame = docs(spark, texts)
    assert apply(spark, data, "near_duplicates", frame.unionByName(frame)).count() == len(kept) + 2  # 5 and 6 are in no group


def test_rows_of_one_id_are_told_apart(spark, data):
    u, v, t = vocabulary_text(1, 50), vocabulary_text(2, 50), vocabulary_text(3, 80)
    rows = [(5, u), (5, v), (3, t), (5, t + " more"), (None, u + " also"), (None, vocabulary_text(4, 30)), (None, vocabulary_text(4, 30))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = apply(spark, data, "near_duplicates", frame).collect()
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, [rows[0], rows[1], rows[2], rows[5]]))


def test_lines_are_cut_and_empty_documents_go(spark, data):
    text = vocabulary_text(6, 80)
    got = {r.doc_id: r for r in apply(spark, data, "line_dedup", docs(spark, {1: text, 2: text, 3: f"own line\n{text}", 4: "", 5: None})).collect()}
    assert set(got) == {1, 3, 4, 5} and got[3].text == "own line" and got[3].n_chars == 8 and got[1].n_chars == len(text)


def test_run_equals_brute_force_of_its_counts(spark, data):
    """Every stage by plain Python but for scores and cut lines, which have tests of their own."""
    documents = table(spark, data, "documents")
    kept = apply(spark, data, "toxicity", documents)
    cut = line_dedup.dedup_lines(kept).collect()
    texts = {r.doc_id: r.text for r in cut if r.n_lines_cut == 0 or WORD.search(r.text)}
    source = {r.doc_id: r.source for r in cut}
    single = {i for i, (_, c) in brute_components(texts).items() if c == i}
    size = {i: len(WORD.findall(texts[i] or "")) for i in single}
    sizes = Counter()
    for i, n in size.items():
        sizes[source[i]] += n
    got = Counter(r.doc_id for r in corpus_pipeline.run(spark, data).collect())
    assert set(got) <= single and max(got.values()) <= 2
    taken = Counter()
    for i, n in got.items():
        taken[source[i]] += n * size[i]
    largest = max(size.values())
    assert all(abs(t - taken[s]) <= largest / 2 + 1e-6 for s, t in brute_targets(sizes).items())
    assert re.fullmatch("[0-9a-f]{64}", corpus_pipeline.run(spark, data).first().ids_sha256)
