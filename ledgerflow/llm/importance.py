"""Importance resampling towards a target distribution, over hashed runs of one to three words.

A text's features are all runs of up to ``ORDER`` consecutive words, repeats counted; a feature's bucket is its CRC-32 modulo
``BUCKETS``. Each bucket has a gain: how much likelier a feature of the target falls into it than one of the
documents. A document's weight is the sum of its features' gains; with a Gumbel variable that follows from its id added, the
highest scores are a draw without replacement by weight.

1. Count. A task cuts its rows into slices of ``SLICE`` words and builds a trie of the words of each: an edge is a word, a
   node a run of words, with its number of occurrences and its CRC-32, which follows from the parent's and the word's.
   Tries are arrays, one level after the other, so numpy builds a level at once. A slice's trie goes once its counts are
   added to the task's ``BUCKETS`` totals; those are summed by Spark, at most ``BUCKETS`` rows a task, whatever the texts.
2. Score. The same tries again, with each node's gain attached; every document walks its paths and adds the gains up.
   The gains, a fixed ``BUCKETS`` numbers, go with the tasks.
3. Draw. Rows are ranked by ranges (``common.ranked``), so no task sorts them all.

Defined results: a null or empty text, or one without words, has no features and weight 0; it is scored but not drawn. A null
id counts as an empty one in the hash. Repeated rows are scored and drawn each by itself; equal scores go to the smaller id,
null first. A long text is cut into slices as well, which share two words, so memory beyond its bytes (some ten times) doesn't
grow with it. Empty tables: no rows; without a target or documents, its counts are 0. Only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import arrow_rows, ranked, staged

BUCKETS, ORDER = 10_000, 3
SEED, LEAST_WORDS, PERCENT = 42, 20, 5
#: Words of a trie.
SLICE = 1 << 19

#: What each byte is read as: a letter or digit in lower case, anything beyond ASCII as it is, else no part of a word.
_BYTES = np.array([b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 0 for b in range(256)], np.uint8)
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _crc_table() -> np.ndarray:
    """What one byte of zeros does to each last byte of a CRC-32."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


def _through(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][(crc >> 8) & 255] ^ tables[2][(crc >> 16) & 255] ^ tables[3][crc >> 24]


def _shifts(most: int) -> list[np.ndarray]:
    """Tables that take CRCs past 1, 2, 4, ... bytes, up to ``most``."""
    one, step = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)]), _crc_table()
    out = [step[one & 255] ^ (one >> 8)]
    while 1 << len(out) <= most:
        out.append(_through(out[-1], out[-1]))
    return out


def extended(parents: np.ndarray, words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of joined strings, from those of their two parts and the second part's length."""
    crc = parents
    for k, tables in enumerate(_shifts(int(lengths.max(initial=1)))):
        crc = np.where((lengths >> k) & 1, _through(tables, crc), crc)
    return crc ^ words


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of the texts, where in the bytes none is read, as one array, with each one's text, and each text's number of words."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32 if texts.type == pa.string() else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = _BYTES[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]] if data is not None else np.empty(0, np.uint8)
    inside = np.zeros(len(raw) + 1, bool)
    np.not_equal(raw, 0, out=inside[:-1])
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    last = inside[:-1] & ~inside[1:]
    cut = offsets[1:-1] - offsets[0]  # a word ends with its text
    cut = cut[(cut > 0) & (cut < len(raw))]
    begins[cut], last[cut - 1] = inside[cut], inside[cut - 1]
    starts = np.flatnonzero(begins)
    ends = np.concatenate([[0], np.cumsum(np.flatnonzero(last) + 1 - starts)])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(raw[inside[:-1]])])
    bounds = np.searchsorted(starts, offsets - offsets[0])
    number = np.diff(bounds)
    return words, np.repeat(np.arange(len(texts)), number), number


class Trie:
    """The trie of some consecutive words; ``texts`` says which text each is of. Level k has the runs of k + 1 words.

    ``nodes[k][i]`` is the run that begins at word ``starts[k][i]``; ``crcs[k]`` and ``counts[k]`` are by node. Runs begin at
    the first ``own`` words only; those behind lend the ends of their runs."""

    def __init__(self, words: pa.Array, texts: np.ndarray, own: int):
        coded = words.dictionary_encode()
        edges, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        first = np.fromiter(map(zlib.crc32, names), np.uint32, len(names))
        later = np.fromiter((zlib.crc32(b" " + x) for x in names), np.uint32, len(names))
        lengths = np.fromiter(map(len, names), np.int64, len(names)) + 1
        at = np.arange(own)
        self.starts, self.nodes, self.crcs = [at], [edges[:own]], [first]
        for k in range(1, ORDER):
            at, above = self.starts[-1], self.nodes[-1]
            goes_on = at + k < len(texts)
            goes_on[goes_on] = texts[at[goes_on]] == texts[at[goes_on] + k]
            at = at[goes_on]
            found = pa.array(above[goes_on].astype(np.int64) * len(names) + edges[at + k]).dictionary_encode()
            key = found.dictionary.to_numpy()
            parent, edge = np.divmod(key, max(1, len(names)))
            self.starts.append(at)
            self.nodes.append(found.indices.to_numpy())
            self.crcs.append(extended(self.crcs[-1][parent], later[edge], lengths[edge]))
        self.counts = [np.bincount(n, minlength=len(c)) for n, c in zip(self.nodes, self.crcs, strict=True)]


def tries(texts: pa.Array) -> Iterator[tuple[Trie, np.ndarray]]:
    """Tries over all words of the texts, each with the texts of the words that its runs begin at."""
    words, of, _ = words_of(texts)
    for a in range(0, len(words), SLICE):
        b = min(a + SLICE, len(words))
        end = min(b + ORDER - 1, len(words))
        yield Trie(words[a:end], of[a:end], b - a), of[a:b]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for trie, _ in tries(batch.column(0)):
            for crcs, counts in zip(trie.crcs, trie.counts, strict=True):
                np.add.at(totals, crcs % BUCKETS, counts)
    there = np.flatnonzero(totals)
    yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(totals[there])], names=["bucket", "n"])


def bucket_totals(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    with arrow_rows(df.sparkSession, 1000):
        rows = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(_count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    totals = np.zeros(BUCKETS, np.int64)
    for row in rows:  # BUCKETS at most
        totals[row.bucket] = row.n
    return totals


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain, in thousandths, rounded down."""
    ours, theirs = (float(x.sum()) + BUCKETS for x in (documents, target))
    return np.floor(1000 * np.log((target + 1.0) * ours / ((documents + 1.0) * theirs))).astype(np.int64)


def _weigh(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            weight, features = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for trie, of in tries(texts):
                for starts, nodes, crcs in zip(trie.starts, trie.nodes, trie.crcs, strict=True):
                    # Runs of one text stand together: a text's sum is a difference of running ones.
                    walked = np.concatenate([[0], np.cumsum(gain[crcs % BUCKETS][nodes])])
                    texts_here, begin = np.unique(of[starts], return_index=True)
                    ends = np.append(begin[1:], len(starts))
                    weight[texts_here] += walked[ends] - walked[begin]
                    features[texts_here] += ends - begin
            _, _, words = words_of(texts)
            columns = [*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(words), pa.array(features), pa.array(weight)]
            yield pa.RecordBatch.from_arrays(columns, names=[*(c for c in batch.schema.names if c != "text"), "n_words", "n_features", "weight"])

    return run


def luck(id_: Column, seed: int = SEED) -> Column:
    """A Gumbel variable in thousandths, rounded down, that follows from the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def weighted(df: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight, score) of each document."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    with arrow_rows(df.sparkSession, 1000):
        found = rows.mapInArrow(_weigh(gain), f"id {dict(rows.dtypes)['id']}, n_words bigint, n_features bigint, weight bigint")
    return found.withColumn("score", F.col("weight") + luck(F.col("id")))


def resample(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): the draw of ``percent`` of the documents with ``least_words`` ranked from 1, others null."""
    found = staged(weighted(df, gains(bucket_totals(df, text_col), bucket_totals(target, target_col)), id_col, text_col))
    # Those that can't be drawn are ranked too, in a tree of their own.
    found = found.withColumn("tree", F.when(F.col("n_words") >= least_words, "drawn").otherwise("never"))
    placed = ranked(found, "tree", F.col("score").desc(), F.col("id").asc_nulls_first())
    rank = F.when((F.col("tree") == "drawn") & (F.col("pos") < F.floor(F.col("n") * percent / 100)), F.col("pos") + 1)
    return placed.select(F.col("id").alias(id_col), "n_features", "weight", "score", rank.cast("bigint").alias("rank"))


def resample_sql(documents: str = "documents", target: str = "benchmark") -> str:
    """DuckDB SQL for resample(); CRC-32 is a fold over each distinct feature's bytes."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = lambda t: f"list_filter(regexp_extract_all(translate(coalesce({t}, ''), '{upper}', '{upper.lower()}'), '{WORD}'), lambda x: x <> '')"
    runs = lambda w: f"list_concat({w}, list_concat(list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]), list_transform(range(1, len({w}) - 1), lambda i: {w}[i] || ' ' || {w}[i + 1] || ' ' || {w}[i + 2])))"
    byte = "CAST('0x' || hex(encode(f))[2 * i + 1 : 2 * i + 2] AS BIGINT)"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(strlen(f)), lambda i: {byte})), lambda a, b: xor(a >> 8, t[xor(a, b) % 256 + 1])), 4294967295)"
    bit = "list_reduce([CAST(k AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"
    h = f"CAST('0x' || sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT)"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {words("text")} AS w FROM {documents}), items AS (SELECT {words("text")} AS w FROM {target}),
f AS (SELECT r, unnest({runs("w")}) AS f FROM docs), own AS (SELECT r, f, count(*) AS n FROM f GROUP BY r, f), wanted AS (SELECT f, count(*) AS n FROM (SELECT unnest({runs("w")}) AS f FROM items) GROUP BY f),
crc AS (SELECT list({bit} ORDER BY k) AS t FROM range(256) x(k)),
every AS (SELECT f, {crc} % {BUCKETS} AS bucket FROM (SELECT f FROM own UNION SELECT f FROM wanted), crc),
ours AS (SELECT bucket, sum(n) AS s FROM own JOIN every USING (f) GROUP BY bucket), theirs AS (SELECT bucket, sum(n) AS t FROM wanted JOIN every USING (f) GROUP BY bucket),
sums AS (SELECT (SELECT coalesce(sum(s), 0) FROM ours) AS big_s, (SELECT coalesce(sum(t), 0) FROM theirs) AS big_t),
gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(big_s + {BUCKETS} AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(big_t + {BUCKETS} AS DOUBLE)))) AS BIGINT) AS g FROM ours LEFT JOIN theirs USING (bucket), sums),
weights AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * g) AS BIGINT) AS weight FROM own JOIN every USING (f) JOIN gain USING (bucket) GROUP BY r),
scored AS (SELECT doc_id, len(w) >= {LEAST_WORDS} AS drawn, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(({h} + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM docs LEFT JOIN weights USING (r)),
placed AS (SELECT *, row_number() OVER (PARTITION BY drawn ORDER BY score DESC, doc_id NULLS FIRST) AS p, count(*) OVER (PARTITION BY drawn) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN drawn AND p <= {PERCENT} * n // 100 THEN p END AS rank FROM placed"""
