"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text is lower-cased, its white space made single spaces, and padded, so that n-grams see where
words begin and end. N-grams of 3 to 8 code points are hashed to 2**20 features. A feature's value
is (1 + ln count) times its log-count ratio between the classes; the features that tell the
classes apart best are kept and weighed by logistic regression.

Training reads a bounded sample of labelled rows: one row an id, of at most ``TOXIC`` and ``CLEAN`` ids,
in order of a hash of the ids. Toxic rows weigh ``WEIGHT`` times as much, as they are the rarer. Scoring
reads every whole text and needs the kept features only, which are a table of fixed size (``KEPT``),
whatever the input.

Defined results: a null or empty text is scored as a text without features, from the bias alone;
unlabelled ids, null ids and null labels don't train; of labels that contradict one another the toxic one
counts; of rows that repeat an id the one whose text has the least hash trains, and all are scored; without
labels of both classes every score is 0; an empty table gives no rows. A very long text is hashed in pieces:
a task holds the text itself and some 100 MB. Only doc_id, text and toxic are read, whatever other columns
there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ledgerflow.llm.common import staged

BITS = 20
SHORTEST, LONGEST = 3, 8
KEPT = 1 << 13
#: How much more a toxic row weighs, and the penalty of the regression.
WEIGHT, RIDGE = 3.0, 10.0
#: The most labelled rows of either class that training reads.
TOXIC, CLEAN = 2_000, 4_000
REJECT = 0.7

# Odd multipliers of the hash.
_R, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Code points hashed at once; a longer text is read in pieces that overlap by LONGEST - 1.
_PIECE = 1 << 20
_SPACE = re.compile(r"\s+")


def hashes(text: str) -> Iterator[np.ndarray]:
    """The features of all n-grams of a text, in blocks."""
    padded = " " + _SPACE.sub(" ", text.lower()).strip() + " "
    if not padded.strip():
        return
    for at in range(0, len(padded), _PIECE):
        codes = np.frombuffer(padded[at : at + _PIECE + LONGEST - 1].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        piece = (codes.astype(np.uint64) + np.uint64(1)) * _M
        h = piece
        for n in range(2, min(LONGEST, len(piece)) + 1):
            h = h[:-1] * _R + piece[n - 1 :]
            if n >= SHORTEST:
                # N-grams that start in the overlap belong to the next piece.
                own = h[:_PIECE]
                yield (((own ^ (own >> np.uint64(29))) * _M) >> np.uint64(64 - BITS)).astype(np.int32)


def met_by(text: str) -> np.ndarray:
    """The distinct features of a text."""
    found: list[np.ndarray] = []
    for block in hashes(text):
        found.append(block)
        if sum(map(len, found)) > 8 * _PIECE:
            found = [np.unique(np.concatenate(found))]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


@dataclass
class Model:
    features: np.ndarray
    weights: np.ndarray  # times the log-count ratios
    bias: float

    def scorer(self):
        """A function from text to score. Its table is built once a task."""
        place = np.full(1 << BITS, -1, dtype=np.int32)
        place[self.features] = np.arange(len(self.features), dtype=np.int32)

        def score(text: str | None) -> float:
            if not len(self.features):
                return 0.0
            counts = np.zeros(len(self.features), dtype=np.int64)
            for block in hashes(text or ""):
                hits = place[block]
                counts += np.bincount(hits[hits >= 0], minlength=len(counts))
            met = np.flatnonzero(counts)
            z = self.bias + float(np.dot(self.weights[met], 1 + np.log(counts[met])))
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return score


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def sample(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN) -> DataFrame:
    """(text, toxic) of the labelled rows to train on, at most toxic + clean."""
    usable = labels.select("doc_id", "toxic").where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    chosen = usable.where("toxic = 1").orderBy(order).limit(toxic).unionByName(usable.where("toxic = 0").orderBy(order).limit(clean))
    # At most toxic + clean rows of two numbers are broadcast; an id may have any number of rows.
    text = F.coalesce("text", F.lit("")).alias("text")
    met = docs.select("doc_id", text).join(F.broadcast(chosen), "doc_id")
    return staged(met.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic"))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of either class each feature occurs; -1 counts the texts."""
    found = np.zeros((2, 1 << BITS), dtype=np.int64)
    texts = np.zeros(2, dtype=np.int64)
    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            found[label][met_by(text.as_py())] += 1
            texts[label] += 1
    met = np.flatnonzero(found.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(np.append(met, -1)), *(pa.array(np.append(found[k][met], texts[k])) for k in (0, 1))], names=["feature", "clean", "toxic"])


def _fit(rows: np.ndarray, features: np.ndarray, values: np.ndarray, labels: np.ndarray, kept: int, rounds: int = 300, ridge: float = RIDGE, weight: float = WEIGHT) -> tuple[np.ndarray, float]:
    """Logistic regression by AdaGrad over the whole sample."""
    weights, squares = np.zeros(kept), np.full(kept, 1e-8)
    bias, square = float(np.log(max(labels.sum(), 1) / max((1 - labels).sum(), 1))), 1e-8
    cost = np.where(labels == 1, weight, 1.0)
    for _ in range(rounds):
        z = bias + np.bincount(rows, weights=values * weights[features], minlength=len(labels))
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * cost
        slope = np.bincount(features, weights=values * error[rows], minlength=kept) + ridge * weights
        squares += slope * slope
        weights -= 0.05 * slope / np.sqrt(squares)
        square += error.sum() ** 2
        bias -= 0.5 * error.sum() / np.sqrt(square)
    return weights, bias


def train(docs: DataFrame, labels: DataFrame, kept: int = KEPT, toxic: int = TOXIC, clean: int = CLEAN) -> Model:
    """Counts and log-count ratios come from a Spark aggregation; what the driver gets is bounded by
    ``kept`` features and the sample's rows of them."""
    rows = sample(docs, labels, toxic, clean).repartition(8)
    counts = rows.mapInArrow(_count, "feature bigint, clean bigint, toxic bigint").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = staged(counts)
    texts = counts.where("feature = -1").first()
    none = Model(np.zeros(0, np.int64), np.zeros(0), -30.0)
    if texts is None or not texts["clean"] or not texts["toxic"]:
        return none
    p, q = (F.col("toxic") + 0.5) / (texts["toxic"] + 1), (F.col("clean") + 0.5) / (texts["clean"] + 1)
    share = (F.col("toxic") + F.col("clean") + 1) / (texts["toxic"] + texts["clean"] + 2)
    apart = (p - q) * (p - q) / (share * (1 - share))
    best = counts.where("feature >= 0 AND clean + toxic >= 3").select("feature", F.log(p / q).alias("ratio"), apart.alias("apart"))
    best = best.orderBy(F.desc("apart"), "feature").limit(kept).toPandas().sort_values("feature")
    if not len(best):
        return none
    features, ratios = best["feature"].to_numpy(), best["ratio"].to_numpy()

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << BITS, -1, dtype=np.int32)
        place[features] = np.arange(len(features), dtype=np.int32)
        for batch in batches:
            at, counted = [], []
            for text in batch.column(0):
                counts = np.zeros(len(features), dtype=np.int64)
                for block in hashes(text.as_py()):
                    hits = place[block]
                    counts += np.bincount(hits[hits >= 0], minlength=len(counts))
                met = np.flatnonzero(counts)
                at.append(met.astype(np.int32).tobytes())
                counted.append(counts[met].astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.binary()), pa.array(counted, pa.binary()), batch.column(1).cast(pa.int32())], names=["at", "n", "toxic"])

    seen = rows.mapInArrow(values, "at binary, n binary, toxic int").toPandas()
    # A fixed order, so that reruns agree to the last bit.
    seen = seen.sort_values(["at", "n", "toxic"], ignore_index=True)
    at = [np.frombuffer(x, np.int32) for x in seen["at"]]
    met = np.concatenate(at)
    counted = np.concatenate([np.frombuffer(x, np.int32) for x in seen["n"]])
    which = np.repeat(np.arange(len(at)), [len(x) for x in at])
    weights, bias = _fit(which, met, (1 + np.log(counted)) * ratios[met], seen["toxic"].to_numpy(dtype=np.float64), len(features))
    return Model(features, weights * ratios, float(bias))


def score(model: Model) -> Column:
    """A function of a text column: its score from 0 to 1."""

    @pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = model.scorer()
        for batch in texts:
            yield pd.Series([of(x) for x in batch], dtype="float64")

    return scored


def digest(docs: DataFrame, labels: DataFrame, reject: float = REJECT) -> DataFrame:
    scored = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), score(train(docs, labels))(F.coalesce("text", F.lit(""))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= reject).cast("int"))
