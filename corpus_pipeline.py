"""Documents to training tokens: toxicity, line deduplication, near duplicates, mixing, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet and
reads it again for the next. All but the last return the columns of documents. A stage begins by deleting what
earlier ones staged, but for what its input still reads: a stage's result is to be written before the next stage begins.
What the caller's own calls of the operators have staged is left alone.

Whatever columns the documents have besides doc_id, text and source stay, whatever their names but those that start
with two underscores. An empty table gives no rows at any stage. A null or empty text passes all stages: it is scored
as an empty one, has no lines to cut, is in no group, has size 0 and so is taken no more often than its source's hash
says, and has no tokens. Of rows with the same id and text, line deduplication keeps all alike, the next stage
keeps one; rows of one id with other texts are told apart by a hash of the text. Very long texts are one task's work
at each stage, as the operators' docstrings say.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm import bpe, line_dedup, mixing, near_dup, toxicity
from ledgerflow.llm.common import WORD, Scope, scope, staged, table
from ledgerflow.llm.registry import vocabulary


#: What the stages before have staged.
_earlier: list[Scope] = []


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``f``, which begins by freeing what the stages before have staged and owns what it stages itself."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for before in _earlier:
            before.free(docs)
        _earlier[:] = [x for x in _earlier if x.folders]
        with scope() as own:
            _earlier.append(own)
            return f(spark, docs, sf_dir)

    return run


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the limit; a null text is scored as an empty one."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score(model)(F.coalesce("text", F.lit(""))) < toxicity.REJECT)


@_stage
def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs are cut; a document that was nothing else goes, and n_chars follows the text."""
    cut = line_dedup.dedup_lines(docs)
    kept = cut.where((F.col("n_lines_cut") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("n_lines_cut") == 0, F.col("n_chars")).otherwise(F.length("text").cast("bigint")))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


@_stage
def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: that of the least id, null last, then of the least text hash.
    Texts without words are in no group and all stay."""
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("bigint").alias("id"), F.col("text_hash").alias("hash"))
    found = near_dup.groups(docs).where("group IS NOT NULL")
    first = staged(found.groupBy("group").agg(F.min(rank).alias("first")))
    kept = staged(found.join(first.withColumnRenamed("group", "g"), F.col("group") == F.col("g")).where(rank.eqNullSafe(F.col("first"))).groupBy("first").agg(F.count("*").alias("rows")))
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("first.id")) & (near_dup.text_hash() == F.col("first.hash"))
    single = docs.join(kept.where("rows = 1"), same, "left_semi")
    empty = docs.where(~F.coalesce(F.col("text").rlike(WORD), F.lit(False)))
    # Rows alike in id and text: any of them.
    alike = docs.join(kept.where("rows > 1"), same, "left_semi").withColumn("__hash", near_dup.text_hash()).dropDuplicates(["doc_id", "__hash"]).drop("__hash")
    return single.unionByName(alike).unionByName(empty)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: never, once or twice."""
    mixed = mixing.mix(docs, keep=True)
    copies = F.explode(F.sequence(F.lit(1), F.col(f"{mixing.MIX}.copies")))
    return mixed.where(F.col(f"{mixing.MIX}.copies") > 0).select(*(F.col(f"`{c}`") for c in docs.columns), copies.alias(mixing.MIX)).drop(mixing.MIX)


@_stage
def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of each document's token ids, and of the bytes they decode to."""
    return bpe.digest(docs, *vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_repeated_lines),
    ("near_duplicates", keep_one_of_each),
    ("mixing", mix_sources),
    ("byte_bpe", encode_tokens),
]

#: SQL can express neither the classifier nor the vocabulary's merges; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scope() as own:
            docs = staged(stage(spark, docs, sf_dir))
        _earlier.append(own)
    return STAGES[-1][1](spark, docs, sf_dir)
