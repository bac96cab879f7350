"""A stream's batches written once each, however often they are delivered.

A batch has a folder of its own, which a retry writes over, and a mark in the ledger, which is set when the folder is whole. What
has its mark is skipped; readers see batches with a mark only. So a try that broke off leaves nothing behind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _there(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def write_once(path: str, shape: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: ``shape`` of each batch goes under ``path``, which every executor must see."""

    def put(batch: DataFrame, number: int) -> None:
        spark, mark = batch.sparkSession, f"{path}/ledger/number={number}"
        if _there(spark, f"{mark}/_SUCCESS"):
            return
        shape(batch).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        spark.range(1).select(F.col("id").alias("batch_mark")).write.mode("overwrite").parquet(mark)

    return put


def written(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The rows of all batches that are whole."""
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    if not _there(spark, f"{path}/ledger"):
        return spark.createDataFrame([], kind)
    marks = spark.read.parquet(f"{path}/ledger").select(F.col("number").alias("__number")).distinct()
    rows = spark.read.schema(T.StructType([*kind.fields, T.StructField("batch", T.LongType())])).parquet(f"{path}/rows")
    return rows.join(marks, F.col("batch") == F.col("__number"), "left_semi").drop("batch")
