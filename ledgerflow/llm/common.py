"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word, as every operator here counts words: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, or on a local master one of our own where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is unset: executors and driver need a folder that all of them see")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


class Scope:
    """The folders that were staged while it was the innermost open scope; free() deletes no others."""

    def __init__(self) -> None:
        self.folders: list[str] = []

    def free(self, docs: DataFrame) -> None:
        """Delete the folders, but for those that ``docs`` reads."""
        needed = docs.inputFiles()
        for path in list(self.folders):
            if not any(path.rsplit("/", 1)[1] in file for file in needed):
                self.folders.remove(path)
                _drop(docs.sparkSession, path)


_open: list[Scope] = []


@contextmanager
def scope() -> Iterator[Scope]:
    """What is staged inside belongs to the scope given. What is staged outside all scopes stays until the driver's Python ends."""
    own = Scope()
    _open.append(own)
    try:
        yield own
    finally:
        _open.remove(own)


def _own(spark: SparkSession, path: str) -> None:
    atexit.register(_drop, spark, path)
    if _open:
        _open[-1].folders.append(path)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        if jvm is not None:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session has ended already
        pass


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is planned inside moves at most so many rows an Arrow batch: by Spark's own limit of 10,000, some hundred
    documents of unusual length make the JVM and its Python workers hold several times their share."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def staged(df: DataFrame, bucket_by: str | None = None, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor
    costs a re-read only. Parquet rather than checkpoint(), which computes its input twice and
    writes it uncompressed. With ``bucket_by``, a later grouping by that column needs no shuffle;
    without it, ``options`` are the writer's. The folder goes with its scope, or when the driver's Python ends."""
    spark = df.sparkSession
    name = f"staged_{uuid.uuid4().hex}"
    path = f"{shared_root(spark)}/{name}"
    _own(spark, path)
    if bucket_by is None:
        df.write.options(**options).parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), bucket_by).option("path", path).saveAsTable(name)
    back = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the entry only: the files stay, and the frame knows their buckets
    return back


def appended(spark: SparkSession, schema: str, frames: Iterable[DataFrame]) -> DataFrame:
    """All frames, written one after the other to one staged folder and read back."""
    path = f"{shared_root(spark)}/staged_{uuid.uuid4().hex}"
    _own(spark, path)
    spark.createDataFrame([], schema).write.parquet(path)
    for frame in frames:
        frame.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def text_of(column: str = "text"):
    """The text, null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def ranked(df: DataFrame, tree: str, *order: Column) -> DataFrame:
    """Every row of ``df``, a staged frame, with its place ``pos`` (from 0) among the ``n`` rows of its ``tree``, in order;
    rows that tie come as they were written.

    Rows are dealt out by range, hot trees and equal rows too, and sorted where they are. A place is then a row's own
    distance from its part's first row and the sum of the parts before: one small row a part and tree."""
    keys = [F.col(tree).asc_nulls_first(), *order, F.col("__rid").asc()]
    dealt = df.withColumn("__rid", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = staged(dealt.drop("__rid").withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33)))
    parts = dealt.groupBy("__part", F.col(tree).alias("__tree")).agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    same = Window.partitionBy("__tree")
    before = F.coalesce(F.sum("__rows").over(same.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = staged(parts.select(F.col("__part").alias("__p"), "__tree", (before - F.col("__first")).alias("__shift"), F.sum("__rows").over(same).alias("n")))
    met = dealt.join(parts, (F.col("__part") == F.col("__p")) & F.col(tree).eqNullSafe(F.col("__tree")))
    return met.select(*df.columns, (F.col("__at") + F.col("__shift")).alias("pos"), "n")
