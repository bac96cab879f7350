"""Entity logs as a Spark data source: ``spark.read.format("entity_log")`` and ``spark.readStream.format("entity_log")``.

Options: ``path``, the store's folder, and ``entity``. Columns are the entity's, the mutation's number ``__seq`` and
``__deleted``. A batch read takes a task a file, skips files by their footers' least and greatest numbers, and filters rows as they are
read: comparisons of numbers and strings are pushed down. A stream reads mutations in order of their number, and what it has
read is a number: a batch is whole mutations, however many files they were written to, and files that are rewritten with
the same numbers are not read twice.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerflow.schema import ENTITIES, MUTATION

_TESTS = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}


def _expression(f: Filter, kinds: dict[str, T.DataType]) -> pc.Expression | None:
    """The filter for the file reader, None if it can't be pushed down."""
    if not isinstance(f, (*_TESTS, In, IsNotNull)) or len(f.attribute) != 1 or not isinstance(kinds.get(f.attribute[0]), (T.StringType, T.LongType, T.IntegerType, T.BooleanType)):
        return None
    column = pc.field(f.attribute[0])
    if isinstance(f, IsNotNull):
        return column.is_valid()
    return column.isin(list(f.value)) if isinstance(f, In) else _TESTS[type(f)](column, pc.scalar(f.value))


@dataclass
class File(InputPartition):
    """Rows of a file that pass the filters and, of a stream, whose numbers are above ``after`` and up to ``until``."""

    path: str
    after: int | None = None
    until: int | None = None


class _Log:
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.filters = schema, []
        self.root = f"{options['path'].rstrip('/')}/{options['entity']}"

    def files(self) -> list[tuple[str, int, int]]:
        """(path, least and greatest number) of each file that is whole."""
        system, path = pyarrow.fs.FileSystem.from_uri(self.root)
        found = system.get_file_info(pyarrow.fs.FileSelector(path, allow_not_found=True))
        out = []
        for name in sorted(f.path for f in found if f.is_file and f.base_name.endswith(".parquet") and f.base_name[0] not in "_."):
            footer = pq.read_metadata(name, filesystem=system)
            place = footer.schema.to_arrow_schema().get_field_index("__seq")
            groups = [footer.row_group(i).column(place).statistics for i in range(footer.num_row_groups) if footer.row_group(i).num_rows]
            if groups:
                out.append((name, min(g.min for g in groups), max(g.max for g in groups)))
        return out

    def read(self, part: File) -> Iterator[pa.RecordBatch]:
        system, _ = pyarrow.fs.FileSystem.from_uri(self.root)
        kinds = {f.name: f.dataType for f in self.schema.fields}
        wanted = [_expression(f, kinds) for f in self.filters]
        if part.after is not None:
            wanted.append((pc.field("__seq") > part.after) & (pc.field("__seq") <= part.until))
        test = None
        for x in wanted:
            test = x if test is None else test & x
        table = pq.read_table(part.path, columns=self.schema.names, filters=test, filesystem=system)
        yield from table.cast(to_arrow_schema(self.schema)).to_batches(max_chunksize=10_000)


class LogReader(_Log, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  Spark's name
        kinds = {f.name: f.dataType for f in self.schema.fields}
        for f in filters:
            if _expression(f, kinds) is None:
                yield f
            else:
                self.filters.append(f)

    def partitions(self) -> list[File]:
        """The files that may have rows, by the numbers asked for."""
        out = []
        for path, least, most in self.files():
            numbers = [f for f in self.filters if f.attribute == ("__seq",) and type(f) in _TESTS]
            holds = {EqualTo: lambda v: least <= v <= most, GreaterThan: lambda v: most > v, GreaterThanOrEqual: lambda v: most >= v, LessThan: lambda v: least < v, LessThanOrEqual: lambda v: least <= v}
            if all(holds[type(f)](f.value) for f in numbers):
                out.append(File(path))
        return out or [File("")]

    def read(self, part: File) -> Iterator[pa.RecordBatch]:
        if part.path:
            yield from super().read(part)


class LogStream(_Log, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return {"seq": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"seq": max((most for _, _, most in self.files()), default=0)}

    def partitions(self, start: dict, end: dict) -> list[File]:
        return [File(path, start["seq"], end["seq"]) for path, least, most in self.files() if most > start["seq"] and least <= end["seq"]]

    def commit(self, end: dict) -> None:
        pass


class EntityLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "entity_log"

    def schema(self) -> T.StructType:
        return T.StructType([*ENTITIES[self.options["entity"]].fields, *MUTATION])

    def reader(self, schema: T.StructType) -> LogReader:
        return LogReader(schema, self.options)

    def streamReader(self, schema: T.StructType) -> LogStream:  # noqa: N802
        return LogStream(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make the format known, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EntityLog)
