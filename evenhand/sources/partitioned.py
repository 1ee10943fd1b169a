"""A data source for tables in folders by column values: ``spark.read.format("evenhand")``.

``/base/year=2018/state=CA/part-0.parquet`` and its like, on any store that pyarrow reads, also where
the session has no connector of its own. Options: ``partitions``, the folders' columns from the top down
(``year int, state string``); ``columns``, a comma-separated list of those to read from the files (all, if it is not given);
``split_bytes``, how much of a file a task reads at most, by whole row groups.

Equality, lists and null tests on columns of folders are answered by the listing: folders that do not
match are neither entered nor opened, and Spark need not check again. Other conditions are left to
Spark. Spark's own reader prunes columns by itself and decodes in the JVM: prefer it where it reaches the files.

Files that begin with ``_`` or ``.`` are no data. Columns come from the first file found (there must be one), and
files without one of them give nulls there.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

NAME = "evenhand"
SPLIT_BYTES = 128 << 20
NULL = "__HIVE_DEFAULT_PARTITION__"
KINDS = {"int": T.IntegerType, "bigint": T.LongType, "long": T.LongType, "string": T.StringType}


@dataclass
class RowGroups(InputPartition):
    """Some row groups of a file, and the values that its folders give."""

    path: str
    first: int
    last: int
    values: tuple


def _value(text: str, kind: T.DataType) -> object:
    if text == NULL:
        return None
    return int(text) if isinstance(kind, T.IntegralType) else unquote(text)


def _visible(store: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    found = store.get_file_info(fs.FileSelector(folder))
    return sorted((f for f in found if f.base_name[0] not in "_."), key=lambda f: f.path)


class PartitionedTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def folders(self) -> T.StructType:
        given = [pair.split() for pair in (self.options.get("partitions") or "").split(",") if pair.strip()]
        if bad := [" ".join(pair) for pair in given if len(pair) != 2 or pair[1].lower() not in KINDS]:
            raise ValueError(f"columns of folders are a name and one of {', '.join(KINDS)}: {bad}")
        return T.StructType([T.StructField(name, KINDS[kind.lower()]()) for name, kind in given])

    def schema(self) -> T.StructType:
        store, base = fs.FileSystem.from_uri(self.options["path"])
        first = next(_files(store, base, self.folders().fields, (), {}), None)
        if first is None:
            raise ValueError(f"no file under {self.options['path']}")
        with store.open_input_file(first[0]) as file:
            held = pq.read_schema(file)
        names = [c.strip() for c in self.options["columns"].split(",")] if self.options.get("columns") else held.names
        if missing := [c for c in names if c not in held.names]:
            raise ValueError(f"not in {first[0]}: {missing}")
        own = from_arrow_schema(pa.schema([held.field(c) for c in names]))
        return T.StructType([*own.fields, *self.folders().fields])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return PartitionedReader(self.options, schema, self.folders())


def _files(store: fs.FileSystem, folder: str, left: list[T.StructField], values: tuple, tests: dict) -> Iterator[tuple[str, int, tuple]]:
    """Files under a folder with their size and values; ``left`` are the columns of the folders below."""
    for entry in _visible(store, folder):
        if not left:
            if entry.type == fs.FileType.File:
                yield entry.path, entry.size, values
            continue
        name, found, text = entry.base_name.partition("=")
        if not found or entry.type != fs.FileType.Directory:
            continue
        if unquote(name) != left[0].name:
            raise ValueError(f"{entry.path} is not a folder of {left[0].name}")
        value = _value(text, left[0].dataType)
        if all(test(value) for test in tests.get(left[0].name, ())):
            yield from _files(store, entry.path, left[1:], (*values, value), tests)


class PartitionedReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType, folders: T.StructType) -> None:
        self.path, self.most = options["path"], int(options.get("split_bytes", SPLIT_BYTES))
        self.columns, self.folders = schema.fields[:len(schema.fields) - len(folders.fields)], folders.fields
        self.tests: dict = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        by_folder = {f.name for f in self.folders}
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name not in by_folder or not isinstance(f, (EqualTo, In, IsNull, IsNotNull)):
                yield f
                continue
            if isinstance(f, EqualTo):
                test = lambda v, want=f.value: v is not None and v == want
            elif isinstance(f, In):
                test = lambda v, want=frozenset(f.value): v is not None and v in want
            else:
                test = lambda v, null=isinstance(f, IsNull): (v is None) == null
            self.tests.setdefault(name, []).append(test)

    def partitions(self) -> list[RowGroups]:
        store, base = fs.FileSystem.from_uri(self.path)
        out = []
        for path, size, values in _files(store, base, self.folders, (), self.tests):
            if size <= self.most:
                out.append(RowGroups(path, 0, -1, values))
                continue
            with store.open_input_file(path) as file:
                footer = pq.read_metadata(file)
            first = held = 0
            for k in range(footer.num_row_groups):
                group = sum(footer.row_group(k).column(c).total_compressed_size for c in range(footer.num_columns))
                if held and held + group > self.most:
                    out.append(RowGroups(path, first, k, values))
                    first, held = k, 0
                held += group
            out.append(RowGroups(path, first, footer.num_row_groups, values))
        return out

    def read(self, partition: RowGroups | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing matched
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        target = to_arrow_schema(T.StructType([*self.columns, *self.folders]))
        names = [f.name for f in self.columns]
        with store.open_input_file(partition.path) as source:
            file = pq.ParquetFile(source)
            last = file.metadata.num_row_groups if partition.last < 0 else partition.last
            held = [c for c in names if c in file.schema_arrow.names]
            for batch in file.iter_batches(batch_size=10_000, row_groups=list(range(partition.first, last)), columns=held):
                own = [batch[c].cast(target.field(c).type) if c in held else pa.nulls(len(batch), target.field(c).type) for c in names]
                given = [pa.repeat(pa.scalar(v, target.field(f.name).type), len(batch)) for v, f in zip(partition.values, self.folders)]
                yield pa.RecordBatch.from_arrays([*own, *given], schema=target)


def read_partitioned(spark: SparkSession, path: str, partitions: str, columns: Iterable[str] = ()) -> DataFrame:
    """The table in ``path``; filters on columns of ``partitions`` choose folders."""
    spark.dataSource.register(PartitionedTable)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(NAME).option("partitions", partitions).option("columns", ",".join(columns)).load(path)
