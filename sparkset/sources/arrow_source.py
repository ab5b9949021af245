"""Arrow IPC files as a Spark data source. A partition is one record batch of one file, read by memory map, or from a store that Arrow reaches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType


class Batch(InputPartition):
    def __init__(self, path: str, index: int, first_row: int):
        self.path, self.index, self.first_row = path, index, first_row


def opened(path: str) -> pa.ipc.RecordBatchFileReader:
    if "://" not in path or path.startswith("file://"):
        return pa.ipc.open_file(pa.memory_map(path.removeprefix("file://")))
    store, inner = fs.FileSystem.from_uri(path)
    return pa.ipc.open_file(store.open_input_file(inner))


class ArrowFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sparkset_arrow"

    def schema(self) -> StructType:
        kind = from_arrow_schema(opened(self.options["paths"].split("\n")[0]).schema)
        return StructType([*kind.fields, StructField("__file", StringType()), StructField("__row", LongType())])

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArrowReader(self.options["paths"].split("\n"))


class ArrowReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[Batch]:
        out = []
        for path in self.paths:
            file, row = opened(path), 0
            for i in range(file.num_record_batches):
                out.append(Batch(path, i, row))
                row += file.get_batch(i).num_rows
        return out or [Batch(self.paths[0], -1, 0)]

    def read(self, partition: Batch) -> Iterator[pa.RecordBatch]:
        if partition.index < 0:
            return
        batch = opened(partition.path).get_batch(partition.index)
        n, at = batch.num_rows, partition.first_row
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([partition.path] * n, pa.string()), pa.array(range(at, at + n), pa.int64())], names=[*batch.schema.names, "__file", "__row"])
