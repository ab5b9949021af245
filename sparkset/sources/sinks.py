"""Writers. A path that ends in a file name gives one file, written in order as partitions arrive; ``sharded`` writes a folder in parallel."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkset.operators.dataset import Dataset


def _made(path: str) -> str:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    return path


def _readable(c: Column) -> Column:
    """Bytes as text, or as base64 where they are not UTF-8."""
    return F.when(F.is_valid_utf8(c), F.decode(c, "UTF-8")).otherwise(F.concat(F.lit("base64:"), F.base64(c)))


def _json_ready(df: DataFrame) -> DataFrame:
    return df.select(*[_readable(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.BinaryType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def _json_lines(d: Dataset) -> Iterator[str]:
    rows = _json_ready(d.ordered())
    for r in rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator(prefetchPartitions=True):
        yield r["j"]


def csv_cells(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Every value as the text of a CSV cell: nulls empty, arrays, maps and structs as JSON."""

    def cell(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BinaryType):
            c = _readable(c)
        elif isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType):
            c = F.to_json(c, {"ignoreNullFields": "false"})
        return F.coalesce(c.cast("string"), F.lit("")).alias(f.name)

    return df.select(*[cell(f) for f in df.schema.fields if columns is None or f.name in columns])


def _quoted(cell: str, delimiter: str) -> str:
    return '"' + cell.replace('"', '""') + '"' if any(x in cell for x in (delimiter, '"', "\n", "\r")) else cell


def to_csv(d: Dataset, path: str, delimiter: str = ",", headers: bool = True, columns: Sequence[str] | None = None, sharded: bool = False) -> None:
    """Cells are quoted where they hold a delimiter, a quote or a line break."""
    cells = csv_cells(d.ordered(), columns)
    if sharded:
        writer = cells.write.mode("overwrite").option("header", headers).option("sep", delimiter).option("quote", '"').option("escape", '"').option("emptyValue", "")
        writer.csv(path)
        return
    with open(_made(path), "w", encoding="utf-8", newline="") as f:
        if headers:
            f.write(delimiter.join(_quoted(c, delimiter) for c in cells.columns) + "\n")
        for r in cells.toLocalIterator(prefetchPartitions=True):
            f.write(delimiter.join(_quoted(x, delimiter) for x in r) + "\n")


def to_json(d: Dataset, path: str, orient: str = "records", pretty: bool = False) -> None:
    """An array of objects, or an object of columns, which must fit in the driver."""
    if orient not in ("records", "columns"):
        raise ValueError(f"invalid orient: {orient}")
    with open(_made(path), "w", encoding="utf-8") as f:
        if orient == "columns":
            rows = [json.loads(x) for x in _json_lines(d)]
            json.dump({c: [r[c] for r in rows] for c in d.column_names} if rows else {}, f, ensure_ascii=False, indent=2 if pretty else None)
            return
        f.write("[")
        for i, line in enumerate(_json_lines(d)):
            f.write("," * bool(i) + ("\n" + json.dumps(json.loads(line), ensure_ascii=False, indent=2) if pretty else line))
        f.write("]")


def to_jsonl(d: Dataset, path: str, sharded: bool = False) -> None:
    if sharded:
        _json_ready(d.ordered()).write.mode("overwrite").option("ignoreNullFields", False).json(path)
        return
    with open(_made(path), "w", encoding="utf-8") as f:
        f.writelines(line + "\n" for line in _json_lines(d))


def to_parquet(d: Dataset, path: str, compression: str | None = "snappy", max_rows: int | None = None) -> None:
    """A folder of Parquet files in order; ``max_rows`` bounds the rows of a file."""
    writer = d.ordered().write.mode("overwrite").option("compression", compression or "uncompressed")
    (writer.option("maxRecordsPerFile", max_rows) if max_rows else writer).parquet(path)


def _batches(d: Dataset, rows: int) -> tuple[pa.Schema, Iterator[pa.RecordBatch]]:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(d.df.schema)

    def made() -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for r in d.ordered().toLocalIterator(prefetchPartitions=True):
            held.append(r.asDict(recursive=True))
            if len(held) == rows:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    return schema, made()


def to_arrow(d: Dataset, path: str, compression: str | None = None, batch_rows: int = 10_000, stream: bool = False, sharded: bool = False) -> None:
    """An Arrow IPC file, or with ``stream`` the IPC stream format; compression: lz4 or zstd.

    With ``sharded``, ``path`` is a folder that all executors reach, and each writes the files of its partitions, which are named in the order of rows.
    """
    if sharded:
        _arrow_shards(d, path, compression, stream)
        return
    schema, batches = _batches(d, batch_rows)
    open_writer = pa.ipc.new_stream if stream else pa.ipc.new_file
    with open_writer(_made(path), schema, options=pa.ipc.IpcWriteOptions(compression=compression)) as writer:
        for batch in batches:
            writer.write_batch(batch)


def _arrow_shards(d: Dataset, folder: str, compression: str | None, stream: bool) -> None:
    from pyspark import TaskContext
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(d.df.schema)
    address = folder if "://" in folder else f"file://{os.path.abspath(folder)}"
    store, inner = fs.FileSystem.from_uri(address)
    store.create_dir(inner)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, (store, inner) = TaskContext.get(), fs.FileSystem.from_uri(address)
        name, rows = f"part-{task.partitionId():05d}", 0
        unfinished = f"{inner}/_{name}-{task.taskAttemptId()}"  # of this attempt alone: tasks are repeated
        open_writer = pa.ipc.new_stream if stream else pa.ipc.new_file
        with store.open_output_stream(unfinished) as file, open_writer(file, schema, options=pa.ipc.IpcWriteOptions(compression=compression)) as writer:
            for batch in batches:
                writer.write_table(pa.Table.from_batches([batch]).cast(schema))
                rows += batch.num_rows
        store.move(unfinished, f"{inner}/{name}.{'arrows' if stream else 'arrow'}")
        yield pa.RecordBatch.from_pydict({"rows": [rows]})

    d.ordered().mapInArrow(write, "rows long").collect()  # a number for each partition


def to_text(d: Dataset, path: str, column: str = "text", append_newline: bool = True, sharded: bool = False) -> None:
    """One value a line; a null is an empty line."""
    if column not in d.column_names:
        raise KeyError(column)
    lines = csv_cells(d.ordered(), [column])
    if sharded:
        lines.write.mode("overwrite").text(path)
        return
    with open(_made(path), "w", encoding="utf-8") as f:
        for i, r in enumerate(lines.toLocalIterator(prefetchPartitions=True)):
            f.write(r[0] + "\n" if append_newline else "\n" * bool(i) + r[0])


def shard_rows(d: Dataset, max_shard_bytes: int = 500 * 1024 * 1024) -> int:
    """Rows of a shard, from twice the JSON size of the first row."""
    first: Any = next(_json_lines(d.take(1)), "")
    return max(1, max_shard_bytes // max(1, 2 * len(first.encode())))
