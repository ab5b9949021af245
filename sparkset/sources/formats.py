"""File formats: which reader a path needs, and the readers. All are lazy and keep the order of files and rows."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkset.operators.dataset import Dataset
from sparkset.plans.order import POS, Key, from_parquet_files

#: File extensions of each format, with options.
EXTENSIONS: dict[str, tuple[str, dict[str, Any]]] = {
    ".jsonl": ("jsonl", {}), ".jsonlines": ("jsonl", {}), ".ndjson": ("jsonl", {}), ".json": ("json", {}),
    ".csv": ("csv", {}), ".tsv": ("csv", {"delimiter": "\t"}), ".parquet": ("parquet", {}),
    ".txt": ("text", {}), ".text": ("text", {}), ".arrow": ("arrow", {}), ".ipc": ("arrow", {}),
}
ARROW_MAGIC = b"ARROW1"


class UnknownFormat(ValueError):
    pass


class Reader(Protocol):
    def __call__(self, spark: SparkSession, paths: Sequence[str], **options) -> DataFrame:
        """The rows with the hidden order columns ``__file`` and ``__row``, or a dense ``__pos``."""


def detect(path: str) -> tuple[str, dict[str, Any]]:
    extension = os.path.splitext(path.rstrip("/").lower())[1]
    if extension not in EXTENSIONS:
        raise UnknownFormat(path)
    name, options = EXTENSIONS[extension]
    return name, dict(options)


def handles(name: str, path: str) -> bool:
    return EXTENSIONS.get(os.path.splitext(path.lower())[1], (None,))[0] == name


def _in_order(df: DataFrame) -> DataFrame:
    """Order of a scan whose source numbers no rows: the file, where its block starts, and the place in the block.

    A task reads the blocks it was given one after the other, so the place grows along each.
    """
    place = F.monotonically_increasing_id()
    return df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), place.alias("__row"))


def read_jsonl(spark: SparkSession, paths: Sequence[str], schema: Any = None, **_: Any) -> DataFrame:
    """One object a line; blank lines are skipped and a bad line is an error."""
    reader = spark.read.option("mode", "FAILFAST")
    return _in_order((reader.schema(schema) if schema else reader).json(list(paths)))


def read_json(spark: SparkSession, paths: Sequence[str], schema: Any = None, **_: Any) -> DataFrame:
    """An array of objects, or one object, in each file."""
    reader = spark.read.option("mode", "FAILFAST").option("multiLine", True)
    return _in_order((reader.schema(schema) if schema else reader).json(list(paths)))


def read_csv(spark: SparkSession, paths: Sequence[str], delimiter: str = ",", headers: bool = True, quoting: str = "rfc4180", **_: Any) -> DataFrame:
    """All values are strings. ``naive`` quoting cuts at every delimiter and trims cells; without headers columns are column_1, column_2, ..."""
    reader = spark.read.option("header", headers).option("inferSchema", False).option("sep", delimiter)
    if quoting == "naive":
        reader = reader.option("quote", "").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    else:
        reader = reader.option("quote", '"').option("escape", '"').option("multiLine", True)
    df = reader.csv(list(paths))
    named = df if headers else df.select(*[F.col(f"`{c}`").alias(f"column_{i + 1}") for i, c in enumerate(df.columns)], "_metadata")
    return _in_order(named).drop("_metadata")


def read_text(spark: SparkSession, paths: Sequence[str], column: str = "text", strip: bool = True, skip_empty: bool = True, **_: Any) -> DataFrame:
    """One row a line."""
    df = _in_order(spark.read.text(list(paths)))
    if strip:
        df = df.withColumn("value", F.regexp_replace("value", r"^\s+|\s+$", ""))
    if skip_empty:
        df = df.where(F.col("value") != "")
    return df.withColumnRenamed("value", column)


def read_parquet(spark: SparkSession, paths: Sequence[str], columns: Sequence[str] | None = None, **_: Any) -> DataFrame:
    df = spark.read.parquet(*paths)
    if columns is not None:
        df = df.select(*[F.col(f"`{c}`") for c in columns if c in df.columns], "_metadata")
    return from_parquet_files(df).drop("_metadata")


def read_arrow(spark: SparkSession, paths: Sequence[str], columns: Sequence[str] | None = None, **_: Any) -> DataFrame:
    """Arrow IPC files, one partition for each record batch."""
    from sparkset.sources.arrow_source import ArrowFiles

    spark.dataSource.register(ArrowFiles)
    df = spark.read.format("sparkset_arrow").option("paths", "\n".join(paths)).load()
    return df.select(*[F.col(f"`{c}`") for c in columns if c in df.columns], "__file", "__row") if columns is not None else df


READERS: dict[str, Callable[..., DataFrame]] = {"jsonl": read_jsonl, "json": read_json, "csv": read_csv, "text": read_text, "parquet": read_parquet, "arrow": read_arrow}


def parser_for(name: str) -> Callable[..., DataFrame]:
    if name not in READERS:
        raise UnknownFormat(name)
    return READERS[name]


def is_arrow(path: str) -> bool:
    with open(path, "rb") as f:
        return f.read(6) == ARROW_MAGIC


def parse(spark: SparkSession, path: str | Sequence[str], format: str | None = None, name: str | None = None, **options) -> Dataset:
    """Read files of one format, or of several by their extensions, into one dataset. Columns that a file lacks are null there."""
    paths = [path] if isinstance(path, str) else list(path)
    groups: dict[tuple, list[str]] = {}
    for p in paths:
        found, extra = (format, {}) if format else detect(p)
        groups.setdefault((found, tuple(sorted(extra.items()))), []).append(p)
    made = []
    for (found, extra), some in groups.items():
        df = parser_for(found)(spark, some, **{**dict(extra), **options})
        keys = [c for c in ("__file", "__block", "__row") if c in df.columns]
        title = name or os.path.splitext(os.path.basename(some[0].rstrip("/")))[0]
        made.append(Dataset(df, (Key(POS),), name=title, is_dense=True) if POS in df.columns else Dataset(df, tuple(map(Key, keys)), name=title))
    return made[0].concat(*made[1:]) if len(made) > 1 else made[0]


def from_csv(spark: SparkSession, path: str | Sequence[str], **options) -> Dataset:
    return parse(spark, path, "csv", **options)


def from_json(spark: SparkSession, path: str, **options) -> Dataset:
    return parse(spark, path, "jsonl" if handles("jsonl", path) else "json", **options)


def from_parquet(spark: SparkSession, path: str | Sequence[str], **options) -> Dataset:
    return parse(spark, path, "parquet", **options)


def from_text(spark: SparkSession, path: str | Sequence[str], **options) -> Dataset:
    return parse(spark, path, "text", **options)


def from_arrow(spark: SparkSession, path: str | Sequence[str], **options) -> Dataset:
    return parse(spark, path, "arrow", **options)
