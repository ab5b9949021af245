"""What the operators of this subpackage share: reading tables, naming columns and cutting lineage."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkset.session import shared_folder

#: White space that separates words: the space and the five ASCII controls from tab to carriage return.
WORD_BREAK = r"[\x20\x09-\x0D]+"

#: Removes a query's shuffle files as it ends; nothing reads them again once its rows are a written table.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000

_kept: dict[str, SparkSession] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of long texts. One file may be one row group, which only one task reads: its rows are dealt to all cores first."""
    df = read_table(spark, sf_dir, name)
    return df.repartition(spark.sparkContext.defaultParallelism) if len(df.inputFiles()) == 1 else df


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: the rows outlive the executors that made them. The files go when Python exits, or by ``release``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/sparkset-tables/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    if not _kept:
        atexit.register(_drop_kept)
    _kept[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._sparkset_path = path
    return out


def release(kept: DataFrame) -> None:
    """Delete the files of a table made by ``keep`` that nothing will read again."""
    path = kept._sparkset_path
    _delete(_kept.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(target, True)


def _drop_kept() -> None:
    for path, spark in _kept.items():
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended before Python does
            return


def own_column(df: DataFrame, wanted: str) -> str:
    """``wanted``, or with underscores added so that it clashes with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow`` with Arrow batches of ``BATCH_ROWS`` rows where the session has the default: whole texts are long rows."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH) == "10000":
        conf.set(_BATCH, str(BATCH_ROWS))
    return df.mapInArrow(function, schema)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of a few rows, which bound what a Python worker holds."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def let(value, body):
    """``body(value)`` with the value computed once a row: the optimizer would else move it into lambdas that run for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text):
    """Words of a text column; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), WORD_BREAK), "")
