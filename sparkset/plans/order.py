"""Order of rows. A dataset is a DataFrame and the sort keys that order it; dense positions are made only where an operator counts rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POS = "__pos"
_ROW_BITS = (1 << 33) - 1


@dataclass(frozen=True)
class Key:
    """A sort key: a hidden column, its direction and where its nulls stand."""

    column: str
    descending: bool = False
    nulls_last: bool = False

    def expr(self) -> Column:
        c = F.col(f"`{self.column}`")
        if self.descending:
            return c.desc_nulls_last() if self.nulls_last else c.desc_nulls_first()
        return c.asc_nulls_last() if self.nulls_last else c.asc_nulls_first()


def sort_exprs(order: tuple[Key, ...]) -> list[Column]:
    return [k.expr() for k in order]


def hidden(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("__")]


def term_order(df: DataFrame, column: str, descending: bool) -> tuple[Column, bool]:
    """Sort value of a column and whether its nulls come last.

    Nulls follow numbers, precede strings, arrays and maps, and stand between false and true.
    """
    kind, c = df.schema[column].dataType, F.col(f"`{column}`")
    if isinstance(kind, T.BooleanType):
        return F.when(c.isNull(), 1).when(c, 2).otherwise(0), False
    if isinstance(kind, T.MapType):
        c = F.array_sort(F.map_entries(c))
    nulls_high = isinstance(kind, T.NumericType | T.DateType | T.TimestampType | T.TimestampNTZType)
    return c, nulls_high != descending


def from_parquet_files(df: DataFrame) -> DataFrame:
    """Add a dense position to a scan of Parquet files: files in order of their paths, rows as they stand in the file.

    One job counts the rows of each file; the offsets are joined, not collected.
    """
    at = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    counts = at.groupBy("__file").agg(F.count("*").alias("__n"))
    rows = sorted((r["__file"], r["__n"]) for r in counts.collect())
    offset, table = 0, []
    for path, n in rows:
        table.append((path, offset))
        offset += n
    files = df.sparkSession.createDataFrame(table, "__file string, __offset long")
    return at.join(files, "__file").withColumn(POS, F.col("__offset") + F.col("__row")).drop("__file", "__row", "__offset")


def densify(df: DataFrame, order: tuple[Key, ...]) -> tuple[DataFrame, int, DataFrame]:
    """Replace the order by a dense position 0..n-1; also the number of rows, and the frame that was kept.

    The rows are range-partitioned and sorted once; a second job counts each partition, and a row's position
    is its place in the partition plus the rows of those before. Nothing passes through a single task. The sorted rows are written to
    the checkpoint folder, so that a lost executor can't change which rows a partition has; where the session has none, they are persisted.
    """
    placed = df.orderBy(*sort_exprs(order)).select(
        *[F.col(f"`{c}`") for c in df.columns if not c.startswith("__")],
        F.spark_partition_id().alias("__part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)).alias("__row"),
    )
    placed = placed.checkpoint() if df.sparkSession.sparkContext.getConf().get("spark.checkpoint.dir") else placed.persist()
    counts = {r["__part"]: r["n"] for r in placed.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    offsets, total = [], 0
    for part in range(max(counts, default=-1) + 1):
        offsets.append(total)
        total += counts.get(part, 0)
    start = F.element_at(F.array(*map(F.lit, offsets or [0])), F.col("__part") + 1)
    return placed.withColumn(POS, (start + F.col("__row")).cast("long")).drop("__part", "__row"), total, placed
