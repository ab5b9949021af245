"""The ordered dataset: an immutable wrapper of a DataFrame with sort keys, metadata and an output format."""

from __future__ import annotations

import dataclasses
import random
import tempfile
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from functools import reduce
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sparkset.functions.cast import CastError, cast_column_expr, failures
from sparkset.functions.features import ClassLabel, Features
from sparkset.operators import allocate
from sparkset.plans.order import POS, Key, densify, from_parquet_files, hidden, sort_exprs, term_order

RowFunction = Callable[[dict], Any]
#: Rows whose permutation the driver holds in memory (8 bytes each); a longer one is drawn in a file of the driver's.
MOST_PERMUTED = 500_000_000


@dataclasses.dataclass(frozen=True)
class Dataset:
    """Rows of ``frame`` in the order of ``order``; columns that begin with two underscores are hidden from users.

    Operators return new datasets and only describe plans. Those that count rows (slices, shards, splits, folds, shuffles)
    make positions dense first, by ``dense``. ``n`` is the number of rows where it is known.
    """

    frame: DataFrame
    order: tuple[Key, ...]
    name: str = "dataset"
    version: str = "1.0"
    metadata: Mapping[str, Any] = dataclasses.field(default_factory=dict)
    logical: Features | None = None
    format: str = "rows"
    format_columns: tuple[str, ...] | None = None
    format_options: Mapping[str, Any] = dataclasses.field(default_factory=dict)
    n: int | None = None
    is_dense: bool = False
    indices: Mapping[str, Any] = dataclasses.field(default_factory=dict)
    held: tuple[DataFrame, ...] = ()

    # -- making -------------------------------------------------------------------------------------------------

    @classmethod
    def from_frame(cls, df: DataFrame, order_by: str | Sequence[str] | None = None, **options) -> Dataset:
        """Wrap a DataFrame, ordered by columns whose values are unique together, or as its partitions stand."""
        if order_by is None:
            return cls(df.withColumn(POS, F.monotonically_increasing_id()), (Key(POS),), **options)
        names = [order_by] if isinstance(order_by, str) else list(order_by)
        keyed = df.select("*", *[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(names)])
        return cls(keyed, tuple(Key(f"__k{i}") for i in range(len(names))), **options)

    @classmethod
    def from_parquet(cls, spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None, **options) -> Dataset:
        """Parquet files in the order of their paths and rows; only ``columns`` are read."""
        df = spark.read.parquet(*([path] if isinstance(path, str) else path))
        if columns is not None:
            df = df.select(*[F.col(f"`{c}`") for c in columns if c in df.columns], "_metadata")
        return cls(from_parquet_files(df).drop("_metadata"), (Key(POS),), is_dense=True, **options)

    @classmethod
    def from_list(cls, spark: SparkSession, rows: Sequence[Mapping[str, Any]], schema: Any = None, **options) -> Dataset:
        """Rows from Python. Without a schema, columns are all keys in sorted order and missing keys are null."""
        rows = list(rows)
        if schema is None:
            names = sorted({str(k) for r in rows for k in r})
            df = spark.createDataFrame([tuple(r.get(c) for c in names) + (i,) for i, r in enumerate(rows)], _inferred(rows, names))
        else:
            kind = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
            df = spark.createDataFrame([tuple(r.get(c) for c in kind.names) + (i,) for i, r in enumerate(rows)], T.StructType([*kind.fields, T.StructField(POS, T.LongType())]))
        return cls(df, (Key(POS),), n=len(rows), is_dense=True, **options)

    @classmethod
    def from_generator(cls, spark: SparkSession, make: Callable[[], Iterable[Mapping[str, Any]]], schema: Any = None, **options) -> Dataset:
        """Rows of a generator, read at once. The lazy form is ``streaming.IterableDataset.from_generator``."""
        return cls.from_list(spark, list(make()), schema, **options)

    def _with(self, frame: DataFrame, order: tuple[Key, ...] | None = None, **changes) -> Dataset:
        """New rows: what is known of numbers, positions and indices goes unless given."""
        return dataclasses.replace(self, frame=frame, order=self.order if order is None else order, **({"n": None, "is_dense": False} | changes))

    # -- looking ------------------------------------------------------------------------------------------------

    @property
    def spark(self) -> SparkSession:
        return self.frame.sparkSession

    @property
    def column_names(self) -> list[str]:
        return [c for c in self.frame.columns if not c.startswith("__")]

    @property
    def df(self) -> DataFrame:
        """The rows without hidden columns, in no promised order."""
        return self.frame.select(*[F.col(f"`{c}`") for c in self.column_names])

    @property
    def features(self) -> Features:
        return Features.of_schema(self.df.schema, self.logical)

    def ordered(self) -> DataFrame:
        return self.frame.orderBy(*sort_exprs(self.order)).select(*[F.col(f"`{c}`") for c in self.column_names])

    def with_position(self, name: str = "pos") -> DataFrame:
        """The rows and their dense position."""
        d = self.dense()
        return d.frame.select(*[F.col(f"`{c}`") for c in self.column_names if c != name], F.col(POS).alias(name))

    def __len__(self) -> int:
        return self.n if self.n is not None else self.frame.count()

    num_items = __len__

    def dense(self) -> Dataset:
        if self.is_dense:
            return self
        frame, n, held = densify(self.frame, self.order)
        return dataclasses.replace(self, frame=frame, order=(Key(POS),), n=n, is_dense=True, held=(*self.held, held))

    def release(self) -> None:
        """Free what was persisted to number the rows of this dataset and of those it comes from; they still work, but number anew."""
        for frame in self.held:
            frame.unpersist()

    def _counted(self) -> Dataset:
        d = self.dense()
        return d if d.n is not None else dataclasses.replace(d, n=d.frame.count())

    def __iter__(self) -> Iterator[Any]:
        from sparkset.operators.formatting import formatter

        shape = formatter(self.format, **self.format_options)
        for row in self.ordered().toLocalIterator(prefetchPartitions=True):
            yield shape.row(row.asDict(recursive=True), self.format_columns)

    def to_list(self) -> list[dict]:
        return [r.asDict(recursive=True) for r in self.ordered().collect()]

    def __contains__(self, row: Mapping[str, Any]) -> bool:
        """Whether a row has just these columns and values."""
        if set(row) != set(self.column_names):
            return False
        schema = T.StructType([self.frame.schema[c] for c in row])
        asked = self.spark.createDataFrame([tuple(row.values())], schema)
        same = [self.df[f"`{c}`"].eqNullSafe(asked[f"`{c}`"]) for c in row]
        return not asked.join(self.df, reduce(Column.__and__, same), "left_semi").isEmpty()

    def to_dict(self, columns: Sequence[str] | None = None) -> dict[str, list]:
        rows = self.to_list()
        names = [c for c in (columns or self.column_names) if c in self.column_names]
        return {c: [r[c] for r in rows] for c in names} if rows else {}

    def __getitem__(self, i: int) -> dict:
        d = self._counted()
        at = allocate.resolve_index(i, d.n)
        if at is None:
            raise IndexError(i)
        return d._public(d.frame.where(F.col(POS) == at)).first().asDict(recursive=True)

    def get(self, i: int, default: Any = None) -> Any:
        try:
            return self[i]
        except IndexError:
            return default

    def _public(self, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f"`{c}`") for c in self.column_names])

    def update(self, i: int, change: Mapping[str, Column | Any]) -> Dataset:
        """Replace columns of row ``i``."""
        d = self._counted()
        at = allocate.resolve_index(i, d.n)
        if at is None:
            raise IndexError(i)
        hit, frame = F.col(POS) == at, d.frame
        for c, v in change.items():
            frame = frame.withColumn(c, F.when(hit, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(f"`{c}`") if c in frame.columns else F.lit(None)))
        return d._with(frame, n=d.n, is_dense=True)

    def pop(self, i: int) -> tuple[dict, Dataset]:
        d = self._counted()
        at = allocate.resolve_index(i, d.n)
        return self[i], d._with(d.frame.where(F.col(POS) != at))

    def validate(self, required: Sequence[str] = ("id", "input", "expected")) -> None:
        if missing := [c for c in required if c not in self.column_names]:
            raise ValueError(f"missing columns: {', '.join(missing)}")

    # -- output format ------------------------------------------------------------------------------------------

    def set_format(self, name: str, columns: Sequence[str] | None = None, **options) -> Dataset:
        from sparkset.operators.formatting import formatter

        formatter(name, **options)
        return dataclasses.replace(self, format=name, format_columns=tuple(columns) if columns else None, format_options=options)

    with_format = set_format

    def reset_format(self) -> Dataset:
        return dataclasses.replace(self, format="rows", format_columns=None, format_options={})

    def iter(self, batch_size: int = 32, drop_last: bool = False) -> Iterator[Any]:
        """Formatted batches, pulled partition by partition."""
        from sparkset.operators.formatting import formatter

        shape, held = formatter(self.format, **self.format_options), []
        for row in self.ordered().toLocalIterator(prefetchPartitions=True):
            held.append(row.asDict(recursive=True))
            if len(held) == batch_size:
                yield shape.batch(held, self.format_columns)
                held = []
        if held and not drop_last:
            yield shape.batch(held, self.format_columns)

    # -- projections --------------------------------------------------------------------------------------------

    def _keep(self) -> list[Column]:
        return [F.col(f"`{c}`") for c in hidden(self.frame)]

    def select(self, what: Sequence[str] | Sequence[int] | range) -> Dataset:
        """Columns by name (unknown ones are ignored) or rows by index; an empty list gives no rows."""
        if isinstance(what, range):
            return self._select_range(what)
        what = list(what)
        if not what:
            return self._with(self.frame.limit(0), n=0)
        if all(isinstance(x, str) for x in what):
            names = [c for c in dict.fromkeys(what) if c in self.column_names]
            return self._with(self.frame.select(*[F.col(f"`{c}`") for c in names], *self._keep()), n=self.n, is_dense=self.is_dense)
        return self.gather(what)

    def gather(self, indices: Sequence[int]) -> Dataset:
        """Rows in the order asked for; repeats repeat, negative indices count from the end, others out of range are dropped."""
        d = self._counted()
        at = [p for i in indices if (p := allocate.resolve_index(int(i), d.n)) is not None]
        wanted = _positions(self.spark, np.array(at, np.int64), np.arange(len(at)))
        frame = d.frame.join(wanted, POS).drop(POS).withColumnRenamed("__out", POS)
        return d._with(frame, n=len(at), is_dense=True)

    def _select_range(self, r: range) -> Dataset:
        d = self._counted()
        at = range(d.n)[r.start : r.stop : r.step] if r.start >= 0 and r.stop >= 0 else [p for p in r if 0 <= p < d.n]
        if not len(at):
            return d._with(d.frame.limit(0), n=0)
        if isinstance(at, range) and at.step > 0:
            hit = F.col(POS).between(at[0], at[-1]) & ((F.col(POS) - at[0]) % at.step == 0)
            return d._with(d.frame.where(hit).withColumn(POS, ((F.col(POS) - at[0]) / at.step).cast("long")), n=len(at), is_dense=True)
        return self.gather(list(at))

    def rename_column(self, old: str, new: str) -> Dataset:
        if old not in self.column_names or old == new:
            return self
        return self._with(self.frame.drop(new).withColumnRenamed(old, new), n=self.n, is_dense=self.is_dense)

    def add_column(self, name: str, value: Column | Callable[[Column], Column] | Callable[[dict, int], Any], returns: str | None = None) -> Dataset:
        """A computed column: an expression, a function of the index column, or, with ``returns``, a Python function of row and index."""
        if isinstance(value, Column):
            return self._with(self.frame.withColumn(name, value), n=self.n, is_dense=self.is_dense)
        d = self.dense()
        if returns is None:
            return d._with(d.frame.withColumn(name, value(F.col(POS))), n=d.n, is_dense=True)
        kind = T.StructType([*[f for f in d.frame.schema.fields if f.name != name], T.StructField(name, T._parse_datatype_string(returns))])
        frame = d._mapped(lambda row, pos: [row | {name: value(row, pos)}], kind)
        return d._with(frame, n=d.n, is_dense=True)

    def remove_columns(self, *names: str) -> Dataset:
        return self._with(self.frame.drop(*[c for c in names if not c.startswith("__")]), n=self.n, is_dense=self.is_dense)

    def flatten(self, column: str) -> Dataset:
        """Fields of a struct, or keys of a map, as columns ``column_key``, one level deep. Other columns are left as they are."""
        if column not in self.column_names:
            return self
        kind, c = self.frame.schema[column].dataType, F.col(f"`{column}`")
        if isinstance(kind, T.StructType):
            new = {f"{column}_{k}": c[k] for k in kind.names}
        elif isinstance(kind, T.MapType):
            keys = sorted(r[0] for r in self.frame.select(F.explode(F.map_keys(c))).distinct().collect())
            new = {f"{column}_{k}": F.try_element_at(c, F.lit(k)) for k in keys}
        else:
            return self
        kept = [F.col(f"`{x}`") for x in self.frame.columns if x != column and x not in new]
        return self._with(self.frame.select(*kept, *[v.alias(k) for k, v in new.items()]), n=self.n, is_dense=self.is_dense)

    def cast(self, features: Features, errors: str = "raise", strict: bool = False) -> Dataset:
        """Cast the columns that ``features`` names; ``errors``: raise on any value that does not fit, or make it null."""
        names = [c for c in features if c in self.column_names]
        if errors == "raise" and names:
            bad = self.frame.select(*[F.count_if(failures(F.col(f"`{c}`"), self.frame.schema[c].dataType, features[c], strict)).alias(c) for c in names]).first()
            if wrong := {c: bad[c] for c in names if bad[c]}:
                raise CastError(wrong)
        frame = self.frame.withColumns({c: cast_column_expr(F.col(f"`{c}`"), self.frame.schema[c].dataType, features[c], strict) for c in names})
        frame = frame.withMetadata(names[0], features[names[0]].metadata()) if len(names) == 1 else _with_metadata(frame, {c: features[c].metadata() for c in names})
        return self._with(frame, n=self.n, is_dense=self.is_dense, logical=Features({**(self.logical or {}), **{c: features[c] for c in names}}))

    def cast_column(self, name: str, feature, errors: str = "raise", strict: bool = False) -> Dataset:
        return self.cast(Features({name: feature}), errors, strict)

    def class_encode_column(self, name: str, include_nulls: bool = False) -> Dataset:
        """Distinct values, ascending, become 0..k-1. Nulls stay null, or are a class of their own after the others.

        The classes are joined to the rows as a table; Spark broadcasts it if it is small.
        """
        if name not in self.column_names:
            raise KeyError(name)
        value = F.col(f"`{name}`")
        rows = self.frame.select(value.cast("string").alias("__v"), value.alias("__o")).distinct()
        rows = rows.where("__v is not null").orderBy("__o") if not include_nulls else rows.orderBy(F.col("__o").asc_nulls_last())
        names = [r["__v"] for r in rows.select("__v").collect()]  # a class label carries its names, so they are few
        table = self.spark.createDataFrame([(v, i) for i, v in enumerate(names)], "__v string, __c int")
        frame = self.frame.withColumn("__key", value.cast("string"))
        frame = frame.join(table, F.col("__key").eqNullSafe(F.col("__v")), "left").withColumn(name, F.col("__c")).drop("__key", "__v", "__c")
        label = ClassLabel(names=["null" if v is None else v for v in names])
        return self._with(frame.withMetadata(name, label.metadata()), n=self.n, is_dense=self.is_dense, logical=Features({**(self.logical or {}), name: label}))

    # -- rows ---------------------------------------------------------------------------------------------------

    def filter(self, predicate: Column | RowFunction, cache=None, new_fingerprint: str | None = None) -> Dataset:
        """Rows where an expression is true, or where a Python function of the row is truthy (neither None nor False).

        With a ``TableCache`` the rows are written, or read where they have been written by the same operation on the same data.
        """
        if cache is not None:
            return self._through(cache, new_fingerprint, "filter", [predicate], lambda: self.filter(predicate))
        if isinstance(predicate, Column):
            return self._with(self.frame.where(predicate))
        return self._with(self._mapped(lambda row, _: [row] if truthy(predicate(row)) else [], self.frame.schema, index=False))

    def map(self, function: Column | Mapping[str, Column] | Callable, schema: Any = None, batched: bool = False, batch_size: int = 1000, cache=None, new_fingerprint: str | None = None) -> Dataset:
        """New rows from expressions, or from a Python function of a row, or of a batch (which may return any number of rows).

        Expressions replace or add columns. A Python function needs ``schema``, the visible columns it returns. With a ``TableCache`` the rows are
        written, or read where they have been written by the same operation on the same data, or under the same ``new_fingerprint``.
        """
        if cache is not None:
            given = [*function.values(), *function] if isinstance(function, Mapping) else [function]
            return self._through(cache, new_fingerprint, "map", [*given, str(schema), batched, batch_size], lambda: self.map(function, schema, batched, batch_size))
        if isinstance(function, Mapping):
            return self._with(self.frame.withColumns(dict(function)), n=self.n, is_dense=self.is_dense)
        kind = self.df.schema if schema is None else schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
        keys = [f for f in self.frame.schema.fields if f.name.startswith("__")]
        if not batched:
            return self._with(self._mapped(lambda row, _: [function(_visible(row)) | _hidden(row)], T.StructType([*kind.fields, *keys]), index=False), n=self.n, is_dense=self.is_dense)
        # batches are consecutive rows; what a batch returns is ordered by the batch and then as returned
        d = self.dense()
        frame = d.frame.withColumn("__batch", F.floor(F.col(POS) / batch_size))
        out = T.StructType([*kind.fields, T.StructField("__batch", T.LongType()), T.StructField("__nth", T.LongType())])

        def run(key, rows):
            import pandas as pd

            given = [_visible(r) for r in rows.sort_values(POS).to_dict("records")]
            made = [r | {"__batch": key[0], "__nth": i} for i, r in enumerate(function(given))]
            return pd.DataFrame(made, columns=out.names)

        return d._with(frame.groupBy("__batch").applyInPandas(run, out), (Key("__batch"), Key("__nth")))

    def _mapped(self, function: Callable[[dict, int | None], Iterable[dict]], schema: T.StructType, index: bool = True) -> DataFrame:
        """Rows of a Python function, by Arrow batches."""
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(schema)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [r for row in batch.to_pylist() for r in function(row, row.get(POS) if index else None)]
                yield pa.RecordBatch.from_pylist(rows, schema=kind)

        return self.frame.mapInArrow(run, schema)

    def take(self, n: int) -> Dataset:
        return self._with(self.frame.orderBy(*sort_exprs(self.order)).limit(max(0, n)))

    def skip(self, n: int) -> Dataset:
        return self.slice(max(0, n))

    def slice(self, start: int, length: int | None = None) -> Dataset:
        """``length`` rows from ``start``; a negative start counts from the end and stops at the first row."""
        d = self._counted()
        first = max(0, start + d.n) if start < 0 else start
        end = d.n if length is None else min(d.n, first + max(0, length))
        return d._span(first, end)

    def _span(self, start: int, end: int) -> Dataset:
        """Rows start..end-1 of dense positions."""
        frame = self.frame.where((F.col(POS) >= start) & (F.col(POS) < end)).withColumn(POS, F.col(POS) - start)
        return self._with(frame, n=max(0, end - start) if self.n is not None else None, is_dense=True)

    def batch(self, size: int) -> Batches:
        """Consecutive datasets of ``size`` rows, the last one perhaps of fewer."""
        if size < 1:
            raise ValueError(f"batches of {size} rows")
        return Batches(self._counted(), size)

    def shard(self, num_shards: int, index: int) -> Dataset:
        """A contiguous shard."""
        d = self._counted()
        return dataclasses.replace(d._span(*allocate.shard_bounds(d.n, num_shards, index)), name=f"{self.name}_shard_{index}")

    def sort(self, column: str, direction: str = "asc") -> Dataset:
        """Stable sort by one column; rows that tie keep their order in both directions."""
        down = direction == "desc"
        value, nulls_last = term_order(self.frame, column, down)
        name = f"__s{sum(c.startswith('__s') for c in self.frame.columns)}"
        return self._with(self.frame.withColumn(name, value), (Key(name, down, nulls_last), *self.order), n=self.n)

    def unique(self, column: str) -> Dataset:
        """The first row of each value; nulls are one value.

        The first is found by an aggregate of partial minima and joined back, so a frequent value fills no task.
        """
        if len(self.order) == 1 and not self.order[0].descending and not self.order[0].nulls_last:
            key = F.col(f"`{self.order[0].column}`")
            first = self.frame.groupBy(F.col(f"`{column}`").alias("__u")).agg(F.min(key).alias("__first")).select("__first")
            return self._with(self.frame.join(first, key == F.col("__first"), "left_semi"))
        return self.dense().unique(column)

    def concat(self, *others: Dataset) -> Dataset:
        """This dataset's rows, then the others'; columns that one lacks are null there."""
        parts, start, frame = [self, *others], 0, None
        for p in parts:
            d = p._counted()
            moved = d.frame.withColumn(POS, F.col(POS) + start).drop(*[c for c in hidden(d.frame) if c != POS])
            frame = moved if frame is None else frame.unionByName(moved, allowMissingColumns=True)
            start += d.n
        return self._with(frame, (Key(POS),), n=start, is_dense=True)

    # -- shuffles and splits ------------------------------------------------------------------------------------

    def shuffle(self, seed: int | None = None, generator: str = "numpy") -> Dataset:
        """A random order. With a seed and ``numpy``, row ``i`` is row ``permutation(n)[i]`` of NumPy's PCG64 generator.

        That permutation is drawn on the driver (8 bytes a row, in a file beyond ``MOST_PERMUTED`` rows) and joined as a table. The ``hash`` generator
        orders rows by a seeded hash of their positions, on the executors alone.
        """
        if generator not in ("numpy", "hash"):
            raise ValueError(f"unknown generator: {generator}")
        if seed is None or generator == "hash":
            d = self.dense()
            seed = random.getrandbits(62) if seed is None else seed
            return d._with(d.frame.withColumn("__r", F.xxhash64(F.col(POS), F.lit(seed))), (Key("__r"), Key(POS)), n=d.n)
        d = self._counted()
        table = _permutation(self.spark, d.n, seed)
        return d._with(d.frame.join(table, POS).drop(POS).withColumnRenamed("__out", POS), n=d.n, is_dense=True)

    def train_test_split(self, test_size: float | int | None = 0.25, train_size: float | int | None = None, stratify_by: str | None = None, seed: int | None = None, shuffle: bool = True) -> dict[str, Dataset]:
        """Train and test, the last rows being test. With ``stratify_by``, the last rows of each group, shared by largest remainders."""
        d = (self.shuffle(seed) if shuffle else self)._counted()
        train, test = allocate.split_counts(d.n, test_size, train_size)
        if stratify_by is None:
            parts = d._span(0, train), d._span(train, d.n)
        else:
            value, nulls_last = term_order(d.frame, stratify_by, False)
            group = F.col(f"`{stratify_by}`")
            sizes = d.frame.groupBy(group.alias("g"), value.alias("v")).agg(F.count("*").alias("n")).orderBy(Key("v", nulls_last=nulls_last).expr()).collect()
            given = allocate.largest_remainders([(r["g"], r["n"]) for r in sizes], test)
            # one row a group: its number of train rows and its place among groups
            schema = T.StructType([T.StructField("__g", d.frame.schema[stratify_by].dataType), T.StructField("__cut", T.LongType()), T.StructField("__place", T.LongType())])
            table = self.spark.createDataFrame([(r["g"], r["n"] - given[r["g"]], i) for i, r in enumerate(sizes)], schema)
            ranked = _ranked_in_group(d.frame, stratify_by)
            ranked = ranked.join(F.broadcast(table) if len(sizes) < 100_000 else table, group.eqNullSafe(F.col("__g"))).drop("__g")
            order = (Key("__place"), Key("__rank"))
            parts = d._with(ranked.where("__rank < __cut"), order), d._with(ranked.where("__rank >= __cut"), order)
        return {k: dataclasses.replace(p, name=f"{self.name}_{k}") for k, p in zip(("train", "test"), parts)}

    def split(self, ratio: float = 0.8) -> tuple[Dataset, Dataset]:
        """First rows and the rest, in order."""
        d = self._counted()
        cut = allocate.round_half_away(d.n * ratio)
        return d._span(0, cut), d._span(cut, d.n)

    # -- search, identity, output -------------------------------------------------------------------------------

    def add_index(self, column: str, metric: str = "cosine") -> Dataset:
        from sparkset.operators.search import VectorIndex

        d = self.dense()
        return dataclasses.replace(d, indices={**self.indices, column: VectorIndex.build(d.frame, column, metric)})

    def get_nearest_examples(self, column: str, query: Sequence[float], k: int = 10) -> tuple[list[float], list[dict]]:
        """Scores and rows of the nearest vectors, by position; rows that are gone since are not returned."""
        if column not in self.indices:
            raise ValueError(f"no index on {column}")
        hits = self.indices[column].search(query, k)
        d = self.dense()
        table = self.spark.createDataFrame(hits, f"{POS} long, __score double")
        rows = d.frame.join(F.broadcast(table), POS).orderBy(F.desc("__score"), POS).collect()
        return [r["__score"] for r in rows], [_visible(r.asDict(recursive=True)) for r in rows]

    def save_index(self, column: str, path: str) -> None:
        if column not in self.indices:
            raise ValueError(f"no index on {column}")
        self.indices[column].save(path)

    def load_index(self, column: str, path: str) -> Dataset:
        from sparkset.operators.search import VectorIndex

        return dataclasses.replace(self, indices={**self.indices, column: VectorIndex.load(self.spark, path)})

    def drop_index(self, column: str) -> Dataset:
        return dataclasses.replace(self, indices={k: v for k, v in self.indices.items() if k != column})

    def add_to_index(self, column: str, more: Dataset) -> Dataset:
        """This dataset followed by the rows of ``more``, whose vectors are added to the index on the column; vectors in it are not read again."""
        if column not in self.indices:
            raise ValueError(f"no index on {column}")
        d = self._counted()
        both = d.concat(more)
        added = both.frame.where(F.col(POS) >= d.n)
        return dataclasses.replace(both, indices={**self.indices, column: self.indices[column].add(added, column)})

    def _through(self, cache, name: str | None, operation: str, args: list, make: Callable[[], Dataset]) -> Dataset:
        from sparkset.plans.fingerprint import combine, generate

        key = name or combine(self.fingerprint, generate(operation, args))
        found = cache.get(key)
        if found is None:
            found = cache.put(key, make().dense().frame)
        return self._with(found, (Key(POS),), is_dense=True)

    def cached(self, cache, *key: Any) -> Dataset:
        """The same rows from a ``TableCache``, written there if they are not yet: under the fingerprint, or under a key of one's own."""
        from sparkset.plans.fingerprint import combine, generate

        name = generate("cached", key) if key else combine(self.fingerprint)
        d = self.dense()
        return d._with(cache.cached(name, lambda: d.frame), n=d.n, is_dense=True)

    @property
    def fingerprint(self) -> str:
        from sparkset.plans.fingerprint import of_frame

        return of_frame(self.frame, [dataclasses.astuple(k) for k in self.order])

    def __getattr__(self, name: str):
        """``to_csv``, ``to_json``, ``to_jsonl``, ``to_parquet``, ``to_arrow``, ``to_text``."""
        if name.startswith("to_"):
            from sparkset.sources import sinks

            if hasattr(sinks, name):
                return lambda *a, **k: getattr(sinks, name)(self, *a, **k)
        raise AttributeError(name)


@dataclasses.dataclass(frozen=True)
class Batches(Sequence):
    """Batches of a dataset whose positions are dense. Each is made as it is asked for; ``rows`` has all of them in one plan, whatever their number."""

    whole: Dataset
    size: int

    def __len__(self) -> int:
        return -(-self.whole.n // self.size)

    def __getitem__(self, i: int | slice) -> Dataset | list[Dataset]:
        if isinstance(i, slice):
            return [self[k] for k in range(*i.indices(len(self)))]
        k = range(len(self))[i]
        start = k * self.size
        return dataclasses.replace(self.whole._span(start, min(self.whole.n, start + self.size)), name=f"{self.whole.name}_batch_{k}")

    def rows(self, name: str = "batch") -> DataFrame:
        """The rows of all batches and the number of each row's batch, in no promised order."""
        return self.whole.frame.select(*[F.col(f"`{c}`") for c in self.whole.column_names if c != name], F.expr(f"`{POS}` div {self.size}").alias(name))


def _ranked_in_group(frame: DataFrame, column: str, block: int = 1_000_000) -> DataFrame:
    """``__rank``, a row's place in its group. Rows are ranked in blocks of positions, and blocks add up in a joined table, so a large group fills no task."""
    group, at = F.col(f"`{column}`"), F.floor(F.col(POS) / block)
    before = F.sum("__n").over(Window.partitionBy("__g").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    counts = frame.groupBy(group.alias("__g"), at.alias("__b")).agg(F.count("*").alias("__n")).select("__g", "__b", F.coalesce(before, F.lit(0)).alias("__before"))
    here = F.row_number().over(Window.partitionBy(f"`{column}`", "__at").orderBy(POS)) - 1
    ranked = frame.withColumn("__at", at).withColumn("__here", here).join(counts, group.eqNullSafe(F.col("__g")) & (F.col("__at") == F.col("__b")))
    return ranked.withColumn("__rank", F.col("__before") + F.col("__here")).drop("__at", "__here", "__g", "__b", "__before")


def _permutation(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """The positions of NumPy's seeded permutation of n, as a table; beyond ``MOST_PERMUTED`` in slices of a mapped file."""
    generator = np.random.Generator(np.random.PCG64(seed))
    if n <= MOST_PERMUTED:
        return _positions(spark, generator.permutation(n), np.arange(n))
    with tempfile.TemporaryFile() as file:  # the driver's own: only slices of it are sent
        drawn = np.memmap(file, np.int64, "w+", shape=(n,))
        for at in range(0, n, MOST_PERMUTED):
            drawn[at : at + MOST_PERMUTED] = np.arange(at, min(n, at + MOST_PERMUTED))
        generator.shuffle(drawn)  # which is what permutation(n) does
        slices = [_positions(spark, np.array(drawn[at : at + MOST_PERMUTED]), np.arange(at, min(n, at + MOST_PERMUTED))) for at in range(0, n, MOST_PERMUTED)]
    return reduce(DataFrame.unionAll, slices)


def _positions(spark: SparkSession, given: np.ndarray, out: np.ndarray) -> DataFrame:
    """A table of positions and where their rows go, by Arrow."""
    import pyarrow as pa

    return spark.createDataFrame(pa.table({POS: pa.array(given, pa.int64()), "__out": pa.array(out, pa.int64())}))


def truthy(x: Any) -> bool:
    """Anything but None and False, as predicates mean it."""
    return x is not None and x is not False


def _visible(row: dict) -> dict:
    return {k: v for k, v in row.items() if not k.startswith("__")}


def _hidden(row: dict) -> dict:
    return {k: v for k, v in row.items() if k.startswith("__")}


def _with_metadata(frame: DataFrame, metadata: dict[str, dict]) -> DataFrame:
    return frame.select(*[F.col(f"`{c}`").alias(c, metadata=metadata[c]) if c in metadata else F.col(f"`{c}`") for c in frame.columns])


def _inferred(rows: list, names: list[str]) -> T.StructType:
    from sparkset.functions.features import infer_value

    kinds = {c: next((infer_value(r[c]).spark_type() for r in rows if r.get(c) is not None), T.StringType()) for c in names}
    return T.StructType([*[T.StructField(c, kinds[c]) for c in names], T.StructField(POS, T.LongType())])
