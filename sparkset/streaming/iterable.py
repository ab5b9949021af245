"""Lazy datasets: plans over batch sources that run as they are pulled, and streams of files or other unbounded sources."""

from __future__ import annotations

import dataclasses
import itertools
import random
from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkset.operators.dataset import Dataset, truthy
from sparkset.plans.order import POS, Key


@dataclasses.dataclass(frozen=True)
class IterableDataset:
    """A pipeline over a dataset, a generator or a streaming DataFrame. Operators describe; iteration, ``take`` and ``to_list`` run.

    Over a dataset, steps are operators of the dataset, and ``take`` stops early as its plan does. Over a generator, steps pull one
    item at a time on the driver. Over a stream, steps are DataFrame operators and ``start`` writes to a sink.
    """

    data: Dataset | None = None
    make: Callable[[], Iterable[dict]] | None = None
    stream: DataFrame | None = None
    name: str = "iterable"
    info: Mapping[str, Any] = dataclasses.field(default_factory=dict)
    steps: tuple[Callable[[Iterator], Iterator], ...] = ()

    @classmethod
    def from_dataset(cls, data: Dataset) -> IterableDataset:
        return cls(data=data, name=data.name)

    @classmethod
    def from_generator(cls, make: Callable[[], Iterable[dict]], name: str = "generator") -> IterableDataset:
        """``make`` is called anew each time the items are iterated."""
        return cls(make=make, name=name)

    @classmethod
    def read_files(cls, spark: SparkSession, format: str, path: str, schema: Any, max_files: int | None = None, **options) -> IterableDataset:
        """A stream of the files that are or come to be in a folder."""
        reader = spark.readStream.format(format).schema(schema).options(**options)
        return cls(stream=(reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(path))

    def _step(self, step: Callable[[Iterator], Iterator]) -> IterableDataset:
        return dataclasses.replace(self, steps=(*self.steps, step))

    def _plain(self) -> bool:
        return self.data is not None and not self.steps

    def map(self, function: Mapping[str, Column] | Callable[[dict], Any], schema: Any = None) -> IterableDataset:
        """New items from expressions or a Python function. With ``schema``, the columns it returns, a function of a dataset's rows runs on the executors."""
        if isinstance(function, Mapping):
            if self.stream is not None:
                return dataclasses.replace(self, stream=self.stream.withColumns(dict(function)))
            if self._plain():
                return dataclasses.replace(self, data=self.data.map(function))
            raise TypeError("expressions apply before Python functions")
        if self.stream is not None:
            raise TypeError("on a stream, map takes expressions; use map_batches for Python")
        if schema is not None and self._plain():
            return dataclasses.replace(self, data=self.data.map(function, schema))
        return self._step(lambda rows: (function(r) for r in rows))

    def map_batches(self, function: Callable[[Iterator], Iterator], schema: Any) -> IterableDataset:
        """A function of an iterator of pandas frames, over a dataset or a stream."""
        if self.stream is not None:
            return dataclasses.replace(self, stream=self.stream.mapInPandas(function, schema))
        d = self.data
        return dataclasses.replace(self, data=Dataset.from_frame(d.ordered().mapInPandas(function, schema), name=d.name))

    def filter(self, predicate: Column | Callable[[dict], Any]) -> IterableDataset:
        if isinstance(predicate, Column):
            if self.stream is not None:
                return dataclasses.replace(self, stream=self.stream.where(predicate))
            if self._plain():
                return dataclasses.replace(self, data=self.data.filter(predicate))
            raise TypeError("expressions apply before Python functions")
        if self.stream is not None:
            raise TypeError("on a stream, filter takes expressions")
        if self._plain():  # on the executors
            return dataclasses.replace(self, data=self.data.filter(predicate))
        return self._step(lambda rows: (r for r in rows if truthy(predicate(r))))

    def skip(self, n: int) -> IterableDataset:
        if self.stream is not None:
            raise TypeError("a stream has no first rows to skip")
        if self._plain():
            return dataclasses.replace(self, data=self.data.skip(n))
        return self._step(lambda rows: itertools.islice(rows, n, None))

    def batch(self, size: int) -> IterableDataset:
        return self._step(lambda rows: (list(b) for b in itertools.batched(rows, size)))

    def shuffle(self, buffer_size: int, seed: int | None = None) -> IterableDataset:
        """Items through a buffer: one leaves at random as the next comes in, and the rest follow shuffled. No item leaves more than
        ``buffer_size - 1`` places early."""
        if buffer_size < 1:
            raise ValueError("buffer_size must be 1 or more")

        def run(rows: Iterator) -> Iterator:
            rng, held = random.Random(seed), []
            for r in rows:
                if len(held) < buffer_size:
                    held.append(r)
                    continue
                i = rng.randrange(buffer_size)
                yield held[i]
                held[i] = r
            rng.shuffle(held)
            yield from held

        return self._step(run)

    def shuffle_partitions(self, buffer_size: int, seed: int = 0) -> IterableDataset:
        """The same on the executors: each partition has its own buffer, and partitions keep their order."""
        d, kind = self.data, self.data.frame.schema

        def run(batches):
            import pyarrow as pa

            rows = (r for b in batches for r in b.to_pylist())
            part = None
            made = []
            for i, r in enumerate(IterableDataset(make=lambda: rows).shuffle(buffer_size, seed)):
                part = r["__part"] if part is None else part
                made.append(r | {"__nth": i})
                if len(made) == 10_000:
                    yield pa.RecordBatch.from_pylist(made, schema=arrow)
                    made = []
            if made:
                yield pa.RecordBatch.from_pylist(made, schema=arrow)

        from pyspark.sql.pandas.types import to_arrow_schema

        visible = [f for f in kind.fields if not f.name.startswith("__")]
        out = T.StructType([*visible, T.StructField("__part", T.IntegerType()), T.StructField("__nth", T.LongType())])
        arrow = to_arrow_schema(out)
        sent = d.ordered().withColumn("__part", F.spark_partition_id()).withColumn("__nth", F.lit(0).cast("long"))
        return dataclasses.replace(self, data=Dataset(sent.mapInArrow(run, out), (Key("__part"), Key("__nth")), name=d.name))

    def with_info(self, **info) -> IterableDataset:
        return dataclasses.replace(self, info={**self.info, **info})

    def __iter__(self) -> Iterator[Any]:
        if self.stream is not None:
            raise TypeError("a stream is started, not iterated")
        rows: Iterator = iter(self.data) if self.data is not None else iter(self.make())
        for step in self.steps:
            rows = step(rows)
        return rows

    def take(self, n: int) -> list:
        """The first n items; no more of the source is asked for than their plan needs."""
        if self._plain():
            return self.data.take(n).to_list()
        return list(itertools.islice(self, n))

    def to_list(self) -> list:
        return list(self)

    def to_dataset(self, spark: SparkSession | None = None, schema: Any = None) -> Dataset:
        if self._plain():
            return self.data
        return Dataset.from_list(spark or self.data.spark, self.to_list(), schema, name=self.name)

    def start(self, sink: Callable[[DataFrame, int], None] | str, checkpoint: str, path: str | None = None, available_now: bool = True):
        """Run a stream into a folder (of the format named) or into a function of each micro-batch."""
        writer = self.stream.writeStream.option("checkpointLocation", checkpoint)
        writer = writer.trigger(availableNow=True) if available_now else writer
        return writer.format(sink).start(path) if isinstance(sink, str) else writer.foreachBatch(sink).start()

    def start_batches(self, size: int, sink: Callable[[DataFrame, int], None], checkpoint: str):
        """Run a stream into a function of lists: each micro-batch with a column ``batch``, of ``size`` rows each but the last."""

        def numbered(df: DataFrame, epoch: int) -> None:
            d = Dataset.from_frame(df).dense()
            sink(d.frame.withColumn("batch", F.floor(F.col(POS) / size)).drop(POS), epoch)
            d.release()

        return self.start(numbered, checkpoint)
