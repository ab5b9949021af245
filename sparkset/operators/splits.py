"""Named splits of a dataset."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, MutableMapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkset.operators.dataset import Dataset


class SplitDict(MutableMapping[str, Dataset]):
    """Datasets by split name. Operators return new ones and apply to every split."""

    def __init__(self, splits: Mapping[str, Dataset] | None = None):
        self._splits = {str(k): v for k, v in (splits or {}).items()}

    @classmethod
    def read(cls, spark, path: str) -> SplitDict:
        """Splits of a table partitioned by ``split=<name>``."""
        names = sorted(r["split"] for r in spark.read.parquet(path).select("split").distinct().collect())
        return cls({n: Dataset.from_parquet(spark, f"{path}/split={n}", name=n) for n in names})

    def __getitem__(self, name: str) -> Dataset:
        return self._splits[str(name)]

    def __setitem__(self, name: str, value: Dataset) -> None:
        self._splits[str(name)] = value

    def __delitem__(self, name: str) -> None:
        del self._splits[str(name)]

    def __iter__(self) -> Iterator[str]:
        return iter(sorted(self._splits))

    def __len__(self) -> int:
        return len(self._splits)

    def put(self, name: str, value: Dataset) -> SplitDict:
        return SplitDict({**self._splits, str(name): value})

    def delete(self, name: str) -> SplitDict:
        return SplitDict({k: v for k, v in self._splits.items() if k != str(name)})

    def rename_split(self, old: str, new: str) -> SplitDict:
        return SplitDict({new if k == old else k: v for k, v in self._splits.items()})

    @property
    def split_names(self) -> list[str]:
        return list(self)

    @property
    def num_splits(self) -> int:
        return len(self)

    @property
    def column_names(self) -> dict[str, list[str]]:
        return {k: v.column_names for k, v in self.items()}

    def counted(self) -> DataFrame:
        """Rows of each split (``split``, ``n_rows``), in one job."""
        union = None
        for k, v in self.items():
            one = v.frame.select(F.lit(k).alias("split"))
            union = one if union is None else union.unionAll(one)
        return union.groupBy("split").agg(F.count("*").alias("n_rows"))

    @property
    def num_rows(self) -> dict[str, int]:
        found = {r["split"]: r["n_rows"] for r in self.counted().collect()} if self._splits else {}
        return {k: found.get(k, 0) for k in self}

    def info(self) -> dict[str, dict]:
        rows = self.num_rows
        return {k: {"num_rows": rows[k], "columns": v.column_names} for k, v in self.items()}

    def map(self, function: Callable[[Dataset], Dataset]) -> SplitDict:
        return SplitDict({k: function(v) for k, v in self.items()})

    def filter(self, predicate: Column | Callable) -> SplitDict:
        return self.map(lambda d: d.filter(predicate))

    def select(self, what) -> SplitDict:
        return self.map(lambda d: d.select(what))

    def shuffle(self, seed: int | None = None) -> SplitDict:
        return self.map(lambda d: d.shuffle(seed))

    def flatten(self) -> Dataset:
        """All splits one after the other, in the order of their names."""
        first, *others = self.values()
        return first.concat(*others)

    def write(self, path: str) -> None:
        for k, v in self.items():
            v.df.write.mode("overwrite").parquet(f"{path}/split={k}")
