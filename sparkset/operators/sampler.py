"""Samples and folds that record in the metadata how they were drawn."""

from __future__ import annotations

import dataclasses
import random as _random
from collections.abc import Callable, Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkset.operators import allocate
from sparkset.operators.dataset import Dataset
from sparkset.plans.order import POS, Key, term_order


def _named(d: Dataset, suffix: str, **metadata) -> Dataset:
    return dataclasses.replace(d, name=f"{d.name}_{suffix}", metadata={**d.metadata, **metadata})


def random(d: Dataset, size: int = 100, seed: int | None = None) -> Dataset:
    """Exactly ``size`` rows (all, if fewer) without replacement, in random order."""
    seed = _random.getrandbits(62) if seed is None else seed
    return _named(d.shuffle(seed, "hash").take(size), f"random_{size}", sample_method="random", sample_size=size, seed=seed)


def stratified(d: Dataset, size: int, strata: str | Sequence[str], seed: int | None = None) -> Dataset:
    """Rounded shares of ``size`` for each value of a column, or of a field within it, drawn at random.

    Rows are ranked within a stratum by a hash; a threshold on the hash that is sure to keep enough rows comes first, so no stratum is
    sorted as a whole.
    """
    seed = _random.getrandbits(62) if seed is None else seed
    path = [strata] if isinstance(strata, str) else list(strata)
    value = F.col("`" + "`.`".join(path) + "`")
    frame = d.dense().frame.withColumn("__stratum", value)
    key, nulls_last = term_order(frame, "__stratum", False)
    sizes = frame.groupBy("__stratum", key.alias("v")).agg(F.count("*").alias("n")).orderBy(Key("v", nulls_last=nulls_last).expr()).collect()
    given = allocate.rounded_shares([(r["__stratum"], r["n"]) for r in sizes], size)
    bits = 1 << 40
    keep = {r["__stratum"]: bits if r["n"] < 10_000 else min(bits, int(bits * (given[r["__stratum"]] + 12 * (given[r["__stratum"]] + 25) ** 0.5) / r["n"])) for r in sizes}
    schema = T.StructType([T.StructField("__g", frame.schema["__stratum"].dataType), T.StructField("__take", T.LongType()), T.StructField("__below", T.LongType())])
    table = d.spark.createDataFrame([(g, n, keep[g]) for g, n in given.items()], schema)
    hashed = F.pmod(F.xxhash64(F.col(POS), F.lit(seed)), F.lit(bits))
    rows = frame.withColumn("__r", hashed).join(table, F.col("__stratum").eqNullSafe(F.col("__g"))).where("__r < __below")
    rows = rows.withColumn("__rank", F.row_number().over(Window.partitionBy("__stratum").orderBy("__r", POS))).where(F.col("__rank") <= F.col("__take"))
    made = d._with(rows, (Key("__stratum", nulls_last=nulls_last), Key("__rank")))
    return _named(made, f"stratified_{size}", sample_method="stratified", strata=path, strata_distribution=given, seed=seed)


def k_fold(d: Dataset, k: int = 5, shuffle: bool = True, seed: int | None = None, balanced: bool = False) -> list[dict[str, Dataset]]:
    """Train and test of each fold. Unless balanced, the last ``n % k`` rows are in no test fold."""
    rows = (d.shuffle(seed) if shuffle else d)._counted()
    out = []
    for fold in range(k):
        a, b = allocate.fold_bounds(rows.n, k, fold, balanced)
        inside = F.col(POS).between(a, b - 1)
        parts = {"train": rows._with(rows.frame.where(~inside)), "test": rows._with(rows.frame.where(inside))}
        out.append({s: _named(p, f"fold_{fold}_{s}", fold=fold, k=k, split=s) for s, p in parts.items()})
    return out


def train_test_split(d: Dataset, test_size: float = 0.2, shuffle: bool = True, seed: int | None = None) -> dict[str, Dataset]:
    rows = (d.shuffle(seed) if shuffle else d)._counted()
    cut = rows.n - allocate.round_half_away(rows.n * test_size)
    parts = {"train": rows._span(0, cut), "test": rows._span(cut, rows.n)}
    return {s: _named(p, s, split=s, split_ratio=1 - test_size if s == "train" else test_size) for s, p in parts.items()}


def shuffle(d: Dataset, seed: int | None = None) -> Dataset:
    return _named(d.shuffle(seed, "hash"), "shuffled", shuffled=True, seed=seed)


def take(d: Dataset, n: int) -> Dataset:
    return _named(d.take(n), f"take_{n}", taken=n)


def skip(d: Dataset, n: int) -> Dataset:
    return _named(d.skip(n), f"skip_{n}", skipped=n)


def filter(d: Dataset, predicate: Column | Callable) -> Dataset:
    return _named(d.filter(predicate), "filtered", filtered=True, original_size=d.n)
