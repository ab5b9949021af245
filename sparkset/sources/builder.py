"""Datasets by user-defined builders: a configuration gives split generators, and these give examples."""

from __future__ import annotations

import dataclasses
from abc import ABC, abstractmethod
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from sparkset.functions.features import Features
from sparkset.operators.dataset import Dataset
from sparkset.operators.splits import SplitDict
from sparkset.sources.download import DownloadManager


@dataclasses.dataclass(frozen=True)
class DatasetInfo:
    description: str = ""
    features: Features | None = None
    citation: str = ""
    homepage: str = ""
    license: str = ""
    version: str = "1.0"


@dataclasses.dataclass(frozen=True)
class BuilderConfig:
    name: str = "default"
    version: str = "1.0"
    description: str = ""
    data_dir: str | None = None
    options: Mapping[str, Any] = dataclasses.field(default_factory=dict)


@dataclasses.dataclass(frozen=True)
class SplitGenerator:
    name: str
    options: Mapping[str, Any] = dataclasses.field(default_factory=dict)


class DatasetBuilder(ABC):
    @abstractmethod
    def info(self) -> DatasetInfo: ...

    def configs(self) -> list[BuilderConfig]:
        return [BuilderConfig()]

    def default_config_name(self) -> str:
        return self.configs()[0].name

    @abstractmethod
    def split_generators(self, downloads: DownloadManager | None, config: BuilderConfig) -> list[SplitGenerator]: ...

    @abstractmethod
    def generate_examples(self, spark: SparkSession, options: Mapping[str, Any]) -> DataFrame | Iterable: ...


def build(spark: SparkSession, builder: DatasetBuilder, config: str | None = None, split: str | None = None, cache_dir: str | None = None) -> Dataset | SplitDict:
    """A split, or all. Examples are a DataFrame, rows, or pairs of a key and a row."""
    wanted = config or builder.default_config_name()
    chosen = next((c for c in builder.configs() if c.name == wanted), None)
    if chosen is None:
        raise KeyError(f"unknown config: {wanted}")
    generators = builder.split_generators(DownloadManager(cache_dir) if cache_dir else None, chosen)
    if not generators:
        raise ValueError("no splits found")
    info, made = builder.info(), {}
    for g in generators:
        if split is not None and g.name != split:
            continue
        found = builder.generate_examples(spark, g.options)
        options = {"name": g.name, "version": chosen.version, "metadata": {"config": chosen.name, "license": info.license}, "logical": info.features}
        if isinstance(found, DataFrame):
            made[g.name] = Dataset.from_frame(found, **options)
        else:
            rows = [x[1] if isinstance(x, tuple) else x for x in found]
            made[g.name] = Dataset.from_list(spark, rows, info.features.spark_schema() if info.features else None, **options)
    if split is not None:
        if split not in made:
            raise KeyError(f"no split {split}")
        return made[split]
    return SplitDict(made)
