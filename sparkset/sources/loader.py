"""Loading by name or from a repository of files, over any source."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkset.functions import shapes
from sparkset.operators.dataset import Dataset
from sparkset.operators.splits import SplitDict
from sparkset.plans.order import POS, Key
from sparkset.sources import formats, registry
from sparkset.sources.hub import HubSource
from sparkset.sources.resolve import LocalSource, Source, resolve

#: Subjects of the science subset of the multiple-choice benchmark.
STEM_SUBJECTS = (
    "abstract_algebra", "anatomy", "astronomy", "college_biology", "college_chemistry", "college_computer_science", "college_mathematics", "college_physics", "computer_security",
    "conceptual_physics", "electrical_engineering", "elementary_mathematics", "high_school_biology", "high_school_chemistry", "high_school_computer_science", "high_school_mathematics",
    "high_school_physics", "high_school_statistics", "machine_learning",
)


def load_dataset(spark: SparkSession, repo: str, config: str | None = None, split: str | None = None, streaming: bool = False, source: Source | None = None, max_files: int | None = None, revision: str | None = None, token: str | None = None):
    """Files of a repository: a split as a dataset (lazy with ``streaming``), or all splits. No file is left out unless ``max_files`` says so.

    ``revision`` and ``token`` are those of a hub's client, and take the place of what the source's has.
    """
    if streaming and split is None:
        raise ValueError("streaming needs a split")
    source = source or LocalSource()
    if revision or token:
        changes = {k: v for k, v in (("revision", revision), ("token", token)) if v}
        source = HubSource(dataclasses.replace(source.client, **changes), source.folder)
    _, found = resolve([f["path"] for f in source.list_files(repo)], config, split)
    made = {}
    for name, paths in found.items():
        local = [source.download(repo, p) for p in (paths[:max_files] if max_files else paths)]
        made[name] = formats.parse(spark, local, name=name)
    if streaming:
        from sparkset.streaming.iterable import IterableDataset

        return IterableDataset.from_dataset(made[split])
    return made[split] if split is not None else SplitDict(made)


def load_from_file(spark: SparkSession, path: str, **options) -> Dataset:
    return formats.parse(spark, path, **options)


def load_local(spark: SparkSession, path: str, name: str) -> Dataset:
    """JSON lines as canonical rows."""
    return shaped(formats.parse(spark, path, "jsonl", name=name), lambda df: shapes.local(df, name))


def shaped(d: Dataset, shape) -> Dataset:
    """A dataset through a row shape, in the same order."""
    df = shape(d.with_position())
    return Dataset(df.withColumnRenamed("pos", POS), (Key(POS),), name=d.name, metadata=d.metadata)


def load(spark: SparkSession, name: str, source: Source, split: str | None = None, sample_size: int | None = None, subjects: Sequence[str] | None = None, config: str | None = None) -> Dataset:
    """A catalogued dataset as canonical rows, from a source that has its repository.

    Files are read from ``config``, or else from the configuration that the catalogue names; a catalogue's ``default``, ``all`` and ``stem`` name no
    folder of their own, and leave the choice to the repository.
    """
    entry = registry.get_metadata(name)
    split = split or ("test" if name in ("math_500", "mmlu", "mmlu_stem", "humaneval") else "train")
    raw = load_dataset(spark, entry.repo, config or (None if entry.config in ("all", "stem", "default") else entry.config), split, source=source)
    if entry.shape == "multiple_choice":
        wanted = list(subjects) if subjects else list(STEM_SUBJECTS) if name == "mmlu_stem" else None
        # positions are counted among the wanted subjects
        d = raw.filter(F.col("subject").isin(*wanted)) if wanted else raw
        made = shaped(d, lambda df: shapes.multiple_choice(df, split))
    elif entry.shape in ("grade_school_math", "function_synthesis"):
        made = shaped(raw, shapes.SHAPES[entry.shape])
    else:
        made = shaped(raw, lambda df: shapes.SHAPES[entry.shape](df, name))
    notes = {"source": f"hub:{entry.repo}", "config": config or entry.config, "license": entry.license, "domain": entry.domain, "split": split}
    made = Dataset(made.frame, made.order, name=name, metadata=notes)
    return made.take(sample_size) if sample_size else made


def load_all_splits(spark: SparkSession, name: str, source: Source, splits: Sequence[str] = ("train", "validation", "test")) -> SplitDict:
    return SplitDict({s: load(spark, name, source, s) for s in splits})


def parse_jsonl_text(spark: SparkSession, content: str, schema: str, shape) -> Dataset:
    """JSON lines in a string, by a row shape. Lines that are not objects are left out, and positions keep the gaps."""
    lines = [x for x in content.split("\n") if x]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "pos long, line string")
    whole = df.withColumn("ok", F.from_json("line", "map<string,string>")).where("ok is not null") if lines else df
    rows = whole.select("pos", F.from_json("line", schema).alias("r")).select("pos", "r.*")
    return Dataset(shape(rows).withColumnRenamed("pos", POS), (Key(POS),))


def schema_of(example: dict) -> str:
    """Schema of one JSON object, as text."""
    from sparkset.functions.features import Features

    kind = Features.infer(json.loads(json.dumps(example))).spark_schema()
    return T.StructType([T.StructField(f.name, f.dataType) for f in kind.fields]).simpleString()
