"""sparkset: ordered machine-learning datasets on PySpark DataFrames."""

from sparkset.functions.features import ClassLabel, Features, Sequence, Value
from sparkset.operators.dataset import Dataset
from sparkset.operators.sampler import k_fold, train_test_split
from sparkset.operators.sampler import random as random_sample
from sparkset.operators.sampler import stratified as stratified_sample
from sparkset.operators.splits import SplitDict
from sparkset.plans.cache import TableCache
from sparkset.session import build_session
from sparkset.sources.builder import BuilderConfig, DatasetBuilder, DatasetInfo, SplitGenerator, build
from sparkset.sources.formats import from_arrow, from_csv, from_json, from_parquet, from_text, parse
from sparkset.sources.loader import load, load_all_splits, load_dataset, load_from_file, load_local
from sparkset.sources.registry import get_metadata, list_available
from sparkset.streaming.iterable import IterableDataset

__all__ = [
    "BuilderConfig", "ClassLabel", "Dataset", "DatasetBuilder", "DatasetInfo", "Features", "IterableDataset", "Sequence", "SplitDict", "SplitGenerator", "TableCache", "Value",
    "build", "build_session", "from_arrow", "from_csv", "from_json", "from_parquet", "from_text", "get_metadata", "k_fold", "list_available", "load", "load_all_splits",
    "load_dataset", "load_from_file", "load_local", "parse", "random_sample", "stratified_sample", "train_test_split",
]
