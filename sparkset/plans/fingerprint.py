"""Fingerprints of operations and data."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame

VERSION = "1"


def _plain(x: Any) -> Any:
    if isinstance(x, Column):
        return str(x)
    if callable(x):
        return hashlib.sha256(cloudpickle.dumps(x)).hexdigest()
    return repr(x)


def generate(operation: str, args: Iterable[Any] = (), options: dict | None = None) -> str:
    """SHA-256 of an operation, its arguments and options. Functions count by their pickled code, not their names."""
    body = [VERSION, operation, [_plain(a) for a in args], {k: _plain(v) for k, v in sorted((options or {}).items())}]
    return hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()


def of_frame(df: DataFrame, order: Any = ()) -> str:
    """Fingerprint of a plan with its inputs; expression ids, which differ from run to run, don't count."""
    plan = re.sub(r"#\d+L?", "", df._jdf.queryExecution().optimizedPlan().toString())
    files = sorted(df.inputFiles()) if "Relation" in plan else []
    return generate("frame", [plan, files, str(order)])


def combine(*fingerprints: str) -> str:
    return hashlib.sha256("".join(fingerprints).encode()).hexdigest()
