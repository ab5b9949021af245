"""Output formats: what iteration yields for a row and for a batch. Rows of data are not changed."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any, Protocol

import numpy as np


class Formatter(Protocol):
    def row(self, row: dict, columns: Sequence[str] | None = None) -> Any: ...

    def batch(self, rows: list[dict], columns: Sequence[str] | None = None) -> Any: ...


class Rows:
    """Rows as dicts; columns are not chosen here."""

    def row(self, row: dict, columns: Sequence[str] | None = None) -> dict:
        return row

    def batch(self, rows: list[dict], columns: Sequence[str] | None = None) -> list[dict]:
        return rows


class Numpy:
    """Numbers and lists of numbers as arrays (32-bit floats unless ``dtype`` says else), stacked in a batch; other values as they are."""

    def __init__(self, dtype: str | None = None):
        self.dtype = np.dtype(dtype) if dtype else None

    def _array(self, v: Any) -> Any:
        if isinstance(v, bool) or not isinstance(v, int | float | list | tuple) or v == []:
            return v
        made = np.asarray(v)
        if made.dtype.kind not in "iuf":
            return v
        return made.astype(self.dtype or (np.float32 if made.dtype.kind == "f" else made.dtype))

    def row(self, row: dict, columns: Sequence[str] | None = None) -> dict:
        return {k: self._array(v) for k, v in row.items() if columns is None or k in columns}

    def batch(self, rows: list[dict], columns: Sequence[str] | None = None) -> dict:
        if not rows:
            return {}
        made = {k: [self._array(r[k]) for r in rows] for k in rows[0] if columns is None or k in columns}
        alike = lambda v: all(isinstance(x, np.ndarray) and x.shape == v[0].shape for x in v)
        return {k: np.stack(v) if alike(v) else v for k, v in made.items()}


class Pandas:
    """Batches as pandas frames."""

    def row(self, row: dict, columns: Sequence[str] | None = None) -> dict:
        return row

    def batch(self, rows: list[dict], columns: Sequence[str] | None = None) -> Any:
        import pandas as pd

        df = pd.DataFrame(rows)
        return df[[c for c in columns if c in df]] if columns else df


class Arrow(Pandas):
    """Batches as Arrow tables."""

    def batch(self, rows: list[dict], columns: Sequence[str] | None = None) -> Any:
        import pyarrow as pa

        table = pa.Table.from_pylist(rows)
        return table.select([c for c in columns if c in table.column_names]) if columns else table


class Custom:
    """A function of each row, or of each batch."""

    def __init__(self, transform: Callable, batched: bool = False):
        self.transform, self.batched = transform, batched

    def row(self, row: dict, columns: Sequence[str] | None = None) -> Any:
        return self.transform([row])[0] if self.batched else self.transform(row)

    def batch(self, rows: list[dict], columns: Sequence[str] | None = None) -> Any:
        return self.transform(rows) if self.batched else [self.transform(r) for r in rows]


FORMATS: Mapping[str, type] = {"rows": Rows, "numpy": Numpy, "pandas": Pandas, "arrow": Arrow, "custom": Custom}


def formatter(name: str, **options) -> Formatter:
    if name not in FORMATS:
        raise ValueError(f"unknown format: {name}")
    return FORMATS[name](**options)
