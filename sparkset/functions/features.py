"""Logical types of columns and their Spark types. A type travels in the metadata of its column."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Iterable, Mapping
from typing import Any

import numpy as np
from pyspark.sql import types as T

_SPARK = {
    "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "float16": T.FloatType(), "float32": T.FloatType(), "float64": T.DoubleType(), "bool": T.BooleanType(), "string": T.StringType(), "binary": T.BinaryType(),
}
DTYPES = tuple(_SPARK)


class Feature:
    """A logical type."""

    def spark_type(self) -> T.DataType:
        raise NotImplementedError

    def metadata(self) -> dict:
        return {"sparkset": json.dumps(self.to_json())}

    def to_json(self) -> dict:
        plain = lambda v: v.to_json() if isinstance(v, Feature) else {k: plain(x) for k, x in v.items()} if isinstance(v, Mapping) else [plain(x) for x in v] if isinstance(v, list | tuple) else v
        return {"kind": type(self).__name__} | {f.name: plain(getattr(self, f.name)) for f in dataclasses.fields(self)}


@dataclasses.dataclass(frozen=True)
class Value(Feature):
    """A scalar of one of ``DTYPES``. Whole numbers of 8 and 16 bits are checked for range, unsigned ones for sign."""

    dtype: str

    def __post_init__(self):
        if self.dtype not in _SPARK:
            raise ValueError(f"unknown dtype: {self.dtype}")

    def spark_type(self) -> T.DataType:
        return _SPARK[self.dtype]

    def numpy_dtype(self) -> np.dtype:
        return np.dtype({"string": "object", "binary": "object"}.get(self.dtype, self.dtype))

    def bounds(self) -> tuple[int | None, int | None]:
        return {"int8": (-128, 127), "int16": (-32768, 32767), "uint8": (0, 255), "uint16": (0, 65535), "uint32": (0, None), "uint64": (0, None)}.get(self.dtype, (None, None))


string, int8, int16, int32, int64 = (Value(x) for x in ("string", "int8", "int16", "int32", "int64"))
uint8, uint16, uint32, uint64 = (Value(x) for x in ("uint8", "uint16", "uint32", "uint64"))
float16, float32, float64, boolean, binary = (Value(x) for x in ("float16", "float32", "float64", "bool", "binary"))


@dataclasses.dataclass(frozen=True)
class ClassLabel(Feature):
    names: list[str] | tuple[str, ...] = ()
    num_classes: int | None = None

    def __post_init__(self):
        n = self.num_classes if self.num_classes is not None else len(self.names)
        object.__setattr__(self, "names", list(self.names) or [f"class_{i}" for i in range(n)])
        object.__setattr__(self, "num_classes", n)

    def spark_type(self) -> T.DataType:
        return T.IntegerType()

    def int2str(self, i: int) -> str | None:
        return self.names[i] if -len(self.names) <= i < len(self.names) else None

    def str2int(self, name: str) -> int | None:
        return self.names.index(name) if name in self.names else None

    encode, decode = str2int, int2str


@dataclasses.dataclass(frozen=True)
class Sequence(Feature):
    """A list of one type. ``length`` is a note and is not checked."""

    feature: Feature
    length: int | None = None

    def spark_type(self) -> T.DataType:
        return T.ArrayType(self.feature.spark_type())

    @classmethod
    def of_strings(cls) -> Sequence:
        return cls(string)

    @classmethod
    def of_integers(cls) -> Sequence:
        return cls(int64)

    @classmethod
    def of_floats(cls) -> Sequence:
        return cls(float64)

    @classmethod
    def fixed(cls, feature: Feature, length: int) -> Sequence:
        return cls(feature, length)


@dataclasses.dataclass(frozen=True)
class Struct(Feature):
    fields: Mapping[str, Feature]

    def spark_type(self) -> T.DataType:
        return T.StructType([T.StructField(k, v.spark_type()) for k, v in self.fields.items()])


@dataclasses.dataclass(frozen=True)
class Array(Feature):
    """An array of 2 to 5 dimensions; its shape is checked, its numbers are not."""

    shape: tuple[int, ...]
    dtype: str = "float32"

    def __post_init__(self):
        object.__setattr__(self, "shape", tuple(self.shape))
        if not 2 <= len(self.shape) <= 5:
            raise ValueError("an array has 2 to 5 dimensions")

    def spark_type(self) -> T.DataType:
        kind = _SPARK[self.dtype]
        for _ in self.shape:
            kind = T.ArrayType(kind)
        return kind

    def to_numpy(self, value: list) -> np.ndarray:
        made = np.array(value, dtype=Value(self.dtype).numpy_dtype())
        if made.shape != self.shape:
            raise ValueError(f"shape {made.shape}, expected {self.shape}")
        return made


@dataclasses.dataclass(frozen=True)
class Image(Feature):
    mode: str = "RGB"
    decode: bool = True

    def spark_type(self) -> T.DataType:
        return T.StructType([T.StructField("bytes", T.BinaryType()), T.StructField("path", T.StringType())])

    @classmethod
    def rgb(cls) -> Image:
        return cls("RGB")

    @classmethod
    def grayscale(cls) -> Image:
        return cls("L")

    @classmethod
    def rgba(cls) -> Image:
        return cls("RGBA")


@dataclasses.dataclass(frozen=True)
class Audio(Feature):
    sampling_rate: int | None = None
    mono: bool = True
    decode: bool = True

    spark_type = Image.spark_type

    @classmethod
    def speech(cls) -> Audio:
        return cls(16_000)

    @classmethod
    def cd_quality(cls) -> Audio:
        return cls(44_100, False)


@dataclasses.dataclass(frozen=True)
class Translation(Feature):
    languages: tuple[str, ...]

    def spark_type(self) -> T.DataType:
        return T.StructType([T.StructField(x, T.StringType()) for x in self.languages])


@dataclasses.dataclass(frozen=True)
class TranslationVariableLanguages(Feature):
    languages: tuple[str, ...] = ()

    def spark_type(self) -> T.DataType:
        texts = T.ArrayType(T.StringType())
        return T.StructType([T.StructField("languages", texts), T.StructField("translation", texts)])


def infer_value(v: Any) -> Feature:
    """Type of a Python value; None and unknown types are strings, an empty list is one of strings."""
    if isinstance(v, bool):
        return boolean
    if isinstance(v, int):
        return int64
    if isinstance(v, float):
        return float64
    if isinstance(v, bytes | bytearray):
        return binary
    if isinstance(v, list | tuple):
        return Sequence(infer_value(v[0]) if v else string)
    if dataclasses.is_dataclass(v) and not isinstance(v, type):
        v = dataclasses.asdict(v)
    if isinstance(v, Mapping):
        return Struct({str(k): infer_value(x) for k, x in v.items()})
    return string


def of_type(kind: T.DataType) -> Feature:
    """Type of a Spark type."""
    for name in ("int8", "int16", "int32", "int64", "float32", "float64", "bool", "string", "binary"):
        if type(kind) is type(_SPARK[name]):
            return Value(name)
    if isinstance(kind, T.ArrayType):
        return Sequence(of_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return Struct({f.name: of_type(f.dataType) for f in kind.fields})
    return float64 if isinstance(kind, T.DecimalType) else string


def from_json(spec: Mapping[str, Any]) -> Feature:
    kinds = {c.__name__: c for c in (Value, ClassLabel, Sequence, Struct, Array, Image, Audio, Translation, TranslationVariableLanguages)}
    made = lambda v: from_json(v) if isinstance(v, Mapping) and "kind" in v else {k: made(x) for k, x in v.items()} if isinstance(v, Mapping) else v
    fields = {k: tuple(v) if isinstance(v, list) and k != "names" else made(v) for k, v in spec.items() if k != "kind"}
    return kinds[spec["kind"]](**fields)


class Features(dict[str, Feature]):
    """Types of columns by name."""

    @classmethod
    def infer(cls, row: Mapping[str, Any]) -> Features:
        return cls({str(k): infer_value(v) for k, v in row.items()})

    @classmethod
    def infer_from_items(cls, rows: Iterable[Mapping[str, Any]]) -> Features:
        return cls.infer(next(iter(rows), {}))

    @classmethod
    def of_schema(cls, schema: T.StructType, logical: Mapping[str, Feature] | None = None) -> Features:
        """Types from a schema: those in column metadata first, then ``logical`` where the Spark type agrees."""
        out = cls()
        for f in schema.fields:
            if "sparkset" in f.metadata:
                out[f.name] = from_json(json.loads(f.metadata["sparkset"]))
            elif logical and f.name in logical and logical[f.name].spark_type() == f.dataType:
                out[f.name] = logical[f.name]
            else:
                out[f.name] = of_type(f.dataType)
        return out

    def put(self, name: str, feature: Feature) -> Features:
        return Features({**self, name: feature})

    @property
    def column_names(self) -> list[str]:
        return list(self)

    def spark_schema(self) -> T.StructType:
        return T.StructType([T.StructField(k, v.spark_type(), True, v.metadata()) for k, v in self.items()])
