"""Casts and validation of columns to logical types, as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkset.functions import features as ft

WHOLE = r"^[+-]?[0-9]+$"
DECIMAL = r"^[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"


class CastError(ValueError):
    """Numbers of values that don't fit, by column."""

    def __init__(self, wrong: Mapping[str, int]):
        super().__init__(f"values that cannot be cast: {dict(wrong)}")
        self.wrong = dict(wrong)


def cast_column_expr(c: Column, kind: T.DataType, feature: ft.Feature, strict: bool = False) -> Column:
    """The value cast to a logical type, null where it does not fit. Nulls stay null; strict makes null strings empty."""
    target = feature.spark_type()
    null = F.lit(None).cast(target)
    text = isinstance(kind, T.StringType)
    if isinstance(feature, ft.ClassLabel):
        if text:
            return F.nullif(F.array_position(F.array(*map(F.lit, feature.names)), c) - 1, F.lit(-1)).cast(target)
        return F.when(c.between(0, feature.num_classes - 1), c.cast(target))
    if isinstance(feature, ft.Sequence):
        if not isinstance(kind, T.ArrayType):
            return null
        made = F.transform(c, lambda x: cast_column_expr(x, kind.elementType, feature.feature, strict))
        return F.when(~F.exists(c, lambda x: failures(x, kind.elementType, feature.feature, strict)), made)
    if not isinstance(feature, ft.Value):
        return F.when(valid(c, kind, feature), c)
    name = feature.dtype
    if name == "string":
        made = F.to_json(c) if isinstance(kind, T.ArrayType | T.StructType | T.MapType) else c.cast("string")
        return F.coalesce(made, F.lit("")) if strict else made
    if name == "binary":
        return c.cast("binary") if isinstance(kind, T.StringType | T.BinaryType) else null
    if name == "bool":
        if isinstance(kind, T.BooleanType):
            return c
        if text:
            return F.when(c == "true", True).when(c == "false", False)
        return F.when(c == 1, True).when(c == 0, False) if isinstance(kind, T.NumericType) else null
    if not (text or isinstance(kind, T.NumericType)):
        return null
    if name.startswith("float"):
        number = F.when(c.rlike(DECIMAL), c.try_cast("double")) if text else c.cast("double")
        return number.cast(target)
    # fractions are cut off; whole numbers of up to 38 digits pass before the range is looked at
    number = F.when(c.rlike(WHOLE), c.try_cast("decimal(38,0)")) if text else F.when(c.cast("double").between(-9.3e18, 1.9e19), _truncated(c, kind))
    low, high = feature.bounds()
    if low is not None:
        number = F.when(number >= low, number)
    if high is not None:
        number = F.when(number <= high, number)
    return number.try_cast(target)


def _truncated(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.FractionalType):
        c = F.when(c < 0, F.ceil(c)).otherwise(F.floor(c))
    return c.try_cast("decimal(38,0)")


def failures(c: Column, kind: T.DataType, feature: ft.Feature, strict: bool = False) -> Column:
    """True where a cast fails. A null fails only if strict, and then in all types but strings."""
    made = cast_column_expr(c, kind, feature, strict)
    is_string = isinstance(feature, ft.Value) and feature.dtype == "string"
    return made.isNull() if strict and not is_string else c.isNotNull() & made.isNull()


def valid(c: Column, kind: T.DataType, feature: ft.Feature) -> Column:
    """True where a value is one of a logical type as it stands; false for null."""
    never = F.lit(False)
    if isinstance(feature, ft.ClassLabel):
        return F.coalesce(c.between(0, feature.num_classes - 1), never) if isinstance(kind, T.IntegralType) else never
    if isinstance(feature, ft.Sequence):
        return F.coalesce(F.forall(c, lambda x: valid(x, kind.elementType, feature.feature)), never) if isinstance(kind, T.ArrayType) else never
    if isinstance(feature, ft.Struct):
        if not isinstance(kind, T.StructType) or set(feature.fields) - set(kind.names):
            return never
        out = c.isNotNull()
        for k, v in feature.fields.items():
            out &= valid(c[k], kind[k].dataType, v)
        return out
    if isinstance(feature, ft.Array):
        return F.coalesce(_shaped(c, kind, feature.shape), never)
    if isinstance(feature, ft.Image | ft.Audio):
        if isinstance(kind, T.StringType | T.BinaryType):
            return c.isNotNull()
        if isinstance(kind, T.StructType) and {"bytes", "path"} & set(kind.names):
            return F.coalesce(*[c[k].cast("string") for k in ("bytes", "path") if k in kind.names]).isNotNull()
        return never
    if isinstance(feature, ft.Translation):
        if isinstance(kind, T.MapType):
            return F.coalesce(F.array_sort(F.map_keys(c)) == F.array(*map(F.lit, sorted(feature.languages))), never)
        return c.isNotNull() if isinstance(kind, T.StructType) and set(kind.names) == set(feature.languages) else never
    if isinstance(feature, ft.TranslationVariableLanguages):
        if not isinstance(kind, T.StructType) or not {"languages", "translation"} <= set(kind.names):
            return never
        return F.coalesce(F.size(c["languages"]) == F.size(c["translation"]), never)
    name, (low, high) = feature.dtype, feature.bounds()
    accepts = {"string": (T.StringType, T.BinaryType), "binary": (T.StringType, T.BinaryType), "bool": (T.BooleanType,)}.get(name, (T.FractionalType, T.IntegralType) if name.startswith("float") else (T.IntegralType,))
    if name == "uint64" and isinstance(kind, T.DecimalType):
        accepts = (T.DecimalType,)
    if not isinstance(kind, accepts):
        return never
    out = c.isNotNull()
    return out & (c >= low if low is not None else F.lit(True)) & (c <= high if high is not None else F.lit(True))


def _shaped(c: Column, kind: T.DataType, shape: tuple[int, ...]) -> Column:
    if not shape:
        return F.lit(not isinstance(kind, T.ArrayType))
    if not isinstance(kind, T.ArrayType):
        return F.lit(False)
    return (F.size(c) == shape[0]) & F.forall(c, lambda x: _shaped(x, kind.elementType, shape[1:]))


def validate(df: DataFrame, features: Mapping[str, ft.Feature]) -> dict[str, int]:
    """Numbers of invalid values by column, in one pass; a missing column is invalid in all rows."""
    checks = [F.count_if(~valid(F.col(f"`{k}`"), df.schema[k].dataType, v)).alias(k) if k in df.columns else F.count("*").alias(k) for k, v in features.items()]
    row = df.agg(*checks).first() if checks else {}
    return {k: row[k] for k in features if row[k]}


def translations_to_map(c: Column) -> Column:
    return F.map_from_arrays(c["languages"], c["translation"])
