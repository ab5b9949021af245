"""Decoding of images. It needs the Pillow package, which is optional; without it images stay bytes and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Modes and what they decode to.
MODES = {"RGB": "RGB", "RGBA": "RGB", "L": "L"}
DECODED = "struct<height:int,width:int,channels:int,data:binary>"


def can_decode() -> bool:
    try:
        import PIL.Image  # noqa: F401
    except ImportError:
        return False
    return True


def decode_image(image: Column, mode: str = "RGB") -> Column:
    """Pixels of an image given as bytes, in Arrow batches; null for null and for bytes that are no image."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    if not can_decode():
        raise RuntimeError("decoding images needs Pillow")
    import pandas as pd

    @F.pandas_udf(DECODED)
    def run(values: pd.Series) -> pd.DataFrame:
        import io

        from PIL import Image

        def one(raw):
            try:
                picture = Image.open(io.BytesIO(raw)).convert(MODES[mode])
            except Exception:  # whatever is wrong with the bytes, the row has no pixels
                return (None, None, None, None)
            return (picture.height, picture.width, len(picture.getbands()), picture.tobytes())

        return pd.DataFrame([one(v) if v is not None else (None,) * 4 for v in values], columns=["height", "width", "channels", "data"])

    return run(image)


def decode_or_keep(df, column: str, mode: str = "RGB"):
    """A column ``column_decoded`` beside an image column of ``struct<bytes, path>``; all null where images can't be decoded here."""
    pixels = decode_image(F.col(f"`{column}`")["bytes"], mode) if can_decode() else F.lit(None).cast(DECODED)
    return df.withColumn(f"{column}_decoded", pixels)
