"""Pixel work on Spark image structs (row-major, channels last, one byte per channel)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.BinaryType())
def _crop_bytes(
    data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series, box: pd.DataFrame
) -> pd.Series:
    def cut(raw, h, w, c, x1, y1, x2, y2):
        if raw is None or h is None or h <= 0:
            return None
        pixels = np.frombuffer(raw, dtype=np.uint8).reshape(int(h), int(w), int(c))
        return pixels[int(y1) : int(y2), int(x1) : int(x2)].tobytes()

    rows = zip(data, height, width, channels, box["x1"], box["y1"], box["x2"], box["y2"])
    return pd.Series([cut(*row) for row in rows], dtype=object)


def crop_image(image: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Part of an image inside a clamped integer box, as another image struct."""
    box = F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    data = _crop_bytes(image["data"], image["height"], image["width"], image["nChannels"], box)
    empty = F.lit(0)
    return F.struct(
        image["origin"].alias("origin"),
        F.greatest(empty, y2 - y1).alias("height"),
        F.greatest(empty, x2 - x1).alias("width"),
        image["nChannels"].alias("nChannels"),
        image["mode"].alias("mode"),
        data.alias("data"),
    )


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def _crops_bytes(
    data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series, boxes: pd.Series
) -> pd.Series:
    def cut(raw, h, w, c, sides):
        if sides is None:
            return None
        if raw is None or h is None or h <= 0:
            return [None] * len(sides)
        pixels = np.frombuffer(raw, dtype=np.uint8).reshape(int(h), int(w), int(c))
        return [pixels[b["y1"] : b["y2"], b["x1"] : b["x2"]].tobytes() for b in sides]

    return pd.Series([cut(*row) for row in zip(data, height, width, channels, boxes)], dtype=object)


def crop_boxes(image: Column, boxes: Column) -> Column:
    """Parts of an image inside clamped integer boxes (``x1, y1, x2, y2``), as image structs in order.

    The pixels go to Python once, however many boxes there are.
    """
    sides = F.transform(boxes, lambda b: F.struct(*[b[n].alias(n) for n in ("x1", "y1", "x2", "y2")]))
    cut = _crops_bytes.asNondeterministic()(
        image["data"], image["height"], image["width"], image["nChannels"], sides
    )
    empty = F.lit(0)
    return F.zip_with(
        boxes,
        cut,
        lambda b, data: F.struct(
            image["origin"].alias("origin"),
            F.greatest(empty, b["y2"] - b["y1"]).alias("height"),
            F.greatest(empty, b["x2"] - b["x1"]).alias("width"),
            image["nChannels"].alias("nChannels"),
            image["mode"].alias("mode"),
            data.alias("data"),
        ),
    )


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _planes(
    data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series
) -> pd.Series:
    def scale(raw, h, w, c):
        if raw is None or not h or h <= 0:
            return None
        pixels = np.frombuffer(raw, dtype=np.uint8).reshape(int(h), int(w), int(c))
        unit = (pixels.astype(np.float32) / np.float32(255.0) - np.float32(0.5)) / np.float32(0.5)
        return unit.transpose(2, 0, 1).ravel()

    return pd.Series([scale(*row) for row in zip(data, height, width, channels)], dtype=object)


def normalized_planes(image: Column) -> Column:
    """Pixels scaled to -1..1 and laid out plane by plane, as a flat float array."""
    return _planes(image["data"], image["height"], image["width"], image["nChannels"])
