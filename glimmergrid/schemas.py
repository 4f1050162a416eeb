"""Schemas of the tables, and checks of arguments."""

from __future__ import annotations

import math

from pyspark.sql import types as T

SIDE = 224
FRAME_BYTES = SIDE * SIDE * 3
DIMENSIONS = 512
THRESHOLD = 0.8
# File names with these endings are opened as archives; case matters.
ARCHIVE_ENDINGS = (".zip", ".7z", ".rar", ".gz", ".xz")

FEATURES = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("md5", T.StringType(), False),
        T.StructField("vgg16", T.ArrayType(T.FloatType(), False), False),
    ]
)
MATCHES = T.StructType(
    [
        T.StructField("query_path", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("md5", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("rank", T.IntegerType()),
    ]
)
FILES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)
ENTRIES = T.StructType(
    [
        T.StructField("source_path", T.StringType()),
        T.StructField("entry_name", T.StringType()),
        T.StructField("entry_ordinal", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("content", T.BinaryType()),
        T.StructField("error", T.StringType()),
    ]
)
FRAMES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("entry_ordinal", T.LongType()),
        T.StructField("frame_index", T.LongType()),
        T.StructField("pixels", T.BinaryType()),
        T.StructField("stage", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)
ERRORS = T.StructType([T.StructField("path", T.StringType()), T.StructField("stage", T.StringType()), T.StructField("error", T.StringType())])


def check_threshold(t: float) -> float:
    """``t`` if it is in [0, 1]; NaN is refused too."""
    if isinstance(t, bool) or not isinstance(t, (int, float)) or not 0 <= t <= 1 or math.isnan(t):
        raise ValueError(f"the threshold must be from 0 to 1, not {t!r}")
    return float(t)


def check_k(k: int | None) -> int | None:
    if k is not None and (isinstance(k, bool) or not isinstance(k, int) or k < 1):
        raise ValueError(f"k must be a positive integer or None, not {k!r}")
    return k


def check_frames(frames) -> frozenset[int] | None:
    """A whitelist of frame indexes; None for all. An empty list means all, too."""
    found = frozenset(int(f) for f in frames or ())
    if any(f < 0 for f in found):
        raise ValueError("frame indexes are not negative")
    return found or None
