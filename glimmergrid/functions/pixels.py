"""Frames as buffers of 224 by 224 pixels in the order blue, green, red."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glimmergrid.schemas import SIDE

#: Frame buffers that a task hands over at once; a batch of small images is 10,000 rows, and buffers are much larger.
HANDED = 64


@lru_cache(maxsize=256)
def _weights(n: int, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of ``side`` places along ``n`` pixels: the pixel before, the one behind, and how far it is from the first."""
    at = np.clip((np.arange(side) + 0.5) * n / side - 0.5, 0, n - 1)
    low = np.floor(at).astype(int)
    return low, np.minimum(low + 1, n - 1), at - low


def _is_grey(image: np.ndarray) -> bool:
    """True if three channels are equal everywhere; most images in colour tell by their first line."""
    return all((part[:, :, 1:] == part[:, :, :1]).all() for part in (image[:1], image))


def resized(image: np.ndarray, side: int = SIDE) -> np.ndarray:
    """An image (height, width, channels) stretched to a square of three channels, bilinear between pixel centres."""
    if image.ndim == 2:
        image = image[:, :, None]
    # One channel is stretched once, and repeated at the end; so are three equal ones.
    image = image[:, :, :1] if image.shape[2] < 3 or _is_grey(image[:, :, :3]) else image[:, :, :3]
    if image.shape[:2] == (side, side):
        return np.ascontiguousarray(np.broadcast_to(image, (side, side, 3)), np.uint8)

    channels = image.shape[2]
    y0, y1, fy = _weights(image.shape[0], side)
    x0, x1, fx = (x.repeat(channels) for x in _weights(image.shape[1], side))
    channel = np.tile(np.arange(channels), side)
    fy = fy[:, None, None]
    # Lines first: of a large image only those that are needed become numbers.
    lines = (image[y0] * (1 - fy) + image[y1] * fy).reshape(side, -1)
    left, right = (lines.take(x * channels + channel, axis=1, mode="clip") for x in (x0, x1))
    right -= left
    right *= fx
    right += left
    out = np.rint(right, out=right).astype(np.uint8)
    return (out if channels == 3 else out.repeat(3, axis=1)).reshape(side, side, 3)


def buffers(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Frame buffers of batches of (pixels, width, height, channels), at most ``HANDED`` at a time."""
    for part in parts:
        for k in range(0, len(part[0]), HANDED):
            rows = zip(*(column.iloc[k : k + HANDED] for column in part))
            yield pd.Series([None if d is None else resized(np.frombuffer(d, np.uint8).reshape(h, w, c)).tobytes() for d, w, h, c in rows], dtype=object)


@F.pandas_udf(T.BinaryType())
def _normalized(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    yield from buffers(parts)


def normalize_pixels(pixels: Column, width: Column, height: Column, channels: Column) -> Column:
    """Pixels of any size (blue, green, red; one or four channels too) as a frame buffer; null stays null."""
    return _normalized(pixels, width, height, channels)


def content_md5(pixels: Column) -> Column:
    """Lower-case hex MD5 of a frame buffer."""
    return F.md5(pixels)
