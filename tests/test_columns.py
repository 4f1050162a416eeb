"""Column functions: paths, vectors and pixels."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from glimmergrid.functions.paths import entry_path, frame_path, is_archive, is_file_entry, parse_whitelist, whitelist
from glimmergrid.functions.pixels import HANDED, buffers, content_md5, normalize_pixels, resized
from glimmergrid.functions.vectors import dot, l2_normalize, reaches
from glimmergrid.schemas import check_frames, check_threshold


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("path, expected", [("a.zip", True), ("a.ZIP", False), ("d/.zip", False), ("d.zip/a", False), ("x.tar.gz", True), ("a.7z", True), ("a.rar", True), ("a.xz", True), ("a.png", False), ("a.zip.png", False)])
def test_is_archive(spark, path, expected):
    assert one(spark, is_archive(F.lit(path))) is expected


def test_paths(spark):
    assert one(spark, entry_path(F.lit("a.zip"), F.lit("/b/c"))) == "a.zip/b/c"
    assert one(spark, frame_path(F.lit("p"), F.lit(0))) == "p"
    assert one(spark, frame_path(F.lit("p"), F.lit(5))) == "p/5"
    assert one(spark, is_file_entry(F.lit("d/"))) is False
    assert one(spark, is_file_entry(F.lit("d/e"))) is True


def test_whitelist(spark):
    assert one(spark, parse_whitelist(F.lit("0;2;;5;2"))) == [0, 2, 5]
    assert one(spark, parse_whitelist(F.lit(""))) == []
    with pytest.raises(Exception, match="not a frame index"):
        one(spark, parse_whitelist(F.lit("x")))
    assert whitelist("0;2;;5;2") == {0, 2, 5} and whitelist("") == set()
    with pytest.raises(ValueError):
        whitelist("x")
    assert check_frames([]) is None


@pytest.mark.parametrize("t", [-0.1, 1.1, math.nan, "0.5", True])
def test_bad_thresholds(t):
    with pytest.raises(ValueError):
        check_threshold(t)


def test_vectors(spark):
    v = F.array(*[F.lit(float(x)) for x in (3, 4)])
    assert one(spark, l2_normalize(v)) == pytest.approx([0.6, 0.8])
    assert one(spark, dot(v, v)) == 25.0
    assert one(spark, l2_normalize(F.array(F.lit(0.0), F.lit(0.0)))) is None
    assert one(spark, reaches(F.lit(float("nan")), 0.8)) is False
    assert one(spark, reaches(F.lit(0.8), 0.8)) is True


@pytest.mark.parametrize("text", ["", "a", "abc", "message digest", "abcdefghijklmnopqrstuvwxyz"])
def test_md5_of_known_texts(spark, text):
    assert one(spark, content_md5(F.lit(text).cast("binary"))) == hashlib.md5(text.encode()).hexdigest()


def test_md5_of_a_frame(spark):
    data = bytes(150_528)
    assert spark.createDataFrame([(bytearray(data),)], "p binary").select(content_md5(F.col("p"))).first()[0] == hashlib.md5(data).hexdigest()


def test_pixels(spark):
    grey = np.full((3, 2, 1), 7, np.uint8)
    alpha = np.dstack([np.full((3, 2, 3), 9, np.uint8), np.zeros((3, 2, 1), np.uint8)])
    rows = [(bytearray(grey.tobytes()), 2, 3, 1), (bytearray(alpha.tobytes()), 2, 3, 4)]
    got = spark.createDataFrame(rows, "p binary, w int, h int, c int").select(normalize_pixels(F.col("p"), F.col("w"), F.col("h"), F.col("c")).alias("x")).collect()
    assert [set(r["x"]) for r in got] == [{7}, {9}] and all(len(r["x"]) == 150_528 for r in got)
    ramp = np.repeat(np.arange(224, dtype=np.uint8)[None, :, None], 224, axis=0)
    assert (resized(ramp)[:, :, 0] == ramp[:, :, 0]).all()


def test_buffers_are_handed_over_in_small_batches(spark):
    """A batch of 10,000 small images would be 1.5 GB of buffers."""
    n = 3 * HANDED + 5
    part = [pd.Series([bytes([i % 256]) if i % 7 else None for i in range(n)], dtype=object), *(pd.Series([1] * n) for _ in range(3))]
    handed = list(buffers(iter([tuple(part), tuple(c.iloc[:0] for c in part)])))
    assert max(map(len, handed)) <= HANDED and sum(map(len, handed)) == n
    rows = spark.range(n).selectExpr("id", "IF(id % 7 = 0, NULL, unhex(lpad(hex(id % 256), 2, '0'))) AS p").coalesce(1)
    got = rows.select("id", normalize_pixels(F.col("p"), F.lit(1), F.lit(1), F.lit(1)).alias("x")).selectExpr("id", "length(x) AS n", "hex(substring(x, 150528, 1)) AS last").collect()
    assert len(got) == n and all((r["n"], r["last"]) == ((150_528, f"{r['id'] % 256:02X}") if r["id"] % 7 else (None, None)) for r in got)


def test_equal_channels_are_stretched_once_with_the_same_result():
    rng = np.random.default_rng(2)
    for h, w in ((8, 8), (1, 5), (30, 22)):
        grey = rng.integers(0, 256, (h, w, 1), dtype=np.uint8)
        image = np.repeat(grey, 3, axis=2)
        image[-1, -1, 2] ^= 255
        assert (resized(np.repeat(grey, 3, axis=2)) == resized(grey)).all()
        assert (resized(image)[:, :, :2] == resized(grey)[:, :, :2]).all() and resized(image)[-1, -1, 2] == image[-1, -1, 2] != grey[-1, -1, 0]
