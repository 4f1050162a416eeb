"""Choosing frames, images and rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmergrid.functions.vectors import reaches
from glimmergrid.schemas import THRESHOLD, check_frames, check_threshold

LITERALS = 10_000
#: Values of one list that Spark hands to Parquet one by one; longer lists become a range.
PUSHED = 10


def frame_whitelist(frames: DataFrame, indexes=()) -> DataFrame:
    """Frames whose index is listed; an empty list keeps all. Long lists are joined instead of written into the plan."""
    wanted = check_frames(indexes)
    if wanted is None:
        return frames
    if len(wanted) <= LITERALS:
        return frames.filter(F.col("frame_index").isin(sorted(wanted)))
    listed = frames.sparkSession.createDataFrame([(i,) for i in sorted(wanted)], "frame_index long")
    return frames.join(listed, "frame_index", "left_semi")


def first_frame(frames: DataFrame) -> DataFrame:
    return frames.filter(F.col("frame_index") == 0)


def first_image(frames: DataFrame) -> DataFrame:
    """The first decoded frame of each source file, in the order of entries and frames."""
    first = F.min_by(F.struct(*frames.columns), F.struct("entry_ordinal", "frame_index")).alias("first")
    return frames.filter(F.col("error").isNull()).groupBy("source_path").agg(first).select("first.*")


def threshold_filter(matches: DataFrame, t: float = THRESHOLD) -> DataFrame:
    """Matches with a score of at least ``t``; NaN is never one."""
    return matches.filter(reaches(F.col("score"), check_threshold(t)))


def find_by_md5(features: DataFrame, hashes: DataFrame, literals: int = 1_000) -> DataFrame:
    """Rows whose hash is among ``hashes`` (column ``md5``, in either case).

    Up to ``literals`` hashes are written into the filter, in groups that reach the
    Parquet scan, which skips row groups by their statistics and bloom filters.
    More are joined; Spark broadcasts the list if its size allows it.
    """
    wanted = hashes.select(F.lower("md5").alias("md5")).filter("md5 IS NOT NULL").distinct()
    # At most one more than may be written.
    few = [r["md5"] for r in wanted.limit(literals + 1).collect()]
    if len(few) > literals:
        return features.join(wanted, "md5", "left_semi")
    parts = [F.col("md5").isin(few[k : k + PUSHED]) for k in range(0, len(few), PUSHED)]
    return features.filter(reduce(lambda a, b: a | b, parts, F.lit(False)))
