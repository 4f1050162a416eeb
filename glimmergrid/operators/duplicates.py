"""Rows with the same content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exact_duplicates(features: DataFrame, *, path_col: str = "path", md5_col: str = "md5") -> DataFrame:
    """Hashes that more than one row has: ``md5``, ``n`` rows and the least ``first_path``. Pre-aggregated, so a very common hash costs a row per task."""
    found = features.groupBy(F.col(md5_col).alias("md5")).agg(F.count(F.lit(1)).alias("n"), F.min(path_col).alias("first_path"))
    return found.filter("n > 1")


def duplicate_members(features: DataFrame, *, path_col: str = "path", md5_col: str = "md5") -> DataFrame:
    """Every row of those groups with its group's ``first_path``: a row per member, so no group has to fit into one value."""
    groups = exact_duplicates(features, path_col=path_col, md5_col=md5_col)
    return features.select(F.col(path_col).alias("path"), F.col(md5_col).alias("md5")).join(groups, "md5").select("md5", "path", "first_path", "n")
