"""Paths of files, archive entries and frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glimmergrid.schemas import ARCHIVE_ENDINGS


def is_archive(path: Column) -> Column:
    """True if the file name ends like an archive's; case matters, and a bare ending is no ending."""
    return F.regexp_extract(path, r"[^/](\.[^./]*)$", 1).isin(*ARCHIVE_ENDINGS)


def archive_name(path: str) -> bool:
    """The same for one path, inside a task."""
    name = path.rpartition("/")[2]
    return any(name.endswith(e) and len(name) > len(e) for e in ARCHIVE_ENDINGS)


def is_file_entry(name: Column) -> Column:
    """False for the directories of an archive."""
    return ~name.endswith("/")


def entry_path(archive: Column, name: Column) -> Column:
    """Path of an archive's entry; a leading slash of the name doesn't hide the archive."""
    return F.concat_ws("/", archive, F.regexp_replace(name, "^/+", ""))


def frame_path(path: Column, index: Column) -> Column:
    """The first frame has its file's path, later ones their index below it."""
    return F.when(index == 0, path).otherwise(F.concat_ws("/", path, index.cast("string")))


def parse_whitelist(text: Column) -> Column:
    """``"0;2;;5"`` as an array of distinct indexes; empty parts are skipped, anything but a number is an error."""
    parts = F.filter(F.split(text, ";"), lambda x: x != "")
    return F.array_distinct(F.transform(parts, lambda x: F.when(x.rlike("^[0-9]+$"), x.cast("bigint")).otherwise(F.raise_error(F.concat(F.lit("not a frame index: "), x)).cast("bigint"))))


def whitelist(text: str | None) -> frozenset[int]:
    """The same for an argument of a job."""
    parts = [p for p in (text or "").split(";") if p]
    if any(not (p.isascii() and p.isdigit()) for p in parts):
        raise ValueError(f"not a list of frame indexes: {text!r}")
    return frozenset(map(int, parts))
