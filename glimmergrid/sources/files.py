"""Files and the entries of archives."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmergrid.functions.paths import is_archive
from glimmergrid.schemas import ENTRIES
from glimmergrid.sources.archives import write_target

MAX_ENTRY = 1 << 30
#: What opening a file counts for when files are dealt to tasks, beside its bytes.
OPEN_BYTES = 64 << 10


def small_files(spark: SparkSession) -> SparkSession:
    """A session with the same settings, whose scans deal many small files to a task.

    By Spark's default opening a file counts like 4 MB, so that every few files are a task of
    their own; the scan keeps the setting of the session that made it.
    """
    other = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(name):
            other.conf.set(name, value)
    other.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", max(2, spark.sparkContext.defaultParallelism))
    other.conf.set("spark.sql.files.openCostInBytes", min(OPEN_BYTES, _bytes(spark.conf.get("spark.sql.files.openCostInBytes"))))
    return other


def _bytes(text: str) -> int:
    number, unit = re.fullmatch(r"([0-9]+)([a-z]*)", text.strip().lower()).groups()
    return int(number) << {"": 0, "b": 0, "k": 10, "kb": 10, "m": 20, "mb": 20, "g": 30, "gb": 30}[unit]


def read_files(spark: SparkSession, root: str | list[str], max_length: int | None = None) -> DataFrame:
    """All files below ``root`` (or the files of a list), with their bytes.

    Spark's file sources skip names that begin with ``_`` or ``.``; name such
    files in a list. Empty files are left out by Spark, too. ``max_length`` leaves
    out larger ones before they are read.
    """
    files = small_files(spark).read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files if max_length is None else files.filter(F.col("length") <= max_length)


def list_files(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """Path, length and time of all files below ``root``; bytes aren't read."""
    return read_files(spark, root).select("path", "length", "modificationTime")


def write_files(rows: DataFrame, folder: str) -> int:
    """Writes rows (``path``, relative, and ``content``) as files below ``folder``, in a store that tasks can open; returns how many.

    A file gets its name when it is complete, so a task may run again.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                write_target(f"{folder}/{path}", content)
            yield pd.DataFrame({"n": [len(b)]})

    return rows.select("path", "content").mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]


def archive_entries(path: str, content: bytes, max_entry: int = MAX_ENTRY) -> Iterator[tuple]:
    """Name, ordinal, path, bytes and error of each entry of an archive, inflated one at a time."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
        infos = [i for i in archive.infolist() if not i.filename.endswith("/")]
    except Exception as e:
        yield None, 0, path, None, f"{type(e).__name__}: {e}"
        return
    for nth, info in enumerate(infos):
        data, error = None, None
        try:
            if info.file_size > max_entry:
                raise ValueError(f"{info.file_size} bytes are over the limit of {max_entry}")
            data = archive.read(info)
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
        yield info.filename, nth, f"{path}/{info.filename.lstrip('/')}", data, error


def expand_archives(files: DataFrame, max_entry: int = MAX_ENTRY, partitions: int | None = None) -> DataFrame:
    """Archives as a row per entry, other files as they are.

    Directories inside archives are skipped. What can't be read is a row with an
    ``error``: the archive, or the one entry. Entries are inflated one at a time,
    and those larger than ``max_entry`` not at all. Entries are dealt out anew,
    as a big archive comes from one task.
    """

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ENTRIES.fieldNames()
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                for entry in archive_entries(path, content, max_entry):
                    yield pd.DataFrame([(path, *entry)], columns=columns)

    archives = files.filter(is_archive(F.col("path"))).select("path", "content").mapInPandas(expand, ENTRIES)
    archives = archives.repartition(partitions, "path") if partitions else archives.repartition("path")
    plain = files.filter(~is_archive(F.col("path"))).select(
        F.col("path").alias("source_path"), F.lit(None).cast("string").alias("entry_name"), F.lit(0).cast("long").alias("entry_ordinal"), "path", "content", F.lit(None).cast("string").alias("error")
    )
    return plain.unionByName(archives)


def failed_files(rows: DataFrame, stage: str | None = None) -> DataFrame:
    """The rows that failed, as a table of path, stage and error."""
    at = F.lit(stage) if stage else F.col("stage")
    return rows.filter(F.col("error").isNotNull()).select("path", at.alias("stage"), "error")
