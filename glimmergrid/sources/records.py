"""Files of feature records, for exchange with other programs.

A record is an unsigned 64-bit length, a path of that many bytes, 32 bytes of MD5
text and ``dimensions`` 32-bit floats, all little-endian. Files have no header
and no marks between records, so files can be joined by concatenation.

A large file is still read by many tasks. Each looks for the first place in its
part from which several records follow each other, and walks from there to the
first record of the next part. The walks of a file must join: where one ends, the
next has to begin. One that doesn't join has been misled, and walks again from
where the last one ended; where a walk meets a broken record, the file ends.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from glimmergrid.schemas import DIMENSIONS
from glimmergrid.sources.archives import SCHEMES, can_seek, open_source, scheme_of, store_of

#: Bytes of the parts of large files, and the most that Spark hands over as one value.
SPLIT_BYTES, MAX_VALUE = 128 << 20, 1 << 30
#: Records that must follow each other for a place to count as a record's beginning; bytes searched at a time.
CHAIN, WINDOW = 4, 1 << 20
WALKS = "path string, length long, start long, end long, known boolean, first long, last long, error string"
RECORDS = "path string, md5 string, vgg16 array<float>, error string"


def read_records(data: BinaryIO, left: int, dimensions: int) -> Iterator[tuple[str, str, np.ndarray]]:
    """The records of one stream of ``left`` bytes; a cut or broken record is an error."""
    while left:
        if left < 8:
            raise ValueError("the last record is cut in its length")
        (n,) = struct.unpack("<Q", data.read(8))
        if 8 + n + 32 + 4 * dimensions > left:
            raise ValueError(f"a record's path of {n} bytes goes beyond the file")
        body = data.read(n + 32 + 4 * dimensions)
        md5 = body[n : n + 32].decode("ascii")
        if not re.fullmatch("[0-9a-f]{32}", md5):
            raise ValueError("a record's hash isn't 32 hexadecimal digits")
        yield body[:n].decode("utf-8"), md5, np.frombuffer(body, "<f4", dimensions, n + 32)
        left -= 8 + len(body)


def record_bytes(path: str, md5: str, vector) -> bytes:
    name = path.encode("utf-8")
    return struct.pack("<Q", len(name)) + name + md5.encode("ascii") + np.asarray(vector, "<f4").tobytes()


def parse_records(files: DataFrame, mode: str = "FAILFAST", dimensions: int = DIMENSIONS) -> DataFrame:
    """Records of files (``path``, ``content``). PERMISSIVE gives a row with an ``error`` where a file breaks off, after its good records."""
    if mode not in ("FAILFAST", "PERMISSIVE"):
        raise ValueError(f"unknown mode {mode!r}")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                out: list[tuple] = []
                try:
                    for path, md5, vector in read_records(io.BytesIO(content), len(content), dimensions):
                        out.append((path, md5, vector, None))
                        if len(out) == 1024:
                            yield pd.DataFrame(out, columns=["path", "md5", "vgg16", "error"])
                            out = []
                except ValueError as e:
                    if mode == "FAILFAST":
                        raise
                    out.append((name, None, None, str(e)))
                if out:
                    yield pd.DataFrame(out, columns=["path", "md5", "vgg16", "error"])

    return files.select("path", "content").mapInPandas(parse, RECORDS)


def read_feature_records(spark: SparkSession, glob: str, mode: str = "FAILFAST", dimensions: int = DIMENSIONS, large: int = SPLIT_BYTES) -> DataFrame:
    """Features from record files. In PERMISSIVE mode errors are in a column ``error``.

    Files of up to ``large`` bytes come through Spark's file reader, from any
    store that Spark reads. That reader holds a file as one value, so larger ones are
    opened by the tasks, in parts of ``large`` bytes, from stores that tasks can open;
    in others the limit is ``MAX_VALUE``.
    """
    if mode not in ("FAILFAST", "PERMISSIVE"):
        raise ValueError(f"unknown mode {mode!r}")
    listed = spark.read.format("binaryFile").load(glob)
    large = large if can_seek(listed.select("path")) else MAX_VALUE
    found = parse_records(listed.filter(F.col("length") <= large), mode, dimensions)
    cut = listed.filter(F.col("length") > large).select("path", "length")
    if not cut.isEmpty():
        spark.dataSource.register(FeatureRecords)
        parts = record_parts(cut, dimensions, max(1, large))
        streamed = spark.read.format("feature_records").schema(RECORDS).options(parts=json.dumps(parts), mode=mode, dimensions=str(dimensions)).load()
        found = found.unionByName(streamed)
    return found if mode == "PERMISSIVE" else found.drop("error")


def record_end(file: BinaryIO, at: int, size: int, dimensions: int) -> int:
    """Where the record that begins at ``at`` ends; a cut or broken one is an error. Vectors aren't read."""
    file.seek(at)
    head = file.read(8)
    if len(head) < 8:
        raise ValueError("the last record is cut in its length")
    (n,) = struct.unpack("<Q", head)
    end = at + 8 + n + 32 + 4 * dimensions
    if end > size:
        raise ValueError(f"a record's path of {n} bytes goes beyond the file")
    body = file.read(n + 32)
    if not re.fullmatch(b"[0-9a-f]{32}", body[n:]):
        raise ValueError("a record's hash isn't 32 hexadecimal digits")
    body[:n].decode("utf-8")
    return end


def first_record(file: BinaryIO, start: int, end: int, size: int, dimensions: int) -> int | None:
    """The first place from ``start`` to ``end`` from which ``CHAIN`` records, or all up to the file's end, follow each other."""
    for base in range(start, end, WINDOW):
        file.seek(base)
        data = np.frombuffer(file.read(min(WINDOW, end - base) + 7), np.uint8)
        places = len(data) - 7
        if places <= 0:
            return None
        # A length of a path is small: its upper six bytes are zero.
        zero = np.concatenate(([0], np.cumsum(data != 0)))
        for at in np.flatnonzero(zero[8 : 8 + places] == zero[2 : 2 + places]):
            place = base + int(at)
            try:
                for _ in range(CHAIN):
                    if place < size:
                        place = record_end(file, place, size, dimensions)
            except ValueError:
                continue
            return base + int(at)
    return None


def walk(path: str, start: int, end: int, size: int, dimensions: int, known: bool) -> tuple[int | None, int | None, str | None]:
    """The first record that begins in a part, where the last one that begins there ends, and the error that ended the walk before."""
    with open_source(path) as file:
        first = start if known else first_record(file, start, end, size, dimensions)
        if first is None:
            return None, None, None
        at = first
        try:
            while at < min(end, size):
                at = record_end(file, at, size, dimensions)
        except ValueError as e:
            return first, at, str(e)
        return first, at, None


def record_parts(files: DataFrame, dimensions: int, part_bytes: int) -> list[tuple[str, int, int, str | None]]:
    """Parts of files (``path``, ``length``) that begin and end at records: path, start, end, and the error behind the last good record.

    Tasks walk the parts; a row per part comes to the driver, as parts of files do in any scan.
    """
    spark = files.sparkSession
    starts = files.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(part_bytes).cast("long"))))

    def walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(*r, *walk(r[0], r[2], r[3], r[1], dimensions, r[4])) for r in b[["path", "length", "start", "end", "known"]].itertuples(index=False, name=None)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in WALKS.split(", ")]).astype({"first": "Int64", "last": "Int64"})

    def run(asked: DataFrame) -> list:
        # Every part is a task's work of its own.
        return asked.repartition(max(spark.sparkContext.defaultParallelism, 1), "path", "start").mapInPandas(walked, WALKS).collect()

    parts = starts.select("path", "length", "start", F.least(F.col("start") + part_bytes, F.col("length")).alias("end"), (F.col("start") == 0).alias("known"))
    told = {(r["path"], r["end"]): r for r in run(parts)}
    while True:
        out, misled, at = [], [], {}
        for path, end in sorted(told):
            r, begin = told[path, end], at.get(path, 0)
            if begin is None or begin >= end:
                continue
            if r["first"] != begin:
                misled.append((path, r["length"], begin, end, True))
                at[path] = None
                continue
            at[path] = r["last"] if r["error"] is None else None
            out.append((path, begin, r["last"], r["error"]))
        if not misled:
            return out
        told |= {(r["path"], r["end"]): r for r in run(spark.createDataFrame(misled, "path string, length long, start long, end long, known boolean"))}


class RecordPart(InputPartition):
    def __init__(self, path: str, start: int, end: int, error: str | None):
        self.path, self.start, self.end, self.error = path, start, end, error


class RecordReader(DataSourceReader):
    """Streams parts of record files, one a task."""

    def __init__(self, parts: list[list], mode: str, dimensions: int):
        self.parts, self.mode, self.dimensions = parts, mode, dimensions

    def partitions(self) -> list[InputPartition]:
        return [RecordPart(*p) for p in self.parts]

    def read(self, partition: RecordPart) -> Iterator[tuple]:
        with open_source(partition.path) as data:
            data.seek(partition.start)
            for path, md5, vector in read_records(data, partition.end - partition.start, self.dimensions):
                yield path, md5, vector.tolist(), None
        if partition.error is not None:
            if self.mode == "FAILFAST":
                raise ValueError(partition.error)
            yield partition.path, None, None, partition.error


@dataclass
class Written(WriterCommitMessage):
    name: str
    records: int


class RecordFolder:
    """A folder of record files in any store that tasks can open, changed in two phases.

    Tasks write below ``_staged``, where no reader looks. A commit first writes its
    manifest, one file with the names to bring in and those to remove. From then on it holds:
    whoever finds the manifest does what it says, however often it was begun.
    Before, it is as if nothing had been written.
    """

    def __init__(self, path: str, store=None):
        self.path = path
        self.store, self.root = (store, path) if store is not None else store_of(path)
        self.root = self.root.rstrip("/")

    def staged(self, job: str) -> str:
        return f"{self.root}/_staged/{job}"

    def files(self, below: str = "") -> list[str]:
        from pyarrow import fs

        found = self.store.get_file_info(fs.FileSelector(self.root + below, allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == fs.FileType.File)

    def exists(self, at: str) -> bool:
        from pyarrow import fs

        return self.store.get_file_info(at).type == fs.FileType.File

    def publish(self, job: str, names: list[str], overwrite: bool) -> None:
        """Makes the staged files ``names`` the folder's, beside its own or in their place."""
        self.recover()
        old = [n for n in self.files() if n.endswith(".db")] if overwrite else []
        told = json.dumps({"job": job, "bring": names, "remove": old}).encode()
        self.store.create_dir(f"{self.root}/_manifests", recursive=True)
        # Stores differ in whether a half-written file can be seen, so it says itself whether it is whole.
        with self.store.open_output_stream(f"{self.root}/_manifests/{job}") as out:
            out.write(told + b"\n")
        self.apply(job)

    def apply(self, job: str) -> None:
        """Does what a manifest says. What was done already is passed over."""
        manifest = f"{self.root}/_manifests/{job}"
        with self.store.open_input_file(manifest) as file:
            told = file.read()
        if told.endswith(b"\n"):
            change = json.loads(told)
            for name in change["bring"]:
                if self.exists(at := f"{self.staged(job)}/{name}"):
                    self.store.move(at, f"{self.root}/{name}")
                elif not self.exists(f"{self.root}/{name}"):
                    raise FileNotFoundError(f"{at} was written, but is gone")
            for name in change["remove"]:
                if self.exists(at := f"{self.root}/{name}"):
                    self.store.delete_file(at)
        self.discard(job)
        self.store.delete_file(manifest)

    def recover(self) -> int:
        """Finishes commits that were cut off; returns how many there were."""
        jobs = self.files("/_manifests")
        for job in jobs:
            self.apply(job)
        return len(jobs)

    def discard(self, job: str) -> None:
        """Removes what a job has staged, attempts that were lost included."""
        from pyarrow import fs

        if self.store.get_file_info(at := self.staged(job)).type == fs.FileType.Directory:
            self.store.delete_dir(at)


class RecordWriter(DataSourceWriter):
    """One file a task; the driver publishes those of the attempts that count."""

    def __init__(self, folder: str, overwrite: bool, store=None):
        self.folder, self.job, self.overwrite, self.store = folder, uuid.uuid4().hex, overwrite, store

    def _folder(self) -> RecordFolder:
        return RecordFolder(self.folder, self.store)

    def write(self, rows) -> Written:
        at, name, n = self._folder(), f"part-{uuid.uuid4().hex}.db", 0
        at.store.create_dir(at.staged(self.job), recursive=True)
        with at.store.open_output_stream(f"{at.staged(self.job)}/{name}", buffer_size=1 << 20) as out:
            for r in rows:
                out.write(record_bytes(r["path"], r["md5"], r["vgg16"]))
                n += 1
        return Written(name, n)

    def commit(self, messages) -> None:
        self._folder().publish(self.job, [m.name for m in messages if m and m.records], self.overwrite)

    def abort(self, messages) -> None:
        self._folder().discard(self.job)


class FeatureRecords(DataSource):
    """Spark's format ``feature_records``: streams large files, and writes a folder, in stores that tasks can open."""

    @classmethod
    def name(cls) -> str:
        return "feature_records"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return RecordReader(json.loads(self.options["parts"]), self.options["mode"], int(self.options["dimensions"]))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return RecordWriter(self.options["path"], overwrite)


def to_records(df: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """Every feature row as the bytes of its record, in column ``content``."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if any(len(v) != dimensions for v in b["vgg16"]):
                raise ValueError(f"a feature doesn't have {dimensions} components")
            yield pd.DataFrame({"path": b["path"], "content": [record_bytes(*r) for r in zip(b["path"], b["md5"], b["vgg16"])]})

    return df.select("path", "md5", "vgg16").mapInPandas(encode, "path string, content binary")


def recover_records(folder: str) -> int:
    """Finishes writes into ``folder`` whose driver was lost while it published them; returns how many there were.

    The next write does so by itself. No write into the folder may be running.
    """
    return RecordFolder(folder).recover()


def write_feature_records(df: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """Writes the record files of ``folder``, one a partition, in their place (``overwrite``) or beside them (``append``).

    The folder is in any store that tasks can open. Partitions without rows make
    no file. One write into a folder may run at a time.
    """
    if mode not in ("overwrite", "append"):
        raise ValueError(f"unknown mode {mode!r}")
    if scheme_of(folder) not in SCHEMES:
        raise ValueError(f"record files are written in a mounted file system or a store that tasks can open, not in {scheme_of(folder)}:")
    df.sparkSession.dataSource.register(FeatureRecords)
    rows = df.select(F.col("path"), F.col("md5"), F.col("vgg16").cast("array<float>").alias("vgg16"), F.lit(None).cast("string").alias("error"))
    rows.write.format("feature_records").mode(mode).option("path", folder).save()
