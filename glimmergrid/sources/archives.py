"""Entries of files and archives as rows, before anything is inflated.

A row says where an entry's bytes are: in its own column ``content``, or at an
``offset`` of a file. Only an archive's directory is read to make the rows, so one
archive of any size is many rows, dealt to tasks by bytes; each task then seeks to
its entries and inflates them one at a time.
"""

from __future__ import annotations

import io
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmergrid.functions.paths import archive_name, is_archive

#: A plain file, or an entry as it is, packed by DEFLATE, or by another method of the archive's own.
STORED, DEFLATED, OTHER = 0, 8, -1
PACKED = "source_path string, entry_name string, entry_ordinal long, path string, content binary, offset long, packed long, method int, size long, crc long, piece long, error string, first long, last long"
_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
ARROW = pa.schema([(name, _KINDS[kind]) for name, kind in (part.split() for part in PACKED.split(", "))])
COLUMNS = ARROW.names
#: Stores that a task opens itself: mounted folders, and those that Arrow has a client for.
SCHEMES = ("", "file", "s3", "s3a", "s3n", "gs", "gcs", "hdfs", "abfs", "abfss")
HEADER = 30


def scheme_of(path: str) -> str:
    scheme, colon, _ = path.partition(":")
    return scheme if colon and "/" not in scheme else ""


def store_of(path: str):
    """Arrow's client for a path's store, and the path there."""
    from pyarrow import fs

    scheme = scheme_of(path)
    if scheme in ("", "file"):
        return fs.LocalFileSystem(), re.sub("^/+", "/", path.removeprefix("file:") if scheme else path)
    rest = path.partition("://")[2]
    store, _ = fs.FileSystem.from_uri(f"{ {'s3a': 's3', 's3n': 's3'}.get(scheme, scheme) }://{rest.partition('/')[0]}/")
    return store, "/" + rest.partition("/")[2] if scheme == "hdfs" else rest


class StoredFile(io.RawIOBase):
    """A file of an Arrow client that fails as Python's files do."""

    def __init__(self, file):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, at: int, whence: int = 0) -> int:
        to = at + (0, self.file.tell(), self.file.size())[whence]
        if to < 0:
            raise OSError(f"there is no place {to} in a file")
        return self.file.seek(min(to, self.file.size()))

    def readinto(self, into) -> int:
        data = self.file.read(len(into))
        into[: len(data)] = data
        return len(data)

    def close(self) -> None:
        self.file.close()
        super().close()


def open_source(path: str) -> BinaryIO:
    """The file at ``path``, for reading at any place, from any of ``SCHEMES``."""
    store, name = store_of(path)
    return open(name, "rb") if scheme_of(path) in ("", "file") else stored_file(store, name)


def stored_file(store, name: str) -> BinaryIO:
    return io.BufferedReader(StoredFile(store.open_input_file(name)), 1 << 16)


def write_target(path: str, content: bytes) -> None:
    """A file at ``path`` in any of ``SCHEMES``; it appears under its name when it is complete."""
    store, name = store_of(path)
    folder, _, last = name.rpartition("/")
    store.create_dir(folder, recursive=True)
    waiting = f"{folder}/_{last}-{uuid.uuid4().hex}"
    with store.open_output_stream(waiting) as out:
        out.write(content)
    store.move(waiting, name)


def can_seek(listed: DataFrame) -> bool:
    """True if tasks can open all listed files themselves. A row per scheme comes back."""
    schemes = listed.select(F.regexp_extract("path", "^([A-Za-z0-9+.-]+):", 1).alias("scheme")).distinct().collect()
    return all(r["scheme"] in SCHEMES for r in schemes)


def inflated(data: bytes, method: int, size: int, crc: int) -> bytes:
    """An entry's bytes, checked against its directory."""
    if method == DEFLATED:
        reader = zlib.decompressobj(-15)
        data = reader.decompress(data, size + 1)
    if len(data) != size:
        raise ValueError(f"the entry doesn't have the {size} bytes that its directory tells")
    if zlib.crc32(data) != crc:
        raise ValueError("the entry's checksum is wrong")
    return data


def directory(path: str, file: BinaryIO, piece_bytes: int) -> Iterator[tuple]:
    """A row per entry of an archive, in pieces of about ``piece_bytes``; one row with an error if it has no directory."""
    try:
        infos = [i for i in zipfile.ZipFile(file).infolist() if not i.filename.endswith("/")]
    except Exception as e:
        yield path, None, 0, path, None, None, None, None, None, None, 0, f"{type(e).__name__}: {e}", None, None
        return
    before = 0
    for nth, i in enumerate(infos):
        plain = i.compress_type in (STORED, DEFLATED) and not i.flag_bits & 1
        yield path, i.filename, nth, f"{path}/{i.filename.lstrip('/')}", None, i.header_offset, i.compress_size, i.compress_type if plain else OTHER, i.file_size, i.CRC, before // piece_bytes, None, None, None
        before += i.compress_size + HEADER


def packed_bytes(file: BinaryIO, offset: int, packed: int) -> bytes:
    """An entry's bytes as they lie in the archive, behind its own header."""
    file.seek(offset)
    header = file.read(HEADER)
    if len(header) < HEADER or header[:4] != b"PK\x03\x04":
        raise ValueError("the entry has no header where its directory tells")
    name, extra = struct.unpack_from("<HH", header, 26)
    file.seek(offset + HEADER + name + extra)
    return file.read(packed)


def unpacked(file: BinaryIO, name: str, nth: int, offset: int, packed: int, method: int, size: int, crc: int) -> bytes:
    """An entry of an archive. Rare methods are left to the standard library, which reads the directory anew."""
    if method == OTHER:
        archive = zipfile.ZipFile(file)
        return archive.read([i for i in archive.infolist() if not i.filename.endswith("/")][nth])
    return inflated(packed_bytes(file, offset, packed), method, size, crc)


def batches_of(rows: Iterator[tuple], most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows in the columns of ``PACKED``, in batches of at most about ``most_bytes`` of content."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[4] or b"")
        if size >= most_bytes or len(held) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), ARROW.types)], schema=ARROW)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), ARROW.types)], schema=ARROW)


def entries_at(listed: DataFrame, piece_bytes: int) -> DataFrame:
    """Entries of listed files (``path``, ``length``), which tasks open themselves. Of archives only the directory is read."""

    def directories(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for path in b.column("path").to_pylist():
                try:
                    with open_source(path) as file:
                        yield from directory(path, file, piece_bytes)
                except OSError as e:
                    yield path, None, 0, path, None, None, None, None, None, None, 0, f"{type(e).__name__}: {e}", None, None

    archives = listed.filter(is_archive(F.col("path"))).select("path").mapInArrow(lambda batches: batches_of(directories(batches), piece_bytes), PACKED)
    null = {c: F.lit(None).cast(kind) for c, kind in (part.split() for part in PACKED.split(", "))}
    zero = F.lit(0).cast("long")
    plain = null | {"source_path": F.col("path"), "path": F.col("path"), "entry_ordinal": zero, "offset": zero, "packed": F.col("length"), "size": F.col("length"), "piece": zero}
    return archives.unionByName(listed.filter(~is_archive(F.col("path"))).select(*[c.alias(n) for n, c in plain.items()]))


def entries_in(files: DataFrame, piece_bytes: int) -> DataFrame:
    """Entries of files whose bytes are a column (``path``, ``content``); those of archives stay packed."""

    def cut_out(file: BinaryIO, row: tuple) -> tuple:
        """The row of a directory with the entry's bytes."""
        told = dict(zip(COLUMNS, row))
        try:
            if told["method"] == OTHER:
                data = unpacked(file, told["entry_name"], told["entry_ordinal"], told["offset"], told["packed"], OTHER, told["size"], told["crc"])
                told |= {"method": STORED, "content": data, "crc": zlib.crc32(data)}
            else:
                told["content"] = packed_bytes(file, told["offset"], told["packed"])
        except Exception as e:
            told["error"] = f"{type(e).__name__}: {e}"
        return tuple(told.values())

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                if archive_name(path):
                    file = io.BytesIO(content)
                    for row in directory(path, file, piece_bytes):
                        yield row if row[11] else cut_out(file, row)
                else:
                    yield path, None, 0, path, content, None, None, None, None, None, 0, None, None, None

    return files.select("path", "content").mapInArrow(lambda batches: batches_of(entries(batches), piece_bytes), PACKED)


def entry_bytes(rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """The entries of a task, one at a time, each as its row, its bytes and an error; a file stays open while its entries follow each other."""
    opened, name = None, None
    try:
        for b in rows:
            for row in b[COLUMNS].itertuples(index=False):
                data, error = None, row.error if isinstance(row.error, str) else None
                if error is None:
                    try:
                        if row.content is None and row.source_path != name:
                            if opened:
                                opened.close()
                            opened, name = None, None
                            opened, name = open_source(row.source_path), row.source_path
                        if row.entry_name is None and row.content is None:
                            opened.seek(0)
                            data = opened.read()
                        elif row.entry_name is None:
                            data = row.content
                        elif row.content is None:
                            data = unpacked(opened, row.entry_name, *map(int, (row.entry_ordinal, row.offset, row.packed, row.method, row.size, row.crc)))
                        else:
                            data = inflated(row.content, int(row.method), int(row.size), int(row.crc))
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                yield row, data, error
    finally:
        if opened:
            opened.close()


def frame_ranges(rows: DataFrame, count: Callable[[bytes], int], wanted: frozenset[int] | None, frames: int) -> DataFrame:
    """Entries of many frames as a row per ``frames`` of them (``first`` to ``last``); ranges without a wanted frame are left out.

    ``count`` tells how many frames a file has; where it fails, the row stays whole.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for row, data, error in entry_bytes(batches):
            whole = tuple(None if isinstance(x, float) and x != x else x for x in row)
            try:
                n = count(data) if error is None else 0
            except Exception:
                n = 0
            starts = sorted({k // frames * frames for k in wanted if k < n}) if wanted is not None else range(0, n, frames)
            if n <= frames:
                yield whole
            for first in starts if n > frames else ():
                yield (*whole[:-2], first, min(first + frames, n))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches_of(map(as_row, cut(batches)), 1 << 20):
            yield batch.to_pandas()

    return rows.mapInPandas(run, PACKED)


def as_row(row: tuple) -> tuple:
    """A row that came through pandas, with whole numbers again."""
    return tuple(int(x) if isinstance(x, float) else x for x in row)


