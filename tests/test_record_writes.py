"""Writes of record files: two phases, in an object store too, and cut off at every step."""

import io
import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from object_store import Store
from pyarrow import fs
from pyarrow._fs import _MockFileSystem

from glimmergrid.sources import records

MD5 = "0123456789abcdef" * 2
SCRIPT = """
import sys
from pyspark.sql import SparkSession, functions as F
from glimmergrid.sources.records import write_feature_records
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").getOrCreate()
def rows(a, b):
    return spark.range(a, b, 1, 4).select(F.concat(F.lit("f"), "id").alias("path"), F.lit("0123456789abcdef" * 2).alias("md5"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("vgg16"))
write_feature_records(rows(900, 950), sys.argv[1])
write_feature_records(rows(0, 1000), sys.argv[1])
write_feature_records(rows(1000, 1003), sys.argv[1], "append")
"""


def row(path):
    return {"path": path, "md5": MD5, "vgg16": [1.0, 2.0]}


def paths(data: bytes) -> list[str]:
    return [path for path, _, _ in records.read_records(io.BytesIO(data), len(data), 2)]


def test_an_object_store(tmp_path):
    """A Spark job writes into a store without a mount: replaces, then adds; three rows in four tasks make three files."""
    store = Store()
    try:
        root = str(Path(__file__).resolve().parents[1])
        env = os.environ | store.environment | {"PYTHONPATH": os.pathsep.join([root, os.environ.get("PYTHONPATH", "")])}
        subprocess.run([sys.executable, "-c", SCRIPT, "s3a://bucket/a/records"], env=env, check=True, timeout=240, capture_output=True, cwd=tmp_path)
        files = {k: v for k, v in store.objects.items() if not k.endswith("/")}
        assert all(k.startswith("bucket/a/records/part-") and k.endswith(".db") for k in files) and len(files) == 7
        assert sorted(p for data in files.values() for p in paths(data)) == sorted(f"f{i}" for i in range(1003))
    finally:
        store.shutdown()


class Lost(Exception):
    pass


class Failing:
    """A store whose driver is lost before its ``at``-th change, or, if ``half``, in the middle of writing it."""

    def __init__(self, store, at, half):
        self.store, self.left, self.half = store, at, half

    def __getattr__(self, name):
        call = getattr(self.store, name)
        if name in ("get_file_info", "open_input_file"):
            return call

        def change(*args, **kwargs):
            self.left -= 1
            if self.left < 0:
                if self.half and name == "open_output_stream":
                    with call(*args, **kwargs) as out:
                        out.write(b'{"job"')
                raise Lost
            return call(*args, **kwargs)

        return change


def held(store):
    """The paths that a reader of the folder sees."""
    found = [f.path for f in store.get_file_info(fs.FileSelector("d", allow_not_found=True)) if f.type == fs.FileType.File]
    assert all(f.endswith(".db") for f in found)
    return sorted(p for f in found for p in paths(store.open_input_file(f).read()))


def below(store, name):
    found = store.get_file_info(fs.FileSelector(f"d/{name}", recursive=True, allow_not_found=True))
    return [f.path for f in found if f.type == fs.FileType.File]


def staged_write(store, overwrite=True):
    """A writer with two tasks done, one of them twice, and one without rows."""
    writer = records.RecordWriter("d", overwrite, store)
    told = [writer.write([row("new 1"), row("new 2")]), writer.write([row("new 3")]), writer.write([]), None]
    writer.write([row("new 3")])
    return writer, told


@pytest.mark.parametrize("half", [False, True])
@pytest.mark.parametrize("overwrite", [False, True])
def test_a_driver_lost_at_any_step(overwrite, half):
    new, old = ["new 1", "new 2", "new 3"], ["old 1", "old 2"]
    after, ended, steps = sorted(new + ([] if overwrite else old)), set(), 0
    while True:
        store = _MockFileSystem()
        first = records.RecordWriter("d", True, store)
        first.commit([first.write([row("old 1")]), first.write([row("old 2")])])
        assert held(store) == old
        writer, told = staged_write(store, overwrite)
        assert held(store) == old
        writer.store = Failing(store, steps, half)
        try:
            writer.commit(told)
            break
        except Lost:
            manifests = below(store, "_manifests")
            published = any(store.open_input_file(m).read().endswith(b"\n") for m in manifests)
            assert records.RecordFolder("d", store).recover() == len(manifests)
            assert held(store) == (after if published else old) and below(store, "_manifests") == []
            assert not published or below(store, "_staged") == []
            assert records.RecordFolder("d", store).recover() == 0
            ended.add(tuple(held(store)))
        steps += 1
    assert held(store) == after and below(store, "_staged") == below(store, "_manifests") == []
    assert steps >= 5 and ended == {tuple(old), tuple(after)}


def test_the_next_write_finishes_the_last():
    store = _MockFileSystem()
    writer, told = staged_write(store)
    writer.store = Failing(store, 3, False)
    with pytest.raises(Lost):
        writer.commit(told)
    assert len(below(store, "_manifests")) == 1 and set(json.loads(store.open_input_file(below(store, "_manifests")[0]).read())) == {"job", "bring", "remove"}
    more = records.RecordWriter("d", False, store)
    more.commit([more.write([row("more")])])
    assert held(store) == ["more", "new 1", "new 2", "new 3"]


def test_a_failed_write_leaves_the_folder_as_it_was():
    store = _MockFileSystem()
    first = records.RecordWriter("d", True, store)
    first.commit([first.write([row("old")])])
    writer, told = staged_write(store)
    writer.abort(told)
    assert held(store) == ["old"] and below(store, "_staged") == []
    empty = records.RecordWriter("d", True, store)
    empty.commit([])
    assert held(store) == []


def test_a_published_file_that_is_gone_is_an_error():
    store = _MockFileSystem()
    writer, told = staged_write(store)
    store.delete_file(f"d/_staged/{writer.job}/{told[0].name}")
    with pytest.raises(FileNotFoundError):
        writer.commit(told)
