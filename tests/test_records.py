"""Record files in parts: the same rows as in one piece, broken files included."""

import io
import os
import random
import struct

import pytest

from glimmergrid.sources import records

MD5 = "0123456789abcdef" * 2


def record(path: bytes, n: int, seed: int = 0) -> bytes:
    return struct.pack("<Q", len(path)) + path + MD5.encode() + random.Random(seed).randbytes(4 * n)


def whole(data: bytes, n: int):
    """Paths of the records before the first broken one, and whether there is one."""
    out = []
    try:
        for path, _, _ in records.read_records(io.BytesIO(data), len(data), n):
            out.append(path)
    except ValueError:
        return out, True
    return out, False


def read(spark, folder, n, large):
    rows = records.read_feature_records(spark, f"{folder}/*.db", "PERMISSIVE", n, large).collect()
    return sorted(r["path"] for r in rows if r["error"] is None), sum(r["error"] is not None for r in rows)


def files_of(seed):
    """Files whole, cut, with a broken record, with long paths, and with records inside records' paths and vectors."""
    rng = random.Random(seed)
    plain = b"".join(record(f"p{i}".encode() * rng.randint(1, 9), 4, i) for i in range(120))
    inner = b"".join(record(b"in", 4, i) for i in range(9))
    nested = b"".join(record(b"x" * 5, 4, i) + struct.pack("<Q", 0) + MD5.encode() + bytes(16) for i in range(20))
    hidden = b"".join(record(bytes(c for c in inner if c < 128)[:300], 4, i) for i in range(20))
    broken = bytearray(plain)
    broken[len(plain) // 2 : len(plain) // 2 + 60] = b"?" * 60
    long = b"".join(record(b"l" * k, 4, k) for k in (1, 70_000, 2, 3, 1_500, 4))
    return {"plain": plain, "cut": plain[:-rng.randint(1, 50)], "broken": bytes(broken), "nested": nested, "hidden": hidden, "long": long, "zeros": bytes(500), "one": record(b"a", 4), "tail": plain + b"\0\0\0"}


@pytest.mark.parametrize("large", [64, 333, 5_000])
def test_parts_equal_one_piece(spark, tmp_path, large):
    want, bad = [], 0
    for name, data in files_of(large).items():
        (tmp_path / f"{name}.db").write_bytes(data)
        paths, broken = whole(data, 4)
        want, bad = want + paths, bad + broken
    assert read(spark, tmp_path, 4, large) == (sorted(want), bad) == read(spark, tmp_path, 4, 1 << 30)
    with pytest.raises(Exception, match="record"):
        records.read_feature_records(spark, f"{tmp_path}/*.db", "FAILFAST", 4, large).collect()


def test_vectors_that_look_like_records(spark, tmp_path):
    """Vectors full of whole records mislead a search; walks that don't join are walked again."""
    inside = b"".join(record(b"", 0) for _ in range(40))[: 4 * 300]
    data = b"".join(struct.pack("<Q", 1) + bytes([97 + i % 26]) + MD5.encode() + inside for i in range(60))
    (tmp_path / "a.db").write_bytes(data)
    for large in (100, 1_000, 5_000):
        assert read(spark, tmp_path, 300, large) == (sorted(whole(data, 300)[0]), 0)
    small = b"".join(record(b"", 0) for _ in range(50))
    (tmp_path / "a.db").write_bytes(small)
    assert read(spark, tmp_path, 0, 70) == ([""] * 50, 0)


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    data = b"".join(record(f"file {i}".encode(), 512, i) for i in range(12_000))
    (tmp_path / "big.db").write_bytes(data)
    rows = records.read_feature_records(spark, f"{tmp_path}/big.db", "FAILFAST", 512, len(data) // 7)
    assert rows.rdd.getNumPartitions() >= 8 and rows.select("path").distinct().count() == rows.count() == 12_000
    files = spark.read.format("binaryFile").load(str(tmp_path / "big.db")).select("path", "length")
    parts = records.record_parts(files, 512, len(data) // 7)
    assert len(parts) in (7, 8) and max(end - start for _, start, end, _ in parts) < 0.2 * len(data)
    assert os.path.getsize(tmp_path / "big.db") == parts[-1][2]
