"""Files, archives, frames, stores, records and the jobs over them."""

import hashlib
import io
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glimmergrid.functions.embedding import stub_model
from glimmergrid.functions.pixels import resized
from glimmergrid.plans import jobs
from glimmergrid.sources import records, store
from glimmergrid.sources.files import expand_archives, failed_files, list_files, read_files
from glimmergrid.sources.frames import decode_frames, read_images
from glimmergrid.streaming.ingest import arriving_files, stream_build, stream_features

MODEL = stub_model()


def png(image: np.ndarray) -> bytes:
    """An RGB, grey or RGBA image as PNG."""
    h, w, c = image.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + line.tobytes() for line in image)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def bmp(image: np.ndarray) -> bytes:
    h, w, _ = image.shape
    lines = b"".join(line[:, ::-1].tobytes() + bytes(-3 * w % 4) for line in image[::-1])
    return b"BM" + struct.pack("<IHHI", 54 + len(lines), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(lines), 0, 0, 0, 0) + lines


COLOUR = np.tile(np.array([255, 0, 7], np.uint8), (3, 2, 1))


def zipped(entries: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return out.getvalue()


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    (root / "sub dir").mkdir()
    (root / "a.png").write_bytes(png(COLOUR))
    (root / "sub dir" / "é#b%.png").write_bytes(png(COLOUR))
    (root / "a.bmp").write_bytes(bmp(COLOUR))
    (root / "a.ppm").write_bytes(b"P6\n# note\n2 3\n255\n" + COLOUR.tobytes())
    (root / "grey.png").write_bytes(png(np.full((2, 2, 1), 90, np.uint8)))
    (root / "alpha.png").write_bytes(png(np.full((2, 2, 4), 60, np.uint8)))
    (root / "n.txt").write_text("no image")
    (root / "empty.png").write_bytes(b"")
    (root / "black.png").write_bytes(png(np.zeros((2, 2, 3), np.uint8)))
    (root / "x.zip").write_bytes(zipped({"d/": b"", "d/e.png": png(COLOUR), "f.png": png(COLOUR)}))
    (root / "X.ZIP").write_bytes(zipped({"a.png": png(COLOUR)}))
    (root / "c.gz").write_bytes(b"\x1f\x8b not a zip")
    (root / "nest.zip").write_bytes(zipped({"in.zip": zipped({"a.png": png(COLOUR)})}))
    (root / "none.zip").write_bytes(zipped({}))
    broken = bytearray(zipped({"1.png": png(COLOUR), "2.png": png(COLOUR), "3.png": png(COLOUR)}))
    second = broken.index(b"2.png") + 30
    broken[second] ^= 255
    (root / "bad.zip").write_bytes(bytes(broken))
    return str(root)


def name(path: str, root: str) -> str:
    return path.removeprefix("file:").removeprefix(root + "/")


def test_listing(spark, tree):
    assert list_files(spark, tree).count() == 14  # Spark leaves out empty files
    assert set(list_files(spark, tree).columns) == {"path", "length", "modificationTime"}


def test_archives(spark, tree):
    rows = expand_archives(read_files(spark, tree)).collect()
    got = {name(r["path"], tree): r["error"] is None for r in rows}
    assert got["x.zip/d/e.png"] and got["x.zip/f.png"] and "x.zip/d/" not in got
    assert got["bad.zip/1.png"] and not got["bad.zip/2.png"] and got["bad.zip/3.png"]
    assert not got["c.gz"] and got["X.ZIP"] and got["nest.zip/in.zip"] and not any(n.startswith("none.zip") for n in got)
    large = expand_archives(read_files(spark, tree), max_entry=10)
    assert {name(r["path"], tree) for r in failed_files(large, "archive").collect()} >= {"x.zip/f.png", "c.gz"}


def test_frames(spark, tree):
    rows = decode_frames(expand_archives(read_files(spark, tree))).collect()
    pixels = {name(r["path"], tree): bytes(r["pixels"]) for r in rows if r["error"] is None}
    colour = bytes([7, 0, 255]) * (224 * 224)
    for n in ("a.png", "a.bmp", "a.ppm", "sub dir/é#b%.png", "x.zip/d/e.png", "x.zip/f.png", "bad.zip/1.png"):
        assert pixels[n] == colour
    assert set(pixels["grey.png"]) == {90} and set(pixels["alpha.png"]) == {60}
    assert {name(r["path"], tree) for r in rows if r["error"] is not None} == {"n.txt", "X.ZIP", "c.gz", "nest.zip/in.zip", "bad.zip/2.png"}


def test_image_source_agrees(spark, tree):
    by_spark = {name(r["path"], tree): r for r in read_images(spark, tree).collect()}
    for n in ("a.png", "a.bmp", "sub dir/é#b%.png"):
        assert bytes(by_spark[n]["pixels"]) == bytes([7, 0, 255]) * 6
    assert by_spark["n.txt"]["error"]


def test_many_frames(spark):
    def six(data, wanted):
        for i in range(6):
            if data == b"fails" and i == 3:
                raise ValueError("frame 3")
            if wanted is None or i in wanted:
                yield i, np.full((2, 2, 3), 10 * i + 1, np.uint8)

    rows = [("p", None, 0, "p", bytearray(b"x"), None), ("q", None, 0, "q", bytearray(b"fails"), None)]
    entries = spark.createDataFrame(rows, "source_path string, entry_name string, entry_ordinal long, path string, content binary, error string")
    got = decode_frames(entries, None, six).collect()
    assert sorted(r["path"] for r in got if r["error"] is None) == ["p", *(f"p/{i}" for i in range(1, 6)), "q", "q/1", "q/2"]
    assert [(r["path"], r["stage"]) for r in got if r["error"]] == [("q", "decode")]
    assert sorted(r["path"] for r in decode_frames(entries.filter("path = 'p'"), {0, 2, 5}, six).collect()) == ["p", "p/2", "p/5"]


def test_png_filters(spark):
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (5, 4, 3), dtype=np.uint8)
    lines, above = [], np.zeros(12, np.int64)
    for y, line in enumerate(image.reshape(5, 12).astype(np.int64)):
        left = np.concatenate((np.zeros(3, np.int64), line[:-3]))
        corner = np.concatenate((np.zeros(3, np.int64), above[:-3]))
        near = np.stack([abs(above - corner), abs(left - corner), abs(left + above - 2 * corner)])
        guess = [np.zeros(12, np.int64), left, above, (left + above) // 2, np.choose(near.argmin(axis=0), [left, above, corner])][y]
        lines.append(bytes([y]) + ((line - guess) % 256).astype(np.uint8).tobytes())
        above = line
    data = png(image)
    at = data.index(b"IDAT")
    body = zlib.compress(b"".join(lines))
    data = data[: at - 4] + struct.pack(">I", len(body)) + b"IDAT" + body + bytes(4)
    entries = spark.createDataFrame([("p", None, 0, "p", bytearray(data), None)], "source_path string, entry_name string, entry_ordinal long, path string, content binary, error string")
    told = decode_frames(entries).first()
    assert bytes(told["pixels"]) == resized(image[:, :, ::-1]).tobytes()


def test_build_and_query(spark, tree, tmp_path):
    out = str(tmp_path / "store")
    told = jobs.build(spark, tree, out, MODEL)
    features = jobs.features_of(spark, out)
    assert told == {"features": 10, "errors": 6}
    rows = features.collect()
    assert all(abs(sum(x * x for x in r["vgg16"]) - 1) < 1e-6 for r in rows)
    assert {r["md5"] for r in rows if r["path"].endswith(("/a.png", "/a.bmp", "/a.ppm"))} == {hashlib.md5(bytes([7, 0, 255]) * (224 * 224)).hexdigest()}
    assert "black.png" in {name(r["path"], tree) for r in jobs.errors_of(spark, out).collect()}
    got = jobs.query(spark, features, f"{tree}/x.zip", MODEL, 0.99).collect()
    assert len(got) >= 8 and got[0]["score"] == pytest.approx(1.0, abs=1e-6)
    batch = jobs.batch_query(spark, features, read_files(spark, [f"{tree}/a.png", f"{tree}/grey.png"]), MODEL, 0.9, 3)
    assert {r["query_path"].rpartition("/")[2] for r in batch.collect()} == {"a.png", "grey.png"}
    groups, pairs = jobs.dedup_report(features, 0.999)
    assert groups.first()["n"] == 8 and pairs.count() >= 28
    with pytest.raises(ValueError):
        jobs.query(spark, features, f"{tree}/n.txt", MODEL)


def test_store(spark, tmp_path):
    rows = spark.createDataFrame([("a", "0" * 32, [1.0, 0.0])], "path string, md5 string, vgg16 array<float>")
    both = store.union_features(rows, rows)
    store.save_features(both, str(tmp_path / "s"))
    store.save_features(both, str(tmp_path / "s"))
    assert store.count_features(store.load_features(spark, str(tmp_path / "s"))) == 2
    store.write_matches(rows.select("path"), str(tmp_path / "m"), "json")
    assert spark.read.json(str(tmp_path / "m")).count() == 1


def record(path: str, n: int = 4) -> bytes:
    return struct.pack("<Q", len(path.encode())) + path.encode() + b"0123456789abcdef" * 2 + struct.pack(f"<{n}f", *range(n))


def test_records(spark, tmp_path):
    (tmp_path / "one.db").write_bytes(record("é"))
    (tmp_path / "two.db").write_bytes(record("é") + record("b"))
    (tmp_path / "none.db").write_bytes(b"")
    rows = records.read_feature_records(spark, str(tmp_path / "*.db"), dimensions=4)
    assert sorted(r["path"] for r in rows.collect()) == ["b", "é", "é"]
    out = str(tmp_path / "out")
    records.write_feature_records(rows, out)
    records.write_feature_records(rows.coalesce(1), out)
    files = sorted((tmp_path / "out").glob("*.db"))
    assert len(files) == 1 and len(files[0].read_bytes()) == 2 * len(record("é")) + len(record("b"))
    assert records.read_feature_records(spark, out + "/*.db", dimensions=4).count() == 3
    streamed = records.read_feature_records(spark, str(tmp_path / "*.db"), dimensions=4, large=60)
    assert sorted(map(str, streamed.collect())) == sorted(map(str, rows.collect()))
    assert records.record_bytes("é", "0123456789abcdef" * 2, [0, 1, 2, 3]) == record("é")


@pytest.mark.parametrize("large", [1 << 30, 0])
@pytest.mark.parametrize("cut", [3, 8, 20, -1])
def test_cut_records(spark, tmp_path, cut, large):
    (tmp_path / "cut.db").write_bytes(record("a") + record("bb")[:cut])
    rows = records.read_feature_records(spark, str(tmp_path / "cut.db"), "PERMISSIVE", 4, large).collect()
    assert [r["error"] is None for r in rows] == [True, False]
    with pytest.raises(Exception, match="record"):
        records.read_feature_records(spark, str(tmp_path / "cut.db"), "FAILFAST", 4, large).collect()


def test_stream(spark, tree, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "a.png").write_bytes(png(COLOUR))
    (root / "n.txt").write_text("x")
    out, at = str(tmp_path / "out"), str(tmp_path / "at")
    stream_features(arriving_files(spark, str(root), 1), out, at, MODEL).awaitTermination()
    (root / "x.zip").write_bytes(zipped({"b.png": png(COLOUR), "c.png": png(COLOUR)}))
    stream_features(arriving_files(spark, str(root), 1), out, at, MODEL).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert sorted((r["path"].rpartition("/")[2], r["error"] is None) for r in rows) == [("a.png", True), ("b.png", True), ("c.png", True), ("n.txt", False)]
    stored, at = str(tmp_path / "store"), str(tmp_path / "at2")
    stream_build(arriving_files(spark, str(root), 2), stored, at, MODEL).awaitTermination()
    stream_build(arriving_files(spark, str(root)), stored, at, MODEL).awaitTermination()
    assert sorted(r["path"].rpartition("/")[2] for r in jobs.features_of(spark, stored).collect()) == ["a.png", "b.png", "c.png"]


def test_jpeg(spark, tmp_path):
    """Files that only Spark's image source reads: in a folder with others, and as a query."""
    jvm = spark._jvm
    picture = jvm.java.awt.image.BufferedImage(16, 16, 1)
    graphics = picture.createGraphics()
    graphics.setColor(jvm.java.awt.Color(200, 100, 50))
    graphics.fillRect(0, 0, 16, 16)
    root = tmp_path / "pictures"
    root.mkdir()
    jvm.javax.imageio.ImageIO.write(picture, "jpg", jvm.java.io.File(str(root / "a.JPG")))
    (root / "bad.jpeg").write_text("x")
    (root / "b.png").write_bytes(png(COLOUR))
    out = str(tmp_path / "store")
    assert jobs.build(spark, str(root), out, MODEL) == {"features": 2, "errors": 1}
    got = jobs.query(spark, jobs.features_of(spark, out), str(root / "a.JPG"), MODEL, 0.999).collect()
    assert got[0]["path"].endswith("a.JPG") and got[0]["score"] == pytest.approx(1.0, abs=1e-6)


def test_files_are_decoded_once(spark, tree):
    plan = jobs.frame_features(read_files(spark, tree), MODEL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "Exchange" not in plan


def test_records_need_a_store_that_tasks_can_open(spark, tmp_path):
    rows = spark.createDataFrame([("a", "0" * 32, [1.0])], "path string, md5 string, vgg16 array<float>")
    with pytest.raises(ValueError, match="mounted"):
        records.write_feature_records(rows, "wasb://bucket/records")
    with pytest.raises(ValueError, match="mode"):
        records.write_feature_records(rows, str(tmp_path), "ignore")
    for path in ("file:///a/b", "file:/a/b", "/a/b", "/a/b/"):
        assert records.RecordFolder(path).root == "/a/b"


def test_small_files_are_few_tasks(spark, tmp_path):
    """300 files of a byte are a few tasks, also inside a plan of the first session, whose settings stay."""
    from glimmergrid.sources.files import small_files

    for i in range(300):
        (tmp_path / f"f{i}").write_bytes(b"x")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    listed = list_files(spark, str(tmp_path))
    assert listed.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    ids = spark.range(1).join(listed, F.lit(True)).count()
    assert ids == 300 and spark.conf.get("spark.sql.files.openCostInBytes") == before
    assert small_files(spark).conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")
    assert int(small_files(spark).conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")) <= 2 * spark.sparkContext.defaultParallelism


def test_small_frames_become_the_same_buffers(spark, tree):
    """Frames that move as they are, and the first of each source, are those of whole frames; large ones move as buffers."""
    from glimmergrid.operators.selection import first_image
    from glimmergrid.sources.frames import small_pixels, whole_frames

    large = np.random.default_rng(1).integers(0, 256, (300, 400, 3), dtype=np.uint8)
    assert small_pixels(large)[:3] == (224, 224, 3) and len(small_pixels(large)[3]) == 150_528 and small_pixels(large[:8, :8, 0])[:3] == (8, 8, 1)
    entries = expand_archives(read_files(spark, tree))
    whole, small = decode_frames(entries), decode_frames(entries, whole=False)

    def rows(df):
        return sorted((r["path"], r["frame_index"] or 0, bytes(r["pixels"] or b""), r["stage"] or "") for r in df.collect())

    assert rows(whole_frames(small)) == rows(whole) and "pixels" in whole.columns
    assert rows(whole_frames(first_image(small))) == rows(first_image(whole))
    plan = first_image(small)._jdf.queryExecution().optimizedPlan().toString()
    assert "_normalized" not in plan


def test_images_are_passed_on_together():
    from glimmergrid.plans import jobs

    entries = (("s", i, f"s/{i}", b"BM" + bytes(50), None, None, None) for i in range(600))
    told = list(jobs._run(entries, None, None, None, True))
    assert len(told) == 3 and sum(map(len, told)) == 600 and all(len(c) == 52 for t in told for c in t["content"])
