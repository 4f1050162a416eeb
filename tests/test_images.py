"""Images in any container, archives dealt by their directory, models per process, restarts."""

import io
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from glimmergrid.functions.embedding import embed, kept_model, onnx_model, shared_model, stub_model
from glimmergrid.operators.selection import first_image
from glimmergrid.plans import jobs
from glimmergrid.sources import archives, frames
from glimmergrid.sources.files import expand_archives, list_files, read_files, write_files
from glimmergrid.streaming import ingest
from glimmergrid.streaming.ingest import arriving_files, stream_build, stream_features

MODEL = stub_model()
GREY = b"P5 2 2 255\n" + bytes([10, 20, 30, 40])


def drawn(spark, kind: str, colour=(200, 100, 50)) -> bytes:
    """An image of one colour, by Java's writers."""
    jvm = spark._jvm
    picture = jvm.java.awt.image.BufferedImage(16, 16, 1)
    graphics = picture.createGraphics()
    graphics.setColor(jvm.java.awt.Color(*colour))
    graphics.fillRect(0, 0, 16, 16)
    out = jvm.java.io.ByteArrayOutputStream()
    jvm.javax.imageio.ImageIO.write(picture, kind, out)
    return bytes(out.toByteArray())


def zipped(entries: dict[str, bytes], method=zipfile.ZIP_DEFLATED) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return out.getvalue()


def contents(spark, files: dict[str, bytes]):
    return spark.createDataFrame([(p, bytearray(c), 7, "x") for p, c in files.items()], "path string, content binary, key long, error string")


def told(df):
    return {r["path"].rpartition("tree/")[2]: (r["stage"], r["error"] is None and r["vgg16"] is not None) for r in df.collect()}


@pytest.fixture(scope="module")
def pictures(spark):
    return {k: drawn(spark, k) for k in ("jpg", "png", "gif", "bmp")}


@pytest.fixture(scope="module")
def tree(tmp_path_factory, pictures):
    root = tmp_path_factory.mktemp("tree") / "tree"
    root.mkdir()
    (root / "a.JPG").write_bytes(pictures["jpg"])
    (root / "no-ending").write_bytes(pictures["png"])
    (root / "g.pgm").write_bytes(GREY)
    (root / "bad.png").write_bytes(b"no image")
    (root / "x.zip").write_bytes(zipped({"d/b.jpg": pictures["jpg"], "c": pictures["gif"], "e.bmp": pictures["bmp"], "f.pgm": GREY, "g.txt": b"text", "h.jpg": b"\xff\xd8\xffcut"}))
    return str(root)


WANT = {"a.JPG": (None, True), "no-ending": (None, True), "g.pgm": (None, True), "bad.png": ("decode", False), "x.zip/d/b.jpg": (None, True), "x.zip/c": (None, True), "x.zip/e.bmp": (None, True), "x.zip/f.pgm": (None, True)}
WANT |= {"x.zip/g.txt": ("decode", False), "x.zip/h.jpg": ("decode", False)}


@pytest.mark.parametrize("seek", [True, False])
def test_images_everywhere(spark, tree, monkeypatch, seek):
    """The same rows whether tasks open files themselves or Spark hands them over, also by Spark's writers."""
    if not seek:
        monkeypatch.setattr(archives, "SCHEMES", ())
        monkeypatch.setattr(frames, "SCHEMES", ())
    assert told(jobs.features_below(spark, tree, MODEL)) == WANT
    only = told(jobs.features_below(spark, tree, MODEL, frames={1}))
    assert set(only) == {p for p, (_, fine) in WANT.items() if not fine and p not in ("bad.png", "x.zip/h.jpg")}


def test_equal_pictures_have_equal_features(spark, tree, pictures):
    rows = {r["path"].rpartition("tree/")[2]: r for r in jobs.features_below(spark, tree, MODEL).collect()}
    assert rows["a.JPG"]["md5"] == rows["x.zip/d/b.jpg"]["md5"] and rows["a.JPG"]["vgg16"] == rows["x.zip/d/b.jpg"]["vgg16"]
    assert rows["no-ending"]["md5"] == rows["x.zip/e.bmp"]["md5"] == rows["x.zip/c"]["md5"]
    assert rows["x.zip/e.bmp"]["entry_ordinal"] == 2 and rows["x.zip/e.bmp"]["source_path"].endswith("x.zip")


def test_query_images_and_streams(spark, tree, pictures, tmp_path):
    out = str(tmp_path / "store")
    assert jobs.build(spark, tree, out, MODEL) == {"features": 7, "errors": 3}
    features = jobs.features_of(spark, out)
    asked = contents(spark, {"q.jpg": pictures["jpg"], "q.zip": zipped({"1": b"text", "2": pictures["bmp"]}), "q.txt": b"text"})
    best = {r["query_path"]: r["score"] for r in jobs.batch_query(spark, features, asked, MODEL, 0.9, 1).collect()}
    assert set(best) == {"q.jpg", "q.zip"} and min(best.values()) > 1 - 1e-6
    assert jobs.query(spark, features, f"{tree}/x.zip", MODEL, 0.999).count() >= 5
    streamed = str(tmp_path / "streamed")
    for files in (arriving_files(spark, tree, 2), arriving_files(spark, tree)):
        assert "content" not in files.columns
        stream_build(files, streamed, str(tmp_path / "at"), MODEL).awaitTermination()
    assert jobs.features_of(spark, streamed).count() == 7 and jobs.errors_of(spark, streamed).count() == 3


def test_decoder_that_reads_everything(spark, tree):
    def pages(data, wanted):
        for i in range(2):
            if wanted is None or i in wanted:
                yield i, np.full((2, 2, 3), len(data) % 200 + 1 + i, np.uint8)

    rows = told(jobs.features_below(spark, tree, MODEL, decoder=pages, images=False))
    assert len(rows) == 2 * len(WANT) and all(fine for _, fine in rows.values()) and "a.JPG/1" in rows and "x.zip/d/b.jpg/1" in rows


def film(log: str, bad: int | None = None):
    # Local, so that tasks get it by value.
    class Film:
        """Frames of one colour, told by their number; ``bad`` fails. Each call notes its process and how many frames it was asked for."""

        def __init__(self, log: str, bad: int | None = None):
            self.log, self.bad = log, bad

        def count(self, data: bytes) -> int:
            return int(data)

        def __call__(self, data: bytes, wanted):
            asked = range(int(data)) if wanted is None else sorted(i for i in wanted if i < int(data))
            with open(self.log, "a") as f:
                f.write(f"{os.getpid()} {len(asked)}\n")
            for i in asked:
                if i == self.bad:
                    raise ValueError(f"frame {i}")
                yield i, np.full((1, 1, 3), i % 200 + 1, np.uint8)

    return Film(log, bad)


def small():
    def make():
        return lambda batch: batch[:, :3].astype(float)

    return make


def test_one_film_is_many_tasks(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.film").write_bytes(b"10000")
    (root / "b.film").write_bytes(b"3")
    (root / "x.zip").write_bytes(zipped({"c.film": b"700"}))
    log = str(tmp_path / "calls")
    rows = jobs.features_below(spark, str(root), small(), decoder=film(log), images=False)
    assert rows.filter("error IS NULL").count() == rows.select("path").distinct().count() == 10_703
    assert rows.filter("path LIKE '%a.film/9999' AND frame_index = 9999").count() == rows.filter("path LIKE '%a.film' AND frame_index = 0").count() == 1
    calls = [line.split() for line in open(log)]
    assert len(calls) == 40 + 1 + 3 and max(int(n) for _, n in calls) <= jobs.RANGE_FRAMES and len({p for p, _ in calls}) >= 3
    # A whitelist leaves out whole ranges.
    log = str(tmp_path / "fewer")
    rows = jobs.features_below(spark, str(root), small(), {0, 5, 300, 9999, 20_000}, film(log), images=False)
    assert sorted(r["path"].rpartition("tree/")[2] for r in rows.collect()) == sorted(["a.film", "a.film/5", "a.film/300", "a.film/9999", "b.film", "x.zip/c.film", "x.zip/c.film/5", "x.zip/c.film/300"])
    assert sorted(int(line.split()[1]) for line in open(log)) == [1, 1, 1, 1, 2, 2]


def test_a_film_that_breaks(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.film").write_bytes(b"600")
    (root / "n.film").write_bytes(b"no number")
    rows = jobs.features_below(spark, str(root), small(), decoder=film(str(tmp_path / "log"), 300), images=False)
    assert rows.filter("error IS NULL").count() == 256 + 44 + 88
    assert sorted((r["path"].rpartition("/")[2], r["error"]) for r in rows.filter("error IS NOT NULL").collect()) == [("a.film", "ValueError: frame 300"), ("n.film", "ValueError: invalid literal for int() with base 10: b'no number'")]


def test_first_image_of_archives(spark, pictures):
    entries = expand_archives(contents(spark, {"x.zip": zipped({"a.txt": b"?", "b.bmp": pictures["bmp"], "c.pgm": GREY}), "p.pgm": GREY}))
    assert {(r["source_path"], r["path"]) for r in first_image(frames.decode_frames(entries)).collect()} == {("x.zip", "x.zip/b.bmp"), ("p.pgm", "p.pgm")}


@pytest.mark.parametrize("seek", [True, False])
def test_one_archive_runs_in_all_tasks(spark, tmp_path, monkeypatch, seek):
    names = {f"{i:05d}.pgm": b"P5 1 1 255\n" + bytes([i % 255 + 1]) + os.urandom(400) for i in range(10_000)}
    (tmp_path / "big.zip").write_bytes(zipped(names, zipfile.ZIP_STORED))
    listed = list_files(spark, str(tmp_path))
    rows = archives.entries_at(listed, 1 << 17) if seek else archives.entries_in(read_files(spark, str(tmp_path)), 1 << 17)
    dealt = rows.repartition(16, "source_path", "piece") if seek else rows.repartition(16)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 10_000 and len(sizes) >= 8 and max(sizes) < 4_000
    if not seek:
        return
    # The directory alone is read to deal: no row has bytes.
    assert rows.filter("content IS NOT NULL").isEmpty()
    plain = spark.createDataFrame([(str(tmp_path / "big.zip"), 5)], "path string, length long")

    def sums(batches):
        import pandas as pd

        for row, data, error in archives.entry_bytes(batches):
            yield pd.DataFrame({"nth": [row.entry_ordinal], "n": [len(data)], "first": [data[11]], "error": [error]})

    got = archives.entries_at(plain, 1 << 17).mapInPandas(sums, "nth long, n long, first long, error string").agg(F.count("*"), F.sum("n"), F.sum("first"), F.count("error")).first()
    assert list(got) == [10_000, sum(map(len, names.values())), sum(i % 255 + 1 for i in range(10_000)), 0]


def test_broken_and_rare_entries(spark, tmp_path):
    """Other methods, wrong checksums, lost headers, wrong sizes: an error for the entry, never for its neighbours."""
    root = tmp_path / "tree"
    root.mkdir()
    (root / "bz.zip").write_bytes(zipped({"a.pgm": GREY, "b.pgm": GREY}, zipfile.ZIP_BZIP2))
    whole = zipped({"1.pgm": GREY, "2.pgm": GREY, "3.pgm": GREY}, zipfile.ZIP_STORED)
    for name, at in (("crc.zip", whole.index(b"2.pgm") + 5 + 11), ("header.zip", whole.index(b"2.pgm") - 30)):
        broken = bytearray(whole)
        broken[at] ^= 255
        (root / name).write_bytes(bytes(broken))
    (root / "gone.zip").write_bytes(whole[:40])
    for rows in (jobs.features_below(spark, str(root), MODEL), jobs.file_features(read_files(spark, str(root)), MODEL)):
        got = told(rows)
        assert got.pop("gone.zip") == ("archive", False) and got.pop("crc.zip/2.pgm") == got.pop("header.zip/2.pgm") == ("archive", False)
        assert set(got.values()) == {(None, True)} and len(got) == 6


def test_large_files_have_no_limit_where_tasks_open_them(spark, tree):
    assert told(jobs.features_below(spark, tree, MODEL)) == WANT
    capped = told(jobs.features_below(spark, tree, MODEL, max_file=20))
    assert capped["no-ending"] == ("read", False) and capped["x.zip"] == ("read", False) and capped["g.pgm"] == (None, True)
    missing = spark.createDataFrame([("/nowhere/a.pgm", 3), ("/nowhere/b.zip", 3)], "path string, length long")
    assert told(jobs.features_at(missing, MODEL)) == {"/nowhere/a.pgm": ("read", False), "/nowhere/b.zip": ("archive", False)}


def test_models_load_once_a_process(spark, tmp_path):
    log = str(tmp_path / "loads")

    def make():
        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")
        return MODEL()

    files = contents(spark, {f"{i}.pgm": GREY for i in range(64)}).repartition(64)
    assert jobs.frame_features(files, make).filter("error IS NULL").count() == 64
    first = open(log).read().split()
    assert len(first) == len(set(first)) <= 8
    assert jobs.frame_features(files, make).count() == 64
    again = open(log).read().split()
    assert len(again) == len(set(again)) <= 8


def test_models_are_bounded_and_told_apart():
    made = []

    def maker(n):
        def make():
            made.append(n)
            return n

        return make

    assert [kept_model(f"k{n}", maker(n)) for n in (1, 2, 1, 3, 1, 2)] == [1, 2, 1, 3, 1, 2] and made == [1, 2, 3, 2]
    assert shared_model(maker(5))() == 5 and shared_model(maker(6))() == 6


def test_embed_column(spark):
    size = 224 * 224 * 3
    rows = spark.createDataFrame([(i, bytearray([i] * size) if i < 3 else None) for i in range(4)], "i long, pixels binary").repartition(3)
    got = {r["i"]: r["v"] for r in rows.select("i", embed(F.col("pixels"), MODEL, 2).alias("v")).collect()}
    assert got[0] is None and got[3] is None and all(abs(sum(x * x for x in got[i]) - 1) < 1e-5 for i in (1, 2))


def test_a_filter_does_not_embed_twice(spark):
    rows = spark.range(3).selectExpr("id", "CAST(NULL AS binary) AS pixels").select("id", embed(F.col("pixels"), MODEL).alias("v")).filter("v IS NOT NULL")
    assert rows._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1 and rows.count() == 0


def test_onnx_model(tmp_path):
    """A network of one max pool, written by hand: its features are the channels' maxima."""

    def field(n, data):
        return bytes([n << 3 | 2, *varint(len(data))]) + data

    def varint(n):
        return [n] if n < 128 else [n & 127 | 128, *varint(n >> 7)]

    def info(name, dims):
        shape = b"".join(field(1, bytes([8, *varint(d)])) for d in dims)
        return field(1, name) + field(2, field(1, bytes([8, 1]) + field(2, shape)))

    node = field(1, b"x") + field(2, b"y") + field(4, b"GlobalMaxPool")
    graph = field(1, node) + field(2, b"g") + field(11, info(b"x", (2, 3, 224, 224))) + field(12, info(b"y", (2, 3, 1, 1)))
    (tmp_path / "m.onnx").write_bytes(bytes([8, 8]) + field(7, graph) + field(8, bytes([16, 13])))
    pixels = np.random.default_rng(1).integers(0, 256, (2, 224 * 224 * 3), dtype=np.uint8)
    got = onnx_model(str(tmp_path / "m.onnx"))()(pixels)
    assert (got == pixels.reshape(2, -1, 3).max(axis=1)).all()


def test_files_of_other_stores_behave_like_files(tmp_path):
    """By Arrow's client of the local store: the way that object stores are read."""
    from pyarrow import fs

    for name, data in {"none.zip": zipped({}), "two.zip": zipped({"a": GREY, "b": GREY * 999}), "bad.zip": b"\x1f\x8b not a zip"}.items():
        (tmp_path / name).write_bytes(data)
        with archives.stored_file(fs.LocalFileSystem(), str(tmp_path / name)) as file:
            rows = list(archives.directory(name, file, 1 << 20))
            want = list(archives.directory(name, io.BytesIO(data), 1 << 20))
            assert rows == want and len(rows) == {"none.zip": 0, "two.zip": 2, "bad.zip": 1}[name]
            for r in rows:
                if r[11] is None:
                    assert archives.unpacked(file, r[1], r[2], *r[5:10]) == zipfile.ZipFile(io.BytesIO(data)).read(r[1])
            assert file.seek(0) == 0 and file.read() == data and file.read() == b""


def test_write_files(spark, tmp_path):
    files = {"a/b.bin": b"\x00\xff\n", "c": b""}
    assert write_files(contents(spark, files), f"file://{tmp_path}/out") == 2
    assert {str(p.relative_to(tmp_path / "out")): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()} == files


@pytest.mark.parametrize("form", ["table", "store"])
def test_a_stream_restarts_after_a_failure(spark, tmp_path, monkeypatch, form):
    """The batch fails after its rows are written and before it is done; the second run has every file once."""
    root, out, at = tmp_path / "tree", str(tmp_path / "out"), str(tmp_path / "at")
    root.mkdir()
    for i in range(6):
        (root / f"{i}.pgm").write_bytes(GREY + bytes([i]))
    (root / "x.zip").write_bytes(zipped({"a.pgm": GREY}))
    whole = ingest._features
    run = stream_features if form == "table" else stream_build

    def failing(batch, *more):
        rows = whole(batch, *more)
        target = f"{out}/batch=1" if form == "table" else f"{out}/rows/batch=1"
        if os.path.exists(f"{out}/batch=0") or os.path.exists(f"{out}/rows/batch=0"):
            rows.select("path", "md5", "vgg16", "stage", "error").write.mode("overwrite").parquet(target)
            raise RuntimeError("lost between writing and committing")
        return rows

    monkeypatch.setattr(ingest, "_features", failing)
    with pytest.raises(Exception, match="lost between"):
        run(arriving_files(spark, str(root), 3), out, at, MODEL).awaitTermination()
    monkeypatch.setattr(ingest, "_features", whole)
    run(arriving_files(spark, str(root), 3), out, at, MODEL).awaitTermination()
    rows = (spark.read.parquet(out) if form == "table" else jobs.features_of(spark, out)).collect()
    assert sorted(r["path"].rpartition("tree/")[2] for r in rows) == [*(f"{i}.pgm" for i in range(6)), "x.zip/a.pgm"]
