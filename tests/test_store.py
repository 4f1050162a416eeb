"""Replaced tables, and lookups that skip row groups."""

import threading

import pytest
from pyspark.sql import functions as F

from glimmergrid.functions.embedding import stub_model
from glimmergrid.operators.selection import find_by_md5
from glimmergrid.plans import jobs
from glimmergrid.sources import store
from glimmergrid.streaming.ingest import arriving_files, stream_build

MODEL = stub_model()


def rows(spark, n, tag="p"):
    path = F.concat(F.lit(tag), F.col("id").cast("string"))
    return spark.range(n).select(path.alias("path"), F.md5(path).alias("md5"), F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>").alias("vgg16"))


def test_a_reader_keeps_its_version(spark, tmp_path):
    path = str(tmp_path / "s")
    store.save_features(rows(spark, 10, "old"), path)
    reader = store.load_features(spark, path)
    store.save_features(rows(spark, 5, "new"), path)
    assert reader.filter("path LIKE 'old%'").count() == reader.count() == 10
    assert {r["path"] for r in store.load_features(spark, path).collect()} == {f"new{i}" for i in range(5)}


def test_saving_into_the_table_that_is_read(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    store.save_features(rows(spark, 10), path)
    for n in (20, 40, 80):
        now = store.load_features(spark, path)
        store.save_features(store.union_features(now, now), path)
        assert store.load_features(spark, path).count() == n
    assert len(list((tmp_path / "s").glob("version-*"))) == store.KEPT_VERSIONS == len(list((tmp_path / "s").glob("_current.*")))


def test_a_failed_save_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "s")
    store.save_features(rows(spark, 3), path)
    with pytest.raises(Exception, match="lost"):
        store.save_features(rows(spark, 3).withColumn("path", F.raise_error(F.lit("lost")).cast("string")), path)
    assert store.load_features(spark, path).count() == 3


def test_tables_without_versions_are_read(spark, tmp_path):
    rows(spark, 4).write.parquet(str(tmp_path / "plain"))
    assert store.load_features(spark, str(tmp_path / "plain")).count() == 4


def test_readers_during_many_replacements(spark, tmp_path):
    """Whoever reads sees one version whole."""
    path, seen, done = str(tmp_path / "s"), [], threading.Event()
    store.save_features(rows(spark, 8, "v0-"), path, keep=50)

    def read():
        while not done.is_set():
            seen.append({r["path"].split("-")[0] for r in store.load_features(spark, path).collect()})

    reader = threading.Thread(target=read)
    reader.start()
    for k in range(1, 5):
        store.save_features(rows(spark, 8, f"v{k}-"), path, keep=50)
    done.set()
    reader.join()
    assert seen and all(len(s) == 1 for s in seen)


def test_a_built_store_is_replaced_whole(spark, tmp_path):
    files = [{"a.pgm": 5, "b.pgm": 9}, {"c.pgm": 7}]
    out = str(tmp_path / "store")

    def told(some):
        made = [(p, bytearray(b"P5 1 1 255\n" + bytes([v]))) for p, v in some.items()]
        return jobs.file_features(spark.createDataFrame(made, "path string, content binary"), MODEL)

    assert jobs.build_store(told(files[0]), out) == {"features": 2, "errors": 0}
    reader = jobs.features_of(spark, out)
    assert jobs.build_store(told(files[1]), out) == {"features": 1, "errors": 0}
    assert {r["path"] for r in reader.collect()} == {"a.pgm", "b.pgm"} and jobs.features_of(spark, out).first()["path"] == "c.pgm"


def test_a_built_store_is_added_to_by_streams(spark, tmp_path):
    root, out = tmp_path / "in", str(tmp_path / "store")
    root.mkdir()
    (root / "a.pgm").write_bytes(b"P5 1 1 255\n\x05")
    (root / "bad").write_bytes(b"?")
    assert jobs.build(spark, str(root), out, MODEL) == {"features": 1, "errors": 1}
    (root / "b.pgm").write_bytes(b"P5 1 1 255\n\x09")
    stream_build(arriving_files(spark, str(root)), out, str(tmp_path / "at"), MODEL).awaitTermination()
    names = sorted(r["path"].rpartition("/")[2] for r in jobs.features_of(spark, out).collect())
    assert names == ["a.pgm", "a.pgm", "b.pgm"] and jobs.errors_of(spark, out).count() == 2


def scanned(df) -> int:
    """Rows that come out of the table's scan."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.length()))


def test_lookups_skip_row_groups(spark, tmp_path):
    path = str(tmp_path / "s")
    spark.conf.set("spark.sql.parquet.enableVectorizedReader", "true")
    many = rows(spark, 200_000).repartition(4)
    blocks = store.LOOKUP | {"parquet.block.size": str(1 << 20), "parquet.page.row.count.limit": "20000"}
    many.sortWithinPartitions("md5").write.options(**blocks).parquet(path)
    features = store.load_features(spark, path)
    asked = spark.createDataFrame([("p7",), ("p199999",), ("nobody",)], "path string").select(F.upper(F.md5("path")).alias("md5"))
    found = find_by_md5(features, asked)
    assert {r["path"] for r in found.collect()} == {"p7", "p199999"}
    assert "PushedFilters: [In(md5" in found._jdf.queryExecution().toString() or "EqualTo(md5" in found._jdf.queryExecution().toString()
    assert scanned(find_by_md5(features, asked)) < 100_000 < scanned(features.select("path", "md5"))
    # Values that no row group can hold by its bloom filter: nothing is read.
    none = spark.createDataFrame([(f"none{i}",) for i in range(5)], "path string").select(F.md5("path").alias("md5"))
    assert scanned(find_by_md5(features, none)) == 0


def test_many_hashes_are_joined(spark, tmp_path):
    features = rows(spark, 300)
    asked = rows(spark, 50).select(F.upper("md5").alias("md5")).union(spark.createDataFrame([(None,)], "md5 string"))
    for literals in (1_000, 10):
        assert {r["path"] for r in find_by_md5(features, asked, literals).collect()} == {f"p{i}" for i in range(50)}
    assert find_by_md5(features, asked.limit(0)).count() == 0
