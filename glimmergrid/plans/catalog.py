"""The registered queries and their SQL twins.

The given tables hold no images. ``embeddings`` stands for a feature store,
``documents`` for file contents, ``conversations`` for files of several frames;
image files and archives are made by Spark from the rows of those tables.
"""

from __future__ import annotations

import io
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmergrid.functions.embedding import embed as embedded
from glimmergrid.functions.paths import entry_path, frame_path, is_archive, is_file_entry, parse_whitelist
from glimmergrid.functions.pixels import content_md5, normalize_pixels
from glimmergrid.functions.vectors import l2_normalize, squared_norm
from glimmergrid.operators import duplicates, search, selection
from glimmergrid.plans import jobs
from glimmergrid.schemas import FILES, SIDE
from glimmergrid.sources import records, store
from glimmergrid.sources.files import expand_archives as expand
from glimmergrid.sources.files import failed_files as failures
from glimmergrid.sources.files import list_files as listing
from glimmergrid.sources.files import read_files as reading
from glimmergrid.sources.files import write_files
from glimmergrid.sources.frames import decode_frames as decode
from glimmergrid.sources.frames import whole_frames
from glimmergrid.streaming.ingest import arriving_files, stream_features
from glimmergrid.streaming.ingest import stream_build as streamed_build
from glimmergrid.workspace import shared_path

NAMES = {"path_col": "vec_id", "vector_col": "embedding"}
QUERY_NAMES = NAMES | {"query_col": "query_id", "query_vector_col": "embedding"}
#: Places of a frame's corners in its buffer: stretching keeps corner pixels as they are, so SQL can tell them.
CORNERS = [0, (SIDE - 1) * 3, SIDE * (SIDE - 1) * 3, (SIDE * SIDE - 1) * 3]

# The header of a bitmap of 8 by 8 pixels, 24 bits each.
BMP_HEADER = "424DF600000000000000360000002800000008000000080000000100180000000000C0000000" + 16 * "00"


def corner_model():
    """A model whose features are the four corners of a frame."""

    def predict(batch: np.ndarray) -> np.ndarray:
        return batch[:, CORNERS].astype(np.float64)

    return predict


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def _asked(vectors: DataFrame) -> DataFrame:
    """The stated query set: every twentieth vector."""
    return vectors.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` in the schema of the store."""
    rows = _vectors(spark, sf_dir).filter("vec_id IS NOT NULL AND embedding IS NOT NULL")
    path = F.concat(F.lit("img/"), F.col("vec_id").cast("string"))
    return rows.select(path.alias("path"), F.md5(path).alias("md5"), F.col("embedding").cast("array<float>").alias("vgg16"))


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grey 8 by 8 image file per vector."""
    rows = _vectors(spark, sf_dir).filter("vec_id IS NOT NULL AND size(embedding) = 64")
    grey = F.array_join(F.transform("embedding", lambda x: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + 400 * x))).cast("long")), 2, "0")), "")
    content = F.concat(F.encode(F.lit("P5 8 8 255\n"), "UTF-8"), F.unhex(grey))
    return rows.select(F.concat(F.lit("img/"), F.col("vec_id").cast("string"), F.lit(".pgm")).alias("path"), F.current_timestamp().alias("modificationTime"), F.length(content).cast("long").alias("length"), content.alias("content"))


def _pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same images as bitmaps, which Spark's image source reads; the lowest line of a bitmap comes first."""
    raw = _images(spark, sf_dir).select("path", "modificationTime", F.hex(F.expr("substring(content, 12)")).alias("grey"))
    pixel = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.substring(F.col("grey"), 2 * ((7 - F.floor(i / 8)) * 8 + i % 8) + 1, F.lit(2)))
    content = F.unhex(F.concat(F.lit(BMP_HEADER), F.array_join(F.transform(pixel, lambda g: F.repeat(g, F.lit(3))), "")))
    return raw.select(F.regexp_replace("path", "pgm$", "bmp").alias("path"), "modificationTime", F.length(content).cast("long").alias("length"), content.alias("content"))


def _archives(rows: DataFrame) -> DataFrame:
    """Rows of (archive, name, content) as zip files, each with a directory entry first."""

    def zipped(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("d/", b"")
            for name, content in sorted(zip(pdf["name"], pdf["content"])):
                archive.writestr(zipfile.ZipInfo(f"d/{name}"), bytes(content))
        return pd.DataFrame({"path": [pdf["archive"].iat[0]], "content": [out.getvalue()]})

    files = rows.groupBy("archive").applyInPandas(zipped, "path string, content binary")
    return files.select("path", F.current_timestamp().alias("modificationTime"), F.length("content").cast("long").alias("length"), "content")


def _document_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents an archive, and every document as a text file of its own."""
    docs = table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    name = F.concat(F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".txt"))
    packed = docs.select(F.concat(F.lit("zip/"), F.floor(F.col("doc_id") / 10).cast("string"), F.lit(".zip")).alias("archive"), name.alias("name"), "content")
    return _archives(packed)


def similarity_search(spark, sf_dir):
    """All vectors by their likeness to vector 0."""
    vectors = _vectors(spark, sf_dir)
    asked = vectors.filter("vec_id = 0").first()
    found = search.similarity_search(vectors, asked["embedding"] if asked else [0.0], 0.2, **NAMES)
    return found.select("vec_id", F.round("score", 6).alias("score"))


def batch_similarity_search(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    found = search.batch_similarity_search(vectors, _asked(vectors), 0.3, **QUERY_NAMES)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"))


def top_k(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    found = search.top_k(vectors, _asked(vectors), 10, 0.0, **QUERY_NAMES)
    return found.select("query_id", "vec_id", F.col("rank").cast("int").alias("rank"), F.round("score", 6).alias("score"))


def near_duplicate_pairs(spark, sf_dir):
    found = search.near_duplicate_pairs(_vectors(spark, sf_dir), 0.3, **NAMES)
    return found.select(F.col("path_a").alias("vec_a"), F.col("path_b").alias("vec_b"), F.round("score", 6).alias("score"))


def _drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters: each vector is drawn towards the axis of its label."""
    rows = table(spark, sf_dir, "embeddings").filter("vec_id IS NOT NULL AND embedding IS NOT NULL AND label IS NOT NULL")
    drawn = F.transform("embedding", lambda x, i: x.cast("double") + F.when(i == F.col("label"), 3.0).otherwise(0.0))
    return rows.select("vec_id", l2_normalize(drawn).alias("embedding"))


def clustered_pairs(spark, sf_dir):
    """Similar vectors among clusters, of which cells rule out most pairs."""
    found = search.near_duplicate_pairs(_drawn(spark, sf_dir), 0.92, block_rows=256, **NAMES)
    return found.select(F.col("path_a").alias("vec_a"), F.col("path_b").alias("vec_b"), F.round("score", 6).alias("score"))


def hashed_pairs(spark, sf_dir):
    """The same pairs by locality-sensitive hashing; with these tables a pair at the threshold is missed once in a million."""
    found = search.near_duplicate_candidates(_drawn(spark, sf_dir), 0.92, tables=12, **NAMES)
    return found.select(F.col("path_a").alias("vec_a"), F.col("path_b").alias("vec_b"), F.round("score", 6).alias("score"))


def record_parts(spark, sf_dir):
    """A table written as record files, each of which is read again by several tasks."""
    folder = shared_path(spark, "records")
    records.write_feature_records(_features(spark, sf_dir).coalesce(1), folder)
    return _scalars(records.read_feature_records(spark, f"{folder}/*.db", dimensions=64, large=20_000))


def l2_normalized(spark, sf_dir):
    """Vectors of many lengths brought back to length one."""
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 7 + 1))
    rows = _vectors(spark, sf_dir).withColumn("unit", l2_normalize(scaled))
    parts = [F.round(F.element_at("unit", i), 6).alias(f"v{i}") for i in (1, 32, 64)]
    return rows.select("vec_id", *parts, F.round(squared_norm(F.col("unit")), 6).alias("squared_norm"))


def content_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", content_md5(F.col("text").cast("binary")).alias("md5"))


def exact_duplicates(spark, sf_dir):
    rows = content_hashes(spark, sf_dir)
    found = duplicates.exact_duplicates(rows, path_col="doc_id")
    return found.select("md5", "n", F.col("first_path").alias("first_doc"))


def duplicate_members(spark, sf_dir):
    found = duplicates.duplicate_members(content_hashes(spark, sf_dir), path_col="doc_id")
    return found.select("md5", F.col("path").alias("doc_id"), F.col("first_path").alias("first_doc"), "n")


def find_by_md5(spark, sf_dir):
    """All documents with the content of a stated query set, given in capitals."""
    rows = content_hashes(spark, sf_dir)
    asked = rows.filter("doc_id % 20 = 0").select(F.upper("md5").alias("md5"))
    return selection.find_by_md5(rows, asked).select("doc_id", "md5")


def frame_whitelist(spark, sf_dir):
    """Turns of conversations as frames of files, by a written whitelist."""
    rows = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c/"), F.col("conv_id").cast("string")).alias("file"), F.col("turn").alias("frame_index"))
    wanted = spark.range(1).select(parse_whitelist(F.lit("0;2;;5")).alias("w")).first()["w"]
    kept = selection.frame_whitelist(rows, wanted)
    return kept.select(frame_path(F.col("file"), F.col("frame_index")).alias("path"), "frame_index")


def first_frame(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c/"), F.col("conv_id").cast("string")).alias("file"), F.col("turn").alias("frame_index"))
    return selection.first_frame(rows).select(frame_path(F.col("file"), F.col("frame_index")).alias("path"))


def archive_routing(spark, sf_dir):
    """File names of many endings, told apart."""
    endings = [".zip", ".ZIP", ".gz", ".png", ".tar.xz", "", "/"]
    ending = F.element_at(F.array(*map(F.lit, endings)), (F.col("doc_id") % 7 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string"), ending).alias("name"))
    return rows.select("doc_id", entry_path(F.lit("a.zip"), F.col("name")).alias("path"), is_archive(F.col("name")).alias("is_archive"), is_file_entry(F.col("name")).alias("is_file"))


def _scalars(features: DataFrame) -> DataFrame:
    """Rows of a store with a digest of all components, in millionths."""
    whole = F.array_join(F.transform("vgg16", lambda x: F.floor(x.cast("double") * 1_000_000).cast("string")), ",")
    return features.select("path", "md5", F.size("vgg16").cast("long").alias("n"), F.md5(whole).alias("digest"))


def _corners(features: DataFrame) -> DataFrame:
    """Paths and all four components of features by the corner model."""
    return features.select("path", *[F.round(F.element_at("vgg16", i).cast("double"), 6).alias(f"v{i}") for i in range(1, 5)])


def _bytes_at(pixels: Column) -> list[Column]:
    return [F.conv(F.hex(F.substring(pixels, at + 1, 1)), 16, 10).cast("long").alias(f"p{i}") for i, at in enumerate(CORNERS, 1)]


def store_roundtrip(spark, sf_dir):
    """Two copies of a table under one roof, saved and loaded."""
    features = _features(spark, sf_dir).withColumn("score", F.lit(1.0))
    path = shared_path(spark, "store")
    store.save_features(store.union_features(features, features), path)
    return _scalars(store.load_features(spark, path))


def record_roundtrip(spark, sf_dir):
    """A table written as record files, and read again."""
    folder = shared_path(spark, "records")
    records.write_feature_records(_features(spark, sf_dir), folder)
    return _scalars(records.read_feature_records(spark, f"{folder}/*.db", dimensions=64))


def count_features(spark, sf_dir):
    return _features(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))


def _text_files(spark: SparkSession, sf_dir: str) -> str:
    """Documents written as text files, a folder for each language."""
    path = shared_path(spark, "texts")
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL AND lang IS NOT NULL")
    docs.select(F.col("text").alias("value"), "lang").write.partitionBy("lang").text(path)
    return path


def list_files(spark, sf_dir):
    """Bytes of the files of each folder."""
    found = listing(spark, _text_files(spark, sf_dir))
    return found.groupBy(F.regexp_extract("path", "lang=([^/]+)/", 1).alias("lang")).agg(F.sum("length").alias("n_bytes"))


def read_files(spark, sf_dir):
    """Bytes that reading the files of each folder gives."""
    found = reading(spark, _text_files(spark, sf_dir))
    told = found.select(F.regexp_extract("path", "lang=([^/]+)/", 1).alias("lang"), F.col("length"), F.octet_length("content").alias("read"))
    return told.groupBy("lang").agg(F.sum("read").cast("long").alias("n_read"), F.sum("length").alias("n_bytes"))


def expand_archives(spark, sf_dir):
    """Documents packed into archives, and taken out again."""
    found = expand(_document_archives(spark, sf_dir))
    return found.select("source_path", "entry_name", "path", F.md5("content").alias("md5"))


def failed_files(spark, sf_dir):
    """Texts under the name of an archive, and under that of an image: each is one error."""
    docs = table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL")
    name = F.concat(F.lit("t/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".zip").otherwise(".png"))
    files = docs.select(name.alias("path"), F.current_timestamp().alias("modificationTime"), F.lit(0).cast("long").alias("length"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return failures(decode(expand(files))).select("path", "stage")


def decode_frames(spark, sf_dir):
    """Frame buffers of images that stand for vectors: their size and corners."""
    frames = decode(expand(_images(spark, sf_dir)))
    return frames.select("path", "frame_index", F.length("pixels").cast("long").alias("n_bytes"), *_bytes_at(F.col("pixels")))


def pixels_normalized(spark, sf_dir):
    """Pixels of 8 by 8 as frame buffers: their size and corners."""
    raw = _images(spark, sf_dir).select("path", F.expr("substring(content, 12)").alias("raw"))
    frames = raw.select("path", normalize_pixels(F.col("raw"), F.lit(8), F.lit(8), F.lit(1)).alias("pixels"))
    return frames.select("path", F.length("pixels").cast("long").alias("n_bytes"), *_bytes_at(F.col("pixels")))


def _packed(images: DataFrame) -> DataFrame:
    """Images as plain files, and once more inside archives."""
    number = F.regexp_extract("path", "[0-9]+", 0)
    packed = images.select(F.concat(F.lit("zip/"), F.floor(number.cast("long") / 20).cast("string"), F.lit(".zip")).alias("archive"), F.regexp_extract("path", "[^/]+$", 0).alias("name"), "content")
    return images.unionByName(_archives(packed))


def _packed_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(_images(spark, sf_dir))


def build_features(spark, sf_dir):
    """Features of those images."""
    told = jobs.file_features(_packed_images(spark, sf_dir), corner_model)
    return _corners(told.filter("error IS NULL"))


def picture_features(spark, sf_dir):
    """Features of bitmaps, plain and inside archives: Spark's image source reads them from the shared folder."""
    told = jobs.file_features(_packed(_pictures(spark, sf_dir)), corner_model)
    return _corners(told.filter("error IS NULL"))


def _on_disk(spark: SparkSession, sf_dir: str) -> str:
    """A folder of image files of both kinds, with archives of both."""
    folder = shared_path(spark, "tree")
    write_files(_packed_images(spark, sf_dir).unionByName(_packed(_pictures(spark, sf_dir)).withColumn("path", F.regexp_replace("path", "^zip/", "bmp/"))), folder)
    return folder


def _below(path: Column) -> Column:
    """A file's path below its folder."""
    return F.regexp_extract(path, "/tree-[0-9a-f]+/(.*)$", 1)


def build(spark, sf_dir):
    """A store built from those files on disk."""
    out = shared_path(spark, "built")
    jobs.build(spark, _on_disk(spark, sf_dir), out, corner_model)
    return _corners(jobs.features_of(spark, out).withColumn("path", _below(F.col("path"))))


def query(spark, sf_dir):
    """The images in a store most like one image file on disk."""
    out, tree = shared_path(spark, "built"), _on_disk(spark, sf_dir)
    jobs.build(spark, f"{tree}/img", out, corner_model)
    found = jobs.query(spark, jobs.features_of(spark, out), f"{tree}/img/0.bmp", corner_model, 0.95)
    return found.select(_below(F.col("path")).alias("path"), F.round("score", 6).alias("score"))


def picture_queries(spark, sf_dir):
    """The five images most like each of a stated set of bitmaps."""
    asked = _pictures(spark, sf_dir).filter(F.regexp_extract("path", "[0-9]+", 0).cast("long") % 20 == 0)
    found = jobs.batch_query(spark, _stored_images(spark, sf_dir), asked, corner_model, 0.5, 5)
    return found.select(F.regexp_replace("query_path", "bmp$", "pgm").alias("query_path"), "path", F.col("rank").cast("int").alias("rank"), F.round("score", 6).alias("score"))


def picture_stream(spark, sf_dir):
    """A store built from files on disk as they arrive, of both kinds."""
    out, checkpoint = (shared_path(spark, n) for n in ("streamed", "progress"))
    streamed_build(arriving_files(spark, _on_disk(spark, sf_dir), 1_000), out, checkpoint, corner_model).awaitTermination()
    return _corners(jobs.features_of(spark, out).withColumn("path", _below(F.col("path"))))


def embed(spark, sf_dir):
    """Features of pixel buffers as a column."""
    raw = _images(spark, sf_dir).select("path", F.expr("substring(content, 12)").alias("raw"))
    frames = raw.select("path", normalize_pixels(F.col("raw"), F.lit(8), F.lit(8), F.lit(1)).alias("pixels"))
    return _corners(frames.select("path", embedded(F.col("pixels"), corner_model).alias("vgg16")).filter("vgg16 IS NOT NULL"))


def first_image(spark, sf_dir):
    """The first frame of each archive of bitmaps, and of each plain file: its path and corners."""
    # Frames are chosen before they become buffers, so none of those is shuffled.
    frames = decode(expand(_packed(_pictures(spark, sf_dir))), whole=False)
    return whole_frames(selection.first_image(frames)).select("source_path", "path", *_bytes_at(F.col("pixels")))


def build_store(spark, sf_dir):
    """A store built of them and of texts that are no images: its features and its errors."""
    docs = table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    text = F.col("text").cast("binary")
    texts = docs.select(F.concat(F.lit("t/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path"), F.current_timestamp().alias("modificationTime"), F.length(text).cast("long").alias("length"), text.alias("content"))
    out = shared_path(spark, "built")
    jobs.build_store(jobs.file_features(_packed_images(spark, sf_dir).unionByName(texts), corner_model), out)
    return jobs.features_of(spark, out).select("path", F.lit("").alias("stage")).unionByName(jobs.errors_of(spark, out).select("path", "stage"))


def _stored_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "features")
    store.save_features(jobs.file_features(_images(spark, sf_dir), corner_model).filter("error IS NULL"), path)
    return store.load_features(spark, path)


def query_image(spark, sf_dir):
    """The images most like the first one, by their features."""
    asked = jobs.frame_features(_images(spark, sf_dir).filter("path = 'img/0.pgm'"), corner_model, {0})
    found = jobs.first_features(asked).first()
    stored = _stored_images(spark, sf_dir)
    found = search.similarity_search(stored, found["vgg16"] if found else [0.0] * 4, 0.95)
    return found.select("path", F.round("score", 6).alias("score"))


def batch_query(spark, sf_dir):
    """The five images most like each of a stated query set."""
    asked = _images(spark, sf_dir).filter(F.regexp_extract("path", "[0-9]+", 0).cast("long") % 20 == 0)
    found = jobs.batch_query(spark, _stored_images(spark, sf_dir), asked, corner_model, 0.5, 5)
    return found.select("query_path", "path", F.col("rank").cast("int").alias("rank"), F.round("score", 6).alias("score"))


def _arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = shared_path(spark, "arrived")
    _packed_images(spark, sf_dir).write.parquet(files)
    return spark.readStream.schema(FILES).option("maxFilesPerTrigger", 4).parquet(files)


def stream_ingest(spark, sf_dir):
    """Image files that arrive as a stream, ingested into a table."""
    out, checkpoint = (shared_path(spark, n) for n in ("streamed", "progress"))
    stream_features(_arriving(spark, sf_dir), out, checkpoint, corner_model).awaitTermination()
    return _corners(spark.read.schema("path string, md5 string, vgg16 array<float>, stage string, error string").parquet(out).filter("error IS NULL"))


def stream_build(spark, sf_dir):
    """The same, a batch at a time into a store in the layout of ``build``."""
    out, checkpoint = (shared_path(spark, n) for n in ("streamed", "progress"))
    streamed_build(_arriving(spark, sf_dir), out, checkpoint, corner_model).awaitTermination()
    return _corners(jobs.features_of(spark, out))


def threshold_filter(spark, sf_dir):
    """Scores against vector 1, filtered."""
    vectors = _vectors(spark, sf_dir)
    asked = vectors.filter("vec_id = 1").select(F.col("vec_id").alias("query_id"), "embedding")
    found = search.batch_similarity_search(vectors, asked, 0.0, **QUERY_NAMES)
    return selection.threshold_filter(found, 0.25).select("vec_id", F.round("score", 6).alias("score"))


def write_matches(spark, sf_dir):
    """Ranked matches, written and read."""
    vectors = _vectors(spark, sf_dir)
    found = search.ranked(search.batch_similarity_search(vectors, _asked(vectors), 0.3, **QUERY_NAMES), "vec_id", "query_id")
    path = shared_path(spark, "matches")
    store.write_matches(found, path)
    return spark.read.schema("query_id long, vec_id long, score double, rank int").parquet(path).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


def dedup_report(spark, sf_dir):
    """Groups of equal hashes (here of labels) and pairs of similar vectors, as one table."""
    rows = table(spark, sf_dir, "embeddings").filter("vec_id IS NOT NULL AND embedding IS NOT NULL")
    features = rows.select(F.col("vec_id").alias("path"), F.md5(F.col("label").cast("string")).alias("md5"), F.col("embedding").alias("vgg16"))
    groups, pairs = jobs.dedup_report(features, 0.35)
    groups = groups.select("md5", F.col("first_path").alias("a"), F.col("n").alias("b"), F.lit(None).cast("double").alias("score"))
    return groups.unionByName(pairs.select(F.lit(None).cast("string").alias("md5"), F.col("path_a").alias("a"), F.col("path_b").alias("b"), F.round("score", 6).alias("score")))


QUERIES = {
    "similarity_search": similarity_search,
    "batch_similarity_search": batch_similarity_search,
    "top_k": top_k,
    "near_duplicate_pairs": near_duplicate_pairs,
    "clustered_pairs": clustered_pairs,
    "hashed_pairs": hashed_pairs,
    "l2_normalize": l2_normalized,
    "content_md5": content_hashes,
    "exact_duplicates": exact_duplicates,
    "duplicate_members": duplicate_members,
    "find_by_md5": find_by_md5,
    "frame_whitelist": frame_whitelist,
    "first_frame": first_frame,
    "archive_routing": archive_routing,
    "store_roundtrip": store_roundtrip,
    "record_roundtrip": record_roundtrip,
    "record_parts": record_parts,
    "count_features": count_features,
    "list_files": list_files,
    "read_files": read_files,
    "expand_archives": expand_archives,
    "failed_files": failed_files,
    "decode_frames": decode_frames,
    "normalize_pixels": pixels_normalized,
    "build_features": build_features,
    "picture_features": picture_features,
    "build": build,
    "query": query,
    "picture_queries": picture_queries,
    "picture_stream": picture_stream,
    "embed": embed,
    "first_image": first_image,
    "build_store": build_store,
    "query_image": query_image,
    "batch_query": batch_query,
    "stream_ingest": stream_ingest,
    "stream_build": stream_build,
    "threshold_filter": threshold_filter,
    "write_matches": write_matches,
    "dedup_report": dedup_report,
}

_SCORES = """SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s
  FROM embeddings a, embeddings b"""
_STORED = """SELECT 'img/' || vec_id AS path, md5('img/' || vec_id) AS md5, len(embedding)::BIGINT AS n,
  md5(array_to_string(list_transform(embedding::FLOAT[]::DOUBLE[], lambda x: floor(x * 1000000)::BIGINT), ',')) AS digest FROM embeddings"""
_GREYS = """SELECT vec_id, list_transform([embedding[1], embedding[8], embedding[57], embedding[64]]::DOUBLE[],
  lambda x: greatest(0, least(255, floor(128 + 400 * x)))::BIGINT) AS g FROM embeddings WHERE len(embedding) = 64"""
_UNITS = f"""SELECT vec_id, list_transform(g, lambda x: (x / sqrt(list_sum(list_transform(g, lambda y: y * y))))::FLOAT::DOUBLE) AS u FROM ({_GREYS}) WHERE list_sum(g) > 0"""
_PLACED = f"""SELECT 'img/' || vec_id || '.pgm' AS path, u FROM ({_UNITS}) UNION ALL SELECT 'zip/' || vec_id // 20 || '.zip/d/' || vec_id || '.pgm', u FROM ({_UNITS})"""
_CORNERS = f"SELECT path, round(u[1], 6) AS v1, round(u[2], 6) AS v2, round(u[3], 6) AS v3, round(u[4], 6) AS v4 FROM ({_PLACED})"
_BITMAPS = f"SELECT replace(path, '.pgm', '.bmp') AS path, v1, v2, v3, v4 FROM ({_CORNERS})"
_TREE = f"{_CORNERS} UNION ALL SELECT regexp_replace(path, '^zip/', 'bmp/'), v1, v2, v3, v4 FROM ({_BITMAPS})"
_FIRST = f"""SELECT 'img/' || vec_id || '.bmp' AS source_path, 'img/' || vec_id || '.bmp' AS path, g FROM ({_GREYS})
  UNION ALL SELECT 'zip/' || vec_id // 20 || '.zip', 'zip/' || vec_id // 20 || '.zip/d/' || vec_id || '.bmp', g FROM ({_GREYS})
  QUALIFY row_number() OVER (PARTITION BY vec_id // 20 ORDER BY vec_id || '.bmp') = 1"""
_ALIKE = f"""SELECT a.vec_id AS a, b.vec_id AS b, 'img/' || a.vec_id || '.pgm' AS query_path, 'img/' || b.vec_id || '.pgm' AS path,
  a.u[1] * b.u[1] + a.u[2] * b.u[2] + a.u[3] * b.u[3] + a.u[4] * b.u[4] AS s FROM ({_UNITS}) a, ({_UNITS}) b"""
_FOLDERS = "SELECT lang, sum(strlen(text) + 1)::BIGINT AS n_bytes FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL GROUP BY lang"

_CLUSTERED = """WITH d AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x, i: x + CASE WHEN i = label + 1 THEN 3.0 ELSE 0.0 END) AS v FROM embeddings),
  u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM d)
  SELECT a.vec_id AS vec_a, b.vec_id AS vec_b, round(list_inner_product(a.u, b.u), 6) AS score FROM u a JOIN u b ON a.vec_id < b.vec_id WHERE list_inner_product(a.u, b.u) >= 0.92::DOUBLE"""

ORACLES = {
    "similarity_search": f"SELECT vec_id, round(s, 6) AS score FROM ({_SCORES} WHERE a.vec_id = 0) WHERE s >= 0.2::DOUBLE",
    "batch_similarity_search": f"SELECT query_id, vec_id, round(s, 6) AS score FROM ({_SCORES} WHERE a.vec_id % 20 = 0) WHERE s >= 0.3::DOUBLE",
    "top_k": f"""SELECT query_id, vec_id, rank, round(s, 6) AS score FROM (SELECT *,
      row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id)::INT AS rank FROM ({_SCORES} WHERE a.vec_id % 20 = 0) WHERE s >= 0) WHERE rank <= 10""",
    "near_duplicate_pairs": f"SELECT query_id AS vec_a, vec_id AS vec_b, round(s, 6) AS score FROM ({_SCORES} WHERE a.vec_id < b.vec_id) WHERE s >= 0.3::DOUBLE",
    "clustered_pairs": _CLUSTERED,
    "hashed_pairs": _CLUSTERED,
    "l2_normalize": """SELECT vec_id, round(u[1], 6) AS v1, round(u[32], 6) AS v32, round(u[64], 6) AS v64, round(list_inner_product(u, u), 6) AS squared_norm
      FROM (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u
        FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (vec_id % 7 + 1)) AS v FROM embeddings))""",
    "content_md5": "SELECT doc_id, md5(text) AS md5 FROM documents",
    "exact_duplicates": "SELECT md5(text) AS md5, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY md5(text) HAVING count(*) > 1",
    "duplicate_members": """SELECT md5, doc_id, first_doc, n FROM (SELECT md5(text) AS md5, doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS first_doc,
      count(*) OVER (PARTITION BY md5(text)) AS n FROM documents) WHERE n > 1""",
    "find_by_md5": "SELECT doc_id, md5(text) AS md5 FROM documents WHERE md5(text) IN (SELECT lower(upper(md5(text))) FROM documents WHERE doc_id % 20 = 0)",
    "frame_whitelist": "SELECT CASE turn WHEN 0 THEN 'c/' || conv_id ELSE 'c/' || conv_id || '/' || turn END AS path, turn AS frame_index FROM conversations WHERE turn IN (0, 2, 5)",
    "first_frame": "SELECT 'c/' || conv_id AS path FROM conversations WHERE turn = 0",
    "archive_routing": """SELECT doc_id, 'a.zip/f' || doc_id || e AS path, e IN ('.zip', '.gz', '.tar.xz') AS is_archive, e <> '/' AS is_file FROM (SELECT doc_id,
      CASE doc_id % 7 WHEN 0 THEN '.zip' WHEN 1 THEN '.ZIP' WHEN 2 THEN '.gz' WHEN 3 THEN '.png' WHEN 4 THEN '.tar.xz' WHEN 5 THEN '' ELSE '/' END AS e FROM documents)""",
    "store_roundtrip": f"{_STORED} UNION ALL {_STORED}",
    "record_roundtrip": _STORED,
    "record_parts": _STORED,
    "count_features": "SELECT count(*) AS n FROM embeddings",
    "expand_archives": """SELECT 'zip/' || doc_id // 10 || '.zip' AS source_path, 'd/' || lpad(doc_id::VARCHAR, 12, '0') || '.txt' AS entry_name,
      'zip/' || doc_id // 10 || '.zip/d/' || lpad(doc_id::VARCHAR, 12, '0') || '.txt' AS path, md5(coalesce(text, '')) AS md5 FROM documents""",
    "failed_files": "SELECT 't/' || doc_id || CASE doc_id % 2 WHEN 0 THEN '.zip' ELSE '.png' END AS path, CASE doc_id % 2 WHEN 0 THEN 'archive' ELSE 'decode' END AS stage FROM documents",
    "list_files": _FOLDERS,
    "read_files": f"SELECT *, n_bytes AS n_read FROM ({_FOLDERS})",
    "decode_frames": f"SELECT 'img/' || vec_id || '.pgm' AS path, 0::BIGINT AS frame_index, 150528::BIGINT AS n_bytes, g[1] AS p1, g[2] AS p2, g[3] AS p3, g[4] AS p4 FROM ({_GREYS})",
    "normalize_pixels": f"SELECT 'img/' || vec_id || '.pgm' AS path, 150528::BIGINT AS n_bytes, g[1] AS p1, g[2] AS p2, g[3] AS p3, g[4] AS p4 FROM ({_GREYS})",
    "build_features": _CORNERS,
    "picture_features": _BITMAPS,
    "build": _TREE,
    "picture_stream": _TREE,
    "query": f"""SELECT path, round(s, 6) AS score FROM ({_ALIKE}) WHERE a = 0 AND s >= 0.95::DOUBLE
      UNION ALL SELECT replace(path, '.pgm', '.bmp'), round(s, 6) FROM ({_ALIKE}) WHERE a = 0 AND s >= 0.95::DOUBLE""",
    "embed": f"SELECT * FROM ({_CORNERS}) WHERE path LIKE 'img/%'",
    "first_image": f"SELECT source_path, path, g[1] AS p1, g[2] AS p2, g[3] AS p3, g[4] AS p4 FROM ({_FIRST})",
    "build_store": f"SELECT path, '' AS stage FROM ({_PLACED}) UNION ALL SELECT 't/' || doc_id || '.png', 'decode' FROM documents WHERE text IS NOT NULL",
    "query_image": f"SELECT path, round(s, 6) AS score FROM ({_ALIKE}) WHERE a = 0 AND s >= 0.95::DOUBLE",
    "batch_query": f"""SELECT query_path, path, rank, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_path ORDER BY s DESC, path)::INT AS rank
      FROM ({_ALIKE}) WHERE a % 20 = 0 AND s >= 0.5::DOUBLE) WHERE rank <= 5""",
    "picture_queries": f"""SELECT query_path, path, rank, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_path ORDER BY s DESC, path)::INT AS rank
      FROM ({_ALIKE}) WHERE a % 20 = 0 AND s >= 0.5::DOUBLE) WHERE rank <= 5""",
    "stream_ingest": _CORNERS,
    "stream_build": _CORNERS,
    "threshold_filter": f"SELECT vec_id, round(s, 6) AS score FROM ({_SCORES} WHERE a.vec_id = 1) WHERE s >= 0.25::DOUBLE",
    "write_matches": f"""SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id)::INT AS rank, round(s, 6) AS score
      FROM ({_SCORES} WHERE a.vec_id % 20 = 0) WHERE s >= 0.3::DOUBLE""",
    "dedup_report": f"""SELECT md5(label::VARCHAR) AS md5, min(vec_id) AS a, count(*) AS b, NULL::DOUBLE AS score FROM embeddings GROUP BY label HAVING count(*) > 1
      UNION ALL SELECT NULL, query_id, vec_id, round(s, 6) FROM ({_SCORES} WHERE a.vec_id < b.vec_id) WHERE s >= 0.35::DOUBLE""",
}
