"""End-to-end jobs: build a store, query it, report duplicates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmergrid.functions.embedding import shared_model, unit_features
from glimmergrid.functions.paths import archive_name
from glimmergrid.functions.pixels import resized
from glimmergrid.operators.duplicates import exact_duplicates
from glimmergrid.operators.search import batch_similarity_search, near_duplicate_pairs, ranked, similarity_search, top_k
from glimmergrid.schemas import THRESHOLD, check_frames
from glimmergrid.sources.archives import can_seek, entries_at, entries_in, entry_bytes, frame_ranges
from glimmergrid.sources.files import archive_entries, list_files, read_files
from glimmergrid.sources.frames import SPARK_IMAGES, Decoder, is_image, is_spark_image, read_images, spilled_images, still_decoder
from glimmergrid.sources.store import LOOKUP, load_features, replace_version, store_parts
from glimmergrid.workspace import written

#: The largest file that Spark is asked to hand over as one value.
MAX_FILE = 1 << 30
#: Bytes of the pieces that archives are dealt out in.
LEAST_PIECE, MOST_PIECE = 1 << 20, 64 << 20
BATCH = 32
#: Images, and their bytes, that are passed on at once.
PASSED, PASSED_BYTES = 256, 4 << 20
#: Frames of a file that are decoded together.
RANGE_FRAMES = 256
TAGGED = ["path", "source_path", "entry_ordinal", "frame_index", "md5", "vgg16", "stage", "error"]
SCHEMA = "path string, source_path string, entry_ordinal long, frame_index long, md5 string, vgg16 array<float>, stage string, error string"


def _tagged(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=TAGGED).astype({"entry_ordinal": "Int64", "frame_index": "Int64"})


def _made(waiting: list[tuple], predict) -> list[tuple]:
    """Rows of frames that wait as (path, source, ordinal, index, buffer)."""
    found = unit_features(predict, np.stack([w[4].reshape(-1) for w in waiting]))
    bad = ("embed", "the feature is zero or not finite")
    return [(*w[:4], hashlib.md5(w[4].tobytes()).hexdigest(), None if v is None else v.tolist(), *((None, None) if v is not None else bad)) for w, v in zip(waiting, found)]


def _run(entries: Iterator[tuple], predict, wanted: frozenset[int] | None, decoder: Decoder, images: bool) -> Iterator[pd.DataFrame]:
    """Features of entries (source, ordinal, path, bytes, error, first and last frame or None). With ``images``, what Spark's image source reads is passed on as it is, in column ``content``."""
    waiting: list[tuple] = []
    passed: list[tuple[tuple, bytes]] = []
    held = 0

    def told(rows: list[tuple], contents: list[bytes] | None = None) -> pd.DataFrame:
        return _tagged(rows).assign(content=pd.Series(contents or [None] * len(rows), dtype=object)) if images else _tagged(rows)

    for source, nth, path, data, error, first, last in entries:
        stage = "archive" if path != source or archive_name(source) else "read"
        if error is None:
            stage = "decode"
            if images and is_image(data):
                if wanted is None or 0 in wanted:
                    passed.append(((path, source, nth, 0, None, None, None, None), data))
                    held += len(data)
                if len(passed) == PASSED or held >= PASSED_BYTES:
                    yield told(*map(list, zip(*passed)))
                    passed, held = [], 0
                continue
            try:
                asked = wanted if first is None else frozenset(i for i in range(first, last) if wanted is None or i in wanted)
                for index, image in decoder(data, asked):
                    if asked is None or index in asked:
                        waiting.append((path if index == 0 else f"{path}/{index}", source, nth, index, resized(image)))
                    if len(waiting) == BATCH:
                        yield told(_made(waiting, predict))
                        waiting = []
            except Exception as e:
                error = f"{type(e).__name__}: {e}"
        if error is not None:
            yield told([(path, source, nth, None, None, None, stage, error)])
    if waiting:
        yield told(_made(waiting, predict))
    if passed:
        yield told(*map(list, zip(*passed)))


def frame_features(files: DataFrame, make_predict, frames=None, decoder: Decoder = still_decoder) -> DataFrame:
    """Files to features in one pass: ``path``, ``source_path``, ``entry_ordinal``, ``frame_index``, ``md5``, ``vgg16``, ``stage`` and ``error``.

    Lazy, and for what the decoder reads; ``file_features`` reads the formats of
    Spark's image source, too. A task opens a file, inflates the entries of an
    archive one after another, decodes, hashes and embeds; neither bytes nor pixels
    leave it. Good rows have no error; an entry that fails half way has its good
    frames and an error row.
    """
    wanted, load = check_frames(frames), shared_model(make_predict)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def entries() -> Iterator[tuple]:
            for b in batches:
                for source, content in zip(b["path"], b["content"]):
                    found = archive_entries(source, content) if archive_name(source) else [(None, 0, source, content, None)]
                    for _, nth, path, data, error in found:
                        yield source, nth, path, data, error, None, None

        yield from _run(entries(), load(), wanted, decoder, False)

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def image_features(images: DataFrame, make_predict) -> DataFrame:
    """As ``frame_features``, for single images that Spark's image source has decoded."""
    load = shared_model(make_predict)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load()
        for b in batches:
            for k in range(0, len(b), BATCH):
                part, waiting, bad = b.iloc[k : k + BATCH], [], []
                for path, w, h, c, data, error in part[["path", "width", "height", "channels", "pixels", "error"]].itertuples(index=False):
                    if error is None:
                        waiting.append((path, path, 0, 0, resized(np.frombuffer(data, np.uint8).reshape(h, w, c))))
                    else:
                        bad.append((path, path, 0, None, None, None, "decode", error))
                yield _tagged((_made(waiting, predict) if waiting else []) + bad)

    return images.mapInPandas(run, SCHEMA)


def _entry_features(rows: DataFrame, make_predict, frames, decoder: Decoder, images: bool) -> DataFrame:
    """Features of dealt entries, each read, decoded and embedded once and written; then those of the images among them."""
    wanted, load = check_frames(frames), shared_model(make_predict)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def entries() -> Iterator[tuple]:
            for row, data, error in entry_bytes(batches):
                whole = row.first is None or row.first != row.first
                yield row.source_path, int(row.entry_ordinal), row.path, data, error, *((None, None) if whole else (int(row.first), int(row.last)))

        yield from _run(entries(), load(), wanted, decoder, images)

    if not images:
        return written(rows.mapInPandas(run, SCHEMA), "told")
    told = written(rows.mapInPandas(run, f"{SCHEMA}, content binary").withColumn("key", F.monotonically_increasing_id()), "told")
    done, pictures = told.filter("content IS NULL").select(TAGGED), told.filter("content IS NOT NULL")
    if pictures.isEmpty():
        return done
    made = image_features(spilled_images(pictures).withColumn("path", F.col("key").cast("string")).drop("key"), make_predict)
    made = made.select(F.col("path").cast("long").alias("key"), "frame_index", "md5", "vgg16", "stage", "error")
    # Features meet, not pixels.
    found = pictures.select("key", "path", "source_path", "entry_ordinal").join(made, "key").select(TAGGED)
    return done.unionByName(written(found, "pictures"))


def file_features(files: DataFrame, make_predict, frames=None, decoder: Decoder = still_decoder, images: bool = True) -> DataFrame:
    """As ``frame_features``, for all formats: files (``path``, ``content``) and entries of archives that begin like JPEG, PNG, GIF or BMP go through Spark's image source.

    Entries are dealt out, still packed, to as many tasks as there are cores or
    more before anything is inflated or decoded. With ``images=False`` the decoder
    has every format.
    """
    spark = files.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return _entry_features(entries_in(files, LEAST_PIECE).repartition(tasks), make_predict, frames, decoder, images)


def features_at(listed: DataFrame, make_predict, frames=None, decoder: Decoder = still_decoder, images: bool = True) -> DataFrame:
    """As ``file_features``, for listed files (``path``, ``length``) that tasks open themselves, of any size.

    Only names and places are dealt out, by bytes: an archive is cut into pieces
    by its directory, and each task seeks to its entries. A decoder with a function
    ``count`` (bytes to the number of frames) has files of many frames in ranges of
    ``RANGE_FRAMES``, each a task's work of its own; a range that fails keeps its frames
    before the failure and has an error row, the others stay.
    """
    tasks = listed.sparkSession.sparkContext.defaultParallelism
    total = listed.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]
    piece = min(MOST_PIECE, max(LEAST_PIECE, total // (4 * tasks)))
    parts = max(4 * tasks, -(-total // piece))
    dealt = entries_at(listed, piece).repartition(parts, "source_path", "piece")
    if count := getattr(decoder, "count", None):
        dealt = frame_ranges(dealt, count, check_frames(frames), RANGE_FRAMES).repartition(parts, "source_path", "entry_ordinal", "first")
    return _entry_features(dealt, make_predict, frames, decoder, images)


def features_below(spark: SparkSession, root: str | list[str], make_predict, frames=None, decoder: Decoder = still_decoder, max_file: int | None = None, images: bool = True) -> DataFrame:
    """Features of all files below ``root``, tagged as in ``frame_features``. Each file is read once.

    Files with names of JPEG, PNG, GIF and BMP go through Spark's image source, as
    single images; all others, and the entries of archives, as in ``file_features``
    (not with ``images=False``: then the decoder has them all). In stores that
    tasks can open there is no limit to a file's size unless ``max_file`` says so;
    in others Spark hands a file over as one value, so those over 1 GiB are errors.
    """
    wanted = check_frames(frames)
    # Written, as it is read many times: by Spark's scan each time every file is asked for anew.
    listed = written(list_files(spark, root), "listed")
    mine = ~is_spark_image(F.col("path")) if images else F.lit(True)
    seek = can_seek(listed)
    limit = max_file if max_file is not None or seek else MAX_FILE
    files = listed if seek else read_files(spark, root)
    told = files.filter(mine)
    if limit is not None:
        told = told.filter(F.col("length") <= limit)
    told = features_at(told, make_predict, frames, decoder, images) if seek else file_features(told, make_predict, frames, decoder, images)
    if limit is not None:
        empty = [F.lit(None).cast(t).alias(n) for n, t in (("frame_index", "long"), ("md5", "string"), ("vgg16", "array<float>"))]
        large = listed.filter(mine & (F.col("length") > limit))
        told = told.unionByName(large.select("path", F.col("path").alias("source_path"), F.lit(0).cast("long").alias("entry_ordinal"), *empty, F.lit("read").alias("stage"), F.lit("larger than the limit").alias("error")))
    if not images or (wanted is not None and 0 not in wanted) or listed.filter(~mine).isEmpty():
        return told
    return told.unionByName(image_features(read_images(spark, root, SPARK_IMAGES), make_predict))


def build(spark: SparkSession, root: str | list[str], out: str, make_predict, frames=None, decoder: Decoder = still_decoder, max_file: int | None = None, images: bool = True) -> dict[str, int]:
    """Builds the store ``out`` from all files below ``root``; returns how many features and errors there are."""
    return build_store(features_below(spark, root, make_predict, frames, decoder, max_file, images), out)


def build_store(told: DataFrame, out: str) -> dict[str, int]:
    """Writes a tagged table as the store ``out``; returns how many features and errors there are.

    The expensive pass runs once and writes one table, split by whether a row
    failed, in ``rows``, and the errors once more in ``errors``, both below the new
    version's folder. A store that is being read is replaced whole, and may be read
    to make ``told``.
    """
    spark = told.sparkSession
    replace_version(spark, out, lambda folder: write_tagged(told, f"{folder}/rows", f"{folder}/errors"))
    return {"features": features_of(spark, out).count(), "errors": errors_of(spark, out).count()}


def write_tagged(told: DataFrame, rows_path: str, errors_path: str) -> None:
    """Writes the tagged table once, then the small error table from it; features stay where they are."""
    rows = told.select("path", "md5", "vgg16", "stage", "error", F.col("error").isNotNull().alias("failed"))
    rows.sortWithinPartitions("failed", "md5").write.mode("overwrite").options(**LOOKUP).partitionBy("failed").parquet(rows_path)
    rows = told.sparkSession.read.schema(rows.schema).parquet(rows_path)
    rows.filter("failed").select("path", "stage", "error").write.mode("overwrite").parquet(errors_path)


def features_of(spark: SparkSession, store: str) -> DataFrame:
    """The features of a store, built or streamed; only that part of the table is read."""
    schema = "path string, md5 string, vgg16 array<float>, failed boolean"
    parts = [spark.read.schema(schema).parquet(p).filter("NOT failed").select("path", "md5", "vgg16") for p in store_parts(spark, store, "rows")]
    return reduce(DataFrame.unionByName, parts)


def errors_of(spark: SparkSession, store: str) -> DataFrame:
    parts = [spark.read.schema("path string, stage string, error string").parquet(p).select("path", "stage", "error") for p in store_parts(spark, store, "errors")]
    return reduce(DataFrame.unionByName, parts)


def first_features(told: DataFrame) -> DataFrame:
    """``query_path`` and ``vgg16`` of the first good frame of each file. Of an archive, features meet and not pixels."""
    first = F.min_by("vgg16", F.struct("entry_ordinal", "frame_index")).alias("vgg16")
    return told.filter("error IS NULL").groupBy(F.col("source_path").alias("query_path")).agg(first)


def query_vector(told: DataFrame) -> list[float]:
    """The feature of the first image that files yield: one row comes to the driver."""
    found = first_features(told).orderBy("query_path").limit(1).first()
    if found is None:
        raise ValueError("the query file yields no image with a feature")
    return list(found["vgg16"])


def query(spark: SparkSession, features: DataFrame | str, image: str, make_predict, t: float = THRESHOLD, k: int | None = None, decoder: Decoder = still_decoder) -> DataFrame:
    """Stored images most similar to one image file: ``path``, ``md5``, ``score``, best first."""
    store = load_features(spark, features) if isinstance(features, str) else features
    vector = query_vector(features_below(spark, image, make_predict, {0}, decoder))
    return similarity_search(store, vector, t, k).select("path", "md5", "score")


def batch_query(spark: SparkSession, features: DataFrame, images: DataFrame, make_predict, t: float = THRESHOLD, k: int | None = None, decoder: Decoder = still_decoder) -> DataFrame:
    """Matches of every query file: ``query_path``, ``path``, ``score``, ``rank``. Query images are embedded once and written."""
    asked = written(first_features(file_features(images, make_predict, {0}, decoder)), "asked")
    if k is not None:
        return top_k(features, asked, k, t)
    return ranked(batch_similarity_search(features, asked, t))


def dedup_report(features: DataFrame, t: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Groups of equal content, and pairs of similar content."""
    return exact_duplicates(features), near_duplicate_pairs(features, t)
