"""Features of files as they arrive.

The stream has no state of its own: the checkpoint knows which files are done.
A batch writes into a folder of its own, which it replaces if it runs again after
a failure, so each file is ingested once, also after a restart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from glimmergrid.plans.jobs import features_at, file_features, write_tagged
from glimmergrid.schemas import FILES
from glimmergrid.sources.archives import SCHEMES, scheme_of
from glimmergrid.sources.files import small_files
from glimmergrid.sources.frames import Decoder, still_decoder


def arriving_files(spark: SparkSession, root: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the files below ``root``: names and lengths, where tasks can open them, so a file may have any size; else with their bytes."""
    reader = small_files(spark).readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    files = reader.load(root)
    home = scheme_of(root) or spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file").partition(":")[0]
    return files.drop("content") if home in SCHEMES else files


def _features(batch: DataFrame, make_predict, frames, decoder: Decoder) -> DataFrame:
    return (file_features if "content" in batch.columns else features_at)(batch, make_predict, frames, decoder)


def stream_features(files: DataFrame, out: str, checkpoint: str, make_predict, frames=None, decoder: Decoder = still_decoder) -> StreamingQuery:
    """Adds the features of a stream of files to the table ``out``, errors included (column ``error``), and ends when no file is left."""

    def add(batch: DataFrame, number: int) -> None:
        rows = _features(batch, make_predict, frames, decoder).select("path", "md5", "vgg16", "stage", "error")
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_build(files: DataFrame, store: str, checkpoint: str, make_predict, frames=None, decoder: Decoder = still_decoder) -> StreamingQuery:
    """Adds a stream of files to a store in the layout of ``build``, a batch at a time. ``features_of`` and ``errors_of`` read the store."""

    def add(batch: DataFrame, number: int) -> None:
        write_tagged(_features(batch, make_predict, frames, decoder), f"{store}/rows/batch={number}", f"{store}/errors/batch={number}")

    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
