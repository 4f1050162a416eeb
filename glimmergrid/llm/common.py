"""Small helpers that the operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: what ``spark.checkpoint.dir`` or ``setCheckpointDir`` names.

    Where none is set, a session in one process (master ``local``) gets a
    temporary one; on a cluster no folder is known to be shared, so that is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="shared-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(named)
    return named


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    It cuts the lineage: a lost executor costs a reread, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores.

    Large inputs are scanned in many splits already and stay as they are, and so
    do plans that shuffle anyway; small files with one row group are dealt out so
    that Python work runs in parallel.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` evaluated once, also where ``use`` has it inside a function over an array."""
    return F.element_at(F.transform(F.array(value), lambda x: use(x)), 1)


def held_out(doc_id: Column) -> Column:
    """True for the fifth of all ids that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def row_keys(id_col: str, text_col: str) -> list[Column]:
    """``k1`` and ``k2``, 128 bits that stand for a row's id and text; null ids have them, too."""
    row = (F.col(id_col).isNull(), F.col(id_col), F.col(text_col).isNull(), F.col(text_col))
    return [F.xxhash64(*row).alias("k1"), F.xxhash64(F.lit(7), *row).alias("k2")]
