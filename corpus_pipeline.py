"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame. It works on
all that its predecessor kept; all but the last return the columns of
``documents``. ``run`` writes each stage's result as Parquet into the shared
folder and reads it back for the next.

The first stage learns from ``labels`` and has no SQL twin; the tests hold each
stage against a brute-force version instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmergrid.llm.common import materialize, row_keys, table
from glimmergrid.llm.jaccard import jaccard_join
from glimmergrid.llm.line_dedup import dedup_lines
from glimmergrid.llm.mixing import SPACE, mix_sources
from glimmergrid.llm.packing import pack
from glimmergrid.llm.toxicity import fit_toxicity, score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5. A null text has nothing toxic and stays."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    told = score_toxicity(docs, model, keep=("text", "lang", "source", "n_chars"))
    return told.filter(F.col("score") < TOXIC).select(COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line makes redundant.

    A document that loses all its lines goes; one that had no text stays.
    """
    told = dedup_lines(docs, keep=("lang", "source", "n_chars"))
    left = told.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    text = F.col("kept_text")
    n_chars = F.when(F.col("n_removed") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars"))
    return left.select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the least id, then by a hash of id and text.

    Null ids come last. Rows that repeat id and text are one document; rows that
    repeat an id with other texts are documents of their own. Texts without a
    word are like nothing and all stay.
    """
    told = jaccard_join(docs)
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "k1", "k2")
    classes = told.filter("near_class IS NOT NULL").groupBy("near_class").agg(F.min(order).alias("first"))
    first = materialize(classes.select("first.k1", "first.k2"), "stage-first")
    words = told.filter("near_class IS NULL").select("k1", "k2").distinct().withColumn("wordless", F.lit(True))
    keyed = docs.select(*COLUMNS, *row_keys("doc_id", "text"))
    alone = keyed.join(words, ["k1", "k2"], "left_semi").select(COLUMNS)
    # Combined before they move; of rows that differ in other columns only, the least is taken.
    chosen = keyed.join(first, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.min(F.struct(*COLUMNS)).alias("row"))
    return chosen.select("row.*").unionByName(alone)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes; the last copy of a source is cut to the words its budget has left."""
    told = mix_sources(docs, keep=("text", "lang", "n_chars")).filter("taken > 0")
    copies = F.array_repeat("size", F.col("epochs").cast("int"))
    copies = F.when(F.col("part") > 0, F.concat(copies, F.array("part"))).otherwise(copies)
    rows = told.withColumn("words", F.explode(copies))
    whole = F.col("words") == F.col("size")
    cut = F.array_join(F.slice(F.filter(F.split("text", SPACE), lambda w: w != ""), F.lit(1), F.col("words").cast("int")), " ")
    rows = rows.withColumn("taken_text", F.when(whole, F.col("text")).otherwise(cut))
    n_chars = F.when(whole, F.col("n_chars")).otherwise(F.length("taken_text").cast("long"))
    return rows.select("doc_id", F.col("taken_text").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of 1024 tokens."""
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("jaccard", drop_near_duplicates),
    ("mixing", mix),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents").select(COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
