"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source has a weight and gets that share of a word budget, at most
``max_epochs`` times what it holds. A source's documents are taken in complete
epochs first. What is left of its budget is filled in the order of exponential
keys, scaled by the documents' quality weights: the weighted sampling without
replacement of Efraimidis and Spirakis, with a running sum in place of a count.

No step holds a source in one task. Documents are dealt to ranges of keys of a
source, which are cut until each has at most ``range_rows`` rows; they are summed
there, and the sums of earlier ranges are added from a table of one row per range.
Rows that can't be told apart are dealt to shares by number. Sources, too, may be
many: they are ranked in sorted ranges, and their common level is found by sums.

Defined results: a null or empty text has size 0 and nothing is taken of it; a
null source is a source of its own, ordered last; rows that repeat an id are
separate documents (identical rows share a key, so either may come first); an
empty table gives an empty result. Only the named columns are carried, with the
columns in ``keep``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glimmergrid.llm.common import materialize, shuffle_partitions, table

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[!#$%&*|]"
#: Words that the next word repeats.
AGAIN = r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)[\x20\x09-\x0D]++(?=\1(?![^\x20\x09-\x0D]))"
# Constant, and factors of the share of symbols and of repeated words, fitted by logistic
# regression to the quality labels of the given tables (rows that may be learned from; held-out accuracy 1.00 of 800).
QUALITY = (6.5, -130.0, -19.0)
WEIGHTS = (5.0, 2.0, 1.0)
#: Bits of a key's logarithm, and those that ranges leave out, from coarse to fine.
KEY_BITS, LEFT_OUT = 43, (36, 24, 12, 0)
#: Stands for a cut of one place by the numbers of rows.
SHARES = -1


def word_count(text: Column) -> Column:
    """Words of ``text``: maximal runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_quality(text: Column) -> Column:
    """Default quality weight in (0, 1): a fitted logistic function of a text's shares of symbols and of words that the next one repeats."""
    symbols = F.regexp_count(text, F.lit(SYMBOLS)) / F.greatest(F.length(text), F.lit(1))
    again = F.regexp_count(text, F.lit(AGAIN)) / F.greatest(word_count(text), F.lit(1))
    z = QUALITY[0] + QUALITY[1] * F.coalesce(symbols, F.lit(0.0)) + QUALITY[2] * F.coalesce(again, F.lit(0.0))
    return 1.0 / (1.0 + F.exp(-z))


def source_targets(sizes: DataFrame, share: float, weights: Sequence[float], max_epochs: float) -> DataFrame:
    """Targets per source: ``sizes`` (source, source_size) plus ``target``.

    Weights go by the rank of the source's name. The common level starts at the
    budget per weight; sources that reach their limit below it leave the rest to
    the others, until none does. A round is two sums, and only they come back.
    """
    spark = sizes.sparkSession
    dealt = sizes.repartitionByRange(shuffle_partitions(spark), F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt, "sources")
    # One row per range of names.
    held = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    nth = dealt.withColumn("within", within).join(F.broadcast(held.select("part", before.alias("before"))), "part").withColumn("nth", F.col("within") + F.col("before"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("nth") - 1) % len(weights) + 1).cast("int"))
    known = nth.select("source", "source_size", weight.alias("weight"), (F.lit(float(max_epochs)) * F.col("source_size")).alias("limit"))
    known = materialize(known, "weighted")
    told = known.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    budget, level, full = share * float(told["size"] or 0), None, -1
    if told["weight"]:
        level, now = budget / told["weight"], 0
        while level is not None and now != full:
            full, over = now, F.col("limit") < F.lit(level) * F.col("weight")
            got = known.agg(F.sum(F.when(over, F.col("limit")).otherwise(0.0)).alias("limits"), F.sum(F.when(~over, F.col("weight"))).alias("open"), F.count_if(over).alias("full")).first()
            now = got["full"]
            level = (budget - got["limits"]) / got["open"] if got["open"] else None
    target = F.col("limit") if level is None else F.least(F.col("limit"), F.lit(level) * F.col("weight"))
    return known.select("source", "source_size", F.round(target, 6).alias("target"))


def key_ranges(rows: DataFrame, most: int) -> tuple[DataFrame, list[tuple[int, DataFrame]]]:
    """Cuts the keys of each source into ranges of up to ``most`` rows (more or less).

    Gives ``rows`` with ``range`` and ``share``, and the cuts that were made, for
    ``in_ranges``. ``range`` is the least place that a key of the range can have,
    where places are the keys' logarithms in fixed point. Ranges with too many rows
    are cut finer; the list of them has at most a row for ``most`` rows.
    """
    cuts: list[tuple[int, DataFrame]] = []
    placed = in_ranges(rows, cuts)
    for bits in (*LEFT_OUT[1:], SHARES):
        held = placed.groupBy("skey", "range").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
        held = materialize(held.select(F.col("skey").alias("h_skey"), F.col("range").alias("h_range"), F.ceil(F.col("n") / most).alias("shares")), "crowded")
        if held.isEmpty():
            break
        cuts.append((bits, held))
        placed = in_ranges(rows, cuts)
    return placed, cuts


def in_ranges(rows: DataFrame, cuts: list[tuple[int, DataFrame]]) -> DataFrame:
    """``rows`` with ``range`` and ``share``.

    Rows of one place hold the same id and text, so there the order doesn't matter:
    shares are by the number of a row, which must be the same in each run; such
    ``rows`` have to be written before.
    """

    def cut(bits: int):
        return F.shiftleft(F.shiftright(F.col("place"), bits), bits)

    rows = rows.withColumn("range", cut(LEFT_OUT[0])).withColumn("share", F.lit(0).cast("long"))
    if any(bits == SHARES for bits, _ in cuts):
        rows = rows.withColumn("number", F.monotonically_increasing_id())
    for bits, held in cuts:
        met = rows.join(F.broadcast(held), (F.col("skey") == F.col("h_skey")) & (F.col("range") == F.col("h_range")), "left")
        crowded = F.col("shares").isNotNull()
        if bits == SHARES:
            rows = met.withColumn("share", F.when(crowded, F.pmod(F.xxhash64("number"), F.col("shares"))).otherwise(0)).drop("number")
        else:
            rows = met.withColumn("range", F.when(crowded, cut(bits)).otherwise(F.col("range")))
        rows = rows.drop("h_skey", "h_range", "shares")
    return rows


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: Sequence[str] = (),
    share: float = 1.5,
    weights: Sequence[float] = WEIGHTS,
    max_epochs: float = 2.0,
    quality=text_quality,
    seed: int = 17,
    range_rows: int = 100_000,
) -> DataFrame:
    """How much of each document the mix takes.

    Returns one row per input row: ``id_col``, ``source``, the columns of
    ``keep``, ``size``, ``source_size``, ``target``, ``epochs`` (complete
    copies), ``part`` (words of one more, incomplete or complete, copy) and
    ``taken``.
    """
    drawn = F.concat_ws("|", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("")), "tie")
    uniform = (F.conv(F.substring(F.md5(drawn), 1, 13), 16, 10).cast("double") + 0.5) / 2.0**52
    rows = (
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"), F.struct(F.lit(0).alias("_"), *keep).alias("kept"))
        .withColumn("size", word_count(F.col("text")))
        .withColumn("tie", F.md5(F.coalesce(F.col("text"), F.lit(""))))
        .withColumn("key", -F.ln(uniform) / quality(F.col("text")))
        .withColumn("place", F.floor((F.ln("key") + 40) * 2.0**KEY_BITS))
        .withColumn("skey", F.concat(F.when(F.col("source").isNull(), "-").otherwise("+"), F.coalesce(F.col("source"), F.lit(""))))
        .drop("text")
    )
    # Without other columns a row is small: written once, it is cut and summed without reading the texts again.
    small = materialize(rows if not keep else rows.drop("kept"), "keyed")
    placed, cuts = key_ranges(small, range_rows)
    if not keep:
        rows = placed
    elif cuts and cuts[-1][0] == SHARES:
        rows = in_ranges(materialize(rows, "keyed-rows"), cuts)
        placed = rows
    else:
        rows = in_ranges(rows, cuts)
    sums = materialize(placed.groupBy("source", "skey", "range", "share").agg(F.sum("size").alias("held")), "mix-sums")
    targets = source_targets(sums.groupBy("source").agg(F.sum("held").alias("source_size")), share, weights, max_epochs)
    earlier = Window.partitionBy("skey").orderBy("range", "share").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("held").over(earlier), F.lit(0)))
    plan = starts.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("skey", "range", "share", "start", "source_size", "target")
    within = Window.partitionBy("skey", "range", "share").orderBy("key", "id", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    before = F.col("start") + F.col("running") - F.col("size")
    return (
        rows.withColumn("running", F.sum("size").over(within))
        .join(plan, ["skey", "range", "share"])
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), left - before)).cast("long"))
        .withColumn("taken", F.col("epochs") * F.col("size") + F.col("part"))
        .select(F.col("id").alias(id_col), "source", *[F.col("kept")[c].alias(c) for c in keep], "size", "source_size", "target", "epochs", "part", "taken")
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH w AS (SELECT doc_id, source, text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words, md5(coalesce(text, '')) AS tie FROM documents),
q AS (SELECT *, len(words)::BIGINT AS size,
    6.5::DOUBLE - 130::DOUBLE * coalesce(len(regexp_extract_all(text, '[!#$%&*|]'))::DOUBLE / greatest(length(text), 1), 0)
      - 19::DOUBLE * (len(list_filter(range(1, len(words)), lambda i: words[i] = words[i + 1]))::DOUBLE / greatest(len(words), 1)) AS z FROM w),
d AS (
  SELECT doc_id, source, size, tie,
    -ln((('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, '') || '|' || tie), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / (1 / (1 + exp(-z))) AS k
  FROM q),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM d GROUP BY source),
v AS (SELECT *, (CASE (nth - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight, 2.0::DOUBLE * source_size AS lim,
        1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s),
o AS (SELECT *, (budget - coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM v),
l AS (SELECT min_by(level, lim / weight) AS level FROM o WHERE level <= lim / weight),
t AS (SELECT source, source_size, round(least(lim, coalesce(l.level * weight, lim)), 6) AS target FROM o, l),
e AS (SELECT t.*, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
r AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, round(e.target - e.epochs * e.source_size)::BIGINT AS remains,
        (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.tie ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS earlier
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, epochs * size + greatest(0, least(size, remains - earlier)) AS taken FROM r
"""
