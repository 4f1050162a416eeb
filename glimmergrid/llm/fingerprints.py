"""Document fingerprints: a canonical exact digest.

A text is brought into a canonical form: Unicode compatibility normalisation
(NFKC), full case folding and NFKC again, then white space folding. It is digested
by four differently seeded xxhash64 values. Rows are then grouped by digest, and
inside a bucket the canonical bytes themselves are compared: a second text with the
digest of another would get a suffix to its fingerprint, so equal fingerprints
always mean equal canonical texts.

Everything is built from DataFrame functions. Normalisation and case folding are
those of the Unicode library that comes with Spark, called by Spark's ``reflect``.
Equal texts collapse before they are sent to the comparison, so a group of copies
of any size is one row per task.

Defined results: a null text is the empty text; empty texts share a
fingerprint; repeated rows get equal fingerprints, and follow each other in the
order of ids; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glimmergrid.llm.common import materialize, shuffle_partitions, table


def _java(kind: str, method: str, text: Column) -> Column:
    return F.reflect(F.lit(f"com.ibm.icu.{kind}"), F.lit(method), text, F.lit(True))


def normalised(text: Column) -> Column:
    """NFKC."""
    return _java("text.Normalizer", "compose", text)


def case_folded(text: Column) -> Column:
    """Full case folding: also of letters that become several."""
    return _java("lang.UCharacter", "foldCase", text)


def spaces_folded(text: Column) -> Column:
    """Each run of white space as one space, none at the ends. Most texts have single spaces and line ends only, and skip the pattern."""
    odd = F.lit(False)
    for c in "\t\x0b\f\r\x85\u1680\u2028\u2029":
        odd = odd | F.contains(text, F.lit(c))
    lines = F.replace(text, F.lit("\n"), F.lit(" "))
    lines = F.when(F.contains(lines, F.lit("  ")), F.regexp_replace(lines, " +", " ")).otherwise(lines)
    return F.trim(F.when(odd, F.regexp_replace(text, r"[\s\p{Z}\x{85}]+", " ")).otherwise(lines))


def with_form(rows: DataFrame, text: str, form: str) -> DataFrame:
    """Adds the form of ``text`` in which equal documents are equal bytes."""
    given = F.coalesce(text, F.lit(""))
    plain = F.length(given) == F.octet_length(given)
    usual = F.when(plain, F.lower(given)).otherwise(normalised(case_folded(normalised(given))))
    # In steps, so that each value is computed once.
    return rows.withColumn(form, usual).withColumn(form, spaces_folded(F.col(form)))


def digest(text: Column) -> Column:
    """256 bits of xxhash64 over a canonical text, as lowercase hex."""
    return F.concat(*[F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), text))), 16, "0") for seed in (3, 5, 7, 11)])


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row with its fingerprint after comparison of bytes, and its group.

    Returns ``id_col``, ``fingerprint``, ``group_id`` (the least id with that
    fingerprint) and ``copies`` (rows with it).
    """
    rows = with_form(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", "form").drop("text").withColumn("digest", digest(F.col("form")))
    told = materialize(distinguish(rows), "fingerprints")
    groups = materialize(told.groupBy("fingerprint").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("copies")), "groups")
    return told.join(groups, "fingerprint").select(F.col("id").alias(id_col), "fingerprint", "group_id", "copies")


def collisions(rows: DataFrame) -> DataFrame:
    """``other``, ``other_form`` and ``nth`` of the second and later forms of a digest.

    Equal forms collapse before they move, so a bucket is as large as the number
    of its distinct forms: one, unless two texts collide. The result has rows only
    where 256 bits collide, which bounds what is broadcast.
    """
    forms = rows.groupBy("digest", "form").agg(F.count(F.lit(1)).alias("rows"))
    colliding = forms.groupBy("digest").agg(F.count(F.lit(1)).alias("forms")).filter("forms > 1").select("digest")
    by_form = Window.partitionBy("digest").orderBy("form")
    later = forms.join(F.broadcast(colliding), "digest", "left_semi").withColumn("nth", F.row_number().over(by_form)).filter("nth > 1")
    return later.select(F.col("digest").alias("other"), F.col("form").alias("other_form"), "nth")


def fingerprinted(rows: DataFrame, later: DataFrame, name: str = "fingerprint") -> DataFrame:
    """Turns ``digest`` and ``form`` into a fingerprint: colliding forms get their rank as a suffix."""
    joined = rows.join(F.broadcast(later), (F.col("digest") == F.col("other")) & (F.col("form") == F.col("other_form")), "left")
    suffix = F.when(F.col("nth").isNotNull(), F.concat(F.lit("-"), F.col("nth").cast("string"))).otherwise(F.lit(""))
    return joined.withColumn(name, F.concat("digest", suffix)).drop("other", "other_form", "nth", "digest")


def distinguish(rows: DataFrame) -> DataFrame:
    """Turns ``digest`` and ``form`` into ``fingerprint``."""
    return fingerprinted(rows, collisions(rows)).drop("form")


def number_of_cuts_below(cuts: list, value: Column) -> Column:
    """How many of the sorted cuts are below ``value``; of a long list, only its stretch is searched."""
    if not cuts:
        return F.lit(0)
    size = max(1, math.isqrt(len(cuts)))
    coarse = F.array(*[F.lit(c) for c in cuts[::size]])
    before = F.greatest(F.size(F.filter(coarse, lambda c: c < value)) - 1, F.lit(0)) * size
    return before + F.size(F.filter(F.slice(F.array(*[F.lit(c) for c in cuts]), before + 1, F.lit(size)), lambda c: c < value))


def dealt_by_id(rows: DataFrame, parts: int) -> tuple[DataFrame, DataFrame | None]:
    """Deals ``id``, ``tie`` and what else there is to ranges of descending ids, each with a guest: the first row of the range that follows.

    So no range waits for another. Columns ``range``, ``sub`` and ``guest`` are
    added. An id that fills several ranges, and null ids, are cut by ``tie``, a
    hash. Of rows of such an id that equal each other all but one come back as the
    second table: each of them is followed by one that equals it.
    """
    told = rows.agg(
        F.percentile_approx("id", [i / parts for i in range(1, parts)] or [0.5], F.lit(10 * parts)).alias("cuts"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col("id").isNull()).alias("unnamed")
    ).first()
    found = told["cuts"] or []
    hot = {c: n for c, n in Counter(found).items() if n > 1}
    cuts, most = sorted(set(found)), math.ceil(told["rows"] / parts)
    unnamed = math.ceil(told["unnamed"] / max(1, most))
    twins = None
    if hot or unnamed > 1:
        crowded = F.col("id").isNull() if unnamed > 1 else F.lit(False)
        if hot:
            crowded = crowded | F.coalesce(F.col("id").isin(list(hot)), F.lit(False))
        rows = rows.withColumn("at", F.when(crowded, F.monotonically_increasing_id()))
        # At most ``parts`` rows.
        many = rows.filter(crowded).groupBy("id", "tie").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("kept")).filter(F.col("n") > most)
        many = materialize(many.select(F.col("id").alias("many_id"), F.col("tie").alias("many_tie"), "kept"), "many")
        rows = rows.join(F.broadcast(many), F.col("id").eqNullSafe(F.col("many_id")) & (F.col("tie") == F.col("many_tie")), "left")
        spare = F.coalesce(F.col("at") != F.col("kept"), F.lit(False))
        names = [c for c in rows.columns if c not in ("at", "many_id", "many_tie", "kept")]
        twins, rows = rows.filter(spare).select(names), rows.filter(~spare).select(names)
    split = F.when(F.col("id").isNull(), unnamed).otherwise(F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in hot.items() for x in kv]), F.col("id")), F.lit(1)) if hot else F.lit(1))
    sub = F.floor((F.col("tie") / 2.0**64 + 0.5) * split).cast("int")
    # Ids below a hot one get another range than it.
    alone = F.col("id").isin(list(hot)).cast("int") if hot else F.lit(0)
    nth = F.when(F.col("id").isNull(), -1).otherwise(2 * number_of_cuts_below(cuts, F.col("id")) + alone).cast("int")
    rows = rows.withColumn("range", nth).withColumn("sub", sub)
    # One row per range. The first row has the greatest id, then the least tie.
    heads = rows.groupBy("range", "sub").agg(F.max(F.struct("id", F.bitwise_not("tie").alias("tie"))).alias("head"))
    order = Window.orderBy(F.desc("range"), "sub")
    ends = Window.orderBy(F.desc("range"), "sub").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    here = F.struct("range", "sub")
    heads = heads.select(F.coalesce(F.lag(here).over(order), F.last(here).over(ends)).alias("host"), F.col("range").alias("h_range"), F.col("sub").alias("h_sub"), F.col("head.id").alias("h_id"), F.bitwise_not("head.tie").alias("h_tie"))
    first = (F.col("range") == F.col("h_range")) & (F.col("sub") == F.col("h_sub")) & F.col("id").eqNullSafe(F.col("h_id")) & (F.col("tie") == F.col("h_tie"))
    guests = rows.join(F.broadcast(heads), first).withColumn("range", F.col("host.range")).withColumn("sub", F.col("host.sub")).drop("host", "h_range", "h_sub", "h_id", "h_tie")
    return rows.withColumn("guest", F.lit(False)).unionByName(guests.withColumn("guest", F.lit(True))), twins


def with_next(dealt: DataFrame, twins: DataFrame | None, names: list[str]) -> DataFrame:
    """Adds ``next_<name>`` of the next row by descending ``id``, then by ``tie``; null ids come last, and after the last row the first."""
    down = Window.partitionBy("range", "sub").orderBy("guest", F.col("id").desc_nulls_last(), "tie")
    told = dealt.select("*", *[F.lead(n).over(down).alias(f"next_{n}") for n in names]).filter("not guest").drop("guest", "range", "sub")
    return told if twins is None else told.unionByName(twins.select("*", *[F.col(n).alias(f"next_{n}") for n in names]))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts.

    An edited text that has the digest of its own document is compared with it by
    bytes, too.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("tie", F.xxhash64("text"))
    formed = lambda rows: with_form(rows, "text", "form").withColumn("digest", digest(F.col("form")))
    later = materialize(collisions(formed(docs)), "collisions")
    dealt, twins = dealt_by_id(docs, 4 * shuffle_partitions(spark))
    told = lambda rows: fingerprinted(formed(rows), later).drop("form")
    rows = with_next(told(dealt), None if twins is None else told(twins), ["text", "fingerprint"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.left("text", F.length("text") - half), F.left("next_text", half))
    rows = rows.select(F.col("id").alias("doc_id"), "text", edited.alias("edited"), "fingerprint", "next_fingerprint")
    rows = with_form(rows, "edited", "form").withColumn("digest", digest(F.col("form")))
    rows = fingerprinted(rows, later, "edited_fingerprint")
    # Only where digests meet the document's own form is made once more.
    meets = F.col("fingerprint") == F.col("edited_fingerprint")
    rows = with_form(rows.withColumn("met", F.when(meets, F.col("text")).otherwise(F.lit(""))), "met", "met")
    rows = rows.withColumn("edited_fingerprint", F.when(meets & (F.col("met") != F.col("form")), F.concat("edited_fingerprint", F.lit("-edited"))).otherwise(F.col("edited_fingerprint")))
    alike = lambda a, b: F.when(F.col(a) == F.col(b), 1.0).otherwise(0.0)
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", alike("fingerprint", "edited_fingerprint").alias("near_edited"), alike("fingerprint", "next_fingerprint").alias("near_next"),
    )
