"""Line dedup by a deletion-neighbourhood join.

A line goes if an earlier line, by (id, place in the document), equals it or is
within one edit (insertion, deletion or substitution of a character) of it. The
earliest stays. Lines are compared after white space is folded and trimmed.

1. Equal lines collapse to one row with the place of their first occurrence.
2. Two lines within one edit are equal outside the block in which the edit lies.
   Of all distinct lines only those go on that share all but one of two blocks
   (a half) with another line, and of these only those that share all but one of
   sixteen.
   No pair within the bound is lost, and a line without near lines costs a few
   keys instead of a whole neighbourhood.
3. Those emit the deletion neighbourhood of the open block: the block and every
   variant with one character deleted, as keys hashed with what surrounds it.
4. Equal variants meet. All lines that could be one edit apart in a bucket are one
   edit from its earliest line of the right kind, so each line is verified by edit
   distance against that one only, and a bucket of any size costs a row a line.

Lines under ``min_chars`` characters after folding go only if an earlier line
equals them: at one edit they say too little. Blank lines part paragraphs and
always stay.

Defined results: a null text has no lines and stays null; an empty text is one
empty line and stays; rows that repeat an id and a text are judged as one row;
an empty table gives an empty result. Line ends are ``\\n``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmergrid.llm.common import bound, materialize, table

MIN_CHARS = 10
FINE = 16
PLACE = ["id", "mark", "nth"]


def folded(line: Column) -> Column:
    """The form in which lines are compared. Most lines have nothing to fold and skip the pattern."""
    odd = F.contains(line, F.lit("  "))
    for c in "\t\x0b\f\r":
        odd = odd | F.contains(line, F.lit(c))
    return F.trim(F.when(odd, F.regexp_replace(line, r"[ \t\x0B\f\r]+", " ")).otherwise(line))


def half_keys(line: Column) -> list[Column]:
    """Hashes of the two halves, each with the length it is cut by: as the shorter line of a pair, and as the longer."""
    found = []
    for short in (F.length(line), F.length(line) - 1):
        half = F.floor(short / 2).cast("int")
        found += [F.xxhash64(short, F.lit("<"), F.left(line, half)), F.xxhash64(short, F.lit(">"), F.right(line, short - half))]
    return found


def block_keys(line: Column, blocks: int) -> Column:
    """All (key, start, length, longer) of one block left open.

    A key stands for the text before and after the block. Blocks are cut by the
    length of the shorter line of a pair, so a line is cut twice: as the shorter
    or equally long one, and as the one that is longer by a character.
    """
    n = F.length(line)

    def cut(short: Column, longer: int) -> Column:
        def key(b: Column) -> Column:
            start = F.floor(b * short / blocks).cast("int")
            tail = (short - F.floor((b + 1) * short / blocks)).cast("int")
            return F.struct(
                F.xxhash64(short, b, F.left(line, start), F.lit("|"), F.right(line, tail)).alias("key"),
                start.alias("start"), (n - tail - start).alias("length"), F.lit(bool(longer)).alias("longer"),
            )

        return F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), key)

    return F.concat(cut(n, 0), cut(n - 1, 1))


def variants(key: Column, block: Column, longer: Column) -> Column:
    """An open block's deletion neighbourhood: (variant, kind) for the block itself and each character deleted.

    Of lines of one length, those that are equal but for a character share the
    variant without it, hashed with its place: kind 0. A line that is longer by a
    character has the shorter line's whole block (kind 1) as a variant (kind 2).
    """
    places = F.sequence(F.lit(1), F.greatest(F.length(block), F.lit(1)))
    left = lambda i: F.concat(F.left(block, i - 1), F.substr(block, i + 1))
    same = F.transform(places, lambda i: F.struct(F.xxhash64(key, i, left(i)).alias("variant"), F.lit(0).alias("kind")))
    cut = F.transform(places, lambda i: F.struct(F.xxhash64(key, left(i)).alias("variant"), F.lit(2).alias("kind")))
    whole = F.array(F.struct(F.xxhash64(key, block).alias("variant"), F.lit(1).alias("kind")))
    return F.when(longer, cut).otherwise(F.concat(whole, same))


def all_lines(rows: DataFrame) -> DataFrame:
    """One row per line: its place and its folded form."""
    return rows.select("id", "mark", F.posexplode(F.split("text", "\n")).alias("nth", "line")).withColumn("line", folded(F.col("line")))


def distinct_lines(rows: DataFrame, min_chars: int) -> DataFrame:
    """One row per distinct line that isn't blank: its first place and the keys of its halves, null if it is short. 128 bits stand for the line."""
    keys = [F.when(F.length("line") >= min_chars, k).alias(f"k{i}") for i, k in enumerate(half_keys(F.col("line")))]
    lines = all_lines(rows).filter("line <> ''").select(*PLACE, F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), *keys)
    found = lines.groupBy("h1", "h2").agg(F.min(F.struct(*PLACE)).alias("place"), *[F.min(f"k{i}").alias(f"k{i}") for i in range(4)])
    return found.select("place.*", *[f"k{i}" for i in range(4)])


def shared(keyed: DataFrame, key: str) -> DataFrame:
    """Rows of ``keyed`` whose ``key`` another row has too.

    The repeated keys are written first, so that both sides of the join are plain
    shuffles and a hot key's rows can be split.
    """
    often = materialize(keyed.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select(key), "often")
    return keyed.join(often, key, "left_semi")


def same_place(a: DataFrame, b: DataFrame, names: tuple[str, ...] = ("id", "mark", "nth")) -> Column:
    return F.lit(True) if not names else a[names[0]].eqNullSafe(b[names[0]]) & same_place(a, b, names[1:])


def near_earlier(lines: DataFrame) -> DataFrame:
    """Places of the lines that are one edit from an earlier one; ``lines`` has distinct lines by place."""
    keyed = lines.select(*PLACE, F.explode(block_keys(F.col("line"), FINE)).alias("k")).select(*PLACE, "k.*")
    texts = lines.select(*[F.col(c).alias(f"{c}_t") for c in PLACE], F.col("line").alias("text_t"))

    def with_text(df: DataFrame, prefix: str, name: str) -> DataFrame:
        on = F.lit(True)
        for c in PLACE:
            on = on & df[f"{prefix}{c}"].eqNullSafe(texts[f"{c}_t"])
        return df.join(texts, on).withColumn(name, F.col("text_t")).drop("text_t", *[f"{c}_t" for c in PLACE])

    opened = with_text(shared(keyed, "key"), "", "line")
    block = F.substr("line", F.col("start") + 1, F.col("length"))
    emitted = opened.select(*PLACE, F.explode(variants(F.col("key"), block, F.col("longer"))).alias("v")).select(*PLACE, "v.*")
    met = materialize(shared(emitted, "variant"), "lines-met")
    place = F.struct(*PLACE)
    # The earliest of each kind is enough: lines of kind 0 are all one edit from each other, those of 1 and 2 from those of 2 and 1.
    first = met.groupBy("variant").agg(*[F.min(F.when(F.col("kind") == k, place)).alias(f"first{k}") for k in range(3)])
    first = materialize(first, "lines-first")
    earlier = F.when(F.col("kind") == 0, F.col("first0")).when(F.col("kind") == 1, F.col("first2")).otherwise(F.col("first1"))
    later = met.join(first, "variant").withColumn("e", earlier).filter(F.col("e").isNotNull()).filter(place > F.col("e"))
    pairs = later.select(*PLACE, *[F.col(f"e.{c}").alias(f"e_{c}") for c in PLACE]).distinct()
    told = with_text(with_text(pairs, "", "line"), "e_", "earlier")
    return told.filter(F.levenshtein("line", "earlier", 1) >= 0).select(*PLACE).distinct()


def per_document(places: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """``rows`` with the sorted line numbers that ``places`` has of them."""
    listed = places.groupBy("id", "mark").agg(F.sort_array(F.collect_list("nth")).alias("nths"))
    return rows.join(listed, same_place(rows, listed, ("id", "mark")), how).select(rows["*"], "nths")


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), min_chars: int = MIN_CHARS) -> DataFrame:
    """Documents without the lines that an earlier line makes redundant.

    Returns, for each input row, ``id_col``, the columns of ``keep``,
    ``kept_text``, ``n_lines`` and ``n_removed``.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("mark"), F.col(text_col).alias("text"), F.struct(F.lit(0).alias("_"), *keep).alias("kept"))
    slim = rows.select("id", "mark", "text")
    unique = materialize(distinct_lines(slim, min_chars), "lines-unique")
    keyed = unique.select(*PLACE, F.explode(F.array_distinct(F.array_compact(F.array(*[f"k{i}" for i in range(4)])))).alias("key"))
    candidates = per_document(shared(keyed, "key").select(*PLACE).distinct(), slim, "inner")
    picked = bound(F.split("text", "\n"), lambda lines: F.transform("nths", lambda i: F.struct(i.alias("nth"), F.element_at(lines, i + 1).alias("line"))))
    picked = candidates.dropDuplicates(["id", "mark"]).select("id", "mark", F.explode(picked).alias("l")).select("id", "mark", "l.*")
    near = materialize(picked.select(*PLACE, folded(F.col("line")).alias("line")), "lines-near")
    gone = near_earlier(near)
    firsts = unique.select(*PLACE).join(gone, same_place(unique, gone), "left_anti")
    blank = all_lines(slim).filter("line = ''").select(*PLACE).distinct()
    told = per_document(firsts.union(blank), rows, "left")
    kept_text = bound(F.split("text", "\n"), lambda lines: F.array_join(F.transform("nths", lambda i: F.element_at(lines, i + 1)), "\n"))
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    stays = F.coalesce(F.size("nths"), F.lit(0))
    return told.select(
        F.col("id").alias(id_col),
        *[F.col("kept")[c].alias(c) for c in keep],
        F.when(F.col("text").isNotNull(), F.coalesce(kept_text, F.lit(""))).alias("kept_text"),
        F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"),
        F.when(F.col("text").isNull(), 0).otherwise(n_lines - stays).cast("long").alias("n_removed"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line dedup leaves of every document."""
    told = dedup_lines(table(spark, sf_dir, "documents"))
    return told.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("kept_text", F.lit(""))).alias("kept_md5"))


ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS nth FROM documents),
f AS (SELECT doc_id, nth, raw, trim(regexp_replace(raw, '[ \t\x0B\f\r]+', ' ', 'g')) AS line FROM l),
u AS (SELECT line, min((doc_id, nth)) AS place FROM f WHERE line <> '' GROUP BY line),
k AS (SELECT line, place, unnest([(s, 'a', left(line, s // 2)), (s, 'b', right(line, s - s // 2))]) AS key
      FROM (SELECT line, place, unnest([length(line), length(line) - 1]) AS s FROM u WHERE length(line) >= 10)),
near AS (SELECT DISTINCT b.line FROM k a JOIN k b ON a.key = b.key AND a.place < b.place
         WHERE abs(length(a.line) - length(b.line)) <= 1 AND levenshtein(a.line, b.line) <= 1),
v AS (SELECT f.*, f.line = '' OR (u.place = (f.doc_id, f.nth) AND near.line IS NULL) AS stays
      FROM f LEFT JOIN u ON f.line = u.line LEFT JOIN near ON f.line = near.line)
SELECT d.doc_id, count(v.nth)::BIGINT AS n_lines, coalesce(sum((NOT v.stays)::INT), 0)::BIGINT AS n_removed,
  md5(coalesce(string_agg(v.raw, chr(10) ORDER BY v.nth) FILTER (v.stays), '')) AS kept_md5
FROM documents d LEFT JOIN v ON d.doc_id = v.doc_id GROUP BY d.doc_id
"""
