"""N-gram Jaccard join by MinHash banding.

Texts become sets of hashed word n-grams (lower case, words between ASCII white
space). Bands and rows are chosen so that a pair at the threshold meets in some
band with the target probability. The shuffle goes on band hashes; texts that
meet there are verified on their full n-gram sets.

1. Texts with equal sets form a class; from here on a class is one row, however
   many copies it has.
2. In a band every class is compared with the band's least class, then those that
   are unlike it with all of the band, in blocks. Two classes are alike if the
   sizes of their sets allow the threshold and enough of their MinHash values
   agree; a pair at the threshold fails that with a tenth of the probability with
   which it meets in no band. So chance meetings don't chain, and a large band of
   like texts costs one comparison a member.
3. Each connected component of like classes is verified exactly, all its members
   against each other, in blocks: large ones are cut into blocks, by rows and by
   bytes, that meet pairwise. Blocks hold n-gram sets, not texts. A task returns
   link counts and a spanning forest of the links, never the pairs.
4. The forests' components are the near-duplicate classes.

Defined results: null and empty texts, and texts without a word, have no n-grams
and link to nothing; texts shorter than ``n`` words have one n-gram, all their
words; rows that repeat an id are separate documents, and so are rows with null
ids: they link like others, and a class whose ids are all null has a null
``class_id`` (``near_class`` still names it); an empty table gives an empty
result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmergrid.llm.common import materialize, row_keys, spread, table
from glimmergrid.llm.components import connected_components
from glimmergrid.llm.hashing import as_bytes, mixed, words

N, THRESHOLD, RECALL = 5, 0.8, 0.9998
BLOCK = 1024
COLUMNS = 4096
#: Bytes of n-gram sets up to which a block is verified in one task (a longer set is a block of its own).
BLOCK_BYTES = 64 << 20
#: Rows of small bands that a task compares at a time, more or less.
GROUP_ROWS = 8192


def choose_bands(threshold: float, recall: float, most_rows: int = 12) -> tuple[int, int]:
    """(bands, rows) that let a pair at the threshold meet with the target probability.

    Of the shapes that do, the one with the fewest chance meetings at a quarter
    of the threshold, and no more than 128 hashes, is taken.
    """
    shapes = []
    for rows in range(1, most_rows + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        chance = 1 - (1 - (threshold / 4) ** rows) ** bands
        if rows * bands <= 128:
            shapes.append((chance, bands, rows))
    return min(shapes)[1:] if shapes else (math.ceil(math.log(1 - recall) / math.log(1 - threshold)), 1)


def least_agreement(threshold: float, hashes: int, miss: float) -> int:
    """The most of ``hashes`` MinHash values that a pair at the threshold fails to agree in with a probability of at most ``miss``."""
    if not 0 < threshold < 1:
        return hashes if threshold >= 1 else 0
    below = 0.0
    for c in range(hashes):
        ways = math.lgamma(hashes + 1) - math.lgamma(c + 1) - math.lgamma(hashes - c + 1)
        below += math.exp(ways + c * math.log(threshold) + (hashes - c) * math.log(1 - threshold))
        if below > miss:
            return c
    return hashes


def ngram_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams."""
    b = as_bytes((text or "").lower())
    if not len(b):
        return np.zeros(0, np.uint64)
    found = words(b)[2]
    size = min(n, len(found))
    if not size:
        return np.zeros(0, np.uint64)
    grams = np.zeros(len(found) - size + 1, np.uint64)
    for k in range(size):
        grams = mixed(grams + found[k : len(found) - size + 1 + k])
    return np.unique(grams)


def set_name(grams: np.ndarray) -> str:
    """128 bits that stand for an n-gram set."""
    return xxhash.xxh3_128_hexdigest(grams.tobytes())


def signatures(docs: DataFrame, n: int, bands: int, rows: int, seed: int = 11) -> DataFrame:
    """``id``, ``k1``, ``k2``, ``node`` (name of the set; null if it is empty), its size ``grams``, band hashes and a byte of every MinHash value."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(1 << 62, size=bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    offsets = rng.integers(1 << 63, size=bands * rows, dtype=np.uint64)
    numbers = np.arange(bands, dtype=np.uint64)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            nodes, sizes, keys, bytes_ = [], [], [], []
            for text in b["text"]:
                grams = ngram_set(text, n)
                nodes.append(set_name(grams) if len(grams) else None)
                sizes.append(len(grams))
                if not len(grams):
                    keys.append(None)
                    bytes_.append(None)
                    continue
                least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
                for k in range(0, len(grams), 4096):
                    least = np.minimum(least, ((grams[k : k + 4096, None] ^ offsets) * factors).min(axis=0))
                band = numbers
                for part in least.reshape(bands, rows).T:
                    band = mixed(band + part)
                keys.append(band.astype(np.int64))
                bytes_.append((mixed(least) & np.uint64(255)).astype(np.uint8).tobytes())
            yield pd.DataFrame({"id": b["id"], "k1": b["k1"], "k2": b["k2"], "node": nodes, "grams": sizes, "bands": keys, "agree": bytes_})

    kind = dict(docs.dtypes)["id"]
    return spread(docs).mapInPandas(sign, f"id {kind}, k1 long, k2 long, node string, grams long, bands array<long>, agree binary")


def like_classes(classes: DataFrame, hashes: int, least: int, threshold: float, block: int) -> DataFrame:
    """``a`` and ``b``: links whose components hold every two classes that share a band and are alike.

    ``classes`` has ``short``, ``grams``, ``bands`` and ``agree``, one row per class.
    """

    def matrix(column: pd.Series) -> np.ndarray:
        return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), hashes)

    def sized(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.minimum(a, b) + 1e-9 >= threshold * np.maximum(a, b)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            same = (matrix(b["agree"]) == matrix(b["head_agree"])).sum(axis=1)
            b["like"] = (same >= least) & sized(b["grams"].to_numpy(), b["head_grams"].to_numpy())
            yield b[["band", "head", "node", "grams", "agree", "like"]]

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, band in pdf.groupby("band", sort=False):
            some, rest = band["rest"].to_numpy(), matrix(band["agree"])
            nodes, sizes = band["node"].to_numpy(), band["grams"].to_numpy()
            same = np.zeros((some.sum(), (~some).sum()), np.int16)
            for x, y in zip(rest[some].T, rest[~some].T):
                same += x[:, None] == y[None, :]
            like = (same >= least) & sized(sizes[some][:, None], sizes[~some][None, :])
            # Every class of the rest is also one of all, so more than one like row or column is a link.
            links = np.zeros((len(band), len(band)), bool)
            links[np.ix_(some, ~some)] = like
            links |= links.T
            out.append(pd.DataFrame({"a": nodes, "b": nodes[forest(links)]}).query("a != b"))
        return pd.concat(out)

    met = classes.select(F.col("short").alias("node"), F.explode("bands").alias("band"))
    # Tables of one row per key are written first: both sides of a join are then plain shuffles, and a hot key's rows can be split.
    heads = materialize(met.groupBy("band").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("size")).filter("size > 1").select("band", "head"), "heads")
    known = classes.select(F.col("short").alias("node"), "grams", "agree")
    pivots = materialize(heads.join(known.toDF("head", "head_grams", "head_agree"), "head"), "pivots")
    told = materialize(met.join(pivots, "band").join(known, "node").mapInPandas(meet, "band long, head long, node long, grams long, agree binary, like boolean"), "told")
    starred = told.filter("like AND node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    # A band's unlike classes, the rest, meet all others of the band; bands of two have said everything.
    unlike = told.groupBy("band").agg(F.count_if(~F.col("like")).alias("n_rest"), F.count(F.lit(1)).alias("n")).filter("n_rest > 0 AND n > 2")
    parts = [F.ceil(F.col(c) / block).cast("int").alias(c) for c in ("n_rest", "n")]
    unlike = materialize(unlike.select("band", F.col("n").alias("held"), *parts), "unlike")
    small = unlike.filter("n = 1").agg(F.sum("held")).first()[0] or 0
    nth = lambda parts: F.pmod(F.xxhash64("node"), F.col(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    open_ = told.join(unlike, "band")
    every = open_.select("band", "node", "grams", "agree", F.lit(False).alias("rest"), each("n_rest").alias("i"), nth("n").alias("j"), "n")
    rest = open_.filter(~F.col("like")).select("band", "node", "grams", "agree", F.lit(True).alias("rest"), nth("n_rest").alias("i"), each("n").alias("j"), "n")
    # Bands of one block share a group with some others, as most are very small.
    group = F.when(F.col("n") > 1, F.col("band")).otherwise(F.pmod("band", F.lit(small // GROUP_ROWS + 1)))
    dealt = every.unionByName(rest).withColumn("group", group)
    return starred.unionByName(dealt.groupBy("group", "n", "i", "j").applyInPandas(compare, "a long, b long"))


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each two sets share, from products of blocks of the incidence matrix."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.concatenate(([True], every[1:] != every[:-1]))
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    column, owner = column[shared], owner[shared]
    if not len(column):
        return np.diag([float(len(s)) for s in sets])
    column = np.cumsum(np.concatenate(([True], column[1:] != column[:-1]))) - 1
    total = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, column[-1] + 1, COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        part = np.zeros((len(sets), min(COLUMNS, column[-1] + 1 - low)), np.float32)
        part[owner[a:b], column[a:b] - low] = 1.0
        total += part @ part.T
    return total


def verified_links(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which two of the sets reach the threshold."""
    sizes = np.array([len(s) for s in sets], float)
    shared = intersections(sets).astype(float)
    links = shared + 1e-9 >= threshold * (sizes[:, None] + sizes[None, :] - shared)
    np.fill_diagonal(links, False)
    return links


def forest(links: np.ndarray) -> np.ndarray:
    """The least row that each row is connected to."""
    root = np.arange(len(links))
    while True:
        new = np.minimum(root, np.where(links, root[None, :], len(links)).min(axis=1))
        new = new[new]
        if (new == root).all():
            return root
        root = new


def verify(candidates: DataFrame, threshold: float) -> DataFrame:
    """``node``, ``n_links`` and ``other`` (a linked node, for the forest) from ``root``, ``node``, ``grams`` and ``blocks``."""

    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(g, "<u8") for g in pdf["grams"]]
        side = pdf["side"].to_numpy()
        links = verified_links(sets, threshold)
        if pdf["first"].iat[0] != pdf["second"].iat[0]:
            links &= side[:, None] != side[None, :]
        root = forest(links)
        counts = links.sum(axis=1)
        nodes = pdf["node"].to_numpy()
        return pd.DataFrame({"node": nodes, "n_links": counts.astype(np.int64), "other": nodes[root]})[counts > 0]

    dealt = candidates.withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("root", "node", "grams", "side", F.least("side", "with").alias("first"), F.greatest("side", "with").alias("second"))
    return dealt.groupBy("root", "first", "second").applyInPandas(check, "node string, n_links long, other string")


def gram_sets(texts: DataFrame, n: int) -> DataFrame:
    """``root``, ``node`` and the bytes of the n-gram set of each row's ``text``."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"root": b["root"], "node": b["node"], "grams": [ngram_set(t, n).astype("<u8").tobytes() for t in b["text"]]})

    return texts.select("root", "node", "text").mapInPandas(sets, "root long, node string, grams binary")


def jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document with its near-duplicate class and its links.

    Returns ``id_col``, ``class_id`` (least id of its class of near duplicates),
    ``copy_of`` (least id with an equal n-gram set), ``n_copies`` (documents with
    that set), ``n_links`` (other n-gram sets at or above the threshold),
    ``near_class`` (a name of the class; null where a text has no n-grams), and
    ``k1`` and ``k2``, which stand for the row's id and text.
    """
    bands, rows = choose_bands(threshold, recall)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *row_keys(id_col, text_col))
    signed = materialize(signatures(texts, n, bands, rows), "signatures")
    same = [F.first(c).alias(c) for c in ("grams", "bands", "agree")]
    classes = signed.filter("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("copy_of"), F.count(F.lit(1)).alias("n_copies"), F.min(F.struct("k1", "k2")).alias("own"), *same)
    # Candidates go by 64-bit names: if two texts shared one, their candidates would be verified together.
    classes = materialize(classes.withColumn("short", F.xxhash64("node")), "classes")
    least = least_agreement(threshold, bands * rows, (1 - recall) / 10)
    found = materialize(connected_components(like_classes(classes, bands * rows, least, threshold, block)), "candidates")
    wanted = materialize(found.withColumnRenamed("node", "short").join(classes.select("node", "own.*", "short"), "short").select("root", "node", "k1", "k2"), "wanted")
    # A set is verified once, by one of the rows that hold it; rows that repeat id and text are combined before they move on.
    one_each = texts.select("k1", "k2", "text").join(wanted, ["k1", "k2"]).groupBy("root", "node").agg(F.min("text").alias("text"))
    sets = materialize(gram_sets(one_each, n), "sets")
    sizes = sets.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum(F.length("grams")) / block_bytes)).cast("int").alias("blocks"))
    links = materialize(verify(sets.join(materialize(sizes, "sizes"), "root"), threshold), "links")
    counts = links.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    near = connected_components(links.select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = classes.select("node", "copy_of", "n_copies").join(near, "node", "left").join(counts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = named.groupBy("root").agg(F.min("copy_of").alias("class_id"))
    told = materialize(named.join(first, "root").select("node", "root", "class_id", "copy_of", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links")), "classes")
    return signed.select("id", "k1", "k2", "node").join(told, "node", "left").select(
        F.col("id").alias(id_col), F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("copy_of")).alias("copy_of"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("root").alias("near_class"), "k1", "k2",
    )


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes and links of all documents, at five words and 0.8."""
    return jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copy_of", "n_copies", "n_links")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS grams FROM w),
c AS (SELECT grams, min(doc_id) AS copy_of, count(*) AS n_copies, len(grams) AS size FROM g WHERE len(grams) > 0 GROUP BY grams),
s AS (SELECT copy_of, size, unnest(grams) AS gram FROM c),
p AS (SELECT a.copy_of AS a, b.copy_of AS b FROM s a JOIN s b ON a.gram = b.gram AND a.copy_of <> b.copy_of
      GROUP BY a.copy_of, b.copy_of, a.size, b.size HAVING count(*) + 1e-9 >= 0.8::DOUBLE * (a.size + b.size - count(*))),
r AS (SELECT copy_of AS node, copy_of AS other FROM c UNION SELECT r.node, p.b FROM r JOIN p ON r.other = p.a),
k AS (SELECT node, min(other) AS class_id FROM r GROUP BY node)
SELECT g.doc_id, coalesce(k.class_id, g.doc_id) AS class_id, coalesce(c.copy_of, g.doc_id) AS copy_of, coalesce(c.n_copies, 1) AS n_copies,
  (SELECT count(*) FROM p WHERE p.a = c.copy_of) AS n_links
FROM g LEFT JOIN c ON g.grams = c.grams LEFT JOIN k ON c.copy_of = k.node
"""
