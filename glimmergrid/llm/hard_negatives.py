"""Hard negatives by an inverted multi-index with certified windows.

Vectors are cut into two halves, each with a codebook of its own; a pair of
codewords is a cell. Rows come to whole numbers, so scores are exact. For an
anchor, a half's inner product with all members of a codeword is at most that
with the codeword plus the half's length times the codeword's radius (the largest
distance of a member), so the sum of two half bounds bounds every score of a
cell. A heap walks the two sorted lists of half bounds (multi-sequence) and gives
the cells by falling bound.

A search has windows of scores and wants each window's best ``k`` rows. A window
is certified once the next cell's bound lies under its lower end, or under the
``k``-th best row found inside; an anchor stops when all its windows are. Rounds
take 4, 16, 64, ... of an anchor's cells. The search runs twice: for the best
rows of the anchor's own label (one open window), then for rows of other labels,
in one window for each positive: from ``share`` of its score up to its score.

Codebooks are fitted on a bounded sample (``sample_rows``); every row is indexed
and radii are taken over all rows. Cells are dealt in parts of bounded size, and
so are the anchors that visit a cell: neither one very common vector nor a label
that a third of all rows have lands in one task. Each task returns ``k`` rows a
window at most. Only codebooks, radii and the occupied cells (4,096 at most)
reach the driver.

Where directions are independent, as in random vectors, bounds leave out few
cells and the work grows with anchors times rows.

Defined results: rows with a null id, label or vector, with a null or non-finite
component, or of another length than most take no part; a zero vector does. Rows
that repeat an id are separate candidates, but never partners of their own id; of
rows that repeat an anchor's id the one with the least label and vector asks, and
a pair is told once for each row it is found in. Ties go to the smaller id. An
anchor without positives, and a positive without negatives, give no row; an empty
table gives none. Scores beyond a 64-bit number are cut to it.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glimmergrid.llm.common import materialize, spread, table
from glimmergrid.llm.neighbours import met_in_blocks, sample_rows_of

SCALE = 256.0
#: Anchors of a block that are scored at a time.
SCORED = 256
LEAST, MOST = -(1 << 63) + 1, (1 << 63) - 1


@dataclass
class MultiIndex:
    """Two codebooks, the radius of each codeword, and the cells that hold rows."""

    words: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    occupied: frozenset[int]

    def nearest_words(self, vectors: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Each half's nearest codeword and the distance to it."""
        codes, away = [], []
        for half, words in zip(halves(vectors), self.words):
            apart = ((half[:, None, :] - words[None, :, :]) ** 2).sum(axis=2)
            codes.append(apart.argmin(axis=1))
            away.append(np.sqrt(apart.min(axis=1)))
        return codes, away

    def bounds(self, vectors: np.ndarray) -> list[np.ndarray]:
        """For each half, upper bounds of its inner products with the members of each codeword."""
        out = []
        for half, words, radii in zip(halves(vectors), self.words, self.radii):
            reach = np.sqrt((half * half).sum(axis=1))[:, None] * radii
            bound = half @ words.T + reach
            # A little more than rounding can take away.
            out.append(bound + 1e-9 * (np.abs(half @ words.T) + reach) + 1e-6)
        return out

    def cells(self, one: np.ndarray, two: np.ndarray, first: int, last: int, floor: float) -> Iterator[int]:
        """Occupied cells of ranks ``first`` to ``last`` by falling sum of bounds, as far as it reaches ``floor``."""
        a, b = np.argsort(-one, kind="stable"), np.argsort(-two, kind="stable")
        heap, seen, rank = [(-(one[a[0]] + two[b[0]]), 0, 0)], {(0, 0)}, 0
        while heap and rank < last:
            bound, i, j = heapq.heappop(heap)
            if -bound < floor:
                return
            cell = int(a[i]) * len(two) + int(b[j])
            if cell in self.occupied:
                if rank >= first:
                    yield cell
                rank += 1
            for i, j in ((i + 1, j), (i, j + 1)):
                if i < len(a) and j < len(b) and (i, j) not in seen:
                    seen.add((i, j))
                    heapq.heappush(heap, (-(one[a[i]] + two[b[j]]), i, j))


def halves(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    middle = vectors.shape[1] // 2
    return vectors[:, :middle], vectors[:, middle:]


def codebook(points: np.ndarray, count: int, seed: int, rounds: int = 8) -> np.ndarray:
    """At most ``count`` codewords: means of the points nearest to them."""
    if not points.shape[1]:
        return np.zeros((1, 0))
    different = np.unique(points, axis=0)
    words = different[np.random.default_rng(seed).permutation(len(different))[:count]]
    for _ in range(rounds):
        nearest = ((points[:, None, :] - words[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
        words = np.stack([points[nearest == k].mean(axis=0) if (nearest == k).any() else words[k] for k in range(len(words))])
    return words


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64)


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows; doubles hold them where they stay under 2 ** 53."""
    most = [int(np.abs(x.astype(float)).max(initial=0)) for x in (a, b)]
    if most[0] * most[1] * max(1, a.shape[1]) < 1 << 53:
        return np.rint(a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return np.clip(a.astype(object) @ b.T.astype(object), LEAST, MOST).astype(np.int64)


def best_in_windows(block: pd.DataFrame, asked: pd.DataFrame, k: int, same: bool) -> pd.DataFrame:
    """Each window's best ``k`` rows of one block: rows of the anchor's label (``same``) or of others, never of its id."""
    block = block.sort_values("id", kind="stable")
    ids, labels, vectors = block["id"].to_numpy(), block["label"].to_numpy(), matrix(block["vector"])
    told: list[tuple[int, int, int]] = []
    found = [np.zeros(0, np.int64)]
    points = [np.zeros(0, np.int64)]
    for at in range(0, len(asked), SCORED):
        some = asked.iloc[at : at + SCORED]
        scores = inner_products(matrix(some["vector"]), vectors)
        names, own = some["query_id"].to_numpy(), some["label"].to_numpy()
        fits = ((own[:, None] == labels[None, :]) == same) & (names[:, None] != ids[None, :])
        fits &= scores >= np.array([min(lows) for lows in some["lows"]])[:, None]
        for n, (windows, lows, highs) in enumerate(zip(some["windows"], some["lows"], some["highs"])):
            rows = np.flatnonzero(fits[n])
            # Rows are sorted by id, so a stable order settles ties.
            rows = rows[np.argsort(-scores[n, rows], kind="stable")]
            falling = -scores[n, rows]
            firsts, lasts = np.searchsorted(falling, -np.asarray(highs), "left"), np.searchsorted(falling, -np.asarray(lows), "right")
            for window, first, last in zip(windows, firsts, np.minimum(lasts, firsts + k)):
                if first < last:
                    told.append((names[n], window, last - first))
                    found.append(rows[first:last])
                    points.append(falling[first:last])
    queries, windows, counts = np.array(told, np.int64).reshape(-1, 3).T
    chosen = np.concatenate(found)
    return pd.DataFrame({"query_id": np.repeat(queries, counts), "window": np.repeat(windows, counts), "id": ids[chosen], "score": -np.concatenate(points)})


@dataclass
class Indexed:
    """Rows in the parts of their cells."""

    index: MultiIndex
    blocks: DataFrame
    parts: DataFrame


def build_index(rows: DataFrame, count: int, sample_rows: int, cell_rows: int, max_words: int, seed: int) -> Indexed:
    """Codebooks from a sample of ``rows`` (``id``, ``label``, ``vector``), every row in its cell, radii over all rows."""
    sample = sample_rows_of(rows, sample_rows / count, 2 * sample_rows, seed)
    if not len(sample):
        sample = np.zeros((1, len(rows.first()["vector"])))
    words = max(1, min(max_words, math.ceil(math.sqrt(count / cell_rows))))
    books = tuple(codebook(half.astype(float), words, seed) for half in halves(sample))
    index = MultiIndex(books, (np.zeros(len(books[0])), np.zeros(len(books[1]))), frozenset())

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 1024):
                b = whole.iloc[at : at + 1024]
                (one, two), (away_one, away_two) = index.nearest_words(np.stack(b["vector"].to_numpy()).astype(float))
                yield b.assign(one=one.astype(np.int32), two=two.astype(np.int32), away_one=away_one, away_two=away_two)

    placed = spread(rows).mapInPandas(place, "id long, label long, vector array<long>, one int, two int, away_one double, away_two double")
    placed = materialize(placed.withColumn("cell", F.col("one") * len(books[1]) + F.col("two")), "cells")
    # A row per codeword, then a row per cell.
    for side, radii in zip(("one", "two"), index.radii):
        for r in placed.groupBy(side).agg(F.max(f"away_{side}").alias("away")).collect():
            radii[r[side]] = r["away"]
    parts = materialize(placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / cell_rows).cast("int").alias("parts")), "parts")
    index.occupied = frozenset(r["cell"] for r in parts.select("cell").collect())
    blocks = placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id", "vector"), F.col("parts")).cast("int"))
    return Indexed(index, blocks.select("cell", "part", "id", "label", "vector"), parts)


def search_windows(indexed: Indexed, asked: DataFrame, k: int, same: bool, query_rows: int) -> DataFrame:
    """``query_id``, ``window``, ``rank``, ``id`` and ``score``: the best ``k`` rows of every window.

    ``asked`` has ``query_id``, ``label``, ``vector`` and the arrays ``windows``, ``lows`` and ``highs``.
    """
    index = indexed.index

    def onward(first: int, last: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    one, two = index.bounds(np.stack(b["vector"].to_numpy()).astype(float))
                    told = [(q, c) for n, (q, floor) in enumerate(zip(b["query_id"], b["floor"])) for c in index.cells(one[n], two[n], first, last, floor)]
                    yield pd.DataFrame(told, columns=["query_id", "cell"]).astype({"query_id": "int64", "cell": "int32"})

        return run

    def search(block: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        return best_in_windows(block, queries if len(block) else queries.iloc[:0], k, same)

    order = Window.partitionBy("query_id", "window").orderBy(F.desc("score"), "id")
    best, first, last = None, 0, 4
    while True:
        open_ends = asked.select("query_id", F.explode(F.arrays_zip("windows", "lows")).alias("w")).select("query_id", F.col("w.windows").alias("window"), F.col("w.lows").alias("low"))
        if best is not None:
            kth = best.filter(F.col("rank") == k).select("query_id", "window", F.col("score").alias("kth"))
            open_ends = open_ends.join(kth, ["query_id", "window"], "left").withColumn("low", F.greatest("low", F.coalesce("kth", "low")))
        floors = open_ends.groupBy("query_id").agg(F.min("low").cast("double").alias("floor"))
        going = asked.select("query_id", "vector").join(floors, "query_id")
        # Written without the vectors, as there may be many cells an anchor.
        visits = materialize(spread(going).mapInPandas(onward(first, last), "query_id long, cell int"), "visits")
        if visits.isEmpty():
            break
        met, sent = met_in_blocks(indexed.blocks, indexed.parts, visits.join(asked, "query_id"), query_rows)
        found = met.groupBy("cell", "part", "share").cogroup(sent.groupBy("cell", "part", "share")).applyInPandas(search, "query_id long, window int, id long, score long")
        found = found if best is None else found.unionByName(best.drop("rank"))
        best = materialize(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "best")
        if last >= len(index.occupied):
            break
        first, last = last, 4 * last
    if best is None:
        return asked.sparkSession.createDataFrame([], "query_id long, window int, rank int, id long, score long")
    return best.select("query_id", "window", F.col("rank").cast("int").alias("rank"), "id", "score")


def whole_numbers(vectors: DataFrame, id_col: str, label_col: str, vector_col: str, scale: float) -> DataFrame:
    """``id``, ``label`` and ``vector`` (scaled and rounded down) of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & fine)
    return rows.withColumn("vector", F.transform("vector", lambda x: F.floor(F.lit(scale) * x).cast("long")))


def mine(
    vectors: DataFrame, is_anchor: Callable[[Column], Column], *, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", positives: int = 5, negatives: int = 5, share: tuple[int, int] = (4, 5),
    scale: float = SCALE, sample_rows: int = 10_000, cell_rows: int = 1_024, max_words: int = 64, query_rows: int = 4_096, seed: int = 3,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score`` and ``negative_score``.

    For each anchor and each of its best ``positives`` rows of its label, the best
    ``negatives`` rows of other labels whose score is from ``share`` (a fraction)
    of the positive's up to the positive's.
    """
    spark = vectors.sparkSession
    rows = whole_numbers(vectors, id_col, label_col, vector_col, scale)
    most = rows.groupBy(F.size("vector").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "n").first()
    if most is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    rows = rows.filter(F.size("vector") == most["n"])
    indexed = build_index(rows, most["rows"], sample_rows, cell_rows, max_words, seed)
    anchors = rows.filter(is_anchor(F.col("id"))).groupBy(F.col("id").alias("query_id")).agg(F.min(F.struct("label", "vector")).alias("row")).select("query_id", "row.*")
    anchors = materialize(anchors, "anchors")

    def one(value: int, kind: str) -> Column:
        return F.array(F.lit(value).cast(kind))

    asked = anchors.select("*", one(0, "int").alias("windows"), one(LEAST, "long").alias("lows"), one(MOST, "long").alias("highs"))
    near = search_windows(indexed, asked, positives, True, query_rows)
    # An anchor has as many windows as positives, at most.
    low = F.ceil(F.col("score").cast("decimal(20,0)") * share[0] / share[1]).cast("long")
    windows = near.withColumn("low", low).filter(F.col("low") <= F.col("score"))
    windows = windows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(F.col("rank").alias("window"), "low", F.col("score").alias("high")))).alias("w"))
    windows = windows.select("query_id", F.col("w.window").alias("windows"), F.col("w.low").alias("lows"), F.col("w.high").alias("highs"))
    hard = search_windows(indexed, materialize(anchors.join(windows, "query_id"), "asked"), negatives, False, query_rows)
    told = near.select("query_id", F.col("rank").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return hard.join(told, ["query_id", "window"]).select(
        F.col("query_id").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; labels of every seventh are moved on by one."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), lambda i: i % 100 == 0)


ORACLE = """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
    list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS s FROM r a, r b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
  p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
  SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b)::INT AS rank, n.b AS negative_id, p.s AS positive_score, n.s AS negative_score
  FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 80 * p.s <= 100 * n.s AND n.s <= p.s
  QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) <= 5"""
