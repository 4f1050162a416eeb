"""Approximate nearest neighbours by stable projections and a kd-tree.

Nearness is the inner product. With one more component, the root of what a
vector's squared length lacks to the largest one, the largest inner product is
the least Euclidean distance. A few Gaussian projections (2-stable: a projected
squared distance is the true one times a chi-square variable) place every vector
in a low-dimensional space, cut into kd-tree cells.

A query goes through cells, and inside them through leaves, by increasing projected
distance. A leaf's vectors are verified on the original components if they project
near enough; the score of the k-th best so far bounds how near that is. The bound
is tightened after each round of cells, and a query stops at the first cell that
fails the chi-square test: a vector that beats the k-th one by the factor ``ratio``
in distance would project into it with less than ``1 - probability``. Rounds take
1, 3, 12, 48, ... of a query's next cells.

The tree's cuts are fitted on a bounded sample (``sample_rows``); every row is
indexed. Cells are dealt in blocks of bounded size, so neither a dense cell nor
one very common vector lands in one task; so are the queries that visit a cell,
and a task scores a few hundred of them at a time. A task returns at most ``k``
rows a query, of those that come up to the k-th best of earlier rounds.

Defined results: vectors that are null, zero, of another length than most, or
hold a null or non-finite component take no part; ties go to the smaller id;
rows that repeat an id are separate candidates, except that a query never finds
its own id; of rows that repeat a query's id the one with the least vector asks;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glimmergrid.llm.common import materialize, spread, table

DIGITS = 11
#: Queries of a block that are scored at a time.
SCORED = 256


def chi_square_quantile(p: float, degrees: int) -> float:
    """Wilson and Hilferty's approximation."""
    a = 2 / (9 * degrees)
    return degrees * (1 - a + NormalDist().inv_cdf(p) * math.sqrt(a)) ** 3


@dataclass
class Cells:
    """A kd-tree over projected space: a node's cut, or its cell."""

    projection: np.ndarray
    longest: float
    #: dimension (-1: a cell), value, and the node below; the node above follows.
    dims: np.ndarray
    cuts: np.ndarray
    below: np.ndarray
    #: Per cell, its box; open sides are infinite.
    low: np.ndarray
    high: np.ndarray

    def project(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        """Projections of rows. A query's length is the longest one, and its own component is 0."""
        if query:
            scaled = vectors * (math.sqrt(self.longest) / np.sqrt((vectors * vectors).sum(axis=1)))[:, None]
            return scaled @ self.projection[:-1]
        rest = np.sqrt(np.maximum(0.0, self.longest - (vectors * vectors).sum(axis=1)))
        return vectors @ self.projection[:-1] + rest[:, None] * self.projection[-1]

    def cell(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        rows = np.arange(len(points))
        while len(rows := rows[self.dims[node[rows]] >= 0]):
            at = node[rows]
            node[rows] = self.below[at] + (points[rows, self.dims[at]] >= self.cuts[at])
        return self.below[node]

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Squared distances of points to all cells."""
        return box_distances(points, self.low, self.high)


def box_distances(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        x = points[:, d : d + 1]
        out += np.maximum(0.0, np.maximum(low[:, d] - x, x - high[:, d])) ** 2
    return out


def fit_cells(sample: np.ndarray, longest: float, count: int, dimensions: int, seed: int) -> Cells:
    """Cuts ``count`` cells (rounded up to a power of two) at the medians of a sample."""
    rng = np.random.default_rng(seed)
    cells = Cells(rng.standard_normal((sample.shape[1] + 1, dimensions)), longest, *[np.zeros(0)] * 5)
    points = cells.project(sample)
    dims, cuts, below, lows, highs = [0], [0.0], [0], [], []

    def grow(node: int, rows: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> None:
        spread = np.ptp(points[rows], axis=0) if len(rows) > 1 else np.zeros(1)
        d = int(spread.argmax())
        cut = float(np.median(points[rows, d])) if len(rows) else 0.0
        if not depth or spread[d] == 0 or not (points[rows, d] < cut).any():
            dims[node], below[node] = -1, len(lows)
            lows.append(low)
            highs.append(high)
            return
        dims[node], cuts[node], below[node] = d, cut, len(dims)
        for table in (dims, cuts, below):
            table.extend([0, 0])
        at = below[node]
        inner_high, inner_low = high.copy(), low.copy()
        inner_high[d] = inner_low[d] = cut
        grow(at, rows[points[rows, d] < cut], low, inner_high, depth - 1)
        grow(at + 1, rows[points[rows, d] >= cut], inner_low, high, depth - 1)

    edge = np.full(dimensions, np.inf)
    grow(0, np.arange(len(points)), -edge, edge, max(0, math.ceil(math.log2(max(1, count)))))
    cells.dims, cells.cuts, cells.below = np.array(dims), np.array(cuts), np.array(below)
    cells.low, cells.high = np.array(lows), np.array(highs)
    return cells


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, added up in the order of the components."""
    out = np.zeros(len(queries))
    for d in range(queries.shape[1]):
        out += queries[:, d] * vectors[:, d]
    return out


def leaves(points: np.ndarray, rows: np.ndarray, size: int) -> list[np.ndarray]:
    """Rows of a block in the leaves of its own kd-tree."""
    spread = np.ptp(points[rows], axis=0)
    d = int(spread.argmax())
    if len(rows) <= size or spread[d] == 0:
        return [rows]
    order = rows[np.argsort(points[rows, d], kind="stable")]
    half = len(order) // 2
    return leaves(points, order[:half], size) + leaves(points, order[half:], size)


def best_of_block(block: pd.DataFrame, queries: pd.DataFrame, cells: Cells, k: int, reach: float, leaf: int) -> pd.DataFrame:
    """Each query's ``k`` best candidates of one block, verified leaf by leaf in the order of projected distance.

    ``reach`` is the squared projected distance up to which a vector is verified,
    as a factor of the squared distance of the k-th neighbour so far.
    """
    block = block.sort_values("id", kind="stable")
    ids, vectors = block["id"].to_numpy(), np.stack(block["vector"].to_numpy()).astype(float)
    points = cells.project(vectors)
    groups = leaves(points, np.arange(len(ids)), leaf)
    low, high = np.array([points[g].min(axis=0) for g in groups]), np.array([points[g].max(axis=0) for g in groups])
    found, verified = [], 0
    for first in range(0, len(queries), SCORED):
        some = queries.iloc[first : first + SCORED]
        query_ids, wanted = some["query_id"].to_numpy(), np.stack(some["vector"].to_numpy()).astype(float)
        length = np.sqrt((wanted * wanted).sum(axis=1))
        # Squared distance of the k-th neighbour so far, in the space where all queries have the greatest length.
        worst = some["worst"].to_numpy(float, copy=True)
        scores = np.full((len(wanted), len(ids)), -np.inf)
        at = cells.project(wanted, query=True)
        away = box_distances(at, low, high)
        order = np.argsort(away, axis=1, kind="stable")
        for step in range(len(groups)):
            nearest_leaf = order[:, step]
            going = np.flatnonzero(away[np.arange(len(wanted)), nearest_leaf] <= reach * worst)
            if not len(going):
                break
            for g in np.unique(nearest_leaf[going]):
                q, rows = going[nearest_leaf[going] == g], groups[g]
                apart = (at[q] ** 2).sum(axis=1)[:, None] + (points[rows] ** 2).sum(axis=1) - 2 * (at[q] @ points[rows].T)
                a, b = np.nonzero(apart <= (reach * worst[q])[:, None])
                verified += len(a)
                if 4 * len(a) > apart.size:
                    scores[np.ix_(q, rows)] = wanted[q] @ vectors[rows].T
                else:
                    scores[q[a], rows[b]] = (wanted[q[a]] * vectors[rows[b]]).sum(axis=1)
            # The bound is taken anew after 1, 2, 4, ... leaves.
            if len(ids) > k and not step + 1 & step:
                kth = np.partition(scores[going], len(ids) - k, axis=1)[:, len(ids) - k]
                bound = np.maximum(0.0, 2 * cells.longest - 2 * kth * math.sqrt(cells.longest) / length[going])
                worst[going] = np.minimum(worst[going], np.where(np.isfinite(kth), bound, np.inf))
        scores[query_ids[:, None] == ids[None, :]] = -np.inf
        # Rows are sorted by id, so a stable order settles ties; products differ in their last digits by where a row stands.
        best = np.argsort(-np.round(scores, DIGITS), axis=1, kind="stable")[:, :k]
        q, c = np.repeat(np.arange(len(wanted)), best.shape[1]), best.ravel()
        # What doesn't come up to the k-th best of earlier rounds isn't returned.
        fine = np.isfinite(scores[q, c])
        q, c = q[fine], c[fine]
        apart = 2 * cells.longest - 2 * scores[q, c] * math.sqrt(cells.longest) / length[q]
        near = apart <= some["worst"].to_numpy(float)[q] + 1e-9 * cells.longest
        q, c = q[near], c[near]
        found.append(pd.DataFrame({"query_id": query_ids[q], "vec_id": ids[c], "score": products(wanted[q], vectors[c])}))
    out = pd.concat(found)
    out.attrs["verified"] = verified
    return out


def met_in_blocks(blocks: DataFrame, parts: DataFrame, queries: DataFrame, query_rows: int) -> tuple[DataFrame, DataFrame]:
    """``blocks`` and ``queries`` by ``cell``, ``part`` and ``share``, so that each query of a cell meets each row of it once.

    ``queries`` of a cell are dealt to shares of about ``query_rows``. ``queries`` are read twice.
    """
    # One row per cell.
    shares = materialize(queries.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / query_rows).cast("int").alias("shares")), "shares")
    dealt = queries.join(F.broadcast(parts), "cell").join(F.broadcast(shares), "cell").withColumn("share", F.pmod(F.xxhash64("query_id"), F.col("shares")).cast("int"))
    sent = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts", "shares")
    repeated = blocks.join(F.broadcast(shares), "cell").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    return repeated, sent


def with_vectors(visits: DataFrame, asked: DataFrame) -> DataFrame:
    """Visits with their query's vector, by a sort-merge join.

    Visits are many rows in few bytes (1.2 a row on disk, as ids and bounds repeat), so by their
    files' size Spark would broadcast millions of them through the driver.
    """
    return visits.join(asked.hint("merge"), "query_id")


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``vector`` (doubles) of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    return rows.filter(F.col("id").isNotNull() & F.col("vector").isNotNull() & fine)


def sample_rows_of(rows: DataFrame, share: float, most: int, seed: int) -> np.ndarray:
    """A matrix of about ``share`` of the vectors, at most ``most``."""
    picked = rows.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) < 1_000_000 * share).select("vector").limit(most).toPandas()
    return np.stack(picked["vector"].to_numpy()) if len(picked) else np.zeros((0, 0))


def boxes(placed: DataFrame, cells: Cells) -> Cells:
    """``cells`` with the boxes of the rows that lie in them; a cell without rows is infinitely far. A row per cell and dimension comes back."""

    def extent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            points = pd.DataFrame(cells.project(np.stack(b["vector"].to_numpy()))) if len(b) else None
            if points is not None:
                told = points.groupby(b["cell"].to_numpy()).agg(["min", "max"]).stack(level=0, future_stack=True).reset_index()
                told.columns = ["cell", "dim", "low", "high"]
                yield told.astype({"cell": "int32", "dim": "int32"})

    told = placed.select("cell", "vector").mapInPandas(extent, "cell int, dim int, low double, high double").groupBy("cell", "dim").agg(F.min("low").alias("low"), F.max("high").alias("high")).toPandas()
    cells.low, cells.high = np.full(cells.low.shape, np.inf), np.full(cells.high.shape, np.inf)
    cells.low[told["cell"], told["dim"]] = told["low"]
    cells.high[told["cell"], told["dim"]] = told["high"]
    return cells


def nearest(
    vectors: DataFrame, is_query, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20,
    dimensions: int = 24, probability: float = 0.85, ratio: float = 1.0, sample_rows: int = 20_000, cell_rows: int = 2_048, query_rows: int = 4_096, max_cells: int = 4_096, leaf: int = 256, seed: int = 3,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of each query's ``k`` nearest rows.

    ``is_query`` says of an id column which rows are queries. ``probability`` is
    the chance that a true neighbour passes the chi-square test, ``ratio`` (1 or
    more) by how much a missed one may be nearer than the last one found.
    """
    rows = usable(vectors, id_col, vector_col)
    lengths = rows.groupBy(F.size("vector").alias("n")).agg(F.count(F.lit(1)).alias("rows"), F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)).alias("longest"))
    most = lengths.orderBy(F.desc("rows"), "n").first()
    out = "query_id long, rank int, vec_id long, score double"
    if most is None:
        return rows.sparkSession.createDataFrame([], out)
    rows = rows.filter(F.size("vector") == most["n"])
    sample = sample_rows_of(rows, sample_rows / most["rows"], 2 * sample_rows, seed)
    sample = sample if len(sample) else np.zeros((1, most["n"]))
    cells = fit_cells(sample, float(most["longest"]), min(max_cells, math.ceil(most["rows"] / cell_rows)), dimensions, seed)
    reach = chi_square_quantile(probability, dimensions) / ratio**2

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(cell=cells.cell(cells.project(np.stack(b["vector"].to_numpy()))).astype(np.int32))

    placed = materialize(spread(rows).mapInPandas(place, "id long, vector array<double>, cell int"), "cells")
    cells = boxes(placed, cells)

    def onward(first: int, last: int):
        """The cells that come next: those of ranks ``first`` to ``last`` by distance that pass the test."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in batches:
                for low in range(0, len(whole), SCORED):
                    b = whole.iloc[low : low + SCORED]
                    wanted = np.stack(b["vector"].to_numpy())
                    length = np.sqrt((wanted * wanted).sum(axis=1))
                    worst = np.maximum(0.0, 2 * cells.longest - 2 * b["kth"].to_numpy(float) * math.sqrt(cells.longest) / length)
                    worst = np.where(np.isnan(worst), np.inf, worst)
                    away = cells.distances(cells.project(wanted, query=True))
                    next_cells = np.argsort(away, axis=1, kind="stable")[:, first:last]
                    apart = np.take_along_axis(away, next_cells, axis=1)
                    q, c = np.nonzero((apart <= reach * worst[:, None]) & np.isfinite(apart))
                    yield pd.DataFrame({"query_id": b["query_id"].to_numpy()[q], "cell": next_cells[q, c].astype(np.int32), "worst": worst[q]})

        return run

    def search(block: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(block) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return best_of_block(block, queries, cells, k, reach, leaf)

    # One row per cell.
    parts = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / cell_rows).cast("int").alias("parts"))
    blocks = placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).select("cell", "part", "id", "vector")
    asked = rows.filter(is_query(F.col("id"))).groupBy(F.col("id").alias("query_id")).agg(F.min("vector").alias("vector"))
    asked = materialize(asked, "queries")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best, first, last = None, 0, 1
    while first < len(cells.low):
        going = asked.withColumn("kth", F.lit(None).cast("double"))
        if best is not None:
            going = asked.join(best.filter(F.col("rank") == k).select("query_id", F.col("score").alias("kth")), "query_id", "left")
        # Written without the vectors, as there may be many cells a query.
        visits = materialize(spread(going).mapInPandas(onward(first, last), "query_id long, cell int, worst double"), "visits")
        if visits.isEmpty():
            break
        met, sent = met_in_blocks(blocks, parts, with_vectors(visits, asked), query_rows)
        found = met.groupBy("cell", "part", "share").cogroup(sent.groupBy("cell", "part", "share")).applyInPandas(search, "query_id long, vec_id long, score double")
        found = found if best is None else found.unionByName(best.drop("rank"))
        best = materialize(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "best")
        first, last = last, 4 * last
    if best is None:
        return rows.sparkSession.createDataFrame([], out)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one."""
    return nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)
