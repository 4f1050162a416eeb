"""Hierarchical packing into several lengths of sequences.

Documents are tokenised and ended with an end token. What is longer than the
capacity gives full sequences; the rest of each document is routed to the tier
of the smallest power of two that holds it. Tiers are packed from the longest to
the shortest: a piece opens a sequence of its tier, and the gap behind it is
filled from shorter pieces, by one that fits exactly, by two that do, or by the
longest that fits. Where none fits, the shortest longer piece is cut to the gap
and its rest goes back to its own tier. So each sequence is filled to a power of
two, and none is padded. Sequences of a tier are dealt to step groups of about
``step_tokens`` tokens each: by falling attention cost (the sum of the squared
lengths of the pieces), back and forth, so that the groups of a tier differ by at
most one sequence and cost about the same. The groups of all tiers are numbered
in turn, each tier spread evenly over the whole run.

A piece matters only by its length, so the plan is made from a histogram of at
most ``capacity`` lengths, whatever the number of documents, as runs of equal
sequences. Pieces are dealt to buckets in turn (not by a key, so equal rows don't
meet), get their number among those of their length from counts per bucket, and
look up their places in the plan. Full sequences carry only their checksum; the
ids of the rests move once, as they may be cut.

Defined results: a null or empty text is the end token alone; rows that repeat an
id, or are equal, are separate documents; a null id stays null; an empty table
gives an empty result. Whole texts are tokenised.
"""

from __future__ import annotations

import zlib
from bisect import insort
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glimmergrid.llm.common import materialize, shuffle_partitions, spread, table
from glimmergrid.llm.packing import default_vocabulary, encoder

CAPACITY = 1024
END = 0
STEP_TOKENS = 64 * 1024
#: A lot splits a run if it has at least this part of its sequences.
SLACK = 2
PIECES = "id long, start long, length int, doc_tokens long, bucket int, crc long, ids binary"
TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())


@dataclass(frozen=True)
class Lot:
    """``count`` equal pieces: tokens ``start`` to ``start + length`` of the pieces ``first``, ``first + 1``, ... of length ``origin``."""

    origin: int
    first: int
    count: int
    start: int
    length: int


@dataclass
class Run:
    """``count`` equal sequences, one piece of each lot in every one."""

    count: int
    lots: list[Lot] = field(default_factory=list)
    first: int = 0
    tier: int = 0

    @property
    def used(self) -> int:
        return sum(lot.length for lot in self.lots)

    @property
    def cost(self) -> int:
        return sum(lot.length**2 for lot in self.lots)

    def split(self, count: int) -> tuple[Run, Run]:
        here = [replace(lot, count=count) for lot in self.lots]
        rest = [replace(lot, first=lot.first + count, count=lot.count - count) for lot in self.lots]
        return Run(count, here), Run(self.count - count, rest)


class TierPlan:
    """Runs of sequences for ``histogram[length]`` pieces of each length."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY):
        self.lots: dict[int, list[Lot]] = {}
        self.runs: list[Run] = []
        self.sequences = 0
        for length, count in histogram.items():
            self.give(Lot(length, 0, count, 0, length))
        tier = capacity
        while tier:
            while routed := [n for n in self.lots if tier // 2 < n <= tier]:
                lot = self.take(max(routed, key=lambda n: (self.most(n), n)))
                self.fill(tier, Run(lot.count, [lot]))
            tier //= 2

    def give(self, lot: Lot) -> None:
        insort(self.lots.setdefault(lot.length, []), lot, key=lambda x: x.count)

    def most(self, length: int) -> int:
        """Pieces of the largest lot of this length."""
        return self.lots[length][-1].count

    def take(self, length: int, most: int | None = None) -> Lot:
        """The largest lot of this length, at most ``most`` pieces of it."""
        lots = self.lots[length]
        lot = lots.pop()
        if not lots:
            del self.lots[length]
        if most is not None and lot.count > most:
            self.give(replace(lot, first=lot.first + most, count=lot.count - most))
            lot = replace(lot, count=most)
        return lot

    def filler(self, gap: int, count: int) -> int | None:
        """The length that goes into ``count`` gaps: whole if one fits, else the shortest longer one.

        Small lots don't split large runs while there are larger lots, so the
        number of runs stays small whatever the number of pieces.
        """
        enough = min(count, max(map(self.most, self.lots), default=0)) / SLACK
        fit = {n for n in self.lots if self.most(n) >= enough}
        whole = sorted((n for n in fit if n <= gap), reverse=True)
        for n in whole:
            if n == gap or gap - n in fit and (gap != 2 * n or self.most(n) >= 2 * enough):
                return n
        return whole[0] if whole else min(fit, default=None)

    def fill(self, tier: int, run: Run) -> None:
        """Fills all sequences of a run; what nothing is left for is given back, half by half."""
        waiting = [run]
        while waiting:
            run = waiting.pop()
            gap = tier - run.used
            if not gap:
                self.close(tier, run)
            elif (length := self.filler(gap, run.count)) is not None:
                lot = self.take(length, run.count)
                if lot.count < run.count:
                    run, rest = run.split(lot.count)
                    waiting.append(rest)
                if length > gap:
                    self.give(replace(lot, start=lot.start + gap, length=length - gap))
                    lot = replace(lot, length=gap)
                run.lots.append(lot)
                waiting.append(run)
            elif run.count > 1 or waiting:
                back, run = run.split((run.count + 1) // 2)
                for lot in back.lots:
                    self.give(lot)
                if run.count:
                    waiting.append(run)
            else:
                self.last(run)

    def last(self, run: Run) -> None:
        """The one sequence that nothing is left for, as sequences of the powers of two that it is made of."""
        left, lots = run.used, list(reversed(run.lots))
        while left:
            tier = 1 << left.bit_length() - 1
            here = Run(1)
            while gap := tier - here.used:
                lot = lots.pop()
                if lot.length > gap:
                    lots.append(replace(lot, start=lot.start + gap, length=lot.length - gap))
                    lot = replace(lot, length=gap)
                here.lots.append(lot)
            self.close(tier, here)
            left -= tier

    def close(self, tier: int, run: Run) -> None:
        run.tier, run.first = tier, self.sequences
        self.sequences += run.count
        self.runs.append(run)

    def places(self) -> list[tuple[int, ...]]:
        """A row for each lot of each run, in the columns of ``PLACES``."""
        out, before = [], {}
        for run in sorted(self.runs, key=lambda r: (-r.tier, -r.cost)):
            rank = before.get(run.tier, 0)
            before[run.tier] = rank + run.count
            offset = 0
            for lot in run.lots:
                out.append((lot.origin, lot.first, lot.count, lot.start, lot.length, run.first, offset, run.tier, rank))
                offset += lot.length
        return out

    def groups(self, step_tokens: int) -> dict[int, int]:
        """Step groups of each tier."""
        held: dict[int, int] = {}
        for run in self.runs:
            held[run.tier] = held.get(run.tier, 0) + run.count
        return {tier: -(-n * tier // max(tier, step_tokens)) for tier, n in sorted(held.items(), reverse=True)}


#: Rows of a plan that go to every task; a larger plan is joined.
SENT = 200_000
PLACES = "length int, first_piece long, pieces long, piece_start int, piece_length int, first_sequence long, offset long, tier int, rank long"


def tokenised(docs: DataFrame, vocabulary: tuple[str, str, str], capacity: int, end: int, buckets: int, with_ids: bool) -> DataFrame:
    """Full sequences and rests of documents (``id``, ``text``), dealt to buckets in turn."""
    closing = np.array([end], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*vocabulary)
        # Tasks begin at places of their own; the result is written, so a row keeps its bucket.
        turn = TaskContext.get().partitionId() * 7919
        for batch in batches:
            rows = []
            for i, text in zip(*(batch.column(n).to_pylist() for n in ("id", "text"))):
                ids = encode(text or "") + closing
                n = len(ids) // 4
                for a in range(0, n, capacity):
                    part, turn = ids[4 * a : 4 * (a + capacity)], turn + 1
                    full = len(part) == 4 * capacity
                    rows.append((i, a, len(part) // 4, n, turn % buckets, zlib.crc32(part), part if with_ids or not full else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * len(TYPES), TYPES)], ["id", "start", "length", "doc_tokens", "bucket", "crc", "ids"])

    return docs.mapInArrow(pieces, PIECES)


def step_group(rank: Column, tier: Column, groups: dict[int, int]) -> Column:
    """The number of a sequence's step group, from its rank in its tier.

    Ranks go back and forth over the tier's groups. Group ``g`` of ``n`` stands
    at ``(2 g + 1) / 2 n`` of the run; it is numbered by how many groups of all
    tiers stand before it, a longer tier first where two stand at one place.
    """
    found = F.lit(None).cast("long")
    for own, n in groups.items():
        lap, at = F.floor(rank / n), rank % n
        place = 2 * F.when(lap % 2 == 0, at).otherwise(n - 1 - at) + 1
        # Another tier's groups h with (2 h + 1) / 2 m under place / 2 n; with ties, at most that.
        before = [F.floor((place * m + n - (0 if other > own else 1)) / (2 * n)) if other != own else F.floor(place / 2) for other, m in groups.items()]
        found = F.when(tier == own, sum(before[1:], before[0]).cast("long")).otherwise(found)
    return found


def pack_tiers(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, step_tokens: int = STEP_TOKENS, vocabulary: tuple[str, str, str] | None = None, with_ids: bool = True
) -> DataFrame:
    """Pieces of all documents, each with its sequence and its place there.

    Returns ``id_col``, ``start``, ``length``, ``ids`` (little-endian, four bytes
    a token; without ``with_ids`` null where a piece is a full sequence),
    ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``, ``tier`` (the
    sequence's length) and ``step_group``. ``capacity`` is a power of two.
    """
    if capacity < 1 or capacity & capacity - 1:
        raise ValueError(f"the capacity must be a power of two, not {capacity}")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    buckets = 4 * shuffle_partitions(spark)
    pieces = materialize(tokenised(spread(rows), vocabulary or default_vocabulary(), capacity, end, buckets, with_ids), "pieces")
    counts = pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("held"))
    # At most one row per possible length.
    plan = TierPlan({r["length"]: r["held"] for r in counts.groupBy("length").agg(F.sum("held").alias("held")).collect()}, capacity)
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "bucket", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("id", "crc", "start", "doc_tokens")
    numbered = pieces.withColumn("nth", F.row_number().over(within) - 1).join(starts, ["length", "bucket"]).withColumn("nth", F.col("nth") + F.col("before"))
    # Bounded by the lengths and the gaps they can fill, not by the documents; sent only while small.
    told = plan.places()
    places = spark.createDataFrame(told, PLACES)
    placed = numbered.join(F.broadcast(places) if len(told) <= SENT else places, "length").filter((F.col("nth") >= F.col("first_piece")) & (F.col("nth") < F.col("first_piece") + F.col("pieces")))
    step = F.col("nth") - F.col("first_piece")
    whole = F.col("piece_length") == F.col("length")
    cut = F.substring(F.col("ids"), 4 * F.col("piece_start") + 1, 4 * F.col("piece_length"))
    return placed.select(
        F.col("id").alias(id_col), (F.col("start") + F.col("piece_start")).alias("start"), F.col("piece_length").cast("long").alias("length"),
        F.when(whole, F.col("ids")).otherwise(cut).alias("ids"), F.when(whole, F.col("crc")).otherwise(F.crc32(cut)).alias("ids_crc32"), "doc_tokens",
        (F.col("first_sequence") + step).alias("sequence_id"), "offset", "tier", step_group(F.col("rank") + step, F.col("tier"), plan.groups(step_tokens)).alias("step_group"),
    )


def op12_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens and of shorter powers of two."""
    return pack_tiers(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")
