"""Best-fit packing with large-item matching.

Documents are tokenised, ended with an end token, and cut only if they are longer
than a sequence. Pieces above a third of the capacity go at most twice into a
sequence: the longest is matched greedily with the longest other one that still
fits. Smaller pieces then go, longest first, to the tightest gap that holds them.

A piece matters only by its length, so the plan is made from a histogram with at
most ``capacity`` entries, whatever the number of documents: it says how many
sequences have which pattern of lengths, in runs of equal patterns. Pieces get
their number among those of their length from counts per (bucket, length), and
look up their place in the plan. No step sorts all pieces in one task.

Defined results: a null or empty text is the end token alone; rows that repeat
an id are separate documents (told apart by their text; identical rows are
numbered by the order of their pieces, which are equal); an empty table gives an
empty result. Whole texts are tokenised.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glimmergrid.llm.common import materialize, shuffle_partitions, spread, table

CAPACITY = 1024
END = 2
CACHED = 400_000
PIECES = "id long, mark long, piece int, start long, length long, ids_crc32 long"


def default_vocabulary() -> tuple[str, str, str]:
    """The tokenizer file, the same vocabulary as ranks, and its splitting pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


class Encoder(dict):
    """Text to token ids, as little-endian bytes of four a token.

    A byte-level vocabulary never joins text across a single space that precedes
    a word, so a text is the concatenation of its words' ids, and the words in
    use are kept. Texts where this need not hold (double spaces, the name of a
    special token) are encoded whole.
    """

    def __init__(self, tokenizer_file: str, ranks_file: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer_file)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.words = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.words.encode_ordinary(" " + word), "<u4").tobytes()
        if len(self) < CACHED:
            self[word] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if "  " in text:
            return np.array(self.words.encode_ordinary(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        return np.array(self.words.encode_ordinary(first), "<u4").tobytes() + b"".join(map(self.__getitem__, rest))


@cache
def encoder(*files: str) -> Encoder:
    """One encoder a worker process."""
    return Encoder(*files)


def tokenised(docs: DataFrame, vocabulary: tuple[str, str, str], capacity: int, end: int) -> DataFrame:
    """One row per piece of a document; ``docs`` has ``id``, ``mark`` and ``text``."""
    closing = np.array([end], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*vocabulary)
        for batch in batches:
            rows = []
            for i, mark, text in zip(*(batch.column(n).to_pylist() for n in ("id", "mark", "text"))):
                ids = encode(text or "") + closing
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                rows += [(i, mark, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 6, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["id", "mark", "piece", "start", "length", "ids_crc32"])

    return docs.mapInArrow(pieces, PIECES)


class Plan:
    """Where the pieces of each length go: runs of sequences with equal patterns."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.used: dict[int, int] = {}
        #: length, first piece, pieces, first sequence, pieces a sequence, offset of the first
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        #: gap: runs (first sequence, sequences)
        self.gaps: dict[int, list[tuple[int, int]]] = {}

    def put(self, length: int, first: int, sequences: int, each: int, offset: int) -> None:
        """``each`` pieces of ``length`` into every one of ``sequences`` sequences."""
        at = self.used.get(length, 0)
        self.runs.append((length, at, sequences * each, first, each, offset))
        self.used[length] = at + sequences * each
        if gap := self.capacity - offset - each * length:
            self.gaps.setdefault(gap, []).append((first, sequences))

    def open(self, sequences: int) -> int:
        self.sequences += sequences
        return self.sequences - sequences


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The packing of ``histogram[length]`` pieces of each length."""
    plan, left = Plan(capacity), dict(histogram)
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for a in large:
        while left[a]:
            fits = [b for b in large if left[b] and b <= capacity - a and (b != a or left[a] > 1)]
            if not fits:
                plan.put(a, plan.open(left[a]), left[a], 1, 0)
                left[a] = 0
            elif (b := fits[0]) == a:
                plan.put(a, plan.open(left[a] // 2), left[a] // 2, 2, 0)
                left[a] %= 2
            else:
                pairs = min(left[a], left[b])
                first = plan.open(pairs)
                plan.put(a, first, pairs, 1, 0)
                plan.gaps[capacity - a].remove((first, pairs))
                plan.put(b, first, pairs, 1, a)
                left[a], left[b] = left[a] - pairs, left[b] - pairs
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            gap = min((g for g, runs in plan.gaps.items() if g >= n and runs), default=None)
            if gap is None:
                gap, first, sequences = capacity, 0, -(-left[n] // (capacity // n))
                first = plan.open(sequences)
            else:
                first, sequences = plan.gaps[gap].pop()
            each = min(gap // n, left[n])
            filled = min(sequences, left[n] // each)
            plan.put(n, first, filled, each, capacity - gap)
            left[n] -= filled * each
            if rest := sequences - filled:
                plan.gaps.setdefault(gap, []).append((first + filled, rest))
    return plan


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, vocabulary: tuple[str, str, str] | None = None) -> DataFrame:
    """Pieces of all documents, each with its sequence and its place there.

    Returns ``id_col``, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``sequence_id`` and ``offset``.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    pieces = tokenised(spread(rows), vocabulary or default_vocabulary(), capacity, end)
    buckets = 4 * shuffle_partitions(spark)
    pieces = materialize(pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "mark", "piece"), F.lit(buckets)).cast("int")), "pieces")
    counts = pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("held"))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("before", F.coalesce(F.sum("held").over(earlier), F.lit(0)))
    # At most one row per possible length.
    histogram = {r["length"]: r["held"] for r in counts.groupBy("length").agg(F.sum("held").alias("held")).collect()}
    runs = plan_packing(histogram, capacity).runs
    places = spark.createDataFrame(runs, "length long, first_piece long, pieces long, first_sequence long, each long, first_offset long")
    within = Window.partitionBy("length", "bucket").orderBy("id", "mark", "piece")
    numbered = pieces.withColumn("nth", F.row_number().over(within) - 1).join(starts.drop("held"), ["length", "bucket"]).withColumn("nth", F.col("nth") + F.col("before"))
    # Bounded by the number of lengths times the gaps they can fill, not by the documents.
    placed = numbered.join(F.broadcast(places), "length").filter((F.col("nth") >= F.col("first_piece")) & (F.col("nth") < F.col("first_piece") + F.col("pieces")))
    step = F.col("nth") - F.col("first_piece")
    return placed.select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.floor(step / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + step % F.col("each") * F.col("length")).cast("long").alias("offset"),
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"))
