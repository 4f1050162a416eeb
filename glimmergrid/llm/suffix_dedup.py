"""Suffix-array dedup by threshold-bounded interval expansion.

A byte goes if it lies in a string of ``min_length`` bytes that also starts
somewhere else, in the same document or another.

The rows of a suffix array that can share a prefix of that length are brought
together first, so that no task needs the array of the corpus:

1. Every window of ``min_length`` bytes has a seed, its least hashed ``k``-gram,
   and windows of one seed are sliced by their distance to it. All windows of a
   slice contain the same core, ``min_length - slice + 1`` bytes that lie in the
   same place relative to the seed. Equal windows have equal seeds, slices and
   cores, so only slices whose core is repeated can hold repeated windows.
2. Those are sent, by core, with what surrounds the core. Equal surroundings
   collapse to one row, so a group of copies of any size is one row a task.
3. In a core's bucket the rows are an interval of the suffix array: suffixes that
   begin with the core, sorted by what follows it. The interval is extended
   backward, breadth first, one byte of the Burrows-Wheeler column (the byte
   before each suffix) at a time, by rank counts; intervals of one row are
   dropped. After each step neighbours of an interval share the extension, and
   what follows the core as far as the common prefixes of the suffix array say:
   they share a window if both make up ``min_length``. Expansion ends there.

Repeated windows become runs of bytes per document. Three things go without
expansion, as they are known to repeat: a text that occurs twice as a whole,
equal surroundings of a core (its windows occur twice), and buckets whose windows
were dealt one by one.

Defined results: a null text is empty; texts shorter than ``min_length`` stay;
rows that repeat an id and a text are copies of each other; rows with null ids
are rows like others; an empty table gives an empty result. Whole texts are
treated, as UTF-8 bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmergrid.llm.common import materialize, spread, table
from glimmergrid.llm.hashing import mixed

MIN_LENGTH, K, SLICE = 400, 32, 200
SEGMENT = 1 << 23
ROWS = 20_000
BUCKET = 5_000
FACTORS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F]


def doubled(grams: np.ndarray, length: int, twice: int) -> tuple[np.ndarray, int]:
    """Hashes of twice as many bytes, ``twice`` times over."""
    for _ in range(twice):
        factor = np.uint64(FACTORS[length.bit_length() - 1])
        x = (grams[:-length] if length < len(grams) else grams[:0]) * factor + grams[length:]
        grams, length = x ^ (x >> np.uint64(31)), 2 * length
    return grams, length


def stretched(grams: np.ndarray, length: int, wanted: int) -> np.ndarray:
    """Hashes of ``wanted`` bytes (up to twice ``length``) from those of ``length``."""
    gap = wanted - length
    return mixed(grams[: len(grams) - gap] * np.uint64(FACTORS[-1]) + grams[gap:])


def slices(b: np.ndarray, min_length: int, k: int, width: int) -> dict[str, np.ndarray]:
    """A text's slices: start of the core, first and last window as bytes before it, two hashes of the core."""
    parts = [_slices(b[i : i + SEGMENT + min_length - 1], i, min_length, k, width) for i in range(0, max(1, len(b) - min_length + 1), SEGMENT)]
    return {name: np.concatenate([p[name] for p in parts]) for name in parts[0]}


def _slices(b: np.ndarray, offset: int, min_length: int, k: int, width: int) -> dict[str, np.ndarray]:
    windows = len(b) - min_length + 1
    core = min_length - width + 1
    if windows < 1:
        return {"at": np.zeros(0, np.int64), "low": np.zeros(0, np.int64), "high": np.zeros(0, np.int64), "h1": np.zeros(0, np.uint64), "h2": np.zeros(0, np.uint64)}
    start = mixed(b.astype(np.uint64) + np.uint64(1))
    seeds, length = doubled(start, 1, k.bit_length() - 1)
    # Hash above, place below: the least is the leftmost of the least hashes.
    packed = (seeds & ~np.uint64((1 << 24) - 1)) | np.arange(len(seeds), dtype=np.uint64)
    span = min_length - k + 1
    padded = np.concatenate((packed, np.full(-len(packed) % span, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, span)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:windows], ahead[span - 1 : span - 1 + windows])
    seed = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    nth = (seed - np.arange(windows)) // width
    first = np.flatnonzero(np.concatenate(([True], (seed[1:] != seed[:-1]) | (nth[1:] != nth[:-1]))))
    last = np.concatenate((first[1:], [windows])) - 1
    at = seed[first] - nth[first] * width
    grams, length = doubled(seeds, length, int(np.log2(core)) - (k.bit_length() - 1))
    h1 = stretched(grams, length, core)[at]
    h2 = mixed(grams[at] ^ (grams[at + core - length] * np.uint64(FACTORS[0])))
    return {"at": at + offset, "low": at - last, "high": at - first, "h1": h1, "h2": h2}


def common_prefixes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading columns the paired rows of two matrices share."""
    other = a != b
    return np.where(other.any(axis=1), other.argmax(axis=1), a.shape[1])


class RangeMinimum:
    """Minima of any stretch of an array, from minima of stretches of twice the length each."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << len(self.levels) - 1 <= len(values):
            last, half = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minima from ``first`` to ``last``, both included."""
        level = np.log2(last - first + 1).astype(np.int64)
        out = np.empty(len(first), self.levels[0].dtype)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.levels[k][first[at]], self.levels[k][last[at] - (1 << k) + 1])
        return out


def expand(core: np.ndarray, lefts: list[bytes], rights: list[bytes], low: np.ndarray, high: np.ndarray, width: int) -> np.ndarray:
    """Which windows of which rows another row shares: a matrix by row and bytes before the core.

    ``core`` numbers the cores; a row's windows begin ``low`` to ``high`` bytes
    before the core. Rows of a core, sorted by what follows it, are an interval of
    the suffix array; ``prefixes`` has what neighbours in it share. The column
    ``left[:, e]`` is the Burrows-Wheeler transform of the rows that were extended
    by ``e`` bytes. A step backward takes each row to the number of rows in its
    interval with a smaller byte, plus the rank of its own byte among equal ones.
    """
    n = len(core)
    right = np.zeros((n, width), ">u2")
    left = np.zeros((n, width), np.int64)
    for i, (a, b) in enumerate(zip(lefts, rights)):
        left[i, : len(a)] = np.frombuffer(a, np.uint8)[::-1].astype(np.int64) + 1
        right[i, : len(b)] = np.frombuffer(b, np.uint8).astype(np.uint16) + 1
    core = np.unique(core, return_inverse=True)[1].astype(np.int64)
    order = np.lexsort((np.ascontiguousarray(right).view(f"S{2 * width}").ravel(), core))
    core, left, right, low, high = core[order], left[order], right[order], low[order], high[order]
    prefixes = np.where(core[1:] == core[:-1], common_prefixes(right[1:], right[:-1]), -1)
    shortest = RangeMinimum(prefixes) if n > 1 else None
    shared = np.zeros((n, width), bool)
    # Rows of all intervals in their order after each step, and the number of each one's interval.
    rows, interval = np.arange(n), core
    for e in range(width):
        if e:
            byte = left[rows, e - 1]
            start = np.searchsorted(interval, interval)
            smaller, rank = stepped(interval, byte)
            at = np.empty(len(rows), np.int64)
            at[start + smaller + rank] = np.arange(len(rows))
            rows, byte, interval = rows[at], byte[at], interval[at]
            first = np.concatenate(([True], (interval[1:] != interval[:-1]) | (byte[1:] != byte[:-1])))
            interval = np.cumsum(first) - 1
            # An interval of one row shares nothing more.
            many = np.bincount(interval)[interval] > 1
            rows, interval = rows[many], interval[many]
        if len(rows) < 2:
            break
        here = np.flatnonzero((low[rows] <= e) & (e <= high[rows]))
        a, b = here[:-1], here[1:]
        same = interval[a] == interval[b]
        a, b = rows[a[same]], rows[b[same]]
        if len(a):
            # Rows of an interval keep the order of what follows the core, so only neighbours need a look.
            together = shortest.least(a, b - 1) >= width - 1 - e
            shared[a[together], e] = shared[b[together], e] = True
    out = np.zeros_like(shared)
    out[order] = shared
    return out


def stepped(interval: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of sorted intervals: rows of its interval with a smaller byte, and earlier ones with the same."""
    by_byte = np.argsort(interval * 257 + byte, kind="stable")
    place = np.empty(len(byte), np.int64)
    place[by_byte] = np.arange(len(byte))
    key = (interval * 257 + byte)[by_byte]
    first = np.searchsorted(key, interval * 257 + byte)
    return first - np.searchsorted(interval, interval), place - first


def runs(marked: np.ndarray) -> list[int]:
    """First and last place of each run of marks, one after another."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], marked.astype(np.int8), [0]))))
    edge[1::2] -= 1
    return edge.tolist()


def repeated_windows(surroundings: DataFrame, width: int) -> DataFrame:
    """``h1``, ``place`` and ``shared`` (runs of bytes before the core) of surroundings that hold repeated windows; buckets go by ``key``."""

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = pdf.groupby(["key", "h1", "h2"], sort=False).ngroup().to_numpy()
        sizes = np.bincount(bucket)[bucket]
        low, high, copies = (pdf[c].to_numpy() for c in ("low", "high", "copies"))
        found = [[int(a), int(b)] if c > 1 else [] for a, b, c in zip(low, high, copies)]
        many = np.flatnonzero(sizes > 1)
        if len(many):
            part = pdf.iloc[many]
            marks = expand(bucket[many], list(part["left"]), list(part["right"]), low[many], high[many], width)
            for i, row in zip(many, marks):
                if copies[i] < 2:
                    found[i] = runs(row)
        out = pd.DataFrame({"h1": pdf["h1"], "place": pdf["place"], "shared": found})
        return out[[len(x) > 0 for x in found]]

    def buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []
        held = 0
        for b in batches:
            # Rows come sorted by bucket: all but the last bucket's rows are complete.
            waiting.append(b)
            held += len(b)
            if held >= ROWS:
                rows = pd.concat(waiting, ignore_index=True)
                cut = int(np.searchsorted(rows["key"].to_numpy(), rows["key"].iat[-1]))
                if cut:
                    yield settle(rows.iloc[:cut].reset_index(drop=True))
                waiting, held = [rows.iloc[cut:]], len(rows) - cut
        if held:
            yield settle(pd.concat(waiting, ignore_index=True))

    dealt = surroundings.repartition("key").sortWithinPartitions("key")
    return dealt.mapInPandas(buckets, "h1 long, place long, shared array<int>")


def split_buckets(surroundings: DataFrame, width: int, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Deals surroundings to buckets of up to ``most`` rows, and gives windows that need none.

    A core with many different surroundings, such as a passage that stands in
    very many documents, is dealt anew by more than the core: windows that begin
    ``a`` to ``b`` bytes before it share the last ``a`` bytes to its left and all
    but ``b`` of those to its right, too. Ranges get narrower until the bucket is
    small enough. A range of one window needs no expansion: its rows are equal.
    """
    rows = surroundings.withColumn("key", F.xxhash64("h1", "h2")).withColumn("a", F.lit(0)).withColumn("b", F.lit(width))
    done: list[DataFrame] = []
    equal = None
    steps = [w for w in (width // 4, width // 20, 1) if w]
    for step in (*steps, None):
        hot = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("key"), "hot")
        if hot.isEmpty():
            break
        done.append(rows.join(hot, "key", "left_anti"))
        large = rows.join(hot, "key", "left_semi")
        if step is None:
            equal = large.select("h1", "place", F.array("a", "a").alias("shared"))
            return _all(done), equal
        parts = large.withColumn("from", F.explode(F.sequence(F.col("a"), F.col("b") - 1, F.lit(step))))
        parts = parts.withColumn("b", F.least(F.col("b"), F.col("from") + step)).withColumn("a", F.col("from")).drop("from")
        parts = parts.withColumn("low", F.greatest("low", "a")).withColumn("high", F.least(F.col("high"), F.col("b") - 1)).filter("low <= high")
        near = F.xxhash64("h1", "h2", "a", "b", F.expr("substring(left, length(left) - a + 1, a)"), F.expr(f"substring(right, 1, {width} - b)"))
        rows = materialize(parts.withColumn("key", near), "parts")
    return _all([*done, rows]), equal


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables).drop("a", "b")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint maximal spans."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, k: int = K, width: int = SLICE, bucket_rows: int = BUCKET) -> DataFrame:
    """Documents without the bytes that repeated strings cover.

    Returns, for each input row, ``id_col``, ``n_bytes``, ``spans`` (removed runs,
    start and end) and ``kept`` (the remaining bytes).
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")).withColumn("mark", F.xxhash64("text"))
    kind = dict(rows.dtypes)["id"]

    def outline(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cores = [slices(np.frombuffer(t, np.uint8), min_length, k, width)["h1"].astype(np.int64) for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "mark": b["mark"], "digest": [hashlib.sha256(t).digest() for t in b["text"]], "long": [len(t) >= min_length for t in b["text"]], "cores": cores})

    outlines = materialize(spread(rows).mapInPandas(outline, f"id {kind}, mark long, digest binary, long boolean, cores array<long>"), "outlines").filter("long")
    texts = outlines.groupBy("digest").agg(F.min(F.struct("id", "mark")).alias("own"), F.count(F.lit(1)).alias("copies"))
    # Written first, so that both sides of the joins are plain shuffles and the rows of a text with very many copies can be split.
    texts = materialize(texts.select("digest", "own.*", "copies"), "texts")
    copied = outlines.join(texts.filter("copies > 1").select("digest"), "digest", "left_semi").select("id", "mark").distinct()
    own = (outlines["digest"] == texts["digest"]) & (outlines["mark"] == texts["mark"]) & outlines["id"].eqNullSafe(texts["id"])
    one_each = outlines.select("id", "mark", "digest", "cores").join(texts, own, "left_semi").dropDuplicates(["digest"])
    cores = one_each.select("id", "mark", F.posexplode("cores").alias("nth", "h1"))
    # Written first, so that both sides of the join are plain shuffles and a very common core's rows can be split.
    often = materialize(cores.groupBy("h1").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1"), "often")
    wanted = cores.join(often, "h1", "left_semi").groupBy("id", "mark").agg(F.sort_array(F.collect_list("nth")).alias("nths"))
    wanted = materialize(wanted, "wanted")
    dealt = rows.join(wanted, (rows["id"].eqNullSafe(wanted["id"])) & (rows["mark"] == wanted["mark"])).select(rows["id"], rows["mark"], "text", "nths")

    def surround(full: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out: dict[str, list] = {c: [] for c in ("id", "mark", "at", "h1", "h2", "low", "high", "left", "right", "place")}
                for i, mark, text, nths in zip(b["id"], b["mark"], b["text"], b["nths"]):
                    cut = {name: x[nths] for name, x in slices(np.frombuffer(text, np.uint8), min_length, k, width).items()}
                    core = min_length - width + 1
                    left = [text[a - h : a] for a, h in zip(cut["at"].tolist(), cut["high"].tolist())]
                    right = [text[a + core : a + core + width - 1 - lo] for a, lo in zip(cut["at"].tolist(), cut["low"].tolist())]
                    for name in ("at", "low", "high"):
                        out[name] += cut[name].tolist()
                    out["h1"].append(cut["h1"].astype(np.int64))
                    out["h2"].append(cut["h2"].astype(np.int64))
                    out["left"] += left
                    out["right"] += right
                    out["id"] += [i] * len(left)
                    out["mark"] += [mark] * len(left)
                    out["place"] += [int.from_bytes(hashlib.blake2b(b"%d,%d,%d|" % (lo, hi, len(x)) + x + y, digest_size=8).digest(), "little", signed=True) for lo, hi, x, y in zip(cut["low"].tolist(), cut["high"].tolist(), left, right)]
                for name in ("h1", "h2"):
                    out[name] = np.concatenate(out[name]) if out[name] else []
                yield pd.DataFrame({c: out[c] for c in (("h1", "h2", "low", "high", "left", "right", "place") if full else ("id", "mark", "at", "h1", "place"))})

        return run

    around = dealt.mapInPandas(surround(True), "h1 long, h2 long, low int, high int, left binary, right binary, place long")
    around = around.groupBy("h1", "h2", "low", "high", "left", "right", "place").agg(F.count(F.lit(1)).alias("copies"))
    buckets, equal = split_buckets(materialize(around, "around"), width, bucket_rows)
    shared = repeated_windows(buckets, width)
    shared = materialize(shared if equal is None else shared.unionByName(equal), "windows")
    # Rows of whole copies go as they are; an id and a text that are no copy are one row, whose hits are gathered.
    lone = dealt.join(copied, (dealt["id"].eqNullSafe(copied["id"])) & (dealt["mark"] == copied["mark"]), "left_anti")
    at = lone.select("id", "mark", "text", "nths").mapInPandas(surround(False), f"id {kind}, mark long, at long, h1 long, place long")
    hits = at.join(shared, ["h1", "place"]).select("id", "mark", F.struct("at", "shared").alias("hit"))
    hits = hits.groupBy("id", "mark").agg(F.collect_list("hit").alias("hits"))
    verdict = hits.select("id", "mark", "hits", F.lit(False).alias("all"))
    empty = F.array().cast(dict(hits.dtypes)["hits"])
    verdict = verdict.unionByName(copied.select("id", "mark", empty.alias("hits"), F.lit(True).alias("all")))

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            spans, kept = [], []
            for text, hits, whole in zip(b["text"], b["hits"], b["all"]):
                found = [(h["at"] - y, h["at"] - x + min_length) for h in (hits if hits is not None else []) for x, y in zip(h["shared"][::2], h["shared"][1::2])]
                found = [(0, len(text))] if whole is True or whole == 1 else merged(found)
                edges = [0, *(e for span in found for e in span), len(text)]
                spans.append([{"start": a, "end": z} for a, z in found])
                kept.append(b"".join(text[a:z] for a, z in zip(edges[::2], edges[1::2])))
            yield pd.DataFrame({"id": b["id"], "n_bytes": [len(t) for t in b["text"]], "spans": spans, "kept": kept})

    judged = rows.join(verdict, (rows["id"].eqNullSafe(verdict["id"])) & (rows["mark"] == verdict["mark"]), "left").select(rows["id"], "text", "hits", "all")
    return judged.mapInPandas(remove, f"id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary").withColumnRenamed("id", id_col)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What suffix-array dedup at 400 bytes leaves of every document."""
    told = dedup_substrings(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    told = told.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "kept")
    share = F.when(F.col("n_bytes") > 0, F.col("n_removed") / F.col("n_bytes")).otherwise(0.0)
    # Runs may begin or end inside a letter; what is left of it becomes the replacement sign.
    kept_text = F.make_valid_utf8(F.col("kept").cast("string"))
    return told.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_removed") > 0).alias("repeated"), share.alias("removed_share"), kept_text.alias("kept_text"))
