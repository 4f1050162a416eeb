"""The trie of all conversations' prefixes, by sorted longest common prefixes.

Conversations are rebuilt, their turns become 128-bit hashes of depth, role and
text, and are sorted as sequences. In a block of the sorted order the longest
common prefixes of neighbours (LCPs) get a sparse table of range minima. A prefix
of a conversation is a candidate where no earlier row of the block has it; each
candidate binary-searches its left and its right extent over the table,
independently and without a stack, which gives the interval of its members. In
the order of rows and depths the candidates are in preorder, so counts and sums
over subtrees are differences of prefix sums.

No task holds more than a block. Long conversations are cut into segments of
``segment`` turns, each sorted among those with the same turns before it, so
sorting keys are bounded. Prefixes at the edge of a block may go on in another
one, and those at the end of a segment in the next; they are *open*, and their
parts meet by hash. Per block there are as many as its first and its last row have
prefixes, however many members they have. Sums below them are added to their
ancestors from one row each. Turns are numbered from ranges of bounded size, so a
conversation that holds a third of all rows isn't sorted by one task.

Defined results: rows with a null conversation id take no part; null turns come
first, and equal turn numbers go by role and text; a null role or text is empty;
repeated rows are turns of their own; an empty table gives no node. A
conversation whose turns all go is a member of the root.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glimmergrid.llm.common import materialize, table

SEGMENT = 256
BLOCK_TURNS = 200_000
RANGE_ROWS = 500_000
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = ["depth", "p1", "p2"]
PARTS = """kind string, seg long, k1 long, k2 long, depth long, p1 long, p2 long, q1 long, q2 long, parent_conv long, parted boolean, edge boolean, n long, conv long, chars long,
  kids long, leaves long, saved long, ends_sha256 string, first_end long, ends binary, line1 array<long>, line2 array<long>"""


def own_turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv``, ``pos`` (from 1), the hashes ``d1`` and ``d2`` of role and text, and the code points ``n`` of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")).filter("conv IS NOT NULL")
    # Texts only move where turn numbers are equal.
    ties = materialize(rows.groupBy("conv", "turn").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("conv", "turn", F.lit(True).alias("tied")), "ties")
    if ties.isEmpty():
        rows = rows.withColumn("tie", F.lit(None).cast("struct<role:string,text:string>"))
    else:
        same = rows["conv"].eqNullSafe(ties["conv"]) & rows["turn"].eqNullSafe(ties["turn"])
        rows = rows.join(ties, same, "left").select(rows["*"], F.when(F.col("tied"), F.struct("role", "text")).alias("tie"))
    rows = rows.select("conv", "turn", "tie", F.xxhash64("role", "text").alias("d1"), F.xxhash64(F.lit(7), "role", "text").alias("d2"), F.length("text").alias("n"))
    ranges = max(1, math.ceil(rows.count() / RANGE_ROWS))
    order = ["conv", "turn", "tie", "d1", "d2"]
    ranged = materialize(rows.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()), "ranged")
    held = ranged.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("held"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = materialize(held.select("conv", "part", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before")), "before")
    numbered = ranged.withColumn("nth", F.row_number().over(Window.partitionBy("conv", "part").orderBy(*order[1:])))
    return numbered.join(before, ["conv", "part"]).select("conv", (F.col("before") + F.col("nth")).alias("pos"), "d1", "d2", "n")


def rebuilt(turns: DataFrame, family: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations (``conv``, ``length``), and their turns after rebuilding (``conv``, ``length``, ``depth``, ``d1``, ``d2``, ``n``).

    The first ``h`` turns come from the conversation that opens the family, with
    ``h`` the CRC-32 of the id modulo ``most``; then come the own turns after the first ``h``.
    """
    turns = materialize(turns, "turns")
    totals = materialize(turns.groupBy("conv").agg(F.max("pos").alias("total")), "totals")
    told = totals.withColumn("base", F.col("conv") - F.col("conv") % family).withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % most)
    heads = totals.select(F.col("conv").alias("base"), F.least("total", F.lit(most)).alias("head"))
    told = told.join(heads, "base", "left").withColumn("lent", F.least("h", F.coalesce("head", F.lit(0))))
    length = F.when(F.col("conv") == F.col("base"), F.col("total")).otherwise(F.col("lent") + F.greatest(F.lit(0), F.col("total") - F.col("h")))
    told = materialize(told.select("conv", "base", "h", "lent", length.alias("length")), "conversations")
    opening = turns.filter(F.col("pos") < most).withColumnRenamed("conv", "base")
    lent = told.filter("conv <> base").join(opening, "base").filter("pos <= h").select("conv", "length", F.col("pos").alias("depth"), "d1", "d2", "n")
    own = turns.join(told, "conv").filter("conv = base OR pos > h")
    own = own.select("conv", "length", F.when(F.col("conv") == F.col("base"), F.col("pos")).otherwise(F.col("pos") - F.col("h") + F.col("lent")).alias("depth"), "d1", "d2", "n")
    return told.select("conv", "length"), lent.unionByName(own)


def segments_of(convs: DataFrame, turns: DataFrame, segment: int) -> DataFrame:
    """A row for each ``segment`` turns of a conversation: ``seg``, the hash ``k1``, ``k2`` of the turns before, ``seq`` (two hashes a turn), ``chars`` and ``last``."""
    hashes = [F.xxhash64("depth", "d1", "d2").alias("h1"), F.xxhash64(F.lit(7), "depth", "d1", "d2").alias("h2")]
    rows = turns.select("conv", "length", "depth", *hashes, "n", F.floor((F.col("depth") - 1) / segment).alias("seg"))
    in_order = F.sort_array(F.collect_list(F.struct("depth", "h1", "h2", "n")))
    # At most ``segment`` turns meet in a row.
    held = rows.groupBy("conv", "length", "seg").agg(in_order.alias("t"), F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
    held = held.select("conv", "length", "seg", F.flatten(F.transform("t", lambda t: F.array(t["h1"], t["h2"]))).alias("seq"), F.transform("t", lambda t: t["n"]).alias("chars"), "x1", "x2")
    held = materialize(held, "segments")
    before = Window.partitionBy("conv").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    keys = [F.coalesce(F.bit_xor(x).over(before), F.lit(0)).alias(k) for k, x in (("k1", "x1"), ("k2", "x2"))]
    zero = F.lit(0).cast("long")
    last = (F.col("length") <= (F.col("seg") + 1) * segment).alias("last")
    short = held.filter(F.col("length") <= segment).select("seg", zero.alias("k1"), zero.alias("k2"), "seq", "chars", "conv", last)
    long = held.filter(F.col("length") > segment).select("seg", *keys, "seq", "chars", "conv", last)
    none = convs.filter("length = 0").select(zero.alias("seg"), zero.alias("k1"), zero.alias("k2"), F.array().cast("array<long>").alias("seq"), F.array().cast("array<int>").alias("chars"), "conv", F.lit(True).alias("last"))
    return short.unionByName(long).unionByName(none)


class RangeMinima:
    """A sparse table: minima of all runs of 1, 2, 4, ... values."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << len(self.levels) - 1 <= len(values):
            below, half = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(np.minimum(below[:-half], below[half:]))

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The least value from ``first`` to ``last``, both included."""
        out = np.empty(len(first), self.levels[0].dtype)
        level = np.frexp((last - first + 1).astype(float))[1] - 1
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.levels[k][first[at]], self.levels[k][last[at] - (1 << int(k)) + 1])
        return out

    def left(self, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The first row down to which all LCPs after it, up to ``row``'s, reach ``depth``."""
        at = row.copy()
        for k in reversed(range(len(self.levels))):
            to = at - (1 << k)
            fine = to >= 0
            fine[fine] = self.levels[k][to[fine] + 1] >= depth[fine]
            at[fine] = to[fine]
        return at

    def right(self, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The last row up to which all LCPs after ``row``'s reach ``depth``."""
        at = row.copy()
        for k in reversed(range(len(self.levels))):
            fine = at + (1 << k) < len(self.levels[0])
            fine[fine] = self.levels[k][at[fine] + 1] >= depth[fine]
            at[fine] += 1 << k
        return at


def common_prefixes(new: np.ndarray, sizes: np.ndarray, starts: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """How many turns each row shares with the one before; -1 where ``new`` says that it has another key."""
    out = np.full(len(sizes), -1, np.int64)
    shared = np.where(new[1:], 0, np.minimum(sizes[:-1], sizes[1:]))
    out[1:][~new[1:]] = 0
    rows = np.flatnonzero(shared)
    if len(rows):
        n = shared[rows]
        begins = np.cumsum(n) - n
        within = np.arange(n.sum()) - np.repeat(begins, n)
        a, b = np.repeat(starts[rows], n) + within, np.repeat(starts[rows + 1], n) + within
        differ = np.where((h1[a] != h1[b]) | (h2[a] != h2[b]), within, np.repeat(n, n))
        out[rows + 1] = np.minimum.reduceat(differ, begins)
    return out


def block_nodes(block: pa.Table, segment: int) -> pa.Table:
    """The nodes of one sorted block, and a row of sums for each key of a later segment."""
    seg, k1, k2, conv = (block.column(c).to_numpy() for c in ("seg", "k1", "k2", "conv"))
    going = ~block.column("last").to_numpy(zero_copy_only=False)
    seq = block.column("seq").combine_chunks()
    values, chars = seq.flatten().to_numpy(), block.column("chars").combine_chunks().flatten().to_numpy()
    h1, h2 = values[0::2], values[1::2]
    sizes = seq.value_lengths().to_numpy().astype(np.int64) // 2
    starts = np.cumsum(sizes) - sizes
    m = len(seg)
    new = np.ones(m, bool)
    new[1:] = (seg[1:] != seg[:-1]) | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    lcp = common_prefixes(new, sizes, starts, h1, h2)
    minima, ids = RangeMinima(lcp), RangeMinima(conv)

    # Candidates: prefixes that the row before doesn't have, the root among them.
    low = np.maximum(lcp + 1, (seg > 0).astype(np.int64))
    fresh = np.maximum(0, sizes - low + 1)
    first = np.cumsum(fresh) - fresh
    total = int(fresh.sum())
    row = np.repeat(np.arange(m), fresh)
    depth = low[row] + np.arange(total) - np.repeat(first, fresh)
    begin, end = minima.left(row, depth), minima.right(row, depth)

    # Hashes of prefixes.
    def path(h: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        run = np.concatenate(([0], np.bitwise_xor.accumulate(h))) if len(h) else np.zeros(1, np.int64)
        at = starts[row]
        mine = run[at + depth] ^ run[at] ^ key[row]
        above = run[at + np.maximum(depth - 1, 0)] ^ run[at] ^ key[row]
        return mine, above

    (p1, q1), (p2, q2) = path(h1, k1), path(h2, k2)
    # Parents: the candidate before, or the one whose interval begins at the left extent of the shorter prefix.
    above = np.arange(total) - 1
    turned = np.flatnonzero(depth == low[row])
    up = depth[turned] - 1
    inside = up >= (seg[row[turned]] > 0)
    above[turned[~inside]] = -1
    left = minima.left(row[turned[inside]], up[inside])
    above[turned[inside]] = first[left] + up[inside] - low[left]

    unfinished = np.concatenate(([0], np.cumsum(going)))
    edge = (begin == 0) | (end == m - 1) | (depth == 0)
    opened = edge | ((depth == segment) & (unfinished[end + 1] > unfinished[begin]))
    n = end - begin + 1
    smallest = ids.least(begin, end)
    length = np.zeros(total, np.int64)
    deep = depth > 0
    length[deep] = chars[starts[row[deep]] + depth[deep] - 1]
    # Open children of open nodes are counted once their parts have met.
    counted = (above >= 0) & (~opened | ~opened[above])
    kids = np.bincount(above[counted], minlength=total)[:total]
    leaf = (~opened & (kids == 0)).astype(np.int64)
    value = np.where(edge, 0, (n - 1) * length)
    after = np.append(first + fresh, 0)[end]
    leaves, saved = (np.concatenate(([0], np.cumsum(x)))[after] - np.concatenate(([0], np.cumsum(x)))[:-1] for x in (leaf, value))

    # Conversations that end here: equal rows stand together, by id.
    ended: list[bytes | None] = [None] * total
    sha: list[str | None] = [NO_ENDS] * total
    least_end: list[int | None] = [None] * total
    again = np.concatenate((lcp[1:] == sizes[1:], [False])) & np.concatenate((sizes[1:] == sizes[:-1], [False])) if m else np.zeros(0, bool)
    for c in np.flatnonzero(sizes[row] == depth):
        i = j = int(row[c])
        while again[j]:
            j += 1
        own = conv[i : j + 1][~going[i : j + 1]]
        if len(own):
            text = ",".join(map(str, own.tolist())).encode()
            if opened[c]:
                ended[c], least_end[c] = text, int(own[0])
            else:
                sha[c] = hashlib.sha256(text).hexdigest()

    # Ancestors within the segment, of open nodes only.
    lines1: list[np.ndarray | None] = [None] * total
    lines2: list[np.ndarray | None] = [None] * total
    for c in np.flatnonzero(opened & deep):
        i, d = row[c], depth[c]
        at, base = starts[i], int(seg[i] > 0)
        for lines, h, key in ((lines1, h1, k1), (lines2, h2, k2)):
            lines[c] = np.bitwise_xor.accumulate(np.concatenate(([key[i]], h[at : at + d - 1])))[base:]

    parent_known = above >= 0
    parent_known[parent_known] = ~opened[above[parent_known]]
    parent_conv = pa.array(np.where(parent_known, smallest[above] if total else above, 0), mask=~parent_known)
    columns = [pa.array(["node"] * total, pa.string()), seg[row], k1[row], k2[row], seg[row] * segment + depth, p1, p2, q1, q2, parent_conv, opened, edge, n, smallest, length, kids, leaves, saved]
    columns += [pa.array(sha, pa.string()), pa.array(least_end, pa.int64()), pa.array(ended, pa.binary()), pa.array(lines1, pa.list_(pa.int64())), pa.array(lines2, pa.list_(pa.int64()))]
    nodes = pa.table([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=ARROW)
    tops = np.flatnonzero(new & (seg > 0))
    if not len(tops):
        return nodes
    bounds = np.append(np.flatnonzero(new), m)
    ends = bounds[np.searchsorted(bounds, tops, "right")]
    at, to = first[tops], np.append(first, total)[ends]
    nothing = {f.name: pa.nulls(len(tops), f.type) for f in ARROW}
    sums = [np.concatenate(([0], np.cumsum(x))) for x in (leaf, value)]
    told = {"kind": pa.array(["key"] * len(tops)), "seg": pa.array(seg[tops]), "k1": pa.array(k1[tops]), "k2": pa.array(k2[tops]), "conv": pa.array(ids.least(tops, ends - 1))}
    told |= {name: pa.array(s[to] - s[at]) for name, s in zip(("leaves", "saved"), sums)}
    return pa.concat_tables([nodes, pa.table(list((nothing | told).values()), schema=ARROW)])


_KINDS = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
ARROW = pa.schema([(name, _KINDS[kind]) for name, kind in (part.split() for part in PARTS.replace("\n", " ").split(","))])


def joined_hashes(ends: DataFrame) -> DataFrame:
    """SHA-256 of each node's ends, which lie in several rows: one pass over sorted rows, nothing held but the state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, hashlib.sha256()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(NODE, at), told_sha256=state.hexdigest())], pa.schema([(c, pa.int64()) for c in NODE] + [("told_sha256", pa.string())]))

        for b in batches:
            for *node, part in zip(*(b.column(c).to_pylist() for c in (*NODE, "ends"))):
                if node != at:
                    if at is not None:
                        yield told()
                    at, state = node, hashlib.sha256(part)
                else:
                    state.update(b"," + part)
        if at is not None:
            yield told()

    rows = ends.select(*NODE, "first_end", "ends").repartition(*NODE).sortWithinPartitions(*NODE, "first_end")
    return rows.mapInArrow(run, "depth long, p1 long, p2 long, told_sha256 string")


def later_segments(sums: DataFrame, rows: DataFrame, segment: int) -> DataFrame:
    """What later segments add to the nodes of earlier ones: ``depth``, ``p1``, ``p2``, ``more_leaves``, ``more_saved``.

    ``sums`` has a row per key of a later segment with one conversation that stands
    for it; all nodes that this conversation goes through before are above the key.
    """
    mine = rows.filter("seg > 0 OR NOT last").join(sums.select("conv", "seg", "leaves", "saved"), ["conv", "seg"], "left")
    later = Window.partitionBy("conv").orderBy(F.desc("seg")).rowsBetween(Window.unboundedPreceding, -1)
    told = mine.select("seg", "k1", "k2", "seq", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"more_{c}") for c in ("leaves", "saved")]).filter("more_leaves > 0 OR more_saved > 0")

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for seg, k1, k2, seq, leaves, saved in zip(*(b.column(c).to_pylist() for c in ("seg", "k1", "k2", "seq", "more_leaves", "more_saved"))):
                h = np.array(seq, np.int64)
                p1, p2 = (np.bitwise_xor.accumulate(np.concatenate(([k], x))) for k, x in ((k1, h[0::2]), (k2, h[1::2])))
                depth = seg * segment + np.arange(len(p1))
                keep = slice(int(seg > 0), None)
                columns = [depth[keep], p1[keep], p2[keep], np.full(len(depth[keep]), leaves), np.full(len(depth[keep]), saved)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [*NODE, "more_leaves", "more_saved"])

    found = told.mapInArrow(paths, "depth long, p1 long, p2 long, more_leaves long, more_saved long")
    return found.groupBy(*NODE).agg(F.sum("more_leaves").alias("more_leaves"), F.sum("more_saved").alias("more_saved"))


def prefix_trie(
    conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", family: int = 100, most: int = 6, segment: int = SEGMENT, block_turns: int = BLOCK_TURNS
) -> DataFrame:
    """A row per node: ``conv_id``, ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``."""
    convs, turns = rebuilt(own_turns(conversations, conv_col, turn_col, role_col, text_col), family, most)
    rows = materialize(segments_of(convs, turns, segment), "rows")
    size = rows.agg(F.coalesce(F.sum(F.size("chars") + 1), F.lit(0)).alias("turns")).first()["turns"]
    order = ["seg", "k1", "k2", "seq", "conv"]
    ranged = rows.repartitionByRange(max(1, math.ceil(size / block_turns)), *order).sortWithinPartitions(*order)

    def nodes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = [b for b in batches if b.num_rows]
        if block:
            yield from block_nodes(pa.Table.from_batches(block), segment).to_batches(max_chunksize=10_000)

    found = materialize(ranged.mapInArrow(nodes_of, PARTS), "nodes")
    nodes, keys = found.filter("kind = 'node'"), found.filter("kind = 'key'")
    closed = nodes.filter("NOT parted")
    # Parts of open nodes meet; there are few, whatever the number of members.
    summed = [F.sum(c).alias(c) for c in ("n", "kids", "leaves", "saved")]
    same = [F.first(c).alias(c) for c in ("seg", "k1", "k2", "q1", "q2", "chars", "line1", "line2")]
    merged = materialize(nodes.filter("parted").groupBy(*NODE).agg(*summed, F.min("conv").alias("conv"), F.max("edge").alias("edge"), F.max("parent_conv").alias("parent_conv"), *same), "open")
    parents = [(F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")]
    born = merged.filter("depth > 0").select(*parents).unionByName(closed.filter((F.col("depth") > 1) & ((F.col("depth") - 1) % segment == 0)).select(*parents))
    born = born.groupBy(*NODE).agg(F.count(F.lit(1)).alias("born"))
    merged = merged.join(born, NODE, "left").withColumn("kids", F.col("kids") + F.coalesce("born", F.lit(0)))
    own = [(F.col("kids") == 0).cast("long").alias("own_leaves"), F.when(F.col("edge"), (F.col("n") - 1) * F.col("chars")).otherwise(0).alias("own_saved")]
    merged = materialize(merged.select("*", *own), "open")
    adding = merged.filter("own_leaves > 0 OR own_saved > 0")
    place = F.posexplode(F.arrays_zip("line1", "line2")).alias("step", "at")
    up = adding.filter("line1 IS NOT NULL").select((F.col("depth") - F.size("line1")).alias("top"), place, "own_leaves", "own_saved")
    up = up.groupBy((F.col("top") + F.col("step")).alias("depth"), F.col("at.line1").alias("p1"), F.col("at.line2").alias("p2")).agg(F.sum("own_leaves").alias("up_leaves"), F.sum("own_saved").alias("up_saved"))
    hashes = joined_hashes(nodes.filter("ends IS NOT NULL"))
    full = merged.join(up, NODE, "left").join(hashes, NODE, "left")
    full = full.select(
        *NODE, "q1", "q2", "parent_conv", "n", "conv", "kids", *[(F.col(c) + F.col(f"own_{c}") + F.coalesce(F.col(f"up_{c}"), F.lit(0))).alias(c) for c in ("leaves", "saved")],
        F.coalesce("told_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
    every = closed.select(full.columns).unionByName(full)
    if not keys.isEmpty():
        columns = ["seg", "k1", "k2", "conv", "leaves", "saved"]
        sums = keys.select(columns).unionByName(adding.filter("seg > 0").select("seg", "k1", "k2", "conv", F.col("own_leaves").alias("leaves"), F.col("own_saved").alias("saved")))
        sums = sums.groupBy("seg", "k1", "k2").agg(F.min("conv").alias("conv"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        more = materialize(later_segments(sums, rows, segment), "later")
        every = every.join(more, NODE, "left").withColumns({c: F.col(c) + F.coalesce(F.col(f"more_{c}"), F.lit(0)) for c in ("leaves", "saved")}).select(full.columns)
    # Parents that are open have the smallest member of all their parts; one row each.
    waiting = every.filter("parent_conv IS NULL")
    known = merged.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv").alias("found"))
    waiting = waiting.join(known, ["depth", "q1", "q2"], "left").withColumn("parent_conv", F.col("found")).select(full.columns)
    return every.filter("parent_conv IS NOT NULL").unionByName(waiting).select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").cast("long").alias("n_children"), F.col("leaves").cast("long").alias("n_leaves"),
        F.col("saved").cast("long").alias("saved_tokens"), "ends_sha256",
    )


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: One step of CRC-32 for each character of an id, eight bits each; the polynomial is fixed.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295::BIGINT) % 6"""
ORACLE = f"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
    md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS h, length(coalesce(text, ''))::BIGINT AS n FROM conversations WHERE conv_id IS NOT NULL),
  c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC} AS h FROM (SELECT DISTINCT conv_id FROM t)),
  r AS (SELECT c.conv_id, pos, 0 AS own, t.h, n FROM c JOIN t ON t.conv_id = c.base AND pos <= c.h UNION ALL SELECT c.conv_id, pos, 1, t.h, n FROM c JOIN t ON t.conv_id = c.conv_id AND pos > c.h),
  d AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(h, '') OVER w AS path, n FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos)),
  e AS (SELECT conv_id, depth, path, n, '' AS root FROM d UNION ALL SELECT conv_id, 0, '', 0, NULL FROM c),
  l AS (SELECT conv_id, max_by(path, depth) AS whole FROM e GROUP BY conv_id),
  k AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n FROM e GROUP BY path, depth),
  s AS (SELECT k.*, p.conv_id AS parent_conv_id, left(k.path, -32) AS above FROM k LEFT JOIN k p ON k.depth > 0 AND p.depth = k.depth - 1 AND p.path = left(k.path, -32)),
  kids AS (SELECT above, depth - 1 AS depth, count(*) AS n_children FROM s WHERE depth > 0 GROUP BY ALL),
  m AS (SELECT s.*, coalesce(n_children, 0) AS n_children FROM s LEFT JOIN kids ON kids.above = s.path AND kids.depth = s.depth),
  sub AS (SELECT left(m.path, 32 * u.i) AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * n)::BIGINT AS saved_tokens FROM m, LATERAL (SELECT unnest(range(0, m.depth + 1)) AS i) u GROUP BY 1),
  ends AS (SELECT whole, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM l GROUP BY whole)
  SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
  FROM m JOIN sub USING (path) LEFT JOIN ends ON ends.whole = m.path"""
