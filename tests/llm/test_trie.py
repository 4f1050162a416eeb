"""The trie of conversations' prefixes against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from glimmergrid.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, conv string, n double"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 3, "x", 0.5) for r in rows], SCHEMA)


def brute(rows, family=100, most=6):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    full = {}
    for c, mine in own.items():
        base = c - (c % family if c >= 0 else -(-c % family))
        h = zlib.crc32(str(c).encode()) % most
        full[c] = tuple(own.get(base, [])[:h] + mine[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in full.items():
        ends[seq].append(c)
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, held in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(held) - 1) * len(p[-1][1]) if p else 0
    sha = {p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest() for p in members}
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p], sha[p]) for p, m in members.items())


def told(spark, rows, **more):
    df = prefix_trie.prefix_trie(frame(spark, rows), **more)
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())


def conversations(seed, n, kinds=3, longest=7, step=7):
    rng = random.Random(seed)
    words = ["", "é", "one", "two words", "\U0001f600 four"][:kinds]
    return [(c * step % 977, t, rng.choice(["user", "bot"]) if rng.random() < 0.2 else "user", rng.choice(words)) for c in range(n) for t in range(rng.randint(1, longest))]


@pytest.mark.parametrize("segment, block_turns", [(256, 200_000), (256, 40), (3, 40), (2, 15), (1, 30)])
def test_against_brute_force(spark, segment, block_turns):
    rows = conversations(segment, 60) + [(2000 + i, t, "user", "one") for i in range(12) for t in range(9)]
    assert told(spark, rows, segment=segment, block_turns=block_turns) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "x"), (None, None, None, None), (5, None, None, None), (5, 2, "user", None), (5, 1, None, "b"), (7, 1, "user", "z"), (7, 1, "user", "a"), (7, 1, "bot", "z"), (7, 1, "user", "a")]
    rows += [(-5, t, "user", "n") for t in range(8)] + [(-105, t, "user", "n") for t in range(3)] + [(-100, 0, "user", "base"), (0, 0, "user", "base"), (0, -3, "bot", "first")]
    rows += [(c, 0, "user", "gone") for c in range(300, 320)] + [(9, t, "user", "long " * 20_000 if t == 1 else "s") for t in range(4)]
    assert told(spark, rows) == brute(rows)
    assert told(spark, rows, segment=2, block_turns=10) == brute(rows)
    assert {r[1] for r in brute(rows)} > {0, 1, 2}


def test_copies_and_a_long_conversation(spark):
    """A third of all rows in one conversation, and a third of all conversations equal, over many blocks."""
    rows = [(100 * i, t, "user", f"t{t}") for i in range(1, 40) for t in range(3)] + [(7, t, "user", f"u{t % 5}") for t in range(150)] + conversations(9, 12)
    assert told(spark, rows, segment=16, block_turns=30) == brute(rows)


def test_turnless_and_empty(spark):
    gone = [c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 >= 1][:5]
    rows = [(c, 0, "user", "x") for c in gone]
    assert told(spark, rows) == brute(rows) and len(brute(rows)) == 1
    assert told(spark, []) == [] and told(spark, [(None, 1, "a", "b")]) == []


def test_range_minima():
    rng = np.random.default_rng(1)
    for m in (1, 2, 3, 7, 8, 33):
        values = rng.integers(-1, 4, m)
        minima = prefix_trie.RangeMinima(values)
        rows = np.repeat(np.arange(m), 5)
        depth = np.tile(np.arange(5), m)
        for i, d, a, b in zip(rows, depth, minima.left(rows, depth), minima.right(rows, depth)):
            while i and values[i] >= d:
                i -= 1
            assert a == i
        for i, d, b in zip(rows, depth, minima.right(rows, depth)):
            while i + 1 < m and values[i + 1] >= d:
                i += 1
            assert b == i
        first = rng.integers(0, m, 20)
        last = np.minimum(m - 1, first + rng.integers(0, m, 20))
        assert minima.least(first, last).tolist() == [values[a : b + 1].min() for a, b in zip(first, last)]


def test_query(spark, tmp_path):
    rows = conversations(3, 150, step=1)
    frame(spark, rows).select("conv_id", "turn", "role", "text").write.parquet(str(tmp_path / "conversations.parquet"))
    found = prefix_trie.op13_trie(spark, str(tmp_path)).collect()
    assert sorted(tuple(-1 if x is None else x for x in r) for r in found) == brute(rows)
