"""Hierarchical packing: the planner, and whole results against the tokenizer."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cases import ODD, frame, prose
from glimmergrid.llm import tiers


def tokens(texts, end=0):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [whole.encode(t or "", add_special_tokens=False).ids + [end] for t in texts]


def little(ids):
    return np.array(ids, "<u4").tobytes()


def check_sequences(rows, capacity=1024):
    """Offsets are gapless from 0, and every sequence is a power of two."""
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"], r["tier"], r["step_group"]))
    for parts in held.values():
        at = 0
        for offset, length, _, _ in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity and at & at - 1 == 0
        assert {t for _, _, t, _ in parts} == {at} and len({g for *_, g in parts}) == 1
    return held


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 60), max_size=12))
def test_plan_places_every_token_once(histogram):
    plan = tiers.TierPlan(histogram, 64)
    seen = Counter()
    for run in plan.runs:
        assert run.used == run.tier and run.tier & run.tier - 1 == 0 and run.tier <= 64
        for lot in run.lots:
            assert lot.count == run.count
            for nth in range(lot.first, lot.first + lot.count):
                for t in range(lot.start, lot.start + lot.length):
                    seen[lot.origin, nth, t] += 1
    assert set(seen.values()) <= {1} and len(seen) == sum(n * c for n, c in histogram.items())
    assert sorted(f for r in plan.runs for f in range(r.first, r.first + r.count)) == list(range(plan.sequences))


def test_plan_of_many_pieces_is_small():
    rng = random.Random(1)
    for histogram in ({700: 10**9}, {n: rng.randint(1, 10 ** rng.randint(0, 9)) for n in range(1, 1025)}, {3: 10**12, 1000: 7}):
        plan = tiers.TierPlan(histogram)
        assert sum(r.tier * r.count for r in plan.runs) == sum(n * c for n, c in histogram.items())
        assert len(plan.places()) < tiers.SENT


def test_whole_pieces_come_before_cuts():
    plan = tiers.TierPlan({1000: 5, 24: 5, 600: 3, 300: 3, 124: 3})
    assert {(r.tier, tuple(sorted(x.length for x in r.lots)), r.count) for r in plan.runs} == {(1024, (24, 1000), 5), (1024, (124, 300, 600), 3)}


@pytest.mark.parametrize("with_ids", [True, False])
def test_pieces_hold_every_token(spark, with_ids):
    rng = random.Random(4)
    texts = ODD + [prose(i, rng.choice([3, 40, 200, 400, 900])) for i in range(60)] + [prose(1, 700)] * 5 + ["<|endoftext|> two  spaces"]
    want = tokens(texts)
    rows = tiers.pack_tiers(frame(spark, texts), with_ids=with_ids, step_tokens=4096).collect()
    check_sequences(rows)
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    assert set(pieces) == set(range(len(texts)))
    for i, ids in enumerate(want):
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            part = ids[at : at + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(little(part))
            assert bytes(r["ids"]) == little(part) if with_ids or r["ids"] is not None else r["length"] == 1024
            at += r["length"]
        assert at == len(ids)


def test_step_groups_are_balanced(spark):
    rng = random.Random(8)
    rows = tiers.pack_tiers(frame(spark, [prose(i, rng.choice([5, 30, 200])) for i in range(400)]), capacity=256, step_tokens=1024).collect()
    held = check_sequences(rows, 256)
    by_group = defaultdict(list)
    for parts in held.values():
        by_group[parts[0][3]].append((parts[0][2], sum(p[1] ** 2 for p in parts)))
    assert sorted(by_group) == list(range(len(by_group)))
    for tier in {t for p in by_group.values() for t, _ in p}:
        groups = [p for p in by_group.values() if p[0][0] == tier]
        sizes, costs = [len(p) for p in groups], [sum(c for _, c in p) for p in groups]
        assert max(sizes) - min(sizes) <= 1 and max(sizes) * tier <= max(tier, 1024)
        assert max(costs) - min(costs) <= 2 * tier * tier
    assert all(len({t for t, _ in p}) == 1 for p in by_group.values())
    # The long tier is spread over the run, not put at one end.
    places = [g for g, p in by_group.items() if p[0][0] == 256]
    assert len(places) > 3 and max(places) - min(places) > 0.6 * len(by_group)


def test_null_and_equal_rows(spark):
    rows = [(None, None)] * 3 + [(None, "a b")] * 2 + [(5, prose(1, 300))] * 40 + [(5, "other"), (6, None)]
    docs = spark.createDataFrame([(i, t, 9, b"x", 1) for i, t in rows], "doc_id long, text string, length int, ids binary, bucket int")
    told = tiers.pack_tiers(docs).collect()
    held = check_sequences(told)
    want = Counter((i, len(x)) for (i, _), x in zip(rows, tokens([t for _, t in rows])))
    assert Counter({k: n // k[1] for k, n in sum((Counter({(r["doc_id"], r["doc_tokens"]): r["length"]}) for r in told), Counter()).items()}) == want
    assert sum(p[1] for parts in held.values() for p in parts) == sum(n * c for (_, n), c in want.items())
    assert tiers.pack_tiers(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        tiers.pack_tiers(docs, capacity=1000)


def test_query(spark, tmp_path):
    """The registered query over a small table on disk."""
    texts = ODD + [prose(i, 150) for i in range(10)]
    frame(spark, texts).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    rows = tiers.op12_tiers(spark, str(tmp_path)).collect()
    check_sequences(rows)
    want = tokens(texts)
    assert sum(r["length"] for r in rows) == sum(map(len, want))
    assert all(r["ids_crc32"] == zlib.crc32(little(want[r["doc_id"]][r["start"] : r["start"] + r["length"]])) for r in rows)
