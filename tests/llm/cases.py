"""Rows that every operator must handle."""

from __future__ import annotations

import random

WORDS = "the of and river stone light under seven morning quiet garden window paper cloud winter letter road garden simple answer".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.sample("abcdefghilmnoprstu", rng.randint(2, 7))) if rng.random() < 0.7 else rng.choice(WORDS) for _ in range(n))


def frame(spark, texts, sources=None, start=0):
    """``documents`` of the given texts, with extra columns whose names operators use themselves."""
    rows = [(start + i, t, "en", (sources or ["s"] * len(texts))[i], len(t) if t is not None else None, 1, "x", 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id long, mark string, score double")


ODD = [None, "", " ", "\n\n", "a", "é", "ß" * 30, "word " * 40_000, "\t\x0b\f\r", "one two three four", "á ë", "日本語 テキスト", "\U0001f600 smile", "\U0001f600", "\U00020000"]
