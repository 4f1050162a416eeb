"""Fitted operators by held-out accuracy, and nearest neighbours by brute force."""

from __future__ import annotations

import inspect
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import ODD, frame, prose
from glimmergrid.llm import language, neighbours, quality, toxicity
from glimmergrid.llm.common import held_out


def labels(spark, pairs, name):
    return spark.createDataFrame([(i, y) for i, y in pairs], f"doc_id long, {name} int")


# Toxicity


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_against_edit_distance():
    rng = random.Random(6)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(3, 8))) for _ in range(40)]
    entries = [toxicity.Entry(w, i % 4 == 0) for i, w in enumerate(dict.fromkeys(words))]
    automaton = toxicity.Automaton(entries, edits=1, least=5)
    for _ in range(3000):
        token = "".join(rng.choice("abc") for _ in range(rng.randint(1, 10)))
        want = {}
        for k, e in enumerate(entries):
            forms = [token[:n] for n in range(len(token) + 1)] if e.stem else [token]
            d = min(distance(e.text, f) for f in forms)
            if d <= (1 if len(e.text) >= 5 else 0):
                want[k] = d
        assert dict(automaton.hits(token)) == want, (token, want)


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(7)
    bad = ["gromble", "snarfing", "vexwood", "klopter"]
    texts, marks = [], []
    for i in range(400):
        text, toxic = prose(i, 60).split(" "), i % 4 == 0
        for _ in range(rng.randint(1, 3)) if toxic else ():
            word = rng.choice(bad)
            at = rng.randrange(1, len(word))
            text.insert(rng.randrange(len(text)), rng.choice([word, word, word[:at] + word[at + 1 :], word + "s", word.upper()]))
        if i % 4 == 1:
            text.insert(20, f'"a {rng.choice(bad)} word"')
        texts.append(" ".join(text))
        marks.append(int(toxic))
    docs = frame(spark, texts)
    model = toxicity.fit_toxicity(docs, labels(spark, enumerate(marks), "toxic"))
    assert {e.text for e in model.entries} & set(bad)
    rows = toxicity.score_toxicity(docs, model, keep=("lang", "mark")).withColumn("held", held_out(F.col("doc_id"))).filter("held").collect()
    right = sum((r["score"] >= 0.5) == bool(marks[r["doc_id"]]) for r in rows)
    assert len(rows) > 50 and right / len(rows) >= 0.9
    odd = toxicity.score_toxicity(frame(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] < 0.5 for r in odd)
    assert toxicity.score_toxicity(frame(spark, []), model).count() == 0


def test_toxicity_without_labels(spark):
    docs = frame(spark, ["a b", None])
    for marks in ([], [(0, 0)]):
        model = toxicity.fit_toxicity(docs, labels(spark, marks, "toxic"))
        assert len({r["score"] for r in toxicity.score_toxicity(docs, model).collect()}) == 1


def test_words_cut_by_digits_and_marks():
    entries = [toxicity.Entry("gromble", False), toxicity.Entry("snarf", True), toxicity.Entry("vex", False)]
    automaton = toxicity.Automaton(entries)
    for text, want in [("gr0mble", {(0, 1)}), ("a g.r.o.m.b.l.e b", {(0, 1)}), ("grom-ble", {(0, 1)}), ("sn@rfing", {(1, 1)}), ("v3x", set()), ("v.ex", set())]:
        assert {(k, e) for k, e, _ in toxicity.text_hits(automaton, text, 6)} == want, text
    for text, want in [("gromble-like", [(0, 0, False)]), ("well-snarfing.", [(1, 0, False)]), ('say "a gr0mble word" now', [(0, 1, True)]), ("it's end.next 3x4", [])]:
        assert toxicity.text_hits(automaton, text, 6) == want, text


def test_rarely_misspelled_words_count():
    none = toxicity.weights((50, 0), (0, 0), 100, 100, 4.0)
    assert none[0] > none[1] > 1
    assert none[1] > toxicity.weights((50, 0), (0, 1), 100, 100, 4.0)[1] > 0
    assert toxicity.weights((50, 0), (0, 9), 100, 100, 4.0)[1] == 0
    assert toxicity.weights((50, 0), (9, 0), 100, 100, 4.0)[1] > none[1]


def test_unseen_misspelling_is_scored(spark):
    texts = [prose(i, 30) + (" gromble" if i % 4 == 0 else "") for i in range(200)]
    model = toxicity.fit_toxicity(frame(spark, texts), labels(spark, [(i, int(i % 4 == 0)) for i in range(200)], "toxic"))
    told = toxicity.score_toxicity(frame(spark, ["so grombel", "so grmble", "so gr0mble", "so what"]), model).orderBy("doc_id").collect()
    assert told[1]["score"] > told[3]["score"] and told[2]["score"] > told[3]["score"] and told[1]["abuse"] > 0


def test_stems_are_one_explanation():
    stems = ["gromble"[:n] + "*" for n in (4, 5, 6, 7)] + ["gromble", "grombles"]
    odds = dict.fromkeys(stems, 6.0) | {"vexwood": 4.0, "klopter": 3.5}
    got = {(e.text, e.stem) for e in toxicity.cover([list(odds)] * 10, odds, 5)}
    assert {("vexwood", False), ("klopter", False)} <= got


# Quality


def test_quality_on_held_out_rows(spark):
    rng = random.Random(9)
    texts, marks = [], []
    for i in range(400):
        text, good = prose(i, rng.randint(20, 80)), i % 3 > 0
        if not good:
            text = rng.choice([text.upper().replace(" ", "!! "), " ".join(w for w in text.split() for _ in range(4)), text.replace(" ", " | ")])
        texts.append(text)
        marks.append(int(good))
    docs = frame(spark, texts)
    model = quality.fit_quality(docs, labels(spark, enumerate(marks), "quality"))
    rows = quality.score_quality(docs, model, keep=("lang",)).withColumn("held", held_out(F.col("doc_id"))).filter("held").collect()
    assert sum((r["score"] >= 0.3) == bool(marks[r["doc_id"]]) for r in rows) / len(rows) >= 0.95
    again = quality.fit_quality(docs.repartition(3), labels(spark, enumerate(marks), "quality"))
    assert np.allclose(again.weights, model.weights)
    odd = quality.score_quality(frame(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    assert quality.score_quality(frame(spark, []), model).count() == 0
    single = quality.fit_quality(docs, labels(spark, [(i, 1) for i in range(400)], "quality"))
    assert len({round(r["score"], 9) for r in quality.score_quality(docs, single).collect()}) == 1


def test_ngrams_are_distinct_and_repeatable():
    for text in ODD:
        found = quality.ngrams(text or "")
        assert len(set(found.tolist())) == len(found) and (np.sort(found) == np.sort(quality.ngrams(text or ""))).all()


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((200, 5))
    y = (x @ np.array([1.0, -2, 0.5, 0, 3]) > 0).astype(int)
    w, b = quality.dual_coordinate_descent([np.arange(5)] * 200, list(x), y, 5, rounds=100)
    assert ((x @ w + b > 0) == y).mean() >= 0.97


# Languages


def alphabet(name: str, i: int) -> str:
    rng = random.Random(f"{name}{i}")
    parts = {"x": ["ka", "lo", "mi", "tu", "ren"], "y": ["sch", "ung", "ein", "ber", "tz"], "z": ["ção", "nh", "os", "ar", "é"]}[name]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(12)).capitalize() + "."


def test_languages_on_held_out_rows(spark):
    names = [("x", "y", "z")[i % 3] for i in range(300)]
    texts = [alphabet(n, i) for i, n in enumerate(names)]
    docs = frame(spark, texts).withColumn("lang", F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("z")), (F.col("doc_id") % 3 + 1).cast("int")))
    model = language.fit_languages(docs)
    rows = language.identify(docs, model).withColumn("held", held_out(F.col("doc_id"))).filter("held").collect()
    assert all(r["lang_pred"] == names[r["doc_id"]] and r["score"] > 0.9 and r["accepted"] for r in rows)
    odd = {r["doc_id"]: r for r in language.identify(frame(spark, ODD), model, keep=("mark",)).collect()}
    for i, text in enumerate(ODD):
        assert (odd[i]["lang_pred"] == "und") == (not any(map(str.isalpha, text or ""))), text
    assert not odd[11]["accepted"]
    assert language.identify(frame(spark, []), model).count() == 0
    nothing = language.fit_languages(frame(spark, []))
    assert [r["lang_pred"] for r in language.identify(docs.limit(2), nothing).collect()] == ["und", "und"]


def test_kneser_ney_sums_to_one():
    text = language.symbols("abra cadabra barbara arab " * 3)
    codes, n = np.unique(language.trigrams(text), return_counts=True)
    model = language.kneser_ney({"a": (codes, n)})
    letters = sorted(set(text.tolist()))
    size = len(letters)
    for a in letters:
        for b in letters:
            every = np.array([(int(a) << 42) | (int(b) << 21) | int(c) for c in letters], np.uint64)
            total = np.exp(model.log_probabilities(every)).sum()
            unseen = math.exp(model.unseen[0])
            assert total <= 1 + 1e-5 and total >= 1 - unseen * 3, (a, b, total, size)


def test_trigram_counts(spark):
    texts = ["Abc abc!", None, "é", "x1y"]
    got = {(r["lang"], r["code"]): r["n"] for r in language.count_trigrams(frame(spark, texts)).collect()}
    want = Counter()
    for t in filter(None, texts):
        s = "  " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " "
        for i in range(len(s) - 2):
            want["en", (ord(s[i]) << 42) | (ord(s[i + 1]) << 21) | ord(s[i + 2])] += 1
    assert got == dict(want)


def test_no_trigram_is_cut(spark):
    """The old cut, made small: rare languages lost their trigrams first, and with them their lower orders."""
    hot, rare = [alphabet("x", i) for i in range(200)], [alphabet("z", 1), alphabet("z", 2)]
    every = frame(spark, hot + rare).withColumn("lang", F.when(F.col("doc_id") < 200, "x").otherwise("z"))
    model = language.fit_languages(every, hold_out=lambda i: F.lit(False))
    counts = language.count_trigrams(every).collect()
    assert "max_ngrams" not in inspect.signature(language.fit_languages).parameters
    assert len(model.trigrams.values) == len(counts) and model.languages == ["x", "z"]
    assert model.predict([alphabet("z", 3)])[0] == ["z"]
    by = {g: sorted((r["code"], r["n"]) for r in counts if r["lang"] == g) for g in "xz"}
    want = language.kneser_ney({g: (np.array([c for c, _ in v], np.uint64), np.array([n for _, n in v])) for g, v in by.items()})
    assert np.allclose(model.cross_entropies(hot[:5] + rare), want.cross_entropies(hot[:5] + rare))


def test_calibration_on_all_rows(spark):
    """More rows than the old sample of 8,000, and ids that its hash put in or out together; a rare language is calibrated, too."""
    names = ["z" if i % 5_000 == 7 else "xy"[i % 2] for i in range(20_000)]
    texts = [None if i == 3 else "12" if i == 4 else " ".join(alphabet(n, i).split()[: 1 + i % 3]) for i, n in enumerate(names)]
    rows = [(None if i % 3 == 0 else i // 2, t, n) for i, (t, n) in enumerate(zip(texts, names))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit_languages(docs, hold_out=lambda i: F.lit(False))
    h = model.cross_entropies(texts)
    own = np.array([model.languages.index(n) for n in names])
    good = ~np.isnan(h).any(axis=1)
    assert good.sum() == 19_998 and model.languages == ["x", "y", "z"]
    h, own = h[good], own[good]
    want = [h[own == k, k].mean() + 4 * max(h[own == k, k].std(), 0.05) for k in range(3)]
    assert np.allclose(model.limits, want, rtol=1e-9, atol=0)

    def fit(t):
        return sum(max(math.log(p), math.log(1e-6)) for p in language.softmax(-h * t)[np.arange(len(h)), own])

    assert model.temperature == max((2 ** (k / 2) for k in range(18)), key=fit)


def test_languages_without_texts(spark):
    docs = frame(spark, [alphabet("x", 0), alphabet("x", 1), None]).withColumn("lang", F.when(F.col("doc_id") == 2, "q").otherwise("x"))
    assert language.fit_languages(docs, hold_out=lambda i: F.lit(False)).languages == ["x"]


# Nearest neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((1500, 12)) * rng.uniform(0.5, 2, 1500)[:, None]
    v[100:400] = v[99]
    rows = [(i, [float(x) for x in r], 1) for i, r in enumerate(v)]
    rows += [(2001, None, 1), (2002, [0.0] * 12, 1), (2003, [1.0, None] + [0.0] * 10, 1), (2004, [float("nan")] * 12, 1), (2005, [float("inf")] * 12, 1), (2006, [1.0], 1), (None, [1.0] * 12, 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = neighbours.nearest(vectors, lambda i: i % 20 == 0, k=10, cell_rows=200).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], {})[r["rank"]] = r
    assert set(by) == set(range(0, 1500, 20))
    hits = 0
    for q, ranks in by.items():
        scores = np.round(v @ v[q], 11)
        scores[q] = -np.inf
        want = np.lexsort((np.arange(1500), -scores))[:10].tolist()
        found = [ranks[n + 1]["vec_id"] for n in range(10)]
        hits += len(set(want) & set(found))
        assert all(abs(ranks[n + 1]["score"] - v[q] @ v[found[n]]) < 1e-9 for n in range(10))
    assert hits / (10 * len(by)) >= 0.95


def test_queries_of_a_cell_are_cut(spark):
    blocks = spark.range(50).selectExpr("1 AS cell", "CAST(id % 2 AS int) AS part", "id")
    parts = spark.createDataFrame([(1, 2), (2, 1)], "cell int, parts int")
    queries = spark.range(1000).selectExpr("id AS query_id", "1 AS cell").union(spark.range(5).selectExpr("id AS query_id", "2 AS cell"))
    met, sent = neighbours.met_in_blocks(blocks, parts, queries, 100)
    assert max(r["count"] for r in sent.groupBy("cell", "part", "share").count().collect()) < 200
    pairs = met.join(sent, ["cell", "part", "share"]).groupBy("id", "query_id").count().collect()
    assert len(pairs) == 50 * 1000 and all(r["count"] == 1 for r in pairs)


def test_visits_are_not_broadcast(spark, tmp_path):
    """A table of 200,000 visits has few bytes, but it goes through the driver if it is broadcast."""
    spark.range(200_000).selectExpr("id DIV 100 AS query_id", "CAST(id % 100 AS int) AS cell", "1.0D AS worst").write.parquet(str(tmp_path / "visits"))
    spark.range(2_000).selectExpr("id AS query_id", "array(1.0D, CAST(id AS double)) AS vector").write.parquet(str(tmp_path / "asked"))
    visits, asked = (spark.read.parquet(str(tmp_path / n)) for n in ("visits", "asked"))
    met = neighbours.with_vectors(visits, asked)
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    assert met.count() == 200_000 and met.filter("vector[1] <> query_id").isEmpty()


def test_few_neighbours(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.nearest(vectors, lambda i: i == 0, k=20).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2)]
    assert neighbours.nearest(vectors.limit(0), lambda i: i == 0).count() == 0
    assert neighbours.nearest(vectors.limit(1), lambda i: i == 0).count() == 0


def test_chi_square():
    assert neighbours.chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=0.05)
