"""The pipeline's stages, each on its own input, and the registered queries."""

from __future__ import annotations

import os
import random

import duckdb
import pytest

import corpus_pipeline
from cases import ODD, frame, prose
from glimmergrid.llm import registry
from test_text_ops import brute_lines, check_packing

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    told = con.execute(registry.ORACLES[name])
    names = [d[0] for d in told.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, told.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, SF)
    want = spark.read.parquet(f"{SF}/documents.parquet").count()
    n = df.count()
    assert n == want if name not in ("op7_packing", "op10_neighbours", "op12_tiers") else n >= want


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "jaccard", "mixing", "packing"]


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(corpus_pipeline.COLUMNS).cache()
    before = {r["doc_id"]: r for r in docs.collect()}
    clean = {r["doc_id"]: r for r in corpus_pipeline.drop_toxic(spark, docs, SF).collect()}
    assert 0.8 * len(before) < len(clean) <= len(before) and all(clean[i] == before[i] for i in clean)
    order = sorted(before)
    want = brute_lines([before[i]["text"] for i in order])
    lines = {r["doc_id"]: r for r in corpus_pipeline.drop_repeated_lines(spark, docs, SF).collect()}
    lost_all = {i for n, i in enumerate(order) if want[n] == "" and before[i]["text"]}
    assert set(lines) == set(before) - lost_all
    assert all(lines[i]["text"] == want[n] and lines[i]["n_chars"] == len(want[n]) for n, i in enumerate(order) if i in lines)
    single = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    told = registry.QUERIES["op6_jaccard"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in single.collect()) == sorted({r["class_id"] for r in told})
    mixed = corpus_pipeline.mix(spark, docs, SF).collect()
    taken = {r["doc_id"]: r["taken"] for r in registry.QUERIES["op9_mixing"](spark, SF).collect()}
    words = dict.fromkeys(taken, 0)
    for r in mixed:
        words[r["doc_id"]] += len(r["text"].split())
    assert words == taken
    texts = [before[i]["text"] for i in order]
    check_packing(texts, corpus_pipeline.pack_sequences(spark, frame(spark, texts), SF).collect())


def test_whole_pipeline(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert sum(r["length"] for r in rows) > 0.9 * 1024 * len({r["sequence_id"] for r in rows})


def test_stages_on_odd_rows(spark):
    rng = random.Random(1)
    texts = ODD + [prose(rng.random(), 30) for _ in range(5)] + [ODD[7]]
    docs = frame(spark, texts, ([None, "a"] * len(texts))[: len(texts)]).select(corpus_pipeline.COLUMNS)
    docs = docs.union(docs.limit(3)).union(spark.createDataFrame([(None, None, None, None, None)], docs.schema))
    for name, stage in corpus_pipeline.STAGES:
        told = stage(spark, docs, SF)
        assert name == "packing" or told.columns == corpus_pipeline.COLUMNS
        assert told.count() > 0
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_near_duplicates_with_odd_ids(spark):
    """No text is lost to a repeated or null id, and one of each class stays."""
    near = prose(1, 60)
    rows = [(3, prose(2, 40)), (3, prose(3, 40)), (3, prose(3, 40)), (None, near), (None, near + " end"), (7, prose(4, 50)), (None, prose(4, 50)), (8, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()]
    assert len(got) == 6 and {(3, prose(2, 40)), (3, prose(3, 40)), (7, prose(4, 50)), (8, None), (9, "")} <= set(got)
    assert len({t for i, t in got if i is None}) == 1
