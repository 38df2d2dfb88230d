"""Columns that are called like an operator's own ones neither break it nor change what it finds."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_dedup import words
from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.quality import METRICS, quality_cascade
from tidemark.llm.stages import ngram_join
from tidemark.llm.url_filter import filter_urls

HITS = ["_h", "_d", "_hit", "_items", "_found", "items", "N_HIT", "n_words", "hits"]
RULES = ["kept", "rejected_by", "word_chars", "N_words"]
PAGES = ["key", "_key", "alias_verdict", "_fit", "_alias_key", "_own", "_said", "host", "verdict", "id"]


def texts(spark):
    rng = random.Random(5)
    rows = [(k, words(rng, 40)) for k in range(6)]
    rows.append((6, rows[0][1] + " and more"))
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


@pytest.mark.parametrize("block", [1, 1 << 21])
@pytest.mark.parametrize("name", HITS)
def test_decontamination(spark, name, block):
    docs, rows = texts(spark)
    items = spark.createDataFrame([(1, " ".join(rows[0][1].split(" ")[:12])), (2, "x y z")], "item_id long, text string")
    out = decontaminate(docs.withColumn(name, F.lit("mine")), items, block=block)
    assert {r.doc_id for r in out.where("n_hit > 0").collect()} == {0, 6}
    if name.lower() not in ("n_words", "n_hit", "items"):
        assert {r[name] for r in out.collect()} == {"mine"}
    assert len({c.lower() for c in out.columns}) == len(out.columns)


@pytest.mark.parametrize("name", RULES)
def test_quality_rules(spark, name):
    docs, _ = texts(spark)
    want = sorted((r.doc_id, r.kept, r.n_words) for r in quality_cascade(docs, metrics=True).collect())
    out = quality_cascade(docs.withColumn(name, F.lit("mine")), metrics=True)
    assert sorted((r.doc_id, r.kept, r.n_words) for r in out.collect()) == want
    if name.lower() not in ("kept", "rejected_by", *METRICS):
        assert {r[name] for r in out.collect()} == {"mine"}


@pytest.mark.parametrize("name", PAGES)
def test_url_filter(spark, name):
    html = '<link rel="canonical" href="http://bad.net/fr/1">'
    pages = spark.createDataFrame(
        [(1, "http://a.org/x", html), (2, "http://b.org/y", ""), (3, "http://bad.net/fr/1", None)], "page_id long, url string, html string")
    out = filter_urls(pages.withColumn(name, F.lit("mine")), [("net", "/fr/", "block")])
    assert sorted((r.page_id, r.verdict) for r in out.collect()) == [(1, "block"), (2, "allow"), (3, "block")]
    if name not in ("host", "verdict"):
        assert {r[name] for r in out.collect()} == {"mine"}


@pytest.mark.parametrize("name", ["row", "order", "doc", "_order", "component_id", "_first", "_h", "id"])
def test_ngram_stage(spark, name):
    docs, rows = texts(spark)
    frame = docs.union(docs.limit(2)).withColumn(name, F.lit("mine"))
    out = ngram_join(spark, frame, "")
    assert out.columns == frame.columns
    assert sorted((r.doc_id, r[name]) for r in out.collect()) == [(k, "mine") for k in range(6)]


def test_the_stages_are_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "BPE encoding and decoding"]
