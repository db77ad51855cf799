"""A worker whose first and only rows are null or empty."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, jaccard, packing, quality, substrings, textkit
from graphloom.llm.queries import tokenizer_path


@pytest.fixture()
def fresh(monkeypatch):
    """Tables as a new worker has them."""
    monkeypatch.setattr(textkit, "_pow", {})


def test_powers_of_nothing(fresh):
    assert [len(x) for x in textkit.powers(0)] == [0, 0]
    assert textkit.prefix(np.zeros(0, np.uint8)).tolist() == [0]


def test_words_of_nothing(fresh):
    w, off, s = textkit.words(np.zeros(0, np.uint8), np.zeros(3, np.int64))
    assert len(w) == len(s) == 0 and off.tolist() == [0, 0, 0]
    h, soff = textkit.shingles(w, off, 5)
    assert len(h) == 0 and soff.tolist() == [0, 0, 0]


@pytest.fixture(scope="module")
def blank(spark):
    """Null and empty texts, each alone in a partition."""
    rows = [(k, t) for k, t in enumerate([None, "", None, "", "  ", "\n"])]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit(None).cast("string")).repartition(6, "doc_id")


def test_operators_on_blank_texts(spark, blank):
    links = jaccard.jaccard_links(blank).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in links) == [(k, k, 0) for k in range(6)]
    assert jaccard.keep_one(blank).count() == 6
    bench = spark.createDataFrame([(1, None), (2, "")], "item_id long, text string")
    assert {r._coverage for r in decontaminate.decontaminate(blank, bench).collect()} == {0.0}
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality.score(blank, labels).collect())
    cut = substrings.remove_repeats(blank, length=20).collect()
    assert sum(r.n_bytes for r in cut) == 3 and not any(r.spans for r in cut)
    pieces = packing.pack(blank, tokenizer_path()).collect()
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())
    assert len({p.doc_id for p in pieces}) == 6
