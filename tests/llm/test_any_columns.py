"""Columns of the caller with the names that operators use inside, and stop words as texts write them."""

import pytest
from pyspark.sql import functions as F

from caseloom.llm import line_dedup, mixing, ngram_join, quality_rules, shared
from tests.llm import brute
from tests.llm.test_operators import TEXTS

NAMES = ["_lines", "_kept", "_doc", "_stay", "_gone", "_id", "_words", "_at", "_row", "_windows", "_sorted", "doc", "n", "line", "h", "bits", "block"]


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def docs(plain):
    return plain.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in NAMES})


def kept_whole(rows):
    return all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in NAMES)


def test_unused_names(docs):
    assert shared.unused(docs, "_DOC", "fresh") == ["_DOC_", "fresh"]


def test_line_dedup_bears_any_columns(docs):
    got = line_dedup.dedup_lines(docs)
    rows = got.collect()
    assert got.columns == [*docs.columns, "n_removed_lines"] and kept_whole(rows)
    assert {r["doc_id"]: r["text"] for r in rows} == brute.surviving_lines(TEXTS)


def test_one_of_each_bears_any_columns(docs):
    rows = ngram_join.one_of_each(docs, 3, 90).collect()
    want = {d for d, (_, c) in brute.groups(TEXTS, 3, 90).items() if c == d}
    assert {r["doc_id"] for r in rows} == want and kept_whole(rows)


def test_quality_bears_any_columns(docs):
    got = quality_rules.quality(docs)
    rows = got.collect()
    assert set(docs.columns) <= set(got.columns) and kept_whole(rows)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert {r["doc_id"]: tuple(r[c] for c in names) for r in rows} == {d: brute.quality(t) for d, t in TEXTS}
    again = quality_rules.quality(got)
    assert sorted(again.columns) == sorted(got.columns) and again.count() == got.count()


def test_mix_bears_any_columns(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    got = mixing.apply_mix(docs, labels)
    assert got.columns == [*docs.columns, "rate", "copies"] and kept_whole(got.collect())


def test_stop_words_in_any_case_and_with_marks(spark):
    rows = [(1, "The and, AND of."), (2, "the and and of"), (3, "(the) \"la\" théâtre them"), (4, "... - *")]
    got = quality_rules.measures(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["n_stop_words"] for r in got.collect()} == {1: 4, 2: 4, 3: 2, 4: 0}
