"""The n-gram join on families of near copies: no link lost, few rows met."""

import random

import pytest

from caseloom.llm import ngram_join
from tests.llm import brute


def family(seed, copies, words, changes):
    """Copies of one text with up to ``changes`` words changed; some changes are shared by several copies."""
    rng = random.Random(seed)
    base = [f"w{seed}x{k}" for k in range(words)]
    shared = [(rng.randrange(words), f"s{seed}x{k}") for k in range(8)]
    for _ in range(copies):
        text = list(base)
        for _ in range(rng.randrange(changes + 1)):
            at, word = rng.choice(shared) if rng.random() < 0.5 else (rng.randrange(words), f"u{rng.randrange(10**6)}")
            text[at] = word
        yield " ".join(text[: rng.choice([words, words, words - 1, words - 3])])


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_families_of_near_copies(spark, k, percent):
    texts = [t for seed, words in [(1, 30), (2, 70), (3, 140), (4, 12)] for t in family(seed, 120, words, 6)]
    rows = [((7 * i) % 1009, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngram_join.similar_groups(docs, k, percent)
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == brute.groups(rows, k, percent)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = ngram_join.similar_groups(docs, 3, 90)
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == brute.groups(rows, 3, 90)
