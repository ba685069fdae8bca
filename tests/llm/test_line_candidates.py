"""Line dedup: candidates that reach the words, and how many of a family do."""

import random

from caseloom.llm import line_dedup

from tests.llm import brute


def judged(spark, monkeypatch, lines):
    """Pairs judged on their words; the lines left are checked against the plain version."""
    seen, close = [], line_dedup._close

    def counted(pairs, texts, percent):
        seen.append(pairs.count())
        return close(pairs, texts, percent)

    monkeypatch.setattr(line_dedup, "_close", counted)
    texts = [(k, line) for k, line in enumerate(lines)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert got == brute.surviving_lines(texts)
    return sum(seen)


def test_unlike_long_lines_are_not_judged(spark, monkeypatch):
    draw = random.Random(3)
    lines = [" ".join(f"w{k}" for k in draw.sample(range(800), 200)) for _ in range(30)]
    assert judged(spark, monkeypatch, lines) == 0


def test_family_of_variants_is_judged_once_a_line(spark, monkeypatch):
    draw = random.Random(5)
    lines = []
    for k in range(50):
        words = [f"b{i}" for i in range(60)]
        for i in draw.sample(range(60), 3):
            words[i] = f"x{k}-{i}"
        lines.append(" ".join(words + [f"y{k}-{i}" for i in range(k % 4)]))
    assert judged(spark, monkeypatch, lines) <= 3 * len(lines)


def test_other_white_space_parts_words(spark, monkeypatch):
    lines = ["a b c d e", "a\tb\x0bc\x0cd\re", " e  d c b a ", "a\tb f g h", "\t"]
    judged(spark, monkeypatch, lines)
