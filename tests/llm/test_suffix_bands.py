"""Suffix dedup: what reaches the suffix arrays is small, and nothing that repeats is left out."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from caseloom.llm import suffix_dedup
from caseloom.llm.suffix_arrays import permuted_prefixes, suffix_array
from tests.llm import brute

LENGTH = suffix_dedup.LENGTH


def near_copies(seed, families=3, copies=6):
    """Documents of repeated passages, each with a few bytes changed, left out or moved, and a few of one short cycle."""
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdefgh é") for _ in range(400)) for _ in range(families)] + ["xy " * 90]
    texts = []
    for _ in range(copies * len(passages)):
        text = ""
        for _ in range(rng.randint(1, 2)):
            part = list(rng.choice(passages))
            for _ in range(rng.choice([0, 1, 2, 5])):
                part[rng.randrange(len(part))] = rng.choice(["", "a", "q", "zz"])
            at = rng.choice([0, 0, rng.randrange(len(part))])
            text += "".join(part[at:] + part[:at])
        texts.append(text)
    return list(enumerate(texts))


def marked(docs):
    """Rows of anchors: dicts of the columns of the marks, and the bytes of the texts."""
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs], pa.int64()), pa.array([t for _, t in docs])], names=["doc", "text"])
    return [row for out in suffix_dedup._mark(iter([batch])) for row in out.to_pylist()], {d: t.encode() for d, t in docs}


def contexts(docs):
    """The different contexts of each anchor in batches, as they are sorted before the shards."""
    rows, raw = marked(docs)
    found = {}
    for r in sorted(rows, key=lambda r: (r["doc"], r["at"])):
        if not r["sure"]:
            found.setdefault((r["h"], r["c"]), (r["h"], r["doc"], r["at"] - r["l"], r["l"], raw[r["doc"]][r["at"] - r["l"] : r["at"] + r["r"]]))
    rows = sorted(found.values())
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.binary()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["h", "doc", "start", "l", "context"])
    return [batch.slice(i, 5) for i in range(0, len(rows), 5)], rows


@pytest.mark.parametrize("seed", range(5))
def test_every_string_stands_in_a_context_that_marks_it(seed):
    docs = near_copies(seed)
    rows, raw = marked(docs)
    held = {(r["doc"], k) for r in rows for k in range(r["at"] - r["l"], r["at"] + r["r"] - LENGTH + 1)}
    assert held == {(d, k) for d, b in raw.items() for k in range(len(b) - LENGTH + 1)}
    by_context = {}
    for r in rows:
        if r["sure"]:
            continue
        got = raw[r["doc"]][r["at"] - r["l"] : r["at"] + r["r"]]
        assert by_context.setdefault((r["h"], r["c"]), got) == got
    # Without cycles each string marks one place and stands in one context.
    plain = "".join(random.Random(seed).choices("abcdefgh é", k=3000))
    alone, _ = marked([(1, plain)])
    assert sum(r["l"] + r["r"] - LENGTH + 1 for r in alone) == len(plain.encode()) - LENGTH + 1


@pytest.mark.parametrize("shard", [1, 3000, 2 << 20])
def test_few_bytes_reach_the_suffix_arrays(monkeypatch, shard):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    handed = []
    whole = suffix_dedup.repeated_in
    monkeypatch.setattr(suffix_dedup, "repeated_in", lambda c, doc, start: handed.extend(c) or whole(c, doc, start))
    batches, rows = contexts(near_copies(1, copies=20))
    list(suffix_dedup._shards(iter(batches)))
    assert 0 < sum(map(len, handed)) < sum(len(r[-1]) for r in rows) * 2 / 3
    handed.clear()
    # The same 32 bytes among others share no string of 100: no suffix array at all.
    rng = random.Random(3)
    rows = [(5, d, 0, 68, bytes(rng.choices(range(97, 123), k=68)) + b"a" * 32 + bytes(rng.choices(range(97, 123), k=68))) for d in range(50)]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.binary()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["h", "doc", "start", "l", "context"])
    assert list(suffix_dedup._shards(iter([batch]))) == [] and not handed


def test_near_copies_lose_what_a_plain_search_removes(spark):
    docs = near_copies(7, copies=10)
    got = suffix_dedup.dedup_spans(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    got = got.select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == brute.repeats(docs)


def test_common_prefixes_and_suffix_order_of_cycles():
    rng = np.random.default_rng(5)
    for n, values in ((1, 2), (2, 1), (300, 1), (300, 2), (300, 5), (300, 250)):
        t = rng.integers(0, values, n).astype(np.uint8)
        for t in (t, np.tile(t[: 1 + n // 9], 9)):
            order = suffix_array(t, 256)
            assert order.tolist() == suffix_array(t, 1000).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tobytes())
            for most in (100, 13, 8):
                want = [0] * len(t)
                for a, b in zip(order[1:], order[:-1]):
                    while want[a] < most and max(a, b) + want[a] < len(t) and t[a + want[a]] == t[b + want[a]]:
                        want[a] += 1
                assert permuted_prefixes(t, order, most).tolist() == want
