"""Vector codes against a plain version in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from caseloom.llm import vector_codes


def plain_codes(rows, rounds=6):
    """vec_id -> [(code, error, label_error)] and the digest of the codebooks."""
    kept = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    if not kept:
        return {}, ""
    d = len(kept[0][1]) // 8
    kept = [r for r in kept if len(r[1]) == 8 * d]
    cut = [[v[p * d : (p + 1) * d] for p in range(8)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:16]] for p in range(8)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(8):
            found = [near(c[p], books[p])[1] for c in cut]
            for k in set(found):
                mine = [c[p] for c, f in zip(cut, found) if f == k]
                books[p][k] = [sum(col) // len(mine) for col in zip(*mine)]
    sums, out = {}, {}
    coded = []
    for (i, _, lab), c in zip(kept, cut):
        best = [near(c[p], books[p]) for p in range(8)]
        error = min(2**63 - 1, sum(b[0] for b in best))
        coded.append((i, "".join(f"{b[1]:02x}" for b in best), error, lab))
        sums[lab] = sums.get(lab, 0) + error
    for i, code, error, lab in coded:
        out.setdefault(i, []).append((code, error, min(2**63 - 1, sums[lab])))
    text = ",".join(str(x) for book in books for e in book for x in e)
    return {i: sorted(v) for i, v in out.items()}, hashlib.sha256(text.encode()).hexdigest()


def some_rows(n, dims, seed, size=1.0):
    rng = random.Random(seed)
    centres = [[rng.uniform(-size, size) for _ in range(dims)] for _ in range(20)]
    rows = [(k, [c + rng.gauss(0, size / 20) for c in rng.choice(centres)], rng.choice([0, 1, 1, None])) for k in range(n)]
    return [(i, [float(np.float32(x)) for x in v], lab) for i, v, lab in rows]


def check(spark, rows, more=""):
    schema = "vec_id long, embedding array<float>, label int, part int, key string"
    table = spark.createDataFrame([(*r, 7, "k") for r in rows], schema).repartition(5)
    got = {}
    digests = set()
    for r in vector_codes.product_codes(table).collect():
        got.setdefault(r["vec_id"], []).append((r["code"], r["error"], r["label_error"]))
        digests.add(r["codebooks_sha256"])
    want, digest = plain_codes(rows)
    assert {i: sorted(v) for i, v in got.items()} == want
    assert digests == ({digest} if want else set())


def test_codes_with_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK_POINTS", 16)
    rows = some_rows(400, 16, 1)
    rows += [(1000 + k, rows[3][1], 5) for k in range(150)] + [(2000, rows[4][1], 5)] * 3
    rows += [(-1, None, 1), (-2, [None] + [0.0] * 15, 1), (-3, [math.nan] * 16, 1), (-4, [math.inf] + [0.0] * 15, None)]
    rows += [(5000, [0.5] * 8, 1), (5001, [], 1), (None, rows[5][1], 2)]
    check(spark, rows)


@pytest.mark.parametrize("size", [3.0e4, 1.0e12])
def test_large_components_stay_exact(spark, size):
    check(spark, some_rows(120, 8, 2, size))


def test_few_and_no_vectors(spark):
    check(spark, some_rows(5, 64, 3))
    check(spark, [])
    check(spark, [(1, None, None)])


def test_short_lists_keep_every_nearest_entry():
    rng = np.random.default_rng(5)
    for _ in range(50):
        points = rng.integers(-50, 50, (30, 3))
        book = rng.integers(-80, 80, (16, 3))
        listed = vector_codes.shortlists(points.min(0)[None], points.max(0)[None], book)[0]
        full = ((points[:, None] - book[None]) ** 2).sum(2)
        assert listed[np.unique(full.argmin(1))].all()
        entry, least = vector_codes.nearest(points, book, np.flatnonzero(listed))
        assert (entry == full.argmin(1)).all() and (least == full.min(1)).all()


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2)])
def test_curve_visits_neighbours(dims, bits, monkeypatch):
    monkeypatch.setattr(vector_codes, "_CURVE_BITS", dims * bits)
    top = 1 << bits
    cells = np.stack(np.meshgrid(*[np.arange(top)] * dims), -1).reshape(-1, dims)
    keys = vector_codes.hilbert_keys(cells, np.zeros(dims, int), np.full(dims, top - 1))
    assert sorted(keys) == list(range(top**dims))
    steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1)
    assert (steps == 1).all()
