"""Personal data against plain expressions, a plain estimation, and spans planted in texts."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from caseloom.llm import personal_data, queries

FORMATS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in twice) % 10 == 0


def plain_base(text):
    out = []
    for kind, pattern in FORMATS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            fits = {
                "email": lambda: True,
                "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")),  # noqa: B023
                "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),  # noqa: B023
                "phone": lambda: 9 <= len(digits) <= 15,  # noqa: B023
            }
            if fits[kind]():
                out.append((kind, m.start(), m.end()))
    return out


def card(rng):
    body = [rng.randrange(10) for _ in range(15)]
    return next(s for s in ("".join(map(str, body)) + str(k) for k in range(10)) if luhn(s))


def odd_texts():
    rng = random.Random(2)
    texts = [
        None, "", " ", "a@b.c_d@e.f", "x@y@z.com a@@b@c.d", "..a%+-b@c-d.e.f.", "a@b", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.0255",
        "1.2.3.4a@b.c", "+1 (243) 555-5526 +12 +1((((( 9 +49.30.1234567+33 1 23 45 67 89", f"card {card(rng)}, {card(rng)[:-1]}x 4111-1111 1111-1111",
        "é\U0001f600 " * 30 + "ü@x.de name.\U0001f600@mail.example.com 10.0.0.1", "1" * 30 + " " + "12 " * 40, "4111 1111 1111 1111  5",
        "\n".join(f"u{i}@host{i}.org +1 (17{i % 10}) 555-77{i:02d} {i}.{i}.3.4" for i in range(100)),
    ]
    alphabet = "a1 2.3@4+5-6(7)89%_b"
    return texts + ["".join(rng.choice(alphabet) for _ in range(300)) for _ in range(60)]


def test_base_spans_equal_plain_expressions(spark):
    texts = odd_texts()
    rows = [(None if i % 7 == 0 else i, t, "mine", i) for i, t in enumerate(texts)]
    rows += rows[3:5]
    table = spark.createDataFrame(rows, "doc_id long, text string, base string, n_email int").repartition(3)
    got = personal_data.personal_data(table.withColumn("spans", F.lit(1)).withColumn("at", F.lit(2)))
    out = got.withColumn("b", personal_data.written("base_spans")).withColumn("s", personal_data.written("spans")).collect()
    assert len(out) == len(rows) and {r["at"] for r in out} == {2} and {r["base"] for r in out} == {"mine"}
    want = sorted(((r[0] if r[0] is not None else -1), ",".join(":".join(map(str, s)) for s in plain_base(r[1]))) for r in rows)
    assert sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["b"]) for r in out) == want
    for r in out:
        assert set(filter(None, r["b"].split(","))) <= set(r["s"].split(","))
        kinds = [s.split(":") for s in r["s"].split(",") if s]
        assert kinds == sorted(kinds, key=lambda s: (personal_data.KINDS.index(s[0]), int(s[1])))


def test_registered_query_and_empty_table(spark, tmp_path):
    texts = odd_texts()
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op11_personal_data(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        base = plain_base(t)
        assert [got[i][f"n_{k}"] for k in FORMATS] == [sum(b[0] == k for b in base) for k in FORMATS]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(":".join(map(str, b)) for b in base).encode()).hexdigest()
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert personal_data.personal_data(empty).collect() == []
    assert personal_data.personal_data(empty.union(spark.createDataFrame([(1, None)], empty.schema))).first()["spans"] == []


def test_very_long_texts(spark):
    parts = ["1" * 300_000, "a" * 300_000, "1.1.1.1 " * 20_000, "+1 " * 50_000, "a@" * 100_000, "a.b" * 100_000 + "@c" + ".d" * 50_000, "( " * 100_000]
    table = spark.createDataFrame(list(enumerate(parts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in personal_data.personal_data(table).collect()}
    assert got[2]["n_ip"] == 20_000 and got[2]["base_spans"][-1]["end"] == 8 * 20_000 - 1
    assert got[5]["n_email"] == 1 and got[5]["base_spans"][0]["end"] == len(parts[5])


def test_estimation_equals_plain_rows():
    rng = random.Random(4)
    truth, counts, rows = {}, {}, []
    good = {"format": 0.9, "variety": 0.6, "gazetteer": 0.8, "words_before": 0.85, "neighbours": 0.7}
    for _ in range(4000):
        kind, y = rng.choice(["card", "phone"]), rng.random() < 0.4
        vote = tuple(0 if rng.random() < 0.2 else (1 if (rng.random() < q) == y else -1) for q in good.values())
        rows.append((kind, *vote))
        counts[rows[-1]] = counts.get(rows[-1], 0) + 1
        truth.setdefault(rows[-1], []).append(y)
    p, worth, prior = personal_data.estimate(counts, rounds=40, least=0)
    q = [1 / (1 + math.exp(-sum(v if v > 0 else 2 * v for v in r[1:]))) for r in rows]
    for _ in range(40):  # row by row
        w = []
        for j in range(5):
            two = [{v: 1.0 for v in (-1, 0, 1)} for _ in range(2)]
            for r, x in zip(rows, q):
                two[1][r[1 + j]] += x
                two[0][r[1 + j]] += 1 - x
            w.append([{v: c / sum(s.values()) for v, c in s.items()} for s in two])
        share = {k: (sum(x for r, x in zip(rows, q) if r[0] == k) + 1) / (sum(r[0] == k for r in rows) + 2) for k in ("card", "phone")}
        q = []
        for r in rows:
            yes, no = share[r[0]], 1 - share[r[0]]
            for j in range(5):
                yes, no = yes * w[j][1][r[1 + j]], no * w[j][0][r[1 + j]]
            q.append(yes / (yes + no))
    assert all(p[r] == pytest.approx(x, abs=1e-6) for r, x in zip(rows, q))
    for name, x in zip(personal_data.LABELERS, good.values()):
        assert worth[name][1][1] / (worth[name][1][1] + worth[name][1][-1]) == pytest.approx(x, abs=0.06)
    right = sum((p[k] > 0.5) == y for k, ys in truth.items() for y in ys)
    assert right / len(rows) > 0.9


def planted(seed, n=400):
    """Texts with spans beyond the base formats, and look-alikes that are none."""
    rng = random.Random(seed)
    words = "the of and to in over under with from light stone water paper".split()
    rows = []
    for i in range(n):
        said = " ".join(rng.choice(words) for _ in range(12))
        pick = rng.randrange(8)
        digits = "".join(rng.choice("0123456789") for _ in range(16))
        hexes = "".join(rng.choice("0123456789abcdef") for _ in range(32))
        span = [
            f"0{digits[:3]} {digits[3:7]}{digits[7:10]}", f"{rng.choice(['Anna', 'Peter', 'Maria'])} {rng.choice(['Stone', 'Water'])}", hexes,
            "changeme", f"{300 + i}.{digits[0]}.{digits[1]}.{digits[2]}", card(rng), f"u{i}@mail{i}.com", f"+1 (243) 555-{digits[:4]}",
        ][pick]
        lead = ["phone ", "Dr. ", 'token = "', "password: ", "version ", "visa card ", "mail ", "call "][pick]
        tail = '" ' if pick == 2 else " "
        rows.append((i, f"{said} {lead}{span}{tail}{said}", span, pick not in (3, 4)))
    return rows


def test_held_out_spans(spark):
    schema = "doc_id long, text string, span string, private boolean"
    train = spark.createDataFrame(planted(1), schema)
    held_out = spark.createDataFrame(planted(9), schema)
    trained = personal_data.train(personal_data.find(train))
    found = hits = wanted = 0
    for r in personal_data.personal_data(held_out, classifier=trained).collect():
        spans = [r["text"][s["start"] : s["end"]] for s in r["spans"]]
        found += len(spans)
        wanted += r["private"]
        hits += r["private"] and r["span"] in spans
    assert hits / wanted > 0.95 and hits / found > 0.95
