"""Text operators against plain versions, on hand-made tables and on the smallest given tables."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.llm import chat_format, decontamination, license_scan, line_dedup, lm_scoring, mixing, ngram_join, quality_rules, suffix_dedup
from caseloom.llm.suffix_arrays import suffix_array
from caseloom.llm.token_counts import Counter, Viterbi, read_pieces
from tests.llm import brute

P = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"
TEXTS = [
    (1, f"{P}\nalpha beta gamma delta epsilon\n\nshort"),
    (2, None),
    (3, ""),
    (4, f"{P}\nalpha beta gamma delta zeta\nalpha beta gamma delta epsilon"),
    (5, f"{P}\nalpha beta gamma delta epsilon\n\nshort"),
    (6, "x " * 3000 + "é中\U0001f600"),
    (7, "\t \n\x0b"),
    (8, f"{P} eighteen"),
    (9, "no space" + "y" * 500),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "s", "n") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, n string, line string").repartition(3)


def by_id(df, *names):
    return {r[0]: tuple(r)[1:] for r in df.select(*names).collect()}


def test_suffix_dedup(docs):
    got = suffix_dedup.dedup_spans(docs).withColumn("d", F.sha2("kept", 256)).withColumn("k", F.size("spans"))
    assert by_id(got, "doc_id", "n_bytes", "n_removed", "k", "d") == brute.repeats(TEXTS)


def test_suffix_dedup_hot_anchor(docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", 0)
    got = suffix_dedup.dedup_spans(docs).withColumn("k", F.size("spans"))
    want = {d: v[:3] for d, v in brute.repeats(TEXTS).items()}
    assert by_id(got, "doc_id", "n_bytes", "n_removed", "k") == want


@pytest.mark.parametrize("values", [2, 4, 200])
def test_suffix_array(values):
    rng = np.random.default_rng(values)
    for n in (1, 2, 3, 40, 200):
        t = rng.integers(0, values, n)
        want = sorted(range(n), key=lambda i: t[i:].tolist())
        assert suffix_array(t, 256).tolist() == want
        assert suffix_array(t, 1000).tolist() == want


@pytest.mark.parametrize("block_words", [1_000_000, 3])
def test_decontamination(spark, docs, block_words):
    items = [("b", P.upper()), ("a", "gamma, delta"), ("c", None), ("d", "absent words here"), ("e", P)]
    table = spark.createDataFrame(items, "item_id string, text string")
    got = decontamination.contaminated(docs, table, block_words=block_words)
    assert by_id(got, "doc_id", "n_words", "n_hit", "items") == brute.decontaminate(TEXTS, items)
    assert {r[0] for r in decontamination.clean(docs, table).select("doc_id").collect()} == {2, 3, 6, 7, 9}


def test_line_dedup(docs):
    got = line_dedup.dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "n", "line", "n_removed_lines"]
    assert by_id(got, "doc_id", "text") == {d: (t,) for d, t in brute.surviving_lines(TEXTS).items()}


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_ngram_join(docs, k, percent):
    got = ngram_join.similar_groups(docs, k, percent)
    assert by_id(got, "doc_id", "n_shingles", "component_id") == brute.groups(TEXTS, k, percent)


def test_quality(docs):
    got = by_id(quality_rules.measures(docs.select("doc_id", "text")), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert got == {d: brute.quality(t) for d, t in TEXTS}
    assert quality_rules.keep(docs).columns == docs.columns


def test_token_counts_equal_the_tokenizer():
    from tokenizers.models import Unigram

    pieces = read_pieces("/opt/tokenizers/piece_bpe_32k.model")
    counter, model = Counter(Viterbi(pieces)), Unigram(pieces, unk_id=0, byte_fallback=True)
    texts = [t for _, t in TEXTS] + ["  a  b\n\n<0x0A> <s>", "\U0001f600" * 3, " "]
    want = [len(model.tokenize(counter.viterbi.prepare(t or ""))) if t else 0 for t in texts]
    assert counter.count(texts)[0] == want


@pytest.mark.parametrize("order", [1, 2, 3])
def test_model_is_a_distribution(spark, order):
    texts = ["a b a c", "a b", None, "c c c a"]
    model = lm_scoring.fit(spark.createDataFrame([(t,) for t in texts], "text string"), order=order)
    assert model.train_tokens == 14 and model.vocabulary == 4
    words = ["a", "b", "c", "unseen"]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(["", *words])], "doc_id long, text string")
    scored = by_id(lm_scoring.score(rows, model), "doc_id", "n_tokens", "score")
    assert [scored[i][0] for i in range(5)] == [1, 2, 2, 2, 2]
    model.open()
    total = 0.0
    for w in [*words, None]:
        column = lm_scoring.pa.array([w or ""])
        _, _, data, offsets = next(lm_scoring.shared.pieces(column))
        seq, _, at = lm_scoring.padded(lm_scoring.shared.split_words(data, offsets, lm_scoring.shared.SPACE_WORDS), 1, order)
        total += 10 ** model.log_probabilities(seq, at[:1])[0][0]
    assert total == pytest.approx(1.0)


def test_chat_windows_read_back(spark):
    said = "</s>[INST] ok [/INST] \\[ <|end|>\n"
    rows = [(1, 0, "system", "be kind"), *[(1, k, "user" if k % 2 else "assistant", f"{said} {k} " * 30) for k in range(1, 600)]]
    rows += [(2, 0, "user", None), (2, 1, "assistant", said), (3, 0, "system", "alone"), (4, 5, None, "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    windows = chat_format.format_chats(table).orderBy("conv_id", "stretch", "window").collect()
    turns, learnt = {}, {}
    for w in windows:
        got = chat_format.read_turns(w["formatted"])
        assert len(got) == w["n_turns"]
        turns.setdefault(w["conv_id"], []).extend((r, t) for r, t, _, _ in got[w["n_repeated"] :])
        spans = [chat_format.unescape(w["formatted"][s["first"] : s["last"]]) for s in w["loss"]]
        learnt.setdefault(w["conv_id"], []).extend(spans)
    for conv in (1, 2, 3, 4):
        want = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        assert turns[conv] == want
        assert learnt.get(conv, []) == [t for r, t in want if r == "assistant"]


def test_mixing_comes_near_targets_out_of_reach(spark):
    """Posteriors that are all mixed cannot meet the targets; the steps go most of the way to the least distance."""
    rng = np.random.default_rng(3)
    p = rng.dirichlet([8, 2, 2], 60)
    t = rng.integers(1, 200, 60)
    rows = [(i, int(n), *map(float, q)) for i, (n, q) in enumerate(zip(t, p))]
    members = spark.createDataFrame(rows, "doc_id long, tokens long, p_clean double, p_poor double, p_toxic double").coalesce(1)
    got = np.array([r[0] for r in members.select(mixing.fit_rates(members, {"clean": 0.99, "poor": 0.01, "toxic": 0.0}, 5000.0)).collect()])
    want, x = np.array([4950.0, 50.0, 0.0]), np.ones(60)
    for _ in range(100_000):
        x = np.maximum(0, x + p @ (want - (x * t) @ p) / np.linalg.eigvalsh((p.T * t) @ p)[-1])
    least = np.linalg.norm((x * t) @ p - want)
    start = np.linalg.norm(t @ p - want)
    assert (got >= 0).all() and least > 100
    assert np.linalg.norm((got * t) @ p - want) - least <= 0.2 * (start - least)


def test_mixing_reaches_the_targets(spark):
    rows = [(i, " ".join(["idiot", "trash"] * 5 if i % 3 == 0 else ["| |"] * 9 if i % 3 == 1 else ["calm", "prose"] * 8)) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 2), int(i % 3 == 0)) for i in range(0, 300, 2)], "doc_id long, quality int, toxic int")
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string"), labels).toPandas()
    mass = {d: (got.tokens * got.rate * got[f"p_{d}"]).sum() for d in mixing.DOMAINS}
    total = sum(mass.values())
    for d in mixing.DOMAINS:
        assert mass[d] / total == pytest.approx(mixing.TARGETS[d], abs=1e-4)
    assert (got.rate >= 0).all()
    calm = got[got.doc_id % 3 == 2]
    assert (calm.p_clean > 0.95).all() and (calm.rate >= 1).all()  # clean documents stay whole, labelled or not
    assert (got[got.doc_id % 3 == 0].p_toxic > 0.95).all()


def test_mixing_takes_the_rates_nearest_to_one(spark):
    rng = np.random.default_rng(5)
    p, t = rng.dirichlet([1, 1, 1], 80), rng.integers(1, 200, 80)
    rows = [(i, int(n), *map(float, q)) for i, (n, q) in enumerate(zip(t, p))]
    members = spark.createDataFrame(rows, "doc_id long, tokens long, p_clean double, p_poor double, p_toxic double").coalesce(1)
    want = np.array([0.5, 0.3, 0.2]) * 6000
    got = np.array([r[0] for r in members.select(mixing.fit_rates(members, {"clean": 0.5, "poor": 0.3, "toxic": 0.2}, 6000.0)).collect()])
    moved = np.zeros(3)  # plain ascent on the same small problem
    for _ in range(100_000):
        moved += (want - (np.maximum(0, 1 + p @ moved) * t) @ p) / np.linalg.eigvalsh((p.T * t) @ p)[-1]
    assert (got * t) @ p == pytest.approx(want, rel=1e-4)
    assert got == pytest.approx(np.maximum(0, 1 + p @ moved), abs=1e-3)


def test_license_inheritance(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/b/c/x.txt", "nothing"),
        (3, "a/b/y.txt", "text\nLicensed under CC BY-NC 4.0.\nmore"),
        (4, "z/x.txt", None),
        (5, None, "nothing"),
    ]
    got = by_id(license_scan.scan(spark.createDataFrame(rows, "id long, path string, text string")), "id", "license", "origin")
    assert got == {1: ("MIT", "notice"), 2: ("MIT", "directory"), 3: ("CC-BY-NC-4.0", "notice"), 4: (None, None), 5: (None, None)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert suffix_dedup.dedup_spans(none).count() == 0
    assert ngram_join.similar_groups(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0
    assert decontamination.contaminated(none, items).count() == 0
    assert quality_rules.quality(none).count() == 0


@pytest.mark.parametrize("block_words", [1_000_000, 3])
def test_rows_of_one_id_or_none_are_judged_apart(spark, block_words):
    rows = [(1, f"a {P}"), (1, "alpha beta"), (1, "alpha beta"), (None, P), (None, "clean text"), (None, None), (2, ""), (2, f"alpha {P} b")]
    items = [("x", P), ("y", "alpha"), ("z", "seven eight nine")]
    schema = "doc_id long, text string"
    table = spark.createDataFrame(items, "item_id string, text string")
    for cast in ("long", "string"):
        docs = spark.createDataFrame(rows, schema).withColumns({"doc_id": F.col("doc_id").cast(cast), "_bad_key": F.lit(1), "key": F.lit("k")})
        got = decontamination.contaminated(docs, table, block_words=block_words)
        want = [brute.decontaminate([(0, t)], items)[0] for _, t in rows]
        have = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"]) for r in got.collect())
        assert have == sorted((str(d), *w) for (d, _), w in zip(rows, want)) and got.schema["doc_id"].dataType.simpleString().startswith(cast[:3].replace("lon", "big"))
        kept = decontamination.clean(docs, table, block_words=block_words)
        assert kept.columns == docs.columns
        assert sorted(str((None if r[0] is None else str(r[0]), r[1])) for r in kept.collect()) == sorted(
            str((None if d is None else str(d), t)) for (d, t), w in zip(rows, want) if w[1] == 0
        )
