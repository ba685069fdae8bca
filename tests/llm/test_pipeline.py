"""Every stage of the corpus pipeline on what the stages before it kept, against plain versions."""

import re

import duckdb

import corpus_pipeline
from caseloom.llm import oracle
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def stage_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    yield docs.columns, docs.collect()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        yield docs.columns, docs.collect()


def test_stages_against_plain_versions(spark, tmp_path):
    (names, first), (n1, good), (n2, lined), (n3, single), (n4, clean), (n5, mixed) = stage_by_stage(spark, tmp_path)
    assert names == n1 == n2 == n3 == n4 and n5 == [*names, "rate", "copies"]
    texts = lambda rows: [(r["doc_id"], r["text"]) for r in rows]
    ids = lambda rows: {r["doc_id"] for r in rows}

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    kept = con.execute(f"SELECT doc_id FROM ({oracle.SQL['op8_quality_rules']}) x WHERE kept").fetchall()
    assert ids(good) == {d for (d,) in kept} and 0 < len(good) < len(first)

    want = brute.surviving_lines(texts(good))
    before = dict(texts(good))
    want = {d: t for d, t in want.items() if t == before[d] or re.search(r"[^\x20\x09-\x0D]", t)}
    assert dict(texts(lined)) == want
    assert all(r["n_chars"] == len(r["text"]) for r in lined if r["text"] != before[r["doc_id"]])

    assert ids(single) == {d for d, (_, c) in brute.groups(texts(lined), 5, 80).items() if c == d}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    hits = brute.decontaminate(texts(single), items)
    assert ids(clean) == {d for d, (_, n, _) in hits.items() if n == 0}
    assert ids(mixed) <= ids(clean) and all(r["copies"] >= 1 and abs(r["copies"] - r["rate"]) < 1 for r in mixed)

    whole = corpus_pipeline.run(spark, SF).select("doc_id", "text", "copies").collect()
    assert sorted(map(tuple, whole)) == sorted((r["doc_id"], r["text"], r["copies"]) for r in mixed)
