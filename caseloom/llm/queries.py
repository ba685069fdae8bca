"""Registered queries of the text operators, each over its whole tables, and their SQL."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm import (
    chat_format,
    decontamination,
    license_scan,
    line_dedup,
    lm_scoring,
    mixing,
    ngram_join,
    personal_data,
    quality_rules,
    suffix_dedup,
    token_counts,
    vector_codes,
)
from caseloom.llm.conversation_queries import op13_turn_repair
from caseloom.llm.shared import table

#: Vocabulary file of the token counts.
TOKENIZER = os.environ.get("CASELOOM_TOKENIZER", "/opt/tokenizers/piece_bpe_32k.model")
LM_ORDER = 3


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), TOKENIZER)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = lm_scoring.held_out_expr(F.col("doc_id"))
    model = lm_scoring.fit(docs.filter(~held_out).select("text"), order=LM_ORDER)
    scored = lm_scoring.score(docs, model)
    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
    return scored.select("doc_id", held_out.alias("held_out"), *names)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.dedup_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one more, whose texts are made of control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn int, role string, text string")
    more = more.select(*[F.col(f.name).cast(f.dataType) for f in rows.schema])
    return rows.unionByName(more)


def _digest_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of each conversation, read back from its windows in order; nothing but the state of one is held."""
    key, some = None, False
    out: list[tuple] = []

    def start() -> list:
        return [0, hashlib.sha256(), 0, hashlib.sha256(), 0]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def close(state: list) -> tuple:
        return (key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

    state = start()
    for batch in batches:
        for conv, repeated, formatted, loss in zip(*(c.to_pylist() for c in batch.columns)):
            if not some or conv != key:
                if some:
                    out.append(close(state))
                key, some, state = conv, True, start()
            for role, text, _, _ in chat_format.read_turns(formatted)[repeated:]:
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            for span in loss:
                learnt = chat_format.unescape(formatted[span["first"] : span["last"]])
                state[2] += len(learnt)
                state[3].update(learnt.encode())
            state[4] += len(formatted)
        if out:
            yield batch_of(out)
            out = []
    if some:
        yield batch_of([close(state)])


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = chat_format.format_chats(conversations(spark, sf_dir), tokenizer=TOKENIZER)
    ordered = windows.repartition("conv_id").sortWithinPartitions("conv_id", "stretch", "window")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return ordered.select("conv_id", "n_repeated", "formatted", "loss").mapInArrow(_digest_windows, schema)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select("doc_id", *names)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"), k=3, percent=90)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: source, then folders of 500 and of 50 ids; each 50th is a license file."""
    docs = table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 50 == 0, "LICENSE").otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    parts = [F.col("source"), F.expr("concat('d', doc_id div 500)"), F.expr("concat('s', doc_id div 50)"), name]
    return docs.select(F.col("doc_id").alias("id"), F.concat_ws("/", *parts).alias("path"), "text")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(files(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [f"n_{k}" for k in personal_data.BASE_KINDS]
    base = F.sha2(personal_data.written("base_spans"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, personal_data.written("spans").alias("spans"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.product_codes(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_mixing,
        op3_line_dedup,
        op4_lm_scoring,
        op5_decontamination,
        op6_suffix_dedup,
        op7_chat_format,
        op8_quality_rules,
        op9_ngram_join,
        op10_license_scan,
        op11_personal_data,
        op12_vector_codes,
        op13_turn_repair,
    )
}
