"""Registered query of the conversation repair: damage, repair, and the digests of its contract."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.llm import turn_repair
from caseloom.llm.shared import table
from caseloom.operators.ordering import null_safe_join

_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults put in by a checksum of (conv_id, turn)."""
    space = F.lit(" ")
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    rows = rows.select("conv_id", "turn", *[F.coalesce(c, space).alias(c) for c in ("role", "text")], (F.crc32(name.cast("binary")) % 20).alias("_k"))
    k = F.col("_k")
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(k == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.filter(k != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def _schema(conv: T.DataType) -> T.StructType:
    longs = [T.StructField(c, T.LongType()) for c in _COUNTS]
    return T.StructType([T.StructField("conv_id", conv), *longs, *[T.StructField(c, T.StringType()) for c in ("audit", "repaired_sha256")]])


class _Whole:
    """Counts and digest of one conversation, fed chunk by chunk."""

    def __init__(self, conv):
        self.conv, self.sums, self.audit, self.hash, self.any = conv, dict.fromkeys(_COUNTS, 0), [], hashlib.sha256(), False
        self.first = self.upto = self.last = None
        self.turns = 0

    def add(self, c: dict) -> None:
        for name in _COUNTS[1:]:
            self.sums[name] += c[name]
        if self.last is not None:
            self.sums["illegal"] += self.last + c["first"] not in turn_repair.LEGAL
        self.last = c["last"]
        if c["turn_first"] is not None:
            self.turns += c["n_turns"] - (c["turn_first"] == self.upto)
            self.first = c["turn_first"] if self.first is None else self.first
            self.upto = c["turn_last"]
        self.audit.append(c["audit"])
        for t in c["turns"]:
            self.hash.update((b"\n" if self.any else b"") + f"{t['role']}:{t['text']}".encode())
            self.any = True

    def row(self) -> tuple:
        self.sums["gaps"] = 0 if self.first is None else self.upto - self.first + 1 - self.turns
        return (self.conv, *self.sums.values(), "".join(self.audit), self.hash.hexdigest())


def _digest(schema: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, whole = turn_repair.to_arrow_schema(schema), None
        for batch in batches:
            out = []
            for c in batch.to_pylist():
                if whole is None or whole.conv != c["conv_id"]:
                    if whole is not None:
                        out.append(whole.row())
                    whole = _Whole(c["conv_id"])
                whole.add(c)
            if out:
                yield turn_repair.batch_of(out, arrow)
        if whole is not None:
            yield turn_repair.batch_of([whole.row()], arrow)

    return run


def digests(repaired: DataFrame) -> DataFrame:
    """One row per conversation.  A SHA-256 cannot be split: the chunks of one conversation pass through one task as a stream."""
    schema = _schema(repaired.schema["conv_id"].dataType)
    several = repaired.filter(~F.col("single")).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    parts = [p.mapInArrow(_digest(schema), schema) for p in (repaired.filter("single"), several)]
    return parts[0].unionByName(parts[1])


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = digests(turn_repair.repair(damaged(rows)))
    out = null_safe_join(rows.select("conv_id").distinct(), found, ["conv_id"], "left")
    zeros = {c: F.coalesce(c, F.lit(0).cast("long")) for c in _COUNTS}
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    out = out.withColumns({**zeros, "audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", empty)})
    return out.select("conv_id", *_COUNTS, "audit", "repaired_sha256")
