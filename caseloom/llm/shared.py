"""Helpers of the text operators: byte-level words and hashes inside tasks, tables, bounded lookup arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.session import ship_package

#: Regular expressions for Spark and DuckDB: ASCII white space, and what is not.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Text bytes handled at once inside a task; numpy needs some 40 bytes of memory for each.
PIECE_BYTES = (2 << 20) - 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes inside words: all but ASCII white space, and only ASCII letters, digits and non-ASCII.
SPACE_WORDS = np.ones(256, dtype=bool)
SPACE_WORDS[[9, 10, 11, 12, 13, 32]] = False
PLAIN_WORDS = np.zeros(256, dtype=bool)
PLAIN_WORDS[48:58] = PLAIN_WORDS[97:123] = PLAIN_WORDS[128:] = True

_BASE = 0x9E3779B97F4A7C15
_BYTE_VALUES = np.random.Generator(np.random.PCG64(71)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until the table has no such column."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def words_expr(text: Column) -> Column:
    """Array of the words of a text, none for null."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D]", " ")
    return F.array_remove(F.split(spaced, " "), "")


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over the whole range; one to one."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@lru_cache(maxsize=4)
def _powers(base: int, at_least: int) -> np.ndarray:
    out = np.full(at_least, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


def powers(base: int, n: int) -> np.ndarray:
    return _powers(base, 1 << max(12, int(n - 1).bit_length()))[:n]


def rolling(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums and inverse powers: ``(sums[e] - sums[s]) * inverse[s]`` is the hash of bytes s to e."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[data] * powers(_BASE, max(n, 1))[:n], out=sums[1:])
    return sums, powers(pow(_BASE, -1, 2**64), n + 1)


@dataclass
class Words:
    """Words of some texts: byte spans, text number, 64-bit hash."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray

    def per_doc(self, docs: int) -> np.ndarray:
        return np.bincount(self.doc, minlength=docs)


def pieces(column, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of a text column as ``(first, last, bytes, offsets)``; null is empty, a long text is its own run."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def split_words(data: np.ndarray, offsets: np.ndarray, inside_table: np.ndarray, lower: bool = True) -> Words:
    """Words of all texts of a piece; a word never crosses texts."""
    b = _LOWER[data] if lower else data
    inside = inside_table[b]
    before = np.zeros(len(b), dtype=bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(b), dtype=bool)
    after[:-1] = inside[1:]
    full = offsets[1:] > offsets[:-1]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    sums, inverse = rolling(b)
    h = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    return Words(start, end, doc, h)


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """Hash of a sequence of hashes, position by position."""
    out = np.zeros(len(parts[0]), dtype=np.uint64)
    for p in parts:
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + p)
    return out


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive values."""
    m = max(0, len(h) - n + 1)
    return combine([h[j : j + m] for j in range(n)])


def log_classes(hashes: DataFrame, hash_col: str, slots: int) -> bytes:
    """One byte per slot of the low hash bits: eight times the base-2 logarithm of the number of rows there.

    ``slots`` (a power of two, at least 65,536) bounds what reaches the driver, whatever the size of the table.
    """
    rows = hashes.select(F.col(hash_col).bitwiseAND(slots - 1).cast("int").alias("slot")).groupBy("slot").agg(F.count("*").alias("n"))
    rows = (
        rows.groupBy((F.col("slot") / 256).cast("int").alias("block"))
        .agg(F.map_from_entries(F.collect_list(F.struct(F.col("slot") % 256, (8 * F.log2("n")).cast("int")))).alias("m"))
        .select("block", F.expr("transform(sequence(0, 255), i -> coalesce(try_element_at(m, i), 0))").alias("v"))
    )
    out = bytearray(slots)
    for block, v in rows.collect():
        out[block * 256 : block * 256 + 256] = bytes(min(255, x) for x in v)
    return bytes(out)


def bit_table(df: DataFrame, hash_col: str, bits: int) -> bytes:
    """Bit set of the low hash bits of all rows; ``bits`` bounds what reaches the driver.  A test may err to yes only."""
    slot = F.col(hash_col).bitwiseAND(bits - 1)
    rows = df.select(
        (slot / 8).cast("int").alias("at"), F.expr(f"shiftleft(1, cast({hash_col} & 7 as int))").alias("bit")
    )
    rows = rows.groupBy("at").agg(F.bit_or("bit").alias("bit"))
    rows = rows.groupBy((F.col("at") / 256).cast("int").alias("block")).agg(
        F.map_from_entries(F.collect_list(F.struct((F.col("at") % 256).cast("int"), "bit"))).alias("m")
    )
    out = bytearray(bits // 8)
    for block, m in rows.collect():
        for at, bit in m.items():
            out[block * 256 + at] = bit
    return bytes(out)


def maybe_in(table: bytes, hash_col: str) -> Column:
    """False for rows whose hash is surely not in the bit table."""
    at = (F.col(hash_col).bitwiseAND(len(table) * 8 - 1) / 8).cast("int") + 1
    byte = F.conv(F.hex(F.substring(F.lit(bytearray(table)), at, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.expr(f"shiftleft(1, cast({hash_col} & 7 as int))")) != 0
