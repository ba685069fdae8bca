"""Seeded, engine-independent pseudo-random order of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_DIGITS = 12
HASH_SPAN = float(16**HASH_DIGITS)


def seeded_hash(seed, *parts: Column | str) -> Column:
    """48-bit number from md5 of ``seed|part|...``: uniform, the same on every engine and retry."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    text = F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, HASH_DIGITS), 16, 10).cast("long")


def uniform_cuts(n: int) -> list[float]:
    """Cut points that split the hash range evenly, so no pass over the data is needed."""
    return [HASH_SPAN * i / n for i in range(1, n)]
