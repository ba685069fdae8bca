"""Unions, long and wide forms of result tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Append frames by column name; columns missing from one become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def to_long(wide: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "variable", value: str = "value") -> DataFrame:
    return wide.unpivot(list(ids), list(values), name, value)


def to_wide(long: DataFrame, ids: Sequence[str], column: str, values: Sequence, cell: Column) -> DataFrame:
    """One column per listed value; the list is fixed, so no extra pass looks for it."""
    return long.groupBy(*ids).pivot(column, list(values)).agg(cell)


def best_trial(trials: DataFrame, keys: Sequence[str], loss: str, order: str, maximise: bool = False) -> DataFrame:
    """The trial with the lowest (or highest) score per group; the first of equals wins."""
    rank = F.struct((-F.col(loss) if maximise else F.col(loss)).alias("l"), F.col(order).alias("o"))
    cols = [c for c in trials.columns if c not in keys]
    return trials.groupBy(*keys).agg(F.min_by(F.struct(*cols), rank).alias("_best")).select(*keys, "_best.*")
