"""Ranks, running totals, order statistics and quantiles that never put a group in one task.

A plain window sorts a whole group in one task, which is right for groups of ordinary size only.
The largest group is counted first; when it is above ``PLAIN_ROWS``, the ordered column is first cut into value buckets at (approximate) global quantiles, which are a fixed number of
literals.  A window then runs inside (group, bucket), and the totals of the earlier buckets are
joined back.  A bucket holds about rows / buckets rows whatever the group sizes are.  Where values
repeat, rows are summed per value first, so a value shared by a third of all rows is one row.
A null group key is a group of its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.session import cut_lineage, shuffle_width

PLAIN_ROWS = 1_000_000
MAX_BUCKETS = 2000
BUCKET = "_bucket"


def _bucket_count(df: DataFrame) -> int:
    return min(MAX_BUCKETS, 2 * shuffle_width(df.sparkSession))


def value_cuts(df: DataFrame, value: str, n: int | None = None) -> list[float]:
    """At most ``n - 1`` cut points of a numeric column; reads that column only."""
    n = n or _bucket_count(df)
    probs = [i / n for i in range(1, n)]
    cuts = df.select(F.col(value).cast("double").alias("v")).approxQuantile("v", probs, 1 / (4 * n))
    return sorted(set(cuts))


def with_bucket(df: DataFrame, value: str, cuts: Sequence[float]) -> DataFrame:
    """Add the bucket of a numeric column; the order of buckets follows the order of values."""
    if not cuts:
        return df.withColumn(BUCKET, F.lit(0))
    splits = [float("-inf"), *cuts, float("inf")]
    tool = Bucketizer(splits=splits, inputCol="_as_double", outputCol=BUCKET, handleInvalid="keep")
    cut = tool.transform(df.withColumn("_as_double", F.col(value).cast("double")))
    return cut.withColumn(BUCKET, F.coalesce(F.col(BUCKET).cast("int"), F.lit(-1))).drop("_as_double")


def null_safe_join(rows: DataFrame, dim: DataFrame, on: Sequence[str], how: str = "inner", hint: str | None = None) -> DataFrame:
    """Join by keys of which null equals null; the key columns of ``rows`` stay."""
    other = dim.select(*[F.col(k).alias(f"_key_{k}") for k in on], *[c for c in dim.columns if c not in on])
    other = other.hint(hint) if hint else other
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in on])
    return rows.join(other, same, how).drop(*[f"_key_{k}" for k in on])


def fits_plain_window(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether every group is small enough for one task; a count combined before the shuffle."""
    if not keys:
        return df.count() <= PLAIN_ROWS
    largest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return (largest or 0) <= PLAIN_ROWS


def _direction(name: str, descending: bool) -> Column:
    return F.col(name).desc() if descending else F.col(name).asc()


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    sums: dict[str, Column],
    descending: bool = False,
    keep_bucket: bool = False,
) -> DataFrame:
    """One row per (keys, value) with ``x`` (own total), ``x_before`` (earlier values) and ``x_all``.

    ``sums`` maps an output name to the expression summed.  Rows with a null value are left out.
    The input is read once: its totals per value are written out and everything else works on them.
    """
    keys = list(keys)
    rows = df.filter(F.col(value).isNotNull())
    per_value = cut_lineage(rows.groupBy(*keys, value).agg(*[F.sum(e).alias(n) for n, e in sums.items()]))
    if fits_plain_window(per_value, keys):
        return _plain_totals(per_value, keys, value, list(sums), descending, keep_bucket)
    per_value = with_bucket(per_value, value, value_cuts(per_value, value))

    inside = (
        Window.partitionBy(*keys, BUCKET)
        .orderBy(_direction(value, descending))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    per_bucket = per_value.groupBy(*keys, BUCKET).agg(*[F.sum(n).alias(n) for n in sums])
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    earlier = group.orderBy(_direction(BUCKET, descending)).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *keys,
        BUCKET,
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_off_{n}") for n in sums],
        *[F.sum(n).over(group).alias(f"{n}_all") for n in sums],
    )
    out = per_value.select("*", *[F.sum(n).over(inside).alias(f"_in_{n}") for n in sums])
    out = null_safe_join(out, offsets, [*keys, BUCKET])
    return out.select(
        *keys,
        value,
        *([BUCKET] if keep_bucket else []),
        *sums,
        *[(F.coalesce(F.col(f"_in_{n}"), F.lit(0)) + F.col(f"_off_{n}")).alias(f"{n}_before") for n in sums],
        *[f"{n}_all" for n in sums],
    )


def _plain_totals(per_value, keys, value, sums, descending, keep_bucket) -> DataFrame:
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    earlier = group.orderBy(_direction(value, descending)).rowsBetween(Window.unboundedPreceding, -1)
    return per_value.select(
        *keys,
        value,
        *([F.lit(0).alias(BUCKET)] if keep_bucket else []),
        *sums,
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{n}_before") for n in sums],
        *[F.sum(n).over(group).alias(f"{n}_all") for n in sums],
    )


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    by: str,
    out: str,
    ties: Sequence[str] = (),
    outer: Sequence[str] = (),
    descending: bool = False,
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """Dense zero-based row number per ``keys`` in the order (``outer``, ``by``, ``ties``).

    ``by`` must be numeric and (nearly) unique: a row key or a hash.  ``outer`` holds leading
    order columns with few distinct values.
    """
    keys, outer = list(keys), list(outer)
    place = [_direction(by, descending), *[F.col(t).asc() for t in ties]]
    if fits_plain_window(df, keys):
        whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
        order = whole.orderBy(*[F.col(o).asc() for o in outer], *place)
        return df.withColumn(out, (F.row_number().over(order) - 1).cast("long"))
    cuts = value_cuts(df, by) if cuts is None else cuts
    rows = with_bucket(df, by, cuts)
    inside = Window.partitionBy(*keys, *outer, BUCKET).orderBy(*place)
    per_bucket = rows.groupBy(*keys, *outer, BUCKET).agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    earlier = group.orderBy(
        *[F.col(o).asc() for o in outer], _direction(BUCKET, descending)
    ).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *keys, *outer, BUCKET, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off")
    )
    rows = rows.withColumn("_in", F.row_number().over(inside) - 1)
    rows = null_safe_join(rows, offsets, [*keys, *outer, BUCKET])
    return rows.withColumn(out, (F.col("_off") + F.col("_in")).cast("long")).drop("_off", "_in", BUCKET)


def quantile_points(totals: DataFrame, keys: Sequence[str], value: str, n: str, probs: Sequence[float]) -> DataFrame:
    """Exact, linearly interpolated quantiles per group as an array column ``edges``.

    ``totals`` comes from :func:`running_totals` in ascending order with the count column ``n``.
    At most two values per quantile and group meet in the final step.
    """
    keys = list(keys)
    before, after, size = F.col(f"{n}_before"), F.col(f"{n}_before") + F.col(n), F.col(f"{n}_all")
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])

    def low(p: Column) -> Column:
        return F.floor(p * (size - 1).cast("double"))

    def hits(x: Column) -> Column:
        lo = low(x["p"])
        return ((lo >= before) & (lo < after)) | ((lo + 1 >= before) & (lo + 1 < after))

    found = totals.withColumn("_q", F.explode(F.filter(wanted, hits)))
    p = F.col("_q.p")
    lo = low(p)
    per_edge = (
        found.select(
            *keys,
            F.col("_q.i").alias("_i"),
            F.when((lo >= before) & (lo < after), F.col(value)).alias("_lo"),
            F.when((lo + 1 >= before) & (lo + 1 < after), F.col(value)).alias("_hi"),
            (p * (size - 1).cast("double") - lo).alias("_f"),
        )
        .groupBy(*keys, "_i")
        .agg(F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.max("_f").alias("_f"))
    )
    edge = F.col("_lo") + (F.coalesce(F.col("_hi"), F.col("_lo")) - F.col("_lo")) * F.col("_f")
    listed = per_edge.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", edge.alias("e")))).alias("_e"))
    return listed.select(*keys, F.transform("_e", lambda x: x["e"]).alias("edges"))
