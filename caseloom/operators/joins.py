"""Lookups between cases, batches, capacities, experts and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.operators import ordering
from caseloom.session import cut_lineage, shuffle_width

MODEL = "model#0"
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 << 20


class MissingKeys(ValueError):
    """Raised by strict lookups when some keys have no match."""


def salt_count(rows: DataFrame) -> int:
    """Tasks a single key is spread over: more on wider sessions, within 16 and 256."""
    return max(16, min(256, shuffle_width(rows.sparkSession) // 4))


def attach(
    rows: DataFrame, dim: DataFrame, on: Sequence[str], spread_by: str, how: str = "inner", written: bool = False
) -> DataFrame:
    """Join a table of one row per key to rows whose keys may be very uneven.

    The table is written once and measured.  Up to ``BROADCAST_ROWS`` rows and ``BROADCAST_BYTES`` it goes to every
    task, so the rows are not moved at all.  A null key matches a null key.  Above that the key is salted and the table repeated per salt, so
    a key that holds a third of all rows is spread over many tasks; what is still uneven is
    split by adaptive execution.  ``written`` says that the table has been written already.
    """
    if not written:
        dim = cut_lineage(dim)
    size = dim.select(F.count(F.lit(1)), F.sum(F.octet_length(F.to_json(F.struct(*dim.columns))))).first()
    if size[0] <= BROADCAST_ROWS and (size[1] or 0) <= BROADCAST_BYTES:
        return ordering.null_safe_join(rows, dim, on, how, hint="broadcast")
    salts = salt_count(rows)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    copies = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return ordering.null_safe_join(salted, copies, [*on, "_salt"], how, hint="merge").drop("_salt")


def lookup(rows: DataFrame, table: DataFrame, on: Sequence[str], strict: bool = True) -> DataFrame:
    """Add the columns of ``table`` by key.  Strict mode fails when a key is missing."""
    on = list(on)
    if not strict:
        return rows.join(table, on, "left")
    marked = rows.join(table.withColumn("_found", F.lit(True)), on, "left")
    gap = F.concat(F.lit("no match for key "), F.to_json(F.struct(*on)))
    return marked.filter(F.when(F.col("_found"), True).otherwise(F.raise_error(gap).cast("boolean"))).drop("_found")


def require_keys(rows: DataFrame, table: DataFrame, on: Sequence[str]) -> None:
    """Fail at once when some keys of ``rows`` are missing from ``table``."""
    missing = rows.join(table, list(on), "left_anti").select(*on).limit(3).collect()
    if missing:
        raise MissingKeys(f"no match for {[tuple(r) for r in missing]}")


def batch_cases(batches: DataFrame, cases: DataFrame) -> DataFrame:
    """Batches in order: every (batch, pos) with the columns of its case."""
    return batches.join(cases, "case_id")


def unpivot_capacity(wide: DataFrame, keys: Sequence[str], experts: Sequence[str]) -> DataFrame:
    """Capacity table from one column per expert to one row per expert."""
    return wide.unpivot([*keys, "batch", "batch_size"], list(experts), "expert", "capacity")


def with_remainder(capacity: DataFrame, keys: Sequence[str], model: str | int = MODEL) -> DataFrame:
    """Add the classifier's row: what the batch has left after the human capacities."""
    group = [*keys, "batch"]
    rest = capacity.groupBy(*group).agg(
        F.max("batch_size").alias("batch_size"),
        (F.max("batch_size") - F.sum("capacity")).alias("capacity"),
    )
    kind = capacity.schema["expert"].dataType
    rest = rest.withColumn("expert", F.lit(model).cast(kind))
    both = capacity.select(*group, "batch_size", "expert", F.col("capacity").cast("long").alias("capacity"))
    return both.unionByName(rest.withColumn("capacity", F.col("capacity").cast("long")).select(both.columns))


def apportion(weights: Column, total: Column) -> Column:
    """Largest-remainder shares of ``total`` in proportion to an array of whole weights.

    Everyone gets the whole part of the exact share; what is left goes one by one to the largest remainders, equal ones
    in the order of the array.
    """
    zero = F.lit(0).cast("long")
    whole = F.aggregate(weights, zero, lambda a, w: a + w)
    base = F.transform(weights, lambda w: F.floor(total * w / whole).cast("long"))
    # Exact whole parts: the quotient of doubles may be one off for products beyond 2**53.
    exact = F.zip_with(base, weights, lambda b, w: b - F.when(b * whole > total * w, 1).otherwise(0) + F.when((b + 1) * whole <= total * w, 1).otherwise(0))
    rest = F.zip_with(weights, exact, lambda w, b: total * w - b * whole)
    order = F.array_sort(F.transform(rest, lambda r, i: F.struct((-r).alias("r"), i.alias("i"))))
    place = F.transform(order, lambda x: x["i"])
    left = total - F.aggregate(exact, zero, lambda a, b: a + b)
    return F.transform(exact, lambda b, i: b + F.when(F.array_position(place, i) <= left, 1).otherwise(0))


def fit_capacities(caps: DataFrame, sizes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Capacities of batches with more places than cases cut to the cases, in proportion; others stay.

    ``caps(keys, batch, expert, capacity)`` has a row per expert, ``sizes(keys, batch, n_cases)`` one per batch.
    """
    group = [*keys, "batch"]
    listed = caps.groupBy(*group).agg(
        F.array_sort(F.collect_list(F.struct("expert", F.col("capacity").cast("long").alias("capacity")))).alias("_r")
    )
    room = F.transform("_r", lambda x: x["capacity"])
    both = listed.join(sizes.select(*group, F.col("n_cases").cast("long").alias("_n")), group).withColumn("_c", room)
    many = F.aggregate("_c", F.lit(0).cast("long"), lambda a, c: a + c) > F.col("_n")
    both = both.withColumn("_c", F.when(many, apportion(F.col("_c"), F.col("_n"))).otherwise(F.col("_c")))
    fitted = F.zip_with("_r", "_c", lambda r, c: F.struct(r["expert"].alias("expert"), c.alias("capacity")))
    return both.select(*group, F.explode(fitted).alias("_x")).select(*group, "_x.expert", "_x.capacity")


def score_pairs(cases: DataFrame, experts: Sequence, name: str = "expert") -> DataFrame:
    """One row per (case, expert) for a fixed roster: a row-local expansion, no join."""
    return cases.withColumn(name, F.explode(F.array(*[F.lit(e) for e in experts])))


def rosters(rows: DataFrame, keys: Sequence[str], expert: str = "expert", model: str | int = MODEL) -> DataFrame:
    """(keys, roster): the experts that occur under each key, sorted, without the classifier.

    A key may have an empty roster; null experts are left out, a null key is a key.  A roster is as long as a team,
    whatever the number of rows.
    """
    human = F.when(F.col(expert) != F.lit(model), F.col(expert))
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set(human)).alias("roster"))


def roster_pairs(cases: DataFrame, table: DataFrame, keys: Sequence[str], name: str = "expert") -> DataFrame:
    """One row per case and expert of the roster of its key, so scenarios with other teams share one job.

    ``table`` is that of :func:`rosters`; cases whose key has no roster or an empty one give no row.
    """
    return attach(cases, table, keys, "case_id").withColumn(name, F.explode("roster")).drop("roster")


def expand_grid(rows: DataFrame, costs: Sequence[float], sub_costs: Sequence[float], sub: Column | str = "sub") -> DataFrame:
    """Scenario rows times cost ratios; training shares below 1 only under the allowed costs."""
    sub = F.col(sub) if isinstance(sub, str) else sub
    full = F.array(*[F.lit(float(c)) for c in costs])
    few = F.array(*[F.lit(float(c)) for c in costs if c in sub_costs])
    return rows.withColumn("cost", F.explode(F.when(sub == 1.0, full).otherwise(few)))


def chosen_decision(assigned: DataFrame, predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Decision of the assigned expert: a two-key lookup on (case, expert).

    Pairs may be expanded from few bytes of cases, which the planner would take for a small table and send whole to every
    task; so both sides are dealt by key.
    """
    return assigned.join(predictions.hint("merge"), [*keys, "case_id", "expert"], "left")


def pending_work(grid: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    """Grid rows whose output does not exist yet."""
    return grid.join(done.select(*on), list(on), "left_anti")


def rank_experts(pairs: DataFrame, keys: Sequence[str], p: str = "p_correct") -> DataFrame:
    """Order of experts inside each case, most likely right first, ties by expert."""
    w = Window.partitionBy(*keys, "case_id").orderBy(F.col(p).desc(), F.col("expert").asc())
    return pairs.withColumn("rank", F.row_number().over(w))
