"""Assignment that minimises the expected number of wrong decisions under exact capacities.

Costs are ``1 - p_correct`` in units of 1e-9, so sums and ties are exact integers.  The dual of
this transport problem has one price per expert.  Prices of an over-demanded set of experts are
raised to the point where the demand fits; when no set is over-demanded, cases at their minimum
price can fill all capacities, and that assignment is optimal.

Several assignments may be equally cheap.  The one taken depends on the costs and the order of cases and experts alone:
from any optimum follow the same canonical prices, from them the same sets of cheapest experts and the same flow between
sets and experts.  So batches settled in a task and by a job agree case by case, at any partitioning and from any first prices.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.functions.hashing import HASH_SPAN, seeded_hash
from caseloom.functions.transport import assign_exact, canonical_flow, canonical_prices, tight_flow
from caseloom.operators import ordering
from caseloom.operators.deferral import GROUP_ROWS, _output, cogrouped, settle_in_tasks, split_by_size
from caseloom.operators.joins import attach
from caseloom.session import cut_lineage

UNIT = 1e9
WARM_CASES = 20_000


def error_cost(p: Column | str) -> Column:
    """Chance of a wrong decision in integer units."""
    p = F.col(p) if isinstance(p, str) else p
    return F.rint((F.lit(1.0) - p) * UNIT).cast("long")


def optimal(pred: DataFrame, caps: DataFrame, keys: Sequence[str] = (), limit: int = GROUP_ROWS) -> DataFrame:
    """Each case once, each expert exactly its capacity, at the lowest total cost.

    Adds the price of the assigned expert, from which :func:`optimality_check` proves the result.
    Fails when the capacities of a batch do not add up to its cases.
    """
    group = [*keys, "batch"]
    pred = pred.select(*group, "pos", "case_id", "expert", error_cost("p_correct").alias("_cost"))
    caps = caps.select(*group, "expert", "capacity")
    schema = _output(pred, keys, [T.StructField("price", T.LongType())])
    usual, n_rows, large = split_by_size(pred, keys, limit)

    def settle(costs: np.ndarray, free: np.ndarray, n_cases: int):
        if free.sum() != n_cases:
            raise ValueError(f"capacities add up to {free.sum()}, not to the cases of the batch")
        if np.isnan(costs).any():
            raise ValueError("every case needs a cost per expert with room")
        choice, prices = assign_exact(costs.astype(np.int64), free)
        return choice, [prices]

    out = settle_in_tasks(usual, n_rows, caps, keys, "_cost", settle, [T.StructField("price", T.LongType())])
    if large is None:
        return out
    return out.unionByName(optimal_spread(large, caps, keys).select(*schema.names))


def optimal_spread(pred: DataFrame, caps: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The same optimum for batches of any size, as a loop of Spark jobs.

    The rows stay where they are; each round counts them by their set of cheapest experts, finds
    the over-demanded set of each batch from those counts, and takes the price step from an order
    statistic of the gaps.  Carried between rounds: one array of prices per batch.
    """
    group = [*keys, "batch"]
    room = caps.filter(F.col("capacity") > 0)
    roster = cut_lineage(
        room.groupBy(*group)
        .agg(F.array_sort(F.collect_list(F.struct("expert", "capacity"))).alias("_r"))
        .select(
            *group,
            F.transform("_r", lambda x: x["expert"]).alias("experts"),
            F.transform("_r", lambda x: x["capacity"].cast("long")).alias("free"),
        )
    )
    kept = attach(pred, room.select(*group, "expert"), [*group, "expert"], "case_id", "left_semi")
    listed = F.array_sort(F.collect_list(F.struct("expert", "_cost")))
    wide = cut_lineage(
        kept.groupBy(*group, "pos", "case_id").agg(F.transform(listed, lambda x: x["_cost"]).alias("costs"))
    )
    _require_balance(wide, roster, group)
    prices = cut_lineage(_warm_prices(wide, roster, group))
    while True:
        rows = _priced(wide, prices, group)
        step = cut_lineage(_flow_step(_counted(rows, group), roster, group))  # one row per batch
        over = step.filter(F.size("over") > 0).select(*group, "over", "excess")
        if over.isEmpty():
            break
        bound = attach(rows, over, group, "case_id", written=True).filter(F.size(F.array_except("tight", "over")) == 0)
        outside = F.array_min(F.filter("_red", lambda r, i: ~F.array_contains(F.col("over"), i)))
        gaps = bound.select(*group, (outside - F.col("_low")).alias("gap"))
        totals = ordering.running_totals(gaps, group, "gap", {"n": F.lit(1).cast("long")})
        delta = (
            totals.join(over, group)
            .filter((F.col("n_before") < F.col("excess")) & (F.col("excess") <= F.col("n_before") + F.col("n")))
            .select(*group, "over", F.col("gap").alias("delta"))
        )
        raised = F.transform(
            "prices", lambda u, i: u + F.when(F.array_contains(F.col("over"), i), F.col("delta")).otherwise(0)
        )
        prices = cut_lineage(
            prices.join(delta, group, "left").select(
                *group, F.when(F.col("delta").isNull(), F.col("prices")).otherwise(raised).alias("prices")
            )
        )
    some = _placed(rows, step, group)
    prices = cut_lineage(_canonical(some, group))
    rows = _priced(wide, prices, group)
    step = cut_lineage(_flow_step(_counted(rows, group), roster, group, canonical=True))
    placed = attach(_placed(rows, step, group), roster.drop("free"), group, "case_id", written=True)
    return placed.select(
        *group, "pos", "case_id", F.get("experts", F.col("_e")).alias("expert"), F.get("prices", F.col("_e")).alias("price")
    )


def _priced(wide: DataFrame, prices: DataFrame, group: Sequence[str]) -> DataFrame:
    """Cases with their costs at these prices and the places of their cheapest experts."""
    rows = attach(wide, prices, group, "case_id", written=True)
    rows = rows.withColumn("_red", F.zip_with("costs", "prices", lambda c, u: c + u))
    rows = rows.withColumn("_low", F.array_min("_red"))
    cheapest = F.transform("_red", lambda r, i: F.when(r == F.col("_low"), i))
    return rows.withColumn("tight", F.filter(cheapest, lambda i: i.isNotNull()))


def _counted(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    return rows.groupBy(*group, "tight").agg(F.count(F.lit(1)).alias("n"))


def _placed(rows: DataFrame, step: DataFrame, group: Sequence[str]) -> DataFrame:
    """Cases with the place of their expert: those of one set of cheapest experts in order along its spans."""
    single = rows.filter(F.size("tight") == 1).withColumn("_e", F.get("tight", 0))
    several = ordering.numbered(rows.filter(F.size("tight") > 1), [*group, "tight"], "pos", "_place")
    spans = step.select(*group, F.explode("places").alias("_p")).select(*group, "_p.tight", "_p.spans")
    several = several.join(spans, [*group, "tight"]).withColumn(
        "_e", F.get(F.filter("spans", lambda s: s["upto"] > F.col("_place")), 0)["e"]
    )
    cols = [*group, "pos", "case_id", "costs", "prices", "_e"]
    return single.select(*cols).unionByName(several.select(*cols))


def _canonical(placed: DataFrame, group: Sequence[str]) -> DataFrame:
    """Canonical prices of each batch from the least extra cost between its experts; a batch has one row per pair of experts."""
    extra = F.transform("costs", lambda c: c - F.get("costs", F.col("_e")))
    least = placed.select(*group, "_e", F.posexplode(extra).alias("_f", "_x")).groupBy(*group, "_e", "_f").agg(F.min("_x").alias("_x"))
    kinds = [T.StructField(f.name, f.dataType) for f in placed.select(*group).schema]
    schema = T.StructType(kinds + [T.StructField("prices", T.ArrayType(T.LongType()))])

    def settle(key: tuple, pairs: pd.DataFrame) -> pd.DataFrame:
        k = int(pairs["_f"].max()) + 1
        matrix = np.zeros((k, k), dtype=np.int64)
        matrix[pairs["_e"].to_numpy(), pairs["_f"].to_numpy()] = pairs["_x"].to_numpy()
        return pd.DataFrame([[*key, canonical_prices(matrix).tolist()]], columns=schema.names)

    return least.groupBy(*group).applyInPandas(settle, schema)


def _require_balance(wide: DataFrame, roster: DataFrame, group: Sequence[str]) -> None:
    have = wide.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.size("costs")).alias("k0"), F.max(F.size("costs")).alias("k1")
    )
    fits = (
        (F.aggregate("free", F.lit(0).cast("long"), lambda a, x: a + x) == F.col("n"))
        & (F.size("free") == F.col("k0"))
        & (F.size("free") == F.col("k1"))
    )
    bad = have.join(roster, list(group), "left").filter(~F.coalesce(fits, F.lit(False)))
    if not bad.isEmpty():
        raise ValueError("capacities do not add up to the cases of a batch")


def _warm_prices(wide: DataFrame, roster: DataFrame, group: Sequence[str]) -> DataFrame:
    """First prices: the exact ones of a small hash sample of each batch with scaled capacities.

    Any start gives the same optimum; this one only saves rounds.
    """
    sized = wide.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    share = F.lit(WARM_CASES * HASH_SPAN) / F.col("n")
    drawn = attach(wide, sized, group, "case_id").filter(seeded_hash("warm", "case_id") <= share).select(*group, "costs")
    schema = T.StructType(
        [T.StructField(f.name, f.dataType) for f in wide.select(*group).schema]
        + [T.StructField("prices", T.ArrayType(T.LongType()))]
    )
    n_keys = len(group)

    def solve(key, cases: pd.DataFrame, team: pd.DataFrame) -> pd.DataFrame:
        free = np.asarray(team["free"].iloc[0], dtype=np.int64)
        prices = np.zeros(len(free), dtype=np.int64)
        if len(cases) >= len(free):
            exact = free * (len(cases) / free.sum())
            scaled = np.floor(exact).astype(np.int64)
            for k in np.argsort(scaled - exact)[: len(cases) - scaled.sum()]:
                scaled[k] += 1
            live = scaled > 0
            _, found = assign_exact(np.stack(cases["costs"].to_numpy())[:, live], scaled[live])
            prices[live] = found
        return pd.DataFrame([[*key[:n_keys], prices.tolist()]], columns=schema.names)

    return cogrouped(drawn, roster, group).applyInPandas(solve, schema)


def _flow_step(counts: DataFrame, roster: DataFrame, group: Sequence[str], canonical: bool = False) -> DataFrame:
    """Per batch, from the counts per set of cheapest experts: the over-demanded set, or the places (canonical at the end)."""
    names = list(group)
    kinds = [T.StructField(f.name, f.dataType) for f in counts.select(*names).schema]
    span = T.StructType([T.StructField("upto", T.LongType()), T.StructField("e", T.IntegerType())])
    place = T.StructType(
        [T.StructField("tight", T.ArrayType(T.IntegerType())), T.StructField("spans", T.ArrayType(span))]
    )
    schema = T.StructType(
        kinds
        + [
            T.StructField("over", T.ArrayType(T.IntegerType())),
            T.StructField("excess", T.LongType()),
            T.StructField("places", T.ArrayType(place)),
        ]
    )

    def step(key, seen: pd.DataFrame, team: pd.DataFrame) -> pd.DataFrame:
        sets = [list(s) for s in seen["tight"]]
        free = np.asarray(team["free"].iloc[0])
        if canonical:
            flow, over, excess = canonical_flow(sets, seen["n"].to_numpy(), free), np.zeros(len(free), dtype=bool), 0
        else:
            flow, over, excess = tight_flow(seen["n"].to_numpy(), sets, free)
        places = []
        if excess == 0:
            for s, row in zip(sets, flow):
                used = np.flatnonzero(row)
                places.append(
                    {
                        "tight": [int(i) for i in s],
                        "spans": [{"upto": int(u), "e": int(e)} for u, e in zip(np.cumsum(row[used]), used)],
                    }
                )
        marked = [int(i) for i in np.flatnonzero(over)]
        return pd.DataFrame([[*key, marked, excess, places]], columns=schema.names)

    return cogrouped(counts, roster, names).applyInPandas(step, schema)


def optimality_check(assigned: DataFrame, pred: DataFrame, caps: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Proof of the optimum per batch by strong duality, in one pass over the pairs.

    With the prices ``u`` of the experts, every assignment that fills the capacities costs at least the sum of the cases' least
    ``cost + u`` less the sum of ``capacity * u``.  ``duality_gap`` is what the assignment costs beyond that bound: 0 with
    ``unfilled`` 0 (places too many or too few, cases placed twice or not at all) proves it optimal.  ``assigned`` carries
    the price of each assigned expert; the check takes the prices as a claim and trusts nothing else of it.
    """
    group = [*keys, "batch"]
    room = caps.filter(F.col("capacity") > 0).select(*group, "expert", F.col("capacity").cast("long").alias("capacity"))
    claimed = assigned.groupBy(*group, "expert").agg(F.max("price").alias("price"), F.count(F.lit(1)).alias("_n"))
    team = room.join(claimed, [*group, "expert"], "full").fillna(0, ["capacity", "price", "_n"])
    sides = team.groupBy(*group).agg(
        F.sum(F.col("capacity") * F.col("price")).alias("_paid"),
        F.sum(F.abs(F.col("capacity") - F.col("_n"))).alias("_off"),
        F.map_from_entries(F.collect_list(F.struct("expert", "price"))).alias("_u"),
    )
    listed = pred.select(*group, "case_id", "expert", error_cost("p_correct").alias("_c"))
    mine = assigned.select(*group, "case_id", F.col("expert").alias("_mine"), F.lit(1).alias("_has"))
    pairs = listed.groupBy(*group, "case_id").agg(F.map_from_entries(F.collect_list(F.struct("expert", "_c"))).alias("_costs"))
    cases = pairs.join(mine, [*group, "case_id"], "left")
    priced = attach(cases, sides, group, "case_id", "left")
    at = F.array_min(F.transform(F.map_keys("_u"), lambda e: F.try_element_at("_costs", e) + F.try_element_at("_u", e)))
    own = F.try_element_at("_costs", F.col("_mine"))
    each = priced.select(*group, "_paid", "_off", "_has", own.alias("_own"), at.alias("_low"), F.try_element_at("_u", F.col("_mine")).alias("_price"))
    return each.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_cases"),
        F.sum("_own").alias("total_cost"),
        F.count_if(F.col("_own") + F.col("_price") > F.col("_low")).alias("violations"),
        (F.max("_off") + F.count_if(F.col("_has").isNull())).alias("unfilled"),
        (F.sum("_own") - F.sum("_low") + F.max("_paid")).alias("duality_gap"),
    )
