"""Assignment of the cases of a batch to experts under capacities.

Long tables: ``pred(keys, batch, pos, case_id, expert, p_correct)`` and
``caps(keys, batch, expert, capacity)``.  (keys, batch) is the unit of work.  A batch of ordinary
size is settled inside one task, many of them at once; a batch above ``limit`` rows is settled by a Spark job over all
its rows, with the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from caseloom.functions.transport import assign_in_order
from caseloom.operators import sampling
from caseloom.operators.joins import attach
from caseloom.session import cut_lineage, shuffle_width

GROUP_ROWS = 1_000_000
#: Rows settled by one call and rows of one task; whole batches only, so a large batch may exceed both.
CHUNK_ROWS = 20_000
TASK_ROWS = 500_000
POS_BUCKETS = 1024
AUTO_REJECT = "auto-reject"


def reject_all(batches: DataFrame) -> DataFrame:
    """Every case is rejected without review."""
    return batches.withColumn("assignment", F.lit(AUTO_REJECT)).withColumn("prediction", F.lit(1))


def one_expert(batches: DataFrame, expert) -> DataFrame:
    """Every case goes to one agent, for example the classifier."""
    return batches.withColumn("expert", expert if isinstance(expert, Column) else F.lit(expert))


def random_under_capacity(
    batches: DataFrame, caps: DataFrame, keys: Sequence[str], seed, key: str = "case_id"
) -> DataFrame:
    """Uniformly random assignment that respects every capacity.

    Cases of a batch are put in a seeded random order; the n-th one takes the n-th place of the
    batch, places being lined up by expert.  Cases beyond the last place get no expert.
    """
    group = [*keys, "batch"]
    ranked = sampling.hash_rank(batches, group, seed, key, "_place")
    upto = Window.partitionBy(*group).orderBy("expert").rowsBetween(Window.unboundedPreceding, 0)
    lined = (
        caps.withColumn("_upto", F.sum("capacity").over(upto))
        .groupBy(*group)
        .agg(F.array_sort(F.collect_list(F.struct("_upto", "expert"))).alias("_places"))
    )
    holder = F.filter("_places", lambda x: x["_upto"] > F.col("_place"))
    out = attach(ranked, lined, group, key, "left").withColumn("expert", F.get(holder, 0)["expert"])
    return out.drop("_place", "_places")


# --- batches settled inside a task --------------------------------------------------------


def square(values: np.ndarray, experts: np.ndarray, team: np.ndarray) -> np.ndarray:
    """Matrix cases x experts of the rows of a batch in order, for the experts with room."""
    if len(team) == 0:
        return np.empty((0, 0))
    if len(experts) % len(team) or (experts.reshape(-1, len(team)) != team).any():
        raise ValueError("every case needs one row per expert with room")
    return values.reshape(-1, len(team))


def _output(pred: DataFrame, keys: Sequence[str], extra: Sequence[T.StructField] = ()) -> T.StructType:
    kept = [f for name in [*keys, "batch", "pos", "case_id", "expert"] for f in pred.schema if f.name == name]
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in kept] + list(extra))


def cogrouped(cases: DataFrame, side: DataFrame, group: Sequence[str]):
    """Rows of both frames per group; the side gets fresh column ids, as both may share lineage."""
    return cases.groupBy(*group).cogroup(side.toDF(*side.columns).groupBy(*group))


def split_by_size(pred: DataFrame, keys: Sequence[str], limit: int) -> tuple[DataFrame, int, DataFrame | None]:
    """(ordinary batches, their number of rows, batches above the limit or None)."""
    group = [*keys, "batch"]
    sized = pred.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    usual = F.when(F.col("_n") <= limit, F.col("_n"))
    rows, most = sized.agg(F.coalesce(F.sum(usual), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    if most <= limit:
        return pred, rows, None
    large = cut_lineage(sized.filter(F.col("_n") > limit).drop("_n"))
    few = attach(pred, large, group, "case_id", "left_anti", written=True)
    return few, rows, attach(pred, large, group, "case_id", "left_semi", written=True)


def _coded(left: pa.Table, right: pa.Table, name: str) -> tuple[np.ndarray, pa.Array]:
    """Places of the values of a column of both tables among its sorted distinct values, null last; the values."""
    both = pa.concat_arrays([*left[name].chunks, *right[name].chunks]).dictionary_encode(null_encoding="encode")
    order = pc.sort_indices(both.dictionary).to_numpy()
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    return place[both.indices.to_numpy()], both.dictionary.take(pa.array(order))


def settle_in_tasks(
    usual: DataFrame, n_rows: int, caps: DataFrame, keys: Sequence[str], value: str, rule: Callable, extra: Sequence[T.StructField] = ()
) -> DataFrame:
    """Ordinary batches, dealt to tasks in chunks of whole batches.

    A call settles about ``CHUNK_ROWS`` rows and a task takes about ``TASK_ROWS``, so a larger table gives more tasks, not
    larger ones.  ``rule(values, room, n_cases)`` returns the place of the expert of each case (-1: none) and the values of
    ``extra`` per expert; no rows of experts with room mean that nobody gets a case.
    """
    group = [*keys, "batch"]
    schema = _output(usual, keys, extra)
    chunks = max(1, -(-n_rows // CHUNK_ROWS))
    tasks = max(min(shuffle_width(usual.sparkSession), chunks), -(-n_rows // TASK_ROWS))
    # Equal values of other types would be dealt to other chunks.
    alike = [F.col(c).cast(usual.schema[c].dataType).alias(c) for c in [*group, "expert"]]
    room = caps.filter(F.col("capacity") > 0).select(*alike, F.col("capacity").cast("long").alias("capacity"))
    room = room.toDF(*room.columns)

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_chunk", F.pmod(F.xxhash64(*group), F.lit(chunks))).repartition(tasks, "_chunk")

    def settle(cases: pa.Table, room: pa.Table) -> pa.Table:
        n = cases.num_rows
        batch = np.zeros(n + room.num_rows, dtype=np.int64)
        for c in group if len(batch) else []:
            code, values = _coded(cases, room, c)
            batch = np.unique(batch * len(values) + code, return_inverse=True)[1].reshape(-1)
        if n == 0:
            return pa.Table.from_batches([], to_arrow_schema(schema))
        expert, names = _coded(cases, room, "expert")
        pos, case_, amount = cases["pos"].to_numpy(), _coded(cases, cases.slice(0, 0), "case_id")[0], cases[value].to_numpy()
        order = np.lexsort((expert[n:], batch[n:]))
        team_batch, team, free = batch[n:][order], expert[n:][order], room["capacity"].to_numpy()[order]
        batch, expert = batch[:n], expert[:n]
        whole = np.argsort(batch, kind="stable")
        rows = np.flatnonzero(np.isin(batch * len(names) + expert, team_batch * len(names) + team))
        rows = rows[np.lexsort((expert[rows], pos[rows], batch[rows]))]
        ids = np.unique(batch)
        ends = [(np.searchsorted(x, ids), np.searchsorted(x, ids, "right")) for x in (batch[whole], batch[rows], team_batch)]
        taken, chosen, added = [], [], [[] for _ in extra]
        for (a0, a1), (r0, r1), (t0, t1) in zip(*[zip(*e) for e in ends]):
            mine, experts = rows[r0:r1], team[t0:t1]
            matrix = square(amount[mine], expert[mine], experts)
            every = whole[a0:a1]
            first = every[np.unique(case_[every], return_index=True)[1]]
            choice, per_expert = rule(matrix, free[t0:t1], len(first))
            if len(matrix) == 0:
                taken.append(first)
                chosen.append(np.full(len(first), -1))
                continue
            taken.append(mine[:: len(experts)])
            chosen.append(np.where(choice >= 0, experts[choice], -1))
            for into, x in zip(added, per_expert):
                into.append(x[choice])
        at, who = np.concatenate(taken), np.concatenate(chosen)
        out = {c: cases[c].take(pa.array(at)) for c in schema.names if c in cases.column_names}
        out["expert"] = names.take(pa.array(who, mask=who < 0))
        out |= {f.name: pa.array(np.concatenate(x)) for f, x in zip(extra, added)}
        return pa.table({c: out[c] for c in schema.names})

    return dealt(usual).groupBy("_chunk").cogroup(dealt(room).groupBy("_chunk")).applyInArrow(settle, schema)


def greedy(pred: DataFrame, caps: DataFrame, keys: Sequence[str] = (), limit: int = GROUP_ROWS) -> DataFrame:
    """Cases in order take their likeliest expert with room left; null when nobody has room."""
    group = [*keys, "batch"]
    pred = pred.select(*group, "pos", "case_id", "expert", "p_correct")
    caps = caps.select(*group, "expert", "capacity")
    schema = _output(pred, keys)
    usual, n_rows, large = split_by_size(pred, keys, limit)
    out = settle_in_tasks(usual, n_rows, caps, keys, "p_correct", lambda p, free, _: (assign_in_order(p, free), []))
    if large is None:
        return out
    return out.unionByName(greedy_spread(large, caps, keys).select(*schema.names))


# --- batches settled by a job ---------------------------------------------------------------


def greedy_spread(pred: DataFrame, caps: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The greedy rule for batches of any size.

    Between two closings each case's choice is its best open expert, so a stretch is a map and a
    count.  Each round finds, for all batches together, the position at which the next expert
    closes; there are at most as many rounds as experts.  Only stretch tables are carried.
    """
    group = [*keys, "batch"]
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("p_correct")).alias("p"), "expert")))
    wide = cut_lineage(
        pred.groupBy(*group, "pos", "case_id").agg(F.transform(ranked, lambda x: x["expert"]).alias("prefs"))
    )
    _require_pairs(pred, caps, group)
    extent = wide.groupBy(*group).agg(F.min("pos").alias("start"), F.max("pos").alias("_last"))
    extent = extent.withColumn("width", F.ceil((F.col("_last") - F.col("start") + 1) / POS_BUCKETS).cast("long"))
    state = caps.filter(F.col("capacity") > 0).select(*group, "expert", F.col("capacity").alias("left"))
    state = cut_lineage(state.join(extent.drop("_last"), group))
    stretches = []
    while not state.isEmpty():
        now = cut_lineage(
            state.groupBy(*group).agg(
                F.max("start").alias("start"), F.max("width").alias("width"), F.collect_set("expert").alias("open")
            )
        )
        rows = attach(wide, now, group, "case_id", written=True).filter(F.col("pos") >= F.col("start"))
        rows = rows.withColumn("expert", best_open("prefs", "open")).filter(F.col("expert").isNotNull())
        rows = rows.withColumn("_b", F.floor((F.col("pos") - F.col("start")) / F.col("width")))
        per_bucket = rows.groupBy(*group, "expert", "_b").agg(F.count(F.lit(1)).alias("_n"))
        upto = Window.partitionBy(*group, "expert").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
        cross = (
            per_bucket.withColumn("_upto", F.sum("_n").over(upto))
            .join(state.select(*group, "expert", "left"), [*group, "expert"])
            .filter((F.col("_upto") >= F.col("left")) & (F.col("_upto") - F.col("_n") < F.col("left")))
            .select(*group, "expert", "_b", (F.col("left") - F.col("_upto") + F.col("_n")).alias("_need"))
        )
        inside = Window.partitionBy(*group, "expert").orderBy("pos")
        closing = (
            rows.join(cross, [*group, "expert", "_b"])
            .withColumn("_i", F.row_number().over(inside))
            .filter(F.col("_i") == F.col("_need"))
            .groupBy(*group)
            .agg(F.min("pos").alias("end"))
        )
        closing = cut_lineage(closing)
        stretches.append(now.join(closing, group, "left").select(*group, "start", "end", "open"))
        used = (
            attach(rows.drop("start", "width"), closing, group, "case_id", written=True)
            .filter(F.col("pos") <= F.col("end"))
            .groupBy(*group, "expert")
            .agg(F.count(F.lit(1)).alias("_used"))
        )
        state = cut_lineage(
            state.join(closing, group)
            .join(used, [*group, "expert"], "left")
            .select(
                *group,
                "expert",
                (F.col("left") - F.coalesce("_used", F.lit(0))).alias("left"),
                (F.col("end") + 1).alias("start"),
                "width",
            )
            .filter(F.col("left") > 0)
        )
    if not stretches:
        return wide.select(*group, "pos", "case_id").withColumn("expert", F.lit(None).cast(pred.schema["expert"].dataType))
    listed = stretches[0]
    for s in stretches[1:]:
        listed = listed.unionByName(s)
    listed = listed.groupBy(*group).agg(F.collect_list(F.struct("start", "end", "open")).alias("_s"))
    mine = F.filter(
        "_s", lambda s: (F.col("pos") >= s["start"]) & (s["end"].isNull() | (F.col("pos") <= s["end"]))
    )
    out = attach(wide, listed, group, "case_id", "left").withColumn("open", F.get(mine, 0)["open"])
    return out.withColumn("expert", best_open("prefs", "open")).select(*group, "pos", "case_id", "expert")


def _require_pairs(pred: DataFrame, caps: DataFrame, group: Sequence[str]) -> None:
    """Fail, as batches settled in a task do, when a case lacks the row of an expert with room."""
    room = caps.filter(F.col("capacity") > 0).select(*group, "expert")
    open_ = room.groupBy(*group).agg(F.count(F.lit(1)).alias("_open"))
    have = attach(pred.select(*group, "case_id", "expert"), room, [*group, "expert"], "case_id", "left_semi")
    have = have.groupBy(*group, "case_id").agg(F.count(F.lit(1)).alias("_k"))
    if not attach(have, open_, group, "case_id").filter(F.col("_k") != F.col("_open")).isEmpty():
        raise ValueError("every case needs one row per expert with room")


def best_open(prefs: str, open_set: str):
    """First preferred expert that is open."""
    return F.get(F.filter(prefs, lambda e: F.array_contains(F.col(open_set), e)), 0)


# --- checks ---------------------------------------------------------------------------------


def capacity_audit(assigned: DataFrame, caps: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Cases per (batch, expert) against the capacity; the row without an expert counts leftovers."""
    group = [*keys, "batch"]
    have = assigned.groupBy(*group, "expert").agg(F.count(F.lit(1)).alias("n_assigned"))
    left = have.withColumnRenamed("expert", "_e")
    room = caps.select(*group, F.col("expert").alias("_e"), F.col("capacity").cast("long").alias("capacity"))
    both = left.join(room, [*group, "_e"], "full_outer").withColumnRenamed("_e", "expert")
    n, cap = F.coalesce("n_assigned", F.lit(0).cast("long")), F.coalesce("capacity", F.lit(0).cast("long"))
    return both.select(
        *group,
        "expert",
        n.alias("n_assigned"),
        cap.alias("capacity"),
        (n == cap).cast("int").alias("filled"),
        (n > cap).cast("int").alias("over"),
    )
