"""All deferral policies over a whole grid of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom import config
from caseloom.operators import deferral, joins, optimal, reshape

SEEDED = ["greedy", "optimal"]
UNSEEDED = ["random", "reject_all", "classifier_only"]
NO_SEED = "NA"


def run_policies(
    batches: DataFrame,
    pred: DataFrame,
    caps: DataFrame,
    keys: Sequence[str],
    model,
    methods: Sequence[str] = (*SEEDED, *UNSEEDED),
    rng_seed=config.SAMPLE_SEED,
) -> DataFrame:
    """``(method, seed, keys, batch, case_id, expert)`` of every policy in one frame.

    ``batches(keys, batch, pos, case_id)`` and ``caps(keys, batch, expert, capacity)`` hold for every
    training seed; ``pred`` has ``seed`` in addition.  Policies without training run once with seed
    ``NA``.  Rejected cases have no expert.  The optimum fills every place, so a batch with fewer cases than places gets
    its capacities in proportion.
    """
    keys = list(keys)
    kind = caps.schema["expert"].dataType
    cols = ["method", "seed", *keys, "batch", "case_id", "expert"]
    flat = batches.select(*keys, "batch", "pos", "case_id")
    parts = []
    if "reject_all" in methods:
        parts.append(deferral.reject_all(flat).withColumn("method", F.lit("reject_all")).withColumn("expert", F.lit(None).cast(kind)))
    if "classifier_only" in methods:
        parts.append(deferral.one_expert(flat, F.lit(model).cast(kind)).withColumn("method", F.lit("classifier_only")))
    if "random" in methods:
        parts.append(deferral.random_under_capacity(flat, caps, keys, rng_seed).withColumn("method", F.lit("random")))
    parts = [p.withColumn("seed", F.lit(NO_SEED)) for p in parts]
    trained = [m for m in SEEDED if m in methods]
    if trained:
        seeds = pred.select(*keys, "seed").distinct()
        per_seed = caps.select(*keys, "batch", "expert", "capacity").join(seeds, keys)
        sizes = flat.groupBy(*keys, "batch").agg(F.count(F.lit(1)).alias("n_cases"))
        places = {"greedy": per_seed, "optimal": joins.fit_capacities(caps, sizes, keys).join(seeds, keys)}
        rules = {"greedy": deferral.greedy, "optimal": optimal.optimal}
        parts += [rules[m](pred, places[m], [*keys, "seed"]).withColumn("method", F.lit(m)) for m in trained]
    return reshape.union_all([p.select(*cols) for p in parts])


def with_predictions(assigned: DataFrame, decisions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Final prediction per case: the assigned expert's decision, 1 for rejected cases."""
    known = decisions.select(*keys, "case_id", "expert", "decision")
    out = assigned.join(known, [*keys, "case_id", "expert"], "left")
    return out.withColumn(
        "prediction", F.when(F.col("method") == "reject_all", F.lit(1)).otherwise(F.col("decision"))
    ).drop("decision")
