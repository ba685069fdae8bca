"""Views of the given tables in the shapes the operators expect.

Orders stand for cases, the customer's segment for a category, and integer arithmetic on the keys
for scores, labels and expert decisions, so every engine derives the same values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom import config
from caseloom.operators import joins, ordering
from caseloom.session import cut_lineage, shuffle_width

EXPERTS = list(range(10))
MODEL_EXPERT = 9
BATCH_SIZE = 100
SEEDS = [1, 2, 3]
ENVIRONMENTS = ["batch#homogenous_0", "batch#variable-1_0", "batch#variable-2_0"]
METHODS = ["greedy", "optimal", "random", "reject_all", "classifier_only"]
SEEDED_METHODS = ["greedy", "optimal"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    key = F.col("o_orderkey")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        key.alias("case_id"),
        (F.month("o_orderdate") % 8).cast("int").alias("month"),
        (20 + ((F.col("c_custkey") * 13) % 6) * 10).cast("int").alias("customer_age"),
        F.col("o_orderpriority").alias("payment_type"),
        F.col("c_mktsegment").alias("employment_status"),
        (((key * 7919) % 10007).cast("double") / 10007.0).alias("model_score"),
        F.when(
            ((key * 104729) % 1000) * 10007 < ((key * 7919) % 10007) * 300, F.lit(1)
        ).otherwise(F.lit(0)).alias("fraud_bool"),
    )


def expert_decision(k):
    """Decision of expert ``k`` on a case: the label, wrong in 15% + 2% k of cases."""
    wrong = ((F.col("case_id") * (k + 3) * 6151 + k * 977) % 1000) < 150 + 20 * k
    return F.when(wrong, 1 - F.col("fraud_bool")).otherwise(F.col("fraud_bool")).cast("int")


def expert_probability(k):
    return ((F.col("case_id") * (2 * k + 5) * 3571 + k * 131) % 9973).cast("double") / 9973.0


def expert_pred(case_rows: DataFrame) -> DataFrame:
    pairs = joins.score_pairs(case_rows, EXPERTS)
    k = F.col("expert")
    return pairs.select(
        "case_id",
        "expert",
        "month",
        "fraud_bool",
        expert_decision(k).alias("decision"),
        expert_probability(k).alias("p_correct"),
    )


def batches(case_rows: DataFrame) -> DataFrame:
    """Test cases in order of their id, cut into batches of a fixed size."""
    test = case_rows.filter(F.col("month") == 7)
    placed = ordering.numbered(test, [], "case_id", "pos")
    return cut_lineage(placed.withColumn("batch", (F.floor(F.col("pos") / BATCH_SIZE) + 1).cast("int")))


def capacity_wide(batch_rows: DataFrame) -> DataFrame:
    """One row per batch with a capacity column per human."""
    sized = batch_rows.groupBy("batch").agg(F.count(F.lit(1)).alias("batch_size"))
    return sized.select(
        "batch",
        "batch_size",
        *[F.lit(8 + k % 3).cast("long").alias(str(k)) for k in EXPERTS if k != MODEL_EXPERT],
    )


def capacity(batch_rows: DataFrame) -> DataFrame:
    """Capacities per (batch, expert); the classifier takes what is left, at least 0."""
    humans = [str(k) for k in EXPERTS if k != MODEL_EXPERT]
    long = joins.unpivot_capacity(capacity_wide(batch_rows), [], humans)
    long = long.withColumn("expert", F.col("expert").cast("int"))
    full = joins.with_remainder(long, [], MODEL_EXPERT)
    return full.withColumn("capacity", F.greatest(F.col("capacity"), F.lit(0).cast("long")))


def batch_pred(case_rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(probabilities per batch, case and expert; capacities; batches)."""
    placed = batches(case_rows)
    cap = capacity(placed)
    k = F.col("expert")
    pairs = joins.score_pairs(placed.select("batch", "pos", "case_id", "fraud_bool"), EXPERTS)
    pred = pairs.select(
        "batch", "pos", "case_id", "expert",
        expert_probability(k).alias("p_correct"),
        expert_decision(k).alias("decision"),
    )
    return pred, cap, placed


def fitted(cap: DataFrame) -> DataFrame:
    """Capacities that every batch can fill, the last and shorter one too."""
    sizes = cap.groupBy("batch").agg(F.max("batch_size").alias("n_cases"))
    return joins.fit_capacities(cap, sizes)


CORRECTNESS_METHODS = ["joint", "separate"]
CORRECTNESS_SEEDS = [1, 2]
CORRECTNESS_SCEN = "alert_0.05-data_0.05"


def probability_store(case_rows: DataFrame) -> DataFrame:
    """Stored probabilities of being right: one row per run (scen, cost, seed, method) and test case, an array over the experts."""
    runs_ = [
        (cost, seed, method, 977 * seed + 401 * m)
        for cost in config.COSTS
        for seed in CORRECTNESS_SEEDS
        for m, method in enumerate(CORRECTNESS_METHODS)
    ]
    listed = ", ".join(
        f"named_struct('scen', '{CORRECTNESS_SCEN}', 'cost', {cost}D, 'seed', {seed}, 'method', '{method}', 'shift', {shift})"
        for cost, seed, method, shift in runs_
    )
    test = case_rows.filter(F.col("month") == 7).select("case_id", F.explode(F.expr(f"array({listed})")).alias("r"))
    p = [((F.col("case_id") * (2 * k + 5) * 3571 + k * 131 + F.col("r.shift")) % 9973).cast("double") / 9973.0 for k in EXPERTS]
    return test.select("case_id", "r.scen", "r.cost", "r.seed", "r.method", F.array(*p).alias("p"))


def runs(case_rows: DataFrame) -> DataFrame:
    """Decisions of finished runs: test cases x (scenario, cost) x method x seed x environment.

    Every run sends a case to one expert by a rotation of the run's numbers.  Labels come along, so
    the expanded rows need no join of their own.
    """
    grid = [
        (i, scen, cost, m, method, seed, e, env)
        for i, (scen, _, _, cost) in enumerate(config.scenario_costs())
        for m, method in enumerate(METHODS)
        for seed in (SEEDS if method in SEEDED_METHODS else [0])
        for e, env in enumerate(ENVIRONMENTS)
    ]
    # One SQL text instead of thousands of column objects.
    lines = F.expr(
        "array("
        + ", ".join(
            f"named_struct('scen', '{scen}', 'cost', {cost}D, 'method', '{method}', "
            f"'seed', '{'NA' if seed == 0 else f'5k-{seed}#regular'}', 'env', '{env}', "
            f"'shift', {3 * m + 5 * seed + 7 * e + 11 * i})"
            for i, scen, cost, m, method, seed, e, env in grid
        )
        + ")"
    )
    decisions = F.array(*[expert_decision(F.lit(k)) for k in EXPERTS])
    test = case_rows.filter(F.col("month") == 7)
    test = test.select("case_id", "fraud_bool", "customer_age", decisions.alias("decisions"))
    # Spread the few, narrow rows before each becomes several hundred.
    test = test.repartition(shuffle_width(test.sparkSession), "case_id")
    wide = test.withColumn("run", F.explode(lines)).select("case_id", "fraud_bool", "customer_age", "decisions", "run.*")
    k = F.when(F.col("method") == "classifier_only", F.lit(9)).otherwise(
        (F.col("case_id") + F.col("shift")) % 10
    ).cast("int")
    wide = wide.withColumn("expert", k)
    return wide.withColumn(
        "prediction",
        F.when(F.col("method") == "reject_all", F.lit(1)).otherwise(F.get("decisions", F.col("expert"))),
    ).select("scen", "cost", "method", "seed", "env", "case_id", "fraud_bool", "customer_age", "expert", "prediction")
