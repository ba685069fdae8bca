"""The evaluation table: one row per run with its outcome counts, rates, cost and attributes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom import config
from caseloom.functions import scalars
from caseloom.operators import metrics

RUN_KEYS = ["scen", "cost", "seed", "method", "env"]
METRICS = ["tpr", "fpr", "cost_per_100"]


def evaluate_runs(
    decisions: DataFrame,
    cases: DataFrame | None = None,
    keys: Sequence[str] = tuple(RUN_KEYS),
    label: str = config.LABEL,
    age: str = config.PROTECTED,
) -> DataFrame:
    """Join decisions to labels by case and reduce each run to one row in a single aggregation.

    Without ``cases`` the decisions carry label and age themselves.
    ``seed`` may hold the text ``NA`` for methods without training; it becomes null.
    """
    y, d, old = F.col(label), F.col("prediction"), F.col(age) >= config.OLD_AGE
    reviewed = decisions if cases is None else decisions.join(cases.select("case_id", label, age), "case_id")
    neg, pos = y == 0, y == 1
    sums = reviewed.groupBy(*keys).agg(
        F.count_if(neg & (d == 0)).alias("tn"),
        F.count_if(neg & (d == 1)).alias("fp"),
        F.count_if(pos & (d == 0)).alias("fn"),
        F.count_if(pos & (d == 1)).alias("tp"),
        F.count_if(neg & old & (d == 1)).alias("_fp_old"),
        F.count_if(neg & old).alias("_neg_old"),
        F.count_if(neg & ~old & (d == 1)).alias("_fp_young"),
        F.count_if(neg & ~old).alias("_neg_young"),
    )
    fp, fn, tp, tn = (F.col(c) for c in ("fp", "fn", "tp", "tn"))
    young = scalars.ratio(F.col("_fp_young"), F.col("_neg_young"))
    aged = scalars.ratio(F.col("_fp_old"), F.col("_neg_old"))
    scen = scalars.scenario_fields("scen")
    env = scalars.environment_fields("env")
    return sums.select(
        "scen",
        "cost",
        scen["sub"].alias("sub"),
        scen["alert_rate"].alias("alert_rate"),
        scalars.na_to_null("seed").alias("seed"),
        "method",
        "env",
        *[k for k in keys if k not in RUN_KEYS],
        F.lit(config.RUN_BATCH_SIZE).alias("batch_size"),
        F.lit(config.RUN_BATCH_SEED).alias("batch_seed"),
        F.lit(0).alias("absence_rate"),
        F.lit(None).cast("string").alias("absence_seed"),
        *[c.alias(n) for n, c in env.items()],
        F.lit(config.RUN_DEFERRAL_RATE).alias("deferral_rate"),
        F.lit(config.RUN_POOL).alias("pool"),
        scalars.ratio(fp + fn, metrics.total()).alias("n_errors"),
        "tp",
        "fp",
        "fn",
        "tn",
        scalars.ratio(tp, tp + fn).alias("tpr"),
        scalars.ratio(fp, fp + tn).alias("fpr"),
        (young / F.nullif(aged, F.lit(0.0))).alias("fpr_disp"),
        (metrics.misclassification_cost("cost") * 100.0).alias("cost_per_100"),
    )


def keep_results(
    results: DataFrame, full_training_only: bool = False, cost: float | None = None, drop_methods: Sequence[str] = ()
) -> DataFrame:
    """Filters of the reports: full training data (or unknown share), one cost, methods left out."""
    if full_training_only:
        results = results.filter((F.col("sub") == 1.0) | F.col("sub").isNull())
    if cost is not None:
        results = results.filter(F.col("cost") == cost)
    if drop_methods:
        results = results.filter(~F.col("method").isin(list(drop_methods)))
    return results


def by_training_share(results: DataFrame, cost: float, drop_methods: Sequence[str]) -> DataFrame:
    """Mean measures per scenario, method, environment kind, seed and training share."""
    kept = keep_results(results, cost=cost, drop_methods=drop_methods).filter(F.col("sub").isNotNull())
    keys = ["scen", "alert_rate", "cost", "method", "distribution", "distribution_seed", "seed", "sub"]
    return metrics.group_mean(kept, keys, METRICS, keep_null_keys=True)


def rounded(df: DataFrame, columns: Sequence[str], digits: int) -> DataFrame:
    """Half-even rounding for presentation."""
    return df.withColumns({c: F.bround(c, digits) for c in columns})
