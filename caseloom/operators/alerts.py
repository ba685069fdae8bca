"""Score thresholds at a fixed false-positive rate and the alert tables built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom import config
from caseloom.functions import scalars
from caseloom.operators import ordering, sampling
from caseloom.session import cut_lineage


def threshold_at_fpr(
    rows: DataFrame, keys: Sequence[str], label: str, score: str, rates: Sequence[float]
) -> DataFrame:
    """Per group and target rate: the k-th highest negative score, ``k = rint(rate * negatives)``.

    Also gives the true-positive rate of ``score >= threshold``, read off the same running totals.
    For k = 0 no negative may pass: the threshold is infinite and the rate 0.
    """
    keys = list(keys)
    y = F.col(label)
    totals = ordering.running_totals(
        rows, keys, score, {"neg": (y == 0).cast("long"), "pos": (y == 1).cast("long")}, descending=True
    )
    asked = F.array(*[F.lit(float(r)) for r in rates])

    def k_of(rate):
        return F.rint(rate * F.col("neg_all")).cast("long")

    def here(rate):
        return (k_of(rate) > F.col("neg_before")) & (k_of(rate) <= F.col("neg_before") + F.col("neg"))

    # The top value of each group also answers the k = 0 case.
    first = (F.col("neg_before") == 0) & (F.col("pos_before") == 0)
    hit = totals.withColumn("rate", F.explode(F.filter(asked, lambda r: here(r) | (first & (k_of(r) == 0)))))
    none = k_of(F.col("rate")) == 0
    return hit.select(
        *keys,
        "rate",
        F.col("neg_all").alias("n_neg"),
        k_of(F.col("rate")).alias("k"),
        F.when(none, F.lit(float("inf"))).otherwise(F.col(score)).alias("threshold"),
        F.when(none & (F.col("pos_all") > 0), F.lit(0.0))
        .otherwise(scalars.ratio(F.col("pos_before") + F.col("pos"), F.col("pos_all")))
        .alias("tpr"),
    )


def raise_alerts(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Rows strictly above the threshold, once per alert rate.

    ``thresholds`` has one row per configured alert rate and enters as scalar subqueries.
    """
    lowest = thresholds.agg(F.min("threshold")).scalar()
    listed = thresholds.agg(F.collect_list(F.struct("rate", "threshold"))).scalar()
    over = scored.filter(F.col("model_score") > lowest).withColumn("_limits", listed)
    passed = F.filter("_limits", lambda t: F.col("model_score") > t["threshold"])
    return (
        over.withColumn("_hit", F.explode(passed))
        .withColumn("alert_rate", F.col("_hit.rate"))
        .drop("_limits", "_hit")
    )


def alert_scenarios(
    scored: DataFrame,
    rates: Sequence[float] = tuple(config.ALERT_RATES),
    subs: Sequence[float] = tuple(config.SUBSAMPLES),
    data_rate: float = config.DATA_RATE,
    seed: int = config.SAMPLE_SEED,
    key: str = "case_id",
) -> DataFrame:
    """The alert table of every scenario, in one frame with ``scen, alert_rate, sub``.

    The narrow rate gives the monthly sizes; wider rates are sampled down to them; training shares
    then keep ``floor(size * sub)`` of each month but the test month.
    """
    validation = scored.filter(F.col(config.TIMESTAMP) == 3)
    limits = threshold_at_fpr(validation, [], config.LABEL, "model_score", sorted({*rates, data_rate}))
    alerts = cut_lineage(raise_alerts(scored, limits))
    sizes = (
        alerts.filter(F.col("alert_rate") == data_rate)
        .groupBy(config.TIMESTAMP)
        .agg(F.count(F.lit(1)).alias("n_take"))
    )
    wanted = alerts.filter(F.col("alert_rate").isin([float(r) for r in rates]))
    base = cut_lineage(sampling.stratified_sample(wanted, ["alert_rate"], config.TIMESTAMP, sizes, seed, key))
    return sampling.nested_subsample(base, ["alert_rate"], config.TIMESTAMP, subs, seed, key).withColumn(
        "scen",
        F.when(
            F.col("sub") == 1.0,
            F.format_string(f"alert_%.2f-data_{data_rate:.2f}", F.col("alert_rate")),
        ).otherwise(F.format_string(f"alert_%.2f-data_{data_rate:.2f}-sub_%.2f", F.col("alert_rate"), F.col("sub"))),
    )
