"""Evaluation measures.  Each is one partial-then-final aggregation over its group keys."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom import config
from caseloom.functions import scalars
from caseloom.functions.hashing import HASH_SPAN, seeded_hash
from caseloom.operators import ordering
from caseloom.operators.joins import attach
from caseloom.session import cut_lineage

COUNTS = ["tn", "fp", "fn", "tp"]


def _where(test: Column) -> Column:
    return F.count_if(test)


def confusion(rows: DataFrame, keys: Sequence[str], label: str, decision: str) -> DataFrame:
    """Counts tn, fp, fn, tp per group."""
    y, d = F.col(label), F.col(decision)
    return rows.groupBy(*keys).agg(
        _where((y == 0) & (d == 0)).alias("tn"),
        _where((y == 0) & (d == 1)).alias("fp"),
        _where((y == 1) & (d == 0)).alias("fn"),
        _where((y == 1) & (d == 1)).alias("tp"),
    )


def total() -> Column:
    return F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")


def misclassification_cost(cost: Column | float | str) -> Column:
    """Mean cost of a case: a false positive costs the ratio, a missed positive 1."""
    lam = F.col(cost) if isinstance(cost, str) else F.lit(cost) if isinstance(cost, float) else cost
    return scalars.ratio(lam * F.col("fp") + F.col("fn"), total())


def with_rates(counts: DataFrame) -> DataFrame:
    """Rates of confusion counts; null where the denominator is 0."""
    tn, fp, fn, tp = (F.col(c) for c in COUNTS)
    return counts.select(
        "*",
        total().alias("n"),
        scalars.ratio(fp, fp + tn).alias("fpr"),
        scalars.ratio(fn, fn + tp).alias("fnr"),
        scalars.ratio(tp, fn + tp).alias("tpr"),
        scalars.ratio(fn + tp, total()).alias("prevalence"),
        scalars.ratio(fp + fn, total()).alias("error_rate"),
    )


def with_reject_all(
    counts: DataFrame, cases: DataFrame, keys: Sequence[str], label: str, agent: str, name="reject_all"
) -> DataFrame:
    """Add the agent that rejects every case, counted once over the cases of each group."""
    y = F.col(label)
    zero = F.lit(0).cast("long")
    base = cases.groupBy(*keys).agg(_where(y == 0).alias("fp"), _where(y == 1).alias("tp"))
    base = base.select(
        *keys, F.lit(name).alias(agent), zero.alias("tn"), F.col("fp"), zero.alias("fn"), F.col("tp")
    )
    named = counts.withColumn(agent, F.col(agent).cast("string"))
    return named.unionByName(base)


def weighted_prevalence(rows: DataFrame, keys: Sequence[str], label: str, weight: Column) -> DataFrame:
    """Weighted share of positives and its log-odds."""
    y = F.col(label)
    sums = rows.groupBy(*keys).agg(
        F.sum(F.when(y == 1, weight).otherwise(0.0)).alias("_pos"), F.sum(weight).alias("_all")
    )
    p = F.col("_pos") / F.nullif(F.col("_all"), F.lit(0.0))
    return sums.select(*keys, p.alias("prevalence"), scalars.log_odds(p).alias("init_log_odds"))


def fpr_by_age(rows: DataFrame, keys: Sequence[str], label: str, decision: str, age: str, cut: int = config.OLD_AGE) -> DataFrame:
    """False-positive rates below and from the age cut, as difference old - young and ratio young / old."""
    y, d, old = F.col(label), F.col(decision), F.col(age) >= cut
    neg = y == 0
    sums = rows.groupBy(*keys).agg(
        _where(neg & old & (d == 1)).alias("fp_old"),
        _where(neg & old).alias("neg_old"),
        _where(neg & ~old & (d == 1)).alias("fp_young"),
        _where(neg & ~old).alias("neg_young"),
    )
    fpr_old = scalars.ratio(F.col("fp_old"), F.col("neg_old"))
    fpr_young = scalars.ratio(F.col("fp_young"), F.col("neg_young"))
    return sums.select(
        *keys,
        fpr_old.alias("fpr_old"),
        fpr_young.alias("fpr_young"),
        (fpr_old - fpr_young).alias("fpr_difference"),
        (fpr_young / F.nullif(fpr_old, F.lit(0.0))).alias("fpr_ratio"),
    )


def outcome_shares(rows: DataFrame, run_keys: Sequence[str], report_keys: Sequence[str], label: str, decision: str) -> DataFrame:
    """Shares of each outcome per training set, then their mean per report group."""
    per_run = confusion(rows, run_keys, label, decision)
    n = total()
    shares = per_run.select(
        *run_keys,
        *[scalars.ratio(F.col(c), n).alias(c) for c in COUNTS],
        scalars.ratio(F.col("tp") + F.col("tn"), n).alias("correct"),
        scalars.ratio(F.col("fp") + F.col("fn"), n).alias("incorrect"),
    )
    return group_mean(shares, report_keys, [*COUNTS, "correct", "incorrect"])


def group_mean(rows: DataFrame, keys: Sequence[str], values: Sequence[str], keep_null_keys: bool = True) -> DataFrame:
    """Means per group; groups with a null key are kept or left out."""
    src = rows if keep_null_keys else rows.na.drop(subset=list(keys))
    return src.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def mean_ci(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean and half width of the normal 95% interval (sample standard deviation)."""
    return rows.groupBy(*keys).agg(
        F.avg(value).alias("mean"),
        (F.lit(1.96) * F.stddev_samp(value) / F.sqrt(F.count(value))).alias("half_width"),
        F.count(value).alias("n"),
    )


def weighted_log_loss(rows: DataFrame, keys: Sequence[str], label: str, p: str, weight: Column) -> DataFrame:
    """Weighted mean of the negative log likelihood, probabilities clipped away from 0 and 1."""
    q = scalars.clipped(p)
    loss = -F.when(F.col(label) == 1, F.ln(q)).otherwise(F.ln(F.lit(1.0) - q))
    return rows.groupBy(*keys).agg((F.sum(weight * loss) / F.nullif(F.sum(weight), F.lit(0.0))).alias("log_loss"))


def _class_totals(rows: DataFrame, keys, label: str, score: str, descending: bool, weight: str | None, **kw) -> DataFrame:
    w = F.lit(1).cast("long") if weight is None else F.col(weight)
    y = F.col(label)
    sums = {
        "neg": F.when(y == 0, w).otherwise(0).cast("long"),
        "pos": F.when(y == 1, w).otherwise(0).cast("long"),
    }
    return ordering.running_totals(rows, keys, score, sums, descending=descending, **kw)


def roc_auc(rows: DataFrame, keys: Sequence[str], label: str, score: str, weight: str | None = None) -> DataFrame:
    """Area under the ROC curve, ties counted half; null for a single class.

    ``weight`` names an integer multiplicity, so resampled rows need not be written out.
    """
    return _area(_class_totals(rows, keys, label, score, False, weight), keys)


def _area(t: DataFrame, keys: Sequence[str]) -> DataFrame:
    pairs = F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / F.lit(2.0))
    return t.groupBy(*keys).agg(
        (
            F.sum(pairs)
            / F.nullif(F.max("pos_all").cast("double") * F.max("neg_all").cast("double"), F.lit(0.0))
        ).alias("auc")
    )


def roc_curve(
    rows: DataFrame, keys: Sequence[str], label: str, score: str, weight: str | None = None, drop_collinear: bool = True
) -> DataFrame:
    """Points (threshold, fpr, tpr) from the strictest threshold on, starting at (0, 0).

    The start point's threshold is the highest score plus 1.  Points in the middle of a straight
    run are left out on request.
    """
    keys = list(keys)
    t = _class_totals(rows, keys, label, score, True, weight, keep_bucket=True)
    step = F.struct("neg", "pos")
    inside = Window.partitionBy(*keys, ordering.BUCKET).orderBy(F.col(score).desc())
    over = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    heads = t.groupBy(*keys, ordering.BUCKET).agg(F.max_by(step, score).alias("_head"))
    heads = heads.select(
        *keys,
        ordering.BUCKET,
        F.lead("_head").over(over.orderBy(F.col(ordering.BUCKET).desc())).alias("_next_head"),
    )
    t = t.withColumn("_next", F.lead(step).over(inside))
    t = ordering.null_safe_join(t, heads, [*keys, ordering.BUCKET])
    after = F.coalesce(F.col("_next"), F.col("_next_head"))
    is_first = (F.col("neg_before") == 0) & (F.col("pos_before") == 0)
    if drop_collinear:
        t = t.filter(is_first | after.isNull() | (after != step))
    point = F.struct(
        F.col(score).alias("threshold"),
        scalars.ratio(F.col("neg_before") + F.col("neg"), F.col("neg_all")).alias("fpr"),
        scalars.ratio(F.col("pos_before") + F.col("pos"), F.col("pos_all")).alias("tpr"),
    )
    start = F.struct(
        (F.col(score) + 1.0).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    points = F.when(is_first, F.array(start, point)).otherwise(F.array(point))
    return t.select(*keys, F.explode(points).alias("_p")).select(*keys, "_p.threshold", "_p.fpr", "_p.tpr")


def calibration_curve(
    rows: DataFrame, keys: Sequence[str], outcome: str, p: str, weight: str | None = None, bins: int = 10
) -> DataFrame:
    """Mean outcome and mean probability per quantile bin; empty bins are absent.

    A probability on an edge belongs to the upper bin; the highest one to the last bin.
    """
    keys = list(keys)
    w = F.lit(1).cast("long") if weight is None else F.col(weight)
    sums = {"n": w.cast("long"), "hit": (F.col(outcome) * w).cast("long")}
    return _binned(ordering.running_totals(rows, keys, p, sums), keys, p, "hit", bins)


def _binned(t: DataFrame, keys: Sequence[str], p: str, hit: str, bins: int) -> DataFrame:
    edges = ordering.quantile_points(t, keys, p, "n", [i / bins for i in range(bins + 1)])
    joined = attach(t, edges, keys, p) if keys else t.withColumn("edges", edges.select("edges").scalar())
    inner = F.slice("edges", 1, bins)
    bin_no = F.size(F.filter(inner, lambda e: e <= F.col(p))) - 1
    return (
        joined.withColumn("bin", bin_no.cast("int"))
        .groupBy(*keys, "bin")
        .agg(
            F.sum("n").alias("n"),
            (F.sum(hit) / F.sum("n")).alias("mean_outcome"),
            (F.sum(F.col(p) * F.col("n")) / F.sum("n")).alias("mean_probability"),
        )
    )


def probability_quality(
    rows: DataFrame, keys: Sequence[str], outcome: str, p: str, weight: str | None = None, bins: int = 10
) -> DataFrame:
    """``(keys, auc, ece)`` of probabilities of an outcome, from one ordered pass over the totals per probability.

    Same values as :func:`roc_auc` and :func:`calibration_error`; ``weight`` names the copies of a resampled row.  Null keys are a
    group; rows without probability are left out, the AUC of a single outcome is null.
    """
    keys = list(keys)
    w = (F.lit(1) if weight is None else F.col(weight)).cast("long")
    hit = F.col(outcome).cast("long") * w
    totals = cut_lineage(ordering.running_totals(rows.filter(w > 0), keys, p, {"neg": w - hit, "pos": hit, "n": w}))
    error = calibration_error(_binned(totals, keys, p, "pos", bins), keys)
    return ordering.null_safe_join(_area(totals, keys), error, keys)


def calibration_error(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Unweighted mean over bins of the distance between outcome and probability."""
    gap = F.abs(F.col("mean_outcome") - F.col("mean_probability"))
    return curve.groupBy(*keys).agg(F.avg(gap).alias("ece"))


def complementarity(rows: DataFrame, keys: Sequence[str], experts: Sequence, correct: str = "correct") -> DataFrame:
    """Share of cases on which one expert is right and another wrong, for every ordered pair.

    Cases are first reduced to their pattern of right and wrong experts and counted per pattern;
    pairs are formed on the patterns only, whose number depends on the team, not on the data.
    """
    keys = list(keys)
    flags = [
        F.max(F.when(F.col("expert") == F.lit(e), F.col(correct))).alias(f"_e{i}") for i, e in enumerate(experts)
    ]
    per_case = rows.groupBy(*keys, "case_id").agg(*flags)
    names = [f"_e{i}" for i in range(len(experts))]
    patterns = per_case.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("_n"))
    listed = F.array(*[F.struct(F.lit(e).alias("expert"), F.col(n).alias("ok")) for e, n in zip(experts, names)])
    one = patterns.withColumn("_a", F.explode(listed)).withColumn("_b", F.explode(listed))
    won = F.when((F.col("_a.ok") == 1) & (F.col("_b.ok") == 0), F.col("_n")).otherwise(0)
    return one.groupBy(*keys, F.col("_a.expert").alias("expert"), F.col("_b.expert").alias("other")).agg(
        (F.sum(won) / F.sum("_n")).alias("share")
    )


def rebalance_ratio(validation: DataFrame, test: DataFrame, keys: Sequence[str], label: str, cost: str) -> DataFrame:
    """Positives needed in the test set to reach the cost-weighted class balance of validation.

    ``cost`` is one of the keys; ``n_pos`` is the number to draw.
    """
    keys = list(keys)
    on = [k for k in keys if k != cost]
    y, lam = F.col(label), F.col(cost)
    v = validation.groupBy(*keys).agg(
        F.avg(y.cast("double")).alias("prev"),
        F.avg(scalars.cost_weight(label, lam)).alias("mean_weight"),
    )
    v = v.select(
        *keys,
        "prev",
        "mean_weight",
        (F.col("prev") / F.col("mean_weight")).alias("r1"),
        ((F.lit(1.0) - F.col("prev")) * lam / F.col("mean_weight")).alias("r0"),
    )
    n = test.groupBy(*on).agg(_where(y == 0).alias("n_neg"))
    both = v.join(n, on) if on else v.withColumn("n_neg", n.scalar())
    return both.withColumn("n_pos", F.floor(F.col("n_neg") * F.col("r1") / F.col("r0")).cast("long"))


def iso_cost_line(rows: DataFrame, prevalence: str, cost_value: str, cost: str) -> DataFrame:
    """Line of equal cost in (FNR, FPR) space."""
    lam, prev = F.col(cost), F.col(prevalence)
    base = lam * (F.lit(1.0) - prev)
    return rows.withColumn("slope", -prev / base).withColumn("intercept", F.col(cost_value) / base)


def percent_improvement(means: DataFrame, on: Sequence[str], method: str, better: str, baseline: str, value: str) -> DataFrame:
    """Mean over groups of the relative change of one method against another, in percent."""
    a = means.filter(F.col(method) == better).select(*on, F.col(value).alias("_a"))
    b = means.filter(F.col(method) == baseline).select(*on, F.col(value).alias("_b"))
    change = (F.col("_a") - F.col("_b")) / F.nullif(F.col("_b"), F.lit(0.0)) * 100.0
    return a.join(b, list(on)).agg(F.avg(change).alias("pct_change"))


def win_rate(
    results: DataFrame, better: str, seeded: Sequence[str], baselines: Sequence[str], value: str
) -> DataFrame:
    """Share of environments in which a method costs less, per seed, averaged over the seeds.

    Baselines trained with a seed are compared under the same seed, the others under every seed.
    """
    place = ["alert_rate", "cost", "env"]
    mine = results.filter(F.col("method") == better).select(*place, "seed", F.col(value).alias("_a"))
    theirs = results.filter(F.col("method").isin(list(baselines))).select(
        *place, F.col("seed").alias("_seed"), F.col("method").alias("baseline"), F.col(value).alias("_b")
    )
    same_seed = ~F.col("baseline").isin(list(seeded)) | (F.col("seed") == F.col("_seed"))
    paired = mine.join(theirs, place).filter(same_seed)
    per_seed = paired.groupBy("alert_rate", "cost", "baseline", "seed").agg(
        F.avg((F.col("_a") < F.col("_b")).cast("double")).alias("_won")
    )
    return per_seed.groupBy("alert_rate", "cost", "baseline").agg(F.avg("_won").alias("win_rate"))


def poisson_steps() -> list[int]:
    """Bounds in the range of the seeded hash below which a Poisson(1) count is 0, 1, 2 ..., from its distribution function."""
    steps, term, total, k = [], math.exp(-1.0), 0.0, 0
    while True:
        total += term
        k += 1
        term /= k
        if term * HASH_SPAN < 1:
            return steps
        steps.append(int(total * HASH_SPAN))


def poisson_count(h: Column) -> Column:
    """How often a resample takes a row, from its hash."""
    steps = poisson_steps()
    count = F.when(h < steps[0], 0)
    for k, bound in enumerate(steps[1:], start=1):
        count = count.when(h < bound, k)
    return count.otherwise(len(steps))


def bootstrap_ci(
    rows: DataFrame, keys: Sequence[str], values: Sequence[str], row_key: Sequence[str], replicates: int = 200, seed=config.SAMPLE_SEED
) -> DataFrame:
    """``(keys, measure, mean, ci_low, ci_high)``: mean and 95% interval of the mean of each measure over resamples.

    Each replicate takes a row Poisson(1) times, by a hash of the row's key and the replicate: rows are resampled where they lie, in
    one pass, and all measures share the draws.  What is moved is one row of sums per group, task and replicate.  A replicate
    without any row of a measure has no mean and is left out.  Null values are left out; null keys are a group.
    """
    keys, row_key = list(keys), list(row_key)
    rep = F.col("_rep")
    drawn = rows.select(*keys, *[F.col(v).cast("double").alias(f"_v_{v}") for v in values], *[F.col(k).alias(f"_k_{k}") for k in row_key])
    # Replicate -1 is the sample itself.
    times = F.when(rep < 0, 1).otherwise(poisson_count(seeded_hash(seed, *[f"_k_{k}" for k in row_key], rep)))
    drawn = drawn.withColumn("_rep", F.explode(F.sequence(F.lit(-1), F.lit(replicates - 1)))).withColumn("_m", times).filter("_m > 0")
    sums = {}
    for v in values:
        value = F.col(f"_v_{v}")
        sums[v] = (F.sum(value * F.col("_m")) / F.sum(F.when(value.isNotNull(), F.col("_m")))).alias(f"_v_{v}")
    per_rep = drawn.groupBy(*keys, "_rep").agg(*sums.values())
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("measure"), F.col(f"_v_{v}").alias("x")) for v in values]))
    long = per_rep.select(*keys, "_rep", each.alias("_e")).select(*keys, "_rep", "_e.measure", "_e.x")
    out = long.groupBy(*keys, "measure").agg(
        F.max(F.when(rep < 0, F.col("x"))).alias("mean"),
        F.percentile(F.when(rep >= 0, F.col("x")), F.array(F.lit(0.025), F.lit(0.975))).alias("_q"),
    )
    return out.select(*keys, "measure", "mean", F.get("_q", 0).alias("ci_low"), F.get("_q", 1).alias("ci_high"))

