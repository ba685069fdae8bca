"""Registered queries without learning: name -> callable(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom import config
from caseloom.functions import hashing, scalars
from caseloom.operators import (
    alerts,
    deferral,
    evaluation,
    joins,
    metrics,
    optimal,
    policies,
    reshape,
    sampling,
)
from caseloom.plans import inputs
from caseloom.session import cut_lineage
from caseloom.sources import registry, tables

LAMBDA = 0.057


def r6(df: DataFrame, *cols: str) -> DataFrame:
    """Round the float outputs so that engines agree on the last digits."""
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _split(c="month"):
    return scalars.span_name(c, config.ALERT_SPANS)


def _correct(pred: DataFrame) -> DataFrame:
    return pred.withColumn("correct", scalars.is_correct("decision", "fraud_bool"))


# --- sources ------------------------------------------------------------------------------


def scan_project(spark: SparkSession, d: str) -> DataFrame:
    return tables.scan(
        spark,
        f"{d}/orders.parquet",
        {"case_id": "o_orderkey", "payment_type": "o_orderpriority", "amount": F.round("o_totalprice", 2)},
        where=F.col("o_totalprice") > 100000,
    )


def capacity_long(spark, d):
    wide = inputs.capacity_wide(inputs.batches(inputs.cases(spark, d)))
    return joins.unpivot_capacity(wide, [], [str(k) for k in range(9)])


def scenario_parse(spark, d):
    key = F.col("case_id")
    rate = F.when(key % 2 == 0, "0.05").otherwise("0.15")
    sub = F.when(key % 3 == 0, "-sub_0.50").when(key % 3 == 1, "-sub_0.25").otherwise("")
    cost = F.when(key % 5 == 0, "0.0114").when(key % 5 == 1, "0.285").otherwise("0.057")
    kind = F.when(key % 4 == 0, "homogenous").otherwise(F.concat(F.lit("variable-"), (key % 4).cast("string")))
    named = inputs.cases(spark, d).select(
        "case_id",
        F.concat(F.lit("alert_"), rate, F.lit("-data_0.05"), sub, F.lit("-l_"), cost).alias("name"),
        F.concat(F.lit("batch#"), kind, F.lit("_x")).alias("env"),
        F.concat(F.lit("5k-"), (key % 5 + 1).cast("string"), F.lit("#regular#0.05")).alias("train"),
    )
    scen, env = scalars.scenario_fields("name"), scalars.environment_fields("env")
    return named.select(
        "case_id",
        *[c.alias(n) for n, c in scen.items()],
        *[c.alias(n) for n, c in env.items()],
        scalars.training_seed("train").alias("seed"),
    )


def pending_work(spark, d):
    pred, _, _ = inputs.batch_pred(inputs.cases(spark, d))
    grid = pred.select("batch", "expert").distinct()
    done = pred.filter((F.col("decision") == 1) & (F.col("case_id") % 7 == 0)).select("batch", "expert").distinct()
    return joins.pending_work(grid, done, ["batch", "expert"])


def model_properties(spark, d):
    pred = inputs.expert_pred(inputs.cases(spark, d)).filter(F.col("expert") == inputs.MODEL_EXPERT)
    rows = pred.withColumn("split", _split()).filter(F.col("split").isNotNull())
    report = metrics.with_rates(metrics.confusion(rows, ["split"], "fraud_bool", "decision"))
    report = report.withColumn("cost", metrics.misclassification_cost(LAMBDA))
    long = registry.properties_long(report, ["split"], ["fpr", "fnr", "prevalence", "cost"])
    return r6(long, "value")


def scenario_grid(spark, d):
    listed = F.array(
        *[
            F.struct(F.lit(n).alias("scen"), F.lit(s).alias("sub"))
            for n, _, s in config.scenarios()
        ]
    )
    base = inputs.cases(spark, d).filter(F.col("month") >= 3).select("case_id", "fraud_bool")
    rows = base.withColumn("_s", F.explode(listed)).select("case_id", "fraud_bool", "_s.*")
    rows = rows.filter(F.col("case_id") % 4 < F.col("sub") * 4)
    grid = joins.expand_grid(rows, config.COSTS, config.SUBSAMPLE_COSTS)
    out = grid.groupBy("scen", "sub", "cost").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("fraud_bool").alias("n_pos"),
        F.sum(scalars.cost_weight("fraud_bool", F.col("cost"))).alias("weight"),
    )
    return r6(out, "weight")


# --- projections and scalar functions -------------------------------------------------------


def case_id_assign(spark, d):
    rows = inputs.cases(spark, d).select(F.col("case_id").alias("source_key"), "month")
    return tables.with_case_id(rows, "source_key")


def conform_domain(spark, d):
    domain = ["BUILDING", "HOUSEHOLD", "MACHINERY"]
    return inputs.cases(spark, d).select(
        "case_id",
        scalars.conform("employment_status", domain).alias("employment_status"),
        scalars.domain_code("employment_status", domain).alias("code"),
    )


def time_split(spark, d):
    spans = F.array(
        *[F.struct(F.lit(n).alias("split"), F.lit(a).alias("a"), F.lit(b).alias("b"))
          for n, (a, b) in config.MODEL_SPANS.items()]
    )
    held = F.filter(spans, lambda s: scalars.in_span("month", s["a"], s["b"]))
    rows = inputs.cases(spark, d).withColumn("_s", F.explode(held)).withColumn("split", F.col("_s.split"))
    out = rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("fraud_bool").alias("n_pos"),
        F.avg("model_score").alias("mean_score"),
    )
    return r6(out, "mean_score")


def _alerts(spark, d) -> DataFrame:
    rows = inputs.cases(spark, d).filter(F.col("month") >= 3)
    limits = alerts.threshold_at_fpr(
        rows.filter(F.col("month") == 3), [], "fraud_bool", "model_score", config.ALERT_RATES
    )
    return alerts.raise_alerts(rows, limits)


def alert_split_counts(spark, d):
    out = _alerts(spark, d).withColumn("split", _split())
    return out.groupBy("alert_rate", "split", "month").agg(
        F.count(F.lit(1)).alias("n"), F.sum("fraud_bool").alias("n_pos")
    )


def cost_weights(spark, d):
    rows = joins.expand_grid(
        inputs.cases(spark, d).select("case_id", "fraud_bool").withColumn("sub", F.lit(1.0)), config.COSTS, []
    )
    return rows.select("case_id", "cost", scalars.cost_weight("fraud_bool", F.col("cost")).alias("weight"))


def binarize(spark, d):
    cut = F.lit(5000).cast("double") / 9973.0
    return inputs.expert_pred(inputs.cases(spark, d)).groupBy("expert").agg(
        F.sum(scalars.binarize("p_correct", cut)).alias("n_reaching"),
        F.sum(scalars.binarize("p_correct", cut, strict=True)).alias("n_above"),
    )


def expert_correctness(spark, d):
    pred = _correct(inputs.expert_pred(inputs.cases(spark, d)))
    return pred.groupBy("expert", "month").agg(F.count(F.lit(1)).alias("n"), F.sum("correct").alias("n_correct"))


def model_confidence(spark, d):
    pred = inputs.expert_pred(inputs.cases(spark, d)).filter(F.col("expert") == inputs.MODEL_EXPERT)
    return r6(pred.select("case_id", scalars.self_confidence("p_correct").alias("p_correct")), "p_correct")


def logit_offset(spark, d):
    p = F.col("model_score") * 0.98 + 0.01
    rows = inputs.cases(spark, d).select("case_id", scalars.log_odds(p).alias("raw"))
    out = rows.select("case_id", "raw", scalars.shifted_probability("raw", config.OFFSET_WIDTH).alias("shifted"))
    return r6(out, "raw", "shifted")


def _results(spark, d) -> DataFrame:
    return evaluation.evaluate_runs(inputs.runs(inputs.cases(spark, d)))


def _results_table(spark, d) -> DataFrame:
    """The evaluation table written once, for reports that use it several times."""
    return cut_lineage(_results(spark, d))


def result_filter(spark, d):
    kept = evaluation.keep_results(_results(spark, d), full_training_only=True, cost=LAMBDA, drop_methods=["random"])
    return r6(kept.select("scen", "cost", "method", "seed", "env", "cost_per_100"), "cost_per_100")


def na_to_null(spark, d):
    runs = inputs.runs(inputs.cases(spark, d))
    return runs.groupBy("method", scalars.na_to_null("seed").alias("seed")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("prediction").alias("n_rejected")
    )


def recode_labels(spark, d):
    names = {f"standard#{k}": f"Expert#{k}" for k in range(9)} | {"model#0": "Class. h"}
    pred = inputs.expert_pred(inputs.cases(spark, d))
    agent = F.when(F.col("expert") == 9, F.lit("model#0")).otherwise(
        F.concat(F.lit("standard#"), F.col("expert").cast("string"))
    )
    return pred.groupBy(scalars.recode(agent, names).alias("agent")).agg(
        F.sum("decision").alias("n_rejected"), F.count(F.lit(1)).alias("n")
    )


def l2_normalize(spark, d):
    vec = inputs.table(spark, d, "embeddings").select("vec_id", scalars.unit_vector("embedding").alias("v"))
    out = vec.select("vec_id", F.posexplode("v").alias("dim", "weight"))
    return r6(out, "weight")


def round_report(spark, d):
    means = metrics.group_mean(_results(spark, d), ["alert_rate", "cost", "method"], evaluation.METRICS)
    return evaluation.rounded(evaluation.rounded(means, ["tpr", "fpr"], 3), ["cost_per_100"], 2)


def _cost_ci(spark, d) -> DataFrame:
    return metrics.mean_ci(_results(spark, d), ["alert_rate", "cost", "method"], "cost_per_100")


def report_cells(spark, d):
    seeded = _cost_ci(spark, d).filter(F.col("method").isin(inputs.SEEDED_METHODS))
    return seeded.select("alert_rate", "cost", "method", scalars.mean_ci_text("mean", "half_width").alias("cell"))


def rebalance_ratio(spark, d):
    out = _rebalance(inputs.cases(spark, d))
    return r6(out, "prev", "mean_weight", "r1", "r0")


def _rebalance(rows: DataFrame) -> DataFrame:
    validation = joins.expand_grid(rows.filter(F.col("month") == 6).withColumn("sub", F.lit(1.0)), config.COSTS, [])
    return metrics.rebalance_ratio(validation, rows.filter(F.col("month") == 7), ["cost"], "fraud_bool", "cost")


# --- joins --------------------------------------------------------------------------------


def lookup_join(spark, d):
    scored = inputs.cases(spark, d).select("case_id", F.round("model_score", 6).alias("model_score"))
    months = inputs.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("case_id"), F.month("o_orderdate").alias("month")
    )
    return joins.lookup(scored, months, ["case_id"])


def batch_cases(spark, d):
    rows = inputs.cases(spark, d)
    order = inputs.batches(rows).select("batch", "pos", "case_id")
    return joins.batch_cases(order, rows.select("case_id", "fraud_bool", "customer_age"))


def capacity_remainder(spark, d):
    return inputs.capacity(inputs.batches(inputs.cases(spark, d)))


def case_expert_cross(spark, d):
    test = inputs.cases(spark, d).filter(F.col("month") == 7)
    return r6(inputs.expert_pred(test).select("case_id", "expert", "p_correct"), "p_correct")


def decision_lookup(spark, d):
    rows = inputs.cases(spark, d)
    chosen = rows.select("case_id", (F.col("case_id") % 10).cast("int").alias("expert"))
    pred = inputs.expert_pred(rows).select("case_id", "expert", "decision")
    return joins.chosen_decision(chosen, pred, [])


def join_labels(spark, d):
    docs = inputs.table(spark, d, "documents").select("doc_id", "lang", "source")
    labels = inputs.table(spark, d, "labels")
    both = docs.join(labels, "doc_id")
    out = both.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("quality").alias("n_quality"),
        F.sum("toxic").alias("n_toxic"),
        F.sum(scalars.cost_weight("toxic", LAMBDA)).alias("weight"),
    )
    return r6(out, "weight")


def scenario_rosters(spark, d):
    """Cases of every segment with the experts seen on that segment in earlier months, all segments in one job."""
    rows = inputs.cases(spark, d)
    seen = (F.length("employment_status") + F.col("case_id") % 7) % 10
    log = rows.filter(F.col("month").between(3, 6)).select("employment_status", seen.cast("int").alias("expert"))
    team = joins.rosters(log, ["employment_status"], model=inputs.MODEL_EXPERT)
    pairs = joins.roster_pairs(rows.filter(F.col("month") == 7), team, ["employment_status"])
    k = F.col("expert")
    out = pairs.groupBy("employment_status", "expert").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(inputs.expert_decision(k)).alias("n_rejected"),
        F.avg(inputs.expert_probability(k)).alias("mean_p"),
    )
    return r6(out, "mean_p")


def complementarity(spark, d):
    test = inputs.cases(spark, d).filter(F.col("month") == 7)
    out = metrics.complementarity(_correct(inputs.expert_pred(test)), [], inputs.EXPERTS)
    return r6(out, "share")


def win_rate(spark, d):
    out = metrics.win_rate(
        evaluation.keep_results(_results_table(spark, d), full_training_only=True),
        "optimal", ["greedy"], ["greedy", "random", "reject_all", "classifier_only"], "cost_per_100",
    )
    return r6(out, "win_rate")


# --- measures -----------------------------------------------------------------------------


def _split_pred(spark, d) -> DataFrame:
    pred = inputs.expert_pred(inputs.cases(spark, d)).withColumn("split", _split())
    return pred.filter(F.col("split").isNotNull())


def _by_expert(spark, d) -> DataFrame:
    return metrics.confusion(_split_pred(spark, d), ["split", "expert"], "fraud_bool", "decision")


def confusion_by_expert(spark, d):
    return _by_expert(spark, d)


def rates_by_expert(spark, d):
    out = metrics.with_rates(_by_expert(spark, d)).drop("tn", "fp", "fn", "tp")
    return r6(out, "fpr", "fnr", "tpr", "prevalence", "error_rate")


def misclass_cost(spark, d):
    grid = joins.expand_grid(_by_expert(spark, d).withColumn("sub", F.lit(1.0)), config.COSTS, []).drop("sub")
    value = metrics.misclassification_cost("cost")
    out = grid.select(
        "split", "expert", "cost", value.alias("mean_cost"), (value * 100.0).alias("cost_per_100")
    )
    return r6(out, "mean_cost", "cost_per_100")


def _with_baseline(spark, d) -> DataFrame:
    rows = inputs.cases(spark, d).withColumn("split", _split()).filter(F.col("split").isNotNull())
    return metrics.with_reject_all(_by_expert(spark, d), rows, ["split"], "fraud_bool", "expert")


def cost_with_baseline(spark, d):
    out = _with_baseline(spark, d).withColumn("mean_cost", metrics.misclassification_cost(LAMBDA))
    return r6(out, "mean_cost")


def weighted_prevalence(spark, d):
    rows = inputs.cases(spark, d).withColumn("split", _split()).filter(F.col("split").isNotNull())
    rows = joins.expand_grid(rows.withColumn("sub", F.lit(1.0)), config.COSTS, [])
    out = metrics.weighted_prevalence(
        rows, ["split", "cost"], "fraud_bool", scalars.cost_weight("fraud_bool", F.col("cost"))
    )
    return r6(out, "prevalence", "init_log_odds")


def fpr_disparity(spark, d):
    rows = inputs.cases(spark, d).filter(F.col("month") == 7)
    pairs = joins.score_pairs(rows, inputs.EXPERTS).withColumn("decision", inputs.expert_decision(F.col("expert")))
    out = metrics.fpr_by_age(pairs, ["expert"], "fraud_bool", "decision", "customer_age")
    return r6(out, "fpr_old", "fpr_young", "fpr_difference", "fpr_ratio")


def train_outcome_shares(spark, d):
    runs = inputs.runs(inputs.cases(spark, d)).filter(F.col("method") == "greedy")
    runs = runs.withColumn("alert_rate", scalars.scenario_fields("scen")["alert_rate"])
    out = metrics.outcome_shares(
        runs, ["alert_rate", "cost", "scen", "seed"], ["alert_rate", "cost"], "fraud_bool", "prediction"
    )
    return r6(out, "tn", "fp", "fn", "tp", "correct", "incorrect")


def group_mean_nullkeys(spark, d):
    res = _results_table(spark, d)
    keys = ["scen", "cost", "distribution_seed", "seed"]
    kept = metrics.group_mean(res, keys, ["cost_per_100"]).withColumn("null_keys", F.lit("kept"))
    dropped = metrics.group_mean(res, keys, ["cost_per_100"], keep_null_keys=False).withColumn(
        "null_keys", F.lit("dropped")
    )
    return r6(reshape.union_all([kept, dropped]), "cost_per_100")


def mean_ci(spark, d):
    return r6(_cost_ci(spark, d), "mean", "half_width")


def weighted_log_loss(spark, d):
    pred = _correct(inputs.expert_pred(inputs.cases(spark, d)).filter(F.col("month") == 6))
    out = metrics.weighted_log_loss(
        pred, ["expert"], "correct", "p_correct", scalars.cost_weight("fraud_bool", LAMBDA)
    )
    return r6(out, "log_loss")


def roc_auc(spark, d):
    pred = _correct(inputs.expert_pred(inputs.cases(spark, d)).filter(F.col("month") == 7))
    return r6(metrics.roc_auc(pred, ["expert"], "correct", "p_correct"), "auc")


def roc_curve(spark, d):
    rows = inputs.cases(spark, d).filter(F.col("month") >= 3)
    return r6(metrics.roc_curve(rows, [], "fraud_bool", "model_score"), "threshold", "fpr", "tpr")


def _calibration(spark, d) -> DataFrame:
    pred = _correct(inputs.expert_pred(inputs.cases(spark, d)).filter(F.col("month") == 7))
    return metrics.calibration_curve(pred, ["expert"], "correct", "p_correct")


def calibration_curve(spark, d):
    return r6(_calibration(spark, d), "mean_outcome", "mean_probability")


def ece(spark, d):
    return r6(metrics.calibration_error(_calibration(spark, d), ["expert"]), "ece")


def tpr_at_fpr(spark, d):
    rows = inputs.cases(spark, d).filter(F.col("month") == 3)
    out = alerts.threshold_at_fpr(rows, [], "fraud_bool", "model_score", config.ALERT_RATES)
    return r6(out, "threshold", "tpr")


def fpr_threshold(spark, d):
    rows = inputs.cases(spark, d).filter(F.col("month") == 3)
    out = alerts.threshold_at_fpr(rows, ["employment_status"], "fraud_bool", "model_score", [0.05])
    return r6(out.drop("tpr"), "threshold")


def pct_improvement(spark, d):
    means = metrics.group_mean(_results_table(spark, d), ["alert_rate", "cost", "method"], ["cost_per_100"])
    out = metrics.percent_improvement(means, ["alert_rate", "cost"], "method", "optimal", "greedy", "cost_per_100")
    return r6(out, "pct_change")


def sub_ablation(spark, d):
    out = evaluation.by_training_share(_results(spark, d), LAMBDA, ["reject_all", "random", "classifier_only"])
    return r6(out, *evaluation.METRICS)


BOOTSTRAP_REPLICATES = 200


def bootstrap_ci(spark, d):
    """Intervals of every method and measure."""
    out = metrics.bootstrap_ci(
        _results(spark, d),
        ["alert_rate", "cost", "method"],
        evaluation.METRICS,
        ["scen", "seed", "env"],
        replicates=BOOTSTRAP_REPLICATES,
    )
    return r6(out, "mean", "ci_low", "ci_high")


def correctness_quality(spark, d):
    """AUC and calibration error of every run's and expert's probabilities on the cost-balanced resample.

    The probabilities come one row per run and case, the resample as copies per case and cost: they meet before a row
    becomes one per expert.
    """
    drawn = bootstrap_oversample(spark, d).select("cost", "case_id", "fraud_bool", "copies")
    wide = inputs.probability_store(inputs.cases(spark, d))
    pairs = wide.join(drawn, ["cost", "case_id"]).select("*", F.posexplode("p").alias("expert", "p_correct"))
    pairs = pairs.withColumn("decision", inputs.expert_decision(F.col("expert")))
    out = metrics.probability_quality(_correct(pairs), ["scen", "cost", "seed", "method", "expert"], "correct", "p_correct", "copies")
    return r6(out, "auc", "ece")


def iso_cost_line(spark, d):
    base = _with_baseline(spark, d).withColumn("mean_cost", metrics.misclassification_cost(LAMBDA))
    base = metrics.with_rates(base).withColumn("cost", F.lit(LAMBDA))
    out = metrics.iso_cost_line(base, "prevalence", "mean_cost", "cost")
    return r6(out.select("split", "expert", "slope", "intercept"), "slope", "intercept")


# --- ranks, sets and reshaping --------------------------------------------------------------


def expert_ranking(spark, d):
    test = inputs.cases(spark, d).filter(F.col("month") == 7)
    ranked = joins.rank_experts(inputs.expert_pred(test), [])
    return ranked.select("case_id", "expert", "rank")


def select_best_trial(spark, d):
    pred = _correct(inputs.expert_pred(inputs.cases(spark, d)))
    loss = metrics.weighted_log_loss(
        pred, ["month", "expert"], "correct", "p_correct", scalars.cost_weight("fraud_bool", LAMBDA)
    )
    trials = r6(loss.select(F.col("month").alias("study"), F.col("expert").alias("trial"), F.col("log_loss").alias("loss")), "loss")
    return registry.best_trials(trials, ["study"])


def union_methods(spark, d):
    runs = inputs.runs(inputs.cases(spark, d)).filter(F.col("cost") == LAMBDA)
    per = [
        runs.filter(F.col("method") == m).groupBy("method", "env").agg(
            F.count(F.lit(1)).alias("n"), F.sum("prediction").alias("n_rejected")
        )
        for m in ("greedy", "random")
    ]
    per[1] = per[1].drop("n_rejected")
    return reshape.union_all(per)


def unpivot_metrics(spark, d):
    res = _results(spark, d).select("scen", "cost", "method", "seed", "env", *evaluation.METRICS)
    return r6(reshape.to_long(res, ["scen", "cost", "method", "seed", "env"], evaluation.METRICS), "value")


def pivot_methods(spark, d):
    out = reshape.to_wide(
        _results(spark, d), ["alert_rate", "cost"], "method", inputs.METHODS, F.avg("cost_per_100")
    )
    return r6(out, *inputs.METHODS)


# --- sampling -----------------------------------------------------------------------------


def _monthly_sizes(rows: DataFrame) -> DataFrame:
    narrow = rows.filter(F.col("alert_rate") == config.DATA_RATE)
    return narrow.groupBy("month").agg(F.count(F.lit(1)).alias("n_take"))


def stratified_sample(spark, d):
    rows = cut_lineage(_alerts(spark, d))
    out = sampling.stratified_sample(
        rows.filter(F.col("alert_rate") == 0.15), ["alert_rate"], "month", _monthly_sizes(rows), config.SAMPLE_SEED
    )
    return out.select("alert_rate", "month", "case_id", "fraud_bool")


def nested_subsample(spark, d):
    rows = inputs.cases(spark, d).filter(F.col("month") >= 3)
    return alerts.alert_scenarios(rows).select("scen", "alert_rate", "sub", "month", "case_id")


def bootstrap_oversample(spark, d):
    rows = inputs.cases(spark, d)
    test = rows.filter(F.col("month") == 7).select("case_id", "fraud_bool").withColumn("sub", F.lit(1.0))
    grid = joins.expand_grid(test, config.COSTS, []).drop("sub")
    return sampling.oversample_positives(
        grid, ["cost"], "fraud_bool", _rebalance(rows).select("cost", "n_pos"), config.SAMPLE_SEED
    )


# --- deferral -----------------------------------------------------------------------------


def defer_reject_all(spark, d):
    placed = inputs.batches(inputs.cases(spark, d)).select("batch", "case_id")
    return deferral.reject_all(placed)


def _decided(assigned: DataFrame, pred: DataFrame, keys=()) -> DataFrame:
    out = joins.chosen_decision(assigned, pred.select(*keys, "case_id", "expert", "decision"), keys)
    return out.select(*keys, "batch", "case_id", "expert", "decision")


def defer_model_only(spark, d):
    pred, _, placed = inputs.batch_pred(inputs.cases(spark, d))
    return _decided(deferral.one_expert(placed.select("batch", "case_id"), inputs.MODEL_EXPERT), pred)


def _random(spark, d):
    rows = inputs.cases(spark, d)
    pred, cap, placed = inputs.batch_pred(rows)
    placed = placed.select("batch", "case_id")
    return deferral.random_under_capacity(placed, cap, [], config.SAMPLE_SEED), pred, cap


def defer_random(spark, d):
    assigned, pred, _ = _random(spark, d)
    return _decided(assigned, pred)


def defer_greedy(spark, d):
    pred, cap, _ = inputs.batch_pred(inputs.cases(spark, d))
    return _decided(deferral.greedy(pred, cap), pred)


def defer_optimal(spark, d):
    pred, cap, _ = inputs.batch_pred(inputs.cases(spark, d))
    return _decided(optimal.optimal(pred, inputs.fitted(cap)), pred)


def defer_optimal_certificate(spark, d):
    pred, cap, _ = inputs.batch_pred(inputs.cases(spark, d))
    cap = inputs.fitted(cap)
    check = optimal.optimality_check(cut_lineage(optimal.optimal(pred, cap)), pred, cap)
    return check.select("batch", "n_cases", "violations", "unfilled", "duality_gap")


def fitted_capacity(spark, d):
    return inputs.fitted(inputs.capacity(inputs.batches(inputs.cases(spark, d))))


def defer_optimal_two(spark, d):
    pred, cap, _ = inputs.batch_pred(inputs.cases(spark, d))
    two = pred.filter(F.col("expert").isin(0, inputs.MODEL_EXPERT))
    sized = cap.groupBy("batch").agg(F.max("batch_size").alias("n"))
    first = F.floor(F.col("n") * 2 / 5).cast("long")
    room = sized.select(
        "batch",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("expert"), first.alias("capacity")),
                F.struct(F.lit(inputs.MODEL_EXPERT).alias("expert"), (F.col("n") - first).alias("capacity")),
            )
        ).alias("r"),
    ).select("batch", "r.*")
    return optimal.optimal(two, room).select("batch", "case_id", "expert")


def capacity_audit(spark, d):
    assigned, _, cap = _random(spark, d)
    return deferral.capacity_audit(assigned, cap)


# --- the grid of runs -----------------------------------------------------------------------

GRID_SEEDS = [1, 2]
GRID_ENVS = ["batch#homogenous_0", "batch#variable-1_0"]
GRID_SCEN = "alert_0.05-data_0.05"


def _grid(spark, d):
    """(batches per env, probabilities per env and seed, capacities per env) of the test cases."""
    rows = inputs.cases(spark, d)
    placed = inputs.batches(rows).select("batch", "pos", "case_id", "fraud_bool")
    sized = placed.groupBy("batch").agg(F.count(F.lit(1)).alias("batch_size"))
    envs = F.array(*[F.struct(F.lit(e).alias("env"), F.lit(i).alias("e")) for i, e in enumerate(GRID_ENVS)])
    k, e = F.col("expert"), F.col("e")
    humans = joins.score_pairs(sized.withColumn("x", F.explode(envs)).select("batch", "batch_size", "x.*"), list(range(9)))
    humans = humans.withColumn("capacity", (8 + (k + e) % 3).cast("long"))
    cap = joins.with_remainder(humans, ["env"], inputs.MODEL_EXPERT)
    cap = cap.withColumn("capacity", F.greatest("capacity", F.lit(0).cast("long")))
    per_env = placed.withColumn("env", F.explode(F.array(*[F.lit(x) for x in GRID_ENVS])))
    pairs = joins.score_pairs(
        per_env.withColumn("s", F.explode(F.array(*[F.lit(s) for s in GRID_SEEDS]))), inputs.EXPERTS
    )
    p = ((F.col("case_id") * (2 * k + 5) * 3571 + k * 131 + F.col("s") * 977) % 9973).cast("double") / 9973.0
    pred = pairs.select(
        F.concat(F.lit("5k-"), F.col("s").cast("string"), F.lit("#regular")).alias("seed"),
        "env", "batch", "pos", "case_id", "expert",
        p.alias("p_correct"), inputs.expert_decision(k).alias("decision"),
    )
    return rows, per_env, pred, cap


def _grid_decisions(spark, d, methods) -> DataFrame:
    """Decisions of the methods with the label and age of their case, every seed and environment in one frame."""
    rows, per_env, pred, cap = _grid(spark, d)
    assigned = policies.run_policies(per_env, pred, cap, ["env"], inputs.MODEL_EXPERT, methods)
    labelled = assigned.join(rows.select("case_id", "fraud_bool", "customer_age").hint("merge"), "case_id")
    own = inputs.expert_decision(F.col("expert"))
    return labelled.withColumn("prediction", F.when(F.col("method") == "reject_all", 1).otherwise(own))


def deferral_grid(spark, d):
    decisions = _grid_decisions(spark, d, inputs.METHODS)
    return decisions.groupBy("method", "seed", "env", "expert").agg(
        F.count(F.lit(1)).alias("n"), F.sum("prediction").alias("n_rejected")
    )


def _evaluated_grid(spark, d, methods):
    decisions = _grid_decisions(spark, d, methods)
    runs = decisions.withColumn("scen", F.lit(GRID_SCEN)).withColumn("cost", F.lit(LAMBDA))
    out = evaluation.evaluate_runs(runs)
    return r6(out, "n_errors", "tpr", "fpr", "fpr_disp", "cost_per_100")


def deferral_results(spark, d):
    """Evaluation of the policies whose decisions plain SQL can follow."""
    return _evaluated_grid(spark, d, [m for m in inputs.METHODS if m != "optimal"])


def deferral_results_all(spark, d):
    """Evaluation of every policy, the optimum included."""
    return _evaluated_grid(spark, d, inputs.METHODS)


QUERIES = {
    f.__name__: f
    for f in [
        scan_project, capacity_long, scenario_parse, pending_work, model_properties, scenario_grid,
        case_id_assign, conform_domain, time_split, alert_split_counts, cost_weights, binarize,
        expert_correctness, model_confidence, logit_offset, result_filter, na_to_null, recode_labels,
        l2_normalize, round_report, report_cells, rebalance_ratio,
        lookup_join, batch_cases, capacity_remainder, case_expert_cross, decision_lookup, join_labels,
        scenario_rosters, complementarity, win_rate,
        confusion_by_expert, rates_by_expert, misclass_cost, cost_with_baseline, weighted_prevalence,
        fpr_disparity, train_outcome_shares, group_mean_nullkeys, mean_ci, weighted_log_loss, roc_auc,
        roc_curve, calibration_curve, ece, tpr_at_fpr, fpr_threshold, pct_improvement, sub_ablation,
        bootstrap_ci, correctness_quality, iso_cost_line,
        expert_ranking, select_best_trial, union_methods, unpivot_metrics, pivot_methods,
        stratified_sample, nested_subsample, bootstrap_oversample,
        defer_reject_all, defer_model_only, defer_random, defer_greedy, defer_optimal,
        defer_optimal_certificate, defer_optimal_two, capacity_audit, fitted_capacity, deferral_grid, deferral_results, deferral_results_all,
    ]
}
