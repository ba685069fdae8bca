"""Registered queries that fit models on the given tables.

Learned scores have no SQL form; each query returns summaries or scores whose rows can be counted.
Small settings keep a run short; the operators take any.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom import config
from caseloom.functions import scalars
from caseloom.operators import deferral, joins, learning, metrics, optimal
from caseloom.plans import inputs
from caseloom.plans.queries import LAMBDA, r6
from caseloom.session import cut_lineage

# Category values of the given tables that stand for the closed domains.
DOMAINS = {
    "payment_type": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
    "employment_status": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
}
NUMERIC = ["customer_age", "f1", "f2"]
HUMANS = [f"standard#{k}" for k in range(9)]
TREES = {"max_depth": 3, "n_estimators": 5, "learning_rate": 0.3, "min_child_samples": 5}


def featured(spark, d) -> DataFrame:
    """Cases with two more numeric features, one of which carries the score."""
    rows = inputs.cases(spark, d)
    return rows.withColumn("f1", F.col("model_score")).withColumn(
        "f2", ((F.col("case_id") * 31) % 101).cast("double")
    ).drop("model_score")


def _log(spark, d) -> DataFrame:
    """One human decision per case of months 3 to 6, the expert rotating with the case id."""
    rows = featured(spark, d).filter(scalars.in_span("month", 3, 7))
    k = (F.col("case_id") % 9).cast("int")
    named = rows.withColumn("assignment", F.concat(F.lit("standard#"), k.cast("string")))
    return learning.decision_log(named.withColumn("decision", inputs.expert_decision(k)), LAMBDA)


def alert_score(spark, d):
    rows = featured(spark, d)
    model = learning.fit_alert_scorer(rows, TREES, DOMAINS, NUMERIC)
    return r6(learning.score_deployment(rows, model).select("case_id", "month", "model_score"), "model_score")


def hyper_search(spark, d):
    ready = learning.with_features(featured(spark, d), DOMAINS, NUMERIC)
    train = ready.filter(scalars.in_span("month", *config.MODEL_SPANS["train"])).persist()
    validation = ready.filter(scalars.in_span("month", *config.MODEL_SPANS["validation"])).persist()
    space = {**config.ALERT_SPACE, "max_depth": (2, 4, False), "n_estimators": (2, 5, True)}
    measure = learning.TprAtFpr()
    try:
        trials, _ = learning.search(
            train,
            validation,
            learning.draw_params(space, 3, config.SAMPLE_SEED),
            lambda df, p: learning.boosted_trees(p, config.LABEL).fit(df),
            lambda scored: -measure.evaluate(learning.positive_probability(scored)),
        )
    finally:
        train.unpersist()
        validation.unpersist()
    return trials


def weighted_classifier(spark, d):
    ready = learning.with_features(featured(spark, d), DOMAINS, NUMERIC)
    spaces = [{**s, "n_estimators": (3, 3, False), "min_child_samples": (5, 20, False)} for s in config.CLASSIFIER_SPACES]
    trials, model = learning.sweep_classifier(ready, LAMBDA, spaces, trials=1, offsets=2)
    scored = model.transform(ready.filter(F.col("month") >= 3)).withColumn("cost", F.lit(LAMBDA))
    return r6(
        learning.classifier_report(scored, [], "cost"), "fpr", "fnr", "prev", "model_cost", "reject_all_cost"
    )


def classifier_report(spark, d):
    rows = inputs.cases(spark, d).withColumn("sub", F.lit(1.0))
    scored = joins.expand_grid(rows, config.COSTS, [])
    out = learning.classifier_report(scored, [], "cost", p="model_score")
    return r6(out, "fpr", "fnr", "prev", "model_cost", "reject_all_cost")


def joint_correctness(spark, d):
    model = learning.fit_joint(_log(spark, d), TREES, HUMANS, DOMAINS, NUMERIC)
    test = featured(spark, d).filter(F.col("month") == 7)
    return r6(learning.score_joint(test, model, HUMANS), "p_correct")


def _one_vs_all(spark, d) -> DataFrame:
    params = {**TREES, "n_estimators": 2, "max_depth": 2}
    models = learning.fit_one_vs_all(_log(spark, d), params, HUMANS, DOMAINS, NUMERIC)
    test = featured(spark, d).filter(F.col("month") == 7)
    return learning.score_one_vs_all(test, models, DOMAINS, NUMERIC)


def ova_correctness(spark, d):
    return r6(_one_vs_all(spark, d), "p_correct")


def pair_scores(spark, d):
    pairs = joint_correctness(spark, d)
    own = featured(spark, d).filter(F.col("month") == 7).select("case_id", F.col("f1").alias("p"))
    return r6(learning.with_classifier(pairs, own), "p_correct")


def learned_deferral(spark, d):
    """Greedy and optimal assignment on learned probabilities, judged by the error rate."""
    rows = inputs.cases(spark, d)
    placed = inputs.batches(rows)
    cap = inputs.capacity(placed)
    placed = placed.select("batch", "pos", "case_id")
    names = F.when(F.col("expert") == joins.MODEL, 9).otherwise(F.substring_index("expert", "#", -1).cast("int"))
    pairs = pair_scores(spark, d).withColumn("expert", names)
    pred = cut_lineage(placed.join(pairs, "case_id"))
    labels = rows.select("case_id", "fraud_bool")
    parts = []
    for method, rule, room in (("greedy", deferral.greedy, cap), ("optimal", optimal.optimal, inputs.fitted(cap))):
        chosen = rule(pred, room).join(labels, "case_id").withColumn("decision", inputs.expert_decision(F.col("expert")))
        parts.append(
            metrics.with_rates(metrics.confusion(chosen.withColumn("method", F.lit(method)), ["method"], "fraud_bool", "decision"))
        )
    return r6(parts[0].unionByName(parts[1]), "fpr", "fnr", "tpr", "prevalence", "error_rate")


LEARNING = {
    f.__name__: f
    for f in [
        alert_score, hyper_search, weighted_classifier, classifier_report, joint_correctness,
        ova_correctness, pair_scores, learned_deferral,
    ]
}
