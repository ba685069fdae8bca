"""Learning jobs on MLlib: alert scorer, cost-weighted classifier, models of expert correctness.

Trees, fits and scoring are distributed by MLlib.  The driver only loops over trials, offsets or
experts, several at a time, as MLlib's own tuning does.
"""

from __future__ import annotations

import hashlib
import json
import math
import random
import threading
import uuid
from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressionModel, GeneralizedLinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom import config
from caseloom.functions import scalars
from caseloom.operators import alerts, joins, metrics
from caseloom.session import cut_lineage, use_checkpoint_dir

FEATURES = "features"
WEIGHT = "weight"
ROUNDS_PER_CHECKPOINT = 10


def in_parallel(spark: SparkSession, jobs: Sequence[Callable], width: int) -> list:
    """Run Spark jobs from a few driver threads and keep their order."""
    if not jobs:
        return []
    inherit = inheritable_thread_target(spark)
    spark_jobs = [inherit(j) for j in jobs]
    with ThreadPool(min(width, len(jobs))) as pool:
        return pool.map(lambda j: j(), spark_jobs)


# --- features -----------------------------------------------------------------------------


def feature_stages(domains: dict[str, Sequence[str]], numeric: Sequence[str]) -> list[Transformer]:
    """Index the categories on their closed domains and assemble all features.

    Nothing is fitted: a value outside its domain, or null, gets an index of its own.
    """
    stages = [
        StringIndexerModel.from_labels(list(labels), inputCol=c, outputCol=f"_{c}_ix", handleInvalid="keep")
        for c, labels in domains.items()
    ]
    inputs = [f"_{c}_ix" for c in domains] + list(numeric)
    return [*stages, VectorAssembler(inputCols=inputs, outputCol=FEATURES, handleInvalid="keep")]


def with_features(rows: DataFrame, domains: dict[str, Sequence[str]], numeric: Sequence[str]) -> DataFrame:
    conformed = rows.withColumns({c: scalars.conform(c, labels) for c, labels in domains.items()})
    return PipelineModel(feature_stages(domains, numeric)).transform(conformed).drop(*[f"_{c}_ix" for c in domains])


def positive_probability(scored: DataFrame, name: str = "p", column: str = "probability") -> DataFrame:
    return scored.withColumn(name, F.get(vector_to_array(column), 1))


# --- search -------------------------------------------------------------------------------


def draw_params(space: dict, n: int, seed: int) -> list[dict]:
    """``n`` random settings of a search space; log-scaled ranges are drawn on the log scale."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        one = {}
        for name, bounds in space.items():
            if not isinstance(bounds, tuple):
                continue
            low, high, log = bounds
            x = math.exp(rng.uniform(math.log(low), math.log(high))) if log else rng.uniform(low, high)
            one[name] = round(x) if isinstance(low, int) and isinstance(high, int) else x
        out.append(one)
    return out


def boosted_trees(params: dict, label: str, weight: str | None = None, validation: str | None = None, seed: int = 42) -> GBTClassifier:
    """Gradient-boosted trees for one setting.

    The leaf limit enters as a depth limit.  Regularisation of leaf values has no counterpart here.
    """
    depth = min(int(params.get("max_depth", 5)), math.ceil(math.log2(max(2, params.get("num_leaves", 2**20)))))
    tool = GBTClassifier(
        featuresCol=FEATURES,
        labelCol=label,
        maxDepth=max(1, depth),
        maxIter=int(params.get("n_estimators", 20)),
        stepSize=float(params.get("learning_rate", 0.1)),
        minInstancesPerNode=int(params.get("min_child_samples", 1)),
        subsamplingRate=float(params.get("subsample", 1.0)),
        maxBins=64,
        seed=seed,
    )
    if weight:
        tool = tool.setWeightCol(weight)
    if validation:
        tool = tool.setValidationIndicatorCol(validation)
    return tool


class BestSoFar:
    """Holds the model of the lowest loss (the first of equals) among those offered by several threads."""

    def __init__(self):
        self._lock, self.place, self.model = threading.Lock(), (math.inf, math.inf), None

    def offer(self, loss: float, trial: int, model: Transformer | None) -> None:
        with self._lock:
            if (loss, trial) < self.place or self.model is None and (loss, trial) == self.place:
                self.place, self.model = (loss, trial), model


def trial_key(params: dict) -> str:
    """Name of a setting, the same in every run."""
    return hashlib.md5(json.dumps(params, sort_keys=True).encode()).hexdigest()


def search(
    train: DataFrame,
    validation: DataFrame,
    settings: Sequence[dict],
    fit: Callable[[DataFrame, dict], Transformer],
    loss: Callable[[DataFrame], float],
    width: int = 4,
    log=None,
) -> tuple[DataFrame, Transformer]:
    """Fit every setting, score it on the validation rows, keep the lowest loss (the first of equals).

    Returns the trial log and the best model.  Models are dropped as soon as a better one is known, so the driver holds one besides the
    ``width`` being fitted.  With a ``log`` (:class:`caseloom.sources.registry.TrialLog`) every trial is written when it ends, and a search
    that was stopped goes on with the settings not in it; if the best is one of the earlier run, it is fitted once more.
    A loss that is no number is the worst.
    """
    known = log.finished() if log is not None else {}
    best = BestSoFar()

    def job(trial: int, params: dict) -> float:
        key = trial_key(params)
        if key in known:
            best.offer(known[key], trial, None)
            return known[key]
        model = fit(train, params)
        value = float(loss(model.transform(validation)))
        value = math.inf if math.isnan(value) else value
        best.offer(value, trial, model)
        if log is not None:
            log.append(key, trial, value, params)
        return value

    done = in_parallel(train.sparkSession, [lambda i=i, p=p: job(i, p) for i, p in enumerate(settings)], width)
    rows = [(i, value, *[float(v) for v in p.values()]) for i, (value, p) in enumerate(zip(done, settings))]
    schema = T.StructType(
        [T.StructField("trial", T.IntegerType()), T.StructField("loss", T.DoubleType())]
        + [T.StructField(n, T.DoubleType()) for n in settings[0]]
    )
    model = best.model if best.model is not None else fit(train, settings[int(best.place[1])])
    return train.sparkSession.createDataFrame(rows, schema), model


class TprAtFpr(Evaluator):
    """True-positive rate at a fixed false-positive rate; larger is better."""

    def __init__(self, label: str = config.LABEL, score: str = "p", rate: float = 0.05):
        super().__init__()
        self.label, self.score, self.rate = label, score, rate

    def _evaluate(self, dataset: DataFrame) -> float:
        found = alerts.threshold_at_fpr(dataset, [], self.label, self.score, [self.rate]).select("tpr").first()
        return float(found["tpr"]) if found and found["tpr"] is not None else 0.0

    def isLargerBetter(self) -> bool:
        return True


def weighted_loss(label: str, p: str = "p", weight: str = WEIGHT) -> Callable[[DataFrame], float]:
    def loss(scored: DataFrame) -> float:
        return metrics.weighted_log_loss(scored, [], label, p, F.col(weight)).first()["log_loss"]

    return loss


# --- alert scorer ---------------------------------------------------------------------------


def fit_alert_scorer(
    rows: DataFrame, params: dict, domains: dict[str, Sequence[str]], numeric: Sequence[str]
) -> PipelineModel:
    """Trees on the training months, stopped early on the validation month."""
    a, b = config.MODEL_SPANS["train"]
    _, c = config.MODEL_SPANS["validation"]
    use_checkpoint_dir(rows.sparkSession)
    used = rows.filter(scalars.in_span(config.TIMESTAMP, a, c)).withColumn(
        "_validation", F.col(config.TIMESTAMP) >= b
    )
    trees = boosted_trees(params, config.LABEL, validation="_validation")
    return Pipeline(stages=[*feature_stages(domains, numeric), trees]).fit(used)


def score_deployment(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """Deployment rows with ``model_score``; the month is kept for the alert tables."""
    a, b = config.MODEL_SPANS["deployment"]
    scored = model.transform(rows.filter(scalars.in_span(config.TIMESTAMP, a, b)))
    return positive_probability(scored, "model_score").select(*rows.columns, "model_score")


# --- classifier with an initial score -------------------------------------------------------


class OffsetTrees(Transformer):
    """Boosted trees that start from a fixed log-odds offset; adds ``raw`` and ``p``."""

    def __init__(self, init: float, trees: GBTRegressionModel | None):
        super().__init__()
        self.init, self.trees = init, trees

    def _transform(self, rows: DataFrame) -> DataFrame:
        if self.trees is None:
            out = rows.withColumn("raw", F.lit(self.init))
        else:
            boosted = self.trees.setPredictionCol("_boost").transform(rows)
            out = boosted.withColumn("raw", F.lit(self.init) + F.col("_boost")).drop("_boost")
        return out.withColumn("p", scalars.sigmoid("raw"))

    def save(self, path: str, spark: SparkSession) -> None:
        """The trees as an MLlib model, the offset as a one-row table beside it."""
        self.trees.write().overwrite().save(f"{path}/trees")
        spark.createDataFrame([(self.init,)], "init double").write.mode("overwrite").parquet(f"{path}/start")

    @staticmethod
    def load(path: str, spark: SparkSession) -> OffsetTrees:
        return OffsetTrees(spark.read.parquet(f"{path}/start").first()["init"], GBTRegressionModel.load(f"{path}/trees"))


def weighted_sum(spark: SparkSession, trees: Sequence, rate: float) -> GBTRegressionModel | None:
    """Fitted regression trees as one MLlib ensemble, so that scoring is a single pass."""
    if not trees:
        return None
    gateway = spark.sparkContext._gateway
    ml = gateway.jvm.org.apache.spark.ml.regression
    listed = gateway.new_array(ml.DecisionTreeRegressionModel, len(trees))
    weights = gateway.new_array(gateway.jvm.double, len(trees))
    for i, tree in enumerate(trees):
        listed[i], weights[i] = tree._java_obj, float(rate)
    model = GBTRegressionModel(ml.GBTRegressionModel(f"gbtr_{uuid.uuid4().hex[:12]}", listed, weights))
    return model.setFeaturesCol(FEATURES)


def fit_offset_trees(
    rows: DataFrame, label: str, weight: str, init: float, params: dict, seed: int = 42
) -> OffsetTrees:
    """Boosting in which every round fits a regression tree to the Newton step of the weighted loss.

    With target ``(y - p) / (p (1 - p))`` and weight ``w p (1 - p)`` a leaf's mean is the Newton
    step of its rows, so the offset acts as the starting score.  Only features, label, weight and
    raw score are carried; their lineage is cut every few rounds.
    """
    rate = float(params.get("learning_rate", 0.1))
    state = rows.select(FEATURES, F.col(label).cast("double").alias("_y"), F.col(weight).alias("_w"), F.lit(float(init)).alias("_raw"))
    trees = []
    for i in range(int(params.get("n_estimators", 20))):
        p = F.least(F.greatest(scalars.sigmoid("_raw"), F.lit(1e-6)), F.lit(1 - 1e-6))
        step = state.withColumn("_p", p).select(
            FEATURES,
            ((F.col("_y") - F.col("_p")) / (F.col("_p") * (1 - F.col("_p")))).alias("_step"),
            (F.col("_w") * F.col("_p") * (1 - F.col("_p"))).alias("_h"),
        )
        tree = DecisionTreeRegressor(
            featuresCol=FEATURES,
            labelCol="_step",
            weightCol="_h",
            predictionCol="_t",
            maxDepth=int(params.get("max_depth", 3)),
            minInstancesPerNode=int(params.get("min_child_samples", 1)),
            maxBins=64,
            seed=seed + i,
        ).fit(step)
        trees.append(tree)
        state = tree.transform(state).withColumn("_raw", F.col("_raw") + F.lit(rate) * F.col("_t")).drop("_t")
        if (i + 1) % ROUNDS_PER_CHECKPOINT == 0:
            state = cut_lineage(state)
    return OffsetTrees(float(init), weighted_sum(rows.sparkSession, trees, rate))


def fit_offset_linear(rows: DataFrame, label: str, weight: str, init: float, reg: float = 0.01):
    """Weighted logistic regression in which the offset takes the place of the intercept."""
    with_offset = rows.withColumn("_offset", F.lit(float(init)))
    return GeneralizedLinearRegression(
        family="binomial",
        featuresCol=FEATURES,
        labelCol=label,
        weightCol=weight,
        offsetCol="_offset",
        predictionCol="p",
        fitIntercept=False,
        regParam=reg,
        maxIter=25,
    ).fit(with_offset)


def sweep_classifier(
    rows: DataFrame,
    cost: float,
    spaces: Sequence[dict],
    trials: int | Sequence[int],
    offsets: int = config.OFFSET_STEPS,
    seed: int = 42,
    width: int = 4,
    log=None,
) -> tuple[DataFrame, OffsetTrees]:
    """Studies over search spaces x starting offsets, each a random search by weighted log loss.

    ``rows`` hold features, label and month.  The offset starts at the weighted log-odds of the
    training months and grows in fixed steps.  Returns the trial log and the model of the best study.
    """
    weighted = rows.withColumn(WEIGHT, scalars.cost_weight(config.LABEL, float(cost)))
    train = weighted.filter(scalars.in_span(config.TIMESTAMP, *config.ALERT_SPANS["train"])).persist()
    validation = weighted.filter(scalars.in_span(config.TIMESTAMP, *config.ALERT_SPANS["validation"])).persist()
    try:
        start = metrics.weighted_prevalence(train, [], config.LABEL, F.col(WEIGHT)).first()["init_log_odds"]
        counts = [trials] * len(spaces) if isinstance(trials, int) else trials
        settings = [
            {"study": s * offsets + i, "init_score": start + config.OFFSET_WIDTH * i, **params}
            for s, space in enumerate(spaces)
            for i in range(offsets)
            for params in draw_params(space, counts[s], seed)
        ]
        return search(
            train,
            validation,
            settings,
            lambda df, p: fit_offset_trees(df, config.LABEL, WEIGHT, p["init_score"], p, seed),
            weighted_loss(config.LABEL),
            width,
            log,
        )
    finally:
        train.unpersist()
        validation.unpersist()


def classifier_report(scored: DataFrame, keys: Sequence[str], cost: str, p: str = "p", threshold: float = 0.5) -> DataFrame:
    """Per split: rates, prevalence and cost of the thresholded classifier and of rejecting all."""
    keys = list(keys)
    rows = scored.withColumn("split", scalars.span_name(config.TIMESTAMP, config.ALERT_SPANS))
    rows = rows.filter(F.col("split").isNotNull()).withColumn("_d", scalars.binarize(p, threshold))
    rates = metrics.with_rates(metrics.confusion(rows, [*keys, cost, "split"], config.LABEL, "_d"))
    lam = F.col(cost)
    return rates.select(
        *keys,
        cost,
        "split",
        "fpr",
        "fnr",
        F.col("prevalence").alias("prev"),
        metrics.misclassification_cost(cost).alias("model_cost"),
        scalars.ratio(lam * (F.col("tn") + F.col("fp")), F.col("n")).alias("reject_all_cost"),
    )


# --- models of expert correctness -----------------------------------------------------------

CORRECT = "correct"


def decision_log(rows: DataFrame, cost: float, model: str = joins.MODEL) -> DataFrame:
    """Training log of human decisions with the correctness label and the case weight."""
    human = rows.filter(F.col("assignment") != model)
    return human.withColumn(CORRECT, scalars.is_correct("decision", config.LABEL)).withColumn(
        WEIGHT, scalars.cost_weight(config.LABEL, float(cost))
    )


def fit_joint(
    log: DataFrame, params: dict, experts: Sequence[str], domains: dict[str, Sequence[str]], numeric: Sequence[str]
) -> PipelineModel:
    """One model for the whole team; the expert is a categorical feature."""
    use_checkpoint_dir(log.sparkSession)
    full = {**domains, "assignment": list(experts)}
    trees = boosted_trees(params, CORRECT, weight=WEIGHT)
    return Pipeline(stages=[*feature_stages(full, numeric), trees]).fit(log)


def fit_one_vs_all(
    log: DataFrame,
    params: dict,
    experts: Sequence[str],
    domains: dict[str, Sequence[str]],
    numeric: Sequence[str],
    width: int = 4,
) -> dict[str, Transformer]:
    """An independent model per expert, fitted on that expert's decisions.

    ``params`` is one setting for all experts or a setting per expert.
    """
    use_checkpoint_dir(log.sparkSession)
    ready = with_features(log, domains, numeric).select("assignment", FEATURES, CORRECT, WEIGHT).persist()
    try:
        jobs = [
            lambda e=e: boosted_trees(params.get(e, params), CORRECT, weight=WEIGHT).fit(ready.filter(F.col("assignment") == e))
            for e in experts
        ]
        return dict(zip(experts, in_parallel(log.sparkSession, jobs, width)))
    finally:
        ready.unpersist()


def score_joint(cases: DataFrame, model: PipelineModel, experts: Sequence[str]) -> DataFrame:
    """Probability of being right for every (case, expert)."""
    pairs = joins.score_pairs(cases, experts, "assignment")
    scored = positive_probability(model.transform(pairs), "p_correct")
    return scored.select("case_id", F.col("assignment").alias("expert"), "p_correct")


def score_one_vs_all(
    cases: DataFrame, models: dict[str, Transformer], domains: dict[str, Sequence[str]], numeric: Sequence[str]
) -> DataFrame:
    """The same from one model per expert: the cases are read once and get one column per expert."""
    wide = with_features(cases, domains, numeric).select("case_id", FEATURES)
    names = {}
    for i, (expert, model) in enumerate(models.items()):
        out = model.copy()
        out.setPredictionCol("").setRawPredictionCol("").setProbabilityCol(f"_p{i}")
        wide = out.transform(wide)
        names[expert] = F.get(vector_to_array(f"_p{i}"), 1)
    wide = wide.select("case_id", *[c.alias(e) for e, c in names.items()])
    return wide.unpivot(["case_id"], list(names), "expert", "p_correct")


def with_classifier(pairs: DataFrame, classifier: DataFrame, model: str = joins.MODEL) -> DataFrame:
    """Add the classifier's own confidence, from its probabilities ``p`` per case, as one more expert."""
    own = classifier.select("case_id", F.lit(model).alias("expert"), scalars.self_confidence("p").alias("p_correct"))
    return pairs.unionByName(own)
