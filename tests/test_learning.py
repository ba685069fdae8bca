import math

import pytest
from pyspark.sql import functions as F

from caseloom import config
from caseloom.functions import scalars
from caseloom.operators import learning, metrics
from caseloom.plans import learning_queries as lq
from caseloom.sources import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ready(spark):
    rows = learning.with_features(lq.featured(spark, SF), lq.DOMAINS, lq.NUMERIC)
    return rows.withColumn("weight", scalars.cost_weight("fraud_bool", 0.057)).cache()


def test_offset_trees_start_from_the_offset_and_learn(spark, ready, tmp_path):
    start = metrics.weighted_prevalence(ready, [], "fraud_bool", F.col("weight")).first()["init_log_odds"]
    none = learning.OffsetTrees(start, None)
    prior = learning.weighted_loss("fraud_bool")(none.transform(ready))
    model = learning.fit_offset_trees(ready, "fraud_bool", "weight", start, {"n_estimators": 12, "max_depth": 2, "learning_rate": 0.3})
    assert learning.weighted_loss("fraud_bool")(model.transform(ready)) < prior - 0.01
    model.save(str(tmp_path / "m"), spark)
    again = learning.OffsetTrees.load(str(tmp_path / "m"), spark).transform(ready)
    assert sorted(again.select("case_id", "p").collect()) == sorted(model.transform(ready).select("case_id", "p").collect())
    p = none.transform(ready).select("p").distinct().collect()
    assert len(p) == 1 and math.isclose(p[0]["p"], 1 / (1 + math.exp(-start)))


def test_linear_offset_model(spark, ready):
    model = learning.fit_offset_linear(ready, "fraud_bool", "weight", -1.0)
    scored = model.transform(ready.withColumn("_offset", F.lit(-1.0)))
    assert 0 < scored.agg(F.avg("p")).first()[0] < 1


def test_search_keeps_the_first_of_the_best(spark, ready):
    settings = learning.draw_params({**config.EXPERT_SPACE, "max_depth": (2, 3, False), "n_estimators": (2, 3, False)}, 3, 1)
    assert settings == learning.draw_params({**config.EXPERT_SPACE, "max_depth": (2, 3, False), "n_estimators": (2, 3, False)}, 3, 1)
    trials, best = learning.search(
        ready, ready, settings, lambda df, p: learning.boosted_trees(p, "fraud_bool", weight="weight").fit(df),
        lambda s: learning.weighted_loss("fraud_bool")(learning.positive_probability(s)),
    )
    assert trials.count() == 3 and best is not None


def test_evaluator_finds_the_better_score(spark, ready):
    measure = learning.TprAtFpr(score="p")
    good = measure.evaluate(ready.withColumn("p", F.col("fraud_bool") * 0.5 + F.col("f1") * 0.1))
    assert good == 1.0 and measure.isLargerBetter()
    assert measure.evaluate(ready.withColumn("p", F.col("f2"))) < 0.5


def test_saved_scorer_gives_the_same_scores(spark, tmp_path):
    rows = lq.featured(spark, SF)
    model = learning.fit_alert_scorer(rows, lq.TREES, lq.DOMAINS, lq.NUMERIC)
    registry.save_model(model, str(tmp_path / "m"))
    a = learning.score_deployment(rows, model).select("case_id", "model_score").collect()
    b = learning.score_deployment(rows, registry.load_model(str(tmp_path / "m"))).select("case_id", "model_score").collect()
    assert sorted(a) == sorted(b) and len(a) > 0


def test_pair_scores_cover_every_case_and_expert(spark):
    test = lq.featured(spark, SF).filter("month = 7")
    n = test.count()
    joint = lq.joint_correctness(spark, SF)
    single = lq.ova_correctness(spark, SF)
    for pairs in (joint, single):
        assert pairs.count() == n * 9 and pairs.filter("p_correct < 0 OR p_correct > 1").isEmpty()


def test_stopped_search_goes_on_and_holds_one_model(spark, ready, tmp_path):
    space = {**config.EXPERT_SPACE, "max_depth": (2, 3, False), "n_estimators": (2, 3, False)}
    settings = learning.draw_params(space, 5, 1)
    place = {learning.trial_key(p): i for i, p in enumerate(settings)}
    losses = [0.5, 0.2, 0.9, 0.2, float("nan")]
    fitted = []

    class Model:
        def __init__(self, trial):
            self.trial = trial

        def transform(self, rows):
            return self.trial

    def fit(rows, params, stop=None):
        trial = place[learning.trial_key(params)]
        if stop is not None and trial >= stop:
            raise RuntimeError("lost")
        fitted.append(trial)
        return Model(trial)

    log = registry.TrialLog(spark, str(tmp_path / "trials"), {"scen": "a"})
    with pytest.raises(RuntimeError):
        learning.search(ready, ready, settings, lambda df, p: fit(df, p, 3), lambda t: losses[t], width=1, log=log)
    assert fitted == [0, 1, 2] and len(log.finished()) == 3
    trials, best = learning.search(ready, ready, settings, fit, lambda t: losses[t], width=1, log=log)
    assert fitted == [0, 1, 2, 3, 4, 1] and best.trial == 1
    assert [r["loss"] for r in trials.orderBy("trial").collect()] == [0.5, 0.2, 0.9, 0.2, math.inf]
    assert registry.TrialLog(spark, str(tmp_path / "trials"), {"scen": "b"}).finished() == {}
    held = learning.BestSoFar()
    for i in (2, 1, 0, 3):
        held.offer(0.1, i, i)
    assert held.model == 0 and held.place == (0.1, 0)
