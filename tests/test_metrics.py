import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.functions import hashing, scalars
from caseloom.operators import alerts, evaluation, joins, metrics, ordering, sampling


@pytest.fixture(autouse=True, params=[1_000_000, 0], ids=["plain", "bucketed"])
def group_limit(request, monkeypatch):
    monkeypatch.setattr(ordering, "PLAIN_ROWS", request.param)
    monkeypatch.setattr(joins, "BROADCAST_ROWS", request.param)


def test_threshold_with_ties_and_with_no_allowed_positive(spark):
    rows = [("a", 0, s) for s in (0.9, 0.8, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1)] + [("a", 1, 0.85), ("a", 1, 0.8), ("a", 1, 0.1)]
    rows += [("few", 0, 0.5), ("few", 1, 0.9)]
    df = spark.createDataFrame(rows, "g string, y int, s double")
    got = {(r["g"], r["rate"]): r for r in alerts.threshold_at_fpr(df, ["g"], "y", "s", [0.05, 0.2, 0.25]).collect()}
    assert got["a", 0.2]["k"] == 2 and got["a", 0.2]["threshold"] == 0.8
    assert math.isclose(got["a", 0.2]["tpr"], 2 / 3)
    assert got["a", 0.25]["k"] == 2  # 2.5 rounds to the even number
    assert got["few", 0.05]["k"] == 0 and got["few", 0.05]["threshold"] == math.inf and got["few", 0.05]["tpr"] == 0.0
    assert len(got) == 6
    limits = alerts.threshold_at_fpr(df.filter("g = 'a'"), [], "y", "s", [0.2])
    raised = alerts.raise_alerts(df.filter("g = 'a'").withColumnRenamed("s", "model_score"), limits)
    assert sorted(r["model_score"] for r in raised.collect()) == [0.85, 0.9]  # strictly above


def test_auc_and_rates_of_a_single_class_are_null(spark):
    df = spark.createDataFrame([("one", 1, 0.3), ("one", 1, 0.4), ("two", 0, 0.1), ("two", 1, 0.1)], "g string, y int, s double")
    auc = {r["g"]: r["auc"] for r in metrics.roc_auc(df, ["g"], "y", "s").collect()}
    assert auc == {"one": None, "two": 0.5}
    counts = metrics.confusion(df.withColumn("d", F.lit(1)), ["g"], "y", "d")
    rates = {r["g"]: r for r in metrics.with_rates(counts).collect()}
    assert rates["one"]["fpr"] is None and rates["one"]["tpr"] == 1.0


def test_weights_equal_written_out_copies(spark):
    rng = np.random.default_rng(0)
    rows = [(i, int(rng.random() < 0.4), float(rng.integers(0, 20)) / 20, int(rng.integers(1, 5))) for i in range(200)]
    df = spark.createDataFrame(rows, "case_id int, y int, p double, copies long").withColumn("g", F.lit("x"))
    full = sampling.expand_copies(df)
    for measure in (
        lambda d, w: metrics.roc_auc(d, ["g"], "y", "p", weight=w),
        lambda d, w: metrics.calibration_curve(d, ["g"], "y", "p", weight=w),
        lambda d, w: metrics.roc_curve(d, ["g"], "y", "p", weight=w),
    ):
        a = sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in measure(df, "copies").collect())
        b = sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in measure(full, None).collect())
        assert a == b


def test_equal_probabilities_fill_one_bin(spark):
    df = spark.createDataFrame([(1, 0.5)] * 6 + [(0, 0.5)] * 2, "y int, p double").withColumn("g", F.lit(1))
    curve = metrics.calibration_curve(df, ["g"], "y", "p").collect()
    assert [(r["bin"], r["n"], r["mean_outcome"]) for r in curve] == [(9, 8, 0.75)]
    assert metrics.calibration_error(metrics.calibration_curve(df, ["g"], "y", "p"), ["g"]).first()["ece"] == 0.25


def test_roc_curve_drops_points_inside_a_straight_run(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (1, 0.7), (0, 0.6), (0, 0.5)], "y int, s double")
    got = [(r["threshold"], r["fpr"], round(r["tpr"], 3)) for r in metrics.roc_curve(df, [], "y", "s").collect()]
    assert sorted(got, reverse=True) == [(1.9, 0.0, 0.0), (0.9, 0.0, 0.333), (0.7, 0.0, 1.0), (0.5, 1.0, 1.0)]
    assert metrics.roc_curve(df, [], "y", "s", drop_collinear=False).count() == 6


def test_null_group_keys_are_kept_or_dropped(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "k string, v double")
    assert {(r["k"], r["v"]) for r in metrics.group_mean(df, ["k"], ["v"]).collect()} == {(None, 2.0), ("a", 5.0)}
    assert {(r["k"], r["v"]) for r in metrics.group_mean(df, ["k"], ["v"], keep_null_keys=False).collect()} == {("a", 5.0)}


def test_complementarity_equals_the_pairwise_definition(spark):
    rng = np.random.default_rng(1)
    ok = rng.integers(0, 2, (50, 3))
    df = spark.createDataFrame([(i, k, int(ok[i, k])) for i in range(50) for k in range(3)], "case_id int, expert int, correct int")
    for r in metrics.complementarity(df, [], [0, 1, 2]).collect():
        assert math.isclose(r["share"], ((ok[:, r["expert"]] == 1) & (ok[:, r["other"]] == 0)).mean())


def test_domains_sentinels_and_names(spark):
    df = spark.createDataFrame([("AA", "NA", "alert_0.05-data_0.05-sub_0.50-l_0.057", "x#variable-3_y"), (None, "q", "alert_0.15-data_0.05", "z-1#homogenous_y"), ("ZZ", None, "alert_0.15-data_0.05-l_0.285", "z#homogenous_y")], "c string, s string, scen string, env string")
    fields = {**scalars.scenario_fields("scen"), **scalars.environment_fields("env")}
    rows = df.select(
        scalars.conform("c", ["AA", "AB"]).alias("c"), scalars.domain_code("c", ["AA", "AB"]).alias("code"),
        scalars.na_to_null("s").alias("s"), *[v.alias(k) for k, v in fields.items()],
    ).collect()
    assert [r["c"] for r in rows] == ["AA", None, None] and [r["code"] for r in rows] == [0, None, None]
    assert [r["s"] for r in rows] == [None, "q", None]
    assert [(r["alert_rate"], r["sub"], r["cost"]) for r in rows] == [(0.05, 0.5, 0.057), (0.15, 1.0, None), (0.15, 1.0, 0.285)]
    assert [(r["distribution"], r["distribution_seed"]) for r in rows] == [("variable", "3"), ("homogenous", None), ("homogenous", None)]


def test_win_rate_pairs_by_environment_and_seed(spark):
    rows = [(0.05, 0.057, e, s, m, c) for e, s, m, c in [
        ("e1", "1", "best", 1.0), ("e2", "1", "best", 5.0), ("e1", "2", "best", 1.0), ("e2", "2", "best", 1.0),
        ("e1", "1", "other", 2.0), ("e2", "1", "other", 4.0), ("e1", "2", "other", 0.5), ("e2", "2", "other", 3.0),
        ("e1", None, "plain", 3.0), ("e2", None, "plain", 3.0)]]
    df = spark.createDataFrame(rows, "alert_rate double, cost double, env string, seed string, method string, c double")
    got = {r["baseline"]: r["win_rate"] for r in metrics.win_rate(df, "best", ["other"], ["other", "plain"], "c").collect()}
    assert got == {"other": 0.5, "plain": 0.75}


def test_evaluation_row(spark):
    dec = spark.createDataFrame([("alert_0.05-data_0.05", 0.1, "NA", "m", "x#homogenous_1", i, p) for i, p in enumerate([1, 1, 0, 0])], "scen string, cost double, seed string, method string, env string, case_id int, prediction int")
    cases = spark.createDataFrame([(0, 1, 60), (1, 0, 60), (2, 1, 30), (3, 0, 30)], "case_id int, fraud_bool int, customer_age int")
    r = evaluation.evaluate_runs(dec, cases).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (1, 1, 1, 1) and r["seed"] is None and r["sub"] == 1.0
    assert math.isclose(r["cost_per_100"], (0.1 + 1) / 4 * 100) and r["fpr_disp"] == 0.0


def test_sample_sizes_and_failures(spark):
    df = spark.createDataFrame([("r", i % 2, i) for i in range(101)], "k string, month int, case_id int")
    sizes = spark.createDataFrame([(0, 10), (1, 7)], "month int, n_take long")
    out = sampling.stratified_sample(df, ["k"], "month", sizes, 42)
    assert {r["month"]: r["count"] for r in out.groupBy("month").count().collect()} == {0: 10, 1: 7}
    same = sampling.stratified_sample(df.repartition(7), ["k"], "month", sizes, 42)
    assert {r["case_id"] for r in out.collect()} == {r["case_id"] for r in same.collect()}
    with pytest.raises(Exception, match="stratum too small"):
        sampling.stratified_sample(df, ["k"], "month", sizes.withColumn("n_take", F.lit(60).cast("long")), 42).collect()
    nested = sampling.nested_subsample(out, ["k"], "month", [0.5, 0.25], 42, keep_whole=1)
    got = {(r["sub"], r["month"]): r["count"] for r in nested.groupBy("sub", "month").count().collect()}
    assert got == {(1.0, 0): 10, (1.0, 1): 7, (0.5, 0): 5, (0.5, 1): 7, (0.25, 0): 2, (0.25, 1): 7}


def test_oversample_draws_exactly_the_asked_number(spark):
    df = spark.createDataFrame([("a", int(i % 4 == 0), i) for i in range(40)], "g string, y int, case_id int")
    asked = spark.createDataFrame([("a", 25_003)], "g string, n_pos long")
    out = sampling.oversample_positives(df, ["g"], "y", asked, 42)
    sums = {r["y"]: r["s"] for r in out.groupBy("y").agg(F.sum("copies").alias("s")).collect()}
    assert sums == {0: 30, 1: 25_003}


def test_poisson_counts_and_bootstrap_intervals(spark):
    rng = np.random.default_rng(1)
    rows = [("a", i, float(x), float(x) * 2 if i % 3 else None) for i, x in enumerate(rng.normal(5, 2, 400))]
    rows += [(None, 1000, 3.0, None)]
    df = spark.createDataFrame(rows, "g string, id long, u double, v double").repartition(3)
    counts = [r[0] for r in spark.range(20_000).select(metrics.poisson_count(hashing.seeded_hash(42, "id")).alias("m")).collect()]
    assert abs(np.mean(counts) - 1) < 0.03 and abs(np.var(counts) - 1) < 0.06
    got = {(r["g"], r["measure"]): r for r in metrics.bootstrap_ci(df, ["g"], ["u", "v"], ["id"], replicates=300).collect()}
    assert set(got) == {("a", "u"), ("a", "v"), (None, "u"), (None, "v")}
    for name, place in (("u", 2), ("v", 3)):
        x = np.array([r[place] for r in rows if r[0] == "a" and r[place] is not None])
        r, half = got["a", name], 1.96 * x.std() / np.sqrt(len(x))
        assert r["mean"] == pytest.approx(x.mean())
        assert r["ci_low"] == pytest.approx(x.mean() - half, abs=half / 3) and r["ci_high"] == pytest.approx(x.mean() + half, abs=half / 3)
    assert tuple(got[None, "u"])[2:] == (3.0, 3.0, 3.0) and got[None, "v"]["mean"] is None
    same = metrics.bootstrap_ci(df.repartition(11), ["g"], ["u", "v"], ["id"], replicates=300)
    assert {(r["g"], r["measure"]): r["ci_low"] for r in same.collect()} == pytest.approx({k: r["ci_low"] for k, r in got.items()}, nan_ok=True)
    plan = same._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_quality_of_weighted_probabilities_equals_expanded_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(g, int(rng.random() < 0.4), round(float(rng.random()), 2), int(rng.integers(0, 4))) for g in ("a", None) for _ in range(300)]
    rows += [("one", 1, 0.3, 2)]
    df = spark.createDataFrame(rows, "g string, y int, p double, w long")
    got = {r["g"]: (r["auc"], r["ece"]) for r in metrics.probability_quality(df, ["g"], "y", "p", "w").collect()}
    full = df.filter("w > 0").withColumn("copies", F.col("w"))
    full = sampling.expand_copies(full)
    auc = {r["g"]: r["auc"] for r in metrics.roc_auc(full, ["g"], "y", "p").collect()}
    ece = {r["g"]: r["ece"] for r in metrics.calibration_error(metrics.calibration_curve(full, ["g"], "y", "p"), ["g"]).collect()}
    assert set(got) == {"a", None, "one"} and got["one"][0] is None
    for g, (a, e) in got.items():
        assert a == (None if auc[g] is None else pytest.approx(auc[g])) and e == pytest.approx(ece[g])


def test_oversampling_keeps_null_groups(spark):
    df = spark.createDataFrame([(None, 1, 1), (None, 2, 0), ("a", 3, 1), ("a", 4, 0)], "g string, case_id long, y int")
    asked = spark.createDataFrame([(None, 3), ("a", 2)], "g string, n_pos long")
    out = sampling.oversample_positives(df, ["g"], "y", asked, 42).collect()
    assert {(r["g"], r["case_id"]): r["copies"] for r in out} == {(None, 1): 3, (None, 2): 1, ("a", 3): 2, ("a", 4): 1}


@pytest.mark.parametrize("headroom", [6.0, -2.0])
def test_cut_sample_equals_an_order_of_everything(spark, monkeypatch, headroom):
    monkeypatch.setattr(sampling, "HEADROOM", headroom)
    rows = [(k, m, i) for k in ("a", None) for m in (1, 2) for i in range(400 if k else 40)]
    df = spark.createDataFrame([(k, m, j) for j, (k, m, _) in enumerate(rows)], "k string, month int, case_id long")
    sizes = spark.createDataFrame([(1, 30), (2, 0)], "month int, n_take long")
    got = {r["case_id"] for r in sampling.stratified_sample(df, ["k"], "month", sizes, 42).collect()}
    ranked = sampling.hash_rank(df.filter("month = 1"), ["k", "month"], 42, "case_id", "r").filter("r < 30")
    assert got == {r["case_id"] for r in ranked.collect()} and len(got) == 60
