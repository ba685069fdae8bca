import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from caseloom.operators import ordering, sampling


@pytest.fixture(autouse=True, params=[1_000_000, 0], ids=["plain", "bucketed"])
def group_limit(request, monkeypatch):
    monkeypatch.setattr(ordering, "PLAIN_ROWS", request.param)


def hot_frame(n=3000, seed=1):
    """One group and one value hold a third of all rows."""
    rng = np.random.default_rng(seed)
    group = np.where(rng.random(n) < 0.4, "hot", rng.choice(list("abcd"), n))
    value = np.where(rng.random(n) < 0.35, 0.5, rng.random(n).round(3))
    return pd.DataFrame({"id": np.arange(n), "g": group, "v": value})


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, descending):
    frame = hot_frame()
    out = ordering.running_totals(spark.createDataFrame(frame), ["g"], "v", {"n": F.lit(1)}, descending).toPandas()
    per = frame.groupby(["g", "v"]).size().rename("n").reset_index().sort_values("v", ascending=not descending)
    per["before"] = per.groupby("g")["n"].cumsum() - per["n"]
    both = out.merge(per, on=["g", "v"])
    assert len(both) == len(per) == len(out)
    assert (both["n_x"] == both["n_y"]).all() and (both["n_before"] == both["before"]).all()
    assert (out["n_all"] == out["g"].map(frame.groupby("g").size())).all()


@pytest.mark.parametrize("partitions", [1, 4, 32])
def test_numbering_does_not_depend_on_the_layout(spark, partitions):
    frame = hot_frame(1000)
    frame["m"] = frame["id"] % 3
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        df = spark.createDataFrame(frame.sample(frac=1, random_state=partitions)).repartition(partitions)
        out = ordering.numbered(df, ["g"], "id", "pos", outer=["m"]).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = frame.sort_values(["m", "id"])
    want["want"] = want.groupby("g").cumcount()
    assert (out.set_index("id")["pos"].sort_index() == want.set_index("id")["want"].sort_index()).all()


def test_quantiles_are_exact(spark):
    frame = hot_frame(777)
    probs = [i / 10 for i in range(11)]
    totals = ordering.running_totals(spark.createDataFrame(frame), ["g"], "v", {"n": F.lit(1)})
    for r in ordering.quantile_points(totals, ["g"], "v", "n", probs).collect():
        want = np.percentile(frame.loc[frame["g"] == r["g"], "v"], np.array(probs) * 100)
        assert np.allclose(r["edges"], want)


def test_single_value_and_single_row(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 3.0)], "g string, v double")
    totals = ordering.running_totals(df, ["g"], "v", {"n": F.lit(1)})
    got = {r["g"]: r["edges"] for r in ordering.quantile_points(totals, ["g"], "v", "n", [0.0, 0.5, 1.0]).collect()}
    assert got == {"a": [1.0] * 3, "b": [3.0] * 3}


def test_null_keys_stay_at_any_size(spark):
    rows = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", 3.0)], "k string, v double")
    got = ordering.numbered(rows, ["k"], "v", "place").collect()
    assert sorted((r["k"] or "", r["v"], r["place"]) for r in got) == [("", 1.0, 0), ("", 2.0, 1), ("a", 3.0, 0)]
    assert ordering.running_totals(rows, ["k"], "v", {"n": F.lit(1)}).count() == 3
    outer = ordering.numbered(rows, [], "v", "place", outer=["k"]).collect()
    assert sorted(r["place"] for r in outer) == [0, 1, 2]


def test_draws_spread_over_partitions(spark):
    groups = spark.range(5000).select(F.col("id").alias("k"), F.lit(3).alias("n"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = sampling.draws(groups, "n").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(r["count"] for r in parts) == 15000 and len(parts) > 1
