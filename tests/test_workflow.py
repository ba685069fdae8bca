"""The whole workflow on tables derived from the given ones, then again with nothing left to do."""

import glob
import os
import shutil

from pyspark.sql import functions as F

from caseloom import config
from caseloom.plans import inputs
from caseloom.plans import learning_queries as lq
from caseloom.plans import workflow
from caseloom.sources import tables

SF = "/root/testdata/sf0.01"
HUMANS = ["standard#0", "standard#1"]


def make_inputs(spark, root):
    rows = lq.featured(spark, SF).withColumns(
        {
            "housing_status": F.lit("BA"),
            "source": F.lit("INTERNET"),
            "device_os": F.lit("linux"),
            "payment_type": F.element_at(F.array(*[F.lit(x) for x in config.DOMAINS["payment_type"]]), (F.col("case_id") % 5 + 1).cast("int")),
            "employment_status": F.lit("CA"),
        }
    )
    order = tables.applications_schema(["f1", "f2"]).names
    rows.select(*order).coalesce(1).write.option("header", True).csv(f"{root}/applications")


def make_experts(spark, root, scen, cost):
    alerts = spark.read.parquet(f"{root}/alerts").filter(F.col("scen") == scen)
    k = (F.col("case_id") % 2).cast("int")
    log = alerts.filter("month BETWEEN 3 AND 6").select(
        F.lit(scen).alias("scen"), F.lit(cost).alias("cost"), F.lit("5k-1#regular").alias("seed"), "case_id",
        F.concat(F.lit("standard#"), k.cast("string")).alias("assignment"), F.lit(1).alias("batch"),
        inputs.expert_decision(k).alias("decision"),
    )
    log.write.mode("append").parquet(f"{root}/decisions")
    test = alerts.filter("month = 7")
    agents = [(i, h) for i, h in enumerate(HUMANS)] + [(9, "model#0")]
    for i, name in agents:
        p = F.lit(0.3) + F.col("fraud_bool") * 0.4 if name == "model#0" else inputs.expert_decision(F.lit(i)).cast("double")
        test.select(F.lit(scen).alias("scen"), F.lit(cost).alias("cost"), "case_id", F.lit(name).alias("expert"), p.alias("p")).write.mode("append").parquet(f"{root}/predictions")
    ids = [r["case_id"] for r in test.select("case_id").orderBy("case_id").collect()]
    for env in ("batch#homogenous_0", "batch#variable-1_0"):
        folder = f"{root}/testbed/{scen}-l_{cost}/{env}"
        os.makedirs(folder)
        half = len(ids) // 2
        with open(f"{folder}/batches.csv", "w") as f:
            f.write("case_id,batch\n" + "".join(f"{c},{1 if i < half else 2}\n" for i, c in enumerate(ids)))
        with open(f"{folder}/capacity.csv", "w") as f:
            f.write("batch_id,batch_size,standard#0,standard#1\n")
            f.writelines(f"{b},{n},{n // 3},{n // 4}\n" for b, n in ((1, half), (2, len(ids) - half)))
    return len(ids)


def test_workflow(spark, tmp_path):
    root = str(tmp_path)
    make_inputs(spark, root)
    small = {"max_depth": (2, 3, False), "n_estimators": (2, 2, False), "learning_rate": (0.2, 0.4, False)}
    s = workflow.Settings(
        root, None, ["f1", "f2"], costs=[0.057], alert_space=small, classifier_spaces=[small], expert_space=small, trials=1, offsets=1
    )
    workflow.run(spark, s, ["score", "alerts"])
    scen = config.scenario_name(0.05)
    assert {r["scen"] for r in workflow.scenario_grid(spark, s).collect()} == {n for n, _, _ in config.scenarios()}
    n = make_experts(spark, root, scen, 0.057)
    only = spark.createDataFrame([(x, 0.057) for x, _, _ in config.scenarios() if x != scen], "scen string, cost double")
    only.withColumns({"split": F.lit("x"), "property": F.lit("x"), "value": F.lit(0.0)}).write.partitionBy("scen", "cost").parquet(f"{root}/model_properties/classifier")
    workflow.run(spark, s, ["classifier", "experts", "deferral", "report"])

    results = workflow.report(spark, s)
    got = {(r["method"], r["env"], r["seed"]): r for r in results.collect()}
    assert len(got) == 10 and all(r["tp"] + r["fp"] + r["fn"] + r["tn"] == n for r in got.values())
    assert {m for m, _, _ in got} == {"optimal", "greedy", "random", "reject_all", "classifier_only"}
    assert all(r["fn"] == 0 and r["tn"] == 0 for (m, _, _), r in got.items() if m == "reject_all")
    props = spark.read.parquet(f"{root}/model_properties/classifier").filter(F.col("scen") == scen)
    assert {r["split"] for r in props.collect()} == {"train", "validation", "test"}
    before = spark.read.parquet(f"{root}/probabilities").count()
    workflow.run(spark, s)
    assert spark.read.parquet(f"{root}/probabilities").count() == before
    assert spark.read.parquet(f"{root}/trials/alert").count() == 1
    assert workflow.complete(spark, workflow.Settings(root, HUMANS)).numeric == ["f1", "f2"]

    # A new environment adds its runs only; a run torn before it was entered is done again.
    old = {p: os.path.getmtime(p) for p in glob.glob(f"{root}/assignments/**/*.parquet", recursive=True)}
    shutil.copytree(f"{root}/testbed/{scen}-l_0.057/batch#homogenous_0", f"{root}/testbed/{scen}-l_0.057/batch#variable-9_0")
    torn = spark.createDataFrame([(1, 77, None, 1)], "batch int, case_id long, expert string, prediction int").withColumns(
        {"scen": F.lit(scen), "cost": F.lit(0.057), "seed": F.lit("NA"), "method": F.lit("random"), "env": F.lit("batch#variable-9_0")}
    )
    torn.write.mode("append").partitionBy(*workflow.RUN).parquet(f"{root}/assignments")
    workflow.run(spark, s, ["deferral", "report"])
    assert all(os.path.getmtime(p) == t for p, t in old.items())
    more = {(r["method"], r["env"], r["seed"]): r for r in workflow.report(spark, s).collect()}
    assert len(more) == 15 and all(tuple(more[k]) == tuple(got[k]) for k in got)
    assert all(r["tp"] + r["fp"] + r["fn"] + r["tn"] == n for r in more.values())
    assert spark.read.parquet(f"{root}/assignments_finished").count() == 15
