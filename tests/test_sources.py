import os

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom import config
from caseloom.operators import joins
from caseloom.sources import ledger, registry, tables, testbed


def test_csv_to_case_ids(spark, tmp_path):
    schema = tables.applications_schema(["income"])
    rows = [(1, 0.5, "AA", "CA", "BA", "INTERNET", "linux", 30, m) for m in (2, 0, 1, 0)]
    df = spark.createDataFrame(rows, schema).coalesce(1)
    df.write.option("header", True).csv(str(tmp_path / "base"))
    back = tables.read_csv(spark, str(tmp_path / "base"), schema)
    assert back.schema == schema and sorted(back.collect()) == sorted(df.collect())
    assert tables.numeric_features(spark, str(tmp_path / "base")) == ["income"]
    turned = df.select(*reversed(df.columns))
    turned.write.option("header", True).csv(str(tmp_path / "turned"))
    assert sorted(tables.read_csv(spark, str(tmp_path / "turned"), schema).collect()) == sorted(df.collect())
    with pytest.raises(ValueError, match="income"):
        turned.drop("income").write.option("header", True).csv(str(tmp_path / "short"))
        tables.read_csv(spark, str(tmp_path / "short"), schema)
    keyed = tables.with_case_id(back.withColumn("row", F.monotonically_increasing_id()), "row")
    got = sorted((r["case_id"], r["month"]) for r in keyed.collect())
    assert got == [(0, 0), (1, 0), (2, 1), (3, 2)]


def test_scan_reaches_the_files(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write(spark.range(100).selectExpr("id", "id % 7 AS m", "id * 2 AS unused"), path)
    tables.write(spark.range(1).selectExpr("id", "id AS m", "id AS unused"), path)  # kept, not overwritten
    df = tables.scan(spark, path, {"case_id": "id"}, where=F.col("m") == 3)
    assert df.count() == 14
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "unused" not in plan and "EqualTo(m,3)" in plan


def test_testbed_folders(spark, tmp_path):
    for env, order in {"batch#homogenous_1": [5, 3, 9], "batch#variable-2_1": [9, 5, 3]}.items():
        folder = tmp_path / "bed" / env
        folder.mkdir(parents=True)
        (folder / "batches.csv").write_text("batch,case_id\n" + "".join(f"1,{c}\n" for c in order))
        (folder / "capacity.csv").write_text("batch_id,batch_size,standard#0,standard#1\n1,3,1,1\n")
    got = testbed.read_batches(spark, str(tmp_path / "bed" / "*" / "batches.csv")).collect()
    order = {}
    for r in sorted(got, key=lambda r: (r["env"], r["pos"])):
        order.setdefault(r["env"], []).append(r["case_id"])
    assert order == {"batch#homogenous_1": [5, 3, 9], "batch#variable-2_1": [9, 5, 3]}
    cap = testbed.read_capacity(spark, str(tmp_path / "bed" / "*" / "capacity.csv"), ["standard#0", "standard#1"])
    assert sorted((r["env"], r["expert"], r["capacity"]) for r in cap.collect())[:3] == [
        ("batch#homogenous_1", "model#0", 1), ("batch#homogenous_1", "standard#0", 1), ("batch#homogenous_1", "standard#1", 1)]


def test_probability_store_and_pending_work(spark, tmp_path):
    path = str(tmp_path / "store")
    grid = spark.createDataFrame([(s, c, "joint", n) for s in ("a", "b") for c in (0.057,) for n in ("1", "2")], "scen string, cost double, method string, seed string")
    assert tables.pending(grid, path, tables.STORE_KEYS).count() == 4
    pairs = grid.filter("scen = 'a'").selectExpr("*", "inline(array(struct(1L AS case_id, 'x' AS expert, 0.5D AS p_correct), struct(2L AS case_id, 'x' AS expert, 0.75D AS p_correct)))")
    tables.write_probabilities(pairs, path)
    left = tables.pending(grid, path, tables.STORE_KEYS)
    assert {(r["scen"], r["seed"]) for r in left.collect()} == {("b", "1"), ("b", "2")}
    one = tables.read_probabilities(spark, path, scen="a", seed="2")
    assert one.count() == 2 and "PartitionFilters: [isnotnull(scen" in one._jdf.queryExecution().executedPlan().toString()


def test_trials_and_models(spark, tmp_path):
    trials = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.25), (0, 2, 0.25), (1, 0, 0.9)], "study int, trial int, loss double")
    registry.append_trials(trials.filter("study = 0"), str(tmp_path / "trials"))
    registry.append_trials(trials.filter("study = 1"), str(tmp_path / "trials"))
    best = registry.best_trials(registry.read_trials(spark, str(tmp_path / "trials")), ["study"])
    assert {(r["study"], r["trial"]) for r in best.collect()} == {(0, 1), (1, 0)}
    registry.save_model(PipelineModel([]), str(tmp_path / "model"))
    assert registry.load_model(str(tmp_path / "model")).stages == []


def test_strict_lookup(spark):
    rows = spark.createDataFrame([(1,), (2,)], "case_id int")
    table = spark.createDataFrame([(1, "x")], "case_id int, v string")
    assert joins.lookup(rows, table, ["case_id"], strict=False).count() == 2
    with pytest.raises(Exception, match="no match"):
        joins.lookup(rows, table, ["case_id"]).collect()
    with pytest.raises(joins.MissingKeys):
        joins.require_keys(rows, table, ["case_id"])


def test_grid_has_the_configured_size():
    assert len(config.scenario_costs()) == 10 and len(config.scenarios()) == 6


@pytest.mark.parametrize("split", [64 << 20, 200])
def test_lines_keep_their_order_however_files_are_cut(spark, tmp_path, split):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        for env, n in (("a", 30), ("b", 90)):
            os.makedirs(tmp_path / "bed" / env)
            lines = "".join(f"{(i * 37) % n + 1000},{i // 20 + 1}\n" for i in range(n))
            (tmp_path / "bed" / env / "batches.csv").write_text("case_id,batch\n" + lines)
        got = testbed.read_batches(spark, f"{tmp_path}/bed/*/batches.csv").collect()
        assert {(r["env"], r["batch"], r["pos"]): r["case_id"] for r in got} == {
            (env, i // 20 + 1, i % 20): (i * 37) % n + 1000 for env, n in (("a", 30), ("b", 90)) for i in range(n)
        }
        os.makedirs(tmp_path / "apps")
        for name, start, n in (("1.csv", 0, 20), ("0.csv", 100, 120)):
            (tmp_path / "apps" / name).write_text("month,x\n" + "".join(f"{i % 2},{start + i}\n" for i in range(n)))
        schema = T.StructType([T.StructField("month", T.IntegerType()), T.StructField("x", T.IntegerType())])
        rows = tables.read_csv(spark, f"{tmp_path}/apps", schema, line="_line")
        order = [r["x"] for r in tables.with_case_id(rows, "_line").orderBy("case_id").collect()]
        lined = [100 + i for i in range(120)] + list(range(20))
        assert order == [x for x in lined if x % 2 == 0] + [x for x in lined if x % 2 == 1]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_ledger_reads_finished_runs_and_replaces_torn_ones(spark, tmp_path):
    book = ledger.RunLedger(spark, str(tmp_path / "t"), ["run", "env"])
    grid = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (1, "a")], "run int, env string")
    assert book.pending(grid).count() == 3
    rows = grid.distinct().withColumn("v", F.lit(1))
    book.commit(rows.filter("run = 1"), spark.createDataFrame([(1, "a"), (1, "b")], grid.schema))
    rows.filter("run = 2").withColumn("v", F.lit(9)).write.mode("append").partitionBy("run", "env").parquet(book.path)
    assert {tuple(r) for r in book.pending(grid).collect()} == {(2, "a")} and book.read().count() == 2
    todo = spark.createDataFrame([(2, "a")], grid.schema)
    book.commit(rows.filter("run = 2"), todo)
    assert book.pending(grid).isEmpty() and {r["v"] for r in book.read().collect()} == {1}
