import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from caseloom.operators import deferral, joins, optimal
from tests.test_transport import one_by_one

EXPERTS = ["a#0", "b#1", "c#2", "d#3"]


def bed(spark, sizes, seed=0, levels=None, caps=None):
    """Batches of the given sizes with random probabilities; one batch may hold most rows."""
    rng = np.random.default_rng(seed)
    rows, room, case = [], [], 0
    for b, n in enumerate(sizes, start=1):
        for pos in range(n):
            p = rng.integers(0, levels, len(EXPERTS)) / levels if levels else rng.random(len(EXPERTS))
            rows += [("s1", b, pos, case, e, float(x)) for e, x in zip(EXPERTS, p)]
            case += 1
        share = caps[b - 1] if caps else [n // 4, n // 5, n - n // 4 - n // 5, 0]
        room += [("s1", b, e, int(c)) for e, c in zip(EXPERTS, share)]
    pred = spark.createDataFrame(pd.DataFrame(rows, columns=["seed", "batch", "pos", "case_id", "expert", "p_correct"]))
    cap = spark.createDataFrame(pd.DataFrame(room, columns=["seed", "batch", "expert", "capacity"]))
    return pred, cap, pd.DataFrame(rows, columns=["seed", "batch", "pos", "case_id", "expert", "p_correct"])


def expected_greedy(frame, caps):
    out = {}
    for b, part in frame.groupby("batch"):
        wide = part.pivot(index="pos", columns="expert", values="p_correct")
        ids = part.drop_duplicates("pos").set_index("pos")["case_id"]
        for pos, k in zip(wide.index, one_by_one(wide.to_numpy(), caps[b - 1])):
            out[ids[pos]] = None if k < 0 else EXPERTS[k]
    return out


CAPS = [[3, 4, 2, 1], [20, 10, 25, 0], [1, 0, 2, 1]]


@pytest.mark.parametrize("limit", [10**9, 40, 0])
@pytest.mark.parametrize("levels", [None, 3])
def test_greedy_equals_the_sequential_rule_in_tasks_and_as_a_job(spark, limit, levels):
    pred, cap, frame = bed(spark, [10, 60, 9], levels=levels, caps=CAPS)
    out = {r["case_id"]: r["expert"] for r in deferral.greedy(pred, cap, ["seed"], limit=limit).collect()}
    assert out == expected_greedy(frame, CAPS)
    assert sum(v is None for v in out.values()) > 0


@pytest.mark.parametrize("limit", [10**9, 200, 0])
@pytest.mark.parametrize("levels", [None, 4])
def test_optimal_is_proved_by_its_prices_in_tasks_and_as_a_job(spark, limit, levels):
    pred, cap, _ = bed(spark, [12, 90, 20], seed=2, levels=levels)
    done = optimal.optimal(pred, cap, ["seed"], limit=limit).cache()
    audit = deferral.capacity_audit(done, cap, ["seed"]).collect()
    assert all(r["filled"] == 1 for r in audit)
    assert done.count() == done.select("case_id").distinct().count() == 122
    check = optimal.optimality_check(done, pred, cap, ["seed"]).collect()
    assert [(r["violations"], r["unfilled"], r["duality_gap"]) for r in check] == [(0, 0, 0)] * 3


def test_the_job_gives_the_same_when_tables_are_too_large_to_send(spark, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    pred, cap, frame = bed(spark, [10, 30, 9], levels=4, caps=[[3, 4, 2, 1], [10, 5, 15, 0], [2, 3, 3, 1]])
    out = {r["case_id"]: r["expert"] for r in deferral.greedy(pred, cap, ["seed"], limit=0).collect()}
    assert out == expected_greedy(frame, [[3, 4, 2, 1], [10, 5, 15, 0], [2, 3, 3, 1]])
    done = optimal.optimal(pred, cap, ["seed"], limit=60).cache()
    assert [r["violations"] for r in optimal.optimality_check(done, pred, cap, ["seed"]).collect()] == [0, 0, 0]
    assert all(r["filled"] == 1 for r in deferral.capacity_audit(done, cap, ["seed"]).filter("capacity > 0").collect())


def test_both_ways_reach_the_same_cost_and_beat_the_other_rules(spark):
    pred, cap, _ = bed(spark, [40, 30], seed=5)
    cost = {}
    for name, out in {
        "task": optimal.optimal(pred, cap, ["seed"]),
        "job": optimal.optimal(pred, cap, ["seed"], limit=0),
        "greedy": deferral.greedy(pred, cap, ["seed"]),
        "random": deferral.random_under_capacity(pred.select("seed", "batch", "case_id").distinct(), cap, ["seed"], 1),
    }.items():
        priced = out.select("case_id", "expert").join(pred, ["case_id", "expert"])
        cost[name] = priced.agg(F.sum(optimal.error_cost("p_correct"))).first()[0]
    assert cost["task"] == cost["job"]
    assert cost["task"] <= cost["greedy"] and cost["task"] <= cost["random"]


def test_optimal_rejects_capacities_that_do_not_add_up(spark):
    pred, cap, _ = bed(spark, [8], caps=[[1, 1, 1, 1]])
    with pytest.raises(Exception, match="add up"):
        optimal.optimal(pred, cap, ["seed"]).collect()
    with pytest.raises(Exception, match="add up"):
        optimal.optimal(pred, cap, ["seed"], limit=0).collect()


def test_random_fills_every_capacity_and_is_reproducible(spark):
    pred, cap, _ = bed(spark, [50, 10])
    cases = pred.select("seed", "batch", "case_id").distinct()
    a = deferral.random_under_capacity(cases, cap, ["seed"], 7)
    first = {(r["case_id"], r["expert"]) for r in a.collect()}
    assert all(r["filled"] == 1 for r in deferral.capacity_audit(a, cap, ["seed"]).collect())
    again = deferral.random_under_capacity(cases.repartition(5, "case_id"), cap, ["seed"], 7)
    assert {(r["case_id"], r["expert"]) for r in again.collect()} == first
    other = {(r["case_id"], r["expert"]) for r in deferral.random_under_capacity(cases, cap, ["seed"], 8).collect()}
    assert other != first


def test_audit_counts_cases_without_expert(spark):
    pred, cap, _ = bed(spark, [6], caps=[[1, 1, 1, 0]])
    audit = {r["expert"]: r for r in deferral.capacity_audit(deferral.greedy(pred, cap, ["seed"]), cap, ["seed"]).collect()}
    assert audit[None]["n_assigned"] == 3 and audit[None]["over"] == 1


def assignments(out):
    return {r["case_id"]: r["expert"] for r in out.collect()}


@pytest.mark.parametrize("levels", [2, 4])
def test_equal_costs_give_one_assignment_whatever_the_way(spark, levels):
    pred, cap, frame = bed(spark, [30, 70, 12], seed=levels, levels=levels)
    want = None
    for limit in (0, 10**9):
        for parts in (1, 4, 32):
            got = assignments(optimal.optimal(pred.repartition(parts), cap.repartition(parts), ["seed"], limit=limit))
            want = want or got
            assert got == want
    again = assignments(optimal.optimal(pred.orderBy(F.rand(3)), cap.orderBy(F.rand(4)), ["seed"], limit=60))
    assert again == want and len(want) == 112


def test_first_prices_do_not_matter(spark, monkeypatch):
    pred, cap, _ = bed(spark, [60], seed=8, levels=3)
    want = assignments(optimal.optimal(pred, cap, ["seed"]))
    for cases in (1, 15):
        monkeypatch.setattr(optimal, "WARM_CASES", cases)
        assert assignments(optimal.optimal(pred, cap, ["seed"], limit=0)) == want


def test_certificate_sees_a_wrong_assignment(spark):
    pred, cap, _ = bed(spark, [20, 16], seed=6)
    done = optimal.optimal(pred, cap, ["seed"]).cache()
    rows = done.filter("batch = 1").orderBy("pos").collect()
    a = rows[0]
    b = next(r for r in rows if r["expert"] != a["expert"])
    swapped = {a["case_id"]: (b["expert"], b["price"]), b["case_id"]: (a["expert"], a["price"])}

    def check(frame):
        return {r["batch"]: r for r in optimal.optimality_check(frame, pred, cap, ["seed"]).collect()}

    new = [tuple(r[:4]) + swapped.get(r["case_id"], (r["expert"], r["price"])) for r in done.collect()]
    worse = check(spark.createDataFrame(new, done.schema))
    assert worse[1]["duality_gap"] > 0 and worse[1]["violations"] > 0 and worse[1]["unfilled"] == 0
    assert (worse[2]["duality_gap"], worse[2]["violations"], worse[2]["unfilled"]) == (0, 0, 0)
    short = check(done.filter(F.col("case_id") != a["case_id"]))
    assert short[1]["unfilled"] > 0 and short[2]["unfilled"] == 0
    one = check(done.withColumn("expert", F.when(F.col("batch") == 1, F.lit(a["expert"])).otherwise(F.col("expert"))))
    assert one[1]["unfilled"] > 0


@pytest.mark.parametrize("limit", [10**9, 0])
def test_greedy_needs_every_pair_on_both_ways(spark, limit):
    pred, cap, _ = bed(spark, [10], caps=[[3, 4, 2, 1]])
    missing = pred.filter(~((F.col("case_id") == 4) & (F.col("expert") == "b#1")))
    with pytest.raises(Exception, match="one row per expert"):
        deferral.greedy(missing, cap, ["seed"], limit=limit).collect()


def test_short_batches_get_capacities_in_proportion(spark):
    caps = spark.createDataFrame([("e", 1, k, c) for k, c in enumerate([8, 9, 10, 8, 0])] + [("e", 2, k, c) for k, c in enumerate([1, 2, 3, 4, 5])], "env string, batch int, expert int, capacity long")
    sizes = spark.createDataFrame([("e", 1, 14), ("e", 2, 15)], "env string, batch int, n_cases long")
    got = {(r["batch"], r["expert"]): r["capacity"] for r in joins.fit_capacities(caps, sizes, ["env"]).collect()}
    assert [got[1, k] for k in range(5)] == [3, 4, 4, 3, 0] and [got[2, k] for k in range(5)] == [1, 2, 3, 4, 5]
    huge = spark.createDataFrame([(1, k, 10**9 + k) for k in range(3)], "batch int, expert int, capacity long")
    total = 3 * 10**9 - 5
    some = joins.fit_capacities(huge, spark.createDataFrame([(1, total)], "batch int, n_cases long"))
    assert sum(r["capacity"] for r in some.collect()) == total


def test_expanded_pairs_are_never_sent_whole_to_the_tasks(spark):
    cases = spark.range(1000).select(F.col("id").alias("case_id"))
    pairs = joins.score_pairs(cases, EXPERTS).withColumn("decision", F.lit(1))
    plan = joins.chosen_decision(deferral.one_expert(cases, EXPERTS[1]), pairs, [])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in text and "ShuffledHashJoin" not in text
    assert plan.filter("decision = 1").count() == 1000


@pytest.mark.parametrize("rows", [(1, 1), (100, 50), (10**6, 10**6)])
def test_batches_may_be_dealt_in_any_chunks(spark, monkeypatch, rows):
    monkeypatch.setattr(deferral, "CHUNK_ROWS", rows[0])
    monkeypatch.setattr(deferral, "TASK_ROWS", rows[1])
    sizes, caps = [5, 1, 12, 9, 3, 7], [[2, 1, 2, 0], [0, 0, 0, 1], [3, 3, 3, 3], [9, 0, 0, 0], [1, 1, 0, 1], [4, 1, 1, 1]]
    pred, cap, frame = bed(spark, sizes, seed=4, levels=3, caps=caps)
    wide = cap.withColumn("batch", F.col("batch").cast("int"))
    got = deferral.greedy(pred, wide, ["seed"])
    assert assignments(got) == expected_greedy(frame, caps) and got.rdd.getNumPartitions() >= (37 * 4) // rows[1]
    # One whose key is null, one without capacities, one whose capacities are all zero.
    null = pred.withColumn("batch", F.when(F.col("batch") != 3, F.col("batch")).cast("long"))
    some = pred.filter("batch = 3").withColumn("batch", F.lit(None).cast("long"))
    room = cap.filter("batch = 3").withColumn("batch", F.lit(None).cast("long"))
    others = cap.filter("batch NOT IN (3, 5)").withColumn("capacity", F.when(F.col("batch") == 2, 0).otherwise(F.col("capacity")))
    out = assignments(deferral.greedy(null.filter("batch IS NOT NULL").unionByName(some), others.unionByName(room), ["seed"]))
    want = expected_greedy(frame, caps)
    ids = {b: set(frame[frame["batch"] == b]["case_id"]) for b in (2, 5)}
    assert out == {c: None if c in ids[2] | ids[5] else e for c, e in want.items()}
