"""Teams that differ between scenarios: capacity files with their own headers, rosters, pairs, the workflow's choice."""

import pytest

from caseloom.operators import joins
from caseloom.plans import workflow
from caseloom.sources import testbed


def write(folder, name, text):
    folder.mkdir(parents=True)
    (folder / name).write_text(text)


def test_each_capacity_file_has_its_own_humans(spark, tmp_path):
    write(tmp_path / "a-l_0.1" / "e1", "capacity.csv", "batch_id,batch_size,standard#0,standard#1\n1,10,2,3\n2,4,1,\n")
    write(tmp_path / "b-l_0.1" / "e1", "capacity.csv", 'standard#7,"batch_size",batch_id\n6,9,1\n\n')
    write(tmp_path / "c-l_0.1" / "e2", "capacity.csv", "batch_id,batch_size\n1,5\n")
    got = testbed.read_capacity(spark, str(tmp_path / "*" / "*" / "capacity.csv"), grid=True)
    assert got.columns == ["grid", "env", "batch", "batch_size", "expert", "capacity"]
    assert sorted(tuple(r) for r in got.collect()) == [
        ("a-l_0.1", "e1", 1, 10, "model#0", 5),
        ("a-l_0.1", "e1", 1, 10, "standard#0", 2),
        ("a-l_0.1", "e1", 1, 10, "standard#1", 3),
        ("a-l_0.1", "e1", 2, 4, "model#0", 3),
        ("a-l_0.1", "e1", 2, 4, "standard#0", 1),
        ("b-l_0.1", "e1", 1, 9, "model#0", 3),
        ("b-l_0.1", "e1", 1, 9, "standard#7", 6),
        ("c-l_0.1", "e2", 1, 5, "model#0", 5),
    ]
    one = str(tmp_path / "a-l_0.1" / "*" / "capacity.csv")
    named = testbed.read_capacity(spark, one, ["standard#0", "standard#1"]).filter("batch = 1")
    own = testbed.read_capacity(spark, one).filter("batch = 1")
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, named.collect()))


@pytest.mark.parametrize("limit", [joins.BROADCAST_ROWS, 0])
def test_pairs_follow_the_roster_of_their_key(spark, limit, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", limit)
    log = spark.createDataFrame(
        [("s1", 0.1, "b"), ("s1", 0.1, "a"), ("s1", 0.1, "a"), ("s1", 0.1, None), ("s2", 0.1, "model#0"), ("s2", 0.2, "c"), (None, 0.1, "d")],
        "scen string, cost double, expert string",
    )
    team = joins.rosters(log, ["scen", "cost"])
    assert {tuple(r)[:2]: r["roster"] for r in team.collect()} == {("s1", 0.1): ["a", "b"], ("s2", 0.1): [], ("s2", 0.2): ["c"], (None, 0.1): ["d"]}
    cases = spark.createDataFrame([(i, s, c) for i in range(3) for s, c in [("s1", 0.1), ("s2", 0.1), ("s2", 0.2), (None, 0.1), ("s9", 0.1)]], "case_id long, scen string, cost double")
    got = joins.roster_pairs(cases, team, ["scen", "cost"])
    want = [(i, s, c, e) for i in range(3) for s, c, e in [("s1", 0.1, "a"), ("s1", 0.1, "b"), ("s2", 0.2, "c"), (None, 0.1, "d")]]
    assert sorted(map(str, map(tuple, got.select("case_id", "scen", "cost", "expert").collect()))) == sorted(map(str, want))


def test_workflow_takes_each_scenarios_own_team(spark, tmp_path):
    rows = [("s1", 0.1, "standard#0"), ("s1", 0.1, "standard#1"), ("s2", 0.1, "standard#5"), ("s2", 0.1, "model#0")]
    spark.createDataFrame(rows, "scen string, cost double, assignment string").write.parquet(f"{tmp_path}/decisions")
    assert workflow.rosters(spark, workflow.Settings(str(tmp_path))) == {("s1", 0.1): ["standard#0", "standard#1"], ("s2", 0.1): ["standard#5"]}
    assert set(map(tuple, workflow.rosters(spark, workflow.Settings(str(tmp_path), ["x"])).values())) == {("x",)}
