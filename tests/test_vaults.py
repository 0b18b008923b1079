"""Vaults of few rows are walked in one task, those of many by loops: both tell the same, and one task never holds a large one."""

import random

import pytest

from treeloom.operators import dag, history, mainline, vaults


@pytest.fixture(scope="module")
def fleet(spark):
    rng = random.Random(3)
    commits, edges, trees = [], [], []
    for v in range(4):
        for i in range(14):
            commits.append((f"v{v}", f"{i:02d}", f"n{i % 3}", i, i, i % 4 != 3))
            for p in {i - 3, rng.randrange(-6, i)} if i else ():
                if p >= 0:
                    edges.append((f"v{v}", f"{i:02d}", f"{p:02d}"))
            trees += [(f"v{v}", f"{i:02d}", path, "b") for path in ("a", "b", "d/c") if rng.random() < 0.6]
    edges.append(("v1", "04", "gone"))
    return (
        spark.createDataFrame(commits, "vault_id string, oid string, node_id string, counter long, time long, is_primitive boolean"),
        spark.createDataFrame(edges, "vault_id string, child string, parent string"),
        spark.createDataFrame(trees, "vault_id string, oid string, path string, blob_oid string"))


def answers(commits, edges, trees):
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    tips = mainline.tips_of(commits, edges)
    links = edges.withColumnsRenamed({"child": "src", "parent": "dst"})
    pairs = tips.selectExpr("vault_id", "k", "oid AS a", "'05' AS b")
    told = mainline.touches(commits, edges, trees)
    last = commits.groupBy("vault_id", "node_id").agg({"oid": "max"}).toDF("vault_id", "node_id", "oid")
    return {
        "tips": rows(tips), "reached": rows(dag.reachable(tips, links, ["k"])), "fold_bases": [(r[0], r[1], r[2], r[-1] or "") for r in rows(dag.fold_bases(tips, edges).fillna(""))],
        "bases": rows(dag.maximal_bases(pairs, edges, ["k"])), "agree": rows(dag.agreeing(last, edges)), "touches": rows(told), "ghosts": rows(mainline.ghosts(commits, edges, trees)),
        "latest": sorted(map(str, history.latest_touches_on_dag(None, told, commits, edges).collect()))}


def test_large_vaults_go_on_with_the_loops_and_tell_the_same(fleet, monkeypatch):
    small = answers(*fleet)
    monkeypatch.setattr(vaults, "MOST_ROWS", 6)
    assert answers(*fleet) == small
    assert all(small[name] for name in ("tips", "reached", "bases", "touches", "ghosts", "latest"))


def test_a_task_gives_up_a_vault_beyond_its_rows(spark):
    rows = spark.createDataFrame([("few", "x")] * 3 + [("many", "y")] * 9, "vault_id string, oid string")
    told, large = vaults.each_vault([rows], lambda own: [(str(len(own)),)], [rows.schema["oid"]], "rows", 4)
    assert [tuple(r) for r in told.collect()] == [("few", "3")] and [r.vault_id for r in large.collect()] == ["many"]


def test_chains_are_never_broadcast(spark, monkeypatch):
    from treeloom.operators import chains

    plans = []
    for name in ("saved", "saved_counted"):
        real = getattr(chains, name)
        monkeypatch.setattr(chains, name, lambda df, *rest, real=real: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df, *rest))[1])
    rows = spark.createDataFrame([("v", i, i * 10, i * 10 + 25, True, i == 0) for i in range(50)], "vault_id string, own long, level long, bar long, candidate boolean, first boolean")
    assert sorted(r.own for r in chains.chained(rows, ["vault_id"]).collect()) == list(range(0, 50, 3))
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
