"""Chain-cover labels against a closure."""

import random

import pytest
from pyspark.sql import functions as F

from treeloom.operators import cover, history, mainline


def grown(seed, n=40):
    """A DAG of some writers; counters rise along it, or (every third seed) mean nothing; some commits are synthetic; some are torn."""
    rng = random.Random(seed)
    commits = {}
    for i in range(n):
        oid = f"{rng.randrange(16**8):08x}{i:02d}"
        parents = rng.sample(list(commits), min(len(commits), rng.choice([1, 1, 1, 2, 3]))) if i else []
        if i and rng.random() < 0.6:
            parents = list({*parents, list(commits)[-1]})
        counter = rng.randint(1, 6) if seed % 3 == 2 else 1 + max((commits[p]["counter"] for p in parents if p in commits), default=0)
        if seed % 4 == 1 and rng.random() < 0.05:
            parents = [*parents, f"gone{i}"]
        commits[oid] = {"parents": parents, "node": str(rng.randrange(4)), "counter": counter, "primitive": rng.random() < 0.7}
    return commits


def above(commits, oid):
    seen, stack = set(), [oid]
    while stack:
        o = stack.pop()
        if o not in seen:
            seen.add(o)
            stack.extend(commits.get(o, {"parents": []})["parents"])
    return seen


def tables(spark, dags):
    commits = spark.createDataFrame([(str(i), o, c["node"], c["counter"], c["primitive"]) for i, d in enumerate(dags) for o, c in d.items()], "vault_id string, oid string, node_id string, counter long, is_primitive boolean")
    edges = spark.createDataFrame([(str(i), o, p) for i, d in enumerate(dags) for o, c in d.items() for p in c["parents"]], "vault_id string, child string, parent string")
    return commits, edges


def test_labels_are_the_closure(spark):
    dags = [grown(s) for s in range(12)]
    commits, edges = tables(spark, dags)
    made = cover.covered(commits, edges)
    spots = {(r.vault_id, r.oid): (r.chain, r.spot) for r in made.spots.collect()}
    labels = {}
    for r in made.labels.collect():
        labels.setdefault((r.vault_id, r.chain, r.other), []).append((r.spot, r.reach))
    for i, d in enumerate(dags):
        prims = [o for o in d if d[o]["primitive"]]
        for x in prims:
            seen = above(d, x)
            c, at = spots[str(i), x]
            for y in prims:
                e, place = spots[str(i), y]
                reach = at if c == e else max((r for s, r in labels.get((str(i), c, e), []) if s <= at), default=-1)
                assert (place <= reach) == (y in seen), (i, x, y)


def test_latest_touches_and_torn_histories(spark):
    dags = [grown(s) for s in range(30, 40)]
    commits, edges = tables(spark, dags)
    rng = random.Random(5)
    touched = [(str(i), o, p, rng.choice(["add", "delete"]), c["counter"], c["node"]) for i, d in enumerate(dags) for o, c in d.items() if c["primitive"] for p in "abc" if rng.random() < 0.25]
    touches = spark.createDataFrame(touched, "vault_id string, oid string, path string, kind string, counter long, node_id string")
    asked = commits.select("vault_id", "oid", F.explode(F.array(*map(F.lit, "abcd"))).alias("path"))
    made = cover.covered(commits, edges)
    got = {(r.vault_id, r.oid, r.path): (r.kind, r.touch_oid) for r in history.latest_touches_on_cover(asked, touches, made).collect()}
    for i, d in enumerate(dags):
        for o in d:
            seen = above(d, o)
            for p in "abcd":
                best = max(((c, n, t, k) for v, t, q, k, c, n in touched if v == str(i) and q == p and t in seen), default=None)
                assert got[str(i), o, p] == ((best[3], best[2]) if best else (None, None))
    torn = {(r.vault_id, r.oid) for r in cover.incomplete(made, commits).collect()}
    assert torn == {(str(i), o) for i, d in enumerate(dags) for o in d if above(d, o) - set(d)} and torn


@pytest.mark.parametrize("deep", [10_000])
def test_rows_grow_with_depth_not_with_its_square(spark, deep):
    """Five writers who take turns, each knowing what the others did before; every second commit touches a path."""
    n = spark.range(deep).withColumn("oid", F.lpad(F.col("id").cast("string"), 40, "0"))
    commits = n.select(F.lit("v").alias("vault_id"), "oid", (F.col("id") * F.col("id") % 5).cast("string").alias("node_id"), F.col("id").alias("counter"), F.lit(True).alias("is_primitive"))
    edges = n.where("id > 0").select(F.lit("v").alias("vault_id"), F.col("oid").alias("child"), F.lpad((F.col("id") - 1).cast("string"), 40, "0").alias("parent"))
    made = cover.covered(commits, edges)
    assert made.labels.count() <= 8 * deep
    touches = commits.where("counter % 2 = 0").withColumns({"path": (F.col("counter") % 6).cast("string"), "kind": F.lit("add")})
    asked = commits.select("vault_id", "oid", F.lit("4").alias("path"))
    found = history.latest_touches_on_cover(asked, touches, made)
    assert found.where("touch_oid IS NOT NULL").count() == deep - 4
    assert found.where(f"oid = lpad('{deep - 1}', 40, '0')").first().touch_oid.lstrip("0") == str((deep - 1 - 4) // 6 * 6 + 4)


def test_ghosts_without_a_delete_cost_nothing(spark):
    commits = spark.createDataFrame([("v", "a", "1", 1, 1, True), ("v", "b", "1", 2, 2, True)], "vault_id string, oid string, node_id string, counter long, time long, is_primitive boolean")
    edges = spark.createDataFrame([("v", "b", "a")], "vault_id string, child string, parent string")
    trees = spark.createDataFrame([("v", "b", "x.md", "0" * 40)], "vault_id string, oid string, path string, blob_oid string")
    assert mainline.ghosts(commits, edges, trees).count() == 0
