"""Commit DAG queries over the fleet of `events`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import dag
from ..sources import fleet


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.commits(spark, sf_dir).select("vault_id", "oid", "node_id", "counter", "author_time", "subject")


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.edges(spark, sf_dir).select("vault_id", F.col("child").alias("src"), F.col("parent").alias("dst"))


def _tips(spark: SparkSession, sf_dir: str) -> DataFrame:
    tips = dag.frontier(_commits(spark, sf_dir), fleet.edges(spark, sf_dir))
    return dag.ranked(tips, "k").select("vault_id", "oid", "node_id", "counter", "author_time", "k")


def g1_closure(spark, sf_dir):
    return dag.closure(fleet.edges(spark, sf_dir))


def j2_frontier(spark, sf_dir):
    return dag.frontier(_commits(spark, sf_dir), fleet.edges(spark, sf_dir)).select("vault_id", "oid")


def w1_order_rank(spark, sf_dir):
    return dag.ranked(fleet.commits(spark, sf_dir)).select("vault_id", "oid", "rank")


def w2_fold_position(spark, sf_dir):
    return _tips(spark, sf_dir).select("vault_id", "oid", "k")


def a2_merge_base(spark, sf_dir):
    order = Window.partitionBy("vault_id").orderBy("k")
    pairs = _tips(spark, sf_dir).select("vault_id", F.lag("oid").over(order).alias("a"), F.col("oid").alias("b")).where("a IS NOT NULL")
    return dag.merge_bases(pairs, fleet.edges(spark, sf_dir))


def l5_maximal_bases(spark, sf_dir):
    """How many maximal common ancestors neighbouring tips have, and the least of them, which is the base."""
    order = Window.partitionBy("vault_id").orderBy("k")
    tips = _tips(spark, sf_dir).select("vault_id", "oid", "k", F.lag("oid").over(order).alias("a")).where("a IS NOT NULL")
    return dag.maximal_bases(tips.select("vault_id", "k", "a", F.col("oid").alias("b")), fleet.edges(spark, sf_dir), ["k"])


def z5_common_ancestors(spark, sf_dir):
    seen = dag.reachable(_tips(spark, sf_dir).where("k <= 2").select("vault_id", "k", "oid"), _links(spark, sf_dir), by=["k"])
    return seen.groupBy("vault_id", F.col("oid").alias("ancestor")).agg(F.count("*").alias("n")).where("n = 2").drop("n")


def g3_fold_bases(spark, sf_dir):
    return dag.fold_bases(_tips(spark, sf_dir), fleet.edges(spark, sf_dir)).select("vault_id", "k", "oid", "base")


def g2_reachable(spark, sf_dir):
    return dag.reachable(_tips(spark, sf_dir).where("k = 1"), _links(spark, sf_dir))


def z2_export_closure(spark, sf_dir):
    """Everything reachable from the tips of one node per vault, with what travels: the commits' rows in order of oid."""
    wanted = dag.reachable(_tips(spark, sf_dir).where("k = 2"), _links(spark, sf_dir))
    return _commits(spark, sf_dir).join(wanted, ["vault_id", "oid"], "left_semi").select("vault_id", "oid", "counter", "node_id")


def z4_gc_unreachable(spark, sf_dir):
    """A report of commits that neither the first tip nor a snapshot (here: the oldest commit) reaches; nothing is deleted."""
    commits = _commits(spark, sf_dir)
    roots = _tips(spark, sf_dir).where("k = 1").select("vault_id", "oid").unionByName(commits.where("counter = 1").select("vault_id", "oid"))
    return commits.join(dag.reachable(roots, _links(spark, sf_dir)), ["vault_id", "oid"], "left_anti").select("vault_id", "oid")


def j14_missing_objects(spark, sf_dir):
    """What a receiver that holds the first half of each vault lacks of the first tip's closure."""
    wanted = dag.reachable(_tips(spark, sf_dir).where("k = 1"), _links(spark, sf_dir))
    return wanted.join(_commits(spark, sf_dir).where("counter <= 10").select("vault_id", "oid"), ["vault_id", "oid"], "left_anti")


def j6_want_tips(spark, sf_dir):
    """Advertised tips that the receiver (all commits with an even counter, of which every third is not admitted) lacks."""
    held = _commits(spark, sf_dir).where("counter % 2 = 0").select("vault_id", "oid", "counter")
    return dag.wanted_tips(_tips(spark, sf_dir), held, held.where("counter % 3 <> 0"))


def f12_want_filter(spark, sf_dir):
    """Malformed tip ids are left out before the anti-join."""
    c = fleet.commits(spark, sf_dir)
    shown = c.select("vault_id", F.when(F.col("counter") % 5 == 0, F.concat("oid", F.lit("x"))).when(F.col("counter") % 7 == 0, F.upper("oid")).otherwise(F.col("oid")).alias("oid"))
    return dag.well_formed(shown)


def g10_dangling(spark, sf_dir):
    """Edges whose parent is missing, after every eleventh commit is taken away."""
    commits = fleet.commits(spark, sf_dir).where("counter % 11 <> 0")
    return dag.dangling(fleet.edges(spark, sf_dir), commits).select("vault_id", "child", "parent")


def a1_next_counter(spark, sf_dir):
    c = fleet.commits(spark, sf_dir)
    return c.groupBy("vault_id", "node_id").agg((F.max("counter") + 1).alias("next_counter"))


def a11_snapshot(spark, sf_dir):
    """A snapshot is the ordered frontier at its making."""
    tips = _tips(spark, sf_dir)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("counter", "node_id", "oid"))), lambda x: x["oid"])
    return tips.groupBy("vault_id").agg(F.array_join(ordered, ",").alias("frontier"))


def j12_snapshot_subset(spark, sf_dir):
    """Commits of a snapshot's closure: the frontier of what was known at counter 12."""
    commits = _commits(spark, sf_dir)
    snap = dag.frontier(commits.where("counter <= 12"), fleet.edges(spark, sf_dir))
    return commits.join(dag.reachable(snap, _links(spark, sf_dir)), ["vault_id", "oid"], "left_semi").select("vault_id", "oid", "counter")


def z1_union_known(spark, sf_dir):
    c = fleet.commits(spark, sf_dir)
    one, two = c.where("counter % 3 <> 0").select("vault_id", "oid"), c.where("counter % 2 = 0").select("vault_id", "oid")
    return one.unionByName(two).distinct()


def a13_convergence(spark, sf_dir):
    """Whether all nodes of a vault know the same commits: a node knows those of its closure."""
    last = _commits(spark, sf_dir).groupBy("vault_id", "node_id").agg(F.max_by("oid", "counter").alias("oid"))
    return dag.agreeing(last, fleet.edges(spark, sf_dir))


def l3_export_order(spark, sf_dir):
    c = fleet.commits(spark, sf_dir)
    return c.select("vault_id", "oid", F.row_number().over(Window.partitionBy("vault_id").orderBy("oid")).alias("place"))


def g6_known_at(spark, sf_dir):
    """Point in time: the frontier of commits authored up to noon of their vault's day."""
    early = _commits(spark, sf_dir).where("author_time % 86400 <= 43200")
    return dag.frontier(early, fleet.edges(spark, sf_dir)).select("vault_id", "oid", "author_time")


QUERIES = {f.__name__: f for f in (g1_closure, j2_frontier, w1_order_rank, w2_fold_position, a2_merge_base, l5_maximal_bases, z5_common_ancestors, g3_fold_bases, g2_reachable, z2_export_closure, z4_gc_unreachable, j14_missing_objects, j6_want_tips, f12_want_filter, g10_dangling, a1_next_counter, a11_snapshot, j12_snapshot_subset, z1_union_known, a13_convergence, l3_export_order, g6_known_at)}

_CLO = "WITH RECURSIVE " + fleet.EDGES_SQL + """, clo AS (
  SELECT vault_id, child AS descendant, parent AS ancestor FROM d_edges
  UNION SELECT c.vault_id, c.descendant, e.parent FROM clo c JOIN d_edges e ON c.vault_id = e.vault_id AND c.ancestor = e.child
), incl AS (SELECT * FROM clo UNION SELECT vault_id, oid, oid FROM d_commits),
tips AS (SELECT *, row_number() OVER (PARTITION BY vault_id ORDER BY counter, node_id, oid) AS k FROM d_commits c
  WHERE NOT EXISTS (SELECT 1 FROM clo WHERE clo.vault_id = c.vault_id AND clo.ancestor = c.oid))"""
_C = "WITH " + fleet.COMMITS_SQL

ORACLES = {
    "g1_closure": _CLO + " SELECT vault_id, descendant, ancestor FROM clo",
    "j2_frontier": _CLO + " SELECT vault_id, oid FROM tips",
    "w1_order_rank": _C + " SELECT vault_id, oid, row_number() OVER (PARTITION BY vault_id ORDER BY counter, node_id, oid)::INTEGER AS rank FROM d_commits",
    "w2_fold_position": _CLO + " SELECT vault_id, oid, k::INTEGER AS k FROM tips",
    "a2_merge_base": _CLO + """, pairs AS (SELECT vault_id, lag(oid) OVER (PARTITION BY vault_id ORDER BY k) AS a, oid AS b FROM tips QUALIFY a IS NOT NULL),
common AS (SELECT p.vault_id, a, b, x.ancestor FROM pairs p JOIN incl x ON x.vault_id = p.vault_id AND x.descendant = a JOIN incl y ON y.vault_id = p.vault_id AND y.descendant = b AND y.ancestor = x.ancestor),
best AS (SELECT vault_id, a, b, min(ancestor) AS base FROM common c WHERE NOT EXISTS (SELECT 1 FROM common d JOIN clo ON clo.vault_id = d.vault_id AND clo.descendant = d.ancestor
  WHERE d.vault_id = c.vault_id AND d.a = c.a AND d.b = c.b AND clo.ancestor = c.ancestor) GROUP BY ALL)
SELECT p.vault_id, p.a, p.b, base FROM pairs p LEFT JOIN best USING (vault_id, a, b)""",
    "z5_common_ancestors": _CLO + """ SELECT i.vault_id, ancestor FROM tips t JOIN incl i ON i.vault_id = t.vault_id AND descendant = oid WHERE k = 1
INTERSECT SELECT i.vault_id, ancestor FROM tips t JOIN incl i ON i.vault_id = t.vault_id AND descendant = oid WHERE k = 2""",
    "g3_fold_bases": _CLO + """, reached AS (SELECT t.vault_id, k, ancestor FROM tips t JOIN incl i ON i.vault_id = t.vault_id AND descendant = oid),
common AS (SELECT DISTINCT r.vault_id, r.k, r.ancestor FROM reached r JOIN reached q ON q.vault_id = r.vault_id AND q.ancestor = r.ancestor AND q.k < r.k),
best AS (SELECT vault_id, k, min(ancestor) AS base FROM common c WHERE NOT EXISTS (SELECT 1 FROM common d JOIN clo ON clo.vault_id = d.vault_id AND clo.descendant = d.ancestor
  WHERE d.vault_id = c.vault_id AND d.k = c.k AND clo.ancestor = c.ancestor) GROUP BY ALL)
SELECT t.vault_id, t.k::INTEGER AS k, oid, base FROM tips t LEFT JOIN best USING (vault_id, k) WHERE t.k > 1""",
    "g2_reachable": _CLO + " SELECT i.vault_id, i.ancestor AS oid FROM incl i JOIN tips t ON t.vault_id = i.vault_id AND t.oid = i.descendant WHERE k = 1",
    "z2_export_closure": _CLO + " SELECT DISTINCT c.vault_id, c.oid, counter, node_id FROM d_commits c JOIN incl i ON i.vault_id = c.vault_id AND i.ancestor = c.oid JOIN (SELECT vault_id, oid FROM tips WHERE k = 2) t ON t.vault_id = i.vault_id AND t.oid = i.descendant",
    "z4_gc_unreachable": _CLO + " SELECT vault_id, oid FROM d_commits EXCEPT SELECT i.vault_id, ancestor FROM incl i JOIN (SELECT vault_id, oid FROM tips WHERE k = 1 UNION SELECT vault_id, oid FROM d_commits WHERE counter = 1) r ON r.vault_id = i.vault_id AND r.oid = descendant",
    "j14_missing_objects": _CLO + " SELECT i.vault_id, i.ancestor AS oid FROM incl i JOIN tips t ON t.vault_id = i.vault_id AND t.oid = i.descendant AND k = 1 EXCEPT SELECT vault_id, oid FROM d_commits WHERE counter <= 10",
    "j6_want_tips": _CLO + " SELECT vault_id, oid FROM tips EXCEPT SELECT vault_id, oid FROM d_commits WHERE counter % 2 = 0 AND counter % 3 <> 0",
    "f12_want_filter": _C + " SELECT vault_id, lower(oid) AS oid FROM (SELECT vault_id, CASE WHEN counter % 5 = 0 THEN oid || 'x' WHEN counter % 7 = 0 THEN upper(oid) ELSE oid END AS oid FROM d_commits) WHERE regexp_full_match(oid, '[0-9a-fA-F]{40}')",
    "g10_dangling": "WITH " + fleet.EDGES_SQL + " SELECT vault_id, child, parent FROM d_edges e WHERE NOT EXISTS (SELECT 1 FROM d_commits c WHERE c.vault_id = e.vault_id AND c.oid = e.parent AND counter % 11 <> 0)",
    "a1_next_counter": _C + " SELECT vault_id, node_id, max(counter) + 1 AS next_counter FROM d_commits GROUP BY ALL",
    "a11_snapshot": _CLO + " SELECT vault_id, string_agg(oid, ',' ORDER BY counter, node_id, oid) AS frontier FROM tips GROUP BY ALL",
    "j12_snapshot_subset": _CLO + """, early AS (SELECT vault_id, oid FROM d_commits WHERE counter <= 12),
snap AS (SELECT * FROM early e WHERE NOT EXISTS (SELECT 1 FROM clo JOIN early f ON f.vault_id = clo.vault_id AND f.oid = clo.descendant WHERE clo.vault_id = e.vault_id AND clo.ancestor = e.oid))
SELECT DISTINCT c.vault_id, c.oid, c.counter FROM d_commits c JOIN incl i ON i.vault_id = c.vault_id AND i.ancestor = c.oid JOIN snap s ON s.vault_id = i.vault_id AND s.oid = i.descendant""",
    "z1_union_known": _C + " SELECT vault_id, oid FROM d_commits WHERE counter % 3 <> 0 UNION SELECT vault_id, oid FROM d_commits WHERE counter % 2 = 0",
    "a13_convergence": _CLO + """, last AS (SELECT vault_id, node_id, arg_max(oid, counter) AS descendant FROM d_commits GROUP BY ALL),
known AS (SELECT l.vault_id, node_id, string_agg(ancestor, ',' ORDER BY ancestor) AS held FROM last l JOIN incl i ON i.vault_id = l.vault_id AND i.descendant = l.descendant GROUP BY ALL)
SELECT vault_id, count(*) AS nodes, count(DISTINCT held) = 1 AS converged FROM known GROUP BY vault_id""",
    "l5_maximal_bases": _CLO + """, pairs AS (SELECT vault_id, k, lag(oid) OVER (PARTITION BY vault_id ORDER BY k) AS a, oid AS b FROM tips QUALIFY a IS NOT NULL),
common AS (SELECT p.vault_id, k, x.ancestor FROM pairs p JOIN incl x ON x.vault_id = p.vault_id AND x.descendant = a JOIN incl y ON y.vault_id = p.vault_id AND y.descendant = b AND y.ancestor = x.ancestor)
SELECT vault_id, k::INTEGER AS k, count(*) AS n, min(ancestor) AS base FROM common c WHERE NOT EXISTS (SELECT 1 FROM common d JOIN clo ON clo.vault_id = d.vault_id AND clo.descendant = d.ancestor
  WHERE d.vault_id = c.vault_id AND d.k = c.k AND clo.ancestor = c.ancestor) GROUP BY ALL""",
    "l3_export_order": _C + " SELECT vault_id, oid, row_number() OVER (PARTITION BY vault_id ORDER BY oid)::INTEGER AS place FROM d_commits",
    "g6_known_at": _CLO + """, early AS (SELECT vault_id, oid, author_time FROM d_commits WHERE author_time % 86400 <= 43200)
SELECT vault_id, oid, author_time FROM early e WHERE NOT EXISTS (SELECT 1 FROM clo JOIN early f ON f.vault_id = clo.vault_id AND f.oid = clo.descendant WHERE clo.vault_id = e.vault_id AND clo.ancestor = e.oid)""",
}
