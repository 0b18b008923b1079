"""Commits, trees and blobs as one graph over the fleet of `events`: closures, exports, garbage, and diffs on tree objects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dag, mainline
from ..plans import objects, trees as plans
from . import mainline as lines


def _stored(spark, sf_dir) -> tuple[lines.Fleet, DataFrame, DataFrame]:
    f = lines._fleet(spark, sf_dir)
    return f, *objects.stored_trees(f.trees)


def g2_object_graph(spark, sf_dir):
    """Commits, trees and blobs that the first tip of every vault reaches, with their kinds."""
    f, roots, entries = _stored(spark, sf_dir)
    seen = objects.reached(lines._first_tips(f), f.edges, roots, entries)
    return objects.all_objects(f.commits, roots, entries).join(seen, ["vault_id", "oid"], "left_semi")


def z2_export_objects(spark, sf_dir):
    """What travels when a peer asks for everything below the second tip of every vault."""
    f, roots, entries = _stored(spark, sf_dir)
    tip = mainline.tips_of(f.commits, f.edges).where("k = 2").select("vault_id", "oid")
    seen = objects.reached(tip, f.edges, roots, entries)
    return objects.all_objects(f.commits, roots, entries).join(seen, ["vault_id", "oid"], "left_semi").select("vault_id", "kind", "oid")


def j14_missing_graph(spark, sf_dir):
    """What a receiver lacks of the first tip's closure if it holds all that the commits up to counter 10 are made of."""
    f, roots, entries = _stored(spark, sf_dir)
    wanted = objects.reached(lines._first_tips(f), f.edges, roots, entries)
    held = objects.reached(lines.fleet.commits(spark, sf_dir).where("counter <= 10").select("vault_id", "oid"), f.edges.limit(0), roots, entries)
    return wanted.join(held, ["vault_id", "oid"], "left_anti")


def _sole(f: lines.Fleet) -> DataFrame:
    """(vault_id, oid, parent) of primitives with a sole parent."""
    sole = f.edges.groupBy("vault_id", F.col("child").alias("oid")).agg(F.count("*").alias("n"), F.min("parent").alias("parent")).where("n = 1").drop("n")
    return f.commits.where("is_primitive").select("vault_id", "oid").join(sole, ["vault_id", "oid"])


def _pairs(f: lines.Fleet, roots: DataFrame) -> DataFrame:
    """The trees of primitives with a sole parent, and of those parents."""
    new = _sole(f).join(roots.withColumnRenamed("tree_oid", "new"), ["vault_id", "oid"], "left")
    old = roots.select("vault_id", F.col("oid").alias("parent"), F.col("tree_oid").alias("old"))
    return new.join(old, ["vault_id", "parent"], "left").select("vault_id", F.col("oid").alias("id"), "old", "new")


def z3_export_new_objects(spark, sf_dir):
    """What every primitive with a sole parent travels with: itself, and the trees and blobs that its parent's tree holds nowhere."""
    f, roots, entries = _stored(spark, sf_dir)
    new = objects.new_objects(objects.pruned_diff(_pairs(f, roots), entries), entries)
    return new.select("vault_id", F.col("id").alias("oid"), "kind", F.col("oid").alias("object")).unionByName(_sole(f).select("vault_id", "oid", F.lit("commit").alias("kind"), F.col("oid").alias("object")))


def j3_added_by_objects(spark, sf_dir):
    """Paths that every primitive adds to its sole parent's tree, found on tree objects."""
    f, roots, entries = _stored(spark, sf_dir)
    return objects.status(objects.pruned_diff(_pairs(f, roots), entries)).where("status = 'A'").select("vault_id", F.col("id").alias("oid"), "path")


def z7_diff_by_objects(spark, sf_dir):
    """What every primitive changes against its sole parent, found on tree objects."""
    f, roots, entries = _stored(spark, sf_dir)
    return objects.status(objects.pruned_diff(_pairs(f, roots), entries)).withColumnRenamed("id", "oid")


def z4_gc_from_roots(spark, sf_dir):
    """Objects that neither a vault's main (its folds and their trees included), nor its nodes' latest commits, nor its snapshot (what
    was known at commit 12) reach; a report, nothing is deleted."""
    f, roots, entries = _stored(spark, sf_dir)
    done = lines._main(f, f.commits)
    tips = done.folds.select("vault_id", F.explode("parents").alias("oid"))
    nodes = f.commits.where("is_primitive").groupBy("vault_id", "node_id").agg(F.max_by("oid", F.struct("counter", "oid")).alias("oid")).select("vault_id", "oid")
    early = lines.fleet.commits(spark, sf_dir).where("counter <= 12").select("vault_id", "oid")
    kept = objects.reached(tips.unionByName(nodes).unionByName(dag.frontier(early, f.edges)), f.edges, roots, entries)
    folded = plans.step_tree_oids(done.changes).select("vault_id", F.col("tree_oid").alias("oid")).unionByName(done.changes.select("vault_id", F.col("blob_oid").alias("oid")))
    return objects.all_objects(f.commits, roots, entries).join(kept.unionByName(folded).distinct(), ["vault_id", "oid"], "left_anti")


def g5_fsck_objects_whole(spark, sf_dir):
    """Faults of the fleet's objects, of which every eleventh commit is lost, blobs whose length is a multiple of five declare a byte
    too many, and those whose id ends in 0 have grown by a byte."""
    f, roots, entries = _stored(spark, sf_dir)
    raw, size = F.col("content").cast("binary"), F.octet_length("content").cast("long")
    blobs = f.trees.select("vault_id", "blob_oid").distinct().join(f.blobs, "blob_oid").select(
        "vault_id", F.col("blob_oid").alias("oid"), F.lit("blob").alias("kind"), (size + (size % 5 == 0).cast("long")).alias("declared"),
        F.when(F.col("blob_oid").endswith("0"), F.concat(raw, F.lit(b"x"))).otherwise(raw).alias("payload"))
    lost = lines.fleet.commits(spark, sf_dir).where("counter % 11 = 0").select("vault_id", "oid")
    rest = objects.all_objects(f.commits, roots, entries).where("kind <> 'blob'").join(lost, ["vault_id", "oid"], "left_anti")
    rest = rest.select("vault_id", "oid", "kind", F.lit(None).cast("long").alias("declared"), F.lit(None).cast("binary").alias("payload"))
    return objects.fsck(blobs.unionByName(rest), objects.object_links(f.edges, roots, entries))


QUERIES = {f.__name__: f for f in (g2_object_graph, z2_export_objects, j14_missing_graph, z3_export_new_objects, j3_added_by_objects, z7_diff_by_objects, z4_gc_from_roots, g5_fsck_objects_whole)}

_SUB = f"SELECT vault_id, oid, {lines._tree_sql('body')} AS tree FROM (SELECT vault_id, oid, string_agg(hex(('100644 f' || p::VARCHAR || '.md')::BLOB) || '00' || upper(blob_oid), '' ORDER BY p) AS body FROM trees WHERE p > 3 GROUP BY ALL)"
_TOP = f"""SELECT vault_id, oid, {lines._tree_sql('body')} AS tree FROM (SELECT vault_id, oid, string_agg(e, '' ORDER BY n) AS body FROM (SELECT vault_id, oid, 'd/' AS n, hex('40000 d'::BLOB) || '00' || upper(tree) AS e FROM csub
  UNION ALL SELECT vault_id, oid, 'f' || p::VARCHAR, hex(('100644 f' || p::VARCHAR || '.md')::BLOB) || '00' || upper(blob_oid) FROM trees WHERE p <= 3) GROUP BY ALL)"""
#: holds: every commit with itself, its trees and its blobs.
_HOLDS = f""", csub AS ({_SUB}), ctop AS ({_TOP}),
holds AS (SELECT vault_id, oid, oid AS object, 'commit' AS kind FROM d_commits UNION SELECT vault_id, oid, tree, 'tree' FROM csub UNION SELECT vault_id, oid, tree, 'tree' FROM ctop UNION SELECT vault_id, oid, blob_oid, 'blob' FROM trees)"""


def _below(roots: str) -> str:
    return f"SELECT DISTINCT h.vault_id, h.object AS oid, h.kind FROM ({roots}) r JOIN incl i ON i.vault_id = r.vault_id AND i.descendant = r.oid JOIN holds h ON h.vault_id = i.vault_id AND h.oid = i.ancestor"


_TOLD = lines._FACTS + _HOLDS + ", own AS (SELECT p.vault_id, p.oid, parent FROM prim p JOIN sole s ON s.vault_id = p.vault_id AND s.oid = p.oid)"
_CHANGED = """SELECT o.vault_id, o.oid, p.path, a.blob_oid AS old, b.blob_oid AS new FROM own o JOIN (SELECT DISTINCT vault_id, path FROM trees) p ON p.vault_id = o.vault_id
  LEFT JOIN trees a ON a.vault_id = o.vault_id AND a.oid = o.parent AND a.path = p.path LEFT JOIN trees b ON b.vault_id = o.vault_id AND b.oid = o.oid AND b.path = p.path WHERE a.blob_oid IS DISTINCT FROM b.blob_oid"""

ORACLES = {
    "g2_object_graph": lines._PLAIN_TIPS + _HOLDS + " " + _below("SELECT vault_id, oid FROM tips WHERE k = 1"),
    "z2_export_objects": lines._PLAIN_TIPS + _HOLDS + " " + _below("SELECT vault_id, oid FROM tips WHERE k = 2"),
    "j14_missing_graph": lines._PLAIN_TIPS + _HOLDS + f" SELECT vault_id, oid FROM ({_below('SELECT vault_id, oid FROM tips WHERE k = 1')}) EXCEPT SELECT h.vault_id, h.object FROM holds h JOIN d_commits c ON c.vault_id = h.vault_id AND c.oid = h.oid WHERE counter <= 10",
    "z3_export_new_objects": _TOLD + """ SELECT o.vault_id, o.oid, h.kind, h.object FROM own o JOIN holds h ON h.vault_id = o.vault_id AND h.oid = o.oid
WHERE h.kind = 'commit' OR NOT EXISTS (SELECT 1 FROM holds w WHERE w.vault_id = o.vault_id AND w.oid = o.parent AND w.object = h.object)""",
    "j3_added_by_objects": _TOLD + f" SELECT vault_id, oid, path FROM ({_CHANGED}) WHERE old IS NULL",
    "z7_diff_by_objects": _TOLD + f" SELECT vault_id, oid, path, CASE WHEN old IS NULL THEN 'A' WHEN new IS NULL THEN 'D' ELSE 'M' END AS status, old, new FROM ({_CHANGED})",
    "z4_gc_from_roots": lines._ALL + _HOLDS + """, early AS (SELECT vault_id, oid FROM d_commits WHERE counter <= 12),
kept AS (""" + _below("SELECT vault_id, oid FROM tips UNION SELECT vault_id, arg_max(oid, (counter, oid)) FROM prim GROUP BY vault_id, node UNION SELECT vault_id, oid FROM early") + """)
SELECT vault_id, object AS oid, kind FROM holds EXCEPT SELECT vault_id, oid, kind FROM kept EXCEPT SELECT vault_id, oid, 'tree' FROM sub EXCEPT SELECT vault_id, tree, 'tree' FROM tid EXCEPT SELECT vault_id, o, 'blob' FROM run""",
    "g5_fsck_objects_whole": lines._FACTS + """, b AS (SELECT DISTINCT t.vault_id, t.blob_oid AS oid, strlen(h.content) AS n FROM held h JOIN trees t ON t.vault_id = h.vault_id AND t.oid = h.oid AND t.p = h.p)
SELECT vault_id, oid, 'length' AS fault, NULL::VARCHAR AS other FROM b WHERE (n % 5 = 0) <> (right(oid, 1) = '0') UNION ALL SELECT vault_id, oid, 'id', NULL FROM b WHERE right(oid, 1) = '0'
UNION ALL SELECT e.vault_id, e.child, 'dangling', e.parent FROM d_edges e JOIN d_commits p ON p.vault_id = e.vault_id AND p.oid = e.parent JOIN d_commits c ON c.vault_id = e.vault_id AND c.oid = e.child WHERE p.counter % 11 = 0 AND c.counter % 11 <> 0""",
}
