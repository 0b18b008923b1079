"""Trees as objects: entries by tree id, the graph of commits, trees and blobs, and diffs that skip what is equal.

entries are (vault_id, tree_oid, name, mode, child_oid), once per tree whatever commits hold it; roots (vault_id, oid, tree_oid) name
every commit's tree. A tree's content is told by its id, so two trees with one id are never opened, and a subtree that many
commits share is one row wherever it is walked.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import saved, saved_counted
from ..operators import dag
from ..operators.scope import parent_dir
from .trees import tree_objects

FOLDER = "40000"


def stored_trees(trees: DataFrame) -> tuple[DataFrame, DataFrame]:
    """trees (vault_id, oid of a commit, path, blob_oid) -> (roots, entries)."""
    made = saved(tree_objects(trees, ("vault_id", "oid")).select("vault_id", "oid", "dir", "tree_oid"), "trees")
    one = saved(made.groupBy("vault_id", "tree_oid").agg(F.min(F.struct("oid", "dir")).alias("at")).select("vault_id", "tree_oid", "at.oid", "at.dir"), "holders")
    files = trees.select("vault_id", "oid", parent_dir(F.col("path")).alias("dir"), F.substring_index("path", "/", -1).alias("name"), F.lit("100644").alias("mode"), F.col("blob_oid").alias("child_oid"))
    folders = made.where("dir <> ''").select("vault_id", "oid", parent_dir(F.col("dir")).alias("dir"), F.substring_index("dir", "/", -1).alias("name"), F.lit(FOLDER).alias("mode"), F.col("tree_oid").alias("child_oid"))
    entries = files.unionByName(folders).join(one, ["vault_id", "oid", "dir"]).select("vault_id", "tree_oid", "name", "mode", "child_oid")
    return made.where("dir = ''").select("vault_id", "oid", "tree_oid"), saved(entries, "entries")


def object_links(edges: DataFrame, roots: DataFrame, entries: DataFrame) -> DataFrame:
    """(vault_id, src, dst): commits to parents and trees, trees to what they hold."""
    up = edges.select("vault_id", F.col("child").alias("src"), F.col("parent").alias("dst"))
    down = roots.select("vault_id", F.col("oid").alias("src"), F.col("tree_oid").alias("dst"))
    return up.unionByName(down).unionByName(entries.select("vault_id", F.col("tree_oid").alias("src"), F.col("child_oid").alias("dst")).distinct())


def all_objects(commits: DataFrame, roots: DataFrame, entries: DataFrame) -> DataFrame:
    """(vault_id, oid, kind) of every commit, tree and blob."""
    commit = commits.select("vault_id", "oid", F.lit("commit").alias("kind"))
    tree = roots.select("vault_id", F.col("tree_oid").alias("oid")).unionByName(entries.select("vault_id", F.col("tree_oid").alias("oid"))).distinct().withColumn("kind", F.lit("tree"))
    blob = entries.where(F.col("mode") != FOLDER).select("vault_id", F.col("child_oid").alias("oid")).distinct().withColumn("kind", F.lit("blob"))
    return commit.unionByName(tree).unionByName(blob)


def reached(roots_of_walk: DataFrame, edges: DataFrame, roots: DataFrame, entries: DataFrame) -> DataFrame:
    """(vault_id, oid) of all objects that roots_of_walk (vault_id, oid) reach, themselves included. Commits are walked first, then
    the distinct trees that they name, each tree once."""
    up = edges.select("vault_id", F.col("child").alias("src"), F.col("parent").alias("dst"))
    commits = saved(dag.reachable(roots_of_walk.select("vault_id", "oid"), up), "commits")
    named = roots.join(commits, ["vault_id", "oid"], "left_semi").select("vault_id", F.col("tree_oid").alias("oid")).distinct()
    down = entries.select("vault_id", F.col("tree_oid").alias("src"), F.col("child_oid").alias("dst")).distinct()
    return commits.unionByName(dag.reachable(named, down))


class Diff(NamedTuple):
    """rows (vault_id, id, path, is_tree, old, new): what differs, trees included (the root's path is ''), null where a side lacks
    it; same (vault_id, id, child_oid, is_tree): entries that both sides of an opened tree hold; opened (vault_id, old, new): the
    pairs of trees that were opened, '' for none, once for all that ask."""

    rows: DataFrame
    same: DataFrame
    opened: DataFrame


def pruned_diff(pairs: DataFrame, entries: DataFrame, most_depth: int = 1000) -> Diff:
    """pairs (vault_id, id, old, new: root trees, old may be null). All pairs go down together, level by level; subtrees with equal ids
    are not opened, and a pair of subtrees is opened once however many pairs of roots come to it. So the work grows with what
    differs, not with the trees."""
    none = F.lit("")
    front = pairs.select("vault_id", "id", F.coalesce("old", none).alias("old"), F.coalesce("new", none).alias("new"), F.lit("").alias("path")).where("old <> new")
    front = saved(front, "front")
    rows = [front.select("vault_id", "id", "path", F.lit(True).alias("is_tree"), "old", "new")]
    same, opened = [], []
    is_tree = (F.col("mode") == FOLDER).alias("is_tree")
    for _ in range(most_depth):
        pair = saved(front.select("vault_id", "old", "new").distinct(), "opened")
        opened.append(pair)
        side = lambda name, other: pair.where(F.col(name) != "").join(entries.withColumnRenamed("tree_oid", name), ["vault_id", name]).select(
            "vault_id", "old", "new", "name", is_tree, F.col("child_oid").alias(f"{name}_child"), F.lit(None).cast("string").alias(f"{other}_child"))
        both = side("old", "new").unionByName(side("new", "old")).groupBy("vault_id", "old", "new", "name", "is_tree").agg(F.max("old_child").alias("o"), F.max("new_child").alias("n"))
        here = front.join(saved(both, "both"), ["vault_id", "old", "new"])
        here = here.select("vault_id", "id", F.concat("path", F.when(F.col("path") != "", "/").otherwise(""), "name").alias("path"), "is_tree", F.coalesce("o", none).alias("old"), F.coalesce("n", none).alias("new"))
        here, deeper = saved_counted(here, "level", "is_tree AND old <> new")
        rows.append(here.where("old <> new"))
        same.append(here.where("old = new").select("vault_id", "id", F.col("new").alias("child_oid"), "is_tree"))
        if not deeper:
            null = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
            return Diff(dag._all(rows).select("vault_id", "id", "path", "is_tree", null("old"), null("new")), dag._all(same), dag._all(opened))
        front = here.where("is_tree AND old <> new").select("vault_id", "id", "old", "new", "path")
    raise RuntimeError("the folders are nested too deeply")


def status(diff: Diff) -> DataFrame:
    """(vault_id, id, path, status, old, new) of the files that differ."""
    told = F.when(F.col("old").isNull(), "A").when(F.col("new").isNull(), "D").otherwise("M")
    return diff.rows.where("NOT is_tree").select("vault_id", "id", "path", told.alias("status"), "old", "new")


def new_objects(diff: Diff, entries: DataFrame) -> DataFrame:
    """(vault_id, id, oid, kind) of the trees and blobs of the new side that the old side holds nowhere. Where an object has only moved, the
    old side holds it at a place that differs too, among the entries that stayed, or inside a subtree that stayed: each distinct one
    of those is walked once for all pairs."""
    fresh = diff.rows.where("new IS NOT NULL").select("vault_id", "id", F.col("new").alias("oid"), F.when(F.col("is_tree"), "tree").otherwise("blob").alias("kind")).distinct()
    was = diff.rows.where("old IS NOT NULL").select("vault_id", "id", F.col("old").alias("oid"))
    stayed = diff.same.select("vault_id", "id", F.col("child_oid").alias("oid"))
    tops = diff.same.where("is_tree").select("vault_id", "id", F.col("child_oid").alias("top")).distinct()
    down = entries.select("vault_id", F.col("tree_oid").alias("src"), F.col("child_oid").alias("dst")).distinct()
    inside = dag.reachable(tops.select("vault_id", "top", F.col("top").alias("oid")).distinct(), down, by=["top"])
    wanted = fresh.select("vault_id", "oid").distinct()
    within = inside.join(wanted, ["vault_id", "oid"], "left_semi").join(tops, ["vault_id", "top"]).select("vault_id", "id", "oid")
    held = was.unionByName(stayed).unionByName(within).distinct()
    return fresh.join(held, ["vault_id", "id", "oid"], "left_anti")


def fsck(objects: DataFrame, links: DataFrame) -> DataFrame:
    """objects (vault_id, oid, kind, declared, payload; both null where the bytes are not at hand) and links (vault_id, src, dst) ->
    (vault_id, oid, fault, other): `length` where the declared length is not the payload's, `id` where the id is not that of the
    bytes, and `dangling` where an object that is there names one (other) that is not."""
    size = F.octet_length("payload").cast("long")
    framed = F.concat(F.concat("kind", F.lit(" "), size.cast("string")).cast("binary"), F.lit(bytes(1)), "payload")
    none = F.lit(None).cast("string").alias("other")
    read = objects.where("payload IS NOT NULL").select("vault_id", "oid", F.explode(F.array_compact(F.array(
        F.when(F.col("declared") != size, F.lit("length")), F.when(F.sha1(framed) != F.col("oid"), F.lit("id"))))).alias("fault"), none)
    there = saved(objects.select("vault_id", "oid").distinct(), "there")
    named = links.join(there.withColumnRenamed("oid", "src"), ["vault_id", "src"], "left_semi").distinct()
    lost = named.join(there.withColumnRenamed("oid", "dst"), ["vault_id", "dst"], "left_anti")
    return read.unionByName(lost.select("vault_id", F.col("src").alias("oid"), F.lit("dangling").alias("fault"), F.col("dst").alias("other")))
