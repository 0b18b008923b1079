"""The main line of every vault: what all its known commits fold to, as trees and as commits, and whether recorded folds are
what they claim to be.

Commits are (vault_id, oid, node_id, counter, time, is_primitive), edges (vault_id, child, parent), trees (vault_id, oid, path,
blob_oid) of every commit, blobs (blob_oid, content). The protocol's short name is a parameter (it is part of fold commits).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField

from ..functions.tables import saved
from ..plans.trees import EMPTY_TREE, paths_toggled, step_tree_oids
from . import dag, fold
from .history import commit_payload, ghost_adds, latest_touches_on_dag, object_oid
from .vaults import each_vault, linked, only


class Main(NamedTuple):
    """mains (vault_id, main_oid, tree_oid, tips), files (vault_id, path, blob_oid) of the main tree, folds (vault_id, k, oid,
    tree_oid, parents, time) made on the way, texts (blob_oid, content) that merges
    of lines made, and changes (vault_id, path, k, blob_oid): what each step changes; fold.standing() spreads them out."""

    mains: DataFrame
    files: DataFrame
    folds: DataFrame
    texts: DataFrame
    changes: DataFrame


def fold_oid(tree: Column, parents: Column, time: Column, protocol: str, kind: str = "fold") -> Column:
    """The id of a synthetic commit: fixed identity and message, the time of its latest parent."""
    return object_oid("commit", commit_payload(tree, parents, F.lit(protocol), F.lit(protocol + "@localhost"), time, F.lit(f"{protocol}: {kind}\n")))


def genesis_oid(protocol: str) -> Column:
    """The id of what a vault without commits folds to."""
    return fold_oid(F.lit(EMPTY_TREE), F.array().cast("array<string>"), F.lit(0).cast("long"), protocol, "genesis")


def touches(commits: DataFrame, edges: DataFrame, trees: DataFrame) -> DataFrame:
    """(vault_id, oid, parent, path, kind, counter, node_id) of every path whose presence a primitive with a sole parent toggles."""

    def run(own: list[tuple], links: list[tuple], held: list[tuple]) -> Iterator[tuple]:
        up, paths = linked(links), {}
        for oid, path in held:
            paths.setdefault(oid, set()).add(path)
        for oid, counter, node in own:
            if len(up.get(oid, ())) == 1:
                mine, was = paths.get(oid, set()), paths.get(up[oid][0], set())
                yield from ((oid, up[oid][0], path, "add" if path in mine else "delete", counter, node) for path in mine ^ was)

    asked = commits.where("is_primitive").select("vault_id", "oid", "counter", "node_id")
    kinds = commits.schema
    text = lambda name: StructField(name, StringType())
    found, large = each_vault(
        [asked, edges.select("vault_id", "child", "parent"), trees.select("vault_id", "oid", "path")], run,
        [text("oid"), text("parent"), text("path"), text("kind"), kinds["counter"], kinds["node_id"]], "touches")
    if large is None:
        return found
    asked, links, held = only(large, asked, edges, trees)
    sole = links.groupBy("vault_id", F.col("child").alias("oid")).agg(F.count("*").alias("n"), F.min("parent").alias("parent")).where("n = 1").drop("n")
    asked = asked.join(sole, ["vault_id", "oid"])
    return found.unionByName(paths_toggled(asked, held).join(asked, ["vault_id", "oid"]).select("vault_id", "oid", "parent", "path", "kind", "counter", "node_id"))


def ghosts(commits: DataFrame, edges: DataFrame, trees: DataFrame, readds: DataFrame | None = None) -> DataFrame:
    """(vault_id, oid) of primitives that bring back a path whose latest touch before them is a delete that they do not name in
    readds (vault_id, oid, touch_oid). Where a commit's history is not whole nothing is proven and it stays."""
    return ghosts_of(touches(commits, edges, trees), commits, edges, readds)


def ghosts_of(told: DataFrame, commits: DataFrame, edges: DataFrame, readds: DataFrame | None = None, asked: DataFrame | None = None) -> DataFrame:
    """ghosts() of the touches of all commits; only the commits of asked (vault_id, oid), if given, and then only the vaults in which one
    of them adds what was deleted are labelled."""
    # Only a path that was deleted at some time can be brought back by mistake.
    deleted = told.where("kind = 'delete'").select("vault_id", "path").distinct()
    added = saved(told.where("kind = 'add'").join(deleted, ["vault_id", "path"], "left_semi").select("vault_id", "oid", "parent", "path"), "added")
    if asked is not None:
        added = saved(added.join(asked.select("vault_id", "oid"), ["vault_id", "oid"], "left_semi"), "asked")
        near = saved(added.select("vault_id").distinct(), "near")
        commits, edges, told = (saved(t.join(near, "vault_id", "left_semi"), "near") for t in (commits, edges, told))
    last = latest_touches_on_dag(added.select("vault_id", F.col("parent").alias("oid"), "path").distinct(), told, commits, edges)
    if readds is None:
        readds = added.select("vault_id", "oid", F.lit(None).cast("string").alias("touch_oid")).limit(0)
    none = added.select("vault_id", "oid").limit(0)
    # Where a parent's history is not whole nothing is proven, whatever another of the commit's paths says.
    kept = added.join(last.where("NOT whole").select("vault_id", F.col("oid").alias("parent")).distinct(), ["vault_id", "parent"], "left_semi").select("vault_id", "oid")
    return ghost_adds(added, last.where("whole"), readds, none).join(kept, ["vault_id", "oid"], "left_anti")


class Begun(NamedTuple):
    """Where a fold goes on: folds (vault_id, oid, k from 2, time) made before, and files (vault_id, path, k, blob_oid) of their trees."""

    folds: DataFrame
    files: DataFrame


def fold_tips(tips: DataFrame, bases: DataFrame, trees: DataFrame, blobs: DataFrame, protocol: str, begun: Begun | None = None) -> Main:
    """Folds tips (vault_id, oid, k from 1, time) with bases (vault_id, k, base; the empty tree where there is none) left to right.
    One tip is wrapped as it is. Vaults that begun names go on from there: their tips are those behind, mains, folds and changes tell
    the new steps, and files the whole tree."""
    tips = tips.select("vault_id", "oid", F.col("k").cast("int").alias("k"), "time")
    steps = fold.steps_of(tips, bases.select("vault_id", F.col("k").cast("int").alias("k"), "base"), trees)
    if begun is not None:
        # What stands is a step of its own, which takes all that it holds.
        start = begun.folds.select("vault_id", "oid", F.col("k").cast("int").alias("k"), "time")
        tips = tips.unionByName(start)
        steps = steps.unionByName(begun.files.select("vault_id", "path", F.col("k").cast("int").alias("k"), F.col("blob_oid").alias("tip"), F.lit(None).cast("string").alias("base")))
    tips = saved(tips, "tips")
    done = saved(fold.folded(steps), "steps")
    merged = saved(fold.folded_lines(done.where("lines"), blobs), "merged")
    states = done.where("NOT lines").select("vault_id", "path", "k", "blob_oid").unionByName(merged.select("vault_id", "path", "k", "blob_oid"))
    changed = saved(fold.changes(states), "changes")
    roots = step_tree_oids(changed).where("dir = ''").select("vault_id", "k", F.coalesce("tree_oid", F.lit(EMPTY_TREE)).alias("tree_oid"))
    along = Window.partitionBy("vault_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    whole = tips.join(roots, ["vault_id", "k"], "left").withColumn("tree_oid", F.coalesce(F.last("tree_oid", True).over(along), F.lit(EMPTY_TREE)))
    folds = _chain(whole, protocol)
    made = changed
    if begun is not None:
        old = begun.folds.select("vault_id", F.col("k").cast("int").alias("k"))
        folds, made = (t.join(old, ["vault_id", "k"], "left_anti") for t in (folds, made))
    folds = saved(folds, "folds")
    last = folds.groupBy("vault_id").agg(F.max("k").alias("k"))
    mains = folds.join(last, ["vault_id", "k"]).select("vault_id", F.col("oid").alias("main_oid"), "tree_oid", F.col("k").alias("tips"))
    files = changed.groupBy("vault_id", "path").agg(F.max_by(F.struct("blob_oid"), "k").alias("now")).select("vault_id", "path", "now.blob_oid").where("blob_oid IS NOT NULL")
    return Main(mains, files, folds, merged.where("content IS NOT NULL").select("blob_oid", "content").dropDuplicates(["blob_oid"]), made)


def _chain(whole: DataFrame, protocol: str) -> DataFrame:
    """whole (vault_id, k, oid, time, tree_oid of every step) -> the fold commits (vault_id, k, oid, tree_oid, parents, time). Each is
    a parent of the next, so a vault's steps stream by in order; only the latest fold is held. One tip is wrapped as it is."""
    fields = [("vault_id", pa.string()), ("k", pa.int32()), ("oid", pa.string()), ("tree_oid", pa.string()), ("parents", pa.list_(pa.string())), ("time", pa.int64())]
    schema = pa.schema(fields)

    def made(vault: str, k: int, tree: str, parents: list[str], time: int) -> tuple:
        who = f"{protocol} <{protocol}@localhost> {time} +0000\n"
        body = (f"tree {tree}\n" + "".join(f"parent {p}\n" for p in parents) + f"author {who}committer {who}\n{protocol}: fold\n").encode()
        return vault, k, hashlib.sha1(b"commit %d\x00" % len(body) + body).hexdigest(), tree, parents, time

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, acc, since, first = None, None, None, None
        for batch in batches:
            out = []
            for vault, k, oid, time, tree in zip(*(c.to_pylist() for c in batch.columns)):
                if vault != at:
                    out += [first] if first else []
                    at, acc, since, first = vault, oid, time, made(vault, k, tree, [oid], time)
                    continue
                first, since = None, max(since, time)
                out.append(made(vault, k, tree, [acc, oid], since))
                acc = out[-1][2]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        if first:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(first, schema)], schema=schema)

    ordered = whole.select("vault_id", "k", "oid", "time", "tree_oid").repartition("vault_id").sortWithinPartitions("vault_id", "k")
    return ordered.mapInArrow(run, "vault_id string, k int, oid string, tree_oid string, parents array<string>, time long")


def tips_of(known: DataFrame, edges: DataFrame, dropped: DataFrame | None = None) -> DataFrame:
    """(vault_id, oid, k, time) of the tips of all primitives among known commits but the dropped ones, in their strict order."""
    effective = known.where("is_primitive")
    if dropped is not None:
        effective = effective.join(dropped.select("vault_id", "oid"), ["vault_id", "oid"], "left_anti")
    return dag.ranked(dag.frontier(effective, edges), "k").select("vault_id", "oid", "k", "time")


def folded_tips(folds: DataFrame) -> DataFrame:
    """(vault_id, oid, k) of the tips that folds are made of: each step's last parent, and the first one's other."""
    own = folds.select("vault_id", F.element_at("parents", -1).alias("oid"), "k")
    return own.unionByName(folds.where("k = 2").select("vault_id", F.col("parents")[0].alias("oid"), F.lit(1).alias("k")))


def compute_main(known: DataFrame, edges: DataFrame, trees: DataFrame, blobs: DataFrame, protocol: str, readds: DataFrame | None = None, history: DataFrame | None = None, dropped: DataFrame | None = None) -> Main:
    """Of every vault with known commits the main line: ghosts go, the frontier of what is left is folded. history: all stored
    commits, if more than the known ones (restores). dropped: their ghosts (vault_id, oid), where the caller has them already. A vault
    with no tip has the genesis."""
    known = saved(known, "known")
    if dropped is None:
        dropped = saved(ghosts(known if history is None else history, edges, trees, readds), "ghosts")
    tips = saved(tips_of(known, edges, dropped), "tips")
    done = fold_tips(tips, dag.fold_bases(tips, edges).select("vault_id", "k", "base"), trees, blobs, protocol)
    bare = known.select("vault_id").distinct().join(tips.select("vault_id"), "vault_id", "left_anti")
    started = bare.select("vault_id", genesis_oid(protocol).alias("main_oid"), F.lit(EMPTY_TREE).alias("tree_oid"), F.lit(0).alias("tips"))
    return done._replace(mains=done.mains.unionByName(started))


def wrong_folds(folds: DataFrame, commits: DataFrame, edges: DataFrame, trees: DataFrame, blobs: DataFrame, protocol: str) -> DataFrame:
    """(vault_id, oid) of recorded synthetic commits (vault_id, oid, parents in order) that do not come out when their parents
    are folded again, and of those that build on one through synthetic commits. commits (vault_id, oid, time), edges and trees
    hold all commits, folds too. Tips without a common ancestor merge against the empty tree, as all histories begin. One without parents must be the genesis; more than two parents are never right."""
    folds = saved(folds.select("vault_id", "oid", "parents"), "recorded")
    own = F.concat_ws("/", "vault_id", "oid")
    some = folds.where(F.size("parents").between(1, 2)).withColumn("fold", own)
    tips = some.select("vault_id", "fold", F.posexplode("parents").alias("at", "tip")).join(commits.select("vault_id", F.col("oid").alias("tip"), "time"), ["vault_id", "tip"])
    tips = saved(tips.select("vault_id", "fold", F.col("tip").alias("oid"), (F.col("at") + 1).alias("k"), "time"), "parents")
    pairs = some.where(F.size("parents") == 2).select("vault_id", "fold", F.col("parents")[0].alias("a"), F.col("parents")[1].alias("b"))
    bases = saved(dag.merge_bases(pairs.select("vault_id", "a", "b").distinct(), edges).join(pairs, ["vault_id", "a", "b"]).select("vault_id", "fold", F.lit(2).alias("k"), "base"), "bases")
    wanted = tips.select("vault_id", "fold", "oid").unionByName(bases.select("vault_id", "fold", F.col("base").alias("oid"))).distinct()
    near = wanted.join(trees, ["vault_id", "oid"]).select(F.col("fold").alias("vault_id"), "oid", "path", "blob_oid")
    again = fold_tips(tips.select(F.col("fold").alias("vault_id"), "oid", "k", "time"), bases.select(F.col("fold").alias("vault_id"), "k", "base"), near, blobs, protocol)
    due = folds.withColumn("fold", own).join(again.mains.select(F.col("vault_id").alias("fold"), "main_oid", "tips"), "fold", "left")
    n = F.size("parents")
    right = F.when(n == 0, F.col("oid") == genesis_oid(protocol)).otherwise((F.col("tips") == n) & (F.col("main_oid") == F.col("oid")))
    bad = saved(due.where(~F.coalesce(right, F.lit(False))).select("vault_id", "oid"), "bad")
    built = folds.select("vault_id", F.col("oid").alias("dst"), F.explode("parents").alias("src"))
    return dag.reachable(bad, built)


def known_at(commits: DataFrame, when: DataFrame) -> DataFrame:
    """Commits authored up to the time (vault_id, at) asked for."""
    return commits.join(when.select("vault_id", "at"), "vault_id").where("time <= at").drop("at")


def resolved(targets: DataFrame, snapshots: DataFrame) -> DataFrame:
    """targets (vault_id, target) with the snapshot's frontier where one has that name, else the time that the text means (at).
    snapshots: vault_id, name, frontier (array of oids)."""
    from ..functions.columns import when_seconds

    named = snapshots.select("vault_id", F.col("name").alias("target"), "frontier")
    return targets.join(named, ["vault_id", "target"], "left").withColumn("at", F.when(F.col("frontier").isNull(), when_seconds(F.col("target"))))


def known_of_targets(commits: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Commits that each vault's resolved target (frontier, or at) means: all that a snapshot's frontier reaches, or all
    authored up to the time. A target that is neither names nothing."""
    links = edges.select("vault_id", F.col("child").alias("src"), F.col("parent").alias("dst"))
    roots = targets.where("frontier IS NOT NULL").select("vault_id", F.explode("frontier").alias("oid"))
    inside = commits.join(dag.reachable(roots, links), ["vault_id", "oid"], "left_semi")
    return inside.unionByName(known_at(commits, targets.where("frontier IS NULL AND at IS NOT NULL")).select(*inside.columns))
