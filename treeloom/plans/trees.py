"""Tables of (vault_id, path, blob_oid) against each other: merges, diffs, and plans of what to do."""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import forget, saved
from ..operators.scope import ancestor_dirs, parent_dir

KEY = ["vault_id", "path"]


def side(tree: DataFrame, name: str) -> DataFrame:
    return tree.select(*KEY, F.col("blob_oid").alias(name))


def lined_up(**trees: DataFrame) -> DataFrame:
    """The trees side by side: one row per path that any holds, null where one does not. A union and one aggregation."""
    names = list(trees)
    rows = [t.select(*KEY, *[(F.col("blob_oid") if m == n else F.lit(None).cast("string")).alias(m) for m in names]) for n, t in trees.items()]
    whole = rows[0]
    for more in rows[1:]:
        whole = whole.unionByName(more)
    return whole.groupBy(*KEY).agg(*[F.max(n).alias(n) for n in names])


def merge(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Three-way merge by path, with verdict and blob_oid; verdict `lines` marks files to merge line by line (blob_oid is
    then theirs). A path that the merge drops has a null blob_oid."""
    rows = lined_up(base=base, ours=ours, theirs=theirs)
    o, t, b = F.col("ours"), F.col("theirs"), F.col("base")
    verdict = F.when(o.eqNullSafe(t), "same").when(o.eqNullSafe(b), "theirs").when(t.eqNullSafe(b), "ours").when(o.isNotNull() & t.isNotNull() & b.isNotNull(), "lines").otherwise("theirs")
    return rows.withColumn("verdict", verdict).withColumn("blob_oid", F.when(F.col("verdict") == "ours", o).otherwise(t))


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    rows = lined_up(old=before, new=after)
    status = F.when(F.col("old").isNull(), "A").when(F.col("new").isNull(), "D").otherwise("M")
    return rows.where(~F.col("old").eqNullSafe(F.col("new"))).select(*KEY, status.alias("status"), "old", "new")


def paths_added(parent: DataFrame, child: DataFrame) -> DataFrame:
    return child.join(parent, KEY, "left_anti").select(*KEY)


def paths_toggled(asked: DataFrame, trees: DataFrame) -> DataFrame:
    """asked (vault_id, oid, parent), trees (vault_id, oid, path, blob_oid): (vault_id, oid, path, kind) of the paths that
    only one of a commit and its parent holds."""
    own = asked.select("vault_id", "oid").join(trees, ["vault_id", "oid"]).select("vault_id", "oid", "path", F.lit(1).alias("n"))
    was = asked.select("vault_id", "oid", "parent").join(trees.withColumnRenamed("oid", "parent"), ["vault_id", "parent"]).select("vault_id", "oid", "path", F.lit(-1).alias("n"))
    toggled = own.unionByName(was).groupBy("vault_id", "oid", "path").agg(F.sum("n").alias("n")).where("n <> 0")
    return toggled.select("vault_id", "oid", "path", F.when(F.col("n") > 0, "add").otherwise("delete").alias("kind"))


def materialize(want: DataFrame, disk: DataFrame, last: DataFrame) -> DataFrame:
    """What a folder must do to become `want`, given what lies on disk and what was last written: op, and the state kept."""
    rows = lined_up(want=want, disk=disk, last=last)
    w, d, h = F.col("want"), F.col("disk"), F.col("last")
    op = (
        F.when(w.isNull() & h.isNotNull() & d.eqNullSafe(h), "remove").when(w.isNull(), F.lit(None))
        .when(w.eqNullSafe(d), F.lit(None)).when(d.isNotNull() & ~d.eqNullSafe(h), "defer").otherwise("write"))
    state = F.when(w.isNull(), F.lit(None)).when(op == "defer", h).otherwise(w)
    return rows.select(*KEY, op.alias("op"), F.when(op == "write", w).alias("blob_oid"), state.alias("state"))


def changed(files: DataFrame, last: DataFrame) -> DataFrame:
    """Per vault, whether any file is new, different or gone."""
    rows = lined_up(now=files, then=last)
    return rows.groupBy("vault_id").agg(F.bool_or(~F.col("now").eqNullSafe(F.col("then"))).alias("changed"), F.count_if(~F.col("now").eqNullSafe(F.col("then"))).alias("n_changed"))


def restore(tree: DataFrame, current: DataFrame) -> DataFrame:
    """Write all of the tree, remove what it does not hold."""
    rows = lined_up(tree=tree, current=current)
    return rows.select(*KEY, F.when(F.col("tree").isNull(), "remove").otherwise("write").alias("op"), F.col("tree").alias("blob_oid"))


def reconcile(left: DataFrame, right: DataFrame) -> DataFrame:
    """left (vault_id, path, hash) and right (vault_id, path, hash, deleted): one decision per path."""
    both = left.select(*KEY, F.col("hash").alias("l")).join(right.select(*KEY, F.col("hash").alias("r"), "deleted"), KEY, "full_outer")
    l, r, gone = F.col("l"), F.col("r"), F.coalesce("deleted", F.lit(False))
    step = (
        F.when(r.isNull() & ~gone, "push").when(l.isNull() & gone, "none").when(l.isNull(), "apply")
        .when(gone, "delete").when(l == r, "none").otherwise("push"))
    return both.select(*KEY, step.alias("step"))


def expand_folder(ops: DataFrame, files: DataFrame) -> DataFrame:
    """Folder operations (vault_id, op, from_dir, to_dir) as one row per file beneath: an equi-join on the files' folders."""
    beneath = files.select(*KEY, F.explode(F.concat(ancestor_dirs(F.col("path")), F.array("path"))).alias("from_dir"))
    hit = beneath.join(ops, ["vault_id", "from_dir"])
    target = F.when(F.col("op") == "rename", F.concat("to_dir", F.expr("substring(path, length(from_dir) + 1)")))
    return hit.select("vault_id", "op", "path", target.alias("to_path"))


def rename_verdict(from_ok: Column, to_ok: Column, source_there: Column) -> Column:
    return F.when(to_ok & ~source_there, "write").when(from_ok & to_ok, "rename").when(from_ok, "delete").when(to_ok, "create").otherwise("none")


def emptied_dirs(removed: DataFrame, left: DataFrame) -> DataFrame:
    """Folders above removed files with nothing left beneath them: one set difference, no climbing."""
    above = removed.select("vault_id", F.explode(ancestor_dirs(F.col("path"))).alias("dir")).distinct()
    alive = left.select("vault_id", F.explode(ancestor_dirs(F.col("path"))).alias("dir")).distinct()
    return above.join(alive, ["vault_id", "dir"], "left_anti")


def folders_to_make(files: DataFrame, there: DataFrame) -> DataFrame:
    """(vault_id, dir, depth) of missing folders; shallow ones come first in order of depth."""
    need = files.select("vault_id", F.explode(ancestor_dirs(F.col("path"))).alias("dir")).distinct()
    return need.join(there, ["vault_id", "dir"], "left_anti").withColumn("depth", F.size(F.split("dir", "/")))


#: The id of a tree without entries.
EMPTY_TREE = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"


def tree_objects(tree: DataFrame, by: tuple[str, ...] = ("vault_id",)) -> DataFrame:
    """(*by, dir, tree_oid, payload) of the nested trees of flat (*by, path, blob_oid), bottom up: each level's folders are
    hashed over their sorted entries, and become entries of the level above. The loop runs over the depth of the deepest path;
    every level is written once and read once by the level above."""
    by = list(by)
    depth_of = lambda d: F.when(d == "", 0).otherwise(F.size(F.split(d, "/")))
    entries = tree.select(*by, parent_dir(F.col("path")).alias("dir"), F.substring_index("path", "/", -1).alias("name"), F.lit("100644").alias("mode"), "blob_oid")
    entries = saved(entries.withColumn("depth", depth_of(F.col("dir"))), "entries")
    deepest = entries.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    levels, below = None, None
    for level in range(deepest, -1, -1):
        here = entries.where(F.col("depth") == level).drop("depth")
        if below is not None:
            here = here.unionByName(below.select(*by, parent_dir(F.col("dir")).alias("dir"), F.substring_index("dir", "/", -1).alias("name"), F.lit("40000").alias("mode"), F.col("tree_oid").alias("blob_oid")))
        key = F.concat(F.col("name"), F.when(F.col("mode") == "40000", F.lit("/")).otherwise(F.lit(""))).cast("binary")
        piece = F.concat(F.hex(F.concat("mode", F.lit(" "), "name").cast("binary")), F.lit("00"), F.col("blob_oid"))
        listed = here.groupBy(*by, "dir").agg(F.array_sort(F.collect_list(F.struct(key.alias("key"), piece.alias("piece")))).alias("all"))
        payload = listed.select(*by, "dir", F.unhex(F.array_join(F.transform("all", lambda x: x["piece"]), "")).alias("payload"))
        framed = F.concat(F.concat(F.lit("tree "), F.octet_length("payload").cast("string")).cast("binary"), F.lit(bytes(1)), "payload")
        below = saved(payload.select(*by, "dir", F.sha1(framed).alias("tree_oid"), "payload"), "level")
        levels = below if levels is None else levels.unionByName(below)
    return levels


def flat_tree_oids(tree: DataFrame, by: tuple[str, ...] = ("vault_id",)) -> DataFrame:
    """(*by, tree_oid): the ids of the root trees."""
    return tree_objects(tree, by).where("dir = ''").select(*by, "tree_oid")


def step_tree_oids(changes: DataFrame) -> DataFrame:
    """changes (vault_id, k, path, blob_oid; null where the path goes): what each of a vault's steps changes -> (vault_id, dir, k,
    tree_oid) of every folder after every step that changes something below it, null where nothing is left in it.

    Folders are hashed from the deepest level up, each only at the steps that touch it: its changes stream by in order of
    steps over the entries that stand, and an id that comes out is a change of the folder above. So rows grow with the changes,
    not with steps times files; a task holds one folder's entries."""
    depth_of = lambda d: F.when(d == "", 0).otherwise(F.size(F.split(d, "/")))
    entries = changes.select("vault_id", parent_dir(F.col("path")).alias("dir"), F.col("k").cast("int").alias("k"), F.substring_index("path", "/", -1).alias("name"), F.lit("100644").alias("mode"), F.col("blob_oid").alias("oid"))
    entries = saved(entries.withColumn("depth", depth_of(F.col("dir"))), "entries")
    deepest = entries.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    schema = pa.schema([("vault_id", pa.string()), ("dir", pa.string()), ("k", pa.int32()), ("tree_oid", pa.string())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, step, was, order, held = None, None, None, [], {}

        def told() -> list[tuple]:
            body = b"".join(held[n] for n in order)
            now = hashlib.sha1(b"tree %d\x00" % len(body) + body).hexdigest() if held else None
            return [] if now == was else [(*at, step, now)]

        for batch in batches:
            out = []
            for vault, folder, k, name, mode, oid in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (vault, folder) or step != k:
                    if at is not None:
                        done = told()
                        out += done
                        was = done[0][3] if done else was
                    if at != (vault, folder):
                        at, was, order, held = (vault, folder), None, [], {}
                    step = k
                key = name.encode() + (b"/" if mode == "40000" else b"")
                if oid is None:
                    if held.pop(key, None) is not None:
                        del order[bisect.bisect_left(order, key)]
                else:
                    if key not in held:
                        bisect.insort(order, key)
                    held[key] = f"{mode} {name}".encode() + b"\x00" + bytes.fromhex(oid)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        if at is not None and (done := told()):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

    levels, below = None, None
    for level in range(deepest, -1, -1):
        here = entries.where(F.col("depth") == level).drop("depth")
        if below is not None:
            here = here.unionByName(below.select("vault_id", parent_dir(F.col("dir")).alias("dir"), "k", F.substring_index("dir", "/", -1).alias("name"), F.lit("40000").alias("mode"), F.col("tree_oid").alias("oid")))
        ordered = here.repartition("vault_id", "dir").sortWithinPartitions("vault_id", "dir", "k").select("vault_id", "dir", "k", "name", "mode", "oid")
        below = saved(ordered.mapInArrow(hashed, "vault_id string, dir string, k int, tree_oid string"), "level")
        levels = below if levels is None else levels.unionByName(below)
    forget(entries)
    return levels
