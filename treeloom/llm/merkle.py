"""A Merkle manifest of documents: a digest over all of them, a proof for each, and versions in which some have changed.

Leaves of each language stand in a binary hash tree in the order of their ids, the roots of the languages in one above them.
Trees are cut into aligned blocks of 2^BLOCK_LEVELS leaves. Going up, a task builds one block and passes on its root, whose place is
the block's number; the blocks of those are the next round. Coming down, each block is built again together with the path
above it. Every changed leaf makes a version of its block's persistent tree: nodes are never overwritten, the version copies the
leaf's ancestors and shares all else, and goes on above the block along that path. Rows above the leaves shrink by the size of
a block in each round; no task holds more than a block and its versions.

A path is an array of steps from the leaf up: `l` or `r` and the digest of the sibling on that side, `-` where a node is alone.

Cases: null fields count as `-`; rows without a language are the first tree; rows without an id come first in theirs and are
never changed by the query; rows with equal ids are ordered by their digests, and equal rows are leaves of their own; an
empty table has an empty manifest; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import placed, saved

BLOCK_LEVELS = 10


def field(value: Column) -> Column:
    """How a leaf holds a field: `-` for null, else its length in bytes, a colon, and its text."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(n_chars: Column | None = None) -> Column:
    """The digest of a row of documents, with another n_chars if one is given."""
    fields = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") if n_chars is None else n_chars, F.col("text")]
    return F.sha2(F.concat(*[field(f) for f in fields]).cast("binary"), 256)


def digest_of(parts: str) -> str:
    return hashlib.sha256(parts.encode("ascii")).hexdigest()


def depth_of(total: int) -> int:
    """How many levels lie above the leaves of a tree."""
    return (total - 1).bit_length()


def step_up(digest: str, step: str) -> str:
    """The parent of a node, whose sibling the step tells."""
    return digest_of(digest if step == "-" else step[1:] + digest if step[0] == "l" else digest + step[1:])


class PersistentTree:
    """A hash tree over some leaves whose versions share nodes: a node is a digest and its one or two children, never changed."""

    def __init__(self, leaves: list[str], levels: int):
        self.digests, self.children, self.levels = list(leaves), [()] * len(leaves), levels
        row = list(range(len(leaves)))
        for _ in range(levels):
            row = [self._node(tuple(row[i : i + 2])) for i in range(0, len(row), 2)]
        (self.root,) = row

    def _node(self, children: tuple[int, ...]) -> int:
        self.digests.append(digest_of("".join(self.digests[c] for c in children)))
        self.children.append(children)
        return len(self.digests) - 1

    def _descent(self, root: int, place: int) -> list[int]:
        nodes = [root]
        for level in range(self.levels - 1, -1, -1):
            nodes.append(self.children[nodes[-1]][place >> level & 1])
        return nodes

    def steps(self, root: int, place: int) -> list[str]:
        """The path of a leaf in a version, from the leaf up to the root."""
        nodes, out = self._descent(root, place), []
        for level in range(self.levels):
            pair, side = self.children[nodes[-2 - level]], place >> level & 1
            out.append("-" if len(pair) == 1 else ("l" if side else "r") + self.digests[pair[1 - side]])
        return out

    def version(self, root: int, place: int, leaf: str) -> list[int]:
        """Nodes made for the version of root that has another leaf at place: the leaf, then its copied ancestors, the new root last."""
        nodes = self._descent(root, place)
        self.digests.append(leaf)
        self.children.append(())
        made = [len(self.digests) - 1]
        for level in range(self.levels):
            pair, side = self.children[nodes[-2 - level]], place >> level & 1
            made.append(self._node(tuple(made[-1] if at == side else c for at, c in enumerate(pair))))
        return made


def _block(rows: pa.Table, level: int, block_levels: int) -> tuple[pa.Table, PersistentTree]:
    """The rows of a block in order, and its tree; at the top of a tree a block has no more levels than the tree."""
    rows = rows.sort_by("place")
    total = rows["total"][0].as_py()
    return rows, PersistentTree(rows["digest"].to_pylist(), min(block_levels, max(0, depth_of(total) - level * block_levels)))


def climb(leaves: DataFrame, block_levels: int = BLOCK_LEVELS) -> tuple[list[DataFrame], DataFrame]:
    """leaves (tree, total, place, digest, ...): the nodes at the foot of every round of blocks, and the roots of the trees."""

    def up_from(level: int) -> Callable[[pa.Table], pa.Table]:
        def up(rows: pa.Table) -> pa.Table:
            rows, tree = _block(rows, level, block_levels)
            place = rows["place"][0].as_py() >> block_levels
            return pa.table({"tree": [rows["tree"][0].as_py()], "total": [rows["total"][0].as_py()], "place": [place], "digest": [tree.digests[tree.root]]})

        return up

    largest = leaves.agg(F.max("total")).first()[0] or 0
    rounds = [leaves]
    while len(rounds) == 1 or largest > 1 << block_levels * (len(rounds) - 1):
        nodes = rounds[-1].select("tree", "total", "place", "digest", F.shiftright("place", block_levels).alias("block"))
        rounds.append(saved(nodes.groupBy("tree", "block").applyInArrow(up_from(len(rounds) - 1), "tree string, total long, place long, digest string"), "blocks"))
    return rounds[:-1], rounds[-1]


def descend(rounds: list[DataFrame], tops: DataFrame, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """rounds of climb() and tops (tree, above: the path over each root) -> tree, place and path of every leaf; where leaves have
    a column `changed`, also key, digest, the root of its tree and the one over all, and, where it is not null, version (the
    digests that this change makes, up to the root)."""
    lists = pa.list_(pa.string())

    def down_to(level: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def down(left: pa.Table, right: pa.Table) -> pa.Table:
            rows, tree = _block(left, level, block_levels)
            over = right["above"][0].as_py()
            paths = [tree.steps(tree.root, i) + over for i in range(len(rows))]
            return pa.table({"tree": rows["tree"], "block": rows["place"], "above": pa.array(paths, lists)})

        return down

    def leaves_of(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, tree = _block(left, 0, block_levels)
        over = right["above"][0].as_py()
        # The unchanged nodes over the block: its own root, then one for each step above.
        chain = [tree.digests[tree.root]]
        for step in over:
            chain.append(step_up(chain[-1], step))
        subroot = chain[depth_of(rows["total"][0].as_py()) - tree.levels]
        versions = []
        for i, leaf in enumerate(rows["changed"].to_pylist()):
            made = None
            if leaf is not None:
                made = [tree.digests[n] for n in tree.version(tree.root, i, leaf)]
                for step in over:
                    made.append(step_up(made[-1], step))
            versions.append(made)
        paths = [tree.steps(tree.root, i) + over for i in range(len(rows))]
        told = {n: rows[n] for n in ("tree", "place", "key", "digest")} | {"subroot": [subroot] * len(rows), "root": [chain[-1]] * len(rows)}
        return pa.table(told | {"path": pa.array(paths, lists), "version": pa.array(versions, lists)})

    above = tops.select("tree", F.lit(0).cast("long").alias("block"), "above")
    for level in range(len(rounds) - 1, -1, -1):
        grouped = rounds[level].withColumn("block", F.shiftright("place", block_levels)).groupBy("tree", "block").cogroup(above.groupBy("tree", "block"))
        if level == 0 and "changed" in rounds[0].columns:
            return grouped.applyInArrow(leaves_of, "tree string, place long, key long, digest string, subroot string, root string, path array<string>, version array<string>")
        above = saved(grouped.applyInArrow(down_to(level), "tree string, block long, above array<string>"), "paths")
    return above.select("tree", F.col("block").alias("place"), F.col("above").alias("path"))


def manifest(docs: DataFrame, changed: Column | None = None, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root and path of every document; changed (a column over docs): the leaf's digest in a version where
    it is another, else null; version: the digests that this version does not share, from its leaf up to its root."""
    tree = F.concat(F.when(F.col("lang").isNull(), "0").otherwise("1"), F.coalesce("lang", F.lit("")))
    leaves = docs.select(F.col("doc_id").cast("long").alias("key"), tree.alias("tree"), leaf_digest().alias("digest"), (F.lit(None).cast("string") if changed is None else changed).alias("changed"))
    # Equal rows may be many: their number parts them, and any order of theirs gives the same leaves.
    leaves = saved(leaves, "leaves").withColumn("__number", F.monotonically_increasing_id())
    leaves = saved(placed(leaves, "tree", [F.col("key").asc_nulls_first(), F.col("digest"), F.col("__number")], []).drop("__number"), "placed")
    rounds, roots = climb(leaves, block_levels)
    subroots = placed(roots.select(F.col("tree").alias("lang_tree"), F.lit("all").alias("tree"), "digest"), "tree", [F.col("lang_tree")], [])
    subroots = saved(subroots, "subroots")
    upper, top = climb(subroots.select("tree", "total", "place", "digest"), block_levels)
    paths = descend(upper, top.select("tree", F.array().cast("array<string>").alias("above")), block_levels)
    tops = subroots.join(paths, ["tree", "place"]).select(F.col("lang_tree").alias("tree"), F.col("path").alias("above"))
    proven = descend(rounds, saved(tops, "tops"), block_levels)
    return proven.select(F.col("key").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", "path", "version")


def siblings(path: Column) -> Column:
    return F.transform(F.filter(path, lambda s: s != "-"), lambda s: F.substring(s, 2, 64))


def tampered() -> Column:
    """Where 7 divides the crc32 of the id, the digest of the row with one more character counted; else null. No id: null."""
    id_text = F.col("doc_id").cast("string").cast("binary")
    return F.when(F.crc32(id_text) % 7 == 0, leaf_digest(F.col("n_chars") + 1))


def proofs(manifested: DataFrame) -> DataFrame:
    """The digest of each proof, the root to which each version folds, and whether it is the manifest's."""
    folded = F.coalesce(F.element_at("version", -1), F.col("root"))
    return manifested.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(siblings(F.col("path")), "").cast("binary"), 256).alias("proof_sha256"), folded.alias("folded_root"), (folded == F.col("root")).alias("verified"))
