"""The prefix trie of conversations: which share which first turns, and what sharing them saves.

A turn is the digest of its role and text, a sequence of turns two polynomial hashes modulo 2^61 - 1 (122 bits), which the first d
turns of a conversation give for every d. Conversations are dealt by ranges of their ids, long ones in segments of SEGMENT turns that
go on from the hash of what comes before them, so a task holds neither a whole long conversation nor a popular prefix. Each task
puts its segments into z-fast tries, in batches, and gives up a trie as rows (its edges expanded to one node a turn) when it is
full; equal nodes of all tries are then added up by depth and hash. Sums over subtrees need no walk: every node belongs
to its smallest member, a member's nodes are the last ones of its path, so the sum below a node is its owner's from
there on plus all that the node's other members own; these come from a second pass of the same tries with weights.

Cases: rows are ordered by turn (null first), then role and text; null roles and texts count as empty; rows without a conv_id belong to
no conversation and are left out; repeated rows are turns of their own; for negative ids the remainder is not negative; an
empty table has no trie; further columns are not read. A digest over a node's end members streams their ids through one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import placed, saved

SEGMENT = 512
BATCH = 512
#: A task gives up its trie when it holds so many turns.
FULL = 200_000
HEADS, GROUP = 9, 5
PRIME = (1 << 61) - 1
#: Bases of the two hashes: any numbers below PRIME do.
BASES = (0x1A2B3C4D5E6F708, 0x0F1E2D3C4B5A697)


def two_fattest(low: int, high: int) -> int:
    """The number in (low, high] that the highest power of two divides."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class Key:
    """A segment: hashes of the first start, start + 1, ..., end turns, bytes of its turns' texts, and what it adds to its nodes."""

    __slots__ = ("start", "end", "hashes", "sizes", "least", "count", "weights")

    def __init__(self, start: int, hashes: list[int], sizes: list[int], least: int, weights: tuple[int, int] = (0, 0)):
        self.start, self.end, self.hashes, self.sizes = start, start + len(sizes), hashes, sizes
        self.least, self.count, self.weights = least, 1, weights

    def at(self, depth: int) -> int:
        return self.hashes[depth - self.start]


class Edge:
    """A compacted node: the depths (low, high] of key, the nodes above and (by the hash of their first turn) below it, and what
    ends at it."""

    __slots__ = ("low", "high", "key", "above", "below", "count", "least", "weights")

    def __init__(self, above: Edge | None, low: int, high: int, key: Key):
        self.low, self.high, self.key, self.above, self.below = low, high, key, above, {}
        self.count, self.least, self.weights = 0, None, (0, 0)

    def add(self, count: int, least: int | None, weights: tuple[int, int]) -> None:
        self.count += count
        self.least = least if self.least is None else self.least if least is None else min(self.least, least)
        self.weights = (self.weights[0] + weights[0], self.weights[1] + weights[1])


class ZFastTrie:
    """Compacted tries whose nodes are found by the hash of their handle, the prefix at the two-fattest depth of their edge."""

    def __init__(self) -> None:
        self.roots: dict[tuple[int, int], Edge] = {}
        self.handles: dict[tuple[int, int], Edge] = {}
        self.turns = 0

    def _handle(self, edge: Edge) -> tuple[int, int]:
        depth = two_fattest(edge.low, edge.high)
        return depth, edge.key.at(depth)

    def exit_of(self, key: Key) -> tuple[Edge, Edge | None]:
        """The deepest node all of which begins key, and the node below in whose edge key leaves the trie (None: no such edge, or key
        ends at the first). A fat binary search over depths: each probe halves what is left, whatever the trie's height."""
        node = self.roots.get((key.start, key.at(key.start)))
        if node is None:
            node = self.roots[key.start, key.at(key.start)] = Edge(None, key.start, key.start, key)
        low, high = key.start, key.end
        while low < high:
            depth = two_fattest(low, high)
            found = self.handles.get((depth, key.at(depth)))
            if found is None:
                high = depth - 1
            elif found.high <= key.end and found.key.at(found.high) == key.at(found.high):
                node, low = found, found.high
            else:
                return found.above, found
        return node, node.below.get(key.at(node.high + 1)) if node.high < key.end else None

    def insert(self, keys: list[Key]) -> None:
        """Equal keys are one; exits of the whole batch are found first, then each key is put in below its own, where keys before it
        may have split the edge by now."""
        once: dict[tuple[int, int, int], Key] = {}
        for key in keys:
            same = once.setdefault((key.start, key.end, key.at(key.end)), key)
            if same is not key:
                same.count += key.count
                same.least = min(same.least, key.least)
                same.weights = (same.weights[0] + key.weights[0], same.weights[1] + key.weights[1])
        exits = [(key, *self.exit_of(key)) for key in once.values()]
        for key, node, _ in exits:
            self._put(key, node)

    def _put(self, key: Key, node: Edge) -> None:
        while node.high < key.end:
            below = node.below.get(key.at(node.high + 1))
            if below is None:
                below = node.below[key.at(node.high + 1)] = Edge(node, node.high, key.end, key)
                self.handles[self._handle(below)] = below
                self.turns += key.end - key.start
            shared = self._shared(key, below)
            if shared < below.high:
                below = self._split(node, below, shared)
            node = below
        node.add(key.count, key.least, key.weights)

    def _shared(self, key: Key, edge: Edge) -> int:
        """How deep key follows an edge whose first turn it has."""
        good, bad = edge.low + 1, min(edge.high, key.end) + 1
        while bad - good > 1:
            depth = (good + bad) // 2
            good, bad = (depth, bad) if edge.key.at(depth) == key.at(depth) else (good, depth)
        return good

    def _split(self, above: Edge, edge: Edge, depth: int) -> Edge:
        upper = Edge(above, edge.low, depth, edge.key)
        del self.handles[self._handle(edge)]
        edge.low, edge.above = depth, upper
        above.below[edge.key.at(upper.low + 1)] = upper
        upper.below[edge.key.at(depth + 1)] = edge
        for e in (upper, edge):
            self.handles[self._handle(e)] = e
        return upper

    def nodes(self) -> Iterator[tuple]:
        """(depth, hash, hash of the parent, bytes of the last text, count, least, weights) of every node below the roots: members of
        its subtree counted, edges expanded."""
        for root in self.roots.values():
            order = [root]
            for edge in order:
                order.extend(edge.below.values())
            for edge in reversed(order):
                for b in edge.below.values():
                    edge.add(b.count, b.least, b.weights)
            for edge in order:
                for depth in range(edge.low + 1, edge.high + 1):
                    yield depth, edge.key.at(depth), edge.key.at(depth - 1), edge.key.sizes[depth - edge.key.start - 1], edge.count, edge.least, *edge.weights


# ---- conversations as rows -------------------------------------------------------------------------------------------


def sequences(convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations (the first h turns of the first one of their group of five, then their own after their first h): turns
    (conv_id, i, t1, t2, size, length) and conversations (conv_id, length)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    named = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    number = lambda at: F.conv(F.substring(named, at, 15), 16, 10).cast("long")
    rows = convs.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"), number(1).alias("t1"), number(16).alias("t2"), F.octet_length(text).cast("long").alias("size"))
    ordered = saved(placed(rows, "conv_id", [F.col("turn").asc_nulls_first()], [F.col("role"), F.col("text")], drop=("turn", "role", "text")), "turns")
    first = F.col("conv_id") - F.pmod("conv_id", F.lit(GROUP))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).alias("h")
    own = ordered.where("place = 0").select("conv_id", h, first.alias("base"), F.col("total").alias("n"))
    bases = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    head = F.least("h", F.coalesce("base_n", F.lit(0)))
    known = own.join(bases, "base", "left").select("conv_id", "base", "h", head.alias("head"), (head + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    known = saved(known, "conversations")
    lent = ordered.where((F.col("place") < HEADS - 1) & (F.pmod("conv_id", F.lit(GROUP)) == 0)).select(F.col("conv_id").alias("base"), F.col("place").alias("i"), "t1", "t2", "size")
    turns = lent.join(known, "base").where("i < h").select("conv_id", "i", "t1", "t2", "size", "length")
    after = ordered.join(known, "conv_id").where("place >= h").select("conv_id", (F.col("head") + F.col("place") - F.col("h")).alias("i"), "t1", "t2", "size", "length")
    return saved(turns.unionByName(after), "rebuilt"), known.select("conv_id", "length")


#: What rows of a segment are: its weights, the hash of what comes before it, or (from 0) turns.
_WEIGHTS, _BEFORE = -2, -1
_PART = ("conv_id", "seg", "i", "t1", "t2", "size", "length")


def _segment(i: Column, segment: int) -> Column:
    return F.floor(i / segment).cast("long")


def _befores(turns: DataFrame, convs: DataFrame, segment: int) -> DataFrame:
    """For later segments of long conversations the hash of all turns before them, as rows of kind _BEFORE."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, i, *ts = (batch.column(k).to_pylist() for k in range(4))
            terms = [[(t + 1) * pow(base, at, PRIME) % PRIME for at, t in zip(i, column)] for base, column in zip(BASES, ts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([at // segment for at in i], pa.int64()), *(pa.array(t, pa.int64()) for t in terms)], names=["conv_id", "seg", "t1", "t2"])

    long_ones = turns.where(F.col("length") > segment).select("conv_id", "i", "t1", "t2")
    per = long_ones.mapInArrow(sums, "conv_id long, seg long, t1 long, t2 long").groupBy("conv_id", "seg").agg(*[(F.sum(F.col(t).cast("decimal(38,0)")) % PRIME).cast("decimal(38,0)").alias(t) for t in ("t1", "t2")])
    earlier = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    summed = per.select("conv_id", "seg", *[(F.sum(t).over(earlier) % PRIME).cast("long").alias(t) for t in ("t1", "t2")])
    return summed.where("seg > 0").select("conv_id", "seg", F.lit(_BEFORE).cast("long").alias("i"), "t1", "t2", F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("length"))


_NODE = [("ends", pa.bool_()), ("depth", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("q1", pa.int64()), ("q2", pa.int64()), ("size", pa.int64()), ("n", pa.int64()), ("least", pa.int64()), ("w1", pa.int64()), ("w2", pa.int64())]
_NODE_SCHEMA = "ends boolean, depth long, p1 long, p2 long, q1 long, q2 long, size long, n long, least long, w1 long, w2 long"


def _through_tries(rows: DataFrame, weighted: bool, segment: int, batch_size: int, full: int) -> DataFrame:
    """Segments (rows of _PART) through their tasks' tries: nodes, each as often as tries hold it, and (ends) where conversations end.
    weighted: only segments with weights are put in."""
    low = PRIME  # 61 ones: a hash is p1 << 61 | p2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, keys, ended = ZFastTrie(), [], []
        at, weights, powers, hashes, sizes, final = None, None, (1, 1), [0], [], 0

        def close() -> None:
            nonlocal keys
            if at is None or not sizes or weighted and weights is None:
                return
            start = at[1] * segment
            keys.append(Key(start, hashes, sizes, at[0], weights or (0, 0)))
            if start + len(sizes) == final:
                ended.append((final, hashes[-1], at[0]))
            if len(keys) >= batch_size:
                trie.insert(keys)
                keys = []

        def table(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*found), _NODE)], names=[n for n, _ in _NODE])

        def given_up() -> Iterator[pa.RecordBatch]:
            trie.insert(keys)
            keys.clear()
            out = []
            for depth, p, q, size, n, least, w1, w2 in trie.nodes():
                out.append((False, depth, p >> 61, p & low, q >> 61, q & low, size, n, least, w1, w2))
                if len(out) == 20_000:
                    yield table(out)
                    out = []
            out += [(True, depth, p >> 61, p & low, 0, 0, 0, 1, conv, 0, 0) for depth, p, conv in ended]
            ended.clear()
            if out:
                yield table(out)

        for batch in batches:
            for conv, seg, i, t1, t2, size, length in zip(*(batch.column(k).to_pylist() for k in range(len(_PART)))):
                if (conv, seg) != at:
                    close()
                    if trie.turns + len(keys) > full:
                        yield from given_up()
                        trie = ZFastTrie()
                    at, weights, hashes, sizes = (conv, seg), None, [0], []
                    powers = tuple(pow(base, seg * segment, PRIME) for base in BASES) if seg else (1, 1)
                if i == _WEIGHTS:
                    weights = (t1, t2)
                elif i == _BEFORE:
                    hashes = [t1 << 61 | t2]
                else:
                    p = hashes[-1]
                    hashes.append((p >> 61) + (t1 + 1) * powers[0] % PRIME)
                    hashes[-1] = hashes[-1] % PRIME << 61 | ((p & low) + (t2 + 1) * powers[1]) % PRIME
                    powers = (powers[0] * BASES[0] % PRIME, powers[1] * BASES[1] % PRIME)
                    sizes.append(size)
                    final = length
        close()
        yield from given_up()

    return rows.repartitionByRange("conv_id", "seg").sortWithinPartitions("conv_id", "seg", "i").select(*_PART).mapInArrow(run, _NODE_SCHEMA)


def _ends_digests(ends: DataFrame) -> DataFrame:
    """ends (depth, p1, p2, conv) -> ends_sha256 of every node at which conversations end: their ids stream by in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("depth", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("ends_sha256", pa.string())])
        at, digest = None, None
        for batch in batches:
            done = []
            for *node, conv in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if node != at:
                    if at is not None:
                        done.append((*at, digest.hexdigest()))
                    at, digest = node, hashlib.sha256(str(conv).encode())
                else:
                    digest.update(f",{conv}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((*at, digest.hexdigest()), schema)], schema=schema)

    ordered = ends.repartition("depth", "p1", "p2").sortWithinPartitions("depth", "p1", "p2", "conv").select("depth", "p1", "p2", "conv")
    return ordered.mapInArrow(run, "depth long, p1 long, p2 long, ends_sha256 string")


def trie(convs: DataFrame, segment: int = SEGMENT, batch_size: int = BATCH, full: int = FULL) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    node = ["depth", "p1", "p2"]
    zero = F.lit(0).cast("long")
    turns, known = sequences(convs)
    rows = saved(turns.withColumn("seg", _segment(F.col("i"), segment)).select(*_PART).unionByName(_befores(turns, known, segment).select(*_PART)), "segments")
    parts = saved(_through_tries(rows, False, segment, batch_size, full), "parts")
    below = parts.where("NOT ends").groupBy(*node).agg(*[F.min(c).alias(c) for c in ("q1", "q2", "size", "least")], F.sum("n").alias("n"))
    root = known.agg(F.min("conv_id").alias("least"), F.count("*").alias("n")).where("n > 0")
    root = root.select(*[zero.alias(c) for c in node], *[zero.alias(c) for c in ("q1", "q2", "size")], "least", "n")
    nodes = saved(below.unionByName(root), "nodes")

    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
    valued = nodes.join(children, node, "left").withColumns({
        "n_children": F.coalesce("n_children", zero), "leaf": F.col("n_children").isNull().cast("long"),
        "value": (F.col("n") - 1) * F.col("size"), "seg": _segment(F.greatest(F.col("depth") - 1, zero), segment)})
    valued = saved(valued, "valued")
    # A member's nodes from each of its segments on, and all of them.
    per = valued.groupBy("least", "seg").agg(F.sum("value").alias("v"), F.sum("leaf").alias("l"))
    later = Window.partitionBy("least").orderBy(F.desc("seg")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("least")
    owned = per.select("least", "seg", *[F.coalesce(F.sum(c).over(later), zero).alias(f"later_{c}") for c in "vl"], *[F.sum(c).over(whole).alias(f"all_{c}") for c in "vl"])
    owned = saved(owned, "owned")
    weights = owned.where("seg >= 0 AND (all_v > 0 OR all_l > 0)").groupBy("least").agg(F.max("all_v").alias("t1"), F.max("all_l").alias("t2")).withColumnRenamed("least", "conv_id")
    weights = weights.join(known.where("length > 0"), "conv_id").select("conv_id", F.explode(F.sequence(zero, _segment(F.col("length") - 1, segment))).alias("seg"), F.lit(_WEIGHTS).cast("long").alias("i"), "t1", "t2", zero.alias("size"), "length")
    passed = _through_tries(rows.unionByName(weights.select(*_PART)), True, segment, batch_size, full)
    members = passed.where("NOT ends").groupBy(*node).agg(F.sum("w1").alias("w1"), F.sum("w2").alias("w2"))
    everyone = owned.groupBy("least").agg(F.max("all_v").alias("w1"), F.max("all_l").alias("w2")).agg(F.sum("w1").alias("w1"), F.sum("w2").alias("w2")).where("w1 IS NOT NULL")
    members = saved(members.unionByName(everyone.select(*[zero.alias(c) for c in node], "w1", "w2")), "members")

    ends = parts.where("ends").select(*node, F.col("least").alias("conv")).unionByName(known.where("length = 0").select(*[zero.alias(c) for c in node], F.col("conv_id").alias("conv")))
    digests = saved(_ends_digests(ends), "digests")
    onward = Window.partitionBy("least", "seg").orderBy(F.desc("depth"))
    summed = valued.select("*", F.sum("value").over(onward).alias("on_v"), F.sum("leaf").over(onward).alias("on_l")).join(owned, ["least", "seg"])
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("least").alias("parent_conv_id"))
    summed = saved(summed, "summed")
    found = summed.join(members, node, "left").join(digests, node, "left").join(parents, ["depth", "q1", "q2"], "left")
    below_it = lambda c, w: (F.col(f"on_{c}") + F.col(f"later_{c}") + F.coalesce(F.col(w), zero) - F.col(f"all_{c}"))
    return found.select(
        F.col("least").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", below_it("l", "w2").alias("n_leaves"), below_it("v", "w1").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
