"""Operators over commit DAGs of many vaults at once: closure, frontier, merge bases, reachability.

Edges are (vault_id, child, parent). A vault of few rows is walked within one task (see vaults), all of them by one shuffle; vaults of
many rows meet in no task: loops write each round to the shared folder and stop when nothing is new, with vault_id as part of every
key. The closure is quadratic in a history's depth, so only the operator of that name builds it; all others walk from the commits that
they are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField

from ..functions.tables import forget, saved, saved_counted
from .vaults import Past, each_vault, linked, only


LONGEST_HOP = 8


def _all(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.unionByName(more)
    return whole


def closure(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(vault_id, descendant, ancestor). Each round joins only the pairs that the last one found with all pairs so far, so paths
    double in length and no pair is written twice."""
    parts = [saved(edges.select("vault_id", F.col("child").alias("descendant"), F.col("parent").alias("ancestor")).distinct(), "closure")]
    for _ in range(most_rounds):
        known = _all(parts)
        onward = known.select("vault_id", F.col("descendant").alias("ancestor"), F.col("ancestor").alias("further"))
        longer = parts[-1].join(onward, ["vault_id", "ancestor"]).select("vault_id", "descendant", F.col("further").alias("ancestor")).distinct()
        new, found = saved_counted(longer.join(known, ["vault_id", "descendant", "ancestor"], "left_anti"), "closure")
        if not found:
            return known
        parts.append(new)
    raise RuntimeError("the edges have a path longer than 2 to the number of rounds")


def extend_closure(known: DataFrame, new_edges: DataFrame) -> DataFrame:
    """Pairs that commits new to a stored closure add, if their parents are all stored: one join, no loop."""
    direct = new_edges.select("vault_id", F.col("child").alias("descendant"), F.col("parent").alias("ancestor"))
    onward = known.select("vault_id", F.col("descendant").alias("ancestor"), F.col("ancestor").alias("further"))
    return direct.unionByName(direct.join(onward, ["vault_id", "ancestor"]).select("vault_id", "descendant", F.col("further").alias("ancestor"))).distinct()


def inclusive(commits: DataFrame, clo: DataFrame) -> DataFrame:
    """The closure with each commit as its own ancestor."""
    return clo.unionByName(commits.select("vault_id", F.col("oid").alias("descendant"), F.col("oid").alias("ancestor")))


def dominated(commits: DataFrame, edges: DataFrame, most_rounds: int = 100_000, ends: DataFrame | None = None) -> DataFrame:
    """(vault_id, oid) of all ancestors of commits. A parent that is itself among the commits is not followed any further, since
    its own parents are there from the start; where histories are whole this is one shuffle, and only stretches of commits
    that are left out are walked. ends: the commits that are not followed, if more than these."""
    up = edges.select("vault_id", F.col("child").alias("oid"), "parent")
    own = saved((commits if ends is None else ends).select("vault_id", "oid"), "own")
    begin = own if ends is None else commits
    parts = [saved(up.join(begin.select("vault_id", "oid"), ["vault_id", "oid"], "left_semi").select("vault_id", F.col("parent").alias("oid")).distinct(), "dominated")]
    for _ in range(most_rounds):
        front, left = saved_counted(parts[-1].join(own, ["vault_id", "oid"], "left_anti"), "front")
        if not left:
            return _all(parts)
        above = front.join(up, ["vault_id", "oid"]).select("vault_id", F.col("parent").alias("oid")).distinct()
        parts.append(saved(above.join(_all(parts), ["vault_id", "oid"], "left_anti"), "dominated"))
    raise RuntimeError("too many rounds")


def frontier(commits: DataFrame, edges: DataFrame) -> DataFrame:
    """Commits that are no ancestor of another of these commits."""

    def run(links: list[tuple], own: list[tuple]) -> Iterator[tuple]:
        up = linked(links)
        below: set[str] = set()
        todo = [p for (oid,) in own for p in up.get(oid, ())]
        while todo:
            if (at := todo.pop()) not in below:
                below.add(at)
                todo += up.get(at, ())
        yield from ((oid,) for oid in {oid for (oid,) in own} - below)

    asked = commits.select("vault_id", "oid")
    tops, large = each_vault([edges.select("vault_id", "child", "parent"), asked], run, [asked.schema["oid"]], "frontier")
    if large is not None:
        mine, links = only(large, asked, edges)
        tops = tops.unionByName(mine.join(dominated(mine, links), ["vault_id", "oid"], "left_anti"))
    return commits.join(tops, ["vault_id", "oid"], "left_semi")


def ranked(commits: DataFrame, name: str = "rank") -> DataFrame:
    """The strict total order (counter, node, oid) of each vault, from 1."""
    order = Window.partitionBy("vault_id").orderBy("counter", "node_id", "oid")
    return commits.withColumn(name, F.row_number().over(order))


def maximal(common: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """Of each set of common ancestors (vault_id, *by, oid) the members that are no ancestor of another. Such a set holds all
    ancestors of its members, so it is enough to look for a child within it."""
    children = edges.select("vault_id", F.col("parent").alias("oid"), "child").join(common, ["vault_id", "oid"])
    covered = children.join(common.select("vault_id", *by, F.col("oid").alias("child")), ["vault_id", *by, "child"], "left_semi")
    return common.join(covered.select("vault_id", *by, "oid").distinct(), ["vault_id", *by, "oid"], "left_anti")


def _bases(pairs: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """pairs (vault_id, *by, a, b) -> (vault_id, *by, n, base) of those that have common ancestors, the two included: how many of them are
    maximal, and the least of these."""

    def run(links: list[tuple], asked: list[tuple]) -> Iterator[tuple]:
        past = Past(links)
        for *label, a, b in asked:
            if best := past.maximal(past.of(a) & past.of(b)):
                yield (*label, len(best), min(best))

    asked = pairs.select("vault_id", *by, F.col("a").alias("__a"), F.col("b").alias("__b")).distinct()
    fields = [*(asked.schema[c] for c in by), StructField("n", LongType()), StructField("base", StringType())]
    found, large = each_vault([edges.select("vault_id", "child", "parent"), asked], run, fields, "bases")
    if large is None:
        return found
    asked, links = only(large, asked, edges)
    sides = asked.select("vault_id", *by, F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("__a").alias("oid")), F.struct(F.lit(2).alias("side"), F.col("__b").alias("oid")))).alias("s"))
    seen = _walked(sides.select("vault_id", *by, "s.side", "s.oid"), links.select("vault_id", F.col("child").alias("src"), F.col("parent").alias("dst")), [*by, "side"])
    common = saved(seen.groupBy("vault_id", *by, "oid").agg(F.count("*").alias("n")).where("n = 2").drop("n"), "common")
    return found.unionByName(maximal(common, links, by).groupBy("vault_id", *by).agg(F.count("*").alias("n"), F.min("oid").alias("base")))


def merge_bases(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """pairs (vault_id, a, b) -> with base: the least oid among the maximal common ancestors, the two included."""
    return pairs.join(_bases(pairs, edges, ["a", "b"]).drop("n"), ["vault_id", "a", "b"], "left")


def maximal_bases(pairs: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """pairs (vault_id, *by, a, b) -> (vault_id, *by, n, base): how many maximal common ancestors they have, and the least of them; pairs
    without one are left out."""
    return _bases(pairs, edges, by)


def fold_bases(tips: DataFrame, edges: DataFrame) -> DataFrame:
    """tips (vault_id, oid, k): the merge base of each step k > 1, whose left side holds all that tips before k reach.

    Known up front for all steps, since a step's left side never is an ancestor of a later tip.
    """

    def run(links: list[tuple], own: list[tuple]) -> Iterator[tuple]:
        past, before = Past(links), 0
        steps: dict[int, int] = {}
        for k, oid in own:
            steps[k] = steps.get(k, 0) | past.of(oid)
        for k in sorted(steps):
            if best := past.maximal(steps[k] & before):
                yield k, min(best)
            before |= steps[k]

    asked = tips.select("vault_id", "k", "oid")
    best, large = each_vault([edges.select("vault_id", "child", "parent"), asked], run, [asked.schema["k"], StructField("base", StringType())], "fold_bases")
    if large is not None:
        mine, links = only(large, asked, edges)
        seen = _walked(mine, links.select("vault_id", F.col("child").alias("src"), F.col("parent").alias("dst")), ["k"])
        first = seen.groupBy("vault_id", "oid").agg(F.min("k").alias("first"))
        common = saved(seen.join(first, ["vault_id", "oid"]).where("first < k").select("vault_id", "k", "oid"), "common")
        best = best.unionByName(maximal(common, links, ["k"]).groupBy("vault_id", "k").agg(F.min("oid").alias("base")))
    return tips.where("k > 1").join(best, ["vault_id", "k"], "left")


def agreeing(last: DataFrame, edges: DataFrame) -> DataFrame:
    """last (vault_id, node_id, oid): each node's latest commit -> (vault_id, nodes, converged): how many, and whether all reach the same."""

    def run(links: list[tuple], own: list[tuple]) -> Iterator[tuple]:
        past = Past(links)
        known: dict[str, int] = {}
        for node, oid in own:
            known[node] = known.get(node, 0) | past.of(oid)
        yield len(known), len(set(known.values())) == 1

    asked = last.select("vault_id", "node_id", "oid")
    told, large = each_vault([edges.select("vault_id", "child", "parent"), asked], run, [StructField("nodes", LongType()), StructField("converged", BooleanType())], "agreeing")
    told = told.where("nodes > 0")
    if large is None:
        return told
    mine, links = only(large, asked, edges)
    seen = _walked(mine, links.select("vault_id", F.col("child").alias("src"), F.col("parent").alias("dst")), ["node_id"])
    # A set is told by its size and an order-free sum of hashes.
    known = seen.groupBy("vault_id", "node_id").agg(F.count("*").alias("n"), F.sum(F.xxhash64("oid").cast("decimal(38,0)")).alias("h"))
    return told.unionByName(known.groupBy("vault_id").agg(F.count("*").alias("nodes"), (F.countDistinct("n", "h") == 1).alias("converged")))


def reachable(roots: DataFrame, links: DataFrame, by: list[str] | None = None, most_rounds: int = 100_000) -> DataFrame:
    """(vault_id, *by, oid) that roots reach over links (vault_id, src, dst), roots included; each label in `by` walks on its own."""

    def run(pairs: list[tuple], begin: list[tuple]) -> Iterator[tuple]:
        onward = linked(pairs)
        labels: dict[tuple, list[str]] = {}
        for *label, oid in begin:
            labels.setdefault(tuple(label), []).append(oid)
        for label, todo in labels.items():
            seen = set(todo)
            while todo:
                new = [oid for oid in onward.get(todo.pop(), ()) if oid not in seen]
                seen.update(new)
                todo += new
            yield from ((*label, oid) for oid in seen)

    begin = roots.select("vault_id", *(by or []), "oid").distinct()
    pairs = links.select("vault_id", "src", "dst")
    seen, large = each_vault([pairs, begin], run, begin.schema.fields[1:], "seen")
    if large is None:
        return seen
    begin, pairs = only(large, begin, pairs)
    return seen.unionByName(_walked(begin, pairs, by, most_rounds))


def _walked(roots: DataFrame, links: DataFrame, by: list[str] | None = None, most_rounds: int = 100_000) -> DataFrame:
    """reachable() where no task holds a vault. A round follows only what the last one found, and no row is written twice. Where the walk
    goes on, rounds take two, four, and then LONGEST_HOP links at once, so that a deep history needs fewer of them."""
    key = ["vault_id", *(by or []), "oid"]
    onward, hop = links.select("vault_id", F.col("src").alias("oid"), "dst"), 1
    parts = [saved(roots.select(*key).distinct(), "seen")]
    for _ in range(most_rounds):
        step = parts[-1].join(onward, ["vault_id", "oid"]).select("vault_id", *(by or []), F.col("dst").alias("oid")).distinct()
        new, found = saved_counted(step.join(_all(parts), key, "left_anti"), "seen")
        if not found:
            return _all(parts)
        parts.append(new)
        if hop < LONGEST_HOP:
            further = onward.join(onward.select("vault_id", F.col("oid").alias("dst"), F.col("dst").alias("__next")), ["vault_id", "dst"]).select("vault_id", "oid", F.col("__next").alias("dst"))
            longer = saved(onward.unionByName(further).distinct(), "hops")
            forget(onward)
            onward, hop = longer, hop * 2
        if len(parts) == 32:  # keeps plans short in deep histories; the rows are rewritten once in 32 rounds
            whole = saved(_all(parts[:-1]), "seen")
            forget(*parts[:-1])
            parts = [whole, parts[-1]]
    raise RuntimeError("too many rounds")


def dangling(edges: DataFrame, commits: DataFrame) -> DataFrame:
    """Edges whose parent is not among the commits."""
    return edges.join(commits.select("vault_id", F.col("oid").alias("parent")), ["vault_id", "parent"], "left_anti")


def well_formed(tips: DataFrame) -> DataFrame:
    """tips whose oid is one (forty hexadecimal digits), in lower case; malformed ones are ignored."""
    return tips.where(F.col("oid").rlike("^[0-9a-fA-F]{40}\\z")).withColumn("oid", F.lower("oid"))


def wanted_tips(shown: DataFrame, held: DataFrame, known: DataFrame) -> DataFrame:
    """Advertised tips (vault_id, oid) that the receiver does not hold, or holds but has not admitted as known."""
    admitted = held.select("vault_id", "oid").join(known.select("vault_id", "oid"), ["vault_id", "oid"], "left_semi")
    return well_formed(shown).select("vault_id", "oid").distinct().join(admitted, ["vault_id", "oid"], "left_anti")
