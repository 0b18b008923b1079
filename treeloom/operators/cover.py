"""Which commits come before which, without the closure: labels over a cover of the DAG by chains.

A node's primitives, in order of their counters, are a chain: each comes after the one before it. So all that comes before a commit
is told by one number per chain, the highest place reached in it. Those numbers only rise along a chain, and only
the commits where one rises are kept: rows grow with the links between chains, not with the square of a history's depth. Labels
are composed with themselves until nothing rises, which takes as many rounds as the logarithm of the number of chains.

That a node's primitives are a chain is not taken for granted. Labels are computed as if it were, then every step of a chain is
checked against what the real parents reach, and a chain is cut where a step does not hold; once all steps hold, all labels
do (by induction from the oldest commits on). Stretches of synthetic commits are walked through.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import forget, saved, saved_counted


class Cover(NamedTuple):
    """spots (vault_id, oid, chain, spot) of primitives, labels (vault_id, chain, spot, other, reach: from this spot of chain on, the
    spots of other up to reach come before), above (vault_id, oid, above): the nearest primitives above every synthetic commit, and
    torn (vault_id, oid) of commits, primitive or not, above which a parent is missing before any other primitive."""

    spots: DataFrame
    labels: DataFrame
    above: DataFrame
    torn: DataFrame


def nearest(asked: DataFrame, commits: DataFrame, edges: DataFrame, most_rounds: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """asked (vault_id, oid) -> (vault_id, oid, above): the first primitives on every way up, and (vault_id, oid) of those from which
    a way leads to a parent that is not among the commits, through synthetic commits alone."""
    kinds = commits.select("vault_id", F.col("oid").alias("above"), "is_primitive")
    up = edges.select("vault_id", F.col("child").alias("at"), F.col("parent").alias("above"))
    key = ["vault_id", "oid", "above"]
    rounds = []
    front = asked.select("vault_id", "oid", F.col("oid").alias("at"))
    for _ in range(most_rounds):
        step = front.join(up, ["vault_id", "at"]).select(*key).distinct()
        for earlier in rounds:
            step = step.join(earlier.where("NOT is_primitive"), key, "left_anti")
        told, left = saved_counted(step.join(kinds, ["vault_id", "above"], "left").select(*key, "is_primitive"), "nearest", "NOT is_primitive")
        rounds.append(told)
        if len(rounds) == 16:
            rounds = [saved(_all(rounds[:-1]), "nearest"), rounds[-1]]
        front = told.where("NOT is_primitive").select("vault_id", "oid", F.col("above").alias("at"))
        if not left:
            whole = _all(rounds)
            return whole.where("is_primitive").select(*key).distinct(), whole.where("is_primitive IS NULL").select("vault_id", "oid").distinct()
    raise RuntimeError("too many rounds")


def _all(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.unionByName(more)
    return whole


def last_before(questions: DataFrame, facts: DataFrame, key: list[str], at: str, value: str) -> DataFrame:
    """questions (*key, at, ...) with the value of the latest fact (*key, at, value) of their key at or before them; null if none."""
    order = Window.partitionBy(*key).orderBy(at, "__asks").rowsBetween(Window.unboundedPreceding, 0)
    rest = [c for c in questions.columns if c not in (*key, at)]
    kinds = dict(questions.dtypes)
    both = facts.select(*key, at, value, F.lit(0).alias("__asks"), *[F.lit(None).cast(kinds[c]).alias(c) for c in rest])
    both = both.unionByName(questions.select(*key, at, F.lit(None).cast(facts.schema[value].dataType).alias(value), F.lit(1).alias("__asks"), *rest))
    return both.withColumn(value, F.last(value, True).over(order)).where("__asks = 1").drop("__asks")


def _risen(labels: DataFrame) -> DataFrame:
    """Of labels (with new, whether this round made them) only those that reach higher than all at or before their spot."""
    order = Window.partitionBy("vault_id", "chain", "other").orderBy("spot", F.desc("reach"), "new")
    before = F.max("reach").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return labels.withColumn("__before", before).where("__before IS NULL OR reach > __before").drop("__before")


def _composed(links: DataFrame, most_rounds: int = 64) -> DataFrame:
    """links as labels -> all labels: what a chain reaches in a second one, from there in a third, until nothing rises."""
    labels = saved(_risen(links.withColumn("new", F.lit(0))), "labels")
    for turn in range(1, most_rounds + 1):
        on = labels.select("vault_id", F.col("chain").alias("other"), F.col("other").alias("third")).distinct()
        asks = labels.select("vault_id", "chain", "spot", "other", "reach").join(on, ["vault_id", "other"])
        asks = asks.select("vault_id", F.col("other").alias("via"), "third", F.col("reach").alias("at"), "chain", "spot")
        facts = labels.select("vault_id", F.col("chain").alias("via"), F.col("other").alias("third"), F.col("spot").alias("at"), "reach")
        further = last_before(asks, facts, ["vault_id", "via", "third"], "at", "reach").where("reach IS NOT NULL AND NOT (third = chain AND reach <= spot)")
        both = labels.unionByName(further.select("vault_id", "chain", "spot", F.col("third").alias("other"), "reach", F.lit(turn).alias("new")))
        risen, grown = saved_counted(_risen(both), "labels", f"new = {turn}")
        forget(labels)
        if not grown:
            return risen.drop("new")
        labels = risen
    raise RuntimeError("labels do not settle")


def covered(commits: DataFrame, edges: DataFrame, most_cuts: int = 1000) -> Cover:
    """commits (vault_id, oid, node_id, counter, is_primitive), edges (vault_id, child, parent): the cover of the primitives."""
    commits = commits.select("vault_id", "oid", "node_id", "counter", "is_primitive")
    prims = commits.where("is_primitive")
    found, torn = nearest(commits, commits, edges)
    links = saved(found.join(commits.select("vault_id", "oid", "is_primitive"), ["vault_id", "oid"]), "links")
    above = links.where("NOT is_primitive").drop("is_primitive")
    links = links.where("is_primitive").drop("is_primitive")
    own = Window.partitionBy("vault_id", "node_id").orderBy("counter", "oid")
    numbered = saved(prims.select("vault_id", "oid", "node_id", F.row_number().over(own).cast("long").alias("spot")), "numbered")
    cuts = numbered.select("vault_id", "oid").limit(0)
    for _ in range(most_cuts):
        along = Window.partitionBy("vault_id", "node_id").orderBy("spot")
        cut = numbered.join(cuts.withColumn("cut", F.lit(1)), ["vault_id", "oid"], "left")
        part = F.count("cut").over(along).cast("string")
        spots = saved(cut.select("vault_id", "oid", F.concat("node_id", F.lit("/"), part).alias("chain"), "spot", (F.lag("spot").over(along).isNotNull() & F.col("cut").isNull()).alias("goes_on")), "spots")
        ends = spots.select("vault_id", F.col("oid").alias("above"), F.col("chain").alias("other"), F.col("spot").alias("reach"))
        placed = saved(links.join(spots.select("vault_id", "oid", "chain", "spot", "goes_on"), ["vault_id", "oid"]).join(ends, ["vault_id", "above"]), "placed")
        across = placed.where("other <> chain OR reach > spot").select("vault_id", "chain", "spot", "other", "reach")
        labels = _composed(across)
        # A step from a spot to the one before it holds if a real parent is that one, or comes after it.
        steps = placed.where("goes_on").select("vault_id", "oid", "chain", "spot", "other", "reach")
        by_parent = steps.where("other = chain AND reach < spot").select("vault_id", "oid", F.col("reach").alias("got"), "spot")
        asked = steps.where("other <> chain").select("vault_id", F.col("other").alias("via"), F.col("chain").alias("third"), F.col("reach").alias("at"), "oid", "spot")
        facts = labels.select("vault_id", F.col("chain").alias("via"), F.col("other").alias("third"), F.col("spot").alias("at"), F.col("reach").alias("got"))
        through = last_before(asked, facts, ["vault_id", "via", "third"], "at", "got").select("vault_id", "oid", "got", "spot")
        held = by_parent.unionByName(through).where("got = spot - 1 OR got >= spot").select("vault_id", "oid")
        more, wrong = saved_counted(spots.where("goes_on").select("vault_id", "oid").join(held, ["vault_id", "oid"], "left_anti"), "cuts")
        if not wrong:
            return Cover(spots.drop("goes_on"), labels, above, saved(torn, "torn"))
        cuts = saved(cuts.unionByName(more), "all_cuts")
        forget(labels, spots, placed)
    raise RuntimeError("the chains do not settle")


def starts(cover: Cover, asked: DataFrame) -> DataFrame:
    """asked (vault_id, oid) -> (vault_id, oid, chain, spot): where a commit's past begins, itself if it is primitive, else the
    nearest primitives above it."""
    asked = asked.select("vault_id", "oid").distinct()
    own = asked.join(cover.spots, ["vault_id", "oid"]).select("vault_id", "oid", "chain", "spot")
    found = asked.join(cover.above, ["vault_id", "oid"])
    return own.unionByName(found.join(cover.spots.withColumnRenamed("oid", "above"), ["vault_id", "above"]).select("vault_id", "oid", "chain", "spot"))


def _bounds(cover: Cover, questions: DataFrame) -> DataFrame:
    """questions (vault_id, chain, spot, other, ...) with bound: the highest spot of other that comes before, itself included."""
    rest = [c for c in questions.columns if c not in ("vault_id", "chain", "spot", "other")]
    found = last_before(questions, cover.labels.withColumnRenamed("reach", "bound"), ["vault_id", "chain", "other"], "spot", "bound")
    bound = F.when(F.col("chain") == F.col("other"), F.greatest("spot", "bound")).otherwise(F.col("bound"))
    return found.withColumn("bound", bound).where("bound IS NOT NULL").select("vault_id", "other", "bound", *rest)


def latest(cover: Cover, asked: DataFrame, marks: DataFrame, by: list[str], key: Column) -> DataFrame:
    """asked (vault_id, oid, *by) -> with best: of all marks (vault_id, oid of a primitive, *by, ...) of the same labels on the commit or
    before it, the one with the greatest key, a column over marks; rows without one are left out. A mark's chains are asked one by
    one, so rows are the questions times the chains that hold a mark of the same labels."""
    spotted = marks.withColumn("__key", key).join(cover.spots, ["vault_id", "oid"])
    order = Window.partitionBy("vault_id", "chain", *by).orderBy("spot").rowsBetween(Window.unboundedPreceding, 0)
    best = spotted.select("vault_id", F.col("chain").alias("other"), *by, F.col("spot").alias("bound"), F.max("__key").over(order).alias("best"))
    best = saved(best, "best")
    holding = best.select("vault_id", *by, "other").distinct()
    questions = asked.select("vault_id", "oid", *by).distinct().join(holding, ["vault_id", *by]).join(starts(cover, asked), ["vault_id", "oid"])
    bounds = _bounds(cover, questions).groupBy("vault_id", "oid", *by, "other").agg(F.max("bound").alias("bound"))
    met = last_before(bounds, best, ["vault_id", "other", *by], "bound", "best").where("best IS NOT NULL")
    return met.groupBy("vault_id", "oid", *by).agg(F.max("best").alias("best"))


def reaching(cover: Cover, asked: DataFrame, marks: DataFrame) -> DataFrame:
    """asked (vault_id, oid) that are, or come after, one of the marks (vault_id, oid of primitives)."""
    first = marks.select("vault_id", "oid").join(cover.spots, ["vault_id", "oid"]).groupBy("vault_id", F.col("chain").alias("other")).agg(F.min("spot").alias("least"))
    questions = starts(cover, asked).join(first, "vault_id")
    return _bounds(cover, questions).where("bound >= least").select("vault_id", "oid").distinct()


def incomplete(cover: Cover, asked: DataFrame) -> DataFrame:
    """asked (vault_id, oid) whose history is not whole."""
    asked = asked.select("vault_id", "oid").distinct()
    return reaching(cover, asked, cover.torn).unionByName(asked.join(cover.torn, ["vault_id", "oid"], "left_semi")).distinct()
