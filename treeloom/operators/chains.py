"""Greedy chains: from a first row on, each member names the next one as the first row beyond a bar of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import forget, saved, saved_counted


def chained(rows: DataFrame, key: list[str], most_rounds: int = 40) -> DataFrame:
    """(*key, own) of the members of each key's chain. rows: own (which row, rising), level and bar (long), candidate and first
    (whether the row can be a member, and whether it begins the chain). A member's successor is the candidate of the least
    level above its bar, the lowest own among equals.

    One window finds every row's successor; then jumps double in length, so rounds grow with the logarithm of a chain's length
    and no array of a key's rows is ever made. Joins are by sorting: numbers of rows pack so well that the files' sizes say nothing of what a
    broadcast would hold in the driver."""
    rows = rows.select(*key, "own", "level", "bar", "candidate", "first")
    both = rows.where("candidate").select(*key, "own", F.col("level").alias("value"), F.lit(1).alias("kind")).unionByName(rows.select(*key, "own", F.col("bar").alias("value"), F.lit(0).alias("kind")))
    falling = Window.partitionBy(*key).orderBy(F.desc("value"), "kind", F.desc("own")).rowsBetween(Window.unboundedPreceding, 0)
    after = both.withColumn("next", F.last(F.when(F.col("kind") == 1, F.col("own")), True).over(falling))
    jump = saved(after.where("kind = 0 AND next IS NOT NULL").select(*key, "own", "next"), "jump")
    members, found = saved_counted(rows.where("first").select(*key, "own"), "members")
    for _ in range(most_rounds):
        more, found = saved_counted(members.hint("merge").join(jump.hint("merge"), [*key, "own"]).select(*key, F.col("next").alias("own")), "more")
        if not found:
            forget(jump)
            return members
        onward = saved(members.unionByName(more), "members")
        longer = saved(jump.hint("merge").join(jump.hint("merge").select(*key, F.col("own").alias("next"), F.col("next").alias("further")), [*key, "next"]).select(*key, "own", F.col("further").alias("next")), "jump")
        forget(jump, members, more)
        members, jump = onward, longer
    raise RuntimeError("a chain is longer than 2 to the number of rounds")
