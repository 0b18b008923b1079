"""Mixing sources to target weights, in DataFrame functions alone.

Sizes are counted per source, targets come from a water-filling over the sources, and each document is emitted
floor(rate) times plus one copy drawn from a hash of the document with probability equal to the fraction.

Cases: a null or empty text has size 0 and is taken 0 words, its document still gets copies; the null source is a source
of its own and comes last, also where sources tie; repeated rows draw alike; a source without words has rate 0; an empty table gives an empty
result; further columns pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, saved, shielded

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
#: Up to so many sources the table of rates is broadcast: a bound of about 10,000 rows.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_rates(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Columns __source, __source_size, __target, __rate, one row per source.

    Targets are min(cap * size, level * weight): sources ordered by the level at which they reach their cap, those
    capped are a prefix of that order, and the level is what the rest share. The windows run over one row per source.
    """
    per_source = sizes.groupBy("__source").agg(F.sum("__size").alias("__source_size"))
    order = Window.orderBy(F.col("__source").asc_nulls_last())
    n = len(weights)
    numbered = per_source.withColumn("__ix", (F.row_number().over(order) - 1) % n)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__ix") + 1).cast("int"))
    limited = numbered.withColumn("__w", weight).withColumn("__cap", F.col("__source_size") * F.lit(float(cap)))
    limited = limited.withColumn("__full_at", F.col("__cap") / F.col("__w"))
    by_level = Window.orderBy("__full_at", F.col("__source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    stepped = limited.withColumns({
        "__left": F.sum("__source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0)),
        "__left_w": F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(before), F.lit(0.0)),
        "__turn": F.row_number().over(by_level),
    })
    stepped = stepped.withColumn("__level", F.col("__left") / F.col("__left_w"))
    # The first source, in the order of the sums above, that does not reach its cap fixes the level; if all reach it, every
    # target is the cap.
    open_level = F.min_by(F.col("__level"), F.when(F.col("__full_at") > F.col("__level"), F.col("__turn")))
    levelled = stepped.withColumn("__level", open_level.over(everything))
    target = F.when(F.col("__level").isNull() | (F.col("__full_at") <= F.col("__level")), F.col("__cap")).otherwise(F.col("__level") * F.col("__w"))
    capped = levelled.withColumn("__target", F.least(target, F.col("__cap")))
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    return capped.select("__source", "__source_size", "__target", rate.alias("__rate"))


@shielded
def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 17, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """docs with __size, __source_size, __target and __copies (how often the mix holds the document)."""
    sizes = docs.select(F.col(source).alias("__source"), word_count(F.col(text)).alias("__size"))
    rates = saved(source_rates(sizes, weights, share, cap).coalesce(1), "rates")
    side = F.broadcast(rates) if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else rates
    whole = F.floor("__rate")
    named = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))).cast("binary"))
    draw = F.conv(F.substring(named, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    joined = docs.withColumn("__size", word_count(F.col(text))).join(side, F.col(source).eqNullSafe(F.col("__source")), "left")
    copies = (whole + (draw < (F.col("__rate") - whole)).cast("int")).cast("int")
    return joined.withColumn("__copies", F.coalesce(copies, F.lit(0))).drop("__source", "__rate")


@shielded
def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as its draw says, with the columns of docs."""
    taken = mix(docs, **options)
    copies = taken.where("__copies > 0").withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__copies"))))
    return copies.select(*[F.col(f"`{c}`") for c in docs.columns])


def mixing_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken of each document."""
    return mix(docs, **options).select(
        "doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
        (F.col("__size") * F.col("__copies")).alias("taken"),
    )
