"""What the operators share: shared-folder tables, tables by name, and words."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import forget, saved, shared_dir, table  # noqa: F401  (for the operators of this folder)

#: A word: a run of anything but the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def utf8(column: str = "text") -> Column:
    """The text as bytes; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def crc_rest(column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo modulus (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (public splitmix64 constants), elementwise on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Columns that operators address by name; all others only pass through.
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def shielded(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For operators on documents: columns that they don't address get neutral names while they work, so that no name can
    clash. Where such a column has the name of a column that the operator adds, the added one stands."""

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        names = docs.columns
        hidden = [n if n in OWN else f"__x{i}" for i, n in enumerate(names)]
        if hidden == names:
            return operator(docs, *args, **options)
        out = operator(docs.toDF(*hidden), *args, **options)
        back = {h: n for h, n in zip(hidden, names) if h not in OWN}
        added = {c.lower() for c in out.columns if c not in back}
        kept = [c for c in out.columns if c not in back or back[c].lower() not in added]
        return out.select(*kept).toDF(*[back.get(c, c) for c in kept])

    return run


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For what mapInArrow runs: Python workers outlive their tasks and keep what these have freed, beside the workers of the next
    stage; so it goes back to the machine at a task's end (where the C library can do so)."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return task


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of all texts, one text after the other, and the number of words of each text.

    One pass over the bytes of all texts; no Python object per word.
    """
    coded = [t.lower().encode("utf-8", "replace") for t in texts]
    letters = np.frombuffer(b" " + b" ".join(coded) + b" ", np.uint8)
    space = _SPACE[letters]
    begins = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    if not len(begins):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    inside = np.flatnonzero(~space)
    first = np.searchsorted(inside, begins)
    sizes = np.diff(np.append(first, len(inside)))
    place = np.arange(len(inside)) - np.repeat(first, sizes)
    mixed = mix64((letters[inside].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64))
    hashes = mix64(np.add.reduceat(mixed, first))
    bounds = np.cumsum([1] + [len(c) + 1 for c in coded])
    return hashes, np.diff(np.searchsorted(begins, bounds))


def runs_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive entries."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x100000001B3) + hashes[i : len(hashes) - n + 1 + i]
    return mix64(out)


def placed(rows: DataFrame, group: str, within: list[Column], ties: list[Column], drop: tuple[str, ...] = ()) -> DataFrame:
    """rows with `place`, their number (from 0) in their group's order, and `total`, the size of the group (a column that is
    never null). The order is within, then ties; rows are dealt over the tasks by ranges of group and within, so that a group of
    any size is spread, and only rows that agree in both meet. Range bounds are found on samples of group and within alone,
    which should be short; the rows themselves are written once, in order, without the columns to drop."""
    order = [F.col(group), *within]
    ranged = saved(rows.repartitionByRange(*order).sortWithinPartitions(*order, *ties).drop(*drop).withColumn("__at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("__at", 33).alias("__part")
    counts = ranged.groupBy(F.col(group), part).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    along = Window.partitionBy(group).orderBy("__part")
    starts = counts.withColumns({"__before": F.sum("__n").over(along) - F.col("__n"), "total": F.sum("__n").over(Window.partitionBy(group))}).drop("__n")
    found = ranged.withColumn("__part", part).join(saved(starts, "starts"), [group, "__part"])
    return found.withColumn("place", F.col("__before") + F.col("__at") - F.col("__first")).drop("__part", "__at", "__first", "__before")
