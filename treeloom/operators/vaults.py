"""Vault by vault: what one vault's rows tell is worked out in one task where they are few, so a walk is one shuffle and no loop.

Rows come sorted by vault and part; a task holds one vault at a time and never more than a fixed number of rows. Vaults beyond that are
named, and their operators go on with the loops that hold no vault in a task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, StructField, StructType

from ..functions.tables import saved_counted

#: Rows of one vault that a task holds, and cells (commits times paths, or bits over 64) that it makes of them.
MOST_ROWS = 100_000
MOST_CELLS = 4_000_000
_BATCH = 20_000


class Unsuited(Exception):
    """The vault is left to the loops."""


def each_vault(parts: list[DataFrame], run: Callable[..., Iterable[tuple]], fields: list[StructField], name: str, most: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """parts begin with vault_id. run(rows of the first part, of the second, ...) gives a vault's rows of fields, as tuples. Returns
    (vault_id, *fields), and (vault_id) of the vaults that have more than most rows or that run calls unsuited; None where there are none."""
    most = MOST_ROWS if most is None else most
    slots: list[str] = []
    placed = []
    for part in parts:
        used: Counter = Counter()
        own = []
        for _, kind in part.dtypes[1:]:
            place = f"{kind}#{used[kind]}"
            used[kind] += 1
            own.append(place)
            if place not in slots:
                slots.append(place)
        placed.append(own)
    rows = None
    for i, (part, own) in enumerate(zip(parts, placed)):
        at = {place: F.col(f"`{column}`") for place, column in zip(own, part.columns[1:])}
        cells = [at.get(s, F.lit(None).cast(s.split("#")[0])).alias(f"c{j}") for j, s in enumerate(slots)]
        one = part.where("vault_id IS NOT NULL").select("vault_id", F.lit(i).alias("part"), *cells)
        rows = one if rows is None else rows.unionAll(one)
    schema = StructType([parts[0].schema["vault_id"], *(StructField(f.name, f.dataType) for f in fields), StructField("__large", BooleanType())])
    shape = to_arrow_schema(schema)
    takes = [[slots.index(s) + 2 for s in own] for own in placed]
    many = len(parts)

    def told(vault: object, held: list[list[tuple]]) -> Iterator[tuple]:
        try:
            for row in run(*held):
                yield (vault, *row, False)
        except Unsuited:
            yield (vault, *[None] * (len(shape) - 2), True)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, n, out = None, [[] for _ in range(many)], 0, []

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), shape)], schema=shape)

        def ended() -> Iterator[tuple]:
            if at is not None:
                yield from told(at, held) if n <= most else [(at, *[None] * (len(shape) - 2), True)]

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            each = [list(zip(*[columns[j] for j in take])) if take else [()] * len(columns[0]) for take in takes]
            for i, (vault, part) in enumerate(zip(columns[0], columns[1])):
                if vault != at:
                    for row in ended():
                        out.append(row)
                        if len(out) >= _BATCH:
                            yield flushed()
                            out = []
                    at, held, n = vault, [[] for _ in range(many)], 0
                n += 1
                if n <= most:
                    held[part].append(each[part][i])
                elif n == most + 1:
                    held = [[] for _ in range(many)]
        for row in ended():
            out.append(row)
            if len(out) >= _BATCH:
                yield flushed()
                out = []
        if out:
            yield flushed()

    ordered = rows.repartition("vault_id").sortWithinPartitions("vault_id", "part")
    made, large = saved_counted(ordered.mapInArrow(go, schema), name, "__large")
    whole = made.where("NOT __large").drop("__large")
    return whole, made.where("__large").select("vault_id") if large else None


def only(large: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """The rows of large vaults."""
    return [t.join(large, "vault_id", "left_semi") for t in tables]


def parents_first(up: dict[str, list[str]]) -> list[str]:
    """All commits that up (child: parents) names, every parent before its children."""
    order: list[str] = []
    done: set[str] = set()
    opened: set[str] = set()
    for root in up:
        stack = [root]
        while stack:
            at = stack[-1]
            todo = [p for p in up.get(at, ()) if p not in done] if at not in done else []
            if todo:
                if at in opened:
                    raise Unsuited
                opened.add(at)
                stack += todo
                continue
            stack.pop()
            if at not in done:
                done.add(at)
                order.append(at)
    return order


def linked(pairs: Iterable[tuple[str, str]]) -> dict[str, list[str]]:
    found: dict[str, list[str]] = {}
    for a, b in pairs:
        found.setdefault(a, []).append(b)
    return found


class Past:
    """A vault's commits numbered parents first, and what each reaches, itself included, as the bits of a whole number."""

    def __init__(self, edges: list[tuple[str, str]]):
        up = linked(edges)
        self.names = parents_first(up)
        if len(self.names) ** 2 > MOST_CELLS * 64:
            raise Unsuited
        self.at = {oid: i for i, oid in enumerate(self.names)}
        self.bits: list[int] = []
        for i, oid in enumerate(self.names):
            bits = 1 << i
            for p in up.get(oid, ()):
                bits |= self.bits[self.at[p]]
            self.bits.append(bits)

    def of(self, oid: str) -> int:
        if oid not in self.at:  # without edges: it reaches itself
            self.at[oid] = len(self.names)
            self.bits.append(1 << len(self.names))
            self.names.append(oid)
        return self.bits[self.at[oid]]

    def maximal(self, common: int) -> list[str]:
        """Of a set that holds all ancestors of its members those that are no ancestor of another."""
        best = []
        while common:
            top = common.bit_length() - 1
            best.append(self.names[top])
            common &= ~self.bits[top]
        return best
