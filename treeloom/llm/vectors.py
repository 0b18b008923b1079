"""Nearest neighbours along shifted Hilbert curves, and exact top-k inner products by MaxScore.

Cases, for both: vectors that are null or hold a null or non-finite component take no part (for cosines, zero vectors
neither), nor do rows without a vec_id; rows repeated whole count once; equal vectors tie and the smaller vec_id wins; only
vectors of one length are compared; an empty table gives an empty result; further columns are not read. Products of components
so large that a sum could leave 64 bits are computed and ranked in whole numbers of any length; a score beyond 64 bits is
returned as the largest (or least) 64-bit number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

TOP = 5
EVERY = 50
#: Components of products are floor(SCALE * x).
SCALE = 256
#: Many curves with a small window each find more than a few with a wide one.
CURVES = 96
DIMS = 16
BITS = 2
#: The part of a curve that a query sees, half on either side, and the least number of rows to a side. Neighbours without
#: structure need a share of all rows; see the README for recall and rows compared.
WINDOW = 0.0031
LEAST_REACH = 64
BLOCK = 1024
#: Candidates whose cosine is computed exactly, for each query.
RERANKED = 24
#: Unit vectors travel along the curves as 16-bit integers.
CODE = 32767
SHARD = 4096
CHUNK = 512


def _usable(v: str) -> Column:
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.col("vec_id").isNotNull() & F.col(v).isNotNull() & (F.size(v) > 0) & ~F.coalesce(odd, F.lit(True))


def hilbert_keys(grid: np.ndarray, bits: int) -> np.ndarray:
    """The place of each row of grid (integers below 2**bits) on the Hilbert curve through its space, by the transposed form
    of the published algorithm: undo excess rotations from the top bit down, Gray-encode, interleave."""
    x = grid.astype(np.uint32).copy()
    dims = x.shape[1]
    for b in range(bits - 1, 0, -1):
        bit, low = np.uint32(1 << b), np.uint32((1 << b) - 1)
        for i in range(dims):
            on = (x[:, i] & bit) != 0
            swap = np.where(on, np.uint32(0), (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(on, low, swap)
            x[:, i] ^= swap
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    flips = np.zeros(len(x), np.uint32)
    for b in range(bits - 1, 0, -1):
        flips ^= np.where((x[:, -1] & np.uint32(1 << b)) != 0, np.uint32((1 << b) - 1), np.uint32(0))
    x ^= flips[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[:, i] >> np.uint32(b)) & 1).astype(np.int64)
    return key


def curve_keys(vectors: np.ndarray, curves: int, dims: int = DIMS, bits: int = BITS, seed: int = 3) -> np.ndarray:
    """Keys of unit vectors on every curve, a column each. A curve projects on its own orthonormal directions, spreads the
    values evenly over the cells, and shifts the grid by its own offset."""
    n, size = vectors.shape
    rng = np.random.default_rng([seed, size])
    out = np.empty((n, curves), np.int64)
    for c in range(curves):
        basis, _ = np.linalg.qr(rng.normal(size=(size, min(dims, size))))
        shift = rng.random(basis.shape[1])
        even = 1 / (1 + np.exp(-1.7 * np.sqrt(size) * (vectors @ basis)))
        cells = ((even + shift / 4) / 1.25 * (1 << bits)).astype(np.int64)
        out[:, c] = hilbert_keys(np.clip(cells, 0, (1 << bits) - 1), bits)
    return out


def _matrix(column: pa.Array, dtype: str = "float64") -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), dtype)


def _joined(column: pa.Array) -> np.ndarray:
    """The bytes of all entries of a binary column, one after the other."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]] if len(column) else np.zeros(0, np.uint8)


def _units(raw: np.ndarray) -> np.ndarray:
    unit = raw / np.abs(raw).max(axis=1, keepdims=True)
    return unit / np.linalg.norm(unit, axis=1, keepdims=True)


def _blocks_along_curves(kinds: DataFrame, curves: int) -> DataFrame:
    """Blocks of neighbours along every curve, in the order in which range partitions hold them: the first row's curve, key and
    rid, the rows' ids and codes, and apart those of the rows that ask (with their places in the block)."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                part = batch.take(pa.array(at))
                unit = _units(_matrix(part.column(1)))
                keys = curve_keys(unit, curves)
                codes = pa.array([r.tobytes() for r in np.rint(unit * CODE).astype(np.int16)], pa.binary())
                for c in range(curves):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), size * 1000 + c)), pa.array(keys[:, c]), part.column(0), part.column(2), codes], names=["curve", "key", "rid", "asks", "code"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        curve, room = None, BLOCK

        def block() -> pa.RecordBatch:
            key, rid, asks, code = (np.concatenate([h[i] for h in held]) for i in range(4))
            code = code.reshape(len(rid), -1)
            own = np.flatnonzero(asks)
            binary = [pa.array([x.tobytes()], pa.binary()) for x in (rid, code, own, rid[own], code[own])]
            return pa.RecordBatch.from_arrays([*(pa.array([int(x)], pa.int64()) for x in (curve, key[0], rid[0], len(rid), len(own))), *binary], names=["curve", "key", "rid", "n", "n_asks", "ids", "codes", "asks_at", "ask_ids", "ask_codes"])

        for batch in batches:
            curve_of, keys, rids = (batch.column(i).to_numpy() for i in range(3))
            asks = batch.column(3).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(curve_of)) + 1).tolist(), len(curve_of)]
            for a, z in zip(cuts, cuts[1:]):
                if held and z > a and curve != int(curve_of[a]):
                    yield block()
                    held, room = [], BLOCK
                while a < z:
                    curve, stop = int(curve_of[a]), min(z, a + room)
                    held.append((keys[a:stop], rids[a:stop], asks[a:stop], _joined(batch.column(4).slice(a, stop - a))))
                    a, room = stop, room - (stop - a)
                    if not room:
                        yield block()
                        held, room = [], BLOCK
        if held:
            yield block()

    ordered = kinds.select("rid", "v", "asks").mapInArrow(keyed, "curve long, key long, rid long, asks boolean, code binary").repartitionByRange("curve", "key", "rid").sortWithinPartitions("curve", "key", "rid")
    return saved(ordered.mapInArrow(packed, "curve long, key long, rid long, n long, n_asks long, ids binary, codes binary, asks_at binary, ask_ids binary, ask_codes binary"), "blocks")


def _visits(blocks: DataFrame, window: float) -> DataFrame:
    """(curve, key, rid) of blocks that hold queries with their first row's place, the reach of their windows, and the blocks
    (c_key, c_rid, c_first) that these meet."""
    along = Window.partitionBy("curve").orderBy("key", "rid")
    placed = blocks.select("curve", "key", "rid", "n", "n_asks").withColumns({"last": F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(Window.partitionBy("curve"))})
    placed = placed.withColumns({"first": F.col("last") - F.col("n"), "reach": F.greatest(F.lit(LEAST_REACH), F.ceil(F.col("all") * F.lit(window / 2)))})
    cell = lambda rank: F.floor(rank / F.lit(float(BLOCK))).cast("long")
    there = placed.select("curve", F.col("key").alias("c_key"), F.col("rid").alias("c_rid"), F.col("first").alias("c_first"), F.explode(F.sequence(cell(F.col("first")), cell(F.col("last") - 1))).alias("cell"))
    seen = placed.where("n_asks > 0").select("curve", "key", "rid", "first", "reach", F.explode(F.sequence(cell(F.greatest(F.col("first") - F.col("reach"), F.lit(0))), cell(F.least(F.col("last") - 1 + F.col("reach"), F.col("all") - 1)))).alias("cell"))
    return seen.join(there, ["curve", "cell"]).drop("cell").distinct()


def nearest(table: DataFrame, top: int = TOP, every: int = EVERY, curves: int = CURVES, window: float = WINDOW, v: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score (cosine) of the nearest vectors found for each row whose vec_id is divisible by
    every. Equal vectors stand together as one, with the smallest top + 1 of their ids. Windows are compared on 16-bit codes in
    single precision; the best RERANKED candidates of a query are ranked on their cosines in double precision."""
    rows = table.where(_usable(v)).select("vec_id", F.transform(v, lambda x: x.cast("double")).alias("v")).where(F.exists("v", lambda x: x != 0)).distinct()
    asks = F.pmod("vec_id", F.lit(every)) == 0
    kinds = saved(rows.groupBy("v").agg(F.min("vec_id").alias("rid"), F.max(asks).alias("asks"), F.count("*").alias("copies")), "kinds")
    copied = rows.join(kinds.where("copies > 1").select("v", "rid"), "v").select("rid", "vec_id")
    by_id = Window.partitionBy("rid").orderBy("vec_id")
    ids = kinds.where("copies = 1").select("rid", F.col("rid").alias("vec_id")).unionByName(
        copied.withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= top + 1).select("rid", "vec_id"))
    queries = kinds.where("copies = 1 and asks").select("rid", F.col("rid").alias("query_id")).unionByName(copied.where(asks).select("rid", F.col("vec_id").alias("query_id")))
    found = saved(_candidates(_blocks_along_curves(kinds, curves), window, top).groupBy("asker", "rid").agg(F.max("near").alias("near")), "candidates")
    order = Window.partitionBy("asker").orderBy(F.desc("near"), "rid")
    few = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= RERANKED).select("asker", "rid")
    pairs = few.join(kinds.select("rid", F.col("v").alias("theirs")), "rid").join(kinds.select(F.col("rid").alias("asker"), F.col("v").alias("own")), "asker").select("asker", "rid", "own", "theirs")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            for size in np.unique(sizes).tolist():
                part = batch.take(pa.array(np.flatnonzero(sizes == size)))
                score = (_units(_matrix(part.column(2))) * _units(_matrix(part.column(3)))).sum(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score)], names=["asker", "rid", "score"])

    exact = pairs.mapInArrow(measured, "asker long, rid long, score double")
    named = exact.join(ids, "rid").join(queries.withColumnRenamed("rid", "asker"), "asker").where("vec_id <> query_id")
    final = named.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= top)
    return final.select("query_id", "rank", "vec_id", "score")


def _candidates(blocks: DataFrame, window: float, top: int) -> DataFrame:
    """asker, rid and near (the cosine on codes) of the best rows of every window; a query is among its own candidates."""
    visits = _visits(blocks, window)
    asking = visits.join(blocks.select("curve", "key", "rid", "asks_at", "ask_ids", "ask_codes"), ["curve", "key", "rid"])
    met = blocks.select("curve", F.col("key").alias("c_key"), F.col("rid").alias("c_rid"), "ids", "codes")
    work = asking.drop("key", "rid").join(met, ["curve", "c_key", "c_rid"]).select("first", "reach", "c_first", "ids", "codes", "asks_at", "ask_ids", "ask_codes")
    keep = top + 1 + 6

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                first, reach, c_first = (batch.column(k)[i].as_py() for k in range(3))
                ids, codes, at, ask_ids, ask_codes = (np.frombuffer(batch.column(k)[i].as_buffer(), t) for k, t in ((3, np.int64), (4, np.int16), (5, np.int64), (6, np.int64), (7, np.int16)))
                theirs = codes.reshape(len(ids), -1).astype(np.float32)
                own = ask_codes.reshape(len(at), -1).astype(np.float32) * np.float32(CODE**-2.0)
                low = np.maximum(first + at - reach - c_first, 0).tolist()
                high = np.minimum(first + at + reach - c_first + 1, len(ids)).tolist()
                who, what, near = [], [], []
                for q, (a, z) in enumerate(zip(low, high)):
                    if a < z:
                        score = theirs[a:z] @ own[q]
                        best = np.argpartition(score, len(score) - keep)[-keep:] if len(score) > keep else np.arange(len(score))
                        who.append(np.full(len(best), ask_ids[q]))
                        what.append(ids[a + best])
                        near.append(score[best])
                if who:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (who, what, near)], names=["asker", "rid", "near"])

    return work.mapInArrow(rank, "asker long, rid long, near float")


class Shard:
    """Rows of integer vectors, by rising id, with what MaxScore needs: each component's least and largest value."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        by = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[by], rows[by]
        self.low, self.high = self.rows.min(axis=0), self.rows.max(axis=0)

    def search(self, query: np.ndarray, own: int, top: int) -> tuple[np.ndarray, np.ndarray]:
        """The best ids and scores. A term is a component of the query; its posting's impact is how far a row's component
        lies above the least that this term can give, so impacts are never negative and their bounds add up."""
        least = np.where(query >= 0, query * self.low, query * self.high)
        bound = np.where(query >= 0, query * self.high, query * self.low) - least
        base = int(least.sum())
        order = np.argsort(bound, kind="stable")
        upto = np.cumsum(bound[order])
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for k in range(0, len(self.ids), CHUNK):
            ids, rows = self.ids[k : k + CHUNK], self.rows[k : k + CHUNK]
            need = int(best[-1]) if len(best) == top else None
            # Non-essential: the terms of small bounds that together can't lift a row over the k-th best.
            spare = 0 if need is None else int(np.searchsorted(upto, need - base, side="right"))
            essential, rest = order[spare:], order[:spare]
            score = rows[:, essential] @ query[essential] + int(least[rest].sum())
            live = np.flatnonzero(ids != own) if need is None else np.flatnonzero((ids != own) & (score + (int(upto[spare - 1]) if spare else 0) > need))
            score = score[live]
            while spare and len(live):  # probe the others, largest bounds first, while a row can still win
                cut = max(0, spare - 8)
                terms = order[cut:spare]
                score = score + (rows[np.ix_(live, terms)] @ query[terms] - int(least[terms].sum()))
                spare = cut
                good = score + (int(upto[spare - 1]) if spare else 0) > need
                live, score = live[good], score[good]
            if len(live):
                best_ids, best = np.concatenate([best_ids, ids[live]]), np.concatenate([best, score])
                keep = np.lexsort((best_ids, -best))[:top]
                best_ids, best = best_ids[keep], best[keep]
        return best_ids, best

    def search_all(self, queries: np.ndarray, own: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """search() of many queries at once: (places of the queries, ids, scores). Each query keeps its own non-essential terms, which are
        zero in its column of one product in double precision, exact below 2**53; where sums could leave that, queries go one by one."""
        if int(np.abs(self.rows).max(initial=0)) * int(np.abs(queries).max(initial=0)) * queries.shape[1] >= 1 << 52:
            each = [self.search(q, o, top) for q, o in zip(queries, own.tolist())]
            return (np.repeat(np.arange(len(each)), [len(i) for i, _ in each]), *(np.concatenate([e[k] for e in each]) for k in (0, 1)))
        least = np.where(queries >= 0, queries * self.low, queries * self.high)
        bound = np.where(queries >= 0, queries * self.high, queries * self.low) - least
        base = least.sum(axis=1)
        order = np.argsort(bound, axis=1, kind="stable")
        place = np.argsort(order, axis=1)
        upto = np.cumsum(np.take_along_axis(bound, order, axis=1), axis=1)
        held = np.concatenate([np.zeros((len(queries), 1), np.int64), upto], axis=1)
        none = np.iinfo(np.int64).min
        need = np.full(len(queries), none)
        at, best_ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for k in range(0, len(self.ids), CHUNK):
            ids, rows = self.ids[k : k + CHUNK], self.rows[k : k + CHUNK]
            some = need > none
            spare = np.where(some, (upto <= np.where(some, need - base, 0)[:, None]).sum(axis=1), 0)
            essential = place >= spare[:, None]
            product = rows.astype(np.float64) @ np.where(essential, queries, 0).T.astype(np.float64)
            product += np.where(essential, 0, least).sum(axis=1)
            bar = np.where(some, need - held[np.arange(len(queries)), spare], none).astype(np.float64)
            if not some.all() and len(ids) > top + 1:  # a row below the best of its own chunk, the query's own included, can't win
                few = np.flatnonzero(~some)
                bar[few] = np.partition(product[:, few], len(ids) - top - 1, axis=0)[len(ids) - top - 1] - 1
            row, q = np.nonzero(product > bar)
            mine = ids[row] != own[q]
            row, q = row[mine], q[mine]
            score = product[row, q]
            rest = np.flatnonzero(spare[q] > 0)
            if len(rest) * 32 > product.size:  # many rows may still win: the other terms are one more product
                score[rest] = (rows.astype(np.float64) @ queries.T.astype(np.float64))[row[rest], q[rest]]
            else:
                score[rest] = (rows[row[rest]] * queries[q[rest]]).sum(axis=1)
            won = score > need[q]
            row, q, score = row[won], q[won], score[won].astype(np.int64)
            if len(q):
                at, best_ids, best = np.concatenate([at, q]), np.concatenate([best_ids, ids[row]]), np.concatenate([best, score])
                by = np.lexsort((best_ids, -best, at))
                at, best_ids, best = at[by], best_ids[by], best[by]
                nth = np.arange(len(at)) - np.searchsorted(at, at)
                keep = nth < top
                need[at[nth == top - 1]] = best[nth == top - 1]
                at, best_ids, best = at[keep], best_ids[keep], best[keep]
        return at, best_ids, best


def _exactly(x: float) -> int:
    """floor(256 * x) for a component of any size."""
    return math.floor(Fraction(x) * SCALE)


def _ranked(score: int) -> tuple[int, str, int]:
    """What a score of any length is ordered by, falling: whether it lies above, within or below 64 bits, its digits (those
    that lie beyond), and the score as 64 bits hold it."""
    if -(1 << 63) <= score < 1 << 63:
        return 0, "", score
    digits = str(abs(score))
    if score > 0:
        return 1, f"{len(digits):05d}{digits}", (1 << 63) - 1
    return -1, f"{99999 - len(digits):05d}" + digits.translate(str.maketrans("0123456789", "9876543210")), -(1 << 63)


def top_products(table: DataFrame, top: int = TOP, every: int = EVERY, v: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: exact top inner products of floor(SCALE * component). Shards of about SHARD rows
    meet blocks of queries, MaxScore runs in each shard, and the shards' best merge. Rows whose products with others like them
    might leave 62 bits are packed apart, as they came, and meet all others in whole numbers of any length."""
    whole = table.where(_usable(v)).select("vec_id", F.transform(v, lambda x: x.cast("double")).alias("v"))
    most = F.array_max(F.transform("v", F.abs)) * F.sqrt(F.size("v"))
    whole = whole.withColumn("big", most >= float(1 << 31) / SCALE)
    floors = F.transform("v", lambda x: F.floor(x * F.lit(float(SCALE))).cast("double"))
    rows = saved(whole.select("vec_id", "big", F.when(F.col("big"), F.col("v")).otherwise(floors).alias("v")).distinct(), "integers")
    n = rows.count()
    shards = max(1, -(-n // SHARD))
    ask_blocks = max(1, -(-n // (every * 1024)))
    sized = rows.select("vec_id", "v", "big", F.size("v").alias("dim"))

    def pack(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        return pa.table({"dim": group["dim"][:1], "part": group["part"][:1], "big": group["big"][:1], "ids": pa.array([group["vec_id"].to_numpy().tobytes()], pa.binary()), "rows": pa.array([_matrix(group["v"].chunk(0)).tobytes()], pa.binary())})

    kinds = "dim int, part long, big boolean, ids binary, rows binary"
    candidates = sized.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(shards))).groupBy("dim", "big", "part").applyInArrow(pack, kinds)
    asking = sized.where(F.pmod("vec_id", F.lit(every)) == 0).withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(ask_blocks))).groupBy("dim", "big", "part").applyInArrow(pack, kinds)
    everywhere = asking.select("dim", F.col("big").alias("ask_big"), F.col("ids").alias("ask_ids"), F.col("rows").alias("ask_rows"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("part"))
    # The sizes that Spark estimates don't know of the copies: it would gather all of them in the driver to broadcast them.
    work = candidates.hint("merge").join(everywhere.hint("merge"), ["dim", "part"]).select("big", "ids", "rows", "ask_big", "ask_ids", "ask_rows")

    def whole_numbers(rows_: np.ndarray, big: bool) -> np.ndarray:
        out = np.empty(rows_.shape, object)
        out[:] = [[_exactly(x) if big else int(x) for x in r] for r in rows_.tolist()]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for big, ids, rows_, ask_big, ask_ids, ask_rows in zip(*(c.to_pylist() for c in batch.columns)):
                ids, ask_ids = np.frombuffer(ids, np.int64), np.frombuffer(ask_ids, np.int64)
                rows_, ask_rows = np.frombuffer(rows_).reshape(len(ids), -1), np.frombuffer(ask_rows).reshape(len(ask_ids), -1)
                if big or ask_big:
                    out = []
                    theirs = whole_numbers(rows_, big)
                    for q, row in zip(ask_ids.tolist(), whole_numbers(ask_rows, ask_big)):
                        best = sorted((-s, i) for s, i in zip((theirs @ row).tolist(), ids.tolist()) if i != q)[:top]
                        out += [(q, i, *_ranked(-s)) for s, i in best]
                    columns = list(zip(*out)) or [()] * 5
                else:
                    at, near, score = Shard(ids, rows_.astype(np.int64)).search_all(ask_rows.astype(np.int64), ask_ids, top)
                    columns = [ask_ids[at], near, np.zeros(len(at), np.int32), [""] * len(at), score]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64()))], names=["query_id", "vec_id", "beyond", "digits", "score"])

    found = work.mapInArrow(run, "query_id long, vec_id long, beyond int, digits string, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("beyond"), F.desc("digits"), F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
