"""N-gram Jaccard self-join by MinHash banding.

Texts are sets of runs of NGRAM words. BANDS bands of ROWS minimum hashes each make a pair at the threshold miss every band
with a probability below 1 - RECALL. Texts with the same set are one class from the start. Classes are shuffled on band
hashes; within a bucket, pairs whose short signatures agree enough (five standard deviations below the threshold) become
candidate groups; inside these every pair is verified on the full sets of 64-bit n-gram hashes, in blocks of bounded size.
Blocks give back a spanning forest and a number of links per class, never the pairs, so that a group of thousands of near
copies costs rows in proportion to its members; buckets and groups of any size are dealt out in block pairs.

Result: one row per document with class_id (the least doc_id of all documents it is linked with, through others too) and
n_links (the other documents whose similarity to it is at least the threshold, copies included).

Cases: a null text, or one without a word, is alone in its class with no links; a text of fewer than NGRAM words is the set
of one run, all its words; repeated rows are copies of each other and count as links; where doc_id is null (and stays null) a
hash of the text stands for it in class_id; of rows that share id and text one_of_each keeps the first by their other columns; very long texts have long sets, and blocks hold fewer of them; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import sub_batches
from .common import hashed_words, lean, mix64, runs_of, saved, shielded, utf8
from .components import components

NGRAM = 5
THRESHOLD = 0.8
RECALL = 0.9999
ROWS = 5
BLOCK = 512
BLOCK_GRAMS = 1_000_000
BUCKET_BLOCK = 2048


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """The least number of bands by which a pair at the threshold shares one with probability recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def gram_sets(texts: list[str], n: int = NGRAM) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its word runs."""
    words, counts = hashed_words(texts)
    runs = runs_of(words, n)
    out, at = [], 0
    for size in counts.tolist():
        if size >= n:
            out.append(np.unique(runs[at : at + size - n + 1]))
        elif size:
            out.append(mix64(runs_of(words[at : at + size], size) + np.uint64(size)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += size
    return out


def signatures(sets: list[np.ndarray], k: int, seed: int = 11) -> np.ndarray:
    """The k minimum hashes (uint32) of each non-empty set, a row per set."""
    grams = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    rng = np.random.default_rng(seed)
    factors = rng.integers(0, 1 << 31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shifts = rng.integers(0, 1 << 32, k, dtype=np.uint64).astype(np.uint32)
    out = np.empty((len(sets), k), np.uint32)
    for i in range(k):
        out[:, i] = np.minimum.reduceat(grams * factors[i] + shifts[i], starts)
    return out


def row_key(key: str = "doc_id", text: str = "text") -> Column:
    return F.coalesce(F.col(key).cast("long"), F.xxhash64(text))


def sketch(docs: DataFrame, bands: int, rows: int = ROWS, n: int = NGRAM) -> DataFrame:
    """__key, __text (a hash of it), __named (whether the row has an id), set_a and set_b (of the n-gram set; null if there is none), size, short (one byte per
    minimum hash) and bands (a hash each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix64(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            at = 0
            for texts in sub_batches(batch.column(2)):
                sets = gram_sets(texts, n)
                some = [i for i, s in enumerate(sets) if len(s)]
                short: list = [None] * len(sets)
                banded: list = [None] * len(sets)
                if some:
                    mins = signatures([sets[i] for i in some], bands * rows)
                    packed = np.zeros((len(some), bands), np.uint64) + salt
                    for r in range(rows):
                        packed = mix64(packed * np.uint64(0x100000001B3) + mins[:, r::rows][:, :bands].astype(np.uint64))
                    for j, i in enumerate(some):
                        short[i] = (mins[j] & np.uint32(255)).astype(np.uint8).tobytes()
                        banded[i] = packed[j].view(np.int64)
                part = batch.slice(at, len(texts))
                at += len(texts)
                with np.errstate(over="ignore"):
                    a = [int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else None for s in sets]
                    b = [int(mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64)) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(short, pa.binary()), pa.array(banded, pa.list_(pa.int64()))], names=["__key", "__text", "__named", "set_a", "set_b", "size", "short", "bands"])

    fed = docs.select(row_key().alias("__key"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("__text"), utf8().alias("__raw"), F.col("doc_id").isNotNull().alias("__named"))
    return fed.mapInArrow(lean(run), "__key long, __text long, __named boolean, set_a long, set_b long, size long, short binary, bands array<long>")


def _forest(linked: np.ndarray) -> np.ndarray:
    """Of a symmetric boolean matrix, the least index that each row reaches."""
    roots = np.arange(len(linked))
    while True:
        then = np.minimum(roots, np.where(linked, roots[None, :], len(roots)).min(axis=1, initial=len(roots)))
        then = then[then]
        if (then == roots).all():
            return roots
        roots = then


def _alike(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Pairs of rows of signature bytes that agree in a share of at least `least`."""
    out = np.zeros((len(a), len(b)), bool)
    need = math.ceil(least * a.shape[1])
    for i in range(len(a)):
        out[i] = (b == a[i]).sum(axis=1) >= need
    return out


def _dealt(pieces: DataFrame, group: str, blocks: Column, small: Column, units: int) -> DataFrame:
    """Adds __unit and __side: groups of one block share units with others; a larger group's members get a block by a hash
    and go to the unit of every pair of blocks (side 0: the lower block)."""
    placed = pieces.withColumn("__n", blocks).withColumn("__b", F.pmod(F.xxhash64("cid", F.lit(3)), F.col("__n")))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1), lambda o: F.struct(
        F.xxhash64(F.col(group), F.least(o, F.col("__b")), F.greatest(o, F.col("__b"))).alias("unit"), F.when(F.col("__b") <= o, 0).otherwise(1).alias("side"), (F.col("__b") == o).alias("own")))
    alone = placed.where(small).withColumns({"__unit": F.pmod(F.xxhash64(group), F.lit(units)), "__side": F.lit(0), "__own": F.lit(True)})
    spread = placed.where(~small).withColumn("__p", F.explode(pairs)).withColumns({"__unit": F.col("__p.unit"), "__side": F.col("__p.side"), "__own": F.col("__p.own")}).drop("__p")
    return alone.unionByName(spread).drop("__n", "__b")


def coarse_groups(classes: DataFrame, least: float) -> DataFrame:
    """(node, root): classes that share a bucket and have signatures alike, and whom these reach."""
    posted = classes.select("cid", F.explode("bands").alias("bucket"))
    full = posted.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    met = saved(posted.join(full, "bucket"), "buckets")
    if met.isEmpty():
        return met.select(F.col("cid").alias("node"), F.col("cid").alias("root"))
    with_short = met.join(classes.select("cid", "short"), "cid")
    units = max(1, met.count() // BUCKET_BLOCK)
    dealt = _dealt(with_short, "bucket", F.ceil(F.col("members") / BUCKET_BLOCK).cast("long"), F.col("members") <= BUCKET_BLOCK, units)

    def link(group: pa.Table) -> pa.Table:
        cid = group["cid"].to_numpy()
        sig = np.frombuffer(b"".join(group["short"].to_pylist()), np.uint8).reshape(len(cid), -1)
        bucket, side = group["bucket"].to_numpy(), group["__side"].to_numpy()
        hi, lo = [], []

        def pairs(i: np.ndarray, j: np.ndarray) -> None:
            good = (sig[i] == sig[j]).sum(axis=1) >= least * sig.shape[1]
            hi.append(np.maximum(cid[i[good]], cid[j[good]]))
            lo.append(np.minimum(cid[i[good]], cid[j[good]]))

        order = np.lexsort((cid, bucket))
        starts = np.flatnonzero(np.diff(bucket[order], prepend=bucket[order][0] - 1 if len(order) else 0) != 0) if len(order) else np.zeros(0, np.int64)
        starts[:1] = 0
        sizes = np.diff(np.append(starts, len(order)))
        small = np.repeat(sizes <= 32, sizes)
        for d in range(1, 32):  # neighbours at distance d in one small bucket
            i = np.flatnonzero(small[:-d] & (bucket[order][:-d] == bucket[order][d:])) if len(order) > d else np.zeros(0, np.int64)
            if not len(i):
                break
            pairs(order[i], order[i + d])
        for s, n in zip(starts[sizes > 32].tolist(), sizes[sizes > 32].tolist()):
            rows = order[s : s + n]
            left, right = rows[side[rows] == 0], rows[side[rows] == 1]
            if len(right):
                linked = np.zeros((n, n), bool)
                linked[: len(left), len(left) :] = _alike(sig[left], sig[right], least)
                rows, linked = np.concatenate([left, right]), linked | linked.T
            else:
                linked = _alike(sig[rows], sig[rows], least)
            by = np.argsort(cid[rows], kind="stable")
            rows, linked = rows[by], linked[np.ix_(by, by)]
            root = _forest(linked)
            told = np.flatnonzero(root != np.arange(n))
            hi.append(cid[rows[told]])
            lo.append(cid[rows[root[told]]])
        pairs_ = np.unique(np.stack([np.concatenate(hi), np.concatenate(lo)], 1), axis=0) if hi else np.zeros((0, 2), np.int64)
        return pa.table({"a": pairs_[:, 0], "b": pairs_[:, 1]})

    edges = dealt.select("__unit", "cid", "bucket", "__side", "short").groupBy("__unit").applyInArrow(link, "a long, b long")
    return components(edges)


def _links(a: list[np.ndarray], b: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which sets of a and of b have a Jaccard similarity of at least threshold, by counting shared n-grams exactly."""
    na, nb = np.array([len(s) for s in a]), np.array([len(s) for s in b])
    all_a, all_b = np.concatenate(a), np.concatenate(b)
    owner_a, owner_b = np.repeat(np.arange(len(a)), na), np.repeat(np.arange(len(b)), nb)
    shared = np.intersect1d(all_a, all_b)
    counted = np.zeros((len(a), len(b)), np.float32)
    keep_a, keep_b = np.isin(all_a, shared), np.isin(all_b, shared)
    at_a, at_b = np.searchsorted(shared, all_a[keep_a]), np.searchsorted(shared, all_b[keep_b])
    own_a, own_b = owner_a[keep_a], owner_b[keep_b]
    if a is b:  # n-grams of one set alone link nothing
        often = np.bincount(at_a, minlength=len(shared)) > 1
        places = np.cumsum(often) - 1
        good = often[at_a]
        at_a, own_a = places[at_a[good]], own_a[good]
        at_b, own_b = at_a, own_a
        total = int(often.sum())
    else:
        total = len(shared)
    order_a, order_b = np.argsort(at_a, kind="stable"), np.argsort(at_b, kind="stable")
    at_a, own_a, at_b, own_b = at_a[order_a], own_a[order_a], at_b[order_b], own_b[order_b]
    step = 4096
    for k in range(0, total, step):
        sa, sb = slice(*np.searchsorted(at_a, [k, k + step])), slice(*np.searchsorted(at_b, [k, k + step]))
        width = min(step, total - k)
        ma, mb = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        ma[own_a[sa], at_a[sa] - k] = 1
        mb[own_b[sb], at_b[sb] - k] = 1
        counted += ma @ mb.T
    union = na[:, None] + nb[None, :] - counted
    return counted >= threshold * union - 1e-6


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, n: int = NGRAM) -> DataFrame:
    """__key, __text (which row of docs it is), __named, class_id, n_links, and __first: whether it stands for its class."""
    bands = bands_for(threshold, recall)
    sketched = saved(sketch(docs, bands, ROWS, n), "sketched")
    sets = sketched.where("size > 0")
    classes = saved(
        sets.groupBy("set_a", "set_b", "size").agg(F.min(F.struct("__key", "__text")).alias("rep"), F.count("*").alias("copies"), F.first("short").alias("short"), F.first("bands").alias("bands"))
        .withColumn("cid", F.xxhash64("set_a", "set_b", "size")), "classes")
    expected = threshold + (1 - threshold) / 256
    least = max(0.0, expected - 5 * math.sqrt(expected * (1 - expected) / (bands * ROWS)))
    grouped = saved(coarse_groups(classes.select("cid", "short", "bands"), least), "groups")
    member = grouped.join(classes.select("cid", "rep", "copies", "size"), grouped["node"] == F.col("cid")).select("cid", "root", "rep", "copies", "size")
    sized = grouped.join(classes.select("cid", "size"), grouped["node"] == F.col("cid")).groupBy("root").agg(F.count("*").alias("members"), F.sum("size").alias("grams"))
    member = saved(member.join(sized, "root"), "members")
    # Their full sets, from the texts.
    wanted = member.select(F.col("rep.__key").alias("__key"), "cid")

    def sets_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in sub_batches(batch.column(1)):
                made = gram_sets(texts, n)
                ids = batch.column(0).slice(at, len(texts))
                at += len(texts)
                with np.errstate(over="ignore"):
                    a = [int(s.sum(dtype=np.uint64).view(np.int64)) for s in made]
                yield pa.RecordBatch.from_arrays([ids, pa.array(a, pa.int64()), pa.array([s.tobytes() for s in made], pa.binary())], names=["cid", "set_a", "grams"])

    fed = docs.select(row_key().alias("__key"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("__text"), utf8().alias("__raw"))
    exact = fed.join(member.select(F.col("rep.__key").alias("__key"), F.col("rep.__text").alias("__text"), "cid").hint("shuffle_hash"), ["__key", "__text"])
    grams = exact.select("cid", "__raw").mapInArrow(lean(sets_again), "cid long, set_a long, grams binary").select("cid", F.col("grams").alias("set")).dropDuplicates(["cid"])
    units = max(1, member.count() // (BLOCK // 2)) if not grouped.isEmpty() else 1
    n_blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("long")
    dealt = _dealt(member.select("cid", "root", "copies", "members", "grams"), "root", n_blocks, n_blocks <= 1, units)

    def verify(group: pa.Table) -> pa.Table:
        cid, copies, side, own = group["cid"].to_numpy(), group["copies"].to_numpy().astype(np.float64), group["__side"].to_numpy(), group["__own"].to_numpy(zero_copy_only=False)
        by = np.argsort(cid, kind="stable")
        cid, copies, side, own = cid[by], copies[by], side[by], own[by]
        raw = group["set"].to_pylist()
        made = [np.frombuffer(raw[i], np.uint64) for i in by]
        if own.all():
            linked = _links(made, made, threshold) if len(made) > 1 else np.zeros((len(made), len(made)), bool)
            np.fill_diagonal(linked, False)
        else:
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            linked = np.zeros((len(cid), len(cid)), bool)
            if len(left) and len(right):
                linked[np.ix_(left, right)] = _links([made[i] for i in left], [made[i] for i in right], threshold)
                linked |= linked.T
        root = _forest(linked)
        return pa.table({"cid": cid, "lead": cid[root], "links": (linked @ copies).astype(np.int64)})

    checked = saved(dealt.join(grams, "cid").select("__unit", "cid", "copies", "__side", "__own", "set").groupBy("__unit").applyInArrow(verify, "cid long, lead long, links long"), "checked")
    roots = components(checked.where("cid <> lead").select(F.col("cid").alias("a"), F.col("lead").alias("b")))
    links = checked.groupBy("cid").agg(F.sum("links").alias("links"))
    named = classes.select("cid", "set_a", "set_b", "size", "rep", "copies").join(roots.withColumnRenamed("node", "cid"), "cid", "left").join(links, "cid", "left")
    named = named.withColumn("root", F.coalesce("root", "cid"))
    heads = named.groupBy("root").agg(F.min("rep").alias("head"))
    told = named.join(heads, "root").select("set_a", "set_b", F.col("size").alias("size"), "head", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    told = saved(told, "told")
    alone = sketched.where("size = 0").select("__key", "__text", "__named", F.col("__key").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("__first"))
    rest = sets.select("__key", "__text", "__named", "set_a", "set_b", "size").join(told, ["set_a", "set_b", "size"]).select(
        "__key", "__text", "__named", F.col("head.__key").alias("class_id"), "n_links", ((F.col("head.__key") == F.col("__key")) & (F.col("head.__text") == F.col("__text"))).alias("__first"))
    return rest.unionByName(alone)


def classes_of(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id and n_links of every row of docs."""
    return join(docs.select("doc_id", "text"), **options).select(F.when(F.col("__named"), F.col("__key")).alias("doc_id"), "class_id", "n_links")


@shielded
def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stand for their class, each once; rows without words all stay."""
    keyed = docs.withColumns({"__key": row_key(), "__text": F.coalesce(F.xxhash64("text"), F.lit(0))})
    kept = saved(join(docs.select("doc_id", "text"), **options).where("__first").groupBy("__key", "__text").agg(F.count("*").alias("__rows"), F.max("n_links").alias("__links")), "kept")
    out = keyed.join(kept.hint("shuffle_hash"), ["__key", "__text"])
    again = kept.where("__rows > 1 and __links > 0")
    if not again.isEmpty():  # a row that comes again whole is its own copy
        many = out.where((F.col("__rows") > 1) & (F.col("__links") > 0))
        first = F.min_by(F.struct(*[f"`{c}`" for c in many.columns]), F.to_json(F.struct(*[f"`{c}`" for c in docs.columns if c != "text"])))
        many = many.groupBy(F.col("__key").alias("__k"), F.col("__text").alias("__t")).agg(first.alias("__row")).select("__row.*")
        out = out.where(~((F.col("__rows") > 1) & (F.col("__links") > 0))).unionByName(many)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
