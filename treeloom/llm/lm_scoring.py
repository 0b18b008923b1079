"""Scores of texts under a causal self-attention model over subword ids, beside an add-one unigram base.

Words (ASCII letters lower-cased, white space of no further account) are cut greedily into the public vocabulary's short,
frequent subwords; a blank is the last byte of a word's last subword. Pairs of subwords that the training documents have most
often are units of their own, so that a text has fewer places to predict. One attention layer over a window of the last tokens and
one rectified layer predict the next unit among all, by its class and its place in the class, so the product over a text is
a probability of the text. Windows overlap by half: each scores its second half, batched and masked, with its first half as
context, so every unit is scored once.

All weights are trained in numpy on every target of every window of every training document: the documents are cut once, their
ids written, and dealt over ROUNDS rounds (a small corpus goes over all of them several times, in rounds of their own); in a round every partition makes its steps from the broadcast weights over its share
of the round, and the weights (of fixed size) are averaged by tokens in a tree. Corpus-wide counts of subwords and their pairs
only say which pairs are joined, which units share a class and how the biases start. The counts of words cover all training documents; they meet
texts in two ways: words that make up at least 1 / HOT_SHARE of all tokens (so at most HOT_SHARE of them) are broadcast, all
others are joined by hash.

Cases: a null text counts as empty and has one token, its end; very long texts go window by window; repeated rows repeat
their result; without training documents every count is 0 and the model is as it was drawn, near uniform; an empty table gives
an empty result; further columns are not read. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import copy
import functools
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import default_path
from .common import _SPACE, crc_rest, forget, mix64, saved, utf8
from .substring_dedup import _raws

HOT_SHARE = 1 << 21
MERGES = 3000
LONGEST = 4
CLASSES = 64
WIDTH, KEYS, VALUES, HIDDEN = 16, 8, 16, 29
#: Columns of the rectified layer's output: what it has, a one for the biases, and zeros up to a multiple of eight.
COLUMNS = -(-(HIDDEN + 1) // 8) * 8
HALF = 8
BATCH = 512
#: Bytes of text that a task has in hand at once (a longer single text is taken alone).
READ_CHARS = 1_000_000
ROUNDS = 8
#: Windows of a step; a small corpus is gone over until about ENOUGH windows were seen, MOST_PASSES times at most.
STEP_WINDOWS = 512
ENOUGH, MOST_PASSES = 1_200_000, 10
RATE = 0.03
#: So many of the most frequent pairs of subwords, each met LEAST_MET times or more, are units of their own.
JOINS, LEAST_MET = 2000, 400
#: Logits are held within this, so that no sum of their exponentials leaves the single precision.
MOST_LOGIT, LEAST_SUM = 80.0, np.float32(1e-30)
END_WORD = np.uint64(0x5EED)


class Subwords:
    """Greedy longest match of byte strings of up to LONGEST bytes, for whole buffers at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        from .bpe import SUFFIX, byte_letters

        byte_of = {c: b for b, c in enumerate(byte_letters())}
        names = sorted(vocab, key=vocab.get)[: 512 + MERGES]
        strings = {bytes([b]) for b in range(256)}
        for name in names:
            ended = name.endswith(SUFFIX)
            body = bytes(byte_of[c] for c in (name[: -len(SUFFIX)] if ended else name))
            if len(body) + ended <= LONGEST and not _SPACE[np.frombuffer(body, np.uint8)].any():
                strings.add(body + b" " * ended)
        self.strings = sorted(strings)
        self.end, self.begin = len(self.strings), len(self.strings) + 1
        self.size = len(self.strings) + 2
        self.tables = []
        ids = {s: i for i, s in enumerate(self.strings)}
        for n in range(LONGEST, 1, -1):
            codes = np.array([int.from_bytes(s, "big") for s in self.strings if len(s) == n], np.uint64)
            own = np.array([ids[s] for s in self.strings if len(s) == n], np.int32)
            for factor in np.random.default_rng(n).integers(1, 1 << 62, 10_000, dtype=np.uint64) * np.uint64(2) + np.uint64(1):
                slots = (codes * factor) >> np.uint64(46)
                if len(np.unique(slots)) == len(codes):
                    break
            else:
                raise RuntimeError("no collision-free table found")
            keys, found = np.zeros(1 << 18, np.uint64), np.zeros(1 << 18, np.int32)
            keys[slots], found[slots] = codes, own
            self.tables.append((n, factor, keys, found))
        self.single = np.array([ids[bytes([b])] for b in range(256)], np.int32)

    def cut(self, letters: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all subwords of the words at [begins, ends], ends being the blank after each; and where each begins."""
        wide = letters.astype(np.uint64)
        code = wide
        ids, sizes = self.single[letters], np.ones(len(letters), np.int8)
        for n, factor, keys, found in reversed(self.tables):
            code = (code[:-1] << np.uint64(8)) | wide[n - 1 :]
            slot = (code * factor) >> np.uint64(46)
            hit = np.flatnonzero(keys[slot] == code)
            ids[hit] = found[slot[hit]]
            sizes[hit] = n
        starts = np.zeros(len(letters) + LONGEST, bool)
        at, last = begins, ends
        while len(at):
            starts[at] = True
            at = at + sizes[at]
            more = at <= last
            at, last = at[more], last[more]
        where = np.flatnonzero(starts)
        return ids[where], where


@functools.lru_cache(2)
def subwords(path: str) -> Subwords:
    return Subwords(path)


class Read:
    """Texts as word hashes and as subword ids, each text's ids ending with the end."""

    def __init__(self, raws: list[bytes], units: Subwords):
        letters = np.frombuffer(b" " + b" ".join(raws).lower() + b" ", np.uint8)
        space = _SPACE[letters]
        letters = np.where(space, np.uint8(32), letters)
        begins = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
        offsets = np.cumsum([1] + [len(r) + 1 for r in raws])
        inside = np.flatnonzero(~space)
        first = np.searchsorted(inside, begins)
        place = np.arange(len(inside)) - np.repeat(first, ends - begins)
        mixed = mix64((letters[inside].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64))
        self.words = mix64(np.add.reduceat(mixed, first)) if len(first) else np.zeros(0, np.uint64)
        self.bounds = np.searchsorted(begins, offsets)
        ids, where = units.cut(letters, begins, ends) if len(begins) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        cuts = np.searchsorted(where, offsets)
        self.ids = np.insert(ids, cuts[1:], units.end)
        self.sizes = np.diff(cuts) + 1


class Model:
    """One causal attention layer, one rectified layer, and a softmax over all subwords in two steps: the class, then the
    member of the class. All of it is learned; classes are of equal size."""

    def __init__(self, subwords: int, seed: int = 7, joined: np.ndarray = np.zeros(0, np.int64)):
        self.joined, units = joined, subwords + len(joined)
        self.units, width = units, -(-units // CLASSES)
        rng = np.random.default_rng(seed)
        small = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        self.p = {
            "e": small(0.4, units, WIDTH),
            "pos": small(0.1, 2 * HALF, WIDTH),
            "q": small(WIDTH**-0.5, WIDTH, KEYS),
            "k": small(WIDTH**-0.5, WIDTH, KEYS),
            "v": small(WIDTH**-0.5, WIDTH, VALUES),
            "w": small(WIDTH**-0.5, WIDTH + VALUES, HIDDEN),
            "wb": np.zeros(HIDDEN, np.float32),
            "c": small(0.3 * HIDDEN**-0.5, HIDDEN, CLASSES),
            "cb": np.zeros(CLASSES, np.float32),
            "m": small(0.3 * HIDDEN**-0.5, CLASSES, HIDDEN, width),
            "mb": np.zeros((CLASSES, width), np.float32),
        }
        self.place(np.arange(units), np.ones(units))

    def place(self, order: np.ndarray, counts: np.ndarray) -> None:
        """Units in this order fill the classes; biases start as logs of the units' shares."""
        width = self.p["mb"].shape[1]
        self.class_of, self.member_of = np.empty(self.units, np.uint8), np.empty(self.units, np.int64)
        self.class_of[order], self.member_of[order] = np.divmod(np.arange(self.units), width)
        share = (counts + 0.5) / (counts + 0.5).sum()
        within = np.bincount(self.class_of, share, CLASSES)
        self.p["cb"] = np.log(within + 1e-30).astype(np.float32)
        self.p["mb"] = np.full((CLASSES, width), -1e4, np.float32)  # a place without a unit has no probability
        self.p["mb"][self.class_of, self.member_of] = np.log(share / within[self.class_of])

    def windows(self, ids: np.ndarray, sizes: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all texts: inputs (windows, 2 * HALF), targets (windows, HALF; -1 where there is none), and whether a window
        is its text's first. The input at a place is the token before its target."""
        counts = -(-sizes // HALF)
        text = np.repeat(np.arange(len(sizes)), counts)
        number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        start = (np.cumsum(sizes) - sizes)[text] + number * HALF
        first, last = number == 0, np.flatnonzero(number == counts[text] - 1)
        if not len(ids):
            return np.zeros((0, 2 * HALF), np.int32), np.zeros((0, HALF), np.int32), first
        inputs = np.take(ids, (start - HALF - 1)[:, None] + np.arange(2 * HALF), mode="clip")
        inputs[first, HALF] = begin
        inputs[number == 1, 0] = begin
        targets = np.take(ids, start[:, None] + np.arange(HALF), mode="clip")
        late = (number[last] * HALF)[:, None] + np.arange(HALF)
        targets[last] = np.where(late < sizes[text[last]][:, None], targets[last], -1)
        return inputs, targets, first

    def attend(self, inputs: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Embeddings of every place; for every place of the second half its query against embeddings (the products with queries
        and keys in one), its masked weights, and its own embedding beside those gathered by these weights, a one, and zeros."""
        p, n = self.p, len(inputs)
        x = np.take(p["e"], inputs, axis=0, mode="clip")
        x += p["pos"]
        u = (x[:, HALF:].reshape(-1, WIDTH) @ (p["q"] @ p["k"].T * np.float32(KEYS**-0.5))).reshape(n, HALF, WIDTH)
        s = np.matmul(u, x.transpose(0, 2, 1))
        np.clip(s, -30, 30, out=s)
        np.exp(s, out=s)
        s *= MASK
        s[first, :, :HALF] = 0
        s *= 1 / summed(s)
        z = np.zeros((n, HALF, 2 * WIDTH + 8), np.float32)
        z[:, :, :WIDTH], z[:, :, 2 * WIDTH] = x[:, HALF:], 1
        np.matmul(s, x, out=z[:, :, WIDTH : 2 * WIDTH])
        return x, u, s, z.reshape(n * HALF, -1)

    def inward(self) -> np.ndarray:
        """The rectified layer's weights for what attend gives (values are a product of what is gathered), its biases, and a one."""
        out = np.zeros((2 * WIDTH + 8, COLUMNS), np.float32)
        out[:WIDTH, :HIDDEN], out[WIDTH : 2 * WIDTH, :HIDDEN] = self.p["w"][:WIDTH], self.p["v"] @ self.p["w"][WIDTH:]
        out[2 * WIDTH, :HIDDEN], out[2 * WIDTH, HIDDEN] = self.p["wb"], 1
        return out

    def hidden(self, z: np.ndarray, inward: np.ndarray) -> np.ndarray:
        """The rectified layer of the places in hand, a column of ones for biases, and zeros."""
        h = z @ inward
        return np.maximum(h, 0, out=h)

    def outward(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of classes and of members, each with its biases as a last row."""
        c, m = np.zeros((COLUMNS, CLASSES), np.float32), np.zeros((CLASSES, COLUMNS, self.p["m"].shape[2]), np.float32)
        c[:HIDDEN], c[HIDDEN], m[:, :HIDDEN], m[:, HIDDEN] = self.p["c"], self.p["cb"], self.p["m"], self.p["mb"]
        return c, m

    def log10s(self, ids: np.ndarray, sizes: np.ndarray, begin: int) -> np.ndarray:
        """Of each text its log10 probability."""
        out = np.zeros(len(ids))
        inputs, targets, first = self.windows(ids, sizes, begin)
        inward, (to_class, to_member) = self.inward(), self.outward()
        done = 0
        for a in range(0, len(inputs), BATCH):
            y = targets[a : a + BATCH].ravel()
            *_, z = self.attend(inputs[a : a + BATCH], first[a : a + BATCH])
            real = np.flatnonzero(y >= 0)
            order = np.argsort(self.class_of[y[real]], kind="stable")
            h = self.hidden(np.take(z, real[order], axis=0, mode="clip"), inward)
            y = y[real[order]]
            own = self.class_of[y]
            told = np.empty(len(y), np.float32)
            told[order] = picked(h @ to_class, own) + picked(members(h, to_member, own), self.member_of[y])
            out[done : done + len(y)] = told
            done += len(y)
        starts = np.cumsum(sizes) - sizes
        return np.add.reduceat(out, starts) / np.log(10) if len(sizes) else np.zeros(0)

    def fresh(self) -> dict:
        """Adam's state before the first step: sums of slopes and of their squares that fade, not yet scaled."""
        return {"step": 0, "mean": {n: np.zeros_like(w) for n, w in self.p.items()}, "var": {n: np.zeros_like(w) for n, w in self.p.items()}}

    def slopes(self, x_ids: np.ndarray, targets: np.ndarray, one: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean cross entropy of the next subword, over all targets of these windows."""
        p, y = self.p, targets.ravel()
        x, u, s, z = self.attend(x_ids, one)
        live = np.flatnonzero(y >= 0)
        live = live[np.argsort(self.class_of[y[live]], kind="stable")]
        y = y[live]
        own, rows, each = self.class_of[y], np.arange(len(y)), np.float32(1 / max(len(y), 1))
        inward, (to_class, to_member) = self.inward(), self.outward()
        z = np.take(z, live, axis=0, mode="clip")
        h = self.hidden(z, inward)
        told, among = softmax(h @ to_class, each), softmax(members(h, to_member, own), each)
        told[rows, own] -= each
        among[rows, self.member_of[y]] -= each
        g, g_class, g_member = {}, h.T @ told, np.zeros_like(to_member)
        g["c"], g["cb"] = g_class[:HIDDEN], g_class[HIDDEN]
        d_h = told @ to_class.T
        for c, a, b in parts(own):
            np.matmul(h[a:b].T, among[a:b], out=g_member[c])
            d_h[a:b] += among[a:b] @ to_member[c].T
        g["m"], g["mb"] = g_member[:, :HIDDEN], g_member[:, HIDDEN]
        d_h *= h > 0
        g_in = (z.T @ d_h)[:, :HIDDEN]
        g["w"], g["wb"] = np.concatenate([g_in[:WIDTH], p["v"].T @ g_in[WIDTH : 2 * WIDTH]]), g_in[2 * WIDTH]
        n = len(x_ids)
        d_z = np.zeros((n * HALF, 2 * WIDTH), np.float32)
        d_z[live] = d_h[:, :HIDDEN] @ inward[: 2 * WIDTH, :HIDDEN].T
        d_z = d_z.reshape(n, HALF, 2 * WIDTH)
        # What comes back through the weights (with the slopes of what they gather) and through the products (with the queries).
        back, by = np.empty((n, 2 * HALF, WIDTH), np.float32), np.empty((n, 2 * HALF, 2 * HALF), np.float32)
        back[:, :HALF], back[:, HALF:] = d_z[:, :, WIDTH:], u
        d_s = np.matmul(back[:, :HALF], x.transpose(0, 2, 1))
        d_s *= s
        by[:, :HALF] = s
        s *= summed(d_s)
        d_s -= s
        by[:, HALF:] = d_s
        d_x = np.matmul(by.transpose(0, 2, 1), back)
        d_u = np.matmul(d_s, x).reshape(-1, WIDTH)
        d_u *= np.float32(KEYS**-0.5)
        g_qk = x[:, HALF:].reshape(-1, WIDTH).T @ d_u
        g["q"], g["k"], g["v"] = g_qk @ p["k"], g_qk.T @ p["q"], g_in[WIDTH : 2 * WIDTH] @ p["w"][WIDTH:].T
        d_x[:, HALF:] += d_z[:, :, :WIDTH]
        d_x[:, HALF:] += (d_u @ (p["k"] @ p["q"].T)).reshape(n, HALF, WIDTH)
        g["pos"] = (np.ones(n, np.float32) @ d_x.reshape(n, -1)).reshape(2 * HALF, WIDTH)
        g["e"] = gathered(x_ids.ravel(), d_x.reshape(-1, WIDTH), self.units)
        return g

    def descend(self, x_ids: np.ndarray, targets: np.ndarray, one: np.ndarray, state: dict, pace: float) -> None:
        """One step of Adam."""
        g = self.slopes(x_ids, targets, one)
        state["step"] += 1
        step = state["step"]
        spread = math.sqrt(0.01 / (1 - 0.99**step))
        pace, least = np.float32(pace * 0.1 / (1 - 0.9**step) / spread), np.float32(1e-8 / spread)
        for n, whole in self.p.items():
            flat = [v.reshape(-1) for v in (whole, state["mean"][n], state["var"][n], np.ascontiguousarray(g[n]))]
            for a in range(0, whole.size, 1 << 14):  # what fits the cache
                w, mean, var, d = (v[a : a + (1 << 14)] for v in flat)
                mean *= np.float32(0.9)
                mean += d
                var *= np.float32(0.99)
                np.multiply(d, d, out=d)
                var += d
                np.sqrt(var, out=d)
                d += least
                np.divide(mean, d, out=d)
                d *= pace
                w -= d

    def set_classes(self, counts: np.ndarray) -> None:
        """Classes of units with alike neighbours, from the counts of pairs of subwords (before, after): halved again and again
        along the leading direction of what is in hand, until each part is a class or less. A joined pair has the neighbours
        before its first and after its last subword."""
        often = counts.sum(axis=0, dtype=np.int64)
        # Neighbours are told apart only if they are frequent: 128 to either side.
        frequent = np.argsort(-often, kind="stable")[:128]
        one, two = np.divmod(self.joined, len(counts))
        follow, come = counts[:, frequent], counts[frequent].T
        both = np.sqrt(np.hstack([np.concatenate([follow, follow[two]]), np.concatenate([come, come[one]])]).astype(np.float32))
        both /= np.maximum(np.linalg.norm(both, axis=1), 1)[:, None]
        met = counts[one, two].astype(np.int64)
        np.subtract.at(often, one, met)
        np.subtract.at(often, two, met)
        often = np.concatenate([np.maximum(often, 0), met])
        width = self.p["mb"].shape[1]
        order = np.arange(self.units)
        parts_left = [(0, CLASSES)]
        while parts_left:
            a, z = parts_left.pop()
            if z - a < 2:
                continue
            half = (a + z) // 2
            here = order[a * width : z * width]
            rows = both[here] - both[here].sum(axis=0) / max(len(here), 1)
            order[a * width : z * width] = here[np.argsort(rows @ np.linalg.eigh(rows.T @ rows)[1][:, -1], kind="stable")]
            parts_left += [(a, half), (half, z)]
        self.place(order, often)


class Joins:
    """Joins neighbouring subwords to one unit where their pair is one of the model's, from the left of each run of such pairs."""

    def __init__(self, subwords: int, joined: np.ndarray):
        self.subwords, self.found = subwords, None
        if len(joined):
            self.found = np.full(subwords * subwords, -1, np.int16)
            self.found[joined] = subwords + np.arange(len(joined))

    def __call__(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units of texts and their number in each, from subwords. The end is in no pair, so none reaches over two texts."""
        if self.found is None or len(ids) < 2:
            return ids, sizes
        unit = np.take(self.found, ids[:-1] * np.int32(self.subwords) + ids[1:])
        at = np.flatnonzero(unit >= 0)
        number = np.arange(len(at))
        begins = np.ones(len(at), bool)
        begins[1:] = at[1:] != at[:-1] + 1
        at = at[(number - np.maximum.accumulate(np.where(begins, number, 0))) % 2 == 0]
        out, stays = ids.copy(), np.ones(len(ids), bool)
        out[at], stays[at + 1] = unit[at], False
        return out[stays], np.add.reduceat(stays, np.cumsum(sizes) - sizes, dtype=np.int64)


def joined_of(pairs: np.ndarray, end: int) -> np.ndarray:
    """The JOINS most frequent pairs (before * subwords + after) met LEAST_MET times or more, without the end and the begin."""
    counts = pairs.copy().reshape(end + 2, end + 2)
    counts[end:], counts[:, end:] = 0, 0
    met = np.flatnonzero(counts.ravel() >= LEAST_MET)
    return met[np.argsort(-counts.ravel()[met].astype(np.int64), kind="stable")[:JOINS]]


def parts(classes: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(class, from, to) of the runs of sorted classes."""
    bounds = np.searchsorted(classes, np.arange(CLASSES + 1))
    return ((c, int(bounds[c]), int(bounds[c + 1])) for c in np.flatnonzero(np.diff(bounds)))


def summed(values: np.ndarray) -> np.ndarray:
    """Sums along the last axis, which stays."""
    return (values.reshape(-1, values.shape[-1]) @ np.ones(values.shape[-1], np.float32)).reshape(*values.shape[:-1], 1)


def members(h: np.ndarray, to_member: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Logits of the members of each row's class; rows come sorted by class."""
    out = np.empty((len(h), to_member.shape[2]), np.float32)
    for c, a, z in parts(classes):
        np.matmul(h[a:z], to_member[c], out=out[a:z])
    return out


def bounded(logits: np.ndarray) -> np.ndarray:
    """The logits, in place, none above MOST_LOGIT."""
    if len(logits) and logits.max() > MOST_LOGIT:
        np.minimum(logits, MOST_LOGIT, out=logits)
    return logits


def softmax(logits: np.ndarray, times: np.float32) -> np.ndarray:
    """Each row's probabilities, times this."""
    np.exp(bounded(logits), out=logits)
    logits *= times / np.maximum(summed(logits), LEAST_SUM)
    return logits


def picked(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each row the natural log of the probability of the place at."""
    told = bounded(logits)[np.arange(len(at)), at]
    np.exp(logits, out=logits)
    return told - np.log(np.maximum(summed(logits)[:, 0], LEAST_SUM))


def gathered(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of the values of each row from 0 to size; two neighbouring columns are added as one complex number."""
    half = values.shape[1] // 2
    out = np.zeros(size * half, np.complex64)
    np.add.at(out, (rows.astype(np.int64)[:, None] * half + np.arange(half)).ravel(), np.ascontiguousarray(values).view(np.complex64).ravel())
    return out.view(np.float32).reshape(size, -1)


MASK = (np.arange(2 * HALF)[None, :] <= np.arange(HALF, 2 * HALF)[:, None]).astype(np.float32)


def before(ids: np.ndarray, sizes: np.ndarray, begin: int) -> np.ndarray:
    """The token before each."""
    out = np.roll(ids, 1)
    out[np.cumsum(sizes) - sizes] = begin
    return out


def counted(docs: DataFrame, path: str, text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of all docs: (hash, n) of their words and ends, (pair, n) of neighbouring subwords, and (turn, ids) of every document,
    ids as 16-bit numbers. Sub-batches and tasks pre-aggregate; texts are read once, and what is found is saved."""

    def made(kind: int, keys: np.ndarray, n: np.ndarray, turns: pa.Array | None = None, ids: list[bytes] | None = None) -> pa.RecordBatch:
        size = len(keys)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(size, kind, np.int32)), pa.array(keys), pa.array(n), pa.nulls(size, pa.int32()) if turns is None else turns, pa.array(ids or [None] * size, pa.binary())],
            names=["kind", "key", "n", "turn", "ids"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = subwords(path)
        pairs = np.zeros(units.size**2, np.int32)
        for batch in batches:
            at = 0
            for raws in _raws(batch.column(1), READ_CHARS):
                read = Read(raws, units)
                words, n = np.unique(read.words, return_counts=True)
                words, n = np.append(words, END_WORD), np.append(n, len(raws))
                yield made(0, words.view(np.int64), n)
                met, n = np.unique(before(read.ids, read.sizes, units.begin).astype(np.int64) * units.size + read.ids, return_counts=True)
                pairs[met] += n.astype(np.int32)
                none = np.zeros(len(raws), np.int64)
                cuts = np.split(read.ids.astype(np.uint16), np.cumsum(read.sizes)[:-1])
                yield made(2, none, none, batch.column(0).slice(at, len(raws)), [c.tobytes() for c in cuts])
                at += len(raws)
        found = np.flatnonzero(pairs)
        for a in range(0, len(found), 1 << 16):
            yield made(1, found[a : a + (1 << 16)], pairs[found[a : a + (1 << 16)]].astype(np.int64))

    turn = F.pmod(F.xxhash64("doc_id", text), F.lit(ROUNDS)).cast("int")
    parts_of = saved(docs.select(turn.alias("turn"), utf8(text)).mapInArrow(run, "kind int, key long, n long, turn int, ids binary"), "parts")
    totals = saved(parts_of.where("kind < 2").groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    coded = saved(parts_of.where("kind = 2").select("turn", "ids"), "coded")  # the rounds read it again and again
    forget(parts_of)
    return totals.where("kind = 0").select(F.col("key").alias("hash"), "n"), totals.where("kind = 1").select(F.col("key").alias("pair"), "n"), coded


def train_on(coded: DataFrame, path: str, pairs: np.ndarray) -> Model:
    """A model of the documents of coded (turn, ids), whose pair counts are given. Only weights travel, and their size is fixed."""
    units = subwords(path)
    model = Model(units.size, joined=joined_of(pairs, units.end))
    counts = pairs.reshape(units.size, units.size)
    tokens = int(counts.sum(dtype=np.int64))
    if tokens:
        model.set_classes(counts)
        passes = min(MOST_PASSES, max(1, -(-ENOUGH * HALF // tokens)))
        shares = max(1, ROUNDS // passes)
        rounds = shares * passes
        for number in range(rounds):
            averaged(coded.where(F.col("turn") % shares == number % shares).select("ids"), model, path, RATE * (1 - 0.9 * number / rounds), number)
    return model


def averaged(docs: DataFrame, model: Model, path: str, rate: float, seed: int) -> int:
    """One round: steps over all windows of docs in every partition, then the mean of the weights by tokens. Returns the tokens."""
    names, shapes = list(model.p), [w.shape for w in model.p.values()]
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin = subwords(path).begin
        own = copy.copy(shared.value)
        own.p = {n: w.copy() for n, w in own.p.items()}
        joins = Joins(subwords(path).size, own.joined)
        state, seen, rng = own.fresh(), 0, np.random.default_rng([TaskContext.get().partitionId(), seed])
        for batch in batches:
            for raws in _raws(batch.column(0), READ_CHARS):
                ids = np.frombuffer(b"".join(raws), np.uint16).astype(np.int32)
                inputs, targets, first = own.windows(*joins(ids, np.array([len(r) // 2 for r in raws])), begin)
                seen += len(ids)
                mixed = rng.permutation(len(inputs))
                for a in range(0, len(mixed), STEP_WINDOWS):
                    pick = mixed[a : a + STEP_WINDOWS]
                    own.descend(inputs[pick], targets[pick], first[pick], state, rate * min(1.0, (state["step"] + 1) / 10))
        if seen:
            flat = np.concatenate([own.p[n].ravel() for n in names])
            yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([flat.tobytes()], pa.binary())], names=["tokens", "weights"])

    def add(a: tuple | None, b: tuple | None) -> tuple | None:
        return a if b is None else b if a is None else (a[0] + b[0], a[1] + b[1])

    told = docs.mapInArrow(run, "tokens long, weights binary").rdd.map(lambda r: (r[0], np.frombuffer(r[1], np.float32).astype(np.float64) * r[0]))
    total = told.treeAggregate(None, add, add)
    shared.unpersist()
    if total is None:
        return 0
    at = np.cumsum([0] + [int(np.prod(x)) for x in shapes])
    for i, n in enumerate(names):
        model.p[n] = (total[1][at[i] : at[i + 1]] / total[0]).reshape(shapes[i]).astype(np.float32)
    return total[0]


def score(docs: DataFrame, learn: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of docs, learning from the rows of learn."""
    path = path or default_path()
    units = subwords(path)
    spark = docs.sparkSession
    words, pair_counts, coded = counted(learn, path)
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    pairs = np.zeros(units.size**2, np.int32)
    met = pair_counts.toArrow()  # at most the square of the vocabulary's size, and fitted by no data
    pairs[met["pair"].to_numpy()] = np.minimum(met["n"].to_numpy(), np.iinfo(np.int32).max)
    model = train_on(coded, path, pairs)
    forget(coded)
    hot_rows = words.where(F.col("n") * HOT_SHARE >= F.lit(int(total))).toArrow()
    hot = hot_rows["hash"].to_numpy().view(np.uint64)
    by = np.argsort(hot)
    shared = spark.sparkContext.broadcast((model, hot[by], hot_rows["n"].to_numpy()[by]))
    ends = words.where(F.col("hash") == F.lit(int(END_WORD))).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known, n_known = shared.value
        cut = subwords(path)
        joins = Joins(cut.size, own.joined)
        row = TaskContext.get().partitionId() << 40
        logs = np.log10(n_known + 1.0)
        for batch in batches:
            at = 0
            for raws in _raws(batch.column(1), READ_CHARS):
                read = Read(raws, cut)
                place = np.minimum(np.searchsorted(known, read.words), max(len(known) - 1, 0))
                hit = known[place] == read.words if len(known) else np.zeros(len(read.words), bool)
                text = np.repeat(np.arange(len(raws)), np.diff(read.bounds))
                base = np.bincount(text[hit], logs[place[hit]], len(raws)) if len(known) else np.zeros(len(raws))
                found = np.bincount(text[hit], minlength=len(raws))
                rest = read.words[~hit].view(np.int64)
                cuts = np.concatenate([[0], np.cumsum(np.bincount(text[~hit], minlength=len(raws)))])
                tail = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(rest))
                told = own.log10s(*joins(read.ids, read.sizes), cut.begin)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(raws))), batch.column(0).slice(at, len(raws)), pa.array(np.diff(read.bounds) + 1), pa.array(found), pa.array(base), pa.array(told), tail], names=["row", "doc_id", "n_tokens", "found", "base", "score", "tail"])
                row += len(raws)
                at += len(raws)

    read = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8()).mapInArrow(run, "row long, doc_id long, n_tokens long, found long, base double, score double, tail array<long>"), "read")
    tails = read.select("row", F.explode("tail").alias("hash")).groupBy("row", "hash").agg(F.count("*").alias("times"))
    cold = words.where(F.col("n") * HOT_SHARE < F.lit(int(total)))
    found = tails.join(cold, "hash").groupBy("row").agg(F.sum(F.log10(F.col("n") + 1.0) * F.col("times")).alias("more"), F.sum("times").alias("also"))
    whole = read.drop("tail").join(found, "row", "left")
    spread = float(np.log10(float(total) + float(kinds) + 1.0))
    base = F.col("base") + F.coalesce("more", F.lit(0.0)) + F.lit(float(np.log10(ends + 1.0))) - F.col("n_tokens") * F.lit(spread)
    n_known = F.col("found") + F.coalesce("also", F.lit(0)) + F.lit(int(ends > 0))
    return whole.select("doc_id", "n_tokens", n_known.alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def held_out(modulus: int = 7, rest: int = 2):
    return crc_rest("doc_id", modulus) == rest
