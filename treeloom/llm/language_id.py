"""Language identification with a linear-chain conditional random field over words.

A word's evidence is the sum of learned weights of its affixes and letter n-grams (hashed; word borders are letters, so
n-grams at a border are affixes) and of its membership in learned lexicons. Learned transitions tie neighbouring words, and
forward-backward gives each word's distribution, so a code-switched text gets a label per word. A text's language is the one
with the largest mean over its words, and that mean is the score.

The field is trained in numpy on a bounded sample of labelled rows: of every language SAMPLE_DOCS distinct ones, whole texts, of
together SAMPLE_BYTES at most, of which each language has an equal share and at least one text; prediction reads every whole
text and shuffles nothing.

Cases: a null text, or one without a letter (of Unicode's category L), is `und` with score 0; very long texts are followed word by word to their end;
repeated rows repeat their result; ties go to the language that sorts first; without a labelled row everything is `und`;
an empty table gives an empty result; further columns pass through where asked for.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import sub_batches
from .common import crc_rest, lean, mix64, utf8

SAMPLE_DOCS = 400
SAMPLE_BYTES = 64_000_000
BUCKETS = 1 << 17
GRAMS = (1, 2, 3, 4, 5)
STEPS = 24
MEMO = 200_000
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of whole words."""
    return _grams(words)[2]


def _grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all words in one go: the bucket of every n-gram, the word it belongs to, and a hash of each word."""
    letters = np.frombuffer(b"".join([b"^" + w + b"$" for w in words]), np.uint8).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    room = np.repeat(ends, sizes) - np.arange(len(letters))  # letters from here to the word's end
    buckets, owners = [], []
    rolled = np.zeros(len(letters), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        rolled = rolled * np.uint64(0x100000001B3)
        rolled[: len(letters) - n + 1] += letters[n - 1 :]
        fits = room >= n
        if n == max(GRAMS):  # the longest only as affixes
            fits &= (room == n) | (np.arange(len(letters)) == ends[owner] - sizes[owner])
        at = np.flatnonzero(fits)
        buckets.append((mix64(rolled[at] + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(owner[at])
    place = np.arange(len(letters), dtype=np.uint64) - (ends - sizes)[owner].astype(np.uint64)
    whole = np.add.reduceat(mix64(letters * np.uint64(0x9E3779B97F4A7C15) + place), ends - sizes) if len(words) else np.zeros(0, np.uint64)
    return np.concatenate(buckets), np.concatenate(owners), whole


class Field:
    """A trained field: languages, n-gram weights, transitions, and per language the sorted hashes of its lexicon."""

    def __init__(self, langs: list[str]):
        n = len(langs)
        self.langs, self.weights = langs, np.zeros((BUCKETS, n), np.float32)
        self.moves, self.first = np.zeros((n, n)), np.zeros(n)
        self.lexicon = np.zeros(0, np.uint64)
        self.members = np.zeros((0, n), np.float32)
        self.trust = np.ones(n, np.float32)

    def evidence(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.langs)), np.float32)
        buckets, owners, whole = _grams(words)
        order = np.argsort(owners, kind="stable")
        buckets, counts = buckets[order], np.bincount(owners, minlength=len(words))
        starts = np.cumsum(counts) - counts
        out = np.add.reduceat(self.weights[buckets], starts, axis=0) / np.sqrt(counts)[:, None].astype(np.float32)
        return out + self.trust * self.listed(whole)

    def listed(self, whole: np.ndarray) -> np.ndarray:
        if not len(self.lexicon):
            return np.zeros((len(whole), len(self.langs)), np.float32)
        at = np.minimum(np.searchsorted(self.lexicon, whole), len(self.lexicon) - 1)
        return self.members[at] * (self.lexicon[at] == whole)[:, None]

    def passes(self, evidence: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward-backward over many texts at once (evidence: their words' rows, one text after the other). Of every word: its
        own factor, the forward message (its own factor included) and the backward message, each up to a factor per word."""
        n = len(self.langs)
        local = np.exp(evidence - evidence.max(axis=1, keepdims=True)).astype(np.float64) + 1e-30
        step, enter = self.moving()
        begins = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        begins, sizes = begins[order], sizes[order]
        active = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), side="right")
        ahead, behind = np.empty_like(local), np.ones_like(local)
        state = None
        for t, k in enumerate(active.tolist()):
            rows = begins[:k] + t
            state = local[rows] * (enter if t == 0 else state[:k] @ step)
            state /= state.sum(axis=1, keepdims=True)
            ahead[rows] = state
        back = np.ones((len(sizes), n))
        for t in range(len(active) - 1, 0, -1):
            k = active[t]
            rows = begins[:k] + t
            back[:k] = (local[rows] * back[:k]) @ step.T
            back[:k] /= back[:k].sum(axis=1, keepdims=True)
            behind[rows - 1] = back[:k]
        return local, ahead, behind

    def moving(self) -> tuple[np.ndarray, np.ndarray]:
        """Factors of a move from one word's language to the next one's, and of a text's first language."""
        return np.exp(self.moves - self.moves.max()), np.exp(self.first - self.first.max())

    def posteriors(self, evidence: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        _, ahead, behind = self.passes(evidence, sizes)
        ahead *= behind
        return ahead / ahead.sum(axis=1, keepdims=True)

    def slopes(self, evidence: np.ndarray, sizes: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the log probability of the labels gold: its gradient by the words' evidence, the moves and the first languages."""
        n = len(self.langs)
        local, ahead, behind = self.passes(evidence, sizes)
        post = ahead * behind
        post /= post.sum(axis=1, keepdims=True)
        begins = np.cumsum(sizes) - sizes
        miss = np.eye(n)[gold] - post
        inside = np.ones(len(gold), bool)
        inside[begins] = False
        then = np.flatnonzero(inside)
        told = np.zeros((n, n))
        np.add.at(told, (gold[then - 1], gold[then]), 1)
        joint = ahead[then - 1][:, :, None] * self.moving()[0] * (local[then] * behind[then])[:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        return miss, told - joint.sum(axis=0), miss[begins].sum(axis=0)


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").split()


def train(sample: list[tuple[str, str]], seed: int = 5, passes: int = 2, rate: float = 0.3, batch: int = 256) -> Field:
    """sample: (language, text). Sequences of STEPS words; every third one switches to another language within."""
    langs = sorted({lang for lang, _ in sample})
    field, n = Field(langs), len(langs)
    if not langs:
        return field
    rng = np.random.default_rng(seed)
    index: dict[bytes, int] = {}
    pieces: list[list[list[int]]] = [[] for _ in langs]
    counts: list[Counter] = [Counter() for _ in langs]
    for lang, text in sample:
        k = langs.index(lang)
        ids = [index.setdefault(w, len(index)) for w in words_of(text)]
        counts[k].update(ids)
        pieces[k] += [ids[i : i + STEPS] for i in range(0, len(ids), STEPS) if len(ids) - i >= STEPS or i == 0]
    words = list(index)
    if not words:
        return field
    buckets, owners, whole = _grams(words)
    order = np.argsort(owners, kind="stable")
    buckets, sizes = buckets[order], np.bincount(owners, minlength=len(words))
    starts = np.cumsum(sizes) - sizes
    scale = 1 / np.sqrt(sizes)
    # The lexicon: words seen often enough, with the log-odds of their languages.
    seen = np.stack([np.bincount(np.fromiter(c.keys(), np.int64, len(c)), np.fromiter(c.values(), np.float64, len(c)), len(words)) for c in counts], 1)
    share = (seen + 0.5) / (seen.sum(axis=0) + 0.5 * len(words))
    often = np.flatnonzero(seen.sum(axis=1) >= 5)
    often = often[np.argsort(whole[often])]
    field.lexicon = whole[often]
    odds = np.log(share[often]) - np.log(share[often]).mean(axis=1, keepdims=True)
    field.members = np.clip(odds, -2, 2).astype(np.float32)
    listed = field.listed(whole)
    every = [(k, p) for k in range(n) for p in pieces[k] if p]
    grad_w, grad_m, grad_t, grad_f = np.full((BUCKETS, n), 1e-6), np.full((n, n), 1e-6), np.full(n, 1e-6), np.full(n, 1e-6)
    for _ in range(passes):
        for at in range(0, len(every), batch):
            taken = [every[i] for i in rng.integers(0, len(every), batch)] if n else []
            rows, gold, lengths = [], [], []
            for k, piece in taken:
                own, tags = list(piece), [k] * len(piece)
                if n > 1 and rng.random() < 1 / 3:  # a switch to another language
                    other = int(rng.choice([j for j in range(n) if j != k and pieces[j]] or [k]))
                    if pieces[other]:
                        more = pieces[other][int(rng.integers(len(pieces[other])))]
                        cut = int(rng.integers(1, len(own) + 1))
                        own, tags = own[:cut] + more[cut:], [k] * cut + [other] * len(more[cut:])
                rows += own
                gold += tags
                lengths.append(len(own))
            rows_, gold_, lengths_ = np.array(rows), np.array(gold), np.array(lengths)
            used, inverse = np.unique(rows_, return_inverse=True)
            at_gram = np.concatenate([np.arange(starts[u], starts[u] + sizes[u]) for u in used])
            gram, gram_word = buckets[at_gram], np.repeat(np.arange(len(used)), sizes[used])
            score = np.add.reduceat(field.weights[gram], np.cumsum(sizes[used]) - sizes[used], axis=0) * scale[used][:, None]
            score = score + field.trust * listed[used]
            miss, slope_m, slope_f = field.slopes(score[inverse].astype(np.float32), lengths_, gold_)
            per_word = np.stack([np.bincount(inverse, miss[:, l], len(used)) for l in range(n)], 1)
            slope = np.stack([np.bincount(gram, (per_word[:, l] * scale[used])[gram_word], BUCKETS) for l in range(n)], 1) / batch
            grad_w += slope**2
            field.weights += (rate * slope / np.sqrt(grad_w)).astype(np.float32)
            trust = (per_word * listed[used]).sum(axis=0) / batch
            grad_t += trust**2
            field.trust = (field.trust + 0.1 * rate * trust / np.sqrt(grad_t)).astype(np.float32)
            for weights, slope_, grad in ((field.moves, slope_m / batch, grad_m), (field.first, slope_f / batch, grad_f)):
                grad += slope_**2
                weights += 0.3 * rate * slope_ / np.sqrt(grad)
    return field


def labelled_sample(docs: DataFrame, per_lang: int = SAMPLE_DOCS, most_bytes: int = SAMPLE_BYTES) -> list[tuple[str, str]]:
    """(lang, text) of at most per_lang distinct documents in every language, by a hash of id and text, as far as the language's
    equal share of most_bytes goes (one document in any case). Each language's count sets a bound on the hash that about twice
    as many rows pass, so that only these are ranked, however many rows a language has; rows that repeat collapse before they
    are shuffled."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0)).select("lang", "text", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1).alias("__order"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()  # a row per class to be learned
    if not counts:
        return []
    bounds = [(r["lang"], min((1 << 63) - 1, (2 * per_lang << 63) // r["n"])) for r in counts]
    bound = docs.sparkSession.createDataFrame(bounds, "lang string, __bound long")
    few = known.join(F.broadcast(bound), "lang").where("__order <= __bound").groupBy("lang", "__order").agg(F.min("text").alias("text"))
    along = Window.partitionBy("lang").orderBy("__order")
    sized = few.withColumns({"__rank": F.row_number().over(along), "__bytes": F.sum(F.octet_length("text").cast("long")).over(along)})
    best = sized.where((F.col("__rank") <= per_lang) & ((F.col("__rank") == 1) | (F.col("__bytes") <= most_bytes // len(counts))))
    return [(r["lang"], r["text"]) for r in best.orderBy("__order", "lang").select("lang", "text").collect()]


def fit(docs: DataFrame, **options) -> Field:
    return train(labelled_sample(docs), **options)


def identify(docs: DataFrame, field: Field, keep: list[str], text: str = "text", spans: bool = False) -> DataFrame:
    """The columns of keep, then lang_pred and score; with spans also the runs of words of one language."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    carried = text in keep  # then the text goes to the workers once
    fed = docs.select(*[f"`{c}`" for c in keep], *([] if carried else [utf8(text).alias("__raw")]))
    out_fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    span_type = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("first_word", T.IntegerType()), T.StructField("n_words", T.IntegerType())]))
    if spans:
        out_fields.append(T.StructField("spans", span_type))
    schema = T.StructType([*docs.select(*[f"`{c}`" for c in keep]).schema.fields, *out_fields])
    arrow_spans = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        memo: dict[bytes, int] = {}
        table = np.zeros((MEMO, len(own.langs)), np.float32)
        for batch in batches:
            at = 0
            raw = batch.column(keep.index(text)).cast(pa.binary()) if carried else batch.column(batch.num_columns - 1)
            for texts in sub_batches(raw):
                cut = [words_of(t) if own.langs and LETTER.search(t) else [] for t in texts]
                new = list({w for ws in cut for w in ws if w not in memo})
                if len(memo) + len(new) > MEMO:
                    memo.clear()
                    new = list({w for ws in cut for w in ws})
                    if len(new) > len(table):
                        table = np.zeros((len(new), len(own.langs)), np.float32)
                for k in range(0, len(new), 10_000):
                    part = new[k : k + 10_000]
                    table[len(memo) : len(memo) + len(part)] = own.evidence(part)
                    memo.update(zip(part, range(len(memo), len(memo) + len(part))))
                sizes = np.array([len(ws) for ws in cut])
                ids = np.fromiter((i for ws in cut for i in map(memo.__getitem__, ws)), np.int64, sizes.sum())
                some = np.flatnonzero(sizes)
                langs, scores, runs = [UNKNOWN] * len(cut), np.zeros(len(cut)), [[] for _ in cut]
                if len(some):
                    post = own.posteriors(table[ids], sizes[some])
                    begins = np.cumsum(sizes[some]) - sizes[some]
                    mean = np.add.reduceat(post, begins, axis=0) / sizes[some][:, None]
                    best = mean.argmax(axis=1)
                    scores[some] = np.minimum(mean.max(axis=1), 1.0)
                    for i, k in zip(some.tolist(), best.tolist()):
                        langs[i] = own.langs[k]
                    if spans:
                        tags = post.argmax(axis=1)
                        for i, b in zip(some.tolist(), begins.tolist()):
                            mine = tags[b : b + sizes[i]]
                            turns = [0, *(np.flatnonzero(np.diff(mine)) + 1).tolist(), len(mine)]
                            runs[i] = [{"lang": own.langs[mine[a]], "first_word": a, "n_words": z - a} for a, z in zip(turns, turns[1:])]
                part = batch.slice(at, len(texts))
                at += len(texts)
                columns = [*part.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(scores)] + ([pa.array(runs, arrow_spans)] if spans else [])
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return fed.mapInArrow(lean(run), schema)


def held_out(modulus: int = 4, rest: int = 2, key: str = "doc_id"):
    return crc_rest(key, modulus) == rest
