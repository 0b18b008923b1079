"""Substring dedup by sliding sentence spans.

A sentence of more than LONG_WORDS words counts as several: it is cut on behind every word whose hash is 0 modulo CUT_ONE_IN,
so that a passage within longer sentences is cut alike wherever it stands.

A span is a shortest run of two or more consecutive sentences with at least MIN_WORDS words, seen forwards from every
sentence and backwards to every sentence (so that a repeated passage is covered to both its ends), or one sentence of at
least LONE_WORDS words. Spans are hashed on their words (ASCII letters lower-cased, white space and case of no account) and
meet globally on their hashes; a sentence goes if some span that covers it occurs earlier, in order of doc_id and place.

Only hashes with places are shuffled, and they are pre-aggregated; a hash that is everywhere is a skewed join key whose
partner side is one row. Cases: a null text stays null, an empty one empty; a text all of whose sentences go becomes empty;
rows that repeat whole (id and text) are one document and get one result; with a null doc_id a hash of the text orders it;
texts of any length are cut alike; an empty table gives an empty result; further columns pass through whatever
their names (but one called removed_sentences or removed_words is replaced).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import BATCH_CHARS
from .common import _SPACE, lean, mix64, saved, shielded, utf8

MIN_SENTENCES = 2
MIN_WORDS = 14
LONE_WORDS = 14
#: Sentences of more words are cut further, behind one word in CUT_ONE_IN.
LONG_WORDS = 16
CUT_ONE_IN = 8
#: A place is one long: sentence, sentences in the span, and bits of the text's hash.
_LENGTH_BITS, _TEXT_BITS = 6, 26
_STOPS = np.zeros(256, bool)
_STOPS[list(b".!?")] = True


class Cut:
    """Texts cut into sentences: where each begins (bytes, in its own text), its words and hash, and each text's first one."""

    def __init__(self, raws: list[bytes]):
        letters = np.frombuffer(b" " + b" ".join(raws).lower() + b" ", np.uint8)
        space = _SPACE[letters]
        begins = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        offsets = np.cumsum([1] + [len(r) + 1 for r in raws])
        inside = np.flatnonzero(~space)
        first = np.searchsorted(inside, begins)
        sizes = np.diff(np.append(first, len(inside)))
        ends = begins + sizes
        text_of = np.searchsorted(offsets, begins, side="right") - 1
        place = np.arange(len(inside)) - np.repeat(first, sizes)
        mixed = mix64((letters[inside].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64))
        words = mix64(np.add.reduceat(mixed, first)) if len(first) else np.zeros(0, np.uint64)
        lines = np.flatnonzero(letters == 10)
        # A sentence begins with a text, after a stop, and after a line break.
        opens = np.ones(len(begins), bool)
        if len(begins) > 1:
            broken = np.searchsorted(lines, begins[1:]) > np.searchsorted(lines, ends[:-1])
            opens[1:] = broken | _STOPS[letters[ends[:-1] - 1]] | (text_of[1:] != text_of[:-1])
            # A long one is cut on behind words that their hash alone chooses, so that copies are cut alike whatever is around.
            heads = np.flatnonzero(opens)
            sizes = np.diff(np.append(heads, len(begins)))
            opens[1:] |= (np.repeat(sizes, sizes)[1:] > LONG_WORDS) & (words[:-1] % np.uint64(CUT_ONE_IN) == 0)
        heads = np.flatnonzero(opens)
        self.words = np.diff(np.append(heads, len(begins)))
        at = np.arange(len(begins)) - np.repeat(heads, self.words)
        self.hashes = mix64(np.add.reduceat(mix64(words + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), heads)) if len(heads) else np.zeros(0, np.uint64)
        owner = text_of[heads]
        self.begins = begins[heads] - offsets[owner]
        self.bounds = np.searchsorted(owner, np.arange(len(raws) + 1))
        self.owner = owner

    def spans(self, min_words: int, lone_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First sentence, number of sentences and hash of every span."""
        n = len(self.words)
        before = np.concatenate([[0], np.cumsum(self.words)])
        i = np.arange(n)
        more = MIN_SENTENCES - 1
        last = np.maximum(i + more, np.searchsorted(before, before[i] + min_words) - 1)
        good = last < self.bounds[self.owner + 1]
        start = np.minimum(i - more, np.searchsorted(before, before[i + 1] - min_words, side="right") - 1)
        back = start >= self.bounds[self.owner]
        alone = i[self.words >= lone_words]
        firsts = np.concatenate([i[good], start[back], alone])
        lasts = np.concatenate([last[good], i[back], alone])
        packed = np.unique(firsts * 64 + (lasts - firsts)) if n else np.zeros(0, np.int64)
        firsts, extra = packed >> 6, packed & 63
        out = np.zeros(len(firsts), np.uint64)
        for d in range(int(extra.max(initial=-1)) + 1):
            on = extra >= d
            out[on] = out[on] * np.uint64(0x100000001B3) + self.hashes[firsts[on] + d]
        return firsts, extra + 1, mix64(out + extra.astype(np.uint64))


def _raws(column: pa.Array, most: int = BATCH_CHARS) -> Iterator[list[bytes]]:
    held, size = [], 0
    for raw in (r for i in range(0, len(column), 256) for r in column.slice(i, 256).to_pylist()):
        raw = raw or b""
        if held and size + len(raw) > most:
            yield held
            held, size = [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield held


def _key(key: str, text: str) -> Column:
    return F.coalesce(F.col(key).cast("long"), F.xxhash64(text))


def _text_bits(text: str) -> Column:
    return F.coalesce(F.pmod(F.xxhash64(text), F.lit(1 << _TEXT_BITS)), F.lit(0))


def spans_of(docs: DataFrame, min_words: int = MIN_WORDS, lone_words: int = LONE_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """hash, doc and place of every span."""
    fed = docs.select(_key(key, text).alias("doc"), _text_bits(text).alias("bits"), utf8(text).alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs_, bits, at = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), 0
            for raws in _raws(batch.column(2)):
                cut = Cut(raws)
                first, n, hashes = cut.spans(min_words, lone_words)
                owner = cut.owner[first] if len(first) else np.zeros(0, np.int64)
                sentence = first - cut.bounds[owner]
                place = (sentence << (_LENGTH_BITS + _TEXT_BITS)) | (n << _TEXT_BITS) | bits[at + owner]
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(docs_[at + owner], pa.int64()), pa.array(place, pa.int64())], names=["hash", "doc", "place"])
                at += len(raws)

    return fed.mapInArrow(lean(run), "hash long, doc long, place long")


@shielded
def dedup(docs: DataFrame, min_words: int = MIN_WORDS, lone_words: int = LONE_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs with the repeated sentences taken out of the text, then removed_sentences and removed_words."""
    spans = spans_of(docs, min_words, lone_words, key, text)
    first = spans.groupBy("hash").agg(F.min(F.struct("doc", "place")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = saved(first, "first")  # a table of its own: a join of two plain exchanges can split a hot hash over tasks
    later = spans.join(first, "hash").where((F.col("doc") != F.col("first.doc")) | (F.col("place") != F.col("first.place")))
    marks = saved(later.groupBy("doc").agg(F.collect_set("place").alias("places")), "marks")
    names = docs.columns
    fed = docs.withColumns({"__doc": _key(key, text), "__bits": _text_bits(text), "__raw": F.col(text).cast("binary")}).join(marks.select(F.col("doc").alias("__doc"), F.col("places").alias("__places")).hint("shuffle_hash"), "__doc", "left")
    fed = fed.select(*[f"`{c}`" for c in names if c != text], "__bits", "__places", "__raw")
    kept = [c for c in names if c != text]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(text, T.StringType()), T.StructField("removed_sentences", T.IntegerType()), T.StructField("removed_words", T.IntegerType())])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, places, raw = (batch.column(len(kept) + i) for i in range(3))
            texts, sentences, words = raw.to_pylist(), [0] * len(raw), [0] * len(raw)
            for i in np.flatnonzero(places.is_valid().to_numpy(zero_copy_only=False)).tolist():
                if texts[i] is None:
                    continue
                marked = np.array(places[i].as_py(), np.int64)
                marked = marked[(marked & ((1 << _TEXT_BITS) - 1)) == bits[i].as_py()] >> _TEXT_BITS
                cut = Cut([texts[i]])
                gone = np.zeros(len(cut.words) + 1, np.int64)
                start, n = marked >> _LENGTH_BITS, marked & ((1 << _LENGTH_BITS) - 1)
                np.add.at(gone, start, 1)
                np.add.at(gone, start + n, -1)
                gone = np.cumsum(gone)[:-1] > 0
                edges = np.append(cut.begins, len(texts[i])).tolist()
                sentences[i], words[i] = int(gone.sum()), int(cut.words[gone].sum())
                whole = texts[i][: edges[0]] + b"".join([texts[i][edges[k] : edges[k + 1]] for k in np.flatnonzero(~gone).tolist()])
                texts[i] = whole.rstrip(b" \t\n\r\x0b\x0c") if sentences[i] else texts[i]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(texts, pa.binary()).cast(pa.string()), pa.array(sentences, pa.int32()), pa.array(words, pa.int32())], names=schema.names)

    return fed.mapInArrow(lean(rewrite), schema).select(*[f"`{c}`" for c in names], "removed_sentences", "removed_words")
