"""BPE encoding and decoding by prefix sharing.

The distinct words of a batch, sorted, are the depth-first walk of their trie, and are taken as that: a word goes on at the
letter at which it leaves the one before, and no nodes are built. The walk gives every prefix its last token: the encoding of a
prefix is the encoding of a shorter prefix plus one token, and the token fits where its pair with that shorter prefix's last
token is what BPE itself makes of the two. Which tokens end at a letter, longest first, is told by one step of an automaton over
the vocabulary. Prefixes shared by words are so encoded once, and a word's ids are read backwards from its leaf. Each Spark task
works on the texts of its partition in bounded sub-batches; no row is shuffled.

Cases: a null text counts as empty and has no ids; very long words are walked without recursion; repeated rows repeat their
result; an empty table gives an empty result; special tokens in a text become their ids unless `specials` is off; columns
that are carried along keep their names, and `ids` and `decoded` are named by parameters so that they need not clash.
"""

from __future__ import annotations

import functools
import json
import re
import sys
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, utf8

#: Characters of text that one sub-batch holds at most (a longer single text is a sub-batch of its own).
BATCH_CHARS = 2_000_000
#: Entries of the per-worker memo of units; the rarer ones go when it is full, which changes time and never results.
MEMO = 250_000
PAIRS = 1_000_000
#: Steps of the automaton that are kept besides the vocabulary's own.
STEPS = 250_000
#: Codes of a letter: a byte, or FINAL more where a word ends. A state is told by its number times CODES.
FINAL, CODES = 256, 512
#: Texts with other characters than these take the tokenizers library's own normaliser and splitter.
PLAIN = re.compile("[\x00\x01\x1c-\x1f]|[^\x00-ɏ]")
SUFFIX = "</w>"
EMPTY = b""


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class TrieBpe:
    """Encodes words (as UTF-8) of a vocabulary whose last letter carries an end mark."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        vocab: dict[str, int] = described["model"]["vocab"]
        self.library = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in described["added_tokens"] if t["special"]}
        self.build(vocab)
        self.merged, self.halves, self.rank = {}, {}, {}
        for rank, pair in enumerate(described["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            made = vocab[a + b]
            self.merged[vocab[a], vocab[b]] = (rank, made)
            self.halves[made], self.rank[made] = (vocab[a], vocab[b]), rank
        splitter = described["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(splitter).findall
        self.pair_ok: dict[int, bool] = {}
        self.memo: dict[str, bytes] = {}
        names = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        table = [names.get(i, "").encode() + b" " for i in range(max(names) + 1)]
        self.id_bytes = [int(i).to_bytes(4, sys.byteorder) for i in range(len(table))]
        self.name_bytes = np.frombuffer(b"".join(table), np.uint8)
        self.name_sizes = np.array([len(x) for x in table])
        self.name_at = np.cumsum(self.name_sizes) - self.name_sizes

    def fits(self, before: int, token: int) -> bool:
        """Whether BPE leaves the two tokens side by side: no merge across their border ever comes before one inside.

        Both sides are taken apart from the border, the part made last first. A pair across the border that merges
        earlier than the parts still standing were made would have been merged.
        """
        key = before * 65536 + token
        merged, halves = self.merged, self.halves
        left, right, fine = before, token, True
        # made: rank by which a merge across the border must come to break the present parts
        made = 1 << 60
        while left >= 0:
            across = merged.get((left, right))
            if across is not None and across[0] < made:
                fine = False
                break
            rank_l, rank_r = self.rank.get(left, -1), self.rank.get(right, -1)
            if rank_l < 0 and rank_r < 0:
                break
            if rank_l > rank_r:
                made, left = rank_l, halves[left][1]
            else:
                made, right = rank_r + 1, halves[right][0]
        if len(self.pair_ok) >= PAIRS:
            self.pair_ok.clear()
        self.pair_ok[key] = fine
        return fine

    def build(self, vocab: dict[str, int]) -> None:
        """The automaton over the vocabulary (Aho and Corasick's). A state stands for the longest prefix of a token that the
        letters so far end with; step leads from a state and a letter's code to the next state and the tokens that end there,
        linked from the longest to the shortest: (id, length, the next shorter)."""
        self.bytes_of = {ord(letter): chr(byte) for byte, letter in enumerate(byte_letters())}
        tokens: dict[str, int] = {}  # a character is a letter's code
        for name, i in vocab.items():
            body = name.removesuffix(SUFFIX).translate(self.bytes_of)
            tokens[body[:-1] + chr(ord(body[-1]) + FINAL) if name.endswith(SUFFIX) else body] = i
        prefixes = sorted({t[:n] for t in tokens for n in range(1, len(t) + 1)}, key=len)
        number = {"": 0} | {p: i for i, p in enumerate(prefixes, 1)}
        ending: list[tuple | None] = [None] * len(number)
        self.fail, self.step, self.added = [0] * len(number), {}, []
        for i, p in enumerate(prefixes, 1):
            rest = p[1:]
            while rest not in number:
                rest = rest[1:]
            self.fail[i] = number[rest]
            ending[i] = (tokens[p], len(p), ending[number[rest]]) if p in tokens else ending[number[rest]]
            self.step[number[p[:-1]] * CODES + ord(p[-1])] = (i * CODES, ending[i])

    def move(self, key: int) -> tuple:
        """The step at key (a state times CODES plus a code) where the vocabulary has none: that of the state's longest end."""
        state, code = divmod(key, CODES)
        while (found := self.step.get(state * CODES + code)) is None:
            state = self.fail[state]
        if len(self.added) >= STEPS:
            for old in self.added:
                del self.step[old]
            self.added.clear()
        self.step[key] = found
        self.added.append(key)
        return found

    def encode_words(self, words: set[bytes]) -> dict[bytes, bytes]:
        """The ids of each distinct word, as int32 bytes."""
        found: dict[bytes, bytes] = {}
        step, move, fits, pair_ok, id_bytes = self.step.get, self.move, self.fits, self.pair_ok.get, self.id_bytes
        deepest = max(map(len, words), default=0) + 1
        ids, sizes, states = [-1] * deepest, [0] * deepest, [0] * deepest  # of the path from the root to the letter at hand
        last, known = b"", 0  # the word before, and how much of it lies on the path
        for word in sorted(words):
            inner, depth = len(word) - 1, 0
            most = min(known, inner)
            while depth < most and word[depth] == last[depth]:
                depth += 1
            state = states[depth]
            for letter in word[depth:inner]:
                key = state + letter
                state, (token, size, shorter) = step(key) or move(key)
                depth += 1
                pair = ids[depth - size] * 65536 + token
                while not ((ok := pair_ok(pair)) or (ok is None and fits(ids[depth - size], token))):
                    token, size, shorter = shorter
                    pair = ids[depth - size] * 65536 + token
                ids[depth], sizes[depth], states[depth] = token, size, state
            key = state + FINAL + word[inner]
            _, (token, size, shorter) = step(key) or move(key)
            depth += 1
            pair = ids[depth - size] * 65536 + token
            while not ((ok := pair_ok(pair)) or (ok is None and fits(ids[depth - size], token))):
                token, size, shorter = shorter
                pair = ids[depth - size] * 65536 + token
            at = depth - size
            if at:
                out = [id_bytes[token]]
                while at:
                    out.append(id_bytes[ids[at]])
                    at -= sizes[at]
                found[word] = b"".join(out[::-1])
            else:
                found[word] = id_bytes[token]
            last, known = word, inner
        return found

    def units(self, text: str, specials: bool) -> list[str]:
        """Pieces whose encodings are independent: chunks between white space, or \\x00 and a split word, or \\x01 and a special."""
        if specials and "<|" in text and any(s in text for s in self.special):
            parts = re.split("(" + "|".join(map(re.escape, self.special)) + ")", text)
            return [u for p in parts for u in (["\x01" + p] if p in self.special else self.units(p, False))]
        if PLAIN.search(text) is None:
            return text.lower().split()
        ready = self.library.normalizer.normalize_str(text)
        return ["\x00" + w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(ready)]

    def learn(self, units: set[str]) -> None:
        """Adds units to the memo, through one trie over all their words."""
        whole, cut = {}, {}
        for u in units:
            if u.isalpha():  # a run of letters is one word to the splitter
                whole[u] = u.encode()
            elif u[0] == "\x00":
                whole[u] = u[1:].translate(self.bytes_of).encode("latin-1")
            elif u[0] == "\x01":
                self.memo[u] = self.id_bytes[self.special[u[1:]]]
            else:
                cut[u] = [w.encode() for w in self.split(u)]
        ids = self.encode_words({*whole.values(), *(w for ws in cut.values() for w in ws)})
        for u, w in whole.items():
            self.memo[u] = ids[w]
        for u, ws in cut.items():
            self.memo[u] = b"".join([ids[w] for w in ws])

    def encode_texts(self, texts: list[str], specials: bool = True) -> list[bytes]:
        """Of each text its ids as int32 bytes."""
        cut = [self.units(t, specials) for t in texts]
        memo = self.memo
        new = {u for units in cut for u in units if u not in memo}
        if len(memo) + len(new) > MEMO:  # keep what this sub-batch needs, and of that what comes again
            often = {u for u, n in Counter(u for units in cut for u in units).items() if n > 1 and u in memo}
            for u in [u for u in memo if u not in often]:
                del memo[u]
            new = {u for units in cut for u in units if u not in memo}
        if new:
            self.learn(new)
        return [b"".join(map(memo.__getitem__, units)) for units in cut]

    def decode_lists(self, lists: list[bytes]) -> list[bytes]:
        """What the library's decode(ids, skip_special_tokens=False) gives for a vocabulary without a decoder: the tokens'
        names with a blank between, in UTF-8. Ids are int32 bytes."""
        ids = np.frombuffer(b"".join(lists), np.int32)
        sizes = self.name_sizes[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        place = np.int32 if ends[-1] + len(self.name_bytes) < 1 << 31 else np.int64
        at = np.repeat((self.name_at[ids] - ends[:-1]).astype(place), sizes)
        at += np.arange(ends[-1], dtype=place)
        out = self.name_bytes[at].tobytes()
        last = ends[np.cumsum([0] + [len(x) // 4 for x in lists])].tolist()
        return [out[a : max(a, b - 1)] for a, b in zip(last, last[1:])]


@functools.lru_cache(2)
def coder(path: str) -> TrieBpe:
    """One per Python worker."""
    return TrieBpe(path)


def sub_batches(texts: pa.Array, most: int = BATCH_CHARS) -> Iterator[list[str]]:
    """The texts of a column of bytes in bounded lists; only one list is held as Python strings at a time."""
    held, size = [], 0
    for raw in (r for i in range(0, len(texts), 256) for r in texts.slice(i, 256).to_pylist()):
        text = (raw or EMPTY).decode("utf-8", "replace")
        if held and size + len(text) > most:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def lists(raw: list[bytes], dtype: str = "int32") -> pa.ListArray:
    """A list array over the joined bytes, without a Python object per id."""
    width = np.dtype(dtype).itemsize
    ends = np.cumsum([0] + [len(r) // width for r in raw])
    if ends[-1] >= 1 << 31:
        raise ValueError("a batch holds too many ids for one Arrow list array; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(raw), dtype)))


def encode(docs: DataFrame, keep: list[str] | None = None, text: str = "text", path: str | None = None, specials: bool = True, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The columns of keep (all, by default), then ids array<int> and the decoded text."""
    path = path or default_path()
    keep = docs.columns if keep is None else keep
    fed = docs.select(*[f"`{c}`" for c in keep], utf8(text).alias("__raw"))
    schema = T.StructType([*docs.select(*[f"`{c}`" for c in keep]).schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False)), T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            at = 0
            for texts in sub_batches(batch.column(batch.num_columns - 1)):
                done = own.encode_texts(texts, specials)
                shown = own.decode_lists(done)
                part = batch.slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists(done), pa.array(shown, pa.binary()).cast(pa.string())], names=[*keep, ids, decoded])
        own.memo.clear()  # workers outlive their tasks, and other stages need the memory

    return fed.mapInArrow(lean(run), schema)


def digests(coded: DataFrame, key: str = "doc_id", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Of encode()'s result: the key, n_tokens, and SHA-256 of the ids (decimal, a blank between) and of the decoded text."""
    return coded.select(
        key, F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded).cast("binary"), 256).alias("decoded_sha256"),
    )
