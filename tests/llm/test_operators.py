"""Each operator against brute force on small tables, and on the odd rows that any table may hold."""

import hashlib
import itertools
import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from treeloom.llm import bpe, language_id, lm_scoring, mixing, ngram_join, queries, substring_dedup, token_counts, url_filter, vectors
from treeloom.llm.common import lean

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, `__key` string, ids string, removed_words int"
LONG = "One long text of many words. " * 4000
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def odd_docs(spark):
    rows = [
        (1, "Plain text with some words in it, and a few more of them here.", "en", "a"), (1, "Plain text with some words in it, and a few more of them here.", "en", "a"),
        (2, None, "en", "a"), (3, "", None, "b"), (4, "  \n\t ", "fr", None), (None, "A row without an id but with words, quite a few.", None, None), (None, None, None, None),
        (5, LONG, "en", "b"), (6, "123 456 -- 789", "de", "c"), (7, "PLAIN text WITH some words in it, and a few more of them here.", "en", "a"), (8, "été à la mer, où l'on va <|endoftext|> 中文 ½ İ ς", "fr", "c"),
    ]
    return spark.createDataFrame([(i, t, l, s, len(t or ""), 0.5, "k", "i", 7) for i, t, l, s in rows], SCHEMA)


def empty(spark):
    return odd_docs(spark).limit(0)


@pytest.fixture(scope="module")
def coder():
    return bpe.TrieBpe(bpe.default_path())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


# ---- 2, 10 -----------------------------------------------------------------------------------------------------------


@settings(deadline=None, max_examples=150)
@given(text=st.text(alphabet=st.one_of(st.sampled_from("thein'sdr l1½éßΣςİ.,!?<>|\n\t\x1c\x85\xa0中ﬁ́\U0001F600"), st.characters(codec="utf-8")), max_size=40))
def test_encoding_is_the_librarys(coder, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    mine = coder.encode_texts([text])
    assert np.frombuffer(mine[0], np.int32).tolist() == ids
    assert coder.decode_lists(mine)[0].decode() == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["<|startoftext|>Hi<|endoftext|>x<|end", "a" * 5000, "the" * 3000, "", " "])
def test_special_and_long_words(coder, library, text):
    assert np.frombuffer(coder.encode_texts([text])[0], np.int32).tolist() == library.encode(text, add_special_tokens=False).ids


def test_a_sub_batch_of_words_builds_no_nodes(coder):
    """The walk over sorted words holds the path at hand alone: its peak is below what a node for every prefix would take."""
    rng = np.random.default_rng(1)
    units = {"".join(x) for x in rng.choice(list("etaoinshrdlu"), (20_000, 12))}
    own = bpe.TrieBpe(bpe.default_path())
    own.learn(units)  # pairs and steps are known from here on
    own.memo.clear()
    tracemalloc.start()
    try:
        own.learn(units)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(own.memo) == len(units) and peak < 15_000_000


def test_a_lean_task_keeps_its_rows():
    batches = [pa.RecordBatch.from_arrays([pa.array([i])], names=["x"]) for i in range(3)]
    assert list(lean(lambda given: (b for b in given))(iter(batches))) == batches


def test_bpe_query_on_odd_rows(spark, library):
    docs = odd_docs(spark)
    rows = bpe.digests(bpe.encode(docs.select("doc_id", "text"), keep=["doc_id"])).collect()
    want = Counter()
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(map(tuple, rows)) == want
    assert bpe.encode(empty(spark), keep=["doc_id"]).count() == 0


@pytest.mark.parametrize("block", [7, 1000, 1 << 18])
def test_token_counts(spark, library, block):
    docs = odd_docs(spark)
    library.encode_special_tokens = True
    want = Counter((r.doc_id, len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    library.encode_special_tokens = False
    assert Counter(tuple(r) for r in token_counts.token_counts(docs.repartition(2), block_tokens=block).collect()) == want
    assert token_counts.token_counts(empty(spark)).count() == 0


def test_raw_token_files(spark, tmp_path):
    end = token_counts.END_OF_DOCUMENT
    np.array([5, 6, end, end, 7, 8, 9, end, 1, 2], np.uint16).tofile(tmp_path / "a.bin")
    np.array([end], np.uint16).tofile(tmp_path / "b.bin")
    (tmp_path / "c.bin").write_bytes(b"")
    for size in (1, 3, 100):
        found = token_counts.scan(token_counts.blocks_of_files(spark, str(tmp_path), block_tokens=size))
        assert sorted((r.file[-5:], r.place, r.n_tokens, r.ended) for r in found.collect()) == [("a.bin", 0, 2, True), ("a.bin", 1, 0, True), ("a.bin", 2, 3, True), ("a.bin", 3, 2, False), ("b.bin", 0, 0, True)]


# ---- 3, 4 ------------------------------------------------------------------------------------------------------------


def test_ngram_join_is_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    sets = {i: set(map(int, g)) for i, g in zip(texts, ngram_join.gram_sets(list(texts.values())))}
    links, root = defaultdict(set), {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in texts:
        for j in texts:
            if i < j and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i].add(j), links[j].add(i)
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert {tuple(r) for r in ngram_join.classes_of(docs).collect()} == {(i, find(i), len(links[i])) for i in texts}


def test_a_large_group_of_near_copies_in_blocks(spark, monkeypatch):
    for name in ("BLOCK", "BUCKET_BLOCK"):
        monkeypatch.setattr(ngram_join, name, 8)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(5, 105, 2)] + ["nothing like the others at all, not even a little"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(map(int, g)) for g in ngram_join.gram_sets(texts)]
    want = {(i, 0 if i < 50 else i, sum(j != i and len(s & t) >= 0.8 * len(s | t) for j, t in enumerate(sets))) for i, s in enumerate(sets)}
    assert {tuple(r) for r in ngram_join.classes_of(docs).collect()} == want


def test_ngram_join_on_odd_rows(spark):
    docs = odd_docs(spark)
    rows = ngram_join.classes_of(docs).collect()
    assert len(rows) == docs.count()
    assert {(r.class_id, r.n_links) for r in rows if r.doc_id in (1, 7)} == {(1, 2)}
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 4, None, None, 5, 6, 8])
    assert ngram_join.classes_of(empty(spark)).count() == 0


def test_the_row_that_stays_is_the_same_in_any_order(spark):
    rows = [(1, "one text that comes three times over", "en", s, 5) for s in ("c", "a", "b")] + [(None, "no id", "en", "z", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for parts in (1, 2, 3):
        assert {(r.doc_id, r.source) for r in ngram_join.one_of_each(docs.repartition(parts)).collect()} == {(1, "a"), (None, "z")}
    assert sorted((r.doc_id or 0, r.n_links) for r in ngram_join.classes_of(docs).collect()) == [(0, 0), (1, 2), (1, 2), (1, 2)]


def test_bands_reach_the_recall():
    bands = ngram_join.bands_for()
    assert 1 - (1 - 0.8**ngram_join.ROWS) ** bands >= ngram_join.RECALL


def test_repeated_passages_go(spark):
    passage = "The first sentence of a passage that comes again and again. Here is its second sentence, no shorter than that. And a third one ends it, after which something else follows in every text."
    own = lambda i: f"Text number {i} begins in a way of its own. It goes on with words like q{i}a and q{i}b."
    rows = [(i, f"{own(i)} {passage} {own(i + 100)}") for i in range(5)] + [(9, own(9)), (10, passage)]
    got = {r.doc_id: r for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].text == rows[0][1] and got[9].text == rows[5][1] and got[9].removed_sentences == 0
    for i in range(1, 5):
        assert got[i].text == f"{own(i)} {own(i + 100)}" and got[i].removed_sentences == 3
    assert got[10].text == "" and got[10].removed_words == len(passage.split())


def brute_dedup(texts):
    """The definition, span by span, over one list of texts in order."""
    first, marks = {}, defaultdict(set)
    for at, text in enumerate(texts):
        cut = substring_dedup.Cut([text.encode()])
        for s, n, h in zip(*(x.tolist() for x in cut.spans(substring_dedup.MIN_WORDS, substring_dedup.LONE_WORDS))):
            if first.setdefault(h, (at, s)) > (at, s):
                first[h] = (at, s)
    for at, text in enumerate(texts):
        cut = substring_dedup.Cut([text.encode()])
        for s, n, h in zip(*(x.tolist() for x in cut.spans(substring_dedup.MIN_WORDS, substring_dedup.LONE_WORDS))):
            if first[h] != (at, s):
                marks[at] |= set(range(s, s + n))
    return [len(marks[at]) for at in range(len(texts))]


def test_dedup_is_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id")
    rows = docs.collect()
    got = {r.doc_id: r.removed_sentences for r in substring_dedup.dedup(docs).collect()}
    assert [got[r.doc_id] for r in rows] == brute_dedup([r.text for r in rows])


def repeated_runs(texts, words=50, kinds=20):
    """(text, place) of every run of so many words that occurs before, told by the words alone."""
    seen, found = set(), []
    for at, text in enumerate(texts):
        split = WORDS.findall(text.lower().encode())
        for i in range(len(split) - words + 1):
            run = tuple(split[i : i + words])
            if run in seen and len(set(run)) >= kinds:
                found.append((at, i))
            seen.add(run)
    return found


def test_no_run_of_fifty_words_stays_twice(spark, sf_dir):
    rng = np.random.default_rng(3)
    some = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    inside, short = some(60), some(17) + ". " + some(8) + ". " + some(8) + ". " + some(19)
    texts = [f"{some(40 + i)} {p} {some(60 - i)}. {some(9)}." for i in range(20) for p in (inside, short, some(60))]
    given = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    rows = list(enumerate(texts + given))
    got = {r.doc_id: r for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {at for at, _ in repeated_runs(texts)} == {i for i in range(3, 60) if i % 3 < 2}
    assert repeated_runs([got[i].text for i, _ in rows]) == []
    assert all(got[i].text == texts[i] for i in range(60) if i < 2 or i % 3 == 2)


def test_dedup_on_odd_rows(spark):
    docs = odd_docs(spark)
    out = substring_dedup.dedup(docs)
    assert out.columns == [*[c for c in docs.columns if c != "removed_words"], "removed_sentences", "removed_words"]
    rows = out.collect()
    assert len(rows) == docs.count() and sum(r.text is None for r in rows) == 2
    assert len({(r.text, r.removed_sentences) for r in rows if r.doc_id == 1}) == 1
    assert substring_dedup.dedup(empty(spark)).count() == 0


# ---- 5, 7 ------------------------------------------------------------------------------------------------------------


def vector_table(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)], "x") for i in range(400)]
    rows += [(400 + i, rows[3][1], "copy") for i in range(30)]
    rows += [(500, None, "null"), (550, [float("nan")] * 8, "nan"), (600, [1.0, None] * 4, "hole"), (650, [0.0] * 8, "zero"), (None, rows[0][1], "no id"), rows[7], rows[50], (700, [1e300] * 8, "large"), (750, [1.0, 2.0], "short")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")


def usable(table, zero):
    rows = {}
    for r in table.collect():
        v = r.embedding
        if r.vec_id is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v)):
            rows[r.vec_id] = np.array(v)
    return rows


def test_products_are_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD", 100)
    monkeypatch.setattr(vectors, "CHUNK", 16)
    table = vector_table(spark)
    more = [(700, [1e300] * 8), (701, [1e17, -1e17, 3.5] * 2 + [0.0] * 2), (702, [-1e300] * 8), (703, [1e300] * 7 + [-1e300]), (704, [2.0**62] + [0.0] * 7), (800, [1e6 * x for x in range(8)]), (801, [0.1] * 8)]
    table = table.where("score <> 'large'").unionByName(spark.createDataFrame([(i, v, "big") for i, v in more], table.schema))
    rows = {i: [math.floor(Fraction(float(x)) * 256) for x in v] for i, v in usable(table, True).items()}
    want = set()
    for q in [i for i in rows if i % 50 == 0]:
        best = sorted((-sum(a * b for a, b in zip(rows[q], v)), i) for i, v in rows.items() if i != q and len(v) == len(rows[q]))[:5]
        want |= {(q, k + 1, i, max(min(-s, 2**63 - 1), -(2**63))) for k, (s, i) in enumerate(best)}
    got = [tuple(r) for r in vectors.top_products(table).collect()]
    assert set(got) == want and len(got) == len(want)
    assert vectors.top_products(table.limit(0)).count() == 0


def test_nearest_with_copies_and_recall(spark):
    table = vector_table(spark)
    rows = usable(table, False)
    unit = {i: (v / np.abs(v).max()) / np.linalg.norm(v / np.abs(v).max()) for i, v in rows.items()}
    got = defaultdict(list)
    for r in vectors.nearest(table).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q in [i for i in rows if i % 50 == 0]:
        best = sorted((-round(float(unit[q] @ u), 12), i) for i, u in unit.items() if i != q and len(u) == len(unit[q]))[:5]
        mine = [i for _, i, _ in sorted(got[q])]
        assert len(mine) == len(best) and all(abs(s - float(unit[q] @ unit[i])) < 1e-12 for _, i, s in got[q])
        hits, total = hits + len(set(mine) & {i for _, i in best}), total + len(best)
    assert hits >= 0.9 * total
    assert [i for _, i, _ in sorted(got[400])][:5] == [3, 401, 402, 403, 404]
    assert vectors.nearest(table.limit(0)).count() == 0


def test_recall_where_windows_see_a_part_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 128)
    rng = np.random.default_rng(5)
    points = rng.normal(size=(10_000, 24)).astype(np.float32)
    points[2000:2600] = points[7] + rng.normal(size=(600, 24)).astype(np.float32) / 50  # a tight cluster
    table = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<float>")
    unit = points.astype(np.float64) / np.linalg.norm(points.astype(np.float64), axis=1, keepdims=True)
    got = defaultdict(list)
    for r in vectors.nearest(table, window=0.01).collect():
        got[r.query_id].append((r.rank, r.vec_id))
        assert abs(r.score - unit[r.query_id] @ unit[r.vec_id]) < 1e-12
    hits = {False: [], True: []}
    for q in range(0, 10_000, 50):
        score = unit @ unit[q]
        score[q] = -2
        hits[2000 <= q < 2600].append(len(set(np.argsort(-score, kind="stable")[:5].tolist()) & {i for _, i in got[q]}) / 5)
    assert np.mean(hits[False]) >= 0.9 and np.mean(hits[True]) >= 0.9, {k: np.mean(v) for k, v in hits.items()}


def test_hilbert_neighbours_are_grid_neighbours():
    side = np.stack(np.meshgrid(*[np.arange(4)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = vectors.hilbert_keys(side, 2)
    assert sorted(keys.tolist()) == list(range(64))
    path = side[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


# ---- 6 ---------------------------------------------------------------------------------------------------------------


def test_given_rules_and_odd_urls(spark):
    urls = ["https://a.Example.COM/en/7x", "http://shop.com/en/1?x", "http://notcom/en/1", "https://x.example.net/de/8", "http://y.net/de/9#a", "http://org/es/", "http://z.org/fr/", None, "no scheme", "http://", "x://h?://com/en/", "http://a.com" + "/en/" * 3000]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)] + [(1, urls[1], "h", "r")], "page_id long, url string, html string, rule string")
    labels = spark.createDataFrame([(0, 1, 0), (None, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    rows = {r.page_id: r for r in url_filter.judge(pages, labels).collect()}
    assert [rows[i].rule for i in range(12)] == ["example.com/en/7", "com/en/", None, "example.net/de/8", "net/de/", "org/es/", None, None, None, None, None, "com/en/"]
    assert [rows[i].verdict for i in range(7)] == ["allow", "block", "allow", "allow", "block", "block", "allow"]
    assert (rows[0].host, rows[0].path, rows[7].host, rows[10].host, rows[10].path) == ("a.example.com", "/en/7x", "", "h", "")
    assert url_filter.judge(pages.limit(0), labels).count() == 0


def test_mined_rules_fire(spark):
    pages = spark.createDataFrame([(i, f"http://s{i % 7}.test/{'casino' if i % 3 == 0 else 'news'}/{'win' if i % 2 == 0 else 'day'}/{i}") for i in range(400)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    rows = url_filter.judge(pages, labels).collect()
    assert {r.page_id for r in rows if r.verdict == "block"} == {i for i in range(400) if i % 6 == 0}


def rules_by_enumeration(baskets, min_support, min_confidence, min_lift):
    """Token sets (of any length) whose share of bad pages is as asked for, none of which holds one as confident with a token less."""
    held, bad = Counter(), Counter()
    for tokens, is_bad in baskets:
        for n in range(1, len(tokens) + 1):
            for some in itertools.combinations(sorted(tokens), n):
                held[some] += 1
                bad[some] += is_bad
    total, n_bad = len(baskets), sum(b for _, b in baskets)

    def surely(k, n, z=url_filter.DEVIATIONS):
        return (k / n + z * z / (2 * n) - z * math.sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n)

    strong = {s: bad[s] / n for s, n in held.items() if bad[s] >= min_support * total and surely(bad[s], n) >= min_confidence and bad[s] / n * total / max(n_bad, 1) >= min_lift}
    return {s for s in strong if not any(strong.get(s[:i] + s[i + 1 :], -1) >= strong[s] for i in range(len(s)))}


def test_mined_rules_are_those_of_enumeration(spark):
    rng = np.random.default_rng(8)
    urls = [f"http://{rng.choice(['a', 'b'])}.{rng.choice(['x', 'y', 'z'])}.test/" + "/".join(rng.permutation(["p", "q", "r", "s", "t", "u"])[: rng.integers(1, 6)]) + (f"?k{rng.integers(3)}=1" if rng.random() < 0.5 else "") for _ in range(500)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    tokens = {r.page_id: r.tokens for r in url_filter.parsed(pages).collect()}
    held = lambda i, *some: all(t in tokens[i] for t in some)
    toxic = [int(held(i, "p:p", "p:q", "p:r", "d:x.test") or held(i, "p:s", "q:k1") or rng.random() < 0.1) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    want = rules_by_enumeration([(tokens[i], toxic[i]) for i in range(400)], url_filter.MIN_PAGES / 400, url_filter.MIN_CONFIDENCE, url_filter.MIN_LIFT)
    rows = {r.page_id: r.verdict for r in url_filter.judge(pages, labels).collect()}
    assert any(len(s) > 1 for s in want)
    assert rows == {i: "block" if any(set(s) <= set(t) for s in want) else "allow" for i, t in tokens.items()}
    mined = url_filter.mine(url_filter.parsed(pages), labels).collect()
    # Of tokens on the same pages only one is mined, so each mined rule is one of the enumeration's, up to such tokens.
    assert {tuple(sorted(r.antecedent)) for r in mined} <= want and all(r.index_token in r.antecedent for r in mined)


def test_a_bound_on_combinations_keeps_rules_of_one_token(spark):
    """Many tokens that each miss on some pages: combinations are mined from more pages on, single tokens still from MIN_PAGES."""
    rng = np.random.default_rng(3)
    urls = ["http://h.test/" + "/".join(chr(97 + k) for k in range(14) if rng.random() < 0.8) + ("/bad" if i < 8 else "/worse/too" if i < 40 else "") for i in range(300)]
    pages = url_filter.parsed(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"))
    labels = spark.createDataFrame([(i, 1, int(i < 40)) for i in range(300)], "doc_id long, quality int, toxic int")
    apart, least = url_filter.combinable(pages.withColumn("page", F.col("page_id")).withColumn("bad", F.lit(True)), url_filter.MIN_PAGES, 60_000)
    assert least > url_filter.MIN_PAGES and 0 < apart.agg(F.sum(F.pow(F.lit(2.0), F.size("tokens")))).first()[0] <= 60_000
    mined = {tuple(r.antecedent) for r in url_filter.mine(pages, labels, most_itemsets=60_000).collect()}
    assert {("p:bad",), ("p:too",)} <= mined


def test_long_urls_elsewhere_cost_no_rule(spark):
    """Pages of thirty tokens could have more combinations than any bound, though few of them come again: a rule of two tokens on
    ten pages is found all the same."""
    rng = np.random.default_rng(5)
    marks = ["/u/v" if i < 10 else "/u" if i < 40 else "/v" if i < 70 else "" for i in range(400)]
    urls = ["http://h.test/" + "/".join(f"{'abcdefghijklmnopqrstuvwxy'[k // 25]}-{'abcdefghijklmnopqrstuvwxy'[k % 25]}" for k in rng.permutation(600)[:30]) + m for m in marks]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, int(i < 10 or (i >= 70 and i % 2))) for i in range(400)], "doc_id long, quality int, toxic int")
    assert ("p:u", "p:v") in {tuple(r.antecedent) for r in url_filter.mine(url_filter.parsed(pages), labels).collect()}
    assert {i for i in range(10)} <= {r.page_id for r in url_filter.judge(pages, labels).collect() if r.verdict == "block"}


@pytest.mark.parametrize("total", [n for n in range(7, 2000) if math.ceil(6 / n * n) > 6][:1])
def test_no_rounding_asks_for_a_page_more(spark, total):
    """A rule of two tokens on just MIN_PAGES blocked pages, in a table of a size at which 6 / n * n is over 6."""
    urls = [f"http://h{i}.test/" + ("u/v" if i < 6 else "u" if i < 12 else "v" if i < 18 else "w") for i in range(total)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, int(i < 6)) for i in range(total)], "doc_id long, quality int, toxic int")
    assert {r.page_id for r in url_filter.judge(pages, labels).collect() if r.verdict == "block"} == set(range(6))


def test_a_long_url_in_many_copies_makes_no_flood_of_rules(spark):
    long = "http://h.test/" + "/".join(f"{chr(97 + i % 26)}{'x' * (i // 26)}" for i in range(60))
    pages = spark.createDataFrame([(i, long if i % 2 else f"http://o{i}.test/n") for i in range(300)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(300)], "doc_id long, quality int, toxic int")
    assert {r.page_id for r in url_filter.judge(pages, labels).collect() if r.verdict == "block"} == set(range(1, 300, 2))


# ---- 8 ---------------------------------------------------------------------------------------------------------------


def test_targets_and_copies(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 9), f"s{i % 5}") for i in range(3000)] + [(9000 + i, "w " * 5, None) for i in range(300)], "doc_id long, text string, source string")
    rows = mixing.mixing_report(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    per = {s: [r for r in rows if r.source == s] for s in {r.source for r in rows}}
    total = sum(r.size for r in rows)
    targets = {s: rs[0].target for s, rs in per.items()}
    assert abs(sum(targets.values()) - 1.5 * total) < 1e-6 * total
    for s, rs in per.items():
        assert targets[s] <= 2 * rs[0].source_size and all(r.taken <= 2 * r.size for r in rs)
        assert abs(sum(r.taken for r in rs) - targets[s]) < 0.1 * targets[s]
    again = mixing.mixing_report(docs.repartition(7)).select("doc_id", "taken").collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in rows}


@pytest.mark.parametrize("last", [None, "s3"])
def test_targets_where_the_last_source_ties(spark, last):
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate(((1000, "s0"), (10, "s1"), (10, "s2"), (1000, last)))]
    got = {r.doc_id: r.target for r in mixing.mixing_report(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert {i: round(t, 6) for i, t in got.items()} == {0: 1495.0, 1: 20.0, 2: 20.0, 3: 1495.0}


def test_mixing_on_odd_rows(spark):
    docs = odd_docs(spark)
    assert mixing.mixing_report(docs).count() == docs.count()
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mixed(docs).where("doc_id = 1").count() % 2 == 0
    assert mixing.mixed(empty(spark)).count() == 0 and mixing.mixing_report(empty(spark)).count() == 0


# ---- 1, 9 ------------------------------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark, sf_dir):
    rows = queries.op9_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 100 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_code_switched_words(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.lang: r.text for r in docs.orderBy("n_chars").where("n_chars > 600").collect()}
    both = " ".join(texts["en"].split()[:60] + texts["fr"].split()[:60])
    field = language_id.fit(docs)
    mixed = spark.createDataFrame([(1, both)], "doc_id long, text string")
    spans = language_id.identify(mixed, field, keep=["doc_id"], spans=True).first().spans
    words = [s.lang for s in spans for _ in range(s.n_words)]
    assert len(words) == 120 and words[:60].count("en") > 50 and words[60:].count("fr") > 50


def test_language_on_odd_rows(spark):
    docs = odd_docs(spark)
    field = language_id.fit(docs)
    rows = language_id.identify(docs, field, keep=["doc_id", "text"]).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.lang_pred == "und" and r.score == 0) == (not regex.search(r"\p{L}", r.text or ""))
    none = language_id.fit(empty(spark))
    assert {r.lang_pred for r in language_id.identify(docs, none, keep=["doc_id"]).collect()} == {"und"}


def some_field():
    rng = np.random.default_rng(1)
    field = language_id.Field(["a", "b", "c"])
    field.moves, field.first = rng.normal(size=(3, 3)), rng.normal(size=3)
    return field, rng.normal(size=(7, 3)), np.array([3, 1, 3]), rng.integers(0, 3, 7)


def label_paths(field, evidence):
    """(labels, score) of every way to label one text's words."""
    n = len(evidence)
    for path in itertools.product(range(3), repeat=n):
        yield path, field.first[path[0]] + sum(evidence[i, path[i]] for i in range(n)) + sum(field.moves[a, b] for a, b in zip(path, path[1:]))


def test_posteriors_are_those_of_all_label_paths():
    field, evidence, sizes, _ = some_field()
    want, at = [], 0
    for n in sizes.tolist():
        total = np.zeros((n, 3))
        for path, score in label_paths(field, evidence[at : at + n]):
            total[np.arange(n), list(path)] += np.exp(score)
        want.append(total / total.sum(axis=1, keepdims=True))
        at += n
    assert np.allclose(field.posteriors(evidence, sizes), np.concatenate(want), atol=1e-12)


def test_slopes_are_finite_differences():
    field, evidence, sizes, gold = some_field()

    def told():
        total, at = 0.0, 0
        for n in sizes.tolist():
            scores = dict(label_paths(field, evidence[at : at + n]))
            total += scores[tuple(gold[at : at + n].tolist())] - np.log(sum(np.exp(s) for s in scores.values()))
            at += n
        return total

    for slope, held in zip(field.slopes(evidence, sizes, gold), (evidence, field.moves, field.first)):
        for i in np.ndindex(held.shape):
            was, ends = held[i], []
            for step in (1e-5, -1e-5):
                held[i] = was + step
                ends.append(told())
            held[i] = was
            assert abs((ends[0] - ends[1]) / 2e-5 - slope[i]) < 1e-7


def test_numerals_and_marks_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "½ ² ① _ ٣", None)] + [(i, f"some words of text {'the' if i % 2 else 'der'}", "en" if i % 2 else "de") for i in range(2, 40)], "doc_id long, text string, lang string")
    rows = {r.doc_id: r for r in language_id.identify(docs, language_id.fit(docs), keep=["doc_id"]).collect()}
    assert (rows[1].lang_pred, rows[1].score) == ("und", 0.0)


def test_the_sample_is_bounded_distinct_and_whole(spark):
    long = "word " * 3000 + "end"
    docs = spark.createDataFrame([(i, f"text {i} {long if i == 7 else ''}", "en") for i in range(3000)] + [(9, "again", "fr")] * 500 + [(i, "x", None) for i in range(50)], "doc_id long, text string, lang string")
    sample = language_id.labelled_sample(docs, per_lang=100)
    assert Counter(lang for lang, _ in sample) == {"en": 100, "fr": 1}
    assert sample == language_id.labelled_sample(docs.repartition(7), per_lang=100)
    whole = language_id.labelled_sample(docs.where("doc_id = 7"), per_lang=100)
    assert [t.endswith("end") for _, t in whole if "text 7" in t] == [True]


def test_the_sample_knows_every_language_within_its_bytes(spark):
    docs = spark.createDataFrame([(i, f"{i} " + "w" * 1000, f"l{i % 50}") for i in range(1000)], "doc_id long, text string, lang string")
    found = Counter(lang for lang, _ in language_id.labelled_sample(docs, per_lang=5))  # a bound on hashes leaves some languages a row short
    assert set(found) == {f"l{i}" for i in range(50)} and max(found.values()) == 5
    assert Counter(lang for lang, _ in language_id.labelled_sample(docs, per_lang=5, most_bytes=50 * 2500)).keys() == found.keys()
    assert Counter(lang for lang, _ in language_id.labelled_sample(docs, per_lang=5, most_bytes=50 * 2500)).most_common(1)[0][1] == 2
    assert Counter(lang for lang, _ in language_id.labelled_sample(docs, per_lang=5, most_bytes=1)) == {f"l{i}": 1 for i in range(50)}


def test_scores(spark):
    docs = odd_docs(spark).select("doc_id", "text")
    learn = docs.where(~lm_scoring.held_out())
    rows = lm_scoring.score(docs, learn).collect()
    words = lambda t: [*WORDS.findall((t or "").encode().lower()), None]
    counts = Counter(w for r in learn.collect() for w in words(r.text))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for r in docs.collect():
        w = words(r.text)
        want[r.doc_id, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(r.score < 0 for r in rows)
    assert lm_scoring.score(docs.limit(0), learn.limit(0)).count() == 0


def test_hot_and_cold_words_give_the_same_base(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(60)
    monkeypatch.setattr(lm_scoring, "ENOUGH", 1)
    one = {r.doc_id: round(r.base_score, 6) for r in lm_scoring.score(docs, docs).collect()}
    monkeypatch.setattr(lm_scoring, "HOT_SHARE", 100)
    assert {r.doc_id: round(r.base_score, 6) for r in lm_scoring.score(docs, docs).collect()} == one


def test_training_reaches_every_token_of_every_text(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "ENOUGH", 1)
    trained, averaged = [], lm_scoring.averaged
    monkeypatch.setattr(lm_scoring, "averaged", lambda *given: trained.append(averaged(*given)))
    rng = np.random.default_rng(1)
    late = " ".join(f"n{x}" for x in rng.integers(0, 50, 2000))
    texts = [f"text {i} of many" for i in range(2300)] + ["same words " * 300 + late, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    path = bpe.default_path()
    lm_scoring.score(docs, docs, path)
    assert sum(trained) == lm_scoring.Read([(t or "").encode() for t in texts], lm_scoring.subwords(path)).sizes.sum()


def test_text_behind_any_prefix_moves_the_weights(spark):
    path, units = bpe.default_path(), lm_scoring.subwords(bpe.default_path())
    pairs = np.ones(units.size**2, np.int32)
    docs = [spark.createDataFrame([(1, "same words " * 500 + end)], "doc_id long, text string") for end in ("a cat sat here", "le chien dort")]
    models = [lm_scoring.train_on(lm_scoring.counted(d, path)[2], path, pairs) for d in docs]
    assert not np.array_equal(models[0].p["e"], models[1].p["e"])


def small_model(units: int = 150) -> lm_scoring.Model:
    """A model whose weights are all of a size to matter."""
    rng = np.random.default_rng(5)
    model = lm_scoring.Model(units)
    model.place(rng.permutation(units), rng.integers(1, 50, units))
    for name, w in model.p.items():
        w += np.where(w > -1e3, rng.normal(0, 0.2, w.shape), 0).astype(np.float32)
    return model


def told_plainly(model: lm_scoring.Model, ids: list[int], begin: int) -> float:
    """log10 of a text's probability, one token and one place at a time, in double precision."""
    p, half, total = {n: w.astype(float) for n, w in model.p.items()}, lm_scoring.HALF, 0.0
    inputs = [begin, *ids]
    for t, target in enumerate(ids):
        base = (t // half - 1) * half
        x = {j: p["e"][inputs[j]] + p["pos"][j - base] for j in range(max(base, 0), t + 1)}
        bare = {j: math.exp(float((x[t] @ p["q"]) @ (x[j] @ p["k"])) / math.sqrt(lm_scoring.KEYS)) for j in x}
        gathered = sum(bare[j] * (x[j] @ p["v"]) for j in x) / sum(bare.values())
        h = np.maximum(np.concatenate([x[t], gathered]) @ p["w"] + p["wb"], 0)
        c, m = model.class_of[target], model.member_of[target]
        told, among = h @ p["c"] + p["cb"], h @ p["m"][c] + p["mb"][c]
        total += told[c] - math.log(sum(math.exp(v) for v in told)) + among[m] - math.log(sum(math.exp(v) for v in among))
    return total / math.log(10)


def test_score_is_that_of_plain_loops():
    model, rng = small_model(), np.random.default_rng(6)
    texts = [rng.integers(0, 149, n).tolist() for n in (1, 2, 7, 8, 9, 16, 17, 60)]
    ids, sizes = np.concatenate(texts).astype(np.int32), np.array([len(t) for t in texts])
    assert model.log10s(ids, sizes, 149) == pytest.approx([told_plainly(model, t, 149) for t in texts], rel=1e-4)


def test_slopes_of_the_language_model_are_finite_differences():
    model, rng = small_model(90), np.random.default_rng(7)
    sizes = np.array([5, 20, 33])
    ids = rng.integers(0, 89, sizes.sum()).astype(np.int32)
    seen = model.windows(ids, sizes, 89)
    loss = lambda: -model.log10s(ids, sizes, 89).sum() * math.log(10) / len(ids)
    for name, slope in model.slopes(*seen).items():
        w = model.p[name]
        for at in {int(np.abs(slope).argmax()), int(rng.integers(w.size))}:
            at = np.unravel_index(at, w.shape)
            kept = w[at]
            if kept < -1e3:
                continue
            w[at] = kept + 0.01
            up = loss()
            w[at] = kept - 0.01
            down = loss()
            w[at] = kept
            assert slope[at] == pytest.approx((up - down) / 0.02, abs=2e-4, rel=0.03), (name, at)


def test_model_is_a_probability():
    model = small_model()
    told = [model.log10s(np.array([3, 5, i], np.int32), np.array([3]), 149)[0] for i in range(150)]
    short = model.log10s(np.array([3, 5], np.int32), np.array([2]), 149)[0]
    assert abs(sum(10**t for t in told) / 10**short - 1) < 1e-4


def test_held_out_score_is_no_worse_than_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    scored = lm_scoring.score(docs, docs.where(~lm_scoring.held_out())).where(lm_scoring.held_out())
    told = scored.selectExpr("sum(score)", "sum(base_score)").first()
    assert told[0] > told[1]


def test_subwords_give_the_text_back():
    units = lm_scoring.subwords(bpe.default_path())
    texts = [b"The  Cat\tsat, on \xc3\xa9t\xc3\xa9!", b"", b" ", b"x" * 300]
    read = lm_scoring.Read(texts, units)
    ends = np.cumsum(read.sizes)
    for text, a, z in zip(texts, ends - read.sizes, ends):
        assert read.ids[z - 1] == units.end
        assert b"".join(units.strings[i] for i in read.ids[a : z - 1]) == b"".join(w + b" " for w in text.lower().split())


def test_windows_score_each_token_once():
    model = lm_scoring.Model(50)
    sizes = np.array([1, 16, 17, 100])
    ids = np.arange(sizes.sum()) % 48
    inputs, targets, first = model.windows(ids, sizes, 49)
    assert targets[targets >= 0].tolist() == ids.tolist() and first.sum() == 4
    assert inputs[np.flatnonzero(first), lm_scoring.HALF].tolist() == [49] * 4


def test_frequent_pairs_of_subwords_are_units_of_their_own(monkeypatch):
    monkeypatch.setattr(lm_scoring, "LEAST_MET", 2)
    units = lm_scoring.subwords(bpe.default_path())
    rng = np.random.default_rng(3)
    texts = [b"", b"x", b"abab " * 40, *(b" ".join(bytes(rng.choice(list(b"abc"), 9)) for _ in range(n)) for n in (1, 30, 200))]
    read = lm_scoring.Read(texts, units)
    pairs = np.zeros((units.size, units.size), np.int32)
    np.add.at(pairs, (lm_scoring.before(read.ids, read.sizes, units.begin), read.ids), 1)
    joined = lm_scoring.joined_of(pairs.ravel(), units.end)
    assert len(joined) and pairs.ravel()[joined].min() >= 2
    ids, sizes = lm_scoring.Joins(units.size, joined)(read.ids, read.sizes)
    assert sizes.sum() == len(ids) < 0.7 * len(read.ids)
    back = [[i] if i < units.size else list(divmod(joined[i - units.size], units.size)) for i in ids.tolist()]
    assert sum(back, []) == read.ids.tolist()
    assert (ids[np.cumsum(sizes) - 1] == units.end).all() and (ids == units.end).sum() == len(texts)
    model = lm_scoring.Model(units.size, joined=joined)
    model.set_classes(pairs)
    given = ids[sizes[0] : sizes[0] + sizes[1]][:1].tolist()
    told = [model.log10s(np.array([*given, i], np.int32), np.array([2]), units.begin)[0] for i in range(model.units)]
    assert sum(10**t for t in told) == pytest.approx(10 ** model.log10s(np.array(given, np.int32), np.array([1]), units.begin)[0], rel=1e-3)


# ---- the pipeline ----------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = corpus_pipeline.only_named_languages(spark, docs, sf_dir)
    assert first.count() == docs.where(F.col("text").rlike(r"\p{L}")).count()
    assert corpus_pipeline.only_named_languages(spark, docs.withColumn("lang", F.lit(None).cast("string")), sf_dir).count() == 0
    second = corpus_pipeline.one_of_near_copies(spark, docs, sf_dir)
    classes = ngram_join.classes_of(docs).collect()
    assert {r.doc_id for r in second.collect()} == {r.class_id for r in classes}
    third = corpus_pipeline.without_repeats(spark, second, sf_dir)
    cleaned = {r.doc_id: r.text for r in substring_dedup.dedup(second).collect()}
    assert {r.doc_id: r.text for r in third.collect()} == {i: t for i, t in cleaned.items() if t}
    fourth = corpus_pipeline.mixed_to_weights(spark, third, sf_dir)
    want = {r.doc_id: r.taken // r.size for r in mixing.mixing_report(third).collect() if r.size}
    assert Counter(r.doc_id for r in fourth.collect()) == Counter({i: n for i, n in want.items() if n})
    for stage in (first, second, third, fourth):
        assert stage.columns == docs.columns
    assert corpus_pipeline.as_tokens(spark, fourth, sf_dir).count() == fourth.count()


def test_pipeline_on_odd_rows(spark, sf_dir):
    for docs in (odd_docs(spark), empty(spark)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
            if name != "bpe":
                assert docs.columns == columns
        docs.count()


def test_op8_and_op7_sql(spark, sf_dir):
    from conftest import duck_rows, spark_rows

    from treeloom.llm.oracles import ORACLES

    for name, sql in ORACLES.items():
        assert spark_rows(queries.QUERIES[name](spark, sf_dir)) == duck_rows(sql, sf_dir)


def test_held_out_ids(spark):
    ids = spark.createDataFrame([(i,) for i in [*range(-5, 300), 10**12, None]], "doc_id long")
    rows = ids.select("doc_id", language_id.held_out().alias("four"), lm_scoring.held_out().alias("seven")).collect()
    text = lambda i: b"" if i is None else str(i).encode()
    assert [(r.four, r.seven) for r in rows] == [(zlib.crc32(text(r.doc_id)) % 4 == 2, zlib.crc32(text(r.doc_id)) % 7 == 2) for r in rows]
    assert any(r.four for r in rows) and any(r.seven for r in rows)


def test_products_batched_equal_one_by_one_and_copies_of_queries_are_not_broadcast(spark):
    import numpy as np

    from treeloom.llm import vectors

    rng = np.random.default_rng(5)
    for high in (2, 300, 1 << 24, 1 << 29):
        rows, ids = rng.integers(-high, high + 1, (1300, 12)), rng.permutation(4000)[:1300].astype(np.int64)
        queries, own = rows[:40], ids[:40]
        shard = vectors.Shard(ids, rows)
        at, found, scores = shard.search_all(queries, own, 5)
        for k in range(40):
            one = [x.tolist() for x in shard.search(queries[k], int(own[k]), 5)]
            assert [found[at == k].tolist(), scores[at == k].tolist()] == one
    table = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(300)], "vec_id long, embedding array<float>")
    asked = vectors.top_products(table)
    asked.collect()
    assert "BroadcastHashJoin" not in asked._jdf.queryExecution().executedPlan().toString()
