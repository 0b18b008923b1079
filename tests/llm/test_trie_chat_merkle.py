"""The conversation trie, chat templates and the Merkle manifest against plain loops, and on odd rows."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from treeloom.llm import chat_format, merkle, prefix_trie, templates
from treeloom.llm.templates import Node, Template, TemplateError

CONVS = "conv_id long, turn long, role string, text string, place string, total string, n string"


def odd_convs(spark):
    rows = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (0, 2, "user", "so"), (1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, None, None, None), (2, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 0, "assistant", "été 中"),
        (3, 0, "user", chat_format.PROBE), (3, 1, "tool", "\\[ROLE]x[/ROLE]\\"), (3, 2, "assistant", "<s></s>\\</s>"), (8, 5, "assistant", ""), (8, 6, "", "x[INST"), (9, 0, "user", "hi"), (9, 1, "assistant", "yes"), (-7, 0, "user", "low"), (-10, 0, "user", "base"),
        (None, 1, "user", "lost"), (None, 0, "assistant", "found"), (40, 3, "user", "long " * 30_000),
    ]
    long = [(25, i, "user" if i % 2 else "assistant", f"t{i % 3}") for i in range(40)] + [(26, i, "user" if i % 2 else "assistant", f"t{i % 3 if i < 37 else 9}") for i in range(41)] + [(60 + i, 0, "user", "hi") for i in range(20)]
    return spark.createDataFrame([(*r, "p", "t", "n") for r in rows + long], CONVS)


def in_order(convs):
    by = defaultdict(list)
    for r in convs.collect():
        by[r.conv_id].append((r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
    return {c: [(role, text) for _, _, role, text in sorted(rows)] for c, rows in by.items()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- 11 --------------------------------------------------------------------------------------------------------------


def plain_trie(convs):
    own = {c: t for c, t in in_order(convs).items() if c is not None}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    rows = []
    for node, cs in members.items():
        inside = [n for n in members if n[: len(node)] == node]
        leaves = [n for n in inside if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in inside)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in inside if n)
        ends = ",".join(map(str, sorted(c for c in cs if len(whole[c]) == len(node))))
        rows.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), sum(len(n) == len(node) + 1 for n in inside), len(leaves), saved, sha(ends)))
    return Counter(rows)


@pytest.mark.parametrize("segment,batch,full", [(512, 512, 200_000), (4, 3, 20), (7, 1, 1)])
def test_trie_is_the_plain_one(spark, segment, batch, full):
    convs = odd_convs(spark)
    found = prefix_trie.trie(convs.repartition(3), segment, batch, full)
    assert Counter(map(tuple, found.collect())) == plain_trie(convs)


def test_trie_of_nothing(spark):
    assert prefix_trie.trie(odd_convs(spark).limit(0)).count() == 0


@settings(deadline=None, max_examples=200)
@given(st.lists(st.lists(st.sampled_from("ab"), min_size=1, max_size=20), min_size=1, max_size=30), st.integers(1, 5), st.sampled_from([0, 6]))
def test_z_fast_trie(words, batch, start):
    """Exits are where a walk leaves the trie, and nodes are all prefixes with their counts."""
    def key(word, at):
        hashes = [hash(tuple(word[:d])) for d in range(len(word) + 1)]
        return prefix_trie.Key(start, hashes, [1] * len(word), at, (at, 1))

    trie, seen = prefix_trie.ZFastTrie(), []
    for i in range(0, len(words), batch):
        for word in words[i : i + batch]:
            node, below = trie.exit_of(key(word, 0))
            deepest = max((next((d for d in range(min(len(w), len(word)), 0, -1) if w[:d] == word[:d]), 0) for w in seen), default=0)
            assert node.high - start <= deepest and (below is None or below.low == node.high)
            assert deepest == node.high - start or below is not None and deepest <= below.high - start
        trie.insert([key(w, i + k) for k, w in enumerate(words[i : i + batch])])
        seen += words[i : i + batch]
    want = Counter(tuple(w[:d]) for w in words for d in range(1, len(w) + 1))
    least = {p: min(i for i, w in enumerate(words) if tuple(w[: len(p)]) == p) for p in want}
    got = {(depth - start, h): (parent, n, low, w) for depth, h, parent, _, n, low, *w in trie.nodes()}
    assert got == {(len(p), hash(p)): (hash(p[:-1]), n, least[p], [sum(i for i, w in enumerate(words) if tuple(w[: len(p)]) == p), n]) for p, n in want.items()}


def test_two_fattest():
    for a in range(40):
        for b in range(a + 1, 41):
            assert prefix_trie.two_fattest(a, b) == max(range(a + 1, b + 1), key=lambda x: x & -x)


# ---- 12 --------------------------------------------------------------------------------------------------------------


def test_formats_read_back(spark):
    convs = odd_convs(spark)
    want = {}
    for c, turns in in_order(chat_format.with_probe(convs)).items():
        text, spans = chat_format.compiled(chat_format.TEMPLATE).render([{"role": r, "text": t} for r, t in turns])
        assert chat_format.turns_of(text) == turns
        learned = "".join(t for r, t in turns if r == "assistant")
        assert "".join(chat_format.unguarded(text[b:e]) for b, e in spans) == learned
        want[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), sha(learned), len(text))
    found = chat_format.digests(chat_format.formatted(chat_format.with_probe(convs.repartition(3))))
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == want
    assert want[-1] == (2, sha(f"user\n{chat_format.PROBE}\nassistant\n{chat_format.PROBE}\n"), len(chat_format.PROBE), sha(chat_format.PROBE), want[-1][4])
    assert chat_format.digests(chat_format.formatted(convs.limit(0))).count() == 0


def test_pieces_are_the_whole(spark):
    convs = odd_convs(spark)
    source = "{% set a = 'begin ' %}{{ a }}{% for m in messages %}{{ loop.index }}/{{ loop.length }} {{ m.role }}{% if loop.last %}!{% endif %};{% endfor %} end"
    pieces = defaultdict(dict)
    for r in chat_format.formatted(convs, source).collect():
        pieces[r.conv_id][r.place] = r.piece
    for c, turns in in_order(convs).items():
        assert "".join(pieces[c][i] for i in range(len(turns))) == "begin " + "".join(f"{i + 1}/{len(turns)} {r}{'!' if i == len(turns) - 1 else ''};" for i, (r, _) in enumerate(turns)) + " end"


@settings(deadline=None, max_examples=300)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[TEXT]"]), st.lists(st.sampled_from(["<", "s", ">", "/", "[", "INST", "]", "\\", " ", "ROLE", "TEXT", "SYS", "\n", "é"]), max_size=12).map("".join)), min_size=1, max_size=6))
def test_no_text_passes_for_a_mark(turns):
    text, _ = chat_format.compiled(chat_format.TEMPLATE).render([{"role": r, "text": t} for r, t in turns])
    assert chat_format.turns_of(text) == turns
    for _, t in turns:
        assert not any(c in chat_format.guarded(t) for c in chat_format.CONTROL) and chat_format.unguarded(chat_format.guarded(t)) == t


@pytest.mark.parametrize("source,names,want", [
    ("a {#- no -#} b", {}, "ab"), ("{{ 1 + 2 * 3 }}", {}, "7"), ("{{ -x // 2 }}", {"x": 5}, "-3"), ("{{ 'a' ~ 1 ~ none ~ true }}", {}, "a1true"), ("{{ x.y['z'][1] }}", {"x": {"y": {"z": [1, 2]}}}, "2"), ("{{ x.no.no }}", {"x": {}}, ""),
    ("{% if a and not b or c %}1{% elif a == 'x' %}2{% else %}3{% endif %}", {"a": "x", "b": 1}, "2"), ("{{ 'in' if 'b' in x and 'z' not in x else 'out' }}", {"x": "abc"}, "in"), ("{% for i in x %}{% set s = i %}{{ s | upper }}{% endfor %}{{ s }}", {"x": ["a", "b"]}, "AB"),
    ("{{ '%}' ~ \"}}\" ~ 'it\\'s\\n' }}", {}, "%}}}it's\n"), ("x  {%- if true %}  y {%- endif %} z", {}, "x  y z"), ("{{ ' a ' | trim | length }}", {}, "1"), ("{{ a if b }}", {"a": 1}, ""), ("{% if 0 %}{{ 1 // 0 }}{% endif %}ok", {}, "ok"),
])
def test_template_language(source, names, want):
    assert Template(source).render([], **names)[0] == want


@pytest.mark.parametrize("source", ["{{ }}", "{{ a", "{% if a %}", "{% endif %}", "{% else %}", "{{ a b }}", "{{ 'a }}", "{{ f(1) }}", "{{ a | nothing }}", "{% while a %}{% endwhile %}", "{% if a %}{% else %}{% else %}{% endif %}", "{{ " + "(" * 100 + "1" + ")" * 100 + " }}"])
def test_what_is_no_template(source):
    with pytest.raises(TemplateError):
        Template(source)


@pytest.mark.parametrize("source,names", [("{{ x.__class__ }}", {"x": 1}), ("{{ x['__class__'] }}", {"x": "text"}), ("{{ 'a' * 1000000 }}", {}), ("{{ 1 // 0 }}", {}), ("{{ x + 1 }}", {"x": "a"}), ("{% for c in x %}{% endfor %}", {"x": "abc"}), ("{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}", {})])
def test_what_templates_may_not_do(source, names):
    with pytest.raises(TemplateError):
        Template(source).render([], **names)


def test_folding():
    assert Template("{{ 'a' ~ (1 + 2) | length }}{% if 1 > 2 %}no{% elif true %}b{% else %}c{% endif %}d").tree == Node("block", (Node("text", ("a0bd",)),))
    assert Template("{{ x if false else y }}").tree == Node("block", (Node("write", (Node("name", ("y",)),)),))
    assert templates.folded(Node("binary", ("//", Node("value", (1,)), Node("value", (0,))))).kind == "binary"
    with pytest.raises(TemplateError):
        Template("{{ messages | length }}{% for m in messages %}{% endfor %}").piece({}, 0, 1)


# ---- 13 --------------------------------------------------------------------------------------------------------------


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, more=0):
    return sha("".join(map(field, (r.doc_id, r.source, r.lang, None if r.n_chars is None else r.n_chars + more, r.text))))


def plain_tree(leaves):
    rows = [leaves]
    while len(rows[-1]) > 1:
        rows.append([sha("".join(rows[-1][i : i + 2])) for i in range(0, len(rows[-1]), 2)])
    return rows


def plain_path(rows, i):
    out = []
    for r in rows[:-1]:
        out.append("-" if i ^ 1 >= len(r) else ("l" if i & 1 else "r") + r[i ^ 1])
        i >>= 1
    return out


def plain_manifest(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.lang].append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for x in langs:
        by[x].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
    trees = [plain_tree([leaf(r) for r in by[x]]) for x in langs]
    top = plain_tree([t[-1][0] for t in trees])
    out = Counter()
    for k, x in enumerate(langs):
        for i, r in enumerate(by[x]):
            path = plain_path(trees[k], i) + plain_path(top, k)
            now = leaf(r, 1 if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0 else 0)
            for s in path:
                now = sha(now if s == "-" else s[1:] + now if s[0] == "l" else now + s[1:])
            out[r.doc_id, leaf(r), trees[k][-1][0], top[-1][0], sha("".join(s[1:] for s in path if s != "-")), now, now == top[-1][0]] += 1
    return out


def odd_docs(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, leaf string, `__at` int, tree string"
    rows = [(i, f"text {i}", ["en", "de", None, "", "é", "zz"][i % 6 if i < 40 else 0], "s", i) for i in range(90)]
    rows += [(7, "text 7", "de", "s", 7)] * 9 + [(None, None, None, None, None), (None, "a", "en", "s", 1), (14, "", "en", None, None), (21, None, "one", "s", 5), (28, "w" * 200_000, "en", "s", 2)]
    return spark.createDataFrame([(*r, "x", 3, "t") for r in rows], schema)


@pytest.mark.parametrize("levels", [1, 2, 3, 10])
def test_manifest(spark, levels):
    docs = odd_docs(spark)
    found = merkle.manifest(docs.repartition(3), merkle.tampered(), levels).cache()
    assert Counter(map(tuple, merkle.proofs(found).collect())) == plain_manifest(docs.collect())
    for r in found.where("version IS NOT NULL").collect():
        assert len(r.version) == len(r.path) + 1
        again = [r.version[0]]
        for s in r.path:
            again.append(merkle.step_up(again[-1], s))
        assert again == r.version
    found.unpersist()


def test_manifest_of_few(spark):
    docs = odd_docs(spark)
    assert merkle.manifest(docs.limit(0), merkle.tampered()).count() == 0
    one = docs.where("doc_id = 21 AND lang = 'one'")
    assert Counter(map(tuple, merkle.proofs(merkle.manifest(one, merkle.tampered())).collect())) == plain_manifest(one.collect())


def test_versions_share_nodes():
    tree = merkle.PersistentTree([sha(str(i)) for i in range(13)], 4)
    before, root = list(tree.digests), tree.root
    made = tree.version(root, 12, "f" * 64)
    assert tree.digests[: len(before)] == before and len(tree.digests) == len(before) + 5 and tree.root == root
    again = tree.version(made[-1], 12, sha("12"))
    assert tree.digests[again[-1]] == tree.digests[root]  # the old content has the old digest
    assert tree.steps(root, 3) == tree.steps(made[-1], 3)[:3] + [tree.steps(root, 3)[3]]
