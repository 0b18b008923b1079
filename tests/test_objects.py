"""Diffs on tree objects, and what a new side brings, against flat sets."""

import hashlib
import random

from treeloom.plans import objects

FILES = "vault_id string, oid string, path string, blob_oid string"
PAIRS = "vault_id string, id string, old string, new string"


def blob(x):
    return hashlib.sha1(str(x).encode()).hexdigest()


def tree_of(spark, commits):
    return spark.createDataFrame([("v", o, p, b) for o, files in commits.items() for p, b in files.items()], FILES)


def test_diffs_open_only_what_differs(spark):
    files = {f"d{i}/e{j}/f{k}.md": blob((i, j, k)) for i in range(12) for j in range(6) for k in range(3)}
    edited = files | {"d3/e2/f1.md": blob("new"), "d3/e2/more.md": blob("more")}
    roots, entries = objects.stored_trees(tree_of(spark, {"a": files, "b": edited, "c": files}))
    ids = {r.oid: r.tree_oid for r in roots.collect()}
    assert ids["a"] == ids["c"] != ids["b"] and entries.select("tree_oid").distinct().count() == (1 + 12 + 72) + 3
    diff = objects.pruned_diff(spark.createDataFrame([("v", "ab", ids["a"], ids["b"]), ("v", "ac", ids["a"], ids["c"]), ("v", "again", ids["a"], ids["b"])], PAIRS), entries)
    want = {(i, p, s) for i in ("ab", "again") for p, s in (("d3/e2/f1.md", "M"), ("d3/e2/more.md", "A"))}
    assert {(r.id, r.path, r.status) for r in objects.status(diff).collect()} == want
    assert diff.opened.count() == 3  # the root, d3 and e2, once for both pairs; nothing for equal roots


def test_new_objects_are_a_difference_of_sets(spark):
    rng = random.Random(3)
    commits, n = {"0": {f"d{rng.randrange(3)}/e{rng.randrange(3)}/f{i}": blob(rng.randrange(9)) for i in range(12)}}, 14
    for c in range(1, n):
        files = dict(commits[str(rng.randrange(c))])
        for _ in range(rng.randint(0, 4)):
            if files and rng.random() < 0.5:
                path = rng.choice(sorted(files))
                moved = files.pop(path)
                if rng.random() < 0.6:
                    files[f"m{rng.randrange(2)}/{path}"] = moved
            else:
                files[rng.choice(["a", "d0/x", "d1", f"d{rng.randrange(3)}/e1/f{rng.randrange(12)}"])] = blob(rng.randrange(15))
        commits[str(c)] = files
    roots, entries = objects.stored_trees(tree_of(spark, commits))
    ids = {r.oid: r.tree_oid for r in roots.collect()}
    below = {}
    for r in entries.collect():
        below.setdefault(r.tree_oid, set()).add((r.child_oid, "tree" if r.mode == objects.FOLDER else "blob"))

    def held(tree):
        out, todo = set(), [(tree, "tree")] if tree else []
        while todo:
            x = todo.pop()
            if x not in out:
                out.add(x)
                todo.extend(below.get(x[0], ()))
        return out

    pairs = [(f"{a}-{b}", a, b) for a in [None, *commits] for b in commits if a != b]
    diff = objects.pruned_diff(spark.createDataFrame([("v", i, a and ids.get(a), ids.get(b)) for i, a, b in pairs], PAIRS), entries)
    got, told = {}, {}
    for r in objects.new_objects(diff, entries).collect():
        got.setdefault(r.id, set()).add((r.oid, r.kind))
    for r in objects.status(diff).collect():
        told.setdefault(r.id, set()).add((r.path, r.old, r.new))
    for i, a, b in pairs:
        old, new = commits.get(a, {}), commits[b]
        assert got.get(i, set()) == held(ids.get(b)) - held(a and ids.get(a)), i
        assert told.get(i, set()) == {(p, old.get(p), new.get(p)) for p in {*old, *new} if old.get(p) != new.get(p)}, i


def test_shared_subtrees_are_spread_out_once(spark, monkeypatch):
    """60 roots of which each differs from the next in one of 40 folders; a tree without files and one that holds the same twice."""
    from treeloom.sources import stores

    base = {f"d{i}/e/f{j}": blob((i, j)) for i in range(40) for j in range(2)}
    commits = {str(c): base | {f"d{c % 40}/e/f0": blob(("new", c))} for c in range(60)} | {"twice": {"a/x": blob(1), "b/x": blob(1), "top": blob(2)}}
    roots, entries = objects.stored_trees(tree_of(spark, commits))
    ids = {r.oid: r.tree_oid for r in roots.collect()}
    counted, spread = stores.saved, []
    monkeypatch.setattr(stores, "saved", lambda df, name: spread.append(counted(df, name)) or spread[-1] if name == "spread" else counted(df, name))
    entries = entries.drop("vault_id").distinct()
    found = stores.flattened(entries, roots.select("tree_oid"))
    got = {}
    for r in found.collect():
        got.setdefault(r.tree_oid, {})[r.path] = r.blob_oid
    assert got == {ids[o]: files for o, files in commits.items()}
    # Two levels: d folders once each (base and changed ones), then the roots themselves.
    assert [t.count() for t in spread] == [2 * (40 + 60) + 3, 60 * 80] or sum(t.count() for t in spread) == 2 * (40 + 60) + 60 * 80 + 3
    hollow = spark.createDataFrame([("r", "40000", "empty", "e"), ("r", "100644", "f", "1"), ("s", "40000", "only", "r")], "tree_oid string, mode string, name string, child_oid string")
    rows = stores.flattened(hollow, spark.createDataFrame([("r",), ("s",)], "tree_oid string")).collect()
    assert sorted(map(tuple, rows)) == [("r", "f", "1"), ("s", "only/f", "1")]
