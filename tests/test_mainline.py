"""Main lines against a plain loop over each vault's commits, with line merges, ghosts, restores and forged folds."""

import hashlib
import random

from treeloom.operators import dag, fold, mainline
from treeloom.plans import trees as plans

PROTOCOL = "test"


def sha(kind, payload):
    return hashlib.sha1(f"{kind} {len(payload)}".encode() + b"\x00" + payload).hexdigest()


def tree_id(files):
    """The id of the nested tree of {path: blob}."""
    here, below = {}, {}
    for path, blob in files.items():
        head, _, rest = path.partition("/")
        if rest:
            below.setdefault(head, {})[rest] = blob
        else:
            here[head] = ("100644", blob)
    here |= {name: ("40000", tree_id(inner)) for name, inner in below.items()}
    order = sorted(here, key=lambda n: (n + "/" * (here[n][0] == "40000")).encode())
    return sha("tree", b"".join(f"{here[n][0]} {n}".encode() + b"\x00" + bytes.fromhex(here[n][1]) for n in order))


def commit_id(tree, parents, time, kind="fold"):
    who = f"{PROTOCOL} <{PROTOCOL}@localhost> {time} +0000\n"
    return sha("commit", (f"tree {tree}\n" + "".join(f"parent {p}\n" for p in parents) + f"author {who}committer {who}\n{PROTOCOL}: {kind}\n").encode())


def merge(base, ours, theirs, texts):
    out = {}
    for path in {*base, *ours, *theirs}:
        b, o, t = (x.get(path) for x in (base, ours, theirs))
        got = o if o == t or t == b else t
        if None not in (b, o, t) and len({b, o, t}) == 3:
            text = fold.merged_text(texts[b], texts[o], texts[t])
            got = fold.text_oid(text)
            texts[got] = text
        if got:
            out[path] = got
    return out


class Vault:
    """Commits by id: parents, files, counter, node, time, whether primitive, named readds."""

    def __init__(self):
        self.commits, self.texts = {}, {}

    def above(self, oid):
        seen, stack = set(), [oid]
        while stack:
            for p in self.commits.get(stack.pop(), {"parents": []})["parents"]:
                if p not in seen:
                    seen.add(p)
                    stack.append(p)
        return seen

    def key(self, oid):
        return self.commits[oid]["counter"], self.commits[oid]["node"], oid

    def touch(self, oid, path):
        c = self.commits.get(oid)
        if not c or not c["primitive"] or len(c["parents"]) != 1 or c["parents"][0] not in self.commits:
            return None
        before, now = path in self.commits[c["parents"][0]]["files"], path in c["files"]
        return None if before == now else "add" if now else "delete"

    def ghost(self, oid):
        c = self.commits[oid]
        if not c["primitive"] or len(c["parents"]) != 1:
            return False
        parent = c["parents"][0]
        history = self.above(oid)
        if history - set(self.commits):
            return False
        for path in set(c["files"]) - set(self.commits[parent]["files"]):
            told = [(self.key(o), self.touch(o, path)) for o in {parent, *self.above(parent)} if self.touch(o, path)]
            if told and max(told)[1] == "delete" and max(told)[0][2] not in c["readds"]:
                return True
        return False

    def tips(self, known):
        left = [o for o in known if self.commits[o]["primitive"] and not self.ghost(o)]
        return sorted((o for o in left if not any(o in self.above(q) for q in left)), key=self.key)

    def base(self, a, b):
        common = {a, *self.above(a)} & {b, *self.above(b)}
        return min((c for c in common if not any(c in self.above(d) for d in common)), default=None)

    def files(self, oid):
        return self.commits[oid]["files"] if oid else {}

    def put_fold(self, files, parents, time):
        oid = commit_id(tree_id(files), parents, time)
        self.commits[oid] = {"parents": parents, "files": files, "counter": 0, "node": "", "time": time, "primitive": False, "readds": set()}
        return oid

    def main(self, known):
        tips = self.tips(known)
        if not tips:
            return commit_id(plans.EMPTY_TREE, [], 0, "genesis"), {}
        if len(tips) == 1:
            return commit_id(tree_id(self.files(tips[0])), tips, self.commits[tips[0]]["time"]), self.files(tips[0])
        acc, made = tips[0], []
        for tip in tips[1:]:
            files = merge(self.files(self.base(acc, tip)), self.files(acc), self.files(tip), self.texts)
            acc = self.put_fold(files, [acc, tip], max(self.commits[acc]["time"], self.commits[tip]["time"]))
            made.append(acc)
        done = acc, self.files(acc)
        for oid in made:  # folds on the way are not among the vault's commits
            self.made = getattr(self, "made", {}) | {oid: self.commits.pop(oid)}
        return done


def grown(seed):
    rng = random.Random(seed)
    v = Vault()
    paths = ["a.md", "b.md", "d/c.md", "d/e/f.md"]
    for n in range(rng.randint(6, 12)):
        oid = hashlib.sha1(f"{seed}/{n}".encode()).hexdigest()
        earlier = list(v.commits)
        if n == 0:
            parents, files = [], {}
        else:
            parents = rng.sample(earlier, min(len(earlier), 2 if rng.random() < 0.15 else 1))
            files = dict(v.commits[parents[0]]["files"])
            for path in rng.sample(paths, 2):
                if path in files and rng.random() < 0.4:
                    del files[path]
                else:
                    lines = v.texts[files[path]].split("\n") if path in files else [f"{path} {i}" for i in range(5)]
                    lines[rng.randrange(5)] += f" {n}"
                    text = "\n".join(lines) + ("\x00" if rng.random() < 0.1 else "")
                    files[path] = fold.text_oid(text)
                    v.texts[files[path]] = text
        v.commits[oid] = {"parents": parents, "files": files, "counter": 1 + max((v.commits[p]["counter"] for p in parents), default=0), "node": str(rng.randint(1, 3)), "time": 1000 + n * 7 % 5, "primitive": n == 0 or rng.random() < 0.9, "readds": set(rng.sample(earlier, min(len(earlier), 2))) if rng.random() < 0.3 else set()}
    if seed % 7 == 3:
        v.commits[next(iter(v.commits))]["parents"] = ["0" * 40]  # a history that is not whole
    return v


def tables(spark, vaults):
    commits = spark.createDataFrame([(str(i), o, c["node"], c["counter"], c["time"], c["primitive"]) for i, v in enumerate(vaults) for o, c in v.commits.items()], "vault_id string, oid string, node_id string, counter long, time long, is_primitive boolean")
    edges = spark.createDataFrame([(str(i), o, p) for i, v in enumerate(vaults) for o, c in v.commits.items() for p in c["parents"]], "vault_id string, child string, parent string")
    files = spark.createDataFrame([(str(i), o, p, b) for i, v in enumerate(vaults) for o, c in v.commits.items() for p, b in c["files"].items()], "vault_id string, oid string, path string, blob_oid string")
    blobs = spark.createDataFrame(sorted({(b, t) for v in vaults for b, t in v.texts.items()}), "blob_oid string, content string")
    readds = spark.createDataFrame([(str(i), o, r) for i, v in enumerate(vaults) for o, c in v.commits.items() for r in c["readds"]], "vault_id string, oid string, touch_oid string")
    return commits, edges, files, blobs, readds


def test_main_lines_are_those_of_a_plain_loop(spark):
    vaults = [grown(s) for s in range(40)]
    commits, edges, files, blobs, readds = tables(spark, vaults)
    done = mainline.compute_main(commits, edges, files, blobs, PROTOCOL, readds)
    want = [v.main(list(v.commits)) for v in vaults]
    assert {r.vault_id: r.main_oid for r in done.mains.collect()} == {str(i): m for i, (m, _) in enumerate(want)}
    assert {(r.vault_id, r.path, r.blob_oid) for r in done.files.collect()} == {(str(i), p, b) for i, (_, f) in enumerate(want) for p, b in f.items()}
    assert any(any(v.ghost(o) for o in v.commits) for v in vaults) and len({m for m, _ in want}) > 30
    made = {b for v in vaults for b in v.texts} - {r.blob_oid for r in blobs.collect()}
    assert made and made <= {r.blob_oid for r in done.texts.collect()}


def test_a_time_in_the_past_folds_what_was_known_then(spark):
    vaults = [grown(s) for s in range(40, 50)]
    commits, edges, files, blobs, readds = tables(spark, vaults)
    snaps = spark.createDataFrame([("0", "1002", [next(iter(vaults[0].commits))])], "vault_id string, name string, frontier array<string>")
    asked = commits.selectExpr("vault_id", "'1002' AS target").distinct()
    targets = mainline.resolved(asked, snaps)
    known = mainline.known_of_targets(commits, edges, targets)
    done = mainline.compute_main(known, edges, files, blobs, PROTOCOL, readds, commits)
    want = {}
    for i, v in enumerate(vaults):
        then = [next(iter(v.commits))] if i == 0 else [o for o, c in v.commits.items() if c["time"] <= 1002]  # a snapshot's name comes first
        want[str(i)] = v.main(then)[0]
    assert {r.vault_id: r.main_oid for r in done.mains.collect()} == want


def test_forged_folds_and_what_builds_on_them_are_found(spark):
    vaults = [v for v in map(grown, range(60, 75)) if len(v.tips(list(v.commits))) > 1]
    wrong = set()
    folds = []
    for i, v in enumerate(vaults):
        v.main(list(v.commits))
        made, old = dict(v.made), set(v.commits)
        renamed = {}
        for n, (oid, c) in enumerate(made.items()):
            parents = [renamed.get(p, p) for p in c["parents"]]
            own = oid
            if i % 3 == 1 and n == 0:  # another tree, under the id that goes with it
                c = c | {"files": c["files"] | {"planted.md": fold.text_oid("x")}}
                own = commit_id(tree_id(c["files"]), parents, c["time"])
            elif parents != c["parents"]:
                own = commit_id(tree_id(c["files"]), parents, c["time"])
            renamed[oid] = own
            v.commits[own] = c | {"parents": parents}
            folds.append((str(i), own, parents))
            if i % 3 == 1:
                wrong.add((str(i), own))
        tip = next(iter(old))
        extra = [(commit_id(plans.EMPTY_TREE, [], 0, "genesis"), [], False), ("1" * 40, [], True), ("2" * 40, sorted(old)[:3], True), (commit_id(tree_id(v.files(tip)), [tip], v.commits[tip]["time"]), [tip], False), ("3" * 40, [tip], True)]
        for oid, parents, bad in extra:
            folds.append((str(i), oid, parents))
            v.commits[oid] = {"parents": parents, "files": {}, "counter": 0, "node": "", "time": 0, "primitive": False, "readds": set()}
            if bad:
                wrong.add((str(i), oid))
    assert len(wrong) > 3 * len(vaults)
    commits, edges, files, blobs, _ = tables(spark, vaults)
    sent = spark.createDataFrame(folds, "vault_id string, oid string, parents array<string>")
    got = mainline.wrong_folds(sent, commits, edges, files, blobs, PROTOCOL)
    assert {(r.vault_id, r.oid) for r in got.collect()} == wrong


def test_deep_folders_and_long_histories(spark):
    deep = {"/".join(f"d{i}" for i in range(30)) + "/f.md": "a" * 40, "d0/x.md": "b" * 40, "top.md": "c" * 40}
    tree = spark.createDataFrame([("v", p, b) for p, b in deep.items()], "vault_id string, path string, blob_oid string")
    assert plans.flat_tree_oids(tree).first().tree_oid == tree_id(deep)
    chain = spark.createDataFrame([("v", str(i + 1), str(i)) for i in range(70)], "vault_id string, child string, parent string")
    assert dag.closure(chain).count() == 70 * 71 // 2
    seen = dag.reachable(spark.createDataFrame([("v", "70")], "vault_id string, oid string"), chain.selectExpr("vault_id", "child AS src", "parent AS dst"))
    assert seen.count() == 71


def test_ids_of_many_steps_over_many_files(spark):
    """500 tips over 5,000 files in 50 folders: each step changes a file, every 25th takes one away; rows grow with the changes."""
    first = [("v", 1, f"d{i % 50}/f{i}.md", f"{i:040x}") for i in range(5_000)]
    later = [("v", k, f"d{k % 50}/f{k}.md", None if k % 25 == 0 else f"{k + 9000:040x}") for k in range(2, 501)]
    found = plans.step_tree_oids(spark.createDataFrame(first + later, "vault_id string, k int, path string, blob_oid string")).collect()
    assert len(found) == 50 + 1 + 2 * 499
    roots = {r.k: r.tree_oid for r in found if r.dir == ""}
    files = {p: b for _, _, p, b in first}
    for k in range(1, 501):
        for _, step, p, b in later[k - 2 : k - 1] if k > 1 else []:
            assert step == k
            files.pop(p) if b is None else files.update({p: b})
        if k % 100 == 0 or k < 4:
            assert roots[k] == tree_id(files), k
    gone = plans.step_tree_oids(spark.createDataFrame([("v", 1, "a/b.md", "a" * 40), ("v", 3, "a/b.md", None)], "vault_id string, k int, path string, blob_oid string"))
    assert sorted((r.k, r.dir, r.tree_oid) for r in gone.collect() if r.dir == "")[1] == (3, "", None)
