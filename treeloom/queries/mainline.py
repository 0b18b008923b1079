"""Main lines, restores and checks of recorded folds over the fleet of `events`."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import saved, shared_dir
from ..operators import dag, fold, history, mainline
from ..plans import trees as plans
from ..sources import fleet
from ..streaming import maintained
from .history import PROTOCOL, _messages


class Fleet(NamedTuple):
    commits: DataFrame
    edges: DataFrame
    trees: DataFrame
    blobs: DataFrame
    readds: DataFrame


def _fleet(spark, sf_dir, texts: bool = False) -> Fleet:
    """Commits as their messages tell them, and a small tree per commit: three files that change with the commit, three in a
    folder that only come and go. The changing ones are binary, so that both sides' change means theirs; with texts they have
    lines, of which either side changes some."""
    told = saved(history.classified(_messages(spark, sf_dir), PROTOCOL), "told")
    commits = told.select("vault_id", "oid", F.coalesce("t_node", F.lit("")).alias("node_id"), F.coalesce("t_counter", F.lit(0).cast("long")).alias("counter"), F.col("author_time").alias("time"), "is_primitive")
    readds = told.select("vault_id", "oid", F.explode("readds").alias("touch_oid"))
    held = told.select("vault_id", "oid", "counter", "user_id", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("p")).where("(counter * 7 + p * 5) % 11 < 8")
    p, age = F.col("p").cast("string"), F.expr("counter div 3").cast("string")
    if texts:
        line = lambda i: F.concat(F.lit(f"line {i}"), F.when(F.expr(f"(user_id + counter + p) % 4 = {i}"), F.concat(F.lit(" by "), F.col("user_id").cast("string"), F.lit("/"), age)).otherwise(F.lit("")), F.lit("\n"))
        changing = F.concat(*[line(i) for i in range(4)])
    else:
        changing = F.concat(age, F.lit("/"), p, F.lit("\x00"))
    content = F.when(F.col("p") <= 3, changing).otherwise(F.concat(F.lit("text "), p, F.lit("\n")))
    path = F.concat(F.when(F.col("p") <= 3, F.lit("f")).otherwise(F.lit("d/f")), p, F.lit(".md"))
    files = saved(held.select("vault_id", "oid", path.alias("path"), content.alias("content")).withColumn("blob_oid", fleet.blob_oid(F.col("content"))), "files")
    # Many operators read the edges, and the derivation sorts every vault twice.
    return Fleet(commits, saved(fleet.edges(spark, sf_dir), "edges"), files.drop("content"), files.select("blob_oid", "content").dropDuplicates(["blob_oid"]), readds)


def _main(f: Fleet, known: DataFrame, dropped: DataFrame | None = None) -> mainline.Main:
    return mainline.compute_main(known, f.edges, f.trees, f.blobs, PROTOCOL, f.readds, f.commits, dropped)


def g3_compute_main(spark, sf_dir):
    """The main commit of every vault, its tree, and how many tips it folds."""
    f = _fleet(spark, sf_dir)
    return _main(f, f.commits).mains


def t11_maintained_mains(spark, sf_dir):
    """The same mains, kept up to date: the fleet's commits come in two batches, in the second of which every vault goes on from the
    steps that the first one stored."""
    f = _fleet(spark, sf_dir)
    order = Window.partitionBy("vault_id").orderBy("time", "counter", "oid")
    dealt = saved(f.commits.withColumn("part", F.when(F.percent_rank().over(order) < 0.7, 0).otherwise(1)), "dealt")
    root = f"{shared_dir(spark)}/treeloom-{uuid.uuid4().hex}/mains"
    for batch in (0, 1):
        own = dealt.where(F.col("part") == batch)
        oids = own.select("vault_id", "oid")
        trees = f.trees.join(oids, ["vault_id", "oid"], "left_semi").select("vault_id", "oid", "path", "blob_oid")
        blobs = trees.select("vault_id", "blob_oid").distinct().join(f.blobs, "blob_oid").select("vault_id", "blob_oid", "content")
        edges = f.edges.select("vault_id", "child", "parent").join(oids.withColumnRenamed("oid", "child"), ["vault_id", "child"], "left_semi")
        maintained.advance(maintained.Arrived(own.drop("part"), edges, trees, blobs, f.readds), root, batch, PROTOCOL, 64)
    return maintained.mains(spark, root)


def g3_main_files(spark, sf_dir):
    """The files of every vault's main tree."""
    f = _fleet(spark, sf_dir)
    return _main(f, f.commits).files


def u1_line_merges(spark, sf_dir):
    """Main trees where both sides change lines of a file: the files, those that a merge of lines made with their texts."""
    f = _fleet(spark, sf_dir, texts=True)
    done = _main(f, f.commits)
    return done.files.join(done.texts, "blob_oid", "left").select("vault_id", "path", "blob_oid", "content")


def a5_effective_known(spark, sf_dir):
    """Primitives that the fold leaves out, since they bring back what was deleted before them."""
    f = _fleet(spark, sf_dir)
    return mainline.ghosts(f.commits, f.edges, f.trees, f.readds)


def a3_touch_on_dag(spark, sf_dir):
    """For every commit, synthetic ones and merges too, and every path of its vault the latest touch on or before it."""
    f = _fleet(spark, sf_dir)
    told = mainline.touches(f.commits, f.edges, f.trees)
    return history.latest_touches_on_dag(None, told, f.commits, f.edges).drop("whole")


def a4_commit_touches(spark, sf_dir):
    """What every primitive with a sole parent adds and deletes."""
    f = _fleet(spark, sf_dir)
    return mainline.touches(f.commits, f.edges, f.trees).select("vault_id", "oid", "path", "kind")


def a7_main_folds(spark, sf_dir):
    """Every fold commit on the way to a main commit: the number of its step, its id, tree, parents and time."""
    f = _fleet(spark, sf_dir)
    return _main(f, f.commits).folds.select("vault_id", "k", "oid", "tree_oid", F.array_join("parents", ",").alias("parents"), "time")


def _recorded(done: mainline.Main) -> DataFrame:
    """The folds as a peer sends them: every third one is forged, with an empty tree and the id that goes with it."""
    forged = F.col("k") == 3
    empty = mainline.fold_oid(F.lit(plans.EMPTY_TREE), F.col("parents"), F.col("time"), PROTOCOL)
    sent = done.folds.select("vault_id", "k", F.when(forged, empty).otherwise(F.col("oid")).alias("oid"), "parents", "time", F.when(forged, F.col("oid")).alias("was"))
    named = sent.where("was IS NOT NULL").select("vault_id", F.col("was").alias("__was"), F.col("oid").alias("__now"))
    after = sent.where("size(parents) = 2").join(named, "vault_id", "left").select("vault_id", "k", "oid", F.transform("parents", lambda p: F.when(p == F.col("__was"), F.col("__now")).otherwise(p)).alias("parents"), "time")
    return after.unionByName(sent.where("size(parents) = 1").select("vault_id", "k", "oid", "parents", "time"))


def _check_tables(f: Fleet, done: mainline.Main, sent: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Recorded folds, and the commits, edges and trees that they are checked against."""
    commits = f.commits.select("vault_id", "oid", "time").unionByName(sent.select("vault_id", "oid", "time"))
    edges = f.edges.unionByName(sent.select("vault_id", F.col("oid").alias("child"), F.explode("parents").alias("parent")))
    trees = f.trees.unionByName(fold.standing(done.changes, done.folds).join(sent.where("k <> 3").select("vault_id", "k", "oid"), ["vault_id", "k"]).select("vault_id", "oid", "path", "blob_oid"))
    return sent, commits, edges, trees


def g4_verify_folds(spark, sf_dir):
    """Recorded folds that do not come out of their own parents, and those that build on one."""
    f = _fleet(spark, sf_dir)
    done = _main(f, f.commits)
    sent = saved(_recorded(done), "sent")
    return mainline.wrong_folds(*_check_tables(f, done, sent), f.blobs, PROTOCOL)


def g6_restore_at(spark, sf_dir):
    """Every vault's files as they were at noon of its day: the fold of what was authored by then."""
    f = _fleet(spark, sf_dir)
    noon = f.commits.groupBy("vault_id").agg((F.expr("min(time) div 86400") * 86400 + 43200).alias("at"))
    return _main(f, mainline.known_at(f.commits, noon)).files


def _newest_tree(f: Fleet) -> DataFrame:
    tip = f.commits.groupBy("vault_id").agg(F.max_by("oid", F.struct("time", "oid")).alias("oid"))
    return f.trees.join(tip, ["vault_id", "oid"]).select("vault_id", "path", "blob_oid")


def g7_restore_snapshot(spark, sf_dir):
    """Plans to restore every vault to its target over its newest commit's files: a snapshot's name where one has it (here for
    vaults whose name ends in an even digit: what was known at commit 12), else a time."""
    f = _fleet(spark, sf_dir)
    first = fleet.commits(spark, sf_dir).where("counter <= 12").select("vault_id", "oid")
    even = F.substring("vault_id", -1, 1).isin("0", "2", "4", "6", "8")
    snaps = dag.frontier(first, f.edges).where(even).groupBy("vault_id").agg(F.sort_array(F.collect_list("oid")).alias("frontier")).withColumn("name", F.lit("early"))
    wanted = f.commits.select("vault_id").distinct().select("vault_id", F.when(even, F.lit("early")).otherwise(F.concat(F.substring("vault_id", 1, 10), F.lit("T12:00:00Z"))).alias("target"))
    known = mainline.known_of_targets(f.commits, f.edges, saved(mainline.resolved(wanted, snaps), "targets"))
    return plans.restore(_main(f, known).files, _newest_tree(f))


def s9_write_trees(spark, sf_dir):
    """The tree objects of every vault's newest files: folder, id, and bytes."""
    objects = plans.tree_objects(_newest_tree(_fleet(spark, sf_dir)))
    return objects.select("vault_id", "dir", "tree_oid", F.hex("payload").alias("payload"))


def _first_tips(f: Fleet) -> DataFrame:
    return mainline.tips_of(f.commits, f.edges).where("k = 1").select("vault_id", "oid")


def _first_reached(f: Fleet) -> tuple[DataFrame, DataFrame]:
    """(vault_id, oid) of the commits that the first tips reach, and of the blobs in their trees. Only commits are walked; what they
    hold is one join."""
    commits = dag.reachable(_first_tips(f), f.edges.select("vault_id", F.col("child").alias("src"), F.col("parent").alias("dst")))
    return commits, f.trees.join(commits, ["vault_id", "oid"], "left_semi").select("vault_id", F.col("blob_oid").alias("oid")).distinct()


def g2_reachable_objects(spark, sf_dir):
    """Commits and blobs that the first tip of every vault reaches."""
    f = _fleet(spark, sf_dir)
    commits, blobs = _first_reached(f)
    return commits.unionByName(blobs)


def z4_gc_objects(spark, sf_dir):
    """Blobs that no first tip reaches in its vault; a report, nothing is deleted."""
    f = _fleet(spark, sf_dir)
    kept = _first_reached(f)[0].withColumn("kept", F.lit(True))
    held = f.trees.join(kept, ["vault_id", "oid"], "left").groupBy("vault_id", F.col("blob_oid").alias("oid")).agg(F.max("kept").alias("kept"))
    return held.where("kept IS NULL").drop("kept")


def z3_export_primitives(spark, sf_dir):
    """What every primitive with a sole parent travels with: its commit, and the blobs of its tree that the parent's tree lacks."""
    f = _fleet(spark, sf_dir)
    sole = f.edges.groupBy("vault_id", F.col("child").alias("oid")).agg(F.count("*").alias("n"), F.min("parent").alias("parent")).where("n = 1").drop("n")
    own = f.commits.where("is_primitive").select("vault_id", "oid").join(sole, ["vault_id", "oid"])
    blobs = own.join(f.trees.select("vault_id", "oid", "blob_oid").distinct(), ["vault_id", "oid"])
    new = blobs.join(f.trees.select("vault_id", F.col("oid").alias("parent"), "blob_oid"), ["vault_id", "parent", "blob_oid"], "left_anti")
    return new.select("vault_id", "oid", F.lit("blob").alias("kind"), F.col("blob_oid").alias("object")).unionByName(own.select("vault_id", "oid", F.lit("commit").alias("kind"), F.col("oid").alias("object")))


def l1_frontier_order(spark, sf_dir):
    """The tips of every vault in the strict order, as folds take them."""
    f = _fleet(spark, sf_dir)
    return mainline.tips_of(f.commits, f.edges).select("vault_id", "k", "oid")


QUERIES = {f.__name__: f for f in (g3_compute_main, t11_maintained_mains, g3_main_files, u1_line_merges, a5_effective_known, a3_touch_on_dag, a4_commit_touches, a7_main_folds, g4_verify_folds, g6_restore_at, g7_restore_snapshot, s9_write_trees, g2_reachable_objects, z4_gc_objects, z3_export_primitives, l1_frontier_order)}

_BLOB = "sha1('blob ' || strlen({0})::VARCHAR || chr(0) || {0})"
_FACTS = "WITH RECURSIVE " + fleet.EDGES_SQL + f""", clo AS (
  SELECT vault_id, child AS descendant, parent AS ancestor FROM d_edges
  UNION SELECT c.vault_id, c.descendant, e.parent FROM clo c JOIN d_edges e ON c.vault_id = e.vault_id AND c.ancestor = e.child
), incl AS (SELECT * FROM clo UNION SELECT vault_id, oid, oid FROM d_commits),
prim AS (SELECT vault_id, oid, counter AS c, author_time AS time, CASE WHEN counter % 10 = 0 THEN 5 ELSE counter END AS counter, node_id || left(node_id, 24) AS node FROM d_commits WHERE (counter % 10 = 0 OR counter % 6 <> 0) AND counter % 7 <> 0),
held AS (SELECT vault_id, oid, p, CASE WHEN p <= 3 THEN 'f' || p::VARCHAR ELSE 'd/f' || p::VARCHAR END || '.md' AS path, CASE WHEN p <= 3 THEN (counter // 3)::VARCHAR || '/' || p::VARCHAR || chr(0) ELSE 'text ' || p::VARCHAR || chr(10) END AS content
  FROM d_commits, range(1, 7) r(p) WHERE (counter * 7 + p * 5) % 11 < 8),
trees AS (SELECT vault_id, oid, p, path, {_BLOB.format('content')} AS blob_oid FROM held),
sole AS (SELECT vault_id, child AS oid, min(parent) AS parent FROM d_edges GROUP BY ALL HAVING count(*) = 1),
tou AS (SELECT c.vault_id, c.oid, s.parent, 'f' || p::VARCHAR AS f, CASE WHEN p <= 3 THEN 'f' ELSE 'd/f' END || p::VARCHAR || '.md' AS path, CASE WHEN (c.c * 7 + p * 5) % 11 < 8 THEN 'add' ELSE 'delete' END AS kind, c.counter, c.node
  FROM prim c JOIN sole s ON s.vault_id = c.vault_id AND s.oid = c.oid JOIN d_commits d ON d.vault_id = c.vault_id AND d.oid = s.parent, range(1, 7) r(p) WHERE ((c.c * 7 + p * 5) % 11 < 8) <> ((d.counter * 7 + p * 5) % 11 < 8)),
lastt AS (SELECT a.vault_id, a.oid, a.path, arg_max(t.kind, (t.counter, t.node, t.oid)) AS k FROM tou a JOIN incl i ON i.vault_id = a.vault_id AND i.descendant = a.parent JOIN tou t ON t.vault_id = i.vault_id AND t.oid = i.ancestor AND t.path = a.path WHERE a.kind = 'add' GROUP BY ALL),
ghost AS (SELECT DISTINCT vault_id, oid FROM lastt WHERE k = 'delete')"""
_RANKED = "row_number() OVER (PARTITION BY vault_id ORDER BY counter, node, oid)::INTEGER"
_PLAIN_TIPS = _FACTS + f", tips AS (SELECT *, {_RANKED} AS k FROM prim c WHERE NOT EXISTS (SELECT 1 FROM clo JOIN prim f ON f.vault_id = clo.vault_id AND f.oid = clo.descendant WHERE clo.vault_id = c.vault_id AND clo.ancestor = c.oid))"


def _who(time: str) -> str:
    return f"'{PROTOCOL} <{PROTOCOL}@localhost> ' || ({time})::VARCHAR || ' +0000' || chr(10)"


def _commit_sql(tree: str, parents: str, time: str, kind: str = "fold") -> str:
    body = f"('tree ' || {tree} || chr(10) || {parents} || 'author ' || {_who(time)} || 'committer ' || {_who(time)} || chr(10) || '{PROTOCOL}: {kind}' || chr(10))"
    return f"sha1('commit ' || strlen({body})::VARCHAR || chr(0) || {body})"


def _tree_sql(body: str) -> str:
    return f"sha1(unhex(hex(('tree ' || (length({body}) // 2)::VARCHAR)::BLOB) || '00' || {body}))"


def _main_sql(known: str) -> str:
    """Up to mains, files and folds; known is a condition on commits c."""
    return _FACTS + f""", eff AS (SELECT c.* FROM prim c WHERE NOT EXISTS (SELECT 1 FROM ghost g WHERE g.vault_id = c.vault_id AND g.oid = c.oid) AND {known}),
tips AS (SELECT *, {_RANKED} AS k FROM eff c WHERE NOT EXISTS (SELECT 1 FROM clo JOIN eff f ON f.vault_id = clo.vault_id AND f.oid = clo.descendant WHERE clo.vault_id = c.vault_id AND clo.ancestor = c.oid)),
lastk AS (SELECT vault_id, max(k) AS last FROM tips GROUP BY ALL),
reached AS (SELECT t.vault_id, k, ancestor FROM tips t JOIN incl i ON i.vault_id = t.vault_id AND descendant = oid),
common AS (SELECT DISTINCT r.vault_id, r.k, r.ancestor FROM reached r JOIN reached q ON q.vault_id = r.vault_id AND q.ancestor = r.ancestor AND q.k < r.k),
best AS (SELECT vault_id, k, min(ancestor) AS base FROM common c WHERE NOT EXISTS (SELECT 1 FROM common d JOIN clo ON clo.vault_id = d.vault_id AND clo.descendant = d.ancestor WHERE d.vault_id = c.vault_id AND d.k = c.k AND clo.ancestor = c.ancestor) GROUP BY ALL),
st AS (SELECT t.vault_id, t.k, r.p, x.blob_oid AS tip, y.blob_oid AS base FROM tips t LEFT JOIN best b ON b.vault_id = t.vault_id AND b.k = t.k CROSS JOIN range(1, 7) r(p)
  LEFT JOIN trees x ON x.vault_id = t.vault_id AND x.oid = t.oid AND x.p = r.p LEFT JOIN trees y ON y.vault_id = t.vault_id AND y.oid = b.base AND y.p = r.p),
run AS (SELECT vault_id, p, k, tip AS o FROM st WHERE k = 1
  UNION ALL SELECT s.vault_id, s.p, s.k, CASE WHEN s.tip IS NOT DISTINCT FROM s.base THEN o ELSE s.tip END FROM run r JOIN st s ON s.vault_id = r.vault_id AND s.p = r.p AND s.k = r.k + 1),
sub AS (SELECT vault_id, k, {_tree_sql("body")} AS oid FROM (SELECT vault_id, k, string_agg(hex(('100644 f' || p::VARCHAR || '.md')::BLOB) || '00' || upper(o), '' ORDER BY p) AS body FROM run WHERE p > 3 AND o IS NOT NULL GROUP BY ALL)),
top AS (SELECT vault_id, k, string_agg(e, '' ORDER BY n) AS body FROM (SELECT vault_id, k, 'd/' AS n, hex('40000 d'::BLOB) || '00' || upper(oid) AS e FROM sub UNION ALL SELECT vault_id, k, 'f' || p::VARCHAR, hex(('100644 f' || p::VARCHAR || '.md')::BLOB) || '00' || upper(o) FROM run WHERE p <= 3 AND o IS NOT NULL) GROUP BY ALL),
tid AS (SELECT t.vault_id, t.k, t.oid, t.time, {_tree_sql("coalesce(body, '')")} AS tree FROM tips t LEFT JOIN top USING (vault_id, k)),
ch AS (SELECT vault_id, k, oid AS acc, time, ''::VARCHAR AS tree, ''::VARCHAR AS parents FROM tid WHERE k = 1
  UNION ALL SELECT t.vault_id, t.k, {_commit_sql("t.tree", "'parent ' || c.acc || chr(10) || 'parent ' || t.oid || chr(10)", "greatest(c.time, t.time)")}, greatest(c.time, t.time), t.tree, c.acc || ',' || t.oid FROM ch c JOIN tid t ON t.vault_id = c.vault_id AND t.k = c.k + 1),
folds AS (SELECT vault_id, k, acc AS oid, tree AS tree_oid, parents, time FROM ch WHERE k > 1 UNION ALL
  SELECT vault_id, k, {_commit_sql("tree", "'parent ' || oid || chr(10)", "time")}, tree, oid, time FROM tid JOIN lastk USING (vault_id) WHERE last = 1),
files AS (SELECT r.vault_id, CASE WHEN p <= 3 THEN 'f' ELSE 'd/f' END || p::VARCHAR || '.md' AS path, o AS blob_oid FROM run r JOIN lastk l ON l.vault_id = r.vault_id AND l.last = r.k WHERE o IS NOT NULL)"""


_ALL = _main_sql("true")
_NOON = "c.time % 86400 <= 43200"
_EARLY = """(CASE WHEN right(c.vault_id, 1) IN ('0', '2', '4', '6', '8') THEN EXISTS (SELECT 1 FROM d_commits e JOIN incl i ON i.vault_id = e.vault_id AND i.descendant = e.oid WHERE e.vault_id = c.vault_id AND e.counter <= 12 AND i.ancestor = c.oid) ELSE c.time % 86400 <= 43200 END)"""
_NEWEST = ", newest AS (SELECT t.vault_id, t.path, t.blob_oid, t.p FROM trees t JOIN (SELECT vault_id, arg_max(oid, (author_time, oid)) AS oid FROM d_commits GROUP BY ALL) n ON n.vault_id = t.vault_id AND n.oid = t.oid)"
_GENESIS = _commit_sql("'" + plans.EMPTY_TREE + "'", "''", "0", "genesis")

ORACLES = {
    "g3_compute_main": _ALL + f" SELECT vault_id, oid AS main_oid, tree_oid, k AS tips FROM folds JOIN lastk USING (vault_id) WHERE k = last UNION ALL SELECT DISTINCT vault_id, {_GENESIS}, '{plans.EMPTY_TREE}', 0 FROM d_commits WHERE vault_id NOT IN (SELECT vault_id FROM tips)",
    "g3_main_files": _ALL + " SELECT vault_id, path, blob_oid FROM files",
    "a5_effective_known": _FACTS + " SELECT vault_id, oid FROM ghost",
    "a3_touch_on_dag": _FACTS + """, asked AS (SELECT c.vault_id, c.oid, p.path FROM d_commits c JOIN (SELECT DISTINCT vault_id, path FROM tou) p USING (vault_id)),
best AS (SELECT i.vault_id, i.descendant AS oid, t.path, arg_max(struct_pack(kind := t.kind, touch := t.oid), (t.counter, t.node, t.oid)) AS b FROM incl i JOIN tou t ON t.vault_id = i.vault_id AND t.oid = i.ancestor GROUP BY ALL)
SELECT a.vault_id, a.oid, a.path, b.kind AS kind, b.touch AS touch_oid FROM asked a LEFT JOIN best USING (vault_id, oid, path)""",
    "a4_commit_touches": _FACTS + " SELECT vault_id, oid, path, kind FROM tou",
    "a7_main_folds": _ALL + " SELECT vault_id, k, oid, tree_oid, parents, time FROM folds",
    "g4_verify_folds": _ALL + f" SELECT vault_id, CASE WHEN k = 3 THEN {_commit_sql(chr(39) + plans.EMPTY_TREE + chr(39), chr(39) + 'parent ' + chr(39) + ' || string_split(parents, chr(44))[1] || chr(10) || ' + chr(39) + 'parent ' + chr(39) + ' || string_split(parents, chr(44))[2] || chr(10)', 'time')} ELSE oid END AS oid FROM folds WHERE k >= 3",
    "g6_restore_at": _main_sql(_NOON) + " SELECT vault_id, path, blob_oid FROM files",
    "g7_restore_snapshot": _main_sql(_EARLY) + _NEWEST + " SELECT coalesce(f.vault_id, n.vault_id) AS vault_id, coalesce(f.path, n.path) AS path, CASE WHEN f.blob_oid IS NULL THEN 'remove' ELSE 'write' END AS op, f.blob_oid FROM files f FULL JOIN newest n ON n.vault_id = f.vault_id AND n.path = f.path",
    "s9_write_trees": _FACTS + _NEWEST + f""", sub AS (SELECT vault_id, string_agg(hex(('100644 f' || p::VARCHAR || '.md')::BLOB) || '00' || upper(blob_oid), '' ORDER BY p) AS body FROM newest WHERE p > 3 GROUP BY ALL),
top AS (SELECT vault_id, string_agg(e, '' ORDER BY n) AS body FROM (SELECT vault_id, 'd/' AS n, hex('40000 d'::BLOB) || '00' || upper({_tree_sql('body')}) AS e FROM sub UNION ALL SELECT vault_id, 'f' || p::VARCHAR, hex(('100644 f' || p::VARCHAR || '.md')::BLOB) || '00' || upper(blob_oid) FROM newest WHERE p <= 3) GROUP BY ALL)
SELECT vault_id, 'd' AS dir, {_tree_sql('body')} AS tree_oid, body AS payload FROM sub UNION ALL SELECT vault_id, '', {_tree_sql('body')}, body FROM top""",
    "g2_reachable_objects": _PLAIN_TIPS + ", seen AS (SELECT i.vault_id, i.ancestor AS oid FROM incl i JOIN tips t ON t.vault_id = i.vault_id AND t.oid = i.descendant WHERE k = 1) SELECT vault_id, oid FROM seen UNION SELECT t.vault_id, t.blob_oid FROM trees t JOIN seen s ON s.vault_id = t.vault_id AND s.oid = t.oid",
    "z4_gc_objects": _PLAIN_TIPS + ", seen AS (SELECT i.vault_id, i.ancestor AS oid FROM incl i JOIN tips t ON t.vault_id = i.vault_id AND t.oid = i.descendant WHERE k = 1) SELECT vault_id, blob_oid AS oid FROM trees EXCEPT SELECT t.vault_id, t.blob_oid FROM trees t JOIN seen s ON s.vault_id = t.vault_id AND s.oid = t.oid",
    "z3_export_primitives": _FACTS + ", own AS (SELECT p.vault_id, p.oid, parent FROM prim p JOIN sole s ON s.vault_id = p.vault_id AND s.oid = p.oid) SELECT o.vault_id, o.oid, 'blob' AS kind, t.blob_oid AS object FROM own o JOIN trees t ON t.vault_id = o.vault_id AND t.oid = o.oid LEFT JOIN trees b ON b.vault_id = o.vault_id AND b.oid = o.parent AND b.blob_oid = t.blob_oid WHERE b.oid IS NULL GROUP BY ALL UNION ALL SELECT vault_id, oid, 'commit', oid FROM own",
    "l1_frontier_order": _PLAIN_TIPS + " SELECT vault_id, k, oid FROM tips",
}
ORACLES["t11_maintained_mains"] = ORACLES["g3_compute_main"]
