"""History, session and status queries over `events`, `lineitem`, `conversations` and `part`."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import short_sha
from ..functions.tables import saved, shared_dir, table
from ..operators import fold, history
from ..sources import fleet, stores
from ..streaming import live

#: The name in trailers; callers pass their own protocol's.
PROTOCOL = "sync"


def _messages(spark, sf_dir):
    c = fleet.commits(spark, sf_dir)
    n = F.col("counter")
    node = F.concat("node_id", F.substring("node_id", 1, 24))
    message = F.concat(
        F.col("subject"), F.lit("\n\nSYNC-Counter: "), F.when(n % 6 == 0, F.lit("x")).otherwise(n.cast("string")), F.lit("\nSYNC-Node: "), F.when(n % 7 == 0, F.lit("short")).otherwise(F.upper(node)),
        F.when(n % 5 == 0, F.concat(F.lit("\nSYNC-Readd: "), F.col("oid"), F.lit("\nSYNC-Readd: zz"))).otherwise(F.lit("")), F.when(n % 10 == 0, F.lit("\nSYNC-Counter: 5")).otherwise(F.lit("")))
    return c.withColumn("message", message)


def f1_classify_commits(spark, sf_dir):
    told = history.classified(_messages(spark, sf_dir), PROTOCOL)
    return told.select("vault_id", "oid", F.col("t_counter").alias("counter"), F.col("t_node").alias("node"), "is_primitive")


def f2_parse_readds(spark, sf_dir):
    return history.classified(_messages(spark, sf_dir), PROTOCOL).select("vault_id", "oid", F.array_join("readds", ",").alias("readds"))


def _objects(spark, sf_dir):
    m = _messages(spark, sf_dir)
    parents = F.when(F.col("counter") % 3 == 0, F.array("oid", "node_id")).when(F.col("counter") % 3 == 1, F.array("node_id")).otherwise(F.array().cast("array<string>"))
    payload = history.commit_payload(F.col("oid"), parents, F.concat(F.lit("User "), F.col("user_id").cast("string")), F.lit("u@example.org"), F.col("author_time"), F.col("message"))
    return m.select(F.col("oid").alias("key"), history.object_oid("commit", payload).alias("oid"), payload.alias("payload"))


def s3_parse_commits(spark, sf_dir):
    p = history.parsed(_objects(spark, sf_dir))
    return p.select("oid", "tree", F.array_join("parents", ",").alias("parents"), "author", "email", "author_time", "message")


def x2_commit_oid(spark, sf_dir):
    return _objects(spark, sf_dir).select("key", "oid")


def g5_fsck_objects(spark, sf_dir):
    """Objects whose id is not that of their bytes: every ninth claims another's."""
    o = _objects(spark, sf_dir).withColumn("claimed", F.when(F.length("payload") % 9 == 0, F.col("key")).otherwise(F.col("oid")))
    return o.where(history.object_oid("commit", F.col("payload")) != F.col("claimed")).select("claimed", "oid")


def x1_blob_oid(spark, sf_dir):
    return fleet.files(spark, sf_dir).select("vault_id", "path", fleet.blob_oid(F.col("content")).alias("blob_oid"))


def s10_history_json(spark, sf_dir):
    c = fleet.commits(spark, sf_dir)
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return c.select("vault_id", F.to_json(F.struct(F.col("oid").alias("sha"), F.col("node_id").alias("author"), iso.alias("date"), "subject")).alias("line"))


def _log_rows(spark, sf_dir):
    return fleet.commits(spark, sf_dir).select("vault_id", "oid", "node_id", "user_id", F.col("author_time").alias("time"), "subject")


def f13_history_filters(spark, sf_dir):
    """Non-merge commits of some authors in a time span that match a pattern; newest first, after a skip, up to a count."""
    c = _log_rows(spark, sf_dir).where("user_id % 3 <> 0 AND time % 86400 BETWEEN 20000 AND 70000")
    return history.filtered(c, fleet.edges(spark, sf_dir), grep="^(c|p|v)", merges=False, skip=2, max_count=5).select("vault_id", "oid", "subject", "n")


def l4_oldest_first(spark, sf_dir):
    """The three newest merges but one of every vault since a day, oldest first."""
    return history.filtered(_log_rows(spark, sf_dir), fleet.edges(spark, sf_dir), since=1704067200 + 86400, merges=True, skip=1, max_count=3, reverse=True).select("vault_id", "oid", "n")


def f13_first_parents(spark, sf_dir):
    """From each vault's newest commit back along first parents (here: the least of the parents)."""
    c = _log_rows(spark, sf_dir)
    first = fleet.edges(spark, sf_dir).withColumn("ord", F.row_number().over(Window.partitionBy("vault_id", "child").orderBy("parent")) - 1)
    newest = c.groupBy("vault_id").agg(F.max_by("oid", F.struct("time", "oid")).alias("oid"))
    return history.filtered(c, first, first_parent=newest).select("vault_id", "oid", "n")


def x20_split_lines(spark, sf_dir):
    """Every file's lines with their ends, numbered."""
    f = fleet.files(spark, sf_dir)
    return f.select("vault_id", "path", F.posexplode(fold.split_lines(F.col("content"))).alias("n", "line"))


def a12_shortlog(spark, sf_dir):
    return fleet.commits(spark, sf_dir).groupBy("vault_id", "node_id").agg(F.count("*").alias("commits"), F.min("author_time").alias("since"))


def _folder(spark, sf_dir):
    """A linear commit chain per vault whose trees are the vault's paths cut differently each time: one path per event kind,
    present by a rule, so that paths come and go."""
    c = fleet.commits(spark, sf_dir).select("vault_id", "oid", "counter", "node_id")
    order = Window.partitionBy("vault_id").orderBy("counter")
    chain = c.withColumn("parent", F.lag("oid").over(order)).withColumn("parent_counter", F.lag("counter").over(order))
    there = lambda n, p: (n * 7 + p * 5) % 11 < 6
    paths = chain.select("*", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("p")).withColumn("path", F.concat(F.lit("f"), F.col("p").cast("string"), F.lit(".md")))
    return paths.withColumn("now", there(F.col("counter"), F.col("p"))).withColumn("before", F.when(F.col("parent").isNotNull(), there(F.col("parent_counter"), F.col("p"))))


def _touches(folder):
    toggled = folder.where("before IS NOT NULL AND now <> before")
    return toggled.select("vault_id", "oid", "parent", "path", F.when(F.col("now"), "add").otherwise("delete").alias("kind"), "counter", "node_id")


def _places(folder):
    return folder.select("vault_id", "oid", F.col("counter").alias("place")).distinct()


def a3_most_recent_touch(spark, sf_dir):
    f = _folder(spark, sf_dir)
    return history.latest_touches_on_lines(f.select("vault_id", "oid", "path"), _touches(f), _places(f))


def a5_ghost_add_commits(spark, sf_dir):
    f = saved(_folder(spark, sf_dir), "folder")
    t = saved(_touches(f), "touches")
    added = t.where("kind = 'add'").select("vault_id", "oid", "parent", "path", "counter")
    last = saved(history.latest_touches_on_lines(added.select("vault_id", F.col("parent").alias("oid"), "path"), t, _places(f)), "last")
    named = last.select("vault_id", F.col("oid").alias("parent"), "path", "touch_oid")
    readds = added.where("counter % 3 = 0").join(named, ["vault_id", "parent", "path"]).select("vault_id", "oid", "touch_oid")
    incomplete = f.where("counter % 8 = 1").select("vault_id", "oid").distinct()
    return history.ghost_adds(added.drop("counter"), last, readds, incomplete)


def j16_classify_local_adds(spark, sf_dir):
    f = _folder(spark, sf_dir)
    tip = f.groupBy("vault_id").agg(F.max_by("oid", "counter").alias("oid"))
    files = tip.select("vault_id", "oid", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("p")).select("vault_id", "oid", F.concat(F.lit("f"), F.col("p").cast("string"), F.lit(".md")).alias("path"))
    tree = f.join(tip, ["vault_id", "oid"]).where("now").select("vault_id", "path")
    last = history.latest_touches_on_lines(files, _touches(f), _places(f))
    held = files.where("path IN ('f1.md', 'f3.md', 'f5.md')").select("vault_id", "path")
    return history.classify_adds(files.select("vault_id", "path"), tree, last, held)


def a7_fold_commit_oid(spark, sf_dir):
    """Ids of two-parent fold commits: fixed identity and message (the protocol's name), time of the later parent."""
    c = fleet.commits(spark, sf_dir)
    order = Window.partitionBy("vault_id").orderBy("counter")
    both = c.withColumns({"a": F.lag("oid").over(order), "t": F.lag("author_time").over(order)}).where("a IS NOT NULL")
    payload = history.commit_payload(F.col("node_id"), F.array("a", "oid"), F.lit(PROTOCOL), F.lit(PROTOCOL + "@localhost"), F.greatest("t", "author_time"), F.lit(PROTOCOL + ": fold\n"))
    return both.select("vault_id", "oid", history.object_oid("commit", payload).alias("fold_oid"))


def _status(spark, sf_dir):
    c = fleet.commits(spark, sf_dir)
    return c.groupBy("vault_id").agg(F.count("*").alias("known"), F.countDistinct("node_id").alias("nodes"), F.max_by("oid", F.struct("counter", "oid")).alias("newest"), F.count_if(F.col("subject") == "error").alias("errors"), F.count_if(F.col("subject") == "view").alias("views"))


def a8_vault_status(spark, sf_dir):
    return _status(spark, sf_dir).select("vault_id", "known", "nodes", short_sha(F.col("newest")).alias("short_sha"))


def a9_aggregate_status(spark, sf_dir):
    """A day's state over its vaults: error over active over idle over disabled."""
    s = _status(spark, sf_dir).withColumn("state", F.when(F.col("errors") > 8, "error").when(F.col("views") > 5, "active").when(F.col("known") > 3, "idle").otherwise("disabled"))
    day = s.groupBy(F.substring("vault_id", 1, 10).alias("day")).agg(*[F.count_if(F.col("state") == x).alias(x) for x in ("error", "active", "idle", "disabled")])
    return day.withColumn("state", F.when(F.col("error") > 0, "error").when(F.col("active") > 0, "active").when(F.col("idle") > 0, "idle").otherwise("disabled"))


def a10_wire_stats(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    kind = F.concat_ws("-", "l_returnflag", "l_linestatus")
    return l.groupBy(kind.alias("kind")).agg(F.count("*").alias("messages"), F.sum((F.col("l_quantity") * 10).cast("long")).alias("bytes"))


def a14_file_inventory(spark, sf_dir):
    v = fleet.versions(spark, sf_dir).select("vault_id", "path", F.col("turn").alias("ts"), F.when(~((F.col("author") == "user") & (F.col("turn") % 4 == 2)), F.col("content")).alias("content"))
    once = v.groupBy("vault_id", "path", "ts").agg(F.max("content").alias("content"))
    return history.inventory(once)


def _states(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "click", "progress").when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "disconnected").when(F.col("event_type") == "signup", "idle").otherwise("connected")
    return e.select(F.col("user_id").alias("vault_id"), "ts", F.col("event_id").alias("seq"), kind.alias("kind"))


def a15_connection_state(spark, sf_dir):
    return history.connection_states(_states(spark, sf_dir))


def w3_ring_buffer(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    newest = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return e.withColumn("n", F.row_number().over(newest)).where("n <= 500").select("event_type", "event_id", "n")


def x19_log_lines(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    source = F.when(F.col("event_id") % 2 == 0, "main").otherwise("worker")
    level = F.when(F.col("event_type") == "error", "error").otherwise("info")
    return e.select("event_id", history.log_text(source, F.col("ts"), level, F.concat_ws(" ", "event_type", "props")).alias("line"))


def w4_chunk_frames(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("seq")).agg(F.max(F.floor(F.col("l_extendedprice") * 4).cast("long")).alias("bytes"))
    return history.chunk_frames(l, 262144)


def w5_asof_snapshot(spark, sf_dir):
    """Of each user the newest purchase up to noon of every day on which it was active; ties go to the earlier event."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", fleet.seconds("ts").alias("t"))
    asked = e.select("user_id", F.expr("t div 86400").alias("day")).distinct()
    snaps = e.where("event_type = 'purchase'").select("user_id", F.col("t").alias("created"), F.col("event_id").alias("place"), F.col("event_id").alias("name"))
    noon = asked.withColumn("at", F.col("day") * 86400 + 43200)
    return history.snapshots_as_of(snaps, noon, ["user_id"]).select("user_id", "day", F.col("name").alias("event_id"))


def _log(spark, sf_dir):
    e = fleet.commits(spark, sf_dir)
    return e.groupBy("vault_id", F.col("author_time").alias("t")).agg(F.max("user_id").alias("m")).select("vault_id", "t", F.expr("m div 4").alias("main"))


def w7_settle_time(spark, sf_dir):
    return history.settle_times(_log(spark, sf_dir), 5400, 3600, 40000)


def _sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("node"), "ts", F.col("event_id").alias("seq"), (~F.col("event_type").isin("error", "view", "click")).alias("established"))


def w8_handshake_failure_streak(spark, sf_dir):
    return history.failure_streaks(_sessions(spark, sf_dir)).select("node", "seq", "streak", "terminal")


def w9_backoff_delay(spark, sf_dir):
    return history.failure_streaks(_sessions(spark, sf_dir)).select("node", "seq", "delay_ms")


def s11_merge_replica_state(spark, sf_dir):
    """Two saved states of each replica merged: of its commits the saver has seen two thirds, the disk one half."""
    c = fleet.commits(spark, sf_dir)

    def state(rows, source):
        one = rows.groupBy("vault_id", "node_id", "subject").agg(F.min_by("oid", "counter").alias("first"), F.max_by("oid", "counter").alias("last"), F.collect_list("oid").alias("oids"), F.max("counter").alias("counter"))
        pairs = lambda v: F.collect_list(F.struct(F.col("subject").alias("name"), F.col(v).alias("value")))
        return one.groupBy("vault_id", F.col("node_id").alias("replica")).agg(F.max("counter").alias("counter"), (F.max("counter") * 2).alias("observed"), F.flatten(F.collect_list("oids")).alias("known"), pairs("first").alias("snapshots"), pairs("last").alias("materialized")).withColumn("source", F.lit(source))

    done = history.merged_states(state(c.where("counter % 3 <> 1"), 0).unionByName(state(c.where("counter % 2 = 1"), 1)))
    flat = lambda v: F.array_join(F.transform(F.array_sort(v), lambda x: F.concat(x["name"], F.lit("="), x["value"])), ",")
    return done.select("vault_id", "replica", "counter", "observed", F.array_join("known", ",").alias("known"), flat("snapshots").alias("snapshots"), flat("materialized").alias("materialized"))


def s8_put_objects(spark, sf_dir):
    """Objects that an idempotent write adds to a store that holds some: once each, and none that is there."""
    f = fleet.files(spark, sf_dir).select("vault_id", fleet.blob_oid(F.col("content")).alias("oid"), F.col("content").cast("binary").alias("payload"))
    store = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    stores.put_objects(f.where("vault_id IN ('src1', 'src2', 'src3')").select("oid", "payload"), store)
    return stores.put_objects(f.select("oid", "payload"), store).select("oid")


def z8_ls_tree(spark, sf_dir):
    base, _, _ = fleet.trees(spark, sf_dir)
    return base.where(F.col("path").startswith("Brand#1")).select("vault_id", "path", "blob_oid")


def t7_lww_converge(spark, sf_dir):
    return live.last_writers(fleet.room_updates(spark, sf_dir))


QUERIES = {f.__name__: f for f in (f1_classify_commits, f2_parse_readds, s3_parse_commits, x2_commit_oid, g5_fsck_objects, x1_blob_oid, s10_history_json, f13_history_filters, l4_oldest_first, f13_first_parents, x20_split_lines, a12_shortlog, a3_most_recent_touch, a5_ghost_add_commits, j16_classify_local_adds, a7_fold_commit_oid, a8_vault_status, a9_aggregate_status, a10_wire_stats, a14_file_inventory, a15_connection_state, w3_ring_buffer, x19_log_lines, w4_chunk_frames, w5_asof_snapshot, w7_settle_time, w8_handshake_failure_streak, w9_backoff_delay, s11_merge_replica_state, s8_put_objects, z8_ls_tree, t7_lww_converge)}

_M = "WITH RECURSIVE " + fleet.COMMITS_SQL + """, msg AS (SELECT *, subject || chr(10) || chr(10) || 'SYNC-Counter: ' || CASE WHEN counter % 6 = 0 THEN 'x' ELSE counter::VARCHAR END || chr(10) || 'SYNC-Node: ' || CASE WHEN counter % 7 = 0 THEN 'short' ELSE upper(node_id || left(node_id, 24)) END
  || CASE WHEN counter % 5 = 0 THEN chr(10) || 'SYNC-Readd: ' || oid || chr(10) || 'SYNC-Readd: zz' ELSE '' END || CASE WHEN counter % 10 = 0 THEN chr(10) || 'SYNC-Counter: 5' ELSE '' END AS message FROM d_commits)"""
_O = _M + """, obj AS (SELECT oid AS key, 'User ' || user_id::VARCHAR AS author, author_time, message, CASE counter % 3 WHEN 0 THEN oid || ',' || node_id WHEN 1 THEN node_id ELSE '' END AS parents,
  'tree ' || oid || chr(10) || CASE counter % 3 WHEN 0 THEN 'parent ' || oid || chr(10) || 'parent ' || node_id || chr(10) WHEN 1 THEN 'parent ' || node_id || chr(10) ELSE '' END
  || 'author User ' || user_id::VARCHAR || ' <u@example.org> ' || author_time::VARCHAR || ' +0000' || chr(10) || 'committer User ' || user_id::VARCHAR || ' <u@example.org> ' || author_time::VARCHAR || ' +0000' || chr(10) || chr(10) || message AS payload FROM msg),
objs AS (SELECT *, sha1('commit ' || strlen(payload)::VARCHAR || chr(0) || payload) AS oid FROM obj)"""
_C = "WITH RECURSIVE " + fleet.COMMITS_SQL
_FOLD = _C + """, chain AS (SELECT *, lag(oid) OVER w AS parent, lag(counter) OVER w AS pc FROM d_commits WINDOW w AS (PARTITION BY vault_id ORDER BY counter)),
fol AS (SELECT *, 'f' || p::VARCHAR || '.md' AS path, (counter * 7 + p * 5) % 11 < 6 AS now, CASE WHEN parent IS NOT NULL THEN (pc * 7 + p * 5) % 11 < 6 END AS before FROM chain, range(1, 7) r(p)),
tou AS (SELECT vault_id, oid, parent, path, CASE WHEN now THEN 'add' ELSE 'delete' END AS kind, counter, node_id FROM fol WHERE before IS NOT NULL AND now <> before)"""
_SESS = "WITH s AS (SELECT user_id AS node, ts, event_id AS seq, event_type NOT IN ('error', 'view', 'click') AS established FROM events), g AS (SELECT *, sum(established::INT) OVER (PARTITION BY node ORDER BY ts, seq) AS grp FROM s), k AS (SELECT *, sum((NOT established)::INT) OVER (PARTITION BY node, grp ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)::BIGINT AS streak FROM g)"

ORACLES = {
    "f1_classify_commits": _M + " SELECT vault_id, oid, CASE WHEN counter % 10 = 0 THEN 5 WHEN counter % 6 <> 0 THEN counter END AS counter, CASE WHEN counter % 7 <> 0 THEN node_id || left(node_id, 24) END AS node, (counter % 10 = 0 OR counter % 6 <> 0) AND counter % 7 <> 0 AS is_primitive FROM msg",
    "f2_parse_readds": _M + " SELECT vault_id, oid, CASE WHEN counter % 5 = 0 THEN oid ELSE '' END AS readds FROM msg",
    "s3_parse_commits": _O + " SELECT oid, key AS tree, parents, author, 'u@example.org' AS email, author_time, message FROM objs",
    "x2_commit_oid": _O + " SELECT key, oid FROM objs",
    "g5_fsck_objects": _O + " SELECT key AS claimed, oid FROM objs WHERE length(payload) % 9 = 0",
    "x1_blob_oid": "WITH " + fleet.FILES_SQL + " SELECT vault_id, path, sha1('blob ' || strlen(content)::VARCHAR || chr(0) || content) AS blob_oid FROM d_files",
    "s10_history_json": "WITH d_commits AS (SELECT strftime(ts, '%Y-%m-%d') || '-' || (user_id // 15)::VARCHAR AS vault_id, sha1('commit ' || event_id::VARCHAR) AS oid, sha1('node ' || user_id::VARCHAR) AS node_id, ts, event_type AS subject FROM events) SELECT vault_id, '{\"sha\":\"' || oid || '\",\"author\":\"' || node_id || '\",\"date\":\"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '\",\"subject\":\"' || subject || '\"}' AS line FROM d_commits",
    "f13_history_filters": "WITH " + fleet.EDGES_SQL + ", m AS (SELECT vault_id, child FROM d_edges GROUP BY ALL HAVING count(*) > 1), w AS (SELECT *, row_number() OVER (PARTITION BY vault_id ORDER BY author_time DESC, oid)::INTEGER AS n FROM d_commits c WHERE user_id % 3 <> 0 AND author_time % 86400 BETWEEN 20000 AND 70000 AND left(subject, 1) IN ('c', 'p', 'v') AND NOT EXISTS (SELECT 1 FROM m WHERE m.vault_id = c.vault_id AND m.child = c.oid)) SELECT vault_id, oid, subject, n FROM w WHERE n > 2 AND n <= 7",
    "a12_shortlog": _C + " SELECT vault_id, node_id, count(*) AS commits, min(author_time) AS since FROM d_commits GROUP BY ALL",
    "a3_most_recent_touch": _FOLD + " SELECT f.vault_id, f.oid, f.path, arg_max(t.kind, t.counter) AS kind, arg_max(t.oid, t.counter) AS touch_oid FROM fol f LEFT JOIN tou t ON t.vault_id = f.vault_id AND t.path = f.path AND t.counter <= f.counter GROUP BY ALL",
    "a5_ghost_add_commits": _FOLD + " SELECT DISTINCT a.vault_id, a.oid FROM tou a WHERE a.kind = 'add' AND a.counter % 3 <> 0 AND a.counter % 8 <> 1 AND 'delete' = (SELECT arg_max(t.kind, t.counter) FROM tou t WHERE t.vault_id = a.vault_id AND t.path = a.path AND t.counter < a.counter)",
    "j16_classify_local_adds": _FOLD + """, tip AS (SELECT vault_id, max(counter) AS counter FROM fol GROUP BY ALL), want AS (SELECT vault_id, counter, 'f' || p::VARCHAR || '.md' AS path FROM tip, range(1, 9) r(p)),
st AS (SELECT w.vault_id, w.path, (SELECT bool_or(now) FROM fol f WHERE f.vault_id = w.vault_id AND f.counter = w.counter AND f.path = w.path) AS present,
  (SELECT arg_max(kind, counter) FROM tou t WHERE t.vault_id = w.vault_id AND t.path = w.path) AS kind, (SELECT arg_max(oid, counter) FROM tou t WHERE t.vault_id = w.vault_id AND t.path = w.path) AS touch FROM want w),
de AS (SELECT vault_id, path, CASE WHEN NOT coalesce(present, false) AND kind = 'delete' THEN CASE WHEN path IN ('f1.md', 'f3.md', 'f5.md') THEN 'quarantine' ELSE 'publish-readd' END ELSE 'publish' END AS step, touch FROM st)
SELECT vault_id, path, step, CASE WHEN step = 'publish-readd' THEN touch END AS readd FROM de""",
    "a7_fold_commit_oid": _C + """, b AS (SELECT vault_id, oid, node_id, author_time, lag(oid) OVER w AS a, lag(author_time) OVER w AS t FROM d_commits WINDOW w AS (PARTITION BY vault_id ORDER BY counter)),
p AS (SELECT vault_id, oid, 'sync <sync@localhost> ' || greatest(t, author_time)::VARCHAR || ' +0000' || chr(10) AS who, node_id, a FROM b WHERE a IS NOT NULL),
y AS (SELECT vault_id, oid, 'tree ' || node_id || chr(10) || 'parent ' || a || chr(10) || 'parent ' || oid || chr(10) || 'author ' || who || 'committer ' || who || chr(10) || 'sync: fold' || chr(10) AS body FROM p)
SELECT vault_id, oid, sha1('commit ' || strlen(body)::VARCHAR || chr(0) || body) AS fold_oid FROM y""",
    "a8_vault_status": _C + " SELECT vault_id, count(*) AS known, count(DISTINCT node_id) AS nodes, left(arg_max(oid, (counter, oid)), 12) AS short_sha FROM d_commits GROUP BY vault_id",
    "a9_aggregate_status": _C + ", s AS (SELECT vault_id, CASE WHEN count(*) FILTER (subject = 'error') > 8 THEN 'error' WHEN count(*) FILTER (subject = 'view') > 5 THEN 'active' WHEN count(*) > 3 THEN 'idle' ELSE 'disabled' END AS st FROM d_commits GROUP BY vault_id), d AS (SELECT left(vault_id, 10) AS day, count(*) FILTER (st = 'error') AS error, count(*) FILTER (st = 'active') AS active, count(*) FILTER (st = 'idle') AS idle, count(*) FILTER (st = 'disabled') AS disabled FROM s GROUP BY ALL) SELECT *, CASE WHEN error > 0 THEN 'error' WHEN active > 0 THEN 'active' WHEN idle > 0 THEN 'idle' ELSE 'disabled' END AS state FROM d",
    "a10_wire_stats": "SELECT l_returnflag || '-' || l_linestatus AS kind, count(*) AS messages, sum(trunc(l_quantity * 10)::BIGINT)::BIGINT AS bytes FROM lineitem GROUP BY ALL",
    "a14_file_inventory": "WITH " + fleet.VERSIONS_SQL + ", o AS (SELECT vault_id, path, turn AS ts, max(CASE WHEN NOT (author = 'user' AND turn % 4 = 2) THEN content END) AS content FROM d_versions GROUP BY ALL) SELECT vault_id, path, strlen((array_agg(content ORDER BY ts))[-1])::BIGINT AS size, min(ts) AS created, max(ts) AS updated, CASE WHEN (array_agg(content ORDER BY ts))[-1] IS NULL THEN max(ts) END AS deleted_at FROM o GROUP BY ALL",
    "a15_connection_state": "WITH k AS (SELECT user_id AS vault_id, ts, event_id AS seq, CASE event_type WHEN 'click' THEN 'progress' WHEN 'error' THEN 'error' WHEN 'view' THEN 'disconnected' WHEN 'signup' THEN 'idle' ELSE 'connected' END AS kind FROM events), t AS (SELECT *, lag(kind) OVER (PARTITION BY vault_id ORDER BY ts, seq) AS before, row_number() OVER (PARTITION BY vault_id ORDER BY ts DESC, seq DESC) AS n FROM k WHERE kind <> 'progress') SELECT vault_id, CASE WHEN kind = 'disconnected' THEN CASE WHEN coalesce(before, 'idle') = 'idle' THEN 'idle' ELSE 'reconnecting' END ELSE kind END AS state FROM t WHERE n = 1",
    "w3_ring_buffer": "SELECT event_type, event_id, n FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC)::INTEGER AS n FROM events) WHERE n <= 500",
    "x19_log_lines": "SELECT event_id, '[' || CASE WHEN event_id % 2 = 0 THEN 'main' ELSE 'worker' END || ' ' || strftime(ts, '%H:%M:%S.%g') || '] ' || CASE WHEN event_type = 'error' THEN 'ERROR ' ELSE '' END || event_type || ' ' || props AS line FROM events",
    "w4_chunk_frames": """WITH RECURSIVE o AS (SELECT l_orderkey AS session_id, l_linenumber AS seq, max(floor(l_extendedprice * 4)::BIGINT) AS bytes FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS n FROM o),
f AS (SELECT session_id, seq, bytes, n, 0 AS frame, bytes AS fill FROM r WHERE n = 1 UNION ALL SELECT r.session_id, r.seq, r.bytes, r.n, CASE WHEN fill + r.bytes > 262144 THEN frame + 1 ELSE frame END, CASE WHEN fill + r.bytes > 262144 THEN r.bytes ELSE fill + r.bytes END FROM f JOIN r ON r.session_id = f.session_id AND r.n = f.n + 1)
SELECT session_id, seq, bytes, frame, frame = max(frame) OVER (PARTITION BY session_id) AS is_last FROM f""",
    "w5_asof_snapshot": "WITH e AS (SELECT user_id, event_id, event_type, floor(epoch(ts))::BIGINT AS t FROM events), q AS (SELECT DISTINCT user_id, t // 86400 AS day FROM e) SELECT q.user_id, q.day, (SELECT arg_max(event_id, (t, -event_id)) FROM e WHERE e.user_id = q.user_id AND event_type = 'purchase' AND t <= q.day * 86400 + 43200) AS event_id FROM q",
    "w7_settle_time": _C + """, log AS (SELECT vault_id, author_time AS t, max(user_id) // 4 AS main FROM d_commits GROUP BY ALL), m AS (SELECT *, lag(main) OVER w AS before, min(t) OVER (PARTITION BY vault_id) AS t0 FROM log WINDOW w AS (PARTITION BY vault_id ORDER BY t)),
c AS (SELECT *, lead(t) OVER (PARTITION BY vault_id ORDER BY t) AS nx FROM m WHERE before IS NULL OR before <> main) SELECT vault_id, min(least(greatest(t + 5400, t0 + 3600), t0 + 40000) - t0) AS settled_after FROM c WHERE nx IS NULL OR nx > greatest(t + 5400, t0 + 3600) GROUP BY vault_id""",
    "w8_handshake_failure_streak": _SESS + " SELECT node, seq, streak, streak >= 5 AS terminal FROM k",
    "w9_backoff_delay": _SESS + " SELECT node, seq, CASE WHEN established THEN 250 ELSE least(30000, 500 * pow(2, least(streak - 1, 20)))::BIGINT END AS delay_ms FROM k",
    "l4_oldest_first": "WITH " + fleet.EDGES_SQL + ", w AS (SELECT c.*, row_number() OVER (PARTITION BY vault_id ORDER BY author_time DESC, oid) AS n FROM d_commits c WHERE author_time >= 1704153600 AND (SELECT count(*) FROM d_edges e WHERE e.vault_id = c.vault_id AND e.child = c.oid) > 1) SELECT vault_id, oid, row_number() OVER (PARTITION BY vault_id ORDER BY n DESC)::INTEGER AS n FROM w WHERE n BETWEEN 2 AND 4",
    "f13_first_parents": "WITH RECURSIVE " + fleet.EDGES_SQL + ", f AS (SELECT vault_id, child, min(parent) AS parent FROM d_edges GROUP BY ALL), w AS (SELECT vault_id, arg_max(oid, (author_time, oid)) AS oid FROM d_commits GROUP BY vault_id UNION ALL SELECT w.vault_id, f.parent FROM w JOIN f ON f.vault_id = w.vault_id AND f.child = w.oid) SELECT c.vault_id, c.oid, row_number() OVER (PARTITION BY c.vault_id ORDER BY author_time DESC, c.oid)::INTEGER AS n FROM d_commits c JOIN w ON w.vault_id = c.vault_id AND w.oid = c.oid",
    "x20_split_lines": "WITH " + fleet.FILES_SQL + ", l AS (SELECT vault_id, path, content, string_split(content, chr(10)) AS ls FROM d_files WHERE content IS NOT NULL), e AS (SELECT vault_id, path, len(ls) AS k, unnest(range(len(ls))) AS n, unnest(ls) AS line FROM l) SELECT vault_id, path, n::INTEGER AS n, line || CASE WHEN n < k - 1 THEN chr(10) ELSE '' END AS line FROM e WHERE n < k - 1 OR line <> ''",
    "s11_merge_replica_state": _C + """, r AS (SELECT *, 0 AS src FROM d_commits WHERE counter % 3 <> 1 UNION ALL SELECT *, 1 FROM d_commits WHERE counter % 2 = 1),
one AS (SELECT vault_id, node_id, src, subject, arg_min(oid, counter) AS first, arg_max(oid, counter) AS last FROM r GROUP BY ALL),
sn AS (SELECT vault_id, node_id, subject, arg_min(first, src) AS first FROM one GROUP BY ALL),
ss AS (SELECT vault_id, node_id, string_agg(subject || '=' || first, ',' ORDER BY subject) AS snapshots FROM sn GROUP BY ALL),
ms AS (SELECT vault_id, node_id, string_agg(subject || '=' || last, ',' ORDER BY subject) AS materialized FROM one WHERE src = 0 GROUP BY ALL),
ct AS (SELECT vault_id, node_id, max(counter) AS counter, max(counter) * 2 AS observed, string_agg(DISTINCT oid, ',' ORDER BY oid) AS known FROM r GROUP BY ALL)
SELECT vault_id, node_id AS replica, counter, observed, known, snapshots, coalesce(materialized, '') AS materialized FROM ct LEFT JOIN ss USING (vault_id, node_id) LEFT JOIN ms USING (vault_id, node_id)""",
    "s8_put_objects": "WITH " + fleet.FILES_SQL + ", f AS (SELECT vault_id, sha1('blob ' || strlen(content)::VARCHAR || chr(0) || content) AS oid FROM d_files) SELECT oid FROM f EXCEPT SELECT oid FROM f WHERE vault_id IN ('src1', 'src2', 'src3')",
    "z8_ls_tree": "WITH " + fleet.TREES_SQL + " SELECT vault_id, path, blob_oid FROM d_base WHERE starts_with(path, 'Brand#1')",
    "t7_lww_converge": "WITH " + fleet.ROOMS_SQL + " SELECT room, path, max(rev) AS rev, arg_max(content, (rev, -event_id)) AS content, arg_max(deleted, (rev, -event_id)) AS deleted FROM d_rooms GROUP BY ALL",
}
