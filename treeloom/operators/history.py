"""Commit payloads and messages, touches and ghost adds, logs, sessions and status of many vaults."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField

from ..functions.columns import clock_text
from ..functions.tables import saved
from . import cover, dag, vaults
from .chains import chained
from .vaults import Unsuited, each_vault, linked, only, parents_first


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def trailer_values(message: Column, name: str) -> Column:
    head = name + ": "
    return F.transform(F.filter(lines(message), lambda x: x.startswith(head)), lambda x: F.trim(F.regexp_replace(x, "^[^:]*: ", "")))


def classified(commits: DataFrame, protocol: str) -> DataFrame:
    """commits (message) with counter, node_id, readds and is_primitive. Trailers carry the protocol's name, which is a
    parameter; the last counter and node count, and a malformed last one makes the commit synthetic."""
    name = protocol.upper()
    counter = F.try_element_at(trailer_values(F.col("message"), f"{name}-Counter"), F.lit(-1))
    node = F.try_element_at(trailer_values(F.col("message"), f"{name}-Node"), F.lit(-1))
    readds = F.transform(F.filter(trailer_values(F.col("message"), f"{name}-Readd"), lambda x: x.rlike("^[0-9a-fA-F]{40}$")), lambda x: F.lower(x))
    told = commits.withColumns({"t_counter": F.when(counter.rlike("^[0-9]+$"), counter.try_cast("long")), "t_node": F.when(node.rlike("^[0-9a-fA-F]{64}$"), F.lower(node)), "readds": readds})
    return told.withColumn("is_primitive", F.col("t_counter").isNotNull() & F.col("t_node").isNotNull())


def commit_payload(tree: Column, parents: Column, name: Column, email: Column, time: Column, message: Column) -> Column:
    who = F.concat(name, F.lit(" <"), email, F.lit("> "), time.cast("string"), F.lit(" +0000\n"))
    above = F.array_join(F.transform(parents, lambda p: F.concat(F.lit("parent "), p, F.lit("\n"))), "")
    return F.concat(F.lit("tree "), tree, F.lit("\n"), above, F.lit("author "), who, F.lit("committer "), who, F.lit("\n"), message)


def object_oid(kind: str, payload: Column) -> Column:
    raw = payload.cast("binary")
    return F.sha1(F.concat(F.concat(F.lit(kind + " "), F.octet_length(raw).cast("string")).cast("binary"), F.lit(bytes(1)), raw))


def parsed(objects: DataFrame) -> DataFrame:
    """objects (oid, payload text) as tree, parents, author, author_time and message; unknown header lines are skipped."""
    cut = F.instr("payload", "\n\n")
    head = lines(F.expr("substring(payload, 1, instr(payload, '\n\n') - 1)"))
    value = lambda name: F.transform(F.filter(head, lambda x: x.startswith(name + " ")), lambda x: F.regexp_replace(x, "^[a-z]+ ", ""))
    author = F.try_element_at(value("author"), F.lit(1))
    return objects.where(cut > 0).select(
        "oid", F.try_element_at(value("tree"), F.lit(1)).alias("tree"), value("parent").alias("parents"), F.regexp_extract(author, r"^(.*) <", 1).alias("author"), F.regexp_extract(author, r"<([^>]*)>", 1).alias("email"),
        F.regexp_extract(author, r"> ([0-9]+)", 1).try_cast("long").alias("author_time"), F.expr("substring(payload, instr(payload, '\n\n') + 2)").alias("message"))


def latest_touches_on_cover(asked: DataFrame, touches: DataFrame, covered: cover.Cover) -> DataFrame:
    """asked (vault_id, oid, path) with the touch (kind, touch_oid) of the greatest order key on oid or before it; null where the path
    was never touched. touches: vault_id, oid, path, kind, counter, node_id. On any DAG, from the chain-cover labels of its
    primitives: no closure is built, and rows are the questions times the writers that touched the path."""
    key = F.struct("counter", "node_id", F.col("oid").alias("t_oid"), "kind")
    best = cover.latest(covered, asked, touches, ["path"], key)
    return asked.join(best, ["vault_id", "oid", "path"], "left").select("vault_id", "oid", "path", F.col("best.kind").alias("kind"), F.col("best.t_oid").alias("touch_oid"))


def latest_touches_on_dag(asked: DataFrame | None, touches: DataFrame, commits: DataFrame, edges: DataFrame) -> DataFrame:
    """The same from commits (vault_id, oid, node_id, counter, is_primitive) and edges themselves, with whole: whether no parent is missing
    on oid's history. asked may be None: every commit with every touched path of its vault. A vault of few rows is told in one task, parents
    before children, where a path's latest touch is the greatest of the parents' and the commit's own; others ask the cover."""
    most, every = vaults.MOST_CELLS, asked is None

    def run(known: list[tuple], links: list[tuple], told: list[tuple], wanted: list[tuple]) -> Iterator[tuple]:
        there = {oid for (oid,) in known}
        up = linked((c, p) for c, p in links if c in there)
        paths = {path for _, path, *_ in told}
        if len(there) * len(paths) > most:
            raise Unsuited
        torn = {c for c, above in up.items() if not all(p in there for p in above)}
        own: dict[str, dict[str, tuple]] = {}
        for oid, path, kind, counter, node in told:
            if oid in there:
                key = (counter is not None, counter, node is not None, node, oid, kind)
                mine = own.setdefault(oid, {})
                mine[path] = max(mine[path], key) if path in mine else key
        at: dict[str, dict[str, tuple]] = {}
        for oid in parents_first(up | {oid: [] for oid in there if oid not in up}):
            if oid not in there:
                continue
            above = [p for p in up.get(oid, ()) if p in there]
            if any(p in torn for p in above):
                torn.add(oid)
            latest = at[above[0]] if above else {}
            for more in (*(at[p] for p in above[1:]), own.get(oid)):
                if more and more is not latest:
                    latest = latest | {path: key for path, key in more.items() if path not in latest or latest[path] < key}
            at[oid] = latest
        for oid, path in ((oid, path) for oid in at for path in paths) if every else wanted:
            best = at.get(oid, {}).get(path)
            yield oid, path, best and best[5], best and best[4], oid not in torn

    known = commits.select("vault_id", "oid")
    parts = [known, edges.select("vault_id", "child", "parent"), touches.select("vault_id", "oid", "path", "kind", "counter", "node_id"), (touches.limit(0) if asked is None else asked).select("vault_id", "oid", "path")]
    text = lambda name: StructField(name, StringType())
    found, large = each_vault(parts, run, [text("oid"), text("path"), text("kind"), text("touch_oid"), StructField("whole", BooleanType())], "latest")
    if large is None:
        return found
    mine, links, told = only(large, commits, edges, touches)
    of = cover.covered(mine, links)
    wanted = mine.select("vault_id", "oid").join(told.select("vault_id", "path").distinct(), "vault_id") if asked is None else only(large, asked.select("vault_id", "oid", "path"))[0]
    slow = latest_touches_on_cover(wanted, told, of)
    broken = cover.incomplete(of, wanted).withColumn("whole", F.lit(False))
    return found.unionByName(slow.join(broken, ["vault_id", "oid"], "left").withColumn("whole", F.coalesce("whole", F.lit(True))))


def latest_touches_on_lines(asked: DataFrame, touches: DataFrame, places: DataFrame) -> DataFrame:
    """The same for histories without merges, in which a commit's ancestors are all commits at lower places (vault_id, oid,
    place): one window per path, and no closure."""
    rows = asked.join(places, ["vault_id", "oid"]).select("vault_id", "path", "place", F.lit(1).alias("asks"), "oid", F.lit(None).cast("struct<kind:string,touch_oid:string>").alias("t"))
    told = touches.select("vault_id", "oid", "path", "kind").join(places, ["vault_id", "oid"]).select("vault_id", "path", "place", F.lit(0).alias("asks"), "oid", F.struct("kind", F.col("oid").alias("touch_oid")).alias("t"))
    order = Window.partitionBy("vault_id", "path").orderBy("place", "asks").rowsBetween(Window.unboundedPreceding, 0)
    return rows.unionByName(told).withColumn("t", F.last("t", True).over(order)).where("asks = 1").select("vault_id", "oid", "path", "t.kind", "t.touch_oid")


def ghost_adds(added: DataFrame, last: DataFrame, readds: DataFrame, incomplete: DataFrame) -> DataFrame:
    """Primitives to drop: added (vault_id, oid, parent, path) some path whose latest touch at the parent, last (vault_id, oid,
    path, kind, touch_oid), is a delete that readds (vault_id, oid, touch_oid) does not name. Commits in incomplete (vault_id,
    oid) are kept."""
    deleted = last.where("kind = 'delete'").select("vault_id", F.col("oid").alias("parent"), "path", "touch_oid")
    bad = added.join(deleted, ["vault_id", "parent", "path"]).join(readds, ["vault_id", "oid", "touch_oid"], "left_anti").select("vault_id", "oid").distinct()
    return bad.join(incomplete, ["vault_id", "oid"], "left_anti")


def classify_adds(files: DataFrame, parent_tree: DataFrame, last: DataFrame, materialized: DataFrame) -> DataFrame:
    """files (vault_id, path) before publishing: publish, quarantine, or publish with a readd trailer."""
    rows = files.join(parent_tree.select("vault_id", "path", F.lit(True).alias("present")), ["vault_id", "path"], "left").join(last.select("vault_id", "path", "kind", "touch_oid"), ["vault_id", "path"], "left").join(materialized.select("vault_id", "path", F.lit(True).alias("held")), ["vault_id", "path"], "left")
    deleted = F.col("present").isNull() & (F.col("kind") == "delete")
    step = F.when(deleted & F.col("held").isNotNull(), "quarantine").when(deleted, "publish-readd").otherwise("publish")
    return rows.select("vault_id", "path", step.alias("step"), F.when(step == "publish-readd", F.col("touch_oid")).alias("readd"))


def failure_streaks(sessions: DataFrame) -> DataFrame:
    """sessions (node, ts, seq, established) with streak (failures in a row so far), terminal, and the delay before the next
    attempt in ms."""
    order = Window.partitionBy("node").orderBy("ts", "seq")
    island = sessions.withColumn("__g", F.sum(F.col("established").cast("int")).over(order))
    inside = Window.partitionBy("node", "__g").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    streak = island.withColumn("streak", F.sum((~F.col("established")).cast("int")).over(inside))
    delay = F.when(F.col("established"), 250).otherwise(F.least(F.lit(30000), 500 * F.pow(F.lit(2.0), F.least(F.col("streak") - 1, F.lit(20))))).cast("long")
    return streak.withColumns({"terminal": F.col("streak") >= 5, "delay_ms": delay}).drop("__g")


def connection_states(events: DataFrame) -> DataFrame:
    """events (vault_id, ts, seq, kind): the latest state; a disconnection means reconnecting, unless it was idle before."""
    order = Window.partitionBy("vault_id").orderBy("ts", "seq")
    telling = events.where(~F.col("kind").isin("progress", "tree", "quarantine"))
    last = telling.withColumn("before", F.lag("kind").over(order)).groupBy("vault_id").agg(F.max_by(F.struct("kind", "before"), F.struct("ts", "seq")).alias("l"))
    state = F.when((F.col("l.kind") == "disconnected") & (F.coalesce(F.col("l.before"), F.lit("idle")) == "idle"), "idle").when(F.col("l.kind") == "disconnected", "reconnecting").otherwise(F.col("l.kind"))
    return last.select("vault_id", state.alias("state"))


def settle_times(log: DataFrame, quiet: int, least: int, most: int) -> DataFrame:
    """log (vault_id, t, main): per vault the first instant from `least` on at which main has not changed for more than
    quiet; at most `most` after the start."""
    order = Window.partitionBy("vault_id").orderBy("t")
    start = Window.partitionBy("vault_id")
    rows = log.withColumn("t0", F.min("t").over(start))
    moves = rows.withColumn("before", F.lag("main").over(order)).where(F.col("before").isNull() | (F.col("before") != F.col("main")))
    moves = moves.withColumn("next", F.lead("t").over(order))
    ripe = moves.withColumn("at", F.greatest(F.col("t") + quiet, F.col("t0") + least)).where(F.col("next").isNull() | (F.col("next") > F.col("at")))
    return ripe.groupBy("vault_id").agg(F.min(F.least("at", F.col("t0") + most) - F.col("t0")).alias("settled_after"))


def inventory(versions: DataFrame) -> DataFrame:
    """versions (vault_id, path, ts, content; null where deleted): one row per path as it stands now."""
    return versions.groupBy("vault_id", "path").agg(
        F.max_by(F.octet_length("content"), "ts").cast("long").alias("size"), F.min("ts").alias("created"), F.max("ts").alias("updated"),
        F.max_by(F.when(F.col("content").isNull(), F.col("ts")), "ts").alias("deleted_at"))


def chunk_frames(objects: DataFrame, limit: int) -> DataFrame:
    """objects (session_id, seq, bytes) with frame: packed greedily in order, an oversize one rides alone; and is_last. A frame
    ends before the first object whose end lies more than limit behind the frame's begin."""
    order = Window.partitionBy("session_id").orderBy("seq")
    upto = objects.withColumns({"__end": F.sum("bytes").over(order), "__n": F.row_number().over(order)})
    # What follows an oversize object is beyond its frame whatever its size, so ends are counted with one more for each row.
    wide = F.lit(1 << 24)
    rows = saved(upto.select("session_id", "seq", "bytes", F.col("seq").cast("long").alias("own"), (F.col("__end") * wide + F.col("__n")).alias("level"),
        F.when(F.col("bytes") > limit, F.col("__end") * wide + F.col("__n")).otherwise((F.col("__end") - F.col("bytes") + limit + 1) * wide - 1).alias("bar"), F.lit(True).alias("candidate"), (F.col("__n") == 1).alias("first")), "sized")
    begins = chained(rows, ["session_id"]).withColumn("begins", F.lit(1))
    numbered = rows.select("session_id", "seq", "bytes", "own").join(begins, ["session_id", "own"], "left").withColumn("frame", (F.count("begins").over(order) - 1).cast("int"))
    return numbered.select("session_id", "seq", "bytes", "frame", (F.col("frame") == F.max("frame").over(Window.partitionBy("session_id"))).alias("is_last"))


def filtered(commits: DataFrame, edges: DataFrame, authors: list[str] | None = None, since: int | None = None, until: int | None = None, grep: str | None = None, merges: bool | None = None,
             first_parent: DataFrame | None = None, skip: int = 0, max_count: int | None = None, reverse: bool = False) -> DataFrame:
    """A vault's history as asked for: commits (vault_id, oid, node_id, time, subject) with n, their place in the answer. merges:
    only those (true) or none (false); first_parent: starts (vault_id, oid), from which only first parents (edges with ord 0,
    or all where edges have no ord) are followed. Newest first; skip and max_count apply to that order, reverse to what is left."""
    wanted = commits
    if authors is not None:
        wanted = wanted.where(F.col("node_id").isin(authors))
    if since is not None:
        wanted = wanted.where(F.col("time") >= since)
    if until is not None:
        wanted = wanted.where(F.col("time") <= until)
    if grep is not None:
        wanted = wanted.where(F.col("subject").rlike(grep))
    if merges is not None:
        several = edges.groupBy("vault_id", F.col("child").alias("oid")).agg(F.count("*").alias("n")).where("n > 1").select("vault_id", "oid")
        wanted = wanted.join(several, ["vault_id", "oid"], "left_semi" if merges else "left_anti")
    if first_parent is not None:
        links = (edges.where("ord = 0") if "ord" in edges.columns else edges).select("vault_id", F.col("child").alias("src"), F.col("parent").alias("dst"))
        wanted = wanted.join(dag.reachable(first_parent, links), ["vault_id", "oid"], "left_semi")
    newest = Window.partitionBy("vault_id").orderBy(F.desc("time"), "oid")
    ranked = wanted.withColumn("n", F.row_number().over(newest)).where(F.col("n") > skip)
    if max_count is not None:
        ranked = ranked.where(F.col("n") <= skip + max_count)
    if not reverse:
        return ranked
    return ranked.withColumn("n", F.row_number().over(Window.partitionBy("vault_id").orderBy(F.desc("n"))))


def merged_states(states: DataFrame) -> DataFrame:
    """states (vault_id, replica, source, counter, observed, known, snapshots, materialized): what several savers of a replica's
    state hold, source 0 the one that saves now. Known sets unite, counters and what was observed take the greatest, a
    snapshot's name keeps the first source's, and materialised hashes are the saver's own. known: array of oids; snapshots and
    materialized: arrays of (name, value)."""
    key = ["vault_id", "replica"]
    counts = states.groupBy(*key).agg(F.max("counter").alias("counter"), F.max("observed").alias("observed"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("known")))).alias("known"))
    named = states.select(*key, "source", F.explode("snapshots").alias("s")).groupBy(*key, F.col("s.name").alias("name")).agg(F.min_by("s.value", "source").alias("value"))
    snaps = named.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("name", "value"))).alias("snapshots"))
    own = states.where("source = 0").select(*key, "materialized")
    none = F.array().cast(states.schema["snapshots"].dataType)
    return counts.join(snaps, key, "left").join(own, key, "left").select(*key, "counter", "observed", "known", F.coalesce("snapshots", none).alias("snapshots"), F.coalesce("materialized", none).alias("materialized"))


def snapshots_as_of(snapshots: DataFrame, asked: DataFrame, key: list[str]) -> DataFrame:
    """asked (*key, at, ...) with the newest snapshot (*key, created, place: the order in which they were made, name) created by then;
    of equally old ones the first made. One window over both: no row is paired with another."""
    told = F.struct("created", (-F.col("place")).alias("place"), "name")
    facts = snapshots.select(*key, F.col("created").alias("at"), told.alias("snap"))
    order = Window.partitionBy(*key).orderBy("at")  # equally old ones count together
    found = cover.last_before(asked, facts.withColumn("snap", F.max("snap").over(order)), key, "at", "snap")
    return found.withColumn("name", F.col("snap.name")).drop("snap")


def log_text(source: Column, ts: Column, level: Column, message: Column) -> Column:
    """A log line as it is shown: source and time of day to the millisecond, errors marked."""
    return F.concat(F.lit("["), source, F.lit(" "), clock_text(ts), F.lit("] "), F.when(level == "error", "ERROR ").otherwise(""), message)
