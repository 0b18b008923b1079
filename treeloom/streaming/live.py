"""Live behaviour over edit and frame tables: the same functions take batch and streaming DataFrames where built-in
operators can say it; those that need state of
their own come in a batch form (windows) and a streaming form."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tables import saved
from ..operators.chains import chained
from ..sources.stores import there

# ---- sessions and last writers: batch and stream alike ---------------------------------------------------------------


def debounced(edits: DataFrame, gap: str) -> DataFrame:
    """edits (vault_id, ts, path, rev) -> one burst per vault and pause of more than gap. Streams need a watermark on ts."""
    return edits.groupBy("vault_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("edits"), F.max_by("path", F.struct("ts", "rev")).alias("last_path")).select(
        "vault_id", F.col("w.start").alias("started"), F.col("w.end").alias("fires"), "edits", "last_path")


def last_writers(updates: DataFrame) -> DataFrame:
    """updates (room, path, rev, event_id, content, deleted): the highest rev of a path stands, the first of equals; a deletion
    is a value. In a stream: output mode update or complete."""
    order = F.struct("rev", (-F.col("event_id")).alias("neg"))
    return updates.groupBy("room", "path").agg(F.max("rev").alias("rev"), F.max_by(F.struct("content", "deleted"), order).alias("v")).select("room", "path", "rev", "v.content", "v.deleted")


# ---- batches of frames -----------------------------------------------------------------------------------------------


def reassembled(frames: DataFrame) -> DataFrame:
    """frames (session_id, seq, bytes, is_last) -> whole batches in order; frames after the last terminator stay out."""
    order = Window.partitionBy("session_id").orderBy("seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    numbered = frames.withColumn("batch", F.coalesce(F.sum(F.col("is_last").cast("int")).over(before), F.lit(0)))
    return numbered.groupBy("session_id", "batch").agg(F.count("*").alias("frames"), F.sum("bytes").alias("bytes"), F.max("is_last").alias("whole")).where("whole").drop("whole")


def reassemble_stream(frames: DataFrame) -> DataFrame:
    """The same over a stream in which a session's frames come in order: what is open waits in state."""

    def step(key: tuple, frames_: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        batch, count, size = state.get if state.exists else (0, 0, 0)
        out = []
        for part in frames_:
            for row in part.sort_values("seq").itertuples():
                count, size = count + 1, size + int(row.bytes)
                if row.is_last:
                    out.append((key[0], batch, count, size))
                    batch, count, size = batch + 1, 0, 0
        state.update((batch, count, size))
        if out:
            yield pd.DataFrame(out, columns=["session_id", "batch", "frames", "bytes"])

    return frames.groupBy("session_id").applyInPandasWithState(step, "session_id long, batch int, frames long, bytes long", "batch int, frames long, bytes long", "append", "NoTimeout")


def coalesced_leading(events: DataFrame, span_ms: int) -> DataFrame:
    """events (vault_id, ms) -> passes: a timer starts at the first event, does not restart, and takes in all until it fires;
    the next event after that starts the next."""
    times = saved(events.groupBy("vault_id", F.col("ms").cast("long").alias("own")).agg(F.count("*").alias("n")), "times")
    lead = times.groupBy("vault_id").agg(F.min("own").alias("__first"))
    rows = times.join(lead, "vault_id").select("vault_id", "own", F.col("own").alias("level"), (F.col("own") + span_ms).alias("bar"), F.lit(True).alias("candidate"), (F.col("own") == F.col("__first")).alias("first"))
    starts = chained(rows, ["vault_id"]).withColumn("started", F.col("own"))
    order = Window.partitionBy("vault_id").orderBy("own").rowsBetween(Window.unboundedPreceding, 0)
    placed = times.join(starts, ["vault_id", "own"], "left").withColumn("started", F.last("started", True).over(order))
    return placed.groupBy("vault_id", "started").agg(F.sum("n").alias("events")).select("vault_id", "started", (F.col("started") + span_ms).alias("fires"), "events")


# ---- admission of batches --------------------------------------------------------------------------------------------


def integrated(batches: DataFrame, known: DataFrame) -> DataFrame:
    """batches (batch_id, oid, fold_ok, sig_ok): rows to admit. A bad fold rejects its whole batch, a bad signature its row;
    an object that is known, or came in an earlier batch, is not admitted again."""
    refused = batches.where(~F.col("fold_ok")).select("batch_id").distinct()
    good = batches.join(refused, "batch_id", "left_anti").where("sig_ok")
    first = good.groupBy("oid").agg(F.min("batch_id").alias("batch_id"))
    return first.join(known, "oid", "left_anti").select("batch_id", "oid")


def relayed(batches: DataFrame, known: DataFrame) -> DataFrame:
    """Batches that admit something new; the others end here, and so gossip ends."""
    return integrated(batches, known).groupBy("batch_id").agg(F.count("*").alias("admitted"))


def _batch_folder(path: str, batch_id: int) -> str:
    return f"{path.rstrip('/')}/batch={batch_id}"


def _before(spark: SparkSession, path: str, batch_id: int, schema: str) -> DataFrame:
    """Rows that batches other than this one have written below path."""
    if not there(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, batch long").parquet(path).where(F.col("batch") != batch_id).drop("batch")


def integrate_each(known_path: str):
    """For writeStream.foreachBatch: admits what is new to the table at known_path. A micro-batch has a folder of its own, which
    a repeated run of it writes anew without looking at what it wrote before; so a batch counts once however often it runs."""

    def run(frames: DataFrame, batch_id: int) -> None:
        known = _before(frames.sparkSession, known_path, batch_id, "batch_id long, oid string")
        rows = integrated(frames, known.select("oid")).select(F.col("batch_id").cast("long").alias("batch_id"), "oid")
        rows.write.mode("overwrite").parquet(_batch_folder(known_path, batch_id))

    return run


def relay_each(known_path: str, out_path: str):
    """The same, and the batches to forward (batch_id, admitted) go below out_path: those that admitted something new."""
    admit = integrate_each(known_path)

    def run(frames: DataFrame, batch_id: int) -> None:
        admit(frames, batch_id)
        own = frames.sparkSession.read.parquet(_batch_folder(known_path, batch_id))
        own.groupBy("batch_id").agg(F.count("*").alias("admitted")).write.mode("overwrite").parquet(_batch_folder(out_path, batch_id))

    return run


def live_delta_each(trees: DataFrame, out_path: str):
    """For foreachBatch over new commits: what each publishes goes below out_path."""

    def run(commits: DataFrame, batch_id: int) -> None:
        live_delta(commits, trees).write.mode("overwrite").parquet(_batch_folder(out_path, batch_id))

    return run


def main_each(compute: Callable[[DataFrame], DataFrame], store_path: str, out_path: str, schema: str):
    """For foreachBatch over arriving commits in any order and late as they may be: they are added to the store, and compute (of
    all stored rows of the vaults that the batch touched, to one row a vault) goes below out_path. current_mains() reads what
    stands."""

    def run(arrived: DataFrame, batch_id: int) -> None:
        spark = arrived.sparkSession
        arrived.select(*[c.split()[0] for c in schema.split(", ")]).write.mode("overwrite").parquet(_batch_folder(store_path, batch_id))
        stored = spark.read.schema(f"{schema}, batch long").parquet(store_path).drop("batch").distinct()
        touched = spark.read.parquet(_batch_folder(store_path, batch_id)).select("vault_id").distinct()
        compute(stored.join(touched, "vault_id", "left_semi")).write.mode("overwrite").parquet(_batch_folder(out_path, batch_id))

    return run


def current_mains(spark: SparkSession, out_path: str) -> DataFrame:
    """Of every vault the row that the latest batch which touched it wrote."""
    rows = spark.read.parquet(out_path)
    names = [c for c in rows.columns if c != "batch"]
    latest = rows.groupBy("vault_id").agg(F.max_by(F.struct(*names), "batch").alias("r"))
    return latest.select("r.*")


def live_delta(commits: DataFrame, trees: DataFrame) -> DataFrame:
    """What new commits (vault_id, oid, parent) publish at once: the commit, and each blob of its tree (vault_id, oid, path,
    blob_oid) that its parent's tree lacks. In a stream: call it in foreachBatch with the batch's commits."""
    of = commits.join(trees.select("vault_id", "oid", "blob_oid"), ["vault_id", "oid"]).select("vault_id", "oid", "parent", "blob_oid").distinct()
    before = trees.select("vault_id", F.col("oid").alias("parent"), "blob_oid").distinct()
    new = of.join(before, ["vault_id", "parent", "blob_oid"], "left_anti").select("vault_id", "oid", F.lit("blob").alias("kind"), F.col("blob_oid").alias("object"))
    return new.unionByName(commits.select("vault_id", "oid", F.lit("commit").alias("kind"), F.col("oid").alias("object")))


def gated(edits: DataFrame) -> DataFrame:
    """edits (vault_id, ts, seq, path, kind): before a replica's first 'ready' event only the latest edit of each path is
    held, and all are published at that event; later ones pass."""
    opens = edits.where("kind = 'ready'").groupBy("vault_id").agg(F.min(F.struct("ts", "seq")).alias("open"))
    work = edits.where("kind <> 'ready'").join(opens, "vault_id", "left").withColumn("at", F.struct("ts", "seq"))
    early = work.where(F.col("open").isNotNull() & (F.col("at") < F.col("open")))
    held = early.groupBy("vault_id", "path").agg(F.max_by("seq", "at").alias("seq"), F.first("open").alias("open")).select("vault_id", "path", "seq", F.col("open.ts").alias("published"))
    passed = work.where(F.col("open").isNotNull() & (F.col("at") > F.col("open"))).select("vault_id", "path", "seq", F.col("ts").alias("published"))
    return held.unionByName(passed)


def unsuppressed(events: DataFrame) -> DataFrame:
    """events (room, path, ts, seq, own): every own write grants a token, the next event of that path from outside takes one.
    What is left are outside events that found no token. Tokens at hand are a reflected walk: own writes minus outside events,
    above its running minimum."""
    order = Window.partitionBy("room", "path").orderBy("ts", "seq")
    walk = events.withColumn("__s", F.sum(F.when(F.col("own"), 1).otherwise(-1)).over(order))
    low = walk.withColumn("__low", F.coalesce(F.least(F.min("__s").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), F.lit(0)))
    return low.where(~F.col("own") & (F.col("__s") < F.col("__low"))).drop("__s", "__low")


def timed_out(steps: DataFrame, budget_seconds: int) -> DataFrame:
    """steps (session, t, established): sessions whose whole handshake took longer than the budget, or never ended within it."""
    seen = steps.groupBy("session").agg(F.min("t").alias("began"), F.min(F.when(F.col("established"), F.col("t"))).alias("done"))
    return seen.withColumn("timed_out", F.col("done").isNull() | (F.col("done") > F.col("began") + budget_seconds))


# ---- states of their own: the streaming forms of what batches say with windows -----------------------------------------
# A key's rows must come in order here; `ordered` has the forms for streams out of order.


def _stateful(rows: DataFrame, key: list[str], step: Callable, out: str, state: str, timeout: str = "NoTimeout") -> DataFrame:
    """step(key, row or None at a timeout, held, emit, timer) -> what is held from now on; rows of a key in order of `at`."""
    names = [c.split()[0] for c in out.split(", ")]

    def run(key_: tuple, parts: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        told: list[tuple] = []
        now = held.get if held.exists else None
        timer: list[int] = []
        if held.hasTimedOut:
            now = step(key_, None, now, told.append, timer.append)
        else:
            for row in pd.concat(list(parts)).sort_values("at").itertuples():
                now = step(key_, row, now, told.append, timer.append)
        if now is None:
            held.remove()
        else:
            held.update(now)
            if timer and not held.hasTimedOut:
                held.setTimeoutTimestamp(max(timer[-1], held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(told, columns=names)

    return rows.groupBy(*key).applyInPandasWithState(run, out, state, "append", timeout)


def coalesce_leading_stream(events: DataFrame, span_ms: int) -> DataFrame:
    """events (vault_id, at: ms): the passes of coalesced_leading(), each when the first event after it comes."""

    def step(key, row, held, emit, timer):
        started, n = held or (row.at, 0)
        if row.at > started + span_ms:
            emit((key[0], started, started + span_ms, n))
            started, n = row.at, 0
        return int(started), int(n) + 1

    return _stateful(events, ["vault_id"], step, "vault_id long, started long, fires long, events long", "started long, n long")


def gate_stream(edits: DataFrame) -> DataFrame:
    """edits (vault_id, at: order, ts, seq, path, kind) as gated() has them: what is held waits in state as JSON."""

    def step(key, row, held, emit, timer):
        is_open, waiting = held or (False, "{}")
        if row.kind == "ready":
            for path, seq in json.loads(waiting).items():
                emit((key[0], path, seq, row.ts))
            return True, "{}"
        if is_open:
            emit((key[0], row.path, row.seq, row.ts))
            return True, waiting
        return False, json.dumps(json.loads(waiting) | {row.path: int(row.seq)})

    return _stateful(edits, ["vault_id"], step, "vault_id long, path string, seq long, published long", "open boolean, held string")


def unsuppressed_stream(events: DataFrame) -> DataFrame:
    """events (room, path, at: order, seq, own) as unsuppressed() has them: tokens at hand are the state."""

    def step(key, row, held, emit, timer):
        tokens = held[0] if held else 0
        if row.own:
            return (tokens + 1,)
        if not tokens:
            emit((key[0], key[1], row.seq))
        return (max(tokens - 1, 0),)

    return _stateful(events, ["room", "path"], step, "room long, path string, seq long", "tokens long")


def timed_out_stream(steps: DataFrame, budget_seconds: int) -> DataFrame:
    """steps (session, ts: with a watermark, at: seconds, established): a row when a session is established, or when its budget
    has passed on the stream's clock without that."""

    def step(key, row, held, emit, timer):
        began, closed = held or (None, False)
        if row is None:
            if not closed:
                emit((key[0], began, True))
            return began, True
        began = int(row.at) if began is None else began
        if not closed and (row.established or row.at > began + budget_seconds):
            emit((key[0], began, bool(row.at > began + budget_seconds)))
            closed = True
        timer((began + budget_seconds) * 1000 + 1)
        return began, closed

    return _stateful(steps, ["session"], step, "session string, began long, timed_out boolean", "began long, closed boolean", "EventTimeTimeout")
