import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from treeloom.streaming import live, ordered

START = dt.datetime(2026, 1, 1)


@pytest.fixture(autouse=True)
def store(spark):
    names = ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(n) for n in names]
    ordered.use_state_store(spark)
    spark.conf.set(names[1], "2")
    yield
    for name, value in zip(names, before):
        spark.conf.set(name, value)


def run(spark, tmp_path, rows, schema, form, late=2, files=5, seed=1):
    """form over rows (with ts) that come in files of mixed order, none later than `late` seconds, and then far-off rows that move the
    watermark past all; what comes out, and the rows that state still holds."""
    rng = random.Random(seed)
    names = [c.split()[0] for c in schema.split(", ")]
    at = names.index("ts")
    jittered = sorted(rows, key=lambda r: r[at] + dt.timedelta(seconds=rng.uniform(0, late)))
    size = -(-len(jittered) // files)
    parts = [jittered[i : i + size] for i in range(0, len(jittered), size)]
    for part in parts:
        rng.shuffle(part)
    assert [r for part in parts for r in part] != sorted(rows, key=lambda r: r[at])
    far = list(rows[0])
    far[0], far[at] = (-1 if isinstance(far[0], int) else "far"), START + dt.timedelta(days=9)
    parts.append([tuple(far)])
    seen = set()
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for file in (tmp_path / "in").glob("*.parquet"):
            if file not in seen:  # one micro-batch a file, in this order
                seen.add(file)
                os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", f"{late} seconds")
    query = form(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert sum(p["numInputRows"] > 0 for p in query.recentProgress) == len(parts)
    found = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    return found, held[-1]


def moment(ms):
    return START + dt.timedelta(milliseconds=ms)


def test_passes_in_any_order(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.randint(1, 3), moment(rng.randint(0, 20_000)), n) for n in range(60)]
    rows += rows[:3]  # repeated rows count
    schema = "vault_id long, ts timestamp, seq long"
    batch = spark.createDataFrame(rows, schema).select("vault_id", F.unix_millis("ts").alias("ms"))
    got, held = run(spark, tmp_path, rows, schema, lambda s: ordered.coalesced_leading(s, 1500))
    assert got == sorted(tuple(r) for r in live.coalesced_leading(batch, 1500).collect())
    assert held <= 2  # only the far-off row waits, with its timer


def test_frames_in_any_order(spark, tmp_path):
    rows = [(s, moment(300 * q + s), q, 10 * q + s, q % 3 == 0) for s in (1, 2, 3) for q in range(1, 21)]
    schema = "session_id long, ts timestamp, seq long, bytes long, is_last boolean"
    want = sorted(tuple(r) for r in live.reassembled(spark.createDataFrame(rows, schema)).select("session_id", F.col("batch").cast("long"), "frames", "bytes").collect())
    got, held = run(spark, tmp_path, rows, schema, lambda s: ordered.reassembled(s, 60_000))
    assert got == want and held <= 2


def test_gates_in_any_order(spark, tmp_path):
    rng = random.Random(7)
    rows = [(rng.randint(1, 3), moment(rng.randint(0, 20_000)), n, rng.choice("abc"), "ready" if rng.random() < 0.08 else "edit") for n in range(60)]
    rows.append((4, moment(400), 99, "a", "edit"))  # never ready
    schema = "vault_id long, ts timestamp, seq long, path string, kind string"
    want = sorted(tuple(r) for r in live.gated(spark.createDataFrame(rows, schema)).select("vault_id", "path", "seq", "published").collect())
    got, held = run(spark, tmp_path, rows, schema, ordered.gated)
    assert got == want and want
    opened = {r[0] for r in rows if r[4] == "ready"}
    waiting = {(r[0], r[3]) for r in rows if r[0] not in opened}
    assert held <= len(opened) + len(waiting) + 2  # the far-off row and its timer


def test_tokens_in_any_order(spark, tmp_path):
    rng = random.Random(9)
    rows = [(rng.randint(1, 2), rng.choice("ab"), moment(rng.randint(0, 20_000)), n, rng.random() < 0.4) for n in range(80)]
    schema = "room long, path string, ts timestamp, seq long, own boolean"
    want = sorted(tuple(r) for r in live.unsuppressed(spark.createDataFrame(rows, schema)).select("room", "path", "seq").collect())
    got, _ = run(spark, tmp_path, rows, schema, ordered.unsuppressed)
    assert got == want and want


def test_handshakes_in_any_order(spark, tmp_path):
    steps = [("quick", 0, False), ("slow", 1, False), ("never", 2, False), ("quick", 5, True), ("slow", 40, True), ("quick", 44, True), ("edge", 10, False), ("edge", 30, True), ("at once", 3, True)]
    rows = [(s, START + dt.timedelta(seconds=t), n, e) for n, (s, t, e) in enumerate(steps)]
    schema = "session string, ts timestamp, seq long, established boolean"
    batch = spark.createDataFrame(rows, schema).select("session", F.unix_seconds("ts").alias("t"), "established")
    want = sorted((r.session, r.began, r.timed_out) for r in live.timed_out(batch, 20).collect())
    got, held = run(spark, tmp_path, rows, schema, lambda s: ordered.timed_out(s, 20, 60_000), late=6, files=3)
    assert got == want and held <= 2
