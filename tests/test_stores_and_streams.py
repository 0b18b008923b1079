import datetime as dt
import hashlib
import os
import random
import zlib

from pyspark.sql import functions as F

from treeloom.functions import columns as C
from treeloom.operators import history, scope
from treeloom.sources import fleet, stores
from treeloom.streaming import live


def put(root, kind, payload):
    framed = f"{kind} {len(payload)}".encode() + b"\x00" + payload
    oid = hashlib.sha1(framed).hexdigest()
    os.makedirs(root / oid[:2], exist_ok=True)
    (root / oid[:2] / oid[2:]).write_bytes(zlib.compress(framed))
    return oid


def test_loose_objects_and_flattening(spark, tmp_path):
    root = tmp_path / "objects"
    blob = put(root, "blob", b"hello\n")
    sub = put(root, "tree", b"100644 b.md\x00" + bytes.fromhex(blob))
    top = put(root, "tree", b"100644 a.md\x00" + bytes.fromhex(blob) + b"40000 d\x00" + bytes.fromhex(sub))
    cut = put(root, "tree", b"100644 a.md\x00abc")
    (root / "ff").mkdir(exist_ok=True)
    (root / "ff" / ("0" * 38)).write_bytes(b"not deflated")
    found = {r.oid: r for r in stores.loose_objects(spark, str(root)).collect()}
    assert found[blob].ok and found[blob].kind == "blob" and bytes(found[blob].payload) == b"hello\n"
    assert found[top].ok and not found[cut].ok and not found["ff" + "0" * 38].ok
    entries = stores.tree_entries(stores.loose_objects(spark, str(root)))
    assert {(r.tree_oid, r.place, r.name) for r in entries.collect()} == {(top, 0, "a.md"), (top, 1, "d"), (sub, 0, "b.md")}
    flat = stores.flattened(entries, spark.createDataFrame([(top,)], "tree_oid string"))
    assert {(r.path, r.blob_oid) for r in flat.collect()} == {("a.md", blob), ("d/b.md", blob)}


def test_working_trees(spark, tmp_path):
    for name in ("v1/a.md", "v1/d/b.md", "v1/.context/state", "v2/c.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    rows = stores.working_trees(spark, str(tmp_path)).collect()
    assert {(r.vault_id, r.path) for r in rows} == {("v1", "a.md"), ("v1", "d/b.md"), ("v2", "c.md")}
    (tmp_path / "v1" / "z.md").write_bytes(b"a\x00b")
    rules = spark.createDataFrame([("v1", "include", 1, "*"), ("v1", "ignore", 1, "d/")], "vault_id string, kind string, ord int, pattern string")
    assert {r.path for r in stores.working_trees(spark, str(tmp_path), rules).collect()} == {"a.md", "z.md"}
    assert {r.path for r in stores.working_trees(spark, str(tmp_path), rules, binary=False).collect()} == {"a.md"}


def test_put_objects_adds_once(spark, tmp_path):
    new = spark.createDataFrame([("a", b"1"), ("a", b"1"), ("b", b"2")], "oid string, payload binary")
    assert stores.put_objects(new, str(tmp_path / "t")).count() == 2
    assert stores.put_objects(new, str(tmp_path / "t")).count() == 0


def test_known_ids(spark):
    one = spark.range(1)
    assert one.select(history.object_oid("tree", F.lit(""))).first()[0] == "4b825dc642cb6eb9a060e54bf8d69288fbee4904"
    assert one.select(fleet.blob_oid(F.lit("hello\n"))).first()[0] == "ce013625030ba8dba906f756967f9e9ca394464a"


def rule_hits(pattern, path):
    """A rule by the letter of its definition, tried on the path and on every folder above it; negation aside."""
    body = pattern[1:] if pattern.startswith("!") else pattern
    body = body[:-1] if body.endswith("/") else body
    parts = path.split("/")
    own = body.lstrip("/")

    def fits(glob, text):
        if not glob:
            return not text
        if glob.startswith("**"):
            rest = glob[3:] if glob[2:3] == "/" else glob[2:]
            return any(fits(rest, text[i:]) for i in range(len(text) + 1))
        if glob[0] == "*":
            stop = text.find("/") if "/" in text else len(text)
            return any(fits(glob[1:], text[i:]) for i in range(stop + 1))
        return bool(text) and (text[0] == glob[0] or glob[0] == "?" and text[0] != "/") and fits(glob[1:], text[1:])

    starts = [0] if "/" in body else range(len(parts))
    return any(fits(own, "/".join(parts[a:z])) for a in starts for z in range(a + 1, len(parts) + 1))


def test_rules_are_their_definition(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("kmz.+") for _ in range(rng.randint(1, 3)))
    paths = ["/".join(word() for _ in range(rng.randint(1, 4))) for _ in range(60)]
    patterns = []
    for path in rng.choices(paths, k=60):
        parts = [rng.choice([p, p, "*", p[0] + "*", "?" * len(p), "**"]) for p in path.split("/")][: rng.randint(1, 4)]
        patterns.append(rng.choice(["", "", "!", "/"]) + "/".join(parts) + rng.choice(["", "", "/"]))
    rules = spark.createDataFrame([(p, t) for p in patterns for t in paths], "pattern string, path string")
    got = {(r.pattern, r.path): r.hit for r in scope.compiled(rules).select("pattern", "path", F.expr("path RLIKE rule_re").alias("hit")).collect()}
    want = {(p, t): rule_hits(p, t) for p in patterns for t in paths}
    assert got == want and 0.05 < sum(want.values()) / len(want) < 0.95


def test_dates_and_durations(spark):
    one = spark.range(1)
    day = lambda t: one.select(C.date_text(C.date_seconds(F.lit(t)))).first()[0]
    assert day("2026-02-31") == "2026-03-03" and day("2026-13-01") is None and day("x") is None
    assert [one.select(C.duration_days(F.lit(t))).first()[0] for t in ("90", "2w", "1y", "never", "0", "5m")] == [90, 14, 365, None, None, None]
    assert one.select(C.expiry_from_ttl(F.lit(86400), F.lit(1))).first()[0] == 3 * 86400


def test_debounce_stream_equals_batch(spark, tmp_path):
    start = dt.datetime(2026, 1, 1)
    rows = [(v, start + dt.timedelta(seconds=s), f"p{s % 3}", s) for v in (1, 2) for s in (0, 1, 2, 10, 11, 30, 500)]
    edits = spark.createDataFrame(rows, "vault_id int, ts timestamp, path string, rev int")
    want = {tuple(r) for r in live.debounced(edits, "5 seconds").collect() if r.fires <= start + dt.timedelta(seconds=500)}
    for i in range(7):
        edits.where(F.col("rev") == (0, 1, 2, 10, 11, 30, 500)[i]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(edits.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "0 seconds")
    query = live.debounced(stream, "5 seconds").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_reassembly_stream_equals_batch(spark, tmp_path):
    rows = [(s, q, 10 * q + s, q % 3 == 0) for s in (1, 2, 3) for q in range(1, 8)]
    frames = spark.createDataFrame(rows, "session_id long, seq int, bytes long, is_last boolean")
    want = {tuple(map(int, r)) for r in live.reassembled(frames).select("session_id", "batch", "frames", "bytes").collect()}
    for part in ((1, 2), (3, 5), (6, 7)):
        frames.where(F.col("seq").between(*part)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = live.reassemble_stream(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {tuple(map(int, r)) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_last_writers_in_any_order(spark, tmp_path):
    rows = [(1, "p", r, i, f"c{i}", r % 2 == 0) for i, r in enumerate((3, 1, 5, 5, 2))]
    updates = spark.createDataFrame(rows, "room int, path string, rev int, event_id int, content string, deleted boolean")
    want = [tuple(r) for r in live.last_writers(updates).collect()]
    assert want == [(1, "p", 5, "c2", False)]
    updates.orderBy(F.desc("event_id")).coalesce(1).write.parquet(str(tmp_path / "in"))
    query = live.last_writers(spark.readStream.schema(updates.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("lww").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [tuple(r) for r in spark.table("lww").collect()] == want


def test_integrate_each_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", True, True), (1, "b", True, False), (2, "c", False, True), (2, "d", True, True), (3, "a", True, True)], "batch_id int, oid string, fold_ok boolean, sig_ok boolean")
    admit = live.integrate_each(str(tmp_path / "known"))
    admit(rows, 0)
    admit(rows, 0)
    assert [r.oid for r in spark.read.parquet(str(tmp_path / "known")).collect()] == ["a"]


def run_stream(spark, rows, name, tmp_path, cut, form, watermark=None):
    """form over a stream of the rows in as many files as cut has parts; what it gives, as a set."""
    for part in cut:
        rows.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    stream = stream.withWatermark(watermark, "0 seconds") if watermark else stream
    query = form(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"{name}-cp")).option("path", str(tmp_path / f"{name}-out")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return {tuple(r) for r in spark.read.parquet(str(tmp_path / f"{name}-out")).collect()}


def test_state_streams_equal_batches(spark, tmp_path):
    rng = random.Random(3)
    events = spark.createDataFrame([(rng.randint(1, 3), n, n * 37 + rng.randint(0, 30), rng.choice("ab"), rng.random() < 0.4, rng.random() < 0.1) for n in range(60)], "vault_id long, seq long, ms long, path string, own boolean, opens boolean").cache()
    cut = [f"seq BETWEEN {a} AND {a + 19}" for a in (0, 20, 40)]
    want = {tuple(r) for r in live.coalesced_leading(events.select("vault_id", "ms"), 200).collect()}
    got = run_stream(spark, events.select("vault_id", "seq", F.col("ms").alias("at")), "leading", tmp_path, cut, lambda s: live.coalesce_leading_stream(s, 200))
    assert got <= want and len(want - got) == 3  # each vault's last pass waits for its next event
    tokens = events.select(F.col("vault_id").alias("room"), "path", F.col("ms").alias("ts"), "seq", "own")
    got = run_stream(spark, tokens.withColumn("at", F.col("seq")), "tokens", tmp_path, cut, live.unsuppressed_stream)
    assert got == {(r.room, r.path, r.seq) for r in live.unsuppressed(tokens).collect()} and got
    edits = events.select("vault_id", F.col("ms").alias("ts"), "seq", "path", F.when(F.col("opens"), "ready").otherwise("edit").alias("kind"))
    got = run_stream(spark, edits.withColumn("at", F.col("seq")), "gate", tmp_path, cut, live.gate_stream)
    assert got == {tuple(r) for r in live.gated(edits).collect()} and got


def test_handshakes_time_out_on_the_streams_clock(spark, tmp_path):
    rows = [("quick", 0, False), ("slow", 1, False), ("never", 2, False), ("quick", 5, True), ("slow", 40, True), ("other", 60, True), ("other", 61, True)]
    steps = spark.createDataFrame([(s, dt.datetime(2026, 1, 1) + dt.timedelta(seconds=t), t, e) for s, t, e in rows], "session string, ts timestamp, at long, established boolean")
    start = int(dt.datetime(2026, 1, 1, tzinfo=dt.UTC).timestamp())
    steps = steps.withColumn("at", F.col("at") + start)
    got = run_stream(spark, steps, "shakes", tmp_path, [f"at - {start} BETWEEN {a} AND {z}" for a, z in ((0, 4), (5, 39), (40, 59), (60, 60), (61, 99))], lambda s: live.timed_out_stream(s, 20), "ts")
    batch = {r.session: r.timed_out for r in live.timed_out(steps.select("session", F.col("at").alias("t"), "established"), 20).collect()}
    assert {s: late for s, _, late in got} == batch and len(got) == len(batch)


def test_relay_and_repeated_batches(spark, tmp_path):
    schema = "batch_id int, oid string, fold_ok boolean, sig_ok boolean"
    one = spark.createDataFrame([(1, "a", True, True), (2, "b", False, True)], schema)
    two = spark.createDataFrame([(3, "a", True, True), (4, "c", True, True), (4, "a", True, True)], schema)
    relay = live.relay_each(str(tmp_path / "known"), str(tmp_path / "out"))
    for rows, batch in ((one, 0), (one, 0), (two, 1), (two, 1)):
        relay(rows, batch)
    assert sorted((r.batch_id, r.admitted) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 1), (4, 1)]
    assert sorted(r.oid for r in spark.read.parquet(str(tmp_path / "known")).collect()) == ["a", "c"]


def test_late_commits_recompute_only_their_vaults(spark, tmp_path):
    rows = [(v, f"{v}{n}", n) for v in "xyz" for n in range(6)]
    compute = lambda stored: stored.groupBy("vault_id").agg(F.count("*").alias("n"), F.max_by("oid", "counter").alias("tip"))
    found = []
    for seed in (1, 2):
        mixed = random.Random(seed).sample(rows, len(rows)) + rows[:2]
        each = live.main_each(compute, str(tmp_path / f"store{seed}"), str(tmp_path / f"out{seed}"), "vault_id string, oid string, counter int")
        for batch, at in enumerate((0, 7, 14)):
            each(spark.createDataFrame(mixed[at : at + 7], "vault_id string, oid string, counter int"), batch)
        found.append({tuple(r) for r in live.current_mains(spark, str(tmp_path / f"out{seed}")).collect()})
    assert found[0] == found[1] == {(v, 6, f"{v}5") for v in "xyz"}


def test_live_deltas_of_a_stream(spark, tmp_path):
    trees = spark.createDataFrame([("v", "1", "a", "A"), ("v", "2", "a", "A"), ("v", "2", "b", "B")], "vault_id string, oid string, path string, blob_oid string")
    each = live.live_delta_each(trees, str(tmp_path / "out"))
    each(spark.createDataFrame([("v", "2", "1")], "vault_id string, oid string, parent string"), 0)
    each(spark.createDataFrame([("v", "2", "1")], "vault_id string, oid string, parent string"), 0)
    assert sorted((r.kind, r.object) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("blob", "B"), ("commit", "2")]


def test_frames_of_known_kinds(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"session_id": 1, "seq": 1, "kind": "Live", "oid": "x", "bytes": 5}\n{"session_id": 1, "seq": 2, "kind": "Other"}\n')
    assert [(r.kind, r.oid) for r in stores.frames(spark, str(tmp_path / "in")).collect()] == [("Live", "x")]
    assert stores.frames(spark, str(tmp_path / "in"), streaming=True).isStreaming
