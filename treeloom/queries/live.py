"""Live behaviour in batch form over `events` and `lineitem`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import orphan_bucket
from ..functions.tables import table
from ..sources import fleet
from ..streaming import live


def _edits(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("vault_id"), "ts", F.col("event_type").alias("path"), F.col("event_id").alias("rev"))


def t1_debounce_commits(spark, sf_dir):
    b = live.debounced(_edits(spark, sf_dir), "3 hours")
    return b.select("vault_id", fleet.millis("started").alias("started"), fleet.millis("fires").alias("fires"), "edits", "last_path")


def t2_coalesce_leading(spark, sf_dir):
    e = _edits(spark, sf_dir).select("vault_id", fleet.millis("ts").alias("ms"))
    return live.coalesced_leading(e, 3 * 3600 * 1000)


def _frames(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    one = l.groupBy(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("seq")).agg(F.max(F.floor(F.col("l_extendedprice") * 4).cast("long")).alias("bytes"))
    return one.withColumn("is_last", F.col("seq") % 3 == 0)


def t4_reassemble_batches(spark, sf_dir):
    return live.reassembled(_frames(spark, sf_dir))


def _batches(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.expr("event_id div 7").alias("batch_id"), F.concat(F.lit("o"), (F.expr("event_id * 3 div 4")).cast("string")).alias("oid"), (F.col("event_id") % 97 != 0).alias("fold_ok"), (F.col("event_id") % 13 != 0).alias("sig_ok"))


def _known(spark, sf_dir):
    return _batches(spark, sf_dir).select("oid").where("substring(oid, -1, 1) IN ('1', '5')").distinct()


def t3_integrate(spark, sf_dir):
    return live.integrated(_batches(spark, sf_dir), _known(spark, sf_dir))


def t5_relay(spark, sf_dir):
    return live.relayed(_batches(spark, sf_dir), _known(spark, sf_dir))


def t6_bootstrap_gate(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "signup", "ready").otherwise("edit")
    return live.gated(e.select(F.col("user_id").alias("vault_id"), fleet.millis("ts").alias("ts"), F.col("event_id").alias("seq"), F.col("event_type").alias("path"), kind.alias("kind")))


def t8_suppress_self_writes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select((F.col("user_id") % 10).alias("room"), F.col("event_type").alias("path"), "ts", F.col("event_id").alias("seq"), (F.col("event_id") % 5 < 2).alias("own"))
    return live.unsuppressed(rows).select("room", "path", "seq")


def t10_handshake_timeout(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("session"), fleet.seconds("ts").alias("t"), (F.col("event_type") == "purchase").alias("established"))
    return live.timed_out(e, 20000)


def t9_live_delta(spark, sf_dir):
    """Every commit of a vault's chain as it would be published."""
    from .history import _folder

    f = _folder(spark, sf_dir)
    version = F.concat("path", F.lit("@"), F.expr("counter div 4").cast("string"))
    trees = f.where("now").select("vault_id", "oid", "path", F.sha1(version.cast("binary")).alias("blob_oid"))
    return live.live_delta(f.where("parent IS NOT NULL").select("vault_id", "oid", "parent").distinct(), trees)


def t12_quarantine_events(spark, sf_dir):
    """The side output of the pre-publish guard: what goes to the orphan folder of the second in which the vault last moved."""
    from .history import j16_classify_local_adds

    q = j16_classify_local_adds(spark, sf_dir).where("step = 'quarantine'")
    when = fleet.commits(spark, sf_dir).groupBy("vault_id").agg(F.max("author_time").alias("t"))
    return q.join(when, "vault_id").select("vault_id", "path", F.concat(F.lit(".context/orphans/"), orphan_bucket(F.col("t")), F.lit("/"), "path").alias("to_path"))


QUERIES = {f.__name__: f for f in (t1_debounce_commits, t2_coalesce_leading, t3_integrate, t4_reassemble_batches, t5_relay, t6_bootstrap_gate, t8_suppress_self_writes, t9_live_delta, t10_handshake_timeout, t12_quarantine_events)}

_B = "WITH b AS (SELECT event_id // 7 AS batch_id, 'o' || (event_id * 3 // 4)::VARCHAR AS oid, event_id % 97 <> 0 AS fold_ok, event_id % 13 <> 0 AS sig_ok FROM events), adm AS (SELECT min(batch_id) AS batch_id, oid FROM b WHERE sig_ok AND batch_id NOT IN (SELECT batch_id FROM b WHERE NOT fold_ok) AND right(oid, 1) NOT IN ('1', '5') GROUP BY oid)"

ORACLES = {
    "t1_debounce_commits": """WITH e AS (SELECT user_id AS vault_id, ts, event_type AS path, event_id AS rev, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 3 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY vault_id ORDER BY ts, rev ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT vault_id, epoch_us(min(ts)) // 1000 AS started, epoch_us(max(ts) + INTERVAL 3 HOUR) // 1000 AS fires, count(*) AS edits, arg_max(path, (ts, rev)) AS last_path FROM g GROUP BY vault_id, s""",
    "t2_coalesce_leading": """WITH RECURSIVE e AS (SELECT user_id AS vault_id, epoch_us(ts) // 1000 AS ms FROM events), w AS (SELECT vault_id, min(ms) AS started FROM e GROUP BY ALL
UNION ALL SELECT w.vault_id, (SELECT min(ms) FROM e WHERE e.vault_id = w.vault_id AND ms > w.started + 10800000) FROM w WHERE EXISTS (SELECT 1 FROM e WHERE e.vault_id = w.vault_id AND ms > w.started + 10800000))
SELECT w.vault_id, started, started + 10800000 AS fires, count(*) AS events FROM w JOIN e ON e.vault_id = w.vault_id AND ms BETWEEN started AND started + 10800000 GROUP BY ALL""",
    "t3_integrate": _B + " SELECT batch_id, oid FROM adm",
    "t4_reassemble_batches": """WITH o AS (SELECT l_orderkey AS session_id, l_linenumber AS seq, max(floor(l_extendedprice * 4)::BIGINT) AS bytes FROM lineitem GROUP BY ALL),
n AS (SELECT *, seq % 3 = 0 AS is_last, coalesce(sum((seq % 3 = 0)::INT) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS batch FROM o)
SELECT session_id, batch, count(*) AS frames, sum(bytes)::BIGINT AS bytes FROM n GROUP BY ALL HAVING bool_or(is_last)""",
    "t5_relay": _B + " SELECT batch_id, count(*) AS admitted FROM adm GROUP BY ALL",
    "t6_bootstrap_gate": """WITH e AS (SELECT user_id AS vault_id, epoch_us(ts) // 1000 AS ts, event_id AS seq, event_type AS path FROM events), o AS (SELECT vault_id, min((ts, seq)) AS op FROM e WHERE path = 'signup' GROUP BY ALL),
w AS (SELECT e.*, op FROM e JOIN o USING (vault_id) WHERE path <> 'signup')
SELECT vault_id, path, arg_max(seq, (ts, seq)) AS seq, any_value(op[1]) AS published FROM w WHERE (ts, seq) < op GROUP BY ALL UNION ALL SELECT vault_id, path, seq, ts FROM w WHERE (ts, seq) > op""".replace("arg_max(seq, (ts, seq)) AS seq, any_value(op[1]) AS published FROM w WHERE (ts, seq) < op GROUP BY ALL", "arg_max(seq, (ts, seq)) AS seq, min(op)[1] AS published FROM w WHERE (ts, seq) < op GROUP BY vault_id, path"),
    "t8_suppress_self_writes": """WITH e AS (SELECT user_id % 10 AS room, event_type AS path, ts, event_id AS seq, event_id % 5 < 2 AS own FROM events),
s AS (SELECT *, sum(CASE WHEN own THEN 1 ELSE -1 END) OVER (PARTITION BY room, path ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS s FROM e),
l AS (SELECT *, least(coalesce(min(s) OVER (PARTITION BY room, path ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS low FROM s) SELECT room, path, seq FROM l WHERE NOT own AND s < low""",
    "t10_handshake_timeout": "WITH e AS (SELECT user_id::VARCHAR || '-' || strftime(ts, '%Y-%m-%d') AS session, floor(epoch(ts))::BIGINT AS t, event_type = 'purchase' AS ok FROM events) SELECT session, min(t) AS began, min(t) FILTER (ok) AS done, coalesce(min(t) FILTER (ok) > min(t) + 20000, true) AS timed_out FROM e GROUP BY ALL",
    "t9_live_delta": "WITH " + fleet.COMMITS_SQL + """, chain AS (SELECT *, lag(oid) OVER w AS parent, lag(counter) OVER w AS pc FROM d_commits WINDOW w AS (PARTITION BY vault_id ORDER BY counter)),
t AS (SELECT vault_id, oid, counter, sha1('f' || p::VARCHAR || '.md@' || (counter // 4)::VARCHAR) AS b FROM d_commits, range(1, 7) r(p) WHERE (counter * 7 + p * 5) % 11 < 6)
SELECT vault_id, oid, 'blob' AS kind, b AS object FROM (SELECT c.vault_id, c.oid, t.b FROM chain c JOIN t ON t.vault_id = c.vault_id AND t.oid = c.oid WHERE parent IS NOT NULL
  EXCEPT SELECT c.vault_id, c.oid, t.b FROM chain c JOIN t ON t.vault_id = c.vault_id AND t.oid = c.parent)
UNION ALL SELECT vault_id, oid, 'commit', oid FROM chain WHERE parent IS NOT NULL""",
}

from .history import ORACLES as _PAST  # noqa: E402

ORACLES["t12_quarantine_events"] = (
    "WITH j AS (" + _PAST["j16_classify_local_adds"] + ") SELECT j.vault_id, path, '.context/orphans/' || strftime(to_timestamp(t) AT TIME ZONE 'UTC', '%Y-%m-%dT%H-%M-%SZ') || '/' || path AS to_path FROM j JOIN (SELECT strftime(ts, '%Y-%m-%d') || '-' || (user_id // 15)::VARCHAR AS vault_id, max(floor(epoch(ts))::BIGINT) AS t FROM events GROUP BY 1) m ON m.vault_id = j.vault_id WHERE step = 'quarantine'")
