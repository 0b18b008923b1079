"""Key and admission queries over `customer` and `orders`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.tables import table
from ..operators import keys, scope
from ..sources import fleet

#: A fixed present for these queries: 2026-01-01 UTC.
NOW = 1767225600


def _keys(spark, sf_dir):
    return keys.parsed(fleet.auth_lines(spark, sf_dir))


def s6_read_auth_lines(spark, sf_dir):
    return _keys(spark, sf_dir).select("vault_id", "line_no", "raw", "node_id")


def x4_pubkey_string(spark, sf_dir):
    k = _keys(spark, sf_dir).where("node_id IS NOT NULL")
    return k.select("vault_id", "line_no", C.key_of_node(F.col("node_id"), F.concat(F.lit("u"), F.col("line_no").cast("string"))).alias("line"))


def x5_fingerprint(spark, sf_dir):
    return fleet.auth_lines(spark, sf_dir).select("vault_id", "line_no", C.fingerprint(F.col("raw")).alias("fingerprint"))


def x9_parse_expiry(spark, sf_dir):
    return _keys(spark, sf_dir).select("vault_id", "line_no", "kind", F.col("at").alias("expires_at"))


def f10_valid_keys(spark, sf_dir):
    return _keys(spark, sf_dir).where(F.col("node_id").isNotNull() & C.is_valid(F.col("kind"), F.col("at"), F.lit(NOW))).select("vault_id", "line_no", "node_id")


def w6_first_key_per_node(spark, sf_dir):
    return keys.first_keys(_keys(spark, sf_dir)).select("vault_id", "node_id", "line_no")


def x11_migrate_default_expiry(spark, sf_dir):
    """Vaults with an even number keep a default of 90 days; the others have opted out, and nothing changes there."""
    k = _keys(spark, sf_dir)
    even = F.expr("cast(substring(vault_id, 2) as int) % 2 = 0")
    both = keys.migrated(k.where(even), NOW, 90).unionByName(keys.migrated(k.where(~even), NOW, 0))
    return both.select("vault_id", "line_no", "raw")


def _targets(spark, sf_dir):
    """The start of a node id, a part of a line in any case, and a key line of the node of the vault's tenth line."""
    k = _keys(spark, sf_dir)
    vaults = k.select("vault_id").distinct()
    lines = k.where("node_id IS NOT NULL").groupBy("vault_id").agg(F.min_by("node_id", "line_no").alias("node_id"))
    whole = lines.select("vault_id", C.key_of_node(F.col("node_id"), F.lit("elsewhere")).alias("target"))
    return vaults.select("vault_id", F.explode(F.array(F.lit(" AB"), F.lit("User17"))).alias("target")).unionByName(whole)


def x12_extend_expiry(spark, sf_dir):
    return keys.extended(_keys(spark, sf_dir), _targets(spark, sf_dir), NOW, 30).select("vault_id", "line_no", "raw", "updated")


def x12_extend_forever(spark, sf_dir):
    return keys.extended(_keys(spark, sf_dir), _targets(spark, sf_dir), NOW, None).where("updated").select("vault_id", "line_no", "raw")


def x13_revoke(spark, sf_dir):
    """What is left after the node of each vault's first key line, by another line of it, and a comment line are revoked."""
    k = _keys(spark, sf_dir)
    first = k.where("node_id IS NOT NULL").groupBy("vault_id").agg(F.min_by("node_id", "line_no").alias("node_id"))
    wanted = first.select("vault_id", F.explode(F.array(C.key_of_node(F.col("node_id"), F.lit("")), F.lit(" # comment "))).alias("target"))
    return keys.revoked(k, wanted).select("vault_id", "line_no")


def x13_revoke_fingerprint(spark, sf_dir):
    """What is left after each vault's last key line is revoked by its fingerprint."""
    k = _keys(spark, sf_dir)
    last = k.where("node_id IS NOT NULL").groupBy("vault_id").agg(F.max_by("raw", "line_no").alias("raw"))
    return keys.revoked(k, last.select("vault_id", C.fingerprint(F.col("raw")).alias("target"))).select("vault_id", "line_no")


def z6_seed_keys(spark, sf_dir):
    """Every vault is given its first node's key anew, a new one, a comment and a line that is no key."""
    k = _keys(spark, sf_dir)
    first = k.where("node_id IS NOT NULL").groupBy("vault_id").agg(F.min_by("node_id", "line_no").alias("node_id"))
    new = F.sha2(F.concat(F.lit("seed "), F.col("vault_id")).cast("binary"), 256)
    spec = F.concat(C.key_of_node(F.col("node_id"), F.lit("seeded")), F.lit(" expires=2027-01-01,# note\n\n no key at all,"), C.key_of_node(new, F.lit("fresh")))
    return keys.seeded(k, first.select("vault_id", spec.alias("spec")))


def x3_parse_pubkey(spark, sf_dir):
    a = fleet.auth_lines(spark, sf_dir)
    return a.select("vault_id", "line_no", C.node_of_key(F.col("raw")).alias("node_id"))


def x6_duration_days(spark, sf_dir):
    k = F.col("c_custkey")
    text = F.concat(F.when(k % 3 == 0, F.lit(" ")).otherwise(F.lit("")), F.when(k % 11 == 0, F.lit("never")).when(k % 13 == 0, F.lit("5m")).otherwise(F.concat((k % 50).cast("string"), F.element_at(F.array(F.lit(""), F.lit("d"), F.lit("w"), F.lit("y")), (k % 4 + 1).cast("int")))))
    return table(spark, sf_dir, "customer").select("c_custkey", text.alias("text"), C.duration_days(text).alias("days"))


def x8_expiry_from_ttl(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (fleet.seconds("o_orderdate") + F.col("o_orderkey") * 977 % 86400).alias("now"), (F.col("o_orderkey") % 400).alias("days"))
    return o.select("o_orderkey", C.expiry_from_ttl(F.col("now"), F.col("days")).alias("at"))


def x10_strip_and_build(spark, sf_dir):
    k = _keys(spark, sf_dir).where("node_id IS NOT NULL")
    return k.select("vault_id", "line_no", C.without_expiry(F.col("raw")).alias("bare"), C.with_expiry(F.col("raw"), F.lit("never"), F.lit(0)).alias("forever"))


def x22_parse_bool(spark, sf_dir):
    spelled = F.element_at(F.array(*[F.lit(x) for x in ("1", " TRUE", "yes ", "On", "0", "False", "no", "OFF", "maybe", "")]), (F.col("c_custkey") % 10 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", C.parse_bool(spelled).alias("value"))


def x15_derive_name(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    path = F.when(F.col("page_id") % 7 == 0, F.lit("/")).when(F.col("page_id") % 7 == 1, F.lit("/home/me")).otherwise(F.concat(F.lit("/srv/"), F.regexp_replace("url", "^[a-z]+://", ""), F.lit("/")))
    return p.select("page_id", C.derived_name(path, F.lit("/home/me")).alias("name"))


def x17_path_parts(spark, sf_dir):
    f = fleet.files(spark, sf_dir).select("vault_id", "path")
    return f.select("vault_id", "path", C.base_name(F.col("path")).alias("name"), C.ext_of(F.col("path")).alias("ext"), scope.parent_dir(F.col("path")).alias("dir"), scope.is_keep(F.col("path")).alias("is_keep"))


def x18_orphan_bucket(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (fleet.seconds("o_orderdate") + F.col("o_orderkey") * 977 % 86400).alias("t"))
    return o.select("o_orderkey", C.orphan_bucket(F.col("t")).alias("bucket"), C.rfc3339(F.col("t")).alias("rfc3339"))


def x14_key_status(spark, sf_dir):
    k = _keys(spark, sf_dir).where("node_id IS NOT NULL")
    left = F.when(F.col("kind") == "at", F.floor((F.col("at") - NOW) / C.DAY).cast("long"))
    return k.select("vault_id", "line_no", keys.status(F.col("kind"), F.col("at"), F.lit(NOW)).alias("status"), left.alias("remaining_days"))


def _attempts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    node = F.sha2(F.concat(F.lit("key "), (F.col("o_custkey") % 997).cast("string")).cast("binary"), 256)
    return o.join(c.hint("merge"), "o_custkey").select(
        F.concat(F.lit("v"), F.col("c_nationkey").cast("string")).alias("vault_id"), F.col("o_orderkey").alias("attempt_id"), F.when(F.col("o_orderkey") % 53 != 0, node).alias("node_id"),
        (fleet.seconds("o_orderdate") + 27 * 365 * C.DAY).alias("ts"), (F.col("o_orderkey") % 10 == 0).alias("enrolled"))


def j11_admit_peers(spark, sf_dir):
    held = keys.first_keys(_keys(spark, sf_dir)).where("cast(substring(vault_id, 2) as int) >= 10")
    n = F.expr("cast(substring(vault_id, 2) as int)")
    config = _attempts(spark, sf_dir).select("vault_id").distinct().select("vault_id", (n % 4 == 3).alias("no_tofu"), (n % 5 == 4).alias("has_auth_keys"))
    return keys.admissions(_attempts(spark, sf_dir), held, config)


def f11_handshake_verdict(spark, sf_dir):
    """Connection attempts as orders: protocol, binding, signature and authorisation follow from their columns."""
    o = table(spark, sf_dir, "orders")
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    binding = F.when(k % 3 == 0, F.lit("")).when(k % 3 == 1, F.lit("0000")).otherwise(F.lit("ab12"))
    verdict = keys.handshake_verdict(
        F.when(k % 17 == 0, 4).otherwise(5), k % 13 != 0, binding, F.when(k % 4 == 0, F.lit("")).when(k % 4 == 1, F.lit("ab12")).otherwise(F.lit("cd34")),
        k % 11 != 0, F.col("o_orderstatus") != "F", p.startswith("1") | p.startswith("2"))
    return o.select("o_orderkey", verdict.alias("verdict"))


def x7_dates(spark, sf_dir):
    """Dates that roll over, and back: day 31 of every order's month."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.date_format("o_orderdate", "yyyy-MM-"), F.lit("31")).alias("text"))
    return o.withColumn("seconds", C.date_seconds(F.col("text"))).withColumn("back", C.date_text(F.col("seconds"))).select("o_orderkey", "text", "seconds", "back")


def x16_parse_when(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(k % 5 == 0, F.concat(day, F.lit("T10:20:30Z"))).when(k % 5 == 1, F.concat(day, F.lit(" 01:02:03.75+05:30"))).when(k % 5 == 2, F.concat(day, F.lit("T23:59:59-0800"))).when(k % 5 == 3, k.cast("string")).otherwise(F.lit("yesterday"))
    return o.select("o_orderkey", text.alias("text"), C.when_seconds(text).alias("seconds"))


def x15_slugs(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    return p.select("page_id", C.slug(F.col("url")).alias("slug"), C.short_id(F.regexp_replace("url", "^[a-z]+", "")).alias("short_id"))


def s13_config_layers(spark, sf_dir):
    """Effective settings of every customer's device: flag over environment over file over default."""
    k = F.col("c_custkey")
    layers = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(k % 7 == 0, F.lit("Yes")).alias("no_tofu_flag"), F.when(k % 5 == 0, F.lit(" off ")).alias("no_tofu_env"), F.when(k % 3 == 0, F.lit("true")).alias("no_tofu_conf"),
        F.when(k % 4 == 0, F.when(k % 8 == 0, "never").otherwise("2w")).when(k % 4 == 1, F.lit("soon")).alias("ttl_flag"), F.when(k % 6 == 1, (k % 50).cast("int")).alias("ttl_conf"))
    return keys.effective_config(layers).select("c_custkey", "no_tofu", "ttl_days")


QUERIES = {f.__name__: f for f in (s6_read_auth_lines, x4_pubkey_string, x5_fingerprint, x9_parse_expiry, f10_valid_keys, w6_first_key_per_node, x11_migrate_default_expiry, x12_extend_expiry, x12_extend_forever, x13_revoke, x13_revoke_fingerprint, z6_seed_keys, x3_parse_pubkey, x6_duration_days, x8_expiry_from_ttl, x10_strip_and_build, x22_parse_bool, x15_derive_name, x17_path_parts, x18_orphan_bucket, x14_key_status, j11_admit_peers, f11_handshake_verdict, x7_dates, x16_parse_when, x15_slugs, s13_config_layers)}

_K = "WITH RECURSIVE " + fleet.AUTH_SQL + r""", d_keys AS (SELECT vault_id, line_no, raw, CASE WHEN starts_with(raw, 'ssh-ed25519 ') THEN lower(hex(from_base64(string_split(raw, ' ')[2])[20:51])) END AS node_id,
  regexp_extract(raw, ' expires=(\S+)', 1) AS ex, regexp_extract(raw, ' added=(\S+)', 1) AS ad, regexp_extract(raw, ' ttl=([0-9]+)d', 1) AS ttl FROM d_auth),
keyed AS (SELECT vault_id, line_no, raw, node_id,
  CASE WHEN node_id IS NULL THEN NULL WHEN ex = 'never' THEN 'never' WHEN ex <> '' OR (ttl <> '' AND ttl <> '0') THEN 'at' ELSE 'unset' END AS kind,
  CASE WHEN node_id IS NULL OR ex = 'never' THEN NULL WHEN ex <> '' THEN epoch(ex::DATE)::BIGINT WHEN ttl <> '' AND ttl <> '0' THEN epoch(ad::DATE)::BIGINT + ttl::BIGINT * 86400 END AS expires_at FROM d_keys)"""
_HEAD = r"regexp_replace(raw, ' (expires|ttl|added)=\S+', '', 'g')"
_HIT = """, own AS (SELECT vault_id, arg_min(node_id, line_no) AS own FROM keyed WHERE node_id IS NOT NULL GROUP BY vault_id), hits AS (SELECT k.*, node_id IS NOT NULL AND (starts_with(node_id, 'ab') OR contains(lower(raw), 'user17') OR contains(lower(raw), 'ab') OR node_id = own) AS hit FROM keyed k LEFT JOIN own USING (vault_id))"""
_ATT = """, att AS (SELECT 'v' || c_nationkey::VARCHAR AS vault_id, o_orderkey AS attempt_id, CASE WHEN o_orderkey % 53 <> 0 THEN sha256('key ' || (o_custkey % 997)::VARCHAR) END AS node_id,
  floor(epoch(o_orderdate))::BIGINT + 27 * 365 * 86400 AS ts, o_orderkey % 10 = 0 AS enrolled FROM orders JOIN customer ON o_custkey = c_custkey)"""

ORACLES = {
    "s6_read_auth_lines": _K + " SELECT vault_id, line_no, raw, node_id FROM keyed",
    "x4_pubkey_string": _K + r" SELECT vault_id, line_no, 'ssh-ed25519 ' || base64('\x00\x00\x00\x0Bssh-ed25519\x00\x00\x00\x20'::BLOB || unhex(node_id)) || ' u' || line_no::VARCHAR AS line FROM keyed WHERE node_id IS NOT NULL",
    "x5_fingerprint": _K + " SELECT vault_id, line_no, CASE WHEN starts_with(raw, 'ssh-') THEN 'SHA256:' || rtrim(base64(unhex(sha256(from_base64(string_split(raw, ' ')[2])))), '=') ELSE 'SHA256:?' END AS fingerprint FROM keyed",
    "x9_parse_expiry": _K + " SELECT vault_id, line_no, kind, expires_at FROM keyed",
    "f10_valid_keys": _K + f" SELECT vault_id, line_no, node_id FROM keyed WHERE node_id IS NOT NULL AND (kind <> 'at' OR {NOW} < expires_at)",
    "w6_first_key_per_node": _K + " SELECT vault_id, node_id, min(line_no) AS line_no FROM keyed WHERE node_id IS NOT NULL GROUP BY ALL",
    "x11_migrate_default_expiry": _K + f" SELECT vault_id, line_no, CASE WHEN kind = 'unset' AND substr(vault_id, 2)::INTEGER % 2 = 0 THEN {_HEAD} || ' expires=2026-04-02' ELSE raw END AS raw FROM keyed",
    "x12_extend_expiry": _K + _HIT + f" SELECT vault_id, line_no, CASE WHEN coalesce(hit, false) THEN {_HEAD} || ' expires=2026-02-01' ELSE raw END AS raw, coalesce(hit, false) AS updated FROM hits",
    "x12_extend_forever": _K + _HIT + f" SELECT vault_id, line_no, {_HEAD} || ' expires=never' AS raw FROM hits WHERE hit",
    "x13_revoke": _K + " , gone AS (SELECT vault_id, arg_min(node_id, line_no) AS node_id FROM keyed WHERE node_id IS NOT NULL GROUP BY vault_id) SELECT vault_id, line_no FROM keyed k WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.vault_id = k.vault_id AND g.node_id = k.node_id) AND raw <> '# comment'",
    "x13_revoke_fingerprint": _K + " , gone AS (SELECT vault_id, arg_max(node_id, line_no) AS node_id FROM keyed WHERE node_id IS NOT NULL GROUP BY vault_id) SELECT vault_id, line_no FROM keyed k WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.vault_id = k.vault_id AND g.node_id = k.node_id)",
    "z6_seed_keys": _K + r""", f AS (SELECT vault_id, arg_min(node_id, line_no) AS node_id, min(line_no) AS line_no FROM keyed WHERE node_id IS NOT NULL GROUP BY vault_id), top AS (SELECT vault_id, max(line_no) AS top FROM keyed GROUP BY vault_id)
SELECT k.vault_id, k.line_no, CASE WHEN k.line_no = f.line_no THEN 'ssh-ed25519 ' || base64('\x00\x00\x00\x0Bssh-ed25519\x00\x00\x00\x20'::BLOB || unhex(f.node_id)) || ' seeded' ELSE raw END AS raw FROM keyed k LEFT JOIN f ON f.vault_id = k.vault_id
UNION ALL SELECT vault_id, top + 1, 'ssh-ed25519 ' || base64('\x00\x00\x00\x0Bssh-ed25519\x00\x00\x00\x20'::BLOB || unhex(sha256('seed ' || vault_id))) || ' fresh' FROM top JOIN f USING (vault_id)""",
    "x3_parse_pubkey": _K + " SELECT vault_id, line_no, node_id FROM keyed",
    "x6_duration_days": "WITH t AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE '' END || CASE WHEN c_custkey % 11 = 0 THEN 'never' WHEN c_custkey % 13 = 0 THEN '5m' ELSE (c_custkey % 50)::VARCHAR || (['', 'd', 'w', 'y'])[c_custkey % 4 + 1] END AS text FROM customer) SELECT k AS c_custkey, text, CASE WHEN k % 11 <> 0 AND k % 13 <> 0 AND k % 50 > 0 THEN (k % 50) * ([1, 1, 7, 365])[k % 4 + 1] END::BIGINT AS days FROM t",
    "x8_expiry_from_ttl": "SELECT o_orderkey, ((floor(epoch(o_orderdate))::BIGINT + o_orderkey * 977 % 86400 + (o_orderkey % 400) * 86400) // 86400 + 1) * 86400 AS at FROM orders",
    "x10_strip_and_build": _K + f" SELECT vault_id, line_no, {_HEAD} AS bare, {_HEAD} || ' expires=never' AS forever FROM keyed WHERE node_id IS NOT NULL",
    "x22_parse_bool": "SELECT c_custkey, ([true, true, true, true, false, false, false, false, NULL, NULL])[c_custkey % 10 + 1] AS value FROM customer",
    "x15_derive_name": r"SELECT page_id, CASE WHEN page_id % 7 <= 1 THEN '' ELSE trim(regexp_replace(string_split(rtrim('/srv/' || regexp_replace(url, '^[a-z]+://', '') || '/', '/'), '/')[-1], '[^A-Za-z0-9._-]+', '-', 'g'), '-.') END AS name FROM pages",
    "x17_path_parts": "WITH " + fleet.FILES_SQL + " SELECT vault_id, path, string_split(path, '/')[-1] AS name, string_split(path, '.')[-1] AS ext, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, false AS is_keep FROM d_files",
    "x18_orphan_bucket": "WITH t AS (SELECT o_orderkey, to_timestamp(floor(epoch(o_orderdate))::BIGINT + o_orderkey * 977 % 86400) AT TIME ZONE 'UTC' AS t FROM orders) SELECT o_orderkey, strftime(t, '%Y-%m-%dT%H-%M-%SZ') AS bucket, strftime(t, '%Y-%m-%dT%H:%M:%S+00:00') AS rfc3339 FROM t",
    "x14_key_status": _K + f" SELECT vault_id, line_no, CASE kind WHEN 'never' THEN 'never-expires' WHEN 'unset' THEN 'unmigrated' ELSE CASE WHEN {NOW} < expires_at THEN 'valid' ELSE 'expired' END END AS status, CASE WHEN kind = 'at' THEN floor((expires_at - {NOW}) / 86400.0)::BIGINT END AS remaining_days FROM keyed WHERE node_id IS NOT NULL",
    "j11_admit_peers": _K + _ATT + """, held AS (SELECT * FROM keyed WHERE node_id IS NOT NULL AND substr(vault_id, 2)::INTEGER >= 10 QUALIFY row_number() OVER (PARTITION BY vault_id, node_id ORDER BY line_no) = 1),
firsts AS (SELECT vault_id, arg_min(attempt_id, (ts, attempt_id)) AS fa FROM att WHERE node_id IS NOT NULL GROUP BY vault_id),
tries AS (SELECT a.*, h.kind AS kind0, h.expires_at AS at0, fa = attempt_id AND substr(a.vault_id, 2)::INTEGER % 4 <> 3 AND substr(a.vault_id, 2)::INTEGER % 5 <> 4 AND NOT EXISTS (SELECT 1 FROM held x WHERE x.vault_id = a.vault_id) AS tofu,
  row_number() OVER (PARTITION BY a.vault_id, a.node_id ORDER BY ts, attempt_id) AS n FROM att a JOIN firsts USING (vault_id) LEFT JOIN held h ON h.vault_id = a.vault_id AND h.node_id = a.node_id WHERE a.node_id IS NOT NULL),
run AS (SELECT vault_id, node_id, attempt_id, n, kind0 AS kind, at0 AS expires_at, ''::VARCHAR AS verdict FROM tries WHERE false
  UNION ALL SELECT vault_id, node_id, NULL::BIGINT, 0::BIGINT, kind0, at0, 'start' FROM tries WHERE n = 1
  UNION ALL SELECT t.vault_id, t.node_id, t.attempt_id, t.n, CASE WHEN v IN ('refresh', 'enrol', 'tofu') THEN 'at' ELSE kind END, CASE WHEN v IN ('refresh', 'enrol', 'tofu') THEN ((t.ts + 90 * 86400) // 86400 + 1) * 86400 ELSE expires_at END, v
  FROM (SELECT t.*, r.kind, r.expires_at, CASE WHEN r.kind IS NOT NULL AND (r.kind <> 'at' OR t.ts < r.expires_at) THEN 'accept' WHEN t.enrolled AND r.kind IS NOT NULL THEN 'refresh' WHEN t.enrolled THEN 'enrol' WHEN r.kind IS NOT NULL THEN 'reject' WHEN t.tofu THEN 'tofu' ELSE 'reject' END AS v
    FROM run r JOIN tries t ON t.vault_id = r.vault_id AND t.node_id = r.node_id AND t.n = r.n + 1) t)
SELECT vault_id, node_id, attempt_id, verdict FROM run WHERE attempt_id IS NOT NULL UNION ALL SELECT vault_id, node_id, attempt_id, 'reject' FROM att WHERE node_id IS NULL""",
    "f11_handshake_verdict": """SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN 'bad-protocol' WHEN o_orderkey % 13 = 0 THEN 'bad-vault'
WHEN left(o_orderpriority, 1) IN ('1', '2') AND o_orderkey % 3 = 2 AND o_orderkey % 4 IN (2, 3) THEN 'bad-channel' WHEN o_orderkey % 11 = 0 THEN 'bad-signature'
WHEN left(o_orderpriority, 1) NOT IN ('1', '2') AND o_orderstatus = 'F' THEN 'not-authorised' ELSE 'established' END AS verdict FROM orders""",
    "x7_dates": "WITH t AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-31') AS text, date_trunc('month', o_orderdate)::DATE + 30 AS d FROM orders) SELECT o_orderkey, text, epoch(d)::BIGINT AS seconds, strftime(d, '%Y-%m-%d') AS back FROM t",
    "x16_parse_when": """WITH t AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, epoch(o_orderdate::DATE)::BIGINT AS s FROM orders)
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN day || 'T10:20:30Z' WHEN 1 THEN day || ' 01:02:03.75+05:30' WHEN 2 THEN day || 'T23:59:59-0800' WHEN 3 THEN o_orderkey::VARCHAR ELSE 'yesterday' END AS text,
CASE o_orderkey % 5 WHEN 0 THEN s + 37230 WHEN 1 THEN s + 3723 - 19800 WHEN 2 THEN s + 86399 + 28800 WHEN 3 THEN o_orderkey END AS seconds FROM t""",
    "x15_slugs": r"""WITH s AS (SELECT page_id, trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '-.') AS slug, left(trim(regexp_replace(regexp_replace(url, '^[a-z]+', ''), '[^A-Za-z0-9._-]+', '-', 'g'), '-.'), 8) AS h FROM pages)
SELECT page_id, slug, 'vault-' || CASE WHEN h = '' THEN 'x' ELSE h END AS short_id FROM s""",
    "s13_config_layers": """SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN true WHEN c_custkey % 5 = 0 THEN false WHEN c_custkey % 3 = 0 THEN true ELSE false END AS no_tofu,
(CASE WHEN c_custkey % 8 = 0 THEN 0 WHEN c_custkey % 4 = 0 THEN 14 WHEN c_custkey % 6 = 1 THEN c_custkey % 50 ELSE 90 END)::BIGINT AS ttl_days FROM customer""",
}
