"""Versioned-folder tables of a fleet, derived from the driver's tables; all of them are keyed by vault."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tables import table

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def seconds(ts: str) -> Column:
    return F.expr(f"timestampdiff(SECOND, {EPOCH}, cast({ts} as timestamp_ntz))")


def millis(ts: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, cast({ts} as timestamp_ntz)) div 1000")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vault_id, oid, node_id, counter, author_time, subject: every event is a commit of its user in its vault."""
    e = table(spark, sf_dir, "events")
    shaped = e.select(
        F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("-"), F.expr("user_id div 15").cast("string")).alias("vault_id"),
        F.sha1(F.concat(F.lit("commit "), F.col("event_id").cast("string")).cast("binary")).alias("oid"),
        F.sha1(F.concat(F.lit("node "), F.col("user_id").cast("string")).cast("binary")).alias("node_id"),
        seconds("ts").alias("author_time"), F.col("event_type").alias("subject"), "ts", "event_id", "user_id")
    order = Window.partitionBy("vault_id").orderBy("ts", "event_id")
    return shaped.withColumn("counter", F.row_number().over(order).cast("long"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vault_id, child, parent: the user's previous commit in the vault, and for some kinds anyone's previous one."""
    c = commits(spark, sf_dir)
    own = Window.partitionBy("vault_id", "user_id").orderBy("counter")
    anyone = Window.partitionBy("vault_id").orderBy("counter")
    both = c.withColumns({"mine": F.lag("oid").over(own), "other": F.when(F.col("subject").isin("purchase", "signup"), F.lag("oid").over(anyone))})
    parents = both.select("vault_id", F.col("oid").alias("child"), F.explode(F.array("mine", "other")).alias("parent"))
    return parents.where(F.col("parent").isNotNull()).distinct()


COMMITS_SQL = """
d_commits AS (
  SELECT strftime(ts, '%Y-%m-%d') || '-' || (user_id // 15)::VARCHAR AS vault_id, sha1('commit ' || event_id::VARCHAR) AS oid,
    sha1('node ' || user_id::VARCHAR) AS node_id, floor(epoch(ts))::BIGINT AS author_time, event_type AS subject, user_id,
    row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') || '-' || (user_id // 15)::VARCHAR ORDER BY ts, event_id)::BIGINT AS counter
  FROM events
)"""
EDGES_SQL = COMMITS_SQL + """, d_edges AS (
  SELECT vault_id, oid AS child, lag(oid) OVER (PARTITION BY vault_id, user_id ORDER BY counter) AS parent FROM d_commits QUALIFY parent IS NOT NULL
  UNION
  SELECT vault_id, child, parent FROM (SELECT vault_id, oid AS child, subject, lag(oid) OVER (PARTITION BY vault_id ORDER BY counter) AS parent FROM d_commits)
  WHERE subject IN ('purchase', 'signup') AND parent IS NOT NULL
)"""


def blob_oid(content: Column) -> Column:
    """The content-addressed id of a blob: SHA-1 over its kind, its length in bytes, a zero byte and the bytes."""
    raw = content.cast("binary")
    return F.sha1(F.concat(F.concat(F.lit("blob "), F.octet_length(raw).cast("string")).cast("binary"), F.lit(bytes(1)), raw))


def trees(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """base, ours and theirs: (vault_id, path, blob_oid), with edits, removals and additions on either side."""
    p = table(spark, sf_dir, "part").select(
        F.concat(F.lit("v"), (F.col("p_partkey") % 40).cast("string")).alias("vault_id"), F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".md")).alias("path"),
        F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("body"), F.col("p_partkey").alias("k"))
    base = p.where("k % 13 <> 0").select("vault_id", "path", blob_oid(F.col("body")).alias("blob_oid"))
    ours = p.where("k % 7 <> 0").select("vault_id", "path", blob_oid(F.concat("body", F.when(F.col("k") % 3 == 0, F.lit(" ours")).otherwise(F.lit("")))).alias("blob_oid"))
    theirs = p.where("k % 11 <> 0").select("vault_id", "path", blob_oid(F.concat("body", F.when(F.col("k") % 5 == 0, F.lit(" theirs")).otherwise(F.lit("")))).alias("blob_oid"))
    return base, ours, theirs


_BLOB = "sha1('blob ' || strlen({0})::VARCHAR || chr(0) || {0})"
TREES_SQL = f"""
d_part AS (SELECT 'v' || (p_partkey % 40)::VARCHAR AS vault_id, p_brand || '/' || p_partkey::VARCHAR || '.md' AS path, p_name || ' ' || p_partkey::VARCHAR AS body, p_partkey AS k FROM part),
d_base AS (SELECT vault_id, path, {_BLOB.format('body')} AS blob_oid FROM d_part WHERE k % 13 <> 0),
d_ours AS (SELECT vault_id, path, {_BLOB.format("(body || CASE WHEN k % 3 = 0 THEN ' ours' ELSE '' END)")} AS blob_oid FROM d_part WHERE k % 7 <> 0),
d_theirs AS (SELECT vault_id, path, {_BLOB.format("(body || CASE WHEN k % 5 = 0 THEN ' theirs' ELSE '' END)")} AS blob_oid FROM d_part WHERE k % 11 <> 0)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vault_id (the source), path, content of every document as a file."""
    d = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    ext = F.element_at(F.array(*[F.lit(x) for x in (".md", ".txt", ".log", ".png", ".csv")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return d.select(F.col("source").alias("vault_id"), F.concat_ws("/", "lang", F.concat(F.lit("d"), (F.col("doc_id") % 17).cast("string")), F.concat(F.col("doc_id").cast("string"), ext)).alias("path"), F.col("text").alias("content"))


FILES_SQL = """
d_files AS (SELECT source AS vault_id, lang || '/d' || (doc_id % 17)::VARCHAR || '/' || doc_id::VARCHAR || (['.md', '.txt', '.log', '.png', '.csv'])[doc_id % 5 + 1] AS path, text AS content FROM documents WHERE doc_id IS NOT NULL)"""


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vault_id (the host's last two parts) and path of every page."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_extract("url", r"([a-z]+\.[a-z]+)(?:[/?#]|$)", 1).alias("vault_id"), F.regexp_replace(F.regexp_extract("url", r"://[^/?#]*/([^?#]*)", 1), "/$", "").alias("path"))


PATHS_SQL = r"""
d_paths AS (SELECT page_id, regexp_extract(url, '([a-z]+\.[a-z]+)(?:[/?#]|$)', 1) AS vault_id, regexp_replace(regexp_extract(url, '://[^/?#]*/([^?#]*)', 1), '/$', '') AS path FROM pages)"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, turn, author, content: every conversation is a file, every turn a version of it."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.concat(F.lit("v"), (F.col("conv_id") % 20).cast("string")).alias("vault_id"), F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit(".md")).alias("path"), "turn", F.col("role").alias("author"), F.col("text").alias("content"))


VERSIONS_SQL = "d_versions AS (SELECT 'v' || (conv_id % 20)::VARCHAR AS vault_id, 'conv/' || conv_id::VARCHAR || '.md' AS path, turn, role AS author, text AS content FROM conversations)"


def room_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 10).alias("room"), F.col("event_type").alias("path"), F.expr("event_id div 2").alias("rev"), (F.col("event_id") % 9 == 0).alias("deleted"), F.col("props").alias("content"), "event_id", "ts")


ROOMS_SQL = "d_rooms AS (SELECT user_id % 10 AS room, event_type AS path, event_id // 2 AS rev, event_id % 9 = 0 AS deleted, props AS content, event_id, ts FROM events)"


def auth_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vault_id, line_no, raw: a key line per customer, with or without an expiry, some of them comments or malformed."""
    c = table(spark, sf_dir, "customer").where("c_custkey IS NOT NULL")
    k = F.col("c_custkey")
    node = F.sha2(F.concat(F.lit("key "), (k % 997).cast("string")).cast("binary"), 256)
    day = F.date_format(F.date_add(F.to_date(F.lit("2025-06-01")), (k % 400).cast("int")), "yyyy-MM-dd")
    body = F.concat(F.lit("ssh-ed25519 "), F.base64(F.concat(F.lit(bytes([0, 0, 0, 11])), F.lit(b"ssh-ed25519"), F.lit(bytes([0, 0, 0, 32])), F.unhex(node))))
    tail = F.when(k % 4 == 0, F.concat(F.lit(" expires="), day)).when(k % 4 == 1, F.lit(" expires=never")).when(k % 4 == 2, F.concat(F.lit(" added="), day, F.lit(" ttl="), (k % 120).cast("string"), F.lit("d"))).otherwise(F.lit(""))
    raw = F.when(k % 29 == 0, F.lit("# comment")).when(k % 31 == 0, F.lit("")).when(k % 37 == 0, F.lit("ssh-rsa AAAA broken")).otherwise(F.concat(body, F.lit(" user"), k.cast("string"), tail))
    return c.select(F.concat(F.lit("v"), F.col("c_nationkey").cast("string")).alias("vault_id"), k.alias("line_no"), raw.alias("raw"))


AUTH_SQL = r"""
d_auth0 AS (SELECT 'v' || c_nationkey::VARCHAR AS vault_id, c_custkey AS k, strftime(DATE '2025-06-01' + (c_custkey % 400)::INTEGER, '%Y-%m-%d') AS day,
  'ssh-ed25519 ' || base64('\x00\x00\x00\x0Bssh-ed25519\x00\x00\x00\x20'::BLOB || unhex(sha256('key ' || (c_custkey % 997)::VARCHAR))) AS body FROM customer WHERE c_custkey IS NOT NULL),
d_auth AS (SELECT vault_id, k AS line_no, CASE WHEN k % 29 = 0 THEN '# comment' WHEN k % 31 = 0 THEN '' WHEN k % 37 = 0 THEN 'ssh-rsa AAAA broken' ELSE
  body || ' user' || k::VARCHAR || CASE k % 4 WHEN 0 THEN ' expires=' || day WHEN 1 THEN ' expires=never' WHEN 2 THEN ' added=' || day || ' ttl=' || (k % 120)::VARCHAR || 'd' ELSE '' END END AS raw FROM d_auth0)"""
