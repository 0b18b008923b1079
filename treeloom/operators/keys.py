"""Key lines of many vaults: validity, rewriting, reports, and who is admitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.tables import saved
from .chains import chained

TTL_DAYS = 90


def parsed(lines: DataFrame) -> DataFrame:
    """lines (vault_id, line_no, raw) with node_id, kind and at; comments, blanks and malformed lines keep a null node."""
    said = lines.withColumn("node_id", C.node_of_key(F.col("raw"))).withColumn("__e", C.expiry(F.col("raw")))
    return said.withColumns({"kind": F.when(F.col("node_id").isNotNull(), F.col("__e.kind")), "at": F.when(F.col("node_id").isNotNull(), F.col("__e.at"))}).drop("__e")


def first_keys(keys: DataFrame) -> DataFrame:
    """Of each node's lines in a vault the first."""
    order = Window.partitionBy("vault_id", "node_id").orderBy("line_no")
    return keys.where("node_id IS NOT NULL").withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def status(kind: Column, at: Column, now: Column) -> Column:
    return F.when(kind == "never", "never-expires").when(kind == "unset", "unmigrated").when(now < at, "valid").otherwise("expired")


def migrated(keys: DataFrame, now: int, ttl_days: int = TTL_DAYS) -> DataFrame:
    """parsed keys with the default expiry on every key line that has none; a default of 0 days changes nothing."""
    if not ttl_days:
        return keys
    new = C.with_expiry(F.col("raw"), F.lit("at"), C.expiry_from_ttl(F.lit(now), F.lit(ttl_days)))
    return keys.withColumn("raw", F.when(F.col("kind") == "unset", new).otherwise(F.col("raw")))


def extended(keys: DataFrame, targets: DataFrame, now: int, days: int | None) -> DataFrame:
    """parsed keys with updated, and a new expiry (none given: never) on key lines that some target (vault_id, target) of their
    vault names: by a key line of the same node, by the start of the node's id, or by any part of the line, case aside."""
    named = targets.select("vault_id", C.node_of_key(F.col("target")).alias("__node"), F.lower(F.trim("target")).alias("__part"))
    held = keys.where("node_id IS NOT NULL").select("vault_id", "line_no", "node_id", "raw")
    fits = (F.col("node_id") == F.col("__node")) | F.col("node_id").startswith(F.col("__part")) | F.contains(F.lower("raw"), F.col("__part"))
    hit = held.join(named, "vault_id").where(F.coalesce(fits, F.lit(False))).select("vault_id", "line_no").distinct().withColumn("updated", F.lit(True))
    new = C.with_expiry(F.col("raw"), F.lit("never"), F.lit(0)) if days is None else C.with_expiry(F.col("raw"), F.lit("at"), C.expiry_from_ttl(F.lit(now), F.lit(days)))
    told = keys.join(hit, ["vault_id", "line_no"], "left").withColumn("updated", F.coalesce("updated", F.lit(False)))
    return told.withColumn("raw", F.when(F.col("updated"), new).otherwise(F.col("raw")))


def revoked(keys: DataFrame, targets: DataFrame) -> DataFrame:
    """parsed keys without what the targets (vault_id, target) of their vault name: all lines of a target's node, where it is a
    key line or the fingerprint of one that is held; a line of no node goes only where it is the target itself."""
    prints = keys.where("node_id IS NOT NULL").select("vault_id", C.fingerprint(F.col("raw")).alias("target"), F.col("node_id").alias("__held")).distinct()
    named = targets.select("vault_id", "target").join(prints, ["vault_id", "target"], "left")
    gone = named.select("vault_id", F.coalesce(C.node_of_key(F.col("target")), "__held").alias("node_id"), F.trim("target").alias("__line"))
    kept = keys.join(gone.where("node_id IS NOT NULL").select("vault_id", "node_id").distinct(), ["vault_id", "node_id"], "left_anti")
    lines = gone.select("vault_id", "__line").distinct()
    same = (kept["vault_id"] == lines["vault_id"]) & (F.trim(kept["raw"]) == lines["__line"]) & kept["node_id"].isNull()
    return kept.join(lines, same, "left_anti")


def seeded(keys: DataFrame, specs: DataFrame) -> DataFrame:
    """(vault_id, line_no, raw) after the keys of specs (vault_id, spec: lines parted by commas or line breaks) are authorised in
    order: a node's first line is replaced in place, other nodes' lines follow behind; blanks, comments and lines that are no
    key are skipped, and expiries in them are dropped."""
    given = specs.select("vault_id", F.posexplode(F.split("spec", "[,\n]")).alias("at", "line")).withColumn("line", F.trim("line")).where("line <> '' AND NOT line LIKE '#%'")
    given = given.withColumn("node_id", C.node_of_key(F.col("line"))).where("node_id IS NOT NULL")
    last = given.groupBy("vault_id", "node_id").agg(F.max_by("line", "at").alias("line"), F.min("at").alias("at")).withColumn("new", C.without_expiry(F.col("line")))
    first = first_keys(keys).select("vault_id", "line_no", "node_id")
    put = first.join(last, ["vault_id", "node_id"]).select("vault_id", "line_no", "new")
    stay = keys.join(put, ["vault_id", "line_no"], "left").select("vault_id", "line_no", F.coalesce("new", "raw").alias("raw"))
    size = keys.groupBy("vault_id").agg(F.max("line_no").alias("__last"))
    added = last.join(first, ["vault_id", "node_id"], "left_anti").join(size, "vault_id", "left")
    place = F.coalesce("__last", F.lit(0)) + F.row_number().over(Window.partitionBy("vault_id").orderBy("at"))
    return stay.unionByName(added.select("vault_id", place.cast(keys.schema["line_no"].dataType).alias("line_no"), F.col("new").alias("raw")))


def effective_config(layers: DataFrame) -> DataFrame:
    """layers (no_tofu_flag, no_tofu_env, no_tofu_conf, ttl_flag, ttl_conf and any further columns) with no_tofu and ttl_days: a
    flag stands over the environment, that over the file, that over the default. Spellings that mean nothing are as if unset;
    a ttl of `never` or 0 means none (0 days)."""
    truth = F.coalesce(C.parse_bool(F.col("no_tofu_flag")), C.parse_bool(F.col("no_tofu_env")), C.parse_bool(F.col("no_tofu_conf")), F.lit(False))
    days = F.coalesce(F.when(F.trim("ttl_flag").isin("never", "0"), 0), C.duration_days(F.col("ttl_flag")), F.col("ttl_conf"), F.lit(TTL_DAYS)).cast("long")
    return layers.withColumns({"no_tofu": truth, "ttl_days": days})


def admissions(attempts: DataFrame, keys: DataFrame, config: DataFrame, ttl_days: int = TTL_DAYS) -> DataFrame:
    """attempts (vault_id, attempt_id, node_id, ts, enrolled) with verdict, against keys (vault_id, node_id, kind, at) and
    config (vault_id, no_tofu, has_auth_keys).

    Where a vault has no key, TOFU is on and no auth keys are set, its first attempt is accepted whatever it is, so only
    that one can be TOFU. A node's key changes only at attempts that make or renew it, and each of these holds until its own
    expiry, so they are a greedy chain: the next one is the first enrolled attempt from that expiry on. All other attempts look
    back at the last of them.
    """
    any_key = keys.groupBy("vault_id").agg(F.lit(True).alias("any_key"))
    first = attempts.where("node_id IS NOT NULL").groupBy("vault_id").agg(F.min(F.struct("ts", "attempt_id")).alias("__f")).select("vault_id", F.col("__f.attempt_id").alias("first_attempt"))
    shaped = attempts.where("node_id IS NOT NULL").join(config, "vault_id", "left").join(any_key, "vault_id", "left").join(first, "vault_id", "left").join(keys.select("vault_id", "node_id", "kind", "at"), ["vault_id", "node_id"], "left")
    tofu = F.col("any_key").isNull() & ~F.col("no_tofu") & ~F.col("has_auth_keys") & (F.col("attempt_id") == F.col("first_attempt"))
    node = ["vault_id", "node_id"]
    order = Window.partitionBy(*node).orderBy("ts", "attempt_id")
    placed = shaped.select(*node, "attempt_id", "ts", "enrolled", "kind", "at", F.coalesce(tofu, F.lit(False)).alias("tofu")).withColumn("own", F.row_number().over(order).cast("long"))
    opens = (F.col("enrolled") & (F.col("kind").isNull() | ((F.col("kind") == "at") & (F.col("ts") >= F.col("at"))))) | (F.col("kind").isNull() & F.col("tofu"))
    placed = saved(placed.withColumn("__opens", F.coalesce(opens, F.lit(False))), "attempts")
    begin = placed.where("__opens").groupBy(*node).agg(F.min("own").alias("__begin"))
    until = C.expiry_from_ttl(F.col("ts"), F.lit(ttl_days))
    rows = placed.hint("merge").join(begin.hint("merge"), node).select(*node, "own", F.col("ts").alias("level"), (until - 1).alias("bar"), F.col("enrolled").alias("candidate"), (F.col("own") == F.col("__begin")).alias("first"))
    made = chained(rows, node).withColumn("made", F.lit(True))
    known = placed.hint("merge").join(made.hint("merge"), [*node, "own"], "left").withColumn("__at", F.last(F.when(F.col("made"), until), True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    kind = F.when(F.col("__at").isNotNull(), "at").otherwise(F.col("kind"))
    valid = F.coalesce(C.is_valid(kind, F.coalesce("__at", "at"), F.col("ts")), F.lit(False))
    verdict = F.when(F.col("made"), F.when(kind.isNotNull(), "refresh").when(F.col("enrolled"), "enrol").otherwise("tofu")).when(valid, "accept").otherwise("reject")
    told = known.select(*node, "attempt_id", verdict.alias("verdict"))
    lost = attempts.where("node_id IS NULL").select(*node, "attempt_id", F.lit("reject").alias("verdict"))
    return told.unionByName(lost)


def handshake_verdict(proto: Column, vault_same: Column, advertised: Column, observed: Column, signed: Column, authorised: Column, connector: Column, want: int = 5) -> Column:
    """The first failing check of a connection attempt, in order."""
    bound = connector & (advertised != "") & ~advertised.rlike("^0+$") & (observed != "")
    return (
        F.when(proto != want, "bad-protocol").when(~vault_same, "bad-vault").when(bound & (advertised != observed), "bad-channel")
        .when(~signed, "bad-signature").when(~connector & ~authorised, "not-authorised").otherwise("established"))
