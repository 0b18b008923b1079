"""What many vaults and devices look like at one time: status, settings, states rolled up, and whether replicas agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

#: Settings of a device when nothing says otherwise.
DEBOUNCE_MS = 1000
TTL_DAYS = 90


def key_counts(keys: DataFrame, now: Column, by: str = "vault_id") -> DataFrame:
    """keys (by, node_id, kind, at) -> (by, authorized_keys: nodes with a key line that is valid now, any_key: true)."""
    return keys.where("node_id IS NOT NULL").groupBy(by).agg(F.countDistinct(F.when(C.is_valid(F.col("kind"), F.col("at"), now), F.col("node_id"))).alias("authorized_keys"), F.lit(True).alias("any_key"))


def vault_status(vaults: DataFrame, known: DataFrame, mains: DataFrame, tips: DataFrame, keys: DataFrame, peers: DataFrame, now: Column) -> DataFrame:
    """One row for each of vaults (vault_id), also where the other tables have none of it: known_primitives, of known (vault_id, oid,
    is_primitive); main_oid and main_short, of mains (vault_id, main_oid); frontier_tips and how many, of tips (vault_id, oid, k: their
    order); authorized_keys, the nodes with a key line that is valid now, of keys (vault_id, node_id, kind, at), a node's first line
    alone (keys may be the result of key_counts() too); no_keys_yet, where no line is a key at all; peers, of (vault_id, peer), each once in order. A vault's tips and peers are
    listed in its row, as its status shows them; all else is counted."""
    counts = known.groupBy("vault_id").agg(F.count_if("is_primitive").alias("known_primitives"))
    ends = tips.groupBy("vault_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "oid"))), lambda t: t["oid"]).alias("frontier_tips"))
    held = keys if "authorized_keys" in keys.columns else key_counts(keys, now)
    to = peers.where("peer IS NOT NULL").groupBy("vault_id").agg(F.array_sort(F.collect_set("peer")).alias("peers"))
    rows = vaults.select("vault_id").distinct()
    for part in (counts, mains.select("vault_id", "main_oid"), ends, held, to):
        rows = rows.join(part, "vault_id", "left")
    none = F.array().cast("array<string>")
    whole = rows.withColumns({"frontier_tips": F.coalesce("frontier_tips", none), "peers": F.coalesce("peers", none)})
    return whole.select(
        "vault_id", "main_oid", C.short_sha(F.col("main_oid")).alias("main_short"), F.coalesce("known_primitives", F.lit(0)).alias("known_primitives"), "frontier_tips", F.size("frontier_tips").alias("tips"),
        F.coalesce("authorized_keys", F.lit(0)).alias("authorized_keys"), F.col("any_key").isNull().alias("no_keys_yet"), "peers")


def sync_states(vaults: DataFrame) -> DataFrame:
    """vaults (vault_id, enabled, failed, main_oid, ...) with state: disabled whatever else holds, error after a failure, active with a
    main commit, else idle. Null flags are as if false."""
    state = F.when(~F.coalesce("enabled", F.lit(False)), "disabled").when(F.coalesce("failed", F.lit(False)), "error").when(F.col("main_oid").isNotNull(), "active").otherwise("idle")
    return vaults.withColumn("state", state)


def rolled_up(states: DataFrame, by: list[str]) -> DataFrame:
    """states (*by, state) -> per group vault_count, active_count, error_count and its state: error over active over idle over disabled."""
    of = lambda name: F.count_if(F.col("state") == name)
    counted = states.groupBy(*by).agg(F.count("*").alias("vault_count"), of("active").alias("active_count"), of("error").alias("error_count"), of("idle").alias("__idle"))
    state = F.when(F.col("error_count") > 0, "error").when(F.col("active_count") > 0, "active").when(F.col("__idle") > 0, "idle").otherwise("disabled")
    return counted.withColumn("state", state).drop("__idle")


def listed(spec: Column) -> Column:
    """The parts of a comma-separated setting, trimmed, empty ones dropped; an empty array for null."""
    parts = F.filter(F.transform(F.split(spec, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def settings(layers: DataFrame) -> DataFrame:
    """layers with every setting a device has, each from its flag, else its environment, else its file, else the default. A
    layer is a column named for the setting, an underscore and flag, env or conf; columns that are not there are as if null. Flags and
    environment are text, the file is typed (conf columns: booleans, long, text, arrays of text).

    no_tofu, no_tls, allow_binary: spelled truths, what means nothing is as if unset; listen, log, name: text; debounce_ms: whole
    numbers; peers and auth_keys: separated by commas, a layer without any entry does not count; include: the file's, else
    everything; ttl_days: `never` or 0 means none (0), durations as keys have them. client_key is the first auth key of flag or
    environment; tofu says whether first contacts are trusted: neither forbidden nor replaced by auth keys."""
    there = set(layers.columns)

    def told(name: str, layer: str, kind: str = "string") -> Column:
        column = f"{name}_{layer}"
        return F.col(column) if column in there else F.lit(None).cast(kind)

    def first(name: str, read, kind: str, default: Column) -> Column:  # noqa: ANN001
        return F.coalesce(read(told(name, "flag")), read(told(name, "env")), told(name, "conf", kind), default)

    some = lambda entries: F.when(F.size(entries) > 0, entries)
    entries = lambda text: some(listed(text))
    text = lambda value: F.when(F.trim(value) != "", F.trim(value))
    whole = lambda value: F.when(F.trim(value).rlike("^[0-9]{1,18}$"), F.trim(value)).try_cast("long")
    days = lambda value: F.when(F.lower(F.trim(value)).isin("never", "0"), 0).otherwise(C.duration_days(F.trim(value))).cast("long")
    none = F.array().cast("array<string>")
    found = {name: first(name, C.parse_bool, "boolean", F.lit(False)) for name in ("no_tofu", "no_tls", "allow_binary")}
    found |= {name: first(name, text, "string", F.lit(None).cast("string")) for name in ("listen", "log", "name")}
    found["debounce_ms"] = first("debounce_ms", whole, "long", F.lit(DEBOUNCE_MS).cast("long"))
    found["ttl_days"] = first("ttl", days, "long", F.lit(TTL_DAYS).cast("long")).cast("long")
    for name in ("peers", "auth_keys"):
        found[name] = F.coalesce(entries(told(name, "flag")), entries(told(name, "env")), told(name, "conf", "array<string>"), none)
    found["include"] = F.coalesce(some(told("include", "conf", "array<string>")), F.array(F.lit("**")))
    found["client_key"] = F.try_element_at(F.coalesce(entries(told("auth_keys", "flag")), entries(told("auth_keys", "env")), none), F.lit(1))
    known = layers.withColumns(found)
    return known.withColumn("tofu", ~F.col("no_tofu") & (F.size("auth_keys") == 0))


def agreement(known: DataFrame, mains: DataFrame) -> DataFrame:
    """Whether the replicas of each vault agree: known (vault_id, replica, oid), mains (vault_id, replica, main_oid). replicas, how many
    different mains and known sets they have, and converged, where both are one. A set is told by its size and an order-free sum of
    hashes, so no set is collected; a replica without any known commit has the empty set."""
    key = ["vault_id", "replica"]
    sets = known.groupBy(*key).agg(F.count("*").alias("n"), F.sum(F.xxhash64("oid").cast("decimal(38,0)")).alias("h"))
    each = mains.select(*key, "main_oid").join(sets, key, "full").withColumn("n", F.coalesce("n", F.lit(0)))
    counted = each.groupBy("vault_id").agg(
        F.count("*").alias("replicas"), F.countDistinct(F.coalesce("main_oid", F.lit(""))).alias("mains"), F.countDistinct(F.struct("n", "h")).alias("known_sets"))
    return counted.withColumn("converged", (F.col("mains") == 1) & (F.col("known_sets") == 1))
