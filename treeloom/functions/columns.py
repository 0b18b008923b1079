"""Columns over key lines, dates, durations, names: built-in expressions only; what can't be parsed is null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400
_HEAD = bytes([0, 0, 0, 11]) + b"ssh-ed25519" + bytes([0, 0, 0, 32])


def words(line: Column) -> Column:
    return F.split(F.regexp_replace(line, r"^\s+|\s+$", ""), r"\s+")


def key_blob(line: Column) -> Column:
    """The bytes of a key line's second word; null unless it is well-formed base64."""
    part = F.try_element_at(words(line), F.lit(2))
    return F.when(part.rlike("^[A-Za-z0-9+/]+={0,2}$") & (F.length(part) % 4 == 0), F.try_to_binary(part, F.lit("base64")))


def node_of_key(line: Column) -> Column:
    """The node id (hex) of an ssh-ed25519 public key line, else null."""
    blob = key_blob(line)
    fits = (F.try_element_at(words(line), F.lit(1)) == "ssh-ed25519") & (F.octet_length(blob) == 51) & (F.substring(blob, 1, 19) == F.lit(_HEAD))
    return F.when(fits, F.lower(F.hex(F.substring(blob, 20, 32))))


def key_of_node(node: Column, comment: Column) -> Column:
    body = F.concat(F.lit("ssh-ed25519 "), F.base64(F.concat(F.lit(_HEAD), F.unhex(node))))
    return F.when(comment == "", body).otherwise(F.concat(body, F.lit(" "), comment))


def fingerprint(line: Column) -> Column:
    blob = key_blob(line)
    return F.coalesce(F.concat(F.lit("SHA256:"), F.regexp_replace(F.base64(F.unhex(F.sha2(blob, 256))), "=+$", "")), F.lit("SHA256:?"))


def duration_days(text: Column) -> Column:
    """90, 90d, 2w, 1y; never, 0 and anything else are null."""
    n = F.regexp_extract(F.trim(text), r"^([0-9]+)[dwy]?$", 1).try_cast("long")
    unit = F.regexp_extract(F.trim(text), r"^[0-9]+([dwy])$", 1)
    days = n * F.when(unit == "w", 7).when(unit == "y", 365).otherwise(1)
    return F.when(days > 0, days)


def date_seconds(text: Column) -> Column:
    """UTC seconds of YYYY-MM-DD; days up to 31 roll over into the next month, as arithmetic has it."""
    y, m, d = (F.regexp_extract(text, r"^([0-9]{4})-([0-9]{2})-([0-9]{2})$", i).try_cast("int") for i in (1, 2, 3))
    good = m.between(1, 12) & d.between(1, 31)
    return F.when(good, (F.unix_date(F.make_date(F.when(good, y), F.when(good, m), F.lit(1))) + d - 1).cast("long") * DAY)


def date_text(seconds: Column) -> Column:
    return F.date_format(F.date_from_unix_date(F.floor(seconds / DAY).cast("int")), "yyyy-MM-dd")


def expiry_from_ttl(now: Column, days: Column) -> Column:
    """The UTC midnight strictly after now plus days."""
    return (F.floor((now + days * DAY) / DAY) + 1).cast("long") * DAY


def expiry(line: Column) -> Column:
    """struct(kind, at): the last well-formed expires=, else added= and ttl=."""
    tokens = F.slice(words(line), 3, F.greatest(F.size(words(line)) - 2, F.lit(0)))
    value = lambda name: F.transform(F.filter(tokens, lambda t: t.startswith(name)), lambda t: F.regexp_replace(t, "^[a-z]+=", ""))
    good = F.filter(value("expires="), lambda v: (v == "never") | date_seconds(v).isNotNull())
    said = F.try_element_at(good, F.lit(-1))
    ttl = F.try_element_at(F.filter(F.transform(value("ttl="), duration_days), lambda d: d.isNotNull()), F.lit(-1))
    added = F.try_element_at(F.filter(F.transform(value("added="), date_seconds), lambda d: d.isNotNull()), F.lit(-1))
    kind = F.when(said == "never", "never").when(said.isNotNull() | (ttl.isNotNull() & added.isNotNull()), "at").otherwise("unset")
    at = F.when(said.isNotNull(), date_seconds(said)).otherwise(added + ttl * DAY)
    return F.struct(kind.alias("kind"), at.alias("at"))


def without_expiry(line: Column) -> Column:
    return F.array_join(F.filter(words(line), lambda t: ~t.rlike("^(expires|ttl|added)=")), " ")


def with_expiry(line: Column, kind: Column, at: Column) -> Column:
    head = without_expiry(line)
    return F.when(kind == "at", F.concat(head, F.lit(" expires="), date_text(at))).when(kind == "never", F.concat(head, F.lit(" expires=never"))).otherwise(head)


def is_valid(kind: Column, at: Column, now: Column) -> Column:
    return (kind != "at") | (now < at)


def slug(text: Column) -> Column:
    dashed = F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "-")
    return F.regexp_replace(F.regexp_replace(dashed, r"^[-.]+", ""), r"[-.]+$", "")


def short_id(text: Column) -> Column:
    head = F.substring(slug(text), 1, 8)
    return F.concat(F.lit("vault-"), F.when(head == "", "x").otherwise(head))


def when_seconds(text: Column) -> Column:
    """Unix seconds, or a date and time with Z, +HH:MM, +HHMM or nothing (UTC) behind; fractions are dropped."""
    t = F.trim(text)
    pattern = r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})[T ]([0-9]{1,2}):([0-9]{1,2})(?::([0-9]{1,2}))?(?:\.[0-9]+)?(Z|[+-][0-9]{2}:?[0-9]{2})?$"
    y, mo, d, h, mi, s = (F.regexp_extract(t, pattern, i).try_cast("int") for i in range(1, 7))
    zone = F.regexp_extract(t, pattern, 7)
    off = F.when(zone.rlike("^[+-]"), (F.substring(zone, 2, 2).try_cast("int") * 3600 + F.substring(zone, -2, 2).try_cast("int") * 60) * F.when(zone.startswith("-"), -1).otherwise(1)).otherwise(0)
    good = mo.between(1, 12)
    day = F.unix_date(F.make_date(F.when(good, y), F.when(good, mo), F.lit(1))) + d - 1
    return F.coalesce(F.when(t.rlike("^[0-9]+$"), t.try_cast("long")), day.cast("long") * DAY + h * 3600 + mi * 60 + F.coalesce(s, F.lit(0)) - off)


def parse_bool(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.isin("1", "true", "yes", "on"), True).when(t.isin("0", "false", "no", "off"), False)


def derived_name(path: Column, home: Column) -> Column:
    """A vault's name from its folder: the slug of the last part, empty for the root and for the home folder."""
    last = F.substring_index(F.regexp_replace(path, "/+$", ""), "/", -1)
    return F.when((path == home) | last.isin("", "."), F.lit("")).otherwise(slug(last))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def ext_of(path: Column) -> Column:
    """The lower-cased extension of a path's last part; empty where there is none."""
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]*)$", 1))


def _utc(seconds: Column, pattern: str) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), pattern)


def orphan_bucket(seconds: Column) -> Column:
    """The name of the folder for files set aside at a time (UTC; the session's time zone must be UTC)."""
    return _utc(seconds, "yyyy-MM-dd'T'HH-mm-ss'Z'")


def rfc3339(seconds: Column) -> Column:
    return F.concat(_utc(seconds, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def short_sha(oid: Column) -> Column:
    return F.substring(oid, 1, 12)


def clock_text(ts: Column) -> Column:
    """Time of day to the millisecond."""
    return F.date_format(ts, "HH:mm:ss.SSS")
