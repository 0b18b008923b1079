"""Which paths and contents of a vault take part: ordered glob rules, text tests, keep sentinels, a host's own filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rules of a fresh vault, the control folder, the control file, the sentinel, and the extensions that sync.
DEFAULT_RULES = (("include", "*"), ("ignore", "!*.md"), ("ignore", "!.contextignore"))
CONTROL_DIR, CONTROL_FILE, KEEP = ".context", ".contextignore", ".keep"
TEXT_EXTENSIONS = ("md", "mdx", "txt", "canvas", "json", "css", "yaml", "yml", "csv")


def _glob_body(body: Column) -> Column:
    """A glob's body as a regular expression: ** is anything (with one following slash), * and ? stay within a segment."""
    quoted = F.regexp_replace(body, r"([.+()^${}\[\]\\|])", r"\\$1")
    starred = F.regexp_replace(F.regexp_replace(quoted, r"\*\*/?", "\x01"), r"\*", "[^/]*")
    return F.regexp_replace(F.regexp_replace(starred, r"\?", "[^/]"), "\x01", ".*")


def compiled(rules: DataFrame, pattern: str = "pattern") -> DataFrame:
    """rules with negated and rule_re; blank lines and comments go."""
    raw = F.regexp_replace(F.col(pattern), "\\r+\\z", "")
    kept = rules.withColumn("__p", raw).where((F.trim("__p") != "") & ~F.ltrim("__p").startswith("#"))
    kept = kept.withColumn("negated", F.col("__p").startswith("!"))
    kept = kept.withColumn("__p", F.when(F.col("negated"), F.expr("substring(__p, 2)")).otherwise(F.col("__p")))
    kept = kept.withColumn("__p", F.regexp_replace("__p", "/\\z", ""))
    literal = F.regexp_replace("__p", "^/+", "")
    anchored = F.contains(F.col("__p"), F.lit("/"))
    anywhere = F.when(anchored, F.lit("")).otherwise(F.lit("(?:.*/)?"))
    kept = kept.withColumn("rule_re", F.concat(F.lit("(?s)\\A"), anywhere, _glob_body(literal), F.lit("(?:/.*)?\\z")))
    return kept.withColumn("rule_key", _rule_key(literal, anchored)).drop("__p")


def _rule_key(body: Column, anchored: Column) -> Column:
    """What any path that a glob matches has among its path_keys(): the literal first segment or name, else the extension, the first or
    the last character of a segment; `*` (all paths) where the glob tells nothing. A match begins and ends with a segment."""
    wild = body.rlike("[*?]")
    first = F.regexp_extract(body, "(?s)^[^/]*", 0)
    head = F.regexp_extract(body, "(?s)^[^*?/]", 0)
    tail = F.regexp_extract(body, "(?s)[^*?/]*$", 0)
    return (
        F.when(anchored & ~first.rlike("[*?]"), F.concat(F.lit("f:"), first)).when(~wild, F.concat(F.lit("n:"), body))
        .when(F.contains(tail, F.lit(".")), F.concat(F.lit("e:"), F.substring_index(tail, ".", -1)))
        .when(head != "", F.concat(F.when(anchored, F.lit("g:")).otherwise(F.lit("h:")), head))
        .when(tail != "", F.concat(F.lit("t:"), F.right(tail, F.lit(1)))).otherwise(F.lit("*")))


def path_keys(path: Column) -> Column:
    """All keys under which a rule that matches the path can be filed."""
    parts = F.split(path, "/")
    tagged = lambda tag, value: F.transform(parts, lambda c: F.concat(F.lit(tag), value(c)))
    first = F.get(parts, F.lit(0))
    extensions = F.transform(F.filter(parts, lambda c: F.contains(c, F.lit("."))), lambda c: F.concat(F.lit("e:"), F.substring_index(c, ".", -1)))
    own = F.array(F.lit("*"), F.concat(F.lit("f:"), first), F.concat(F.lit("g:"), F.left(first, F.lit(1))))
    return F.array_distinct(F.concat(own, extensions, tagged("n:", lambda c: c), tagged("h:", lambda c: F.left(c, F.lit(1))), tagged("t:", lambda c: F.right(c, F.lit(1)))))


def candidates(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """paths (vault_id, path) with the rules (compiled) of their vault that are filed under one of their keys: an equi-join on vault
    and key. A rule has one key, so no pair comes twice."""
    each = paths.select("vault_id", "path").distinct().withColumn("rule_key", F.explode(path_keys(F.col("path"))))
    return each.join(rules, ["vault_id", "rule_key"])


def rule_hits(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(vault_id, path, kind, ord, negated) of every rule (vault_id, kind, ord, pattern) that matches a path. Expressions run only on
    candidates from the index, so not on every rule with every path."""
    ready = compiled(rules).select("vault_id", "kind", "ord", "negated", "rule_re", "rule_key")
    return candidates(paths, ready).where(F.expr("path RLIKE rule_re")).select("vault_id", "path", "kind", "ord", "negated")


def is_control(path: Column) -> Column:
    return (path == CONTROL_DIR) | path.startswith(CONTROL_DIR + "/")


def decisions(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """paths (vault_id, path) with included, ignored (the last matching rule decides) and in_scope.

    What matched (rule_hits) is pre-aggregated to one row a path, and missing matches count as not included and not ignored.
    """
    each = paths.select("vault_id", "path").distinct()
    hits = rule_hits(each, rules)
    told = hits.groupBy("vault_id", "path").agg(
        F.max(F.col("kind") == "include").alias("included"),
        F.max_by(F.when(F.col("kind") == "ignore", ~F.col("negated")), F.when(F.col("kind") == "ignore", F.col("ord"))).alias("ignored"))
    whole = each.join(told, ["vault_id", "path"], "left").select("vault_id", "path", F.coalesce("included", F.lit(False)).alias("included"), F.coalesce("ignored", F.lit(False)).alias("ignored"))
    return whole.withColumn("in_scope", F.col("included") & ~F.col("ignored") & ~is_control(F.col("path")))


def is_binary(content: Column) -> Column:
    """Not UTF-8, or with a zero byte."""
    raw = content.cast("binary")
    return ~F.is_valid_utf8(content.cast("string")) | (F.locate("\x00", F.try_validate_utf8(raw.cast("string"))) > 0)


def parent_dir(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def ancestor_dirs(path: Column) -> Column:
    """All folders above a path, outermost first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))


def is_keep(path: Column) -> Column:
    return (path == KEEP) | path.endswith("/" + KEEP)


def canonical_keeps(files: DataFrame) -> DataFrame:
    """files (vault_id, path, size): sentinels of folders that hold a real file go; the rest become one empty file each."""
    keep = is_keep(F.col("path"))
    real = files.where(~keep)
    occupied = real.select("vault_id", F.explode(ancestor_dirs(F.col("path"))).alias("dir")).distinct()
    held = files.where(keep).select("vault_id", parent_dir(F.col("path")).alias("dir")).distinct().where("dir <> ''")
    kept = held.join(occupied, ["vault_id", "dir"], "left_anti").select("vault_id", F.concat("dir", F.lit("/" + KEEP)).alias("path"), F.lit(0).cast("long").alias("size"))
    return real.select("vault_id", "path", "size").unionByName(kept)


def empty_dir_keeps(dirs: DataFrame, files: DataFrame) -> DataFrame:
    """One sentinel per folder (vault_id, dir) that no file lies beneath."""
    occupied = files.select("vault_id", F.explode(ancestor_dirs(F.col("path"))).alias("dir")).distinct()
    return dirs.join(occupied, ["vault_id", "dir"], "left_anti").select("vault_id", F.concat("dir", F.lit("/" + KEEP)).alias("path"))


def host_syncs(path: Column, globs: tuple[str, ...]) -> Column:
    """A host's own order of tests; its globs match the whole path and know no base names."""
    name = F.substring_index(path, "/", -1)
    extension = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    matched = F.lit(False)
    for glob in globs:
        quoted = _glob_body(F.lit(glob))
        matched = matched | F.regexp_like(path, F.concat(F.lit("(?s)\\A"), quoted, F.lit("\\z")))
    return F.when(is_control(path), False).when(matched, False).when(path == CONTROL_FILE, True).when(is_keep(path), True).otherwise(extension.isin(*TEXT_EXTENSIONS))


def rule_lines(files: DataFrame) -> DataFrame:
    """files (vault_id, file_rank, content), the control file before a node's own, as numbered rules (vault_id, ord, pattern)."""
    lines = files.select("vault_id", "file_rank", F.posexplode(F.split("content", "\n")).alias("line_no", "pattern"))
    return lines.select("vault_id", F.row_number().over(Window.partitionBy("vault_id").orderBy("file_rank", "line_no")).alias("ord"), "pattern")


def rules_added(rules: DataFrame, more: DataFrame) -> DataFrame:
    """rules and more (vault_id, kind, ord, pattern) as one list, numbered anew: includes that are there already are not added again,
    ignores are appended behind whatever they say, since the last one that matches decides."""
    both = rules.withColumn("__late", F.lit(0)).unionByName(more.withColumn("__late", F.lit(1)))
    own = F.when(F.col("kind") == "include", F.concat(F.lit("p"), F.col("pattern"))).otherwise(F.concat_ws("/", F.col("__late").cast("string"), F.col("ord").cast("string")))
    first = Window.partitionBy("vault_id", "kind", own).orderBy("__late", "ord")
    kept = both.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    return kept.select("vault_id", "kind", F.row_number().over(Window.partitionBy("vault_id", "kind").orderBy("__late", "ord")).alias("ord"), "pattern")
