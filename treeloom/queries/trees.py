"""Queries over trees: merges, diffs and plans on `part` and `documents`, scopes on `pages` and `documents`."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import scope
from ..plans import trees
from ..sources import fleet

# ---- trees -----------------------------------------------------------------------------------------------------------


def j1_merge_trees(spark, sf_dir):
    return trees.merge(*fleet.trees(spark, sf_dir)).select("vault_id", "path", "verdict", "blob_oid")


def j3_paths_added(spark, sf_dir):
    base, ours, _ = fleet.trees(spark, sf_dir)
    return trees.paths_added(base, ours)


def j4_path_present(spark, sf_dir):
    base, ours, theirs = fleet.trees(spark, sf_dir)
    return ours.join(theirs.select("vault_id", "path"), ["vault_id", "path"], "left_semi")


def a4_touches(spark, sf_dir):
    """Paths whose presence toggles between a commit and its parent."""
    base, ours, _ = fleet.trees(spark, sf_dir)
    rows = trees.lined_up(parent=base, child=ours)
    return rows.where(F.col("parent").isNull() != F.col("child").isNull()).select("vault_id", "path", F.when(F.col("parent").isNull(), "add").otherwise("delete").alias("kind"))


def j5_materialize_plan(spark, sf_dir):
    base, ours, theirs = fleet.trees(spark, sf_dir)
    return trees.materialize(theirs, ours, base).where("op IS NOT NULL OR state IS NOT NULL")


def j7_reconcile_plan(spark, sf_dir):
    base, ours, theirs = fleet.trees(spark, sf_dir)
    rows = trees.lined_up(base=base, theirs=theirs).where("theirs IS NOT NULL OR base IS NOT NULL")
    right = rows.select("vault_id", "path", F.col("theirs").alias("hash"), F.col("theirs").isNull().alias("deleted"))
    return trees.reconcile(ours.withColumnRenamed("blob_oid", "hash"), right)


def j13_restore_delta(spark, sf_dir):
    base, ours, _ = fleet.trees(spark, sf_dir)
    return trees.restore(base, ours)


def j15_removed_since(spark, sf_dir):
    _, ours, theirs = fleet.trees(spark, sf_dir)
    return ours.join(theirs, ["vault_id", "path"], "left_anti").select("vault_id", "path")


def j17_change_detect(spark, sf_dir):
    base, ours, _ = fleet.trees(spark, sf_dir)
    return trees.changed(ours, base)


def z7_diff(spark, sf_dir):
    base, _, theirs = fleet.trees(spark, sf_dir)
    return trees.diff(base, theirs)


def z3_export_primitive(spark, sf_dir):
    """Blobs that a commit's tree has over its parent's."""
    base, ours, _ = fleet.trees(spark, sf_dir)
    return ours.select("vault_id", "blob_oid").subtract(base.select("vault_id", "blob_oid"))


def z8_grep(spark, sf_dir):
    """Lines of a tree's files that match a pattern, with their numbers."""
    f = fleet.files(spark, sf_dir)
    lines = f.select("vault_id", "path", F.posexplode(F.split("content", "\n")).alias("i", "line"))
    return lines.where(F.col("line").rlike("(?i)licen[sc]e")).select("vault_id", "path", (F.col("i") + 1).alias("line_no"), "line")


def l2_tree_entry_sort(spark, sf_dir):
    """Entries of each folder in the order of tree objects: by name as bytes, folders with a slash behind."""
    f = fleet.files(spark, sf_dir).select("vault_id", "path")
    file_rows = f.select("vault_id", scope.parent_dir(F.col("path")).alias("dir"), F.substring_index("path", "/", -1).alias("name"), F.lit(False).alias("is_dir"))
    above = f.select("vault_id", F.explode(scope.ancestor_dirs(F.col("path"))).alias("d")).distinct()
    dirs = above.select("vault_id", scope.parent_dir(F.col("d")).alias("dir"), F.substring_index("d", "/", -1).alias("name"), F.lit(True).alias("is_dir"))
    key = F.concat("name", F.when(F.col("is_dir"), F.lit("/")).otherwise(F.lit(""))).cast("binary")
    return file_rows.unionByName(dirs).withColumn("place", F.row_number().over(Window.partitionBy("vault_id", "dir").orderBy(key)))


def a6_tree_oids(spark, sf_dir):
    """Root tree ids of every vault's base tree, hashed from the deepest folder up."""
    return trees.flat_tree_oids(fleet.trees(spark, sf_dir)[0])


def j9_folder_expand(spark, sf_dir):
    f = fleet.files(spark, sf_dir).select("vault_id", "path")
    dirs = f.select("vault_id", scope.parent_dir(F.col("path")).alias("from_dir")).distinct()
    ops = dirs.where(F.col("from_dir").rlike("/d(3|5|16)$")).select("vault_id", "from_dir", F.when(F.col("from_dir").endswith("3"), "delete").otherwise("rename").alias("op"), F.concat(F.lit("moved/"), F.col("from_dir")).alias("to_dir"))
    return trees.expand_folder(ops, f)


def j10_rename_quadrant(spark, sf_dir):
    f = fleet.files(spark, sf_dir).select("vault_id", "path")
    moved = f.withColumn("to_path", F.when(F.length("path") % 2 == 0, F.regexp_replace("path", r"\.[a-z]+$", ".md")).otherwise(F.concat(F.lit("x/"), F.col("path"))))
    verdict = trees.rename_verdict(scope.host_syncs(F.col("path"), HOST_GLOBS), scope.host_syncs(F.col("to_path"), HOST_GLOBS), F.length("path") % 5 != 0)
    return moved.select("vault_id", "path", "to_path", verdict.alias("verdict"))


def g8_prune_empty_dirs(spark, sf_dir):
    base, ours, _ = fleet.trees(spark, sf_dir)
    removed = base.join(ours.select("vault_id", "path"), ["vault_id", "path"], "left_anti")
    return trees.emptied_dirs(removed, ours.where("length(path) % 3 <> 0"))


def g9_ensure_folders(spark, sf_dir):
    f = fleet.files(spark, sf_dir)
    there = f.where("path LIKE 'en/%'").select("vault_id", F.explode(scope.ancestor_dirs(F.col("path"))).alias("dir")).distinct()
    return trees.folders_to_make(f, there)


# ---- scopes ----------------------------------------------------------------------------------------------------------

#: (kind, ord, pattern)
RULES = [("include", 1, "en/"), ("include", 2, "fr/**"), ("include", 3, "*1*"), ("ignore", 1, "# comment"), ("ignore", 2, ""), ("ignore", 3, "*.html"), ("ignore", 4, "!en/1*.html"), ("ignore", 5, "/fr/2?"), ("ignore", 6, "fr/**/*7"), ("ignore", 7, "3*/"), ("ignore", 8, "!**/3?1")]
HOST_GLOBS = ("en/d1/*", "**/d7/**", "fr/d?/1*.md")


def _rules(spark, sf_dir):
    given = spark.createDataFrame(RULES, "kind string, ord int, pattern string")
    return fleet.page_paths(spark, sf_dir).select("vault_id").distinct().crossJoin(F.broadcast(given))  # eleven rules for every vault


def f3_path_in_scope(spark, sf_dir):
    return scope.decisions(fleet.page_paths(spark, sf_dir), _rules(spark, sf_dir)).select("vault_id", "path", "in_scope")


def f4_ignore_decision(spark, sf_dir):
    return scope.decisions(fleet.page_paths(spark, sf_dir), _rules(spark, sf_dir)).select("vault_id", "path", "included", "ignored")


def f5_glob_to_rlike(spark, sf_dir):
    """Patterns made of the paths themselves, compiled; each must match its own path's shape."""
    p = fleet.page_paths(spark, sf_dir).select("page_id", "path")
    pattern = F.concat(F.when(F.col("page_id") % 3 == 0, F.lit("!")).otherwise(F.lit("")), F.regexp_replace("path", "[0-9]", "?"), F.when(F.col("page_id") % 2 == 0, F.lit("/")).otherwise(F.lit("**")))
    return scope.compiled(p.withColumn("pattern", pattern)).select("page_id", "pattern", "negated", "rule_re", F.expr("path RLIKE rule_re").alias("hit"))


def j8_rule_hits(spark, sf_dir):
    """Rules against paths: how many distinct paths of a vault each rule matches."""
    return scope.rule_hits(fleet.page_paths(spark, sf_dir), _rules(spark, sf_dir)).groupBy("vault_id", "kind", "ord").agg(F.count("*").alias("hits"))


def f6_is_binary(spark, sf_dir):
    f = fleet.files(spark, sf_dir)
    odd = F.when(F.length("path") % 4 == 0, F.concat("content", F.lit("\x00"))).otherwise(F.col("content"))
    return f.select("vault_id", "path", scope.is_binary(odd).alias("is_binary"))


def _kept_files(spark, sf_dir):
    f = fleet.files(spark, sf_dir)
    real = f.select("vault_id", "path", F.octet_length("content").cast("long").alias("size")).where("path NOT LIKE '%/d4/%'")
    seeds = f.select("vault_id", F.concat(scope.parent_dir(F.col("path")), F.lit("/.keep")).alias("path"), F.lit(7).cast("long").alias("size")).distinct()
    return real.unionByName(seeds)


def f7_canonicalize_keeps(spark, sf_dir):
    return scope.canonical_keeps(_kept_files(spark, sf_dir))


def f8_empty_dir_keeps(spark, sf_dir):
    f = fleet.files(spark, sf_dir)
    dirs = f.select("vault_id", F.explode(scope.ancestor_dirs(F.col("path"))).alias("dir")).distinct()
    return scope.empty_dir_keeps(dirs, f.where("path LIKE '%.md'"))


def f9_should_sync(spark, sf_dir):
    f = fleet.files(spark, sf_dir).select("vault_id", "path")
    return f.withColumn("syncs", scope.host_syncs(F.col("path"), HOST_GLOBS))


def s7b_default_rules(spark, sf_dir):
    """The rules that a fresh vault starts with."""
    given = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(i + 1).alias("ord"), F.lit(p).alias("pattern")) for i, (k, p) in enumerate(scope.DEFAULT_RULES)])
    return fleet.files(spark, sf_dir).select("vault_id").distinct().select("vault_id", F.inline(given))


def s7_scope_rules(spark, sf_dir):
    """Rule files (here: a conversation's turns, a vault each, the turn as the file's rank) as numbered rules."""
    v = fleet.versions(spark, sf_dir)
    return scope.rule_lines(v.select(F.concat_ws(":", "vault_id", "path").alias("vault_id"), F.col("turn").alias("file_rank"), "content"))


def z6_add_rules(spark, sf_dir):
    """Additive rule lists: includes are deduplicated, ignores are appended behind."""
    old = _rules(spark, sf_dir)
    more = spark.createDataFrame([("include", 90, "en/"), ("include", 91, "de/"), ("ignore", 90, "*.html"), ("ignore", 91, "x")], "kind string, ord int, pattern string")
    new = old.select("vault_id").distinct().crossJoin(F.broadcast(more))  # four rules for every vault
    return scope.rules_added(old, new.select(*old.columns))


QUERIES = {f.__name__: f for f in (j1_merge_trees, j3_paths_added, j4_path_present, a4_touches, j5_materialize_plan, j7_reconcile_plan, j13_restore_delta, j15_removed_since, j17_change_detect, z7_diff, z3_export_primitive, z8_grep, l2_tree_entry_sort, a6_tree_oids, j9_folder_expand, j10_rename_quadrant, g8_prune_empty_dirs, g9_ensure_folders, f3_path_in_scope, f4_ignore_decision, f5_glob_to_rlike, j8_rule_hits, f6_is_binary, f7_canonicalize_keeps, f8_empty_dir_keeps, f9_should_sync, s7b_default_rules, s7_scope_rules, z6_add_rules)}

_T, _F, _P = "WITH " + fleet.TREES_SQL, "WITH " + fleet.FILES_SQL, "WITH " + fleet.PATHS_SQL
_ANC = "list_transform(range(1, len(string_split({0}, '/'))), lambda n: array_to_string(list_slice(string_split({0}, '/'), 1, n), '/'))"
_DIR = "regexp_extract({0}, '^(.*)/[^/]*$', 1)"


def _glob_sql(p: str) -> str:
    quoted = rf"regexp_replace({p}, '([.+()^${{}}\[\]\\|])', '\\\1', 'g')"
    return rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({quoted}, '\*\*/?', chr(1), 'g'), '\*', '[^/]*', 'g'), '\?', '[^/]', 'g'), chr(1), '.*', 'g')"


def _compiled_sql(source: str, columns: str) -> str:
    return rf"""(SELECT {columns}, negated, '(?s)\A' || CASE WHEN contains(p, '/') THEN '' ELSE '(?:.*/)?' END || {_glob_sql("ltrim(p, '/')")} || '(?:/.*)?\z' AS rule_re
FROM (SELECT *, starts_with(q, '!') AS negated, regexp_replace(CASE WHEN starts_with(q, '!') THEN substr(q, 2) ELSE q END, '/$', '') AS p
  FROM (SELECT *, rtrim(pattern, chr(13)) AS q FROM {source}) WHERE trim(q) <> '' AND NOT starts_with(ltrim(q), '#')))"""


_RULES = _P + ", rules AS (SELECT * FROM (SELECT DISTINCT vault_id FROM d_paths), (VALUES " + ", ".join(f"('{k}', {o}, '{p}')" for k, o, p in RULES) + ") AS r(kind, ord, pattern)), ready AS " + _compiled_sql("rules", "vault_id, kind, ord")
_DECIDED = _RULES + """, each AS (SELECT DISTINCT vault_id, path FROM d_paths),
hits AS (SELECT e.vault_id, path, kind, ord, negated FROM each e JOIN ready r ON r.vault_id = e.vault_id AND regexp_matches(path, rule_re)),
told AS (SELECT vault_id, path, bool_or(kind = 'include') AS included, arg_max(NOT negated, ord) FILTER (kind = 'ignore') AS ignored FROM hits GROUP BY ALL),
decided AS (SELECT vault_id, path, coalesce(included, false) AS included, coalesce(ignored, false) AS ignored FROM each LEFT JOIN told USING (vault_id, path))"""
_LINED = "(SELECT vault_id, path, max({0}) AS {0}, max({1}) AS {1} FROM (SELECT vault_id, path, blob_oid AS {0}, NULL AS {1} FROM {2} UNION ALL SELECT vault_id, path, NULL, blob_oid FROM {3}) GROUP BY ALL)"


def _syncs_sql(path: str) -> str:
    globs = " OR ".join(rf"regexp_matches({path}, '(?s)\A{g}\z')" for g in ("en/d1/[^/]*", ".*d7/.*", r"fr/d[^/]/1[^/]*\.md"))
    return f"CASE WHEN {path} = '.context' OR starts_with({path}, '.context/') THEN false WHEN {globs} THEN false WHEN {path} = '.contextignore' THEN true WHEN {path} = '.keep' OR ends_with({path}, '/.keep') THEN true ELSE lower(regexp_extract({path}, '\\.([^./]*)$', 1)) IN ('md', 'mdx', 'txt', 'canvas', 'json', 'css', 'yaml', 'yml', 'csv') END"


_MERGED = _T + """, m AS (SELECT coalesce(o.vault_id, t.vault_id, b.vault_id) AS vault_id, coalesce(o.path, t.path, b.path) AS path, o.blob_oid AS o, t.blob_oid AS t, b.blob_oid AS b
FROM d_ours o FULL JOIN d_theirs t ON o.vault_id = t.vault_id AND o.path = t.path FULL JOIN d_base b ON b.vault_id = coalesce(o.vault_id, t.vault_id) AND b.path = coalesce(o.path, t.path))"""
_SEEDS = _F + f""", kept AS (SELECT vault_id, path, strlen(content)::BIGINT AS size FROM d_files WHERE path NOT LIKE '%/d4/%' UNION ALL SELECT DISTINCT vault_id, {_DIR.format('path')} || '/.keep', 7::BIGINT FROM d_files)"""

ORACLES = {
    "j1_merge_trees": _MERGED + """ SELECT vault_id, path, CASE WHEN o IS NOT DISTINCT FROM t THEN 'same' WHEN o IS NOT DISTINCT FROM b THEN 'theirs' WHEN t IS NOT DISTINCT FROM b THEN 'ours' WHEN o IS NOT NULL AND t IS NOT NULL AND b IS NOT NULL THEN 'lines' ELSE 'theirs' END AS verdict,
CASE WHEN o IS DISTINCT FROM t AND o IS DISTINCT FROM b AND t IS NOT DISTINCT FROM b THEN o ELSE t END AS blob_oid FROM m""",
    "j3_paths_added": _T + " SELECT vault_id, path FROM d_ours EXCEPT SELECT vault_id, path FROM d_base",
    "j4_path_present": _T + " SELECT * FROM d_ours o WHERE EXISTS (SELECT 1 FROM d_theirs t WHERE t.vault_id = o.vault_id AND t.path = o.path)",
    "a4_touches": _MERGED + " SELECT vault_id, path, CASE WHEN b IS NULL THEN 'add' ELSE 'delete' END AS kind FROM m WHERE (b IS NULL) <> (o IS NULL)",
    "j5_materialize_plan": _MERGED + """, p AS (SELECT vault_id, path, t AS want, CASE WHEN t IS NULL THEN CASE WHEN b IS NOT NULL AND o = b THEN 'remove' END WHEN t = o THEN NULL WHEN o IS NOT NULL AND o IS DISTINCT FROM b THEN 'defer' ELSE 'write' END AS op, b FROM m)
SELECT * FROM (SELECT vault_id, path, op, CASE WHEN op = 'write' THEN want END AS blob_oid, CASE WHEN want IS NULL THEN NULL WHEN op = 'defer' THEN b ELSE want END AS state FROM p) WHERE op IS NOT NULL OR state IS NOT NULL""",
    "j7_reconcile_plan": _MERGED + " SELECT vault_id, path, CASE WHEN t IS NULL AND b IS NULL THEN 'push' WHEN o IS NULL AND t IS NULL THEN 'none' WHEN o IS NULL THEN 'apply' WHEN t IS NULL THEN 'delete' WHEN o = t THEN 'none' ELSE 'push' END AS step FROM m",
    "j13_restore_delta": _MERGED + " SELECT vault_id, path, CASE WHEN b IS NULL THEN 'remove' ELSE 'write' END AS op, b AS blob_oid FROM m WHERE o IS NOT NULL OR b IS NOT NULL",
    "j15_removed_since": _T + " SELECT vault_id, path FROM d_ours EXCEPT SELECT vault_id, path FROM d_theirs",
    "j17_change_detect": _MERGED + " SELECT vault_id, bool_or(o IS DISTINCT FROM b) AS changed, count(*) FILTER (o IS DISTINCT FROM b) AS n_changed FROM m WHERE o IS NOT NULL OR b IS NOT NULL GROUP BY ALL",
    "z7_diff": _MERGED + " SELECT vault_id, path, CASE WHEN b IS NULL THEN 'A' WHEN t IS NULL THEN 'D' ELSE 'M' END AS status, b AS old, t AS new FROM m WHERE b IS DISTINCT FROM t",
    "z3_export_primitive": _T + " SELECT vault_id, blob_oid FROM d_ours EXCEPT SELECT vault_id, blob_oid FROM d_base",
    "z8_grep": _F + ", l AS (SELECT vault_id, path, string_split(content, chr(10)) AS ls FROM d_files), e AS (SELECT vault_id, path, unnest(ls) AS line, unnest(range(1, len(ls) + 1))::INTEGER AS line_no FROM l) SELECT vault_id, path, line_no, line FROM e WHERE regexp_matches(line, '(?i)licen[sc]e')",
    "l2_tree_entry_sort": _F + f""", dirs AS (SELECT DISTINCT vault_id, unnest({_ANC.format('path')}) AS d FROM d_files),
ents AS (SELECT vault_id, {_DIR.format('path')} AS dir, string_split(path, '/')[-1] AS name, false AS is_dir FROM d_files UNION ALL SELECT vault_id, {_DIR.format('d')}, string_split(d, '/')[-1], true FROM dirs)
SELECT *, row_number() OVER (PARTITION BY vault_id, dir ORDER BY (name || CASE WHEN is_dir THEN '/' ELSE '' END)::BLOB)::INTEGER AS place FROM ents""",
    "a6_tree_oids": _T + """, leaf AS (SELECT vault_id, string_split(path, '/')[1] AS dir, string_split(path, '/')[2] AS name, blob_oid FROM d_base),
sub AS (SELECT vault_id, dir, string_agg(hex(('100644 ' || name)::BLOB) || '00' || upper(blob_oid), '' ORDER BY name) AS body FROM leaf GROUP BY ALL),
subs AS (SELECT vault_id, dir, sha1(unhex(hex(('tree ' || (length(body) // 2)::VARCHAR)::BLOB) || '00' || body)) AS oid FROM sub),
top AS (SELECT vault_id, string_agg(hex(('40000 ' || dir)::BLOB) || '00' || upper(oid), '' ORDER BY dir || '/') AS body FROM subs GROUP BY ALL)
SELECT vault_id, sha1(unhex(hex(('tree ' || (length(body) // 2)::VARCHAR)::BLOB) || '00' || body)) AS tree_oid FROM top""",
    "j9_folder_expand": _F + f""", dirs AS (SELECT DISTINCT vault_id, {_DIR.format('path')} AS d FROM d_files), ops AS (SELECT vault_id, d, CASE WHEN ends_with(d, '3') THEN 'delete' ELSE 'rename' END AS op, 'moved/' || d AS to_dir FROM dirs WHERE regexp_matches(d, '/d(3|5|16)$'))
SELECT f.vault_id, op, path, CASE WHEN op = 'rename' THEN to_dir || substr(path, length(d) + 1) END AS to_path FROM d_files f JOIN ops o ON o.vault_id = f.vault_id AND (path = d OR starts_with(path, d || '/'))""",
    "j10_rename_quadrant": _F + f""", mv AS (SELECT vault_id, path, CASE WHEN length(path) % 2 = 0 THEN regexp_replace(path, '\\.[a-z]+$', '.md') ELSE 'x/' || path END AS to_path FROM d_files),
v AS (SELECT *, {_syncs_sql('path')} AS f, {_syncs_sql('to_path')} AS t, length(path) % 5 <> 0 AS there FROM mv)
SELECT vault_id, path, to_path, CASE WHEN t AND NOT there THEN 'write' WHEN f AND t THEN 'rename' WHEN f THEN 'delete' WHEN t THEN 'create' ELSE 'none' END AS verdict FROM v""",
    "g8_prune_empty_dirs": _T + f", gone AS (SELECT vault_id, path FROM d_base EXCEPT SELECT vault_id, path FROM d_ours) SELECT DISTINCT vault_id, unnest({_ANC.format('path')}) AS dir FROM gone EXCEPT SELECT vault_id, unnest({_ANC.format('path')}) FROM d_ours WHERE length(path) % 3 <> 0",
    "g9_ensure_folders": _F + f", d AS (SELECT vault_id, unnest({_ANC.format('path')}) AS dir FROM d_files EXCEPT SELECT vault_id, unnest({_ANC.format('path')}) FROM d_files WHERE path LIKE 'en/%') SELECT vault_id, dir, len(string_split(dir, '/'))::INTEGER AS depth FROM d",
    "f3_path_in_scope": _DECIDED + " SELECT vault_id, path, included AND NOT ignored AND NOT (path = '.context' OR starts_with(path, '.context/')) AS in_scope FROM decided",
    "f4_ignore_decision": _DECIDED + " SELECT vault_id, path, included, ignored FROM decided",
    "f5_glob_to_rlike": _P + ", pats AS (SELECT page_id, path, CASE WHEN page_id % 3 = 0 THEN '!' ELSE '' END || regexp_replace(path, '[0-9]', '?', 'g') || CASE WHEN page_id % 2 = 0 THEN '/' ELSE '**' END AS pattern FROM d_paths), ready AS " + _compiled_sql("pats", "page_id, path, pattern") + " SELECT page_id, pattern, negated, rule_re, regexp_matches(path, rule_re) AS hit FROM ready",
    "j8_rule_hits": _RULES + " SELECT p.vault_id, kind, ord, count(*) AS hits FROM (SELECT DISTINCT vault_id, path FROM d_paths) p JOIN ready r ON r.vault_id = p.vault_id AND regexp_matches(path, rule_re) GROUP BY ALL",
    "f6_is_binary": _F + " SELECT vault_id, path, contains(CASE WHEN length(path) % 4 = 0 THEN content || chr(0) ELSE content END, chr(0)) AS is_binary FROM d_files",
    "f7_canonicalize_keeps": _SEEDS + f""" SELECT vault_id, path, size FROM kept WHERE NOT ends_with(path, '/.keep') UNION ALL SELECT vault_id, dir || '/.keep', 0::BIGINT FROM (
SELECT vault_id, {_DIR.format('path')} AS dir FROM kept WHERE ends_with(path, '/.keep') EXCEPT SELECT vault_id, unnest({_ANC.format('path')}) FROM kept WHERE NOT ends_with(path, '/.keep'))""",
    "f8_empty_dir_keeps": _F + f" SELECT vault_id, dir || '/.keep' AS path FROM (SELECT vault_id, unnest({_ANC.format('path')}) AS dir FROM d_files EXCEPT SELECT vault_id, unnest({_ANC.format('path')}) FROM d_files WHERE path LIKE '%.md')",
    "f9_should_sync": _F + f" SELECT vault_id, path, {_syncs_sql('path')} AS syncs FROM d_files",
    "s7b_default_rules": _F + " SELECT * FROM (SELECT DISTINCT vault_id FROM d_files), (VALUES ('include', 1, '*'), ('ignore', 2, '!*.md'), ('ignore', 3, '!.contextignore')) AS r(kind, ord, pattern)",
    "s7_scope_rules": "WITH " + fleet.VERSIONS_SQL + ", l AS (SELECT vault_id || ':' || path AS vault_id, turn, string_split(content, chr(10)) AS ls FROM d_versions), e AS (SELECT vault_id, turn, unnest(range(len(ls))) AS i, unnest(ls) AS pattern FROM l) SELECT vault_id, row_number() OVER (PARTITION BY vault_id ORDER BY turn, i)::INTEGER AS ord, pattern FROM e",
    "z6_add_rules": _RULES + """, more AS (SELECT * FROM (SELECT DISTINCT vault_id FROM d_paths), (VALUES ('include', 90, 'en/'), ('include', 91, 'de/'), ('ignore', 90, '*.html'), ('ignore', 91, 'x')) AS r(kind, ord, pattern)),
both_ AS (SELECT vault_id, kind, ord, pattern FROM rules UNION ALL SELECT * FROM more), one AS (SELECT * FROM both_ QUALIFY row_number() OVER (PARTITION BY vault_id, kind, CASE WHEN kind = 'include' THEN pattern ELSE ord::VARCHAR END ORDER BY ord) = 1)
SELECT vault_id, kind, row_number() OVER (PARTITION BY vault_id, kind ORDER BY ord)::INTEGER AS ord, pattern FROM one""",
}
