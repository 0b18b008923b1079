"""Rules found through the index against every rule's expression on every path."""

import random

from pyspark.sql import functions as F

from treeloom.operators import scope

RULES = "vault_id string, kind string, ord long, pattern string"


def test_the_index_misses_no_match(spark):
    rng = random.Random(9)
    bits = ["a", "b", "ab", "*", "**", "?", "/", ".", ".md", "x.y", "é", "[", "!", "\\", " "]
    patterns = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 6))) for _ in range(700)] + ["*", "**", "/a", "a/", "*.md", "**/a", "a/**/b", "*.", "?", "!*.md", "/*", "//a", ".md", "a?b/*.x.y"]
    parts = ["a", "b", "ab", "aab", "x.y", "a.md", "é", "[", ".", "b.md", "a b", "!a", "axb", ""]
    paths = list({"/".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(400)} - {""})
    rules = scope.compiled(spark.createDataFrame([("v", "ignore", i, p) for i, p in enumerate(patterns)], RULES))
    each = spark.createDataFrame([("v", p) for p in paths], "vault_id string, path string")
    plain = {(r.path, r.ord) for r in each.join(rules, "vault_id").where(F.expr("path RLIKE rule_re")).collect()}
    found = [(r.path, r.ord) for r in scope.rule_hits(each, spark.createDataFrame([("v", "ignore", i, p) for i, p in enumerate(patterns)], RULES)).collect()]
    assert len(found) == len(set(found)) and set(found) == plain and len(plain) > 1000


def test_many_rules_meet_few_paths(spark):
    """3,000 rules and 100,000 paths of one vault: 300 million pairs, of which the index leaves some tens of thousands."""
    rules = spark.range(3_000).select(F.lit("v").alias("vault_id"), F.lit("ignore").alias("kind"), F.col("id").alias("ord"), F.concat(F.element_at(F.array(*map(F.lit, ("/dir", "name", "*.x", "a/dir"))), (F.col("id") % 4 + 1).cast("int")), F.col("id").cast("string")).alias("pattern"))
    paths = spark.range(100_000).select(F.lit("v").alias("vault_id"), F.concat(F.lit("dir"), (F.col("id") % 5_000).cast("string"), F.lit("/sub/f"), F.col("id").cast("string"), F.lit(".x"), (F.col("id") % 9_000).cast("string")).alias("path"))
    assert scope.candidates(paths, scope.compiled(rules)).count() == scope.rule_hits(paths, rules).count() == 750 * 20 + sum(1 for i in range(100_000) if i % 9_000 < 3_000 and i % 9_000 % 4 == 2)
