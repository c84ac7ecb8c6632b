"""A kept dictionary of which pattern tags which site.

Matching every site of a report against every pattern is most of a tag report's work, and next time the sites are nearly the
same. So the pairs (entity, pattern) are stored; an update matches only the sites that are new, against all patterns, and the
patterns that are new, against all known sites, and drops the pairs of patterns that are gone. Which tag a pattern has, its
colour and its place are looked up when the dictionary is read, so renamed or reordered tags need no match at all.

Pairs are added before the sites and patterns they are of, so a job that dies in between is repeated in full by the next
one; a pair stored twice counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktempo.operators.tags import INFO, pattern_matches
from worktempo.sources import stored


def create(spark: SparkSession, database: str) -> None:
    for name, columns in (("sites", "entity string"), ("patterns", "pattern string"),
                          ("site_patterns", "entity string, pattern string")):
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")


def update(spark: SparkSession, database: str, entities: DataFrame, tags: DataFrame) -> None:
    """Take in the sites of ``entities`` and the patterns of ``tags`` as they are now."""
    sites, kept, pairs = (f"{database}.{n}" for n in ("sites", "patterns", "site_patterns"))
    patterns = tags.select(F.lower("domain_pattern").alias("pattern")).where(F.col("pattern").isNotNull()).distinct()
    known_sites, known_patterns = stored.current(spark, sites), stored.current(spark, kept)
    gone = known_patterns.join(patterns, "pattern", "left_anti")
    new_patterns = patterns.join(known_patterns, "pattern", "left_anti")
    new_sites = entities.select("entity").where(F.col("entity").isNotNull()).distinct().join(known_sites, "entity", "left_anti")
    if not gone.isEmpty():
        stored.replace(stored.current(spark, pairs).join(patterns, "pattern", "left_semi"), pairs)
    if not new_patterns.isEmpty():
        stored.append(pattern_matches(known_sites, new_patterns).select("entity", "pattern"), pairs)
    if not new_sites.isEmpty():
        stored.append(pattern_matches(new_sites, patterns).select("entity", "pattern"), pairs)
        stored.append(new_sites, sites)
    stored.replace(patterns, kept)


def first_tags(spark: SparkSession, database: str, rules: DataFrame) -> DataFrame:
    """(entity, tag_name, tag_color, tag_icon) of the first of ``rules`` (by name or by id) that matches a known site."""
    found = stored.current(spark, f"{database}.site_patterns").join(rules, "pattern")
    best = found.groupBy("entity").agg(F.min_by("info", "place").alias("tag"))
    return best.select("entity", *[F.col(f"tag.{c}").alias(c) for c in INFO])
