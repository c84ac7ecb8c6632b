"""Site tags: a pattern tags an entity if it is a case-insensitive substring of it.

Matching all entities against all patterns would be a nested loop over both tables. Instead each pattern is looked for by
one anchor: of its three-letter pieces (all of it, if it is shorter) one that the fewest other patterns hold and that is no
part of what most addresses have. So patterns of one form ("app1.example", "app2.example") hang on what tells them apart.
Each distinct entity is cut into its three-letter pieces once, pieces are joined to the anchors, and ``contains`` decides;
an entity makes as many pieces as it has letters, whatever the patterns. Which piece is the anchor changes no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worktempo.operators.joins import salted_lookup
from worktempo.sources.schemas import DEFAULT_TAG_ICON, UNTAGGED, UNTAGGED_COLOR

INFO = ["tag_name", "tag_color", "tag_icon"]


def rules_by_name(tags: DataFrame) -> DataFrame:
    """Rules in tag_name order (site views). A pattern given twice keeps its first place but the last tag."""
    place = F.struct("tag_name", "id")
    return tags.groupBy(F.lower("domain_pattern").alias("pattern")).agg(
        F.min(place).alias("place"), F.max_by(F.struct(*INFO), place).alias("info")
    )


def rules_by_id(tags: DataFrame) -> DataFrame:
    """Rules in insertion order (daily report); the first of equal patterns wins."""
    place = F.struct("id")
    return tags.groupBy(F.lower("domain_pattern").alias("pattern")).agg(
        F.min(place).alias("place"), F.min_by(F.struct(*INFO), place).alias("info")
    )


GRAM = 3
#: What most addresses have; fixed values.
ADDRESS = ["https://www.", "http://", "://m.", ".com", ".org", ".net", ".html"]
COMMON = sorted({text[k:k + GRAM] for text in ADDRESS for k in range(len(text) - GRAM + 1)})


def _pieces(name: Column, length: Column) -> Column:
    """Distinct substrings of ``name`` with a length; none if it is shorter."""
    size = F.length(name)
    starts = F.sequence(F.lit(1), F.greatest(size - length + 1, F.lit(1)))
    found = F.transform(starts, lambda at: F.substring(name, at, length))
    return F.when(size >= length, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def anchored(rules: DataFrame) -> DataFrame:
    """The rules with ``piece``, the anchor of each pattern."""
    own = F.least(F.length("pattern"), F.lit(GRAM))
    held = rules.withColumn("piece", F.explode(_pieces(F.col("pattern"), own)))
    held = held.withColumn("_held", F.count("*").over(Window.partitionBy("piece")))
    place = F.struct(F.col("piece").isin(COMMON), "_held", "piece")
    kept = [c for c in rules.columns if c != "pattern"]
    return held.groupBy("pattern").agg(F.min_by("piece", place).alias("piece"), *[F.first(c).alias(c) for c in kept])


def entity_pieces(entities: DataFrame, rules: DataFrame) -> DataFrame:
    """(entity, piece) of distinct entities: pieces of three letters, and shorter ones where a pattern is that short."""
    lengths = rules.agg(F.collect_set(F.least(F.length("pattern"), F.lit(GRAM)))).scalar()  # at most GRAM + 1 numbers
    name = F.lower("entity")
    # An empty pattern is in every entity.
    each = F.transform("_lengths", lambda n: F.when(n > 0, _pieces(name, F.greatest(n, F.lit(1)))).otherwise(F.array(F.lit(""))))
    distinct = entities.select("entity").distinct().withColumn("_lengths", lengths)
    return distinct.select("entity", F.explode(F.flatten(each)).alias("piece"))


def _matched(entities: DataFrame, rules: DataFrame) -> DataFrame:
    candidates = entity_pieces(entities, rules).join(anchored(rules), "piece")
    return candidates.where(F.contains(F.lower("entity"), F.col("pattern"))).drop("piece")


def pattern_matches(entities: DataFrame, rules: DataFrame) -> DataFrame:
    """(entity, pattern) for every pattern of ``rules.pattern`` that a distinct entity holds."""
    return _matched(entities, rules.select("pattern"))


def matches(entities: DataFrame, rules: DataFrame) -> DataFrame:
    """(entity, place, info) for every rule that matches a distinct entity."""
    return _matched(entities, rules).drop("pattern")


def first_match(entities: DataFrame, rules: DataFrame) -> DataFrame:
    """(entity, tag_name, tag_color, tag_icon) of the first matching rule; unmatched entities are absent."""
    best = matches(entities, rules).groupBy("entity").agg(F.min_by("info", "place").alias("tag"))
    return best.select("entity", *[F.col(f"tag.{c}").alias(c) for c in INFO])


def with_tag(rows: DataFrame, entities: DataFrame, rules: DataFrame, spread: list[str]) -> DataFrame:
    """Add the first matching tag's name, colour and icon to each row; NULL where none matches.

    ``entities`` is any table whose ``entity`` column holds those of ``rows``; raw heartbeats rather than the
    aggregated rows, so that the aggregation is not run a second time. A popular site may own a large share of the
    rows, so the tags are looked up salted.
    """
    return salted_lookup(rows, first_match(entities, rules), ["entity"], spread)


def untagged(entities: DataFrame, tags: DataFrame) -> DataFrame:
    """Distinct entities no pattern matches."""
    distinct = entities.select("entity").distinct()
    hit = matches(distinct, rules_by_id(tags)).select("entity").distinct()
    return distinct.join(hit, "entity", "left_anti")


def tagged_with(
    rows: DataFrame, entities: DataFrame, tags: DataFrame, names: list[str], spread: list[str]
) -> DataFrame:
    """Rows whose entity matches a pattern of one of the named tags, whatever other tags match too."""
    rules = rules_by_id(tags.where(F.col("tag_name").isin(names)))
    hit = matches(entities, rules).select("entity").distinct()
    return salted_lookup(rows, hit, ["entity"], spread, how="inner")


def tag_labels() -> list[Column]:
    """Name, colour and icon with the defaults of untagged sites."""
    return [
        F.coalesce("tag_name", F.lit(UNTAGGED)).alias("tag_name"),
        F.when(F.col("tag_name").isNull(), F.lit(UNTAGGED_COLOR)).otherwise(F.col("tag_color")).alias("tag_color"),
        F.when(F.col("tag_name").isNull(), F.lit(DEFAULT_TAG_ICON)).otherwise(F.col("tag_icon")).alias("tag_icon"),
    ]
