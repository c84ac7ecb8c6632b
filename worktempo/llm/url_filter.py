"""URL filter: listed rules, then gradient-boosted trees on lexical features; DataFrame and SQL functions only.

A rule (host, path, verdict) fits its host and all subdomains if the URL's path starts with the rule's; the longest rule
wins. URLs with a rule are the labelled ones: on a bounded sample of them (`sample_rows`) gradient-boosted trees (Spark's
own) learn, both classes weighing the same, length, depth, digit ratio, entropy, parameter counts and the share of blocked URLs of the host's suffix; they
judge the URLs without a rule. The rules are a parameter, a handful to some hundreds: they become one CASE expression.

Defined results: NULL or no `://` means an empty host and path; the trees judge such a URL by its features; without both
kinds of labelled URLs the verdict of a URL without a rule is allow; repeated pages are judged each; further columns are
kept out; equal rules: the first listed.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktempo.llm.common import cut, sampled

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))

FEATURES = ["n_url", "n_host", "n_path", "depth", "labels", "hyphens", "digit_share", "entropy", "n_parameters", "n_query",
            "has_fragment", "suffix_blocked", "suffix_seen"]


def host_of(url: str) -> Column:
    host = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: str) -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "://[^/?#]*([^?#]*)", 1)


def ruled(rows: DataFrame, rules=RULES) -> DataFrame:
    """rows with host, path, rule and listed (the rule's verdict), the last two NULL where no rule fits."""
    rule = listed = None
    for host, path, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = (((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path))
        rule = F.when(fits, host + path) if rule is None else rule.when(fits, host + path)
        listed = F.when(fits, verdict) if listed is None else listed.when(fits, verdict)
    return rows.withColumn("rule", rule).withColumn("listed", listed)


def lexical(rows: DataFrame) -> DataFrame:
    """rows (url, host, path) with features of the URL's text and the host's suffix (its last two labels)."""
    entropy = """if(length(u) = 0, 0D, aggregate(array_distinct(split(u, '')), 0D, (total, c) -> total -
        (length(u) - length(replace(u, c, ''))) / length(u) * log2((length(u) - length(replace(u, c, ''))) / length(u))))"""
    found = rows.withColumn("u", F.coalesce("url", F.lit(""))).withColumn("query", F.regexp_extract("u", r"\?([^#]*)", 1))
    return found.select(
        *rows.columns,
        F.length("u").alias("n_url"), F.length("host").alias("n_host"), F.length("path").alias("n_path"),
        F.regexp_count("path", F.lit("/")).alias("depth"), F.regexp_count("host", F.lit(r"\.")).alias("labels"),
        F.regexp_count("host", F.lit("-")).alias("hyphens"),
        (F.regexp_count("u", F.lit("[0-9]")) / F.greatest(F.length("u"), F.lit(1))).alias("digit_share"),
        F.expr(entropy).alias("entropy"),
        F.regexp_count("query", F.lit("[^&]+")).alias("n_parameters"), F.length("query").alias("n_query"),
        F.contains("u", F.lit("#")).cast("int").alias("has_fragment"),
        F.substring_index("host", ".", -2).alias("suffix"))


def suffix_statistics(labelled: DataFrame, prior: float) -> DataFrame:
    """Per suffix: share of blocked URLs, drawn to the prior where there are few, and how many there are."""
    grouped = labelled.groupBy("suffix").agg(
        F.sum(F.col("label") * F.col("weight")).alias("blocked"), F.sum("weight").alias("all"), F.count("*").alias("n"))
    return grouped.select("suffix", ((F.col("blocked") + 5 * prior) / (F.col("all") + 5)).alias("suffix_blocked"),
                          F.log1p("n").alias("suffix_seen"))


def with_suffix(rows: DataFrame, statistics: DataFrame, prior: float) -> DataFrame:
    return (rows.join(statistics, "suffix", "left").withColumn("suffix_blocked", F.coalesce("suffix_blocked", F.lit(prior)))
            .withColumn("suffix_seen", F.coalesce("suffix_seen", F.lit(0.0))))


def verdicts(pages: DataFrame, rules=RULES, sample_rows: int = 20_000, trees: int = 12, depth: int = 3) -> DataFrame:
    """page_id, host, path, rule, verdict and score (of the trees, for every URL) of every page."""
    rows = ruled(pages.select("page_id", "url").withColumn("host", host_of("url")).withColumn("path", path_of("url")), rules)
    labelled = lexical(rows).where(F.col("listed").isNotNull()).withColumn("label", (F.col("listed") == "block").cast("int"))
    counts = labelled.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("blocked")).first()
    result = ["page_id", "host", "path", "rule"]
    if counts.blocked in (0, counts.n):
        return rows.select(*result, F.coalesce("listed", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("score"))
    prior = 0.5  # classes are weighed evenly
    weight = F.when(F.col("label") == 1, counts.n / counts.blocked).otherwise(counts.n / (counts.n - counts.blocked))
    labelled = labelled.withColumn("weight", weight / 2)
    statistics = cut(suffix_statistics(labelled, prior))
    sample = with_suffix(labelled.where(sampled(F.col("page_id"), counts.n, sample_rows)), statistics, prior)
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features")
    training = cut(vectors.transform(sample.select("label", "weight", *FEATURES)).select("label", "weight", "features").coalesce(4))
    if training.select("label").distinct().count() < 2:
        return rows.select(*result, F.coalesce("listed", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("score"))
    model = GBTClassifier(labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=11).fit(training)
    scored = model.transform(vectors.transform(with_suffix(lexical(rows), statistics, prior)))
    score = vector_to_array("probability")[1]
    judged = F.when(score >= 0.5, "block").otherwise("allow")
    return scored.select(*result, F.coalesce("listed", judged).alias("verdict"), score.alias("score"))
