"""Bounded nested results, kept sketches and the kept dictionary of site tags."""

from __future__ import annotations

import random
from datetime import date

import pytest
from helpers import rows
from pyspark.sql import functions as F

from worktempo.jobs import site_tags
from worktempo.operators import sketches
from worktempo.operators.nested import nested
from worktempo.operators.tags import first_match, rules_by_id, rules_by_name
from worktempo.sources import stored


@pytest.fixture
def database(spark, tmp_path):
    name = stored.new_database(spark, str(tmp_path / "db"))
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


def test_arrays_are_bounded_and_the_rest_is_counted(spark):
    df = spark.createDataFrame([("a", n % 7, n) for n in range(20)] + [(None, 1, 1), ("b", 2, 2), ("b", 2, 2)], "k string, v int, n int")
    found = {r["k"]: r for r in rows(nested(df, ["k"], ["v", "n"], 3, "top", F.desc("v"), F.col("n")))}
    assert [(i["v"], i["n"]) for i in found["a"]["top"]] == [(6, 6), (6, 13), (5, 5)] and found["a"]["more_top"] == 17
    assert len(found[None]["top"]) == 1 and found[None]["more_top"] == 0
    assert [i["n"] for i in found["b"]["top"]] == [2, 2]
    assert nested(df.where("false"), ["k"], ["v"], 3, "top", F.col("v")).count() == 0


def test_a_hot_key_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("concat('k', id div 900) AS k", "id AS v")
    plan = nested(df, ["k"], ["v"], 3, "top", F.desc("v"))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("lg_k", [8, 12])
def test_sketches_of_days_merge_within_the_error(hb, lg_k):
    rng = random.Random(lg_k)
    made = [{"id": n, "at": f"{rng.randrange(2, 9):02d} 06:00:00", "user_id": rng.choice(["a", "b"]),
             "entity": f"/f{rng.randrange(4000)}", "language": rng.choice(["Go", None])} for n in range(6000)]
    data = hb(*made)
    kept = sketches.daily_sketches(data, ["entity", "language"], lg_k=lg_k)
    days = data.withColumn("day", F.to_date("time")).where(F.col("day").between(F.lit(date(2024, 1, 3)), F.lit(date(2024, 1, 6))))
    exact = {r["user_id"]: r for r in rows(days.groupBy("user_id").agg(
        F.count_distinct("entity").alias("entity"), F.count_distinct("language").alias("language")))}
    for r in rows(sketches.estimates(kept, ["entity", "language"], date(2024, 1, 3), date(2024, 1, 6))):
        true = exact[r["user_id"]]
        assert abs(r["entity_estimate"] - true["entity"]) <= 4 * sketches.standard_error(lg_k) * true["entity"]
        assert r["language_estimate"] == true["language"] == 1
    assert sketches.estimates(kept.where("false"), ["entity"]).count() == 0


def pairs(df):
    return {(r["entity"], r["tag_name"], r["tag_color"]) for r in rows(df)}


def test_the_dictionary_equals_the_full_match_after_each_change(spark, tags, database, monkeypatch):
    def sites(*names):
        return spark.createDataFrame([(n,) for n in names], "entity string")

    asked = []
    real = site_tags.pattern_matches

    def counted(entities, rules):
        asked.append((entities.count(), rules.count()))
        return real(entities, rules)

    monkeypatch.setattr(site_tags, "pattern_matches", counted)
    site_tags.create(spark, database)
    seen = ["https://www.netflix.com", "https://x.com", None, "", "https://GitHub.com"]
    rules = tags((1, "B", "x.com"), (2, "A", "github.com"), (3, "C", "%"))
    steps = [
        (seen, rules),
        (seen, rules),
        ([*seen, "https://docs.example", "https://x.com/a"], rules),
        (seen, tags((1, "B", "x.com"), (2, "A", "github.com"), (4, "D", "flix"), (5, "E", "docs"))),
        (["https://new.docs"], tags((9, "Z", "X.com"), (5, "E", "docs"), (6, "0", "docs"))),
    ]
    everything = []
    for names, now in steps:
        everything += [n for n in names if n not in everything]
        site_tags.update(spark, database, sites(*names), now)
        for order in (rules_by_name, rules_by_id):
            known = sites(*[n for n in everything if n is not None])
            assert pairs(site_tags.first_tags(spark, database, order(now))) == pairs(first_match(known, order(now)))
    # All sites by all patterns once; nothing; two new sites; two new patterns; one new site (the patterns were known).
    assert asked == [(0, 3), (4, 3), (2, 3), (6, 2), (1, 2)]


def test_a_repeated_update_counts_nothing_twice(spark, tags, database):
    site_tags.create(spark, database)
    sites, now = spark.createDataFrame([("https://x.com",)], "entity string"), tags((1, "B", "x.com"))
    site_tags.update(spark, database, sites, now)
    stored.append(stored.current(spark, f"{database}.site_patterns"), f"{database}.site_patterns")
    assert len(rows(site_tags.first_tags(spark, database, rules_by_id(now)))) == 1
