"""Quality rules with adaptive thresholds, in DataFrame and SQL functions only.

Each document gets base figures (words, symbols, repeated lines and word windows) and four whole-number rates made of them.
Per language and source every rate has a quantile sketch: counts by log-linear buckets (16 to the octave, so a quantile is
off by 1/16 of its value at most). Sketches merge by adding counts: a group of fewer than `least_rows` documents takes the
sketch of its language, and that of all documents where the language is small too. A rate is out of range above
Q3 + 3 (Q3 - Q1) + slack, and the mean word length also below Q1 - 3 (Q3 - Q1) - slack. A document is kept if it passes the
fixed base rules and no rate is out of range. Counts are sums, so a hot group is combined before it is shuffled.

Defined results: a NULL or empty text has no words and fails the base; NULL language or source is a group like any other;
repeated rows are judged each; further columns are kept; an empty table gives no rows.
Word windows are compared by a 64-bit hash inside one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worktempo.llm.common import boxed, cut

LEAST_WORDS, MOST_REPEATED = 10, 20

#: Rates by the base figures, each with its slack.
RATES = {
    "symbol_rate": ("1000 * n_symbols div greatest(n_words, 1)", 200),
    "dup_rate": ("1000 * n_dup_lines div greatest(n_lines, 1)", 400),
    "repeat_rate": ("1000 * n_repeat_words div greatest(n_words, 1)", 200),
    "word_length": ("100 * word_chars div greatest(n_words, 1)", 200),
}

WHITE = "' \\t\\n\\u000b\\u000c\\r'"
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def let(value: str, name: str, body: str) -> str:
    """body with name bound to value, evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def figures() -> Column:
    """Struct of base figures of the column text."""
    text = "coalesce(text, '')"
    words = f"filter(split(translate({text}, {WHITE}, '      '), ' '), w -> w != '')"
    lines = f"filter(split({text}, '\\n'), x -> translate(x, {WHITE}, '') != '')"
    hashes = "transform(sequence(0, size(words) - 5), i -> xxhash64(" + ", ".join(
        f"words[i + {k}]" for k in range(5)) + "))"
    twins = ("transform(filter(sorted, (s, i) -> s.h = get(sorted, i - 1).h or s.h = get(sorted, i + 1).h), s -> s.i)")
    covered = ("aggregate(transform(at, (p, k) -> least(5, coalesce(get(at, k + 1), p + 5) - p)), 0L, "
               "(total, x) -> total + x)")
    repeated = let("array_sort(transform(hashes, (h, i) -> struct(h as h, i as i)))", "sorted",
                   let(f"sort_array({twins})", "at", covered))
    windows = "if(size(words) < 5, 0L, " + let(
        hashes, "hashes", f"if(size(array_distinct(hashes)) = size(hashes), 0L, {repeated})") + ")"
    return F.expr(let(words, "words", let(lines, "lines", f"""struct(
        cast(size(words) as bigint) as n_words,
        cast(length(translate({text}, {WHITE}, '')) as bigint) as word_chars,
        cast(length({text}) - length(translate({text}, '#*$%&|<>', '')) as bigint) as n_symbols,
        cast(size(lines) - size(array_distinct(lines)) as bigint) as n_dup_lines,
        {windows} as n_repeat_words,
        cast(size(lines) as bigint) as n_lines)""")))


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """The named columns with base figures and rates."""
    found = docs.select(*keep, figures().alias("figures")).select(*keep, *(f"figures.{f}" for f in FIGURES))
    return found.select("*", *(F.expr(e).alias(name) for name, (e, _) in RATES.items()))


def bucket(value: str) -> str:
    """Log-linear bucket of a whole number: itself below 32, then 16 to the octave."""
    shift = f"(length(bin({value})) - 5)"
    return f"cast(if({value} < 32, {value}, 16 * {shift} + shiftright({value}, {shift})) as int)"


def bucket_top(b: str) -> str:
    """Largest number of a bucket."""
    shift = f"({b} div 16 - 1)"
    return f"if({b} < 32, cast({b} as bigint), shiftleft(cast({b} - 16 * {shift} + 1 as bigint), cast({shift} as int)) - 1)"


def sketches(rates: DataFrame) -> DataFrame:
    """One row per language, source, rate and bucket with its count: the mergeable sketch."""
    each = F.array(*(F.struct(F.lit(name).alias("rate"), F.col(name).alias("value")) for name in RATES))
    return (rates.select("lang", "source", F.explode(each).alias("m"))
            .select("lang", "source", "m.rate", F.expr(bucket("m.value")).alias("bucket"))
            .groupBy("lang", "source", "rate", "bucket").agg(F.count("*").alias("n")))


def bounds(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: documents, and lower and upper bound of each rate."""
    merged = sketch.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))
    by = Window.partitionBy(*keys, "rate")
    ranked = merged.select("*", F.sum("n").over(by.orderBy("bucket")).alias("upto"), F.sum("n").over(by).alias("total"))
    quartiles = ranked.groupBy(*keys, "rate").agg(
        F.max("total").alias("n_docs"),
        F.min(F.when(4 * F.col("upto") >= F.col("total"), F.col("bucket"))).alias("b1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("total"), F.col("bucket"))).alias("b3"),
    ).select(*keys, "rate", "n_docs", F.expr(bucket_top("b1")).alias("q1"), F.expr(bucket_top("b3")).alias("q3"))
    slack = F.create_map(*(F.lit(x) for name, (_, s) in RATES.items() for x in (name, s)))[F.col("rate")]
    ranged = quartiles.select(
        *keys, "rate", "n_docs",
        (F.col("q1") - 3 * (F.col("q3") - F.col("q1")) - slack).alias("low"),
        (F.col("q3") + 3 * (F.col("q3") - F.col("q1")) + slack).alias("high"))
    picked = [F.max(F.when(F.col("rate") == name, F.col(end))).alias(f"{name}_{end}")
              for name in RATES for end in ("low", "high")]
    return ranged.groupBy(*keys).agg(F.max("n_docs").alias("n_docs"), *picked)


def thresholds(rates: DataFrame, least_rows: int) -> DataFrame:
    """Bounds of every (lang, source) that occurs, from the narrowest sketch that is large enough."""
    sketch = cut(sketches(rates))
    ends = [f"{name}_{end}" for name in RATES for end in ("low", "high")]
    own = bounds(sketch, ["lang", "source"])
    language = bounds(sketch, ["lang"]).select(
        F.col("lang").alias("l_lang"), F.col("n_docs").alias("l_docs"), *(F.col(e).alias(f"l_{e}") for e in ends))
    everything = bounds(sketch.withColumn("all", F.lit(1)), ["all"]).first()  # one row, none for an empty table
    joined = own.join(language, F.col("lang").eqNullSafe(F.col("l_lang")))
    chosen = [F.when(F.col("n_docs") >= least_rows, F.col(e)).when(F.col("l_docs") >= least_rows, F.col(f"l_{e}"))
              .otherwise(F.lit(everything[e] if everything else None).cast("bigint")).alias(e) for e in ends]
    return cut(joined.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), *chosen))


def base_failed() -> Column:
    return F.expr(f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words")


def judge(rates: DataFrame, limits: DataFrame) -> DataFrame:
    """rates with base_failed and kept. ``kept`` is no plain conjunction, so that Spark does not move a part of it below the
    join as a filter of its own, which would compute the figures of every text a second time."""
    inside = F.lit(True)
    for name in RATES:
        inside = inside & (F.col(name) <= F.col(f"{name}_high"))
    inside = inside & (F.col("word_length") >= F.col("word_length_low"))
    same = F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source"))
    return (rates.join(limits, same, "left").withColumn("base_failed", base_failed())
            .withColumn("kept", F.array_min(F.array(~F.col("base_failed"), F.coalesce(inside, F.lit(True)))))
            .select(*rates.columns, "base_failed", "kept"))


def verdicts(docs: DataFrame, least_rows: int = 50) -> DataFrame:
    """doc_id, lang, source, base figures, rates, base_failed and kept of every row."""
    rates = cut(measured(docs, "doc_id", "lang", "source"))
    return judge(rates, thresholds(rates, least_rows))


def keep(docs: DataFrame, least_rows: int = 50) -> DataFrame:
    """Rows of docs that pass. Figures are computed twice (for the sketches, then beside the text) rather than stored."""
    limits = thresholds(measured(docs, "lang", "source"), least_rows)
    rows = measured(boxed(docs, "lang", "source", "text"), "row", "lang", "source")
    return judge(rows, limits).where("kept").select("row.*")
