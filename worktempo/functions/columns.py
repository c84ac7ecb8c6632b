"""Column expressions: predicates, rounding, text and time formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from worktempo.functions.clock import DAY_US, HOUR_US

# Words that mark a heartbeat as AI-assisted.
AI_EDITORS = ["cursor", "windsurf", "trae"]
AI_USERAGENT_KEYWORDS = ["claudecode", "copilot", "codeium", "tabnine", "supermaven", "cody"]
AI_CATEGORY = "ai coding"
BROWSING_CATEGORY = "browsing"
SITE_TYPES = ["domain", "url"]


def _any_word(column: str, words: list[str]) -> str:
    return " OR ".join(f"contains(lower(coalesce({column}, '')), '{w}')" for w in words)


# Predicates are kept as SQL text: one call into the JVM each, however many terms they have.
_AI = (
    f"lower(coalesce(category, '')) = '{AI_CATEGORY}' OR {_any_word('editor', AI_EDITORS)} "
    f"OR {_any_word('user_agent', AI_USERAGENT_KEYWORDS)}"
)
_BROWSING = f"lower(coalesce(category, '')) = '{BROWSING_CATEGORY}'"
_SITE = f"type IN ({', '.join(repr(t) for t in SITE_TYPES)})"


def is_ai() -> Column:
    """Editor or user agent holds an AI keyword, or the category says so. NULLs count as false."""
    return F.expr(_AI)


def is_browsing() -> Column:
    """A NULL category counts as IDE time, not browsing."""
    return F.expr(_BROWSING)


def is_file() -> Column:
    return F.expr("coalesce(type = 'file', false)")


def is_site() -> Column:
    return F.expr(f"coalesce({_SITE}, false)")


def site_rows() -> Column:
    return F.expr(f"{_SITE} AND entity <> ''")


def file_rows() -> Column:
    return F.expr("type = 'file' AND entity <> ''")


def zero() -> Column:
    return F.lit(0).cast("bigint")


def or_zero(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, zero())


def floor_div(value: str, width: int) -> str:
    """SQL text of a floor division of a BIGINT, also right for instants before the epoch."""
    return f"(({value}) - pmod({value}, {width}L)) div {width}L"


def seconds(us: Column | str) -> Column:
    """Microseconds (never negative) to whole seconds, half up; NULL counts as zero."""
    return F.call_function("div", or_zero(us) + F.lit(500_000), F.lit(1_000_000))


def round_even(value: Column) -> Column:
    """Round half to even, as whole number."""
    return F.bround(value, 0).cast("bigint")


def ratio_pct(part: Column, whole: Column) -> Column:
    """round(part / max(whole, 1) * 100)."""
    return round_even(part / F.greatest(whole, F.lit(1).cast("bigint")) * F.lit(100))


def floored(value: Column) -> Column:
    return F.greatest(value, zero())


def local_text(us: Column | str, pattern: str, tz_hours: int) -> Column:
    """Local clock text of an instant in microseconds."""
    col = F.col(us) if isinstance(us, str) else us
    return F.date_format(F.timestamp_micros(col + F.lit(tz_hours * HOUR_US)), pattern)


def ntz_text(time: Column, pattern: str, tz_hours: int) -> Column:
    """Local clock text of a UTC timestamp_ntz."""
    return F.date_format(time + F.expr(f"INTERVAL '{tz_hours}' HOUR"), pattern)


def day_text(day: Column | str) -> Column:
    """ISO text of an integer day number."""
    return F.date_format(F.date_from_unix_date(F.col(day) if isinstance(day, str) else day), "yyyy-MM-dd")


def local_day_of(us: str, tz_hours: int) -> str:
    """SQL text of the local day number of an instant in microseconds."""
    return f"CAST({floor_div(f'{us} + {tz_hours * HOUR_US}L', DAY_US)} AS INT)"


def joined(values: Column | str) -> Column:
    """Sorted, comma-joined non-empty values of an array of distinct strings; NULL if none."""
    col = F.col(values) if isinstance(values, str) else values
    names = F.array_sort(F.filter(col, lambda v: v != ""))
    return F.nullif(F.array_join(names, ", "), F.lit(""))


def joined_all(values: Column | str) -> Column:
    """As ``joined`` but the empty string stays a value; NULL only if there is no value at all."""
    col = F.col(values) if isinstance(values, str) else values
    return F.when(F.size(col) > 0, F.array_join(F.array_sort(col), ", "))


def dashed(value: Column | str, present: Column) -> Column:
    """'-' only where the row has no counterpart; a NULL of an existing row stays NULL."""
    return F.when(present, F.col(value) if isinstance(value, str) else value).otherwise(F.lit("-"))


def duration_text(name: str) -> Column:
    """'2sa 5dk', '5dk', or '-' for nothing."""
    return F.expr(
        f"CASE WHEN coalesce({name}, 0) = 0 THEN '-' "
        f"WHEN {name} >= 3600 THEN format_string('%dsa %ddk', {name} div 3600, {name} % 3600 div 60) "
        f"ELSE format_string('%ddk', {name} % 3600 div 60) END"
    )
