"""Report rows as they are printed: texts per user, and the summary boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktempo.functions.columns import duration_text

# Length limits of the project and language columns by layout, and the box labels in order.
PROJECT_CHARS = {"daily": 34, "range": 32, "weekly": 34}
LANGUAGE_CHARS = 30
BOXES = {
    "Aktif Kullanici": "total_users",
    "IDE Sure": "total_coding_seconds",
    "Tarayici Sure": "total_browsing_seconds",
    "AI Sure": "total_ai_seconds",
    "Takim Verimlilik": "team_productivity",
}


def _clipped(name: str, chars: int) -> Column:
    text = F.nullif(F.coalesce(F.col(name), F.lit("-")), F.lit(""))
    return F.substring(F.coalesce(text, F.lit("-")), 1, chars).alias(name)


def report_rows(users: DataFrame, layout: str, days: int = 7) -> DataFrame:
    """One printed row per user of a daily, range or weekly report."""
    if layout not in PROJECT_CHARS:
        raise ValueError(f"unknown layout {layout}")
    percent = F.concat(F.lit("%"), F.col("productivity").cast("string")).alias("productivity_text")
    hours = F.concat("first_active", F.lit(" - "), "last_active").alias("hours")
    active = F.concat(F.col("active_days").cast("string"), F.lit(f"/{days}")).alias("active_days_text")
    return users.select(
        "user_id",
        *([] if layout == "daily" else [active]),
        duration_text("ide_coding_seconds").alias("ide_time"),
        duration_text("browsing_seconds").alias("browsing_time"),
        duration_text("ai_coding_seconds").alias("ai_time"),
        percent,
        *([hours] if layout == "daily" else []),
        _clipped("projects", PROJECT_CHARS[layout]),
        _clipped("languages", LANGUAGE_CHARS),
    )


def report_boxes(team: DataFrame) -> DataFrame:
    """The team row as (position, label, value) rows."""

    def text(name: str) -> Column:
        if name == "total_users":
            return F.col(name).cast("string")
        if name == "team_productivity":
            return F.concat(F.lit("%"), F.col(name).cast("string"))
        return duration_text(name)

    items = [
        F.struct(F.lit(n).alias("position"), F.lit(label).alias("label"), text(name).alias("value"))
        for n, (label, name) in enumerate(BOXES.items(), start=1)
    ]
    return team.select(F.inline(F.array(*items)))


def write_report(rows: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write report rows as csv (with header), json or parquet."""
    rows.write.mode("overwrite").options(**({"header": "true"} if fmt == "csv" else {})).format(fmt).save(path)
