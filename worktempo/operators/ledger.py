"""Ledgers kept beside the heartbeats: manual time adjustments, leaves and site tags.

Requests come as a table and are checked together: ``check_*`` gives each request with its ``error`` or, if it has none, the
new ``row``; one pass, so that a job can store the outcome and take both sides from it. ``ingest_*`` returns the two sides.
A new row's id is max(existing id) + request_id: unique and repeatable without numbering rows in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktempo.functions.clock import Clock
from worktempo.operators.scan import instant
from worktempo.sources.schemas import (
    ADJUSTMENT_REQUESTS,
    DEFAULT_TAG_COLOR,
    DEFAULT_TAG_ICON,
    LEAVE_TYPES,
    LEAVE_REQUESTS,
    TAG_REQUESTS,
)


def backfill_dates(adjustments: DataFrame, tz_hours: int = 3) -> DataFrame:
    """Give rows without adjustment_date the local date they were created on."""
    created = F.to_date(F.col("created_at") + F.expr(f"INTERVAL '{tz_hours}' HOUR"))
    return adjustments.withColumn("adjustment_date", F.coalesce("adjustment_date", created))


def adjustments_between(
    adjustments: DataFrame, start: date | None = None, end: date | None = None
) -> DataFrame:
    """Rows with adjustment_date in [start, end]."""
    out = adjustments
    if start is not None:
        out = out.where(F.col("adjustment_date") >= F.lit(start))
    if end is not None:
        out = out.where(F.col("adjustment_date") <= F.lit(end))
    return out


def adjusted_by(adjustments: DataFrame, *keys: str) -> DataFrame:
    """Summed seconds per user_id and / or adjustment_date, as ``adj``."""
    total = F.coalesce(F.sum(F.col("seconds").cast("bigint")), F.lit(0).cast("bigint"))
    return adjustments.groupBy(*keys).agg(total.alias("adj"))


def adjusted_by_user_day(adjustments: DataFrame) -> DataFrame:
    """(user_id, local_day, adj) with the integer day number used by the activity tables."""
    days = adjustments.withColumn("local_day", F.unix_date("adjustment_date"))
    return adjusted_by(days, "user_id", "local_day")


def leave_days(leaves: DataFrame, start: date, end: date) -> DataFrame:
    """One row per user and day of leave inside [start, end]; overlapping leaves count once."""
    lo, hi = F.lit(start), F.lit(end)
    hits = leaves.where((F.col("start_date") <= hi) & (F.col("end_date") >= lo)
                        & (F.col("start_date") <= F.col("end_date")))
    days = F.sequence(F.greatest("start_date", lo), F.least("end_date", hi), F.expr("INTERVAL '1' DAY"))
    return hits.select("user_id", F.explode(days).alias("leave_date")).distinct()


def users_on_leave(leaves: DataFrame, day: date) -> DataFrame:
    hit = (F.col("start_date") <= F.lit(day)) & (F.col("end_date") >= F.lit(day))
    return leaves.where(hit).select("user_id").distinct()


# White space that is stripped from request texts.
WHITE_SPACE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
                                0x202F, 0x205F, 0x3000]))
NUMBER = r"^[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"


def _trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def _stripped(name: str) -> Column:
    """Trimmed text, '' for NULL."""
    return _trimmed(F.coalesce(F.col(name), F.lit("")))


def _number(name: str) -> Column:
    """A missing value is 0; NULL where the text is no finite decimal number."""
    text = _trimmed(F.col(name))
    given = F.when(text.rlike(NUMBER), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))
    value = F.when(F.col(name).isNull(), F.lit(0.0)).otherwise(given)
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def _iso_date(text: Column) -> Column:
    """Date of 'yyyy-m-d' text, NULL where it is none."""
    return F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), text.try_cast("date"))


def _first_reason(*checks: tuple[Column, str]) -> Column:
    """Reason of the first failed check, NULL if all pass."""
    return F.coalesce(*[F.when(F.coalesce(failed, F.lit(True)), F.lit(reason)) for failed, reason in checks])


def _known(requests: DataFrame, users: DataFrame) -> DataFrame:
    ids = users.select(F.col("id").alias("user_id"), F.lit(True).alias("_known")).distinct()
    return requests.join(ids, "user_id", "left").withColumn("_known", F.col("_known").isNotNull())


def _with_base_id(df: DataFrame, existing: DataFrame) -> DataFrame:
    """Add ``_base``, the largest id in use, as a scalar subquery."""
    base = existing.agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint")).scalar()
    return df.withColumn("_base", base)


def _checked(found: DataFrame, error: Column, row: Sequence[Column], requests_schema) -> DataFrame:
    """The requests with ``error`` and ``row``."""
    told = found.withColumn("error", error)
    return told.select(*requests_schema.fieldNames(), "error", F.when(F.col("error").isNull(), F.struct(*row)).alias("row"))


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("error").isNull()).select("row.*")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("error").isNotNull()).drop("row")


def check_adjustments(
    requests: DataFrame, users: DataFrame, existing: DataFrame, *, as_of: datetime, tz_hours: int = 3
) -> DataFrame:
    today = Clock.at(as_of, tz_hours).local_date
    op = F.lower(F.when(F.coalesce(F.col("op"), F.lit("")) == "", F.lit("add")).otherwise(F.col("op")))
    text = _stripped("adjustment_date")
    read = (
        _known(requests, users)
        .withColumn("_size", F.bround(_number("hours") * 3600 + _number("minutes") * 60, 0))
        .withColumn("_op", op)
        .withColumn("_date", F.when(text == "", F.lit(today)).otherwise(_iso_date(text)))
    )
    error = _first_reason(
        (F.col("_size").isNull(), "invalid number"),
        (~F.col("_op").isin("add", "sub"), "invalid op"),
        (F.col("_size") <= 0, "not above zero"),
        (F.col("_date").isNull(), "invalid date"),
        (~F.col("_known"), "unknown user"),
    )
    sign = F.when(F.col("_op") == "add", F.lit(1)).otherwise(F.lit(-1))
    return _checked(
        _with_base_id(read, existing), error,
        [
            (F.col("_base") + F.col("request_id")).alias("id"),
            F.col("user_id"),
            (sign * F.col("_size")).cast("bigint").alias("seconds"),
            F.col("_date").alias("adjustment_date"),
            F.nullif(_stripped("reason"), F.lit("")).alias("reason"),
            instant(as_of).alias("created_at"),
        ],
        ADJUSTMENT_REQUESTS,
    )


def ingest_adjustments(
    requests: DataFrame, users: DataFrame, existing: DataFrame, *, as_of: datetime, tz_hours: int = 3
) -> tuple[DataFrame, DataFrame]:
    checked = check_adjustments(requests, users, existing, as_of=as_of, tz_hours=tz_hours)
    return accepted(checked), rejected(checked)


def check_leaves(requests: DataFrame, users: DataFrame, existing: DataFrame, *, as_of: datetime) -> DataFrame:
    start = _stripped("start_date")
    end = F.when(F.coalesce(F.col("end_date"), F.lit("")) == "", start).otherwise(_stripped("end_date"))
    kind = F.when(F.coalesce(F.col("leave_type"), F.lit("")) == "", F.lit("annual")).otherwise(
        _stripped("leave_type")
    )
    read = (
        _known(requests, users)
        .withColumn("_kind", kind)
        .withColumn("_blank", start == "")
        .withColumn("_start", _iso_date(start))
        .withColumn("_end", _iso_date(end))
    )
    error = _first_reason(
        (F.col("_blank"), "start_date missing"),
        (~F.col("_kind").isin(*LEAVE_TYPES), "invalid leave type"),
        (F.col("_start").isNull() | F.col("_end").isNull(), "invalid date"),
        (F.col("_end") < F.col("_start"), "end before start"),
        (~F.col("_known"), "unknown user"),
    )
    return _checked(
        _with_base_id(read, existing), error,
        [
            (F.col("_base") + F.col("request_id")).alias("id"),
            F.col("user_id"),
            F.col("_start").alias("start_date"),
            F.col("_end").alias("end_date"),
            F.col("_kind").alias("leave_type"),
            F.nullif(_stripped("reason"), F.lit("")).alias("reason"),
            instant(as_of).alias("created_at"),
        ],
        LEAVE_REQUESTS,
    )


def ingest_leaves(
    requests: DataFrame, users: DataFrame, existing: DataFrame, *, as_of: datetime
) -> tuple[DataFrame, DataFrame]:
    checked = check_leaves(requests, users, existing, as_of=as_of)
    return accepted(checked), rejected(checked)


def delete_ids(ledger: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is not in ``ids.id``."""
    return ledger.join(ids.select("id").distinct(), "id", "left_anti")


def delete_approved(ledger: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows that no approved request names."""
    return delete_ids(ledger, requests.where(F.col("decision") == "approved"))


def apply_tag_requests(
    requests: DataFrame, tags: DataFrame, *, as_of: datetime
) -> tuple[DataFrame, DataFrame]:
    """New tag table and rejected requests.

    A request without id creates a row (colour and icon have defaults); one with id replaces the four fields of
    that row, blanks included. Of several requests for one id the last one (largest request_id) stands.
    """
    checked = (
        requests.withColumn("_name", _stripped("tag_name"))
        .withColumn("_pattern", _stripped("domain_pattern"))
        .withColumn("_reason", F.when((F.col("_name") == "") | (F.col("_pattern") == ""),
                                      F.lit("tag_name and domain_pattern required")))
    )
    good = checked.where(F.col("_reason").isNull())

    def default(name: str, value: str) -> Column:
        given = F.coalesce(F.col(name), F.lit(""))
        return _trimmed(F.when(given == "", F.lit(value)).otherwise(given))

    created = _with_base_id(good.where(F.col("id").isNull()), tags).select(
        (F.col("_base") + F.col("request_id")).alias("id"),
        F.col("_name").alias("tag_name"),
        default("tag_color", DEFAULT_TAG_COLOR).alias("tag_color"),
        default("tag_icon", DEFAULT_TAG_ICON).alias("tag_icon"),
        F.col("_pattern").alias("domain_pattern"),
        instant(as_of).alias("created_at"),
    )
    last = good.where(F.col("id").isNotNull()).groupBy("id").agg(
        F.max_by(
            F.struct("_name", _stripped("tag_color").alias("_color"), _stripped("tag_icon").alias("_icon"), "_pattern"),
            "request_id",
        ).alias("new")
    )
    fields = {"tag_name": "_name", "tag_color": "_color", "tag_icon": "_icon", "domain_pattern": "_pattern"}
    updated = tags.join(last, "id", "left").select(
        F.col("id").cast("bigint").alias("id"),
        *[F.coalesce(F.col(f"new.{new}"), F.col(old)).alias(old) for old, new in fields.items()],
        "created_at",
    )
    bad = checked.where(F.col("_reason").isNotNull()).select(*TAG_REQUESTS.fieldNames(), F.col("_reason").alias("error"))
    return updated.unionByName(created), bad
