"""Explicit schemas of all tables, and the default site tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in cols.items()])


_S, _I, _L, _B, _D, _TS = (
    T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.DateType(), T.TimestampNTZType(),
)

HEARTBEATS = _struct(
    id=_L, user_id=_S, time=_TS, type=_S, entity=_S, category=_S, project=_S, language=_S, editor=_S,
    operating_system=_S, machine=_S, user_agent=_S,
)
USERS = _struct(
    id=_S, email=_S, created_at=_TS, public_leaderboard=_B, share_data_max_days=_I, share_projects=_B,
    share_languages=_B, share_editors=_B, share_oss=_B, share_machines=_B, share_labels=_B,
)
DOMAIN_TAGS = _struct(id=_L, tag_name=_S, tag_color=_S, tag_icon=_S, domain_pattern=_S, created_at=_TS)
TIME_ADJUSTMENTS = _struct(id=_L, user_id=_S, seconds=_I, adjustment_date=_D, reason=_S, created_at=_TS)
LEAVES = _struct(
    id=_L, user_id=_S, start_date=_D, end_date=_D, leave_type=_S, reason=_S, created_at=_TS
)
LEADERBOARD = _struct(user_id=_S, interval=_S, by=_S, total=_L, key=_S, created_at=_TS)
ADJUSTMENT_REQUESTS = _struct(
    request_id=_L, user_id=_S, hours=_S, minutes=_S, op=_S, reason=_S, adjustment_date=_S
)
LEAVE_REQUESTS = _struct(request_id=_L, user_id=_S, start_date=_S, end_date=_S, leave_type=_S, reason=_S)
TAG_REQUESTS = _struct(
    request_id=_L, id=_L, tag_name=_S, tag_color=_S, tag_icon=_S, domain_pattern=_S
)
DELETE_REQUESTS = _struct(id=_L, line=_L, decision=_S)

# Leave types and their labels.
LEAVE_TYPES = {"annual": "Yıllık İzin", "sick": "Hastalık", "holiday": "Resmî Tatil", "other": "Diğer"}

# Tags given to an empty tag table, one group per tag, patterns in order.
DEFAULT_TAG_COLOR = "#94a3b8"
DEFAULT_TAG_ICON = "🏷️"
UNTAGGED = "Etiketlenmemiş"
UNTAGGED_COLOR = "#475569"
SEED_TAGS = {
    ("İş", "#4ade80", "💼"): [
        "domain.com", "github.com", "gitlab.com", "stackoverflow.com", "localhost", "127.0.0.1", "172.",
        "192.168.", "10.",
    ],
    ("Eğlence", "#f87171", "🎮"): [
        "youtube.com", "netflix.com", "twitch.tv", "reddit.com", "haber7.com", "flo.com.tr",
    ],
    ("Sosyal Medya", "#a78bfa", "📱"): [
        "instagram.com", "twitter.com", "x.com", "linkedin.com", "facebook.com",
    ],
    ("AI Araçları", "#f472b6", "🤖"): [
        "chatgpt.com", "claude.ai", "gemini.google.com", "openrouter.ai", "notebooklm.google.com",
        "copilot.microsoft.com",
    ],
    ("Eğitim", "#38bdf8", "📚"): [
        "docs.google.com", "translate.google.com", "drive.google.com", "figma.com", "medium.com",
    ],
}
LEISURE_TAGS = ["Eğlence", "Sosyal Medya"]


def seed_rows() -> list[tuple[int, str, str, str, str]]:
    """(id, tag_name, tag_color, tag_icon, domain_pattern) with ids from 1."""
    rows = [(*tag, pattern) for tag, patterns in SEED_TAGS.items() for pattern in patterns]
    return [(n, *row) for n, row in enumerate(rows, start=1)]


def seed_tags(spark: SparkSession, created_at=None) -> DataFrame:
    """The default tags as a literal table, so that Spark knows its size."""
    values = ", ".join(f"({n}L, {', '.join(_quoted(v) for v in texts)})" for n, *texts in seed_rows())
    rows = spark.sql(f"SELECT * FROM VALUES {values} AS seed(id, tag_name, tag_color, tag_icon, domain_pattern)")
    return rows.withColumn("created_at", F.lit(created_at).cast(_TS))


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "\\'") + "'"


def ensure_tags(tags: DataFrame, created_at=None) -> DataFrame:
    """The tag table, or the default tags where it is empty."""
    return seed_tags(tags.sparkSession, created_at) if tags.isEmpty() else tags
