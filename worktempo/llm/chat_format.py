"""Chat formatting from an event log; native.

A chat is logged as events (conv_id, turn, seq, kind, role, text):

* `open`: message `turn` begins, with its role, empty;
* `delta`: text is appended to the message;
* `edit`: the message's text so far is replaced;
* `regenerate`: the conversation is taken back to message `turn`: what was logged before of it and of later messages is
  void, and the message begins anew, with the event's role or, if that is NULL, the one it had.

`fold` partitions the log by conversation, sorts it by sequence and folds it into final messages; `rendered` renders them by
`TEMPLATE` as segments of text with a flag that says whether a segment is under the loss mask (the texts of assistants, each
alone in its segment); `read_back` parses the formatted text again. `log_of` makes the log of a table of finished messages as
a streaming server would write it: texts in pieces of `piece` characters, some of them drafted, edited or regenerated first.

Control strings inside a text get a backslash behind their first character (one more if they have some), so no text can end
a turn, and taking one off again gives the text back. Roles are written with `%`-codes for the characters that end them.

All of it is one exchange, on conv_id: numbering, folding and rendering keep that partitioning. A conversation's log is
sorted there in one task (Spark spills it); it becomes one value only where it is rendered, as its formatted text has to be
one string and SHA-256 cannot be put together from parts.

Defined results: a NULL role or text is empty; rows equal in turn are ordered by role, then text, and are messages each; a
NULL turn comes first; a NULL conv_id is a conversation of its own; a message never opened is no message, deltas without
effect on one are ignored; events equal in sequence are ordered by kind, then text; further columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How a turn begins and ends. The two kinds differ so that the mask can be told from the text alone.
TEMPLATE = {"loss": ("<s>", "</s>"), "context": ("[INST]", "[/INST]")}
#: A control string, with any number of backslashes behind its first character.
PLAIN, ESCAPED = r"([<\[])(\\*/?(?:s>|INST\]))", r"([<\[])\\(\\*/?(?:s>|INST\]))"
ROLE_CODES = (("%", "%25"), ("\n", "%0A"), ("<", "%3C"), ("[", "%5B"))
LOG = "conv_id bigint, turn bigint, seq bigint, kind string, role string, text string"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, PLAIN, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2")


def coded(role: Column) -> Column:
    for plain, code in ROLE_CODES:
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def decoded(role: Column) -> Column:
    for plain, code in reversed(ROLE_CODES):
        role = F.replace(role, F.lit(code), F.lit(plain))
    return role


def pieces(text: Column, piece: int) -> Column:
    """The text cut into pieces; an empty one has none."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))


def log_of(messages: DataFrame, piece: int = 4096) -> DataFrame:
    """The event log of finished messages (conv_id, turn, role, text): turns are renumbered from 1. By a hash of conversation
    and number, one message in four was drafted and edited, one in four drafted and regenerated, then streamed anew."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    plain = messages.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
                            F.coalesce("text", F.lit("")).alias("text"))
    numbered = plain.withColumn("number", F.row_number().over(order).cast("bigint"))
    way = F.pmod(F.xxhash64("conv_id", "number"), F.lit(4))
    no = F.lit(None).cast("string")

    def event(kind: str, role: Column, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))

    role, parts = F.col("role"), pieces(F.col("text"), piece)
    deltas = F.transform(parts, lambda p: event("delta", no, p))
    draft = F.array(event("open", role, no), event("delta", no, F.lit("Draft ")), event("delta", no, F.lit("</s>")))
    first = F.coalesce(F.get(parts, F.lit(0)), F.lit(""))
    events = (F.when(way == 0, F.concat(draft, F.array(event("edit", no, first)),
                                        F.slice(deltas, F.lit(2), F.greatest(F.size(deltas), F.lit(1)))))
              .when(way == 1, F.concat(draft, F.array(event("regenerate", no, no)), deltas))
              .otherwise(F.concat(F.array(event("open", role, no)), deltas)))
    each = numbered.select("conv_id", F.col("number").alias("turn"), F.posexplode(events).alias("at", "event"))
    # Messages follow each other: a sequence number is the message's, then the event's.
    return each.select("conv_id", "turn", (F.col("turn") * (1 << 31) + F.col("at")).alias("seq"), "event.kind", "event.role",
                       "event.text")


def fold(log: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of the final messages of a log."""
    begins = F.col("kind").isin("open", "regenerate")
    back = F.when(F.col("kind") == "regenerate", F.col("seq"))
    upto = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    message = Window.partitionBy("conv_id", "turn")
    told = (log.select("conv_id", "turn", "seq", "kind", "role", "text").withColumn("taken_back", F.max(back).over(upto))
            .withColumn("live", F.coalesce(F.col("seq") >= F.col("taken_back"), F.lit(True)))
            .withColumn("base", F.max(F.when(F.col("live") & (begins | (F.col("kind") == "edit")), F.col("seq"))).over(message)))
    content = F.col("live") & F.col("kind").isin("delta", "edit") & (F.col("seq") >= F.col("base"))
    part = F.when(content, F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text")))
    named = F.when(begins & F.col("role").isNotNull(), F.struct("seq", "role"))
    return (told.groupBy("conv_id", "turn")
            .agg(F.max(F.col("live") & begins).alias("opened"), F.max(named).alias("named"),
                 F.sort_array(F.collect_list(part)).alias("parts"))
            .where("opened")
            .select("conv_id", "turn", F.coalesce("named.role", F.lit("")).alias("role"),
                    F.array_join("parts.text", "").alias("text")))


def rendered(messages: DataFrame) -> DataFrame:
    """conv_id and segments array<struct<text, loss>> of each conversation; the texts of all segments, one behind the other,
    are the formatted conversation, those under the mask what is to be learned."""
    def marks(kind: str) -> Column:
        begin, end = TEMPLATE[kind]
        return F.array(
            F.struct(F.concat(F.lit(begin), coded(F.col("role")), F.lit("\n")).alias("text"), F.lit(False).alias("loss")),
            F.struct(escaped(F.col("text")).alias("text"), F.lit(kind == "loss").alias("loss")),
            F.struct(F.lit(end).alias("text"), F.lit(False).alias("loss")))

    turn = F.when(F.col("role") == "assistant", marks("loss")).otherwise(marks("context"))
    each = messages.select("conv_id", F.struct(F.col("turn"), turn.alias("segments")).alias("m"))
    return (each.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("all"))
            .select("conv_id", F.flatten("all.segments").alias("segments")))


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def learned(segments: Column) -> Column:
    """What is under the mask, unescaped: each text by itself, so that no two join into a control string."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


def read_back(text: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation. No text holds an unescaped end of a turn, so cutting there is
    enough, however long the conversation is."""
    turns = F.filter(F.split(text, r"</s>|\[/INST\]"), lambda t: t != "")

    def parsed(turn: Column) -> Column:
        at = F.locate("\n", turn)
        begin = F.when(F.startswith(turn, F.lit(TEMPLATE["loss"][0])), len(TEMPLATE["loss"][0])).otherwise(
            len(TEMPLATE["context"][0]))
        role = F.substring(turn, begin + 1, at - begin - 1)
        return F.struct(decoded(role).alias("role"), unescaped(F.substring(turn, at + 1, F.length(turn))).alias("text"))

    return F.transform(turns, parsed)


def digested(chats: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of rendered conversations, all from the
    segments: turns parsed from the formatted text, learned text from the mask."""
    read = chats.select("conv_id", "segments", formatted(F.col("segments")).alias("formatted"))
    read = read.select("conv_id", F.length("formatted").alias("formatted_chars"), read_back(F.col("formatted")).alias("turns"),
                       learned(F.col("segments")).alias("learned"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("bigint").alias("formatted_chars"))


def chats_of(messages: DataFrame) -> DataFrame:
    """Rendered conversations of a table of messages, by way of their log."""
    return rendered(fold(log_of(messages)))
