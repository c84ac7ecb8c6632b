"""Conversation structure repair by a dynamic programme over persistent audits.

A well-formed conversation has the role initials `(s?(ua)+)?`. The programme reads the rows in order and keeps, for each of
the four states of that pattern, the cheapest edits so far; of equally cheap ones the audit (one letter per edit: Delete,
Insert, Keep, Rerole) that is least in ASCII. Audits are nodes that point to their prefix, so all states share what they have
in common. A node has binary-lifting ancestors and the rolling hash of its string: two audits are compared by searching their
longest common prefix over equal hashes, then by the letter behind it. That the prefixes are equal is verified by walking
both up to a node they share; if they differ after all (a collision), the spelled-out audits decide.

Keeping one audit per state is exact: of two equally cheap audits that reach the same state none begins with the other, since
what is left of the longer would consist of insertions, which cost. An audit tells the repaired rows: what it inserts or
re-roles takes the only role that may follow.

Rows are partitioned by conversation and sorted by turn, and a conversation is read in one go. One of more than `long_rows`
rows or `long_chars` characters is not gathered: its rows are sorted into ranges over many tasks; each stretch of at most
`STRETCH` rows gives the cheapest audit from every state to every state, and these small tables are joined in pairs, the same
rule deciding. The texts then stream past their audit. What a long conversation needs in one task is its audit, one letter
per edit, and the stretches' tables.

Defined results: a NULL turn, role or text, and a NULL conv_id within the damage's key, is written as one space (a NULL
conv_id stays a conversation of its own); rows equal in turn are ordered by role, then by the first 256
characters of the text, then by its SHA-256; repeated rows are duplicates; a conversation without rows has an empty audit; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worktempo.llm.common import cut, slices

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLANKS = " \t\n\v\f\r"
LONG_ROWS, LONG_CHARS, STRETCH = 20_000, 8_000_000, 2048
#: States: nothing yet, after the system's row, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
MODULUS, BASE = (1 << 61) - 1, 911_382_323
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class Audits:
    """Strings of edits that share their prefixes. Node 0 is the empty string."""

    def __init__(self, modulus: int = MODULUS):
        self.modulus = modulus
        self.letters, self.depths, self.hashes, self.ups = [""], [0], [0], [[]]

    def extended(self, node: int, letters: str) -> int:
        for letter in letters:
            ups, at, level = [node], node, 0
            while len(self.ups[at]) > level:
                at = self.ups[at][level]
                ups.append(at)
                level += 1
            self.ups.append(ups)
            self.letters.append(letter)
            self.depths.append(self.depths[node] + 1)
            self.hashes.append((self.hashes[node] * BASE + ord(letter)) % self.modulus)
            node = len(self.letters) - 1
        return node

    def lifted(self, node: int, depth: int) -> int:
        """The prefix of that length."""
        while (more := self.depths[node] - depth) > 0:
            node = self.ups[node][more.bit_length() - 1]
        return node

    def equal(self, a: int, b: int) -> bool:
        """Are two audits of one length the same string? Walks up to a shared node."""
        while a != b:
            if self.letters[a] != self.letters[b]:
                return False
            a, b = self.ups[a][0], self.ups[b][0]
        return True

    def spelled(self, node: int) -> str:
        found = []
        while node:
            found.append(self.letters[node])
            node = self.ups[node][0]
        return "".join(reversed(found))

    def less(self, a: int, b: int) -> bool:
        """Is the string of a before that of b in ASCII order?"""
        depth = min(self.depths[a], self.depths[b])
        p, q = self.lifted(a, depth), self.lifted(b, depth)
        if self.hashes[p] == self.hashes[q]:
            if self.equal(p, q):
                return self.depths[a] < self.depths[b]
            return self.spelled(a) < self.spelled(b)
        for level in range(len(self.ups[p]) - 1, -1, -1):
            if level < len(self.ups[p]):
                up, vp = self.ups[p][level], self.ups[q][level]
                if self.hashes[up] != self.hashes[vp]:
                    p, q = up, vp
        if not self.equal(self.ups[p][0], self.ups[q][0]):
            return self.spelled(a) < self.spelled(b)
        return self.letters[p] < self.letters[q]


States = list  # per state None or (cost, node)


def best(audits: Audits, ways: list[tuple[int, int, str]]) -> tuple[int, int] | None:
    """The cheapest of (cost, node, letters behind it), ties by audit."""
    if not ways:
        return None
    least = min(ways)[0]
    node = -1
    for cost, before, letters in ways:
        if cost == least:
            other = audits.extended(before, letters)
            if node < 0 or audits.less(other, node):
                node = other
    return least, node


def with_inserts(audits: Audits, states: States) -> States:
    """States reachable by inserting rows before the next one; to insert more than this only comes back to a state."""
    def ways(*sources):
        return [(states[s][0] + INSERT * len(letters), states[s][1], letters) for s, letters in sources if states[s]]

    return [states[START], states[SYSTEM],
            best(audits, ways((USER, ""), (START, "I"), (SYSTEM, "I"), (ASSISTANT, "I"))),
            best(audits, ways((ASSISTANT, ""), (USER, "I"), (START, "II"), (SYSTEM, "II")))]


def after_row(audits: Audits, states: States, kind: str) -> States:
    """kind: the initial (o: another), a capital if truncated, d if the row has to go."""
    ways: list[list] = [[] if s is None else [(s[0] + DELETE, s[1], "D")] for s in states]
    if kind != "d":
        initial, more = kind.lower(), TRUNCATED if kind.isupper() else 0
        for role in "ua":
            if role != initial:
                for source, target in NEXT[role].items():
                    if states[source]:
                        ways[target].append((states[source][0] + REROLE + more, states[source][1], "R"))
        for source, target in NEXT.get(initial, {}).items():
            if states[source]:
                ways[target].append((states[source][0] + KEEP + more, states[source][1], "K"))
    return [best(audits, w) for w in ways]


def stretch(kinds: str, start: int, audits: Audits | None = None) -> list[tuple[int, str] | None]:
    """Cheapest (cost, audit) over the rows from one state to each state; insertions behind the last row are left out."""
    audits = audits or Audits()
    states: States = [None] * 4
    states[start] = (0, 0)
    for kind in kinds:
        states = after_row(audits, with_inserts(audits, states), kind)
    return [None if s is None else (s[0], audits.spelled(s[1])) for s in states]


def joined(first: list[list], second: list[list]) -> list[list]:
    """The tables (from state, to state) of two stretches, one behind the other."""
    def through(a: int, b: int):
        ways = [(first[a][m][0] + second[m][b][0], first[a][m][1] + second[m][b][1])
                for m in range(4) if first[a][m] and second[m][b]]
        return min(ways, default=None)

    return [[through(a, b) for b in range(4)] for a in range(4)]


def all_joined(tables: list[list[list]]) -> list[list]:
    """In pairs, so that every letter is copied a few times only."""
    while len(tables) > 1:
        tables = [joined(*tables[k:k + 2]) if k + 1 < len(tables) else tables[k] for k in range(0, len(tables), 2)]
    return tables[0]


def ended(ends: list[tuple[int, str] | None]) -> tuple[int, str]:
    """The cheapest well-formed end."""
    closing = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
    return min((ends[s][0] + INSERT * len(more), ends[s][1] + more) for s, more in closing.items() if ends[s])


def cheapest(kinds: str, most: int = STRETCH) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    if len(kinds) <= most:
        return ended(stretch(kinds, START))
    tables = [[stretch(kinds[k:k + most], s) for s in range(4)] for k in range(0, len(kinds), most)]
    return ended(all_joined(tables)[START])


def is_blank(text: str) -> bool:
    return not text.strip(BLANKS)


def kind_of(role: str, text: str, gone: bool) -> str:
    if gone:
        return "d"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return initial if text.rstrip(BLANKS)[-1] in ".!?" else initial.upper()


class Counting:
    """Figures of consecutive rows, added up row by row; those of two stretches can be joined."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.least = self.most = None
        self.kinds: list[str] = []

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        blank = is_blank(text)
        kind = kind_of(role, text, blank or seen)
        self.blank += blank
        self.duplicate += seen and not blank
        self.truncated += kind.isupper()
        self.follow(role[:1])
        self.kinds.append(kind)
        self.turn(turn, turn)

    def follow(self, initial: str) -> None:
        if self.last is not None:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        else:
            self.first = initial
        self.last = initial

    def turn(self, least: int | None, most: int | None, distinct: int = 1) -> None:
        if least is not None:
            self.turns += distinct - (self.most == least)
            self.least = least if self.least is None else self.least
            self.most = most

    def gaps(self) -> int:
        return 0 if self.least is None else self.most - self.least + 1 - self.turns


def messages_of(audit: str, rows: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The repaired (role, text) of a conversation."""
    rows, last = iter(rows), ""
    for edit in audit:
        role, text = next(rows) if edit != "I" else ("", "")
        if edit in "RI":
            role = "assistant" if last == "u" else "user"
        if edit != "D":
            last = role[:1]
            yield role, text


def as_rows(conversations: DataFrame, damage: bool = False) -> DataFrame:
    """conv_id, turn, role, text and `gone` (true: keeps the conversation's name only). With `damage`, by CRC-32 of
    `conv_id:turn` modulo 20: 0 drops a row, 1 empties its text, 2 takes out `[.!?]`, 3 repeats it, 4 makes it the user's."""
    space = F.lit(" ")
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")))
    fault = F.crc32(key) % 20 if damage else F.lit(-1)
    text = F.coalesce("text", space)
    named = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", space).alias("role"),
                                 text.alias("text"), fault.alias("fault"))
    changed = (F.when(F.col("fault").isin(0, 1), "")
               .when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return named.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
                        changed.alias("text"), (F.col("fault") == 0).alias("gone"), F.explode(copies).alias("copy")).drop("copy")


def place(text: Column, role: Column) -> list[Column]:
    """The order of rows of one turn and role."""
    return [F.substring(text, 1, 256), F.sha2(F.concat(role, F.lit("\n"), text), 256)]


def results_schema(rows: DataFrame) -> T.StructType:
    """position 0: the report of a conversation; from 1 on: its repaired messages."""
    schema = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType)])
    schema.add("position", "long").add("role", "string").add("text", "string")
    for name in COUNTS:
        schema.add(name, "long")
    return schema.add("audit", "string")


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for part in slices(batch):
            yield from zip(*(c.to_pylist() for c in part.columns))


def short_ones(schema: pa.Schema, remembered: int = 200_000) -> Callable:
    """Whole conversations, sorted: report and messages. Conversations of the same kinds of rows share one search."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, str]] = {}
        out: list[tuple] = []
        now: object = run  # equals no conv_id
        held: list[tuple[str, str]] = []

        def finish() -> None:
            kinds = "".join(counted.kinds)
            found = known.get(kinds)
            if found is None:
                if len(known) >= remembered:
                    known.clear()
                found = known[kinds] = cheapest(kinds)
            cost, audit = found
            out.append((now, 0, None, None, counted.gaps(), counted.blank, counted.duplicate, counted.truncated,
                        counted.illegal, cost, audit))
            none = (None,) * 7
            out.extend((now, k, role, text, *none) for k, (role, text) in enumerate(messages_of(audit, held), 1))

        for conv_id, turn, role, text, gone in read_rows(batches):
            if now is run or conv_id != now:
                if now is not run:
                    finish()
                    if len(out) >= 2000:
                        yield batch_of(out, schema)
                        out = []
                now, counted, held, seen = conv_id, Counting(), [], set()
            if not gone:
                counted.add(turn, role, text, (role, text) in seen)
                held.append((role, text))
                seen.add((role, text))
        if now is not run:
            finish()
        yield batch_of(out, schema)

    return run


SEGMENT = ("part int, number int, first string, last string, blank bigint, duplicate bigint, truncated bigint, "
           "illegal bigint, turns bigint, least bigint, most bigint, rows bigint, "
           "ways array<struct<source:int,target:int,cost:bigint,audit:string>>")


def segments(rows: DataFrame) -> DataFrame:
    """Stretches of sorted rows (conv_id, turn, role, digest, last, first_turn) with their tables of audits."""
    kind = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType)])
    for field in T._parse_datatype_string(SEGMENT).fields:
        kind.add(field)
    schema = arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, before = TaskContext.get().partitionId(), 0, None
        now: object = run

        def finish() -> pa.RecordBatch:
            kinds = "".join(counted.kinds)
            ways = [{"source": s, "target": t, "cost": w[0], "audit": w[1]}
                    for s in range(4) for t, w in enumerate(stretch(kinds, s)) if w]
            return batch_of([(now, part, number, counted.first, counted.last, counted.blank, counted.duplicate,
                              counted.truncated, counted.illegal, counted.turns, counted.least, counted.most,
                              len(kinds), ways)], schema)

        for conv_id, turn, role, digest, last, first_turn in read_rows(batches):
            if now is run or conv_id != now or len(counted.kinds) >= STRETCH:
                if now is not run:
                    yield finish()
                    number += 1
                now, counted = conv_id, Counting()
            here = (conv_id, turn, digest)
            # The earliest turn of a text is its first; of equal rows of one turn, which stand together, the first is.
            counted.add(turn, role, last, turn != first_turn or here == before)
            before = here
        if now is not run:
            yield finish()

    return rows.mapInArrow(run, kind)


def reports_of_long(parts: DataFrame, schema: T.StructType) -> DataFrame:
    """One report per conversation from its stretches."""
    out = arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        found = sorted(table.to_pylist(), key=lambda r: (r["part"], r["number"]))
        total, tables = Counting(), []
        for r in found:
            total.follow(r["first"])
            total.last = r["last"]
            total.illegal += r["illegal"]
            for name in ("blank", "duplicate", "truncated"):
                setattr(total, name, getattr(total, name) + r[name])
            total.turn(r["least"], r["most"], r["turns"])
            each: list[list] = [[None] * 4 for _ in range(4)]
            for way in r["ways"]:
                each[way["source"]][way["target"]] = (way["cost"], way["audit"])
            tables.append(each)
        cost, audit = ended(all_joined(tables)[START])
        report = (found[0]["conv_id"], 0, None, None, total.gaps(), total.blank, total.duplicate, total.truncated,
                  total.illegal, cost, audit)
        return pa.Table.from_batches([batch_of([report], out)])

    return parts.groupBy("conv_id").applyInArrow(run, schema)


def streamed(schema: pa.Schema) -> Callable:
    """Sorted rows (conv_id, role, text, report), a conversation's report first, to report and messages."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv_id, audit, at, position, last = None, "", 0, 0, ""

        def inserted() -> None:
            nonlocal at, position, last
            while at < len(audit) and audit[at] == "I":
                emit("assistant" if last == "u" else "user", "")
                at += 1

        def emit(role: str, text: str) -> None:
            nonlocal position, last
            position, last = position + 1, role[:1]
            out.append((conv_id, position, role, text, *(None,) * 7))

        for name, role, text, report in read_rows(batches):
            if report is not None:
                conv_id, audit, at, position, last = name, report["audit"], 0, 0, ""
                out.append((name, 0, None, None, *(report[c] for c in COUNTS), audit))
            else:
                edit = audit[at]
                at += 1
                if edit != "D":
                    emit(("assistant" if last == "u" else "user") if edit == "R" else role, text)
            inserted()
            if len(out) >= 500:
                yield batch_of(out, schema)
                out = []
        yield batch_of(out, schema)

    return run


def long_ones(rows: DataFrame) -> DataFrame:
    """As `short_ones`, for conversations that no task should gather."""
    schema = results_schema(rows)
    present = rows.where(~F.col("gone"))
    head, digest = place(F.col("text"), F.col("role"))
    # Of a text the search needs only whether it is blank and its last character that is not.
    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    narrow = present.select("conv_id", "turn", "role", head.alias("head"), digest.alias("digest"), last.alias("last"))
    # NULL turns come first, so they are the earliest; NULL conversations are one.
    named = F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))
    firsts = (narrow.groupBy(named.alias("name"), "digest")
              .agg(F.min(F.struct(F.col("turn").isNotNull().alias("some"), "turn")).alias("first")))
    told = narrow.withColumn("name", named).join(firsts, ["name", "digest"])
    ranged = (told.repartitionByRange("conv_id", "turn", "role", F.substring("head", 1, 32))
              .sortWithinPartitions("conv_id", "turn", "role", "head", "digest"))
    parts = segments(ranged.select("conv_id", "turn", "role", "digest", "last", F.col("first.turn").alias("first_turn")))
    reports = cut(reports_of_long(parts, schema)).select("conv_id", F.struct(*COUNTS, "audit").alias("report"))
    texts = present.select("conv_id", "turn", "role", "text", F.lit(None).cast(reports.schema["report"].dataType).alias("report"))
    heads = reports.select("conv_id", F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"),
                           F.lit("").alias("text"), "report")
    stream = (heads.unionByName(texts).repartition("conv_id")
              .sortWithinPartitions("conv_id", F.col("report").isNull(), "turn", "role", *place(F.col("text"), F.col("role"))))
    return stream.select("conv_id", "role", "text", "report").mapInArrow(streamed(arrow_schema(schema)), schema)


def repaired(rows: DataFrame, long_rows: int = LONG_ROWS, long_chars: int = LONG_CHARS) -> DataFrame:
    """conv_id, position, role, text, gaps, blank, duplicate, truncated, illegal, cost and audit, of rows as `as_rows` gives
    them. position 0 is a conversation's report, 1 and on are its repaired messages; in each partition a conversation's rows
    stand together in that order."""
    schema = results_schema(rows)
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"),
                                        F.max(~F.col("gone")).alias("any"))
    long = cut(sizes.where(((F.col("n") > long_rows) | (F.col("chars") > long_chars)) & F.col("any"))
               .select(F.col("conv_id").alias("long_id"), F.lit(True).alias("is_long")))

    def whole(part: DataFrame) -> DataFrame:
        sorted_rows = part.repartition("conv_id").sortWithinPartitions(
            "conv_id", "turn", "role", *place(F.col("text"), F.col("role")))
        return sorted_rows.select("conv_id", "turn", "role", "text", "gone").mapInArrow(short_ones(arrow_schema(schema)), schema)

    if long.isEmpty():
        return whole(rows)
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    return whole(rows.join(long, same, "left_anti")).unionByName(long_ones(rows.join(long, same, "left_semi")))


def digests(result: DataFrame) -> DataFrame:
    """One row per conversation: its report and the SHA-256 of its repaired `role:text`, newline-joined. Reads the rows of
    `repaired` as they stand, so nothing is shuffled and no conversation is held."""
    kind = T.StructType([f for f in result.schema.fields if f.name not in ("position", "role", "text")])
    kind.add("repaired_sha256", "string")
    schema = arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        report: tuple | None = None
        digest = hashlib.sha256()
        for conv_id, position, role, text, *figures in read_rows(batches):
            if position == 0:
                if report is not None:
                    out.append((*report, digest.hexdigest()))
                    if len(out) >= 2000:
                        yield batch_of(out, schema)
                        out = []
                report, digest = (conv_id, *figures), hashlib.sha256()
            else:
                digest.update(f"{chr(10) if position > 1 else ''}{role}:{text}".encode())
        if report is not None:
            out.append((*report, digest.hexdigest()))
        yield batch_of(out, schema)

    return result.mapInArrow(run, kind)
