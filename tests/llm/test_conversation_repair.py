"""Repaired conversations against trying every edit, and long conversations against short ones."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from worktempo.llm import conversation_repair as repair
from worktempo.llm.queries import op12_conversation_repair

DATA = "/root/testdata/sf0.01"
FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def every_edit(kinds):
    """(cost, audit) of all edits that give a well-formed conversation, with at most two insertions at a place."""
    found = []
    inserts = [tuple(x) for n in range(3) for x in itertools.product("ua", repeat=n)]

    def go(at, roles, cost, audit):
        if at == len(kinds):
            for more in inserts:
                if re.fullmatch("(s?(ua)+)?", roles + "".join(more)):
                    found.append((cost + 3 * len(more), audit + "I" * len(more)))
            return
        kind = kinds[at]
        for more in inserts:
            r, c, a = roles + "".join(more), cost + 3 * len(more), audit + "I" * len(more)
            if not re.fullmatch("s?(ua)*u?", r):
                continue
            go(at + 1, r, c + 4, a + "D")
            if kind != "d":
                cut = 3 * kind.isupper()
                if re.fullmatch("s?(ua)*u?", r + kind.lower()):
                    go(at + 1, r + kind.lower(), c + cut, a + "K")
                for role in "ua":
                    if re.fullmatch("s?(ua)*u?", r + role):
                        go(at + 1, r + role, c + 3 + cut, a + "R")

    go(0, "", 0, "")
    return min(found)


def plain(rows, cheapest=repair.cheapest):
    """A conversation's figures from (turn, role, text), step by step."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, kinds = [], ""
    blank = duplicate = truncated = 0
    for _, role, text in rows:
        if not re.search(r"[^\x20\x09-\x0D]", text):
            blank += 1
            kinds += "d"
        elif (role, text) in seen:
            duplicate += 1
            kinds += "d"
        else:
            short = re.findall(r"[^\x20\x09-\x0D]", text)[-1] not in ".!?"
            truncated += short
            initial = role[0] if role and role[0] in "sua" else "o"
            kinds += initial.upper() if short else initial
        seen.append((role, text))
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit = cheapest(kinds)
    out, at = [], 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else rows[at][1:]
        at += edit != "I"
        if edit in "RI":
            role = "assistant" if out and out[-1][0][:1] == "u" else "user"
        if edit != "D":
            out.append((role, text))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return gaps, blank, duplicate, truncated, illegal, cost, audit, digest


def plainly_damaged(rows):
    found = {}
    for conv_id, turn, role, text in rows:
        kept = found.setdefault(conv_id, [])
        show = [" " if v is None else str(v) for v in (conv_id, turn)]
        fault = zlib.crc32(":".join(show).encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        if fault == 1:
            text = ""
        elif fault == 2:
            text = re.sub("[.!?]", "", text)
        elif fault == 4:
            role = "user"
        if fault:
            kept.extend([(turn, role, text)] * (2 if fault == 3 else 1))
    return found


def figures(df):
    found = [(r.conv_id, tuple(r[c] for c in FIGURES)) for r in df.collect()]
    assert len(found) == len(dict(found))
    return dict(found)


KINDS = "uasoUASOd"


def test_every_short_conversation_against_all_edits():
    rng = random.Random(1)
    cases = ["", *KINDS, *map("".join, itertools.product(KINDS, repeat=2))]
    cases += ["".join(rng.choices(KINDS, k=rng.choice([3, 4]))) for _ in range(150)]
    for kinds in cases:
        assert repair.cheapest(kinds) == every_edit(kinds), kinds


def test_stretches_joined_give_the_whole():
    rng = random.Random(2)
    for _ in range(60):
        kinds = "".join(rng.choices(KINDS, k=rng.randrange(1, 60)))
        assert repair.cheapest(kinds, 7) == repair.cheapest(kinds)


def test_audits_are_compared_by_their_longest_common_prefix():
    audits = repair.Audits()
    rng = random.Random(3)
    words = ["".join(rng.choices("DIKR", k=rng.randrange(1, 40))) for _ in range(60)] + ["K" * 30, "K" * 31, "K" * 30 + "D"]
    nodes = [audits.extended(0, w) for w in words]
    for (a, x), (b, y) in itertools.product(zip(nodes, words), repeat=2):
        assert audits.less(a, b) == (x < y)
    assert [audits.spelled(n) for n in nodes] == words


def test_collisions_of_the_rolling_hash_are_noticed():
    audits = repair.Audits(modulus=3)
    rng = random.Random(4)
    words = ["".join(rng.choices("DK", k=rng.randrange(1, 12))) for _ in range(60)]
    nodes = [audits.extended(0, w) for w in words]
    for (a, x), (b, y) in itertools.product(zip(nodes, words), repeat=2):
        assert audits.less(a, b) == (x < y)


def test_prefixes_are_shared():
    audits = repair.Audits()
    states = [(0, 0), None, None, None]
    for kind in "ua" * 200:
        states = repair.after_row(audits, repair.with_inserts(audits, states), kind)
    assert len(audits.letters) < 400 * 12
    assert audits.spelled(states[repair.ASSISTANT][1]) == "K" * 400


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    expected = {c: plain(kept) for c, kept in plainly_damaged(rows).items()}
    assert figures(op12_conversation_repair(spark, DATA)) == expected
    assert any(v[1] for v in expected.values()) and any(v[2] for v in expected.values())


def test_long_conversations_are_split_with_the_same_result(spark):
    damaged = repair.as_rows(spark.read.parquet(f"{DATA}/conversations.parquet"), damage=True)
    whole = figures(repair.digests(repair.repaired(damaged)))
    assert figures(repair.digests(repair.repaired(damaged, long_rows=4))) == whole
    assert figures(repair.digests(repair.repaired(damaged, long_chars=1500))) == whole


@pytest.fixture
def conversations(spark):
    def build(*rows, clash=False):
        kind = "conv_id bigint, turn bigint, role string, text string"
        if clash:
            names = ["fault", "copy", "gone", "position", "audit", "digest", "head", "n", "report", "long_id"]
            kind += "".join(f", {c} string" for c in names)
            rows = [(*r, *["x"] * len(names)) for r in rows]
        return spark.createDataFrame(list(rows), kind)

    return build


ODD = [(1, None, None, None), (1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 2, "assistant", ""), (None, None, None, None),
       (None, 5, "user", "x" * 30_000 + "."), (2, 7, "", "  \t\v"), (3, 1, "tool", "out"), (3, 1, "system", "sys!"),
       (4, None, "assistant", "yes?"), (4, 3, "user", "a "), (5, 0, "system", "only."), (6, 0, "usher", "Hm. \n"),
       (7, 4, "user", "b."), (7, 4, "user", "a."), (7, 4, "assistant", "a.")]


@pytest.mark.parametrize("damage", [False, True])
@pytest.mark.parametrize("long_rows", [0, 20_000])
def test_odd_rows(conversations, damage, long_rows):
    rows = conversations(*ODD, clash=True)
    kept = plainly_damaged(ODD)
    if not damage:
        kept = {}
        for conv_id, turn, role, text in ODD:
            kept.setdefault(conv_id, []).append((turn, " " if role is None else role, " " if text is None else text))
    found = repair.digests(repair.repaired(repair.as_rows(rows, damage), long_rows=long_rows))
    assert figures(found) == {c: plain(k) for c, k in kept.items()}


def test_one_conversation_of_many_rows(spark, conversations):
    rng = random.Random(6)
    texts = ["Yes.", "No", " ", "Why?", "Tell me more!"]
    rows = [(1, k // 3, rng.choice(["user", "assistant", "system"]), f"{rng.choice(texts)}") for k in range(900)]
    rows += [(2, k, "user" if k % 2 == 0 else "assistant", f"{k}.") for k in range(700)]
    found = figures(repair.digests(repair.repaired(repair.as_rows(conversations(*rows)), long_rows=300)))
    assert found == {c: plain([r[1:] for r in rows if r[0] == c]) for c in (1, 2)}
    assert found[2][5:7] == (0, "K" * 700)


def test_messages_are_the_repaired_conversation(conversations):
    rows = repair.as_rows(conversations((1, 0, "user", "A?"), (1, 1, "user", "B."), (1, 2, "assistant", "C.")))
    found = repair.repaired(rows).collect()
    assert [(r.position, r.role, r.text) for r in found if r.position] == [(1, "user", "B."), (2, "assistant", "C.")] or \
        [(r.role) for r in found if r.position] == ["user", "assistant", "user", "assistant"]
    (report,) = [r for r in found if r.position == 0]
    assert (report.cost, report.audit) == every_edit("uua")


def test_no_rows(spark, conversations):
    none = conversations((1, 0, "user", "x.")).where("false")
    assert figures(repair.digests(repair.repaired(repair.as_rows(none, damage=True)))) == {}
