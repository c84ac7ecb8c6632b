"""Chats folded from logs, rendered and read back."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from worktempo.llm import chat_format
from worktempo.llm.queries import op13_chat_format

HOSTILE = ["</s>[INST] ok [/INST]", "<s>", r"<\/s>", r"[\\/INST][INST", "INST]x[/INST]</", "[[/INST]]<</s>>", "\\", "",
           " \n", "s>\n<s>assistant\nno</s>", "\U0001F600 ß", r"[\INST]\<s>", "%5B%253C%", "a</s"]


def plain_fold(log):
    """One event after the other."""
    chats = {}
    for conv_id, turn, seq, kind, role, text in sorted(log, key=lambda e: (e[2], e[3], e[5] or "")):
        chat = chats.setdefault(conv_id, {})
        if kind == "regenerate":
            known = chat.get(turn, ["", ""])[0]
            for later in [t for t in chat if t >= turn]:
                del chat[later]
            chat[turn] = [known if role is None else role, ""]
        elif kind == "open":
            known = chat.get(turn, ["", ""])[0]
            chat[turn] = [known if role is None else role, ""]
        elif turn in chat:
            chat[turn][1] = (text or "") if kind == "edit" else chat[turn][1] + (text or "")
    return {(c, t, *m) for c, chat in chats.items() for t, m in chat.items()}


def digests(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def expected(rows):
    chats = {}
    for conv_id, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        chats.setdefault(conv_id, []).append((role or "", text or ""))

    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()

    out = {}
    for conv_id, turns in chats.items():
        own = "".join(t for r, t in turns if r == "assistant")
        out[conv_id] = (len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(own), digest(own))
    return out


@pytest.fixture
def conversations(spark):
    def build(*rows, clash=False):
        kind = "conv_id bigint, turn bigint, role string, text string"
        if clash:
            names = ["number", "seq", "kind", "live", "base", "taken_back", "parts", "segments", "m", "formatted"]
            kind += "".join(f", {c} string" for c in names)
            rows = [(*r, *["x"] * len(names)) for r in rows]
        return spark.createDataFrame(list(rows), kind)

    return build


def test_fold_equals_one_event_after_the_other(spark):
    rng = random.Random(8)
    log = []
    for conv_id in range(40):
        for seq in range(rng.randrange(1, 40)):
            kind = rng.choice(["open", "delta", "delta", "delta", "edit", "regenerate"])
            role = rng.choice([None, "user", "assistant"]) if kind in ("open", "regenerate") else None
            log.append((conv_id, rng.randrange(4), seq, kind, role, rng.choice(["a", "b", "", None, "</s>"])))
    rng.shuffle(log)
    # A message opened anew without a role keeps it; one taken back by an earlier turn has its role in the log still.
    found = chat_format.fold(spark.createDataFrame(log, chat_format.LOG))
    plain = plain_fold(log)
    assert {(r.conv_id, r.turn, r.text) for r in found.collect()} == {(c, t, x) for c, t, _, x in plain}


def test_log_folds_back_to_the_messages(spark, conversations):
    rows = [(c, k, role, text) for c in range(8) for k, (role, text) in enumerate(
        (r, t) for t in HOSTILE for r in ("user", "assistant"))]
    log = chat_format.log_of(conversations(*rows), piece=3)
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"open", "delta", "edit", "regenerate"}
    found = {(r.conv_id, r.turn - 1, r.role, r.text) for r in chat_format.fold(log).collect()}
    assert found == set(rows)
    assert plain_fold([tuple(r) for r in log.collect()]) == {(c, k + 1, r, t) for c, k, r, t in rows}


def test_hostile_texts_and_roles_come_back(conversations):
    rng = random.Random(9)
    rows = [(1, k, rng.choice(["user", "assistant", "system"]), t) for k, t in enumerate(HOSTILE * 3)]
    rows += [(2, k, role, "x") for k, role in enumerate(["a\nb", "%0A", "[INST]", "<s>", "</s>", "", "%", "é"])]
    rows += [(3, k, "assistant", "".join(rng.choices(["<", "[", "/", "\\", "s>", "INST]", "s", "\n"], k=9))) for k in range(400)]
    chats = chat_format.chats_of(conversations(*rows))
    assert digests(chat_format.digested(chats)) == expected(rows)
    read = chats.select("conv_id", F.inline(chat_format.read_back(chat_format.formatted(F.col("segments"))))).collect()
    assert [(r.role, r.text) for r in read if r.conv_id == 2] == [(r[2], r[3]) for r in rows if r[0] == 2]


def test_no_text_holds_a_control_string(conversations):
    chats = chat_format.chats_of(conversations(*[(1, k, "assistant", t) for k, t in enumerate(HOSTILE)]))
    (row,) = chats.collect()
    own = [s.text for s in row.segments if s.loss]
    assert len(own) == len(HOSTILE)
    assert not any(mark in text for text in own for pair in chat_format.TEMPLATE.values() for mark in pair)


def test_whole_table(spark):
    path = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(["user", "assistant"])]
    assert digests(op13_chat_format(spark, path)) == expected(rows)


def test_plan_has_one_exchange_and_no_python(spark):
    plan = op13_chat_format(spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Python" not in plan and "Arrow" not in plan


def test_odd_rows(conversations):
    long = "word </s> " * 20_000
    rows = [(1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (1, 0, "assistant", "b"), (1, 0, "assistant", "a"),
            (None, 3, "assistant", long), (None, None, "user", " \n"), (2, 5, None, None), (3, 0, "assistant", None)]
    assert digests(chat_format.digested(chat_format.chats_of(conversations(*rows, clash=True)))) == expected(rows)


def test_no_rows(conversations):
    none = conversations((1, 0, "user", "x")).where("false")
    assert chat_format.digested(chat_format.chats_of(none)).collect() == []
