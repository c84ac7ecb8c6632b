"""Quality, toxicity and language: held-out accuracy on the given tables, and defined results of odd rows."""

from __future__ import annotations

import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import random

import pytest
from pyspark.sql import functions as F

from worktempo.llm import language, quality_classifier, queries, toxicity
from worktempo.llm.common import Words, ngram_buckets, split_words

DATA = Path("/root/testdata/sf0.1")
needs_data = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}


@needs_data
def test_quality_on_held_out_documents(spark, labels):
    rows = queries.op1_quality_classifier(spark, str(DATA)).where("held_out").collect()
    known = [(r.predicted, labels[r.doc_id].quality) for r in rows if r.doc_id in labels]
    assert len(known) > 500 and np.mean([a == b for a, b in known]) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


@needs_data
def test_toxicity_on_held_out_documents(spark, labels):
    rows = queries.op7_toxicity(spark, str(DATA)).where("held_out").collect()
    known = [(r.predicted, labels[r.doc_id].toxic) for r in rows if r.doc_id in labels]
    assert np.mean([a == b for a, b in known]) > 0.97
    assert np.mean([a for a, b in known if b]) > 0.85


@needs_data
def test_language_on_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.op9_language(spark, str(DATA)).where("held_out").collect()
    assert len(rows) > 1500 and np.mean([truth[r.doc_id] == r.lang_pred for r in rows]) > 0.98


def test_ngrams_stay_inside_words():
    one, owner = ngram_buckets(["ab", "c"], (2,), 1 << 20)
    assert owner.tolist() == [0, 0, 0, 1, 1]
    again, _ = ngram_buckets(["c", "ab"], (2,), 1 << 20)
    assert sorted(one.tolist()) == sorted(again.tolist())


@pytest.fixture(scope="module")
def toxic_model(words):
    texts = [f"{words(20)} {w} {words(20)}" for w in ("idiot", "moron", "stupid") for _ in range(30)]
    clean = [words(41) for _ in range(200)]
    return toxicity.train(texts + clean, [1] * len(texts) + [0] * len(clean))


@pytest.mark.parametrize("hidden, plain", [
    ("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("m0r0n", "moron"), ("stuuuupid", "stupid"), ("$tup!d", "stupid"),
    ("IDIOT!!", "idiot"), ("5tup1d,", "stupid"),
])
def test_deobfuscation(toxic_model, hidden, plain):
    assert toxic_model.characters.restore(hidden) == plain


@pytest.mark.parametrize("hidden, plain", [
    ("stuupid", "stupid"), ("iddiiott", "idiot"), ("mmoorroonn", "moron"), ("st" + "u" * 60 + "pid", "stupid"),
    ("i" + "." * 70 + "d.i.o.t", "idiot"), ("1!|1!|d!|1!|1!|0!|7", "idiot"),
])
def test_doubled_letters_and_long_spellings(toxic_model, hidden, plain):
    assert toxic_model.characters.restore(hidden) == plain


@pytest.mark.parametrize("hidden", [
    "you i d i o t.", "m o r o n!", "you are a i d i o t", "o i d i o t y", "i - d - i - o - t", "st up id", "s tu p i d, i",
    "i, d, i, o, t", "1 d 1 0 t", "$ t u p ! d", "(i d i o t)", "ba i d i o t be m o r o n", "i ... d i o t",
])
def test_words_in_pieces(toxic_model, hidden):
    table = toxicity.WordTable(toxic_model.word_figures)
    plain, found, whole = toxic_model.scores([f"lalala {x} lalala" for x in ("", hidden, "idiot")], table)
    assert plain < 0.5 and found >= whole > 0.5


@pytest.fixture(scope="module")
def certain_model(words):
    """Learned from enough documents that the parts of toxic words are looked for."""
    bad, clean = [f"{words(20)} {w} {words(5)}" for w in ("stupid", "idiots", "worthless") * 30], [words(25) for _ in range(400)]
    return toxicity.train(bad + clean, [1] * len(bad) + [0] * len(clean))


@pytest.mark.parametrize("hidden, whole", [
    ("stu pid", "stupid"), ("idi ots", "idiots"), ("wort hless", "worthless"), ("STU, pid.", "stupid"), ("wor thl ess", "worthless"),
    ("stup id", "stupid"), ("s tupid", "stupid"), ("5tu p1d", "stupid"), ("(idi) - ots", "idiots"), ("wo rthl e ss", "worthless"),
])
def test_longer_pieces_are_joined(certain_model, hidden, whole):
    table = toxicity.WordTable(certain_model.word_figures)
    plain, found, full = certain_model.scores([f"lalala {x} lalala" for x in ("", hidden, whole)], table)
    assert plain < 0.5 and found >= full > 0.5


@pytest.mark.parametrize("text", ["stu lalala pid", "pid stu", "idi stu", "wort stup", "stu. rid", "idi"])
def test_pieces_alone_or_of_no_known_word_do_not_count(certain_model, text):
    table = toxicity.WordTable(certain_model.word_figures)
    plain, found = certain_model.scores(["lalala lalala", f"lalala {text} lalala"], table)
    assert found == pytest.approx(plain, abs=1e-9) or found < 0.5


def test_parts_of_words():
    assert toxicity.inner_parts(frozenset({"idiot", "dio"})) == {"idi", "iot", "idio", "diot"}  # dio is a word itself
    assert "stu" in (parts := toxicity.inner_parts(frozenset({"stupid"}))) and "pid" in parts
    assert [toxicity.folded(w) for w in ("5tu", "p1d", "$tt-u", "ll1!", "3.14", "")] == ["stu", "pid", "stu", "i", "eia", ""]
    assert toxicity.piece_kind("5tu", parts) == toxicity.piece_kind("P!D.", parts) == toxicity.PIECE
    assert toxicity.piece_kind("571", parts) != toxicity.PIECE and toxicity.piece_kind("stu") == toxicity.LONGER
    assert toxicity.inner_parts(frozenset()) == frozenset()


def test_pieces_that_are_words_stay_words(toxic_model, words):
    model = toxicity.train([f"to go in {words(20)} idiot"] * 9 + [f"to go in it is {words(20)}"] * 40, [1] * 9 + [0] * 40)
    assert model.characters.decode("to go in it is") == "to go in it is"
    kinds = np.asarray([toxicity.piece_kind(w) for w in "a 1 2 3 4 5 6 b - c word 1 2 3 4 d".split()])
    assert toxicity.piece_runs(kinds) == [(7, 10), (11, 16)]


def test_decoding_is_exact(toxic_model):
    """Against a search that leaves out no state."""
    model, spellings = toxic_model.characters, ["4!7|0$1!3|+8@1", "m!0|r!0|n!|1", "5+|_|p1d!0$4|", "b!1|6!0$7|3!"]
    full = toxicity.CharacterModel.__new__(toxicity.CharacterModel)
    full.logs, full.spread = model.logs, {letter: 1e9 for letter in model.spread}
    assert [model.decode(s) for s in spellings] == [full.decode(s) for s in spellings]


def test_plain_words_are_left_alone(toxic_model):
    for word in ("hello", "Straße", "don't", "3.14", "2024", "***", "a", "élan"):
        assert toxic_model.characters.restore(word) == word.lower().strip("*")


def test_hidden_words_count_as_much(toxic_model, words, docs):
    base = words(25)
    rows = docs((1, base), (2, f"{base} idiot"), (3, f"{base} 1d10t"), (4, f"{base} i d i o t {base}"), (5, None), (6, ""))
    score = {r.doc_id: r.s for r in rows.select("doc_id", toxicity.score_column(toxic_model, F.col("text")).alias("s")).collect()}
    assert score[1] < 0.5 and min(score[2], score[3], score[4]) > 0.5
    assert score[5] == score[6] <= score[1]


def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")


def test_scores_of_odd_rows(spark, odd, no_docs, toxic_model, words):
    quality = quality_classifier.train([words(30), "*** ###", words(10)], [1, 0, 1])
    for column in (quality_classifier.score_column(quality, F.col("text")), toxicity.score_column(toxic_model, F.col("text"))):
        rows = odd.select("doc_id", column.alias("s")).collect()
        assert len(rows) == 11 and all(0 <= r.s <= 1 for r in rows)
        by = {r.doc_id: r.s for r in rows}
        assert by[1] == by[2] == by[3] and by[5] == by[6]
        assert no_docs.select(column.alias("s")).count() == 0


def test_without_labels(spark, odd, no_docs):
    assert {r.s for r in odd.select(quality_classifier.score_column(
        quality_classifier.fit(odd, no_labels(spark)), F.col("text")).alias("s")).collect()} == {0.5}
    assert {r.s for r in odd.select(toxicity.score_column(
        toxicity.fit(odd, no_labels(spark)), F.col("text")).alias("s")).collect()} == {0.0}
    found = language.identify(odd, language.fit(no_docs)).collect()
    assert {(r.lang_pred, r.score) for r in found} == {("und", 0.0)}


def test_language_of_odd_rows(odd):
    rows = language.identify(odd, language.fit(odd)).select("row.doc_id", "row.score", "lang_pred", F.col("score").alias("s"))
    by = {r.doc_id: r for r in rows.collect() if r.doc_id is not None}
    assert [by[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and by[1].s == 0
    assert by[4].lang_pred != "und" and all(0 <= r.s <= 1 for r in by.values())


def test_languages_outside_the_families_stand_alone(words):
    model = language.train(list(map(language.shares, ["ab ba ab", "xy yx xy", "ab ba", "xy yx"])), ["q1", "q2", "q1", "q2"])
    assert model.families == ["q1", "q2"] and model.pairs == []


def test_samples_hold_repeated_rows_once(spark, docs, words):
    """What comes to the driver is bounded by the sample, however often a row is repeated."""
    many = docs(*[(n, words(20), "en" if n % 2 else "de", None) for n in range(50)])
    crowd = many.unionByName(many.where("doc_id = 1").crossJoin(spark.range(20_000)).drop("id"))
    labels = many.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS quality").unionByName(
        many.where("doc_id = 1").crossJoin(spark.range(20_000)).selectExpr("doc_id", "1 AS quality"))
    once = language.sample(many, 1200, 200, 24_000).count()
    assert language.sample(crowd, 10**6, 200, 10**6).count() == once > 20
    assert len(quality_classifier.labelled(crowd, labels, "quality", 5, 10**6)) <= 50
    assert quality_classifier.labelled(many, labels, "quality", 5, 10**6, most_chars=5) == []


def test_texts_of_languages_not_learned_are_not_typical(spark, docs):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(table)
    own = language.identify(table, model).where("lang_pred <> 'und'")
    assert own.where("NOT typical").count() <= 0.005 * own.count()
    rng = random.Random(3)
    odd = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(600)),
           "широкая электрификация южных губерний даст мощный толчок подъёму сельского хозяйства " * 6,
           "いろはにほへと ちりぬるを わかよたれそ つねならむ うゐのおくやま けふこえて " * 6]
    found = language.identify(docs(*enumerate(odd)), model).collect()
    assert not any(r.typical for r in found)


def test_toxicity_learns_from_every_labelled_document(spark, words, docs):
    """More documents than a sample of 6,000 held, and one of more than 200,000 characters: all are counted, each once."""
    rows = [(n, f"{words(3)} {'idiot' if n % 10 == 0 else words(1)}") for n in range(9000)] + [(9001, f"{words(90_000)} idiot")]
    table = docs(*rows).unionByName(docs(*rows[:50]))
    labels = spark.createDataFrame([(n, int(n % 10 == 0 or n == 9001)) for n, _ in rows for _ in range(2)], "doc_id bigint, toxic int")
    used = [(n, t) for n, t in rows if zlib.crc32(str(n).encode()) % 5]
    assert len(used) > 7000 and used[-1][0] == 9001 and len(used[-1][1]) > 200_000
    found, whole = toxicity.fit(table, labels), toxicity.train([t for _, t in used], [int(n % 10 == 0 or n == 9001) for n, _ in used])
    assert found.characters.logs == whole.characters.logs and (found.odds == whole.odds).all()
    assert found.levels == whole.levels and found.strongest == whole.strongest
    assert found.weights == pytest.approx(whole.weights, rel=1e-6, abs=1e-9)


def test_runs_that_are_not_decoded_hold_no_word(certain_model, monkeypatch):
    pool = ["the", "to", "it", "stu", "pid", "idi", "ots", "wor", "thl", "ess", "wort", "hless", "tth", "sstu", "lala", "id", "is"]
    rng, skipped = random.Random(1), 0
    for _ in range(2000):
        run = [w.encode() for w in rng.choices(pool, k=rng.randrange(2, 6))]
        certain_model.met.clear()
        found = certain_model.joined(run)
        skipped += not certain_model.may_join([w.decode() for w in run])
        with monkeypatch.context() as all_decoded:
            all_decoded.setattr(toxicity.Scorer, "may_join", lambda self, pieces: True)
            certain_model.met.clear()
            assert certain_model.joined(run) == found, run
    assert skipped > 200


def test_texts_are_dealt_out_the_same_way_at_every_size(spark, words, docs):
    """With few labels the join was a broadcast and shuffled the texts of labelled documents only, with many it was not."""
    labels = spark.createDataFrame([(n, n % 2) for n in range(20)], "doc_id bigint, toxic int")
    rows = toxicity.training(docs(*((n % 25, words(5)) for n in range(50))), labels)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and plan.count("Exchange hashpartitioning(doc_id") == 3
    assert all("text#" not in keys.split(")")[0] for keys in plan.split("hashpartitioning(")[1:])


def test_figures_of_many_words_are_those_of_each(certain_model):
    rng = random.Random(2)
    odd = {"".join(rng.choices("aábeélliiosstt$!|(+1034.-,“”’ßÉİΣµñйЖ中ªº²_µllooee", k=rng.randrange(1, 9))) for _ in range(4000)}
    odd |= {"a" * 70, "ab" * 40, "$$$", "!!!", "(Stu", "pid!", "idi", "oottaaeerr", "Straße", "ΑΣ", "e\u0301e"}
    raw = sorted(w.encode() for w in odd if w.split() == [w])
    model, found = certain_model, certain_model.word_figures(raw)
    plain = [toxicity.bare(w.decode()) for w in raw]
    assert found[:, 0].tolist() == [np.float32(model.evidence(model.characters.restore(p))) for p in plain]
    assert found[:, -1].tolist() == [toxicity.piece_kind(p, model.parts) for p in plain]
    buckets = toxicity.Learner(model.characters).buckets(raw)
    for row, p in zip(buckets.tolist(), plain):
        assert sorted(set(row) - {toxicity.BUCKETS}) == sorted(set(toxicity.features(model.characters.restore(p))))


def test_one_of_two_equal_letters_is_left_out_as_by_decoding(certain_model):
    rng = random.Random(3)
    for _ in range(3000):
        word = "".join(rng.choice("iiddoottssttuuppiidlmée") * rng.choice((1, 1, 2)) for _ in range(rng.randrange(2, 9)))
        if toxicity.DOUBLED.search(word) and not toxicity.TRIPLED.search(word):
            assert certain_model.characters.undoubled(word) == certain_model.characters.decode(word)


def test_runs_that_can_change_no_score_are_not_decoded(certain_model, monkeypatch):
    rng, model = random.Random(4), certain_model
    pool = ["the", "to", "it", "of", "de", "la", "en", "ne", "is", "s.", "to,", "a", "é", "ti", "lo", "stu", "pid", "idi", "ot", "st", "up", "id"]
    texts = [" ".join(rng.choices(pool[:15] if n % 2 else pool, k=rng.randrange(2, 12))) for n in range(600)]
    decoded, decode = [], model.characters.decode
    monkeypatch.setattr(model.characters, "decode", lambda x: decoded.append(x) or decode(x))
    some = model.scores(texts, toxicity.WordTable(model.word_figures))
    few = len(decoded)
    model.met.clear()
    monkeypatch.setattr(model, "most", lambda words: float("inf"))
    every = model.scores(texts, toxicity.WordTable(model.word_figures))
    assert some.tolist() == every.tolist() and len(set(some.tolist())) > 3
    assert few < (len(decoded) - few) / 2


def test_words_in_arrow_are_those_of_python():
    texts = [None, "", "  a b\t\na ", "\x1fx\x0by\x0c z", "é\u00a0é \u2003 b", "   ", "b"]
    found = Words(texts)
    assert [[found.distinct[k] for k in found.codes[a:b]] for a, b in zip(found.starts, found.starts[1:])] == list(map(split_words, texts))
    assert len(set(found.distinct)) == len(found.distinct)
    assert Words(pa.array(texts).slice(2, 3)).starts.tolist() == [0, 3, 6, 9]
