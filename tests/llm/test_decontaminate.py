"""Edit search against the plain dynamic programme, recall on edited passages, and defined results."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from worktempo.llm import decontaminate as d
from worktempo.llm import queries
from worktempo.llm.common import WordTable

DATA = Path("/root/testdata/sf0.01")


def plain_search(item, text):
    row = [0] * (len(text) + 1)
    for i, word in enumerate(item, 1):
        below = [i]
        for j, other in enumerate(text, 1):
            below.append(min(row[j] + 1, below[-1] + 1, row[j - 1] + (word != other)))
        row = below
    return min(row), row.index(min(row))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=70), st.lists(st.integers(0, 3), max_size=40))
def test_edit_search(item, text):
    assert d.edit_search(item, text) == plain_search(item, text)


def edited(rng, text, vocabulary, share):
    out = text.split()
    for _ in range(int(share * len(out))):
        at, kind = rng.randrange(len(out)), rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice(vocabulary)
        elif kind == 1:
            out.insert(at, rng.choice(vocabulary))
        else:
            del out[at]
    return " ".join(out)


@pytest.mark.parametrize("share, least", [(0.0, 1.0), (0.05, 0.995), (0.1, 0.99), (0.15, 0.97), (0.2, 0.95)])
def test_recall_on_edited_passages(words, share, least):
    """Against the verified truth: passages within the distance that the search misses count as misses."""
    rng, vocabulary = random.Random(4), words(3000).split()
    items = [(n, words(rng.randrange(14, 60))) for n in range(150)]
    index, table = d.Index(items, 0.8), WordTable(d.word_hashes)
    texts = [f"{words(40)} {edited(rng, text, vocabulary, share)} {words(40)}" for _, text in items]
    true = found = 0
    for (item_id, text), hits in zip(items, index.search(texts, table)):
        distance, _ = d.edit_search(text.split(), texts[item_id].split())
        if distance <= 0.2 * len(text.split()) + 1e-9:
            true += 1
            mine = [h for h in hits if h["item_id"] == item_id]
            found += bool(mine)
            assert all(h["distance"] >= distance for h in mine)
    assert true > 100 and found >= least * true


@pytest.mark.parametrize("n, edits", [(5, 1), (7, 1), (10, 2), (14, 2), (15, 3), (16, 3), (18, 3), (20, 4), (23, 4), (24, 4), (30, 6)])
def test_recall_by_item_length(words, n, edits):
    """As above, with edits up to the limit, for each length: short items have few windows."""
    rng, vocabulary = random.Random(n), words(3000).split()
    items = [(k, words(n)) for k in range(200)]
    texts = [f"{words(30)} {edited(rng, text, vocabulary, (edits + 0.5) / n)} {words(30)}" for _, text in items]
    found = []
    for (item_id, text), hits in zip(items, d.Index(items, 0.8).search(texts, WordTable(d.word_hashes))):
        if d.edit_search(text.split(), texts[item_id].split())[0] <= 0.2 * n + 1e-9:
            found.append(any(h["item_id"] == item_id for h in hits))
    assert len(found) > 150 and sum(found) >= 0.97 * len(found)


def test_short_items_and_other_spellings(docs, spark, words):
    item = words(7)
    bench = spark.createDataFrame([(1, item), (2, "four words are few"), (3, None), (4, ""), (5, item)], "item_id bigint, text string")
    loud = ", ".join(item.upper().split())
    rows = d.find_leaks(docs((1, f"{words(20)} {loud}! {words(20)}"), (2, words(50)), (3, "four words are few")), bench)
    assert sorted((r.doc_id, r.item_id, r.start_word, r.end_word, r.distance) for r in rows.collect()) == [
        (1, 1, 20, 27, 0), (1, 5, 20, 27, 0)]


def test_odd_rows_and_blocks(odd, no_docs, docs, spark, words):
    text = odd.where("doc_id = 6").first().text
    bench = spark.createDataFrame([(n, words(20)) for n in range(7)] + [(7, text)], "item_id bigint, text string")
    for block in (d.BLOCK_WORDS, 60):
        found = d.find_leaks(odd, bench, block_words=block)
        assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(5, 7), (5, 7), (6, 7)]
        clean = d.keep_clean(odd, bench, block_words=block)
        assert clean.columns == odd.columns and clean.count() == 8
    assert d.find_leaks(no_docs, bench).count() == 0
    assert d.keep_clean(odd, bench.where("false")).count() == 11


def test_words_of_equal_length_and_crc_are_two_words(docs, spark):
    bench = spark.createDataFrame([(1, "the plumless house stands alone here")], "item_id bigint, text string")
    (row,) = d.find_leaks(docs((1, "the buckeroo house stands alone here")), bench).collect()
    assert (row.distance, row.similarity) == (1, pytest.approx(5 / 6))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aBZ'.,!-_É é̀ΣσßİK\x1f\x7f"), max_size=8))
def test_normal_words(word):
    assert d.normal(word.encode()) == word.lower().encode().strip(d.PUNCTUATION)


def test_only_words_near_a_candidate_are_compared(words, monkeypatch):
    """Words whose hashes are known are made plain only where they may belong to a leak, each once."""
    items, table = [(1, words(20))], WordTable(d.word_hashes)
    index = d.Index(items, 0.8)
    texts = [" ".join([*(f"w{n}" for n in range(5000)), items[0][1].upper(), *(f"v{n}" for n in range(5000))])] * 3
    first = index.search(texts, table)
    calls = []
    monkeypatch.setattr(d, "normal", lambda word, normal=d.normal: calls.append(word) or normal(word))
    again = index.search(texts, table)
    assert again == first and all([(h["item_id"], h["start_word"], h["distance"]) for h in hits] == [(1, 5000, 0)] for hits in again)
    assert len(calls) == len(set(calls)) < 200


def brute_force(texts, items):
    """All pairs by the plain search over whole documents."""
    found = {}
    for doc_id, text in texts:
        for item_id, item in items:
            words, other = ([d.normal(w) for w in t.encode().split()] for t in (item, text))
            if len(words) >= d.MIN_WORDS:
                distance, _ = plain_search(words, other)
                if distance <= 0.2 * len(words) + 1e-9:
                    found[doc_id, item_id] = distance
    return found


def test_table_of_edited_passages_equals_brute_force(docs, spark, words):
    """Passages with edits up to and beyond the limit, at the edges and inside of documents, twice in some."""
    rng, vocabulary = random.Random(12), words(2000).split()
    items = [(n, words(rng.choice([5, 6, 8, 11, 15, 19, 24, 31, 45]))) for n in range(60)]
    texts = []
    for item_id, text in items:
        share = rng.choice([0, 0, 0.1, 0.2, 0.2, 0.3])
        passage = edited(rng, text, vocabulary, share)
        before, after = rng.choice([0, 1, 30]), rng.choice([0, 2, 30])
        texts.append((item_id, f"{words(before)} {passage} {words(after)} {passage if item_id % 5 == 0 else ''}"))
    want = brute_force(texts, items)
    found = d.find_leaks(docs(*texts), spark.createDataFrame(items, "item_id bigint, text string"))
    got = {(r.doc_id, r.item_id): r.distance for r in found.collect()}
    assert set(got) <= set(want) and all(got[k] == want[k] for k in got)
    assert len(got) >= 0.97 * len(want) and any(want.values())
    assert {k for k in want if want[k] == 0} <= set(got)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_whole_table_equals_brute_force(spark):
    """Every document against every item by the plain dynamic programme where any five words in a row agree."""
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    normal = {k: [d.normal(w) for w in t.encode().split()] for k, t in texts}
    want = {}
    for item_id, text in items:
        item = [d.normal(w) for w in text.encode().split()]
        grams = {tuple(item[i:i + 5]) for i in range(len(item) - 4)}
        for doc_id, other in normal.items():
            if any(tuple(other[i:i + 5]) in grams for i in range(len(other) - 4)):
                distance, _ = d.edit_search(item, other)
                if distance <= 0.2 * len(item) + 1e-9:
                    want[doc_id, item_id] = distance
    got = {(r.doc_id, r.item_id): r.distance for r in queries.op2_decontaminate(spark, str(DATA)).collect()}
    assert got == want and want
