"""Spelling variants against comparing every word with every other."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from worktempo.llm import spelling
from worktempo.llm.queries import op11_spelling_variants

DATA = "/root/testdata/sf0.001"


def plain_counts(rows, least, every):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % every == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            if len(word) >= least:
                counts[word] += 1
    return counts


def plain_near(words):
    """Near words by deletion: equal after taking out one letter at the same place, or one word is the other less a letter."""
    known, holes = set(words), {}
    near = {w: set() for w in words}
    for w in words:
        for k in range(len(w)):
            holes.setdefault((w[:k], w[k + 1:]), set()).add(w)
            shorter = w[:k] + w[k + 1:]
            if shorter in known:
                near[w].add(shorter)
                near[shorter].add(w)
    for same in holes.values():
        for w in same:
            near[w] |= same - {w}
    return near


def plain(rows, least=7, occurrences=2, ratio=10, every=31):
    n = {w: c for w, c in plain_counts(rows, least, every).items() if c >= occurrences}
    near = plain_near(n)
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= ratio * n[w]:
                form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def found(df):
    return [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()]


@pytest.fixture(scope="module")
def family():
    """Documents of words that differ by single letters, some far more frequent than others."""
    rng = random.Random(3)
    bases = ["".join(rng.choices("abcdeéß", k=rng.randrange(7, 11))) for _ in range(12)]
    pool = []
    for base in bases:
        pool += [base] * 1200
        for _ in range(25):
            k = rng.randrange(len(base))
            other = rng.choice([base[:k] + base[k + 1:], base[:k] + rng.choice("abxÿ") + base[k:],
                                base[:k] + rng.choice("abxÿ") + base[k + 1:]])
            pool += [other] * rng.choice([1, 2, 3, 30, 60])
            pool += [other[:-1] + rng.choice("qz")] * rng.choice([1, 2, 3])
    rng.shuffle(pool)
    return [(k, " ".join(pool[k::40])) for k in range(40)]


def test_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    result = found(op11_spelling_variants(spark, DATA))
    assert len(result) == len(set(result))
    assert set(result) == plain(rows)
    assert any(r[1] for r in result)


@pytest.mark.parametrize("tile_chars", [40, spelling.TILE_CHARS])
def test_chains_of_forms_and_small_tiles(docs, family, tile_chars):
    result = found(spelling.grouped(docs(*family), ratio=2, damaged_every=7, tile_chars=tile_chars))
    expected = plain(family, ratio=2, every=7)
    assert set(result) == expected and len(result) == len(expected)
    assert any(form and form != root for _, form, root, *_ in expected)


@pytest.mark.parametrize("groups", [2, 8])
def test_number_of_groups_changes_nothing(docs, family, groups):
    assert set(found(spelling.grouped(docs(*family), groups=groups))) == plain(family)


def test_distances_come_from_the_product_of_letter_counts():
    a = spelling.codes_of("abcdefgabcdxyz", 2)
    b = spelling.codes_of("abcdefhzzzzzzzgfedcba", 3)
    i, j = spelling.candidates(a, b)
    assert set(zip(i.tolist(), j.tolist())) == {(0, 0), (0, 2)}
    i, j = spelling.near_words(a, b, False)
    assert set(zip(i.tolist(), j.tolist())) == {(0, 0)}


def test_one_edit_at_every_place():
    word = "aabbaab"
    longer = sorted({word[:k] + c + word[k:] for k in range(8) for c in "abz"})
    a = np.repeat(spelling.codes_of(word, 1), len(longer), axis=0)
    assert spelling.one_edit(a, spelling.codes_of("".join(longer), len(longer))).all()
    assert not spelling.one_edit(a[:1], spelling.codes_of("abababab", 1)).any()


def test_meeting_blocks_cover_every_edit(spark):
    steps = {tuple(s) for s in spelling.steps(3)}
    assert len(steps) == 1 + 3 + 3
    assert all((0, 0, 0) == s or tuple(-x for x in s) not in steps for s in steps)


def test_counts_forget_and_go_on(docs, family, monkeypatch):
    monkeypatch.setattr(spelling, "REMEMBERED", 5)
    result = {r.word: r.n for r in spelling.word_counts(docs(*family), 7, 31).collect()}
    assert result == plain_counts(family, 7, 31)


def test_odd_rows(docs):
    long = "ab" * 30_000
    rows = [(1, None), (2, ""), (3, f"{long} {long}"), (4, f"{long[:-1]}c {long[:-1]}c"), (5, "Straße-STRASSE ÄÖÜÄÖÜÄ"),
            (5, "Straße-STRASSE ÄÖÜÄÖÜÄ"), (None, "straßen straßen ×÷×÷×÷×"), (None, None),
            (6, "\U0001F600wordful\U0001F600wordfulĀwordfuls wordfuls")]
    result = found(spelling.grouped(docs(*rows, clash=True)))
    assert set(result) == plain(rows) and len(result) == len(set(result))


def test_no_rows_and_no_words(no_docs, docs):
    assert found(spelling.grouped(no_docs)) == []
    assert found(spelling.grouped(docs((1, "a few short ones"), (2, None)))) == []
