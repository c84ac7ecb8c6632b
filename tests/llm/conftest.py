from __future__ import annotations

import random

import pytest

#: Columns beside those of documents whose names the operators use themselves.
CLASHING = ["row", "fp", "root", "found", "score", "lang_pred", "figures", "kept", "leaks", "n_words", "count", "part", "hash",
            "class", "number", "label", "u", "query", "host", "path", "rule"]


@pytest.fixture
def docs(spark):
    """documents from (doc_id, text) or (doc_id, text, lang, source), with clashing columns on request."""
    def build(*rows, clash=False):
        full = [(*r, *[None] * (4 - len(r)), None if r[1] is None else len(r[1])) for r in rows]
        kind = "doc_id bigint, text string, lang string, source string, n_chars bigint"
        if clash:
            full = [(*r, *["x"] * len(CLASHING)) for r in full]
            kind += "".join(f", `{c}` string" for c in CLASHING)
        return spark.createDataFrame(full, kind)

    return build


@pytest.fixture(scope="session")
def words():
    """A generator of made-up sentences, the same in every run."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4)))
                  for _ in range(600)]

    def make(n: int) -> str:
        return " ".join(rng.choices(vocabulary, k=n))

    return make


@pytest.fixture
def odd(docs, words):
    """NULLs in every column, empty and blank texts, a very long one, ties and repeated rows."""
    text = words(40)
    return docs((1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, words(30_000), "en", None),
                (5, text, "de", "a"), (5, text, "de", "a"), (6, text, "de", "b"), (None, words(30), "en", "a"),
                (None, None, None, None), (7, "x" * 50_000, "en", "a"), (8, "á é \U0001F600 ß", "fr", "a"), clash=True)


@pytest.fixture
def no_docs(docs, spark):
    return docs((1, "x")).where("false")
