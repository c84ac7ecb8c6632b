"""Quality classifier: supervised subword embeddings.

Every word and every character n-gram of a word has a learned vector in a hashed table, and so has "the same word again"
(a word equal to the one before it); a document is the average of all its vectors, and a softmax on the average gives the classes. The table and the softmax are trained by stochastic gradient
descent in numpy on a bounded sample of labelled documents (`sample_rows`, the only bound). Scoring is linear up to the
softmax, so the table is folded into one figure per bucket and a word's share is computed once per worker.

Defined results: a NULL or empty text has no vectors and gets the score of the bias alone; repeated rows are scored each;
further columns are kept; without any usable label every score is 0.5; a label other than 0 or 1 is not used.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktempo.llm.common import (
    WordTable, is_remainder, ngram_buckets, repeats, sampled, split_words, sums, text_udf,
)

BUCKETS = 1 << 16
#: Row of the table for a word that repeats the one before it.
AGAIN = BUCKETS
ORDERS = (2, 3, 4)


def word_ids(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams and of the whole word, and the word each belongs to."""
    ids, owner = ngram_buckets([w.decode("utf-8", "replace") for w in words], ORDERS, BUCKETS)
    whole = np.fromiter((zlib.crc32(w) % BUCKETS for w in words), np.int64, len(words))
    return np.concatenate([ids, whole]), np.concatenate([owner, np.arange(len(words))])


class Embeddings:
    """`weights`: log-odds of label 1 per bucket; a document's log-odds are their mean plus `bias`."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def word_figures(self, words: list[bytes]) -> np.ndarray:
        ids, owner = word_ids(words)
        total = np.bincount(owner, self.weights[ids], len(words))
        return np.stack([total, np.bincount(owner, minlength=len(words))], axis=1)

    def scores(self, texts: list[str | None], words: WordTable) -> np.ndarray:
        values, starts = words.rows([split_words(t) for t in texts])
        total = sums(values, starts)
        again = repeats(words.index, starts)
        mean = (total[:, 0] + again * self.weights[AGAIN]) / np.maximum(total[:, 1] + again, 1)
        return 1 / (1 + np.exp(-np.clip(mean + self.bias, -30, 30)))


def train(texts: list[str], labels: list[int], dim: int = 12, epochs: int = 6, rate: float = 0.25,
          seed: int = 7) -> Embeddings:
    """Stochastic gradient descent, one document at a time, rate falling to zero."""
    known: dict[bytes, int] = {}
    documents = []
    lookup: list[np.ndarray] = []
    for text in texts:
        words = split_words(text)
        fresh = [w for w in dict.fromkeys(words) if w not in known]
        if fresh:
            ids, owner = word_ids(fresh)
            order = np.argsort(owner, kind="stable")
            lookup += np.split(ids[order].astype(np.int32), np.cumsum(np.bincount(owner, minlength=len(fresh)))[:-1])
            for w in fresh:
                known[w] = len(known)
        again = np.full(sum(a == b for a, b in zip(words, words[1:])), AGAIN)
        found = np.concatenate([again, *(lookup[known[w]] for w in words)]).astype(np.int64)
        ids, count = np.unique(found, return_counts=True)
        documents.append((ids, (count / max(count.sum(), 1)).astype(np.float32)))
    if len(set(labels)) < 2:
        return Embeddings(np.zeros(BUCKETS + 1), 0.0)
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dim, 1 / dim, (BUCKETS + 1, dim)).astype(np.float32)
    soft, bias = rng.normal(0, 0.1, (dim, 2)).astype(np.float32), np.zeros(2, np.float32)
    steps, done = epochs * len(documents), 0
    for _ in range(epochs):
        for at in rng.permutation(len(documents)):
            ids, weight = documents[at]
            step = rate * (1 - done / steps)
            done += 1
            hidden = weight @ table[ids]
            z = hidden @ soft + bias
            error = np.exp(z - z.max())
            error /= error.sum()
            error[labels[at]] -= 1
            back = soft @ error
            soft -= step * np.outer(hidden, error)
            bias -= 0.1 * step * error
            if len(ids):
                table[ids] -= (step / (weight @ weight)) * np.outer(weight, back)
    return Embeddings(table @ (soft[:, 1] - soft[:, 0]).astype(np.float64), float(bias[1] - bias[0]))


def labelled(docs: DataFrame, labels: DataFrame, name: str, held_out_of: int, sample_rows: int,
             most_chars: int = 200_000) -> list:
    """At most about `sample_rows` labelled (text, label) rows whose crc32(doc_id) mod `held_out_of` is not 0, none longer
    than `most_chars`.

    Labels are counted first; documents are then reduced to the sample before anything is joined, and repeated rows are
    taken out before anything is collected.
    """
    usable = labels.select("doc_id", F.col(name).alias("label")).where(
        F.col("label").isin(0, 1) & ~is_remainder("doc_id", held_out_of, 0) & F.col("doc_id").isNotNull()).distinct()
    chosen = sampled(F.col("doc_id"), usable.count(), sample_rows)
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull() & chosen & (F.length("text") <= most_chars))
    rows = texts.distinct().join(usable.where(chosen), "doc_id").select("doc_id", "text", "label").collect()
    return sorted({(r.doc_id, r.text, int(r.label)) for r in rows})


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000) -> Embeddings:
    rows = labelled(docs, labels, "quality", 5, sample_rows)
    return train([r[1] for r in rows], [r[2] for r in rows])


def score_column(model: Embeddings, text: Column) -> Column:
    """Score from 0 to 1, higher: label 1 likelier."""
    def make():
        words = WordTable(model.word_figures)
        return lambda texts: pa.array(model.scores(texts, words), pa.float64())

    return text_udf(make, "double")(text)
