"""Language ID by hierarchical discrimination.

First a linear support vector machine per family (one against the rest) picks the language family, then one-versus-one
linear support vector machines vote between the languages of that family. Features are the shares of hashed character
n-grams of lower-cased words; all machines are linear in them, so a word's share is computed once per worker. They are
trained by stochastic gradient descent on the hinge loss, on at most about `per_language` documents a language and `most_rows`
in all (rarer languages are used whole); executors count their n-grams, and only the counts come to the driver.

Beside the prediction stands whether a text is `typical` of the predicted language: the mean log-probability of its n-grams
in that language is compared with that of the documents learned from, with room for `SPREADS` of their standard deviations
and for what a text of few n-grams varies by chance. Texts in languages that were not learned, or of random letters, are far
below; a filter may reject them.

Defined results: `und` with score 0 for a NULL text, a text without letters, or when nothing could be learned; a language
that `FAMILIES` does not name is a family of its own; equal votes go to the language first in order; repeated rows are
predicted each; further columns are kept. Languages beyond the `max_languages` most frequent are not learned.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktempo.llm.common import (
    WordTable, boxed, is_remainder, ngram_buckets, sampled, split_words, struct_array, sums, text_udf,
)

BUCKETS = 1 << 12
ORDERS = (1, 2, 3)
#: Standard deviations below the mean at which a text is no longer typical; share of probability spread over all buckets.
SPREADS, SMOOTHED = 8.0, 0.02

#: Families of languages; fixed values.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "pl": "slavic", "cs": "slavic", "sk": "slavic", "ru": "slavic", "uk": "slavic", "bg": "slavic",
}


def letters(words: list[bytes]) -> list[str]:
    return ["".join(filter(str.isalpha, w.decode("utf-8", "replace").lower())) for w in words]


def counts(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and owners of the n-grams of words that have letters."""
    kept = [i for i, w in enumerate(words) if w]
    ids, owner = ngram_buckets([words[i] for i in kept], ORDERS, BUCKETS)
    return ids, np.asarray(kept, np.int64)[owner] if kept else owner


def hinge(x: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 32, keep: float = 1e-4,
          seed: int = 3) -> tuple[np.ndarray, float]:
    """Linear support vector machine; y is 1 or -1. Both classes weigh the same; the averaged weights are returned."""
    rng = np.random.default_rng(seed)
    w, b, mean_w, mean_b, seen = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0, 0
    share = np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-9), 0.5 / max((y < 0).mean(), 1e-9))
    for epoch in range(epochs):
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
            rate = 0.5 / (1 + epoch)
            wrong = part[y[part] * (x[part] @ w + b) < 1]
            g = share[wrong] * y[wrong]
            w += rate * (g @ x[wrong] / len(part) - keep * w)
            b += rate * 0.1 * g.sum() / len(part)
            if epoch >= epochs // 2:
                seen += 1
                mean_w += (w - mean_w) / seen
                mean_b += (b - mean_b) / seen
    return mean_w, mean_b


class Hierarchy:
    """Machines as columns of `weights`: one per family, then one per pair of languages of a family; behind them the
    log-probabilities of the n-grams per language. `usual`: mean, standard deviation over documents and over n-grams."""

    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray, families: list[str],
                 pairs: list[tuple[int, int]], usual: np.ndarray):
        self.languages, self.weights, self.bias, self.families, self.pairs = languages, weights, bias, families, pairs
        self.usual = usual
        self.family_of = [families.index(family(l)) for l in languages]

    def word_figures(self, words: list[bytes]) -> np.ndarray:
        ids, owner = counts(letters(words))
        out = np.zeros((len(words), self.weights.shape[1] + 1), np.float32)
        for k in range(self.weights.shape[1]):
            out[:, k] = np.bincount(owner, self.weights[ids, k], len(words))
        out[:, -1] = np.bincount(owner, minlength=len(words))
        return out

    def predict(self, texts: list[str | None], words: WordTable) -> tuple[list[str], np.ndarray, np.ndarray]:
        values, starts = words.rows([split_words(t) for t in texts])
        total = sums(values, starts)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        machines, grams = len(self.bias), np.maximum(total[:, -1], 1)
        margin = total[:, :machines] / grams[:, None] + self.bias
        n = len(self.families)
        wins = np.exp(2 * np.clip(margin[:, :n], -20, 20))
        wins /= wins.sum(axis=1, keepdims=True)
        votes, rounds = np.zeros((len(texts), len(self.languages))), np.zeros(len(self.languages))
        for (a, b), m in zip(self.pairs, margin[:, n:].T):
            p = 1 / (1 + np.exp(-2 * np.clip(m, -20, 20)))
            votes[:, a] += p
            votes[:, b] += 1 - p
            rounds[[a, b]] += 1
        votes = np.where(rounds > 0, votes / np.maximum(rounds, 1), 1.0)
        inside = np.asarray(self.family_of) == wins.argmax(axis=1)[:, None]
        best = np.where(inside, votes, -1).argmax(axis=1)
        at = np.arange(len(texts))
        score = wins[at, np.asarray(self.family_of)[best]] * votes[at, best]
        empty = total[:, -1] == 0
        mean, over_documents, over_grams = self.usual[best].T
        least = mean - SPREADS * (over_documents + over_grams / np.sqrt(grams))
        typical = ~empty & (total[at, machines + best] / grams >= least)
        return [("und" if e else self.languages[i]) for i, e in zip(best, empty)], np.where(empty, 0.0, score), typical


def family(language: str) -> str:
    return FAMILIES.get(language, language)


def shares(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's n-grams and the share of each."""
    ids, _ = counts(letters(split_words(text)))
    buckets, times = np.unique(ids, return_counts=True)
    return buckets.astype(np.int32), times / max(len(ids), 1)


def likely(x: np.ndarray, codes: np.ndarray, languages: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-probabilities of the buckets per language, and how they vary: mean, over documents, over n-grams."""
    logs, usual = np.zeros((x.shape[1], languages)), np.zeros((languages, 3))
    for k in range(languages):
        mine = x[codes == k].astype(np.float64)
        share = mine.mean(axis=0)
        log = np.log((1 - SMOOTHED) * share + SMOOTHED / x.shape[1])
        means = mine @ log
        usual[k] = means.mean(), means.std(), np.sqrt(np.maximum(share @ log ** 2 - (share @ log) ** 2, 0))
        logs[:, k] = log
    return logs, usual


def train(rows: list[tuple[np.ndarray, np.ndarray]], languages: list[str]) -> Hierarchy:
    """Machines from the `shares` of documents and their languages."""
    known = sorted(set(languages))
    if not known:
        return Hierarchy([], np.zeros((BUCKETS, 0)), np.zeros(0), [], [], np.zeros((0, 3)))
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for at, (buckets, part) in enumerate(rows):
        x[at, buckets] = part
    codes = np.asarray([known.index(l) for l in languages])
    logs, usual = likely(x, codes, len(known))
    scale = 1 / (x.std(axis=0) + 1e-4) / np.sqrt(BUCKETS)
    x *= scale.astype(np.float32)
    families = sorted({family(l) for l in known})
    of = np.asarray([families.index(family(l)) for l in known])
    weights, bias = [], []
    for f in range(len(families)):
        y = np.where(of[codes] == f, 1, -1)
        w, b = hinge(x, y) if len(families) > 1 else (np.zeros(BUCKETS), 0.0)
        weights.append(w)
        bias.append(b)
    pairs = [(a, b) for a, b in combinations(range(len(known)), 2) if of[a] == of[b]]
    for a, b in pairs:
        mine = (codes == a) | (codes == b)
        w, c = hinge(x[mine], np.where(codes[mine] == a, 1, -1))
        weights.append(w)
        bias.append(c)
    columns = np.concatenate([np.stack(weights, axis=1) * scale[:, None], logs], axis=1)
    return Hierarchy(known, columns, np.asarray(bias), families, pairs, usual)


def shares_column(text: Column) -> Column:
    """Binary: the buckets of a text's n-grams as 16-bit and their shares as 32-bit numbers, one behind the other."""
    def packed(text: str) -> bytes:
        buckets, part = shares(text)
        return buckets.astype("<u2").tobytes() + part.astype("<f4").tobytes()

    def make():
        return lambda texts: pa.array(list(map(packed, texts)), pa.binary())

    return text_udf(make, "binary")(text)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 6
    return np.frombuffer(data, "<u2", n).astype(np.int64), np.frombuffer(data, "<f4", n, 2 * n)


def sample(docs: DataFrame, per_language: int, max_languages: int, most_rows: int) -> DataFrame:
    """doc_id, text and lang of the documents to learn from, each once."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
                        & ~is_remainder("doc_id", 4, 2)).select("doc_id", "text", "lang")
    sizes = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()
    each = min(per_language, most_rows // max(len(sizes), 1))
    wanted = F.lit(False)
    for row in sizes:
        wanted = wanted | ((F.col("lang") == row["lang"]) & sampled(F.col("doc_id"), row["count"], each))
    return usable.where(wanted).distinct()


def fit(docs: DataFrame, per_language: int = 1200, max_languages: int = 200, most_rows: int = 24_000) -> Hierarchy:
    """Learn from text and lang of documents whose crc32(doc_id) mod 4 is not 2."""
    chosen = sample(docs, per_language, max_languages, most_rows)
    found = chosen.select("doc_id", F.xxhash64("text").alias("hash"), "lang", shares_column(F.col("text")).alias("s")).collect()
    found.sort(key=lambda r: (r.doc_id, r.hash, r.lang))
    return train([unpacked(bytes(r.s)) for r in found], [r.lang for r in found])


def predict_column(model: Hierarchy, text: Column) -> Column:
    """Struct of lang_pred, score (0 to 1) and typical."""
    def make():
        words = WordTable(model.word_figures)

        def each(texts):
            found, score, typical = model.predict(texts, words)
            return struct_array(lang_pred=pa.array(found, pa.string()), score=pa.array(score, pa.float64()),
                                typical=pa.array(typical, pa.bool_()))

        return each

    return text_udf(make, "struct<lang_pred:string,score:double,typical:boolean>")(text)


def identify(docs: DataFrame, model: Hierarchy) -> DataFrame:
    """Every row of docs as struct `row`, with lang_pred, score and typical."""
    found = boxed(docs).withColumn("found", predict_column(model, F.col("row.text")))
    return found.select("row", "found.lang_pred", "found.score", "found.typical")
