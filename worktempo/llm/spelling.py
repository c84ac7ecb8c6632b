"""Spelling variants by blocked Gram matrices.

Words are counted over all documents. The letter counts of a word are a vector; one inserted or deleted letter moves it by a
squared distance of 1, one replaced letter by at most 2. A matrix product of the vectors of two blocks gives all squared
distances between them at once (|a|^2 + |b|^2 - 2ab); pairs at most two apart in blocks of equal or adjacent length are kept
and their letters compared.

A length block is cut further by how many letters of each of `GROUPS` letter groups a word has: an insertion adds one to one
group, a replacement moves at most one from a group to another, so a block meets at most 1 + GROUPS (GROUPS + 1) / 2 others
and the products stay far below all pairs of words. A block of many words is cut into tiles of about `TILE_CHARS` letters;
every pair of tiles is a row of its own, so a hot block spreads over tasks and none holds more than two tiles. A task returns
for each word of its tiles the number of near words and the best of them, not the pairs.

A word's form is its near word of largest n (ties: smallest in code-point order) if that n is at least `ratio` times its own;
its root is the end of the chain of forms. n grows by `ratio` at each step, so log2 of the longest possible chain rounds of
pointer doubling reach it.

Before counting, a rule damages some words the same way in every run (`damaged_every`): where it divides the CRC-32 of
`<doc_id>:<run>`, one letter goes. CRC-32 is affine, so the CRC of a run behind any document's prefix is the run's own CRC
and a term that depends on the prefix and the run's length only: no run is hashed twice in a task.

Defined results: a NULL or empty text has no words; a NULL doc_id is written as nothing before the colon; words are compared
by code point, only A-Z are lower-cased; repeated rows count each; further columns are ignored; no words give no rows. A word
of any length is compared whole.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktempo.llm.common import cut, slices

LETTERS = "".join(map(chr, [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]))
GROUPS, TILE_CHARS, DIMENSIONS = 6, 6000, 32
#: Words a task remembers before it hands its counts on.
REMEMBERED = 400_000


def lowered(run: str) -> str:
    """Only A-Z become small: bytes know ASCII letters alone."""
    return run.encode("latin-1").lower().decode("latin-1")


class Tally:
    """Counts of the words of one task. Every run seen has a number; per number its CRC, its lengths and its count."""

    def __init__(self, least: int, damaged_every: int):
        self.runs = re.compile(f"[A-Za-zÀ-ÿ]{{{least},}}").findall
        self.least, self.every = least, damaged_every
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.words: list[str] = []
        self.figures = np.zeros((0, 2), np.int64)
        self.counts = np.zeros(0, np.int64)
        self.damaged: Counter[str] = Counter()

    def number(self, found: list[str]) -> np.ndarray:
        numbers, words, fresh = self.numbers, self.words, len(self.words)
        out = np.empty(len(found), np.int64)
        for k, run in enumerate(found):
            at = numbers.get(run)
            if at is None:
                at = numbers[run] = len(words)
                words.append(lowered(run))
            out[k] = at
        if len(words) > fresh:
            raw = [w.encode() for w in words[fresh:]]
            made = np.array([(zlib.crc32(r), len(r)) for r in raw], np.int64)
            self.figures = np.concatenate([self.figures, made])
            self.counts = np.concatenate([self.counts, np.zeros(len(raw), np.int64)])
        return out

    def add(self, ids: list[str | None], texts: list[str | None]) -> None:
        found = [self.runs(t) if t else [] for t in texts]
        numbers = self.number([run for runs in found for run in runs])
        lengths = self.figures[numbers, 1]
        shift, at = np.zeros(len(numbers), np.int64), 0
        for doc_id, runs in zip(ids, found):
            if runs:
                mine = lengths[at:at + len(runs)]
                each, where = np.unique(mine, return_inverse=True)
                prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                terms = [zlib.crc32(bytes(n), prefix) ^ zlib.crc32(bytes(n)) for n in each.tolist()]
                shift[at:at + len(runs)] = np.array(terms, np.int64)[where.ravel()]
                at += len(runs)
        crc = self.figures[numbers, 0] ^ shift
        hit = crc % self.every == 0
        self.counts += np.bincount(numbers[~hit], minlength=len(self.counts))
        for at, h in zip(numbers[hit].tolist(), crc[hit].tolist()):
            word = self.words[at]
            gone = h % len(word)
            if len(word) > self.least:
                self.damaged[word[:gone] + word[gone + 1:]] += 1

    def take(self) -> pa.RecordBatch:
        """Counts so far; begins anew."""
        used = np.flatnonzero(self.counts)
        words = [self.words[k] for k in used] + list(self.damaged)
        n = np.concatenate([self.counts[used], np.fromiter(self.damaged.values(), np.int64, len(self.damaged))])
        self.clear()
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], ["word", "n"])


def word_counts(docs: DataFrame, least: int = 7, damaged_every: int = 31) -> DataFrame:
    """(word, n) of every word of at least `least` letters, after the damage. Tasks hand on sums, not occurrences."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(least, damaged_every)
        for batch in batches:
            for part in slices(batch):
                tally.add(part.column(0).to_pylist(), part.column(1).to_pylist())
                if len(tally.words) > REMEMBERED:
                    yield tally.take()
        yield tally.take()

    parts = docs.select(F.col("doc_id").cast("string").alias("id"), "text").mapInArrow(run, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def block_key(word: Column, groups: int = GROUPS) -> Column:
    """How many letters of each group the word has; their sum is its length."""
    sets = ["".join(c for c in LETTERS if ord(c) % groups == g) for g in range(groups)]
    return F.array(*(F.length(word) - F.length(F.translate(word, s, "")) for s in sets))


def steps(groups: int = GROUPS) -> list[list[int]]:
    """From a block to those that hold its words' near words, each pair of blocks from one side only."""
    unit = np.eye(groups, dtype=int)
    moved = [unit[g] - unit[h] for g in range(groups) for h in range(g + 1, groups)]
    return [[0] * groups, *unit.tolist(), *(m.tolist() for m in moved)]


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """Letter counts of words of one length (rows of code points): a-z apart, all others folded into the rest. Folding
    makes distances smaller only, so no near pair is lost."""
    small = (codes >= 97) & (codes < 123)
    dimension = np.where(small, codes - 97, 26 + codes % (DIMENSIONS - 26)).astype(np.int64)
    rows = np.arange(len(codes))[:, None] * DIMENSIONS
    return np.bincount((rows + dimension).ravel(), minlength=len(codes) * DIMENSIONS).reshape(-1, DIMENSIONS).astype(np.float64)


def candidates(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of all pairs of the two blocks whose letter counts are at most two apart, from one matrix product."""
    x, y = letter_counts(a), letter_counts(b)
    squared = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
    return np.nonzero(squared <= 2)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row: is b that word with one letter replaced, or one inserted where b is longer by one?"""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    n = a.shape[1]
    same = np.concatenate([a == b[:, :n], np.zeros((len(a), 1), bool)], axis=1)
    tail = np.concatenate([(a == b[:, 1:])[:, ::-1], np.zeros((len(a), 1), bool)], axis=1)
    return (~same).argmax(1) + (~tail).argmax(1) >= n


def near_words(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of near words of two tiles; within one tile each pair once."""
    i, j = candidates(a, b)
    if same:
        i, j = i[i < j], j[i < j]
    room = max(1, (1 << 22) // b.shape[1])
    good = [one_edit(a[i[k:k + room]], b[j[k:k + room]]) for k in range(0, len(i), room)]
    kept = np.concatenate(good) if good else np.zeros(0, bool)
    return i[kept], j[kept]


def bests(words: list[str], at: np.ndarray, others: list[str], other: np.ndarray, n: np.ndarray) -> Iterator[tuple]:
    """(word, near words, largest n among them, the first word with it) of every word with near words."""
    order = np.lexsort((other, at))
    at, other = at[order], other[order]
    edges = np.flatnonzero(np.diff(at, prepend=-1))
    for begin, end in zip(edges.tolist(), [*edges[1:].tolist(), len(at)]):
        mine = other[begin:end]
        most = n[mine].max()
        yield words[at[begin]], end - begin, int(most), min(others[k] for k in mine[n[mine] == most].tolist())


def codes_of(text: str, words: int) -> np.ndarray:
    return np.frombuffer(text.encode("latin-1"), np.uint8).reshape(words, -1)


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a_text, a_n, b_text, b_n, same) of tile pairs to rows (word, near, most, best)."""
    for batch in batches:
        for part in slices(batch, 32):
            found: list[tuple] = []
            for a_text, a_n, b_text, b_n, same in zip(*(c.to_pylist() for c in part.columns)):
                a, b = codes_of(a_text, len(a_n)), codes_of(b_text, len(b_n))
                i, j = near_words(a, b, same)
                if len(i):
                    p, q = a.shape[1], b.shape[1]
                    firsts = [a_text[k:k + p] for k in range(0, len(a_text), p)]
                    seconds = [b_text[k:k + q] for k in range(0, len(b_text), q)]
                    found.extend(bests(firsts, i, seconds, j, np.array(b_n, np.int64)))
                    found.extend(bests(seconds, j, firsts, i, np.array(a_n, np.int64)))
            columns = list(zip(*found)) or [(), (), (), ()]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             ["word", "near", "most", "best"])


def near(words: DataFrame, groups: int = GROUPS, tile_chars: int = TILE_CHARS) -> DataFrame:
    """(word, n_near, most, best) of every word of `words` (word, n: each once) that has near words."""
    keyed = words.withColumn("key", block_key(F.col("word"), groups))
    room = F.greatest(F.lit(1.0), F.lit(float(tile_chars)) / F.aggregate("key", F.lit(0), lambda s, x: s + x))
    sizes = keyed.groupBy("key").count().select("key", F.ceil(F.col("count") / room).cast("int").alias("tiles"))
    dealt = keyed.join(sizes, "key").withColumn("tile", F.pmod(F.xxhash64("word"), "tiles").cast("int"))
    tiles = cut(dealt.groupBy("key", "tile").agg(F.collect_list(F.struct("word", "n")).alias("w"))
                .select("key", "tile", F.array_join("w.word", "").alias("text"), F.col("w.n").alias("n")))
    names = tiles.select("key", "tile")
    offsets = F.array(*(F.array(*map(F.lit, s)) for s in steps(groups)))
    meetings = (names.withColumn("step", F.explode(offsets))
                .select("key", "tile", F.zip_with("key", "step", lambda x, y: x + y).alias("other")))
    pairs = (meetings.join(names.select(F.col("key").alias("other"), F.col("tile").alias("other_tile")), "other")
             .withColumn("same_block", F.col("key") == F.col("other"))
             .where(~F.col("same_block") | (F.col("tile") <= F.col("other_tile"))))
    first = tiles.select("key", "tile", F.col("text").alias("a_text"), F.col("n").alias("a_n"))
    second = tiles.select(F.col("key").alias("other"), F.col("tile").alias("other_tile"),
                          F.col("text").alias("b_text"), F.col("n").alias("b_n"))
    ordered = (pairs.join(first, ["key", "tile"]).join(second, ["other", "other_tile"])
               .select("a_text", "a_n", "b_text", "b_n",
                       (F.col("same_block") & (F.col("tile") == F.col("other_tile"))).alias("same")))
    found = ordered.mapInArrow(compared, "word string, near bigint, most bigint, best string")
    top = F.min(F.struct((-F.col("most")).alias("most"), "best"))
    return (found.groupBy("word").agg(F.sum("near").alias("n_near"), top.alias("top"))
            .select("word", "n_near", (-F.col("top.most")).alias("most"), F.col("top.best").alias("best")))


def rooted(forms: DataFrame, most: int, ratio: int) -> DataFrame:
    """(word, root) of every word that has a form, from (word, form); the n of no word exceeds `most`."""
    hops = max(1, math.floor(math.log(max(most, 2)) / math.log(ratio)))
    ends = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(1, math.ceil(math.log2(hops + 1)))):
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ends = cut(ends.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return ends


def grouped(docs: DataFrame, least: int = 7, occurrences: int = 2, ratio: int = 10, damaged_every: int = 31,
            groups: int = GROUPS, tile_chars: int = TILE_CHARS) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of at least `least` letters and `occurrences` in all."""
    words = cut(word_counts(docs, least, damaged_every).where(F.col("n") >= occurrences))
    has_form = F.col("most") >= ratio * F.col("n")
    known = cut(words.join(near(words, groups, tile_chars), "word", "left")
                .select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                        F.when(has_form, F.col("best")).alias("form"), F.when(has_form, F.col("most")).alias("form_n")))
    top = known.agg(F.max("n")).first()[0] or 0
    roots = rooted(known.where(F.col("form").isNotNull()).select("word", "form"), top, ratio)
    return (known.join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
