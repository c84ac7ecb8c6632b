"""Benchmark decontamination by CGK embeddings and bit sampling.

The random walk of CGK reads a word, moves on or stays by a random bit of (step, word), and emits the word at each step: two
passages that differ by few word edits emit sequences that differ in few places, so edit distance becomes Hamming distance.
Bit sampling hashes `PICKED` of the emitted places, `REPEATS` times with other places; windows that share a hash with a
benchmark item are candidates. Item windows start every `STRIDE` words of an item (of fewer than two strides: at every word),
document windows at every word, so a
passage may begin anywhere and any well-kept stretch of it is enough. A walk that stays reads one word over and over: where
the sampled steps of an item window lie on fewer than `DISTINCT` words (two for items of fewer than two strides), the hash says
little and is left out, unless the item has too few others. Each candidate is then verified exactly: the smallest
word edit distance between the whole item and any passage of the document around the window (bit-parallel dynamic
programme over the words themselves, not their hashes). A leak has a similarity 1 - distance / words of the item of at least
`similarity` (0.8). Before that, a test that loses nothing: k edits cut n words into at most k + 1 untouched runs, so a window
without a run of the item's words of that length (of three at most are looked for) holds no leak.

Words are separated by ASCII white space and compared in lower case without punctuation at their edges. The benchmark is
the query set: it is taken in blocks of about `block_words` words, and each block is sent to all tasks (some 60 bytes a word;
more items mean more passes over the documents, not larger ones). Leaks are found
inside a document, so a passage in many documents makes no pairs among them.

An exact passage is always found: every fourth repetition samples so few steps that it cannot leave the shortest item.
Recall on passages with random word edits is measured in the tests (README).

Defined results: a NULL or empty text has no leaks; items of fewer than `MIN_WORDS` words (one five-word shingle) are no
evidence and match nothing; items with equal texts are all reported; repeated documents are searched each; one hit per
(document row, item): the smallest distance, the first place.
"""

from __future__ import annotations

import math
import string
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktempo.llm.common import Words, WordTable, boxed, split_words, text_udf, worker_state

MIN_WORDS, STRIDE, REPEATS = 5, 5, 12
#: Words that the sampled steps of an item window lie on at least; hashes an item keeps at least.
DISTINCT, ENOUGH = 3, 12
BLOCK_WORDS = 300_000
#: Walk length and places per hash, for items of at least so many words.
CLASSES = ((24, 28, 5), (MIN_WORDS, 10, 3))
PUNCTUATION = string.punctuation.encode()
HIT = "array<struct<item_id:bigint,start_word:int,end_word:int,distance:int,similarity:double>>"


def normal(word: bytes) -> bytes:
    if word.isascii():
        return word.lower().strip(PUNCTUATION)
    return word.decode("utf-8", "replace").lower().encode().strip(PUNCTUATION)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Two independent 64-bit hashes of each word: its code, and the bits that steer the walk."""
    plain = [normal(w) for w in words]
    codes = np.fromiter((xxhash.xxh64_intdigest(w) for w in plain), np.uint64, len(plain))
    return np.stack([codes, np.fromiter((xxhash.xxh64_intdigest(w, 1) for w in plain), np.uint64, len(plain))], axis=1)


def places(walk: int, picked: int) -> list[list[int]]:
    """Sampled steps of each repetition, over different lengths of the walk: every fourth at most half of it."""
    rng = np.random.default_rng(walk)
    return [sorted(rng.choice(max(picked + 2, walk - (r % 4) * walk // 6), picked, replace=False).tolist())
            for r in range(REPEATS)]


def signatures(codes: np.ndarray, starts: np.ndarray, walk: int, picked: int, places_too: bool = False) -> tuple:
    """Hash of each repetition (rows) for walks from `starts`; with `places_too` also the furthest word it reads, relative to
    the start, and on how many words its steps lie.

    codes: word hashes, followed by at least `walk` rows of padding.
    """
    chosen, multipliers = places(walk, picked), mixed(np.arange(1, walk + 1, dtype=np.uint64)) | np.uint64(1)
    users = defaultdict(list)
    for r, steps in enumerate(chosen):
        for s in steps:
            users[s].append(r)
    at = starts.astype(np.int64)
    out = np.zeros((REPEATS, len(at)), np.uint64)
    reach = np.full((REPEATS, len(at) if places_too else 0), -1, np.int64)
    on = np.zeros_like(reach)
    code, turn = np.ascontiguousarray(codes[:, 0]), np.ascontiguousarray(codes[:, 1]).view(np.int64)
    for step in range(max(users) + 1):
        if step in users:
            emitted = code[at] * multipliers[step]
            for r in users[step]:
                out[r] += emitted
                if places_too:
                    on[r] += reach[r] != at - starts
                    reach[r] = at - starts
        move = turn[at]
        move >>= step
        move &= 1
        at += move
    return out ^ (out >> np.uint64(32)), reach, on


def edit_search(item: list[int], text: list[int]) -> tuple[int, int]:
    """Smallest edit distance between item and any stretch of text, and the end of the first such stretch."""
    match: dict[int, int] = defaultdict(int)
    for k, word in enumerate(item):
        match[word] |= 1 << k
    full, top = (1 << len(item)) - 1, 1 << (len(item) - 1)
    plus, minus, score = full, 0, len(item)
    best, end = score, 0
    for at, word in enumerate(text):
        eq = match.get(word, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | (~(xh | plus) & full), plus & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        plus, minus = mh | (~(xv | ph) & full), ph & xv
        if score < best:
            best, end = score, at + 1
    return best, end


class Lookup:
    """Values per 64-bit key. A first look at the low bits, in a table at least 32 times as large as the number of keys, spares
    most keys the search."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.first = np.unique(keys[order], return_index=True)
        self.first = np.append(self.first, len(keys))
        self.values = [v[order] for v in values]
        self.mask = np.uint64((1 << max(16, (32 * len(self.keys)).bit_length())) - 1)
        self.low = np.zeros(int(self.mask) + 1, bool)
        self.low[self.keys & self.mask] = True

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of `keys` are known, and the place of each of those."""
        at = np.flatnonzero(self.low[keys & self.mask])
        place = np.searchsorted(self.keys, keys[at])
        known = (place < len(self.keys)) & (self.keys[np.minimum(place, len(self.keys) - 1)] == keys[at]) if len(self.keys) else at < 0
        return at[known], place[known]

    def entries(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which key, which value) of everything that is stored under the keys."""
        at, place = self.find(keys)
        counts = self.first[place + 1] - self.first[place]
        ends = np.cumsum(counts)
        within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
        return np.repeat(at, counts), np.repeat(self.first[place], counts) + within


def runs_of(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q words from each place on."""
    out = np.zeros(max(len(codes) - q + 1, 0), np.uint64)
    for k in range(q):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + codes[k:len(out) + k])
    return out


class Index:
    """Hashes of a block of items; holds nothing of the documents."""

    def __init__(self, items: list[tuple[int, str]], similarity: float):
        groups: dict[tuple[bytes, ...], list[int]] = defaultdict(list)
        for item_id, text in items:
            words = tuple(map(normal, split_words(text)))
            if len(words) >= MIN_WORDS:
                groups[words].append(item_id)
        self.items = [(list(words), sorted(ids)) for words, ids in sorted(groups.items())]
        self.lengths = np.array([len(w) for w, _ in self.items], np.int64)
        self.most = ((1 - similarity) * self.lengths + 1e-9).astype(np.int64)
        codes = [word_hashes(words) for words, _ in self.items]
        self.tables = []
        for number, (least, walk, picked) in enumerate(CLASSES):
            top = math.inf if number == 0 else CLASSES[number - 1][0]
            mine = np.flatnonzero((self.lengths >= least) & (self.lengths < top))
            if len(mine):
                self.tables.append((walk, picked, self.hashed(mine, codes, walk, picked)))
        untouched = -(-(self.lengths - self.most) // (self.most + 1))
        self.run = np.clip(untouched, 1, 3)
        self.runs = [runs_of(c[:, 0], q).tolist() for c, q in zip(codes, self.run.tolist())]
        self.run_tables = {}
        for q in np.unique(self.run).tolist():
            known = np.unique(np.array([h for k in np.flatnonzero(self.run == q) for h in self.runs[k]], np.uint64))
            self.run_tables[q] = Lookup(known)
        self.runs = [set(r) for r in self.runs]

    def hashed(self, mine: np.ndarray, codes: list[np.ndarray], walk: int, picked: int) -> list[Lookup]:
        """Per repetition: hash -> (item, start) of the item windows whose sampled places lie inside the item."""
        found: list[list[tuple]] = [[] for _ in range(REPEATS)]
        for i in mine.tolist():
            n = len(codes[i])
            padded = np.concatenate([codes[i], np.zeros((walk + 1, 2), np.uint64)])
            starts = np.arange(0, n, STRIDE if n >= 2 * STRIDE else 1)
            keys, reach, on = signatures(padded, starts, walk, picked, places_too=True)
            inside = reach + starts < n
            telling = inside & (on >= (DISTINCT if n >= 2 * STRIDE else 2))
            if telling.sum() < ENOUGH:
                telling = inside
            for r, k in zip(*np.nonzero(telling)):
                found[r].append((keys[r, k], i, starts[k]))
        return [Lookup(*(np.array([row[c] for row in rows], kind) for c, kind in enumerate((np.uint64, np.int64, np.int64))))
                for rows in found]

    def candidates(self, codes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, item, where the item would begin) of all windows that share a hash with one of an item, each once."""
        found = [np.zeros((0, 3), np.int64)]
        for walk, picked, lookups in self.tables:
            for part in range(0, words, 1 << 15):
                at = np.arange(part, min(part + (1 << 15), words))
                keys, _, _ = signatures(codes, at, walk, picked)
                for r, lookup in enumerate(lookups):
                    which, value = lookup.entries(keys[r])
                    item, offset = lookup.values[0][value], lookup.values[1][value]
                    found.append(np.stack([at[which], item, at[which] - offset], axis=1))
        return tuple(np.concatenate(found).T)

    def search(self, texts: list[str | None] | pa.Array, table: WordTable) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in texts]
        cut = Words(texts)
        values, starts = table.rows_of(cut), cut.starts
        if not len(values) or not self.items:
            return out
        padding = max(t[0] for t in self.tables) + 1
        codes = np.concatenate([values, np.zeros((padding, 2), np.uint64)])
        at, item, anchor = self.candidates(codes, len(values))
        # One number for (document, item, anchor); an anchor may lie before its document by less than an item.
        doc, back = np.searchsorted(starts, at, side="right") - 1, int(self.lengths.max())
        width = len(values) + back
        one = np.unique((doc * len(self.items) + item) * width + anchor + back)
        (doc, item), anchor = np.divmod(one // width, len(self.items)), one % width - back
        n, most = self.lengths[item], self.most[item]
        begin = np.maximum(starts[doc], anchor - most)
        end = np.minimum(starts[doc + 1], anchor + n + 2 * most + 1)
        keep = np.zeros(len(one), bool)
        for q, known in self.run_tables.items():
            hashes = runs_of(values[:, 0], q)
            hit, _ = known.find(hashes)
            mine = np.flatnonzero((self.run[item] == q) & (end - begin >= n - most))
            first, last = np.searchsorted(hit, begin[mine]), np.searchsorted(hit, end[mine] - q + 1)
            some = last > first
            for k, a, b in zip(mine[some].tolist(), first[some].tolist(), last[some].tolist()):
                keep[k] = not self.runs[item[k]].isdisjoint(hashes[hit[a:b]].tolist())
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        plain: dict[int, bytes] = {}
        for d, i, a, z in np.stack([doc, item, begin, end], axis=1)[keep].tolist():
            words, first = self.items[i][0], int(starts[d])
            near, limit = cut.codes[a:z].tolist(), int(self.most[i])
            for c in near:
                if c not in plain:
                    plain[c] = normal(cut.distinct[c])
            text = [plain[c] for c in near]
            if sum(map(set(words).__contains__, text)) < len(words) - limit:
                continue
            distance, stop = edit_search(words, text)
            if distance > limit:
                continue
            _, length = edit_search(words[::-1], text[:stop][::-1])
            place = (distance, a - first + stop - length, a - first + stop)
            if (d, i) not in best or place < best[d, i]:
                best[d, i] = place
        for (d, i), (distance, a, z) in sorted(best.items()):
            words, ids = self.items[i]
            for item_id in ids:
                out[d].append({"item_id": item_id, "start_word": a, "end_word": z, "distance": distance,
                               "similarity": 1 - distance / len(words)})
        return out


def blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[int, str]]]:
    """The query set in blocks of about block_words words, one collected at a time."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where(F.col("text").isNotNull())
    total = items.distinct().agg(F.sum(F.size(F.split("text", " ")))).first()[0] or 0
    count = max(1, math.ceil(total / block_words))
    for b in range(count):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == b).distinct().collect()
        yield sorted(((r.item_id, r.text) for r in rows), key=lambda r: (r[0] is None, r))


def leaks_column(index: Index, text: Column) -> Column:
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start_word", pa.int32()), ("end_word", pa.int32()),
                               ("distance", pa.int32()), ("similarity", pa.float64())]))

    def make():
        table = worker_state(("word hashes",), lambda: WordTable(word_hashes, 600_000))
        return lambda texts: pa.array(index.search(texts, table), kind)

    return text_udf(make, HIT, as_list=False)(text)


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, start_word, end_word, distance and similarity of every leak."""
    found = None
    for items in blocks(benchmark, block_words):
        leaks = leaks_column(Index(items, similarity), F.col("text"))
        part = docs.select("doc_id", leaks.alias("leaks")).select("doc_id", F.inline("leaks"))
        found = part if found is None else found.unionByName(part)
    return found


def keep_clean(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows of docs without a leak."""
    rows = boxed(docs)
    for items in blocks(benchmark, block_words):
        leaks = leaks_column(Index(items, similarity), F.col("row.text"))
        rows = rows.withColumn("leaks", leaks).where(F.size("leaks") == 0).select("row")
    return rows.select("row.*")
