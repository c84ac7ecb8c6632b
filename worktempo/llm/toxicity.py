"""Toxicity by noisy-channel deobfuscation.

A writer hides a word by leetspeak, spacing and repetition. Each suspicious spelling becomes a lattice of letters it may
stand for, each with a channel cost; a Viterbi decoder under a character language model (order 4, learned from the labelled
documents) restores the likeliest word, and the restored text is scored. Plain words restore to their lower-cased form.

The score is a logistic function of the strongest piece of evidence among the restored words and of how many words reach
each of three levels. A word's evidence is the largest smoothed log-odds among its features (whole word, prefixes of 4 to 6
letters), from document frequencies in toxic and other labelled documents. The logistic is fitted with each training document's own
count taken out, so that words seen once carry nothing. `fit` learns from every labelled document: tasks count words, letter
sequences, features and the sums of each Newton step, Spark adds them up, and only the model itself comes to the driver.

Defined results: a NULL or empty text gets the score of a text without evidence; without any usable label the score is 0;
repeated rows are scored each; further columns are kept. In a run of pieces (signs between them do not count) the lattice
has both readings of each gap, a word's end or nothing, and the words found in more than one piece count beside those that
are there. A piece has one or two letters, or is part of a word that strongly speaks for a label (`stu pid`).
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktempo.llm.common import (
    WordTable, Words, is_remainder, remove_folder, shared_folder, slices, split_words, sums, text_udf, worker_state,
)

BUCKETS = 1 << 18
#: What the checksum of a feature begins with: the length of a prefix, or a sign for whole words.
PREFIXES, WHOLE = tuple((k, zlib.crc32(b"%d" % k)) for k in range(4, 7)), zlib.crc32(b"=")
#: Most distinct words or letter sequences that a task counts before it hands the counts on.
COUNTED = 300_000
#: What a sign may stand for; fixed values.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
    "!": "il", "|": "il", "+": "t", "€": "e", "(": "c", "£": "l", "¡": "i", "%": "o", "&": "a", "^": "a", "µ": "u", "×": "x",
}
FOLD = str.maketrans({sign: letters[0].replace("l", "i") for sign, letters in LEET.items()} | {"l": "i"})
EDGES = "\"'“”‘’«»()[]{}<>.,;:!?¿¡…*#%&|~_-/\\=+^"
EDGES_OR_S = EDGES + "$"
LETTER, OTHER, SIGN = re.compile(r"[^\W\d_]"), re.compile(r"[^\w'’]|[\d_]"), re.compile(r"[\d@$€£!|+(]")
DOUBLED, TRIPLED, LONG = (re.compile(r, re.S) for r in (r"([^\W\d_])\1", r"(.)\1\1", r"(.)\1{4,}"))
NO_LETTER, REPEATED = re.compile(r"[\W\d_]+"), re.compile(r"(.)\1+", re.S)
LEET_COST, DROP_COST, REPEAT_COST, KEEP_COST, JOIN_COST = 0.6, 0.3, 0.4, 3.0, 0.4
#: How far above the highest level the evidence of a word is whose parts are looked for (some twenty toxic documents and no other).
CERTAIN = 1.5
#: A gap between pieces of a word, in spellings and what is decoded from them; a gap found to be none.
GAP, JOINED = " ", "\0"
#: What a word is in a run of pieces: no piece, a piece, one or two signs without letters, signs only.
LONGER, PIECE, LETTERLESS, SIGNS = range(4)


class CharacterModel:
    """Log-probability of a letter after the four before it; falls back to shorter histories at a cost."""

    ORDER, BACK = 4, -1.2

    def __init__(self, grams: Iterable[tuple[str, int, int]]):
        """From sequences of up to ORDER + 1 letters with their number and that of their histories."""
        self.logs = {g: math.log(n / before) for g, n, before in grams if n > 1 or len(g) < 4}
        most, least = defaultdict(lambda: -math.inf), defaultdict(lambda: math.inf)
        for gram, log in self.logs.items():
            log += self.BACK * (self.ORDER + 1 - len(gram))
            most[gram[-1]], least[gram[-1]] = max(most[gram[-1]], log), min(least[gram[-1]], log)
        self.spread, self.dearest_end = {letter: most[letter] - least[letter] for letter in most}, -least["$"]

    @classmethod
    def grams(cls, words: Iterable[tuple[str, int]]) -> Counter:
        """Every sequence of up to ORDER + 1 letters that ends in a word or behind it."""
        grams: Counter = Counter()
        for word, n in words:
            padded = "^" * cls.ORDER + word + "$"
            for at in range(cls.ORDER, len(padded)):
                for k in range(cls.ORDER + 1):
                    grams[padded[at - k:at + 1]] += n
        return grams

    @classmethod
    def longest_grams(cls, words: Iterable[tuple[str, int]]) -> Counter:
        """The sequence of ORDER + 1 letters that ends at each letter of a word or behind it; all others are their ends."""
        grams: Counter = Counter()
        for word, n in words:
            padded = "^" * cls.ORDER + word + "$"
            for at in range(len(word) + 1):
                grams[padded[at:at + cls.ORDER + 1]] += n
        return grams

    @classmethod
    def of_words(cls, words: Counter) -> CharacterModel:
        grams, histories = cls.grams(words.items()), Counter()
        for gram, n in grams.items():
            histories[gram[:-1]] += n
        return cls((g, n, histories[g[:-1]]) for g, n in grams.items())

    def log(self, history: str, letter: str) -> float:
        cost = 0.0
        for k in range(self.ORDER, -1, -1):
            found = self.logs.get(history[len(history) - k:] + letter)
            if found is not None:
                return cost + found
            cost += self.BACK
        return cost - 6.0

    def decode(self, spelling: str) -> str:
        """The likeliest word behind a spelling: Viterbi over states of the last four letters.

        Two states differ in what follows for at most ORDER letters, so one that is dearer than the cheapest by more than
        their largest difference cannot win; only such states are left out. More than four equal signs count as four. A gap
        ends a word or joins two pieces of one.
        """
        spelling = LONG.sub(r"\1\1\1\1", spelling)
        costs = self.__dict__.setdefault("costs", {})  # of letters behind histories met before
        if len(costs) > 300_000:
            costs.clear()
        letters = {x for sign in set(spelling) for x in LEET.get(sign, "") + sign} | {"$"}
        margin = self.ORDER * max(self.spread.get(letter, 0.0) for letter in letters) + 1e-6
        margin += self.dearest_end if GAP in spelling else 0.0
        start = "^" * self.ORDER
        states: dict[str, tuple] = {start: (0.0, None)}  # cost, and the letters so far as (last, those before)
        before = ""
        for sign in spelling:
            after: dict[str, tuple] = {}
            if sign == GAP:
                ends = []
                for history, (cost, word) in states.items():
                    after[history] = (cost + JOIN_COST, (JOINED, word))
                    ends.append((cost if history == start else cost - self.log(history, "$"), history, word))
                cost, _, word = min(ends, key=lambda s: s[:2])
                after[start] = (cost, (GAP, word))
                options = []
            else:
                options = [(letter, LEET_COST) for letter in LEET.get(sign, "")]
                if sign.isalpha():
                    options.append((sign, 0.0))
                else:
                    options.append(("", DROP_COST if not options else KEEP_COST))
                if sign == before:
                    options.append(("", REPEAT_COST))
                before = sign
            for letter, price in options:
                if not letter:
                    for history, (cost, word) in states.items():
                        if history not in after or cost + price < after[history][0]:
                            after[history] = (cost + price, word)
                    continue
                for history, (cost, word) in states.items():
                    gram = history + letter
                    log = costs.get(gram)
                    if log is None:
                        log = costs[gram] = self.log(history, letter)
                    state, total = gram[1:], cost + price - log
                    if state not in after or total < after[state][0]:
                        after[state] = (total, (letter, word))
            if len(after) > 1:
                bound = min(s[0] for s in after.values()) + margin
                after = {state: s for state, s in after.items() if s[0] <= bound}
            states = after
        word = min(((cost - self.log(history, "$"), history, word) for history, (cost, word) in states.items()),
                   key=lambda s: s[:2])[2]
        out = []
        while word:
            out.append(word[0])
            word = word[1]
        return "".join(reversed(out))

    def undoubled(self, word: str) -> str:
        """What `decode` gives for a word of letters, none three times in a row and none of LEET.

        The only choice is whether the second of two equal letters is one too many, so all choices are compared. Each cost
        is added up in the order of `decode`, which decides where two come out about equal.
        """
        second = [at for at in range(1, len(word)) if word[at] == word[at - 1]]
        if len(second) > 3:
            return self.decode(word)
        costs = self.__dict__.setdefault("costs", {})
        if len(costs) > 300_000:
            costs.clear()
        found = []
        for chosen in range(1 << len(second)):
            dropped = [at for k, at in enumerate(second) if chosen >> k & 1]
            history, cost, kept = "^" * self.ORDER, 0.0, []
            for at, letter in enumerate(word):
                if at in dropped:
                    cost += REPEAT_COST
                    continue
                gram = history + letter
                log = costs.get(gram)
                if log is None:
                    log = costs[gram] = self.log(history, letter)
                cost -= log
                history = gram[1:]
                kept.append(letter)
            found.append((cost - self.log(history, "$"), "".join(kept)))
        found.sort()
        return self.decode(word) if len(found) > 1 and found[1][0] - found[0][0] < 1e-9 else found[0][1]

    def knows(self, word: str) -> bool:
        """Did every letter of the word occur after the four before it?"""
        padded, logs, size = "^" * self.ORDER + word, self.logs, self.ORDER + 1
        for at in range(len(word)):
            if padded[at:at + size] not in logs:
                return False
        return True

    def restore(self, word: str) -> str:
        """The word as meant: lower case, without signs at its edges, decoded if it looks hidden.

        A doubled letter alone is decoded where the model knows the start of the decoded word and not the plain one.
        """
        plain = bare(word)
        if simple(plain) or not any(map(str.isalpha, plain)):
            return plain
        if hidden(plain):
            return self.decode(plain)
        return self.restore_doubled(plain) if DOUBLED.search(plain) else plain

    def restore_doubled(self, plain: str) -> str:
        if not self.knows(plain + "$"):
            decoded = self.undoubled(plain) if plain.isalpha() and not any(map(LEET.__contains__, plain)) else self.decode(plain)
            if self.knows(decoded[:6]):
                return decoded
        return plain


def bare(word: str) -> str:
    """Lower case without signs at the edges, but with one before the word that may be a letter."""
    word = word.lower()
    if word.isalpha():
        return word
    plain = word.strip(EDGES_OR_S) or word.strip(EDGES)
    start = word.find(plain)
    return word[start - 1] + plain if start > 0 and word[start - 1] in "$!|(+" else plain


def simple(plain: str) -> bool:
    """Letters only, none twice in a row: such a word hides nothing."""
    return plain.isalpha() and not DOUBLED.search(plain)


def hidden(word: str) -> bool:
    """A sign or digit between a letter and a letter or digit, one that may be a letter before a letter, or three equal signs."""
    if TRIPLED.search(word):
        return True
    first = LETTER.search(word)
    if not first:
        return False
    last = len(word) - 1
    while not word[last].isalnum():
        last -= 1
    if OTHER.search(word, first.start() + 1, last):
        return True
    while not LETTER.match(word[last]):
        last -= 1
    return bool(SIGN.search(word, 0, last))


def features(word: str) -> list[int]:
    """Buckets of the whole word and of its prefixes; longer words share the prefixes of their stem."""
    if word.isascii():
        data = word.encode()
        found = [zlib.crc32(data[:k], start) % BUCKETS for k, start in PREFIXES if k < len(data)]
    else:
        data = word.encode("utf-8", "replace")
        found = [zlib.crc32(word[:k].encode("utf-8", "replace"), start) % BUCKETS for k, start in PREFIXES if k < len(word)]
    if word:
        found.append(zlib.crc32(data, WHOLE) % BUCKETS)
    return found


#: Letters below this code point have at most two bytes in UTF-8; figures of words of them are made for many words at once.
TABLED = 0x800


def tabled(kind: type, of: Callable[[str], object]) -> np.ndarray:
    """One value for each code point below TABLED, and one (of nothing) for all others."""
    return np.asarray([of(chr(code)) for code in range(TABLED)] + [of("")], kind)


#: The lower case of a letter, where it is one letter below TABLED whatever stands beside it; else TABLED.
LOWER = tabled(np.uint16, lambda x: ord(x.lower()) if len(x.lower()) == 1 and ord(x.lower()) < TABLED and x != "Σ" else TABLED)
ALPHA = tabled(bool, lambda x: x.isalpha() and x not in LEET)
EDGE, EDGE_LETTER = tabled(bool, lambda x: x != "" and x in EDGES_OR_S), tabled(bool, lambda x: x != "" and x in "$!|(+")
FOLDED = tabled(np.uint16, lambda x: ord(x.translate(FOLD)) if x else TABLED)
HIGH_EDGES = np.asarray([ord(x) for x in EDGES_OR_S if ord(x) >= TABLED], np.uint32)
CRC = np.asarray([zlib.crc32(bytes([x]), 0xFFFFFFFF) ^ 0xFFFFFFFF for x in range(256)], np.uint32)
#: What turns the checksum of some bytes begun for whole words into the one begun for a prefix, by number of bytes.
TO_PREFIX = {k: np.asarray([zlib.crc32(bytes(n), start) ^ zlib.crc32(bytes(n), WHOLE) for n in range(2 * k + 1)], np.uint32)
             for k, start in PREFIXES}
#: Longest word whose figures are made together with others'.
TOGETHER = 64
MIX = np.cumprod(np.full(TOGETHER + 1, 0x9E3779B97F4A7C15, np.uint64))


def form_hash(word: str) -> int:
    """A hash of a folded word, equal to that of `Plain.folded_hashes`."""
    return sum((ord(x) + 1) ** 2 * int(MIX[at]) for at, x in enumerate(word[:TOGETHER])) % (1 << 64)


class Plain:
    """The bare forms of many words of which one can say without decoding what they are: letters only, none three times in a
    row. `rows` are their places among the words; all other words are `rest`."""

    def __init__(self, words: list[bytes]):
        codes = np.frombuffer(b" ".join(words).decode("utf-8", "replace").encode("utf-32-le", "replace"), "<u4")
        if len(codes) and codes.max() >= TABLED:
            codes = np.where(np.isin(codes, HIGH_EDGES), ord("."), np.minimum(codes, TABLED))
        gaps = np.flatnonzero(codes == ord(" "))
        begin, end = np.concatenate([[0], gaps + 1]), np.append(gaps, len(codes))
        codes = LOWER[codes]
        # The first and the last sign that is no edge; where there is none the word is no word of letters.
        core = np.flatnonzero(~EDGE[codes] & (codes != ord(" ")))
        core = np.append(core, len(codes))
        first = core[np.searchsorted(core, begin)]
        last = core[np.maximum(np.searchsorted(core, end) - 1, 0)] + 1
        whole = (first < end) & (end > begin)
        first, last = np.where(whole, first, begin), np.where(whole, last, begin)
        whole &= last - first <= TOGETHER
        before = np.maximum(first - 1, 0)
        whole &= ~((first > begin) & EDGE_LETTER[codes[before]]) if len(codes) else False
        strange = np.concatenate([[0], np.cumsum(~ALPHA[codes])])
        whole &= strange[last] == strange[first]
        same = np.zeros(len(codes), bool)
        same[1:] = codes[1:] == codes[:-1]  # signs beside the letters are no letters, so none equals one
        thrice = same.copy()
        thrice[1:] &= same[:-1]
        thrice, twice = (np.concatenate([[0], np.cumsum(x)]) for x in (thrice, same))
        whole &= thrice[last] == thrice[first]
        self.codes, self.rows, self.rest = codes, np.flatnonzero(whole), np.flatnonzero(~whole)
        self.first, self.lengths = first[whole], (last - first)[whole]
        self.doubled = np.flatnonzero((twice[last] > twice[first])[whole])

    def words(self, some: np.ndarray) -> list[str]:
        lengths = self.lengths[some] + 1
        starts = np.cumsum(lengths) - lengths
        codes = np.full(int(lengths.sum()), ord(" "), "<u4")
        inside = np.delete(np.arange(len(codes)), starts + lengths - 1)
        codes[inside] = self.codes[(np.repeat(self.first[some] - starts, lengths) + np.arange(len(codes)))[inside]]
        return codes.tobytes().decode("utf-32-le").split()

    def buckets(self) -> np.ndarray:
        """Buckets of each form as `features` has them, in another order; BUCKETS where there are fewer."""
        out = np.full((len(self.rows), len(PREFIXES) + 1), BUCKETS, np.int32)
        order = np.argsort(-self.lengths, kind="stable")
        lengths, first = self.lengths[order], self.first[order]
        state = np.full(len(order), WHOLE ^ 0xFFFFFFFF, np.uint32)
        size = np.zeros(len(order), np.int64)
        made = np.full((len(PREFIXES) + 1, len(order)), BUCKETS, np.int32)
        prefixes = {k: column for column, (k, _) in enumerate(PREFIXES)}
        left = np.searchsorted(-lengths, -np.arange(int(lengths[0]) + 1 if len(order) else 1), side="left")  # words longer than that
        for at in range(len(left)):
            if at in prefixes:
                n = left[at]
                crc = state[:n] ^ np.uint32(0xFFFFFFFF) ^ TO_PREFIX[at][size[:n]]
                made[prefixes[at], :n] = crc % BUCKETS
            n = left[at]
            if not n:
                break
            letter = self.codes[first[:n] + at].astype(np.uint32)
            wide = letter >= 0x80
            now = state[:n]
            byte = np.where(wide, letter >> 6 | 0xC0, letter)
            now = CRC[(now ^ byte) & 0xFF] ^ now >> 8
            some = np.flatnonzero(wide)
            if len(some):
                more = now[some]
                now[some] = CRC[(more ^ (letter[some] & 0x3F | 0x80)) & 0xFF] ^ more >> 8
            state[:n] = now
            size[:n] += 1 + wide
        made[-1] = (state ^ np.uint32(0xFFFFFFFF)) % BUCKETS
        out[order] = made.T
        return out

    def folded_hashes(self) -> np.ndarray:
        """A hash of each folded form."""
        if not len(self.rows):
            return np.zeros(0, np.uint64)
        starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        place = np.arange(int(self.lengths.sum())) - np.repeat(starts, self.lengths)
        codes = FOLDED[self.codes[np.repeat(self.first, self.lengths) + place]]
        kept = np.ones(len(codes), bool)
        kept[1:] = codes[1:] != codes[:-1]
        kept[starts] = True
        rank = np.cumsum(kept)
        rank -= np.repeat(rank[starts], self.lengths)
        values = np.where(kept, (codes.astype(np.uint64) + np.uint64(1)) ** 2 * MIX[rank], np.uint64(0))
        return np.add.reduceat(values, starts)


def inner_parts(words: frozenset[str]) -> frozenset[str]:
    """Parts of three letters or more that begin or end a word or lie inside it, folded, but for words of the set."""
    parts = (w[a:b] for w in words for a in range(len(w)) for b in range(a + 3, len(w) + 1))
    return frozenset(map(folded, parts)) - frozenset(map(folded, words))


def folded(word: str) -> str:
    """One form for all spellings that may stand for the same letters: signs as letters, i for l, repeats and the rest gone."""
    word = word.translate(FOLD)
    return word if simple(word) else REPEATED.sub(r"\1", NO_LETTER.sub("", word))


def met(a: str, b: str) -> str:
    """Two folded forms as one."""
    return a + b[1:] if a and b and a[-1] == b[0] else a + b


def piece_kind(word: str, parts: frozenset[str] = frozenset()) -> int:
    plain = bare(word)
    if len(plain) > 2 and simple(plain):
        return PIECE if parts and folded(plain) in parts else LONGER
    if parts and any(folded(x) in parts for x in {plain, plain.strip(EDGES_OR_S)}) and any(map(str.isalpha, plain)):
        return PIECE
    if len(plain) in (1, 2) and all(x.isalnum() or x in LEET for x in plain):
        return PIECE if any(map(str.isalpha, plain)) else LETTERLESS
    return LONGER if any(map(str.isalnum, word)) else SIGNS


def piece_runs(kinds: np.ndarray, starts: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Ranges of words that may be one word or more, spelled in pieces: two pieces at least, one of them with a letter, signs
    between them. Five pieces without a letter in a row are numbers and end a run. With `starts` (where each document begins,
    and the end) the words of many documents are looked at together; no run goes from one into the next."""
    starts = np.array([0, len(kinds)]) if starts is None else starts
    # A word that is no piece behind each document keeps them apart.
    kinds = np.insert(kinds.astype(np.int8), starts[1:], LONGER)
    inside = kinds > LONGER
    spelled = np.flatnonzero(kinds != SIGNS)
    without = np.flatnonzero(np.diff(np.concatenate([[0], kinds[spelled] == LETTERLESS, [0]]).astype(np.int8)))
    for a, b in zip(without[::2], without[1::2]):
        if b - a > 4:
            inside[spelled[a]:spelled[b - 1] + 1] = False
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside, [0]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    lettered, pieces = (np.concatenate([[0], np.cumsum(k)]) for k in (kinds == PIECE, kinds != SIGNS))
    kept = (lettered[end] > lettered[begin]) & (pieces[end] - pieces[begin] > 1)
    begin, end = begin[kept], end[kept]
    before = np.searchsorted(starts[1:] + np.arange(len(starts) - 1), begin)  # documents that end before the run
    return list(zip((begin - before).tolist(), (end - before).tolist()))


def short_forms(piece: str, last: str) -> list[str]:
    """Up to two letters that decoding may leave of a piece of letters behind the letter `last`: it drops repeats only."""
    if len(piece) < 3 and piece[0] != last and piece[0] != piece[-1]:
        return [piece]
    forms = [""]
    for letter in piece:
        more = [f + letter for f in forms]
        forms = more + forms if letter == last else more
        if min(map(len, forms)) > 2:
            return []
        last = letter
    return [f for f in forms if len(f) < 3]


class Scorer:
    """`odds`: evidence per bucket; `weights`: of a constant, the strongest evidence, and log(1 + words) at each level."""

    def __init__(self, characters: CharacterModel | None, odds: np.ndarray, weights: np.ndarray, levels: list[float],
                 strongest: frozenset[str] = frozenset()):
        self.characters, self.odds, self.weights, self.levels = characters, odds, weights, levels
        self.strongest, self.parts = strongest, inner_parts(strongest)
        self.met: dict[bytes, list[float]] = {}  # short runs of pieces met before
        self.known: dict[str, tuple[float, int]] = {}  # words without the signs at their edges, as they are in word_figures
        self.spelled_out: dict[str, float] = {}  # evidence of words put together from short pieces
        self.pairs: dict[tuple[str, str, bool], tuple[float, bool, bool]] = {}  # of pieces
        self.bare_pieces: dict[bytes, tuple[str, bool, bool]] = {}

    @cached_property
    def listed(self) -> list[float]:
        return self.odds.tolist()

    def evidence(self, word: str) -> float:
        found = features(word)
        return max(map(self.listed.__getitem__, found)) if found else 0.0

    def word_figures(self, words: list[bytes]) -> np.ndarray:
        """Evidence of each word, which levels it reaches, and what it is in a run of pieces."""
        out = np.zeros((len(words), 2 + len(self.levels)), np.float32)
        if not words:
            return out
        easy = Plain(words)
        buckets = easy.buckets()
        for at, word in zip(easy.doubled.tolist(), easy.words(easy.doubled)):
            restored = self.characters.restore_doubled(word)
            if restored != word:
                buckets[at] = BUCKETS
                buckets[at, :len(made)] = (made := features(restored))
        out[easy.rows, 0] = np.append(self.odds, np.float32(-np.inf))[buckets].max(axis=1)
        kinds = np.where(easy.lengths < 3, PIECE, LONGER)
        maybe = np.flatnonzero(np.isin(easy.folded_hashes(), self.part_hashes))
        for at, word in zip(maybe.tolist(), easy.words(maybe)):
            kinds[at] = piece_kind(word, self.parts)
        out[easy.rows, -1] = kinds
        found, known = [], self.known
        for row in easy.rest.tolist():
            word = words[row].decode("utf-8", "replace")
            plain = bare(word)
            figures = known.get(plain)
            if figures is None:
                figures = known[plain] = (self.evidence(self.characters.restore(plain)), piece_kind(plain, self.parts))
                if len(known) > 200_000:
                    known.clear()
            found.append(figures)
        if found:
            out[easy.rest, 0], out[easy.rest, -1] = np.asarray(found).T
        out[:, 1:-1] = out[:, :1] >= np.asarray(self.levels, np.float32)
        return out

    @cached_property
    def part_hashes(self) -> np.ndarray:
        return np.asarray(sorted(map(form_hash, self.parts)), np.uint64)

    @cached_property
    def strong_forms(self) -> frozenset[str]:
        return frozenset(map(folded, self.strongest))

    @cached_property
    def strong_beginnings(self) -> frozenset[str]:
        return frozenset(form[:k] for form in self.strong_forms for k in range(len(form) + 1))

    def may_join(self, pieces: list[str]) -> bool:
        """Can decoding find a word that counts? Of letters it drops repeats only, so each joined word is known in folded form;
        one of pieces below three letters may be any word."""
        if not all(map(str.isalpha, pieces)):
            return True
        before, last_short = "", False
        for piece in pieces:
            once = REPEATED.sub(r"\1", piece)
            short = len(once) - (once[0] == before) < 3
            if short and last_short:
                return True
            before, last_short = piece[-1], short
        return self.spells_strong(pieces)

    def spells_strong(self, pieces: list[str]) -> bool:
        """Do pieces of letters, joined, have the folded form of a word of strong evidence?"""
        forms, beginnings = self.strong_forms, self.strong_beginnings
        parts = list(map(folded, pieces))
        for a in range(len(parts) - 1):
            if parts[a] not in beginnings and not (a and pieces[a][0] == pieces[a - 1][-1]):
                continue
            # A letter that repeats the last one of the piece before may be dropped too.
            for word in {parts[a], folded(pieces[a].lstrip(pieces[a - 1][-1]))} if a else parts[:1]:
                for part in parts[a + 1:]:
                    word = met(word, part)
                    if word in forms:
                        return True
                    if word not in beginnings:
                        break
        return False

    def most(self, words: list[bytes]) -> float:
        """No word that `joined` finds has more evidence than this. Of letters decoding drops repeats only, so of short pieces
        all words that they can spell are known."""
        known = self.bare_pieces
        most, longer, asked, short_before = -math.inf, False, False, False
        p, begins, small, last = "", False, False, ""
        for raw in words:
            q, q_begins, q_small = known.get(raw) or self.bare_piece(raw)
            if not q:
                if q_small:
                    return math.inf
                continue
            if p:
                short = False
                if begins or p[0] == last or small and q_small:
                    key = p, q, p[0] == last
                    evidence, short, strong = self.pairs.get(key) or self.pair(*key)
                    if strong and not asked:
                        asked = True
                        if self.spells_strong(self.bare_letters(words)):
                            return math.inf
                    if evidence > most:
                        most = evidence
                    longer = longer or short and short_before
                short_before, last = short, p[-1]
            p, begins, small = q, q_begins, q_small
        return max(most, self.most_of_short(self.bare_letters(words))) if longer else most

    def bare_piece(self, raw: bytes) -> tuple[str, bool, bool]:
        """The letters of a piece, whether a word of strong evidence begins with them, and whether decoding may leave less than
        three. Without letters: whether signs may stand for some."""
        piece = bare(raw.decode("utf-8", "replace"))
        if not any(x.isalnum() or x in LEET for x in piece):
            found = "", False, False
        elif not piece.isalpha() or any(map(LEET.__contains__, piece)):
            found = "", False, True
        else:
            found = piece, folded(piece) in self.strong_beginnings, bool(len(piece) < 3 or DOUBLED.search(piece))
        if len(self.bare_pieces) >= 100_000:
            self.bare_pieces.clear()
        self.bare_pieces[raw] = found
        return found

    def bare_letters(self, words: list[bytes]) -> list[str]:
        return [piece for piece, _, _ in (self.bare_pieces.get(w) or self.bare_piece(w) for w in words) if piece]

    def pair(self, p: str, q: str, repeated: bool) -> tuple[float, bool, bool]:
        """Of two pieces, the first of which may begin with the last letter before it: most evidence of what they can spell if
        they are short, whether they are, and whether a word of strong evidence begins with them in folded form."""
        last = p[0] if repeated else ""
        begun = {folded(p), folded(p.lstrip(last))} if repeated else {folded(p)}
        strong = any(met(start, folded(q)) in self.strong_beginnings for start in begun)
        short = bool(short_forms(p, last) and short_forms(q, p[-1]))
        found = self.most_of_short([p, q], last) if short else -math.inf, short, strong
        if len(self.pairs) >= 200_000:
            self.pairs.clear()
        self.pairs[p, q, repeated] = found
        return found

    def most_of_short(self, pieces: list[str], last: str = "") -> float:
        if len(pieces) > 12:
            return math.inf
        most, known = -math.inf, self.spelled_out
        begun: list[str] = []  # words that the next piece may go on with
        for piece in pieces:
            forms, last = short_forms(piece, last), piece[-1]
            grown = [w + f for w in begun for f in forms]
            if len(grown) > 60:
                return math.inf
            for word in grown:
                found = known.get(word)
                if found is None:
                    if len(known) > 200_000:
                        known.clear()
                    found = known[word] = self.evidence(word)
                if found > most:
                    most = found
            begun = grown + forms
        return most

    def joined(self, words: list[bytes]) -> list[float]:
        """Evidence of every word that a run spells in more than one piece; with a piece of three letters or more only a
        word that is itself known for strong evidence, since two ordinary words may begin like one."""
        run = b" ".join(words)
        found = self.met.get(run)
        if found is None:
            pieces = [bare(w.decode("utf-8", "replace")) for w in words]
            pieces = [p for p in pieces if any(x.isalnum() or x in LEET for x in p)]
            read = self.characters.decode(GAP.join(pieces)) if self.may_join(pieces) else ""
            decoded = [w.strip(JOINED) for w in read.split(GAP)]
            short = {w for w in decoded if max(map(len, w.split(JOINED))) < 3}
            found = [self.evidence(word) for w in decoded if JOINED in w
                     for word in [w.replace(JOINED, "")] if w in short or word in self.strongest]
            if len(run) <= 64:
                if len(self.met) >= 100_000:
                    self.met.clear()
                self.met[run] = found
        return found

    def scores(self, texts: list[str | None] | pa.Array, table: WordTable) -> np.ndarray:
        if self.characters is None:
            return np.zeros(len(texts))
        every = Words(texts)
        values, starts = table.rows_of(every), every.starts
        full = np.flatnonzero(np.diff(starts))
        best = np.zeros(len(texts))
        if len(full):
            best[full] = np.maximum(np.maximum.reduceat(values[:, 0], starts[:-1][full]), 0)
        total = sums(values, starts)
        count = total[:, 1:-1]
        levels, found_runs = np.asarray(self.levels), piece_runs(values[:, -1], starts)
        documents_of = np.searchsorted(starts, [a for a, _ in found_runs], side="right") - 1
        low = min(self.levels, default=math.inf)
        for (a, b), at in zip(found_runs, documents_of.tolist()):
            words = [every.distinct[code] for code in every.codes[a:b].tolist()]
            most = self.most(words)
            if most <= best[at] and most < low:  # whatever is found changes nothing
                continue
            for found in self.joined(words):
                best[at] = max(best[at], found)
                count[at] += found >= levels
        z = np.column_stack([np.ones(len(best)), best, np.log1p(count)]) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def spelled(texts: Iterable[str | None]) -> Iterator[dict[str, int]]:
    """For each text its words in lower case without signs at the edges, with their number."""
    for text in texts:
        yield {w.decode("utf-8", "replace").lower().strip(EDGES): n for w, n in Counter(split_words(text)).items()}


class Learner:
    """What documents tell of their label, for tables of words whose rows are the buckets of the restored word.

    Row entries that are no bucket (short words have fewer) are BUCKETS.
    """

    def __init__(self, characters: CharacterModel):
        self.characters = characters

    def buckets(self, words: list[bytes]) -> np.ndarray:
        out = np.full((len(words), len(PREFIXES) + 1), BUCKETS, np.int32)
        if not words:
            return out
        plain = Plain(words)
        out[plain.rows] = plain.buckets()
        restored = [(row, self.characters.restore(words[row].decode("utf-8", "replace"))) for row in plain.rest.tolist()]
        for at, word in zip(plain.doubled.tolist(), plain.words(plain.doubled)):
            found = self.characters.restore_doubled(word)
            if found != word:
                restored.append((int(plain.rows[at]), found))
        for row, word in restored:
            found = features(word)
            out[row] = BUCKETS
            out[row, :len(found)] = found
        return out

    def count(self, words: Words, labels: np.ndarray, table: WordTable, into: np.ndarray) -> None:
        """Add to `into` (other and toxic documents) which documents have which buckets."""
        values, width = table.rows_of(words), BUCKETS + 1
        kind = np.int32 if len(labels) * width < 1 << 31 else np.int64
        owner = np.repeat(np.arange(len(labels), dtype=kind) * kind(width), np.diff(words.starts))
        pairs = (owner[:, None] + values).ravel()
        pairs.sort()
        pairs = pairs[np.diff(pairs, prepend=-1) > 0]
        owner = pairs // width
        for label in (0, 1):
            mine = labels[owner] == label
            into[label] += np.bincount(pairs[mine] - owner[mine] * width, minlength=width)


class Odds:
    """Log of the ratio of document shares per bucket, drawn to zero where few documents have the feature."""

    def __init__(self, found: np.ndarray, documents: tuple[int, int]):
        """`found`: other and toxic documents with each bucket; `documents`: other and toxic ones in all."""
        self.found, self.documents = found[:, :BUCKETS].astype(float), documents
        other, toxic = documents
        self.base = toxic / (other + toxic)
        self.strong = max(1.0, math.log(other / toxic) + 1)
        self.levels = [self.strong - 1.5, self.strong - 0.75, self.strong]

    def odds(self, other: np.ndarray, toxic: np.ndarray) -> np.ndarray:
        share = (toxic + 2 * self.base) / (toxic + other + 2)
        return np.log(share / (1 - share)) - math.log(self.base / (1 - self.base))

    @cached_property
    def learned(self) -> np.ndarray:
        return self.odds(*self.found).astype(np.float32)

    @cached_property
    def without_own(self) -> list[np.ndarray]:
        """For documents of each label: without the document's own count, and one entry more for what is no bucket."""
        other, toxic = self.found
        return [np.append(self.odds(np.maximum(other - (label == 0), 0), np.maximum(toxic - label, 0)), -np.inf) for label in (0, 1)]

    def figures(self, words: Words, labels: np.ndarray, table: WordTable) -> np.ndarray:
        """Columns for each document: strongest evidence, words at each level."""
        values, starts = table.rows_of(words), words.starts
        own = np.zeros((len(values), 1 + len(self.levels)))
        toxic = np.repeat(labels, np.diff(starts)).astype(bool)
        for label, rows in enumerate((~toxic, toxic)):
            own[rows, 0] = self.without_own[label][values[rows]].max(axis=1, initial=-np.inf)
        own[:, 1:] = own[:, :1] >= np.asarray(self.levels)
        out = sums(own, starts)
        full = np.flatnonzero(np.diff(starts))
        out[:, 0] = 0
        if len(full):
            out[full, 0] = np.maximum(np.maximum.reduceat(own[:, 0], starts[:-1][full]), 0)
        return out

    def certain(self, words: Iterable[bytes], characters: CharacterModel) -> set[str]:
        """Restored words of letters with evidence far above the highest level."""
        restored = {characters.restore(w.decode("utf-8", "replace")) for w in words}
        return {w for w in restored if w.isalpha() and max(self.learned[features(w)]) >= self.strong + CERTAIN}


def train(texts: list[str], labels: list[int]) -> Scorer:
    """Learn from a few texts in this process, by the steps that `fit` takes on Spark."""
    y = np.asarray(labels)
    if not len(y) or y.min() == y.max():
        return Scorer(None, np.zeros(0), np.zeros(0), [])
    words: Counter = Counter()
    for document in spelled(texts):
        words.update(document)
    characters = CharacterModel.of_words(Counter({w: n for w, n in words.items() if w.isalpha()}))
    learner, found = Learner(characters), np.zeros((2, BUCKETS + 1), np.int64)
    table = WordTable(learner.buckets)
    every = Words(texts)
    learner.count(every, y, table, found)
    odds = Odds(found, (int((y == 0).sum()), int((y == 1).sum())))
    x = features_of(odds.figures(every, y, table))
    weights = logistic(len(odds.levels) + 1, lambda w, used: newton_sums(x, y, np.ones(len(y)), w, used))
    return Scorer(characters, odds.learned, weights, odds.levels, frozenset(odds.certain(table, characters)))


def features_of(figures: np.ndarray) -> np.ndarray:
    """What the logistic function sees: a constant, the strongest evidence, and log(1 + words) at each level."""
    return np.column_stack([np.ones(len(figures)), figures[:, 0], np.log1p(figures[:, 1:])])


def newton_sums(x: np.ndarray, y: np.ndarray, times: np.ndarray, w: np.ndarray, used: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Second and first derivatives of the log-likelihood at weights `w` of the used columns; row k counts times[k]."""
    part = x[:, used]
    p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
    return part.T @ (part * (times * p * (1 - p))[:, None]), part.T @ (times * (y - p))


def logistic(columns: int, sums_at: Callable[[np.ndarray, list[int]], tuple[np.ndarray, np.ndarray]], keep: float = 1e-2) -> np.ndarray:
    """Newton's method with a small ridge; a column whose weight would be negative is left out, the worst first. The sums over
    the documents are made by `sums_at`."""
    used = list(range(columns + 1))
    while True:
        w = np.zeros(len(used))
        for _ in range(40):
            h, g = sums_at(w, used)
            step = np.clip(np.linalg.solve(h + keep * np.eye(len(used)), g - keep * w), -2, 2)
            w += step
            if np.abs(step).max() < 1e-10:
                break
        if len(used) == 1 or w[1:].min() >= 0:
            out = np.zeros(columns + 1)
            out[used] = w
            return out
        used.pop(1 + int(w[1:].argmin()))


def training(docs: DataFrame, labels: DataFrame, held_out_of: int = 5) -> DataFrame:
    """Every distinct (text, label) of a labelled document whose crc32(doc_id) mod `held_out_of` is not 0."""
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where(
        F.col("label").isin(0, 1) & ~is_remainder("doc_id", held_out_of, 0) & F.col("doc_id").isNotNull()).distinct()
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull() & ~is_remainder("doc_id", held_out_of, 0))
    # By doc_id at every size of labels: texts are dealt out once, and their repeated rows lie together for `distinct`.
    return texts.join(usable.hint("merge"), "doc_id").select("doc_id", "text", "label").distinct()


def in_parts(found: dict, most: int = 50_000) -> Iterator[pa.RecordBatch]:
    """A task's counts as rows."""
    keys, numbers = list(found), list(found.values())
    for at in range(0, len(keys), most):
        yield pa.RecordBatch.from_arrays([pa.array(keys[at:at + most], pa.string()), pa.array(numbers[at:at + most], pa.int64())],
                                         names=["key", "n"])


def counted(rows: DataFrame, count: Callable[[pa.RecordBatch], Iterable[dict]]) -> DataFrame:
    """`key` and its number `n` over all rows, from counts of each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for some in slices(batch):
                for more in count(some):
                    found.update(more)
                    if len(found) > COUNTED:
                        yield from in_parts(found)
                        found.clear()
        yield from in_parts(found)

    return rows.mapInArrow(run, "key string, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def learned_characters(rows: DataFrame) -> CharacterModel:
    def words_of(batch: pa.RecordBatch) -> Iterator[dict]:
        for document in spelled(batch.column("text").to_pylist()):
            yield {w: n for w, n in document.items() if w.isalpha()}

    def grams_of(batch: pa.RecordBatch) -> Iterator[dict]:
        yield CharacterModel.longest_grams(zip(batch.column("key").to_pylist(), batch.column("n").to_pylist()))

    longest = counted(counted(rows.select("text"), words_of), grams_of)
    ends = F.expr(f"explode(transform(sequence(1, {CharacterModel.ORDER + 1}), k -> right(key, k)))")
    grams = longest.select(ends.alias("key"), "n").groupBy("key").agg(F.sum("n").alias("n"))
    history = F.expr("left(key, char_length(key) - 1)")
    before = grams.groupBy(history.alias("history")).agg(F.sum("n").alias("before"))
    seen = grams.where("n > 1 OR char_length(key) < 4").withColumn("history", history).join(before, "history")
    found = seen.select("key", "n", "before").toArrow()
    return CharacterModel(zip(*(c.to_pylist() for c in found.columns)))


def learned_odds(rows: DataFrame, characters: CharacterModel, key: tuple, documents: tuple[int, int]) -> Odds:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, table = worker_state(key, lambda: (own := Learner(characters), WordTable(own.buckets, 600_000)))
        found = np.zeros((2, BUCKETS + 1), np.int64)
        for batch in batches:
            for some in slices(batch):
                learner.count(Words(some.column("text")), some.column("label").to_numpy(), table, found)
        at = np.flatnonzero(found.any(axis=0)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[0, at]), pa.array(found[1, at])], names=["bucket", "other", "toxic"])

    parts = rows.select("text", "label").mapInArrow(run, "bucket int, other bigint, toxic bigint")
    total = parts.groupBy("bucket").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic")).toArrow()
    found = np.zeros((2, BUCKETS + 1), np.int64)
    found[:, total["bucket"].to_numpy()] = total["other"].to_numpy(), total["toxic"].to_numpy()
    return Odds(found, documents)


FIGURES = "label int, best double, levels array<double>, word string"
FIGURES_ARROW = pa.schema([("label", pa.int32()), ("best", pa.float64()), ("levels", pa.list_(pa.float64())), ("word", pa.string())])


def document_figures(rows: DataFrame, characters: CharacterModel, odds: Odds, key: tuple) -> DataFrame:
    """A row for each document, and one for each word of certain evidence that a task has found."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, table = worker_state(key, lambda: (own := Learner(characters), WordTable(own.buckets, 600_000)))
        certain: set[str] = set()
        looked_at: set[bytes] = set()
        bar = np.append(odds.learned, -np.inf) >= odds.strong + CERTAIN
        for batch in batches:
            for some in slices(batch):
                labels = some.column("label").to_numpy()
                every = Words(some.column("text"))
                x = odds.figures(every, labels, table)
                yield pa.RecordBatch.from_pylist([{"label": int(label), "best": best, "levels": levels} for label, (best, *levels)
                                                  in zip(labels, x.tolist())], schema=FIGURES_ARROW)
                strong = np.flatnonzero(bar[table.values[table.index]].any(axis=1))
                if len(strong):
                    words = {every.distinct[code] for code in every.codes[strong].tolist()} - looked_at
                    looked_at |= words
                    certain |= odds.certain(words, characters)
        yield pa.RecordBatch.from_pylist([{"word": w} for w in sorted(certain)], schema=FIGURES_ARROW)

    return rows.select("text", "label").mapInArrow(run, FIGURES)


def learned_weights(figures: DataFrame, columns: int) -> np.ndarray:
    """`figures`: label, best, levels and the number `n` of documents that have them."""
    def sums_at(w: np.ndarray, used: list[int]) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(used) + 1, len(used)))
            for batch in batches:
                levels = np.asarray(batch.column("levels").to_pylist()).reshape(len(batch), -1)
                x = features_of(np.column_stack([batch.column("best").to_numpy(), levels]))
                h, g = newton_sums(x, batch.column("label").to_numpy(), batch.column("n").to_numpy(), w, used)
                total += np.vstack([h, g])
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["sums"])

        total = sum(np.asarray(r.sums) for r in figures.mapInArrow(run, "sums array<double>").collect())
        total = total.reshape(len(used) + 1, len(used))
        return total[:-1], total[-1]

    return logistic(columns, sums_at)


def fit(docs: DataFrame, labels: DataFrame) -> Scorer:
    """Learn from all labelled documents whose crc32(doc_id) mod 5 is not 0."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/toxicity-{uuid.uuid4().hex}"
    try:
        training(docs, labels).write.parquet(f"{folder}/rows")
        rows = spark.read.parquet(f"{folder}/rows")
        number = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
        if len(number) < 2:
            return Scorer(None, np.zeros(0), np.zeros(0), [])
        characters = learned_characters(rows)
        key = ("toxicity words", folder)
        odds = learned_odds(rows, characters, key, (number[0], number[1]))
        document_figures(rows, characters, odds, key).write.parquet(f"{folder}/figures")
        figures = spark.read.schema(FIGURES).parquet(f"{folder}/figures")
        strongest = frozenset(r.word for r in figures.where("word IS NOT NULL").select("word").distinct().collect())
        figures.where("word IS NULL").groupBy("label", "best", "levels").agg(F.count("*").alias("n")).write.parquet(f"{folder}/distinct")
        weights = learned_weights(spark.read.parquet(f"{folder}/distinct"), len(odds.levels) + 1)
        return Scorer(characters, odds.learned, weights, odds.levels, strongest)
    finally:
        remove_folder(spark, folder)


def score_column(model: Scorer, text: Column) -> Column:
    """Score from 0 to 1, higher: toxic likelier. A worker keeps the model and the words it has decoded from task to task."""
    key = ("toxicity", zlib.crc32(model.odds.tobytes()), model.weights.tobytes())

    def make():
        scorer, table = worker_state(key, lambda: (model, WordTable(model.word_figures, 600_000)))
        return lambda texts: pa.array(scorer.scores(texts, table), pa.float64())

    return text_udf(make, "double", as_list=False)(text)
