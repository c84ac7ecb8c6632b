"""Token ids of whole texts with a public tokenizer, remembered by word.

The tokenizer splits at white space before anything else that matters (its added tokens hold none), so the ids of a text are
those of its ASCII-space separated chunks in order. Arrow splits many texts and finds the distinct chunks; the ids of the
texts are gathered from theirs. Chunks recur, so each is encoded once while it is remembered. The
memory is bounded: all is forgotten when more than `limit` chunks are known. That changes no result.

A chunk of letters with ASCII punctuation after them is two pre-tokens, or one; it goes to the tokenizer's model directly
(in lower case, its bytes as the printable characters of byte-level tokenizers), which saves most of the library's work for
one word. ASCII letters are remembered without capitals and punctuation too, since most new chunks are known words with
others. Every other chunk goes through the whole tokenizer.
"""

from __future__ import annotations

import os
import string
import unicodedata
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from worktempo.llm.common import Words

#: Words whose ids are put together at a time.
AT_ONCE = 1 << 19
PUNCTUATION = string.punctuation.replace("'", "").encode()


def printable_bytes() -> dict[int, str]:
    """The byte-level alphabet: a printable Latin-1 character stands for itself, the others follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(others)}


class Encoder:
    """Ids as little-endian unsigned 32-bit integers. `path` is a tokenizer file present on every machine."""

    def __init__(self, path: str, limit: int = 800_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.model, self.shown = self.tokenizer.model, printable_bytes()
        self.forget()

    def forget(self) -> None:
        """No chunk is known: none has a number, the ids of none are in `ids`, from its place in `first` to the next one."""
        self.known: dict[bytes, int] = {}
        self.ids, self.first, self.tails = array("I"), array("q", [0]), {}

    def add(self, chunk: bytes, ids: Iterable[int]) -> int:
        at = self.known[chunk] = len(self.first) - 1
        self.ids.extend(ids)
        self.first.append(len(self.ids))
        return at

    def learn(self, chunks: Iterable[bytes]) -> None:
        """Remember the ids of chunks that are not known."""
        others = [chunk for chunk in chunks if not self.simple(chunk)]
        found = self.tokenizer.encode_batch_fast([c.decode("utf-8", "replace") for c in others], add_special_tokens=False)
        for chunk, encoding in zip(others, found):
            self.add(chunk, encoding.ids)

    def simple(self, chunk: bytes) -> bool:
        """Remember a chunk of letters and trailing punctuation; False for any other chunk."""
        core = chunk.rstrip(PUNCTUATION)
        if core.isalpha():  # ASCII letters
            low = core.lower()
            at = self.known.get(low)
            if at is None:
                at = self.add(low, [t.id for t in self.model.tokenize(low.decode())])
            if low == chunk:
                return True
            ids = self.ids[self.first[at]:self.first[at + 1]]
        else:
            word = core.decode("utf-8", "replace")
            low = word.lower()
            if not (word.isalpha() and low.isalpha()) or "Σ" in word or not unicodedata.is_normalized("NFC", word):
                return False
            ids = array("I", [t.id for t in self.model.tokenize(low.encode().decode("latin-1").translate(self.shown))])
        tail = chunk[len(core):]
        if tail:
            if tail not in self.tails:
                if len(self.tails) > 10_000:
                    self.tails = {}
                self.tails[tail] = array("I", [t.id for t in self.model.tokenize(tail.decode())])
            ids += self.tails[tail]
        self.add(chunk, ids)
        return True

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Ids of each text; none for NULL."""
        if len(self.known) > self.limit:
            self.forget()
        words = Words(texts)
        numbers = list(map(self.known.get, words.distinct))
        if None in numbers:
            gaps = [k for k, number in enumerate(numbers) if number is None]
            self.learn(c for c in [words.distinct[k] for k in gaps] if c not in self.known)
            for k in gaps:
                numbers[k] = self.known[words.distinct[k]]
        numbers = np.array(numbers, np.int64)
        ids, bounds = np.frombuffer(self.ids, np.uint32), np.frombuffer(self.first, np.int64)
        first, lengths = bounds[numbers], bounds[numbers + 1] - bounds[numbers]
        # Texts together that have at most AT_ONCE words, or one text.
        starts, at, out = words.starts, 0, []
        while at < len(starts) - 1:
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + AT_ONCE, side="right")) - 1)
            codes = words.codes[starts[at]:starts[to]]
            counts = lengths[codes]
            ends = np.append(0, np.cumsum(counts))
            data = ids[np.arange(ends[-1]) + np.repeat(first[codes] - ends[:-1], counts)].astype("<u4", copy=False).tobytes()
            cuts = (4 * ends[starts[at:to + 1] - starts[at]]).tolist()
            out += [data[a:b] for a, b in zip(cuts, cuts[1:])]
            at = to
        return out
