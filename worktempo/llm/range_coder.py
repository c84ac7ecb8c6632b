"""Adaptive context-mixing range coder for token ids, over many independent blocks at once.

A block is coded by itself: its alphabet (sorted distinct ids), then its ids in up to 64 strands, with a crc32 over its ids.
The probability of an id mixes three predictions: adaptive order-0 frequencies, the id last seen after the previous id (order
1), and the id last seen after the previous two (order 2). Each prediction has a small confidence, and for each pair of
confidences the block learns how often order 2 or order 1 was right; these rates are the mixing weights. Everything starts
afresh in each block, so a block is read without any other.

A strand is a stretch of the block with a range coder of its own. The strands of a block go forward together and share its
models: all read them as they are before a position, then all teach them. So the models learn from every id of the block, and
numpy works on one position of all strands of many blocks at a time, with models small enough for the processor's caches. The
predicted ids follow at once; order-0 frequencies and mixing weights are refreshed at positions that get rarer.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 1 << 14
STRANDS, STRAND = 64, 256  # most strands of a block; ids of a strand at least, where there are several
LANES = 64  # blocks coded at a time at most
MAGIC = b"TMX2"
HEAD = "<4sIIII"  # magic, ids, alphabet, bytes of the alphabet, crc32 of the ids
HEAD_SIZE = struct.calcsize(HEAD)
HASH = 4096
UNIT, SCALE_BITS = 256, 15  # what the three weights, and the order-0 frequencies add up to (the latter as a power of 2)
SCALE, TOTAL_BITS = 1 << SCALE_BITS, SCALE_BITS + 8
KINDS = 32  # pairs of confidences, and whether both predictions agree
MASK = (1 << 48) - 1


def varints(values: np.ndarray) -> bytes:
    left = values.astype(np.uint64)
    groups = np.stack([left >> np.uint64(7 * k) for k in range(10)], axis=1)
    used = groups > 0
    used[:, 0] = True
    out = (groups & np.uint64(127)).astype(np.uint8)
    out[:, :-1] |= used[:, 1:].astype(np.uint8) << 7
    return out[used].tobytes()


def read_varints(data: bytes, count: int) -> np.ndarray:
    groups = np.frombuffer(data, np.uint8)
    last = groups < 128
    first = np.flatnonzero(np.append(True, last[:-1]))
    if last.sum() != count or count and not last[-1]:
        raise ValueError("alphabet is damaged")
    if not count:
        return np.zeros(0, np.int64)
    within = np.arange(len(groups)) - np.repeat(first, np.diff(np.append(first, len(groups))))
    if within.max() > 8:
        raise ValueError("alphabet is damaged")
    return np.add.reduceat((groups & 127).astype(np.int64) << 7 * within, first)


def cut_strands(size: int) -> np.ndarray:
    """Lengths of the strands of a block of so many ids, falling."""
    length = -(-size // min(max(size // STRAND, 1), STRANDS))
    ends = np.minimum(np.arange(length, size + length, length), size)
    return np.diff(ends, prepend=0)


def ranked(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The alphabet, and the place of each id in it."""
    most = int(ids.max())
    if most >= 1 << 18:
        return np.unique(ids, return_inverse=True)
    seen = np.zeros(most + 1, bool)
    seen[ids] = True
    alphabet = np.flatnonzero(seen)
    rank = np.zeros(most + 1, np.int32)
    rank[alphabet] = np.arange(len(alphabet))
    return alphabet, rank[ids]


class Models:
    """State of all blocks: order-0 cumulative counts, predicted ids with confidence, mixing weights by confidences."""

    def __init__(self, alphabet: np.ndarray, inverse: bool):
        blocks, self.sizes, self.width = len(alphabet), alphabet.tolist(), int(alphabet.max())
        self.counts = np.zeros(blocks * self.width, np.int64)
        self.cum = np.zeros((blocks, self.width + 1), np.int32)
        self.inverse = np.zeros((blocks, SCALE), np.uint16) if inverse else None  # rank at each cumulative count
        self.one = np.zeros(blocks * self.width, np.int32)  # 4 * predicted rank + confidence
        self.two = np.zeros(blocks * HASH, np.int32)
        self.tried = np.full(blocks * KINDS, 8, np.int64)
        self.agree = np.arange(blocks * KINDS) & KINDS // 2 > 0  # both predictions are one, of both weights
        self.hits = np.ones((2, blocks * KINDS), np.int64)  # of order 1 where order 2 was wrong, of order 2

    def refresh(self, done: np.ndarray) -> None:
        """Order-0 frequencies (at least 1, in all SCALE) and weights from the counts so far; done: ids of each block.

        Ids of the alphabet that did not come yet share as much as came of different ids.
        """
        for at, (size, seen) in enumerate(zip(self.sizes, done.tolist())):
            spare, cum = SCALE - size, self.cum[at]
            counts = self.counts[at * self.width:at * self.width + size]
            new = counts == 0
            unseen = int(new.sum())
            if unseen:  # at first all of them
                counts, seen = np.where(new, max(size - unseen, 1), counts * unseen), max(seen + size - unseen, 1) * unseen
            freq = 1 + (counts * spare / seen).astype(np.int64)  # exact: below 2 ** 52
            freq[0] += SCALE - freq.sum()
            np.cumsum(freq, out=cum[1:size + 1])
            cum[size + 1:] = SCALE
            if self.inverse is not None:
                self.inverse[at] = np.repeat(np.arange(size, dtype=np.uint16), freq)
        first, second = self.hits * 248 // self.tried
        first, second = np.where(self.agree, (0 * first, first + second), (first, second))
        self.weights = np.stack([UNIT - first - second, first << SCALE_BITS, second << SCALE_BITS]).astype(np.int32)

    def learn(self, places: np.ndarray, tries: np.ndarray) -> None:
        """Count ids, and tries: 4 * kind, and 1 if order 1 was right, 2 if order 2 was."""
        self.counts += np.bincount(places, minlength=len(self.counts))
        wrong, first, second, both = np.bincount(tries, minlength=4 * len(self.tried)).reshape(-1, 4).T
        self.tried += wrong + first + second + both
        self.hits += first, second + both


def taught(old: np.ndarray, hit: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Predicted ids with their confidences (hits in a row, up to 3); where one was wrong, the id that came takes its place."""
    return np.where(hit, np.minimum(old + 1, old | 3), fresh)


def coded(ranks: np.ndarray, lengths: np.ndarray, block: np.ndarray, alphabet: np.ndarray,
          words: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray] | np.ndarray:
    """Encode ranks (a row for each position, a column for each strand) to 16-bit words of each strand, or decode words to
    ranks, which are filled in.

    Strands are ordered by falling length; `block` tells their blocks, `alphabet` how many ranks each block has. Returns the
    words with their number per strand, or the ranks.
    """
    longest, lanes = ranks.shape
    encode = words is None
    m = Models(alphabet, not encode)
    one, two, cum, width = m.one, m.two, m.cum.ravel(), m.width
    cum_next = cum[1:]
    at = np.arange(lanes) * (2 * longest + 8 if encode else words.shape[1])
    if encode:
        out = np.zeros((lanes, 2 * longest + 8), np.uint16)
        flat, low, begin = out.ravel(), np.zeros(lanes, np.int64), at.copy()
    else:
        inverse, flat = m.inverse.ravel(), words.ravel()
        code = (words[:, 0].astype(np.int64) << 32) | (words[:, 1].astype(np.int64) << 16) | words[:, 2]
        at = at + 3
    span = np.full(lanes, MASK, np.int64)
    active = np.searchsorted(-lengths, -np.arange(1, longest + 1), side="right")
    tries = np.zeros((longest, lanes), np.int32)
    before, before2 = np.zeros((2, lanes), np.int32)
    next_refresh, last, n = 0, 0, -1
    for step in range(longest):
        if step == next_refresh:
            if step:
                past, teach = ranks[last:step, :active[last]] + (block * width)[:active[last]], tries[last:step, :active[last]]
                if n < active[last]:  # some have ended in between
                    some = np.arange(active[last]) < active[last:step, None]
                    past, teach = past[some], teach[some]
                m.learn(past.ravel(), teach.ravel())
            m.refresh(np.bincount(block, np.minimum(lengths, step), len(alphabet)).astype(np.int64))
            weight0, weight1, weight2 = m.weights
            next_refresh, last = max(1, min(step * 4, step + 64)), step
        if active[step] != n:
            n = int(active[step])
            row, hash_row, kind_row = (block[:n] * size for size in (width, HASH, KINDS))
            cum_row, inverse_row = row + block[:n], block[:n] << SCALE_BITS
            before, before2, span = before[:n], before2[:n], span[:n]
            if encode:
                low = low[:n]
            else:
                code = code[:n]
        key1 = row + before
        key2 = hash_row + ((before2 * np.int32(40503) + before * np.int32(2971)) >> 5 & (HASH - 1))
        old1, old2 = one[key1], two[key2]
        guess1, sure1, guess2, sure2 = old1 >> 2, old1 & 3, old2 >> 2, old2 & 3
        same = guess1 == guess2
        kind = kind_row + (same.view(np.int8) * np.int32(16) + (sure2 << 2) + sure1)
        w0, w1, w2 = weight0[kind], weight1[kind], weight2[kind]
        r = span >> TOTAL_BITS
        if encode:
            symbol = ranks[step, :n]
        else:
            # Exact, since both are below 2 ** 52.
            value = np.maximum(np.minimum(code / r, (1 << TOTAL_BITS) - 1), 0).astype(np.int32)
            # The point mass of a guess lies behind its order-0 mass: it is cut out, with what is in it put before the cut.
            lo, hi = np.minimum(guess1, guess2), np.maximum(guess1, guess2)
            w_lo = np.where(guess1 < guess2, w1, w2)
            cut_lo, cut_hi = w0 * cum_next[cum_row + lo], w0 * cum_next[cum_row + hi]
            left = np.maximum(np.minimum(value, cut_lo - 1), value - w_lo)
            left = np.maximum(np.minimum(left, cut_hi - 1), left - (w1 + w2 - w_lo))
            symbol = inverse[inverse_row + (left / w0).astype(np.int32)].astype(np.int32)
            ranks[step, :n] = symbol
        place = cum_row + symbol
        below = cum[place]
        hit1, hit2 = guess1 == symbol, guess2 == symbol
        start = w0 * below + w1 * (guess1 < symbol) + w2 * (guess2 < symbol)
        size = w0 * (cum_next[place] - below) + w1 * hit1 + w2 * hit2
        moved = r * start
        span = r * size
        if encode:
            low = low + moved
        else:
            code = code - moved
        small = np.flatnonzero(span < 1 << 32)
        while len(small):
            narrow, where = span[small] << 16, at[small]
            span[small] = narrow
            at[small] = where + 1
            if encode:
                flat[where] = carried(flat, where, low[small] >> 32)
                low[small] = (low[small] & ((1 << 32) - 1)) << 16
            else:
                code[small] = (code[small] << 16) | flat[where]
            small = small[narrow < 1 << 32]
        if encode and lengths[n - 1] == step + 1:  # strands that end here: any value inside the span will do
            done = np.flatnonzero(lengths[:n] == step + 1)
            flat[at[done]] = carried(flat, at[done], low[done] + ((1 << 32) - 1) >> 32)
            at[done] += 1
        tries[step, :n] = (kind << 2) + (hit2.view(np.int8) * np.int8(2) + hit1.view(np.int8))
        fresh = symbol << 2
        one[key1] = taught(old1, hit1, fresh)
        two[key2] = taught(old2, hit2, fresh)
        before2, before = before, symbol
    return (out, at - begin) if encode else ranks


def carried(flat: np.ndarray, at: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Words to be put at `at`; what overflows 16 bits is added to the words before."""
    back = at[words > 65535] - 1
    while len(back):
        flat[back] += np.uint16(1)
        back = back[flat[back] == 0] - 1
    return words & 65535


def grouped(sizes: list[int]) -> list[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks coded together: which, and for their strands by falling length the length, the block and the first id."""
    groups, order = [], sorted(range(len(sizes)), key=lambda k: -sizes[k])
    count = -(-len(order) // LANES)
    for part in range(count):
        mine = order[part * len(order) // count:(part + 1) * len(order) // count]
        strands = [cut_strands(sizes[k]) for k in mine]
        lengths, block = np.concatenate(strands), np.repeat(np.arange(len(mine)), list(map(len, strands)))
        first = np.concatenate([np.cumsum(s) - s for s in strands])
        falling = np.argsort(-lengths, kind="stable")
        groups.append((mine, lengths[falling], block[falling], first[falling]))
    return groups


def places(lengths: np.ndarray, block: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For a table with a row for each block: where the id at each position of each strand is, and which of them are real."""
    position = np.arange(int(lengths[0]))[:, None]
    return np.minimum(block * width + first + position, (block + 1) * width - 1), position < lengths


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Bytes of each non-empty block of unsigned 32-bit ids."""
    done: list[bytes] = [b""] * len(blocks)
    for mine, lengths, block, first in grouped(list(map(len, blocks))):
        kinds = [ranked(blocks[k]) for k in mine]
        table = np.zeros((len(mine), len(blocks[mine[0]])), np.int32)
        for line, (_, ranks) in zip(table, kinds):
            line[:len(ranks)] = ranks
        where, real = places(lengths, block, first, table.shape[1])
        words, counts = coded(table.ravel()[where] * real, lengths, block, np.asarray([len(ids) for ids, _ in kinds]))
        for at, (k, (ids, _)) in enumerate(zip(mine, kinds)):
            alphabet = varints(np.diff(ids.astype(np.int64), prepend=0))
            crc = zlib.crc32(blocks[k].astype("<u4").tobytes())
            own = np.flatnonzero(block == at)
            used = words[own][np.arange(words.shape[1]) < counts[own, None]]
            done[k] = (struct.pack(HEAD, MAGIC, len(blocks[k]), len(ids), len(alphabet), crc) + alphabet
                       + counts[own].astype("<u2").tobytes() + used.astype("<u2").tobytes())
    return done


def decode_blocks(blobs: list[bytes]) -> list[np.ndarray]:
    """Ids of each block; ValueError if one is damaged."""
    heads = [struct.unpack_from(HEAD, b) for b in blobs]
    if any(h[0] != MAGIC or not h[1] or not h[2] for h in heads):
        raise ValueError("not a block of token ids")
    done: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(blobs)
    for mine, lengths, block, first in grouped([h[1] for h in heads]):
        counts, bodies = np.zeros(len(lengths), np.int64), []
        for at, k in enumerate(mine):
            own, body = np.flatnonzero(block == at), np.frombuffer(blobs[k][HEAD_SIZE + heads[k][3]:], "<u2")
            counts[own] = body[:len(own)]
            bodies.append(body[len(own):])
            if counts[own].sum() != len(bodies[-1]) or counts[own].max() > 2 * lengths[0]:
                raise ValueError("strands of a block are damaged")
        words = np.zeros((len(lengths), 2 * int(lengths[0]) + 8), np.uint16)
        for at, body in enumerate(bodies):
            own = np.flatnonzero(block == at)
            some = np.zeros((len(own), words.shape[1]), np.uint16)
            some[np.arange(words.shape[1]) < counts[own, None]] = body
            words[own] = some
        alphabets = [np.cumsum(read_varints(blobs[k][HEAD_SIZE:HEAD_SIZE + heads[k][3]], heads[k][2])) for k in mine]
        ranks = coded(np.zeros((int(lengths[0]), len(lengths)), np.int32), lengths, block,
                      np.asarray(list(map(len, alphabets))), words)
        table = np.zeros((len(mine), heads[mine[0]][1]), np.int32)
        where, real = places(lengths, block, first, table.shape[1])
        table.ravel()[where[real]] = ranks[real]
        for line, k, alphabet in zip(table, mine, alphabets):
            ids = alphabet[line[:heads[k][1]]].astype(np.uint32)
            if zlib.crc32(ids.astype("<u4").tobytes()) != heads[k][4]:
                raise ValueError("checksum of a block differs")
            done[k] = ids
    return done
