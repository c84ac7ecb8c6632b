"""Tokens, range coder, files and packing: exact round trips."""

from __future__ import annotations

import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from worktempo.llm import packing, queries, range_coder, token_files
from worktempo.llm.tokens import Encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
DATA = Path("/root/testdata/sf0.01")
TOKENIZER = Tokenizer.from_file(PATH)
ENCODER = Encoder(PATH, limit=50)


def plain(text):
    return np.asarray(TOKENIZER.encode(text or "", add_special_tokens=False).ids + [2], "<u4")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abÉé́ΣσßİÅ'.,!-*<|>$ \n\t\x0b\x1c\x85  12٣한ᄒ\U0001F600"), max_size=30), max_size=5))
def test_encoder_equals_the_tokenizer(texts):
    texts = [*texts, "<|endoftext|>x it's A's, 'S", None]
    got = [np.frombuffer(i, "<u4").tolist() for i in ENCODER.encode(texts)]
    assert got == [plain(t).tolist()[:-1] for t in texts]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 6), min_size=1, max_size=300), min_size=1, max_size=6))
def test_coder_round_trip(blocks):
    blocks = [np.asarray(b, np.uint32) for b in blocks]
    assert all((a == b).all() for a, b in zip(range_coder.decode_blocks(range_coder.encode_blocks(blocks)), blocks))


def test_coder_on_large_blocks():
    rng = np.random.default_rng(1)
    blocks = [rng.zipf(1.3, range_coder.BLOCK).clip(max=49_000).astype(np.uint32), np.zeros(range_coder.BLOCK, np.uint32),
              np.arange(range_coder.BLOCK, dtype=np.uint32) % 5, rng.integers(0, 49_000, range_coder.BLOCK).astype(np.uint32)]
    coded = range_coder.encode_blocks(blocks)
    assert all((a == b).all() for a, b in zip(range_coder.decode_blocks(coded), blocks))
    assert (range_coder.decode_blocks(coded[2:3])[0] == blocks[2]).all()  # alone
    assert len(coded[2]) < 2000 and len(coded[1]) < 600
    counts = np.bincount(blocks[0])
    shares = counts[counts > 0] / counts.sum()
    assert len(coded[0]) < 1.25 * range_coder.BLOCK * -(shares * np.log2(shares)).sum() / 8


@pytest.mark.parametrize("at", [0, 3, 30, -3])
def test_damage_is_noticed(at):
    blob = bytearray(range_coder.encode_blocks([np.arange(500, dtype=np.uint32) * 7 % 101])[0])
    blob[at] ^= 255
    with pytest.raises(ValueError):
        range_coder.decode_blocks([bytes(blob)])


def test_coder_of_all_lengths_together():
    """Strands of several lengths in one group, blocks alone and beside others, and all values of 32 bits."""
    rng = np.random.default_rng(2)
    sizes = [1, 2, 255, 256, 511, 512, 513, 767, 5000, range_coder.BLOCK - 1, range_coder.BLOCK] * 7
    blocks = [rng.integers(0, most, n).astype(np.uint32) for n, most in zip(sizes, [1, 2, 50, 40_000, 1 << 32] * 16)]
    coded = range_coder.encode_blocks(blocks)
    assert all((a == b).all() for a, b in zip(range_coder.decode_blocks(coded), blocks, strict=True))
    assert all((range_coder.decode_blocks([c])[0] == b).all() for c, b in zip(coded[:11], blocks))
    assert range_coder.encode_blocks(blocks[7:9]) == coded[7:9]


def test_coder_goes_through_few_positions():
    """The loop over positions is what costs: a block of 16,384 ids takes 256 of them, in one group with 63 others."""
    lengths = range_coder.cut_strands(range_coder.BLOCK)
    assert len(lengths) == 64 and lengths.max() == 256 and lengths.sum() == range_coder.BLOCK
    for n in (1, 300, 1000, 16_383):
        lengths = range_coder.cut_strands(n)
        assert lengths.sum() == n and lengths.min() > 0 and (np.diff(lengths) <= 0).all() and lengths.max() <= 512
    assert len(range_coder.grouped([range_coder.BLOCK] * 128)) == 2


def test_coder_learns_from_all_strands():
    """Ids that came in one strand are cheap in the others: 16,384 ids of few blocks' worth of text take little."""
    ids = np.random.default_rng(3).integers(0, 40_000, 61).astype(np.uint32)
    (blob,) = range_coder.encode_blocks([np.resize(ids, range_coder.BLOCK)])
    assert len(blob) < 2500  # 12,147 bytes by order-0 frequencies alone


def test_damage_of_any_byte_gives_no_other_ids():
    """A ValueError and no other error; the last bits of a strand's last word may tell nothing."""
    ids = np.random.default_rng(4).zipf(1.5, 700).clip(max=9000).astype(np.uint32)
    (blob,) = range_coder.encode_blocks([ids])
    noticed = 0
    for at in [*range(4), *range(16, len(blob), 5)]:
        for flip in (1, 255):
            bad = bytearray(blob)
            bad[at] ^= flip
            try:
                assert (range_coder.decode_blocks([bytes(bad)])[0] == ids).all()
            except ValueError:
                noticed += 1
    assert noticed >= 2 * len(range(16, len(blob), 5))


def test_known_letters_with_other_capitals_and_punctuation_are_not_encoded_again():
    encoder, calls = Encoder(PATH), []

    class Model:
        def tokenize(self, word, model=encoder.model):
            calls.append(word)
            return model.tokenize(word)

    encoder.model = Model()
    texts = ["Zorbellith, zorbellith! ZORBELLITH", "zorbellith", "(zorbellith) Zorbellith,"]
    assert [np.frombuffer(i, "<u4").tolist() for i in encoder.encode(texts)] == [plain(t).tolist()[:-1] for t in texts]
    assert calls.count("zorbellith") == 1


def test_texts_are_taken_by_size(monkeypatch):
    monkeypatch.setattr(token_files, "TEXT_BYTES", 10)
    texts = ["a" * 4, None, "b" * 6, "", "c" * 30, "d", "é" * 5, "e"]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    parts = [p.column("text").to_pylist() for p in token_files.portions(batch)]
    assert sum(parts, []) == texts and [len(p) for p in parts] == [4, 1, 1, 1, 1]
    assert sum([p.column("text").to_pylist() for p in token_files.portions(batch.slice(2, 4))], []) == texts[2:6]
    assert list(token_files.portions(batch.slice(0, 0))) == []


def check_files(rows, texts):
    """texts: (doc_id, text) in the order of the files."""
    start, want = 0, []
    for doc_id, text in texts:
        ids = plain(text)
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows), key=lambda r: r[1]) == want


def test_files_of_odd_rows(spark, odd, no_docs, tmp_path):
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    token_files.write(odd, f"{tmp_path}/a", PATH)
    order = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    check_files(token_files.read(spark, f"{tmp_path}/a").collect(), order)
    token_files.write(no_docs, f"{tmp_path}/b", PATH)
    assert token_files.read(spark, f"{tmp_path}/b").count() == 0


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_files_of_the_whole_table(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    check_files(queries.op8_token_files(spark, str(DATA)).collect(), sorted((r.doc_id, r.text) for r in rows))


def check_packing(rows, texts, padding):
    """Every id in exactly one piece, sequences without gaps; texts: doc_id -> list of texts."""
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        documents[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
    for places in sequences.values():
        places.sort()
        assert [o for o, _ in places] == np.cumsum([0, *(n for _, n in places)])[:-1].tolist()
        assert sum(n for _, n in places) <= 4096
    want = defaultdict(list)
    for doc_id, some in texts.items():
        for text in some:
            ids = plain(text)
            want[doc_id, len(ids)] += [(k, len(ids[k:k + 4096]), zlib.crc32(ids[k:k + 4096].tobytes()))
                                       for k in range(0, len(ids), 4096)]
    assert {k: sorted(v) for k, v in documents.items()} == {k: sorted(v) for k, v in want.items()}
    full = [sum(n for _, n in places) for places in sequences.values()]
    wasted = sum(4096 - n for n in full if n & (n - 1))
    assert wasted <= padding * sum(full)


def test_packing_of_odd_rows(odd, no_docs):
    texts = defaultdict(list)
    for r in odd.collect():
        texts[r.doc_id].append(r.text)
    check_packing(packing.pack(odd, PATH).collect(), texts, 1.0)
    assert packing.pack(no_docs, PATH).count() == 0


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_packing_of_the_whole_table(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    check_packing(queries.op5_packing(spark, str(DATA)).collect(), {r.doc_id: [r.text] for r in rows}, 0.02)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**6), st.integers(0, 500)), max_size=40))
def test_plan_uses_every_piece_once(some):
    sizes = packing.class_sizes(4096)
    histogram = np.zeros(len(sizes), np.int64)
    for k, n in some:
        histogram[k % len(sizes)] += n
    made, used = packing.plan(histogram), np.zeros(len(sizes), np.int64)
    for parts, times in made:
        assert times > 0 and sizes[parts].sum() <= 4096
        np.add.at(used, parts, times)
    assert (used == histogram).all()


def test_least_squares_fills_windows():
    """Lengths that pair up exactly are paired exactly."""
    sizes = packing.class_sizes(4096)
    histogram = np.zeros(len(sizes), np.int64)
    for a in (1024, 2048, 3072, 1600, 2496):
        histogram[np.searchsorted(sizes, a)] = 1000
    assert sum(times for _, times in packing.plan(histogram)) <= 2505  # 10,240,000 ids need 2,500


def test_least_squares_is_an_optimum_with_few_combinations():
    """Conditions of the optimum: nothing unused gains, what is used gains nothing; at most as many as there are classes."""
    rng = np.random.default_rng(5)
    sizes = packing.class_sizes(4096)[::9]
    for most in (3, 1000):
        target = rng.integers(1, most, len(sizes)).astype(float)
        classes, counts = packing.combinations(sizes, 4096, 24)
        filled = (counts * sizes[classes]).sum(axis=1)
        assert filled.max() <= 4096 and filled.min() >= 4096 - 24 and len(classes) == len(np.unique(
            np.concatenate([classes, counts], axis=1), axis=0))
        x = packing.least_squares(classes, counts, target)
        left = target - np.bincount(classes.ravel(), (counts * x[:, None]).ravel(), len(sizes))
        gain = (counts * left[classes]).sum(axis=1)
        assert (x >= 0).all() and (x > 0).sum() <= len(sizes)
        assert gain.max() <= 1e-6 * most and abs(gain[x > 0]).max() <= 1e-6 * most


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_least_squares_places_most_pieces_of_the_whole_table():
    texts = pq.read_table(f"{DATA}/documents.parquet", columns=["text"]).column("text").to_pylist()
    sizes, histogram = packing.class_sizes(4096), np.zeros(len(packing.class_sizes(4096)), np.int64)
    for text in texts:
        full, rest = divmod(len(plain(text)), 4096)
        histogram[-1] += full
        if rest:
            histogram[np.searchsorted(sizes, rest)] += 1
    present = np.flatnonzero(histogram)
    classes, counts = packing.combinations(sizes[present], 4096, 24)
    x = packing.least_squares(classes, counts, histogram[present].astype(float))
    assert (np.floor(x + 1e-6)[:, None] * counts).sum() >= 0.6 * histogram.sum()
    assert sum(times for _, times in packing.plan(histogram)) <= 1.01 * (histogram * sizes).sum() / 4096 + 1


def test_places_are_distinct_and_dense():
    made = [([3, 3, 1], 5), ([3], 2), ([1, 0], 4)]
    runs = packing.places(made, 4)
    assert (np.diff(runs["key"]) > 0).all()
    for k, count in ((0, 4), (1, 9), (3, 12)):
        seen = set()
        for n in range(count):
            at = np.searchsorted(runs["key"], k * (1 << 44) + n, side="right") - 1
            seen.add((int(runs["sequence"][at] + n - runs["first"][at]), int(runs["slot"][at])))
        assert len(seen) == count
