"""Fingerprints, links and components against brute force."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
import xxhash

from worktempo.llm import queries, simhash

DATA = Path("/root/testdata/sf0.01")
MASK = (1 << 64) - 1


def plain_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in lowered.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and bin((a ^ b) & MASK).count("1") <= 3:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {f: find(f) for f in fps}


@pytest.fixture(scope="module")
def clustered():
    rng, fps = random.Random(1), set()
    for _ in range(40):
        base = rng.getrandbits(64)
        fps.add(base)
        for _ in range(rng.choice([0, 2, 40])):
            fp = base
            for _ in range(rng.randrange(1, 6)):
                fp ^= 1 << rng.randrange(20)
            fps.add(fp)
    return sorted(map(simhash.signed, fps))


@pytest.mark.parametrize("most", [512, 10, 2])
def test_links_are_all_close_pairs(spark, clustered, most):
    """Also where nearly every key is hot, so that both finer levels are used."""
    got = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(f,) for f in clustered], "fp bigint"), most).collect()]
    want = {(a, b) for a in clustered for b in clustered if a < b and bin((a ^ b) & MASK).count("1") <= 3}
    assert len(got) == len(set(got)) and set(got) == want


def test_components(spark, clustered):
    fps = spark.createDataFrame([(f,) for f in clustered], "fp bigint")
    got = {r.fp: r.root for r in simhash.components(simhash.links(fps)).collect()}
    assert {f: got.get(f, f) for f in clustered} == plain_components(clustered)


def test_a_long_chain_is_one_component(spark):
    pairs = spark.createDataFrame([(k, k + 1) for k in range(300)], "a bigint, b bigint")
    assert {r.root for r in simhash.components(pairs).collect()} == {0}


def test_three_differing_bits_always_share_blocks():
    masks, rng = simhash.block_masks(list(range(64)), 6, 3), random.Random(2)
    for _ in range(2000):
        change = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(not change & m for m in masks)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_whole_table_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    fps = {d: plain_fingerprint(t) for d, t in texts.items()}
    roots = plain_components(sorted(set(fps.values())))
    first = {}
    for d in sorted(fps):
        first.setdefault(roots[fps[d]], d)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op6_simhash(spark, str(DATA)).collect()}
    assert got == {d: (f"{f:016x}", first[roots[f]]) for d, f in fps.items()}


def test_odd_rows(odd, no_docs):
    rows = simhash.assigned(odd).collect()
    assert len(rows) == 11 and simhash.assigned(no_docs).count() == 0
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[1].fingerprint == by[2].fingerprint == by[3].fingerprint == "0" * 16
    assert by[3].component_id == 1 and by[6].component_id == 5
    kept = simhash.keep_first(odd)
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert kept.columns == odd.columns and [i for none, i in ids if not none] == [1, 4, 5, 7, 8]
    assert sum(none for none, _ in ids) == 1  # the other row without an id is empty and joins document 1
    assert simhash.keep_first(no_docs).count() == 0
