"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint has 64 bits; a bit is 1 if it is set in over half of the XXH64 hashes of the document's 3-word shingles. Two
fingerprints link if they differ in at most three bits. Cut into six blocks, a close pair shares at least three of them, so
pairs are looked for only among fingerprints that agree on one of the 20 choices of three blocks (31 to 33 bits), and the
Hamming distance is checked in the join. Equal fingerprints are merged first, so exact copies cost one row however many
there are. Where more than `most` fingerprints agree on a choice (a hot key), the free bits are cut into six blocks again,
and where that is still hot, into four blocks of which one must agree: a key then leaves at most 12 bits free. Nothing
is dropped and no group is gathered in one task. Components are found by alternating large-star and small-star steps.

Defined results: a NULL or empty text has the fingerprint zero, linked like any other; a document of one or two words has
one shingle, all its words; a NULL doc_id keeps its row, and its component is the smallest doc_id reachable, NULL if there
is none; repeated rows are kept; further columns are kept; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktempo.llm.common import boxed, cut, text_udf

DISTANCE = 3


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """64-bit fingerprints as signed integers. bytes.lower and bytes.split know ASCII letters and white space only."""
    hashes, lengths = [], []
    for text in texts:
        words = (text or "").encode("utf-8", "replace").lower().split()
        if len(words) < 3:
            shingles = [b" ".join(words)] if words else []
        else:
            shingles = map(b"%b %b %b".__mod__, zip(words, words[1:], words[2:]))
        before = len(hashes)
        hashes.extend(xxhash.xxh64_intdigest(s, 42) for s in shingles)
        lengths.append(len(hashes) - before)
    out = np.zeros((len(texts), 8), np.uint8)
    each = np.asarray(hashes, np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8)
    at = 0
    for k, n in enumerate(lengths):
        set_bits = np.zeros(64, np.int64)
        for part in range(at, at + n, 1 << 16):
            set_bits += np.unpackbits(each[part:min(part + (1 << 16), at + n)], axis=1).sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * set_bits > n)
        at += n
    return out.view(">i8").ravel().astype(np.int64)


def fingerprint_column(text: Column) -> Column:
    return text_udf(lambda: lambda texts: pa.array(fingerprints(texts), pa.int64()), "bigint")(text)


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def block_masks(free: list[int], blocks: int, agree: int) -> list[int]:
    """Masks of every choice of `agree` blocks out of the given bit positions cut into `blocks`."""
    cuts = [list(part) for part in np.array_split(np.asarray(free), blocks)]
    return [sum(1 << int(bit) for block in choice for bit in block) for choice in combinations(cuts, agree)]


def finer(masks: list[int], blocks: int, agree: int) -> list[tuple[int, int]]:
    """(mask, wider mask) for every mask and choice of blocks among its free bits."""
    return sorted({(m, m | more) for m in masks
                   for more in block_masks([b for b in range(64) if not m >> b & 1], blocks, agree)})


def keyed(fp: DataFrame, masks: list[int]) -> DataFrame:
    """fp once for every mask, with the bits it must share."""
    each = F.array(*(F.lit(signed(m)) for m in masks))
    return fp.select("fp", F.explode(each).alias("mask")).withColumn("part", F.col("fp").bitwiseAND(F.col("mask")))


def distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def close_pairs(rows: DataFrame) -> DataFrame:
    """Pairs a < b within the distance among rows (fp, mask, part) that agree on mask and part."""
    left = rows.select("mask", "part", F.col("fp").alias("a"))
    right = rows.select("mask", "part", F.col("fp").alias("b"))
    return (left.join(right, ["mask", "part"]).where((F.col("a") < F.col("b")) & (distance("a", "b") <= DISTANCE))
            .select("a", "b"))


def links(fp: DataFrame, most: int = 512) -> DataFrame:
    """Pairs (a, b) of different fingerprints that differ in at most three bits; each pair once, a < b."""
    masks = block_masks(list(range(64)), 6, 3)
    rows, found = keyed(fp, masks), []
    for blocks, agree in ((6, 3), (4, 1)):
        hot = cut(rows.groupBy("mask", "part").count().where(F.col("count") > most).select("mask", "part"))
        if hot.isEmpty():
            break
        found.append(close_pairs(rows.join(hot, ["mask", "part"], "left_anti")))
        wider = finer(masks, blocks, agree)
        masks = sorted({w for _, w in wider})
        steps = fp.sparkSession.createDataFrame(
            [(signed(m), signed(w)) for m, w in wider], "mask bigint, wider bigint")
        rows = cut(rows.join(hot, ["mask", "part"], "left_semi").join(F.broadcast(steps), "mask")  # made of constants
                   .select("fp", F.col("wider").alias("mask")).distinct()
                   .withColumn("part", F.col("fp").bitwiseAND(F.col("mask"))))
    found.append(close_pairs(rows))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(fp, root): every end of a pair with the smallest one reachable. Stars shrink to their smallest member; each step
    is a grouped minimum and a join, so neither a long chain nor a hub needs one task."""
    edges = cut(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.distinct()
        smallest = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(smallest, "u").where(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(smallest.withColumnRenamed("m", "v")).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("fp"), F.col("v").alias("root"))
        before = now


def classes(docs: DataFrame, first: Column, most: int = 512) -> DataFrame:
    """(fp, root, first): every fingerprint of docs (doc_id, fp, ...), its component and the least `first` of it."""
    distinct = cut(docs.groupBy("fp").agg(F.min(first).alias("own")))
    roots = components(links(distinct.select("fp"), most))
    known = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return known.join(known.groupBy("root").agg(F.min("own").alias("first")), "root").select("fp", "root", "first")


def assigned(docs: DataFrame, most: int = 512) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row."""
    fp = cut(docs.select("doc_id", fingerprint_column(F.col("text")).alias("fp")))
    return fp.join(classes(fp, F.col("doc_id"), most), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id"))


def keep_first(docs: DataFrame, most: int = 512) -> DataFrame:
    """One row of each component: its smallest doc_id (rows without one last), then the smallest hash of the text."""
    fp = cut(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), fingerprint_column(F.col("text")).alias("fp")))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    kept = cut(classes(fp, order, most).select("root", "first").distinct()
               .select(F.col("first.doc_id").alias("kept_id"), F.col("first.text_hash").alias("kept_hash")))
    rows = boxed(docs).withColumn("id", F.col("row.doc_id")).withColumn("hash", F.xxhash64("row.text"))
    same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("hash") == F.col("kept_hash"))
    return rows.join(kept, same, "left_semi").dropDuplicates(["id", "hash"]).select("row.*")
