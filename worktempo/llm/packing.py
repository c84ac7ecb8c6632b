"""Packing of documents into training sequences by non-negative least squares.

Each document is tokenised and cut into full windows and one rest; a piece belongs to the smallest of some 300 length
classes that holds it (every length up to 64, then steps of 16). Combinations of up to three classes, two of them up to four times, that nearly
fill a window are enumerated; non-negative least squares finds how often to use each so that their sum meets the histogram
of lengths, the counts are rounded (as far as there are pieces), and what is left is packed greedily, largest class first.
All of this works on the histogram, whose size does not depend on the corpus. Pieces then take their places by number: a piece is numbered within
its class (number in its task plus the pieces of that class in the tasks before), and the plan says which sequence the
n-th piece of a class goes to. Nothing is gathered and no piece waits for another.

Defined results: a NULL or empty text is the end id alone; NULL and repeated doc_ids are packed each; further columns are
kept out; an empty table gives no rows. A sequence ends a little short of the window, at most
by the slack where least squares made it: its padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worktempo.llm.common import cut, slices, worker_state
from worktempo.llm.tokens import Encoder

PIECE = ("part int, doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, class int, "
         "number bigint")
NAMES = ["part", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "number"]


def class_sizes(window: int) -> np.ndarray:
    """Largest length of each class."""
    return np.unique(np.concatenate([np.arange(1, min(64, window) + 1), np.arange(80, window + 16, 16).clip(0, window)]))


def pieces(docs: DataFrame, tokenizer: str, end_id: int, window: int) -> DataFrame:
    """Pieces of every document with their class and number within the task."""
    sizes, end = class_sizes(window), end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_state(("encoder", tokenizer), lambda: Encoder(tokenizer))
        part, used = TaskContext.get().partitionId(), np.zeros(len(sizes), np.int64)
        for batch in batches:
            for some in slices(batch):
                rows = []
                for doc_id, ids in zip(some.column("doc_id").to_pylist(), encoder.encode(some.column("text"))):
                    data = ids + end
                    for at in range(0, len(data), 4 * window):
                        piece = data[at:at + 4 * window]
                        rows.append((doc_id, at // 4, len(piece) // 4, zlib.crc32(piece), len(data) // 4))
                kinds = np.searchsorted(sizes, [r[2] for r in rows])
                numbers = np.empty(len(rows), np.int64)
                for k, kind in enumerate(kinds.tolist()):
                    numbers[k] = used[kind]
                    used[kind] += 1
                columns = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), part, np.int32)), *columns, pa.array(kinds.astype(np.int32)),
                     pa.array(numbers)], names=NAMES)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, PIECE)


def combinations(sizes: np.ndarray, window: int, slack: int, deep: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(classes, counts), three of each a row, that fill the window but for `slack`: one class up to `deep` times, another up
    to `deep` times or not at all, and once the largest that still fits. Counts of 0 are places without a class."""
    one = np.arange(len(sizes))
    found = []
    for i in range(deep + 1):
        for j in range(min(i, deep) + 1):
            a, b = (one, one[:1]) if i == 0 else (one[:, None], one[:1] if j == 0 else one)
            a, b = (v.ravel() for v in np.broadcast_arrays(a, b))
            left = window - i * sizes[a] - j * sizes[b]
            c = np.searchsorted(sizes, left, side="right") - 1
            last = (left > 0) & (c >= 0)
            rest = left - np.where(last, sizes[c], 0)
            fits = (rest >= 0) & (rest <= slack) & ((a != b) | (j == 0))
            classes = np.stack([a, b, np.maximum(c, 0)], axis=1)[fits]
            counts = np.stack([np.full(len(a), i), np.full(len(a), j), last.astype(int)], axis=1)[fits]
            found.append(np.concatenate([classes, counts], axis=1))
    every = np.unique(np.concatenate(found), axis=0)
    return every[:, :3], every[:, 3:]


def fitted(basis: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Least squares over the rows of basis: normal equations, improved once by what they leave."""
    gram = basis @ basis.T
    try:
        x = np.linalg.solve(gram, basis @ target)
        return x + np.linalg.solve(gram, basis @ (target - x @ basis))
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(basis.T, target, rcond=None)[0]


def least_squares(classes: np.ndarray, counts: np.ndarray, target: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """x >= 0 with the smallest squared difference of the combinations' sum from the histogram, by an active set.

    The combination that gains most enters, the others are solved anew, and those that would turn negative leave. So at most
    as many combinations as there are classes are used, and rounding costs each of them less than one sequence. A set never
    comes twice, since the difference falls; the bound on steps is for rounding errors alone.
    """
    bound = tolerance * max(1.0, float(target.max()))
    used, x = np.zeros(0, np.int64), np.zeros(0)
    basis, left = np.zeros((0, len(target))), target.astype(float)
    useless = np.zeros(len(classes), bool)
    columns = [(kind.copy(), many.astype(float)) for kind, many in zip(classes.T, counts.T)]
    for _ in range(8 * len(target)):
        gain = sum(many * left[kind] for kind, many in columns)
        gain[used] = gain[useless] = 0
        k = int(np.argmax(gain))
        if gain[k] <= bound:
            break
        used, x = np.append(used, k), np.append(x, 0.0)
        basis = np.vstack([basis, np.bincount(classes[k], counts[k], len(target))])
        solved = fitted(basis, target)
        if solved[-1] <= 0:  # gains by rounding errors only
            useless[k] = True
            used, x, basis = used[:-1], x[:-1], basis[:-1]
            continue
        while (solved <= 0).any():
            falling = solved <= 0
            pace = (x[falling] / (x[falling] - solved[falling]).clip(1e-300)).min()
            x = x + pace * (solved - x)
            keep = ~falling | (x > bound)
            keep[np.flatnonzero(falling)[np.argmin(x[falling])]] = False
            used, x, basis = used[keep], x[keep], basis[keep]
            solved = fitted(basis, target)
        x, left = solved, target - solved @ basis
        useless[:] = False
    out = np.zeros(len(classes))
    out[used] = x
    return out


def plan(histogram: np.ndarray, window: int = 4096, slack: int = 24) -> list[tuple[list[int], int]]:
    """(classes of a sequence, how many such sequences): together exactly the pieces of the histogram."""
    sizes, left = class_sizes(window), histogram.astype(np.int64).copy()
    present = np.flatnonzero(left)
    if not len(present):
        return []
    out: list[tuple[list[int], int]] = []
    classes, counts = combinations(sizes[present], window, slack)
    if len(classes):
        x = least_squares(classes, counts, left[present].astype(float))
        whole = np.floor(x + 1e-6)
        for wanted in (whole, np.rint(x) - whole):  # whole repeats first, then those that rounding adds
            for k in np.argsort(-np.where(wanted > 0, x, 0), kind="stable"):
                if wanted[k] <= 0:
                    break
                parts = np.repeat(present[classes[k]], counts[k])
                some, need = np.unique(parts, return_counts=True)
                times = int(min(wanted[k], (left[some] // need).min()))
                if times:
                    out.append((parts.tolist(), times))
                    left[some] -= times * need
    while left.any():
        room, need = window, np.zeros(len(left), np.int64)
        while True:
            fits = np.flatnonzero((left > need) & (sizes <= room))
            if not len(fits):
                break
            k = int(fits[-1])
            many = min(int(left[k] - need[k]), room // int(sizes[k]))
            need[k] += many
            room -= many * int(sizes[k])
        used = np.flatnonzero(need)
        times = int((left[used] // need[used]).min())
        out.append((np.repeat(used, need[used])[::-1].tolist(), times))
        left -= times * need
    return out


def places(made: list[tuple[list[int], int]], classes: int) -> dict[str, np.ndarray]:
    """For each class, runs of piece numbers in order: key (class and first number), sequence of the first, place in it."""
    used, sequence, rows = np.zeros(classes, np.int64), 0, []
    for parts, times in made:
        for slot, k in enumerate(parts):
            rows.append((k, int(used[k]), sequence, slot))
            used[k] += times
        sequence += times
    rows.sort()
    table = np.asarray(rows, np.int64).reshape(-1, 4)
    return {"key": table[:, 0] * (1 << 44) + table[:, 1], "first": table[:, 1], "sequence": table[:, 2], "slot": table[:, 3]}


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = 4096) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece."""
    found = cut(pieces(docs, tokenizer, end_id, window))
    by_task = cut(found.groupBy("class", "part").agg(F.count("*").alias("n")))
    histogram = np.zeros(len(class_sizes(window)), np.int64)
    for row in by_task.groupBy("class").agg(F.sum("n").alias("n")).collect():  # a row for each class
        histogram[row["class"]] = row["n"]
    runs = places(plan(histogram, window), len(histogram))
    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.select("class", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    numbered = found.join(offsets, ["class", "part"]).withColumn("number", F.col("number") + F.col("earlier"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.column("class").to_numpy().astype(np.int64)
            number = batch.column("number").to_numpy()
            at = np.searchsorted(runs["key"], kind * (1 << 44) + number, side="right") - 1
            added = [pa.array(runs["sequence"][at] + number - runs["first"][at]), pa.array(runs["slot"][at])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in NAMES[1:6]), *added],
                                             names=[*NAMES[1:6], "sequence_id", "slot"])

    kinds = ", ".join(f"{n} bigint" for n in [*NAMES[1:6], "sequence_id", "slot"])
    placed = numbered.select(*NAMES).mapInArrow(assign, kinds)
    earlier = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0))).drop("slot")
