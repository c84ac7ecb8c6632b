"""Token ids of documents as files: written in ascending doc_id order, read back by block.

Documents are dealt out by doc_id range and sorted, each task encodes its texts, and ids are stored by the range coder in
blocks of 16,384 ids. The files are a Parquet table, so that Spark commits them on any store and repeats lost tasks; a row
holds some whole documents: their ids and lengths, the position of the first id in its part, and the blocks as bytes. A
document longer than a block spans several blocks of its row. Any row can be decoded without the others.

Defined results: a NULL or empty text is the end id alone; NULL doc_ids come first; equal doc_ids are ordered by text and
kept each; further columns are not written; a damaged block fails with ValueError; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from worktempo.llm.common import slices, worker_state
from worktempo.llm.range_coder import BLOCK, LANES, decode_blocks, encode_blocks
from worktempo.llm.tokens import Encoder

#: Ids after which a row is closed; blocks after which they are coded; bytes of texts encoded at a time (or one text).
ROW_IDS, WAITING, TEXT_BYTES = 16 * BLOCK, 4 * LANES, 1 << 23

FILE = "part int, first bigint, doc_ids array<bigint>, lengths array<bigint>, blocks array<binary>"
FILE_ARROW = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                        ("lengths", pa.list_(pa.int64())), ("blocks", pa.list_(pa.binary()))])


def cut_blocks(ids: np.ndarray) -> list[np.ndarray]:
    return [ids[k:k + BLOCK] for k in range(0, len(ids), BLOCK)]


def coded_rows(part: int, rows: list[tuple[int, list, list, bytes]]) -> pa.RecordBatch:
    cuts = [cut_blocks(np.frombuffer(ids, "<u4")) for *_, ids in rows]
    blobs = iter(encode_blocks([b for cut in cuts for b in cut]))
    return pa.RecordBatch.from_pylist([
        {"part": part, "first": first, "doc_ids": docs, "lengths": lengths, "blocks": [next(blobs) for _ in cut]}
        for (first, docs, lengths, _), cut in zip(rows, cuts)], schema=FILE_ARROW)


def portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Some rows at a time, of at most TEXT_BYTES of text: the more, the fewer words are met again."""
    ends = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(), dtype=np.int64))
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + TEXT_BYTES, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Write the ids of docs (doc_id, text) to the folder `path`; `tokenizer` is a file that every machine has."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_state(("encoder", tokenizer), lambda: Encoder(tokenizer))
        part, total, waiting = TaskContext.get().partitionId(), 0, 0
        rows, doc_ids, lengths, pieces, size = [], [], [], [], 0

        def close() -> None:
            nonlocal total, waiting, doc_ids, lengths, pieces, size
            rows.append((total, doc_ids, lengths, b"".join(pieces)))
            total, waiting = total + size, waiting + -(-size // BLOCK)
            doc_ids, lengths, pieces, size = [], [], [], 0

        for batch in batches:
            for some in portions(batch):
                for doc_id, ids in zip(some.column("doc_id").to_pylist(), encoder.encode(some.column("text"))):
                    doc_ids.append(doc_id)
                    lengths.append(len(ids) // 4 + 1)
                    pieces += [ids, end]
                    size += lengths[-1]
                    if size >= ROW_IDS:
                        close()
                        if waiting >= WAITING:
                            yield coded_rows(part, rows)
                            rows, waiting = [], 0
        if doc_ids:
            close()
        if rows:
            yield coded_rows(part, rows)

    ordered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, FILE).write.mode("overwrite").parquet(path)


def decoded(batch: pa.RecordBatch) -> Iterator[tuple[dict, np.ndarray]]:
    """Rows of a file with their ids, many blocks at a time."""
    rows, waiting = [], 0
    for row in (r for some in slices(batch, 16) for r in some.to_pylist()):
        rows.append(row)
        waiting += len(row["blocks"])
        if waiting >= WAITING:
            yield from with_ids(rows)
            rows, waiting = [], 0
    yield from with_ids(rows)


def with_ids(rows: list[dict]) -> Iterator[tuple[dict, np.ndarray]]:
    ids = iter(decode_blocks([b for row in rows for b in row["blocks"]]))
    for row in rows:
        yield row, np.concatenate([next(ids) for _ in row["blocks"]] or [np.zeros(0, np.uint32)])


READ = "part int, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and crc32 of the ids of every document of the files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, ids in decoded(batch):
                lengths = np.asarray(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                if ends[-1] != len(ids):
                    raise ValueError("lengths of a row differ from its ids")
                data = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(ends), row["part"], np.int32)), pa.array(row["doc_ids"], pa.int64()),
                    pa.array(row["first"] + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())],
                    names=["part", "doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.read.schema(FILE).parquet(path)
    totals = files.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one small row for each part
    offsets = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return (files.mapInArrow(run, READ).join(offsets, "part")
            .select("doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"))
