"""Helpers shared by the operators: text columns in Arrow batches, worker-wide state, cut lineage, bounded samples."""

from __future__ import annotations

import itertools
import sys
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows taken from an Arrow batch at a time, so that Python holds few texts at once.
SLICE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or one beside the warehouse where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    folder = folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_llm"
    if folder.startswith("file:") and not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.master.startswith("local")):
        raise ValueError(f"spark.checkpoint.dir is not set, and {folder} is a folder of one machine only")
    return folder


def remove_folder(spark: SparkSession, path: str) -> None:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


def cut(df: DataFrame) -> DataFrame:
    """Compute df once and cut its lineage by a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def remainder(column: str | Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo; NULL stays NULL."""
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")) % modulus


def is_remainder(column: str, modulus: int, value: int) -> Column:
    return F.coalesce(remainder(column, modulus) == value, F.lit(False))


def sampled(key: Column, rows: int, wanted: int) -> Column:
    """True for about `wanted` of `rows` rows, chosen by a hash of the key: the same rows in every run."""
    share = min(1.0, wanted / max(rows, 1))
    return F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 20)) < int(share * (1 << 20))


def worker_state(key: tuple, make: Callable[[], object]):
    """One object per Python worker and key, kept from task to task (caches and loaded models)."""
    holder = sys.modules.setdefault("_llm_worker_state", types.ModuleType("_llm_worker_state"))
    if getattr(holder, "key", None) != key:
        holder.key, holder.value = key, make()
    return holder.value


def slices(batch: pa.Array | pa.RecordBatch, size: int = SLICE) -> Iterator:
    for at in range(0, len(batch), size):
        yield batch.slice(at, size)


def boxed(docs: DataFrame, *beside: str) -> DataFrame:
    """All columns as one struct `row`, so that they cannot clash with an operator's own, and some of them beside it."""
    return docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), *(docs[c] for c in beside))


def text_udf(make: Callable[[], Callable[[list | pa.Array], pa.Array]], kind: str, as_list: bool = True):
    """Column function over texts. `make` runs once per task and gives a function from texts (as a list, or as they come in
    Arrow) to an Arrow array.

    Marked as not deterministic only so that Spark evaluates it once where a filter and a projection both use it.
    """
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        each = make()
        for column in columns:
            parts = list(slices(column)) or [column]
            parts = [each(part.to_pylist() if as_list else part) for part in parts]
            yield pa.concat_arrays(parts) if len(parts) > 1 else parts[0]

    run.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind).asNondeterministic()


def struct_array(**columns: np.ndarray | list | pa.Array) -> pa.Array:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()]
    return pa.StructArray.from_arrays(arrays, names=list(columns))


class WordTable(dict):
    """Rows of figures for distinct words; `compute` makes them for the words not met before, many at once.

    After `rows`, `index` numbers the words of the last documents: equal numbers, equal words.
    Forgets everything when it holds more than `limit` words, so memory is bounded and results do not change.
    """

    def __init__(self, compute: Callable[[list[bytes]], np.ndarray], limit: int = 300_000):
        super().__init__()
        self.compute, self.limit, self.fresh, self.values = compute, limit, [], None

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        self.fresh.append(word)
        return at

    def rows(self, documents: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Figures of all words in order, and where each document begins in them (one more entry: the end)."""
        if len(self) > self.limit:
            self.clear()
            self.values = None
        starts = np.concatenate([[0], np.cumsum([len(d) for d in documents], dtype=np.int64)]).astype(np.int64)
        index = np.fromiter(map(self.__getitem__, itertools.chain.from_iterable(documents)), np.int64, starts[-1])
        return self.values_at(index), starts

    def rows_of(self, words: Words) -> np.ndarray:
        """Figures of all words of some texts in order."""
        if len(self) > self.limit:
            self.clear()
            self.values = None
        index = np.fromiter(map(self.__getitem__, words.distinct), np.int64, len(words.distinct))
        return self.values_at(index[words.codes])

    def values_at(self, index: np.ndarray) -> np.ndarray:
        if self.fresh or self.values is None:
            made = self.compute(self.fresh)
            self.values = made if self.values is None else np.concatenate([self.values, made])
            self.fresh = []
        self.index = index
        return self.values[index]


class Words:
    """Words between ASCII white space of many texts (NULL: none): every distinct one in UTF-8, which of them the texts hold in
    order, and where each text begins in that (one more entry: the end)."""

    def __init__(self, texts: list[str | None] | pa.Array):
        if not isinstance(texts, pa.Array):
            texts = pa.array([t and t.encode("utf-8", "replace") for t in texts], pa.binary()).cast(pa.string())
        cut = pc.ascii_split_whitespace(texts.fill_null(""))
        words = cut.flatten().dictionary_encode()
        self.distinct: list[bytes] = words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        codes, starts = words.indices.to_numpy(), cut.offsets.to_numpy().astype(np.int64)
        starts = starts - starts[0] if len(starts) else np.zeros(1, np.int64)
        if b"" in self.distinct:  # beside white space at the ends of a text
            empty = self.distinct.index(b"")
            kept = codes != empty
            starts = np.concatenate([[0], np.cumsum(kept)])[starts]
            codes = codes[kept]
            codes = codes - (codes > empty)
            del self.distinct[empty]
        self.codes, self.starts = codes, starts


def split_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, as UTF-8; none for NULL."""
    return text.encode("utf-8", "replace").split() if text else []


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Column sums of each document's rows; zero for documents without rows. Equal documents have equal sums."""
    out = np.zeros((len(starts) - 1, *values.shape[1:]))
    full = np.flatnonzero(np.diff(starts))
    if len(full):
        out[full] = np.add.reduceat(values, starts[:-1][full], axis=0, dtype=np.float64)
    return out


def repeats(index: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Words of each document that equal the word before them."""
    same = np.zeros(len(index))
    same[1:] = index[1:] == index[:-1]
    same[starts[:-1][np.diff(starts) > 0]] = 0
    return sums(same, starts)


def ngram_buckets(words: Iterable[str], orders: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets (a power of two) of the character n-grams of each <word>, and the word each belongs to."""
    words = list(words)
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), lengths)
    room = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))
    ids, owners = [], []
    for n in orders:
        h = np.full(max(len(codes) - n + 1, 0), n, np.uint64)
        for k in range(n):
            h = (h ^ codes[k:len(h) + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        inside = room[:len(h)] >= n
        ids.append((h[inside] & np.uint64(buckets - 1)).astype(np.int64))
        owners.append(owner[:len(h)][inside])
    return np.concatenate(ids), np.concatenate(owners)
