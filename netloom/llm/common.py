"""What several of the operators share: tables cut from their lineage, batches, words."""

from __future__ import annotations

import ctypes
import unicodedata
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from netloom.sources.shared import Tables, shared_dir, written

#: Bytes of text that one step of an Arrow function holds at a time.
BATCH_BYTES = 2 << 20
#: Rows that Spark sends to an Arrow function at a time, at most.
BATCH_ROWS = 500


def row_key(df: DataFrame, *seeds: int) -> list[Column]:
    """A hash of all columns for each seed, nulls told apart from what stands beside them."""
    plain = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if any(t in f.dataType.simpleString() for t in ("map<", "variant")) else F.col(f"`{f.name}`") for f in df.schema.fields]
    absent = [F.isnull(c) for c in plain]
    return [F.xxhash64(F.lit(s), *absent, *plain) for s in seeds]


def trimmed() -> None:
    """Give freed memory back to the system: what one task held is of no use to the next one's other work."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


@contextmanager
def plain_unions(spark: SparkSession) -> Iterator[None]:
    """Unions without a partitioning of their own: with one, Spark 4.1 fails where adaptive execution has merged partitions of one child only."""
    name = "spark.sql.unionOutputPartitioning"
    before = spark.conf.get(name, "true")
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shared_file(spark: SparkSession, local: str, name: str) -> str:
    """Copy a driver's file into the shared folder; its URI there, which executors can fetch at any later time."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    target.getFileSystem(conf).copyFromLocalFile(False, True, jvm.org.apache.hadoop.fs.Path(f"file://{local}"), target)
    return target.toString()


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` with batches of at most ``BATCH_ROWS`` rows, so that buffers on both sides stay small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= BATCH_ROWS:
        df.sparkSession.conf.set(name, str(BATCH_ROWS))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trimmed()

    return df.mapInArrow(whole, schema)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that ``column`` holds about ``most`` bytes in each (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        block = np.cumsum(sizes) // most
        starts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [batch.num_rows]])
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if b > a:
                yield batch.slice(int(a), int(b - a))
                pa.default_memory_pool().release_unused()


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All lower-cased words, one after another, and where each text's begin (one more entry than texts)."""
    if pa.types.is_string(texts.type):
        texts = texts.cast(pa.large_string())
    texts = pc.utf8_lower(pc.fill_null(texts, ""))
    texts = pc.replace_substring_regex(texts, r"[^\pL\pN\pM]+", " ")
    lists = pc.split_pattern(pc.utf8_trim(texts, " "), " ")
    flat, starts = lists.flatten(), np.asarray(pc.list_value_length(lists), dtype=np.int64)
    empty = np.flatnonzero(np.asarray(pc.equal(flat, ""), dtype=bool))
    offsets = np.concatenate([[0], np.cumsum(starts)])
    if len(empty):
        flat = flat.filter(pc.not_equal(flat, ""))
        offsets = offsets - np.searchsorted(empty, offsets)
    return flat, offsets


def _powers(base: int, number: int) -> np.ndarray:
    """base**i for i below ``number``, modulo 2**64."""
    out = np.ones(1, np.uint64)
    while len(out) < number:
        with np.errstate(over="ignore"):
            out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:number]


def gathered(batches: Iterator[pa.RecordBatch], column: str, least: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until ``column`` holds about ``least`` bytes, for work that gains from meeting more rows at once."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.column(column).nbytes
        if size >= least:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


class WordHashes:
    """64-bit hashes of all words of texts, without making the words.

    A word is a run of letters, digits and marks of the lower-cased text.  Its
    hash is a polynomial of its code points modulo 2**64, mixed; sums of powers
    over the whole batch give every word's polynomial by one subtraction.
    """

    BASE = 0x9E3779B97F4A7C15
    BLOCK = 1 << 16

    def __init__(self) -> None:
        self.inside = np.fromiter((unicodedata.category(chr(i))[0] in "LNM" for i in range(1 << 16)), bool, 1 << 16)
        back = pow(self.BASE, -1, 1 << 64)
        self.low, self.low_back = _powers(self.BASE, self.BLOCK), _powers(back, self.BLOCK)
        self.high_base, self.high_back = pow(self.BASE, self.BLOCK, 1 << 64), pow(back, self.BLOCK, 1 << 64)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, where each text's begin; one more entry than texts)."""
        texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
        ends = np.cumsum(np.asarray(pc.utf8_length(texts), dtype=np.int64) + 1)  # a line feed parts texts
        codes = np.frombuffer("\n".join([*texts.to_pylist(), ""]).encode("utf-32-le", "surrogatepass"), "<u4")
        if not len(codes):
            return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
        inside = self.inside[np.minimum(codes, 0xFFFF)]
        far = np.flatnonzero(codes > 0xFFFF)
        if len(far):
            inside[far] = [unicodedata.category(chr(c))[0] in "LNM" for c in codes[far]]
        turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            turns = np.append(0, turns)
        starts, stops = turns[0::2], turns[1::2]
        # The last code is a line feed, so every word has a stop.
        blocks = -(-len(codes) // self.BLOCK)
        high, high_back = _powers(self.high_base, blocks), _powers(self.high_back, blocks)
        with np.errstate(over="ignore"):
            terms = codes.astype(np.uint64)
            for i in range(blocks):
                part = terms[i * self.BLOCK : (i + 1) * self.BLOCK]
                part *= self.low[: len(part)]
                part *= high[i]
            sums = np.cumsum(terms, out=terms)
            total = sums[stops - 1] - np.where(starts > 0, sums[starts - 1], np.uint64(0))
            total *= self.low_back[starts % self.BLOCK] * high_back[starts // self.BLOCK]
            total += (stops - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return mixed(total), np.append(0, np.searchsorted(starts, ends))


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit integers spread evenly (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of ``size`` words and their offsets; a shorter text has one run, an empty one none."""
    counts = np.diff(offsets)
    number = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out = np.concatenate([[0], np.cumsum(number)])
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    owner = np.repeat(np.arange(len(counts)), number)
    at = offsets[:-1][owner] + (np.arange(out[-1]) - out[:-1][owner])
    end = offsets[1:][owner]
    total = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            total = mixed(total * np.uint64(3) + np.where(at + i < end, padded[at + i], np.uint64(0)) + np.uint64(i + 1))
    return total, out


__all__ = ["BATCH_BYTES", "BATCH_ROWS", "Tables", "WordHashes", "gathered", "mapped", "mixed", "plain_unions", "row_key", "shared_dir", "shared_file", "shingle_hashes", "slices", "trimmed", "words", "written"]
