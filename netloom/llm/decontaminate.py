"""Benchmark decontamination: pieces hit exactly, whole items verified by Myers' bit-parallel distance.

Texts are words, lower-cased, without punctuation.  An item of n words may be
found with ``budget(n)`` word edits.  Cut into one piece more than that, at least
one piece stands unchanged in any such passage; all pieces of all items are
looked up together by an Aho-Corasick automaton.  Around each hit, the least edit
distance between the item and any passage of the document is computed by Myers'
algorithm over words (one bit for each word of the item).

Items are the query set.  Up to ``block_chars`` characters of them are one
automaton in the executors' memory, and one pass over the documents; more are
joined to the documents by hashes of pieces, in two passes however many there are,
and each document is then searched for the items that it has a piece of.

Defined results: null or empty texts hold nothing; items without a word match
nothing; items of six words or less have no edit budget, as 15 % of them is none; an item that occurs several
times in a document is reported once, at its best place; repeated rows are
reported each; very long texts are searched whole; empty tables give an empty
result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from netloom.llm.common import Tables, WordHashes, mapped, mixed, row_key, shingle_hashes, slices, words

MATCH = ("item_id", "errors", "n_words", "first_word", "last_word")
#: Bits of a map of keys, at least and at most, and bits that each key sets.
MAP_BITS = 1 << 20, 1 << 28
PROBES = 4


@dataclass(frozen=True)
class Settings:
    #: Edits allowed for each hundred words of an item.
    percent: int = 15
    #: Characters of benchmark text that one automaton holds.
    block_chars: int = 8_000_000
    #: Items, about, that a document is searched for at once where items are joined to documents.
    share: int = 64

    def budget(self, n: int) -> int:
        return n * self.percent // 100


def pieces(item: list[str], count: int) -> list[tuple[int, list[str]]]:
    """The item in ``count`` pieces of nearly equal size, each with its place."""
    cuts = [len(item) * i // count for i in range(count + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


def distance(item: list[str], passage: list[str]) -> tuple[int, int]:
    """Least edit distance between the item and any part of the passage, and the last word of the first such part.

    Myers (1999): the column of the distance table is kept as vertical steps of
    +1 and -1 in two integers; one pass of a few operations serves each word.
    """
    n = len(item)
    full, high = (1 << n) - 1, 1 << (n - 1)
    where: dict[str, int] = defaultdict(int)
    for i, w in enumerate(item):
        where[w] |= 1 << i
    plus, minus, score = full, 0, n
    best, at = n, -1
    for j, w in enumerate(passage):
        same = where.get(w, 0)
        vertical = same | minus
        same = (((same & plus) + plus) ^ plus) | same
        right = minus | (full & ~(same | plus))
        left = plus & same
        if right & high:
            score += 1
        elif left & high:
            score -= 1
        right = (right << 1) & full  # a match may begin anywhere, so row 0 has no step
        left = (left << 1) & full
        plus = left | (full & ~(vertical | right))
        minus = right & vertical
        if score < best:
            best, at = score, j
    return best, at


class Matcher:
    """The automaton of a block of items."""

    def __init__(self, items: list[tuple[int, str]], settings: Settings) -> None:
        import ahocorasick

        flat, offsets = words(pa.array([t for _, t in items], pa.string()))
        flat = flat.to_pylist()
        self.items = [(i, flat[a:b]) for (i, _), a, b in zip(items, offsets[:-1], offsets[1:], strict=True)]
        self.budgets = [settings.budget(len(w)) for _, w in self.items]
        found: dict[str, list[tuple[int, int, int]]] = defaultdict(list)
        for k, (_, w) in enumerate(self.items):
            if w:
                for at, piece in pieces(w, self.budgets[k] + 1):
                    found[f" {' '.join(piece)} "].append((k, at, len(piece)))
        self.automaton = ahocorasick.Automaton()
        for text, places in found.items():
            self.automaton.add_word(text, places)
        self.empty = not found
        if found:
            self.automaton.make_automaton()

    def search(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(item, errors, words of it, first word, last word) of every item found; ``text`` has a blank around each word."""
        if self.empty:
            return []
        spots: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for end, places in self.automaton.iter(text):
            for k, at, size in places:
                spots[k].append((end, at, size))
        if not spots:
            return []
        blanks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == 32)
        parts = text.split()
        out = []
        for k, hits in sorted(spots.items()):
            item_id, item = self.items[k]
            n, budget = len(item), self.budgets[k]
            # The passage that a hit belongs to begins this many words before it, give or take the budget.
            begins = sorted({int(np.searchsorted(blanks, end)) - size - at for end, at, size in hits})
            spans: list[list[int]] = []
            for b in begins:
                low, high = max(0, b - budget), min(len(parts), b + n + budget)
                if spans and low <= spans[-1][1]:
                    spans[-1][1] = max(high, spans[-1][1])
                else:
                    spans.append([low, high])
            best = min((distance(item, parts[a:b]) + (a,) for a, b in spans), key=lambda x: (x[0], x[2] + x[1]))
            errors, last = best[0], best[1] + best[2]
            if errors <= budget and last >= 0:
                tail = parts[max(0, last - n - budget + 1) : last + 1]
                first = last - distance(item[::-1], tail[::-1])[1]
                out.append((item_id, errors, n, first, last))
        return out


def normal(texts: pa.Array) -> pa.Array:
    """Each text as its words with one blank before, between and after them."""
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    texts = pc.utf8_trim(pc.replace_substring_regex(texts, r"[^\pL\pN\pM]+", " "), " ")
    blank = pa.scalar("", pa.large_string())
    return pc.binary_join_element_wise(blank, texts, blank, pa.scalar(" ", pa.large_string()))


def items_of(benchmark: DataFrame) -> DataFrame:
    return benchmark.select("item_id", "text").filter("text is not null and text != ''")


def held(benchmark: DataFrame, settings: Settings) -> list[tuple[int, str]] | None:
    """The items, where one automaton can hold them all; their size is checked first."""
    size = items_of(benchmark).agg(F.sum(F.length("text"))).first()[0] or 0
    return [tuple(r) for r in items_of(benchmark).collect()] if size <= settings.block_chars else None


def places(keys: np.ndarray, size: int) -> np.ndarray:
    """Bits of the map, of ``size`` bits, that belong to each key: one row for each probe."""
    with np.errstate(over="ignore"):
        return np.stack([mixed(keys + np.uint64(i) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(size) for i in range(PROBES)]).astype(np.int64)


def bits(keys: DataFrame, column: str, number: int) -> np.ndarray:
    """A map of the ``number`` keys; it never misses one, and where it is full, it only spares fewer others."""
    size = min(MAP_BITS[1], max(MAP_BITS[0], 1 << (16 * number).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(places(np.asarray(batch.column(column)).view(np.uint64), size))
            yield pa.RecordBatch.from_arrays([pa.array(at // 64), pa.array(np.uint64(1) << (at % 64).astype(np.uint64)).cast(pa.uint64()).view(pa.int64())], ["cell", "bit"])

    found = mapped(keys.select(column), run, "cell long, bit long").groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most size / 64 rows
    out = np.zeros(size // 64, np.int64)
    out[np.asarray(found["cell"])] = np.asarray(found["bits"])
    return out


def marked(keys: np.ndarray, field: np.ndarray) -> np.ndarray:
    """Whether the map has each key."""
    at = places(keys, 64 * len(field))
    return ((field[at // 64] >> (at % 64)) & 1).all(axis=0)


def piece_keys(items: DataFrame, settings: Settings) -> DataFrame:
    """(item, key, size): the hash and the number of words of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes_of = WordHashes()
        for batch in slices(batches, "text"):
            hashes, offsets = hashes_of(batch.column("text"))
            cuts = [(i, at, len(p)) for i, n in enumerate(np.diff(offsets)) for at, p in pieces(range(n), settings.budget(int(n)) + 1)]
            owner, at, size = (np.array([c[k] for c in cuts], np.int64) for k in range(3))
            key = np.zeros(len(cuts), np.uint64)
            for s in np.unique(size):
                found, starts = shingle_hashes(hashes, offsets, int(s))
                mine = size == s
                key[mine] = found[starts[owner[mine]] + at[mine]]
            yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(owner)), pa.array(key.view(np.int64)), pa.array(size)], ["item", "key", "size"])

    return mapped(items.select("item", "text"), run, "item long, key long, size long")


def match_types(benchmark: DataFrame) -> tuple[str, list[pa.DataType]]:
    """The columns of a match, for Spark and for Arrow."""
    kind = benchmark.schema["item_id"].dataType
    return f"item_id {kind.simpleString()}, errors int, n_words int, first_word int, last_word int", [to_arrow_type(kind), *[pa.int32()] * 4]


def joined(docs: DataFrame, benchmark: DataFrame, settings: Settings) -> DataFrame:
    """(h1, h2, item_id, errors, ...): the matches of every different text, for items of any number.

    Two passes over the documents, however many items there are: one looks up all
    pieces' hashes in a map of bounded size, hits meet their items in a join, and
    one takes the texts of documents with a hit, which are searched for their items
    alone, ``share`` at a time.
    """
    spark = docs.sparkSession
    tables = Tables(spark)
    schema, types = match_types(benchmark)
    items = tables.write(items_of(benchmark).withColumn("item", F.monotonically_increasing_id()), "items")
    cut, found = tables.counted(piece_keys(items, settings), "pieces")
    sizes = sorted(r["size"] for r in cut.select("size").distinct().collect())  # at most the longest item's words
    known = spark.sparkContext.broadcast(bits(cut, "key", found["n"]))
    ends = [h.alias(n) for h, n in zip(row_key(docs.select("text"), 1, 2), ("h1", "h2"), strict=True)]
    rows = docs.select("text", *ends)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes_of = WordHashes()
        for batch in slices(batches, "text"):
            hashes, offsets = hashes_of(batch.column("text"))
            for s in sizes:
                keys, starts = shingle_hashes(hashes, offsets, s)
                some = np.flatnonzero(marked(keys, known.value))
                pair = np.unique(np.stack([np.searchsorted(starts, some, "right") - 1, keys[some].view(np.int64)]), axis=1)
                if pair.shape[1]:
                    at = pa.array(pair[0])
                    yield pa.RecordBatch.from_arrays([batch.column("h1").take(at), batch.column("h2").take(at), pa.array(pair[1])], ["h1", "h2", "key"])

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(marked(np.asarray(batch.column("h1")).view(np.uint64), field.value)))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for h1, h2, some, text in zip(*(batch.column(c).to_pylist() for c in ("h1", "h2", "items")), normal(batch.column("text")), strict=True):
                out += [(h1, h2, *m) for m in Matcher([(x["item_id"], x["text"]) for x in some], settings).search(text.as_py())]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate([pa.int64(), pa.int64(), *types])], ["h1", "h2", *MATCH])

    pairs = mapped(rows, hits, "h1 long, h2 long, key long").join(cut.select("key", "item").distinct(), "key")
    pairs, found = tables.counted(pairs.select("h1", "h2", "item").distinct(), "pairs")
    field = spark.sparkContext.broadcast(bits(pairs, "h1", found["n"]))
    texts = mapped(rows.select("h1", "h2", "text"), wanted, "h1 long, h2 long, text string").groupBy("h1", "h2").agg(F.first("text").alias("text"))
    number = pairs.groupBy("h1", "h2").agg(F.ceil(F.count("*") / settings.share).alias("n"))
    dealt = pairs.join(number, ["h1", "h2"]).withColumn("part", F.pmod(F.xxhash64("item"), "n")).join(items, "item")
    dealt = dealt.groupBy("h1", "h2", "part").agg(F.collect_list(F.struct("item_id", "text")).alias("items"))
    out = tables.write(mapped(dealt.join(texts, ["h1", "h2"]).select("h1", "h2", "items", "text"), searched, f"h1 long, h2 long, {schema}"), "matches")
    tables.drop("items", "pieces", "pairs")
    known.destroy()
    field.destroy()
    return out


def matches(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, item_id, errors, n_words, first_word, last_word): every item within its budget in a document.

    Places count the document's words from 0.
    """
    rows = docs.select("doc_id", "text")
    schema, types = match_types(benchmark)
    items = held(benchmark, settings)
    if items is None:
        part = joined(docs, benchmark, settings)
        ends = [h.alias(n) for h, n in zip(row_key(rows.select("text"), 1, 2), ("h1", "h2"), strict=True)]
        return rows.select("doc_id", *ends).join(part, ["h1", "h2"]).drop("h1", "h2")
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(sent.value, settings)
        for batch in slices(batches, "text"):
            at, out = [], []
            for i, text in enumerate(normal(batch.column("text"))):
                for m in matcher.search(text.as_py()):
                    at.append(i)
                    out.append(m)
            if at:
                columns = [pa.array([m[j] for m in out], t) for j, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), *columns], ["doc_id", *MATCH])

    return mapped(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {schema}")


def cleaned(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents that hold no item, with all their columns.  Nothing is shuffled where one automaton holds the items."""
    items = held(benchmark, settings)
    if items is None:
        names = [f"h{i}_{uuid.uuid4().hex}" for i in (1, 2)]
        bad = joined(docs, benchmark, settings).select(*[F.col(c).alias(n) for c, n in zip(("h1", "h2"), names, strict=True)]).distinct()
        same = [h == F.col(n) for h, n in zip(row_key(docs.select("text"), 1, 2), names, strict=True)]
        return docs.join(bad, same, "left_anti")
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(sent.value, settings)
        for batch in slices(batches, "text"):
            keep = [not matcher.search(text.as_py()) for text in normal(batch.column("text"))]
            yield batch.filter(pa.array(keep))

    return mapped(docs, run, docs.schema)
