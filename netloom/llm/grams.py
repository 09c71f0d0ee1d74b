"""Hashed n-grams of texts, and what classifiers gather over a table: counts, samples, held-out rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import mapped, mixed, slices

#: Texts to the cells that occur in each: (cells, counts) of every text.
Featurise = Callable[[pa.Array], Iterator[tuple[np.ndarray, np.ndarray]]]


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points, one text after another, and where each begins (one more entry than texts)."""
    ends = np.cumsum(np.asarray(pc.utf8_length(texts), dtype=np.int64))
    whole = "".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(whole, "<u4"), np.append(0, ends)


def char_grams(codes: np.ndarray, longest: int, cells: int) -> list[np.ndarray]:
    """For each n up to ``longest``, the hashed cell of the n-gram that begins at each place; ``cells`` is a power of 2."""
    out, now = [], codes.astype(np.uint32) * np.uint32(0x9E3779B1)
    shift = np.uint32(32 - int(cells).bit_length() + 1)
    with np.errstate(over="ignore"):
        for n in range(1, longest + 1):
            if n > 1:
                now = (now[:-1] ^ (now[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + codes[n - 1 :].astype(np.uint32) * np.uint32(0xC2B2AE35 + 2 * n)
            out.append(((now ^ (now >> np.uint32(13))) * np.uint32(0x27D4EB2F)) >> shift)
    return out


def held_out(key: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the key's text leaves this remainder; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def cell_counts(rows: DataFrame, group: str, featurise: Featurise, cells: int) -> dict[object, tuple[np.ndarray, int]]:
    """For each value of ``group``: how many texts hold each cell, and how many texts there are.  Reads all rows.

    A task sends one row for each group and cell, so at most cells x groups reach the driver.
    """
    kind = rows.schema[group].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[object, np.ndarray] = {}
        for batch in slices(batches, "text"):
            for name, (found, _) in zip(batch.column(group).to_pylist(), featurise(batch.column("text")), strict=True):
                if name not in seen:
                    seen[name] = np.zeros(cells + 1, np.int64)
                seen[name][found] += 1
                seen[name][cells] += 1
        for name, counts in seen.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), batch.schema.field(group).type), pa.array(used), pa.array(counts[used])], [group, "cell", "n"])

    found = mapped(rows.select(group, "text"), run, f"{group} {kind}, cell long, n long").groupBy(group, "cell").agg(F.sum("n").alias("n")).toArrow()
    out: dict[object, tuple[np.ndarray, int]] = {}
    names, places, counts = found[group].to_pylist(), np.asarray(found["cell"]), np.asarray(found["n"])
    for name in sorted(set(names), key=str):
        mine = np.array([x == name for x in names], bool)
        whole = np.zeros(cells + 1, np.int64)
        whole[places[mine]] = counts[mine]
        out[name] = whole[:cells], int(whole[cells])
    return out


def sampled(rows: DataFrame, group: str, totals: dict[object, int], each: int, key: str = "doc_id", seed: int = 7) -> DataFrame:
    """About ``each`` rows of every group, chosen by a hash of the key; all of a smaller group."""
    share = F.lit(0)
    for name, total in totals.items():
        share = F.when(F.col(group) == F.lit(name), int(1e6 * min(1.0, each / max(total, 1)))).otherwise(share)
    return rows.filter(F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("string")), F.lit(1_000_000)) < share)


def collected(rows: DataFrame, group: str, featurise: Featurise) -> tuple[list[object], list[tuple[np.ndarray, np.ndarray]]]:
    """Labels and features of a bounded sample, in the order of their keys' hashes (the same in every run).

    A key counts once, with its least label and the least of that label's texts, so repeated rows do not widen the
    sample and no label is learned with another row's text.
    """
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(group, "text")).alias("row")).select("doc_id", f"row.{group}", "row.text")
    kind = rows.schema[group].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = list(featurise(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column(group), batch.column("h"), pa.array([c.astype("<i4").tobytes() for c, _ in found], pa.binary()), pa.array([n.astype("<i4").tobytes() for _, n in found], pa.binary())], ["label", "h", "cells", "counts"])

    rows = rows.select(group, F.xxhash64(F.col("doc_id").cast("string"), "text").alias("h"), "text")
    table = mapped(rows, run, f"label {kind}, h long, cells binary, counts binary").toArrow().sort_by([("h", "ascending"), ("cells", "ascending")])
    return table["label"].to_pylist(), [(np.frombuffer(c.as_py(), "<i4"), np.frombuffer(n.as_py(), "<i4")) for c, n in zip(table["cells"], table["counts"], strict=True)]


__all__ = ["Featurise", "cell_counts", "char_grams", "code_points", "collected", "held_out", "mixed", "sampled"]
