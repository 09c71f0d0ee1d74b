"""URL filters: a sorted array of 64-bit xxhash keys, memory-mapped and probed by binary search.

A rule has a host and the beginning of a path; it fits its host and all
subdomains.  Of the rules that fit, the longest wins (host and path together;
then the longer host; then block before allow).  Every rule and every entry of
the block list is a key in the array; a URL's own candidates (each suffix of its
host with each path length that occurs in the array) are hashed, looked up
together, and a hit counts only if the stored string is equal.

The index is one file in the shared folder.  Each executor fetches it once (also
one that replaces a lost executor) and maps it, so its pages are shared by all
tasks of a machine and read as needed.

Defined results: a null URL, or one without ``://``, has an empty host and path
and the verdict ``allow``; empty tables, repeated rows and further columns are
ordinary; the page_id may be null.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import mapped, shared_file

# The rules (verdict, host, path) of the production filter.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
# end of fixed values
#: Sites that the production filter blocks where no rule fits.
SITES = tuple(f"{name}.example.{top}" for name in ("ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))

MAGIC = np.uint64(0x4E4C55524C303031)
VERDICTS = ("allow", "block")


@dataclass(frozen=True)
class Entry:
    """One rule, or one site of the block list (``listed``)."""

    verdict: str
    host: str
    path: str
    listed: bool = False

    @property
    def key(self) -> str:
        return f"{int(self.listed)}{self.host}\n{self.path}"


def entries(rules: Iterable[tuple[str, str, str]] = RULES, sites: Iterable[str] = SITES) -> list[Entry]:
    return [*(Entry(*r) for r in rules), *(Entry("block", s, "", True) for s in sites)]


def build(found: Iterable[Entry], path: str) -> None:
    """Write the index: header, sorted hashes, where each string ends, verdicts, path lengths of rules, the strings."""
    best: dict[str, Entry] = {}
    for e in found:  # of equal rules, block wins
        if e.key not in best or e.verdict == "block":
            best[e.key] = e
    coded = sorted((xxhash.xxh64_intdigest(k), k.encode(), VERDICTS.index(e.verdict)) for k, e in best.items())
    lengths = sorted({len(e.path) for e in best.values() if not e.listed})
    blob = b"".join(k for _, k, _ in coded)
    ends = np.cumsum([len(k) for _, k, _ in coded]) if coded else []
    with open(path, "wb") as f:
        for x in ([MAGIC, len(coded), len(lengths), len(blob)], [h for h, _, _ in coded], ends, lengths):
            f.write(np.asarray(x, dtype=np.uint64).tobytes())
        f.write(np.asarray([v for _, _, v in coded], dtype=np.uint8).tobytes())
        f.write(blob)


class Index:
    """The mapped file.  Nothing of it is copied."""

    def __init__(self, path: str) -> None:
        head = np.fromfile(path, dtype=np.uint64, count=4)
        if len(head) < 4 or head[0] != MAGIC:
            raise ValueError(f"not an index: {path}")
        n, m, size = (int(x) for x in head[1:])
        whole = np.memmap(path, dtype=np.uint8, mode="r")
        at = 32
        self.hashes = whole[at : at + 8 * n].view(np.uint64)
        self.ends = whole[at + 8 * n : at + 16 * n].view(np.uint64)
        self.lengths = [int(x) for x in whole[at + 16 * n : at + 16 * n + 8 * m].view(np.uint64)]
        at += 16 * n + 8 * m
        self.verdicts = whole[at : at + n]
        self.blob = whole[at + n : at + n + size]

    def probe(self, keys: list[str]) -> np.ndarray:
        """Each key's place in the array, or -1.  Equal hashes of different strings are all compared."""
        if not len(self.hashes) or not keys:
            return np.full(len(keys), -1)
        hashes = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), dtype=np.uint64, count=len(keys))
        left = np.searchsorted(self.hashes, hashes, "left")
        right = np.searchsorted(self.hashes, hashes, "right")
        out = np.full(len(keys), -1)
        for i in np.flatnonzero(right > left):
            wanted = keys[i].encode()
            for j in range(left[i], right[i]):
                if bytes(self.blob[int(self.ends[j - 1]) if j else 0 : int(self.ends[j])]) == wanted:
                    out[i] = j
        return out


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host: str) -> list[str]:
    parts = host.split(".")
    return [".".join(parts[i:]) for i in range(len(parts))] if host else []


def judge(index: Index, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str]]:
    """Each URL's rule and verdict.  Distinct (host, path beginning) pairs are looked up once a batch."""
    tails = {h: suffixes(h) for h in set(hosts)}
    wanted: dict[str, int] = {}
    longest = max(index.lengths, default=0)
    cut = [p[:longest] for p in paths]
    for h, p in set(zip(hosts, cut, strict=True)):
        for s in tails[h]:
            wanted.setdefault(f"1{s}\n", len(wanted))
            for n in index.lengths:
                if n <= len(p):
                    wanted.setdefault(f"0{s}\n{p[:n]}", len(wanted))
    places = index.probe(list(wanted))
    known: dict[tuple[str, str], tuple[str | None, str]] = {}
    for h, p in set(zip(hosts, cut, strict=True)):
        best: tuple[int, int, int] | None = None
        rule, verdict = None, "allow"
        for s in tails[h]:
            for n in index.lengths:
                if n <= len(p) and (at := places[wanted[f"0{s}\n{p[:n]}"]]) >= 0:
                    rank = (len(s) + n, len(s), int(index.verdicts[at]))
                    if best is None or rank > best:
                        best, rule, verdict = rank, s + p[:n], VERDICTS[index.verdicts[at]]
        if rule is None and any(places[wanted[f"1{s}\n"]] >= 0 for s in tails[h]):
            verdict = "block"
        known[h, p] = rule, verdict
    found = [known[k] for k in zip(hosts, cut, strict=True)]
    return [x for x, _ in found], [x for _, x in found]


def judged(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, sites: Iterable[str] = SITES, url: str = "url", key: str = "page_id") -> DataFrame:
    """(key, host, path, rule, verdict) of every row."""
    spark = pages.sparkSession
    name = f"url-index-{uuid.uuid4().hex}.bin"
    with tempfile.TemporaryDirectory() as folder:
        build(entries(rules, sites), os.path.join(folder, name))
        uri = shared_file(spark, os.path.join(folder, name), name)
    spark.sparkContext.addFile(uri)
    rows = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(SparkFiles.get(name))
        for batch in batches:
            ids, hosts, paths = batch.columns
            rule, verdict = judge(index, hosts.to_pylist(), paths.to_pylist())
            yield pa.RecordBatch.from_arrays([ids, hosts, paths, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], [*batch.schema.names, "rule", "verdict"])

    return mapped(rows, run, f"key {rows.schema['key'].dataType.simpleString()}, host string, path string, rule string, verdict string").withColumnRenamed("key", key)


def _sql() -> str:
    """The same verdicts in SQL, from the same rules and sites."""
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    sites = ", ".join(f"('{s}')" for s in SITES)
    return rf"""
WITH parsed AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(verdict, rhost, rpath) AS (VALUES {rules}
), sites(site) AS (VALUES {sites}
), fits AS (
  SELECT page_id, host, path, rhost || rpath AS rule, verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC, verdict DESC) AS nth
  FROM parsed JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT p.page_id, p.host, p.path, f.rule,
  coalesce(f.verdict, CASE WHEN EXISTS (SELECT 1 FROM sites WHERE p.host = site OR ends_with(p.host, '.' || site)) THEN 'block' ELSE 'allow' END) AS verdict
FROM parsed p LEFT JOIN fits f ON f.page_id = p.page_id AND f.nth = 1
"""


SQL = _sql()
