"""Near-duplicate documents: consistent weighted sampling over TF-IDF shingles, banded, verified exactly.

Features are runs of five words.  A shingle's weight is its count in the text
times the mean inverse document frequency of its words.  Document frequencies
are counted over all documents in a fixed number of hashed cells, so the table
sent to executors has the same size for any corpus.

1. Each text gets ``samples`` improved consistent weighted samples (Ioffe, 2010):
   two texts agree in one with the probability of their weighted Jaccard
   similarity.  Texts with the same words are one node; copies are counted, never
   paired.
2. Bands of ``rows`` samples are hashed.  In each bucket two nodes are centres:
   the one that shares most buckets with others (weighted by their sizes), which is
   a typical one, and another by hash.  Every node is compared with its buckets'
   centres, so a bucket of n nodes gives 2 n pairs at most.
3. Pairs whose samples agree too rarely (five standard deviations below the
   threshold) wait for step 5; the others' weighted Jaccard similarity is computed
   from the whole texts, and is at least ``threshold`` for a link.
4. Classes are the connected components of the links (alternating stars, all on
   executors).
5. In buckets that still hold several classes, the nodes outside the largest class
   are compared with all others, in blocks of ``block`` by ``block`` nodes that are
   dealt apart.  Two bounds from above spare most pairs: the weight of what a text
   shares with any other of these (near copies with many changes of their own drop
   out by one count), and sums by hashed shingle of that weight, of which two texts
   share at most the lesser ones.  A pair of several buckets is compared in the one
   with the least key.  So no pair is passed over unless its ends are in one class
   already or it cannot reach the threshold.

Defined results: a null text counts as empty; texts without any word are in one
class only if they are equal; shorter texts are one shingle; repeated rows are
copies; a class is named by its least doc_id (null if it has none); an empty
table gives an empty result; other columns are ignored.  Nodes are told apart by
128 bits of a hash of their words, words by 64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import Tables, WordHashes, mapped, mixed, plain_unions, row_key, shingle_hashes, slices

CELLS = 1 << 20
#: Bits of the map of wanted nodes, at least and at most.
MAP_BITS = 1 << 20, 1 << 27
#: Rows of random numbers that features are dealt to.
RANDOM_ROWS = 1 << 13
CHUNK = 1 << 11


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    threshold: float = 0.8
    bands: int = 16
    rows: int = 4
    #: Sums of weights that bound what two texts share.
    parts: int = 64
    #: Nodes on either side of a block of comparisons.
    block: int = 1024
    seed: int = 20_240_601

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    @property
    def agree(self) -> int:
        """Agreeing samples that a pair at the threshold falls below once in some million times."""
        s = self.threshold
        return max(1, int(self.samples * s - 5 * (self.samples * s * (1 - s)) ** 0.5))


class Randoms:
    """r, beta and ln c of the sampling, for each row and sample."""

    def __init__(self, settings: Settings) -> None:
        rng = np.random.default_rng(settings.seed)
        shape = RANDOM_ROWS, settings.samples
        r = rng.gamma(2.0, 1.0, shape)
        self.beta = rng.random(shape, dtype=np.float64).astype(np.float32)
        self.inverse = (1.0 / r).astype(np.float32)
        self.r = r.astype(np.float32)
        self.start = (np.log(rng.gamma(2.0, 1.0, shape)) - r + r * self.beta).astype(np.float32)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold a word of each cell, over all documents, and the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, number, hashes_of = np.zeros(CELLS, np.int64), 0, WordHashes()
        for batch in slices(batches, "text"):
            hashes, offsets = hashes_of(batch.column("text"))
            cell = (hashes % np.uint64(CELLS)).astype(np.int64)
            owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets))
            pair = np.sort(owner * CELLS + cell)
            pair = pair[np.append(True, pair[1:] != pair[:-1])] if len(pair) else pair
            seen += np.bincount(pair % CELLS, minlength=CELLS)
            number += batch.num_rows
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(seen[used], number))], ["cell", "n"])

    found = mapped(docs.select("text"), run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most CELLS + 1 rows
    out, total = np.zeros(CELLS, np.int64), 0
    cells, counts = np.asarray(found["cell"]), np.asarray(found["n"])
    if (cells < 0).any():
        total = int(counts[cells < 0][0])
    out[cells[cells >= 0]] = counts[cells >= 0]
    return out, total


def inverse(frequencies: np.ndarray, number: int) -> np.ndarray:
    return (np.log((1.0 + number) / (1.0 + frequencies)) + 1.0).astype(np.float32)


def names(texts: pa.Array, hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Two 64-bit halves that name each text's node: a hash of all words in order; of the text itself where it has none."""
    out = np.zeros((len(offsets) - 1, 2), np.uint64)
    raw = hashes.tobytes()
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        whole = xxhash.xxh3_128_intdigest(raw[8 * a : 8 * b]) if b > a else xxhash.xxh3_128_intdigest((texts[i].as_py() or "").encode(), seed=1)
        out[i] = whole & 0xFFFFFFFFFFFFFFFF, whole >> 64
    return out


def features(hashes: np.ndarray, offsets: np.ndarray, idf: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, shingles in ascending order, their weights) of texts by their words' hashes."""
    shingles, starts = shingle_hashes(hashes, offsets, size)
    rarity = np.append(np.float64(0), np.cumsum(idf[(hashes % np.uint64(len(idf))).astype(np.int64)], dtype=np.float64))
    counts = np.diff(starts)
    owner = np.repeat(np.arange(len(counts)), counts)
    begin = offsets[:-1][owner] + np.arange(len(shingles)) - starts[:-1][owner]
    end = np.minimum(begin + size, offsets[1:][owner])
    weight = ((rarity[end] - rarity[begin]) / np.maximum(end - begin, 1)).astype(np.float32)
    # Equal shingles of a text meet by sorting; a shingle keeps 48 bits, above them stands its text's number.
    key = (owner.astype(np.uint64) << np.uint64(48)) | (shingles >> np.uint64(16))
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    weights = np.add.reduceat(weight[order], first) if len(first) else np.zeros(0, np.float32)
    key = key[first]
    ends = np.searchsorted(key, np.arange(len(counts) + 1, dtype=np.uint64) << np.uint64(48))
    return ends, key & np.uint64((1 << 48) - 1), weights


def sample(offsets: np.ndarray, shingles: np.ndarray, weights: np.ndarray, randoms: Randoms) -> np.ndarray:
    """Each text's samples, as 32-bit hashes of (shingle, step).  Work is cut by features, whatever the texts' sizes."""
    number, k = len(offsets) - 1, randoms.r.shape[1]
    best = np.full((number, k), np.inf, np.float32)
    out = np.zeros((number, k), np.uint32)
    owners = np.repeat(np.arange(number), np.diff(offsets))
    rows, logs = (mixed(shingles) % np.uint64(RANDOM_ROWS)).astype(np.int64), np.log(weights)
    step, value, other = (np.empty((CHUNK, k), np.float32) for _ in range(3))
    for at in range(0, len(shingles), CHUNK):
        some, owner, row = shingles[at : at + CHUNK], owners[at : at + CHUNK], rows[at : at + CHUNK]
        s, v, o = step[: len(some)], value[: len(some)], other[: len(some)]
        np.take(randoms.inverse, row, axis=0, out=s, mode="clip")
        s *= logs[at : at + CHUNK, None]
        s += np.take(randoms.beta, row, axis=0, out=o, mode="clip")
        np.floor(s, out=s)
        np.take(randoms.start, row, axis=0, out=v, mode="clip")
        np.take(randoms.r, row, axis=0, out=o, mode="clip")
        o *= s
        v -= o
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        lowest = np.minimum.reduceat(v, first, axis=0)
        place = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(owner))))
        equal = np.empty(v.shape, bool)
        for p, (a, b) in enumerate(zip(first, np.append(first[1:], len(owner)), strict=True)):
            np.equal(v[a:b], lowest[p], out=equal[a:b])
        flat = np.flatnonzero(equal)[::-1]  # of equal values the least shingle is written last
        i, j = flat // k, flat % k
        hashed = np.zeros((len(first), k), np.uint32)
        with np.errstate(over="ignore"):
            hashed[place[i], j] = mixed(some[i] * np.uint64(0x9E3779B97F4A7C15) + s[i, j].astype(np.int64).view(np.uint64)).astype(np.uint32)
        mine = owner[first]
        better = lowest < best[mine]
        best[mine] = np.where(better, lowest, best[mine])
        out[mine] = np.where(better, hashed, out[mine])
    return out


def sketches(docs: DataFrame, idf_sent, settings: Settings) -> DataFrame:
    """``docs`` with node and mark (its text's name) and sketch in place of text; no sketch where a text has no word."""
    kept = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes_of, randoms, k = WordHashes(), Randoms(settings), settings.samples
        for batch in slices(batches, "text"):
            hashes, offsets = hashes_of(batch.column("text"))
            named = names(batch.column("text"), hashes, offsets)
            ends, shingles, weights = features(hashes, offsets, idf_sent.value, settings.shingle)
            found = sample(ends, shingles, weights, randoms)
            some = np.diff(ends) > 0
            places = pa.array(np.append(0, np.cumsum(some * k)).astype(np.int32), mask=np.append(~some, False))
            lists = pa.ListArray.from_arrays(places, pa.array(found[some].ravel().view(np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(named[:, 0].view(np.int64)), pa.array(named[:, 1].view(np.int64)), lists], [*kept, "node", "mark", "sketch"])

    fields = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept]
    return mapped(docs, run, ", ".join([*fields, "node long, mark long, sketch array<int>"]))


def band_keys(nodes: DataFrame, settings: Settings) -> DataFrame:
    """(key, id): each node's buckets."""
    band = F.transform(F.sequence(F.lit(0), F.lit(settings.bands - 1)), lambda b: F.xxhash64(b, F.slice("sketch", b * settings.rows + 1, settings.rows)))
    return nodes.filter("sketch is not null").select(F.explode(band).alias("key"), "id")


def likely(pairs: DataFrame, nodes: DataFrame, settings: Settings) -> DataFrame:
    """Pairs (a, b) whose samples agree often enough."""
    side = nodes.select("id", "sketch")
    both = pairs.join(side.withColumnsRenamed({"id": "a", "sketch": "sa"}), "a").join(side.withColumnsRenamed({"id": "b", "sketch": "sb"}), "b")
    agreeing = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x))
    return both.filter(agreeing >= settings.agree).select("a", "b")


def wanted_texts(docs: DataFrame, wanted: DataFrame, number: int) -> DataFrame:
    """(id, text), one row for each of the ``number`` wanted nodes (id, node, mark).

    A map of the wanted nodes' hashes, of bounded size, spares most other texts the
    shuffle; where it is full, it only spares fewer.
    """
    size = min(MAP_BITS[1], max(MAP_BITS[0], 1 << (16 * number).bit_length()))
    # A node is a hash already; its low bits choose the place.
    cell = F.pmod("node", F.lit(size))
    cells = wanted.select(F.floor(cell / 64).cast("int").alias("cell"), F.expr(f"shiftleft(1L, cast(pmod(node, {size}) % 64 as int))").alias("bit"))
    found = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most size / 64 rows
    field = np.zeros(size // 64, np.int64)
    field[np.asarray(found["cell"])] = np.asarray(found["bits"])
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes_of = WordHashes()
        for batch in slices(batches, "text"):
            hashes, offsets = hashes_of(batch.column("text"))
            named = names(batch.column("text"), hashes, offsets).view(np.int64)
            place = named[:, 0] % size
            keep = ((sent.value[place // 64] >> (place % 64)) & 1).astype(bool) & (np.diff(offsets) > 0)
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(named[:, 0]), pa.array(named[:, 1]), batch.column("text")], ["node", "mark", "text"]).filter(pa.array(keep))

    rows = mapped(docs.select("text"), run, "node long, mark long, text string")
    # Texts of one node meet in the tasks' own aggregates first, so that a group of copies sends one from each.
    return rows.groupBy("node", "mark").agg(F.first("text").alias("text")).join(wanted, ["node", "mark"]).select("id", "text")


def verified(pairs: DataFrame, texts: DataFrame, idf_sent, settings: Settings) -> DataFrame:
    """Pairs whose weighted Jaccard similarity reaches the threshold, with all their columns (integers)."""
    columns = pairs.columns
    both = pairs.join(texts.withColumnsRenamed({"id": "a", "text": "ta"}), "a").join(texts.withColumnsRenamed({"id": "b", "text": "tb"}), "b").select(*columns, "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes_of = WordHashes()
        for batch in slices(slices(batches, "ta"), "tb"):
            coded = pa.chunked_array([batch.column("ta"), batch.column("tb")]).combine_chunks().dictionary_encode()
            offsets, shingles, weights = features(*hashes_of(coded.dictionary), idf_sent.value, settings.shingle)
            place = np.asarray(coded.indices)
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                (a, b), (c, d) = (offsets[[p, p + 1]] for p in (place[i], place[i + batch.num_rows]))
                _, x, y = np.intersect1d(shingles[a:b], shingles[c:d], assume_unique=True, return_indices=True)
                shared = float(np.minimum(weights[a:b][x], weights[c:d][y]).sum(dtype=np.float64))
                total = float(weights[a:b].sum(dtype=np.float64) + weights[c:d].sum(dtype=np.float64)) - shared
                keep[i] = shared >= (settings.threshold - 1e-6) * total
            yield batch.select(columns).filter(pa.array(keep))

    return mapped(both, run, ", ".join(f"{c} long" for c in columns))


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """(node, root) of every node with a link (a, b): alternating large and small stars until nothing changes.

    Every step halves the way to a root or more; each is one written table.
    """
    seen = F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("sum")
    edges, now = tables.counted(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "links", *seen)
    while now["n"]:
        around = edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        low = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Each node's larger neighbours and itself, where it is not the least, go to the least.
        large = around.join(low, "a").select(F.inline(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b"), (F.col("b") > F.col("a")).alias("of")), F.struct("a", F.col("m").alias("b"), (F.col("m") < F.col("a")).alias("of"))))).filter("of").select("a", "b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.inline(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b"))))).filter("a != b").distinct()
        edges, after = tables.counted(small, "links", *seen)
        if after == now:
            break
        now = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def bounds(texts: DataFrame, idf_sent, settings: Settings) -> DataFrame:
    """(id, total, shared, parts): what bounds a text's similarity to others of these texts (id, text).

    ``total`` is the weight of its shingles and ``shared`` of those that another of
    these texts has; ``parts`` are sums of the latter by a hash of the shingle.  Two
    texts share at most the sum of the lesser parts.  Nodes whose ``shared`` keeps
    them below the threshold with any other are left out.
    """

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes_of = WordHashes()
        for batch in slices(batches, "text"):
            offsets, shingles, weights = features(*hashes_of(batch.column("text")), idf_sent.value, settings.shingle)
            owner = np.repeat(np.asarray(batch.column("id")), np.diff(offsets))
            part = (mixed(shingles) % np.uint64(settings.parts)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(shingles.view(np.int64)), pa.array(part), pa.array(weights.astype(np.float64))], ["id", "shingle", "part", "weight"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes_of, k = WordHashes(), settings.parts
        for batch in slices(batches, "text"):
            offsets, shingles, weights = features(*hashes_of(batch.column("text")), idf_sent.value, settings.shingle)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            parts = np.bincount(owner * k + (mixed(shingles) % np.uint64(k)).astype(np.int64), weights=weights, minlength=k * batch.num_rows)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * k), pa.array(parts.astype(np.float32)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(parts.reshape(-1, k).sum(axis=1)), lists], ["id", "total", "parts"])

    # A shingle that one node has alone is known by that node; no rows of a shingle need meet in one task.
    rows = mapped(texts, shingles, "id long, shingle long, part int, weight double")
    alone = rows.groupBy("shingle").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.min("part").alias("part"), F.max("weight").alias("weight")).filter("n = 1")
    lost = alone.repartition("id").groupBy("id", "part").agg(F.sum("weight").alias("weight"))
    lost = lost.groupBy("id").agg(F.sum("weight").alias("lost"), F.map_from_entries(F.collect_list(F.struct("part", "weight"))).alias("by_part"))
    whole = mapped(texts, summed, "id long, total double, parts array<float>").join(lost, "id", "left")
    left = F.transform("parts", lambda x, i: F.greatest(F.lit(0.0), x - F.coalesce(F.col("by_part")[i], F.lit(0.0))).cast("float"))
    return whole.select("id", "total", (F.col("total") - F.coalesce("lost", F.lit(0.0))).alias("shared"), left.alias("parts")).filter(F.col("shared") >= (settings.threshold - 1e-6) * F.col("total"))


def ordered(x: Column, y: Column, rx: Column, ry: Column) -> list[Column]:
    """A pair and its ends' roots, each in order."""
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), F.least(rx, ry).alias("ra"), F.greatest(rx, ry).alias("rb")]


def crossed(open_: DataFrame, stats: DataFrame, settings: Settings) -> DataFrame:
    """Pairs of different classes within a bucket that could be similar enough.

    open_: (key, id, root, total, shared, parts), and perhaps keys, all keys of the
    id; stats: (key, n, most, main), the bucket's members, those of its largest class,
    and that class.
    """
    size = settings.block
    beside = F.ceil((F.col("n") - F.col("most")) / size).cast("int"), F.ceil(F.col("n") / size).cast("int")
    rows = open_.join(stats, "key").select(*open_.columns, "main", beside[0].alias("p"), beside[1].alias("q"))

    def block(seed: int, over: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), "id"), F.col(over)).cast("int")

    every = {c: f"{c}_y" for c in ("id", "root", "total", "shared", "parts", "keys") if c in open_.columns}
    left = rows.filter("root != main").withColumn("i", block(1, "p")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("q") - 1))).drop("p", "q")
    right = rows.withColumn("j", block(2, "q")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("p") - 1))).select("key", "i", "j", *[F.col(a).alias(b) for a, b in every.items()])
    t = settings.threshold

    def reaches(most: Column) -> Column:
        """Whether a pair that shares so much could be as similar as the threshold."""
        return most * (1 + t) >= (t - 1e-4) * (F.col("total") + F.col("total_y"))

    different = (F.col("root") != F.col("root_y")) & ((F.col("root_y") == F.col("main")) | (F.col("id") < F.col("id_y"))) & reaches(F.least("shared", "shared_y"))
    if "keys" in every:  # two ends of different classes are compared once in each bucket that they share: here in one of them
        different &= F.array_min(F.array_intersect("keys", "keys_y")) == F.col("key")
    different &= reaches(F.aggregate(F.zip_with("parts", "parts_y", lambda a, b: F.least(a, b)), F.lit(0.0), lambda s, x: s + x))
    # Dealt by block, so that one bucket's comparisons are many tasks'.
    pairs = left.join(right, ["key", "i", "j"]).filter(different).select(*ordered(F.col("id"), F.col("id_y"), F.col("root"), F.col("root_y")))
    return pairs if "keys" in every else pairs.distinct()


def _classes(rows: DataFrame, docs: DataFrame, settings: Settings, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Written tables: ``rows`` (doc_id, text, ...) with node and mark for text, and (node, mark, root, doc_id) of every node."""
    spark = docs.sparkSession
    idf_sent = spark.sparkContext.broadcast(inverse(*document_frequencies(docs)))
    rows = tables.write(sketches(rows, idf_sent, settings), "sketches")
    nodes = rows.groupBy("node", "mark").agg(F.min("doc_id").alias("doc_id"), F.first("sketch").alias("sketch"))
    nodes = tables.write(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    keys = band_keys(nodes, settings)
    sizes = tables.write(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    members = tables.write(keys.join(sizes, "key").select("key", "id", F.floor(F.log2("n")).cast("int").alias("bits")), "members")
    weights = members.groupBy("id").agg(F.sum("bits").alias("w"))
    typical = F.struct("w", F.xxhash64("id").alias("h"), "id")
    centres = members.join(weights, "id").groupBy("key").agg(F.max(typical).alias("c"), F.max(F.struct(F.xxhash64("id").alias("h"), "id")).alias("d"))
    centres = tables.write(centres.select("key", F.explode(F.array_distinct(F.array("c.id", "d.id"))).alias("y")), "centres")
    of = F.least("id", "y").alias("a"), F.greatest("id", "y").alias("b")
    pairs = tables.write(members.join(centres, "key").select(*of).filter("a != b").distinct(), "pairs")
    close, found = tables.counted(likely(pairs, nodes, settings), "close")
    roots = None
    if found["n"]:
        ids = close.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        wanted, found = tables.counted(ids.join(nodes.select("id", "node", "mark"), "id"), "wanted")
        texts = tables.write(wanted_texts(docs, wanted, found["n"]), "texts")
        roots = components(verified(close, texts, idf_sent, settings), tables)
        tables.drop("texts")
    first = roots
    placed = members.select("key", "id")
    placed = placed.withColumn("root", F.col("id")) if roots is None else placed.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    placed = tables.write(placed, "placed")
    unlike = tables.write(placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key"), "unlike")
    open_, found = tables.counted(placed.join(unlike, "key"), "open")
    if found["n"]:
        wanted, found = tables.counted(open_.select("id").distinct().join(nodes.select("id", "node", "mark"), "id"), "wanted")
        texts = tables.write(wanted_texts(docs, wanted, found["n"]), "texts")
        limits = tables.write(bounds(texts, idf_sent, settings), "limits")
        held = open_.groupBy("id").agg(F.min("root").alias("root"), F.collect_list("key").alias("keys"))
        able = tables.write(held.join(limits, "id").select(*held.columns, "total", "shared", "parts", F.explode("keys").alias("key")), "able")
        counts = able.groupBy("key", "root").agg(F.count("*").alias("n"))
        counts = counts.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("top"))
        stats = tables.write(counts.select("key", "n", F.col("top.n").alias("most"), F.col("top.root").alias("main")).filter("n > most"), "stats")
        pairs, found = tables.counted(crossed(able, stats, settings).join(close, ["a", "b"], "left_anti"), "pairs")
        if found["n"]:
            links = verified(pairs, texts, idf_sent, settings).select(F.col("ra").alias("a"), F.col("rb").alias("b"))
            second = components(links, tables)
            if first is None:
                roots = second
            else:
                later = second.select(F.col("node").alias("root"), F.col("root").alias("later"))
                roots = first.join(later, "root", "left").select("node", F.coalesce("later", "root").alias("root"))
                # A root that the first links did not name is a node of its own.
                roots = roots.union(second.join(first.select("node"), "node", "left_anti"))
    named = nodes.select("id", "node", "mark", "doc_id")
    if roots is None:
        named = named.withColumn("root", F.col("id"))
    else:
        named = named.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = tables.write(named.select("node", "mark", "root", "doc_id"), "named")
    idf_sent.destroy()
    return rows, named


def classes(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, class_id) of every row."""
    tables = Tables(docs.sparkSession)
    with plain_unions(docs.sparkSession):
        rows, named = _classes(docs.select("doc_id", "text"), docs, settings, tables)
        least = tables.write(named.groupBy("root").agg(F.min("doc_id").alias("class_id")), "least")
        labels = tables.write(named.join(least, "root").select("node", "mark", "class_id"), "labels")
    tables.drop(*[t for t in tables.paths if t not in ("sketches", "labels")])
    return rows.join(labels, ["node", "mark"]).select("doc_id", "class_id")


def kept(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row of each class with all its columns: the one with the least doc_id (null last), then the least hash of its columns.

    Rows are told apart by 128 bits of a hash of all their columns, so what stays
    does not depend on doc_id being unique or known; rows equal in all columns
    are one.
    """
    tables = Tables(docs.sparkSession)
    ends = [h.alias(n) for h, n in zip(row_key(docs, 1, 2), ("h1", "h2"), strict=True)]
    with plain_unions(docs.sparkSession):
        rows, named = _classes(docs.select("doc_id", "text", *ends), docs, settings, tables)
        placed = rows.select("node", "mark", "doc_id", "h1", "h2").join(named.select("node", "mark", "root"), ["node", "mark"])
        best = F.min(F.struct(F.isnull("doc_id").alias("unknown"), "doc_id", "h1", "h2")).alias("best")
        first = tables.write(placed.groupBy("root").agg(best).select("best.h1", "best.h2"), "first")
    tables.drop(*[t for t in tables.paths if t != "first"])
    # Equal rows meet in the tasks' own aggregates first.
    whole = docs.select(*ends, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return whole.groupBy("h1", "h2").agg(F.first("row").alias("row")).join(first, ["h1", "h2"], "left_semi").select("row.*")
