"""Best-fit packing: patterns of few lengths, their repeat counts fitted by non-negative least squares.

Documents become token ids (a public tokenizer file, then a closing id); only
those longer than a sequence are cut.  What remains is a histogram of piece
lengths, at most as many numbers as a sequence has tokens, whatever the table's
size.  On it the driver plans:

1. Lengths are put into classes of ``width`` tokens.  All patterns of one to
   three classes that fill a sequence are enumerated.
2. Lawson and Hanson's active-set method finds non-negative repeat counts whose
   use of each class is nearest to the histogram, in least squares.
3. Counts are rounded down.  A pattern takes pieces of its classes that fill the
   sequence to the last token (the last piece may be just above its class), as
   often as its count allows and such pieces are left.
4. Pieces left over go, longest first, to the fullest sequence they fit in, else
   to a new one.

The plan lists, for each length, ranges of pieces and where they go.  A piece's
rank among those of its length comes from counts of (length, salt) groups, so a
length that holds most pieces is spread over many tasks.

Defined results: a null text counts as empty and is one piece, the closing id;
repeated rows are documents of their own (ranked by everything they carry); an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import codecs
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import gathered, mapped, slices, written

LENGTH = 2048
CLOSING_ID = 0
#: Distinct words whose ids a task remembers.
CACHE = 700_000
#: Bytes of text that are encoded together: the more, the fewer words are looked up twice.
TEXT_BYTES = 3 << 20
#: Groups that the pieces of one length are ranked in.
SALTS = 256


class Ids:
    """Token ids of whole texts, the same as the tokenizer's own, each distinct word encoded once.

    The tokenizer's pre-tokens never cross white space, and a run of ASCII
    punctuation between a letter or digit and white space is one of its own, so
    words are split there first.  Texts where that does not hold (apostrophes
    make contractions, ``<|`` may begin a special token, and separators that the
    two sides see differently) take the tokenizer's own path, word by word or
    whole.  A new word of ``LETTERS`` alone is one pre-token that the normaliser
    leaves as it is, so it goes to the tokenizer's model at once, with its bytes
    written as the byte-level pre-tokenizer writes them.
    """

    #: Letters that end in a mark once normalised, which joins the punctuation after it.
    MARKED = r"\x{130}\x{958}-\x{95f}\x{9dc}-\x{9df}\x{a33}\x{a36}\x{a59}-\x{a5e}\x{b5c}\x{b5d}\x{f43}\x{f4d}\x{f52}\x{f57}\x{f5c}\x{f69}\x{fb1d}-\x{fb4e}"
    PUNCTUATION = r"([^\PL" + MARKED + r"]|\pN)([!-&(-/:-@\[-`{-~]+)(\s|$)"
    #: Capitals and white space of ASCII, as lower-case letters and spaces.
    FOLD = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\f\r", b"abcdefghijklmnopqrstuvwxyz    "))
    #: Lower-case letters, or without case, that are in normal form C whatever other of them stand beside: Latin, Greek, Cyrillic, Hebrew, Arabic, kana, Han, Hangul.
    LETTERS = re.compile(
        "[a-z\xdf-\xf6\xf8-\xff" + "".join(c for c in map(chr, range(0x100, 0x180)) if c.islower()) + "\u03b1-\u03ce\u0430-\u045f\u05d0-\u05ea\u0621-\u063a\u0641-\u064a\u3041-\u3096\u30a1-\u30fa\u30fc\u4e00-\u9fa5\uac00-\ud7a3]+"
    )
    #: What stands for each byte in the model, except that the space stays, to part words: its own code point, or one from 256 on for those that do not print.
    MOVED = {b: chr(256 + i) for i, b in enumerate([*range(33), *range(127, 161), 173])} | {32: " "}
    BYTES = "".join(map(MOVED.get, range(256), map(chr, range(256))))
    PART = "<|endoftext|>"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.part = self.tokenizer.token_to_id(self.PART)
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1, np.int64)

    @classmethod
    def of(cls, path: str) -> Ids:
        """One for each worker process, kept from task to task; functions sent to workers bring no globals of ours that last."""
        import tokenizers

        kept = tokenizers.__dict__.setdefault("_kept_ids", {})
        if path not in kept:
            kept[path] = cls(path)
        return kept[path]

    def direct(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def keep(self, some: list[bytes], found: np.ndarray, ends: np.ndarray) -> None:
        """Remember words by the ids of all of them and where each one's end."""
        at = int(self.ends[-1])
        if at + len(found) > len(self.ids):
            self.ids = np.concatenate([self.ids[:at], np.zeros(at + 2 * len(found), np.uint32)])
        self.ids[at : at + len(found)] = found
        self.known.update(zip(some, range(len(self.known), len(self.known) + len(some)), strict=True))
        self.ends = np.concatenate([self.ends, at + ends])

    def learn(self, fresh: list[bytes]) -> None:
        """Encode new words: those of letters by the model, others in one call, where a special token, which no word holds, parts them."""
        letters, others = [], []
        for word in fresh:
            (letters if word.isalpha() or self.LETTERS.fullmatch(word.decode()) else others).append(word)
        tokenize = self.tokenizer.model.tokenize
        for i in range(0, len(letters), 20_000):
            some = letters[i : i + 20_000]
            lists = [[t.id for t in tokenize(word)] for word in codecs.charmap_decode(b" ".join(some), "strict", self.BYTES)[0].split(" ")]
            ends = np.cumsum(np.fromiter(map(len, lists), dtype=np.int64, count=len(lists)))
            self.keep(some, np.fromiter(chain.from_iterable(lists), dtype=np.uint32, count=int(ends[-1])), ends)
        for i in range(0, len(others), 20_000):
            some = others[i : i + 20_000]
            found = np.asarray(self.tokenizer.encode(self.PART.join([*(word.decode() for word in some), ""]), add_special_tokens=False).ids, dtype=np.uint32)
            parts = found == self.part
            self.keep(some, found[~parts], np.flatnonzero(parts) - np.arange(len(some)))

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = np.asarray(pc.match_substring_regex(texts, r"<\||[\x00-\x08\x0b\x0e-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{200b}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"), dtype=bool)
        out: list[np.ndarray | None] = [None] * len(texts)
        if odd.any():
            places = np.flatnonzero(odd)
            for i, x in zip(places, self.direct(texts.filter(pa.array(odd)).to_pylist()), strict=True):
                out[i] = x
        if odd.all():
            return out
        plain = texts.filter(pa.array(~odd))
        valid, offsets, data = plain.buffers()
        plain = pa.LargeStringArray.from_buffers(len(plain), offsets, pa.py_buffer((data.to_pybytes() if data else b"").translate(self.FOLD)), valid, offset=plain.offset)
        apart = pc.replace_substring_regex(plain, self.PUNCTUATION, r"\1 \2\3")
        contraction = pc.match_substring(plain, "'")
        plain = pc.if_else(contraction, plain, apart)
        # Two spaces beside each other part an empty word, which has no ids.
        lists = pc.split_pattern(plain, " ")
        sizes = np.asarray(pc.list_value_length(lists), dtype=np.int64)
        coded = lists.flatten().dictionary_encode()
        number = len(coded.dictionary)
        names = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, number], pa.int32()), coded.dictionary), pa.scalar(" ", pa.large_string()))[0].as_buffer().to_pybytes().split(b" ")
        place = np.fromiter(map(self.known.get, names, repeat(-1)), dtype=np.int64, count=number)
        fresh = [names[i] for i in np.flatnonzero(place < 0)]
        if len(self.known) + len(fresh) > CACHE and self.known:
            self.known, self.ends, fresh = {}, np.zeros(1, np.int64), names
            place[:] = -1
        self.learn(fresh)
        place[place < 0] = np.fromiter(map(self.known.__getitem__, fresh), dtype=np.int64, count=len(fresh))
        place = place[np.asarray(coded.indices)]
        begin, count = self.ends[place], self.ends[place + 1] - self.ends[place]
        after = np.cumsum(count, dtype=np.int64)
        flat = self.ids[np.arange(after[-1] if len(after) else 0) + np.repeat(begin - (after - count), count)]
        ends = np.append(np.int64(0), after)[np.cumsum(sizes)]
        starts = np.append(np.int64(0), ends[:-1])
        for i, a, b in zip(np.flatnonzero(~odd), starts, ends, strict=True):
            out[i] = flat[a:b]
        return out


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, closing: int = CLOSING_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, salt) of every document."""
    rows = docs.select("doc_id", "text")
    salts = SALTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids.of(tokenizer)
        for batch in slices(gathered(batches, "text", TEXT_BYTES), "text", 2 * TEXT_BYTES):
            docs_, numbers, starts, sizes, crcs = [], [], [], [], []
            for doc, found in zip(batch.column("doc_id").to_pylist(), ids(batch.column("text")), strict=True):
                whole = np.append(found, np.uint32(closing)).astype("<u4")
                for number, at in enumerate(range(0, len(whole), length)):
                    part = whole[at : at + length]
                    docs_.append(doc), numbers.append(number), starts.append(at), sizes.append(len(part)), crcs.append(zlib.crc32(part.tobytes()))
            salt = [zlib.crc32(f"{d} {n}".encode()) % salts for d, n in zip(docs_, numbers, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(docs_, batch.schema.field("doc_id").type), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64()), pa.array(salt, pa.int32())], ["doc_id", "piece", "start", "length", "ids_crc32", "salt"])

    return mapped(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, salt int")


def enumerate_patterns(classes: int, present: np.ndarray) -> np.ndarray:
    """All patterns of one to three classes that sum to ``classes``, of classes that occur; 0 stands for none."""
    found = [(classes, 0, 0)] if present[classes] else []
    for a in range(classes, 0, -1):
        if not present[a]:
            continue
        for b in range(min(a, classes - a), 0, -1):
            c = classes - a - b
            if c <= b and present[b] and (c == 0 or present[c]):
                found.append((a, b, c))
    return np.array(found, dtype=np.int64).reshape(-1, 3)


def fit(patterns: np.ndarray, histogram: np.ndarray, most: int = 400) -> np.ndarray:
    """Non-negative repeat counts with the least squared distance to the histogram (Lawson and Hanson).

    Column j of the matrix counts how often pattern j uses each class; it is
    never built, products with it are sums over the three classes of a pattern.
    """
    goal = histogram.astype(float).copy()
    goal[0] = 0.0
    x = np.zeros(len(patterns))
    active: list[int] = []

    def column(j: int) -> np.ndarray:
        out = np.bincount(patterns[j], minlength=len(goal)).astype(float)
        out[0] = 0.0
        return out

    matrix = np.zeros((len(goal), 0))
    residual = goal.copy()
    scale = max(goal.max(initial=0.0), 1.0)
    for _ in range(most):
        gain = residual[patterns].sum(axis=1)
        gain[active] = -np.inf
        j = int(gain.argmax()) if len(gain) else -1
        if j < 0 or gain[j] <= 1e-7 * scale:
            break
        active.append(j)
        matrix = np.column_stack([matrix, column(j)])
        while True:
            solved = np.linalg.lstsq(matrix, goal, rcond=None)[0]
            if solved.min(initial=1.0) > 1e-9:
                break
            now = x[active]
            falling = solved <= 1e-9
            step = np.min(now[falling] / np.maximum(now[falling] - solved[falling], 1e-12))
            now = now + step * (solved - now)
            now[falling & (now <= 1e-9 * scale)] = 0.0
            now[np.argmin(np.where(falling, now, np.inf))] = 0.0
            x[active] = now
            kept = now > 0
            active = [a for a, k in zip(active, kept, strict=True) if k]
            matrix = matrix[:, kept]
            if not active:
                solved = np.zeros(0)
                break
        x[:] = 0.0
        x[active] = solved
        residual = goal - matrix @ solved if active else goal.copy()
    return x


def exact(left: np.ndarray, pattern: tuple[int, ...], width: int, length: int) -> tuple[int, ...] | None:
    """Lengths, at most one class above the pattern's, that fill a sequence to the last token; None if none are left."""

    def choose(asked: list[int], room: int, used: tuple[int, ...]) -> tuple[int, ...] | None:
        low = (asked[0] - 1) * width + 1
        if len(asked) == 1:
            return (*used, room) if low <= room and left[room] > used.count(room) else None
        for size in range(min(asked[0] * width, room), low - 1, -1):
            if left[size] > used.count(size) and (found := choose(asked[1:], room - size, (*used, size))):
                return found
        return None

    return choose([int(c) for c in pattern if c], length, ())


def plan(histogram: np.ndarray, length: int = LENGTH, width: int = 8) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Where pieces go: (length, first rank, how many, first sequence, offset), and the number of sequences."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[int, int, int, int, int]] = []
    ranks = np.zeros(len(left), np.int64)
    sequences = 0
    # Sequences begun so far by their free tokens: (first sequence, how many).
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def take(size: int, number: int) -> None:
        ranks[size] += number
        left[size] -= number

    def begin(lengths: tuple[int, ...], number: int) -> None:
        """Begin so many equal sequences with pieces of the given lengths."""
        nonlocal sequences
        at = 0
        for size in lengths:
            out.append((size, int(ranks[size]), number, sequences, at))
            take(size, number)
            at += size
        if at < length:
            free[length - at].append((sequences, number))
        sequences += number

    if left[length]:
        begin((length,), int(left[length]))
    classes = -(-length // width)
    class_of = -(-np.arange(length + 1) // width)
    grouped = np.bincount(class_of, weights=left, minlength=classes + 1)
    patterns = enumerate_patterns(classes, grouped > 0)
    for pattern, wanted in sorted(zip(map(tuple, patterns), np.floor(fit(patterns, grouped) + 1e-6).astype(np.int64), strict=True), reverse=True):
        while wanted > 0:
            sizes = exact(left, pattern, width, length)
            if not sizes:
                break
            used = Counter(sizes)
            number = int(min(wanted, *(left[s] // n for s, n in used.items())))
            begin(sizes, number)
            wanted -= number
    # Best fit, longest first, many equal pieces at a time.
    heap = sorted(free)
    for size in range(length, 0, -1):
        while left[size]:
            at = np.searchsorted(heap, size)
            if at == len(heap):
                fits = length // size
                number = int(left[size])
                if number >= fits:
                    begin((size,) * fits, number // fits)
                else:
                    begin((size,) * number, 1)
                heap = sorted(k for k in free if free[k])
                continue
            room = int(heap[at])
            sequence, number = free[room].pop()
            used_now = min(number, int(left[size]))
            if number > used_now:
                free[room].append((sequence + used_now, number - used_now))
            out.append((size, int(ranks[size]), used_now, sequence, length - room))
            take(size, used_now)
            if room > size:
                free[room - size].append((sequence, used_now))
            heap = sorted(k for k in free if free[k])
    return out, sequences


def packed(docs: DataFrame, tokenizer: str, length: int = LENGTH, closing: int = CLOSING_ID, width: int = 8) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    The plan is broadcast: its rows are bounded by the length of a sequence, not
    by the table (a few ranges for each length).
    """
    spark = docs.sparkSession
    found = written(pieces(docs, tokenizer, length, closing), "pieces")
    groups = found.groupBy("length", "salt").count()
    histogram = np.zeros(length + 1, np.int64)
    for row in groups.groupBy("length").agg(F.sum("count").alias("n")).collect():  # at most ``length`` rows
        histogram[row["length"]] = row["n"]
    ranges, _ = plan(histogram, length, width)
    places = spark.createDataFrame(ranges or [(0, 0, 0, 0, 0)], "size long, first long, number long, sequence long, offset long")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = groups.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = found.withColumn("nth", F.row_number().over(within) - 1)
    # At most length x SALTS rows, which is a bound of its own.
    ranked = ranked.join(F.broadcast(base), ["length", "salt"]).withColumn("rank", F.col("base") + F.col("nth"))
    byte_size = F.broadcast(places.groupBy("size").agg(F.sort_array(F.collect_list(F.struct("first", "number", "sequence", "offset"))).alias("ranges")))
    ranked = ranked.join(byte_size, ranked["length"] == byte_size["size"])
    hit = F.filter("ranges", lambda r: (r["first"] <= F.col("rank")) & (F.col("rank") < r["first"] + r["number"]))[0]
    ranked = ranked.withColumn("hit", hit)
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("hit.sequence") + F.col("rank") - F.col("hit.first")).alias("sequence_id"), F.col("hit.offset").alias("offset"))
