"""Feature collections of any size, read in parts: one JSON value need not fit a task.

A file is cut at closing braces, which Spark's text reader can do from any place
in it.  What a part means depends on what stands before it, so there are two
passes.  The first tells for each part how many quotes, braces and brackets it
leaves open, both if it begins within a string and if it does not; from these few
numbers the driver knows each part's beginning.  The second pass walks every part
from there and gives out the objects in the arrays of the root, pieces of those
that parts cut; the pieces of an object meet by its number.  Memory is bounded by
the largest object.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.sources.shared import written

#: Parts that the driver may hold the beginnings of; at 128 MB a part this is far beyond any one collection.
MOST_PARTS = 1_000_000
ESCAPE = re.compile(r"\\.", re.S)
STRING = re.compile(r'"[^"]*"')
#: What stands before the next object, strings whole.
BEFORE = re.compile(r'(?:[^"{]|"(?:[^"\\]|\\.)*")*', re.S)
OPENS = re.compile(r'(?<!\\)"features"\s*:\s*\[\s*$')
EMPTY = re.compile(r'(?<!\\)"features"\s*:\s*\[\s*\]')
PIECE = "file string, part long, place long, head boolean, mark int, present boolean, odd boolean, text string"


def outside(value: str, inside: bool) -> tuple[str, bool]:
    """The text without its strings, and whether its end is within one."""
    text = ESCAPE.sub("", value) if "\\" in value else value
    ends = inside ^ bool(text.count('"') & 1)
    return STRING.sub("", ('"' if inside else "") + text + ('"' if ends else "")), ends


def steps(value: str, inside: bool) -> tuple[int, int, bool]:
    """Braces and brackets that a record leaves open, with the closing brace that ends it, and whether it ends in a string."""
    text, ends = outside(value, inside)
    return text.count("{") - (not ends), text.count("[") - text.count("]"), ends


@dataclass
class Walk:
    """The second pass over one part."""

    inside: bool
    braces: int
    brackets: int
    place: int = 0
    #: 1 in the array of features, 2 in another of the root, None where an earlier part says.
    mark: int | None = None
    present: bool = False
    #: Something else than one comma stands between objects.
    odd: bool = False
    head: bool = False
    held: list[str] | None = None

    def __post_init__(self) -> None:
        if self.braces >= 2:
            self.held = []

    def step(self, value: str) -> tuple[bool, int | None, str] | None:
        """The object (head, mark, text) that this record ends, if it ends one."""
        braces, brackets, ends = steps(value, self.inside)
        if self.held is None and self.braces <= 1:
            text = ('"' if self.inside else "") + value
            if not self.braces:
                text = text.lstrip("\ufeff \t\r\n")
                if not text:
                    return None
                if not text.startswith("{") or self.brackets:
                    raise ValueError("the root must be one object")
                text = text[1:]
            text = self.before(text)
            if text is not None:
                self.head, self.held = True, [text]
        elif self.held is not None:
            self.held.append(value)
        self.inside, self.braces, self.brackets = ends, self.braces + braces, self.brackets + brackets
        if self.held is None or ends or self.braces != 1:
            return None
        done = self.head, self.mark, "}".join([*self.held, ""])
        self.head, self.held = False, None
        if self.brackets != 1:  # a member of the root
            return None
        self.place += 1
        return done

    def before(self, text: str) -> str | None:
        """Read what stands before the next object; that object's text if it is an element of an array of the root."""
        cut = BEFORE.match(text).end()
        root, rest = text[:cut], text[cut:]
        plain, _ = outside(root, False)
        opened, closed = plain.count("["), plain.count("]")
        if self.brackets == 1 and self.mark != 2 and (closed or rest.startswith("{")):
            self.odd |= plain.split("]")[0].strip() != ("" if closed else ",")
        if EMPTY.search(root):
            self.present = True
        if opened and self.brackets + opened - closed == 1:
            self.mark = 1 if OPENS.search(root) else 2
            self.present |= self.mark == 1
        return rest if rest.startswith("{") and self.brackets + opened - closed == 1 else None


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[str]]]:
    """Records with the file and part they are of, in runs."""
    for batch in batches:
        files, places, values = (batch.column(c).to_pylist() for c in ("file", "part", "value"))
        at = 0
        for i in range(1, len(files) + 1):
            if i == len(files) or (files[i], places[i]) != (files[at], places[at]):
                yield files[at], places[at], values[at:i]
                at = i


def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each part leaves open, if it begins outside of strings (0) and within one (1)."""
    key, sums = None, [[0, 0, False], [0, 0, True]]

    def row() -> pa.RecordBatch:
        (b0, k0, e0), (b1, k1, e1) = sums
        return pa.RecordBatch.from_pylist([{"file": key[0], "part": key[1], "b0": b0, "k0": k0, "e0": e0, "b1": b1, "k1": k1, "e1": e1}])

    for file, part, values in parts(batches):
        if key != (file, part):
            if key:
                yield row()
            key, sums = (file, part), [[0, 0, False], [0, 0, True]]
        for value in values:
            for one in sums:
                braces, brackets, one[2] = steps(value, one[2])
                one[0] += braces
                one[1] += brackets
    if key:
        yield row()


def beginnings(rows: list[tuple]) -> dict[tuple[str, int], tuple[bool, int, int]]:
    """Where each part begins: within a string or not, and the open braces and brackets.  A file that ends otherwise than it began is an error."""
    out: dict[tuple[str, int], tuple[bool, int, int]] = {}
    last, state = None, (False, 0, 0)

    def check() -> None:
        # Blanks behind the root count as one more record, and so as one more brace.
        if last is not None and (state[0] or state[1] not in (0, -1) or state[2]):
            raise ValueError(f"not one JSON object: {last}")

    for file, part, b0, k0, e0, b1, k1, e1 in sorted(rows):
        if file != last:
            check()
            last, state = file, (False, 0, 0)
        out[file, part] = state
        state = (e1, state[1] + b1, state[2] + k1) if state[0] else (e0, state[1] + b0, state[2] + k0)
    check()
    return out


def objects(spark: SparkSession, path: str) -> DataFrame:
    """(feature_seq, feature): the text of each element of ``features`` of a collection file, or of all files of a folder.

    Numbers ascend with the files' names and the places in them.  Other members of
    the root are skipped.  Errors: a root that is no object, a file without an array
    ``features``, elements that are no objects, and texts of features that are no
    JSON.  Only a root whose last brace is missing is read as if it had one.
    """
    text = spark.read.option("lineSep", "}").text(path).select("value", "_metadata.file_path", "_metadata.file_block_start").toDF("value", "file", "part")
    found = text.mapInArrow(measured, "file string, part long, b0 long, k0 long, e0 boolean, b1 long, k1 long, e1 boolean").limit(MOST_PARTS + 1).collect()
    if not found:
        raise ValueError(f"features must be an array: {path}")
    if len(found) > MOST_PARTS:
        raise ValueError(f"more than {MOST_PARTS} parts; give features as lines")
    starts = spark.sparkContext.broadcast(beginnings([tuple(r) for r in found]))

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, walk = None, None
        names = [f.split()[0] for f in PIECE.split(", ")]
        types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.bool_(), pa.bool_(), pa.string()]

        def sent(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

        def end() -> list[tuple]:
            cut = [(*key, walk.place, walk.head, walk.mark, None, None, "}".join([*walk.held, ""]))] if walk.held else []
            return [*cut, (*key, walk.place, None, walk.mark, walk.present, walk.odd, None)]

        for file, part, values in parts(batches):
            rows = []
            if key != (file, part):
                if key:
                    rows = end()
                key, walk = (file, part), Walk(*starts.value[file, part])
            for value in values:
                done = walk.step(value)
                if done:
                    rows.append((*key, walk.place - 1, done[0], done[1], None, None, done[2]))
            if rows:
                yield sent(rows)
        if key:
            yield sent(end())

    pieces = written(text.mapInArrow(walked, PIECE), "collection")
    # One row for each part: objects and marks before it.
    ends = pieces.filter("text is null")
    lost = ends.groupBy("file").agg(F.max("present").alias("present")).filter("not present").first()
    if lost:
        raise ValueError(f"features must be an array: {lost['file']}")
    before = Window.orderBy("file", "part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("file", "part", "mark", "odd", F.coalesce(F.sum("place").over(before), F.lit(0)).alias("seen"), F.last("mark", True).over(before.partitionBy("file")).alias("inherited"))
    mixed = ends.filter(F.col("odd") & (F.coalesce("inherited", "mark") == 1)).first()
    if mixed:
        raise ValueError(f"features must be objects with commas between them: {mixed['file']}")
    rows = pieces.filter("text is not null").join(ends.select("file", "part", "seen", "inherited"), ["file", "part"])
    piece = F.struct("file", "part", "head", "text", F.coalesce("mark", "inherited").alias("mark"))
    whole = rows.groupBy((F.col("seen") + F.col("place")).alias("feature_seq")).agg(F.sort_array(F.collect_list(piece)).alias("p"), F.min(F.when(F.col("head"), F.struct("file", "part"))).alias("first"))
    # Pieces before an object's head are of a member of the root that a whole part could not tell from an element.
    own = F.filter("p", lambda x: F.struct(x["file"], x["part"]) >= F.col("first"))
    whole = whole.select("feature_seq", F.array_join(F.transform(own, lambda x: x["text"]), "").alias("feature"), F.get(own, F.lit(0))["mark"].alias("mark")).filter("mark = 1")
    sound = F.expr("try_parse_json(feature)").isNotNull()
    return whole.select("feature_seq", F.when(sound, F.col("feature")).otherwise(F.raise_error(F.lit("a feature is no JSON")).cast("string")).alias("feature"))
