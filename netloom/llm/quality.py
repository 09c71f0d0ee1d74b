"""Quality classifier: naive Bayes support vectors (Wang and Manning, 2012).

A text's features are indicators of n-grams: runs of one to three characters
(digits are alike), and one to three of its words' shapes (classes of characters,
marked where a word repeats the one before).  They are hashed to cells.  The
classifier is fitted on a bounded sample of the labelled rows that may be learned
from (about ``each`` rows of a class, by hash): each indicator is scaled by its
class log-count ratio, a linear hinge-loss model is fitted by dual coordinate
descent (Hsieh et al., 2008), and its margin turned into a probability by a
sigmoid fitted on a part of the sample that the model did not see.

Defined results: null and empty texts have no indicators, so their score is the
bias's; documents without a label are scored like others; of several labels of
one document the least counts; where nothing can be learned, or only one
class, the score is that class's share (0.5 if there is none); repeated rows are
scored alike; very long texts are read whole; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import mapped, slices
from netloom.llm.grams import char_grams, code_points, collected, held_out, sampled


@dataclass(frozen=True)
class Settings:
    cells: int = 1 << 16
    longest: int = 3
    #: Rows of each class that the model is fitted on: the bound of the sample.
    each: int = 2000
    smoothing: float = 1.0
    cost: float = 1.0
    rounds: int = 20
    modulus: int = 5
    remainder: int = 0
    #: Scores from here on are predicted 1.
    cut: float = 0.3


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float


def shapes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A code for each word's shape, one text after another, and where each text's begin."""
    plain = pc.utf8_trim(pc.replace_substring_regex(texts, r"\s+", " "), " ")
    lists = pc.split_pattern(plain, " ")
    offsets = np.append(0, np.cumsum(np.asarray(pc.list_value_length(lists), dtype=np.int64)))
    word = lists.flatten().dictionary_encode()
    names, place = word.dictionary, np.asarray(word.indices)
    for pattern, mark in ((r"\p{Lu}+", "A"), (r"[\p{Ll}\p{Lo}\p{Lm}\p{Lt}\pM]+", "a"), (r"\pN+", "0")):
        names = pc.replace_substring_regex(names, pattern, mark)
    shape = names.dictionary_encode()
    known = np.array([hash_text(x) for x in shape.dictionary.to_pylist()], np.uint32)
    out = known[np.asarray(shape.indices)][place] if len(known) else np.zeros(0, np.uint32)
    again = np.append(False, place[1:] == place[:-1])
    again[offsets[:-1][offsets[:-1] < len(again)]] = False
    return np.where(again, out ^ np.uint32(0x5BD1E995), out), offsets


def hash_text(x: str) -> int:
    out = 2166136261
    for b in x.encode():
        out = (out ^ b) * 16777619 & 0xFFFFFFFF
    return out


def featurise(texts: pa.Array, s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    codes, offsets = code_points(pc.replace_substring_regex(texts, r"\pN", "0"))
    kinds, starts = shapes(texts)
    half = s.cells // 2
    chars, forms = char_grams(codes, s.longest, half), char_grams(kinds, s.longest, half)
    for a, b, c, d in zip(offsets[:-1], offsets[1:], starts[:-1], starts[1:], strict=True):
        seen = np.zeros(s.cells, bool)
        for n in range(s.longest):
            if b - a > n:
                seen[chars[n][a : b - n]] = True
                if d - c > n:
                    seen[forms[n][c : d - n] + half] = True
        used = np.flatnonzero(seen)
        yield used, np.ones(len(used), np.int32)


def ratios(labels: list[int], rows: list[tuple[np.ndarray, np.ndarray]], s: Settings) -> np.ndarray:
    """The log of how much likelier each cell is in class 1 than in class 0."""
    counts = np.full((2, s.cells), s.smoothing)
    for label, (cells, _) in zip(labels, rows, strict=True):
        counts[label, cells] += 1
    q, p = np.log(counts / counts.sum(axis=1, keepdims=True))
    return p - q


def descend(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weight: np.ndarray, s: Settings) -> np.ndarray:
    """Weights of the least hinge loss with a squared penalty; the last one is the bias.  Rows are (cells, values)."""
    w = np.zeros(len(weight) + 1)
    alpha, square = np.zeros(len(rows)), np.array([float(v @ v) + 1.0 for _, v in rows])
    most = np.where(labels > 0, s.cost * len(labels) / (2 * max((labels > 0).sum(), 1)), s.cost * len(labels) / (2 * max((labels < 0).sum(), 1)))
    rng = np.random.default_rng(3)
    for _ in range(s.rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            cells, values = rows[i]
            gradient = labels[i] * (values @ w[cells] + w[-1]) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), most[i])
            change = (new - alpha[i]) * labels[i]
            if change:
                w[cells] += change * values
                w[-1] += change
                moved = max(moved, abs(change))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w


def sigmoid_fit(margins: np.ndarray, labels: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and shift of the probability of class 1, by Newton's method on smoothed targets, weighted to the classes' true shares."""
    pos, neg = (labels > 0).sum(), (labels < 0).sum()
    goal = np.where(labels > 0, (pos + 1.0) / (pos + 2.0), 1.0 / (neg + 2.0))
    weight = np.where(labels > 0, share / max(pos, 1), (1 - share) / max(neg, 1)) * len(labels)
    x = np.column_stack([margins, np.ones(len(margins))])
    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        gradient = x.T @ (weight * (p - goal)) + 1e-3 * at
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), gradient)
        at -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(at[0]), float(at[1])


def scaled(cells: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """The indicators of one text, scaled by the ratios and brought to length 1 for the number of indicators."""
    return ratio[cells] / np.sqrt(max(len(cells), 1))


def learn(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    marks = labels.filter(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), s.modulus, s.remainder))
    totals = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    chosen = sampled(marks, "label", totals, s.each).groupBy("doc_id").agg(F.min("label").alias("label"))
    # About 2 * each rows, whatever the tables' sizes.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    names, found = collected(rows, "label", lambda t: featurise(t, s))
    if set(names) != {0, 1}:
        share = {(): 0.5, (0,): 0.0, (1,): 1.0}[tuple(sorted(set(names)))]
        return Model(np.zeros(s.cells, np.float32), 0.0, 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    ratio = ratios(names, found, s)
    y = np.where(np.array(names) == 1, 1.0, -1.0)
    vectors = [(c, scaled(c, ratio)) for c, _ in found]
    part = np.arange(len(y)) % 4 == 0
    fitted = [i for i in range(len(y)) if not part[i]]
    w = descend([vectors[i] for i in fitted], y[fitted], ratio, s)
    held = np.flatnonzero(part) if part.any() else np.arange(len(y))
    margins = np.array([vectors[i][1] @ w[vectors[i][0]] + w[-1] for i in held])
    slope, shift = sigmoid_fit(margins, y[held], totals[1] / (totals[0] + totals[1]))
    return Model((w[:-1] * ratio).astype(np.float32), float(w[-1]), slope, shift)


def scores(model: Model, texts: pa.Array, s: Settings) -> np.ndarray:
    out = np.zeros(len(texts))
    for i, (cells, _) in enumerate(featurise(texts, s)):
        margin = model.weights[cells].sum(dtype=np.float64) / np.sqrt(max(len(cells), 1)) + model.bias
        out[i] = 1 / (1 + np.exp(-np.clip(model.slope * margin + model.shift, -30, 30)))
    return out


def scored(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(vars(model or learn(docs, labels, s)))
    rows = docs.select("doc_id", held_out(F.col("doc_id"), s.modulus, s.remainder).alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**sent.value)
        for batch in slices(batches, "text"):
            found = scores(model, batch.column("text"), s)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found), pa.array((found >= s.cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return mapped(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The documents predicted 1, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(vars(learn(docs, labels, s)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**sent.value)
        for batch in slices(batches, "text"):
            yield batch.filter(pa.array(scores(model, batch.column("text"), s) >= s.cut))

    return mapped(docs, run, docs.schema)
