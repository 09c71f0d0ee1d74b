"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, everything but letters and marks is one blank.  Runs of
one to three code points are hashed to cells.  Document frequencies are counted
over all rows that may be learned from; the weights are fitted on a bounded
sample of them (``each`` rows of a language, by hash) with follow-the-
regularised-leader and elastic-net penalties (McMahan et al., 2013), which leaves
most weights exactly zero; a temperature is fitted on a part of the sample that
the weights did not see.

Defined results: ``und`` with score 0 where a text is null or has no letter, or
where nothing could be learned (no labelled rows); repeated rows are predicted
alike and learned once (of several labels of a doc_id the least, with a text of
its own); very long texts are read whole; an empty table gives an empty result;
other columns are ignored.
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
from netloom.llm.grams import cell_counts, char_grams, code_points, collected, held_out, sampled

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    cells: int = 1 << 15
    longest: int = 3
    #: Rows of each language that weights are fitted on: the bound of the sample.
    each: int = 700
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    modulus: int = 3
    remainder: int = 1


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    idf: np.ndarray
    temperature: float


def featurise(texts: pa.Array, settings: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    texts = pc.replace_substring_regex(texts, r"[^\pL\pM]+", " ")
    codes, offsets = code_points(texts)
    grams = char_grams(codes, settings.longest, settings.cells)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        counts = np.zeros(settings.cells, np.int64)
        for n, g in enumerate(grams):
            if b - a > n:
                counts += np.bincount(g[a : b - n], minlength=settings.cells)
        used = np.flatnonzero(counts)
        yield used, counts[used]


def vector(cells: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf[cells]
    return x / max(float(np.sqrt(x @ x)), 1e-12)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Leader:
    """Follow the regularised leader, one rate for each weight."""

    def __init__(self, cells: int, classes: int, s: Settings) -> None:
        self.z, self.n, self.s = np.zeros((cells, classes)), np.zeros((cells, classes)), s

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n, s = self.z[at], self.n[at], self.s
        return np.where(np.abs(z) <= s.l1, 0.0, -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))

    def step(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1.0
        g = x[:, None] * p[None, :]
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.s.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, by golden section over its logarithm."""

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))
        return float(-np.log(p[np.arange(len(labels)), labels] + 1e-12).mean())

    low, high, ratio = -1.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(labels: list[str], rows: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, languages: list[str], s: Settings) -> Model:
    place = {x: i for i, x in enumerate(languages)}
    y = np.array([place[x] for x in labels])
    cells = [np.append(c, s.cells) for c, _ in rows]  # the last cell is the bias
    values = [np.append(vector(c, n, idf), 1.0) for c, n in rows]
    part = np.arange(len(rows)) % 5 == 0
    leader = Leader(s.cells + 1, len(languages), s)
    rng = np.random.default_rng(1)
    for _ in range(s.epochs):
        for i in rng.permutation(np.flatnonzero(~part)):
            leader.step(cells[i], values[i], int(y[i]))
    w = leader.weights(slice(None))
    held = np.flatnonzero(part)
    t = temperature(np.array([values[i] @ w[cells[i]] for i in held]), y[held]) if len(held) > 10 and len(languages) > 1 else 1.0
    return Model(languages, w[:-1].astype(np.float32), w[-1], idf, t)


def learn(docs: DataFrame, s: Settings = Settings()) -> Model | None:
    """A model from the rows whose key is not held out; None where there is no labelled row."""
    rows = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"), s.modulus, s.remainder) & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang")
    counts = cell_counts(rows, "lang", lambda t: featurise(t, s), s.cells)
    if not counts:
        return None
    seen = sum(c for c, _ in counts.values())
    number = sum(n for _, n in counts.values())
    idf = np.log((1.0 + number) / (1.0 + seen)) + 1.0
    labels, found = collected(sampled(rows, "lang", {k: n for k, (_, n) in counts.items()}, s.each), "lang", lambda t: featurise(t, s))
    languages = sorted(set(labels))
    return fit(labels, found, idf, languages, s) if languages else None


def predict(model: Model | None, texts: pa.Array, s: Settings) -> tuple[list[str], np.ndarray]:
    names, scores = [], np.zeros(len(texts))
    letters = pc.match_substring_regex(pc.fill_null(texts, ""), r"\pL").to_pylist()
    for i, (cells, counts) in enumerate(featurise(texts, s)):
        if model is None or not letters[i]:
            names.append(UNKNOWN)
            continue
        p = softmax((vector(cells, counts, model.idf) @ model.weights[cells] + model.bias) / model.temperature)
        best = int(p.argmax())
        names.append(model.languages[best])
        scores[i] = p[best]
    return names, scores


def sent_to(docs: DataFrame, model: Model | None):
    """The model as plain arrays: its class need not exist where it arrives."""
    return docs.sparkSession.sparkContext.broadcast(vars(model) if model else None)


def identified(docs: DataFrame, s: Settings = Settings(), model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    sent = sent_to(docs, model or learn(docs, s))
    rows = docs.select("doc_id", held_out(F.col("doc_id"), s.modulus, s.remainder).alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            names, scores = predict(Model(**sent.value) if sent.value else None, batch.column("text"), s)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    return mapped(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, least: float = 0.5, s: Settings = Settings()) -> DataFrame:
    """The documents whose language is known with a probability of ``least`` or more, with all their columns."""
    sent = sent_to(docs, learn(docs, s))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            names, scores = predict(Model(**sent.value) if sent.value else None, batch.column("text"), s)
            yield batch.filter(pa.array([n != UNKNOWN and p >= least for n, p in zip(names, scores, strict=True)], pa.bool_()))

    return mapped(docs, run, docs.schema)
