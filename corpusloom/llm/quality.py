"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated.

Fitting happens in one task, on a bounded sample of labelled rows (``max_per_class`` of each class, the smallest by hash
of their id); scoring covers every row and whole texts, needs no shuffle and broadcasts only the model, whose size
``max_units * dim`` bounds.

A *unit* is what a word counts as: the word itself where the sample holds it often, else its shape (letter case,
closing punctuation, digits); a word equal to the one before it is the unit ``<again>``. Each unit has a sparse
ternary index vector drawn from its hash; its word vector adds the index vectors of its neighbours. A document
is the mean of its words' vectors.

Defined cases: null and empty texts have the zero vector, and score as the network scores it; without labelled
rows every score is 0.5, with one class only the score is that class; repeated rows score alike; a null doc_id is not held
out and teaches nothing; score() replaces columns named like its outputs, the stage leaves all columns as they were; an empty table gives an empty result. Labels given twice count as their mean, 1 from 0.5.
"""

from __future__ import annotations

import operator
import pickle
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CACHE_ENTRIES, crc_mod, free_names, load

TAIL = re.compile(r"[^\w\s]+$")
AGAIN = "<again>"


def shape_of(word: str) -> str:
    """Class of a rare word: its letter case, whether it holds digits, its closing punctuation (3 at most)."""
    tail = TAIL.search(word)
    core = word[: tail.start()] if tail else word
    case = "none" if not core else "upper" if core.isupper() and len(core) > 1 else "lower" if core.islower() else "title" if core.istitle() else "mixed"
    digits = "digits" if any(c.isdigit() for c in core) else "letters"
    return f"<{case} {digits} {tail[0][:3] if tail else ''}>"


class Units(dict):
    """Row of a word's unit in the vector matrix; 0 is the unit of shapes never seen."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> int:
        value = self.vocabulary.get(word)
        if value is None:
            value = self.vocabulary.get(shape_of(word), 0)
        if len(self) < CACHE_ENTRIES:
            self[word] = value
        return value


def rows_of(text: str | None, units: Units) -> np.ndarray:
    words = text.split() if text else []
    rows = np.fromiter(map(units.__getitem__, words), np.int64, len(words))
    if len(words) > 1:
        again = np.fromiter(map(operator.eq, words[1:], words), bool, len(words) - 1)
        rows[1:][again] = units.vocabulary.get(AGAIN, 0)
    return rows


@dataclass
class Model:
    vocabulary: dict[str, int]
    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    constant: float | None = None

    def pooled(self, texts: list[str | None], units: Units | None = None) -> np.ndarray:
        units = units if units is not None else Units(self.vocabulary)
        out = np.zeros((len(texts), self.vectors.shape[1]))
        for k, text in enumerate(texts):
            rows = rows_of(text, units)
            if len(rows):
                seen, counts = np.unique(rows, return_counts=True)
                out[k] = counts @ self.vectors[seen] / len(rows)
        return out

    def scores(self, texts: list[str | None], units: Units | None = None) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        x = (self.pooled(texts, units) - self.centre) / self.scale
        z = np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2
        return 1 / (1 + np.exp(-np.clip(z / self.temperature, -60, 60)))


def index_vectors(names: list[str], dim: int, ones: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of each name's index vector."""
    seeds = np.array([[xxhash.xxh3_64_intdigest(n.encode("utf-8", "surrogatepass"), seed=s) for s in range(ones)] for n in names], np.uint64)
    return (seeds % np.uint64(dim)).astype(np.int64), np.where(seeds >> np.uint64(63), 1.0, -1.0)


def random_indexing(docs: list[np.ndarray], names: list[str], dim: int, ones: int = 6, window: int = 2) -> np.ndarray:
    """A unit's index vector plus the unit-length sum of its neighbours' index vectors."""
    places, signs = index_vectors(names, dim, ones)
    size = len(names) * dim
    context = np.zeros(size)
    flat = np.concatenate([np.r_[d, np.full(window, -1)] for d in docs] or [np.empty(0, np.int64)]).astype(np.int64)
    for step in range(1, window + 1):
        left, right = flat[:-step], flat[step:]
        both = (left >= 0) & (right >= 0)
        for a, b in ((left[both], right[both]), (right[both], left[both])):
            for one in range(ones):
                context += np.bincount(a * dim + places[b, one], weights=signs[b, one], minlength=size)
    context = context.reshape(len(names), dim)
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
    own = np.zeros((len(names), dim))
    np.add.at(own, (np.arange(len(names))[:, None], places), signs / np.sqrt(ones))
    return own + context


def train(texts: list[str | None], labels: np.ndarray, weights: np.ndarray, dim: int = 64, hidden: int = 24, max_units: int = 8000, least: int = 20, epochs: int = 60, seed: int = 7) -> Model:
    """Fits vectors, network and temperature; every fifth row only calibrates."""
    counts: Counter[str] = Counter()
    for text in texts:
        words = text.split() if text else []
        counts.update(words)
    shapes: Counter[str] = Counter()
    common = {w for w, c in counts.most_common(max_units) if c >= least}
    for w, c in counts.items():
        if w not in common:
            shapes[shape_of(w)] += c
    names = ["<unseen>", AGAIN, *sorted(common - {AGAIN, "<unseen>"}), *sorted(s for s, _ in shapes.most_common(max_units) if s not in common)]
    names = list(dict.fromkeys(names))
    vocabulary = {n: k for k, n in enumerate(names)}
    units = Units(vocabulary)
    vectors = random_indexing([rows_of(t, units) for t in texts], names, dim)
    model = Model(vocabulary, vectors, np.zeros(dim), np.ones(dim), np.zeros((dim, hidden)), np.zeros(hidden), np.zeros(hidden), 0.0, 1.0)
    if len(set(labels.tolist())) < 2:
        model.constant = float(labels[0]) if len(labels) else 0.5
        return model
    x = model.pooled(texts, units)
    model.centre, model.scale = x.mean(0), x.std(0) + 1e-6
    x = (x - model.centre) / model.scale
    dice = np.random.default_rng(seed)
    order = dice.permutation(len(x))
    held, learn = order[::5], np.setdiff1d(order, order[::5])
    if len(set(labels[learn].tolist())) < 2:
        learn = order
    p = [dice.normal(0, dim**-0.5, (dim, hidden)), np.zeros(hidden), dice.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        shuffled = dice.permutation(learn)
        for at in range(0, len(shuffled), 128):
            i = shuffled[at : at + 128]
            h = np.tanh(x[i] @ p[0] + p[1])
            error = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -60, 60))) - labels[i]) * weights[i] / len(i)
            back = np.outer(error, p[2]) * (1 - h * h)
            step += 1
            for k, g in enumerate((x[i].T @ back + 1e-4 * p[0], back.sum(0), h.T @ error + 1e-4 * p[2], error.sum(keepdims=True))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model.w1, model.b1, model.w2, model.b2 = p[0], p[1], p[2], float(p[3][0])
    z = np.tanh(x[held] @ model.w1 + model.b1) @ model.w2 + model.b2

    def loss(t: float) -> float:
        s = np.clip(z / t, -500, 500)
        return float((weights[held] * (np.logaddexp(0, s) - labels[held] * s)).sum())

    low, high = 0.5, 20.0  # golden-section search; the loss in 1/T is convex
    for _ in range(50):
        a, b = low + 0.382 * (high - low), low + 0.618 * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    model.temperature = (low + high) / 2
    return model


def fit(documents: DataFrame, labels: DataFrame, max_per_class: int = 1500, target: str = "quality") -> Model:
    """Learns from labelled rows whose crc32(doc_id as text) mod 5 is not 0, max_per_class of each class at most.

    The sampled texts meet in one task, which fits the model; the driver gets the model alone.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & (crc_mod() != 0)).groupBy("doc_id").agg((F.avg(F.col(target).cast("double")) >= 0.5).cast("int").alias("y"))
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_class)
        picked = part if picked is None else picked.unionByName(part)
    wanted = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # 2 * max_per_class rows at most

    def run(batches):
        got = sorted({(doc_id, text or "", y) for batch in batches for doc_id, text, y in zip(*(c.to_pylist() for c in batch.columns), strict=True)})
        y = np.array([g[2] for g in got], float)
        held = {k: max(1, int((y == k).sum())) for k in (0, 1)}
        total = max(1, sum(totals.values()))
        weights = np.array([totals[g[2]] / held[g[2]] for g in got]) * (len(got) / total) if got else np.empty(0)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train([g[1] for g in got], y, weights))], pa.binary())], ["model"])

    fitted = wanted.select("doc_id", "text", "y").repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(fitted["model"]) if fitted else train([], np.empty(0), np.empty(0))  # a plan known to be empty has no task


def score(documents: DataFrame, model: Model, threshold: float = 0.3, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """documents with two columns more, by these names, which replace columns named alike; a map over its partitions."""
    kept = [c for c in documents.columns if c.lower() not in (score.lower(), predicted.lower())]
    data = documents.select(*[F.col(f"`{c}`") for c in kept])
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        units = Units(own.vocabulary)
        for batch in batches:
            s = own.scores(batch.column(kept.index("text")).to_pylist(), units)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64()), pa.array(s >= threshold).cast(pa.int32())], [*kept, score, predicted])

    return data.mapInArrow(run, T.StructType([*data.schema.fields, T.StructField(score, T.DoubleType()), T.StructField(predicted, T.IntegerType())]))


def query(spark, sf_dir: str) -> DataFrame:
    documents = load(spark, sf_dir, "documents")
    model = fit(documents, load(spark, sf_dir, "labels"))
    data = documents.select("doc_id", F.coalesce(crc_mod() == 0, F.lit(False)).alias("held_out"), "text")
    return score(data, model).drop("text")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier does not reject; null, empty and repeated rows are scored like any other."""
    model = fit(docs, load(spark, sf_dir, "labels"))
    names = free_names(docs.columns, "score", "predicted")
    return score(docs, model, 0.3, *names).filter(F.col(names[1]) == 1).select(*docs.columns)
