"""Document fingerprints: the k smallest distinct hashes of a text's five-word shingles.

A sketch is the sorted array of these hashes. Sketches of parts merge into the sketch of the whole, which is how a long text is
sketched, segment by segment; two of them estimate resemblance and containment, one the number of distinct shingles. A
fingerprint is the sketch in base 64, 8 bytes a hash. Texts with fewer than five words have their whole sequence as the only
shingle; null, empty and blank texts have the empty sketch, which resembles another empty one fully and all others not at all.

The edited text needs each document's successor by id. Rows are dealt out by ranges of the id, once, a task for each range; the
first document of each range also goes, as a mark, to the range before, so no task needs another one's rows and no
single task holds all. Rows that share an id stand in the order of their texts; null ids come first; other columns are ignored; an
empty table has no rows; the last document's successor is the first one, which may be itself.
"""

from __future__ import annotations

import base64
import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, load, shingle_hashes, words_of

#: Hashes of a sketch; the estimate of a resemblance of a half is off by about .03.
SIZE = 256
#: Shingles that are sketched at once.
SEGMENT = 200_000
SPACE = 2.0**64
#: Ranges of the id at most, as their limits go along with the plan; a range is sorted and streamed, so it may be as long as it likes.
MOST_RANGES = 100_000


def sketch(hashes: np.ndarray, size: int = SIZE) -> np.ndarray:
    return np.unique(hashes)[:size]


def merge(parts: list[np.ndarray], size: int = SIZE) -> np.ndarray:
    """Sketch of the union of what the parts cover."""
    return sketch(np.concatenate([np.empty(0, np.uint64), *parts]), size)


def distinct_count(a: np.ndarray, size: int = SIZE) -> float:
    """Estimated number of distinct shingles; exact below size."""
    return float(len(a)) if len(a) < size else (size - 1) / ((float(a[-1]) + 1) / SPACE)


def resemblance(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated Jaccard similarity: the share of the union's smallest hashes that both hold."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:size]
    return float(len(np.intersect1d(np.intersect1d(a, b, True), union, True))) / len(union)


def containment(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated share of a's shingles that b holds; 1 for an empty a."""
    if not len(a):
        return 1.0
    j, na, nb = resemblance(a, b, size), distinct_count(a, size), distinct_count(b, size)
    return min(1.0, max(0.0, j * (na + nb) / (1 + j) / na))


def to_text(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


def of_text(text: str | None, hashes: WordHash, size: int = SIZE) -> np.ndarray:
    words = words_of(text)
    parts = [words[at : at + SEGMENT + 4] for at in range(0, max(1, len(words) - 4), SEGMENT)]
    return merge([sketch(shingle_hashes(hashes.array(part)), size) for part in parts], size)


def fingerprint(documents: DataFrame, size: int = SIZE) -> DataFrame:
    """documents' doc_id with fingerprint and estimated distinct shingles; a map over its partitions."""

    def run(batches):
        hashes = WordHash()
        for batch in batches:
            sketches = [of_text(t, hashes, size) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([to_text(s) for s in sketches], pa.string()), pa.array([distinct_count(s, size) for s in sketches], pa.float64())], ["doc_id", "fingerprint", "n_distinct"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string, n_distinct double")


def ranges_with_marks(documents: DataFrame, rows_in_range: int = 4000) -> DataFrame:
    """doc_id, text, part, mark: rows by ranges of the id; marks are copies of the next range's first row."""
    ids = documents.select("doc_id")
    n = ids.count()
    parts = min(MOST_RANGES, max(1, -(-n // rows_in_range)))
    probabilities = [k / parts for k in range(1, parts)]
    edges = sorted({int(b) for b in ids.approxQuantile("doc_id", probabilities, 1 / (4 * parts))}) if probabilities else []
    part = F.lit(0)
    if edges:  # number of edges up to the id, by binary search
        steps = F.lit([1 << k for k in reversed(range(len(edges).bit_length()))])
        limits = F.from_json(F.lit(json.dumps(edges)), "array<bigint>")  # folds into one literal
        part = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(limits, at + step - 1) <= F.col("doc_id"), at + step).otherwise(at))
    firsts = ids.select("doc_id", part.alias("part")).groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id"))).alias("first"))
    order = sorted((r["part"], r["first"]["doc_id"]) for r in firsts.collect()) if n else []  # one row a range
    before = [(order[k][1], order[k - 1][0]) for k in range(len(order))]  # the last range has the very first row as its mark
    spark = documents.sparkSession
    marks = spark.createDataFrame(before or [(0, 0)], "first_id long, before int").limit(len(before))
    rows = documents.select("doc_id", "text", part.alias("part"), F.lit(False).alias("mark"))
    known = documents.select("doc_id", "text").join(F.broadcast(marks), F.col("doc_id").eqNullSafe(F.col("first_id")))
    extra = known.groupBy("doc_id", "before").agg(F.min(F.struct(F.col("text").isNotNull().alias("known"), "text")).alias("least")).select("doc_id", F.col("least.text").alias("text"), F.col("before").alias("part"), F.lit(True).alias("mark"))
    return rows.unionByName(extra).repartitionById(max(parts, 1), "part").sortWithinPartitions("part", "mark", "doc_id", "text")


def edited(documents: DataFrame, size: int = SIZE) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, with both likenesses, the estimated number of distinct shingles and
    the estimated share of them that the next document holds."""

    def run(batches):
        hashes = WordHash()

        def row(doc_id, text, other):
            n = len(text)
            own = text[: n - n // 2] + other[: n // 2]
            a, b, c = (of_text(x, hashes, size) for x in (text, own, other))
            return (doc_id, n, hashlib.sha256(own.encode("utf-8", "surrogatepass")).hexdigest(), to_text(a), to_text(b), resemblance(a, b, size), resemblance(a, c, size), distinct_count(a, size), containment(a, c, size))

        out, held = [], None  # held: the row that waits for its successor
        for batch in batches:
            for doc_id, text, part, mark in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = text or ""
                if held and held[2] == part:
                    out.append(row(held[0], held[1], text))
                held = None if mark else (doc_id, text, part)
            if len(out) >= 500:
                yield table(out)
                out = []
        if out:
            yield table(out)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_distinct", "held_by_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.float64()]

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return ranges_with_marks(documents).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_distinct double, held_by_next double")


def query(spark, sf_dir: str) -> DataFrame:
    return edited(load(spark, sf_dir, "documents"))
