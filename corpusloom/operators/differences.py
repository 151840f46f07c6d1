"""How the words of one text differ from those of another: degrees by their links, words that have moved."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Degrees of a linked word, the closest first (fixed values).
LINKED = ["Same", "Form", "Lemma", "Linked", "Unsure"]


def degrees(left: DataFrame, right: DataFrame, links: DataFrame, absent: DataFrame, sure: float = 0.5) -> DataFrame:
    """seg, position, degree of left's words (seg, position, word, form, lemma).

    links: seg, left_at, right_at, confidence (null: stated). The closest of a word's linked partners decides: the same word, another
    form, the same lemma, linked, linked unsurely. Words without a link are Absent where that is recorded (absent: seg,
    position), Unmatched in a segment with links, else Unlinked.
    """
    other = right.select("seg", F.col("position").alias("right_at"), F.col("word").alias("_w"), F.col("form").alias("_f"), F.col("lemma").alias("_l"))
    mine = left.withColumnRenamed("position", "left_at")
    close = F.when(F.col("word") == F.col("_w"), 0).when(F.col("form") == F.col("_f"), 1).when(F.col("lemma") == F.col("_l"), 2).when(F.coalesce(F.col("confidence"), F.lit(1.0)) >= sure, 3).otherwise(4)
    judged = links.join(mine, ["seg", "left_at"]).join(other, ["seg", "right_at"]).groupBy("seg", F.col("left_at").alias("position")).agg(F.min(close).alias("_d"))
    out = left.join(judged, ["seg", "position"], "left").join(absent.select("seg", "position").distinct().withColumn("_a", F.lit(True)), ["seg", "position"], "left")
    out = out.join(links.select("seg").distinct().withColumn("_g", F.lit(True)), "seg", "left")
    degree = F.when(F.col("_d").isNotNull(), F.get(F.array(*[F.lit(d) for d in LINKED]), "_d")).when(F.col("_a"), "Absent").when(F.col("_g"), "Unmatched").otherwise("Unlinked")
    return out.withColumn("degree", degree).drop("_d", "_a", "_g")


def nearest_pairs(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """One-to-one pairs of two sorted lists of places, the nearest first, then the earlier of a, then of b.

    The nearest free places of both sides are neighbours among all free places: a heap holds the neighbours of either side, and
    what a pair leaves between its own neighbours is put in when it goes.
    """
    places = sorted([(p, 0) for p in a] + [(p, 1) for p in b])
    before, after = list(range(-1, len(places) - 1)), [*range(1, len(places)), -1]
    free, heap, out = [True] * len(places), [], []

    def offer(i: int, j: int) -> None:
        if i >= 0 and j >= 0 and places[i][1] != places[j][1]:
            (x, _), (y, _) = sorted((places[i], places[j]), key=lambda p: p[1])
            heapq.heappush(heap, (abs(x - y), x, y, i, j))

    for i in range(len(places) - 1):
        offer(i, i + 1)
    while heap:
        _, x, y, i, j = heapq.heappop(heap)
        if not (free[i] and free[j]):
            continue
        out.append((x, y))
        free[i] = free[j] = False
        left, right = before[i], after[j]
        if left >= 0:
            after[left] = right
        if right >= 0:
            before[right] = left
        offer(left, right)
    return out


def moved(left: DataFrame, right: DataFrame) -> DataFrame:
    """seg, word, left_at, right_at: words that both sides print in a segment, paired one to one, the nearest places first.

    left and right: seg, position, word; what stands at the same place has not moved and takes no part.
    """
    same = left.join(right, ["seg", "position", "word"], "left_semi").select("seg", "position", "word")
    places = lambda df, name: df.join(same, ["seg", "position", "word"], "left_anti").groupBy("seg", "word").agg(F.sort_array(F.collect_list("position")).alias(name))
    both = places(left, "a").join(places(right, "b"), ["seg", "word"])

    def run(batches):
        for batch in batches:
            rows = [(seg, word, i, j) for seg, word, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True) for i, j in nearest_pairs(a, b)]
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["seg", "word", "left_at", "right_at"])

    return both.select("seg", "word", "a", "b").mapInArrow(run, "seg long, word string, left_at long, right_at long")
