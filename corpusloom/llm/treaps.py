"""Ranked lexical search: inverted treaps, traversed together.

The index holds, for each shard of documents and each term, a treap of the documents that hold the term: a search tree by
doc_id and a heap by impact (the part of a score that the document and its number of occurrences decide; equal impacts by a hash
of the document, so copies make no chains). Nodes are numbered in doc_id order and kept as arrays of impacts and children.

A search walks an item's treaps together over intervals of documents. In an interval each term's highest impact is its topmost
node inside; the sum of weight times impact bounds every score there, and an interval that cannot enter the top k any more (ties
to the smaller doc_id included) is dropped with all its subtrees. Otherwise the document of the greatest summand is scored,
each treap is split there by going down its search order, and both halves follow, those of the highest bounds first, many
intervals at a time. A task goes on from shard to shard with the best k of each item so far, so that later shards start
with high bars; the tasks' best k meet per item.

Weights and impacts need N, L and df first: one pass turns each document into its length and its items' terms with their counts
(kept in the shared folder), from which the numbers, and then shards of about ``shard`` documents, are made. Items come in blocks
of about ``item_bytes`` of text whose terms are broadcast; each block is searched against all documents. The index has the terms
that its block asks for: no other posting is ever read.

Defined cases: null and empty texts hold no terms, and rows without doc_id or item_id take no part; rows that repeat a doc_id are
documents of their own; rows that repeat an item_id are one item with the terms of all; an item without terms that any document
holds has no rows; other columns are ignored; empty tables have no rows.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, load, mixed, slices

RESULT = "item_id long, rank int, doc_id long, score long"
#: ASCII letters in lower case; digits and bytes of other letters stay; all else parts terms.
PLAIN = bytes(c if c >= 128 or chr(c).isdigit() or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: Intervals that are split at a time.
WIDE = 256


def terms(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(PLAIN).split() if text else []


def weight(n_documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_documents + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_documents: int, n_terms: int) -> np.ndarray:
    long = 100 - 50 + (50 * n * n_documents) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 20 * long)


def counted(documents: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """doc_id, n, terms, tfs of each document with a term: its length, its numbered terms (packed, 32 bits) and their counts."""
    shared, width = documents.sparkSession.sparkContext.broadcast(numbers), max(1, len(numbers))

    def run(batches):
        get = shared.value.get
        for batch in slices(batches):
            lengths, found = [], []
            for text in batch.column(1).to_pylist():
                words = terms(text)
                lengths.append(len(words))
                ids = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
                found.append(ids[ids >= 0])
            rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
            key, tf = np.unique(rows * width + np.concatenate([np.empty(0, np.int64), *found]), return_counts=True)
            start = np.searchsorted(key, np.arange(len(found) + 1) * width)
            key, tf = (key % width).astype(np.int32), tf.astype(np.int32)
            held = [(k, n) for k, n in enumerate(lengths) if n]
            pack = lambda x: pa.array([x[start[k] : start[k + 1]].tobytes() for k, _ in held], pa.binary())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([k for k, _ in held], pa.int64())), pa.array([n for _, n in held], pa.int64()), pack(key), pack(tf)], ["doc_id", "n", "terms", "tfs"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL").mapInArrow(run, "doc_id long, n long, terms binary, tfs binary")


def totals(held: DataFrame, n_numbers: int) -> tuple[int, int, np.ndarray]:
    """N, L, and df by number: as many sums a task as the block has terms, and two."""

    def run(batches):
        df, n, whole = np.zeros(n_numbers, np.int64), 0, 0
        for batch in batches:
            n, whole = n + batch.num_rows, whole + sum(batch.column(0).to_pylist())
            df += np.bincount(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int32), minlength=n_numbers)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *some.tolist()], pa.int32()), pa.array([n, whole, *df[some].tolist()], pa.int64())], ["term", "n"])

    sums = {r["term"]: r["s"] for r in held.select("n", "terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("s")).collect()}
    return sums.get(-1, 0), sums.get(-2, 0), np.array([sums.get(k, 0) for k in range(n_numbers)], np.int64)


def grown(starts: list[int], priority: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """left, right (-1: none) of each node, and the root of each treap; treap t has the nodes starts[t] to starts[t + 1]."""
    left, right, roots = [-1] * len(priority), [-1] * len(priority), []
    for at, end in zip(starts, starts[1:], strict=False):
        path: list[int] = []
        for node in range(at, end):
            own, last = priority[node], -1
            while path and priority[path[-1]] < own:
                last = path.pop()
            left[node] = last
            if path:
                right[path[-1]] = node
            path.append(node)
        roots.append(path[0])
    return np.array(left, np.int32), np.array(right, np.int32), np.array(roots, np.int32)


INDEX = {"documents": np.int64, "terms": np.int32, "starts": np.int32, "roots": np.int32, "place": np.int32, "impact": np.int32, "left": np.int32, "right": np.int32}


def index(held: DataFrame, n_documents: int, n_terms: int, shard: int = 8192) -> DataFrame:
    """shard and packed arrays: documents by id, terms, and each term's treap over places of documents."""
    n_shards = max(1, -(-n_documents // shard))

    def build(key, group):
        order = np.argsort(group.column("doc_id").to_numpy(), kind="stable")
        group = group.take(pa.array(order))
        documents, n = group.column("doc_id").to_numpy(), group.column("n").to_numpy()
        packed = [np.frombuffer(x, np.int32) for x in group.column("terms").to_pylist()]
        place = np.repeat(np.arange(len(documents)), [len(x) for x in packed])
        term, tf = np.concatenate(packed), np.frombuffer(b"".join(group.column("tfs").to_pylist()), np.int32).astype(np.int64)
        order = np.lexsort((place, term))
        place, term, tf = place[order], term[order], tf[order]
        impact = impacts(tf, n[place], n_documents, n_terms)
        own, first = np.unique(term, return_index=True)
        starts = [*first.tolist(), len(term)]
        dice = (mixed(np.arange(len(documents), dtype=np.uint64)) >> np.uint64(32)).astype(np.int64)
        left, right, roots = grown(starts, (impact * (1 << 32) + dice[place]).tolist())
        arrays = {"documents": documents, "terms": own, "starts": np.array(starts), "roots": roots, "place": place, "impact": impact, "left": left, "right": right}
        return pa.table({"shard": [key[0].as_py()]} | {k: pa.array([arrays[k].astype(kind).tobytes()], pa.binary()) for k, kind in INDEX.items()})

    dealt = F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.lit(n_shards))
    return held.filter("length(terms) > 0").withColumn("shard", dealt).groupBy("shard").applyInArrow(build, "shard long, " + ", ".join(f"{k} binary" for k in INDEX))


class Best:
    """The k best documents so far: highest score first, then the smaller id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]

    def open(self, bound: np.ndarray, least_id: np.ndarray) -> np.ndarray:
        """Which intervals, of such bounds and smallest ids, may still hold one of the best."""
        if len(self.scores) < self.k:
            return bound > 0
        bar = self.scores[-1]
        return (bound > bar) | (bound == bar) & (least_id < self.ids[-1])


class Shard:
    """The treaps of a shard, and how they are walked."""

    def __init__(self, row: dict[str, bytes]):
        self.documents, self.terms, self.starts, self.roots, self.place, self.impact, self.left, self.right = (np.frombuffer(row[k], kind) for k, kind in INDEX.items())
        self.impact = self.impact.astype(np.int64)
        self.n = len(self.documents)
        self.keys = np.repeat(np.arange(len(self.terms)), np.diff(self.starts)) * self.n + self.place

    def inside(self, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """From each node down its treap, the topmost one between low and high, exclusive; -1 if there is none."""
        out = node.copy()
        at = np.flatnonzero(out >= 0)
        while len(at):
            own = out[at]
            place = self.place[own]
            below = place <= low[at]
            move = below | (place >= high[at])
            at, own, below = at[move], own[move], below[move]
            out[at] = np.where(below, self.right[own], self.left[own])
            at = at[out[at] >= 0]
        return out

    def search(self, wanted: np.ndarray, weights: np.ndarray, best: Best) -> int:
        """Adds the item's documents of this shard that are among the best; returns how many were scored."""
        at = np.searchsorted(self.terms, wanted)
        held = (at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == wanted) & (weights > 0)
        rank, weights = at[held], weights[held]
        if not len(rank):
            return 0
        nodes = self.roots[rank][None, :]
        stack, scored = [((weights * self.impact[nodes]).sum(1), np.array([-1]), np.array([self.n]), nodes)], 0
        while stack:
            bound, low, high, nodes = stack.pop()
            may = best.open(bound, self.documents[low + 1])
            if not may.any():
                continue
            low, high, nodes = low[may], high[may], nodes[may]
            rows, columns = np.nonzero(nodes >= 0)
            node = nodes[rows, columns]
            share = np.zeros(nodes.shape, np.int64)
            share[rows, columns] = weights[columns] * self.impact[node]
            split = self.place[nodes[np.arange(len(nodes)), share.argmax(1)]].astype(np.int64)
            key = rank[columns] * self.n + split[rows]
            hit = np.searchsorted(self.keys, key)
            same = self.keys[np.minimum(hit, len(self.keys) - 1)] == key
            score = np.bincount(rows[same], weights[columns[same]] * self.impact[hit[same]], len(nodes)).astype(np.int64)
            scored += len(nodes)
            best.add(score, self.documents[split])
            children = np.full((2, *nodes.shape), -1, np.int32)
            children[0, rows, columns] = self.inside(node, low[rows], split[rows])
            children[1, rows, columns] = self.inside(node, split[rows], high[rows])
            nodes = children.reshape(-1, nodes.shape[1])
            low, high = np.concatenate([low, split]), np.concatenate([split, high])
            bound = (np.where(nodes >= 0, self.impact[nodes], 0) * weights).sum(1)
            may = np.flatnonzero(best.open(bound, self.documents[np.minimum(low + 1, self.n - 1)]))
            may = may[np.argsort(-bound[may], kind="stable")]
            for start in range(0, len(may), WIDE)[::-1]:
                part = may[start : start + WIDE]
                stack.append((bound[part], low[part], high[part], nodes[part]))
        return scored


def traversed(treaps: DataFrame, items: list[tuple[int, np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """item_id, doc_id, score: the k best of each item among the shards of a task."""
    shared = treaps.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        best = [Best(k) for _ in shared.value]
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard({c: batch.column(at)[row].as_py() for at, c in enumerate(batch.schema.names)})
                for own, (_, wanted, weights) in zip(best, shared.value, strict=True):
                    shard.search(wanted, weights, own)
        for own, (item, _, _) in zip(best, shared.value, strict=True):
            if len(own.ids):
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(own.ids), pa.int64()), pa.array(own.ids), pa.array(own.scores)], ["item_id", "doc_id", "score"])

    return treaps.select(*INDEX).mapInArrow(run, "item_id long, doc_id long, score long")


def search(documents: DataFrame, items: DataFrame, k: int = 50, shard: int = 8192, item_bytes: int = 8 << 20) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k documents of the highest scores above 0."""
    spark = documents.sparkSession
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    n_blocks = -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // item_bytes)
    out = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for block in range(n_blocks):
        found: dict[int, set[bytes]] = {}
        for r in asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block).collect():
            found.setdefault(r["item_id"], set()).update(terms(r["text"]))
        numbers = {t: at for at, t in enumerate(sorted({t for own in found.values() for t in own}))}
        if not numbers:
            continue
        held = keep(counted(documents, numbers), "treap-terms")
        n_documents, n_terms, df = totals(held, len(numbers))
        if not n_documents:
            break
        weights = np.array([weight(n_documents, x) for x in df.tolist()], np.int64)
        wanted = [(item, np.array(sorted(numbers[t] for t in own), np.int32)) for item, own in sorted(found.items())]
        treaps = keep(index(held, n_documents, n_terms, shard), "treaps")
        out = out.unionByName(traversed(treaps, [(item, own, weights[own]) for item, own in wanted], k))
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


_FOUND = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
SQL = f"""WITH d AS MATERIALIZED (SELECT doc_id, w, len(w) AS size FROM (SELECT doc_id, {_FOUND} AS w FROM documents WHERE doc_id IS NOT NULL) WHERE len(w) > 0),
s AS (SELECT count(*) AS docs, CAST(sum(size) AS BIGINT) AS whole FROM d),
q AS MATERIALIZED (SELECT DISTINCT item_id, unnest({_FOUND}) AS term FROM benchmark WHERE item_id IS NOT NULL),
p AS MATERIALIZED (SELECT doc_id, size, term, count(*) AS tf FROM (SELECT doc_id, size, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
r AS (SELECT item_id, doc_id, CAST(sum(f.w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * size * docs) // whole))))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN f USING (term), s GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 50"""
