"""Centroid clustering by annulus search: exact rounds over integer vectors.

A vector can only be nearest to centroids whose norms differ from its own by no more than its distance to any centroid: the
triangle inequality. Each round sorts the centroids by norm, takes the exact distance to the one whose norm is nearest as the
vector's upper bound, finds by binary search the first and last norm within that ring, and compares the centroids between them
exactly (equal distances: the smaller number). Bounds carry a relative slack and are inclusive, so rounding only widens rings.

Components are integers, floor(scale * x); squared distances, sums and means are exact (doubles while all intermediate
values stay below 2^53, else 64-bit integers; sums as 38-digit decimals). A task adds up its own vectors by centroid, so a round's
exchange has one row a task, centroid and dimension at most, and the driver gets the k x d sums alone. Each round scans the
vectors anew: nothing is carried from round to round but the centroids, and a lost task is just run again.

Defined cases: vectors that are null, of another length or hold null or non-finite components, and rows without vec_id, take no
part; rows that repeat an id are vectors of their own (as first centroids they stand in the order of their components); fewer
vectors than centroids make fewer; a centroid without vectors stays where it is; zero vectors are vectors; other columns are
ignored; an empty table has no rows. Components of 2^27 or more after scaling raise an error: their distances need not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, load

#: Below these sizes of components squared distances are exact as doubles, as 64-bit integers.
EXACT, MOST = 1 << 22, 1 << 27


def kept(table: DataFrame, dimensions: int, scale: int) -> DataFrame:
    """vec_id, v: integer components of the vectors that take part."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter(f"vec_id IS NOT NULL AND v IS NOT NULL AND size(v) = {dimensions}")
    rows = rows.filter("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    whole = F.transform("v", lambda x: F.when(F.abs(x * scale) < MOST, F.floor(x * scale)).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("long")))
    return rows.select("vec_id", whole.alias("v"))


def first(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest hashes of their ids, in that order."""
    return np.array([r["v"] for r in rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256), "v").limit(k).select("v").collect()], np.int64)


class Rings:
    """Centroids by norm, and the search of each vector's ring."""

    def __init__(self, centroids: np.ndarray):
        norms = np.sqrt((centroids.astype(float) ** 2).sum(1))
        self.order = np.lexsort((np.arange(len(norms)), norms))
        self.norms, self.own = norms[self.order], centroids[self.order]
        self.most = int(np.abs(centroids).max(initial=0))

    def squared(self, x: np.ndarray, at: np.ndarray | int) -> np.ndarray:
        d = x - self.own[at].astype(x.dtype)
        return (d * d).sum(1).astype(np.int64)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of the nearest centroid of each row, and how many distances were taken."""
        x = x.astype(float) if max(self.most, int(np.abs(x).max(initial=0))) < EXACT else x
        norm = np.sqrt((x.astype(float) ** 2).sum(1))
        seed = np.searchsorted(self.norms, norm).clip(1, max(1, len(self.norms) - 1))
        seed = np.where(np.abs(self.norms[seed - 1] - norm) <= np.abs(self.norms[np.minimum(seed, len(self.norms) - 1)] - norm), seed - 1, np.minimum(seed, len(self.norms) - 1))
        best, number = self.squared(x, seed), self.order[seed].copy()
        slack = np.sqrt(best.astype(float)) * (1 + 1e-9) + norm * 1e-9 + 1e-6
        low, high = np.searchsorted(self.norms, norm - slack, "left"), np.searchsorted(self.norms, norm + slack, "right")
        taken = len(x)
        for at in range(int(low.min(initial=len(self.norms))), int(high.max(initial=0))):
            inside = np.flatnonzero((low <= at) & (at < high) & (seed != at))
            if not len(inside):
                continue
            taken += len(inside)
            d, own = self.squared(x[inside], at), self.order[at]
            better = (d < best[inside]) | (d == best[inside]) & (own < number[inside])
            best[inside[better]], number[inside[better]] = d[better], own
        return number, best, taken


def arrays(batches, dimensions: int, rows: int = 8192) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part.column(0), part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions)


def sums(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cluster, dimension, total, n: exact componentwise sums of the vectors nearest to each centroid."""
    d = centroids.shape[1]

    def run(batches):
        rings, total, count = Rings(centroids), [[0] * d for _ in centroids], [0] * len(centroids)
        for _, x in arrays(batches, d):
            number = rings.nearest(x)[0]
            for own in np.unique(number).tolist():
                mine = x[number == own]
                count[own] += len(mine)
                total[own] = [a + b for a, b in zip(total[own], mine.sum(0).tolist(), strict=True)]
        found = [(c, i, total[c][i], count[c]) for c in range(len(count)) if count[c] for i in range(d)]
        columns = list(zip(*found, strict=True)) if found else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(list(map(str, columns[2])), pa.string()), pa.array(columns[3], pa.int64())], ["cluster", "dimension", "total", "n"])

    parts = rows.select("vec_id", "v").mapInArrow(run, "cluster int, dimension int, total string, n long")
    return parts.groupBy("cluster", "dimension").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance."""

    def run(batches):
        rings = Rings(centroids)
        for ids, x in arrays(batches, centroids.shape[1]):
            number, squared, _ = rings.nearest(x)
            yield pa.RecordBatch.from_arrays([ids, pa.array(number, pa.int32()), pa.array(squared, pa.int64())], ["vec_id", "cluster", "distance"])

    return rows.select("vec_id", "v").mapInArrow(run, "vec_id long, cluster int, distance long")


def centroids_of(rows: DataFrame, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centroids after so many rounds: each the floor of its vectors' mean. At most k x d numbers reach the driver a round."""
    own = first(rows, k, seed)
    for _ in range(rounds if len(own) else 0):
        fresh = own.copy()
        for r in sums(rows, own).collect():
            fresh[r["cluster"], r["dimension"]] = int(r["total"]) // r["n"]
        own = fresh
    return own


def cluster(table: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dimensions: int = 64, scale: int = 256) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row a vector."""
    rows = kept(table, dimensions, scale)
    own = centroids_of(rows, k, rounds, seed)
    spark = table.sparkSession
    if not len(own):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    found = keep(assigned(rows, own), "annulus-clusters")
    held = found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()
    whole = sum(r["s"] for r in held)
    facts = [(r["cluster"], r["s"], whole, hashlib.sha256(",".join(map(str, own[r["cluster"]].tolist())).encode()).hexdigest()) for r in held]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def query(spark, sf_dir: str) -> DataFrame:
    return cluster(load(spark, sf_dir, "embeddings"))


def oracle(k: int = 40, rounds: int = 5, seed: int = 2, dimensions: int = 64, scale: int = 256) -> str:
    """The same rows in SQL, by comparing every vector with every centroid."""
    ctes = [
        f"kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "parts AS MATERIALIZED (SELECT vec_id, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM kept)",
        f"c0 AS MATERIALIZED (SELECT r - 1 AS c, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM (SELECT v, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) AS r FROM kept) WHERE r <= {k})",
    ]
    for n in range(rounds + 1):
        ctes.append(f"a{n} AS MATERIALIZED (SELECT vec_id, c, d FROM (SELECT vec_id, c, d, row_number() OVER (PARTITION BY vec_id ORDER BY d, c) AS r FROM (SELECT p.vec_id, q.c, CAST(sum((p.x - q.x) * (p.x - q.x)) AS BIGINT) AS d FROM parts p JOIN c{n} q ON p.i = q.i GROUP BY 1, 2)) WHERE r = 1)")
        if n < rounds:
            mean = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
            ctes.append(f"c{n + 1} AS MATERIALIZED (SELECT o.c, o.i, coalesce({mean}, o.x) AS x FROM c{n} o LEFT JOIN (SELECT a.c, p.i, sum(p.x) AS s, count(*) AS n FROM a{n} a JOIN parts p ON a.vec_id = p.vec_id GROUP BY 1, 2) f ON o.c = f.c AND o.i = f.i)")
    last = rounds
    return f"WITH {', '.join(ctes)}, h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{last} GROUP BY c) SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, h.centroid_sha256 FROM a{last} a JOIN h ON a.c = h.c"
