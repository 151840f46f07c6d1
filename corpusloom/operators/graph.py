"""Components and closures of edge tables; lineage is cut in the shared folder, and tables that nothing reads any more go."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop, kept, scratch

#: Edges that one task contracts.
EDGES = 500_000
#: Rounds of a closure that go up by one edge.
LEVELS = 24


def least_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n vertices the smallest one that the edges a, b join it to: hooking to smaller roots, and jumping to the root."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root != (following := root[root])).any():
            root = following


def contracted(edges: DataFrame, parts: int) -> DataFrame:
    """u, v: for each vertex that a task's edges hold, the smallest one that they join it to. No vertex is lost, none joined anew."""
    kind = edges.schema["u"].dataType.simpleString()

    def run(batches):
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        both = pa.chunked_array(table.column("u").chunks + table.column("v").chunks).combine_chunks().dictionary_encode()
        order = pc.sort_indices(both.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        ends = rank[both.indices.to_numpy()]
        names = both.dictionary.take(pa.array(order))
        root = least_of(ends[: table.num_rows], ends[table.num_rows :], len(order))
        keep = np.flatnonzero(root != np.arange(len(root)))
        for at in range(0, len(keep), 50_000):
            i = keep[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(i)), names.take(pa.array(root[i]))], ["u", "v"])

    return edges.repartition(parts).mapInArrow(run, f"u {kind}, v {kind}")


def plainly(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def components(edges: DataFrame, a: str = "a", b: str = "b", write=plainly) -> DataFrame:
    """vertex, component: each vertex of an edge with the smallest vertex it reaches; ``write(df, path)`` keeps a round's table.

    Tasks first contract their shares of at most EDGES edges each; the only share of a small graph is its answer. Then a
    large star links a vertex's larger neighbours to its smallest one, a small star its smaller neighbours;
    together they need a number of rounds that grows with the logarithm of the longest path. Pairs whose ends are
    equal and null ends are ignored; no edges, no rows.
    """
    spark = edges.sparkSession
    first = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v")
    schema = "u {0}, v {0}".format(edges.schema[a].dataType.simpleString())
    parts = max(1, -(-first.count() // EDGES))
    path, signature = scratch(spark, "stars"), None
    write(contracted(first, parts), path)
    now = spark.read.schema(schema).parquet(path)
    while parts > 1:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        following = scratch(spark, "stars")
        write(small, following)
        drop(spark, path)
        path = following
        now = spark.read.schema(schema).parquet(path)
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if signature == tuple(seen):
            break
        signature = tuple(seen)
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())


def closure(edges: DataFrame, levels: int = LEVELS) -> DataFrame:
    """child, ancestor, depth (the least) of child -> parent edges.

    The first ``levels`` rounds go up by one edge, from the pairs of the round before alone, so their work grows with the pairs there are and
    not with the ways to halve them. Where paths are longer, each further round joins the paths known so far to one another, so their
    length doubles: a chain of n takes log n of these. It ends when a round adds no pair and shortens none, so cycles end too.
    """
    spark = edges.sparkSession
    direct = kept(edges.select("child", F.col("parent").alias("ancestor")).filter("child IS NOT NULL AND parent IS NOT NULL").distinct(), "closure-edges")
    up, level, steps = direct.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("_to")), direct, []
    for depth in range(1, levels + 1):
        steps.append(level.withColumn("depth", F.lit(depth).cast("long")))
        level = kept(level.join(up, "ancestor").select("child", F.col("_to").alias("ancestor")).distinct(), "closure-level")
        if level.isEmpty():
            break
    now = reduce(DataFrame.unionByName, steps).groupBy("child", "ancestor").agg(F.min("depth").alias("depth"))
    if level.isEmpty():
        return now
    path, before = None, None
    while True:
        following = scratch(spark, "closure")
        now.write.parquet(following)
        if path:
            drop(spark, path)
        path = following
        held = spark.read.schema(now.schema).parquet(path)
        seen = tuple(held.agg(F.count("*"), F.sum("depth")).first())
        if seen == before:
            return held
        before = seen
        onward = held.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("_to"), F.col("depth").alias("_more"))
        longer = held.join(onward, "ancestor").select("child", F.col("_to").alias("ancestor"), (F.col("depth") + F.col("_more")).alias("depth"))
        now = held.unionByName(longer).groupBy("child", "ancestor").agg(F.min("depth").alias("depth"))
