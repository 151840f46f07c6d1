"""Incremental building: products in the order of their inputs, what has moved, release differences, licences of layers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Undeclared(KeyError):
    """A product read an input that it does not declare."""


class Graph:
    """Products with their declared inputs and how each is made from them."""

    def __init__(self):
        self.inputs: dict[str, list[str]] = {}
        self.make: dict[str, Callable] = {}

    def product(self, name: str, inputs: list[str], make: Callable) -> None:
        self.inputs[name], self.make[name] = list(inputs), make

    def order(self) -> list[str]:
        """Products behind all their inputs, by name among those that are ready at once; a cycle is an error."""
        left, out = {k: {i for i in v if i in self.inputs} for k, v in self.inputs.items()}, []
        while left:
            ready = sorted(k for k, v in left.items() if not v)
            if not ready:
                raise ValueError(f"products need one another: {sorted(left)}")
            out += ready
            left = {k: v - set(ready) for k, v in left.items() if k not in ready}
        return out

    def moved(self, changed: set[str]) -> list[str]:
        """The products to make again when these inputs have changed, in order."""
        dirty = set(changed)
        return [k for k in self.order() if dirty.intersection(self.inputs[k]) and not dirty.add(k)]

    def build(self, sources: dict[str, DataFrame], only: list[str] | None = None, kept: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
        """Products by name; those not in ``only`` are taken as they were kept."""
        made = dict(sources) | dict(kept or {})
        for name in self.order():
            if only is None or name in only:
                allowed = set(self.inputs[name])

                def read(wanted: str, name=name, allowed=allowed) -> DataFrame:
                    if wanted not in allowed:
                        raise Undeclared(f"{name} reads {wanted}, which it does not declare")
                    return made[wanted]

                made[name] = self.make[name](read)
        return {k: v for k, v in made.items() if k in self.inputs}


def digest(df: DataFrame, by: list[str]) -> DataFrame:
    """by, rows and an order-free digest of each part: counts and sums of row hashes, so equal rows count as often as they occur."""
    row = F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in sorted(df.columns)])
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.sum(row.cast("decimal(38,0)")).cast("string").alias("digest"))


def same_part(a: DataFrame, b: DataFrame, left: list[str], right: list[str]) -> Column:
    """Whether two rows are of one part; a null in the key is a part's key like any other."""
    return reduce(and_, [a[x].eqNullSafe(b[y]) for x, y in zip(left, right, strict=True)])


def parts_moved(manifest: DataFrame, now: DataFrame, by: list[str]) -> DataFrame:
    """by, state of parts against the manifest of the last build: new, gone, moved; parts that are the same are left out."""
    a, b = (df.select(*[F.col(c).alias(f"{side}{k}") for k, c in enumerate(by)], F.col("digest").alias(name)) for df, side, name in ((manifest, "_a", "_old"), (now, "_b", "_new")))
    both = a.join(b, same_part(a, b, [f"_a{k}" for k in range(len(by))], [f"_b{k}" for k in range(len(by))]), "full")
    both = both.select(*[F.coalesce(f"_a{k}", f"_b{k}").alias(c) for k, c in enumerate(by)], "_old", "_new")
    state = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "gone").when(F.col("_old") != F.col("_new"), "moved")
    return both.withColumn("state", state).filter("state IS NOT NULL").select(*by, "state")


def apply_moved(standing: DataFrame, built: DataFrame, moved: DataFrame, by: list[str]) -> DataFrame:
    """The standing table with the parts that moved taken from the built one; what did not move is not read from it."""
    names = [f"_p{k}" for k in range(len(by))]
    parts = moved.select(*[F.col(c).alias(x) for c, x in zip(by, names, strict=True)], "state")
    kept = standing.join(parts, same_part(standing, parts, by, names), "left_anti")
    fresh = parts.filter("state <> 'gone'")
    return kept.unionByName(built.join(fresh, same_part(built, fresh, by, names), "left_semi"))


#: A table is filled anew from so many rows and so great a share of changed rows on; a release is refused beyond a share of the whole (fixed values).
REFILL_ROWS, REFILL_SHARE, REFUSE_SHARE = 100_000, 0.25, 0.50


def release_plan(changes: DataFrame) -> DataFrame:
    """changes (table, rows, removed, added, bytes, dump_bytes) with plan: refuse, refill, apply or nothing."""
    churn = F.col("removed") + F.col("added")
    plan = F.when(churn == 0, "nothing").when(F.col("bytes") > REFUSE_SHARE * F.col("dump_bytes"), "refuse").when((F.col("rows") >= REFILL_ROWS) & (churn >= REFILL_SHARE * F.col("rows")), "refill").otherwise("apply")
    return changes.withColumn("plan", plan)


def layer_licences(layers: DataFrame, sources: DataFrame) -> DataFrame:
    """layer, licences (by name), free: whether every source of a layer may be passed on. layers: layer, source; sources: source, licence, free."""
    joined = layers.join(sources, "source", "left")
    return joined.groupBy("layer").agg(F.array_join(F.sort_array(F.collect_set("licence")), ", ").alias("licences"), F.bool_and(F.coalesce(F.col("free"), F.lit(False))).alias("free"))
