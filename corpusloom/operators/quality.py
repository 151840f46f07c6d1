"""Comparison of two states of a table."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keyed_comparison(before: DataFrame, after: DataFrame, beside: tuple[str, ...] = ()) -> DataFrame:
    """key, value, id on both sides -> key, outcome, old, new: equal values match off first (id-only where ids differ), the rest pairs in order.

    Nulls are values like any other. ``beside``: further columns, which stand as <name>_old and <name>_new, as do the ids.
    """
    own, more = ["key", "value", "id", *beside], ["id", *beside]
    # both states are dealt by key once; rows meet by windows and groups within it. The number is stated, so that parts are not put together: each holds several sorts
    parts = int(before.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = before.select(*own, F.lit(True).alias("_was")).unionByName(after.select(*own, F.lit(False).alias("_was"))).repartition(parts, "key")
    turned = both.withColumn("_n", F.row_number().over(Window.partitionBy("key", "value", "_was").orderBy(*more)))
    sided = lambda c, was: F.max(F.when(F.col("_was") == was, F.col(c)))
    held = [F.bool_or("_was").alias("_a"), F.bool_or(~F.col("_was")).alias("_b")]
    met = turned.groupBy("key", "value", "_n").agg(*held, *[sided(c, was).alias(f"{c}_{name}") for c in more for was, name in ((True, "old"), (False, "new"))])
    beyond = [f"{c}_{name}" for c in more for name in ("old", "new")]
    same = met.filter("_a AND _b AND NOT id_old <=> id_new").select("key", F.lit("id-only").alias("outcome"), F.col("value").alias("old"), F.col("value").alias("new"), *beyond)
    rest = met.filter("_a <> _b").withColumn("_m", F.row_number().over(Window.partitionBy("key", "_a").orderBy("value", "_n")))
    rest = rest.groupBy("key", "_m").agg(F.bool_or("_a").alias("_was"), F.bool_or("_b").alias("_is"), F.max(F.when(F.col("_a"), F.col("value"))).alias("old"), F.max(F.when(F.col("_b"), F.col("value"))).alias("new"), *[F.max(c).alias(c) for c in beyond])
    outcome = F.when(~F.col("_is"), "only-before").when(~F.col("_was"), "only-after").otherwise("changed")
    found = same.unionByName(rest.select("key", outcome.alias("outcome"), "old", "new", *beyond))
    return found if beside else found.select("key", "outcome", "old", "new")


def difference_groups(before: DataFrame, after: DataFrame, examples: int = 12) -> DataFrame:
    """scope, group, outcome, rows, examples of differences of rows (scope, group, key, value, id).

    A row that changed its group stands under both (one -> other). Examples are the first by their text; parts compared apart
    and gathered give the same as the whole, as long as a key's rows stay together.
    """
    whole = lambda df: df.select(F.struct("scope", "key").alias("key"), F.col("value").cast("string").alias("value"), "id", "group")
    found = keyed_comparison(whole(before), whole(after), ("group",))
    either, text = F.coalesce("group_old", "group_new"), lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    group = F.when((F.col("outcome") == "changed") & ~F.col("group_old").eqNullSafe(F.col("group_new")), F.concat(text("group_old"), F.lit(" -> "), text("group_new"))).otherwise(either)
    key = F.coalesce(F.col("key.key").cast("string"), F.lit(""))
    said = F.when(F.col("outcome") == "changed", F.concat(key, F.lit("  "), text("old"), F.lit("  =>  "), text("new")))
    said = said.when(F.col("outcome") == "id-only", F.concat(key, F.lit("  "), text("id_old"), F.lit(" -> "), text("id_new"))).otherwise(F.concat(key, F.lit("  "), F.coalesce("old", "new", F.lit(""))))
    rows = found.select(F.col("key.scope").alias("scope"), group.alias("group"), "outcome", said.alias("said"))
    by = ["scope", "group", "outcome"]
    counts = rows.groupBy(*by).agg(F.count("*").alias("rows"))
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("said"))).filter(F.col("_r") <= examples)  # cut before the exchange
    few = first.groupBy(*by).agg(F.array_join(F.sort_array(F.collect_list("said")), "\n").alias("examples"))
    a, b = counts.alias("a"), few.alias("b")
    return a.join(b, reduce(and_, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by])).select("a.scope", "a.group", "a.outcome", "a.rows", "b.examples")


def row_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows only in one state, by a hash of the whole row, as a multiset: one exchange of hashes, counted before it with a sign."""
    def mark(df: DataFrame, sign: int) -> DataFrame:
        row = F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in df.columns]))
        return df.select(row.alias("row_hash"), F.lit(sign).alias("sign"))

    left = mark(before, 1).unionByName(mark(after, -1)).groupBy("row_hash").agg(F.sum("sign").alias("n")).filter("n <> 0")
    side = F.when(F.col("n") > 0, "before").otherwise("after").alias("side")
    return left.select("row_hash", side, F.explode(F.sequence(F.lit(1).cast("long"), F.abs("n"))).alias("_k")).select("row_hash", "side")
