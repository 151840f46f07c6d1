"""Feature files of an annotated text: a head of @ lines, a blank line, then one value a line for a node or a range of nodes.

A line is ``value`` (for the node after the line before it), ``node<TAB>value`` or ``first-last<TAB>value``. Files are read in blocks by many tasks
although a line without a number leans on the lines before it: each block says how far its own lines carry the count and where they
last name a node, and the blocks' statements, one row a block, are added up in order. Ranges stay ranges until a node asks for its value.

Defined cases: a file without a head or a blank line, or with a line whose number is none, raises an error that names it; a node with values
from several lines keeps the line that names it alone before ranges, then the first; a value may be empty; carriage returns at line ends go.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Nodes of a range are looked up by steps of this many.
STEP = 1024


def _lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Lines with their place (file, block, order within it), and each file's place of the first blank line with its first line."""
    raw = spark.read.option("lineSep", "\n").text(path).select(F.regexp_replace("value", "\r$", "").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    place = F.struct("block", "at")
    return raw, raw.groupBy("file").agg(F.min(F.when(F.col("line") == "", place)).alias("ends"), F.min_by("line", place).alias("first"))


def _name(file: str) -> Column:
    return F.regexp_extract(file, r"([^/]+?)(?:\.tf)?$", 1)


def head(spark: SparkSession, path: str) -> DataFrame:
    """file, key, value: the head's lines; the kind of the file (node, edge, config) under the key ``kind``, edgeValues with a null value."""
    raw, ends = _lines(spark, path)
    mine = raw.join(ends, "file").filter(F.col("ends").isNull() | (F.struct("block", "at") < F.col("ends")))
    kind = F.col("line").isin("@node", "@edge", "@config")
    bad = F.col("ends").isNull() | ~F.col("first").isin("@node", "@edge", "@config") | ~(kind | (F.col("line") == "@edgeValues") | F.col("line").rlike(r"^@[^=]*="))
    line = F.when(bad, F.raise_error(F.concat(F.lit("no valid head: "), "file", F.lit(": "), "line"))).otherwise(F.col("line"))
    mine = mine.select(_name("file").alias("file"), line.alias("line"))
    key, value = F.trim(F.regexp_extract("line", r"^@([^=]*)=", 1)), F.trim(F.regexp_extract("line", r"^@[^=]*=(.*)$", 1))
    return mine.select("file", F.when(F.col("line").rlike("="), key).when(F.col("line") == "@edgeValues", "edgeValues").otherwise("kind").alias("key"), F.when(F.col("line").rlike("="), value).when(F.col("line") != "@edgeValues", F.substring("line", 2, 10)).alias("value"))


def features(spark: SparkSession, path: str) -> DataFrame:
    """file, first, last, single, value of every line: range-coded values by node, whatever block of the file a line lies in."""
    raw, ends = _lines(spark, path)
    rows = raw.join(ends, "file")
    bad = F.col("ends").isNull() | ~F.col("first").isin("@node", "@edge", "@config")
    rows = rows.filter(bad | (F.struct("block", "at") > F.col("ends")))
    spec, tab = F.substring_index("line", "\t", 1), F.instr("line", "\t") > 0
    low, high = F.regexp_extract(spec, r"^(-?\d{1,18})(?:-\d{1,18})?$", 1).try_cast("long"), F.regexp_extract(spec, r"^-?\d{1,18}-(\d{1,18})$", 1).try_cast("long")
    wrong = bad | (tab & (low.isNull() | (high < low)))
    low = F.when(wrong, F.raise_error(F.concat(F.lit("no valid line: "), "file", F.lit(": "), "line")).cast("long")).when(tab, low)
    value = F.when(tab, F.expr("substring(line, instr(line, '\t') + 1)")).otherwise(F.col("line"))
    rows = rows.select("file", "block", "at", low.alias("low"), F.when(tab, F.coalesce(high, low)).alias("high"), (tab & high.isNull() | ~tab).alias("single"), value.alias("value"))
    # within a block: the last node named and the lines since; a block that names none only carries the count on
    own = Window.partitionBy("file", "block").orderBy("at")
    rows = rows.withColumn("n", F.row_number().over(own)).withColumn("named", F.last(F.when(F.col("high").isNotNull(), F.struct("high", "n")), ignorenulls=True).over(own))
    state = rows.groupBy("file", "block").agg(F.max("n").alias("lines"), F.max_by("named", "n").alias("named"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.coalesce(F.sum("lines").over(before), F.lit(0))
    state = state.withColumn("upto", upto)
    reached = F.last(F.when(F.col("named").isNotNull(), F.col("named.high") - (F.col("upto") + F.col("named.n"))), ignorenulls=True).over(before)
    carry = state.select("file", "block", (F.coalesce(reached, F.lit(0)) + F.col("upto")).alias("carry"))
    node = F.coalesce(F.col("low"), F.when(F.col("named").isNotNull(), F.col("named.high") + F.col("n") - F.col("named.n")).otherwise(F.col("carry") + F.col("n")))
    rows = rows.join(carry, ["file", "block"])
    return rows.select(_name("file").alias("file"), node.alias("first"), F.coalesce("high", node).alias("last"), "single", "value", F.struct("block", "at").alias("place"))


def valued(nodes: DataFrame, coded: DataFrame, node: str = "node") -> DataFrame:
    """nodes with the value of each: a line for the node alone before ranges, then the first line; null where no line has it."""
    cut = lambda c: F.floor(F.col(c) / STEP)
    steps = coded.select(F.explode(F.sequence(cut("first"), cut("last"))).alias("_step"), "first", "last", F.struct((~F.col("single")).alias("wide"), "place").alias("_rank"), F.col("value").alias("_value"))
    asked = nodes.select(F.col(node).alias("_node")).distinct().withColumn("_step", cut("_node"))
    found = asked.join(steps, "_step").filter("_node BETWEEN first AND last").groupBy("_node").agg(F.min_by("_value", "_rank").alias("value"))
    return nodes.join(found, F.col(node) == F.col("_node"), "left").drop("_node")


def runs(value: Column) -> Column:
    """A set of slots such as ``1-3,7`` as sorted runs (first, last) that neither meet nor overlap; null where a part is no range."""
    part = F.transform(F.split(value, ","), lambda x: F.split(F.trim(x), "-"))
    pairs = F.transform(part, lambda x: F.struct(F.get(x, F.lit(0)).try_cast("long").alias("first"), F.get(x, F.size(x) - 1).try_cast("long").alias("last")))
    fits = F.forall(part, lambda x: F.size(x) <= 2) & F.forall(pairs, lambda x: F.coalesce(x["first"] <= x["last"], F.lit(False)))
    return F.when(fits, merged(pairs))


def merged(pairs: Column) -> Column:
    """Runs (first, last) sorted, those that meet or overlap joined."""
    empty = F.array().cast("array<struct<first:bigint,last:bigint>>")

    def add(done, x):
        end = F.get(done, F.size(done) - 1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(end["first"].alias("first"), F.greatest(end["last"], x["last"]).alias("last"))))
        return F.when((F.size(done) > 0) & (x["first"] <= end["last"] + 1), joined).otherwise(F.concat(done, F.array(F.struct(x["first"].cast("long").alias("first"), x["last"].cast("long").alias("last")))))

    return F.aggregate(F.sort_array(pairs), empty, add)


def write_features(df: DataFrame, path: str, **about: str) -> None:
    """Files of node features: df has node (once each) and value (without line breaks; a null one is left out); ranges of nodes, one file a task.

    Equal values of nodes in a row become a range, a value for the very next node goes without its number.
    """

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, before, out = None, None, ["@node", *[f"@{k}={v}" for k, v in about.items()], "@valueType=str", ""]

        def said(first, last, value):
            if first < last:
                return f"{first}-{last}\t{value}"
            return value if before == first - 1 and "\t" not in value else f"{first}\t{value}"

        for batch in batches:
            for node, value in zip(batch["node"], batch["value"]):
                if now and now[1] == node - 1 and now[2] == value:
                    now = (now[0], node, value)
                    continue
                if now:
                    out.append(said(*now))
                    before = now[1]
                now = (node, node, value)
            yield pd.DataFrame({"value": out})
            out = []
        yield pd.DataFrame({"value": out + ([said(*now)] if now else [])})

    rows = df.filter("value IS NOT NULL").select(F.col("node").cast("long").alias("node"), "value")
    rows.repartitionByRange("node").sortWithinPartitions("node").mapInPandas(lines, "value string").write.text(path)
