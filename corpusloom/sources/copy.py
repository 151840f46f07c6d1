"""Tables as COPY text with a head: comment lines that begin with #, the column names, then a line for each row.

Only lines before the column names are comments; a row may begin with # as well. A file's head stands in its first block, so the
task that reads this block tells it from the rows, and all other blocks hold rows alone: files are read in parallel. A head may
state the number of its file's rows (``# rows 12``).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW, NAMES, COMMENT = 0, 1, 2
#: Characters that have an escape of their own (fixed values).
ESCAPES = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\x0b": "\\v", "\f": "\\f", "\r": "\\r"}


def escaped(value: Column) -> Column:
    """A field of COPY text: null as \\\\N; backslash, tab, line feed and carriage return escaped."""
    out = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    for plain in "\t\n\r":
        out = F.replace(out, F.lit(plain), F.lit(ESCAPES[plain]))
    return F.coalesce(out, F.lit("\\N"))


def unescaped(field: Column) -> Column:
    """The value of a field of COPY text; an unknown escape is the character itself.

    From the left, two backslashes are always one escape: the pieces between such pairs hold the other escapes.
    """

    def piece(p: Column) -> Column:
        for plain, mark in ESCAPES.items():
            p = F.replace(p, F.lit(mark), F.lit(plain))
        return F.regexp_replace(p, r"(?s)\\(.)", "$1")

    return F.when(field != "\\N", F.array_join(F.transform(F.split(field, r"\\\\"), piece), "\\"))


def lines(spark: SparkSession, path: str, names: list[str] | None = None, least: int = 0) -> DataFrame:
    """file, kind (ROW, NAMES or COMMENT), value of each line. With ``names`` a file must have these columns, the first ``least`` at any rate."""
    text = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")

    def check(file: str, line: str) -> None:
        own = line.split("\t")
        if names is not None and (own != names[: len(own)] or len(own) < least):
            raise ValueError(f"{file}: columns {own}, expected {names}")

    def run(batches):
        now, head = None, False
        for batch in batches:
            files, starts, kinds = batch.column(0).to_pylist(), batch.column(1).to_pylist(), np.zeros(batch.num_rows, np.int8)
            at = 0
            while at < batch.num_rows:
                if (files[at], starts[at]) != now:
                    now, head = (files[at], starts[at]), starts[at] == 0
                if head:
                    value = batch.column(2)[at].as_py()
                    kinds[at] = COMMENT if value.startswith("#") else NAMES
                    if kinds[at] == NAMES:
                        head = False
                        check(files[at], value)
                at += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds), batch.column(2)], ["file", "kind", "value"])

    return text.mapInArrow(run, "file string, kind byte, value string")


def miscounted(spark: SparkSession, path: str) -> DataFrame:
    """file, stated, found of the files whose head states another number of rows than they hold; one without names states none."""
    stated = F.when(F.col("kind") == COMMENT, F.regexp_extract("value", r"^#\s*rows:?\s+(\d+)\s*$", 1))
    facts = lines(spark, path).groupBy("file").agg(F.max(F.nullif(stated, F.lit("")).cast("long")).alias("stated"), F.count_if(F.col("kind") == ROW).alias("found"))
    return facts.filter("stated <> found")


def read_copy(spark: SparkSession, path: str, schema: str, check_rows: bool = False) -> DataFrame:
    """Rows of COPY text by a schema. Columns behind the last NOT NULL one may be missing; any other difference is an error, as is a
    line with another number of fields, and with ``check_rows`` a file that holds more or fewer rows than its head states."""
    fields = spark.createDataFrame([], schema).schema
    least = max([0, *(k + 1 for k, f in enumerate(fields) if not f.nullable)]) or len(fields)
    if check_rows and (wrong := miscounted(spark, path).limit(5).collect()):
        raise ValueError("; ".join(f"{r['file']}: the head says {r['stated']} rows and the file holds {r['found']}" for r in wrong))
    rows = lines(spark, path, fields.names, least).filter(F.col("kind") == ROW).select("file", F.split("value", "\t").alias("f"))
    size = F.size("f")
    told = F.concat(F.col("file"), F.lit(": "), size.cast("string"), F.lit(f" fields where {len(fields)} columns are declared"))
    rows = rows.select(F.when(size.between(least, len(fields)), F.col("f")).otherwise(F.raise_error(told).cast("array<string>")).alias("f"))
    typed = lambda c, f: c == "t" if f.dataType.simpleString() == "boolean" else c.cast(f.dataType)
    return rows.select(*[typed(unescaped(F.get("f", F.lit(k))), f).alias(f.name) for k, f in enumerate(fields)])


def columns_of(spark: SparkSession, path: str) -> list[str]:
    """The columns that the first file names."""
    return lines(spark, path).filter(F.col("kind") == NAMES).first()["value"].split("\t")


def write_copy(df: DataFrame, path: str, comments: dict[str, str] | None = None) -> None:
    """COPY text; every file has the head: comments (on one line each) and the column names. Booleans are t and f."""
    head = [f"# {k} {re.sub(r'[\r\n]+', ' ', v)}" for k, v in (comments or {}).items()] + ["\t".join(df.columns)]
    text = lambda f: F.when(F.col(f"`{f.name}`"), "t").otherwise(F.when(F.col(f"`{f.name}`").isNotNull(), "f")) if f.dataType.simpleString() == "boolean" else F.col(f"`{f.name}`").cast("string")

    def run(batches):
        yield pa.RecordBatch.from_arrays([pa.array(head, pa.string())], ["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["value"])

    df.select(F.concat_ws("\t", *[escaped(text(f)) for f in df.schema.fields]).alias("value")).mapInArrow(run, "value string").write.option("lineSep", "\n").text(path)
