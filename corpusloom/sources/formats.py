"""Typed tables in foreign text formats: schema checks, inference, conversion, export with checksums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import copy

#: Patterns of the inferred types in their order of precedence (fixed values).
PATTERNS = {"wordkey": r"^\d+\.\d+[a-z]?:\d+[a-z]?\.\d+$", "versekey": r"^\d+\.\d+[a-z]?:\d+[a-z]?$", "integer": r"^(0|-?[1-9]\d{0,17})$", "boolean": r"^[tf]$", "json": r"^[\[{].*[\]}]$"}


def infer(df: DataFrame) -> DataFrame:
    """column, type of string columns over all rows: the first type that every value fits; a column without values is text. One scan."""
    checks = [F.min(F.col(f"`{c}`").rlike(p).cast("int")).alias(f"{k}_{name}") for k, c in enumerate(df.columns) for name, p in PATTERNS.items()]

    def kind(k: int):
        out = F.lit("text")
        for name in reversed(PATTERNS):
            out = F.when(F.col(f"{k}_{name}") == 1, name).otherwise(out)
        return out

    one = df.agg(*checks).select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), kind(k).alias("type")) for k, c in enumerate(df.columns)])).alias("x"))
    return one.select("x.column", "x.type")


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """String columns as the types that ``infer`` names; keys and JSON stay strings."""
    cast = {"integer": lambda c: c.cast("long"), "boolean": lambda c: c == "t"}
    return df.select(*[cast.get(types.get(c, "text"), lambda x: x)(F.col(f"`{c}`")).alias(c) for c in df.columns])


def view(df: DataFrame, columns: list[str] | None = None, where: str | None = None, order: list[str] | None = None, head: int | None = None) -> DataFrame:
    """Some columns of the first rows that fit a condition."""
    out = df.filter(where) if where else df
    out = out.orderBy(*order) if order else out
    out = out.limit(head) if head is not None else out
    return out.select(*columns) if columns else out


def stats(df: DataFrame) -> DataFrame:
    """column, rows, nulls, values (distinct), least, greatest of each column, as text; one scan and one exchange."""
    facts = [F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"), F.count_if(F.col(f"`{c}`").isNull()).alias("nulls"), F.countDistinct(f"`{c}`").alias("values"), F.min(f"`{c}`").cast("string").alias("least"), F.max(f"`{c}`").cast("string").alias("greatest")) for c in df.columns]
    return df.agg(F.array(*facts).alias("f")).select(F.explode("f").alias("x")).select("x.*")


def write_sorted(df: DataFrame, path: str, key: list[str], files: int) -> None:
    """Parquet in ranges of a key, sorted, so that a look-up by key reads few row groups."""
    df.repartitionByRange(files, *key).sortWithinPartitions(*key).write.parquet(path)


def lookup(spark: SparkSession, path: str, **key) -> DataFrame:
    """The rows of one key; the conditions reach the row groups' statistics."""
    out = spark.read.parquet(path)
    for name, value in key.items():
        out = out.filter(F.col(name) == F.lit(value))
    return out


def validate(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """rule, found: rows that break each rule, conditions that must hold; one scan. A condition that is unknown counts as broken."""
    found = [F.struct(F.lit(name).alias("rule"), F.count_if(~F.coalesce(F.expr(rule), F.lit(False))).alias("found")) for name, rule in rules.items()]
    return df.agg(F.array(*found).alias("f")).select(F.explode("f").alias("x")).select("x.*")


def check_schema(df: DataFrame, expected: T.StructType) -> list[str]:
    """Problems: columns must agree by name, order and type; trailing nullable ones may be missing."""
    pairs = list(enumerate(zip(df.schema, expected, strict=False)))
    problems = [f"column {k}: {a.name}, expected {b.name}" for k, (a, b) in pairs if a.name != b.name]
    problems += [f"column {k}: {a.name} is {a.dataType.simpleString()}, expected {b.dataType.simpleString()}" for k, (a, b) in pairs if a.name == b.name and a.dataType != b.dataType]
    problems += [f"missing {f.name}" for f in expected[len(df.columns) :] if not f.nullable]
    return problems + [f"unknown {c}" for c in df.columns[len(expected) :]]


def read_any(spark: SparkSession, path: str, kind: str, schema: T.StructType | str | None = None, row_tag: str = "row") -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "tsv":
        names = schema or ", ".join(f"`{c}` string" for c in copy.columns_of(spark, path))
        return copy.read_copy(spark, path, names if isinstance(names, str) else names.toDDL())
    if kind == "csv":
        return reader.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if kind == "jsonl":
        return reader.json(path)
    if kind == "xml":
        return reader.option("rowTag", row_tag).xml(path)
    if kind == "parquet":
        return reader.parquet(path)
    raise ValueError(f"unknown format {kind}")


def write_any(df: DataFrame, path: str, kind: str, row_tag: str = "row") -> None:
    if kind == "tsv":
        copy.write_copy(df, path)
    elif kind == "csv":
        df.write.option("header", True).option("escape", '"').csv(path)
    elif kind == "jsonl":
        df.write.json(path)
    elif kind == "xml":
        df.write.option("rowTag", row_tag).xml(path)
    elif kind == "parquet":
        df.write.parquet(path)
    else:
        raise ValueError(f"unknown format {kind}")


def convert(spark: SparkSession, source: str, from_kind: str, target: str, to_kind: str, schema=None, inferred: bool = False) -> None:
    """Writes a file in another format: by a schema, or with ``inferred`` by the types that all values of its text columns fit."""
    df = read_any(spark, source, from_kind, schema)
    if inferred and schema is None:
        texts = [f.name for f in df.schema if f.dataType == T.StringType()]
        df = typed(df, {r["column"]: r["type"] for r in infer(df.select(*texts)).collect()}) if texts else df  # a row for each column
    write_any(df, target, to_kind)


def manifest(df: DataFrame, by: str) -> DataFrame:
    """by, rows and an order-free checksum of each part of an export: 60 bits of each row's MD5, fields joined by 0x1F and null as 0x00."""
    fields = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in df.columns if c != by]
    row = F.conv(F.substring(F.md5(F.concat_ws("\x1f", *fields)), 1, 15), 16, 10).cast("long")
    return df.groupBy(by).agg(F.count("*").alias("rows"), F.bit_xor(row).alias("checksum"))
