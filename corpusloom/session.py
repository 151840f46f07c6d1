"""Access to the tables of a data folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: What identifies a line item; nothing less does.
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def tables(spark: SparkSession, sf_dir: str) -> Callable[[str], DataFrame]:
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder all executors share: spark.checkpoint.dir, or our own where it is unset, as in tests."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or "/tmp/checkpoints/corpusloom"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def drop(spark: SparkSession, path: str) -> None:
    """Removes a table of the shared folder that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def kept(df: DataFrame, name: str = "kept") -> DataFrame:
    """df written into the shared folder and read again: what follows does not plan or run anew what made it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a bucket of a table that is dealt by segment.
BUCKET = 500_000
#: Spark's setting that asks for a new exchange where a join has more keys than its rows are dealt by.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


class Dealt:
    """Tables bucketed by their column ``segment`` into as many buckets each, so that joins, windows and groups by segment and more columns
    exchange nothing. ``keep`` writes such a table, the files lie in the shared folder."""

    def __init__(self, spark: SparkSession, rows: int):
        self.spark, self.tables = spark, []
        self.buckets = max(spark.sparkContext.defaultParallelism, -(-rows // BUCKET))

    def keep(self, df: DataFrame, name: str = "dealt") -> DataFrame:
        path = scratch(self.spark, name)
        table = path.rsplit("/", 1)[1].replace("-", "_")
        df.repartition(self.buckets, "segment").write.bucketBy(self.buckets, "segment").format("parquet").saveAsTable(table, path=path)
        self.tables.append((table, path))
        return self.spark.table(table)

    def result(self, df: DataFrame, name: str = "kept") -> DataFrame:
        """df written once more, plainly; the tables it was made of go."""
        out = kept(df, name)
        for table, path in self.tables:
            self.spark.sql(f"DROP TABLE {table}")
            drop(self.spark, path)
        self.tables.clear()
        return out


@contextmanager
def by_segment(spark: SparkSession, rows: int) -> Iterator[Dealt]:
    """Within it, what is written joins tables dealt by segment where they lie."""
    before = spark.conf.get(ALL_KEYS, "true")
    spark.conf.set(ALL_KEYS, "false")
    try:
        yield Dealt(spark, rows)
    finally:
        spark.conf.set(ALL_KEYS, before)
