"""A table published part by part: a run writes the parts that moved, and its manifest last.

Data lies under data/run=<n>/part=<id>; the manifest of run n, under manifest/run=<n>, has a row for each part of the whole table:
its key, its digest, and the run that wrote it. Readers take the newest manifest that is complete, so a run that is lost on its way
leaves the state before it: its data stand in no manifest, and the next run takes a later number. Nothing that a reader may be
reading is overwritten or removed; ``swept`` removes the data that the newest manifest does not name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import record_hash
from ..session import drop
from . import build


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder of the shared storage holds; none where there is no such folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in system.listStatus(target)] if system.exists(target) else []


def runs(spark: SparkSession, path: str) -> tuple[int, int]:
    """The newest run with a complete manifest, and the newest that wrote anything; 0 for none."""
    number = lambda names: [int(n.split("=")[1]) for n in names if n.startswith("run=")]
    whole = [k for k in number(listed(spark, f"{path}/manifest")) if "_SUCCESS" in listed(spark, f"{path}/manifest/run={k}")]
    return max(whole, default=0), max([*number(listed(spark, f"{path}/manifest")), *number(listed(spark, f"{path}/data"))], default=0)


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest complete manifest: the key's columns, part, rows, digest, run."""
    newest, _ = runs(spark, path)
    return spark.read.parquet(f"{path}/manifest/run={newest}") if newest else None


def publish(built: DataFrame, path: str, by: list[str]) -> DataFrame:
    """Brings the published table to the built one and returns by, state of the parts that moved, are new or gone; only the former two
    are written. Parts are told by the key columns, a null being a key like any other."""
    spark = built.sparkSession
    old = manifest(spark, path)
    run = runs(spark, path)[1] + 1
    part = record_hash(*[F.col(f"`{c}`") for c in by]).alias("part")
    now = build.digest(built, by)
    empty = now.limit(0).select("*", F.lit("").alias("part"), F.lit(0).alias("run"))
    before = empty if old is None else old
    moved = build.parts_moved(before.select(*by, "rows", "digest"), now, by)
    # what moved is written down first: the data and the manifest must speak of one state
    moved.write.mode("overwrite").parquet(f"{path}/moved/run={run}")
    moved = spark.read.schema(moved.schema).parquet(f"{path}/moved/run={run}")
    fresh = moved.filter("state <> 'gone'").select(part).distinct()
    rows = built.withColumn("part", part).join(fresh, "part", "left_semi")
    rows.repartition("part", F.pmod(F.xxhash64(*[f"`{c}`" for c in built.columns]), F.lit(8))).write.partitionBy("part").mode("overwrite").parquet(f"{path}/data/run={run}")
    stays = before.select(*by, "rows", "digest", "part", "run").join(moved.select(part), "part", "left_anti")
    written = now.select(*by, "rows", "digest", part, F.lit(run).alias("run")).join(fresh, "part", "left_semi")
    stays.select(*by, "rows", "digest", "part", "run").unionByName(written).write.mode("overwrite").parquet(f"{path}/manifest/run={run}")
    return moved


def published(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the newest complete manifest, with the run that wrote each part."""
    named = manifest(spark, path)
    if named is None:
        raise ValueError(f"{path}: nothing has been published")
    names = [n for n in named.columns if n not in ("rows", "digest", "part", "run")]
    own = spark.read.option("basePath", f"{path}/data").parquet(f"{path}/data/run=*")
    live = own.withColumn("part", F.col("part").cast("string")).join(named.select(F.col("part"), F.col("run").cast("int").alias("run")), ["part", "run"], "left_semi")
    return live.select(*names, *[c for c in own.columns if c not in (*names, "part", "run")], F.col("run").cast("int").alias("run"))


def swept(spark: SparkSession, path: str) -> list[str]:
    """Removes runs' data that the newest manifest does not name, and older manifests; returns their names. No reader may be at them."""
    newest, _ = runs(spark, path)
    live = {f"run={r['run']}" for r in manifest(spark, path).select("run").distinct().collect()} if newest else set()
    gone = [f"data/{n}" for n in listed(spark, f"{path}/data") if n.startswith("run=") and n not in live]
    gone += [f"manifest/{n}" for n in listed(spark, f"{path}/manifest") if n.startswith("run=") and n != f"run={newest}"]
    for name in gone:
        drop(spark, f"{path}/{name}")
    return sorted(gone)
