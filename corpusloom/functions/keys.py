"""Identity rules: content hashes that never depend on insertion order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept


def id52(key: Column) -> Column:
    """The first 52 bits of the SHA-256 of a key."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 13), 16, 10).cast("long")


def with_ids(df: DataFrame, key: str, name: str = "id") -> DataFrame:
    """Ids of distinct keys; where ids collide (or are 0), later keys take that of key|1, key|2, ... until no two are the same.

    A round finds ids that several keys have: the one that was hashed less often keeps it, then the smaller key. Without
    collisions, as with 52 bits nearly always, there is one round.
    """
    now = df.withColumn("_n", F.lit(0))
    while True:
        own = now.withColumn(name, F.when(F.col("_n") == 0, id52(F.col(key))).otherwise(id52(F.concat_ws("|", F.col(key), F.col("_n").cast("string")))))
        later = (F.row_number().over(Window.partitionBy(name).orderBy("_n", key)) > 1) | (F.col(name) == 0)
        marked = own.withColumn("_later", later)
        if marked.filter("_later").isEmpty():
            return own.drop("_n")
        now = kept(marked.withColumn("_n", F.col("_n") + F.col("_later").cast("int")).drop("_later", name), "ids")


def record_hash(*fields: Column) -> Column:
    """First 16 hexadecimal digits of the SHA-256 of fields joined by 0x1F, a null being 0x00."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(f.cast("string"), F.lit("\x00")) for f in fields]), 256), 1, 16)


def sampled(key: Column, every: int) -> Column:
    """True for one key in every, by its hash."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % every == 0
