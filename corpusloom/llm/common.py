"""Shared pieces of the training-data operators: table access, shared storage, tokens and hashes."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
#: Odd multiplier of the rolling combination of word hashes (fixed value).
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Entries that a word cache of one Python worker may hold before it starts anew; speed only.
CACHE_ENTRIES = 200_000
#: Spark's setting that removes the shuffle files of a query once it has run; nothing reads those of a written table again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the cluster's spark.checkpoint.dir, or our own where it is unset (tests)."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return at.rstrip("/") if at else "/tmp/checkpoints/corpusloom"


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, path: str) -> None:
    """Writes df as Parquet. Shuffle files of the write go with its end."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df into the shared folder and reads it back."""
    path = scratch(df.sparkSession, name)
    written(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def trim() -> None:
    """Gives memory that this Python worker no longer uses back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def slices(batches, rows: int = 1000):
    """The batches in pieces of so many rows, so that few texts at a time are Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def drop(spark: SparkSession, path: str) -> None:
    """Removes a table of the shared folder that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores in front as it takes to differ from all columns (Spark ignores case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def crc_mod(column: str = "doc_id", modulus: int = 5):
    """crc32 of the id as text, modulo modulus."""
    return F.crc32(F.col(column).cast("string")) % modulus


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; bytes.split cuts at exactly these six characters."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHash(dict):
    """64-bit hash of a word, remembered while the cache is small."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        self[word] = value
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_ENTRIES:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, a bijection of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(word_hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of all runs of size words, in order; with fewer words the whole sequence is the one run."""
    n = len(word_hashes)
    if not n:
        return np.empty(0, np.uint64)
    run = min(n, size)
    out = word_hashes[: n - run + 1].copy()
    for k in range(1, run):
        out *= MULTIPLIER
        out += word_hashes[k : n - run + 1 + k]
    out += np.uint64(run if run < size else 0)
    return mixed(out)
