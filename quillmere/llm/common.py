"""What the operators share: the shared folder, cut lineage, and word hashing for Arrow tasks."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_CACHE = 400_000  # words whose hashes a task keeps; only memory depends on it
BUCKET_BYTES = 1 << 27


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one where that is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):  # local-cluster executors share this machine's folders too
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lineage ends here, and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, name: str, key: str, size: int) -> DataFrame:
    """df (about `size` bytes) as a table in the shared folder, dealt by `key` into buckets and sorted by it in each.

    A join on `key` moves and sorts only its other side, however often the table is read.
    """
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    buckets = min(100_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES + 1))
    rows = df.repartition(buckets, key).write.format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{table}")
    rows.bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return spark.table(table)


def with_rows(docs: DataFrame, **columns: Column) -> DataFrame:
    """docs with each whole row packed into `row`, and the columns given: no name in docs can clash with them."""
    return docs.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in columns.items()])


def row_columns(rows: DataFrame, names: list[str], **replaced: Column) -> DataFrame:
    """The columns `names` of the packed rows, some of them replaced."""
    return rows.select(*[replaced.get(c, F.col("row").getField(c)).alias(c) for c in names])


def text_key() -> Column:
    """A hash of a row's text, null as empty."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class WordHashes(dict):
    """64-bit hashes of words, of which WORD_CACHE are kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums and products of hashes spread over all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive values; none if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[j : j + n]
    return mixed(out)
