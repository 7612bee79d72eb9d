"""Shared plumbing of the training-data operators: scratch tables and small guards."""

from __future__ import annotations

import secrets
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Largest lookup, in bytes, that an operator may broadcast.
BROADCAST_LIMIT = 64 * 1024 * 1024


class BroadcastTooLarge(ValueError):
    """A lookup exceeds the size that an operator may hold in every executor."""


def check_broadcast(n_bytes: int, what: str) -> None:
    if n_bytes > BROADCAST_LIMIT:
        raise BroadcastTooLarge(f"{what} takes {n_bytes} bytes; at most {BROADCAST_LIMIT} may be broadcast")


class Scratch:
    """A folder of written tables that cut lineage and survive the loss of executors.

    It lies in the shared folder named by ``spark.checkpoint.dir``; only where that is unset (local tests) a
    temporary folder of this machine stands in.
    """

    def __init__(self, spark: SparkSession, name: str):
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a shared folder")
            root = "file://" + tempfile.gettempdir()
        self.spark = spark
        self._schemas: dict[str, StructType] = {}
        self.path = f"{root.rstrip('/')}/siftline-{name}-{uuid.uuid4().hex}"
        path, files = self._files("")
        files.deleteOnExit(path)  # results are read from the tables, so they stay until the session's JVM ends

    def _files(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{self.path}/{name}")
        # partition columns are read last; an empty table has no file to tell its schema
        fields = sorted(df.schema.fields, key=lambda f: partition_by.index(f.name) + 1 if f.name in partition_by else 0)
        self._schemas[name] = StructType(fields)
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(self._schemas[name]).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Deletes tables that no later step reads, and asks for the release of shuffles that nothing refers to.

        The request frees disk earlier; nothing depends on it.
        """
        for name in names:
            path, files = self._files(name)
            files.delete(path, True)
        self.spark.sparkContext._jvm.System.gc()


#: No more than so many keys are dealt by salts, and at most twice as many salts.
HOT_KEYS = 100_000


def met_by_key(rows: DataFrame, table: DataFrame, key: str, copies: str, salted_by: tuple[str, ...], how: str = "inner") -> DataFrame:
    """Join of many ``rows`` with a ``table`` of distinct keys and the number of ``copies`` of each.

    A key with more than one ``HOT_KEYS``-th of all copies is dealt over as many tasks as its share asks for, by the
    hash of the columns ``salted_by``.  There are fewer than ``HOT_KEYS`` such keys whatever the size of the table, so
    that they can be broadcast.
    """
    total = table.agg(F.coalesce(F.sum(copies), F.lit(0)).alias("n")).first()["n"]
    share = max(1, total // HOT_KEYS)
    salts = F.ceil(F.col(copies) / share).cast("int")
    hot = table.where(F.col(copies) > max(share, 64)).select(key, salts.alias("_salts"))
    left = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*salted_by), F.col("_salts")).cast("int"), F.lit(0))).drop("_salts")
    every = F.when(F.col(copies) > max(share, 64), F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.lit(0)))
    right = table.withColumn("_salt", F.explode(every))
    return left.join(right, [key, "_salt"], how).drop("_salt")


#: Drawn for each driver, so that no text can be written whose tag is another's.
_TAG_KEY = secrets.token_hex(32)


def text_tag(text: Column) -> Column:
    """A 64-bit number that tells texts of one id apart: the head of a keyed SHA-256, the same all over a driver's life."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(_TAG_KEY), text), 256), 1, 16), 16, -10).cast("bigint")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Parts into which keys are hashed for sampling; fine enough for any number of labels.
SHARES = 1 << 50


def sampled_labels(labels: DataFrame, key: str, label: str, rows: int, balanced: bool = False) -> tuple[DataFrame, dict[int, int]]:
    """About ``rows`` labelled keys, chosen by the key's hash and small enough to broadcast; ``balanced``: of each label alike.

    Sampling before the texts are joined keeps the texts where they are.  Null keys and labels are left out.  Beside
    them the numbers of keys sampled from: of each label if ``balanced``, otherwise of all under 0.
    """
    known = labels.select(F.col(key), F.col(label).cast("int").alias(label)).where(F.col(key).isNotNull() & F.col(label).isNotNull())
    kind = F.col(label) if balanced else F.lit(0)
    sizes = {r["kind"]: r["n"] for r in known.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n")).orderBy("kind").limit(64).collect()}
    share = F.lit(0)
    for value, n in sizes.items():
        share = F.when(kind == value, min(SHARES, SHARES * rows // len(sizes) // n + 1)).otherwise(share)
    return F.broadcast(known.where(F.pmod(F.xxhash64(key), F.lit(SHARES)) < share)), sizes
