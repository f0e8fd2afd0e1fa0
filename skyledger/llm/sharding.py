"""Shards of a shuffled corpus by a two-pass external shuffle.

The first pass scatters whole records by seeded hashes into buckets that fit in
memory; the second shuffles each bucket by Fisher and Yates and writes it. The shard
of a record depends on its key and the number of shards alone (highest random weight),
so one more shard only takes records into itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from skyledger.session import materialize, scratch_path

SEED = 9
BUCKET_BYTES = 16 << 20  # text bytes in a bucket
LEAST_BUCKETS = 4  # buckets per shard, at least
MOST_BUCKETS = 1 << 20  # buckets in all, at most; beyond, they grow with the corpus


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard from 0 to ``shards`` - 1 with the highest weight for the key."""
    weights = [F.struct(F.xxhash64(F.lit(seed), F.lit(s), key).alias("w"), F.lit(s).alias("s")) for s in range(shards)]
    return F.array_max(F.array(*weights))["s"]


def fisher_yates(n: int, *seed: int) -> np.ndarray:
    """A random order of 0 to n - 1 that the seed decides."""
    rng = np.random.default_rng([abs(s) for s in seed])
    order = np.arange(n)
    rng.shuffle(order)  # Fisher-Yates, in place
    return order


def write_shards(docs: DataFrame, path: str, shards: int = 16, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write the rows of ``docs`` under ``path`` and return them as read back.

    The table has the columns ``row`` (all input columns), ``shard``, ``bucket`` and
    ``place``, the row's place in its shuffled bucket; it is stored by shard. Rows with
    equal doc_id are in one shard; a null doc_id is a key too. The text decides nothing: equal texts
    with different ids may lie in different shards. A doc_id whose rows hold more than ``bucket_bytes`` is spread over the
    buckets of its shard, whatever the number of its rows; a single text beyond that is a bucket's own size. Ties inside a bucket are ordered by size and
    checksum before shuffling, and rows equal in those by their order of arrival, which may differ between
    runs even where their other columns differ. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.struct(*docs.columns).alias("row"),
        F.col("doc_id").cast("bigint").alias("key"),
        (F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("crc"),
    )
    total = docs.agg(F.sum(F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + 1)).first()[0] or 0
    bucket_bytes = max(bucket_bytes, -(-total // MOST_BUCKETS))
    parts = max(LEAST_BUCKETS, -(-total // (shards * bucket_bytes)))
    # Keys with more bytes than a bucket are spread; at most MOST_BUCKETS keys can have them, which bounds the broadcast.
    hot = materialize(rows.groupBy(F.col("key").alias("hot_key")).agg(F.sum("size").alias("bytes")).where(F.col("bytes") > bucket_bytes), "hot-keys")
    rows = rows.withColumn("at", F.monotonically_increasing_id()).join(F.broadcast(hot.select("hot_key", F.lit(1).alias("hot"))), F.col("key").eqNullSafe(F.col("hot_key")), "left")
    salt = F.when(F.col("hot").isNotNull(), F.col("at"))
    bucket = (shard_of(F.col("key"), shards, seed) * F.lit(parts) + F.pmod(F.xxhash64(F.lit(seed + 1), "key", salt), F.lit(parts))).cast("int")
    scattered = rows.select("row", "key", "size", "crc", bucket.alias("bucket"))

    def shuffle(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        order = group.select(["key", "size", "crc"]).append_column("i", pa.array(np.arange(group.num_rows)))
        order = order.sort_by([("key", "ascending"), ("size", "ascending"), ("crc", "ascending"), ("i", "ascending")]).column("i").to_numpy()
        mixed = group.take(pa.array(order[fisher_yates(len(order), seed, bucket)]))
        n = len(order)
        return pa.table([mixed.column("row"), mixed.column("size"), mixed.column("crc"), pa.array(np.full(n, bucket // parts), pa.int32()), mixed.column("bucket"), pa.array(np.arange(n), pa.int64())], names=["row", "size", "crc", "shard", "bucket", "place"])

    schema = StructType([scattered.schema["row"], StructField("size", LongType()), StructField("crc", LongType()), StructField("shard", IntegerType()), StructField("bucket", IntegerType()), StructField("place", LongType())])
    # A bucket is a partition of its own, so no task holds two; grouping by the same column needs no second exchange.
    scattered = scattered.repartitionById(shards * parts, F.col("bucket"))
    scattered.groupBy("bucket").applyInArrow(shuffle, schema).write.partitionBy("shard").parquet(path)
    return spark.read.schema(schema).parquet(path)


def shard_slots(written: DataFrame) -> DataFrame:
    """The written rows with ``slot``: gapless from 0 in each shard, bucket after bucket."""
    counts = materialize(written.groupBy("shard", "bucket").agg(F.count("*").alias("n")), "bucket-sizes")
    # One row per bucket, so a shard's window is small beside its rows.
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("bucket").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return written.join(offsets, F.col("bucket") == F.col("of")).withColumn("slot", F.col("offset") + F.col("place")).drop("of", "offset")


def shard_corpus(spark: SparkSession, docs: DataFrame, shards: int = 16, path: str | None = None) -> DataFrame:
    """``write_shards`` with slots and, as ``grown_shard``, the shard under one more shard."""
    written = shard_slots(write_shards(docs, path or scratch_path(spark, "shards"), shards))
    return written.withColumn("grown_shard", shard_of(F.col("row.doc_id").cast("bigint"), shards + 1))
