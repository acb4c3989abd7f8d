"""Sharding by a two-pass external shuffle, in DataFrame operations only.

Pass one scatters the records uniformly into buckets of about ``bucket_bytes`` by a seeded hash. Pass two gathers a
bucket in memory, puts it in a random order by a Fisher-Yates shuffle (``F.shuffle``) and writes it to the shared
folder. Buckets stand one after the other, and the whole order is cut into shards whose row counts differ by one at
most: places follow from what was written, so a task that is run again can't disagree with the counts.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from . import common

#: A table of bucket offsets of more rows than this is not broadcast.
BROADCAST_BUCKETS = 500_000
#: Buckets share tasks beyond this many.
MOST_TASKS = 20_000


def record_bytes(df: DataFrame):
    """Bytes of a record: its strings and binaries, and 16 for each column."""
    wide = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    return sum((F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c in wide), F.lit(16 * len(df.columns))).cast("long")


def shuffle_into_shards(df: DataFrame, shards: int, seed: int = 42, bucket_bytes: int = 16 << 20) -> DataFrame:
    """Rows ``(row, bucket, shard, slot)``: ``row`` is a struct of all columns of df, so no name can clash.

    ``shard`` is 0 to shards-1, ``slot`` the gapless place within it. The scattering hash takes the seed and the place of
    a row in its partition, so rows that are repeated, however often, are spread like any others; the same partitions and
    seed give the same order. An empty table gives no rows; fewer rows than shards leave some shards empty. Nulls are
    values like others. A text longer than ``bucket_bytes`` makes its bucket that much larger.
    """
    if shards < 1 or bucket_bytes < 1:
        raise ValueError("shards and bucket_bytes must be positive")
    total = df.agg(F.sum(record_bytes(df))).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    spread = F.xxhash64(F.lit(seed), F.monotonically_increasing_id())
    scattered = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.pmod(spread, F.lit(buckets)).cast("int").alias("bucket"))
    scattered = scattered.repartitionById(buckets, "bucket") if buckets <= MOST_TASKS else scattered.repartition(MOST_TASKS, "bucket")
    gathered = scattered.groupBy("bucket").agg(F.collect_list("row").alias("rows"))
    mixed = common.written(gathered.select("bucket", F.posexplode(F.shuffle("rows", seed)).alias("at", "row")), "buckets")

    counts = mixed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = W.Window.orderBy("bucket").rowsBetween(W.Window.unboundedPreceding, -1)  # one row a bucket
    whole = W.Window.orderBy("bucket").rowsBetween(W.Window.unboundedPreceding, W.Window.unboundedFollowing)
    offsets = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(whole).alias("rows_in_all"))
    if buckets <= BROADCAST_BUCKETS:
        offsets = F.broadcast(offsets)
    index = F.col("start") + F.col("at")
    shard = F.expr(f"((start + at) * {shards}L) div rows_in_all")
    first = F.expr(f"(shard * rows_in_all + {shards - 1}L) div {shards}L")
    placed = mixed.join(offsets, "bucket").select("row", "bucket", "rows_in_all", index.alias("index"), shard.alias("shard"))
    return placed.select("row", "bucket", F.col("shard").cast("int").alias("shard"), (F.col("index") - first).alias("slot"))


def write_shards(shuffled: DataFrame, path: str) -> None:
    """Write what shuffle_into_shards returned as (row, slot), a folder for each shard; a file has its slots in order."""
    rows = shuffled.select("row", "shard", "slot").sortWithinPartitions("shard", "slot")
    rows.write.partitionBy("shard").parquet(path)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    done = shuffle_into_shards(docs, shards=8)
    text = F.col("row.text")
    return done.select(
        F.col("row.doc_id").alias("doc_id"),
        (common.utf8_bytes(text) + 1).alias("size"),
        F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
