"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass one scatters the records with seeded hashes: the shard comes from the key alone, and
within its shard a record goes to one of so many buckets that a bucket's bytes fit in a
task's memory, of which the session's settings tell how large it is. How many that is follows from the bytes that each shard is measured to have, so
a shard that repeated keys make large has more buckets, not larger ones. The scattered records
are written to the shared folder, so that both readers of pass two see one scatter. Pass two
reads a bucket whole, shuffles it by sorting its records by seeded random numbers (made of their places; more
than memory holds is spilled), numbers its records after those of the shard's buckets before it and writes
it. Buckets are dealt by key and place, so no source, text or group of copies can fill one.

The shard is the one whose hash with the key is highest (rendezvous hashing): with one more
shard, a record either stays or goes to the new one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, written

#: Bytes of a bucket's records; unset, they follow from the executors' memory.
BUCKET_BYTES: int | None = None
#: A bucket's records may take this part of the memory that an executor has for each of its tasks.
BUCKET_PART = 32
#: Bounds of a bucket's bytes, whatever the memory.
LEAST_BUCKET, LARGEST_BUCKET = 4 << 20, 256 << 20


def bucket_size(spark: SparkSession) -> int:
    """Bytes of records that one bucket should hold, from the session's settings; on one machine the driver is the executor."""
    conf = spark.sparkContext.getConf()
    local = spark.sparkContext.master.split("[")[0] == "local"
    memory = _bytes(spark, conf.get("spark.driver.memory" if local else "spark.executor.memory", "1g"))
    # an executor without a setting of its own may have as many cores as there are
    cores = int((not local and conf.get("spark.executor.cores")) or spark.sparkContext.defaultParallelism)
    return min(max(memory // max(cores, 1) // BUCKET_PART, LEAST_BUCKET), LARGEST_BUCKET)


def _bytes(spark: SparkSession, text: str) -> int:
    return int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(text))


def shard_of(key: Column, n_shards: int, seed: int) -> Column:
    """The shard, 0 to n_shards - 1, with the highest hash of (seed, shard, key)."""
    ranked = [F.struct(F.xxhash64(F.lit(seed), F.lit(i), key).alias("h"), F.lit(i).alias("i")) for i in range(n_shards)]
    return F.greatest(*ranked)["i"] if n_shards > 1 else F.lit(0)


def shuffled_shards(
    df: DataFrame,
    *,
    key: str,
    size: Column,
    n_shards: int = 16,
    seed: int = 42,
    bucket_bytes: int | None = None,
) -> DataFrame:
    """``shard`` int, ``slot`` long (the row's place in its shard, gapless from 0), ``grown_shard`` int
    (its shard if there were one more) and ``row``, the row of df as a struct: a written table.

    ``key`` and the number of shards decide the shard. Rows with a null key share one shard; equal
    rows stay apart; an empty table gives no rows; df may have columns of any name and type, since they
    stay inside ``row``. ``size`` is a row's bytes; one row of more than a bucket's bytes is a bucket
    of its own size. ``bucket_bytes`` follows from the executors' memory unless it is given. The order depends on the rows, their places in the input, the seed and
    the numbers of buckets.
    """
    bucket_bytes = bucket_bytes or BUCKET_BYTES or bucket_size(df.sparkSession)
    own = F.col(f"`{key}`")
    shard = shard_of(own, n_shards, seed)
    # one number a shard
    sums = {r["shard"]: r["bytes"] or 0 for r in df.groupBy(shard.alias("shard")).agg(F.sum(size.cast("double")).alias("bytes")).collect()}
    buckets_of = [max(1, math.ceil(sums.get(i, 0) / bucket_bytes)) for i in range(n_shards)]
    scattered = written(
        df.select(
            F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
            shard.alias("shard"),
            shard_of(own, n_shards + 1, seed).alias("grown_shard"),
            F.monotonically_increasing_id().alias("place"),
        ).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), f"row.`{key}`", "place"), F.element_at(F.array(*[F.lit(n) for n in buckets_of]), F.col("shard") + 1)))
        # the buckets of all shards, numbered through
        .withColumn("task", (F.element_at(F.array(*[F.lit(sum(buckets_of[:i])) for i in range(n_shards)]), F.col("shard") + 1) + F.col("bucket")).cast("int")),
        "scatter",
        compression="zstd",
    )
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        scattered.groupBy("shard", "bucket", "task")
        .agg(F.count("*").alias("n"))
        .select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    # sorted by random numbers, which spills what memory does not hold; arrays of whole records do not
    shuffled = Window.partitionBy("task").orderBy(F.xxhash64(F.lit(seed), "place", F.lit("slot")), "place")
    numbered = (
        _one_a_task(scattered, sum(buckets_of))
        .withColumn("nth", F.row_number().over(shuffled) - 1)
        # one row a bucket
        .join(F.broadcast(offsets), "task")
        .select("shard", (F.col("offset") + F.col("nth")).alias("slot"), "grown_shard", "row")
    )
    out = written(numbered, "shards", compression="zstd")
    discard(scattered)
    return out


def _one_a_task(scattered: DataFrame, buckets: int) -> DataFrame:
    """The records, a task for each bucket: dealt by a hash of the bucket, some tasks would hold several at once and others none."""
    return scattered.repartitionById(buckets, "task")


def write_shards(shards: DataFrame, path: str) -> None:
    """The shuffled records as Parquet, one folder a shard, without another shuffle: a file holds whole buckets, and ``slot`` orders them."""
    out = shards.select("shard", "slot", "row.*") if not {"shard", "slot"} & {c.lower() for c in shards.schema["row"].dataType.names} else shards
    out.write.partitionBy("shard").parquet(path)
