"""Sharding as a two-pass external shuffle, in DataFrame operations only.

First pass: every record goes to its shard and there to one of enough buckets that a bucket fits into
memory, both by seeded hashes. Second pass: each bucket is put into the order of its hashes, shuffled
with Fisher-Yates and laid behind the buckets before it, which gives gapless slots. The draw of each
exchange is a hash of the seed, the shard, the bucket and the place, so a bucket's permutation depends on
its records alone: not on the input's partitions, on the task that deals it or on a task run again.

The law is ``key``: the shard is the one with the highest hash of id and shard number (rendezvous
hashing), so the id and the shard count decide alone, and one more shard takes rows only into itself.

A null text has no bytes and a null CRC; a null id is hashed as such, so that rows without an id share a
shard, as the law asks. Copies of a text spread by their ids; rows equal in id and text spread over the
buckets of their shard by their other columns, and only rows equal in all columns stay together. Extra
columns are kept; of clashing names the record's own are dropped. An empty table gives an empty result.
Reruns give the same slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHARDS = 24
SEED = 20240229
#: Bytes and rows of a bucket on average.
BUCKET_BYTES, BUCKET_ROWS = 2 << 20, 1000
#: Bytes that a task deals, about, and the most tasks; more bytes than that are more buckets for a task, one after the other.
TASK_BYTES, MOST_TASKS = 64 << 20, 100_000

_ADDED = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _permutation(n: Column, seed: int, *place: Column) -> Column:
    """Fisher-Yates: 0 to n - 1, from the last place down each exchanged with one drawn from those up to it."""

    def exchanged(order: Column, i: Column) -> Column:
        j = F.pmod(F.xxhash64(F.lit(seed), *place, i), i + 1).cast("int")
        at = lambda k: F.slice(order, k + 1, 1)
        swapped = F.concat(F.slice(order, F.lit(1), j), at(i), F.slice(order, j + 2, i - j - 1), at(j), F.slice(order, i + 2, n))
        return F.when(i == j, order).otherwise(swapped)

    steps = F.when(n > 1, F.sequence(n - 1, F.lit(1), F.lit(-1))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.aggregate(steps, F.sequence(F.lit(0), n - 1), exchanged)


def _others(docs: DataFrame, names: list[str]) -> list[Column]:
    """Columns besides id and text that can be hashed."""
    hashed = lambda t: not isinstance(t, T.MapType | T.VariantType) and not (isinstance(t, T.StructType | T.ArrayType) and "map" in t.simpleString())
    return [F.col(n) for n in sorted(names) if n not in ("doc_id", "text") and hashed(docs.schema[n].dataType)]


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``docs`` with ``size, text_crc32, law, shard, slot, grown_shard``."""
    names = [n for n in docs.columns if n not in _ADDED]
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 8
    total = docs.agg(F.sum(size).alias("bytes"), F.count("*").alias("n")).first()
    buckets = max(1, -(-int(total.bytes or 0) // (shards * bucket_bytes)), -(-int(total.n) // (shards * bucket_rows)))
    tasks = max(1, min(shards * buckets, MOST_TASKS, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total.bytes or 0) // TASK_BYTES)))
    drawn = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.struct(F.xxhash64(F.lit(seed), "doc_id", i).alias("h"), i.alias("s")))
    rows = docs.select(*names).withColumn("size", size).withColumn("text_crc32", F.crc32("text").cast("bigint")).withColumn("shard_best", F.array_max(drawn))
    rows = rows.withColumn("shard", F.col("shard_best.s").cast("int"))
    grown = F.xxhash64(F.lit(seed), F.col("doc_id"), F.lit(shards)) > F.col("shard_best.h")
    rows = rows.withColumn("grown_shard", F.when(grown, F.lit(shards)).otherwise(F.col("shard")).cast("int"))
    own = [F.col("doc_id"), F.col("text_crc32"), F.col("size"), *_others(docs, names)]
    rows = rows.withColumn("shard_order", F.xxhash64(F.lit(seed + 1), *own)).withColumn("shard_bucket", F.pmod(F.xxhash64(F.lit(seed + 2), *own), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("shard", "shard_bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("shard_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "shard_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_offset"))
    record = F.struct("shard_order", *(n for n in rows.columns if n not in ("shard_best", "shard", "shard_bucket", "shard_order")))
    by_hash = lambda a, b: F.when(a["shard_order"] < b["shard_order"], -1).when(a["shard_order"] > b["shard_order"], 1).otherwise(0)
    packed = rows.repartition(tasks, "shard", "shard_bucket").groupBy("shard", "shard_bucket").agg(F.array_sort(F.collect_list(record), by_hash).alias("records"))
    order = _permutation(F.size("records"), seed + 3, F.col("shard"), F.col("shard_bucket"))
    dealt = packed.withColumn("order", order).join(offsets, ["shard", "shard_bucket"])
    out = dealt.select("shard", "shard_offset", "records", F.posexplode_outer("order").alias("place", "k")).withColumn("r", F.get("records", F.col("k")))
    return out.select(
        *(F.col("r")[n].alias(n) for n in names),
        F.col("r.size").alias("size"),
        F.col("r.text_crc32").alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        (F.col("shard_offset") + F.col("place")).alias("slot"),
        F.col("r.grown_shard").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write the records, a folder for each shard; every file holds a run of slots in their order."""
    out = sharded(docs, shards)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
