"""Sharding by a two-pass external shuffle. Spark SQL expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows and bytes that a bucket of the first pass holds on average.
BUCKET_ROWS, BUCKET_BYTES = 512, 64 << 20


def text_size(text: str | Column) -> Column:
    """UTF-8 bytes of a text (null: none) plus 16."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def fisher_yates(items: Column, seed: int, group: Column) -> Column:
    """The array shuffled: from the last place down, place i swaps with a place from 0 to i drawn by a hash of seed, group and i.
    The order depends on these alone, so that a task that runs again gives what it gave before."""
    n = F.size(items)

    def swap(order: Column, i: Column) -> Column:
        j = F.pmod(F.xxhash64(F.lit(seed), group, i), i + 1).cast("int")
        head, between, tail = F.slice(order, 1, j), F.slice(order, j + 2, i - j - 1), F.slice(order, i + 2, n)
        a, b = F.slice(order, j + 1, 1), F.slice(order, i + 1, 1)
        return F.when(j == i, order).otherwise(F.concat(head, b, between, a, tail))

    places = F.when(n > 1, F.reverse(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))))).otherwise(F.array().cast("array<int>"))
    order = F.aggregate(places, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), swap)
    return F.when(n > 0, F.transform(order, lambda p: F.get(items, p))).otherwise(items)


def assign_shards(rows: DataFrame, shards: int, key: str = "doc_id", size: str = "size", seed: int = 17, buckets: int | None = None) -> DataFrame:
    """rows with shard and slot: a seeded random permutation dealt over the shards, counts at most one apart.

    Pass 1 scatters rows to memory-sized buckets by a seeded hash of all columns and of a row's number among its equals; pass
    2 orders each bucket by that hash and shuffles it (Fisher-Yates). Place g = rows of earlier buckets + place in the bucket;
    shard = g mod shards, slot = g div shards. The result is a function of the rows: their partitions, their order and tasks
    that run again do not change it. A hot source, key or group of equal texts scatters, as the hash covers every column
    given, and so do rows that are equal in full: they are counted before the shuffle and numbered. Columns with binary or
    text payloads should be left out and joined on again, or kept small. Nulls hash like any value, an empty table gives no
    rows, and repeated rows each get a place of their own. Columns named shard or slot are replaced.
    """
    rows = rows.drop("shard", "slot")
    names = [F.col(f"`{c}`") for c in rows.columns]
    if buckets is None:
        n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
        buckets = max(1, -(-n // BUCKET_ROWS), -(-total // BUCKET_BYTES))
    alike = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("__times"))
    rows = alike.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).drop("__times")
    mark = F.xxhash64(F.lit(seed), *names, "__copy")
    dealt = rows.select(F.pmod(mark, F.lit(buckets)).alias("bucket"), F.struct(F.xxhash64(F.lit(seed + 1), mark).alias("mark"), F.struct(*names).alias("row"), F.col("__copy")).alias("r"))
    counts = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("part").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    # Running totals in two levels, so that no task holds all buckets: within parts of 65,536 buckets, then over the parts.
    part = (F.col("bucket") / 65536).cast("long")
    inner = counts.withColumn("part", part).withColumn("before", F.coalesce(before, F.lit(0)))
    outer = counts.groupBy(part.alias("part")).agg(F.sum("n").alias("m")).withColumn("one", F.lit(0))
    outer = outer.select("part", F.coalesce(F.sum("m").over(Window.partitionBy("one").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    starts = inner.join(outer, "part").select("bucket", (F.col("base") + F.col("before")).alias("start"))
    held = dealt.groupBy("bucket").agg(F.array_sort(F.collect_list("r")).alias("rows")).join(starts, "bucket")
    mixed = held.select("start", fisher_yates(F.col("rows"), seed, F.col("bucket")).alias("rows"))
    g = F.col("start") + F.col("pos")
    placed = mixed.select("start", F.posexplode("rows").alias("pos", "r"))
    return placed.select("r.row.*", F.pmod(g, F.lit(shards)).cast("int").alias("shard"), F.floor(g / shards).cast("long").alias("slot"))


def write_shards(rows: DataFrame, path: str) -> None:
    """One folder per shard; its files follow each other in slot order. A shard is as many tasks as its size asks for."""
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
