"""Sharding: a two-pass external shuffle in DataFrame operations.

Pass one scatters the rows uniformly into memory-sized buckets by a seeded hash,
buckets in a row to one task.  Pass two shuffles each bucket by Fisher-Yates,
whose draws are seeded hashes of (bucket, step), and lays the buckets end to
end; cutting that order into runs gives the shards, which are written from
there, so a record is shuffled once.  Everything
is a function of the rows and the seed, so a task that runs again after a lost
executor makes the same rows.

Rows that occur often are counted first (one key per row travels), collapsed to
one row with its count before the shuffle, and each copy gets a number of its
own in its key; so copies spread over the buckets like different rows.

Defined results: nulls in any column are hashed like values (a null text counts
as an empty one); equal rows are interchangeable and each gets a place of its
own; an empty table gives no rows; a column named ``bucket``, ``shard`` or
``slot`` in the input is carried inside a struct and does not clash until the
caller unpacks it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from wardspark.llm._shared import cut, join_few, let, scratch, table, text_of

SHARDS = 40
SEED = 20240229
#: A bucket holds about so many rows and bytes; both bound what one group of pass one keeps in memory.
BUCKET_ROWS = 256
BUCKET_BYTES = 8 << 20
#: A row counts as frequent from so many copies on; a task spreads so many copies of it.
OFTEN = 32
COPIES = 4096


def fisher_yates(n: Column, seed: Column) -> Column:
    """A random order of 0 .. n-1: for i = n-1 .. 1 swap places i and j, j drawn from 0 .. i."""

    def swapped(order: Column, i: Column) -> Column:
        j = F.pmod(F.xxhash64(seed, i), i + 1).cast("int")
        return let(
            F.struct(i.alias("i"), j.alias("j")),
            lambda d: F.when(d.i == d.j, order).otherwise(
                F.concat(
                    F.slice(order, 1, d.j),
                    F.array(F.get(order, d.i)),
                    F.slice(order, d.j + 2, d.i - d.j - 1),
                    F.array(F.get(order, d.j)),
                    F.slice(order, d.i + 2, n - d.i - 1),
                )
            ),
        )

    steps = F.when(n > 1, F.sequence(n - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.sequence(F.lit(0), n - 1), swapped)


def _spread(keyed: DataFrame) -> DataFrame:
    """keyed (row, key) with a key of its own for every copy of a frequent row."""
    often = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= OFTEN).select("key"))
    if not often.limit(1).count():
        return keyed
    counted = join_few(keyed, often, ["key"], "left_semi").groupBy("key", "row").agg(F.count(F.lit(1)).alias("n"))
    blocks = counted.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES)))).repartition("key", "block")
    copies = blocks.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(COPIES), F.col("n") - F.col("block") * COPIES))))
    return join_few(keyed, often, ["key"], "left_anti").select("row", "key").union(copies.select("row", F.xxhash64("key", "block", "copy").alias("key")))


def external_shuffle(rows: DataFrame, shards: int, seed: int = SEED, row_bytes: Column | None = None, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(row struct, shard int, slot long) for every row of ``rows``.

    Shards are consecutive runs of the shuffled order with counts at most one
    apart.  row_bytes: the size of a carried row, for the size of the buckets.
    """
    size = F.sum(row_bytes) if row_bytes is not None else F.lit(0)
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(size, F.lit(0))).first()
    buckets = max(1, math.ceil(n / bucket_rows), math.ceil(total / bucket_bytes))
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    scattered = _spread(rows.select(row.alias("row"), F.xxhash64(F.lit(seed), row).alias("key"))).withColumn("bucket", F.pmod("key", F.lit(buckets)))
    grouped = scattered.repartitionByRange("bucket").groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("key", "row"))).alias("rows"))

    # Offsets of the buckets: running sums inside runs of 4096 buckets, then over the runs.
    sizes = cut(scattered.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("run", F.floor(F.col("bucket") / 4096)))
    runs = sizes.groupBy("run").agg(F.sum("n").alias("n"))
    before = runs.select("run", (F.sum("n").over(Window.orderBy("run")) - F.col("n")).alias("run_offset"))
    inside = F.sum("n").over(Window.partitionBy("run").orderBy("bucket")) - F.col("n")
    offsets = cut(sizes.withColumn("inside", inside).join(before, "run").select("bucket", (F.col("run_offset") + F.col("inside")).alias("offset")))

    places = fisher_yates(F.size("rows"), F.xxhash64(F.lit(seed), F.col("bucket")))
    placed = grouped.join(offsets, "bucket").select("offset", F.posexplode(let(F.col("rows"), lambda r: F.transform(places, lambda k: F.get(r, k).row))).alias("place", "row"))
    low, longer = divmod(n, shards)
    p, bound = F.col("p"), longer * (low + 1)
    least = max(low, 1)
    shard = F.when(p < bound, F.floor(p / (low + 1))).otherwise(longer + F.floor((p - bound) / least)).cast("int")
    slot = F.when(p < bound, p % (low + 1)).otherwise((p - bound) % least)
    return placed.withColumn("p", F.col("offset") + F.col("place")).select("row", shard.alias("shard"), slot.alias("slot"))


def shuffled_records(rows: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """external_shuffle of whole records, in buckets bounded by their bytes."""
    return external_shuffle(rows, shards, seed, row_bytes=F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))).cast("long"))


def write_shards(rows: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Writes whole records as Parquet, one folder per shard, in slot order within each of its files."""
    shuffled_records(rows, shards, seed).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, record: T.StructType) -> DataFrame:
    """(row struct, slot long, shard int) of what write_shards wrote."""
    return spark.read.schema(T.StructType().add("row", record).add("slot", T.LongType()).add("shard", T.IntegerType())).parquet(path)


def op7_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the shards of all documents and reads them back; size and text_crc32 are of the text that a shard holds."""
    docs, path = table(spark, sf_dir, "documents"), scratch(spark)
    write_shards(docs, path)
    shards = read_shards(spark, path, docs.schema)
    text = text_of("row.text")
    return shards.select(
        "row.doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast(T.IntegerType()).alias("grown_shard"),
    )
