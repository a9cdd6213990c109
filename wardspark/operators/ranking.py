"""Ranks, first-wins, top-k and order statistics with stated tie-breaks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardspark.operators import graph
from wardspark.sources import files
from wardspark.sources.files import checkpoint_ready

#: So many rows of one component are gone through in one task (some 50 MB of keys).
LARGEST = 200_000
#: Rows of a partition where tasks sort or hash what they hold (some tens of MB).
SHARE = 500_000


def partitions(df: DataFrame, share: int = SHARE) -> int:
    """So many partitions that each gets about ``share`` rows of df; a count, which tables answer from their footers."""
    return max(1, -(-df.count() // share))


def first_wins(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def top_k(df: DataFrame, keys: list[str], order: list[Column | str], k: int) -> DataFrame:
    """The first k rows of each key, with their rank."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def percentile_rank(df: DataFrame, value: str, tie: str, out: str) -> DataFrame:
    """100 i / (n - 1) by row number among non-null values; ties differ by ``tie``; null with fewer than two values.

    df is a rolled-up dimension (districts), so one window over it is small.
    """
    known = F.col(value).isNotNull()
    w = Window.partitionBy(known).orderBy(value, tie)
    n = F.count(F.lit(1)).over(Window.partitionBy(known))
    return df.withColumn(out, F.when(known & (n > 1), (F.row_number().over(w) - 1) * 100.0 / (n - 1)))


def terciles(df: DataFrame, value: str, out: str) -> DataFrame:
    """low, medium, high by the order statistics at max(0, n/3 - 1) and max(0, 2n/3 - 1) of positive values; the rest is low."""
    cuts = df.filter(F.col(value) > 0).agg(F.array_sort(F.collect_list(value)).alias("v"))
    at = cuts.select(
        F.get("v", F.greatest(F.lit(0), F.floor(F.size("v") / 3).cast("int") - 1)).alias("c1"),
        F.get("v", F.greatest(F.lit(0), F.floor(F.size("v") * 2 / 3).cast("int") - 1)).alias("c2"),
    )
    band = F.when(F.col("c1").isNull() | (F.col(value) <= F.col("c1")), "low").when(F.col(value) <= F.col("c2"), "medium").otherwise("high")
    return df.crossJoin(F.broadcast(at)).withColumn(out, band).drop("c1", "c2")  # one row


def blended(df: DataFrame, columns: list[str], out: str) -> DataFrame:
    """Mean of the columns that are not null."""
    some = F.array_compact(F.array(*columns))
    return df.withColumn(out, F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda a, b: a + b) / F.size(some)))


def numbered(df: DataFrame, order: list[Column | str], out: str) -> DataFrame:
    """df with the place (from 1) of each row in a total order, without gathering all rows in one task.

    Rows are range-partitioned and sorted, written once so that places stay, and
    numbered inside their partition; the sizes of the partitions, one row each,
    give what stands before them.
    """
    checkpoint_ready(df.sparkSession)
    held = df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")).checkpoint()
    sizes = held.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_low"))
    before = sizes.select("_part", "_low", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return held.join(F.broadcast(before), "_part").withColumn(out, (F.col("_before") + F.col("_at") - F.col("_low") + 1).cast("int")).drop("_part", "_at", "_low", "_before")  # a row for each partition


def numbered_within(df: DataFrame, keys: list[str], order: list[Column | str], out: str) -> DataFrame:
    """df with the place (from 1) of each row in its key, where one key may hold all rows.

    Rows are range-partitioned by key and order and written once; a key that runs
    on from earlier partitions can only be the first of a partition, so what
    stands before it is one row for each partition.  Then every task numbers its
    own rows.  Null keys are a key; order should be total within a key.
    """
    checkpoint_ready(df.sparkSession)
    held = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = held.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"))
    carried = runs.select("_part", F.sum("_n").over(earlier).alias(out)).filter(F.col(out) > 0)
    rows = held.join(F.broadcast(carried), "_part", "left").drop("_part")  # a row for each partition

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before = None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            of = [batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for k in keys]
            fresh = np.concatenate([[False], np.any([x[1:] != x[:-1] for x in of], axis=0)])
            key = tuple(batch.column(k)[0] for k in keys)
            if last is None:
                before = batch.column(out)[0].as_py() or 0
            elif last != key:
                before = 0
            start = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
            place = np.arange(n) - start + 1 + np.where(start == 0, before, 0)
            last, before = tuple(batch.column(k)[n - 1] for k in keys), int(place[-1])
            yield batch.set_column(batch.schema.get_field_index(out), out, pa.array(place, pa.int64()))

    return rows.mapInArrow(run, rows.schema)


def filled_down(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """df with ``out``: the last value that is not null at or before each row of its key, in order.

    One key may hold all rows: rows are range-partitioned by key and order and
    written once, each partition gives its last value (a row each), and what a
    partition takes over is the last of those before it, if that has the key the
    partition begins with.  Then every task fills down its own rows.  Null keys
    are a key; rows before the first value of their key have null; order should be total.
    """
    checkpoint_ready(df.sparkSession)
    held = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    row = F.struct(F.struct(*keys).alias("k"), F.struct(*order).alias("o"), F.col(value).alias("v"))
    ends = held.groupBy("_part").agg(F.min(F.struct(*keys)).alias("first"), F.max(F.when(F.col(value).isNotNull(), row)).alias("last"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    carried = ends.select("_part", "first", F.max("last").over(before).alias("c")).select("_part", F.when(F.col("c.k").eqNullSafe(F.col("first")), F.col("c.v")).alias(out))
    rows = held.join(F.broadcast(carried), "_part").drop("_part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            of = [batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy() for k in keys]
            fresh = np.concatenate([[True], np.any([x[1:] != x[:-1] for x in of], axis=0)])
            key = tuple(batch.column(k)[0] for k in keys)
            # What the first row takes over: from the batch before, or from the partitions before; further keys begin anew.
            taken = batch.column(out)[0] if last is None else last[1] if last[0] == key else None
            own = batch.column(value)
            known = own.is_valid().to_numpy(zero_copy_only=False)
            place = np.maximum.accumulate(np.where(known | fresh, np.arange(n), 0))
            filled = own.take(pa.array(place))
            until = int(np.argmax(np.append(known | (fresh & (np.arange(n) > 0)), True)))
            if until and taken is not None and taken.is_valid:
                filled = pa.concat_arrays([pa.repeat(taken, until), filled.slice(until)])
            last = (tuple(batch.column(k)[n - 1] for k in keys), filled[n - 1])
            yield batch.set_column(batch.schema.get_field_index(out), out, filled)

    return rows.mapInArrow(run, rows.schema)


def dedupe_by_either(df: DataFrame, a: str, b: str, order: str, largest: int = LARGEST) -> DataFrame:
    """Rows in order, without those that share a or b with an earlier kept row; null keys share nothing.

    Keys are nodes and a row links its two, so rows of different components
    never decide on each other.  Components come from label propagation, whose
    rounds grow with the logarithm of a chain.  Each is then gone through once, in
    order, in the task that has it: rows stream past and only the keys kept so
    far are held.  A component of more than ``largest`` rows (one hot key, as a
    rule) goes by rounds over the least undecided row of each key instead, where
    keys are only aggregated; these are few wherever keys are hot and not chained.
    """
    node = lambda side, c: F.when(F.col(c).isNotNull(), F.xxhash64(F.lit(side), F.col(c)))  # noqa: E731  a shared hash only joins two components
    state = files.kept(df.select(F.col(order).alias("_o"), F.col(a).alias("_a"), F.col(b).alias("_b"), node("a", a).alias("_na"), node("b", b).alias("_nb")))
    links = files.kept(state.filter("_na is not null and _nb is not null").select(F.col("_na").alias("a"), F.col("_nb").alias("b")).distinct())
    components = graph.clusters(links.select(F.col("a").alias("id")).union(links.select("b")).distinct(), links)
    rows = files.kept(state.withColumn("id", F.coalesce("_na", "_nb", F.xxhash64("_o"))).join(components, "id", "left").select("_o", "_a", "_b", F.coalesce("cluster", "id").alias("_c")))
    big = files.kept(rows.groupBy("_c").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > largest).select("_c"))  # a row for ``largest`` rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen_a, seen_b = None, set(), set()
        for batch in batches:
            kept = []
            for at, x, y, c in zip(range(batch.num_rows), *(batch.column(k).to_pylist() for k in (1, 2, 3))):
                if c != now:
                    now, seen_a, seen_b = c, set(), set()
                if x in seen_a or y in seen_b:
                    continue
                kept.append(at)
                seen_a |= set() if x is None else {x}
                seen_b |= set() if y is None else {y}
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64()))], names=["_o"])

    small = rows.join(F.broadcast(big), "_c", "left_anti").select("_o", "_a", "_b", "_c")
    kept = small.repartition("_c").sortWithinPartitions("_c", "_o").mapInArrow(run, f"_o {rows.schema['_o'].dataType.simpleString()}")
    if not big.isEmpty():
        kept = kept.union(_by_rounds(rows.join(F.broadcast(big), "_c", "left_semi").select("_o", "_a", "_b")))
    return df.join(kept.select(F.col("_o").alias(order)), order, "left_semi")


def _by_rounds(rows: DataFrame) -> DataFrame:
    """(_o) of the rows that stay: a round keeps every row that no undecided row precedes on either key, and drops what shares a key with a kept one; two rounds run between two writes."""
    state = rows.withColumn("_kept", F.lit(None).cast("boolean"))
    while True:
        for _ in range(2):
            first = state
            for key in ("_a", "_b"):
                least = state.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.when(F.col("_kept").isNull(), F.col("_o"))).alias(f"{key}_open"), F.min(F.when(F.col("_kept"), F.col("_o"))).alias(f"{key}_kept"))
                first = first.join(least, key, "left")
            taken = (F.col("_a_kept") < F.col("_o")) | (F.col("_b_kept") < F.col("_o"))
            leads = (F.col("_a").isNull() | (F.col("_a_open") == F.col("_o"))) & (F.col("_b").isNull() | (F.col("_b_open") == F.col("_o")))
            kept = F.when(F.col("_kept").isNotNull(), F.col("_kept")).when(F.coalesce(taken, F.lit(False)), False).when(leads, True)
            state = first.select("_o", "_a", "_b", kept.alias("_kept"))
        state = files.kept(state)
        if not state.filter("_kept is null").limit(1).count():
            return state.filter("_kept").select("_o")
