"""Ordered files of any size, one folder for each key, cut into numbered parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardspark.operators import ranking

#: Rows of a part, unless the caller says otherwise: some megabytes of text.
ROWS = 50_000


def write_parts(df: DataFrame, key: str, order: list[str], text: Column, path: str, head: str = "", between: str = "", foot: str = "", rows: int = ROWS) -> None:
    """The texts of each key in order, as path/key=.../part=N/ with one file each; every part is whole, with head, separators and foot.

    Part N (from 0) holds the places N * rows + 1 to (N + 1) * rows of its key,
    under any layout of df, so a key with all rows is written by all tasks and
    no row is gathered in an array.  Rows without a key are left out; a text of null
    reads as an empty line.  A key without rows has no folder.
    """
    named = df.filter(F.col(key).isNotNull()).select(F.col(key), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.coalesce(text, F.lit("")).alias("value"))
    by = [f"_o{i}" for i in range(len(order))]
    placed = ranking.numbered_within(named, [key], by, "_place").select(key, F.floor((F.col("_place") - 1) / rows).cast("int").alias("part"), "_place", "value")
    of = Window.partitionBy(key, "part").orderBy("_place")  # ``rows`` rows at most
    first, last = F.lag("_place").over(of).isNull(), F.lead("_place").over(of).isNull()
    whole = F.concat(F.when(first, head).otherwise(""), "value", F.when(last, foot).otherwise(between))
    dealt = placed.repartition(key, "part").withColumn("value", whole)
    dealt.sortWithinPartitions(key, "part", "_place").select(key, "part", "value").write.partitionBy(key, "part").text(path)


def part_digests(spark: SparkSession, path: str, **told: Column) -> DataFrame:
    """(key, part, bytes, sha256) of what write_parts left at path, and what ``told`` says of content: a row for each part, whose file one task holds."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(*[c for c in files.columns if c not in ("path", "modificationTime", "length", "content")], F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), *[c.alias(name) for name, c in told.items()])
