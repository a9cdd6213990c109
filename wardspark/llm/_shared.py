"""What the operators of this subpackage share: input tables and the shared scratch folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these (fixed values: space and 0x09-0x0D).
BLANKS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def scratch(spark: SparkSession) -> str:
    """A new path below the folder that the cluster names in spark.checkpoint.dir.

    Only where that is unset (tests, a single machine) a temporary folder takes
    its place.  Files stay until the cluster's own cleaning of that folder,
    since results are read lazily.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared scratch folder and read back: the lineage ends there, and a lost executor loses nothing."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, **options) -> tuple[DataFrame, str]:
    """As cut, with the path, for what can be removed before the operator returns; options: of the files."""
    path = scratch(df.sparkSession)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Removes a written table that nothing reads any more, and lets Spark drop the shuffles of finished jobs, which it does when the driver collects its garbage."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    spark._jvm.System.gc()


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """Batches of n rows at most for the jobs that run inside: whole texts are long, and a batch is held twice on each side."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, n)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda variable is not inlined as a column would be."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: A key counts as hot if it has more than 1 / HOT of the rows; so there are fewer than HOT of them.
HOT = 1000
#: So many rows of a few numbers may be broadcast (some 10 MB); beyond that the join is shuffled.
FEW = 200_000


def join_few(rows: DataFrame, few: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """rows joined with a table of narrow rows that is broadcast only if it is counted to be small."""
    return rows.join(F.broadcast(few) if few.limit(FEW + 1).count() <= FEW else few, on, how)


def join_spread(rows: DataFrame, found: DataFrame, key: str, size: str, value: str) -> DataFrame:
    """rows with ``value`` of found (one row a key; size: how many of rows have the key), null where there is none.

    The hot keys, fewer than HOT by their share of the sizes, are broadcast, and
    their rows are spread evenly in the shuffle that serves all other keys.
    """
    total = found.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    hot = found.filter(F.col(size) > total / HOT).select(key, F.col(value).alias("_hot"), F.lit(True).alias("_is_hot"))
    warm = found.filter(F.col(size) <= total / HOT).select(F.col(key).alias("_key"), F.col(value).alias("_warm"))
    kind = rows.schema[key].dataType
    # A hot or null key gives way to a hash of the row, which cannot give a value: it is marked.
    other = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]).cast("string").cast("binary").cast(kind) if kind.typeName() == "binary" else F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
    marked = rows.join(F.broadcast(hot), key, "left").withColumn("_out", F.coalesce("_is_hot", F.col(key).isNull()))
    joined = marked.withColumn("_key", F.when(F.col("_out"), other).otherwise(F.col(key))).join(warm, "_key", "left")
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], F.when(F.col("_out"), F.col("_hot")).otherwise(F.col("_warm")).alias(value))
