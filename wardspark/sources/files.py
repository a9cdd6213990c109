"""Readers and writers of files that Spark itself opens, so any store that Spark reads will do."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RSS_ITEM = "title string, link string, source string, pubDate string, category array<string>"
WAY = "elements array<struct<type: string, id: long, tags: map<string, string>, geometry: array<struct<lat: double, lon: double>>>>"
FEATURE = "type string, geometry struct<type: string, coordinates: array<array<double>>>, properties map<string, string>"


def shared_path(spark: SparkSession) -> str:
    """A new path in the folder named in spark.checkpoint.dir; a temporary one only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = tempfile.mkdtemp(prefix="spark-files-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df written to a new shared path and read again.  Loops of joins use it rather than checkpoint(), which carries the estimated sizes of all rounds along: they multiply."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpoint_ready(spark: SparkSession) -> None:
    """Sets the folder that checkpoint() needs, only where the session has none."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_path(spark))


# Readers.


def column_named(df: DataFrame, *names: str) -> str:
    """The first column whose name is one of ``names``, by any case; a plan-time check."""
    found = {c.lower(): c for c in reversed(df.columns)}
    for n in names:
        if n.lower() in found:
            return found[n.lower()]
    raise ValueError(f"none of {names} in {df.columns}")


def read_features(spark: SparkSession, path: str, geometry: str, properties: str = "map<string, string>") -> DataFrame:
    """(place, geometry, properties): a row for each feature of the FeatureCollections at path; place is its number there, from 1."""
    schema = f"type string, features array<struct<type: string, geometry: {geometry}, properties: {properties}>>"
    f = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("features").alias("place", "f"))
    return f.select((F.col("place") + 1).alias("place"), "f.geometry", "f.properties")


def property_named(properties: Column, *names: str) -> Column:
    """The value of the first of ``names`` that a feature has among its properties, by any case; null if it has none."""
    lower = F.map_from_entries(F.transform(F.map_entries(properties), lambda e: F.struct(F.lower(e.key).alias("key"), e.value.alias("value"))))
    return F.coalesce(*[F.try_element_at(lower, F.lit(n.lower())) for n in names])


def read_records(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON records of which each may lack any field: a column for each declared one, null where it is absent or not a number where one is due."""
    rows = spark.read.schema(schema).json(path)
    return rows.select(*[F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("double", "float") else f.name for f in rows.schema])


def read_ragged(spark: SparkSession, path: str) -> DataFrame:
    """JSON records whose keys differ: a column for every key that any record has.

    A first pass merges the keys and types of all records on the map side
    (numbers widen, other conflicts become text), a second reads with that schema.
    """
    found = spark.read.option("samplingRatio", 1.0).option("allowNonNumericNumbers", True).json(path).schema
    return read_records(spark, path, found)


def read_roster(spark: SparkSession, path: str, entry: str, field: str | None = None, required: bool = True, largest: int = 5_000) -> DataFrame:
    """The entries of a curated JSON document: a list, or the list under ``field`` of an object; entries lack what they do not name.

    A roster that is not required is empty where its file is absent, unreadable
    or has no such list; of a required one these are errors.  Rosters are written
    by hand, so more than ``largest`` entries are refused: what comes back may be broadcast.
    """
    schema = f"{field} array<struct<{entry}>>, _bad string" if field else f"{entry}, _bad string"
    try:
        raw = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_bad").json(path, multiLine=True)
    except AnalysisException as e:
        if required or e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], entry)
    raw = raw.cache()  # a few entries; Spark asks for it before the column of bad documents is read by itself
    rows = raw.select(F.explode(field).alias("e")).select("e.*") if field else raw.drop("_bad")
    if raw.filter("_bad is not null" if not field else f"_bad is not null or {field} is null").limit(1).count():
        if required:
            raise ValueError(f"{path} is no roster")
        return spark.createDataFrame([], entry)
    if rows.limit(largest + 1).count() > largest:
        raise ValueError(f"{path} has more than {largest} entries")
    return rows


def dated_copies(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of dated files (..._YYYY-MM-DD...) below path, with snapshot_date out of the file name."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).json(path)
    return rows.withColumn("snapshot_date", _date_of(F.col("_metadata.file_path")))


def _date_of(file: Column) -> Column:
    return F.regexp_extract(file, r"_([0-9]{4}-[0-9]{2}-[0-9]{2})[^/]*(?:/[^/]*)?$", 1)


def outer_copies(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As dated_copies, but of the oldest and the newest date only: the listing is a table (no file is opened for it), and no other copy is read."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", _date_of(F.col("path")).alias("day")).filter("day <> ''")
    ends = listing.agg(F.min("day").alias("low"), F.max("day").alias("high"))
    picked = listing.join(F.broadcast(ends), F.col("day").isin(F.col("low"), F.col("high"))).select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.when(F.regexp_extract("path", r"_[0-9]{4}-[0-9]{2}-[0-9]{2}[^/]*(/)", 1) == "", F.col("path")).alias("file"))
    # A copy is a folder or single files; two dates, so a few rows.
    paths = [r.p for r in picked.select(F.coalesce("file", "folder").alias("p")).distinct().collect()]
    if not paths:
        return spark.createDataFrame([], schema).withColumn("snapshot_date", F.lit(None).cast("string"))
    rows = spark.read.schema(schema).json(paths)
    return rows.withColumn("snapshot_date", _date_of(F.col("_metadata.file_path")))


def long_rows(sheet: DataFrame, label: str, order: str) -> DataFrame:
    """(label, year, value) of a sheet with a column for each year: the first row of a label wins, cells that are no numbers go."""
    years = [c for c in sheet.columns if c.isdigit()]
    first = sheet.groupBy(label).agg(F.min_by(F.struct(*[F.col(f"`{y}`") for y in years]), order).alias("cells"))
    cells = F.explode(F.array(*[F.struct(F.lit(int(y)).alias("year"), F.col(f"cells.`{y}`").try_cast("double").alias("value")) for y in years]))
    return first.select(F.col(label).alias("label"), cells.alias("c")).select("label", "c.*").filter("value is not null")


def first_source(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """The rows of the first source that has any, with its name; none if all are empty."""
    both = None
    for k, (name, df) in enumerate(parts):
        df = df.withColumns({"source": F.lit(name), "_priority": F.lit(k)})
        both = df if both is None else both.unionByName(df)
    best = both.agg(F.min("_priority").alias("_priority"))
    return both.join(F.broadcast(best), "_priority", "left_semi").drop("_priority")  # one row


def named_ways(raw: DataFrame) -> DataFrame:
    """(id, name, highway, line) of the ways with a name and two points or more; raw has the column elements."""
    e = raw.select(F.explode("elements").alias("e")).select("e.*").filter("type = 'way'")
    line = F.transform("geometry", lambda p: F.struct(p.lon.alias("x"), p.lat.alias("y")))
    return e.filter((F.size("geometry") >= 2) & F.col("tags")["name"].isNotNull()).select("id", F.col("tags")["name"].alias("name"), F.col("tags")["highway"].alias("highway"), line.alias("line"))


def read_ways(spark: SparkSession, path: str) -> DataFrame:
    return named_ways(spark.read.schema(WAY).json(path, multiLine=True))


def read_members(spark: SparkSession, path: str, schema: str, pattern: str = "*.csv") -> DataFrame:
    """CSV members with a header below path; files of other names (metadata) are skipped."""
    return spark.read.option("header", True).option("escape", '"').option("recursiveFileLookup", True).option("pathGlobFilter", pattern).schema(schema).csv(path)


def latest_period(df: DataFrame) -> DataFrame:
    """The rows of the files whose path has the newest six-digit period; the period is added."""
    dated = df.withColumn("period", F.regexp_extract(F.col("_metadata.file_path"), r"/([0-9]{6})-[^/]*", 1)).filter("period <> ''")
    return dated.join(F.broadcast(dated.agg(F.max("period").alias("period"))), "period", "left_semi")  # one row


def rss_items(items: DataFrame) -> DataFrame:
    """Items with a title and a link; blanks around them go."""
    trimmed = items.withColumns({c: F.trim(F.col(c)) for c in ("title", "link")})
    return trimmed.filter("coalesce(title, '') <> '' and coalesce(link, '') <> ''")


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    return rss_items(spark.read.format("xml").option("rowTag", "item").schema(RSS_ITEM).load(path))


def parsed_items(xml: Column) -> Column:
    """An item held as text."""
    return F.from_xml(xml, RSS_ITEM)


# Writers.


def feature(line: Column, properties: dict[str, Column]) -> Column:
    """A GeoJSON feature as text; coordinates to five places."""
    places = F.transform(line, lambda p: F.array(F.round(p.x, 5), F.round(p.y, 5)))
    held = F.create_map(*[x for k, v in properties.items() for x in (F.lit(k), v.cast("string"))])
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), places.alias("coordinates")).alias("geometry"), held.alias("properties")))


def write_slices(df: DataFrame, keys: DataFrame, key: str, path: str) -> None:
    """One folder for each key of ``keys``, even one without rows (it holds one row of nulls); rows without a key are left out.

    Slices are dealt by key and place in the key, so that a large one is written by several tasks.
    """
    placed = keys.select(key).distinct().join(df.filter(F.col(key).isNotNull()), key, "left")
    placed.repartition(key, F.pmod(F.xxhash64(*[c for c in placed.columns if c != key]), F.lit(8))).write.partitionBy(key).mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, provenance: list[str]) -> None:
    """Quoted CSV with a header; the provenance lines go to the side file ``path``.about."""
    df.write.option("header", True).option("quote", '"').option("escape", '"').mode("overwrite").csv(path)
    df.sparkSession.createDataFrame([(f"# {p}",) for p in provenance], "value string").coalesce(1).write.mode("overwrite").text(path + ".about")


def append_snapshots(runs: DataFrame, path: str) -> None:
    """Adds the dated copies of any number of runs (column snapshot_date) in one write; a day that is there already is replaced, others stay."""
    runs.write.option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").mode("overwrite").parquet(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(folder, file, bytes, sha256) of every file below path; files are hashed one row each, so keep them below 2 GB."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", r"([^/]*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def folder_sizes(files: DataFrame) -> DataFrame:
    return files.groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.min("bytes").alias("least"), F.percentile("bytes", F.lit(0.5)).alias("median"), F.max("bytes").alias("most"))


def over_budget(files: DataFrame, limit: int) -> DataFrame:
    return files.filter(F.col("bytes") > limit)
