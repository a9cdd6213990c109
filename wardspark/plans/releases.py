"""Queries on snapshots, sheets, ledgers, exports, published blocks and their gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardspark.functions.scalars import distance, ratio
from wardspark.operators import claims, gates, ranking, spatial
from wardspark.plans.geo import located
from wardspark.plans.registry import query
from wardspark.plans.standins import CELL, FACTS, POINTS, SEGMENTS, facts, points, segments, t, zones
from wardspark.sources import files, parts

# Words of spending that serves riders, and the population of a large city.
MENU_WORDS = ("bike", "bicycle", "traffic calming", "speed hump", "crosswalk", "curb", "pedestrian")


# Sources.


@query(f"""WITH {FACTS}, s AS (SELECT district, year(day) AS y, priority AS category, count(*) AS n FROM facts GROUP BY ALL), b AS (SELECT min(y) AS lo, max(y) AS hi FROM s),
  p AS (SELECT district, category, CAST(coalesce(sum(n) FILTER (y = lo), 0) AS BIGINT) AS o, CAST(coalesce(sum(n) FILTER (y = hi), 0) AS BIGINT) AS w FROM s, b GROUP BY district, category),
  u AS (SELECT district, category, o, w FROM p WHERE o > 0 OR w > 0 UNION ALL SELECT district, 'all', CAST(sum(o) AS BIGINT), CAST(sum(w) AS BIGINT) FROM p GROUP BY district)
  SELECT district, category, w - o AS added, CASE WHEN o > 0 THEN round(100e0 * (w - o) / o, 1) END AS pct, (SELECT CAST(lo AS VARCHAR) || '-01-01' FROM b) AS since FROM u""")
def snapshot_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-8 AGG-14: dated files listed, only the oldest and the newest by their names read; growth in all and by category, a category absent from both left out."""
    path = files.shared_path(spark)
    rows = facts(spark, sf_dir).select(F.struct("id", "district", F.col("priority").alias("category")).alias("r"), F.concat(F.lit("routes_"), F.year("day"), F.lit("-01-01")).alias("copy"))
    rows.select("copy", F.to_json("r").alias("value")).write.partitionBy("copy").text(path)
    s = files.outer_copies(spark, path, "id long, district int, category string")
    b = s.agg(F.min("snapshot_date").alias("lo"), F.max("snapshot_date").alias("hi"))
    part = lambda c: F.count_if(F.col("snapshot_date") == F.col(c))
    each = s.crossJoin(F.broadcast(b)).groupBy("district", "category", "lo").agg(part("lo").alias("o"), part("hi").alias("w"))  # b is one row
    whole = each.groupBy("district", "lo").agg(F.sum("o").alias("o"), F.sum("w").alias("w")).withColumn("category", F.lit("all"))
    u = each.filter("o > 0 or w > 0").unionByName(whole)
    return u.select("district", "category", (F.col("w") - F.col("o")).alias("added"), F.round(ratio(F.col("w") - F.col("o"), F.col("o"), 100.0), 1).alias("pct"), F.col("lo").alias("since"))


_SHEET = f"""{FACTS}, cells AS (SELECT status AS label, year(day) AS y, count(*) AS n FROM facts GROUP BY ALL), u AS (SELECT label, CAST(y AS INTEGER) AS y, CAST(n AS DOUBLE) AS v FROM cells WHERE y <> 1999 OR label <> 'F')"""


def _sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV sheet with a column for each year, written and read as text: a cell that is no number, and labels again further down with other cells."""
    years = list(range(1990, 2011))
    wide = facts(spark, sf_dir).select(F.col("status").alias("label"), F.year("day").alias("y")).groupBy("label").pivot("y", years).agg(F.count(F.lit(1)))
    cells = [F.when((F.col("label") == "F") & F.lit(y == 1999), "n/a").otherwise(F.col(f"`{y}`").cast("string")).alias(str(y)) for y in years]
    first = wide.select(F.lit(0).alias("line"), "label", *cells)
    again = first.select(F.lit(1).alias("line"), "label", *[F.lit("7").alias(str(y)) for y in years])
    path = files.shared_path(spark)
    first.union(again).write.option("header", True).csv(path)
    return spark.read.option("header", True).schema(", ".join(["line int", "label string", *[f"`{y}` string" for y in years]])).csv(path)


@query(f"WITH {_SHEET} SELECT label, y AS year, v AS value FROM u")
def wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-9: a sheet of year columns as long rows; the first row of a label wins, cells that are no numbers go."""
    return files.long_rows(_sheet(spark, sf_dir).select("*"), "label", "line")


@query(f"""WITH {_SHEET} SELECT y AS year, coalesce(sum(v) FILTER (label = 'F'), 0) AS protected, coalesce(sum(v) FILTER (label = 'O'), 0) AS painted, sum(v) FILTER (label IN ('F', 'O')) AS total, coalesce(sum(v) FILTER (label = 'P'), 0) AS upgrade FROM u GROUP BY y HAVING count(*) FILTER (label IN ('F', 'O')) > 0""")
def annual_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-32: miles a year by category out of labelled rows, with the upgrade column beside; a year without any mapped label is left out."""
    long = files.long_rows(_sheet(spark, sf_dir), "label", "line")
    category = F.create_map(*map(F.lit, ("F", "protected", "O", "painted")))[F.col("label")]
    wide = long.withColumn("category", category).groupBy("year")
    of = lambda c: F.coalesce(F.sum(F.when(F.col("category") == c, F.col("value"))), F.lit(0.0))
    out = wide.agg(of("protected").alias("protected"), of("painted").alias("painted"), F.sum(F.when(F.col("category").isNotNull(), F.col("value"))).alias("total"), F.coalesce(F.sum(F.when(F.col("label") == "P", F.col("value"))), F.lit(0.0)).alias("upgrade"))
    return out.filter("total is not null")


@query(f"""WITH {_SHEET}, k AS (SELECT y, round(sum(v) FILTER (label IN ('F', 'O')), 2) AS total, round(max(v) FILTER (label = 'O') + 1.003e0 * max(v) FILTER (label = 'P') + 0.0011e0, 2) AS reported FROM u GROUP BY y)
  SELECT y AS year, total, reported, round(reported - total, 2) AS gap FROM k WHERE reported IS NOT NULL""")
def reported_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-32: the totals that the sheet itself reports stand beside the summed ones, for every year that has one, whatever rows are mapped; neither replaces the other."""
    long = files.long_rows(_sheet(spark, sf_dir), "label", "line")
    # The sheet's own total row, which need not agree with what is mapped (shifted off rounding ties).
    at = lambda label: F.max(F.when(F.col("label") == label, F.col("value")))
    said = long.groupBy("year").agg((at("O") + at("P") * 1.003 + 0.0011).alias("value")).select(F.lit("Total").alias("label"), "year", "value")
    path = files.shared_path(spark)
    said.unionByName(long).select("label", "year", F.col("value").cast("string").alias("cell")).write.option("header", True).csv(path)
    sheet = spark.read.option("header", True).schema("label string, year int, cell string").csv(path).withColumn("value", F.col("cell").try_cast("double"))
    of = lambda *labels: F.round(F.sum(F.when(F.col("label").isin(*labels), F.col("value"))), 2)
    out = sheet.groupBy("year").agg(of("F", "O").alias("total"), of("Total").alias("reported")).filter("reported is not null")
    return out.withColumn("gap", F.round(F.col("reported") - F.col("total"), 2))


@query("""SELECT CAST(year(l_shipdate) AS INTEGER) AS year, round(sum(l_quantity) FILTER (l_returnflag = 'A'), 2) AS a, round(sum(l_quantity) FILTER (l_returnflag = 'N'), 2) AS n, round(coalesce(sum(l_quantity) FILTER (l_returnflag NOT IN ('A', 'N')), 0), 2) AS other, round(coalesce(sum(l_quantity) FILTER (month(l_shipdate) IN (1, 12)), 0), 2) AS without_month FROM lineitem WHERE l_linenumber < 7 GROUP BY 1""")
def surviving_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-33: what stands by year of install and category, and how much of it has no known month; rows without a year do not count."""
    li = t(spark, sf_dir, "lineitem").select("l_quantity", "l_returnflag", F.when(F.col("l_linenumber") < 7, F.year("l_shipdate")).alias("year"), F.when(~F.month("l_shipdate").isin(1, 12), F.month("l_shipdate")).alias("month"))
    of = lambda c: F.round(F.sum(F.when(c, F.col("l_quantity"))), 2)
    flag = F.col("l_returnflag")
    g = li.filter("year > 0").groupBy("year").agg(of(flag == "A").alias("a"), of(flag == "N").alias("n"), of(~flag.isin("A", "N")).alias("other"), of(F.col("month").isNull()).alias("without_month"))
    return g.fillna(0.0, ["other", "without_month"])


@query("""SELECT page_id AS item, trim(regexp_extract(html, '<title>([^<]*)</title>', 1), ' ') AS title, url AS link, 'lang ' || regexp_extract(html, 'lang="([a-z]*)"', 1) || ';page' AS categories FROM pages WHERE trim(regexp_extract(html, '<title>([^<]*)</title>', 1), ' ') <> '' AND page_id % 10 <> 0""")
def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-10: feeds written as XML in order, in parts of bounded size, and scanned by their items, with their categories; those without title or link go."""
    safe = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    p = t(spark, sf_dir, "pages")
    title, lang = safe(F.regexp_extract("html", r"<title>([^<]*)</title>", 1)), F.regexp_extract("html", r'lang="([a-z]*)"', 1)
    link = F.when(F.col("page_id") % 10 != 0, F.concat(F.lit("<link>"), safe(F.col("url")), F.lit("</link>"))).otherwise("")
    item = F.concat(F.lit("<item><title>"), title, F.lit("</title>"), link, F.lit("<source>"), F.col("page_id"), F.lit("</source><category>lang "), lang, F.lit("</category><category>page</category></item>"))
    path = files.shared_path(spark)
    parts.write_parts(p.select("page_id", (F.col("page_id") % 8).alias("feed"), item.alias("item")), "feed", ["page_id"], F.col("item"), path, "<rss><channel>", "", "</channel></rss>")
    return files.read_rss(spark, path).select(F.col("source").cast("long").alias("item"), "title", "link", F.array_join("category", ";").alias("categories"))


@query("""SELECT n_nationkey AS id, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_orderdate >= TIMESTAMP '2030-01-01') THEN 'fresh' ELSE 'curated' END AS source FROM nation""")
def first_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-13: the rows of the first source that has any: a fresh pull (none here), else what is curated, else an older list."""
    fresh = t(spark, sf_dir, "orders").filter("o_orderdate >= timestamp'2030-01-01'").select(F.col("o_orderkey").cast("int").alias("id"))
    curated = t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"))
    older = t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"))
    return files.first_source([("fresh", fresh), ("curated", curated), ("older", older)])


@query("""SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP '1998-01-01'""")
def typed_and_dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-10: rows of one type since a date, both conditions pushed to the scan."""
    o = t(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT' and o_orderdate >= timestamp'1998-01-01'")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))


# Sinks.


@query("""SELECT n_nationkey AS id, n_name AS name, r_name AS area, CAST((SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS BIGINT) AS customers FROM nation JOIN region ON r_regionkey = n_regionkey""")
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-1: a document for each district with nested fields, written as JSON and read back by its declared schema."""
    c = t(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.count(F.lit(1)).alias("customers"))
    n = t(spark, sf_dir, "nation").join(t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).join(c, F.col("id") == F.col("n_nationkey"), "left")
    path = files.shared_path(spark)
    n.select(F.col("n_nationkey").alias("id"), F.struct(F.col("n_name").alias("name"), F.col("r_name").alias("area")).alias("about"), F.coalesce("customers", F.lit(0)).alias("customers")).write.json(path)
    return spark.read.schema("id int, about struct<name: string, area: string>, customers long").json(path).select("id", "about.name", "about.area", "customers")


@query(f"""WITH {FACTS}, f AS (SELECT CASE WHEN id % 10 <> 3 THEN district END AS district, count(*) AS n FROM facts GROUP BY 1) SELECT n_nationkey AS district, coalesce(n, 0) AS n, (SELECT n FROM f WHERE district IS NULL) AS excluded FROM nation LEFT JOIN f ON district = n_nationkey""")
def written_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-2: a slice for each district, even an empty one; rows without a district are in none and are counted."""
    keys, path = t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("district")), files.shared_path(spark)
    rows = facts(spark, sf_dir).select("id", F.when(F.col("id") % 10 != 3, F.col("district")).alias("district"))
    files.write_slices(rows, keys, "district", path)
    excluded = rows.filter("district is null").agg(F.count(F.lit(1)).alias("excluded"))
    return spark.read.parquet(path).groupBy("district").agg(F.count("id").alias("n")).crossJoin(F.broadcast(excluded))  # one row


# Columns of the rows, in order (fixed values).
CRASH_COLUMNS = ("crash_id", "lat", "lng", "injury_severity")
_CRASH_HEAD = '{"columns":["' + '","'.join(CRASH_COLUMNS) + '"],"rows":['


@query(f"""WITH {POINTS}, p AS (SELECT zone, event_id, '[' || CAST(event_id AS VARCHAR) || ',' || printf('%.5f', 41.64e0 + lat_i / 1e4) || ',' || printf('%.5f', -87.85e0 + lon_i / 1e4) || ',"' || severity || '"]' AS r FROM points),
  k AS (SELECT *, (row_number() OVER (PARTITION BY zone ORDER BY event_id) - 1) // {parts.ROWS} AS part FROM p)
  SELECT zone, CAST(part AS INTEGER) AS part, count(*) AS n, sha256('{_CRASH_HEAD}' || string_agg(r, ',' || chr(10) ORDER BY event_id) || ']}}' || chr(10)) AS rows_sha256 FROM k GROUP BY zone, part""")
def columnar_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-3: rows as arrays of a fixed column order (lat before lng, to five places) in source order, written in parts of bounded size; what comes back is each part's rows and the digest of its file."""
    k = F.col("event_id")
    lat, lng = 41.64 + ((k * 104729) % 3800) / 1e4, -87.85 + ((k * 7919) % 3300) / 1e4
    row = F.format_string('[%d,%.5f,%.5f,"%s"]', k, lat, lng, F.col("severity"))
    path = files.shared_path(spark)
    parts.write_parts(located(spark, sf_dir).filter("zone is not null"), "zone", ["event_id"], row, path, _CRASH_HEAD, ",", "]}")
    # Parsed from the bytes in hand: a reader of files goes back to the file for each row that it keeps as text.
    rows = F.size(F.from_json(F.col("content").cast("string"), "rows array<string>").rows).cast("long")
    return parts.part_digests(spark, path, n=rows).select("zone", "part", "n", F.col("sha256").alias("rows_sha256"))


@query("""WITH v AS (SELECT l_orderkey AS matter, count(*) FILTER (l_returnflag = 'A') AS yes, count(*) FILTER (l_returnflag = 'R') AS no, array_to_string(list_sort(list(DISTINCT lpad(CAST(l_suppkey AS VARCHAR), 6, '0'))), '; ') AS sponsors FROM lineitem GROUP BY 1)
  SELECT o_orderkey AS matter, strftime(o_orderdate, '%Y-%m-%d') AS intro_date, coalesce(sponsors, '') AS sponsors, CASE WHEN o_orderkey % 2 = 0 THEN 'legistar' ELSE 'b' END AS source, CASE WHEN yes + no > 0 THEN CAST(yes AS VARCHAR) || '–' || CAST(no AS VARCHAR) || CASE WHEN yes > no THEN ' passed' ELSE ' failed' END ELSE '' END AS vote FROM orders LEFT JOIN v ON matter = o_orderkey""")
def council_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-6: council rows for export: date cut to the day, sponsors joined, a default source, the vote as text or empty."""
    flag = lambda c: F.count_if(F.col("l_returnflag") == c)
    v = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("matter")).agg(flag("A").alias("yes"), flag("R").alias("no"), F.array_sort(F.collect_set(F.lpad(F.col("l_suppkey").cast("string"), 6, "0"))).alias("s"))
    o = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("matter"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("intro_date"), F.when(F.col("o_orderkey") % 2 == 1, "b").alias("source"))
    vote = F.when(F.col("yes") + F.col("no") > 0, F.concat(F.col("yes"), F.lit("–"), F.col("no"), F.when(F.col("yes") > F.col("no"), " passed").otherwise(" failed")))
    return o.join(v, "matter", "left").select("matter", "intro_date", F.coalesce(F.array_join("s", "; "), F.lit("")).alias("sponsors"), F.coalesce("source", F.lit("legistar")).alias("source"), F.coalesce(vote, F.lit("")).alias("vote"))


_INDEX = f"""{POINTS}, r AS (SELECT zone, count(*) AS n, count(*) FILTER (severity = 'fatal') AS fatal FROM points GROUP BY zone),
  m AS (SELECT zone, n, CASE WHEN zone % 7 <> 0 THEN n * 1e4 / (1000 + zone * 13) END AS capita, CASE WHEN fatal > 0 THEN n * 1e0 / fatal END AS mile FROM r),
  k AS (SELECT *, CASE WHEN capita IS NOT NULL AND count(capita) OVER () > 1 THEN (row_number() OVER (PARTITION BY capita IS NULL ORDER BY capita, zone) - 1) * 100e0 / (count(capita) OVER () - 1) END AS a, CASE WHEN mile IS NOT NULL AND count(mile) OVER () > 1 THEN (row_number() OVER (PARTITION BY mile IS NULL ORDER BY mile, zone) - 1) * 100e0 / (count(mile) OVER () - 1) END AS b FROM m),
  d AS (SELECT zone, n, round(CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE (a + b) / 2 END, 1) AS score FROM k), idx AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC NULLS LAST, zone) AS INTEGER) AS rank FROM d)"""


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = located(spark, sf_dir).groupBy("zone").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "fatal").alias("fatal"))
    r = r.withColumns({"capita": F.when(F.col("zone") % 7 != 0, F.col("n") * 1e4 / (1000 + F.col("zone") * 13)), "mile": ratio(F.col("n"), F.col("fatal"))})
    r = ranking.percentile_rank(ranking.percentile_rank(r, "capita", "zone", "a"), "mile", "zone", "b")
    d = ranking.blended(r, ["a", "b"], "score").select("zone", "n", F.round("score", 1).alias("score"))
    return d.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc_nulls_last(), "zone")))  # fifty zones


@query(f"WITH {_INDEX} SELECT rank, zone, n AS incidents, score FROM idx")
def safety_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-6 WIN-1 WIN-2 WIN-4: the index for export: the mean of the ranks by head and by mile that exist, and the place in that order, nulls last."""
    return _index(spark, sf_dir).select("rank", "zone", F.col("n").alias("incidents"), "score")


@query(f"""WITH {_INDEX}, top AS (SELECT n AS most FROM idx ORDER BY n DESC LIMIT 1) SELECT zone, CASE WHEN n <= most * 0.25e0 THEN 0 WHEN n <= most * 0.5e0 THEN 1 WHEN n <= most * 0.75e0 THEN 2 ELSE 3 END AS step,
  CASE WHEN score IS NULL THEN 'none' WHEN score >= 80 THEN 'highest' WHEN score >= 60 THEN 'high' WHEN score >= 40 THEN 'middle' WHEN score >= 20 THEN 'low' ELSE 'lowest' END AS band FROM idx, top""")
def steps_and_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-25: the quarter of the largest count that a zone falls in, and the band of its score."""
    i = _index(spark, sf_dir)
    most = i.agg(F.max("n").alias("most"))
    j = i.crossJoin(F.broadcast(most))  # one row
    part = F.col("n") / F.col("most")
    step = F.when((F.col("most") <= 0) | (part <= 0.25), 0).when(part <= 0.5, 1).when(part <= 0.75, 2).otherwise(3)
    band = F.when(F.col("score").isNull(), "none").when(F.col("score") >= 80, "highest").when(F.col("score") >= 60, "high").when(F.col("score") >= 40, "middle").when(F.col("score") >= 20, "low").otherwise("lowest")
    return j.select("zone", step.alias("step"), band.alias("band"))


@query(f"""WITH {FACTS}, l AS (SELECT district, CAST(id AS VARCHAR) || chr(10) AS line, id FROM facts), f AS (SELECT district, string_agg(line, '' ORDER BY id) AS body FROM l GROUP BY district), s AS (SELECT district, CAST(strlen(body) AS BIGINT) AS bytes, sha256(body) AS sha256 FROM f),
  a AS (SELECT count(*) AS files, min(bytes) AS least, median(bytes) AS middle, max(bytes) AS most FROM s)
  SELECT 'district=' || CAST(district AS VARCHAR) AS folder, bytes, sha256, bytes > 3000 AS over_budget, files, least, middle, most FROM s, a""")
def output_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-10 DQ-5: a file of each district with bytes and digest, whether it is over its budget, and least, middle and most bytes of the family."""
    path = files.shared_path(spark)
    one = facts(spark, sf_dir).select("district", "id").repartition("district").sortWithinPartitions("district", "id")
    one.select("district", F.col("id").cast("string").alias("value")).write.partitionBy("district").text(path)
    m = files.manifest(spark, path).filter("file like 'part-%'")
    over = files.over_budget(m, 3000).select("folder", F.lit(True).alias("over_budget"))
    family = files.folder_sizes(m.withColumn("folder", F.lit("districts"))).select("files", "least", F.col("median").alias("middle"), "most")
    return m.join(over, "folder", "left").crossJoin(F.broadcast(family)).select("folder", "bytes", "sha256", F.coalesce("over_budget", F.lit(False)).alias("over_budget"), "files", "least", "middle", "most")  # one row


@query("""WITH u AS (SELECT 'orders' AS source, count(*) AS records, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day FROM orders UNION ALL SELECT 'events', count(*), strftime(max(ts), '%Y-%m-%d') FROM events) SELECT * FROM u WHERE records > 0 UNION ALL SELECT 'pages', 1, '2020-01-01'""")
def upserted_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-11: a catalogue of earlier runs with what this run found put in its place; sources not touched stay."""
    old = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(s).alias("source"), F.lit(1).cast("long").alias("records"), F.lit("2020-01-01").alias("last_day")) for s in ("orders", "pages")])).alias("r")).select("r.*")
    fresh = None
    for name, day in (("orders", "o_orderdate"), ("events", "ts")):
        row = t(spark, sf_dir, name).agg(F.lit(name).alias("source"), F.count(F.lit(1)).alias("records"), F.date_format(F.max(day), "yyyy-MM-dd").alias("last_day")).filter("records > 0")
        fresh = row if fresh is None else fresh.unionByName(row)
    return old.join(fresh.select("source"), "source", "left_anti").unionByName(fresh)


# Trimmed and joined documents.


@query(f"""WITH {FACTS}, n AS (SELECT district, count(*) AS n FROM facts GROUP BY 1) SELECT n_nationkey AS district, coalesce(n, 0) AS n, 'https://api/wards/ward-' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || '.json' AS detail_url,
  coalesce((SELECT array_to_string(list(CAST(s_suppkey AS VARCHAR) ORDER BY s_suppkey), ',') FROM supplier WHERE s_nationkey = n_nationkey), '') AS routes, 'district,n,matches,detail_url' AS fields FROM nation LEFT JOIN n ON district = n_nationkey""")
def trimmed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-15 FN-23: records of the index without their monthly series, matches cut to ids (no matcher configuration, no evidence), and the address of the detail."""
    months = facts(spark, sf_dir).groupBy("district", F.date_format("day", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    monthly = months.groupBy("district").agg(F.collect_list(F.struct("month", "n")).alias("monthly"), F.sum("n").alias("n"))
    s = t(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("district")).agg(F.collect_list(F.struct(F.col("s_suppkey").alias("id"), F.lit("headline").alias("via"))).alias("routes"))
    matches = F.struct(F.coalesce("routes", F.array().cast("array<struct<id:bigint,via:string>>")).alias("routes"), F.lit("(?i)x").alias("pattern"))
    whole = t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("district")).join(monthly, "district", "left").join(s, "district", "left").select("district", F.coalesce("n", F.lit(0)).alias("n"), "monthly", matches.alias("matches"))
    entry = whole.drop("monthly").withColumn("matches", F.col("matches").dropFields("pattern")).withColumn("matches", F.col("matches").withField("routes", F.array_sort(F.transform("matches.routes", lambda r: r.id))))
    entry = entry.withColumn("detail_url", F.concat(F.lit("https://api/wards/ward-"), F.lpad(F.col("district").cast("string"), 2, "0"), F.lit(".json")))
    return entry.select("district", "n", "detail_url", F.array_join(F.transform("matches.routes", lambda r: r.cast("string")), ",").alias("routes"), F.lit(",".join(entry.columns)).alias("fields"))


_STAR = f"""{FACTS}, a AS (SELECT district, count(*) AS n FROM facts GROUP BY 1), s AS (SELECT s_nationkey AS district, count(*) AS n FROM supplier WHERE s_nationkey % 4 <> 1 GROUP BY 1), c AS (SELECT c_nationkey AS district, count(*) AS n FROM customer GROUP BY 1),
  m AS (SELECT s_nationkey AS district, round(sum(l_extendedprice), 2) AS spent FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_discount > 0.05e0 AND s_nationkey % 5 <> 2 GROUP BY 1), q AS (SELECT user_id % 25 AS district, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1), r AS (SELECT user_id % 25 AS district, CAST(sum(value * 100) AS BIGINT) AS n FROM events WHERE event_type = 'click' AND user_id % 25 <> 7 GROUP BY 1),
  b AS (SELECT c_nationkey AS district, c_mktsegment AS sponsor, count(*) AS n FROM customer WHERE c_nationkey % 6 <> 4 GROUP BY ALL), e AS (SELECT district, string_agg(sponsor || ':' || CAST(n AS VARCHAR), ';' ORDER BY sponsor) AS entries FROM b GROUP BY district)"""


@query(f"""WITH {_STAR} SELECT n_nationkey AS district, n_name AS name, r_name AS area, c.n AS population, coalesce(a.n, 0) AS incidents, round(a.n * 1000e0 / c.n, 3) AS per_1000, CASE WHEN s.n IS NULL THEN 'false' ELSE 'true:' || CAST(s.n AS VARCHAR) END AS roster, CASE WHEN m.spent IS NULL THEN 'false' ELSE 'true' END AS menu, m.spent AS menu_spent,
  coalesce(q.n, 0) AS requests, CASE WHEN r.n IS NULL THEN 'false' ELSE 'true' END AS trips, coalesce(entries, '') AS sponsorship, CASE WHEN s.n IS NULL THEN 'No roster entry for district ' || CAST(n_nationkey AS VARCHAR) END AS roster_note FROM nation JOIN region ON r_regionkey = n_regionkey LEFT JOIN a ON a.district = n_nationkey LEFT JOIN s ON s.district = n_nationkey LEFT JOIN c ON c.district = n_nationkey LEFT JOIN m ON m.district = n_nationkey LEFT JOIN q ON q.district = n_nationkey LEFT JOIN r ON r.district = n_nationkey LEFT JOIN e ON e.district = n_nationkey""")
def district_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-26 JON-14 FLT-14: every district with safety, roster, sponsorship, menu, requests and trips; an absent branch is a struct that says so, not a zero, no sponsorship is an empty list, and a missing roster entry is noted. Each side is rolled up before it is joined."""
    key = lambda c: F.col(c).cast("long").alias("district")
    count = F.count(F.lit(1))
    a = facts(spark, sf_dir).groupBy(key("district")).agg(count.alias("incidents"))
    sup = t(spark, sf_dir, "supplier")
    s = sup.filter("s_nationkey % 4 <> 1").groupBy(key("s_nationkey")).agg(F.struct(F.lit(True).alias("available"), count.alias("members")).alias("roster"))
    c = t(spark, sf_dir, "customer").groupBy(key("c_nationkey")).agg(count.alias("population"))
    li = t(spark, sf_dir, "lineitem").filter("l_discount > 0.05").join(sup.filter("s_nationkey % 5 <> 2"), F.col("l_suppkey") == F.col("s_suppkey"))
    m = li.groupBy(key("s_nationkey")).agg(F.struct(F.lit(True).alias("available"), F.round(F.sum("l_extendedprice"), 2).alias("spent")).alias("menu"))
    e = t(spark, sf_dir, "events").withColumn("d", F.col("user_id") % 25)
    q = e.filter("event_type = 'view'").groupBy(key("d")).agg(count.alias("requests"))
    r = e.filter("event_type = 'click' and d <> 7").groupBy(key("d")).agg(F.struct(F.lit(True).alias("available"), F.sum("value").alias("n")).alias("trips"))
    n = t(spark, sf_dir, "nation").join(t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(key("n_nationkey"), F.col("n_name").alias("name"), F.col("r_name").alias("area"))
    by = t(spark, sf_dir, "customer").filter("c_nationkey % 6 <> 4").groupBy(key("c_nationkey"), F.col("c_mktsegment").alias("sponsor")).agg(count.alias("n"))
    b = by.groupBy("district").agg(F.array_sort(F.collect_list(F.struct("sponsor", "n"))).alias("entries"))  # a row for each sponsor of the roster
    for branch in (a, s, c, m, q, r, b):
        n = n.join(branch, "district", "left")
    for name, field in (("roster", "members"), ("menu", "spent"), ("trips", "n")):
        kind = dict(n.select(f"{name}.*").dtypes)[field]
        n = n.withColumn(name, F.coalesce(name, F.struct(F.lit(False).alias("available"), F.lit(None).cast(kind).alias(field))))
    told = F.when(F.col("roster.available"), F.concat(F.lit("true:"), F.col("roster.members"))).otherwise("false")
    return n.select(
        F.col("district").cast("int").alias("district"), "name", "area", "population", F.coalesce("incidents", F.lit(0)).alias("incidents"), F.round(ratio(F.col("incidents"), F.col("population"), 1000.0), 3).alias("per_1000"),
        told.alias("roster"), F.col("menu.available").cast("string").alias("menu"), F.col("menu.spent").alias("menu_spent"), F.coalesce("requests", F.lit(0)).alias("requests"), F.col("trips.available").cast("string").alias("trips"),
        F.coalesce(F.array_join(F.transform("entries", lambda x: F.concat(x.sponsor, F.lit(":"), x.n)), ";"), F.lit("")).alias("sponsorship"), F.when(~F.col("roster.available"), F.concat(F.lit("No roster entry for district "), F.col("district"))).alias("roster_note"),
    )


@query("""WITH w AS (SELECT l_orderkey AS item, list(DISTINCT l_suppkey % 50) AS wards FROM lineitem GROUP BY 1) SELECT n_nationkey AS ward, o_orderkey AS item, strftime(o_orderdate, '%Y-%m-%d') AS published FROM w JOIN orders ON o_orderkey = item JOIN nation ON list_contains(wards, n_nationkey)""")
def news_of_ward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-17: items whose nested matches name a ward, for each ward; the array is unnested and joined, so no item meets every ward."""
    w = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("item")).agg(F.struct(F.collect_set(F.struct((F.col("l_suppkey") % 50).alias("ward"))).alias("wards")).alias("matches"))
    o = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("published"))
    wards = t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("ward"))
    return w.select("item", F.explode("matches.wards").alias("m")).select("item", "m.ward").join(wards, "ward").join(o, "item").select(F.col("ward").cast("int").alias("ward"), "item", "published")


@query("""WITH r AS (SELECT DISTINCT l_suppkey AS member, l_linenumber AS line FROM lineitem WHERE l_linenumber <= 3 AND l_suppkey % 5 = 0) SELECT s_suppkey AS member, CASE WHEN s_suppkey IN (SELECT member FROM r) THEN 'roster' ELSE 'other' END AS side, (SELECT min(line) FROM r WHERE member = s_suppkey) AS first_line, (SELECT array_to_string(list(CAST(line AS VARCHAR) ORDER BY line), ',') FROM r WHERE member = s_suppkey) AS lines FROM supplier""")
def roster_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-30 AGG-44: members on a roster line with their lines in order, split from the others by a semi and an anti join."""
    r = t(spark, sf_dir, "lineitem").filter("l_linenumber <= 3 and l_suppkey % 5 = 0").select(F.col("l_suppkey").alias("member"), F.col("l_linenumber").alias("line")).distinct()
    index = r.groupBy("member").agg(F.array_sort(F.collect_list("line")).alias("v"))
    s = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("member"))
    on = s.join(index, "member").select("member", F.lit("roster").alias("side"), F.get("v", F.lit(0)).alias("first_line"), F.array_join(F.transform("v", lambda x: x.cast("string")), ",").alias("lines"))
    return on.unionByName(s.join(r, "member", "left_anti").withColumn("side", F.lit("other")), allowMissingColumns=True)


@query("""WITH n AS (SELECT l_orderkey AS node, list_sort(list(DISTINCT l_suppkey % 12)) AS lines FROM lineitem GROUP BY 1), k AS (SELECT range AS line FROM range(0, 12)) SELECT line, node, array_to_string(lines, '|') AS lines FROM n JOIN k ON list_contains(lines, line) WHERE len(lines) >= 2""")
def interchanges_of_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-32: the nodes that a line shares with another one, for each line, with all lines of the node."""
    n = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("node")).agg(F.array_sort(F.collect_set(F.col("l_suppkey") % 12)).alias("v")).filter(F.size("v") >= 2)
    return n.select(F.explode("v").alias("line"), "node", F.array_join(F.transform("v", lambda x: x.cast("string")), "|").alias("lines"))


# Rollups.


@query(f"""WITH {SEGMENTS}, p AS (SELECT corridor % 5 AS category, CASE WHEN seg_id % 4 = 0 THEN 'n/a' WHEN seg_id % 4 = 1 THEN NULL ELSE CAST(seg_id % 10 AS VARCHAR) END AS said, sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)) / 1609.34e0 AS measured FROM segments)
  SELECT category, round(coalesce(sum(TRY_CAST(said AS DOUBLE)), 0), 3) AS said, round(sum(CASE WHEN said IS NULL THEN measured ELSE coalesce(TRY_CAST(said AS DOUBLE), 0) END), 3) AS miles FROM p GROUP BY category""")
def miles_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-12: miles by category, as the source says where it says so, else as measured; what is said and is no number is skipped."""
    k = F.col("seg_id")
    said = F.when(k % 4 == 0, "n/a").when(k % 4 != 1, (k % 10).cast("string"))
    p = segments(spark, sf_dir).select((F.col("corridor") % 5).alias("category"), said.alias("said"), (distance(*(F.col(c) for c in spatial.LINE)) / 1609.34).alias("measured"))
    miles = F.when(F.col("said").isNull(), F.col("measured")).otherwise(F.coalesce(F.col("said").try_cast("double"), F.lit(0.0)))
    return p.groupBy("category").agg(F.round(F.coalesce(F.sum(F.col("said").try_cast("double")), F.lit(0.0)), 3).alias("said"), F.round(F.sum(miles), 3).alias("miles"))


@query(f"""WITH {POINTS}, k AS (SELECT zone, event_type, count(*) AS n FROM points GROUP BY ALL) SELECT zone, CAST(sum(n) AS BIGINT) AS total, array_to_string(list(event_type || '=' || CAST(n AS VARCHAR) ORDER BY event_type), ', ') AS by_type FROM k GROUP BY zone""")
def requests_by_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-15: the total of each zone and a map of its types."""
    k = located(spark, sf_dir).groupBy("zone", "event_type").agg(F.count(F.lit(1)).alias("n"))
    m = k.groupBy("zone").agg(F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("m"))
    return m.select("zone", "total", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e.key, F.lit("="), e.value)), ", ").alias("by_type"))


@query(f"""WITH {POINTS}, s AS (SELECT event_id, CASE WHEN user_id % 3 <> 0 THEN CAST(user_id AS VARCHAR) END AS sid, 'Station ' || CAST(user_id % 40 AS VARCHAR) AS name, CASE WHEN event_id % 4 <> 0 THEN x END AS x, CASE WHEN event_id % 4 <> 0 THEN y END AS y FROM points),
  g AS (SELECT coalesce(sid, name) AS station, count(*) AS trips, arg_min(x, event_id) FILTER (x IS NOT NULL) AS x, arg_min(y, event_id) FILTER (x IS NOT NULL) AS y FROM s GROUP BY 1) SELECT station, trips, round(x, 3) AS x, round(y, 3) AS y FROM g""")
def station_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-17: trips of each station, by its id or else its name, with the first coordinate that is not null."""
    p, k = points(spark, sf_dir), F.col("event_id")
    place = F.when(k % 4 != 0, F.struct("x", "y"))
    key = F.coalesce(F.when(F.col("user_id") % 3 != 0, F.col("user_id").cast("string")), F.concat(F.lit("Station "), F.col("user_id") % 40))
    first = F.min(F.when(place.isNotNull(), F.struct(k.alias("k"), place.alias("p")))).alias("f")
    return p.groupBy(key.alias("station")).agg(F.count(F.lit(1)).alias("trips"), first).select("station", "trips", F.round("f.p.x", 3).alias("x"), F.round("f.p.y", 3).alias("y"))


@query("""WITH i AS (SELECT CASE WHEN l_suppkey % 9 <> 4 THEN l_suppkey END AS ward, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity END AS cost, CASE WHEN l_linenumber <> 6 THEN l_tax * 100 END AS amount, CASE l_linenumber % 4 WHEN 0 THEN 'New BIKE racks' WHEN 1 THEN 'Speed hump' WHEN 2 THEN 'Lighting' END AS category FROM lineitem),
  v AS (SELECT ward, coalesce(cost, amount, 0) AS c, regexp_matches(lower(coalesce(category, '')), 'bike|bicycle|traffic calming|speed hump|crosswalk|curb|pedestrian') AS safe FROM i WHERE ward IS NOT NULL) SELECT ward, round(sum(c), 2) AS spent, count(*) AS items, round(sum(c) FILTER (safe), 2) AS safety_spent FROM v GROUP BY ward""")
def menu_spending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-18: spending by ward, the cost or else the amount; the part whose category has a keyword, null where none has; rows without a ward go."""
    n = F.col("l_linenumber")
    category = F.when(n % 4 == 0, "New BIKE racks").when(n % 4 == 1, "Speed hump").when(n % 4 == 2, "Lighting")
    i = t(spark, sf_dir, "lineitem").select(F.when(F.col("l_suppkey") % 9 != 4, F.col("l_suppkey")).alias("ward"), F.when(n % 3 != 0, F.col("l_quantity")).alias("cost"), F.when(n != 6, F.col("l_tax") * 100).alias("amount"), category.alias("category"))
    c = F.coalesce("cost", "amount", F.lit(0.0))
    safe = F.coalesce(F.rlike(F.lower("category"), F.lit("|".join(MENU_WORDS))), F.lit(False))
    return i.filter("ward is not null").groupBy("ward").agg(F.round(F.sum(c), 2).alias("spent"), F.count(F.lit(1)).alias("items"), F.round(F.sum(F.when(safe, c)), 2).alias("safety_spent"))


# Route report cards: lines of a roster, members graded, line 0 a trail; lines 12 and 13 have no member.
_GRADED = """g AS (SELECT l_suppkey % 12 AS line, 'Street ' || CAST(l_partkey % 7 AS VARCHAR) AS label, CASE WHEN l_discount >= 0.08 THEN 'A' WHEN l_discount >= 0.05 THEN 'B' WHEN l_discount >= 0.02 THEN 'C' ELSE 'D' END AS grade, CAST(l_quantity AS DOUBLE) AS meters, CASE WHEN l_suppkey % 12 <> 0 THEN l_linenumber END AS incidents FROM lineitem), lines AS (SELECT CAST(range AS BIGINT) AS line FROM range(0, 14))"""


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("l_discount")
    grade = F.when(d >= 0.08, "A").when(d >= 0.05, "B").when(d >= 0.02, "C").otherwise("D")
    line = (F.col("l_suppkey") % 12).alias("line")
    return t(spark, sf_dir, "lineitem").select(line, F.concat(F.lit("Street "), F.col("l_partkey") % 7).alias("label"), grade.alias("grade"), F.col("l_quantity").cast("double").alias("meters"), F.when(F.col("l_suppkey") % 12 != 0, F.col("l_linenumber")).alias("incidents"))


@query(f"""WITH {_GRADED}, k AS (SELECT line, grade, sum(meters) / 1609.34e0 AS m, CAST(sum(incidents) AS BIGINT) AS i FROM g GROUP BY ALL), c AS (SELECT line, sum(m) AS miles, CAST(sum(i) AS BIGINT) AS i, coalesce(sum(m) FILTER (grade = 'A'), 0) AS a, array_to_string(list(grade || '=' || printf('%.2f', m) ORDER BY grade), ', ') AS by_grade FROM k GROUP BY line)
  SELECT line, round(coalesce(miles, 0), 2) AS miles, coalesce(by_grade, '') AS by_grade, CASE WHEN line <> 0 AND miles > 0 THEN round(100 * a / miles, 1) END AS pct_protected, CASE WHEN line <> 0 THEN coalesce(i, 0) END AS incidents, miles IS NULL AS no_data FROM lines LEFT JOIN c USING (line)""")
def report_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-25: of each line of the roster miles in all and by grade, the protected share and incidents, which a trail (line 0) omits; a line without members says so."""
    k = _graded(spark, sf_dir).groupBy("line", "grade").agg((F.sum("meters") / 1609.34).alias("m"), F.sum("incidents").alias("i"))
    c = k.groupBy("line").agg(F.sum("m").alias("m"), F.sum("i").alias("i"), F.coalesce(F.sum(F.when(F.col("grade") == "A", F.col("m"))), F.lit(0.0)).alias("a"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("grade", "m")))).alias("g"))
    j = spark.range(14).withColumnRenamed("id", "line").join(c, "line", "left")
    road = F.col("line") != 0
    told = F.array_join(F.transform(F.map_entries("g"), lambda e: F.concat(e.key, F.lit("="), F.format_string("%.2f", e.value))), ", ")
    return j.select("line", F.round(F.coalesce("m", F.lit(0.0)), 2).alias("miles"), F.coalesce(told, F.lit("")).alias("by_grade"), F.when(road, F.round(ratio(F.col("a"), F.col("m"), 100), 1)).alias("pct_protected"), F.when(road, F.coalesce("i", F.lit(0))).alias("incidents"), F.col("m").isNull().alias("no_data"))


@query(f"""WITH {_GRADED}, k AS (SELECT line, label, grade, round(sum(meters), 1) AS meters, CAST(sum(incidents) AS BIGINT) AS incidents FROM g GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY line ORDER BY meters DESC, label, grade) AS INTEGER) AS place FROM k""")
def member_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-26: members of each line by label and grade, the longest first; incidents are null where no member has them."""
    k = _graded(spark, sf_dir).groupBy("line", "label", "grade").agg(F.round(F.sum("meters"), 1).alias("meters"), F.sum("incidents").alias("incidents"))
    return k.withColumn("place", F.row_number().over(Window.partitionBy("line").orderBy(F.col("meters").desc(), "label", "grade")))


@query(f"""WITH {_GRADED} SELECT line, label, round(sum(meters), 2) AS meters FROM g WHERE grade IN ('A', 'B') GROUP BY ALL""")
def comfortable_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-16: members whose grade is at the comfort floor or better; an unknown grade fails."""
    rank = F.coalesce(F.create_map(*[x for i, k in enumerate("DCBA") for x in (F.lit(k), F.lit(i))])[F.col("grade")], F.lit(-1))
    return _graded(spark, sf_dir).filter(rank >= 2).groupBy("line", "label").agg(F.round(F.sum("meters"), 2).alias("meters"))


_WAYS = f"""{SEGMENTS}, w AS (SELECT 'Way ' || CAST(corridor AS VARCHAR) AS name, seg_id, x1, y1, x2, y2, sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)) AS meters FROM segments WHERE seg_id % 4 <> 0 AND seg_id % 5 <> 0)"""


@query(f"""WITH {_WAYS} SELECT name, count(*) AS ways, round(sum(meters), 2) AS meters, array_to_string(list(printf('%.2f %.2f, %.2f %.2f', x1, y1, x2, y2) ORDER BY seg_id), '; ') AS multiline, round(arg_max(x2, seg_id), 3) AS middle_x FROM w GROUP BY name""")
def trail_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-5 AGG-27 AGG-28 FN-7: ways written as nested elements and read back; named ones of two points or more gathered by name to one multiline with its length; the middle vertex of the last way."""
    at = lambda x, y: F.struct(F.col(y).alias("lat"), F.col(x).alias("lon"))
    two = F.when(F.col("seg_id") % 5 == 0, F.array(at("x1", "y1"))).otherwise(F.array(at("x1", "y1"), at("x2", "y2")))
    tags = F.when(F.col("seg_id") % 4 == 0, F.create_map(F.lit("highway"), F.lit("path"))).otherwise(F.create_map(F.lit("name"), F.concat(F.lit("Way "), F.col("corridor").cast("string"))))
    element = F.struct(F.lit("way").alias("type"), F.col("seg_id").alias("id"), tags.alias("tags"), two.alias("geometry"))
    path = files.shared_path(spark)
    segments(spark, sf_dir).select(F.to_json(F.struct(F.array(element).alias("elements"))).alias("value")).write.text(path)
    ways = files.named_ways(spark.read.schema(files.WAY).json(path))
    steps = F.zip_with(F.slice("line", 1, F.size("line") - 1), F.slice("line", 2, F.size("line")), lambda a, b: distance(a.x, a.y, b.x, b.y))
    measured = ways.select("name", "id", "line", F.aggregate(steps, F.lit(0.0), lambda s, m: s + m).alias("meters"))
    g = measured.groupBy("name").agg(F.count(F.lit(1)).alias("ways"), F.round(F.sum("meters"), 2).alias("meters"), F.array_sort(F.collect_list(F.struct("id", "line"))).alias("m"))
    text = F.array_join(F.transform("m", lambda w: F.array_join(F.transform(w.line, lambda p: F.format_string("%.2f %.2f", p.x, p.y)), ", ")), "; ")
    last = F.element_at("m", -1).line
    return g.select("name", "ways", "meters", text.alias("multiline"), F.round(F.get(last, F.floor(F.size(last) / 2).cast("int")).x, 3).alias("middle_x"))


# Ledgers.
_INSTALLED = f"""{FACTS}, i AS (SELECT CAST(year(day) AS INTEGER) AS y, count(*) * 1e0 AS reported, count(*) FILTER (priority = '5-LOW') * 0.25e0 AS upgrade, count(*) FILTER (priority IN ('1-URGENT', '2-HIGH')) * 0.5e0 AS low_stress FROM facts GROUP BY 1)"""


def _installed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("priority")
    return facts(spark, sf_dir).groupBy(F.year("day").alias("y")).agg(F.count(F.lit(1)).cast("double").alias("reported"), (F.count_if(p == "5-LOW") * 0.25).alias("upgrade"), (F.count_if(p.isin("1-URGENT", "2-HIGH")) * 0.5).alias("low_stress"))


def _delivered(installed: DataFrame, since: Column) -> DataFrame:
    """One row of what was delivered from a year on: reported, upgrades, new, and the low-stress share on both bases; none without a reported mile."""
    s = installed.filter(F.col("y") >= since).agg(F.min("y").alias("since_year"), F.max("y").alias("through_year"), F.sum("reported").alias("reported"), F.sum("upgrade").alias("upgrades"), F.sum(F.col("reported") - F.col("upgrade")).alias("new_miles"), F.sum("low_stress").alias("low"))
    new, claimed = F.round(ratio(F.col("low"), F.col("new_miles"), 100.0), 1), F.round(ratio(F.col("low") + F.col("upgrades"), F.col("reported"), 100.0), 1)
    return s.filter("reported > 0").select("through_year", "reported", F.round("upgrades", 2).alias("upgrades"), F.round("new_miles", 2).alias("new_miles"), new.alias("share_new_basis"), claimed.alias("share_reported_basis"))


@query(f"""WITH {_INSTALLED}, s AS (SELECT max(y) AS through_year, sum(reported) AS reported, sum(upgrade) AS upgrades, sum(reported - upgrade) AS new_miles, sum(low_stress) AS low FROM i WHERE y >= 1998)
  SELECT through_year, reported, round(upgrades, 2) AS upgrades, round(new_miles, 2) AS new_miles, round(100 * low / new_miles, 1) AS share_new_basis, round(100 * (low + upgrades) / reported, 1) AS share_reported_basis FROM s WHERE reported > 0""")
def delivered_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-29: what was delivered since a year: reported, upgrades, new miles, and the low-stress share with and without the upgrades."""
    return _delivered(_installed(spark, sf_dir), F.lit(1998))


@query(f"""WITH {_INSTALLED}, c AS (SELECT CAST(range AS INTEGER) AS id, CAST(1995 + range % 3 AS INTEGER) AS base_year, CAST(1998 + range % 5 AS INTEGER) AS target_year, CAST(40 * (range + 1) AS DOUBLE) AS target, CASE WHEN range = 7 THEN NULL ELSE ['state', 'delta', 'sum', 'not_measurable', 'low_stress_share'][CAST(range % 5 + 1 AS INTEGER)] END AS basis FROM range(0, 8)),
  v AS (SELECT c.*, b.low_stress AS b, g.low_stress AS g, b.reported AS rb, g.reported AS rg, (SELECT sum(low_stress) FROM i WHERE y > base_year AND y <= target_year) AS s, (SELECT sum(reported) FROM i WHERE y > base_year AND y <= target_year) AS rs, (SELECT round(100 * sum(low_stress) / sum(reported - upgrade), 1) FROM i WHERE y > base_year) AS share, (SELECT round(100 * (sum(low_stress) + sum(upgrade)) / sum(reported), 1) FROM i WHERE y > base_year) AS rshare FROM c LEFT JOIN i b ON b.y = base_year LEFT JOIN i g ON g.y = target_year),
  r AS (SELECT *, CASE basis WHEN 'state' THEN g WHEN 'delta' THEN g - b WHEN 'sum' THEN s WHEN 'low_stress_share' THEN share END AS actual, CASE basis WHEN 'state' THEN rg WHEN 'delta' THEN rg - rb WHEN 'sum' THEN rs WHEN 'low_stress_share' THEN rshare END AS claimed FROM v),
  k AS (SELECT id, basis, target, actual IS NOT NULL AS measurable, round(actual, 2) AS actual, CASE WHEN actual IS NOT NULL THEN CAST(round(100 * actual / target) AS BIGINT) END AS pct_of_target, actual >= target AS met, round(claimed, 2) AS as_claimed, claimed >= target AS as_claimed_met, CASE WHEN actual IS NULL THEN CASE WHEN basis IS NULL OR basis = 'not_measurable' THEN 'no basis' ELSE 'no history' END END AS reason FROM r)
  SELECT *, count(*) FILTER (measurable) OVER () AS scored, count(*) FILTER (met) OVER () AS total_met FROM k""")
def commitments_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-31 AGG-30 ORD-10: promises against the annual series as a state, a change, a sum over (base, target] or a share; beside them the generous reading, and for those that cannot be measured why; with totals."""
    y, i = _installed(spark, sf_dir), F.col("id")
    basis = F.when(i == 7, F.lit(None)).otherwise(F.get(F.array(*map(F.lit, ("state", "delta", "sum", "not_measurable", "low_stress_share"))), (i % 5).cast("int")))
    c = spark.range(8).select(i.cast("int").alias("id"), (1995 + i % 3).cast("int").alias("base_year"), (1998 + i % 5).cast("int").alias("target_year"), (40 * (i + 1)).cast("double").alias("target"), basis.alias("basis"))
    # Eight promises and a row for each year: joined by the years they span.
    span = c.join(y, F.col("y") >= F.col("base_year"), "left").groupBy(*c.columns)
    at = lambda k, v: F.max(F.when(F.col("y") == F.col(k), F.col(v)))
    after = F.col("y") > F.col("base_year")
    summed = lambda v, c=after: F.sum(F.when(c, F.col(v)))
    inside = after & (F.col("y") <= F.col("target_year"))
    share = F.round(ratio(summed("low_stress"), summed("reported") - summed("upgrade"), 100.0), 1)
    generous = F.round(ratio(summed("low_stress") + summed("upgrade"), summed("reported"), 100.0), 1)
    parts = {}
    for name, v, s in (("actual", "low_stress", share), ("claimed", "reported", generous)):
        b, g = at("base_year", v), at("target_year", v)
        parts[name] = F.when(F.col("basis") == "state", g).when(F.col("basis") == "delta", g - b).when(F.col("basis") == "sum", summed(v, inside)).when(F.col("basis") == "low_stress_share", s)
    r = span.agg(*[p.alias(n) for n, p in parts.items()])
    ok = F.col("actual").isNotNull()
    reason = F.when(~ok, F.when(F.col("basis").isNull() | (F.col("basis") == "not_measurable"), "no basis").otherwise("no history"))
    k = r.select("id", "basis", "target", ok.alias("measurable"), F.round("actual", 2).alias("actual"), F.when(ok, F.round(100 * F.col("actual") / F.col("target")).cast("long")).alias("pct_of_target"), (F.col("actual") >= F.col("target")).alias("met"), F.round("claimed", 2).alias("as_claimed"), (F.col("claimed") >= F.col("target")).alias("as_claimed_met"), reason.alias("reason"))
    whole = Window.partitionBy(F.lit(1))  # eight promises
    return k.withColumns({"scored": F.count_if("measurable").over(whole), "total_met": F.count_if("met").over(whole)}).orderBy("id")


@query("""WITH c AS (SELECT c_nationkey AS k, c_acctbal AS score, c_custkey % 400 * 1000 AS population FROM customer) SELECT k AS district, count(*) AS peers, round(avg(score) + 0.001234567e0, 2) AS mean_score, count(*) FILTER (population >= 300000) AS large FROM c GROUP BY k""")
def peer_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-34: peers, their mean score (shifted off rounding ties), and how many are large."""
    c = t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("district"), "c_acctbal", (F.col("c_custkey") % 400 * 1000).alias("population"))
    return c.groupBy("district").agg(F.count(F.lit(1)).alias("peers"), F.round(F.avg("c_acctbal") + 0.001234567, 2).alias("mean_score"), F.count_if(F.col("population") >= 300_000).alias("large"))


# Orders.


@query(f"""WITH {FACTS}, v AS (SELECT id, district, CASE WHEN status <> 'P' THEN price END AS value FROM facts), r AS (SELECT id, district, row_number() OVER (PARTITION BY district ORDER BY value DESC NULLS LAST, id) AS down, row_number() OVER (PARTITION BY district ORDER BY value ASC NULLS LAST, id) AS up, row_number() OVER (PARTITION BY district ORDER BY value IS NULL, id) AS source_order FROM v)
  SELECT id, district, CAST(down AS INTEGER) AS down, CAST(up AS INTEGER) AS up, CAST(source_order AS INTEGER) AS source_order FROM r""")
def sorted_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ORD-1 ORD-9: places of a column sort in both directions with nulls last, and of an order that only lets rows without data sink; a district may hold all rows, since places are counted over ranges."""
    v = facts(spark, sf_dir).select("id", "district", F.when(F.col("status") != "P", F.col("price")).alias("value"))
    for out, by in (("down", F.col("value").desc_nulls_last()), ("up", F.col("value").asc_nulls_last()), ("source_order", F.col("value").isNull())):
        v = ranking.numbered_within(v, ["district"], [by, "id"], out)
    return v.select("id", "district", *[F.col(c).cast("int").alias(c) for c in ("down", "up", "source_order")])


@query("""SELECT conv_id % 25 AS committee, conv_id AS meeting, turn AS day, CAST(row_number() OVER (ORDER BY turn, conv_id) AS INTEGER) AS place FROM conversations WHERE turn >= 2 AND role = 'user'""")
def upcoming_meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ORD-11: nested meetings of all committees, in documents of at most 40 meetings each, flattened; those still to come and not cancelled, in order."""
    c = t(spark, sf_dir, "conversations")
    nested = c.groupBy((F.col("conv_id") % 25).alias("committee"), F.floor(F.col("conv_id") / 1000).alias("block")).agg(F.collect_list(F.struct(F.col("conv_id").alias("meeting"), F.col("turn").alias("day"), F.col("role").alias("status"))).alias("meetings"))
    flat = nested.select("committee", F.explode(F.filter("meetings", lambda m: (m.day >= 2) & (m.status == "user"))).alias("m")).select("committee", "m.meeting", "m.day")
    return ranking.numbered(flat, ["day", "meeting"], "place")


# Sets.


@query("""WITH u AS (SELECT 1 AS load, 'a' AS source, o_orderkey AS id, o_orderstatus AS status, o_orderdate AS d FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01' UNION ALL SELECT 2, 'b', o_orderkey, o_orderstatus, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'
    UNION ALL SELECT 3, 'a', o_orderkey, 'X', o_orderdate FROM orders WHERE o_orderkey % 3 = 0),
  k AS (SELECT *, row_number() OVER (PARTITION BY source, id ORDER BY load) AS rn FROM u), l AS (SELECT source, strftime(max(d), '%Y-%m-%d') AS latest FROM u GROUP BY source) SELECT CAST(id AS VARCHAR) AS id, source, status, latest FROM k JOIN l USING (source) WHERE rn = 1""")
def merged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-1 WIN-7: two sources with an overlap, one of them with a column of its own; the first load of an id within its source wins, what the other source says of it stays; each source's latest date stands beside."""
    o = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("d"))
    load = lambda n, source, rows: rows.select(F.lit(n).alias("load"), F.lit(source).alias("source"), F.col("id").cast("string").alias("id"), "status", "d")
    a, b = load(1, "a", o.filter("d < timestamp'1999-01-01'")), load(2, "b", o.filter("d >= timestamp'1998-01-01'")).withColumn("recorded_votes", F.lit("{}"))
    again = load(3, "a", o.filter("id % 3 = 0").withColumn("status", F.lit("X")))
    both = a.unionByName(b, allowMissingColumns=True).unionByName(again, allowMissingColumns=True)
    latest = both.groupBy("source").agg(F.date_format(F.max("d"), "yyyy-MM-dd").alias("latest"))
    return ranking.first_wins(both, ["source", "id"], ["load"]).join(F.broadcast(latest), "source").select("id", "source", "status", "latest")  # two rows


@query("""WITH l AS (SELECT n_nationkey * 2 AS id, 'ward' AS family FROM nation UNION ALL SELECT s_suppkey, 'line' FROM supplier WHERE s_suppkey % 3 <> 0), p AS (SELECT DISTINCT c_nationkey AS id, 'ward' AS family FROM customer UNION ALL SELECT DISTINCT l_suppkey, 'line' FROM lineitem WHERE l_suppkey % 5 <> 0),
  d AS (SELECT family, id, 'missing' AS state FROM l WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.family = l.family AND p.id = l.id) UNION ALL SELECT family, id, 'extra' FROM p WHERE NOT EXISTS (SELECT 1 FROM l WHERE p.family = l.family AND p.id = l.id)) SELECT *, count(*) OVER (PARTITION BY family, state) AS n FROM d""")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-4: what is listed against what is present in each family, both ways, and how many of each."""
    key = lambda c, f: F.struct(F.lit(f).alias("family"), c.cast("long").alias("id")).alias("key")
    listed = t(spark, sf_dir, "nation").select(key(F.col("n_nationkey") * 2, "ward")).union(t(spark, sf_dir, "supplier").filter("s_suppkey % 3 <> 0").select(key(F.col("s_suppkey"), "line")))
    present = t(spark, sf_dir, "customer").select(key(F.col("c_nationkey"), "ward")).union(t(spark, sf_dir, "lineitem").filter("l_suppkey % 5 <> 0").select(key(F.col("l_suppkey"), "line")))
    d = gates.only_in_one(listed, present, "key").select("key.family", "key.id", "state")
    return d.join(d.groupBy("family", "state").agg(F.count(F.lit(1)).alias("n")), ["family", "state"])


# Gates.


@query("""SELECT n_nationkey AS file, CASE WHEN n_nationkey % 5 = 1 THEN 'provenance' WHEN n_nationkey % 5 = 2 THEN 'generated_at' WHEN n_nationkey % 5 = 3 THEN 'contract_version' END AS fault FROM nation WHERE n_nationkey % 5 IN (1, 2, 3)""")
def release_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ-2: stamps of published files against those of the data: provenance must be live, time and contract version the same."""
    k = F.col("n_nationkey")
    stamp = lambda *odd: [F.when(k % 5 == o, bad).otherwise(good).alias(n) for n, good, bad, o in (("provenance", "live", "fixtures", odd[0]), ("generated_at", "2024-01-01", "2023-01-01", odd[1]), ("contract_version", "2", "1", odd[2]))]
    n = t(spark, sf_dir, "nation")
    return gates.incoherent_stamps(n.select(k.alias("file"), *stamp(9, 9, 9)), n.select(k.alias("file"), *stamp(1, 2, 3)), "file", "provenance", "live", ["generated_at", "contract_version"])


@query("""WITH c AS (SELECT 'seg-' || CAST(s_nationkey AS VARCHAR) AS selector, CASE WHEN s_suppkey % 4 <> 0 THEN 'live' END AS tier, CASE WHEN s_suppkey % 6 <> 0 THEN 'why' END AS caveat FROM supplier) SELECT selector, count(*) AS claims FROM c WHERE (tier IS NULL OR caveat IS NULL) AND NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey % 2 = 0 AND selector = 'seg-' || CAST(n_nationkey AS VARCHAR)) GROUP BY selector""")
def claims_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ-7: claims that no selector enforces yet and that lack a tier or a caveat, counted by where they stand."""
    name = lambda k: F.concat(F.lit("seg-"), F.col(k).cast("string")).alias("selector")
    c = t(spark, sf_dir, "supplier").select(name("s_nationkey"), F.when(F.col("s_suppkey") % 4 != 0, "live").alias("tier"), F.when(F.col("s_suppkey") % 6 != 0, "why").alias("caveat"))
    return claims.backlog(c, t(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0").select(name("n_nationkey")), ["tier", "caveat"])


@query("""WITH r AS (SELECT c_nationkey % 5 AS roster, c_custkey % 50 AS ward, CASE WHEN c_custkey % 50 >= 8 + 4 * (c_nationkey % 5) THEN c_name END AS name FROM customer) SELECT roster, count(DISTINCT ward) FILTER (name IS NOT NULL) AS named, count(DISTINCT ward) FILTER (name IS NOT NULL) >= 40 AS accepted FROM r GROUP BY roster""")
def roster_refreshes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ-10: a refresh of the fifty wards replaces the roster only if forty or more have a name."""
    k, ward = F.col("c_nationkey") % 5, F.col("c_custkey") % 50
    r = t(spark, sf_dir, "customer").select(k.alias("roster"), F.when(ward >= 8 + 4 * k, ward).alias("ward"))
    return gates.named_enough(r, "roster", "ward", 40)


@query("""WITH b AS (SELECT l_suppkey % 25 AS batch, count(*) AS n FROM lineitem GROUP BY 1), m AS (SELECT min(n) AS cap FROM b) SELECT batch, n, n = cap AS truncated FROM b, m""")
def full_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ-11: a batch with exactly as many rows as its limit (here the least batch's) may have lost some; more or fewer have not."""
    b = t(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 25).alias("batch")).agg(F.count(F.lit(1)).alias("n"))
    cap = b.agg(F.min("n").alias("cap"))
    return b.crossJoin(F.broadcast(cap)).select("batch", "n", (F.col("n") == F.col("cap")).alias("truncated"))  # one row
