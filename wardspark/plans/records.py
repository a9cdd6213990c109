"""Queries on rosters, records, meetings, report cards and what may be published."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardspark.functions.scalars import distance, ratio, title_key, utm16, yes_no
from wardspark.operators import gates, ranking, spatial
from wardspark.plans.registry import query
from wardspark.plans.standins import CELL, FACTS, POINTS, SEGMENTS, facts, points, segments, t, zones
from wardspark.sources import files

# Grades from worst to best (fixed values).
GRADES = ("D", "C", "B", "A")


@query(r"""WITH RECURSIVE p AS (SELECT page_id, row_number() OVER (ORDER BY page_id) AS n, 'h' || regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, nullif('t' || trim(regexp_replace(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '\s+', ' ', 'g')), 't') AS title FROM pages),
  r(n, page_id, kept, seen) AS (SELECT CAST(0 AS BIGINT), CAST(-1 AS BIGINT), false, CAST([] AS VARCHAR[]) UNION ALL SELECT p.n, p.page_id, NOT list_has_any(seen, list_filter([host, title], lambda x: x IS NOT NULL)), CASE WHEN list_has_any(seen, list_filter([host, title], lambda x: x IS NOT NULL)) THEN seen ELSE list_concat(seen, list_filter([host, title], lambda x: x IS NOT NULL)) END FROM r JOIN p ON p.n = r.n + 1)
  SELECT p.page_id, substring(p.host, 2) AS host, substring(p.title, 2) AS title FROM r JOIN p USING (page_id) WHERE kept""")
def deduped_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-8: pages in order, without those that share the host or the title with an earlier kept one; what was kept decides."""
    title = F.nullif(title_key(F.regexp_extract("html", "<title>([^<]*)</title>", 1)), F.lit(""))
    p = t(spark, sf_dir, "pages").select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), title.alias("title"))
    return ranking.dedupe_by_either(p, "host", "title", "page_id")


@query("SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, ends_with(regexp_extract(url, '^https?://([^/:?#]+)', 1), '.com') AS own_host, TRY_CAST(regexp_extract(url, '/([0-9]+)([?#]|$)', 1) AS BIGINT) AS article FROM pages")
def article_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-31: host and article id of an address."""
    host = F.regexp_extract("url", "^https?://([^/:?#]+)", 1)
    return t(spark, sf_dir, "pages").select("page_id", host.alias("host"), host.endswith(".com").alias("own_host"), F.regexp_extract("url", "/([0-9]+)([?#]|$)", 1).try_cast("long").alias("article"))


@query(f"WITH {POINTS}, c AS (SELECT user_id, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY user_id) SELECT c.user_id, c.event_id, zone FROM c JOIN points USING (event_id)")
def clicked_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-5: the zone under the last click of each user."""
    last = points(spark, sf_dir).filter("event_type = 'click'").groupBy("user_id").agg(F.max_by(F.struct("event_id", "x", "y"), "event_id").alias("p")).select("user_id", "p.*")
    return spatial.points_in_polygons(last, zones(spark), CELL).select("user_id", "event_id", "zone")


def _utm_sql(lon: str, lat: str) -> tuple[str, str]:
    """The series of scalars.utm16 as SQL."""
    n = 0.0016792203946287
    a = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * n**0.5 / (1 + n)
    tau = f"sinh(atanh(sin(radians({lat}))) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * sin(radians({lat}))))"
    lam = f"radians({lon} + 87e0)"
    xi, eta = f"atan2({tau}, cos({lam}))", f"atanh(sin({lam}) / sqrt(1 + {tau} * {tau}))"
    east = " + ".join([eta, *(f"{c!r}::DOUBLE * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, c in enumerate(alpha, 1))])
    north = " + ".join([xi, *(f"{c!r}::DOUBLE * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, c in enumerate(alpha, 1))])
    return f"(500000 + {0.9996 * a!r}::DOUBLE * ({east}))", f"({0.9996 * a!r}::DOUBLE * ({north}))"


_ENDS = ("-87.9e0 + ((s_suppkey * 4513) % 3200) / 1e4", "41.6e0 + ((s_suppkey * 2917) % 3700) / 1e4", "-87.9e0 + ((s_suppkey * 4513) % 3200 + 20 + (s_suppkey * 31) % 80) / 1e4", "41.6e0 + ((s_suppkey * 2917) % 3700 + (s_suppkey * 17) % 60) / 1e4")
_A, _B = _utm_sql("lon1", "lat1"), _utm_sql("lon2", "lat2")


@query(f"""WITH g AS (SELECT s_suppkey AS seg_id, {", ".join(f"{x} AS {n}" for x, n in zip(_ENDS, ("lon1", "lat1", "lon2", "lat2")))} FROM supplier), u AS (SELECT seg_id, {_A[0]} AS px, {_A[1]} AS py, {_B[0]} AS qx, {_B[1]} AS qy FROM g)
  SELECT seg_id, round(sqrt((px - qx) * (px - qx) + (py - qy) * (py - qy)), 3) AS meters FROM u""")
def projected_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-4 FN-6: lengths in metres of lines in degrees, by projection."""
    ends = t(spark, sf_dir, "supplier").selectExpr("s_suppkey as seg_id", *[f"{x.replace('e0', 'd')} as {n}" for x, n in zip(_ENDS, ("lon1", "lat1", "lon2", "lat2"))])
    a, b = utm16(F.col("lon1"), F.col("lat1")), utm16(F.col("lon2"), F.col("lat2"))
    return ends.select("seg_id", F.round(distance(*a, *b), 3).alias("meters"))


@query("""SELECT o_orderkey AS id, unnest(list_filter([CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'value of status' END, CASE WHEN o_orderkey % 11 = 0 THEN 'null in day' END], lambda x: x IS NOT NULL)) AS fault FROM orders""")
def contract_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ-4: columns and types are held against the declared contract first, then nulls and values row by row."""
    o = t(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("id"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 11 != 0, F.to_date("o_orderdate")).alias("day"))
    contract = T.StructType([T.StructField("id", T.LongType()), T.StructField("status", T.StringType()), T.StructField("day", T.DateType())])
    if faults := gates.schema_faults(o, contract):
        raise gates.GateError(f"orders: {faults}")
    return gates.value_faults(o, "id", {"status": ("F", "O")}, ["id", "day"])


@query("""SELECT p_partkey AS part, p_partkey % 3 = 0 AS flag, CASE p_type WHEN 'ECONOMY' THEN 'protected' WHEN 'STANDARD' THEN 'buffered' ELSE 'other' END AS category,
  CASE WHEN p_size < 10 THEN 0 WHEN p_size < 20 THEN 1 WHEN p_size < 30 THEN 2 ELSE 3 END AS step FROM part WHERE p_size IS NOT NULL AND regexp_matches(lower(p_name), 'ring|small|bolt') AND contains(lower(p_brand), 'brand')""")
def coded_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-2 FLT-3 FLT-4 FLT-9 FLT-21 FN-22: a fact projection with a flag, a category that may be other, and a step, filtered by any of some words and a search."""
    category = F.create_map(*map(F.lit, ("ECONOMY", "protected", "STANDARD", "buffered")))[F.col("p_type")]
    flag = yes_no(F.when(F.col("p_partkey") % 3 == 0, "y").when(F.col("p_partkey") % 3 == 1, "N"))
    step = F.when(F.col("p_size") < 10, 0).when(F.col("p_size") < 20, 1).when(F.col("p_size") < 30, 2).otherwise(3)
    picked = t(spark, sf_dir, "part").filter(F.col("p_size").isNotNull() & F.lower("p_name").rlike("ring|small|bolt") & F.lower("p_brand").contains("brand"))
    return picked.select(F.col("p_partkey").alias("part"), flag.alias("flag"), F.coalesce(category, F.lit("other")).alias("category"), step.alias("step"))


@query("SELECT p_type AS label, count(*) AS n FROM part WHERE p_type NOT IN ('ECONOMY', 'STANDARD') GROUP BY 1")
def unmapped_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-3: labels that no category takes, counted."""
    return t(spark, sf_dir, "part").filter(~F.col("p_type").isin("ECONOMY", "STANDARD")).groupBy(F.col("p_type").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {FACTS}, d AS (SELECT *, CASE WHEN id % 17 = 0 THEN 'TBD' WHEN id % 19 = 0 THEN NULL ELSE CAST(day AS VARCHAR) END AS said, CASE WHEN id % 6 = 0 THEN 'Cancelled' WHEN id % 6 = 1 THEN 'CANCELED' WHEN id % 6 = 2 THEN NULL ELSE 'scheduled' END AS state FROM facts),
  m AS (SELECT district, id, TRY_CAST(said AS DATE) AS day FROM d WHERE coalesce(lower(state), '') NOT IN ('cancelled', 'canceled', 'postponed') AND TRY_CAST(said AS DATE) >= DATE '1998-01-01')
  SELECT district, CAST(min(day) AS VARCHAR) AS next_day, arg_min(id, (day, id)) AS id, count(*) AS upcoming, date_diff('month', min(day), DATE '1998-12-01') > 3 AS stale FROM m GROUP BY district""")
def next_meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-13 ORD-6 FN-11: the next meeting whose date can be read and whose state is none of a set (in any case), how many follow, and whether the month is stale."""
    k = F.col("id")
    said = F.when(k % 17 == 0, "TBD").when(k % 19 == 0, F.lit(None)).otherwise(F.col("day").cast("string"))
    state = F.when(k % 6 == 0, "Cancelled").when(k % 6 == 1, "CANCELED").when(k % 6 == 2, F.lit(None)).otherwise("scheduled")
    m = facts(spark, sf_dir).select("district", "id", said.alias("said"), state.alias("state"))
    m = m.withColumn("day", F.to_date(F.try_to_timestamp("said", F.lit("yyyy-MM-dd")))).filter(~F.coalesce(F.lower("state"), F.lit("")).isin("cancelled", "canceled", "postponed") & (F.col("day") >= F.lit("1998-01-01").cast("date")))
    stale = F.coalesce(F.months_between(F.lit("1998-12-01").cast("date"), F.trunc(F.min("day"), "month")) > 3, F.lit(False))
    return m.groupBy("district").agg(F.min("day").cast("string").alias("next_day"), F.min_by("id", F.struct("day", "id")).alias("id"), F.count(F.lit(1)).alias("upcoming"), stale.alias("stale"))


@query("""SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, strftime(DATE '2024-01-01' + CAST(page_id % 200 AS INTEGER), '%Y-%m-%d') AS created FROM pages WHERE page_id % 9 <> 0 AND DATE '2024-01-01' + CAST(page_id % 200 AS INTEGER) >= DATE '2024-03-01' AND (contains(lower(html), 'bike') OR contains(lower(html), 'the') OR contains(lower(html), 'der'))""")
def requests_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-9: rows whose text contains any of some words in any case, created on a date or after; a row without a date goes."""
    k = F.col("page_id")
    created = F.when(k % 9 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (k % 200).cast("int")))
    text = F.lower("html")
    rows = t(spark, sf_dir, "pages").filter((created >= F.lit("2024-03-01").cast("date")) & (F.contains(text, F.lit("bike")) | F.contains(text, F.lit("the")) | F.contains(text, F.lit("der"))))
    return rows.select("page_id", F.regexp_extract("url", "^https?://([^/:?#]+)", 1).alias("host"), F.date_format(created, "yyyy-MM-dd").alias("created"))


@query(f"""WITH {FACTS}, r AS (SELECT id, district, row_number() OVER (PARTITION BY district ORDER BY priority = '1-URGENT' DESC, status = 'O' DESC, CASE WHEN status <> 'P' THEN price END DESC NULLS LAST, id) AS place FROM facts) SELECT * FROM r WHERE place <= 6""")
def agenda_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ORD-7: the first six of each district by several keys; rows without the value sink."""
    value = F.when(F.col("status") != "P", F.col("price"))
    order = [(F.col("priority") == "1-URGENT").desc(), (F.col("status") == "O").desc(), value.desc_nulls_last(), F.col("id")]
    best = ranking.top_k(facts(spark, sf_dir), ["district"], order, 6)
    return best.select("id", "district", F.col("rank").cast("long").alias("place"))


@query(f"""WITH {FACTS}, y AS (SELECT CAST(count(*) FILTER (day >= DATE '1997-01-01') AS BIGINT) AS delivered, count(*) FILTER (day >= DATE '2030-01-01') AS fresh, count(*) AS held FROM facts) SELECT delivered, coalesce(nullif(fresh, 0), held) AS reference, CASE WHEN fresh > 0 THEN 'fresh' ELSE 'snapshot' END AS basis FROM y""")
def headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-31: one row of what was delivered, against the fresh figure or, if there is none, the snapshot."""
    y = facts(spark, sf_dir).agg(F.count_if(F.col("day") >= "1997-01-01").alias("delivered"), F.count_if(F.col("day") >= "2030-01-01").alias("fresh"), F.count(F.lit(1)).alias("held"))
    return y.select("delivered", F.coalesce(F.nullif("fresh", F.lit(0)), "held").alias("reference"), F.when(F.col("fresh") > 0, "fresh").otherwise("snapshot").alias("basis"))


@query("""WITH a AS (SELECT l_orderkey * 10 + l_linenumber AS item, unnest([l_orderkey, l_partkey]) AS k, l_suppkey % 50 AS ward FROM lineitem), n AS (SELECT DISTINCT item, k, ward FROM a)
  SELECT item, k AS record, ward, o_orderstatus AS matter FROM n LEFT JOIN orders ON o_orderkey = k""")
def agenda_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-25 FN-14 FN-15 FN-17: record and ward numbers out of agenda text, the first title of a JSON array; each number is looked up once."""
    text = F.concat(F.lit('["('), F.col("l_suppkey") % 50, F.lit("th Ward) O"), F.col("l_orderkey"), F.lit(" and R"), F.col("l_partkey"), F.lit('", "more"]'))
    first = F.coalesce(F.get(F.from_json(text, "array<string>"), F.lit(0)), text)
    items = t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"), first.alias("title"))
    found = items.select("item", F.regexp_extract("title", r"([0-9]+)th Ward", 1).cast("long").alias("ward"), F.explode(F.regexp_extract_all("title", F.lit(r"\b[OR]([0-9]+)"), F.lit(1))).alias("r"))
    records = found.select("item", F.col("r").cast("long").alias("record"), "ward").distinct()
    # Each number is looked up once, however many items name it.
    return records.join(t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record"), F.col("o_orderstatus").alias("matter")), "record", "left")


@query(f"""WITH {FACTS}, a AS (SELECT district, count(*) AS old_rows, count(*) FILTER (id % 10 <> 0 OR district % 2 = 0) AS new_rows, count(DISTINCT status) AS named FROM facts GROUP BY district)
  SELECT district, CASE WHEN new_rows >= old_rows AND named >= 3 THEN 'rebuilt' ELSE 'published' END AS kept, greatest(new_rows, CASE WHEN new_rows >= old_rows AND named >= 3 THEN new_rows ELSE old_rows END) AS n, new_rows = 600 AS at_limit FROM a""")
def publish_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ-13: a weaker or incomplete rebuild never replaces what is published; a batch exactly at the limit is marked."""
    f = facts(spark, sf_dir)
    old = f.groupBy("district").agg(F.count(F.lit(1)).alias("old_rows"), F.count_distinct("status").alias("named"))
    new = f.filter("id % 10 <> 0 or district % 2 = 0").groupBy("district").agg(F.count(F.lit(1)).alias("new_rows"))
    return gates.stronger(old.join(new, "district", "left").fillna(0, ["new_rows"]), "old_rows", "new_rows", F.col("named") >= 3).select("district", "kept", "n", (F.col("new_rows") == 600).alias("at_limit"))


@query("""SELECT CAST(year(o_orderdate) AS BIGINT) AS family, count(DISTINCT CASE WHEN o_custkey % 500 = 0 THEN 2 ELSE 1 END) AS versions FROM orders GROUP BY 1 HAVING versions > 1""")
def mixed_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ-6: families of outputs that are not all stamped with one contract version."""
    stamped = t(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("long").alias("family"), F.when(F.col("o_custkey") % 500 == 0, 2).otherwise(1).alias("version"))
    return stamped.groupBy("family").agg(F.count_distinct("version").alias("versions")).filter("versions > 1")


@query("""SELECT o_custkey % 25 AS route, 'Nation_' || CAST(o_custkey % 25 AS VARCHAR) || ' Road' AS title, count(*) AS n FROM orders WHERE o_custkey % 25 IN (SELECT n_nationkey FROM nation) GROUP BY ALL""")
def roster_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-12 FLT-5 FN-3: a curated roster kept as JSON beside the facts, its key column found under any of its names; titles are cased."""
    path = files.shared_path(spark)
    t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("Route_ID"), F.col("n_name").alias("street")).write.json(path)
    roster = spark.read.schema("Route_ID long, street string").json(path)
    key = files.column_named(roster, "id", "route_id")
    names = roster.select(F.col(key).alias("route"), F.initcap(F.concat_ws(" ", F.lower("street"), F.lit("ROAD"))).alias("title"))
    return t(spark, sf_dir, "orders").select((F.col("o_custkey") % 25).alias("route")).join(names, "route").groupBy("route", "title").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {FACTS}, d AS (SELECT district, count(*) AS n FROM facts GROUP BY 1)
  SELECT 'routes' AS roster, n_nationkey AS id, n_name AS title, coalesce(n, 0) AS n FROM nation LEFT JOIN d ON district = n_nationkey
  UNION ALL SELECT 'points', r_regionkey, r_name, CAST(coalesce((SELECT sum(n) FROM d WHERE district % 5 = r_regionkey), 0) AS BIGINT) FROM region""")
def curated_rosters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-12 JON-14: four curated rosters and what the facts say of their entries: routes (a list) and points (a list by name) must be there; projects (here a broken file) and commitments (here an empty list) may be missing, and then give no rows rather than an error."""
    base = files.shared_path(spark)
    entries = lambda key, title: F.collect_list(F.struct(F.col(key).alias("id"), F.col(title).alias("title")))
    nation, region = t(spark, sf_dir, "nation"), t(spark, sf_dir, "region")
    written = {
        "routes": nation.agg(F.to_json(entries("n_nationkey", "n_name")).alias("value")), "points": region.agg(F.to_json(F.struct(entries("r_regionkey", "r_name").alias("points"))).alias("value")),
        "projects": spark.range(1).select(F.lit('{"projects": [').alias("value")), "commitments": spark.range(1).select(F.lit('{"commitments": []}').alias("value")),
    }
    for name, text in written.items():
        text.write.text(f"{base}/{name}")
    d = facts(spark, sf_dir).groupBy("district").agg(F.count(F.lit(1)).alias("n"))
    keys = {"routes": d, "points": d.groupBy((F.col("district") % 5).alias("district")).agg(F.sum("n").alias("n")), "projects": d, "commitments": d}
    out = None
    for name, counts in keys.items():
        roster = files.read_roster(spark, f"{base}/{name}", "id int, title string", None if name == "routes" else name, name in ("routes", "points"))
        rows = roster.join(counts, F.col("id") == F.col("district"), "left").select(F.lit(name).alias("roster"), "id", "title", F.coalesce("n", F.lit(0)).alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out
