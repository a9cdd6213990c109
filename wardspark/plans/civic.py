"""Queries on dated facts, rosters, councils and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardspark.functions.scalars import count_display, days_before, ratio
from wardspark.operators import ranking, temporal
from wardspark.plans.registry import query
from wardspark.plans.standins import FACTS, facts, t


def _measures() -> dict[str, Column]:
    return {"total": F.lit(True), "urgent": F.col("priority") == "1-URGENT", "open": F.col("status") == "O"}


@query(f"""WITH {FACTS}, m AS (SELECT unnest(generate_series(date_trunc('month', min(day)), date_trunc('month', max(day)), INTERVAL 1 MONTH)) AS s FROM facts)
  SELECT strftime(s, '%Y-%m') AS month, count(id) AS total, count(id) FILTER (priority = '1-URGENT') AS urgent, count(id) FILTER (status = 'O') AS open FROM m LEFT JOIN facts ON date_trunc('month', day) = s GROUP BY s""")
def monthly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-6 FN-10: every month between the first and the last, zero where nothing happened."""
    return temporal.monthly(facts(spark, sf_dir), "day", _measures())


@query(f"""WITH {FACTS}, m AS (SELECT unnest(generate_series(date_trunc('month', min(day)), date_trunc('month', max(day)), INTERVAL 1 MONTH)) AS s FROM facts)
  SELECT n_nationkey AS district, strftime(s, '%Y-%m') AS month, count(id) AS total, count(id) FILTER (priority = '1-URGENT') AS urgent, count(id) FILTER (status = 'O') AS open
  FROM m CROSS JOIN nation LEFT JOIN facts ON date_trunc('month', day) = s AND district = n_nationkey GROUP BY n_nationkey, s""")
def monthly_by_district(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-7: the same for each district; a district without rows gets zeros."""
    keys = t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("district"))
    return temporal.monthly(facts(spark, sf_dir), "day", _measures(), keys)


# District 3 begins late, so it has no trend though the others have.
_LATE = "day >= DATE '2000-06-01' OR district <> 3"
_WINDOWS = f"""WITH {FACTS}, l AS (SELECT * FROM facts WHERE {_LATE}), a AS (SELECT max(day) AS anchor FROM l),
  w AS (SELECT district, count(*) FILTER (day > anchor - 365) AS recent, count(*) FILTER (day > anchor - 730 AND day <= anchor - 365) AS prior,
    count(*) FILTER (day > anchor - 365 AND priority = '1-URGENT') AS recent_urgent, count(*) FILTER (day > anchor - 730 AND day <= anchor - 365 AND priority = '1-URGENT') AS prior_urgent, min(day) AS earliest, first(anchor) AS anchor FROM l, a GROUP BY district)"""


@query(f"""{_WINDOWS}, p AS (SELECT *, earliest <= anchor - 730 AS enough, CASE WHEN earliest <= anchor - 730 AND prior > 0 THEN round((recent - prior) * 100e0 / prior, 1) END AS pct FROM w)
  SELECT district, CASE WHEN enough THEN recent END AS recent, CASE WHEN enough THEN prior END AS prior, recent_urgent, prior_urgent, strftime(anchor, '%Y-%m-%d') AS anchor, pct,
    CASE WHEN pct <= -5 THEN 'improving' WHEN pct >= 5 THEN 'worsening' WHEN pct IS NOT NULL THEN 'flat' ELSE 'insufficient_data' END AS direction FROM p""")
def district_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-8 AGG-9 WIN-13: two trailing windows against the global anchor, change and direction; a district whose own facts begin late has none."""
    late = facts(spark, sf_dir).filter("day >= date'2000-06-01' or district <> 3")
    out = temporal.trend(temporal.trailing_windows(late, "day", "district", {"urgent": F.col("priority") == "1-URGENT"}))
    return out.select("district", "recent", "prior", "recent_urgent", "prior_urgent", F.date_format("anchor", "yyyy-MM-dd").alias("anchor"), "pct", "direction")


@query(f"""WITH {FACTS}, m AS (SELECT strftime(day, '%Y-%m') AS month, count(*) AS total FROM facts GROUP BY 1),
  s AS (SELECT month, total, CAST(sum(total) OVER w AS BIGINT) AS total_12, row_number() OVER (ORDER BY month) AS n, row_number() OVER (ORDER BY month DESC) <= 2 AS provisional FROM m WINDOW w AS (ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
  SELECT month, total, total_12, provisional FROM s WHERE n >= 12""")
def trailing_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-5 WIN-6: trailing 12-month sums without incomplete windows; the last two months are provisional."""
    series = temporal.monthly(facts(spark, sf_dir), "day", {"total": F.lit(True)}).withColumn("one", F.lit(1))
    return temporal.provisional_tail(temporal.trailing_sum(series, "month", "total", 12, ["one"]), "month", ["one"]).drop("one")


@query("""SELECT l_returnflag AS kind, round(avg(CASE WHEN l_linestatus = 'F' THEN 1e0 ELSE 0e0 END) * 100, 4) AS pct_all, round(CASE WHEN count(*) FILTER (l_quantity > 25) > 0 THEN count(*) FILTER (l_quantity > 25 AND l_linestatus = 'F') * 100e0 / count(*) FILTER (l_quantity > 25) END, 4) AS pct_large FROM lineitem GROUP BY 1""")
def flagged_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-10: share of flagged rows, of all and of the large ones."""
    li, done, large = t(spark, sf_dir, "lineitem"), F.col("l_linestatus") == "F", F.col("l_quantity") > 25
    return li.groupBy(F.col("l_returnflag").alias("kind")).agg(F.round(F.avg(done.cast("double")) * 100, 4).alias("pct_all"), F.round(ratio(F.count_if(done & large), F.count_if(large), 100.0), 4).alias("pct_large"))


@query(f"""WITH {FACTS} SELECT district, round(sum(price) FILTER (priority = '1-URGENT') * 100 / sum(price), 3) AS top_share, round(sum(price) FILTER (priority IN ('1-URGENT', '2-HIGH')) * 100 / sum(price), 3) AS upper_share FROM facts WHERE priority <> '5-LOW' GROUP BY district""")
def category_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-11: shares of two nested categories; one category is left out of both sides."""
    f = facts(spark, sf_dir).filter("priority <> '5-LOW'").groupBy("district")
    part = lambda *p: F.sum(F.when(F.col("priority").isin(*p), F.col("price"))) * 100 / F.sum("price")
    return f.agg(F.round(part("1-URGENT"), 3).alias("top_share"), F.round(part("1-URGENT", "2-HIGH"), 3).alias("upper_share"))


@query(f"""WITH {FACTS}, a AS (SELECT CAST(year(day) AS INTEGER) AS y, status, count(*) AS n FROM facts GROUP BY ALL)
  SELECT y, 'history' AS source, CAST(sum(n) AS BIGINT) AS total, CAST(NULL AS BIGINT) AS pending FROM a WHERE y < 1998 GROUP BY y
  UNION ALL SELECT y, 'snapshot', CAST(sum(n) AS BIGINT), CAST(sum(CASE WHEN status = 'P' THEN n ELSE 0 END) AS BIGINT) FROM a WHERE y >= 1998 GROUP BY y""")
def spliced_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-2: history and snapshots as one series, with a column that only one side has."""
    a = facts(spark, sf_dir).withColumn("y", F.year("day"))
    old = a.filter("y < 1998").groupBy("y").agg(F.count(F.lit(1)).alias("total")).withColumn("source", F.lit("history"))
    new = a.filter("y >= 1998").groupBy("y").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "P").alias("pending")).withColumn("source", F.lit("snapshot"))
    return old.unionByName(new, allowMissingColumns=True)


@query("""WITH d AS (SELECT CASE WHEN l_orderkey % 50 <> 0 THEN l_suppkey END AS camera, CASE WHEN l_linenumber % 2 = 0 THEN 'red' ELSE 'speed' END AS kind, CASE WHEN l_orderkey % 13 <> 0 THEN strftime(l_shipdate, '%Y-%m-%d') END AS day, l_orderkey, l_linenumber,
    CASE WHEN l_orderkey % 7 = 1 THEN NULL WHEN l_orderkey % 7 = 2 THEN 'n/a' WHEN l_orderkey % 7 = 3 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '.9' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS violations,
    CASE WHEN l_orderkey % 5 = 0 THEN NULL WHEN l_orderkey % 11 = 0 THEN 'x' ELSE CAST(41 + l_linenumber / 8e0 AS VARCHAR) END AS lat, CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE CAST(-87 - l_orderkey % 16 / 16e0 AS VARCHAR) END AS lon FROM lineitem),
  p AS (SELECT *, CAST(trunc(TRY_CAST(violations AS DOUBLE)) AS BIGINT) AS n, TRY_CAST(lat AS DOUBLE) AS y, TRY_CAST(lon AS DOUBLE) AS x FROM d WHERE camera IS NOT NULL)
  SELECT camera, kind, CAST(coalesce(sum(n), 0) AS BIGINT) AS violations, min(day) AS first_day, max(day) AS last_day, arg_max(y, (l_orderkey, l_linenumber)) FILTER (x IS NOT NULL AND y IS NOT NULL) AS lat, arg_max(x, (l_orderkey, l_linenumber)) FILTER (x IS NOT NULL AND y IS NOT NULL) AS lon FROM p GROUP BY camera, kind""")
def camera_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-16: per device and kind the total of the counts that can be read, cut to whole numbers, first and last day, and the last place of which both coordinates can be read; rows without a device go."""
    k, n = F.col("l_orderkey"), F.col("l_quantity").cast("long").cast("string")
    days = t(spark, sf_dir, "lineitem").select(
        F.when(k % 50 != 0, F.col("l_suppkey")).alias("camera"), F.when(F.col("l_linenumber") % 2 == 0, "red").otherwise("speed").alias("kind"), F.when(k % 13 != 0, F.date_format("l_shipdate", "yyyy-MM-dd")).alias("day"), F.struct(k, F.col("l_linenumber")).alias("at"),
        F.when(k % 7 == 1, F.lit(None)).when(k % 7 == 2, "n/a").when(k % 7 == 3, F.concat(n, F.lit(".9"))).otherwise(n).alias("violations"),
        F.when(k % 5 == 0, F.lit(None)).when(k % 11 == 0, "x").otherwise((41 + F.col("l_linenumber") / 8).cast("string")).alias("lat"), F.when(k % 9 != 0, (-87 - k % 16 / 16).cast("string")).alias("lon"),
    )
    lat, lon = (F.col(c).try_cast("double") for c in ("lat", "lon"))
    place = F.max(F.when(lat.isNotNull() & lon.isNotNull(), F.struct("at", lat.alias("lat"), lon.alias("lon"))))
    rolled = days.filter("camera is not null").groupBy("camera", "kind").agg(F.coalesce(F.sum(F.col("violations").try_cast("double").try_cast("long")), F.lit(0)).alias("violations"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), place.alias("p"))
    return rolled.select("camera", "kind", "violations", "first_day", "last_day", "p.lat", "p.lon")


@query(f"""WITH {FACTS}, d AS (SELECT district, count(*) AS n FROM facts GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, district) AS rn FROM d)
  SELECT round(median(n), 2) AS median_n, CAST(count(*) AS BIGINT) AS districts, round(avg(n), 3) AS mean_n, round(sum(n) FILTER (rn <= 5) * 100e0 / sum(n), 3) AS top5_share FROM r""")
def district_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-36 AGG-37: median, mean and the share of the five largest districts."""
    d = facts(spark, sf_dir).groupBy("district").agg(F.count(F.lit(1)).alias("n"))
    r = d.withColumn("rn", F.row_number().over(Window.orderBy(F.col("n").desc(), "district")))
    return r.agg(F.round(F.median("n"), 2).alias("median_n"), F.count(F.lit(1)).alias("districts"), F.round(F.avg("n"), 3).alias("mean_n"), F.round(F.sum(F.when(F.col("rn") <= 5, F.col("n"))) * 100.0 / F.sum("n"), 3).alias("top5_share"))


@query("""WITH c AS (SELECT c_nationkey, c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 3000), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS place FROM c) SELECT c_nationkey AS district, c_custkey AS peer, place FROM r WHERE place <= 3""")
def large_peer_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-11 WIN-14: rank among the large ones only, first three of each district."""
    c = t(spark, sf_dir, "customer").filter("c_acctbal >= 3000")
    return ranking.top_k(c, ["c_nationkey"], [F.col("c_acctbal").desc(), "c_custkey"], 3).select(F.col("c_nationkey").alias("district"), F.col("c_custkey").alias("peer"), F.col("rank").alias("place"))


@query(f"""WITH {FACTS}, y AS (SELECT district, CAST(year(day) AS INTEGER) AS y, count(*) AS n FROM facts GROUP BY ALL), l AS (SELECT district, max(y) AS last FROM y GROUP BY 1)
  SELECT y.district, arg_min(y.y, y.y) AS base_year, arg_min(n, y.y) AS base_n, arg_max(n, y.y) AS last_n FROM y JOIN l ON y.district = l.district AND y >= last - 2 GROUP BY y.district""")
def trend_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-12 AGG-23: the earliest entry within two years before the latest, and the latest."""
    y = facts(spark, sf_dir).groupBy("district", F.year("day").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    w = y.withColumn("last", F.max("y").over(Window.partitionBy("district"))).filter(F.col("y") >= F.col("last") - 2)
    return w.groupBy("district").agg(F.min("y").alias("base_year"), F.min_by("n", "y").alias("base_n"), F.max_by("n", "y").alias("last_n"))


@query("""WITH n AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT event_type, n, round(n * 100e0 / sum(n) OVER (), 3) AS pct, CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'click' THEN 4 ELSE 5 END AS level FROM n WHERE n > 0""")
def share_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-35 ORD-2: share per level, in a fixed order."""
    n = t(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    level = F.coalesce(F.create_map(*[F.lit(x) for kv in {"error": 1, "purchase": 2, "signup": 3, "click": 4}.items() for x in kv])[F.col("event_type")], F.lit(5))
    return n.filter("n > 0").select("event_type", "n", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(1))), 3).alias("pct"), level.alias("level")).orderBy("level")


@query("""WITH s AS (SELECT l_suppkey AS sponsor, o_orderkey AS matter, o_orderpriority IN ('1-URGENT', '2-HIGH') AS relevant, o_orderstatus FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
  SELECT sponsor, count(*) AS total, count(*) FILTER (relevant) AS relevant, count(*) FILTER (o_orderstatus = 'F') AS no_votes, CAST(row_number() OVER (ORDER BY count(*) FILTER (relevant) DESC, count(*) FILTER (o_orderstatus = 'F') DESC, sponsor) AS INTEGER) AS place FROM s GROUP BY sponsor""")
def sponsor_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ORD-8: matters per sponsor, relevant ones and votes, numbered in published order by ranges of it."""
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    s = t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("sponsor")).distinct().join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    r = s.groupBy("sponsor").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("relevant"), F.count_if(F.col("o_orderstatus") == "F").alias("no_votes"))
    return ranking.numbered(r, [F.col("relevant").desc(), F.col("no_votes").desc(), F.col("sponsor")], "place")


@query("""SELECT l_orderkey AS bill, count(*) FILTER (l_returnflag = 'A') AS yes, count(*) FILTER (l_returnflag = 'R') AS no, count(*) FILTER (l_returnflag = 'N') AS absent,
  array_to_string(list_sort(list_distinct(list(CASE WHEN l_returnflag = 'R' THEN lpad(CAST(l_suppkey AS VARCHAR), 6, '0') END))), '; ') AS dissent, arg_min(l_suppkey, (l_linenumber, l_suppkey)) AS primary_sponsor FROM lineitem GROUP BY l_orderkey""")
def vote_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-20: tallies with the sorted set of dissenters, and the primary sponsor."""
    v = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("bill"))
    who = F.when(F.col("l_returnflag") == "R", F.lpad(F.col("l_suppkey").cast("string"), 6, "0"))
    flag = lambda c: F.count_if(F.col("l_returnflag") == c)
    return v.agg(flag("A").alias("yes"), flag("R").alias("no"), flag("N").alias("absent"), F.array_join(F.array_sort(F.collect_set(who)), "; ").alias("dissent"), F.min_by("l_suppkey", F.struct("l_linenumber", "l_suppkey")).alias("primary_sponsor"))


_BILLS = """SELECT b.c_custkey AS id, b.c_name AS title, strftime(max(a.o_orderdate), '%Y-%m-%d') AS last_action,
    (SELECT a2.o_orderstatus || ' ' || a2.o_orderpriority FROM {actions} a2 WHERE a2.o_custkey = b.c_custkey ORDER BY a2.o_orderdate DESC, a2.o_orderkey DESC LIMIT 1) AS status,
    (SELECT strftime(min(a3.o_orderdate), '%Y-%m-%d') FROM {actions} a3 WHERE a3.o_custkey = b.c_custkey) AS intro_date
  FROM {bills} b JOIN {actions} a ON a.o_custkey = b.c_custkey WHERE lower(b.c_name) LIKE '%1%' OR lower(b.c_mktsegment) LIKE '%auto%'
  GROUP BY b.c_custkey, b.c_name HAVING CAST(max(a.o_orderdate) AS DATE) > DATE '2000-01-01'"""

_SPARK_BILLS = """SELECT g.id, g.title, date_format(g.last_action, 'yyyy-MM-dd') AS last_action,
    (SELECT max_by(a2.o_orderstatus || ' ' || a2.o_orderpriority, struct(a2.o_orderdate, a2.o_orderkey)) FROM w_actions a2 WHERE a2.o_custkey = g.id) AS status,
    (SELECT date_format(min(a3.o_orderdate), 'yyyy-MM-dd') FROM w_actions a3 WHERE a3.o_custkey = g.id) AS intro_date
  FROM (SELECT b.c_custkey AS id, b.c_name AS title, max(a.o_orderdate) AS last_action FROM w_bills b JOIN w_actions a ON a.o_custkey = b.c_custkey
    WHERE lower(b.c_name) LIKE '%1%' OR lower(b.c_mktsegment) LIKE '%auto%' GROUP BY b.c_custkey, b.c_name HAVING date(max(a.o_orderdate)) > date'2000-01-01') g"""


@query(_BILLS.format(bills="customer", actions="orders"))
def bills_last_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-11 AGG-24: bills with any of some words joined to their actions, grouped, those acted on since a date kept, with the last status and the first day by two subqueries for each bill; in SQL, which the planner turns into joins."""
    t(spark, sf_dir, "orders").createOrReplaceTempView("w_actions")
    t(spark, sf_dir, "customer").createOrReplaceTempView("w_bills")
    return spark.sql(_SPARK_BILLS)


@query("""SELECT d.doc_id, CASE WHEN d.doc_id % 7 = 0 THEN 9 ELSE l.quality END AS topic, CASE WHEN d.doc_id % 7 = 0 THEN 'correction' ELSE 'tag' END AS via FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.doc_id % 7 = 0 OR l.quality IS NOT NULL""")
def resolved_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-17: a correction beats a tag; rows with neither go; provenance is kept."""
    d = t(spark, sf_dir, "documents").select("doc_id")
    corrections = d.filter("doc_id % 7 = 0").withColumn("fixed", F.lit(9))
    j = d.join(corrections, "doc_id", "left").join(t(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    via = F.when(F.col("fixed").isNotNull(), "correction").otherwise("tag")
    return j.select("doc_id", F.coalesce("fixed", "quality").alias("topic"), via.alias("via")).filter("topic is not null")


@query("SELECT doc_id FROM documents WHERE doc_id % 7 <> 0 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def untagged_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-18: what is in neither the cache nor the corrections."""
    d = t(spark, sf_dir, "documents").select("doc_id")
    return d.join(d.filter("doc_id % 7 = 0"), "doc_id", "left_anti").join(t(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("""SELECT s_suppkey AS id, CASE WHEN EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s_nationkey AND c_custkey = s_suppkey) THEN 'matched' ELSE 'unmatched' END AS state, s_nationkey AS district FROM supplier""")
def composite_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-16: exact match on two columns, the rest listed as unmatched."""
    s = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("district"))
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("district")).distinct()
    hit = s.join(c, ["id", "district"], "left_semi").withColumn("state", F.lit("matched"))
    return hit.unionByName(s.join(c, ["id", "district"], "left_anti").withColumn("state", F.lit("unmatched")))


@query("""SELECT s_suppkey AS id, coalesce(a.c_custkey, b.c_custkey) AS member, CASE WHEN a.c_custkey IS NOT NULL THEN 'ward' WHEN b.c_custkey IS NOT NULL THEN 'name' END AS how
  FROM supplier LEFT JOIN (SELECT c_nationkey, min(c_custkey) AS c_custkey FROM customer WHERE c_acctbal > 9900 GROUP BY 1) a ON c_nationkey = s_nationkey LEFT JOIN customer b ON b.c_custkey = s_suppkey""")
def fallback_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-29: by district first, else by exact key."""
    c = t(spark, sf_dir, "customer")
    a = c.filter("c_acctbal > 9900").groupBy(F.col("c_nationkey").alias("district")).agg(F.min("c_custkey").alias("a"))
    s = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("district"))
    j = s.join(a, "district", "left").join(c.select(F.col("c_custkey").alias("b")), F.col("b") == F.col("id"), "left")
    return j.select("id", F.coalesce("a", "b").alias("member"), F.when(F.col("a").isNotNull(), "ward").when(F.col("b").isNotNull(), "name").alias("how"))


@query(f"""WITH {FACTS}, p AS (SELECT *, row_number() OVER (ORDER BY day DESC, id) AS rn FROM facts) SELECT id, strftime(day, '%Y-%m-%d') AS day FROM p WHERE rn <= 60 OR (price > 330000 AND status = 'P')""")
def newest_with_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ORD-5: the newest 60, and matches beyond the cap survive it; top-k and filter, no global window."""
    f = facts(spark, sf_dir)
    newest = f.orderBy(F.col("day").desc(), "id").limit(60)
    return newest.unionByName(f.filter("price > 330000 and status = 'P'")).select("id", F.date_format("day", "yyyy-MM-dd").alias("day")).distinct()


@query(f"""WITH {FACTS}, k AS (SELECT *, row_number() OVER (PARTITION BY district ORDER BY day DESC, id) AS rn FROM facts) SELECT district, array_to_string(list(CAST(id AS VARCHAR) ORDER BY rn), ',') AS newest FROM k WHERE rn <= 8 GROUP BY district""")
def newest_per_district(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-14: the newest eight of each as a list."""
    k = ranking.top_k(facts(spark, sf_dir), ["district"], [F.col("day").desc(), "id"], 8)
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.col("id").cast("string").alias("id"))))
    return k.groupBy("district").agg(F.array_join(F.transform(ordered, lambda x: x.id), ",").alias("newest"))


@query("""WITH h AS (SELECT o_orderkey, md5(CAST(o_orderkey AS VARCHAR)) AS full_id FROM orders), n AS (SELECT *, count(*) OVER (PARTITION BY left(full_id, 3)) AS same FROM h) SELECT o_orderkey AS id, CASE WHEN same > 1 THEN full_id ELSE left(full_id, 3) END AS short_id FROM n""")
def short_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-15: an id prefix where it is unique, else the full id."""
    h = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("full_id"))
    same = F.count(F.lit(1)).over(Window.partitionBy(F.substring("full_id", 1, 3)))
    return h.select("id", F.when(same > 1, F.col("full_id")).otherwise(F.substring("full_id", 1, 3)).alias("short_id"))


@query("""WITH b AS (SELECT l_orderkey AS segment, array_to_string(list_sort(list_distinct(list(CAST(l_suppkey % 10 AS VARCHAR)))), '|') AS lines FROM lineitem GROUP BY 1) SELECT lines, count(*) AS segments, min(segment) AS first_segment FROM b GROUP BY lines""")
def shared_track_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-41: segments grouped by their sorted set of lines."""
    lines = F.array_join(F.array_sort(F.collect_set((F.col("l_suppkey") % 10).cast("string"))), "|")
    b = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("segment")).agg(lines.alias("lines"))
    return b.groupBy("lines").agg(F.count(F.lit(1)).alias("segments"), F.min("segment").alias("first_segment"))


@query("""WITH p AS (SELECT nullif(CASE WHEN p_size % 9 = 0 THEN '' ELSE p_brand END, '') AS street, p_size, p_retailprice FROM part) SELECT coalesce(street, '(unnamed)') AS corridor, count(*) AS n, min(p_size) AS low, max(p_size) AS high FROM p GROUP BY 1""")
def named_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-42: groups with a bucket for the unnamed, and the union of their ranges."""
    street = F.nullif(F.when(F.col("p_size") % 9 == 0, "").otherwise(F.col("p_brand")), F.lit(""))
    return t(spark, sf_dir, "part").groupBy(F.coalesce(street, F.lit("(unnamed)")).alias("corridor")).agg(F.count(F.lit(1)).alias("n"), F.min("p_size").alias("low"), F.max("p_size").alias("high"))


@query("""SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_orderdate >= TIMESTAMP '1999-06-01'""")
def looked_up_by_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-1 SRC-2 JON-10: rows by a list of keys, the filter pushed to the scan."""
    keys = t(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey").distinct()
    o = t(spark, sf_dir, "orders").filter("o_orderdate >= timestamp'1999-06-01'")
    return o.join(keys, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))


@query("""SELECT o_orderkey AS id, strftime(CAST(o_orderdate AS DATE) - 30, '%Y-%m-%d') AS since, CASE WHEN o_orderkey < 1000 THEN CAST(o_orderkey AS VARCHAR) WHEN o_orderkey < 10000 THEN 'about ' || format('{:,}', CAST(floor((o_orderkey + 50e0) / 100) * 100 AS BIGINT)) ELSE 'about ' || format('{:,}', CAST(floor((o_orderkey + 500e0) / 1000) * 1000 AS BIGINT)) END AS shown FROM orders""")
def display_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-24 FN-32: rounded counts and a date some days earlier."""
    o = t(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), days_before(F.date_format("o_orderdate", "yyyy-MM-dd"), 30).alias("since"), count_display(F.col("o_orderkey")).alias("shown"))


@query("""SELECT * FROM (SELECT 'orders' AS source, count(*) AS records, strftime(min(o_orderdate), '%Y-%m-%d') AS first_day, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day FROM orders UNION ALL SELECT 'lineitem', count(*), strftime(min(l_shipdate), '%Y-%m-%d'), strftime(max(l_shipdate), '%Y-%m-%d') FROM lineitem UNION ALL SELECT 'events', count(*), strftime(min(ts), '%Y-%m-%d'), strftime(max(ts), '%Y-%m-%d') FROM events) WHERE records > 0""")
def source_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-11: records and dates of each source that is not empty."""
    out = None
    for name, day in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts")):
        row = t(spark, sf_dir, name).agg(F.lit(name).alias("source"), F.count(F.lit(1)).alias("records"), F.date_format(F.min(day), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max(day), "yyyy-MM-dd").alias("last_day")).filter("records > 0")
        out = row if out is None else out.unionByName(row)
    return out
