"""Queries on matching, registrants, files, claims and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.functions.scalars import BUSINESS_SUFFIXES, BUSINESS_TOKENS, business_fold, is_warning, redacted, registrant_class, rfc_time, slug, title_key
from wardspark.operators import claims, gates, matching
from wardspark.plans.registry import query
from wardspark.plans.standins import FACTS, SEGMENTS, facts, segments, t
from wardspark.sources import files

@query("""WITH r AS (SELECT DISTINCT s_suppkey % 12 AS line, upper(p_brand) AS street FROM supplier JOIN part ON p_partkey = s_suppkey)
  SELECT p_partkey AS part, array_to_string(list_sort(list(CAST(line AS VARCHAR))), ',') AS lines FROM part JOIN r ON street = upper(p_brand) WHERE line % 2 = 0 OR p_size BETWEEN 10 AND 30 GROUP BY p_partkey""")
def roster_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-21 FN-1: parts on the lines of a roster by normalised street, some lines clipped to a box."""
    part = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), "p_brand", "p_size", F.concat_ws(" ", "p_brand", F.when(F.col("p_size") % 2 == 0, "St").otherwise("ave")).alias("name"))
    roster = t(spark, sf_dir, "supplier").join(part, F.col("part") == F.col("s_suppkey")).select((F.col("s_suppkey") % 12).alias("line"), F.concat(F.col("p_brand"), F.lit(" Blvd")).alias("street")).distinct()
    odd = F.col("line") % 2 == 1
    on = matching.roster_members(part.drop("p_brand"), roster.withColumns({"low": F.when(odd, 10), "high": F.when(odd, 30)}), "name", "p_size")
    return on.groupBy("part").agg(F.array_join(F.array_sort(F.collect_list(F.col("line").cast("string"))), ",").alias("lines"))


@query("""WITH r AS (SELECT n_nationkey AS line, lower(substring(n_name, 1, 2)) AS token, lower(substring(n_name, 3, 2)) AS veto FROM nation)
  SELECT p_partkey AS part, (SELECT min(line) FROM r WHERE contains(lower(p_name), token) AND NOT contains(lower(p_name), veto)) AS line FROM part""")
def trail_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-22: the first line any of whose tokens a name contains, unless it contains the veto."""
    roster = t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("line"), F.lower(F.substring("n_name", 1, 2)).alias("token"), F.lower(F.substring("n_name", 3, 2)).alias("veto"))
    return matching.token_members(t(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), "p_name"), roster, "p_name").select("part", "line")


_SUFFIXES = "|".join(BUSINESS_SUFFIXES)
_NAMED = """WITH n AS (SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN 'First Bank No ' || CAST(c_custkey % 90 AS VARCHAR) || ' LLC' WHEN 1 THEN 'The ' || c_name || ' Express Co 60601' WHEN 2 THEN NULL WHEN 3 THEN 'Bank' WHEN 4 THEN 'Église ' || c_name ELSE c_name END AS last,
  CASE c_custkey % 6 WHEN 3 THEN 'Ada' WHEN 5 THEN ' ' END AS first, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey % 5 * 25 END AS fine, CASE WHEN c_custkey % 11 = 0 THEN 'Warning issued' ELSE '' END AS note FROM customer)"""
_KIND = f"CASE WHEN trim(coalesce(first, '')) <> '' THEN 'individual' WHEN list_has_any(string_split(trim(regexp_replace(upper(last), '[^A-Z0-9]+', ' ', 'g')), ' '), {list(BUSINESS_TOKENS)}) THEN 'business' ELSE 'unknown' END"
_FOLD = f"trim(regexp_replace(regexp_replace(trim(regexp_replace(upper(shown), '[^A-Z0-9]+', ' ', 'g')), '(^|\\s+)((({_SUFFIXES}|[0-9]{{4,}})(\\s+|$))+)$', ''), '^(({_SUFFIXES})(\\s+|$))+', ''))"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k, at = F.col("c_name"), F.col("c_custkey") % 6, F.col("c_custkey")
    last = F.when(k == 0, F.concat(F.lit("First Bank No "), at % 90, F.lit(" LLC"))).when(k == 1, F.concat(F.lit("The "), c, F.lit(" Express Co 60601"))).when(k == 3, "Bank").when(k == 4, F.concat(F.lit("Église "), c)).when(k == 5, c)
    first = F.when(k == 3, "Ada").when(k == 5, " ")
    fine, note = F.when(at % 7 != 0, at % 5 * 25), F.when(at % 11 == 0, "Warning issued").otherwise("")
    return t(spark, sf_dir, "customer").select(at.alias("id"), last.alias("last"), first.alias("first"), fine.alias("fine"), note.alias("note"))


@query(f"""{_NAMED}, k AS (SELECT *, {_KIND} AS kind, CASE WHEN {_KIND} = 'business' THEN trim(last) ELSE '' END AS shown FROM n)
  SELECT id, kind, CASE WHEN shown = '' THEN '' ELSE {_FOLD} END AS folded, shown, trim(regexp_replace(lower(coalesce(last, '')), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '-') AS slug, trim(regexp_replace(lower(coalesce(last, '')), '\\s+', ' ', 'g')) AS title_key FROM k""")
def registrants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-2 FN-18 FN-19 FN-21 DQ-3: class, folded name and key of each; the name is shown of a business only, and a first name makes a person of anyone."""
    last, first = F.col("last"), F.col("first")
    shown = redacted(last, first)
    text = F.coalesce(last, F.lit(""))
    out = _named(spark, sf_dir).select("id", registrant_class(last, first).alias("kind"), F.when(shown == "", "").otherwise(business_fold(shown)).alias("folded"), shown.alias("shown"), slug(text).alias("slug"), title_key(text).alias("title_key"))
    gates.enforce("names", gates.names_of_individuals(out, "shown", "kind"))
    return out


#: Columns of the public file, in order (fixed values).
PUBLIC = "ticket_number issued_date location ward violation_code violation_description fine ticket_queue is_warning registrant_type registrant registrant_normalized".split()


@query(f"""{_NAMED}, k AS (SELECT *, {_KIND} AS kind, CASE WHEN {_KIND} = 'business' THEN trim(last) ELSE '' END AS shown FROM n)
  SELECT CAST(id AS VARCHAR) AS ticket_number, CAST(NULL AS VARCHAR) AS issued_date, CAST(NULL AS VARCHAR) AS location, CAST(id % 50 AS VARCHAR) AS ward, CAST(NULL AS VARCHAR) AS violation_code, nullif(note, '') AS violation_description, CAST(fine AS VARCHAR) AS fine, CAST(NULL AS VARCHAR) AS ticket_queue,
    CASE WHEN fine IS NULL OR fine = 0 OR contains(upper(note), 'WARNING') THEN 'true' ELSE 'false' END AS is_warning, kind AS registrant_type, nullif(shown, '') AS registrant, CASE WHEN shown <> '' THEN nullif({_FOLD}, '') END AS registrant_normalized FROM k""")
def public_registrants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-9 DQ-3 FN-20: the redacted file with its twelve columns, written as CSV behind the gate and read back; an empty cell reads as null."""
    last, first, text = F.col("last"), F.col("first"), lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    shown = redacted(last, first)
    cells = {
        "ticket_number": text("id"), "ward": (F.col("id") % 50).cast("string"), "violation_description": text("note"), "fine": text("fine"), "is_warning": is_warning(F.col("note"), F.col("fine")).cast("string"),
        "registrant_type": registrant_class(last, first), "registrant": shown, "registrant_normalized": F.when(shown == "", "").otherwise(business_fold(shown)),
    }
    out = _named(spark, sf_dir).select(*[cells.get(c, F.lit("")).alias(c) for c in PUBLIC])
    gates.enforce("names", gates.names_of_individuals(out, "registrant", "registrant_type"))
    path = files.shared_path(spark)
    files.write_csv(out, path, ["registrants, names of businesses only"])
    return spark.read.option("header", True).option("escape", '"').schema(", ".join(f"{c} string" for c in PUBLIC)).csv(path)


@query(f"""{_NAMED}, k AS (SELECT {_KIND} AS kind, fine IS NULL OR fine = 0 OR contains(upper(note), 'WARNING') AS warning FROM n) SELECT kind, count(*) AS n, round(avg(CASE WHEN warning THEN 1e0 ELSE 0e0 END), 4) AS warnings FROM k GROUP BY kind""")
def redaction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-43 FN-20: registrants by class and the share of warnings."""
    warning = is_warning(F.col("note"), F.col("fine"))
    return _named(spark, sf_dir).groupBy(registrant_class(F.col("last"), F.col("first")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(warning.cast("double")), 4).alias("warnings"))


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS published FROM orders")
def feed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-12: dates of feeds read back to UTC."""
    said = F.date_format("o_orderdate", "EEE, d MMM yyyy HH:mm:ss Z")
    return t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.date_format(rfc_time(said), "yyyy-MM-dd HH:mm:ss").alias("published"))


@query(f"""WITH {SEGMENTS} SELECT seg_id, round(x1, 5) AS first_x, round(y2, 5) AS last_y, CAST(corridor AS VARCHAR) AS corridor FROM segments""")
def feature_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-7: lines written as features and read again."""
    line = F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))
    text = segments(spark, sf_dir).select(files.feature(line, {"seg": F.col("seg_id"), "corridor": F.col("corridor")}).alias("value"))
    path = files.shared_path(spark)
    text.write.text(path)
    f = spark.read.text(path).select(F.from_json("value", files.FEATURE).alias("f")).select("f.*")
    return f.select(F.col("properties")["seg"].cast("long").alias("seg_id"), F.col("geometry.coordinates")[0][0].alias("first_x"), F.col("geometry.coordinates")[1][1].alias("last_y"), F.col("properties")["corridor"].alias("corridor"))


@query("""WITH m AS (SELECT max(date_trunc('month', o_orderdate)) AS m FROM orders) SELECT o_orderkey AS id, coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END, '—') AS status, strftime(o_orderdate, '%Y%m') AS period FROM orders, m WHERE date_trunc('month', o_orderdate) = m""")
def latest_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-6 SRC-7 SNK-4 SNK-5: monthly CSV members with provenance beside them; the newest month is read."""
    o, path = t(spark, sf_dir, "orders"), files.shared_path(spark)
    rows = o.select(F.col("o_orderkey").alias("id"), F.coalesce(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")), F.lit("—")).alias("status"), F.date_format("o_orderdate", "yyyyMM").alias("m"))
    last = rows.agg(F.max("m")).first()[0] or ""
    for period, part in ((last, rows.filter(F.col("m") == last)), ("190001", rows.filter(F.col("m") != last))):
        files.write_csv(part.drop("m"), f"{path}/{period}-trips", ["orders", "one row each"])
    return files.latest_period(files.read_members(spark, path, "id long, status string").select("*", "_metadata")).select("id", "status", "period")


@query("""SELECT strftime(o_orderdate, '%Y') || '-01-01' AS snapshot_date, count(*) FILTER (year(o_orderdate) < 2000 OR o_orderstatus <> 'P') AS n FROM orders GROUP BY 1 HAVING count(*) FILTER (year(o_orderdate) < 2000 OR o_orderstatus <> 'P') > 0""")
def dated_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-8: dated copies of all runs from one scan; a later run of some days, again one write, replaces these days only."""
    o, path = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("-01-01")).alias("snapshot_date")), files.shared_path(spark)
    files.append_snapshots(o, path)
    files.append_snapshots(o.filter("snapshot_date >= '2000-01-01' and o_orderstatus <> 'P'"), path)
    return spark.read.option("recursiveFileLookup", False).parquet(path).groupBy(F.col("snapshot_date").cast("string").alias("snapshot_date")).agg(F.count(F.lit(1)).alias("n"))


_CLAIMS = """WITH c AS (SELECT l_suppkey AS id, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1),
  k AS (SELECT *, CASE WHEN id % 13 = 0 THEN returned + 2007 ELSE returned END AS said FROM c)"""


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a restated count (thousands separated), and brackets that are dates, a reference, or a number that begins like a year."""
    c = t(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    said = F.when(F.col("id") % 13 == 0, F.col("returned") + 2007).otherwise(F.col("returned"))
    prose = F.when(F.col("id") % 5 == 0, "provisional counts").otherwise("counts")
    text = F.format_string("%d lines ( %s returned ) since 1995 (1995-01), (May 2026), (2026-07-11 to 2026-07-13), (2021), (see note 7), %s", F.col("n"), F.format_number(said, 0), prose)
    referent = F.when(F.col("id") % 17 == 0, F.lit("counts only")).otherwise(text)
    tags = F.array_union(claims.small_n([F.col("n"), F.col("returned")]), F.when(F.col("id") % 10 < 6, F.array(F.lit("provisional"))).otherwise(F.array().cast("array<string>")))
    return c.select("*", referent.alias("text"), tags.alias("tags"))


@query(f"{_CLAIMS} SELECT id, CAST(returned AS BIGINT) AS returned, said FROM k WHERE said <> returned AND said <> n AND id % 17 <> 0")
def misstated_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ-8 FN-26: claims whose text restates a number that is not theirs; only brackets that are dates as a whole are exempt."""
    bad = claims.misstated(_claims(spark, sf_dir), "text", ["n", "returned"])
    return bad.select("id", "returned", F.get(claims.restated_values(F.col("text")), F.lit(0)).cast("long").alias("said"))


@query(f"{_CLAIMS} SELECT id, n < 20 OR returned < 20 AS small FROM k WHERE (id % 10 < 6 AND (id % 5 <> 0 OR id % 17 = 0)) OR id % 17 = 0")
def mistagged_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ-9 FN-27: claims tagged provisional without saying so, with a foreign tag, or whose text names no date or window."""
    return claims.badly_tagged(_claims(spark, sf_dir), "tags", "text", r"[0-9]{4}").select("id", F.array_contains("tags", "small-n").alias("small"))


@query(f"""{_CLAIMS} SELECT id, CASE WHEN n < 20 OR returned < 20 THEN 'Counts are small (' || CAST(returned AS VARCHAR) || ' returned of ' || CAST(n AS VARCHAR) || '), so the share moves by chance.' ELSE 'Counted over all years (' || CAST(n AS VARCHAR) || ' lines).' END AS caveat,
  CASE WHEN n < 20 OR returned < 20 THEN 'small-n' ELSE '' END AS tags FROM k""")
def qualified_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-28 FN-29: each record with its caveat, made of its own values, and its tags put inside the record by field."""
    c = _claims(spark, sf_dir).select("id", F.struct("n", "returned").alias("record"))
    tags = claims.small_n([F.col("record.n"), F.col("record.returned")])
    few = F.format_string("Counts are small (%d returned of %d), so the share moves by chance.", F.col("record.returned"), F.col("record.n"))
    caveat = F.when(F.size(tags) > 0, few).otherwise(F.format_string("Counted over all years (%d lines).", F.col("record.n")))
    told = c.withColumn("record", F.col("record").withField("caveat", caveat).withField("caveat_tags", tags))
    return told.select("id", "record.caveat", F.array_join("record.caveat_tags", ",").alias("tags"))


@query("""WITH c AS (SELECT o_orderkey AS id, o_orderpriority AS stem, o_orderstatus AS caveat FROM orders), f AS (SELECT stem, caveat, min(id) AS first_id, count(*) AS n FROM c GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY first_id) AS k FROM f)
  SELECT CASE WHEN k = 1 THEN stem ELSE stem || '-' || CAST(k AS VARCHAR) END AS caveat_key, caveat, n FROM r""")
def shared_caveats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-30: equal caveats share a key, suffixed in the order first seen."""
    c = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("stem"), F.col("o_orderstatus").alias("caveat"))
    return claims.caveat_keys(c, "stem", "caveat", "id", "caveat_key").groupBy("caveat_key", "caveat").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT 'seg-' || CAST(n_nationkey AS VARCHAR) AS selector FROM nation), c AS (SELECT 'seg-' || CAST(s_nationkey AS VARCHAR) AS selector, CASE WHEN s_suppkey % 4 <> 0 THEN 'live' END AS tier FROM supplier)
  SELECT DISTINCT selector, 'unqualified' AS problem FROM c JOIN s USING (selector) WHERE tier IS NULL UNION ALL SELECT selector, 'no claim' FROM s WHERE selector NOT IN (SELECT selector FROM c)""")
def unqualified_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ-7: enforced claims that lack a tier, and selectors that hit no claim."""
    name = lambda k: F.concat(F.lit("seg-"), F.col(k).cast("string")).alias("selector")
    c = t(spark, sf_dir, "supplier").select(name("s_nationkey"), F.when(F.col("s_suppkey") % 4 != 0, "live").alias("tier"))
    return claims.unqualified(c, t(spark, sf_dir, "nation").select(name("n_nationkey")), ["tier"])


@query(f"""WITH {FACTS}, e AS (SELECT max(day) AS d FROM facts), w AS (SELECT district, d, count(*) FILTER (day > d - 365) AS recent, count(*) FILTER (day > d - 730 AND day <= d - 365) AS prior FROM facts, e GROUP BY district, d)
  SELECT district, CASE WHEN district % 6 = 1 THEN 'window_end' WHEN district % 6 = 2 THEN 'recent' ELSE 'prior' END AS fault FROM w WHERE district % 6 IN (1, 2, 3)""")
def disagreeing_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ-1: a trend and its windows must share the anchor and both counts; a trend without counts must still share the anchor.  By the key's rest by 6 the trend is altered here: 1 the anchor, 2 the recent count, 3 the prior one, 4 has no counts, 5 neither counts nor anything wrong."""
    f, k = facts(spark, sf_dir), F.col("district") % 6
    end = f.agg(F.max("day").alias("end"))
    back = lambda n: F.date_sub("end", n)
    windows = f.crossJoin(F.broadcast(end)).groupBy("district", F.col("end").alias("window_end")).agg(F.count_if(F.col("day") > F.date_sub("end", 365)).alias("recent"), F.count_if((F.col("day") > back(730)) & (F.col("day") <= back(365))).alias("prior"))  # one row
    told = lambda c, at: F.when(k < 4, F.col(c) + F.when(k == at, 1).otherwise(0))
    trend = windows.select("district", F.when(k == 1, F.date_add("window_end", 1)).otherwise(F.col("window_end")).alias("window_end"), told("recent", 2).alias("recent"), told("prior", 3).alias("prior"))
    return gates.trend_faults(trend, windows, "district")


@query("""WITH p AS (SELECT l_orderkey AS id, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1) SELECT o_orderkey AS id FROM orders LEFT JOIN p ON id = o_orderkey WHERE abs(coalesce(n, 0) - 4) > 1.5""")
def unreconciled_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ-12: totals that the sum of their parts misses by more than the tolerance."""
    parts = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.lit(1.0).alias("part"))
    totals = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit(4.0).alias("total"))
    return gates.unreconciled(parts, totals, "id", "part", "total", 1.5).select("id")
