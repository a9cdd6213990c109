"""Queries on news items, agendas and council records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardspark.functions.scalars import all_caps, capped, clean_line, title_key, without_source
from wardspark.operators import matching, ranking
from wardspark.plans.registry import query
from wardspark.plans.standins import FACTS, facts, t

# Stand-in news: an item for each order; the people are 25 nations, five of whose last names two share.
_ITEMS = """items AS (SELECT o_orderkey AS item, o_custkey % 25 AS c, CASE o_orderkey % 8 WHEN 0 THEN 'Ald. N' || CAST(o_custkey % 25 % 20 AS VARCHAR) || ' blocks a bike lane' WHEN 1 THEN 'f' || CAST(o_custkey % 25 AS VARCHAR) || ' n' || CAST(o_custkey % 25 % 20 AS VARCHAR) || ' proposes an ordinance'
    WHEN 2 THEN 'N' || CAST(o_custkey % 25 % 20 AS VARCHAR) || ' speaks at a rally' WHEN 3 THEN 'Council roundup' WHEN 4 THEN 'N' || CAST(o_custkey % 25 AS VARCHAR) || ' Avenue opens in the ' || CAST(o_custkey % 25 + 1 AS VARCHAR) || 'th Ward'
    WHEN 5 THEN 'Today''s Headlines for N' || CAST(o_custkey % 25 AS VARCHAR) || ' Ave' WHEN 6 THEN 'N' || CAST(o_custkey % 25 AS VARCHAR) || ' approves housing'
    WHEN 7 THEN CASE WHEN o_custkey % 2 = 0 THEN 'The  n' || CAST(o_custkey % 25 AS VARCHAR) || ' avenue   traffic safety PLAN, in full' END END AS title,
    CASE WHEN o_orderkey % 8 = 3 THEN ['Bicycling', 'F' || CAST(o_custkey % 25 AS VARCHAR) || ' N' || CAST(o_custkey % 25 % 20 AS VARCHAR)] WHEN o_orderkey % 16 = 4 THEN ['7th Ward'] ELSE [] END AS tags, o_orderstatus = 'P' AS trusted FROM orders)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = F.col("o_custkey") % 25, F.col("o_orderkey") % 8
    last = c % 20
    title = (
        F.when(k == 0, F.concat(F.lit("Ald. N"), last, F.lit(" blocks a bike lane"))).when(k == 1, F.concat(F.lit("f"), c, F.lit(" n"), last, F.lit(" proposes an ordinance"))).when(k == 2, F.concat(F.lit("N"), last, F.lit(" speaks at a rally"))).when(k == 3, "Council roundup")
        .when(k == 4, F.concat(F.lit("N"), c, F.lit(" Avenue opens in the "), c + 1, F.lit("th Ward"))).when(k == 5, F.concat(F.lit("Today's Headlines for N"), c, F.lit(" Ave"))).when(k == 6, F.concat(F.lit("N"), c, F.lit(" approves housing")))
        .when((k == 7) & (F.col("o_custkey") % 2 == 0), F.concat(F.lit("The  n"), c, F.lit(" avenue   traffic safety PLAN, in full")))
    )
    tags = F.when(k == 3, F.array(F.lit("Bicycling"), F.concat(F.lit("F"), c, F.lit(" N"), last))).when(F.col("o_orderkey") % 16 == 4, F.array(F.lit("7th Ward"))).otherwise(F.array().cast("array<string>"))
    return t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), title.alias("title"), tags.alias("tags"), (F.col("o_orderstatus") == "P").alias("trusted"))


def _patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = t(spark, sf_dir, "nation"), F.col("n_nationkey")
    people = n.select(k.alias("ward"), F.concat(F.lit("N"), k % 20, F.lit(", F"), k).alias("name"))
    streets = n.select(k.alias("entity"), F.concat(F.lit("N"), k).alias("street"))
    tokens = n.filter(k % 5 == 0).select(k.alias("entity"), F.lit("roundup").alias("token"))
    phrases = n.select(k.alias("entity"), F.concat(F.lit("Ald. N"), k).alias("phrase"), (k % 2 == 0).alias("context"))
    phrases = phrases.union(n.select(k, F.concat(F.lit("N"), k, F.lit(" Avenue Traffic Safety Plan")), F.lit(False)))
    return matching.person_patterns(people, "ward", "name").unionByName(matching.route_patterns(streets, tokens)).unionByName(matching.project_patterns(phrases))


_STREETS = "(Ave|Avenue|St|Street|Blvd|Boulevard|Rd|Road|Dr|Drive)"
_KEYWORD = "regexp_matches(lower(coalesce(title, '')), '" + "|".join(matching.KEYWORDS) + "')"
_MATCHES = f"""{_ITEMS}, n AS (SELECT n_nationkey AS k, 'N' || CAST(n_nationkey % 20 AS VARCHAR) AS last, 'F' || CAST(n_nationkey AS VARCHAR) || ' N' || CAST(n_nationkey % 20 AS VARCHAR) AS whole, count(*) OVER (PARTITION BY n_nationkey % 20) = 1 AS alone FROM nation),
  pats AS (SELECT 'person' AS kind, k, 0 AS rank, '(?i)(\\b' || whole || '\\b)' AS pat, false AS ctx FROM n UNION ALL SELECT 'person', k, 1, '(?i)(\\b(Ald\\.?|Alderman|Alderwoman|Alderperson)\\s+' || last || '\\b)', false FROM n WHERE alone
    UNION ALL SELECT 'route', k, 0, '(?i)(\\bN' || CAST(k AS VARCHAR) || '\\s+{_STREETS}\\b)', false FROM n UNION ALL SELECT 'route', k, 1, '(?i)(\\broundup\\b)', false FROM n WHERE k % 5 = 0
    UNION ALL SELECT 'project', k, CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END, '(?i)(\\bAld\\.\\s+N' || CAST(k AS VARCHAR) || '\\b)', k % 2 = 0 FROM n
    UNION ALL SELECT 'project', k, 0, '(?i)(\\bN' || CAST(k AS VARCHAR) || '\\s+Avenue\\s+Traffic\\s+Safety\\s+Plan\\b)', false FROM n),
  texts AS (SELECT item, title, unnest(tags) AS text, unnest(range(len(tags))) AS place FROM items UNION ALL SELECT item, title, title, 1000 FROM items),
  hits AS (SELECT item, kind, CAST(k AS VARCHAR) AS entity, rank, place, CASE WHEN place < 1000 THEN 'publisher tag ''' || text || '''' ELSE '''' || regexp_extract(text, pat, 1) || ''' in headline' END || CASE WHEN ctx THEN ' + safety keyword in headline' ELSE '' END AS via
    FROM texts JOIN pats ON regexp_matches(text, pat) AND (NOT ctx OR {_KEYWORD})),
  matches AS (SELECT item, kind, entity, arg_min(via, (rank, place)) AS via FROM hits GROUP BY ALL)"""


@query(f"WITH {_MATCHES} SELECT item, kind, entity, via FROM matches")
def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-19 JON-20: people, routes and projects that items name, with the evidence; last names and streets need their company, some phrases a keyword."""
    return matching.entity_matches(_items(spark, sf_dir), "item", "title", "tags", _patterns(spark, sf_dir))


@query(rf"""WITH {_ITEMS}, f AS (SELECT item, unnest(tags) AS text, unnest(range(len(tags))) AS place FROM items UNION ALL SELECT item, title, 1000 FROM items),
  w AS (SELECT item, regexp_extract(text, '(?i)\b([0-9]{{1,2}})(st|nd|rd|th)\s+ward\b', 1) AS ward, place, CASE WHEN place < 1000 THEN 'publisher tag ''' || text || '''' ELSE '''' || regexp_extract(text, '(?i)\b([0-9]{{1,2}})(st|nd|rd|th)\s+ward\b', 0) || ''' in headline' END AS via FROM f)
  SELECT item, ward, arg_min(via, place) AS via FROM w WHERE ward <> '' GROUP BY item, ward""")
def ward_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-19 FN-14: wards named by number in tags and titles."""
    return matching.ward_mentions(_items(spark, sf_dir), "item", "title", "tags")


@query(f"""WITH {_MATCHES}, p AS (SELECT DISTINCT item FROM matches WHERE kind = 'project')
  SELECT item, title FROM items WHERE NOT regexp_matches(coalesce(title, ''), '(?i)^today[’'']s headlines') AND (trusted OR {_KEYWORD} OR list_has_any(list_transform(tags, lambda x: lower(x)), {list(matching.TOPICS)}) OR item IN (SELECT item FROM p))""")
def relevant_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-19: items that pass the gate; a project match lets in what keywords would not."""
    items = _items(spark, sf_dir)
    found = matching.entity_matches(items, "item", "title", "tags", _patterns(spark, sf_dir).filter("kind = 'project'"))
    projects = found.select("item", F.lit(True).alias("project")).distinct()
    j = items.join(projects, "item", "left")
    return j.filter(matching.relevant(F.col("title"), F.col("tags"), F.col("trusted"), F.col("project"))).select("item", "title")


@query(f"""WITH {_MATCHES}, r AS (SELECT entity, item, row_number() OVER (PARTITION BY entity ORDER BY o_orderdate DESC, item) AS rn FROM matches JOIN orders ON o_orderkey = item WHERE kind = 'project')
  SELECT CAST(n_nationkey AS VARCHAR) AS project, coalesce((SELECT array_to_string(list(CAST(item AS VARCHAR) ORDER BY rn), ',') FROM r WHERE rn <= 8 AND entity = CAST(n_nationkey AS VARCHAR)), '') AS coverage FROM nation""")
def project_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-23 WIN-14: every project with the newest eight items that name it; a project without any keeps its row."""
    found = matching.entity_matches(_items(spark, sf_dir), "item", "title", "tags", _patterns(spark, sf_dir).filter("kind = 'project'"))
    dated = found.join(t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), "o_orderdate"), "item")
    best = ranking.top_k(dated, ["entity"], [F.col("o_orderdate").desc(), "item"], 8)
    lists = best.groupBy(F.col("entity").alias("project")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("item").cast("string").alias("item")))), lambda x: x.item), ",").alias("coverage"))
    return t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("project")).join(lists, "project", "left").fillna("")


@query(f"""WITH {_ITEMS}, a AS (SELECT item, title, CASE WHEN item % 3 <> 0 THEN 'O2026-' || lpad(CAST(item AS VARCHAR), 5, '0') END AS record FROM items)
  SELECT item, {_KEYWORD} AS safety, record IS NOT NULL AND item % 4 = 0 AS tracked FROM a""")
def decorated_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-20: agenda items with two flags, a keyword in title or text, and whether the record is among the published ones."""
    record = F.format_string("O2026-%05d", "item")  # five digits at least; none is cut off
    a = _items(spark, sf_dir).select("item", "title", F.when(F.col("item") % 3 != 0, record).alias("record"))
    published = t(spark, sf_dir, "orders").filter("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("item")).select(record.alias("record"), F.lit(True).alias("tracked")).distinct()
    j = a.join(published, "record", "left")
    return j.select("item", matching.has_keyword(F.concat_ws(" ", "title", F.lit(""))).alias("safety"), F.coalesce("tracked", F.lit(False)).alias("tracked"))


# Stand-in agenda lines: one for each order, read district by district; every seventh is a heading.
_LINES = f"""{FACTS}, lines AS (SELECT district, id, CASE WHEN id % 7 = 0 THEN ' NEW ' || priority || ' – BUSINESS: ' WHEN id % 7 = 1 THEN '(' || CAST(district AS VARCHAR) || ') Item  O2026-' || lpad(CAST(id % 500 AS VARCHAR), 4, '0') || ' and R26-' || lpad(CAST(id % 300 AS VARCHAR), 4, '0') ELSE '( ) ' || repeat('plain words — ', CAST(id % 60 AS INTEGER)) || 'end' END AS line FROM facts)"""
RECORD = r"\b(?:Doc|SO|SR|SA|CL|PO|PR|Or|O|R|A|F|M)[0-9]{2,4}-[0-9]{4,}\b"


@query(rf"""WITH {_LINES}, c AS (SELECT district, id, trim(regexp_replace(line, '[–—−]', '-', 'g')) AS line FROM lines), h AS (SELECT *, line = upper(line) AND regexp_matches(line, '\p{{L}}') AND NOT regexp_matches(line, '{RECORD}') AS heading FROM c),
  s AS (SELECT *, last_value(CASE WHEN heading THEN trim(rtrim(line, ':')) END IGNORE NULLS) OVER (PARTITION BY district ORDER BY id ROWS UNBOUNDED PRECEDING) AS section FROM h),
  i AS (SELECT district, id, section, TRY_CAST(regexp_extract(line, '^\(\s*([0-9]{{0,2}})\s*\)', 1) AS INTEGER) AS ward, trim(regexp_replace(regexp_replace(line, '^\(\s*[0-9]{{0,2}}\s*\)\s*', ''), '\s+', ' ', 'g')) AS body FROM s WHERE NOT heading),
  b AS (SELECT district, id, section, ward, CASE WHEN length(body) > 600 THEN rtrim(left(body, 600)) || '…' ELSE body END AS body FROM i),
  r AS (SELECT *, CASE WHEN regexp_matches(body, '{RECORD}') THEN regexp_extract_all(body, '{RECORD}') ELSE [NULL] END AS found FROM b), e AS (SELECT district, id, section, ward, md5(body) AS body, unnest(found) AS record, generate_subscripts(found, 1) AS place FROM r),
  n AS (SELECT *, row_number() OVER (PARTITION BY district, record ORDER BY id, place) AS seen FROM e) SELECT district, id, section, ward, body, record FROM n WHERE record IS NULL OR seen = 1""")
def agenda_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-10 FN-15 FN-16: lines cleaned, all-caps headings carried down to the items below them, texts capped, each record number where it is first seen."""
    k, d = F.col("id"), F.col("district").cast("string")
    heading = F.concat(F.lit(" NEW "), "priority", F.lit(" – BUSINESS: "))
    record = F.concat(F.lit("("), d, F.lit(") Item  O2026-"), F.lpad((k % 500).cast("string"), 4, "0"), F.lit(" and R26-"), F.lpad((k % 300).cast("string"), 4, "0"))
    plain = F.concat(F.lit("( ) "), F.repeat(F.lit("plain words — "), (k % 60).cast("int")), F.lit("end"))
    lines = facts(spark, sf_dir).select("district", "id", clean_line(F.when(k % 7 == 0, heading).when(k % 7 == 1, record).otherwise(plain)).alias("line"))
    ward = F.regexp_extract("line", r"^\(\s*([0-9]{0,2})\s*\)", 1).try_cast("int")
    heading = F.when(all_caps(F.col("line")) & ~F.rlike("line", F.lit(RECORD)), F.trim(F.rtrim("line", F.lit(":"))))
    body = capped(F.regexp_replace("line", r"^\(\s*[0-9]{0,2}\s*\)\s*", ""))
    # Lines are parsed once, and what was parsed is narrow; a record is kept where it is seen first, by an aggregate.
    parsed = lines.select("district", "id", heading.alias("heading"), ward.alias("ward"), body.alias("body"))
    held = parsed.select("district", "id", "heading", "ward", F.md5(F.col("body").cast("binary")).alias("body"), F.regexp_extract_all("body", F.lit(RECORD), F.lit(0)).alias("found")).checkpoint()
    s = ranking.filled_down(held, ["district"], ["id"], "heading", "section").filter("heading is null")
    e = s.select("district", "id", "section", "ward", "body", F.posexplode_outer("found").alias("place", "record"))
    first = e.filter("record is not null").groupBy("district", "record").agg(F.min(F.struct("id", "place", "section", "ward", "body")).alias("f"))
    return e.filter("record is null").drop("place").unionByName(first.select("district", "f.id", "f.section", "f.ward", "f.body", "record"))


@query(r"""WITH p AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS source FROM pages), s AS (SELECT page_id, source, CASE WHEN page_id % 2 = 0 THEN title || ' - ' || source ELSE title END AS said FROM p)
  SELECT page_id, trim(regexp_replace(lower(CASE WHEN ends_with(said, ' - ' || source) THEN trim(left(said, length(said) - length(source) - 3)) ELSE said END), '\s+', ' ', 'g')) AS title_key FROM s""")
def title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-13: the key that titles are compared by, without the source behind them."""
    title, source = F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.regexp_extract("url", "^https?://([^/:?#]+)", 1)
    p = t(spark, sf_dir, "pages").select("page_id", source.alias("source"), F.when(F.col("page_id") % 2 == 0, F.concat(title, F.lit(" - "), source)).otherwise(title).alias("said"))
    return p.select("page_id", title_key(without_source(F.col("said"), F.col("source"))).alias("title_key"))


# Council records: an order is a record, its lines are votes and sponsors.
@query("""WITH v AS (SELECT DISTINCT l_suppkey AS member, l_orderkey AS record FROM lineitem WHERE l_returnflag = 'R'), r AS (SELECT member, record, o_orderdate, row_number() OVER (PARTITION BY member ORDER BY o_orderdate DESC, record) AS place FROM v JOIN orders ON o_orderkey = record)
  SELECT member, record, CAST(place AS INTEGER) AS place FROM r""")
def no_vote_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-33: the records a member voted against, newest first."""
    voters = t(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("record")).agg(F.collect_set("l_suppkey").alias("no_voters"))
    r = voters.select("record", F.explode("no_voters").alias("member")).join(t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record"), "o_orderdate"), "record")
    return r.select("member", "record", F.row_number().over(Window.partitionBy("member").orderBy(F.col("o_orderdate").desc(), "record")).alias("place"))


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS record, l_suppkey % 50 AS ward, 'Supplier#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS name FROM lineitem), r AS (SELECT o_orderkey AS record, o_orderdate, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 180 DAY),
  m AS (SELECT n_nationkey AS ward, 'Supplier#' || lpad(CAST(n_nationkey + 50 AS VARCHAR), 9, '0') AS name FROM nation), h AS (SELECT DISTINCT m.ward, r.record, r.o_orderdate FROM m JOIN s ON s.ward = m.ward OR s.name = m.name JOIN r USING (record)),
  k AS (SELECT *, row_number() OVER (PARTITION BY ward ORDER BY o_orderdate DESC, record) AS place FROM h) SELECT ward, record, CAST(place AS INTEGER) AS place FROM k WHERE place <= 5""")
def recently_introduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-18: of each member the newest five records of the last 180 days in an open status, sponsored by ward or by exact name."""
    o = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record"), "o_orderdate", "o_orderstatus")
    cutoff = o.agg((F.max("o_orderdate") - F.expr("interval 180 days")).alias("cutoff"))
    r = o.filter(F.col("o_orderstatus").isin("O", "P")).crossJoin(F.broadcast(cutoff)).filter("o_orderdate >= cutoff").drop("cutoff")  # one row
    name = lambda k: F.concat(F.lit("Supplier#"), F.lpad(k.cast("string"), 9, "0"))
    s = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record"), (F.col("l_suppkey") % 50).alias("ward"), name(F.col("l_suppkey")).alias("name")).join(r, "record")
    m = t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("member"), name(F.col("n_nationkey") + 50).alias("name"))
    by_ward = s.join(m.select("member"), F.col("ward") == F.col("member")).select("member", "record", "o_orderdate")
    by_name = s.join(m, "name").select("member", "record", "o_orderdate")
    best = ranking.top_k(by_ward.union(by_name).distinct(), ["member"], [F.col("o_orderdate").desc(), "record"], 5)
    return best.select(F.col("member").cast("int").alias("ward"), "record", F.col("rank").alias("place"))


@query("""WITH s AS (SELECT l_orderkey AS record, l_linenumber AS place, CASE WHEN l_linenumber % 2 = 0 THEN '  SUPPLIER#' ELSE 'Supplier#' END || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') || ' ' AS said FROM lineitem), m AS (SELECT lower(trim(s_name)) AS k, s_nationkey AS ward FROM supplier WHERE s_suppkey % 3 <> 0)
  SELECT record, array_to_string(list_sort(list_distinct(list(ward))), ',') AS wards FROM s LEFT JOIN m ON k = lower(trim(said)) GROUP BY record""")
def sponsor_wards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-15: sponsor names to wards by trimmed lower-case equality; the sorted set of wards, empty where no name is known."""
    said = F.concat(F.when(F.col("l_linenumber") % 2 == 0, "  SUPPLIER#").otherwise("Supplier#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0"), F.lit(" "))
    s = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record"), F.lower(F.trim(said)).alias("k"))
    m = t(spark, sf_dir, "supplier").filter("s_suppkey % 3 <> 0").select(F.lower(F.trim("s_name")).alias("k"), F.col("s_nationkey").alias("ward"))
    wards = F.array_sort(F.collect_set("ward"))
    return s.join(m, "k", "left").groupBy("record").agg(F.array_join(F.transform(wards, lambda w: w.cast("string")), ",").alias("wards"))


@query("""WITH p AS (SELECT l_orderkey AS bill, arg_min(l_suppkey, (l_linenumber, l_suppkey)) AS lead FROM lineitem GROUP BY 1), s AS (SELECT DISTINCT l_orderkey AS bill, l_suppkey AS s FROM lineitem)
  SELECT bill, array_to_string(list('S' || CAST(s AS VARCHAR) ORDER BY s <> lead, 'S' || CAST(s AS VARCHAR)), ', ') AS sponsors FROM s JOIN p USING (bill) GROUP BY bill""")
def bill_sponsors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-21: the sponsors of each bill, the primary one first, then A to Z."""
    li = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("bill")).agg(F.min_by("l_suppkey", F.struct("l_linenumber", "l_suppkey")).alias("lead"), F.collect_set("l_suppkey").alias("s"))
    ordered = F.array_sort(F.transform("s", lambda x: F.struct((x != F.col("lead")).cast("int").alias("o"), F.concat(F.lit("S"), x.cast("string")).alias("n"))))
    return li.select("bill", F.array_join(F.transform(ordered, lambda x: x.n), ", ").alias("sponsors"))


@query("""WITH v AS (SELECT l_orderkey AS bill, l_shipdate AS day, l_linenumber, count(*) FILTER (l_returnflag = 'A') AS yes, count(*) FILTER (l_returnflag = 'R') AS no FROM lineitem GROUP BY ALL),
  c AS (SELECT *, row_number() OVER (PARTITION BY bill ORDER BY day DESC, l_linenumber DESC) AS rn FROM v WHERE no > 0) SELECT bill, strftime(day, '%Y-%m-%d') AS day, yes, no FROM c WHERE rn = 1""")
def latest_contested_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-9: of the votes of a bill with a no the latest."""
    flag = lambda c: F.count_if(F.col("l_returnflag") == c)
    v = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("bill"), F.col("l_shipdate").alias("day"), "l_linenumber").agg(flag("A").alias("yes"), flag("R").alias("no"))
    c = ranking.first_wins(v.filter("no > 0"), ["bill"], [F.col("day").desc(), F.col("l_linenumber").desc()])
    return c.select("bill", F.date_format("day", "yyyy-MM-dd").alias("day"), "yes", "no")


@query(f"""WITH {FACTS}, a AS (SELECT * FROM facts WHERE priority IN ('1-URGENT', '2-HIGH')) SELECT 'status' AS by, status AS value, count(*) AS n, strftime(max(day), '%Y-%m-%d') AS latest FROM a GROUP BY status UNION ALL SELECT 'type', priority, count(*), strftime(max(day), '%Y-%m-%d') FROM a GROUP BY priority""")
def council_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-22: topic rows counted by status and by type in one pass, with the latest date."""
    a = facts(spark, sf_dir).filter(F.col("priority").isin("1-URGENT", "2-HIGH"))
    both = a.select("day", F.explode(F.array(F.struct(F.lit("status").alias("by"), F.col("status").alias("value")), F.struct(F.lit("type").alias("by"), F.col("priority").alias("value")))).alias("g"))
    return both.groupBy("g.by", "g.value").agg(F.count(F.lit(1)).alias("n"), F.date_format(F.max("day"), "yyyy-MM-dd").alias("latest"))


@query("""WITH s AS (SELECT DISTINCT l_suppkey AS member, l_orderkey AS record FROM lineitem WHERE l_linenumber = 1), v AS (SELECT DISTINCT l_suppkey AS member, l_orderkey AS record FROM lineitem WHERE l_linenumber = 2 AND l_returnflag = 'R'), n AS (SELECT member FROM s UNION SELECT member FROM v),
  a AS (SELECT member, count(*) AS total, count(*) FILTER (o_orderpriority = '1-URGENT') AS relevant, array_to_string(list(CAST(record AS VARCHAR) ORDER BY record) FILTER (o_orderpriority = '1-URGENT'), ',') AS records FROM s JOIN orders ON o_orderkey = record GROUP BY member),
  b AS (SELECT member, count(*) AS no_votes FROM v GROUP BY member) SELECT n.member, coalesce(total, 0) AS total, coalesce(relevant, 0) AS relevant, coalesce(records, '') AS records, coalesce(no_votes, 0) AS no_votes FROM n LEFT JOIN a USING (member) LEFT JOIN b USING (member)""")
def member_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-19: records sponsored by each member with the list of relevant ones; members who only ever voted no keep their row."""
    li = t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("member"), F.col("l_orderkey").alias("record"), "l_linenumber", "l_returnflag")
    s = li.filter("l_linenumber = 1").select("member", "record").distinct()
    v = li.filter("l_linenumber = 2 and l_returnflag = 'R'").select("member", "record").distinct()
    o = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record"), (F.col("o_orderpriority") == "1-URGENT").alias("topic"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("topic"), F.col("record")))), lambda r: r.cast("string")), ",")
    a = s.join(o, "record").groupBy("member").agg(F.count(F.lit(1)).alias("total"), F.count_if("topic").alias("relevant"), listed.alias("records"))
    b = v.groupBy("member").agg(F.count(F.lit(1)).alias("no_votes"))
    return a.join(b, "member", "full").fillna({"total": 0, "relevant": 0, "records": "", "no_votes": 0})


@query("""SELECT c AS page_order, o_orderkey AS id, o_orderstatus AS status FROM (SELECT unnest([7, 900000000, 3, 11, 5]) AS k, unnest([0, 1, 2, 3, 4]) AS c) JOIN orders ON o_orderkey = k""")
def picked_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-22: ids in the order they were asked for; those that do not exist are skipped."""
    asked = spark.range(1).select(F.posexplode(F.array(*map(F.lit, (7, 900000000, 3, 11, 5)))).alias("page_order", "k"))
    o = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return o.join(F.broadcast(asked), F.col("id") == F.col("k")).select("page_order", "id", "status").orderBy("page_order")  # five rows


@query("""WITH n AS (SELECT role, n_nationkey, text FROM conversations JOIN nation ON n_nationkey = conv_id % 25), m AS (SELECT conv_id, n_nationkey AS committee, turn, role FROM conversations JOIN nation ON n_nationkey = conv_id % 25), i AS (SELECT conv_id, count(*) AS items, array_to_string(list(role ORDER BY turn), '>') AS agenda FROM conversations WHERE turn > 0 GROUP BY conv_id)
  SELECT DISTINCT committee, m.conv_id AS meeting, coalesce(items, 0) AS items, coalesce(agenda, '') AS agenda FROM m LEFT JOIN i USING (conv_id)""")
def rebuilt_meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-14 JON-24: committees with nested meetings, in documents of at most 40 meetings each, scanned, agenda items joined in by address, and built up nested again; a meeting without items keeps an empty agenda."""
    c = t(spark, sf_dir, "conversations")
    meeting = c.select((F.col("conv_id") % 25).cast("int").alias("committee"), F.struct(F.col("conv_id").alias("meeting"), F.concat(F.lit("https://agenda/"), "conv_id").alias("agenda_url")).alias("m")).distinct()
    block = F.floor(F.col("m.meeting") / 1000)  # a nested document holds at most 40 meetings of a committee
    committees = meeting.groupBy("committee", block.alias("block")).agg(F.collect_list("m").alias("meetings"))
    flat = committees.select("committee", "block", F.explode("meetings").alias("m")).select("committee", "block", "m.*")
    items = c.filter("turn > 0").groupBy(F.concat(F.lit("https://agenda/"), "conv_id").alias("agenda_url")).agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("items"))
    j = flat.join(items, "agenda_url", "left").withColumn("items", F.coalesce("items", F.array().cast("array<struct<turn:bigint,role:string>>")))
    nested = j.groupBy("committee", "block").agg(F.collect_list(F.struct("meeting", "items")).alias("meetings"))
    out = nested.select("committee", F.explode("meetings").alias("m"))
    return out.select("committee", "m.meeting", F.size("m.items").cast("long").alias("items"), F.array_join(F.transform("m.items", lambda x: x.role), ">").alias("agenda"))
