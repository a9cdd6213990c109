"""Readers, writers, matching and claims on literal cases."""

import hashlib

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from wardspark.functions import scalars
from wardspark.operators import claims, gates, matching, temporal
from wardspark.plans import registry
from wardspark.sources import files

registry.load()


def test_ways(spark, tmp_path):
    (tmp_path / "ways.json").write_text('{"elements": [{"type": "way", "id": 1, "tags": {"name": "A", "highway": "path"}, "geometry": [{"lat": 1, "lon": 2}, {"lat": 3, "lon": 4}]}, {"type": "way", "id": 2, "tags": {}, "geometry": [{"lat": 1, "lon": 2}, {"lat": 3, "lon": 4}]}, {"type": "way", "id": 3, "tags": {"name": "B"}, "geometry": [{"lat": 1, "lon": 2}]}, {"type": "node", "id": 4}]}')
    r = files.read_ways(spark, str(tmp_path / "ways.json")).collect()
    assert [(x.id, x.name, x.line[1].x) for x in r] == [(1, "A", 4.0)]


def test_rss(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title> One </title><link>http://a</link><category>x</category><category>y</category></item><item><title>No link</title></item></channel></rss>")
    r = files.read_rss(spark, str(tmp_path / "f.xml")).collect()
    assert [(x.title, x.link, x.category) for x in r] == [("One", "http://a", ["x", "y"])]


def test_csv_members_and_period(spark, tmp_path):
    (tmp_path / "202401-a.csv").write_text("id,name\n1,old\n")
    (tmp_path / "202402-a.csv").write_text('id,name\n2,"new, ""quoted"""\n')
    (tmp_path / "readme.txt").write_text("id,name\n9,none\n")
    rows = files.read_members(spark, str(tmp_path), "id long, name string")
    assert sorted(r.id for r in rows.collect()) == [1, 2]
    assert [tuple(r) for r in files.latest_period(rows.select("*", "_metadata")).select("id", "name", "period").collect()] == [(2, 'new, "quoted"', "202402")]


def test_slices_and_manifest(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id int, k string")
    keys = spark.createDataFrame([("a",), ("b",)], "k string")
    files.write_slices(rows, keys, "k", str(tmp_path / "s"))
    assert {r.k: r.n for r in spark.read.parquet(str(tmp_path / "s")).groupBy("k").agg(F.count("id").alias("n")).collect()} == {"a": 2, "b": 0}
    (tmp_path / "m" / "x").mkdir(parents=True)
    (tmp_path / "m" / "x" / "f.bin").write_bytes(b"abc")
    m = files.manifest(spark, str(tmp_path / "m"))
    assert [tuple(r) for r in m.collect()] == [("x", "f.bin", 3, hashlib.sha256(b"abc").hexdigest())]
    assert files.over_budget(m, 2).count() == 1 and files.folder_sizes(m).first().median == 3


def test_entity_matching(spark):
    """Bare last names and bare streets never match; a shared last name needs the full name; tags come first."""
    people = spark.createDataFrame([(3, "Dowell, Pat"), (15, "Lopez, Raymond"), (9, "Lopez, Silvana"), (1, "no comma")], "ward int, name string")
    streets = spark.createDataFrame([("milwaukee", "Milwaukee"), ("clark", "Dearborn")], "entity string, street string")
    tokens = spark.createDataFrame([("lakefront", "Lakefront"), ("bloomingdale", "606")], "entity string, token string")
    phrases = spark.createDataFrame([("grand", "Grand Avenue", True), ("trail", "606 extension", False)], "entity string, phrase string, context boolean")
    patterns = matching.person_patterns(people, "ward", "name").unionByName(matching.route_patterns(streets, tokens)).unionByName(matching.project_patterns(phrases))
    titles = ["Ald. Dowell blocks lane", "Dowell speaks", "Ald. Lopez proposes", "Raymond Lopez proposes", "Milwaukee Avenue bike lanes", "Milwaukee approves", "Dearborn St bridge", "New ramp for The 606", "Route 6060 detour", "Grand Avenue daycare", "Grand Avenue bike lane", "Roundup with Ald. Dowell", None]
    items = spark.createDataFrame([(i, t, ["Pat Dowell", "35th Ward"] if i == 11 else None) for i, t in enumerate(titles)], "id int, title string, tags array<string>")
    got = {(r.id, r.kind, r.entity): r.via for r in matching.entity_matches(items, "id", "title", "tags", patterns).collect()}
    assert got == {
        (0, "person", "3"): "'Ald. Dowell' in headline", (3, "person", "15"): "'Raymond Lopez' in headline", (4, "route", "milwaukee"): "'Milwaukee Avenue' in headline", (6, "route", "clark"): "'Dearborn St' in headline",
        (7, "route", "bloomingdale"): "'606' in headline", (10, "project", "grand"): "'Grand Avenue' in headline + safety keyword in headline", (11, "person", "3"): "publisher tag 'Pat Dowell'",
    }
    assert [tuple(r) for r in matching.ward_mentions(items, "id", "title", "tags").collect()] == [(11, "35", "publisher tag '35th Ward'")]


def test_relevance_gate(spark):
    rows = [("New bike lane on Halsted", [], False, None, True), ("Transit roundup", ["Bicycling"], False, None, True), ("Housing plan", ["Housing", None], False, None, False), ("Anything", [], True, None, True), ("Daycare opens", None, None, None, False), ("Daycare opens", None, None, True, True), ("Today\u2019s Headlines for bikes", ["Bikes"], True, True, False), (None, None, False, None, False)]
    d = spark.createDataFrame(rows, "title string, c array<string>, trusted boolean, project boolean, want boolean")
    assert d.filter(matching.relevant(F.col("title"), F.col("c"), F.col("trusted"), F.col("project")) != F.col("want")).count() == 0


def test_large_roster_is_refused(spark):
    roster = spark.range(matching.ROSTER_LIMIT + 1).select(F.col("id").alias("line"), F.lit("x").alias("token"), F.lit("y").alias("veto"))
    with pytest.raises(ValueError):
        matching.token_members(spark.createDataFrame([("x",)], "name string"), roster, "name")


def test_restated_numbers(spark):
    text = "up (12.5 %), down (-3) to ( 2,032 crashes ), (2032 crashes) since (2024-01-02) (2021) (May 2026) (2026-07-11 to 2026-07-13) (2021-2026) (note 8) (none) ()"
    r = spark.createDataFrame([(text,), (None,)], "s string").select(claims.restated_values(F.col("s"))).collect()
    assert r[0][0] == [12.5, -3.0, 2032.0, 2032.0] and r[1][0] is None


def test_registrants(spark):
    rows = [("BANK", "Ada"), ("FIRST BANK", None), ("FEDERAL EXPRESS CORPORATION", ""), ("FEDERAL EXPRESS 225877", " "), ("THE STUDIO 41 LLC", None), ("ROE", None), (None, None), ("CO LLC", None)]
    d = spark.createDataFrame(rows, "last string, first string")
    got = d.select(scalars.registrant_class(F.col("last"), F.col("first")).alias("kind"), scalars.redacted(F.col("last"), F.col("first")).alias("shown"), scalars.business_fold(F.col("last")).alias("folded")).collect()
    assert [r.kind for r in got] == ["individual", "business", "business", "business", "business", "unknown", "unknown", "business"]
    assert [r.shown for r in got] == ["", "FIRST BANK", "FEDERAL EXPRESS CORPORATION", "FEDERAL EXPRESS 225877", "THE STUDIO 41 LLC", "", "", "CO LLC"]
    assert [r.folded for r in got] == ["BANK", "FIRST BANK", "FEDERAL EXPRESS", "FEDERAL EXPRESS", "STUDIO 41", "ROE", None, ""]


def test_text_scalars(spark):
    d = spark.createDataFrame([("Église St. Jean — A", "BUDGET – 2026", "x" * 700, "Bike lanes - The Post", "The Post")], "a string, b string, c string, d string, e string")
    r = d.select(scalars.slug(F.col("a")), scalars.clean_line(F.col("b")), scalars.all_caps(F.col("b")), scalars.all_caps(F.lit("12-3")), scalars.capped(F.col("c")), scalars.without_source(F.col("d"), F.col("e")), scalars.street_name(F.lit("n oak pl")), scalars.street_name(F.lit("Lake  st"))).first()
    assert tuple(r) == ("église-st-jean-a", "BUDGET - 2026", True, False, "x" * 600 + "…", "Bike lanes", "N OAK PL", "LAKE")


def test_coordinates(spark):
    d = spark.createDataFrame([("41.9", "-87.6"), ("0", "0"), ("abc", "-87.6"), (None, "-87.6"), ("41.9", "-187")], "lat string, lon string")
    box = (41.6, -88.0, 42.1, -87.5)
    assert [r.p is not None for r in d.select(scalars.coordinate(F.col("lat"), F.col("lon"), box).alias("p")).collect()] == [True, False, False, False, False]


def test_trend_of_a_late_key(spark):
    rows = [("a", "2020-01-01"), ("a", "2021-06-01"), ("a", "2022-06-01"), ("a", "2022-06-02"), ("b", "2021-06-01"), ("b", "2022-06-02")]
    d = spark.createDataFrame(rows, "k string, d string").withColumn("d", F.to_date("d"))
    got = {r.k: (r.recent, r.prior, r.pct, r.direction) for r in temporal.trend(temporal.trailing_windows(d, "d", "k")).collect()}
    assert got == {"a": (2, 1, 100.0, "worsening"), "b": (None, None, None, "insufficient_data")}


def test_shared_keys(spark):
    c = spark.createDataFrame([(1, "s", "one"), (2, "s", "two"), (3, "s", "one")], "id int, stem string, caveat string")
    assert {r.id: r.key for r in claims.caveat_keys(c, "stem", "caveat", "id", "key").collect()} == {1: "s", 2: "s-2", 3: "s"}


def test_manifest_query(spark):
    out = registry.QUERIES["output_manifest"](spark, "/root/testdata/sf0.001")
    assert out.columns == ["folder", "bytes", "sha256", "over_budget", "files", "least", "middle", "most"] and out.count() > 0


def test_rare_keys_become_columns(spark, tmp_path):
    """A key of one record in 20,000, types that widen or conflict, records of no key, and not-a-number."""
    rows = ['{"id": %d, "v": %s}' % (i, "1" if i % 2 else "1.5") for i in range(20_000)]
    rows[19_999] = '{"id": 19999, "Rare": {"a": [1]}, "v": NaN, "w": "x"}'
    rows[5], rows[6] = "{}", '{"id": 6, "w": 3}'
    (tmp_path / "r.json").write_text("\n".join(rows))
    got = files.read_ragged(spark, str(tmp_path))
    assert dict(got.dtypes) == {"Rare": "struct<a:array<bigint>>", "id": "bigint", "v": "double", "w": "string"}
    assert got.filter("Rare is not null").select("id", "v", "w", "Rare.a").collect() == [(19_999, None, "x", [1])]
    assert got.filter("id is null").count() == 1 and got.filter("w = '3'").count() == 1


def test_only_the_outer_copies_are_read(spark, tmp_path):
    """Ten dated copies, folders and files: the scan has the oldest and the newest only, and a broken one between does no harm."""
    for k in range(10):
        name = tmp_path / f"routes_20{10 + k}-05-01.json"
        if k % 2:
            name.write_text('{"id": %d}' % k)
        else:
            name.mkdir()
            (name / "part-0").write_text('{"id": %d}\n{"id": 100}' % k)
    (tmp_path / "routes_2015-05-01.json").write_bytes(b"\x00broken")
    (tmp_path / "about.json").write_text('{"id": -1}')
    got = files.outer_copies(spark, str(tmp_path), "id long")
    assert sorted(map(tuple, got.collect())) == [(0, "2010-05-01"), (9, "2019-05-01"), (100, "2010-05-01")]
    assert len(got.inputFiles()) == 2
    (tmp_path / "none").mkdir()
    (tmp_path / "none/x.json").write_text('{"id": 1}')
    assert files.outer_copies(spark, str(tmp_path / "none"), "id long").collect() == []


def test_days_are_replaced_in_one_write(spark, tmp_path):
    path = str(tmp_path / "kept")
    files.append_snapshots(spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02"), (3, "2024-01-03")], "id int, snapshot_date string"), path)
    files.append_snapshots(spark.createDataFrame([(7, "2024-01-02"), (8, "2024-01-04")], "id int, snapshot_date string"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 3, 7, 8]


def test_trend_against_windows(spark):
    w = spark.createDataFrame([(k, "2024-05-01", 10, 20) for k in range(6)], "k int, window_end string, recent int, prior int")
    t = spark.createDataFrame([(0, "2024-05-01", 10, 20), (1, "2024-05-02", 11, 20), (2, "2024-05-01", 11, 20), (3, "2024-05-01", 10, 21), (4, "2024-05-01", None, None), (5, None, None, None)], w.schema)
    assert {r.k: r.fault for r in gates.trend_faults(t, w, "k").collect()} == {1: "window_end", 2: "recent", 3: "prior", 5: "window_end"}


def test_rosters(spark, tmp_path):
    """A list or a named list; absent, broken or foreign documents are none where they may be, and errors where they may not; size is checked."""
    entry = "id int, title string"
    for name, text in (("list", '[{"id": 1, "title": "a"}, {"id": 2, "more": []}]'), ("named", '{"as_of": "x", "points": [{"id": 3}]}'), ("broken", '{"points": ['), ("foreign", '{"other": []}'), ("empty", '{"points": []}')):
        (tmp_path / f"{name}.json").write_text(text)
    read = lambda name, field=None, **more: [tuple(r) for r in files.read_roster(spark, str(tmp_path / f"{name}.json"), entry, field, **more).collect()]
    assert read("list") == [(1, "a"), (2, None)] and read("named", "points") == [(3, None)] and read("empty", "points") == []
    for name in ("absent", "broken", "foreign"):
        assert read(name, "points", required=False) == []
        with pytest.raises((ValueError, AnalysisException)):
            read(name, "points")
    with pytest.raises(ValueError):
        read("list", largest=1)
