"""Every registered civic query with SQL against DuckDB on the smallest data, and literal cases."""

import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wardspark.functions import scalars
from wardspark.operators import gates, ranking, spatial
from wardspark.plans import registry
from wardspark.sources import files

registry.load()
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    clean = lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and v != v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(map(clean, r)) for r in df[sorted(df.columns)].astype(object).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    assert rows(registry.QUERIES[name](spark, DATA).toPandas()) == rows(duck.sql(registry.SQL[name]).df())


def test_concave_ring_and_border(spark):
    ring = "array(named_struct('x',0d,'y',0d),named_struct('x',4d,'y',0d),named_struct('x',4d,'y',4d),named_struct('x',3d,'y',4d),named_struct('x',3d,'y',1d),named_struct('x',1d,'y',1d),named_struct('x',1d,'y',4d),named_struct('x',0d,'y',4d))"
    line = tuple(F.lit(v) for v in (-1.0, 2.0, 5.0, 2.0))
    r = spark.range(1).select(scalars.length_inside(line, F.expr(ring)).alias("m"), scalars.inside_ring(F.lit(0.0), F.lit(0.5), F.expr(ring)).alias("a"), scalars.inside_ring(F.lit(4.0), F.lit(0.5), F.expr(ring)).alias("b")).first()
    assert (round(r.m, 9), r.a, r.b) == (2.0, True, False)


def test_either_key_dedup_keeps_chains(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "b", "y"), (4, None, "z")], "n int, url string, title string")
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    assert sorted(r.n for r in ranking.dedupe_by_either(df, "url", "title", "n").collect()) == [1, 3, 4]


def test_gate_stops_a_name(spark):
    df = spark.createDataFrame([("Jane Roe", "individual"), ("Acme LLC", "business")], "name string, kind string")
    with pytest.raises(gates.GateError):
        gates.enforce("names", gates.names_of_individuals(df, "name", "kind"))


def test_buffer_anti(spark):
    line = "id int, x1 double, y1 double, x2 double, y2 double"
    parts = spark.createDataFrame([(1, 0.0, 5.0, 100.0, 5.0), (2, 0.0, 830.0, 100.0, 830.0)], line)
    routes = spark.createDataFrame([(9, 0.0, 0.0, 100.0, 0.0)], line)
    assert [r.id for r in spatial.lines_away_from(parts, routes, 25.0, "id").collect()] == [2]


def test_projection_central_meridian(spark):
    e, n = scalars.utm16(F.lit(-87.0), F.lit(0.0))
    r = spark.range(1).select(e.alias("e"), n.alias("n")).first()
    assert abs(r.e - 500000) < 1e-6 and abs(r.n) < 1e-6


def test_deduped_items_against_brute_force(spark):
    pages = pd.read_parquet(f"{DATA}/pages.parquet").sort_values("page_id")
    seen, kept = set(), []
    for p in pages.itertuples():
        title = " ".join((re.search("<title>([^<]*)</title>", p.html) or ["", ""])[1].lower().split())
        keys = {("host", re.match("https?://([^/:?#]+)", p.url)[1]), ("title", title)} - {("title", "")}
        if not keys & seen:
            seen |= keys
            kept.append(p.page_id)
    assert sorted(r.page_id for r in registry.QUERIES["deduped_items"](spark, DATA).collect()) == kept


def test_contract_and_rebuild_gates(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "z", 3), (3, None, 4)], "id long, k string, n int")
    assert sorted(tuple(r) for r in gates.value_faults(df, "id", {"k": ("a", "b")}, ["k", "n"]).collect()) == [(1, "null in n"), (2, "value of k"), (3, "null in k")]
    d = spark.createDataFrame([(5, 5, True), (5, 4, True), (5, 9, None)], "a int, b int, ok boolean")
    assert [(r.kept, r.n) for r in gates.stronger(d, "a", "b", F.col("ok")).collect()] == [("rebuilt", 5), ("published", 5), ("published", 5)]


def test_column_named(spark):
    df = spark.createDataFrame([(1, 2)], "Ward_ID int, x int")
    assert files.column_named(df, "id", "ward_id") == "Ward_ID"
    with pytest.raises(ValueError):
        files.column_named(df, "name")
