"""Ordered parts and places within keys: brute force, hot and null keys, layouts, edges."""

import hashlib
import json
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wardspark.operators import ranking
from wardspark.sources import files, parts


def _rows(n: int, hot: float) -> list[tuple]:
    """One key holds a share of ``hot``; some rows have no key; places come in no order."""
    return [("hot" if i % 100 < hot * 100 else None if i % 7 == 0 else f"k{i % 5}", (i * 7919) % n, f"t{i}") for i in range(n)]


@pytest.mark.parametrize("layout", [1, 7])
@pytest.mark.parametrize("hot", [0.0, 0.9, 1.0])
def test_places_within_keys(spark, layout, hot):
    rows = _rows(3001, hot)
    df = spark.createDataFrame(rows, "k string, at int, text string").repartition(layout)
    want, seen = {}, defaultdict(int)
    for k, at, _ in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        seen[k] += 1
        want[k, at] = seen[k]
    assert {(r.k, r["at"]): r.place for r in ranking.numbered_within(df, ["k"], ["at"], "place").collect()} == want


def test_places_within_two_keys_and_descending(spark):
    df = spark.range(2000).select((F.col("id") % 2).alias("a"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("b"), "id")
    got = ranking.numbered_within(df, ["a", "b"], [F.col("id").desc()], "place").collect()
    groups = defaultdict(list)
    for r in got:
        groups[r.a, r.b].append((r.place, r.id))
    assert len(groups) == 6 and sum(map(len, groups.values())) == 2000
    for g in groups.values():
        assert [p for p, _ in sorted(g)] == list(range(1, len(g) + 1)) and [i for _, i in sorted(g)] == sorted((i for _, i in g), reverse=True)


def test_places_of_nothing(spark):
    assert ranking.numbered_within(spark.createDataFrame([], "k int, at int"), ["k"], ["at"], "place").count() == 0


def _written(path: str) -> dict[tuple[str, int], list[str]]:
    found = defaultdict(list)
    for f in Path(path).rglob("part-*"):
        found[f.parts[-3].split("=")[1], int(f.parts[-2].split("=")[1])].append(f.read_text())
    return found


@pytest.mark.parametrize("layout", [1, 9])
def test_parts_are_whole_and_in_order(spark, layout):
    rows = _rows(2500, 0.8)
    df = spark.createDataFrame(rows, "k string, at int, text string").repartition(layout)
    path = files.shared_path(spark)
    parts.write_parts(df, "k", ["at"], F.to_json(F.struct("at", "text")), path, '{"rows":[', ",", "]}", rows=300)
    by = defaultdict(list)
    for k, at, text in sorted((r for r in rows if r[0]), key=lambda r: (r[0], r[1])):
        by[k].append({"at": at, "text": text})
    want = {(k, i // 300): v[i : i + 300] for k, v in by.items() for i in range(0, len(v), 300)}
    found = _written(path)
    assert all(len(v) == 1 for v in found.values())  # one file a part
    assert {k: json.loads(v[0])["rows"] for k, v in found.items()} == want and max(n for _, n in want) == 6
    digests = {(r.k, r.part): (r.bytes, r.sha256) for r in parts.part_digests(spark, path).collect()}
    assert digests == {k: (len(v[0].encode()), hashlib.sha256(v[0].encode()).hexdigest()) for k, v in found.items()}


def test_part_borders_and_null_texts(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("a", 3, "z"), ("a", 4, ""), ("b", 1, "y" * 200_000), (None, 1, "gone")], "k string, at int, text string")
    path = files.shared_path(spark)
    parts.write_parts(df, "k", ["at"], F.col("text"), path, "<", ",", ">", rows=2)
    assert {k: v[0] for k, v in _written(path).items()} == {("a", 0): "<x,\n>\n", ("a", 1): "<z,\n>\n", ("b", 0): "<" + "y" * 200_000 + ">\n"}


def test_hot_key_is_written_by_many_tasks(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").alias("at"), F.col("id").cast("string").alias("text"))
    path = files.shared_path(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # the rows of a test are few enough for one task
    try:
        parts.write_parts(df, "k", ["at"], F.col("text"), path, rows=500)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    tasks = {f.name.split("-")[1] for f in Path(path).rglob("part-*") if not f.name.startswith(".")}
    assert len(list(Path(path).rglob("part-*"))) == 40 and len(tasks) > 1
    assert spark.read.text(path).count() == 20_000
