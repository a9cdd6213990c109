"""Entities in texts by one automaton and by joins, and values carried down sorted rows, against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from wardspark.operators import matching, ranking

ITEMS = "id long, title string, tags array<string>"
PATTERNS = "kind string, entity string, form string, rank int, context boolean"


def patterns(spark, rows):
    df = spark.createDataFrame(rows, PATTERNS)
    escaped = F.regexp_replace(F.regexp_replace("form", r"([^A-Za-z0-9\s])", r"\\$1"), r"\s+", r"\\s+")
    return df.withColumns({"phrase": F.array_join(matching.words(F.col("form")), " "), "pattern": F.concat(F.lit("(?i)(?<!\\w)"), escaped, F.lit("(?!\\w)"))})


def by_hand(items, rows):
    out = {}
    for i, title, tags in items:
        told = any(k in (title or "").lower() for k in matching.KEYWORDS)
        for kind, entity, form, rank, context in rows:
            p = re.compile("(?<!\\w)" + r"\s+".join(map(re.escape, re.split(r"\s+", form))) + "(?!\\w)", re.I | re.A)
            for place, text in enumerate([*(tags or []), title]):
                m = p.search(text or "")
                if m and (told or not context):
                    via = (f"publisher tag '{text}'" if place < len(tags or []) else f"'{m[0]}' in headline") + (" + safety keyword in headline" if context else "")
                    out[i, kind, entity] = min(out.get((i, kind, entity), (9, 0, "")), (rank, place, via))
    return {(*k, v[2]) for k, v in out.items()}


def both_ways(spark, items, rows):
    df, p = spark.createDataFrame(items, ITEMS), patterns(spark, rows)
    got = {tuple(r) for r in matching.entity_matches(df, "id", "title", "tags", p).collect()}
    assert got == {tuple(r) for r in matching.entity_matches(df, "id", "title", "tags", p, limit=1).collect()}
    return got


def test_phrases_of_any_length(spark):
    rows = [("project", "archer", "Archer Avenue Traffic Safety", 0, False), ("project", "drive", "Lake Shore Drive redesign", 0, False), ("project", "drive", "DuSable Lake Shore Drive", 1, True), ("project", "lane", "Milwaukee Avenue protected bike lane opens", 0, False), ("route", "grand", "Grand Ave", 0, False)]
    items = [
        (1, "City picks a plan: Archer  Avenue\tTraffic Safety wins", None), (2, "lake shore drive REDESIGN and DuSable Lake Shore Drive", []), (3, "A cyclist on DuSable Lake Shore Drive", ["Grand Avenue", None, "grand ave"]),
        (4, "DuSable Lake Shore Drive reopens", None), (5, "Milwaukee Avenue protected bike lane opens", ["x"]), (6, "Milwaukee Avenue protected bike lanes opens", None), (7, None, None), (8, "Archer Avenue, Traffic Safety", None), (9, "Lake Shore Drive redesigned", None),
    ]
    assert both_ways(spark, items, rows) == {
        (1, "project", "archer", "'Archer  Avenue\tTraffic Safety' in headline"), (2, "project", "drive", "'lake shore drive REDESIGN' in headline"), (3, "project", "drive", "'DuSable Lake Shore Drive' in headline + safety keyword in headline"),
        (3, "route", "grand", "publisher tag 'grand ave'"), (5, "project", "lane", "'Milwaukee Avenue protected bike lane opens' in headline"),
    }


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    """Forms inside each other, repeated ones, punctuation, blanks of all kinds, letters beyond ASCII, bicycles as context."""
    rng = random.Random(seed)
    words, gaps = ["a", "A", "b", "ab", "St", "St.", "é", "x_y", "bike", "7th"], [" ", "  ", "\t", "-", ". ", "\n "]
    text = lambda n: "".join(rng.choice(words) + rng.choice(gaps) for _ in range(n)) + rng.choice(words)
    rows = [(rng.choice("pq"), rng.choice("123"), re.sub(r"\s+", " ", text(rng.randint(0, 4))), rng.randint(0, 1), rng.random() < 0.3) for _ in range(40)]
    rows = [r for r in rows if re.search("[A-Za-z0-9]", r[2])]
    items = [(i, rng.choice([None, text(rng.randint(0, 9))]), rng.choice([None, [], [text(2), None, text(1)]])) for i in range(200)]
    got = both_ways(spark, items, rows)
    assert got == by_hand(items, rows) and len(got) > 100


def test_no_forms_and_no_items(spark):
    assert both_ways(spark, [(1, "bike", ["x"])], []) == set() and both_ways(spark, [], [("p", "1", "x", 0, False)]) == set()


@pytest.mark.parametrize("keys", [1, 3, 40])
def test_values_carried_down(spark, keys):
    """Keys that fill many partitions and partitions that hold many keys, null keys, rows before the first value, long stretches without one."""
    rng = random.Random(keys)
    rows = [(None if keys > 1 and k == 1 else k, i, rng.choice([f"v{i}", None, None]) if i % 700 > 300 else None) for i in range(3000) for k in [rng.randrange(keys)]]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, i int, v string").repartition(5)
    got = {r.i: r.out for r in ranking.filled_down(df, ["k"], ["i"], "v", "out").collect()}
    last, want = {}, {}
    for k, i, v in sorted(rows, key=lambda r: r[1]):
        last[k] = v or last.get(k)
        want[i] = last[k]
    assert got == want and None in want.values() and len(set(want.values())) > 20


def test_one_key_uses_all_tasks(spark):
    df = spark.range(20_000).select(F.lit(1).alias("k"), "id", F.when(F.col("id") == 3, 7).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    out = ranking.filled_down(df, ["k"], ["id"], "v", "out")
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert out.filter("out = 7").count() == 19_997 and len(sizes) == 4 and max(sizes) < 2 * min(sizes)


def test_nothing_to_carry(spark):
    assert ranking.filled_down(spark.createDataFrame([], "k int, i int, v string"), ["k"], ["i"], "v", "out").collect() == []
