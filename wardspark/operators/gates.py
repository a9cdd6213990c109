"""Quality gates: each returns the offending rows; ``enforce`` raises with the first of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class GateError(RuntimeError):
    """A gate found rows that must not be published."""


def enforce(name: str, offending: DataFrame, show: int = 3) -> None:
    rows = offending.limit(show).collect()
    if rows:
        raise GateError(f"{name}: " + "; ".join(str(r.asDict()) for r in rows))


def disagreeing(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys whose columns differ between two tables, null-safe, or that only one of them has."""
    other = b.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns])
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    both = a.select(key, *columns).join(other, F.col(key) == F.col("_key"), "full")
    return both.filter(differs | F.col(key).isNull() | F.col("_key").isNull()).select(F.coalesce(key, "_key").alias(key))


def trend_faults(trend: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    """(key, fault): where a trend block and a windows block (window_end, recent, prior) disagree, the first fault of each key; counts are compared only where the trend has any."""
    other = windows.select(key, *[F.col(c).alias(f"_{c}") for c in ("window_end", "recent", "prior")])
    off = lambda c: ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    counted = F.col("recent").isNotNull()
    fault = F.when(off("window_end"), "window_end").when(counted & off("recent"), "recent").when(counted & off("prior"), "prior")
    return trend.join(other, key).select(key, fault.alias("fault")).filter("fault is not null")


def schema_faults(df: DataFrame, contract: T.StructType) -> list[str]:
    """Columns that are missing, extra or of another type; a plan-time check."""
    have, want = {f.name: f.dataType for f in df.schema}, {f.name: f.dataType for f in contract}
    return sorted([f"missing {c}" for c in want.keys() - have.keys()] + [f"extra {c}" for c in have.keys() - want.keys()] + [f"type of {c}" for c in want.keys() & have.keys() if want[c] != have[c]])


def value_faults(df: DataFrame, key: str, allowed: dict[str, tuple[str, ...]], required: list[str]) -> DataFrame:
    """(key, fault): a row for each column whose value is null though required, or not one of the allowed."""
    bad = [F.when(~F.col(c).isin(*v), F.lit(f"value of {c}")) for c, v in allowed.items()]
    bad += [F.when(F.col(c).isNull(), F.lit(f"null in {c}")) for c in required]
    return df.select(key, F.explode(F.array_compact(F.array(*bad))).alias("fault"))


def stronger(df: DataFrame, old: str, new: str, complete: Column) -> DataFrame:
    """df with ``kept`` and ``n``: the rebuild only where it is complete and has no fewer rows than what is published."""
    good = F.coalesce(complete & (F.col(new) >= F.col(old)), F.lit(False))
    return df.withColumns({"kept": F.when(good, "rebuilt").otherwise("published"), "n": F.when(good, F.col(new)).otherwise(F.col(old))})


def names_of_individuals(df: DataFrame, name: str, kind: str) -> DataFrame:
    return df.filter((F.coalesce(F.col(name), F.lit("")) != "") & (F.col(kind) != "business"))


def unreconciled(parts: DataFrame, totals: DataFrame, key: str, part: str, total: str, tolerance: float) -> DataFrame:
    """Keys whose parts do not add up to their total."""
    sums = parts.groupBy(key).agg(F.sum(part).alias("_sum"))
    return totals.join(sums, key, "left").filter(F.abs(F.coalesce("_sum", F.lit(0.0)) - F.col(total)) > tolerance)


def only_in_one(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of one side only, with the side."""
    left = a.select(key).distinct().join(b, key, "left_anti").select(key, F.lit("missing").alias("state"))
    return left.union(b.select(key).distinct().join(a, key, "left_anti").select(key, F.lit("extra").alias("state")))


def incoherent_stamps(data: DataFrame, published: DataFrame, key: str, provenance: str, live: str, same: list[str]) -> DataFrame:
    """(key, fault): published files whose provenance (or that of their data) is not live, or whose stamps differ from those of the data; the first fault of each."""
    other = published.select(key, *[F.col(c).alias(f"_{c}") for c in (provenance, *same)])
    fault = F.when(~(F.col(provenance).eqNullSafe(F.lit(live)) & F.col(f"_{provenance}").eqNullSafe(F.lit(live))), provenance)
    for c in same:
        fault = fault.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), c)
    return data.join(other, key).select(key, fault.alias("fault")).filter("fault is not null")


def named_enough(df: DataFrame, group: str, name: str, least: int) -> DataFrame:
    """(group, named, accepted): whether so many distinct names that a refresh may replace what is published."""
    return df.groupBy(group).agg(F.count_distinct(name).alias("named")).withColumn("accepted", F.col("named") >= least)
