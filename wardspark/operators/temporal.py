"""Month series, trailing windows and trends over dated facts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def monthly(facts: DataFrame, date: str, measures: Mapping[str, Column], keys: DataFrame | None = None) -> DataFrame:
    """One row for each month from the first to the last (and each row of keys), counts of the measures, zero where nothing happened."""
    bounds = facts.agg(F.trunc(F.min(date), "MM").alias("a"), F.trunc(F.max(date), "MM").alias("b")).filter("a is not null")
    months = bounds.select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month_start"))
    by = ["month_start"]
    if keys is not None:
        # The one row of bounds is what is sent around; keys keep their partitions and each explodes its months.
        months = keys.crossJoin(F.broadcast(bounds)).select(*keys.columns, F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month_start"))
        by = [*keys.columns, *by]
    counts = facts.withColumn("month_start", F.trunc(date, "MM")).groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in measures.items()])
    out = months.join(counts, by, "left").fillna(0, list(measures))
    return out.withColumn("month", F.date_format("month_start", "yyyy-MM")).drop("month_start")


def trailing_windows(facts: DataFrame, date: str, key: str, measures: Mapping[str, Column] | None = None) -> DataFrame:
    """(key, recent, prior, earliest, anchor) against the latest date of all facts; earliest is of the key's own facts.

    recent: date > anchor - 365; prior: anchor - 730 < date <= anchor - 365.  Each
    further measure gives a pair of counts recent_<name> and prior_<name>.
    """
    anchor = facts.agg(F.max(date).alias("anchor"))
    d = F.col(date)
    dated = facts.crossJoin(F.broadcast(anchor))  # one row
    recent = d > F.date_sub("anchor", 365)
    prior = (d > F.date_sub("anchor", 730)) & ~recent
    more = [F.count_if(w & c).alias(f"{k}_{n}") for n, c in (measures or {}).items() for k, w in (("recent", recent), ("prior", prior))]
    return dated.groupBy(key).agg(F.count_if(recent).alias("recent"), F.count_if(prior).alias("prior"), *more, F.min(date).alias("earliest"), F.first("anchor").alias("anchor"))


def trend(windows: DataFrame) -> DataFrame:
    """windows with change in percent (to a tenth) and direction.

    A key whose own facts do not reach back two years, or without a prior one,
    has insufficient_data; of the first kind both counts are null.
    """
    enough = F.col("earliest") <= F.date_sub("anchor", 730)
    pct = F.round(F.when(enough & (F.col("prior") > 0), (F.col("recent") - F.col("prior")) * 100.0 / F.col("prior")), 1)
    direction = F.when(pct <= -5, "improving").when(pct >= 5, "worsening").when(pct.isNotNull(), "flat").otherwise("insufficient_data")
    told = {"pct": pct, "direction": direction, "recent": F.when(enough, F.col("recent")), "prior": F.when(enough, F.col("prior"))}
    return windows.withColumns(told)


def trailing_sum(series: DataFrame, order: str, value: str, n: int, partition: list[str]) -> DataFrame:
    """value summed over n rows; incomplete windows are left out."""
    w = Window.partitionBy(*partition).orderBy(order)
    total = F.sum(value).over(w.rowsBetween(1 - n, 0))
    return series.withColumn("_n", F.row_number().over(w)).withColumn(f"{value}_{n}", total).filter(F.col("_n") >= n).drop("_n")


def provisional_tail(series: DataFrame, order: str, partition: list[str], n: int = 2) -> DataFrame:
    """The last n rows of each series are marked provisional."""
    w = Window.partitionBy(*partition).orderBy(F.col(order).desc())
    return series.withColumn("provisional", F.row_number().over(w) <= n)
