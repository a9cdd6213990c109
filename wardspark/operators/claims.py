"""Numeric claims in prose: the values a text restates, the tags it carries, and the gates on both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Tags that a claim may carry (fixed values).
TAGS = ("small-n", "provisional", "estimate")
# Fixed patterns: a bracket, the number at its head, and what makes the whole of it a date expression.
BRACKET = r"\(\s*([^()]*?)\s*\)"
LEADING = r"^[-+]?[0-9]+(?:,[0-9]{3})+(?:\.[0-9]+)?|^[-+]?[0-9]+(?:\.[0-9]+)?"
_DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2})?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?|[0-9]{4}-[0-9]{2}|(?:19|20)[0-9]{2}"
_MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
DATES = rf"^(?:\s|{_DATE}|{_MONTH}|to|through|thru|until|and|[-\u2013\u2014/,])+$"


def restated_values(text: Column) -> Column:
    """Numbers with which a bracket begins, thousands separators read; a bracket that is a date expression as a whole is exempt."""
    inner = F.regexp_extract_all(text, F.lit(BRACKET), F.lit(1))
    heads = F.transform(F.filter(inner, lambda b: ~F.rlike(F.lower(b), F.lit(DATES))), lambda b: F.regexp_extract(b, LEADING, 0))
    return F.transform(F.filter(heads, lambda h: h != ""), lambda h: F.replace(h, F.lit(","), F.lit("")).cast("double"))


def small_n(counts: list[Column], least: int = 20) -> Column:
    """The tag small-n where any count is below ``least``."""
    few = counts[0] < least
    for c in counts[1:]:
        few = few | (c < least)
    return F.array_compact(F.array(F.when(few, F.lit("small-n"))))


def caveat_keys(claims: DataFrame, stem: str, caveat: str, order: str, out: str) -> DataFrame:
    """Claims with a key shared by equal caveats of a stem: the stem, or stem-2, stem-3 in the order they are first seen."""
    first = claims.groupBy(stem, caveat).agg(F.min(order).alias("_first"))
    n = F.row_number().over(Window.partitionBy(stem).orderBy("_first"))
    keys = first.withColumn(out, F.when(n == 1, F.col(stem)).otherwise(F.concat_ws("-", F.col(stem), n.cast("string")))).drop("_first")
    return claims.join(keys, [stem, caveat], "left")


def misstated(claims: DataFrame, text: str, values: list[str], tolerance: float = 0.05) -> DataFrame:
    """Claims whose text restates a number that equals none of the values of the same row."""
    own = F.array(*[F.col(v).cast("double") for v in values])
    return claims.filter(F.exists(restated_values(F.col(text)), lambda r: ~F.exists(own, lambda v: F.coalesce(F.abs(v - r) <= tolerance, F.lit(False)))))


def badly_tagged(claims: DataFrame, tags: str, text: str, referent: str | None = None) -> DataFrame:
    """Claims with a tag outside the vocabulary, tagged provisional without a word of it in the text, or (with a pattern ``referent``) with a text that names none."""
    foreign = F.size(F.array_except(tags, F.array(*[F.lit(x) for x in TAGS]))) > 0
    silent = F.array_contains(tags, "provisional") & ~F.contains(F.lower(F.col(text)), F.lit("provisional"))
    bare = ~F.rlike(F.col(text), F.lit(referent)) if referent else F.lit(False)
    return claims.filter(foreign | F.coalesce(silent | bare, F.lit(True)))


def backlog(claims: DataFrame, selectors: DataFrame, required: list[str]) -> DataFrame:
    """(selector, claims): how many claims that no selector enforces yet lack a required column."""
    lacking = F.greatest(*[F.col(c).isNull() for c in required]) if len(required) > 1 else F.col(required[0]).isNull()
    return claims.join(selectors, "selector", "left_anti").filter(lacking).groupBy("selector").agg(F.count(F.lit(1)).alias("claims"))


def unqualified(claims: DataFrame, selectors: DataFrame, required: list[str]) -> DataFrame:
    """(selector, problem): claims that a selector enforces and that lack a required column, and selectors that hit nothing."""
    lacking = F.lit(False)
    for c in required:
        lacking = lacking | F.col(c).isNull()
    bare = claims.join(selectors, "selector", "left_semi").filter(lacking).select("selector", F.lit("unqualified").alias("problem"))
    return bare.union(selectors.join(claims, "selector", "left_anti").select("selector", F.lit("no claim").alias("problem"))).distinct()
