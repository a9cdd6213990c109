"""Quality rules: a threshold table compiled into one projection.

Every rule compares one measure of the text with a lower and an upper bound;
``compiled`` turns the table into Columns of a single select, so Spark reads
the text once and runs no user function.

Defined results: a null or blank text has zero words and is rejected by the
base rules; a very long text is measured whole; repeated rows are measured each
by itself and none is rejected for its length; an empty table gives no rows.
Input columns whose names clash with the measures are carried in a struct and
not read, only the named text column is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.llm._shared import BLANKS, let, table, text_of

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in that it is was for on are as with his they at be this have from or had by but not what all were we when your can said there"
    " der die das und ist nicht von zu den mit sich des auf für dem ein eine als auch es an werden aus er hat dass sie nach wird bei"
    " le la les et des en un une du que est pour qui dans ce il pas sur au plus par je avec se sont"
    " el los las y del se por con no su para es al lo como más pero sus le"
).split()


@dataclass(frozen=True)
class Rule:
    """low <= measure <= high, where a measure is scaled by ``per`` (another measure) as scale * measure / per."""

    name: str
    measure: str
    low: int | None = None
    high: int | None = None
    per: str | None = None
    scale: int = 1

    def holds(self) -> Column:
        m = F.col(self.measure) * self.scale
        per = F.col(self.per) if self.per else F.lit(1)
        parts = [m >= self.low * per] if self.low is not None else []
        parts += [m <= self.high * per] if self.high is not None else []
        return parts[0] if len(parts) == 1 else parts[0] & parts[1]


RULES = (
    Rule("length", "n_words", low=50),
    Rule("word_length", "word_chars", low=2, high=15, per="n_words"),
    Rule("symbols", "n_symbols", high=10, per="n_words", scale=100),
    Rule("stop_words", "n_stop_words", low=1, per="n_words", scale=100),
    Rule("duplicate_lines", "n_dup_lines", high=50, per="n_lines", scale=100),
)


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that the text holds at least twice; windows are compared as text."""
    n = F.size(words)
    grams = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<string>"))

    def covered(places: Column) -> Column:
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(places, zero, lambda a, p: F.struct((a.n + p + 3 - F.greatest(p, a.end)).alias("n"), (p + 3).alias("end"))).n

    def repeated(ordered: Column) -> Column:
        def again(x: Column, i: Column) -> Column:
            before = F.get(ordered, F.greatest(i - 1, F.lit(0)))
            after = F.get(ordered, i + 1)
            return ((i > 0) & (before.gram == x.gram)) | F.coalesce(after.gram == x.gram, F.lit(False))

        return let(F.sort_array(F.transform(F.filter(ordered, again), lambda x: x.at)), covered)

    return let(
        grams,
        lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(
            let(F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("gram"), i.alias("at")))), repeated)
        ),
    )


def measures(text: Column, stop_words: tuple[str, ...] = tuple(STOP_WORDS)) -> Column:
    """A struct of the counts that rules compare."""
    words = F.filter(F.split(text, f"{BLANKS}+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(*stop_words))).cast("long").alias("n_stop_words"),
        ),
    )
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return F.struct(of_words.alias("w"), of_lines.alias("l"), F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines")


def compiled(rules: tuple[Rule, ...] = RULES) -> dict[str, Column]:
    """base_failed, kept and the names of the rules that failed, over the measures."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    good = F.lit(True)
    for rule in rules:
        good = good & rule.holds()
    failed = F.array_compact(F.array(*[F.when(~r.holds(), F.lit(r.name)) for r in rules]))
    return {"base_failed": base, "kept": ~base & good, "failed_rules": failed}


def judged(docs: DataFrame, text_column: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs as struct ``row``, with the measures and the verdict beside it."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    measured = docs.select(row.alias("row"), measures(text_of(f"`{text_column}`")).alias("m"))
    flat = measured.select("row", "m.w.n_words", "m.w.word_chars", "m.n_symbols", "m.l.n_dup_lines", "m.w.n_repeat_words", "m.w.n_stop_words", "m.l.n_lines")
    return flat.withColumns(compiled(rules))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns."""
    return judged(docs).filter("kept").select("row.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_stop_words", "n_lines")


_WORDS = ", ".join("'" + w + "'" for w in sorted(set(STOP_WORDS)))
SQL = rf"""
WITH d AS (
  SELECT doc_id, t,
    list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
), g AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3
), grams AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM g
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM grams WHERE n > 1) GROUP BY doc_id
), m AS (
  SELECT d.doc_id,
    CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(list_filter(w, lambda x: lower(x) IN ({_WORDS}))) AS BIGINT) AS n_stop_words,
    CAST(len(l) AS BIGINT) AS n_lines
  FROM d LEFT JOIN covered USING (doc_id)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words >= 50 AND word_chars BETWEEN 2 * n_words AND 15 * n_words AND 100 * n_symbols <= 10 * n_words
    AND 100 * n_stop_words >= n_words AND 100 * n_dup_lines <= 50 * n_lines AS kept,
  n_stop_words, n_lines
FROM b
"""
