"""Spelling variants of a vocabulary by asymmetric q-chunks.

Two words are near if one inserted, deleted or replaced code point makes one the
other.  Of each such pair the shorter word contributes two disjoint chunks, its
halves, the other its positional grams of the same lengths; one edit lies in one
half, so the other half stands unchanged in the longer word, at its own place
or moved by the difference of lengths, which is one at most.  Of all positional
grams those within that shift of a chunk's place are made, since no other could
join.  Chunks and grams meet in an equi-join on the length of the chunked word,
the half and its text; half a word is a rare thing to share, and the exact test
(an edit distance of one) is part of the join, so no candidate pair is written.

A word's form is its most frequent near word if that is frequent enough; roots
follow forms by pointer jumping: each step multiplies the count by the factor,
so a chain has few links and the rounds are the logarithm of that.  Form and
jump tables have one row a word.  Only SQL functions run, and hot words are
counted on the map side before they travel.

Defined results: a null or empty text has no runs; a null id is an empty text in
the hash, so ``:run``; very long texts are read whole; repeated rows count each;
ties go to the word that is first in code-point order; an empty table gives no
rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.llm._shared import cut, table

#: Letters of a run, and the share of runs that lose a letter.
RUNS = r"[A-Za-zÀ-ÿ]+"
SLIP = 97


def _lower(text: Column) -> Column:
    """A-Z only."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def slipped_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(word) of every run of letters of every text; where SLIP divides the hash of id and run, the run has lost one code point."""
    runs = docs.select(F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(_lower(F.col(f"`{text_column}`")), F.lit(RUNS), F.lit(0))).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut_short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return hashed.select(F.when(F.col("h") % SLIP == 0, cut_short).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, shortest: int = 5, least: int = 3) -> DataFrame:
    """(word, n): the distinct words of ``shortest`` code points and ``least`` occurrences."""
    return words.filter(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def chunks(words: DataFrame) -> DataFrame:
    """(size, half, piece, a, na): the two halves of every word; size is the word's length."""
    size = F.length("word")
    half = F.floor(size / 2).cast("int")
    both = F.array(F.struct(F.lit(0).alias("half"), F.substring("word", F.lit(1), half).alias("piece")), F.struct(F.lit(1).alias("half"), F.substring("word", half + 1, size).alias("piece")))
    return words.select(size.alias("size"), F.explode(both).alias("c"), F.col("word").alias("a"), F.col("n").alias("na")).select("size", "c.half", "c.piece", "a", "na")


def grams(words: DataFrame) -> DataFrame:
    """(size, half, piece, b, nb): for words of the same length and of one less, the grams as long as their halves, where these could stand."""
    length = F.length("word")

    def of(less: int, half: int, shift: int) -> Column:
        size = length - less
        first = F.floor(size / 2).cast("int")
        place, long = (F.lit(0), first) if not half else (first, size - first)
        return F.struct(size.alias("size"), F.lit(half).alias("half"), F.substring("word", place + shift + 1, long).alias("piece"))

    each = [of(less, half, shift) for less in (0, 1) for half in (0, 1) for shift in range(less + 1)]
    return words.select(F.explode(F.array_distinct(F.array(*each))).alias("g"), F.col("word").alias("b"), F.col("n").alias("nb")).select("g.size", "g.half", "g.piece", "b", "nb")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, na, b, nb): every pair of near words once; words: word, n.  Words of one letter, whose first half is empty, are met by their second."""
    one = (F.length("b") > F.col("size")) | (F.col("a") < F.col("b"))
    met = chunks(words).join(grams(words), ["size", "half", "piece"]).filter(one & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "na", "b", "nb").distinct()


def forms(words: DataFrame, pairs: DataFrame, factor: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n): the near word of largest count, if that is ``factor`` times the word's own."""
    sides = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m")).union(pairs.select("b", "a", "na"))
    best = sides.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("other").alias("form"))).alias("f"))
    joined = words.join(best, "word", "left")
    fits = -F.col("f.m") >= factor * F.col("n")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("f.form")).alias("form"), F.when(fits, -F.col("f.m")).alias("form_n"))


def roots(found: DataFrame) -> DataFrame:
    """(word, root) of all words with a form: the last of the chain of forms.  Every round doubles how far a row has followed its chain."""
    now = cut(found.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jumped = cut(now.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        now = jumped.select("word", "root")
        if not jumped.filter("moved").limit(1).count():
            return now


def variants(words: DataFrame, factor: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of a vocabulary (word, n)."""
    words = cut(words)
    found = cut(forms(words, near_pairs(words), factor))
    joined = found.join(roots(found), "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(slipped_runs(table(spark, sf_dir, "documents"))))


#: The CRC has no function in DuckDB: a table of 256 values from its polynomial, and a fold over the bytes.
SQL = r"""
WITH RECURSIVE bits AS (
  SELECT range AS b, list_reduce(list_prepend(CAST(range AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256)
), crc AS (SELECT list(v ORDER BY b) AS tbl FROM bits
), runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run
  FROM documents
), each AS (SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS x FROM runs GROUP BY ALL
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(len(x) // 2), lambda i: CAST(strpos('0123456789ABCDEF', x[2 * i + 1]) * 16 + strpos('0123456789ABCDEF', x[2 * i + 2]) - 17 AS BIGINT))),
    lambda c, y: xor(c >> 8, tbl[(xor(c, y) & 255) + 1]))) AS h
  FROM each, crc
), slipped AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM hashed
), v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), short AS (SELECT word, n, length(word) AS size, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM v, LATERAL (SELECT unnest(range(length(word))) AS i)
), pairs AS (
  SELECT DISTINCT a.word AS a, a.n AS na, b.word AS b, b.n AS nb FROM short a JOIN short b ON a.size = b.size AND a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT DISTINCT v.word, v.n, s.word, s.n FROM v JOIN short s ON s.rest = v.word
  UNION SELECT DISTINCT s.word, s.n, v.word, v.n FROM v JOIN short s ON s.rest = v.word
), best AS (
  SELECT a AS word, na AS n, count(*) AS n_near, max(nb) AS most, arg_min(b, {'m': -nb, 'w': b}) AS top FROM pairs GROUP BY a, na
), found AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * v.n THEN top END AS form, CASE WHEN most >= 2 * v.n THEN most END AS form_n FROM v LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS root, form AS next FROM found
  UNION ALL
  SELECT chain.word, found.word, found.form FROM chain JOIN found ON found.word = chain.next
)
SELECT found.word, form, chain.root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM found JOIN chain ON chain.word = found.word AND chain.next IS NULL
"""
