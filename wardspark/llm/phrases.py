"""Phrase collocations by relational mining of occurrences, length by length.

The occurrence relation of length k holds, for every place in a piece of text
where a phrase of k words begins, the place and the words.  It is written
sorted: a row is a run of whole pieces of one slice of documents, with the gap
of each place to the one before (1: the next word of the same piece; a piece ends
with a gap of 2 at least) and the words as numbers into the run's own list of
word keys.  All three are bytes, in numbers as narrow as the run allows, and files
have small row groups: as arrays of long and int, a reader held several vectors for
each element of a whole row group, and Arrow four bytes for each number.  Length k + 1 is the merge-join of the relation with itself on piece
and adjacent position: both sides are sorted and no piece leaves its run, so the
join reads a run once and nothing is shuffled.  Groups are counted over all
runs, and before it is written and extended further the relation is semi-joined
with the groups that are frequent.  Two steps do that: counts of hashed groups
(40 bits, a narrow shuffle) give a bitmap of at most 2**MOST_BITS bits, which
never drops a frequent group, and what passes it is counted by its words.  So
results are exact at every size while the broadcast stays at 16 MB.  A relation is
removed as soon as the next one and its counts are written.

Each candidate is cut in two in every way and scored with exact decimals by the
cut that explains it best; candidates that mostly occur inside a longer one go.

Words are told apart by 64-bit hashes of language and word (two words share
one with chance 2**-64); their counts go by the strings themselves.

Defined results: a null language is ``und`` and counts together with rows that
say ``und``; a null, empty or blank text has no words; very long texts are a run of
their own and are read whole; repeated rows count each; ties go by score, count
and the phrase's bytes; an empty table gives no rows; other columns, whatever
their names, and ids are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardspark.llm._shared import arrow_rows, cut, join_few, remove, table, written
from wardspark.llm._words import mix, slices, word_hashes, words

RUN = 1 << 20
#: Documents, and runs of a relation, in a batch.
DOCUMENTS, RUNS = 500, 4
#: How relations are written; a reader holds a row group at once.
_FILES = {"compression": "zstd", "parquet.block.row.count.limit": RUNS, "parquet.page.size.row.check.min": 1, "parquet.enable.dictionary": "false"}
MOST_BITS = 27
HASHED_BITS = 40
#: Of Spark's bitmap functions: bits in one bitmap.
_CHUNK = 1 << 15
#: The best of a language are first chosen in so many parts.
PARTS = 64
_U = np.uint64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

# Bytes that end a piece, and those that end a word inside one.
_PIECE = np.zeros(256, dtype=bool)
_PIECE[list(b".,;:!?\n\x0b\x0c\r")] = True
_BLANK = _PIECE.copy()
_BLANK[[0x20, 0x09]] = True


def _lang_key(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8, key=b"lang").digest(), "little")


def runs(batch: pa.RecordBatch) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]]:
    """Of slices of documents (lang, text): lower-cased bytes; of every word start, end, key, place and document; the languages."""
    langs = ["und" if x is None else x for x in batch.column(0).to_pylist()]
    of = {x: _lang_key(x) for x in set(langs)}
    for first, data, at in slices(batch.column(1), RUN):
        mine = langs[first : first + len(at) - 1]
        starts, ends, per = words(data, at, _BLANK)
        doc = np.repeat(np.arange(len(mine)), np.diff(per))
        keys = mix(word_hashes(data, starts, ends) + np.array([of[x] for x in mine], dtype=_U)[doc])
        # A piece ends between two words with an end in between, or of two documents.
        ended = np.concatenate([[0], np.cumsum(_PIECE[data])])
        new = np.ones(len(starts), dtype=bool)
        new[1:] = (ended[starts[1:]] > ended[ends[:-1]]) | (doc[1:] != doc[:-1])
        yield data.tobytes().translate(_LOWER), starts, ends, keys, np.arange(len(starts)) + np.cumsum(new), doc, mine


def word_counts(docs: DataFrame) -> DataFrame:
    """(key, lang, word, n) over all occurrences; docs: lang, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, starts, ends, keys, _, doc, langs in runs(batch):
                found, first, n = np.unique(keys, return_index=True, return_counts=True)
                at = zip(starts[first].tolist(), ends[first].tolist())
                columns = [pa.array(found.view(np.int64)), pa.array([langs[i] for i in doc[first].tolist()], pa.string()), pa.array([data[a:b].decode() for a, b in at], pa.string()), pa.array(n.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "lang", "word", "n"])

    counted = docs.select("lang", "text").mapInArrow(run, "key long, lang string, word string, n long")
    return counted.groupBy("key", "lang", "word").agg(F.sum("n").alias("n"))


def _names(k: int) -> list[str]:
    return [f"w{i}" for i in range(k)]


def _hashed(keys: list[np.ndarray]) -> np.ndarray:
    """A group of word keys as a number of HASHED_BITS."""
    h = keys[0]
    for k in keys[1:]:
        h = mix(h * _U(0xA0761D6478BD642F) + k)
    return h >> _U(64 - HASHED_BITS)


class Frequent:
    """A bitmap of hashed groups (column ``h``), broadcast to all tasks: 16 bits a group, and 2**MOST_BITS at most."""

    def __init__(self, groups: DataFrame):
        self.bits = min(MOST_BITS, max(15, math.ceil(math.log2(16 * groups.count() + 1))))
        bit = F.col("h").bitwiseAND(F.lit((1 << self.bits) - 1))
        marked = groups.groupBy(F.floor(bit / _CHUNK).alias("chunk")).agg(F.bitmap_construct_agg(bit % _CHUNK).alias("b")).collect()
        held = np.zeros((1 << self.bits) // 8, dtype=np.uint8)
        for r in marked:
            held[r.chunk * _CHUNK // 8 : (r.chunk + 1) * _CHUNK // 8] = np.frombuffer(r.b, np.uint8)
        self.held = groups.sparkSession.sparkContext.broadcast(held)

    def holds(self, keys: list[np.ndarray]) -> np.ndarray:
        """Whether each group may be frequent."""
        h = _hashed(keys) & _U((1 << self.bits) - 1)
        return (self.held.value[h >> _U(3)] >> (h & _U(7)).astype(np.uint8)) & 1 == 1


_RELATION = "known binary, gap binary, words binary"


def _number(n: int) -> type:
    """The kind of numbers below n."""
    return np.uint16 if n <= 1 << 16 else np.uint32


def _relation(known: np.ndarray, place: np.ndarray, local: list[np.ndarray]) -> pa.RecordBatch:
    """One run: places (sorted) and, as numbers into known (sorted), the words of the phrase that begins there."""
    if len(local) > 1 or len(known) > 2 * len(place) + 16:
        used, number = np.unique(np.concatenate(local), return_inverse=True)
        known, local = known[used], np.split(number, len(local))
    gap = np.diff(place, prepend=place[0])
    # All first bytes of the keys, all second ones and so on: the highest of sorted keys are nearly all repeats.
    columns = known.view(np.uint8).reshape(-1, 8).T, gap.astype(np.min_scalar_type(int(gap.max()))), np.stack(local, axis=1).astype(_number(len(known)))
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in columns], names=["known", "gap", "words"])


def _read(batch: pa.RecordBatch, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """known, places and the (n, k) words of every run of a batch."""
    for row in zip(*batch.columns):
        known, gap, flat = (x.as_buffer() for x in row)
        known = np.frombuffer(known, np.uint8).reshape(8, -1).T.copy().view(_U).ravel()
        words_ = np.frombuffer(flat, _number(len(known))).reshape(-1, k)
        yield known, np.cumsum(np.frombuffer(gap, f"u{gap.size // len(words_)}"), dtype=np.int64), words_


def occurrences(docs: DataFrame, frequent: Frequent) -> DataFrame:
    """The relation of single words, semi-joined with the frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, keys, place, _, _ in runs(batch):
                known, local = np.unique(keys, return_inverse=True)
                kept = frequent.holds([known])
                rows = np.flatnonzero(kept[local])
                if len(rows):
                    yield _relation(known[kept], place[rows], [(np.cumsum(kept) - 1)[local[rows]]])

    return docs.select("lang", "text").mapInArrow(run, _RELATION)


def _merged(place: np.ndarray, words_: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The merge-join of a sorted run with itself on the next place: where phrases one word longer begin, and their words."""
    left = np.flatnonzero(place[1:] == place[:-1] + 1)
    return place[left], [*words_[left].T, words_[left + 1, -1]]


def hashed_counts(relation: DataFrame, k: int) -> DataFrame:
    """(h, n): how often hashed phrases of k + 1 words occur; relation: of k words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for known, place, words_ in _read(batch, k):
                h, n = np.unique(_hashed([known[x] for x in _merged(place, words_)[1]]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    return relation.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def extended(relation: DataFrame, k: int, frequent: Frequent) -> DataFrame:
    """The relation of k + 1 words, semi-joined with the frequent groups; relation: of k words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for known, place, words_ in _read(batch, k):
                place, local = _merged(place, words_)
                rows = np.flatnonzero(frequent.holds([known[x] for x in local]))
                if len(rows):
                    yield _relation(known, place[rows], [x[rows] for x in local])

    return relation.mapInArrow(run, _RELATION)


def group_counts(relation: DataFrame, k: int) -> DataFrame:
    """(w0 .., n): how often each phrase of a relation of k words occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for known, _, words_ in _read(batch, k):
                group = words_[np.lexsort(words_.T[::-1])]
                new = np.ones(len(group), dtype=bool)
                new[1:] = (group[1:] != group[:-1]).any(1)
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(group)))
                yield pa.RecordBatch.from_arrays([*(pa.array(known[x].view(np.int64)) for x in group[first].T), pa.array(n.astype(np.int64))], names=[*_names(k), "n"])

    kinds = ", ".join(f"{c} long" for c in (*_names(k), "n"))
    return relation.mapInArrow(run, kinds).groupBy(*_names(k)).agg(F.sum("n").alias("n"))


def frequent_phrases(docs: DataFrame, least: int, most_words: int) -> tuple[DataFrame, dict[int, DataFrame]]:
    """All word counts, and by length (from 1) the groups of words that occur ``least`` times: w0 .. and n.

    All are written before it returns; a relation is removed when the next one and its counts are there.
    """
    spark = docs.sparkSession
    with arrow_rows(spark, DOCUMENTS):
        every = cut(word_counts(docs))
        groups = {1: every.filter(F.col("n") >= least).select(F.col("key").alias("w0"), "n")}
        hashed = F.shiftrightunsigned("w0", 64 - HASHED_BITS).alias("h")
        relation, path = written(occurrences(docs, Frequent(groups[1].select(hashed))), **_FILES)
    with arrow_rows(spark, RUNS):
        for k in range(2, most_words + 1):
            frequent = Frequent(cut(hashed_counts(relation, k - 1).filter(F.col("n") >= least).select("h")))
            longer, next_path = written(extended(relation, k - 1, frequent), **_FILES)
            remove(spark, path)
            relation, path = longer, next_path
            groups[k] = cut(group_counts(relation, k).filter(F.col("n") >= least))
        remove(spark, path)
    return every, groups


def _scored(groups: dict[int, DataFrame], k: int) -> DataFrame:
    """Candidates of k words with a and the lowest-scoring cut: best (score, at, l, r)."""
    rows = groups[k].withColumnRenamed("n", "a")
    cuts = []
    for j in range(1, k):
        for side, columns in (("l", _names(k)[:j]), ("r", _names(k)[j:])):
            part = groups[len(columns)].select(*[F.col(c).alias(d) for c, d in zip(_names(len(columns)), columns)], F.col("n").alias(f"{side}{j}"))
            rows = join_few(rows, part, columns, "inner")
        score = F.expr(f"(cast(1000000 as decimal(7,0)) * (cast(a as decimal(19,0)) * cast(a as decimal(19,0)))) div (cast(l{j} as decimal(19,0)) * cast(r{j} as decimal(19,0)))")
        cuts.append(F.struct(score.alias("score"), F.lit(j).alias("at"), F.col(f"l{j}").alias("l"), F.col(f"r{j}").alias("r")))
    return rows.select(*_names(k), "a", (F.least(*cuts) if len(cuts) > 1 else cuts[0]).alias("best"))


def _inside_longer(groups: dict[int, DataFrame], k: int) -> DataFrame | None:
    """(w0 .., most): the largest count of a longer candidate that holds the phrase."""
    out = None
    for m in (m for m in groups if m > k):
        for at in range(m - k + 1):
            part = groups[m].select(*[F.col(c).alias(d) for c, d in zip(_names(m)[at : at + k], _names(k))], "n")
            out = part if out is None else out.union(part)
    return None if out is None else out.groupBy(*_names(k)).agg(F.max("n").alias("most"))


def collocations(docs: DataFrame, least: int = 10, most_words: int = 3, inside_percent: int = 50, per_lang: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two to most_words words; docs: lang, text."""
    every, groups = frequent_phrases(docs, least, most_words)
    totals = every.groupBy("lang").agg(F.sum("n").alias("n"))
    dictionary = every.filter(F.col("n") >= least).select("key", "lang", "word")
    found = None
    for k in range(2, most_words + 1):
        rows = _scored(groups, k)
        longer = _inside_longer(groups, k)
        if longer is not None:
            rows = rows.join(longer, _names(k), "left").filter(F.coalesce(100 * F.col("most") < inside_percent * F.col("a"), F.lit(True)))
        for i, c in enumerate(_names(k)):
            names = [F.col("key").alias(c), F.col("word").alias(f"word{i}"), *([F.col("lang")] if not i else [])]
            rows = join_few(rows, dictionary.select(*names), [c], "inner")
        rows = rows.select("lang", F.concat_ws(" ", *[f"word{i}" for i in range(k)]).alias("phrase"), "a", "best.l", "best.r", "best.score")
        found = rows if found is None else found.union(rows)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    best = found.withColumn("_part", part).withColumn("_n", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("_n") <= per_lang)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= per_lang)
    return join_few(ranked, totals, ["lang"], "inner").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
    regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps
  FROM documents
), q AS (SELECT d, lang, unnest(ps) AS piece, unnest(range(len(ps))) AS k FROM p
), s AS (SELECT d, k, lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM q
), w AS (SELECT d, k, lang, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM s
), t AS (
  SELECT lang, w AS w1, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY d, k ORDER BY i)
), c1 AS (SELECT lang, w1, count(*) AS n FROM t GROUP BY ALL
), c2 AS (SELECT lang, w1, w2, count(*) AS n FROM t WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), c3 AS (SELECT lang, w1, w2, w3, count(*) AS n FROM t WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), cuts AS (
  SELECT c2.lang, c2.w1 || ' ' || c2.w2 AS phrase, c2.n AS a, 1 AS k, x.n AS l, y.n AS r
  FROM c2 JOIN c1 x ON x.lang = c2.lang AND x.w1 = c2.w1 JOIN c1 y ON y.lang = c2.lang AND y.w1 = c2.w2
  WHERE NOT EXISTS (SELECT 1 FROM c3 WHERE c3.lang = c2.lang AND c3.w1 = c2.w1 AND c3.w2 = c2.w2 AND 100 * c3.n >= 50 * c2.n)
    AND NOT EXISTS (SELECT 1 FROM c3 WHERE c3.lang = c2.lang AND c3.w2 = c2.w1 AND c3.w3 = c2.w2 AND 100 * c3.n >= 50 * c2.n)
  UNION ALL
  SELECT c3.lang, c3.w1 || ' ' || c3.w2 || ' ' || c3.w3, c3.n, 1, x.n, y.n
  FROM c3 JOIN c1 x ON x.lang = c3.lang AND x.w1 = c3.w1 JOIN c2 y ON y.lang = c3.lang AND y.w1 = c3.w2 AND y.w2 = c3.w3
  UNION ALL
  SELECT c3.lang, c3.w1 || ' ' || c3.w2 || ' ' || c3.w3, c3.n, 2, x.n, y.n
  FROM c3 JOIN c2 x ON x.lang = c3.lang AND x.w1 = c3.w1 AND x.w2 = c3.w2 JOIN c1 y ON y.lang = c3.lang AND y.w1 = c3.w3
), scored AS (
  SELECT *, CAST(1000000::HUGEINT * a * a // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best
)
SELECT ranked.lang, rank, phrase, a, l, r, CAST(t.n AS BIGINT) AS n, score
FROM ranked JOIN (SELECT lang, sum(n) AS n FROM c1 GROUP BY lang) t USING (lang) WHERE rank <= 2000
"""
