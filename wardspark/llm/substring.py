"""Substring dedup by content-defined chunking.

A gear rolling hash over the last 16 bytes of the text decides, at the end of
each word, whether a chunk ends there, so boundaries depend on nearby content
only and find back after an insertion or deletion; no byte of another text
counts, so they are the same in every batch and partition.  Chunks average four words; a digest
covers ``WIDTH`` chunks in a row, so that a common phrase alone is no repeat.
Chunks under a digest that several documents hold are repeats, and a run of
them counts from ``MIN_WORDS`` words on.  The document of the least doc_id that
holds a passage keeps it.  A run that earlier documents hold by parts is cut
where the document or the place in it changes, so that every part stands as it
is in its first document, and what a document is itself the first to hold stays.

Digests are counted first, a partial aggregate, so a chunk that a third of all
documents share costs one row per task.  The (digest, doc, place) rows of those
that occur again go on and get the least document and the place (number of the
chunk) there; the few that have a thousandth of all rows or more
are broadcast and their rows spread, so no task gets all rows of one passage.

Defined results: a null or empty text has no chunks; a document has no repeat
with itself alone (rows that share a doc_id are one document); a row without
doc_id takes no part and keeps its text; very long texts are chunked whole; an
empty table gives no rows; other columns are carried unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.llm._shared import cut, join_spread, table
from wardspark.llm._words import _LOWER, mix, slices, word_hashes, words

MIN_WORDS = 20
WIDTH = 3
#: A chunk ends after a word with chance 1 / CUT.
CUT = 4
MAX_WORDS = 16
_GEAR = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def gear_hashes(data: np.ndarray, ends: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The gear hash, sum of gear[b] << age over the last 16 bytes, at the places ``ends``; bytes in front of ``begins`` (of the text) do not count."""
    low = _LOWER[data]
    h = np.zeros(len(ends), dtype=np.uint64)
    for age in range(16):
        at = ends - 1 - age
        h += np.where(at >= begins, _GEAR[low[np.maximum(at, 0)]], np.uint64(0)) << np.uint64(age)
    return h


def _chained(digest: np.ndarray, width: int) -> np.ndarray:
    """One digest for each ``width`` digests in a row; none for a width of zero."""
    out = np.zeros(max(0, len(digest) - width + 1) if width else 0, dtype=np.uint64)
    for i in range(width):
        out = mix(out * np.uint64(0xA0761D6478BD642F) + digest[i : i + len(out)])
    return out


def chunks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For every text the digests of its windows of WIDTH chunks, and of every chunk the first byte, last byte + 1 and number of words.

    A text of fewer chunks has one window.
    """
    none = np.zeros(0, np.int64)
    for _, data, at in slices(texts):
        starts, ends, per = words(data, at)
        if not len(starts):
            yield from ((none.astype(np.uint64), none, none, none) for _ in at[1:])
            continue
        rolled = mix(gear_hashes(data, ends, np.repeat(at[:-1], np.diff(per))))
        last = rolled % np.uint64(CUT) == 0
        filled = np.flatnonzero(per[1:] > per[:-1])
        last[per[1:][filled] - 1] = True
        # Where content gives no cut (one word again and again), every MAX_WORDS words since the last.
        at_cut = np.where(last, np.arange(len(last)), -1)
        since = np.arange(len(last)) - np.concatenate([[-1], np.maximum.accumulate(at_cut)[:-1]])
        last |= since % MAX_WORDS == 0
        end = np.flatnonzero(last)
        begin = np.concatenate([[0], end[:-1] + 1])
        # The digest of a chunk: a polynomial over the hashes of its words.
        h = word_hashes(data, starts, ends)
        place = np.arange(len(h)) - np.repeat(begin, end - begin + 1)
        weights = mix(place.astype(np.uint64) + np.uint64(1)) | np.uint64(1)
        sums = np.add.reduceat(h * weights, begin)
        digest = mix(sums + (end - begin + 1).astype(np.uint64))
        whole = _chained(digest, WIDTH)
        of = np.searchsorted(end, per)
        for k in range(len(per) - 1):
            a, b = of[k], of[k + 1]
            windows = whole[a : b - WIDTH + 1] if b - a >= WIDTH else _chained(digest[a:b], b - a)
            yield windows, starts[begin[a:b]] - at[k], ends[end[a:b]] - at[k], end[a:b] - begin[a:b] + 1


def _digest_rows(docs: DataFrame) -> DataFrame:
    """(digest, doc_id, at): the distinct digests of every text, and the first chunk under each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            found = [np.unique(d, return_index=True) for d, _, _, _ in chunks(batch.column(1))]
            owners = np.repeat(ids, [len(x) for x, _ in found]).astype(np.int64)
            digests = np.concatenate([*(x for x, _ in found), np.zeros(0, np.uint64)]).view(np.int64)
            places = np.concatenate([*(x for _, x in found), np.zeros(0, np.int64)]).astype(np.int32)
            for k in range(0, len(digests), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 100_000]) for x in (digests, owners, places)], names=["digest", "doc_id", "at"])

    return docs.filter("doc_id is not null").select("doc_id", "text").mapInArrow(run, "digest long, doc_id long, at int")


def shared_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, shared array<struct<digest, first_doc, first_at>>): the digests of each document that other documents hold too."""
    rows = _digest_rows(docs)
    # First the digests that occur more than once, by counts alone; only their rows go on.
    often = cut(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    held = cut(join_spread(rows, often, "digest", "n", "n").filter("n is not null").drop("n"))
    counted = held.groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.min_by("at", "doc_id").alias("at"), F.count(F.lit(1)).alias("n"))
    shared = cut(counted.filter("first_doc < last_doc").select("digest", "n", F.struct(F.col("first_doc").alias("doc_id"), "at").alias("first")))
    found = join_spread(held.drop("at"), shared, "digest", "n", "first").filter("first is not null")
    return found.groupBy("doc_id").agg(F.collect_set(F.struct("digest", F.col("first.doc_id").alias("first_doc"), F.col("first.at").alias("first_at"))).alias("shared"))


def passages(windows: list[int], n: list[int], first: dict[int, tuple[int, int]], own: int) -> Iterator[tuple[int, int, int]]:
    """(first chunk, last chunk + 1, first document) of the repeated passages of one text, the document ``own``.

    A chunk goes to the least document of the windows over it.  Inside a run of
    MIN_WORDS words or more, chunks in a row that earlier documents hold count
    from MIN_WORDS words on, each part by its own first document and place; the
    rest of the run is this document's own.
    """
    hits = [first.get(w) for w in windows]
    held: list[tuple[int, int] | None] = []
    for i in range(len(n)):
        best, follow = None, None
        if held and held[-1] is not None:
            follow = (held[-1][0], held[-1][1] + 1)
        for k in range(max(0, i - WIDTH + 1), min(i + 1, len(hits))):
            if (hit := hits[k]) is not None and (best is None or hit[0] < best[0] or (hit[0] == best[0] and best != follow)):
                best = (hit[0], hit[1] + i - k)
        held.append(best)
    k = 0
    while k < len(n):
        if held[k] is None:
            k += 1
            continue
        end = k
        while end < len(n) and held[end] is not None:
            end += 1
        if sum(n[k:end]) >= MIN_WORDS:
            kept = k  # the first chunk of this document's own since the last part of another
            while k < end:
                stop = k + 1
                if held[k][0] != own:
                    while stop < end and held[stop][0] != own:
                        stop += 1
                    if sum(n[k:stop]) >= MIN_WORDS:
                        if kept < k:
                            yield kept, k, own
                        cuts = [k, *(i for i in range(k + 1, stop) if held[i] != (held[i - 1][0], held[i - 1][1] + 1)), stop]
                        yield from ((x, y, held[x][0]) for x, y in zip(cuts[:-1], cuts[1:]))
                        kept = stop
                k = stop
            if kept < end:
                yield kept, end, own
        k = end


def spans(docs: DataFrame) -> DataFrame:
    """(row struct, spans array<struct<start, end, words, first_doc>>): the repeated passages of every row, places in code points."""
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32()), ("first_doc", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own, known, text, (windows, a, b, n) in zip(batch.column("_id"), batch.column("shared"), batch.column("text"), chunks(batch.column("text"))):
                made = []
                if known.is_valid:
                    digests, holders, places = (known.values.field(c).to_pylist() for c in ("digest", "first_doc", "first_at"))
                    first = dict(zip(digests, zip(holders, places)))
                    raw, n = text.as_py().encode(), n.tolist()
                    for x, y, doc in passages(windows.view(np.int64).tolist(), n, first, own.as_py()):
                        start = len(raw[: a[x]].decode())
                        made.append({"start": start, "end": start + len(raw[a[x] : b[y - 1]].decode()), "words": sum(n[x:y]), "first_doc": doc})
                out.append(made)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.list_(span))], names=["row", "spans"])

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(F.col("doc_id").alias("_id"), row.alias("row"))
    joined = keyed.join(shared_digests(docs).withColumnRenamed("doc_id", "_id"), "_id", "left").select("_id", "row", "row.text", "shared")
    return joined.mapInArrow(run, f"row {keyed.schema['row'].dataType.simpleString()}, spans array<struct<start:int,end:int,words:int,first_doc:bigint>>")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs whose texts have lost each repeated passage but in its first document; n_chars follows if there is one."""
    marked = spans(docs)
    later = F.filter("spans", lambda s: s.first_doc != F.col("row.doc_id"))
    # The text between the passages that go.
    zero = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    text = F.col("row.text")
    kept = F.aggregate(later, zero, lambda acc, s: F.struct(F.concat(acc.text, F.substring(text, acc["at"] + 1, s.start - acc["at"])).alias("text"), s.end.alias("at")))
    rest = F.when(F.size(later) == 0, text).otherwise(F.concat(kept.text, F.substring(text, kept["at"] + 1, F.length(text))))
    columns = [rest.alias(c) if c == "text" else F.length(rest).cast("long").alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns]
    return marked.select(*columns)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each repeated passage in each document that holds it; removed is false in the first document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spans(docs).select("row.doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*").withColumn("removed", F.col("doc_id") != F.col("first_doc"))
