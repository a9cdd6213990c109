"""Quality by the votes of nearest labelled neighbours in a latent semantic space.

A text becomes counts of hashed terms in four parts: its words, the shapes of
its words (runs of letters, digits and marks, so "STOP!!" and "GO!!" are one),
its length, and how many of its three-word windows came before in it.  Counts
are damped by a square root, weighted by inverse document frequency over all
documents, and each part is brought to length one.  The leading right singular
vectors of the labelled rows' matrix span the latent space.

The labelled vectors and the basis are broadcast; their size is bound by
LABELLED rows of DIMENSIONS numbers.  Each task multiplies blocks of documents
with all of them, takes the NEIGHBOURS of largest cosine (ties to the row that
stands first), and the score is the share of label 1 among these, weighted by a
power of the cosine.

What is fitted on a sample: the basis and the voters, from at most LABELLED
labelled rows (those of smallest hash of the id).  Document frequencies are
counted over all documents, and every document is scored whole.

Defined results: a null or empty text has the length "none" as its only term and
is scored by it; very long texts are read whole; repeated rows each get a row,
with one score; a row without id is scored and not held out; of rows that share
an id one votes (the one of least feature bytes), once for each label row;
labels that are null, or of ids without a document, do not vote; with no label at
all, or no neighbour of positive cosine, the score is the labels' mean (0.5 if there are
none); an empty table gives no rows; other columns, whatever their names, are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.llm._shared import table
from wardspark.llm._words import mix, slices, word_hashes, words

#: Most labelled rows that the basis is fitted on and that vote.
LABELLED = 8192
DIMENSIONS = 64
NEIGHBOURS = 15
POWER = 4
#: Hashed terms of each part (words, shapes, lengths, repeats) and the weight of the part.
PARTS = ((1024, 0.5), (896, 1.0), (126, 0.3), (2, 0.5))
TERMS = sum(n for n, _ in PARTS)
_STARTS = np.cumsum([0, *(n for n, _ in PARTS)])
#: Documents that are multiplied with the labelled vectors at once, and bytes of text taken at once.
BLOCK, _SLICE = 256, 1 << 20
_U = np.uint64

# Classes of bytes for shapes: letters (large, small and all beyond ASCII), digits, and every mark its own.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = 48, 65, 97, 97


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's sequence of classes, with runs of one class as one."""
    kind = _CLASS[data]
    begins = np.ones(len(data), dtype=bool)
    begins[1:] = kind[1:] != kind[:-1]
    begins[starts] = True
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[starts] += 1
    np.subtract.at(inside, ends, 1)
    at = np.flatnonzero(begins & (np.cumsum(inside[:-1]) > 0))
    first = np.searchsorted(at, starts)
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    return mix(np.add.reduceat(mix((kind[at].astype(_U) << _U(32)) + place.astype(_U) + _U(1)), first))


def _repeated(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether the window of three words that begins at each word came before in its text; the last two words of a text begin none."""
    out = np.zeros(len(h), dtype=bool)
    at = np.flatnonzero(doc[2:] == doc[:-2])
    windows = mix(mix(mix(h[at] + mix(doc[at].astype(_U))) + h[at + 1]) + h[at + 2])
    order = np.argsort(windows, kind="stable")
    out[at[order[1:]]] = windows[order[1:]] == windows[order[:-1]]
    return out


def term_counts(texts: pa.Array) -> Iterator[np.ndarray]:
    """Blocks (documents x TERMS) of term counts, in the order of the texts."""
    for _, data, at in slices(texts, _SLICE, BLOCK):
        starts, ends, per = words(data, at)
        n = np.diff(per)
        size = len(n) * TERMS
        counts = np.zeros(size)
        if len(starts):
            doc = np.repeat(np.arange(len(n)), n)
            h = word_hashes(data, starts, ends)
            terms = (
                (h >> _U(20)) % _U(PARTS[0][0]),
                _STARTS[1] + (_shapes(data, starts, ends) >> _U(20)) % _U(PARTS[1][0]),
                _STARTS[3] + _repeated(h, doc).astype(np.int64),
            )
            for term in terms:
                counts += np.bincount(doc * TERMS + term.astype(np.int64), minlength=size)
        counts = counts.reshape(len(n), TERMS)
        length = np.minimum(2 * np.log2(n + 1), PARTS[2][0] - 1).astype(np.int64)
        counts[np.arange(len(n)), _STARTS[2] + length] += 1
        yield counts.astype(np.float32)


@dataclass(frozen=True)
class Voters:
    """weights: of terms; basis: terms x dimensions; vectors: of the labelled rows, of length one; labels: 0 or 1."""

    weights: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def latent(self, counts: np.ndarray) -> np.ndarray:
        return _unit(weighted(counts, self.weights) @ self.basis)

    def score(self, counts: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
        """The weighted share of label 1 among the k nearest labelled rows of every row."""
        mean = float(self.labels.mean()) if len(self.labels) else 0.5
        if not len(self.labels):
            return np.full(len(counts), mean)
        cosine = self.latent(counts) @ self.vectors.T
        near = nearest(cosine, min(k, len(self.labels)))
        votes = np.maximum(np.take_along_axis(cosine, near, 1).astype(np.float64), 0.0) ** POWER
        total = votes.sum(1)
        return np.clip(np.where(total > 0, (votes * self.labels[near]).sum(1) / np.where(total > 0, total, 1.0), mean), 0.0, 1.0)


def nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """The places of the k largest of each row; of equal ones those that stand first."""
    n = cosine.shape[1]
    near = np.argpartition(cosine, n - k, axis=1)[:, n - k :]
    least = np.take_along_axis(cosine, near, 1).min(1)
    for i in np.flatnonzero((cosine >= least[:, None]).sum(1) > k).tolist():
        more = np.flatnonzero(cosine[i] > least[i])
        near[i] = np.concatenate([more, np.flatnonzero(cosine[i] == least[i])[: k - len(more)]])
    return near


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def weighted(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts) * weights
    for k, (_, share) in enumerate(PARTS):
        part = slice(_STARTS[k], _STARTS[k + 1])
        x[:, part] = share * _unit(x[:, part])
    return x


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """The number of documents, and for each term in how many it occurs; TERMS + 1 rows at most come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(TERMS + 1, dtype=np.int64)
        for batch in batches:
            for counts in term_counts(batch.column(0)):
                found[:TERMS] += (counts > 0).sum(0)
                found[TERMS] += len(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS + 1)), pa.array(found)], names=["term", "n"])

    rows = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(TERMS + 1, dtype=np.int64)
    for r in rows:
        out[r.term] = r.n
    return int(out[TERMS]), out[:TERMS]


def leading_vectors(x: np.ndarray, dimensions: int, rounds: int = 8) -> np.ndarray:
    """The right singular vectors of the largest singular values, by subspace iteration with some spare dimensions."""
    spare = min(dimensions + 8, *x.shape)
    q = np.random.default_rng(7).standard_normal((x.shape[1], spare)).astype(np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    values, turn = np.linalg.eigh(q.T @ (x.T @ (x @ q)))
    return q @ turn[:, np.argsort(-values)[: min(dimensions, spare)]]


def labelled_counts(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Term counts and labels of at most ``most`` label rows (doc_id, label), those of smallest hash; the texts stay where they are."""
    chosen = labels.filter("doc_id is not null and label is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most)
    held = docs.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")  # at most ``most`` ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row.tobytes() for counts in term_counts(batch.column(1)) for row in counts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["doc_id", "counts"])

    counted = held.select("doc_id", "text").mapInArrow(run, "doc_id long, counts binary").groupBy("doc_id").agg(F.min("counts").alias("counts"))
    rows = counted.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "label").select("counts", "label").collect()
    x = np.frombuffer(b"".join(r.counts for r in rows), np.float32).reshape(-1, TERMS)
    return x, np.array([r.label for r in rows], dtype=np.int64)


def fitted(docs: DataFrame, labels: DataFrame, most: int = LABELLED, dimensions: int = DIMENSIONS) -> Voters:
    """Voters from docs (doc_id, text) and label rows (doc_id, label: 0 or 1)."""
    n, df = document_frequencies(docs)
    weights = np.maximum(np.log((1 + n) / (1 + df)), 0.05).astype(np.float32)
    counts, y = labelled_counts(docs, labels, most)
    x = weighted(counts, weights)
    basis = leading_vectors(x, dimensions) if len(x) else np.zeros((TERMS, 1), np.float32)
    return Voters(weights, basis, _unit(x @ basis), y)


def scores(docs: DataFrame, voters: Voters, k: int = NEIGHBOURS) -> DataFrame:
    """(doc_id, score) of every row of docs (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [held.value.score(counts, k) for counts in term_counts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found) if found else np.zeros(0))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def op13_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    labels = table(spark, sf_dir, "labels").filter(~held_out).select("doc_id", F.col("quality").alias("label"))
    found = scores(docs, fitted(docs, labels))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
