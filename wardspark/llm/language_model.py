"""LM scoring by a smoothed trigram model in Elias-Fano tries.

p(w | u v) = (c(u v w) + B (c(v w) + A p(w))) / (c(u v) + B (c(v) + A)), p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)).

The numerator needs counts of n-grams that end in w only, the denominator such
that end in v only, and for each context the probabilities add up to one.  So
tokens are dealt to shards by their word: a shard knows c(w), c(v w) and c(u v w)
of its words, and is also where w acts as the context of the next token.  A
text's log probability is a sum of numerators, found where w is, less a sum of
denominators, found where v is; one shuffle of tokens is enough and no table of
the vocabulary travels.  A shard builds a trie of its training tokens alone: their
words, the words before them and those before these, with numerators,
denominators and word counts at the nodes.  That trie, and nothing else, then scores
all tokens of the shard, held-out ones among them; partial sums meet per document.

Hot words (more than 1 / (4 shards) of all tokens, so at most 4 shards of them)
are spread over all shards by the word before, with c(w) known beforehand; hot
pairs, as few, by the two words before, with c(v w) known too; hot triples are
scored where the text is.  Hence no shard grows with a word or a phrase.

Logs of numerators and denominators are kept in 16 bits (steps of 30 / 65535),
so a token's score is within one step of the exact one.  The words before are
40-bit hashes in the trie: two contexts of one node are taken for the same with
chance 2**-40 for each pair of them (words themselves keep 64 bits).

Defined results: a null, empty or blank text is the single end token; a row
without doc_id trains; with no training text every count is zero; repeated rows
each count and each get a row; very long texts are taken whole; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.llm._elias_fano import Trie
from wardspark.llm._shared import remove, table, written
from wardspark.llm._words import hashed_slice, mix, slices

A, B = 50.0, 0.05
SHARD_TOKENS = 1_000_000
SHARDS_PER_TASK = 4
BEGIN, END = np.uint64(1), np.uint64(2)
#: Log values are kept as 16-bit steps of this range.
LOW, HIGH = -16.0, 14.0
_U = np.uint64
_SLICE, _ROWS = 3 << 20, 1 << 15


def quantised(x: np.ndarray) -> np.ndarray:
    return np.round((np.clip(x, LOW, HIGH) - LOW) * (65535 / (HIGH - LOW))).astype(np.uint16)


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def near(v: np.ndarray) -> np.ndarray:
    """The word before, as the trie holds it."""
    return mix(v) >> _U(64 - Trie.BITS[0])


def far(u: np.ndarray) -> np.ndarray:
    """The word before that."""
    return mix(u ^ _U(0xD6E8FEB86659FD93)) >> _U(64 - Trie.BITS[1])


def pair_keys(w: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Of words and near() of the words before."""
    return mix(w + mix(v))


def triple_keys(pairs: np.ndarray, u: np.ndarray) -> np.ndarray:
    return mix(pairs + mix(u + _U(1)))


def token_slices(batch: pa.RecordBatch) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of runs of documents: ids, whether held out, tokens per document; per token its word, the two before (the nearer first), its document."""
    ids = batch.column(0).to_pylist()
    for first, data, at in slices(batch.column(1), _SLICE, _ROWS):
        docs = len(at) - 1
        h, per = hashed_slice(data, at)
        ended = per[1:] + np.arange(docs)
        w = np.full(len(h) + docs, END, dtype=_U)
        is_word = np.ones(len(w), dtype=bool)
        is_word[ended] = False
        w[is_word] = h | _U(4)  # never BEGIN or END
        v, u = np.empty_like(w), np.empty_like(w)
        v[1:], u[2:] = w[:-1], w[:-2]
        begins = np.concatenate([[0], ended[:-1] + 1])
        v[begins] = u[begins] = BEGIN
        u[begins[begins + 1 < len(w)] + 1] = BEGIN
        u[begins] = BEGIN
        n = np.diff(per) + 1
        mine = ids[first : first + docs]
        yield mine, np.array([held_out(i) for i in mine]), n, w, v, u, np.repeat(np.arange(docs), n)


def _counts(docs: DataFrame, of) -> DataFrame:
    """(key, n): how often each key of ``of(w, v, u)`` occurs in training tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, out, _, w, v, u, doc in token_slices(batch):
                train = ~out[doc]
                keys, n = np.unique(of(w[train], v[train], u[train]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

    return docs.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Corpus:
    """Totals of the training tokens, and the exact counts of hot words, pairs and triples (sorted keys)."""

    tokens: int
    distinct: int
    texts: int
    shards: int
    words: np.ndarray
    word_counts: np.ndarray
    pairs: np.ndarray
    pair_counts: np.ndarray
    triples: np.ndarray
    triple_counts: np.ndarray

    def unigram(self, c: np.ndarray | float) -> np.ndarray:
        return (c + 0.5) / (self.tokens + 0.5 * (self.distinct + 1))

    def numerator(self, c_triple: np.ndarray | float, c_pair: np.ndarray | float, c_word: np.ndarray | float) -> np.ndarray:
        return quantised(np.log10(c_triple + B * (c_pair + A * self.unigram(c_word))))

    @staticmethod
    def denominator(w: np.ndarray, c_pair: np.ndarray, c_word: np.ndarray) -> np.ndarray:
        """Of a word and the one before as a context, in steps; none behind the end."""
        return np.where(w == END, 0, quantised(np.log10(c_pair + B * (c_word + A))).astype(np.int64))


def _sorted(rows: list) -> tuple[np.ndarray, np.ndarray]:
    keys = np.array([r.key for r in rows], dtype=np.int64).view(_U)
    order = np.argsort(keys)
    return keys[order], np.array([r.n for r in rows], dtype=np.int64)[order]


def _at(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The place of each x in sorted keys, or -1."""
    if not len(keys):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[at] == x, at, -1)


def gathered(docs: DataFrame, shard_tokens: int = SHARD_TOKENS) -> Corpus:
    """Counts over all training tokens.  What comes to the driver is bounded: at most 4 hot words, pairs and triples a shard."""
    counts, path = written(_counts(docs, lambda w, v, u: w))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("key") == int(END), F.col("n"))), F.lit(0))).first()
    shards = max(1, math.ceil(total[0] / shard_tokens))
    limit = total[0] / (4 * shards)
    hot_words, word_counts = _sorted(counts.filter(F.col("n") > limit).collect())

    def hot_pairs(w: np.ndarray, v: np.ndarray, u: np.ndarray) -> np.ndarray:
        hot = np.flatnonzero((_at(hot_words, w) >= 0) & ((_at(hot_words, v) >= 0) | (v == BEGIN)))
        return pair_keys(w[hot], near(v[hot]))

    none = _sorted([])
    pairs, pair_counts = _sorted(_counts(docs, hot_pairs).filter(F.col("n") > limit).collect()) if len(hot_words) else none

    def hot_triples(w: np.ndarray, v: np.ndarray, u: np.ndarray) -> np.ndarray:
        some = np.flatnonzero((_at(hot_words, w) >= 0) & ((_at(hot_words, v) >= 0) | (v == BEGIN)))
        keys = pair_keys(w[some], near(v[some]))
        hot = _at(pairs, keys) >= 0
        return triple_keys(keys[hot], far(u[some[hot]]))

    triples, triple_counts = _sorted(_counts(docs, hot_triples).filter(F.col("n") > limit).collect()) if len(pairs) else none
    remove(docs.sparkSession, path)
    return Corpus(total[0], total[1], total[2], shards, hot_words, word_counts, pairs, pair_counts, triples, triple_counts)


_FIELDS = ("key", "doc_id", "held_out", "n_tokens", "n_known", "base", "score")
_KINDS = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.int64())


def _per_doc(n: int, doc: np.ndarray, known: np.ndarray, base: np.ndarray, score: np.ndarray) -> list[np.ndarray]:
    return [np.bincount(doc, known, n).astype(np.int64), np.bincount(doc, base, n), np.bincount(doc, score, n).astype(np.int64)]  # steps are whole numbers below 2**53


def _scattered(docs: DataFrame, corpus: Corpus) -> DataFrame:
    """(shard, base_key, kind, data): the tokens of runs of documents by shard, and one row on the documents themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base_key = TaskContext.get().partitionId() << 36
        for batch in batches:
            for ids, out, n, w, v, u, doc in token_slices(batch):
                rows = []
                v, u = near(v), far(u)
                hot = _at(corpus.words, w)
                pair, triple = np.full(len(w), -1), np.full(len(w), -1)
                maybe = np.flatnonzero(hot >= 0)
                keys = pair_keys(w[maybe], v[maybe])
                pair[maybe] = _at(corpus.pairs, keys)
                deep = np.flatnonzero(pair[maybe] >= 0)
                triple[maybe[deep]] = _at(corpus.triples, triple_keys(keys[deep], u[maybe[deep]]))
                here = np.flatnonzero(triple >= 0)
                c_w, c_pair = corpus.word_counts[hot[here]], corpus.pair_counts[pair[here]]
                score = corpus.numerator(corpus.triple_counts[triple[here]], c_pair, c_w).astype(np.int64) - corpus.denominator(w[here], c_pair, c_w)
                known, base, score = _per_doc(len(ids), doc[here], c_w > 0, np.log10(c_w + 0.5), score)
                about = pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip((base_key + np.arange(len(ids)), ids, out, n, known, base, score), _KINDS)], names=list(_FIELDS)
                )
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, about.schema) as stream:
                    stream.write_batch(about)
                rows.append(((base_key >> 15) % corpus.shards, base_key, 1, sink.getvalue().to_pybytes()))

                rest = np.flatnonzero(triple < 0)
                w, v, u, doc, hot, pair = (x[rest] for x in (w, v, u, doc, hot, pair))
                by = np.where(hot >= 0, pair_keys(w, v), w)
                by = np.where(pair >= 0, triple_keys(by, u), by)
                shard = (mix(by >> _U(3)) % _U(corpus.shards)).astype(np.int64)
                order = np.lexsort((v, w, shard))  # equal contexts side by side, which compresses
                w, v, u, shard, doc = w[order], v[order], u[order], shard[order], doc[order].astype(np.uint16)
                doc |= out[doc].astype(np.uint16) << np.uint16(15)
                cuts = np.flatnonzero(np.diff(shard, prepend=-1))
                for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(w)]):
                    # Runs of one word; a new one begins at 65,535 tokens at the latest.
                    fresh = np.concatenate([[True], w[a + 1 : b] != w[a : b - 1]])
                    place = np.arange(b - a) - np.maximum.accumulate(np.where(fresh, np.arange(b - a), 0))
                    first = np.flatnonzero(place % 65_535 == 0)
                    sizes = np.diff(np.append(first, b - a)).astype("<u2")
                    part = [np.array([b - a, len(first)], "<u4").tobytes(), w[a:b][first].tobytes(), sizes.tobytes(), _packed(v[a:b]), _packed(u[a:b]), doc[a:b].tobytes()]
                    rows.append((int(shard[a]), base_key, 0, b"".join(part)))
                columns = zip(*rows)
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["shard", "base_key", "kind", "data"])
                base_key += _ROWS

    return docs.mapInArrow(run, "shard long, base_key long, kind int, data binary")


def _packed(x: np.ndarray) -> bytes:
    """Numbers of 40 bits in five bytes each: the lower four of all, then the upper ones."""
    return x.astype("<u4").tobytes() + (x >> _U(32)).astype(np.uint8).tobytes()


def _five(data: bytes, n: int, at: int) -> np.ndarray:
    return np.frombuffer(data, "<u4", n, at).astype(_U) | (np.frombuffer(data, np.uint8, n, at + 4 * n).astype(_U) << _U(32))


def _read(data: bytes, base_key: int) -> tuple[np.ndarray, ...]:
    """Word, the two before, document key and whether it trains, of every token of a part."""
    n, distinct = np.frombuffer(data, "<u4", 2).tolist()
    at = 8
    w = np.frombuffer(data, "<u8", distinct, at)
    sizes = np.frombuffer(data, "<u2", distinct, at := at + 8 * distinct)
    v = _five(data, n, at := at + 2 * distinct)
    u = _five(data, n, at := at + 5 * n)
    doc = np.frombuffer(data, "<u2", n, at + 5 * n)
    return np.repeat(w, sizes), v, u, base_key + (doc & 0x7FFF).astype(np.int64), doc < 0x8000


def _grouped(w: np.ndarray, v: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of tokens in order: where a new word, pair and triple begins."""
    new_word = np.concatenate([[True], w[1:] != w[:-1]])
    new_pair = new_word | np.concatenate([[True], v[1:] != v[:-1]])
    return new_word, new_pair, new_pair | np.concatenate([[True], u[1:] != u[:-1]])


def built(w: np.ndarray, v: np.ndarray, u: np.ndarray, train: np.ndarray, corpus: Corpus) -> Trie:
    """The trie of the training tokens of a shard; tokens come in order of word and context.

    Of hot words and pairs a shard holds a part of the tokens only; their counts
    are known.  Beside the numerators of the nodes stand the counts of words and, of
    words and pairs, the denominators that they make as contexts.
    """
    new_word, new_pair, new_triple = _grouped(w, v, u)
    word, pair, triple = (np.flatnonzero(x) for x in (new_word, new_pair, new_triple))
    word_of_pair, pair_of_triple = (np.cumsum(new_word, dtype=np.int32) - 1)[pair], (np.cumsum(new_pair, dtype=np.int32) - 1)[triple]
    before = np.concatenate([[0], np.cumsum(train, dtype=np.int64)])
    c_word, c_pair, c_triple = (np.diff(np.append(before[x], before[-1])) for x in (word, pair, triple))
    hot = _at(corpus.words, w[word])
    c_word[hot >= 0] = corpus.word_counts[hot[hot >= 0]]
    hot = _at(corpus.pairs, pair_keys(w[pair], v[pair]))
    c_pair[hot >= 0] = corpus.pair_counts[hot[hot >= 0]]

    # What no training token has is no node.
    seen = [np.flatnonzero(c > 0) for c in (c_word, c_pair, c_triple)]
    place = [np.cumsum(c > 0) - 1 for c in (c_word, c_pair)]
    of_pair, of_triple = word_of_pair[seen[1]], pair_of_triple[seen[2]]
    levels = [
        (place[0][of_pair], v[pair[seen[1]]], corpus.numerator(0.0, c_pair[seen[1]], c_word[of_pair])),
        (place[1][of_triple], u[triple[seen[2]]], corpus.numerator(c_triple[seen[2]], c_pair[of_triple], c_word[word_of_pair[of_triple]])),
    ]
    keys, c_word_seen = w[word[seen[0]]], c_word[seen[0]]
    contexts = [corpus.denominator(keys, np.zeros(len(keys)), c_word_seen), corpus.denominator(w[pair[seen[1]]], c_pair[seen[1]], c_word[of_pair])]
    return Trie(keys, corpus.numerator(0.0, 0.0, c_word_seen), levels, [c_word_seen, *(x.astype(np.uint16) for x in contexts)])


def _scored(parts: list[tuple[bytes, int]], corpus: Corpus) -> pa.RecordBatch:
    """Partial sums over the tokens of one shard, one row for each run of documents: a trie from its training tokens, which then scores all, held-out ones among them."""
    w, v, u, key, train = (np.concatenate(x) for x in zip(*(_read(*p) for p in parts)))
    order = np.lexsort((u, v, w))
    w, v, u, key, train = w[order], v[order], u[order], key[order], train[order]
    del order
    trie = built(w, v, u, train, corpus)

    new_triple = _grouped(w, v, u)[2]
    of_triple = (np.cumsum(new_triple) - 1).astype(np.int32)
    w, v, u = w[new_triple], v[new_triple], u[new_triple]
    counts, word_contexts, pair_contexts = trie.more
    at_word, at_pair, at_triple = trie.find(w, [v, u])
    numerator = np.full(len(w), int(corpus.numerator(0.0, 0.0, 0.0)), dtype=np.int64)
    denominator = corpus.denominator(w, np.zeros(len(w)), np.zeros(len(w)))
    c_word = np.zeros(len(w), dtype=np.int64)
    for at, values in zip((at_word, at_pair, at_triple), trie.values):
        numerator[at >= 0] = values[at[at >= 0]]
    for at, values in ((at_word, word_contexts), (at_pair, pair_contexts)):
        denominator[at >= 0] = values[at[at >= 0]]
    c_word[at_word >= 0] = counts[at_word[at_word >= 0]]
    trie.close()
    del at_word, at_pair, at_triple, w, v, u, train

    score, c_word = (numerator - denominator)[of_triple], c_word[of_triple]
    keys, doc = np.unique(key, return_inverse=True)
    n_known, base, score = _per_doc(len(keys), doc, c_word > 0, np.log10(c_word + 0.5), score)
    cuts = np.flatnonzero(np.diff(keys // _ROWS, prepend=-1))
    rows = []
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)]):
        # A text has few tokens in a shard, as a rule: one byte, five (in units of 2**-30) and four then do for its count, its base and its steps.
        short = n_known[a:b].max() < 1 << 8 and np.abs(score[a:b]).max() < 1 << 31 and np.abs(base[a:b]).max() < 500
        kinds = ("<u1", "<i4") if short else ("<u4", "<i8")
        held = _packed((np.round(base[a:b] * 2**30) + 2**39).astype(_U)) if short else base[a:b].tobytes()
        part = [(keys[a:b] % _ROWS).astype("<u2").tobytes(), n_known[a:b].astype(kinds[0]).tobytes(), held, score[a:b].astype(kinds[1]).tobytes()]
        rows.append((int(keys[a]) // _ROWS * _ROWS, 0, (b"s" if short else b"l") + b"".join(part)))
    return _rows(rows)


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["base_key", "kind", "data"])


def _summed(parts: list[tuple[int, bytes]]) -> pa.RecordBatch:
    """The documents of one run, with the partial sums of all shards added."""
    about = next(pa.ipc.open_stream(data).read_next_batch() for kind, data in parts if kind)
    known, base, score = (about.column(_FIELDS.index(c)).to_numpy().copy() for c in ("n_known", "base", "score"))
    for kind, data in parts:
        if not kind:
            short = data[:1] == b"s"
            n = len(data) // (12 if short else 22)
            at = np.frombuffer(data, "<u2", n, 1)
            known[at] += np.frombuffer(data, "<u1" if short else "<u4", n, 1 + 2 * n)
            base[at] += (_five(data, n, 1 + 3 * n).astype(np.float64) - 2**39) / 2**30 if short else np.frombuffer(data, "<f8", n, 1 + 6 * n)
            score[at] += np.frombuffer(data, "<i4" if short else "<i8", n, 1 + (8 if short else 14) * n)
    columns = [about.column(i) for i in range(1, 4)]
    # The lower end of the range cancels in numerators over denominators; the end token, one a text, has a numerator only.
    total = LOW + score * ((HIGH - LOW) / 65535)
    return pa.RecordBatch.from_arrays([*columns, pa.array(known), pa.array(base), pa.array(total)], names=list(_FIELDS[1:]))


def scores(docs: DataFrame, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    corpus = gathered(docs, shard_tokens)

    def score_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts = None, []
        for batch in batches:
            for shard, base_key, kind, data in zip(*(c.to_pylist() for c in batch.columns)):
                if kind:
                    yield _rows([(base_key, 1, data)])
                    continue
                if shard != current:
                    if parts:
                        yield _scored(parts, corpus)
                    current, parts = shard, []
                parts.append((data, base_key))
        if parts:
            yield _scored(parts, corpus)

    def sum_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts = None, []
        for batch in batches:
            for base_key, kind, data in zip(*(c.to_pylist() for c in batch.columns)):
                if base_key != current:
                    if parts:
                        yield _summed(parts)
                    current, parts = base_key, []
                parts.append((kind, data))
        if parts:
            yield _summed(parts)

    tasks = max(1, math.ceil(corpus.shards / SHARDS_PER_TASK))
    dealt = _scattered(docs, corpus).repartition(tasks, "shard").sortWithinPartitions("shard")
    partial = dealt.mapInArrow(score_shards, "base_key long, kind int, data binary").repartition(tasks, "base_key").sortWithinPartitions("base_key")
    sums = partial.mapInArrow(sum_runs, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    return sums.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(corpus.tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(math.log10(corpus.tokens + 0.5 * (corpus.distinct + 1)))).alias("base_score"),
        (F.col("score") - F.lit(math.log10(corpus.texts + B * (corpus.texts + A)))).alias("score"),
    )


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
