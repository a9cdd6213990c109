"""Byte-level BPE encoding and decoding, and token counts from an exact length histogram.

Encoding runs inside ``mapInArrow`` with no shuffle.  The vocabulary file is
read by each Python worker; its path is a parameter.

Defined results: a null or empty text has no tokens and decodes to no bytes; a
very long text is encoded whole (its pre-tokens merge through a heap when they
are long); repeated rows are encoded each by itself; null ids are carried; an
empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardspark.llm._bpe import encoder
from wardspark.llm._shared import cut, table


def rank_file() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=4)
def _vocabulary(path: str) -> tuple[list[bytes], list[bytes], np.ndarray]:
    """The bytes, the decimal form and the length of every id."""
    ranks = encoder(path).ranks
    of = [b""] * (max(ranks.values()) + 1)
    for piece, i in ranks.items():
        of[i] = piece
    return of, [str(i).encode() for i in range(len(of))], np.array(list(map(len, of)), dtype=np.int64)


def encode_documents(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids array<int>, starts array<int>): token ids and the byte where each pre-token begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            done = list(enc.encode(batch.column(1)))
            ids = pa.array([np.frombuffer(x.ids, "<i4") for x in done], pa.list_(pa.int32()))
            starts = pa.array([x.starts.astype(np.int32) for x in done], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, starts], names=["id", "ids", "starts"])

    picked = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").alias("text"))
    return picked.mapInArrow(run, "id long, ids array<int>, starts array<int>")


def decoded(ids: np.ndarray, starts: np.ndarray, of: list[bytes], lengths: np.ndarray, first: int = 0, last: int | None = None) -> bytes:
    """The bytes of the pre-tokens first .. last - 1 (all by default): the offsets say at which ids these begin and end.

    ValueError if an offset is not where a token begins, so ids and offsets that do not belong together are refused.
    """
    ends = np.cumsum(lengths[ids])
    begins = ends - lengths[ids]
    at = np.searchsorted(begins, starts)
    if len(starts) and ((at >= len(ids)).any() or (begins[np.minimum(at, len(ids) - 1)] != starts).any()):
        raise ValueError("offsets do not fit the ids")
    cuts = np.append(at, len(ids))
    last = len(starts) if last is None else min(last, len(starts))
    return b"".join(map(of.__getitem__, ids[cuts[min(first, last)] : cuts[last]].tolist())) if len(starts) else b""


def decode_documents(encoded: DataFrame, path: str, first: int = 0, last: int | None = None) -> DataFrame:
    """(id, data binary) of (id, ids, starts): whole texts, or the pre-tokens first .. last - 1 of each, found by the offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, _, lengths = _vocabulary(path)
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in (1, 2)))
            data = [decoded(np.array(ids or (), dtype=np.int64), np.array(starts or (), dtype=np.int64), of, lengths, first, last) for ids, starts in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["id", "data"])

    return encoded.select("id", "ids", "starts").mapInArrow(run, "id long, data binary")


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """Encodes, decodes the ids by the retained offsets, and returns counts and digests of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        of, decimal, lengths = _vocabulary(path)
        for batch in batches:
            n, pre, shown, back = [], [], [], []
            for x in enc.encode(batch.column(1)):
                ids = np.frombuffer(x.ids, "<u4")
                n.append(len(ids))
                pre.append(len(x.starts))
                shown.append(hashlib.sha256(b" ".join(map(decimal.__getitem__, ids.tolist()))).hexdigest())
                back.append(hashlib.sha256(decoded(ids, x.starts, of, lengths)).hexdigest())
            columns = [pa.array(n, pa.int64()), pa.array(pre, pa.int64()), pa.array(shown, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_tokens", "n_pretokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_pretokens long, ids_sha256 string, decoded_sha256 string")


def token_lengths(docs: DataFrame, path: str, text_column: str = "text") -> DataFrame:
    """(n_tokens) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            n = [len(x.ids) // 4 for x in enc.encode(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], names=["n_tokens"])

    return docs.select(F.col(f"`{text_column}`").alias("text")).mapInArrow(run, "n_tokens long")


def length_histogram(lengths: DataFrame, block: int = 1024) -> DataFrame:
    """One row for every encoded length that occurs, with what a context limit of that length keeps.

    docs_at_least and tokens_at_least are suffix sums over the lengths; docs and
    tokens shorter follow from the totals.  truncated_tokens is the number of
    tokens left when every document is cut to n_tokens.  Sums run inside blocks
    of lengths first and then over the blocks, so no task gets all lengths.
    The counts are written once, since two branches read them and would encode twice.
    """
    counts = cut(lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")).withColumn("block", F.floor(F.col("n_tokens") / block)))
    tokens = F.col("n_docs") * F.col("n_tokens")
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum(tokens).alias("tokens"))
    later, whole = Window.orderBy(F.col("block").desc()), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        (F.sum("docs").over(later) - F.col("docs")).alias("docs_later"),
        (F.sum("tokens").over(later) - F.col("tokens")).alias("tokens_later"),
        F.sum("docs").over(whole).alias("total_docs"),
        F.sum("tokens").over(whole).alias("total_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc())
    return (
        counts.withColumns({"docs_in": F.sum("n_docs").over(inside), "tokens_in": F.sum(tokens).over(inside)})
        .join(blocks, "block")
        .select(
            "n_tokens",
            "n_docs",
            (F.col("docs_in") + F.col("docs_later")).alias("docs_at_least"),
            (F.col("tokens_in") + F.col("tokens_later")).alias("tokens_at_least"),
            "total_docs",
            "total_tokens",
        )
        .withColumn("truncated_tokens", F.col("total_tokens") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("n_tokens"))
    )


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """One row: the tokens left when every document is cut to ``limit``, for any limit."""
    longer = F.col("n_tokens") > limit
    at = F.min(F.when(longer, F.struct("n_tokens", "docs_at_least", "tokens_at_least")))
    kept = F.max("total_tokens") - F.coalesce(at.tokens_at_least, F.lit(0)) + limit * F.coalesce(at.docs_at_least, F.lit(0))
    return histogram.agg(F.coalesce(kept, F.lit(0)).alias("truncated_tokens"))


def quantile(histogram: DataFrame, q: float) -> DataFrame:
    """One row: the smallest length that at least a share q of the documents does not exceed."""
    at_most: Column = F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")
    return histogram.agg(F.min(F.when(at_most >= q * F.col("total_docs"), F.col("n_tokens"))).alias("n_tokens"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"), rank_file())


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(token_lengths(table(spark, sf_dir, "documents"), rank_file()))
