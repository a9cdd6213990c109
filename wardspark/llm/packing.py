"""Best-fit packing of tokenised documents into sequences under several capacities.

A sequence has capacities for tokens, documents and attention cost (the sum of
squared piece lengths).  Pieces go, longest first, to the sequence that they
fit under every constraint and that is left with the smallest weighted residual
norm.  The pieces are dealt at random into groups of about GROUP_PIECES; each
group is packed in one task, so a group costs at most one badly filled sequence
of some thousands.

Defined results: a null or empty text is one piece of the single token 0; a
text longer than a sequence is cut so that only its first piece may be short;
repeated rows are packed each by itself; an empty table gives no rows; other
columns of the input are not read.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.llm._bpe import read_ranks
from wardspark.llm._shared import cut, table

SEQUENCE_TOKENS = 2048
END = 0
GROUP_PIECES = 16384
#: The end-of-text string and its id in the vocabulary (fixed values).
SPECIAL = {"<|endoftext|>": 50256}
_held: dict[str, tiktoken.Encoding] = {}


def tokenizer(path: str) -> tiktoken.Encoding:
    """The ranks hold the same vocabulary as the JSON file of the tokenizers library and give the same ids several times faster."""
    if path not in _held:
        _held[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens=SPECIAL)
    return _held[path]


def token_ids(enc: tiktoken.Encoding, text: str | None) -> array:
    """Unsigned 32-bit ids of a whole text, then END."""
    text = text or ""
    special = any(s in text for s in SPECIAL)
    ids = array("I", enc.encode(text, allowed_special="all") if special else enc.encode_ordinary(text))
    ids.append(END)
    return ids


def pieces_of(docs: DataFrame, path: str, limit: int = SEQUENCE_TOKENS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizer(path)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = token_ids(enc, text.as_py())
                first = (len(ids) - 1) % limit + 1
                for k, end in enumerate(range(first, len(ids) + 1, limit)):
                    start = max(0, end - limit) if k else 0
                    out.append((doc, k, start, end - start, zlib.crc32(ids[start:end].tobytes())))
            columns = list(zip(*out)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, tokens: int, documents: int, attention: int, weights: tuple[float, float, float] = (1.0, 1e-6, 1e-6)) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece.  Pieces go longest first to the open bin of the least residual norm after they are put there."""
    order = np.argsort(-lengths, kind="stable")
    capacity = np.array([tokens, documents, attention], dtype=np.int64)
    scale = np.sqrt(np.array(weights)) / capacity
    left = np.zeros((3, 256), dtype=np.int64)  # of open bins, one column each
    names = np.zeros(256, dtype=np.int64)
    n_open = n_bins = 0
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    shortest, longest = (int(lengths.min()), int(lengths.max())) if len(lengths) else (0, 0)
    if longest > tokens or longest * longest > attention or documents < 1:
        raise ValueError(f"a piece of {longest} tokens fits no sequence")
    for k in order.tolist():
        size = int(lengths[k])
        need = (size, 1, size * size)
        now = left[:, :n_open]
        fits = np.flatnonzero((now[0] >= need[0]) & (now[1] >= need[1]) & (now[2] >= need[2]))
        if len(fits):
            rest = [(now[d, fits] - need[d]) * scale[d] for d in range(3)]
            at = int(fits[np.argmin(rest[0] * rest[0] + rest[1] * rest[1] + rest[2] * rest[2])])
        else:
            if n_open == left.shape[1]:
                left, names = np.concatenate([left, np.zeros_like(left)], 1), np.concatenate([names, np.zeros_like(names)])
            at, n_open = n_open, n_open + 1
            left[:, at], names[at] = capacity, n_bins
            n_bins += 1
        bins[k], offsets[k] = names[at], tokens - left[0, at]
        left[:, at] -= need
        if left[0, at] < shortest or left[1, at] < 1 or left[2, at] < shortest * shortest:  # closed: the last one takes its place
            n_open -= 1
            left[:, at], names[at] = left[:, n_open], names[n_open]
    return bins, offsets


def packed(
    pieces: DataFrame, tokens: int = SEQUENCE_TOKENS, documents: int | None = None, attention: int | None = None, group_pieces: int = GROUP_PIECES, weights: tuple[float, float, float] = (1.0, 1e-6, 1e-6)
) -> DataFrame:
    """pieces (with a column length) with sequence_id and offset.

    Without limits of their own, documents and attention get the largest values
    that the token capacity allows, so that they never bind and the fewest
    sequences result; weights are those of the three residuals in the norm.  A
    single piece must fit an empty sequence under every limit: else ValueError.
    """
    documents, attention = documents or tokens, attention or tokens * tokens
    held = cut(pieces.withColumn("_row", F.monotonically_increasing_id()))  # written once: the numbers then stay the same
    groups = max(1, math.ceil(held.count() / group_pieces))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_row")
        bins, offsets = best_fit(group["length"].to_numpy(), tokens, documents, attention, weights)
        return group.drop(columns="_row").assign(sequence_id=(group["_group"].to_numpy() << 32) + bins, offset=offsets).drop(columns="_group")

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return held.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups))).groupBy("_group").applyInPandas(pack, schema)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(pieces_of(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken")))
