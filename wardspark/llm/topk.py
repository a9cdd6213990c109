"""Exact top-k search by term-at-a-time accumulation.

Vectors become sparse rows of integer weights.  Rows are dealt into blocks of
about ``ROW_BLOCK`` and queries into groups of about ``QUERY_GROUP``; a task
holds one block and the queries of one group stream past it, so memory is
bounded by the block and work by block times group.  Each term of the queries is
taken in turn: its postings in the block (places and weights) are scattered,
weighted, into the dense score array of the block.  The best of a block come
from a partition selection, and blocks merge by one more top-k per query.  N rows
and Q queries travel Q / QUERY_GROUP and N / ROW_BLOCK times.  All scores are
integers, so the result does not depend on blocks or order.

Defined results: a vector that is null, empty of finite values, or holds a null
or a non-finite component takes no part; missing trailing components count as
zero; rows of the query's own id are not its candidates, and equal (id, vector)
rows count once; a null id takes no part; fewer candidates than k give fewer
ranks; an empty table gives no rows; other columns are not read.  Scaled
components and scores that no long can hold stop at its ends, and ranks go by
these.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardspark.llm._shared import cut, table

ROW_BLOCK = 8192
QUERY_GROUP = 16384
#: Queries that are scored against a block at once.
AT_ONCE = 32


def integer_vectors(rows: DataFrame, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id, weights array<long>) with floor(scale * x) of every component, x as double."""
    v: Column = F.col(f"`{vector_column}`")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(v, lambda x: F.floor(x.cast("double") * scale))
    return rows.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.when(whole, scaled).alias("weights")).filter("id is not null and weights is not null").distinct()


def _matrix(weights: pa.ListArray) -> np.ndarray:
    """The weights with zeros for what is missing."""
    flat = weights.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    per = np.diff(weights.offsets.to_numpy())
    out = np.zeros((len(weights), int(per.max(initial=0))), dtype=np.int64)
    out[np.arange(out.shape[1])[None, :] < per[:, None]] = flat
    return out


def accumulate(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Scores (queries x rows), one term after the other; where 64 bits could overflow in Python integers, which then stop at the ends of a long."""
    terms = min(queries.shape[1], rows.shape[1])
    most = terms * float(np.abs(queries.astype(float)).max(initial=0)) * float(np.abs(rows.astype(float)).max(initial=0))
    if most >= 2**62:
        queries, rows = queries.astype(object), rows.astype(object)
    scores = np.zeros((len(queries), len(rows)), dtype=queries.dtype)
    for term in range(terms):
        places = np.flatnonzero(rows[:, term])
        asked = np.flatnonzero(queries[:, term])
        if len(places) and len(asked):
            weighted = queries[asked, term][:, None] * rows[places, term][None, :]
            if len(places) == len(rows) and len(asked) == len(queries):
                scores += weighted
            else:
                scores[np.ix_(asked, places)] += weighted
    return np.clip(scores, -(2**63), 2**63 - 1).astype(np.int64) if scores.dtype == object else scores


def selected(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """The places of the k best of other ids (ids ascend, so ties go to the smaller one)."""
    open_ = np.flatnonzero(ids != own)
    if len(open_) > k:
        best = scores[open_]
        limit = np.partition(best, len(best) - k)[len(best) - k]
        sure, tied = open_[best > limit], open_[best == limit]
        open_ = np.concatenate([sure, tied[: k - len(sure)]])
    return open_


def top_k(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for every query; ties go to the smaller id.  Both have id and weights."""
    rows, queries = cut(rows), cut(queries)
    blocks, groups = max(1, math.ceil(rows.count() / ROW_BLOCK)), max(1, math.ceil(queries.count() / QUERY_GROUP))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = rows.select(F.pmod(F.xxhash64("id", "weights"), F.lit(blocks)).cast("int").alias("block"), every(groups).alias("group"), F.lit(0).alias("kind"), "id", "weights")
    asked = queries.select(every(blocks).alias("block"), F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("group"), F.lit(1).alias("kind"), "id", "weights")
    # More partitions than tasks with rows, so that few blocks share one by their hash.
    dealt = held.union(asked).repartition(4 * blocks * groups, "block", "group").sortWithinPartitions("block", "group", "kind", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, ids, parts, block = None, [], [], None
        for batch in batches:
            at = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
            cuts = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]).any(1), [True]]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if (at[a, 0], at[a, 1]) != place:
                    place, ids, parts, block = (at[a, 0], at[a, 1]), [], [], None
                mine, weights = batch.column(3)[a:b].to_numpy(zero_copy_only=False), _matrix(batch.column(4).slice(a, b - a))
                if at[a, 2] == 0:
                    ids.append(mine)
                    parts.append(weights)
                    continue
                if block is None and parts:
                    block = np.zeros((sum(map(len, parts)), max(p.shape[1] for p in parts)), dtype=np.int64)
                    first = 0
                    for p in parts:
                        block[first : first + len(p), : p.shape[1]] = p
                        first += len(p)
                    ids, parts = [np.concatenate(ids)], []
                if block is None:
                    continue
                out = []
                for q in range(0, len(mine), AT_ONCE):
                    for own, score in zip(mine[q : q + AT_ONCE].tolist(), accumulate(weights[q : q + AT_ONCE], block)):
                        out += [(own, ids[0][j], score[j]) for j in selected(score, ids[0], own, k)]
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(3)], names=["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.filter(F.col("id") % 50 == 0), 5)


SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256e0)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
), s AS (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id, CAST(list_dot_product(q.w, r.w) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id
), o AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM o WHERE rank <= 5
"""
