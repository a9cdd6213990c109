"""MinHash near-dedup with bottom-k sketches of one hash function.

1. Each text becomes its set of word-shingle hashes; equal sets form a class,
   and only classes go on, so exact copies cost one row each.
2. The sketch of a class is the ``SKETCH`` least hashes of its set.  Two sets of
   Jaccard similarity t share each of the least values of their union with
   chance t, so they share at least ``needed`` of them but for a chance below
   1e-9.  By the prefix principle it is then enough to put the rarest
   SKETCH - needed + 1 retained values of every class into the inverted lists;
   values that thousands of unlike documents share stay out of them.
3. The least class of a list is its pivot, and the lists of one pivot form a
   family.  First pass: every class goes to the one family with which it shares
   most values, families are dealt into chunks of bounded size, each chunk with
   the pivot.  Second pass: of the families that then still hold several
   components, sketches alone (not texts) meet block by block; a pair counts in
   the family of its least common pivot only, and only across components.  The
   texts of classes that may still be linked are compared in those blocks.
4. A comparison is: overlap of the sketches from the inverted lists of the
   block, estimate from the union sketch, exact Jaccard on the full sets; pairs
   that are already connected are left out.  Only a spanning forest leaves a task.
5. Links run through connected components.

No list, family or group is capped.  A block is bounded in classes and in
shingles (one longer text is a block of its own beside its partner); the links
that leave a task are fewer than its classes.  Families of n classes that stay
apart although their sketches are close cost n * n / CHUNK sketches of travel.

Shingles are 64-bit hashes: "equal sets" and "full sets" are exact but for
a chance of about 2**-64 for each two different shingles that are compared.

Defined results: a text without words (null, empty, blank) has an empty set and
is linked with nothing; a text of fewer words than a shingle is one shingle; a
row without doc_id gets no component and is kept; rows that share a doc_id
share a node; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.llm._components import components
from wardspark.llm._shared import cut, join_few, join_spread, table
from wardspark.llm._words import shingle_sets

SKETCH = 32
ESTIMATE = 128
#: A chunk holds about so many classes and, where texts travel, about so many shingles.
CHUNK = 512
CHUNK_SHINGLES = 1 << 20


@functools.cache
def needed(percent: int, size: int = SKETCH, chance: float = 1e-9) -> int:
    """The largest c so that fewer than c of ``size`` union values are shared with at most ``chance``."""
    t, c, total = percent / 100, 0, 0.0
    while True:
        total += math.comb(size, c) * t**c * (1 - t) ** (size - c)
        if total > chance:
            return max(1, c)
        c += 1


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, digest, sketch) of every row; the sketch is the least SKETCH hashes as signed longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, least = [], [], []
            for s in shingle_sets(batch.column(1), width):
                n.append(len(s))
                digests.append(_digest(s) if len(s) else None)
                least.append(s[:SKETCH].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(least, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, sketch array<long>")


def inverted_lists(classes: DataFrame, percent: int) -> DataFrame:
    """(value, node, n_shingles) of the retained values by which two alike classes must meet."""
    posts = classes.select("node", "n_shingles", F.size("sketch").alias("k"), F.explode("sketch").alias("value"))
    shared = cut(posts.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"))
    least = needed(percent)
    # A set whose partners' unions fit a sketch must share percent of its own size.
    must = F.when(100 * F.col("n_shingles") <= percent * SKETCH, F.ceil(F.col("n_shingles") * percent / 100)).otherwise(least).cast("int")
    rarest = F.sort_array(F.collect_list(F.struct("df", "value")))
    per = join_spread(posts, shared, "value", "df", "df").filter("df is not null").groupBy("node", "n_shingles", "k").agg(rarest.alias("common"))
    # Values of no other class are the rarest of all and come first.
    take = F.greatest(F.lit(0), F.col("k") - must + 1 - (F.col("k") - F.size("common"))).cast("int")
    return per.select("node", "n_shingles", F.explode(F.slice("common", F.lit(1), take)).alias("c")).select("c.value", "node", "n_shingles")


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether the full sets reach the limit, after the union-sketch estimate."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    if len(a) > 2 * ESTIMATE:
        x, y = a[:ESTIMATE], b[:ESTIMATE]
        union = np.union1d(x, y)[:ESTIMATE]
        both = np.count_nonzero(np.isin(union, x, assume_unique=True) & np.isin(union, y, assume_unique=True))
        if both < needed(percent, len(union)):
            return False
    joined = np.sort(np.concatenate([a, b]), kind="stable")
    shared = int(np.count_nonzero(joined[1:] == joined[:-1]))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _incidence(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """(member, column) of the values that several members hold, and the number of columns."""
    flat = np.concatenate([np.zeros(0, np.uint64), *sets])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, times = np.unique(flat, return_inverse=True, return_counts=True)
    some = times[at] > 1
    return owner[some], (np.cumsum(times > 1) - 1)[at[some]], int((times > 1).sum())


def _overlaps(sets: list[np.ndarray], step: int = 1 << 13) -> np.ndarray:
    """How many values each two sets share, from their inverted lists; counts below 2**24 are exact in float32."""
    owner, column, n = _incidence(sets)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    cuts = np.searchsorted(column, np.arange(0, n + step, step))
    for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
        held = np.zeros((len(sets), min(step, n - k * step)), dtype=np.float32)
        held[owner[a:b], column[a:b] - k * step] = 1
        out += held @ held.T
    return out


def _close(sketch: list[np.ndarray], sizes: np.ndarray, component: np.ndarray, side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether the sketches of each two members of different components and sides allow a link (upper triangle), and their overlaps."""
    overlap = _overlaps(sketch)
    must = np.where(100 * sizes <= percent * SKETCH, -(-sizes * percent // 100), needed(percent))
    fits = (overlap >= np.maximum(must[:, None], must[None, :])) & (sizes[:, None] * 100 >= percent * sizes[None, :]) & (sizes[None, :] * 100 >= percent * sizes[:, None])
    fits &= (component[:, None] != component[None, :]) & ((side[:, None] != side[None, :]) | (side[:, None] < 0))
    return np.triu(fits, 1), overlap


def _forest(sets: list[np.ndarray], component: np.ndarray, side: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """(component, least component) of what all alike pairs of different sides connect; a side of -1 meets every other."""
    sizes = np.array([len(s) for s in sets])
    fits, overlap = _close([s[:SKETCH] for s in sets], sizes, component, side, percent)
    x, y = np.nonzero(fits)
    order = np.argsort(-overlap[x, y], kind="stable")
    x, y = x[order], y[order]
    labels, root = np.unique(component, return_inverse=True)  # sorted, so the root of the least number has the least component
    parent = np.arange(len(labels))

    def find(i: int) -> int:
        while (p := int(parent[i])) != i:
            parent[i] = i = int(parent[p])
        return i

    def join(pairs, alike) -> None:
        for a, b in pairs:
            p, q = find(int(root[a])), find(int(root[b]))
            if p != q and alike(a, b):
                parent[max(p, q)] = min(p, q)

    def exact(a: int, b: int) -> bool:
        return _alike(sets[a], sets[b], percent)

    # The best partner of each member first: in a cluster this leaves little to compare.
    _, first = np.unique(x, return_index=True)
    join(zip(x[first].tolist(), y[first].tolist()), exact)
    roots = np.array([find(i) for i in range(len(parent))])[root]
    still = roots[x] != roots[y]
    x, y = x[still], y[still]
    if len(x):
        # All pairs at once by matrix products, or one by one: the same result, whichever is less work.
        used = np.unique(np.concatenate([x, y]))
        some = [sets[i] for i in used]
        if len(used) ** 2 * _incidence(some)[2] * 1e-10 < (2e-5 + 4e-8 * float((sizes[x] + sizes[y]).mean())) * len(x):
            shared = _overlaps(some)[np.searchsorted(used, x), np.searchsorted(used, y)].astype(np.int64)
            linked = 100 * shared >= percent * (sizes[x] + sizes[y] - shared)
            join(zip(x[linked].tolist(), y[linked].tolist()), lambda a, b: True)
        else:
            join(zip(x.tolist(), y.tolist()), exact)
    for i in range(len(parent)):
        if find(i) != i:
            yield int(labels[i]), int(labels[find(i)])


def _grouped(batches: Iterator[pa.RecordBatch], read) -> Iterator[tuple[str, list[list]]]:
    """Each chunk with the columns of its rows; the first column is the chunk, read(batch) gives those behind it."""
    current, rows = None, []
    for batch in batches:
        for chunk, *row in zip(batch.column(0).to_pylist(), *read(batch)):
            if chunk != current:
                if rows:
                    yield current, list(map(list, zip(*rows)))
                current, rows = chunk, []
            rows.append(row)
    if rows:
        yield current, list(map(list, zip(*rows)))


def _dealt(chunks: DataFrame) -> DataFrame:
    return chunks.repartition(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chunk").sortWithinPartitions("chunk")


def _linked(chunks: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): components that a link inside a chunk connects.  chunks: chunk, node, digest, component, side, text."""

    def read(batch: pa.RecordBatch) -> tuple:
        return (*(batch.column(i).to_pylist() for i in range(1, 5)), shingle_sets(batch.column(5), width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (node, digest, component, side, sets) in _grouped(batches, read):
            # Of rows that share a doc_id only the text of the class counts.
            own = {(node[k], digest[k]): k for k in range(len(node)) if _digest(sets[k]) == digest[k]}
            at = sorted(own.values(), key=lambda k: (len(sets[k]), node[k]))
            if len(at) > 1:
                links = list(_forest([sets[k] for k in at], np.array(component)[at], np.array(side)[at], percent))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return _dealt(chunks.select("chunk", "node", "digest", "component", "side", "text")).mapInArrow(run, "a long, b long")


def _still_close(blocks: DataFrame, percent: int) -> DataFrame:
    """(chunk, node, component, side) of the members of each block that the sketches may link to one of another component."""

    def read(batch: pa.RecordBatch) -> tuple:
        lists = ([np.array(v, dtype=np.int64).view(np.uint64) for v in batch.column(i).to_pylist()] for i in (6, 7))
        return (*(batch.column(i).to_pylist() for i in range(1, 6)), *lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, (pivot, node, component, side, sizes, sketch, pivots) in _grouped(batches, read):
            fits, _ = _close(sketch, np.array(sizes), np.array(component), np.array(side), percent)
            if fits.any():
                fits &= _overlaps([p[p.view(np.int64) < pivot[0]] for p in pivots]) == 0  # else they meet in another family
            at = np.flatnonzero(fits.any(0) | fits.any(1))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(at)), *(pa.array(np.array(v)[at], pa.int64()) for v in (node, component, side))], names=["chunk", "node", "component", "side"])

    dealt = _dealt(blocks.select("chunk", "pivot", "node", "component", "side", "n_shingles", "sketch", "pivots"))
    return dealt.mapInArrow(run, "chunk string, node long, component long, side long")


def _slices(weight: Column) -> Column:
    return F.ceil(F.sum(weight)).cast("int")


def _first_pass(families: DataFrame) -> DataFrame:
    """(chunk, node): each class with the family that it shares most values with, and the pivot in every chunk."""
    best = families.groupBy("node", "n_shingles").agg(F.max(F.struct("common", (-F.col("pivot")).alias("pivot"))).alias("b"))
    best = cut(best.select((-F.col("b.pivot")).alias("pivot"), "node", "n_shingles"))
    weight = F.lit(1 / CHUNK) + F.col("n_shingles") / CHUNK_SHINGLES
    sizes = best.groupBy("pivot").agg(_slices(weight).alias("chunks"))
    dealt = join_few(best, sizes.filter("chunks > 1"), ["pivot"]).withColumn("part", F.pmod(F.xxhash64("node", "pivot"), F.coalesce("chunks", F.lit(1))))
    pivots = sizes.select("pivot", F.col("pivot").alias("node"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks").cast("long") - 1)).alias("part"))
    return dealt.select("pivot", "node", "part").union(pivots).select(F.concat_ws(":", "pivot", "part").alias("chunk"), "node")


def _open_blocks(members: DataFrame, reps: DataFrame, labels: DataFrame) -> DataFrame:
    """Blocks of the families that hold several components, in pairs of parts; a part of one component never meets its like.

    Large components have parts of their own, so that what is connected already is not sent again.
    """
    held = members.join(reps.select("node", "n_shingles", "sketch"), "node").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    spread = held.groupBy("pivot").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("pivot")
    held = cut(join_few(held, spread, ["pivot"], "inner"))
    pivots = members.join(held.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.collect_set("pivot").alias("pivots"))
    weight = F.lit(1 / CHUNK) + F.col("n_shingles") / CHUNK_SHINGLES
    each = cut(held.groupBy("pivot", "component").agg(F.sum(weight).alias("w")))
    large = each.filter("w > 1").select("pivot", "component", F.ceil("w").cast("int").alias("own"))
    small = each.filter("w <= 1").groupBy("pivot").agg(_slices(F.col("w")).alias("chunks")).filter("chunks > 1")
    dealt = join_few(join_few(held, large, ["pivot", "component"]), small, ["pivot"])
    own = F.concat_ws(".", F.lit("c"), "component", F.pmod(F.xxhash64("node"), F.col("own")))
    part = F.when(F.col("own").isNotNull(), own).otherwise(F.concat_ws(".", F.lit("s"), F.pmod(F.xxhash64("component"), F.coalesce("chunks", F.lit(1)))))
    dealt = cut(dealt.withColumn("part", part).drop("own", "chunks").join(pivots, "node"))
    pure = dealt.groupBy("pivot", "part").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    left, right = pure.selectExpr("pivot", "part as p", "low as l1", "high as h1"), pure.selectExpr("pivot", "part as q", "low as l2", "high as h2")
    pairs = left.join(right, "pivot").filter("p <= q and not (l1 = h1 and l2 = h2 and l1 = l2)").select("pivot", "p", "q")
    placed = pairs.select("pivot", "p", F.concat_ws(":", "pivot", "p", "q").alias("chunk"), F.when(F.col("p") == F.col("q"), -1).alias("one"), F.explode(F.array_distinct(F.array("p", "q"))).alias("part"))
    side = F.coalesce("one", F.when(F.col("part") == F.col("p"), 0).otherwise(1)).cast("long")
    return placed.withColumn("side", side).join(dealt, ["pivot", "part"])


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    rows = cut(sketches(docs, width))
    some = rows.filter("doc_id is not null and n_shingles > 0")
    classes = cut(some.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies")))
    reps = some.join(classes.select("digest", F.col("node").alias("doc_id")), ["digest", "doc_id"])
    reps = cut(reps.dropDuplicates(["digest"]).withColumnRenamed("doc_id", "node"))

    lists = inverted_lists(reps, percent)
    pivots = cut(lists.groupBy("value").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    families = join_spread(lists, pivots, "value", "n", "pivot").filter("node <> pivot")
    families = cut(families.groupBy("pivot", "node", "n_shingles").agg(F.count(F.lit(1)).alias("common")))
    members = families.select("pivot", "node").union(families.select("pivot", F.col("pivot").alias("node"))).distinct()
    texts = members.select("node").distinct().join(reps.select("node", "digest"), "node").join(docs.select(F.col("doc_id").alias("node"), "text"), "node")
    texts = cut(texts)

    first = _first_pass(families).join(texts, "node").withColumns({"component": F.col("node"), "side": F.lit(-1)})
    labels = cut(components(cut(_linked(first, width, percent))))
    near = cut(_still_close(_open_blocks(members, reps, labels), percent))
    joined = classes.join(labels, "node", "left").select("digest", "copies", F.coalesce("component", "node").alias("component"))
    if near.limit(1).count():
        links = cut(_linked(near.join(texts, "node"), width, percent))
        again = cut(components(links)).select(F.col("node").alias("component"), F.col("component").alias("lower"))
        joined = join_few(joined, again, ["component"]).select("digest", "copies", F.coalesce("lower", "component").alias("component"))

    labelled = join_spread(some.select("doc_id", "n_shingles", "digest"), cut(joined), "digest", "copies", "component").select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    alone = rows.filter("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return labelled.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)
