"""Exact top-k by inner product with MaxScore over integer components.

A term is a dimension and a sign. The posting list of (d, +) holds the vectors whose
component d is positive, with that impact; (d, -) the negative ones. For a query, terms of
its own sign can only add to a score and have the bound |q_d| * largest impact; terms of
the other sign only subtract.

In a shard the query's terms are ordered by bound. The non-essential ones are the longest
run of smallest bounds whose sum stays below the score to beat: a vector that is in none
of the essential lists cannot be among the best and is never touched. Essential postings
are traversed, then the other terms are probed, by falling bound and only for vectors
whose score could still compete. The best of all shards are merged.

Queries and candidates meet in blocks: each pair of a block of queries and a shard is a
task of its own, which returns k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txtrail.llm.common import join_groups
from txtrail.session import checkpointed

K = 20
QUERY_BLOCK = 1024
SHARD = 8192
# Queries of a block that are looked at together, vectors that give the first score to
# beat, and terms probed between two looks at what still competes.
TOGETHER = 128
SEEDS = 512
PROBE_STEP = 4
# Where no sum can reach this, neither it nor a sum less what others can take from it wraps.
SAFE_SUM = 1 << 62


def integral(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component; null if the vector or a component is null or not finite."""
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(F.coalesce(finite, F.lit(False)), whole)


class Shard:
    """Posting lists of the vectors of one shard.

    Lists are kept as bits over the shard's vectors beside a dense array of impacts, since
    most vectors are in about half of all lists.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, largest_query: int) -> None:
        order = np.argsort(ids, kind="stable")  # equal scores: smaller id first
        self.ids = ids[order]
        # exact in floating point, in 64 bits, or as integers of any size
        bound = largest(vectors) * largest_query * vectors.shape[1]
        self.kind = np.float64 if bound < 1 << 53 else np.int64 if bound < SAFE_SUM else object
        self.lowest = -SAFE_SUM if self.kind is np.int64 else -np.inf
        self.impacts = np.ascontiguousarray(vectors[order].T).astype(self.kind)
        self.lists = [np.packbits(self.impacts > 0, axis=1), np.packbits(self.impacts < 0, axis=1)]
        self.most = [np.maximum(x.max(axis=1), 0) for x in (self.impacts, -self.impacts)]

    def best(self, queries: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, scores) of the k best for each query, without its own id."""
        queries = queries.astype(self.kind)
        positive = queries > 0
        gains = np.abs(queries) * np.where(positive, *self.most)
        losses = np.abs(queries) * np.where(positive, *self.most[::-1])
        order = np.argsort(gains, axis=1, kind="stable")
        bounds = np.cumsum(np.take_along_axis(gains, order, axis=1), axis=1)
        # the score to beat at first: the k-th best among the first vectors of the shard
        seeds = queries @ self.impacts[:, : SEEDS]
        seeds[self.ids[None, :SEEDS] == own[:, None]] = self.lowest
        seeds = np.sort(seeds, axis=1)[:, ::-1]
        beat = seeds[:, k - 1] if seeds.shape[1] >= k else np.full(len(queries), self.lowest, seeds.dtype)
        # non-essential: the run of smallest bounds whose sum stays below it
        n_free = np.where(beat > 0, (bounds < beat[:, None]).sum(axis=1), 0)
        essential = queries.copy()
        for i, n in enumerate(n_free.tolist()):
            essential[i, order[i, :n]] = 0
        touched = [self._touched(essential[i]) if n else np.arange(len(self.ids)) for i, n in enumerate(n_free.tolist())]
        # essential postings, and what the same dimensions subtract: vector by vector where
        # lists hold few of them, and in one product for queries whose lists hold most
        many = np.array([len(t) * 2 > len(self.ids) for t in touched], bool)
        together = iter(essential[many] @ self.impacts)
        for i, n in enumerate(n_free.tolist()):
            docs = touched[i]
            if many[i]:
                partial = next(together)[docs]
            else:
                at = np.nonzero(essential[i])[0]
                partial = essential[i, at] @ self.impacts[np.ix_(at, docs)]
            other = self.ids[docs] != own[i]
            yield self._probe(docs[other], partial[other], queries[i], order[i, :n][::-1], bounds[i], losses[i], beat[i], k)

    def _touched(self, essential: np.ndarray) -> np.ndarray:
        """Vectors in the list of an essential term; a vector in none cannot reach the score."""
        up = np.bitwise_or.reduce(self.lists[0][essential > 0], axis=0)
        down = np.bitwise_or.reduce(self.lists[1][essential < 0], axis=0)
        return np.nonzero(np.unpackbits(up | down, count=len(self.ids)))[0]

    def _probe(self, docs, scores, query, free, bounds, losses, beat, k):  # noqa: ANN001, ANN202
        """Adds the other terms by falling bound for the vectors that still compete."""
        for at in range(0, len(free), PROBE_STEP):
            left = free[at:]
            if len(docs) > k:
                reached = np.partition(scores, len(scores) - k)[len(scores) - k] - losses[left].sum()
                beat = max(beat, reached)
            competitive = scores + bounds[len(left) - 1] >= beat
            docs, scores = docs[competitive], scores[competitive]
            step = left[:PROBE_STEP]
            scores = scores + query[step] @ self.impacts[np.ix_(step, docs)]
        if len(docs) > 4 * k:
            last = np.partition(scores, len(scores) - k)[len(scores) - k]
            docs, scores = docs[scores >= last], scores[scores >= last]
        order = np.argsort(-scores, kind="stable")[:k]  # vectors are in the order of their ids
        return docs[order], scores[order].astype(np.int64)


def largest(vectors: np.ndarray) -> int:
    """The largest absolute value; of the smallest integer, too."""
    return max(int(vectors.max()), -int(vectors.min())) if vectors.size else 0


def packed(ids: np.ndarray, vectors: np.ndarray) -> dict[str, list[bytes | str]]:
    """Ids and components as bytes, components as wide as the largest one needs."""
    widths = [np.dtype(f"<i{n}") for n in (1, 2, 4, 8)]
    width = next(w for w in widths if largest(vectors) <= np.iinfo(w).max or w.itemsize == 8)
    return {"ids": [ids.astype("<i8").tobytes()], "width": [width.str], "packed": [vectors.astype(width).tobytes()]}


def unpacked(ids: bytes, width: str, components: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.frombuffer(ids, "<i8")
    return numbers, np.frombuffer(components, width).reshape(len(numbers), size).astype(np.int64)


def blocks(vectors: DataFrame, name: str) -> DataFrame:
    """(size, name, ids, width, packed): bounded blocks of vectors of one length; each task packs its own."""

    def run(group: pa.Table) -> pa.Table:
        flat = group["v"].combine_chunks().flatten().to_numpy()
        first = {c: group[c][:1] for c in ("size", name)}
        return pa.table(first | packed(group["vec_id"].to_numpy(), flat))

    return vectors.groupBy("size", name).applyInArrow(run, f"size int, {name} bigint, ids binary, width string, packed binary")


def search(
    vectors: DataFrame, queries: Column, k: int = K, scale: int = 64, query_block: int = QUERY_BLOCK, shard: int = SHARD
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each row that `queries` picks.

    Columns vec_id and embedding; others are not looked at. Vectors of each length are
    searched among themselves. Rows without vec_id, and vectors that are null or hold a
    component that is null or not finite, take no part. Equal scores go to the smaller
    vec_id. Rows that repeat a vec_id are one vector each as candidates; a query leaves out
    every row with its id, and gets k rows for each of its vectors' lengths together.
    A component or a score that 64 bits cannot hold is an error.
    """
    whole = vectors.where(F.col("vec_id").isNotNull()).select("vec_id", integral(F.col("embedding"), scale).alias("v"), queries.alias("q"))
    whole = checkpointed(whole.where(F.col("v").isNotNull()).withColumn("size", F.size("v")))
    most = F.greatest(F.array_max("v").cast("double"), -F.array_min("v").cast("double"))
    sizes = checkpointed(whole.groupBy("size").agg(F.count("*").alias("n"), F.count_if("q").alias("nq"), F.max(most).alias("most")))
    # floor() ends there
    if not sizes.where(F.col("most") >= 2.0**63).isEmpty():
        raise ValueError("a component is too large for 64 bits")
    dealt = sizes.select(
        "size",
        "n",
        F.greatest(F.lit(1), F.ceil(F.col("n") / shard)).alias("n_shards"),
        F.greatest(F.lit(1), F.ceil(F.col("nq") / query_block)).alias("n_blocks"),
    )
    placed = join_groups(whole, dealt, "size", "n")
    of = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.col(n))
    shards = blocks(placed.select("size", of("n_shards").alias("shard"), "vec_id", "v"), "shard")
    asked = blocks(placed.where("q").select("size", of("n_blocks").alias("block"), "vec_id", "v").distinct(), "block")
    counts = dealt.drop("n")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    left = asked.join(counts, "size").withColumn("shard", every("n_shards")).select("size", "block", "shard", "ids", "width", "packed")
    right = shards.join(counts, "size").withColumn("block", every("n_blocks"))
    right = right.select("size", "block", "shard", *[F.col(c).alias(f"s_{c}") for c in ("ids", "width", "packed")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, queries_ = unpacked(row["ids"], row["width"], row["packed"], row["size"])
                lists = Shard(*unpacked(row["s_ids"], row["s_width"], row["s_packed"], row["size"]), largest(queries_))
                asked_, best_, scores_ = [], [], []
                for at in range(0, len(ids), TOGETHER):
                    own = ids[at : at + TOGETHER]
                    for one, (docs, scores) in zip(own.tolist(), lists.best(queries_[at : at + TOGETHER], own, k)):
                        asked_.append(np.full(len(docs), one))
                        best_.append(lists.ids[docs])
                        scores_.append(scores)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x).astype(np.int64)) for x in (asked_, best_, scores_)], ["query_id", "vec_id", "score"]
                )

    pairs = left.join(right.hint("shuffle_merge"), ["size", "block", "shard"])
    hits = pairs.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
