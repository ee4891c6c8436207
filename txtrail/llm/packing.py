"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token pieces. Pieces of full length are sequences by themselves; all
others are dealt at random into districts of bounded size, so that each district has
pieces of all lengths. Several islands work on each district: populations of packings
that start from best fit and evolve by grouping crossover. A child takes whole
well-filled bins from one parent, drops the bins of the other that hold any of the same
pieces, and puts displaced pieces back by best fit. Between epochs the best packing of an
island moves to the next one in a ring. A district is finished when it reaches the number
of bins that its tokens need at least.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txtrail.llm.bpe import KEPT_BYTES, Codec
from txtrail.llm.common import partitions_for, release_memory, sliced
from txtrail.session import checkpointed

CAPACITY = 1024
DISTRICT = 20_000
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 4
POPULATION = 4

Bins = list[list[int]]  # the pieces of each bin


class FastCodec(Codec):
    """The same ids, with the merges of single words left to a compiled library."""

    _by_path: dict[str, Codec] = {}

    def __init__(self, path: str) -> None:
        super().__init__(path)
        # its ranks are ids, so merges have to be numbered as their results are
        ordered = all(a < b for a, b in zip(self.merged, self.merged[1:]))
        ranks = {self.tokens[i]: i for i in [*self.first, *self.merged]}
        self.words_of = tiktoken.Encoding("words", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={}) if ordered else None

    def merge(self, word: bytes) -> list[int]:
        return self.words_of.encode_ordinary(word.decode()) if self.words_of else super().merge(word)


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int, kept_bytes: int = KEPT_BYTES) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the ids of each whole text and end_id;
    longer documents are cut, and their first piece takes what is over. A worker keeps about
    `kept_bytes` of the words it has met; with less than the default it drops them when a
    task ends."""
    schema = T.StructType(
        [
            docs.schema["doc_id"],
            T.StructField("piece", T.IntegerType()),
            *[T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")],
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = FastCodec.at(path)
        codec.keep(kept_bytes)
        last = np.array([end_id], "<u4").tobytes()
        for batch in sliced(batches):
            rows, owner = [], []
            for i, text in enumerate(batch.column(1)):
                data = codec.encode(text.as_py() or "").tobytes() + last
                n = len(data) // 4
                stops = range(n % capacity or capacity, n + 1, capacity)
                for number, stop in enumerate(stops):
                    start = max(0, stop - capacity) if number else 0
                    rows.append((number, start, stop - start, zlib.crc32(data[start * 4 : stop * 4])))
                    owner.append(i)
            columns = [pa.array(list(c), f) for c, f in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *columns], schema.names)
        if kept_bytes < KEPT_BYTES:
            codec.forget()
            release_memory()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


# --- one packing -----------------------------------------------------------------


class FreeSpace:
    """Bins by free space; the best fit is the lowest set bit at or above a size."""

    def __init__(self, capacity: int) -> None:
        self.by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.present = 0

    def add(self, bin_: int, space: int) -> None:
        if space:
            self.by_space[space].append(bin_)
            self.present |= 1 << space

    def take(self, size: int) -> tuple[int, int] | None:
        fitting = self.present >> size
        if not fitting:
            return None
        space = size + (fitting & -fitting).bit_length() - 1
        bin_ = self.by_space[space].pop()
        if not self.by_space[space]:
            self.present &= ~(1 << space)
        return bin_, space


def best_fit(order: list[int], sizes: list[int], bins: Bins, capacity: int) -> Bins:
    """The bins with the pieces of `order` put where they leave the least space."""
    free = FreeSpace(capacity)
    for b, members in enumerate(bins):
        free.add(b, capacity - sum(sizes[i] for i in members))
    for i in order:
        found = free.take(sizes[i])
        if found is None:
            bins.append([i])
            free.add(len(bins) - 1, capacity - sizes[i])
        else:
            bins[found[0]].append(i)
            free.add(found[0], found[1] - sizes[i])
    return bins


def falling(members: list[int], sizes: list[int]) -> list[int]:
    return sorted(members, key=lambda i: (-sizes[i], i))


def fitness(bins: Bins, sizes: list[int]) -> tuple[int, int]:
    """Fewer bins first; among as many, space that is gathered in few bins."""
    return -len(bins), sum(sum(sizes[i] for i in members) ** 2 for members in bins)


def crossover(mother: Bins, father: Bins, sizes: list[int], capacity: int, rng: np.random.Generator) -> Bins:
    fills = [sum(sizes[i] for i in members) for members in father]
    full = [b for b, fill in enumerate(fills) if fill >= capacity * 0.99]
    chosen = [b for b, pick in zip(full, rng.random(len(full)) < rng.uniform(0.1, 0.5)) if pick]
    injected = [list(father[b]) for b in chosen]
    taken = {i for members in injected for i in members}
    kept, displaced = [], []
    for members in mother:
        if taken.isdisjoint(members):
            kept.append(list(members))
        else:
            displaced += [i for i in members if i not in taken]
    # the emptiest of the bins that stay are opened as well
    kept.sort(key=lambda members: sum(sizes[i] for i in members), reverse=True)
    opened = max(1, len(kept) // 20)
    displaced += [i for members in kept[len(kept) - opened :] for i in members]
    del kept[len(kept) - opened :]
    return best_fit(falling(displaced, sizes), sizes, injected + kept, capacity)


def first_population(sizes: list[int], capacity: int, n: int, rng: np.random.Generator) -> list[Bins]:
    order = falling(list(range(len(sizes))), sizes)
    population = [best_fit(order, sizes, [], capacity)]
    least = -(-sum(sizes) // capacity)
    while len(population) < n and len(population[0]) > least:
        blurred = np.argsort(-np.array(sizes) * rng.uniform(0.9, 1.1, len(sizes)), kind="stable")
        population.append(best_fit(blurred.tolist(), sizes, [], capacity))
    return population


def evolve(population: list[Bins], sizes: list[int], capacity: int, generations: int, rng: np.random.Generator) -> list[Bins]:
    """The same number of packings, fittest first."""
    least = -(-sum(sizes) // capacity)
    ranked = sorted(population, key=lambda bins: fitness(bins, sizes), reverse=True)
    for _ in range(generations):
        if len(ranked[0]) <= least or len(ranked) < 2:
            break
        size = len(ranked)
        for _ in range(size // 2):
            a, b = rng.choice(size, 2, replace=False)
            ranked.append(crossover(ranked[a], ranked[b], sizes, capacity, rng))
        ranked = sorted(ranked, key=lambda bins: fitness(bins, sizes), reverse=True)[:size]
    return ranked


def as_bytes(bins: Bins, n: int) -> bytes:
    out = np.empty(n, "<i4")
    for b, members in enumerate(bins):
        out[members] = b
    return out.tobytes()


def as_bins(data: bytes) -> Bins:
    bins: dict[int, list[int]] = {}
    for i, b in enumerate(np.frombuffer(data, "<i4").tolist()):
        bins.setdefault(b, []).append(i)
    return list(bins.values())


# --- islands ---------------------------------------------------------------------

STATE = "district bigint, island int, items binary, sizes binary, population array<binary>, bins int, fitness bigint"


def _state(district: int, island: int, items: bytes, sizes: np.ndarray, population: list[Bins]) -> pa.Table:
    listed = sizes.tolist()
    value = fitness(population[0], listed)
    return pa.table(
        {
            "district": pa.array([district], pa.int64()),
            "island": pa.array([island], pa.int32()),
            "items": pa.array([items], pa.binary()),
            "sizes": pa.array([sizes.astype("<i4").tobytes()], pa.binary()),
            "population": pa.array([[as_bytes(b, len(listed)) for b in population]], pa.list_(pa.binary())),
            "bins": pa.array([-value[0]], pa.int32()),
            "fitness": pa.array([value[1]], pa.int64()),
        }
    )


def settled(items: DataFrame, islands: int, capacity: int, population: int, generations: int, seed: int) -> DataFrame:
    """The first epoch, from (item, length, district)."""

    def run(group: pa.Table) -> pa.Table:
        district, island = group["district"][0].as_py(), group["island"][0].as_py()
        group = group.sort_by("item")
        sizes = group["length"].to_numpy()
        rng = np.random.default_rng([seed, district, island])
        start = first_population(sizes.tolist(), capacity, population, rng)
        found = evolve(start, sizes.tolist(), capacity, generations, rng)
        return _state(district, island, group["item"].to_numpy().astype("<i8").tobytes(), sizes, found)

    copies = items.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(islands)])))
    return copies.select("district", "island", "item", "length").groupBy("district", "island").applyInArrow(run, STATE)


def migrated(states: DataFrame, islands: int, capacity: int, generations: int, seed: int) -> DataFrame:
    """An epoch after the elite of each island has moved on to the next."""
    elite = states.select("district", ((F.col("island") + 1) % islands).alias("island"), F.col("population")[0].alias("elite"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.frombuffer(row["sizes"], "<i4")
                population = [as_bins(p) for p in row["population"]]
                newcomer = as_bins(row["elite"])
                population = [*population[: max(1, len(population) - 1)], newcomer]
                rng = np.random.default_rng([seed, row["district"], row["island"]])
                found = evolve(population, sizes.tolist(), capacity, generations, rng)
                yield _state(row["district"], row["island"], row["items"], sizes, found).to_batches()[0]

    return states.join(elite, ["district", "island"]).select(*states.columns, "elite").mapInArrow(run, STATE)


def placed(states: DataFrame) -> DataFrame:
    """(item, district, bin, offset) by the fittest packing of each district."""
    best = states.groupBy("district").agg(
        F.max_by(F.struct("items", "sizes", F.col("population")[0].alias("bins")), F.struct(-F.col("bins"), "fitness", -F.col("island"))).alias("s")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.frombuffer(row["sizes"], "<i4").astype(np.int64)
                bins = np.frombuffer(row["bins"], "<i4")
                order = np.argsort(bins, kind="stable")
                ends = np.cumsum(sizes[order]) - sizes[order]
                fresh = np.concatenate([[True], bins[order][1:] != bins[order][:-1]])
                offset = ends - np.repeat(ends[fresh], np.diff(np.concatenate([np.nonzero(fresh)[0], [len(bins)]])))
                items = np.frombuffer(row["items"], "<i8")[order]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(items), pa.array(np.full(len(items), row["district"])), pa.array(bins[order].astype(np.int64)), pa.array(offset)],
                    ["item", "district", "bin", "offset"],
                )

    return best.select("district", "s.items", "s.sizes", "s.bins").mapInArrow(run, "item bigint, district bigint, bin bigint, offset bigint")


def packed(
    docs: DataFrame,
    path: str,
    end_id: int = 2,
    capacity: int = CAPACITY,
    district: int = DISTRICT,
    islands: int = ISLANDS,
    epochs: int = EPOCHS,
    generations: int = GENERATIONS,
    population: int = POPULATION,
    seed: int = 7,
    kept_bytes: int = KEPT_BYTES,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of each piece.

    A null or empty text is one piece with end_id alone. Repeated rows are packed once each;
    columns besides doc_id and text are not looked at. Sequences hold up to `capacity`
    tokens without gaps; at most one sequence a district is filled worse than its pieces
    force it to.
    """
    cut = checkpointed(pieces(docs, path, end_id, capacity, kept_bytes).withColumn("item", F.monotonically_increasing_id()))
    loose = cut.where(F.col("length") < capacity).select("item", "length")
    districts = partitions_for(loose.count(), district)
    dealt = loose.withColumn("district", F.pmod(F.xxhash64("item"), F.lit(districts)))
    states = checkpointed(settled(dealt, islands, capacity, population, generations, seed))
    for epoch in range(1, epochs):
        states = checkpointed(migrated(states, islands, capacity, generations, seed + epoch))
    shared = placed(states).select("item", (F.col("district") * (1 << 32) + F.col("bin")).alias("sequence_id"), "offset")
    full = cut.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("item")).withColumn("offset", F.lit(0).cast("bigint"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return cut.where(F.col("length") < capacity).join(shared, "item").select(columns).union(full.select(columns))
