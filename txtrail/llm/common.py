"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txtrail.session import checkpointed, new_folder

# A group is hot from this share of all rows on; there are at most 1 / HOT_SHARE hot groups.
HOT_SHARE = 1 / 256

# Bits that tell which rows may have one of some ids are at most so many 64-bit words.
MARK_WORDS = 1 << 18

# Texts are handled in slices of about this many characters inside a task.
SLICE_CHARS = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(key: str = "doc_id") -> Column:
    """True for the fifth of all rows that no model may learn from."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """A batch cut into pieces of bounded text, so that long texts never meet in memory."""
    values = batch.column(batch.schema.get_field_index(column))
    offsets = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1 + values.offset)[values.offset :]
    if pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type):
        offsets = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1 + values.offset)[values.offset :]
    start = 0
    while start < len(values):
        stop = int(np.searchsorted(offsets, offsets[start] + SLICE_CHARS, side="right")) - 1
        stop = min(max(stop, start + 1), len(values))
        yield batch.slice(start, stop - start)
        start = stop


def sliced(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """All batches in slices; memory goes back to the system before a task and after it."""
    release_memory()
    for batch in batches:
        if batch.num_rows:
            yield from slices(batch, column)
    batch = None
    release_memory()


def release_memory() -> None:
    """Gives freed memory back to the system, as a worker outlives its task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def _trim() -> Callable[[int], int] | None:
    """The C library keeps freed blocks of arrays until it is asked for them."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return None


_TRIM = _trim()


def partitions_for(rows: int, rows_each: int, least: int = 1) -> int:
    return max(least, math.ceil(rows / rows_each))


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, with no lineage behind them."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Each row with its place in `order` as column `name`, from 0, without gaps.

    Rows are dealt out by ranges of `order` and sorted inside a range; a range starts where
    the ones before it end, so no task sees more than its own range. Rows that `order` does
    not tell apart get places next to each other.
    """
    placed = stored(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()),
        name,
    )
    # the id holds the number of the range above 33 bits with the place inside it
    part, inside = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    # one row for each range
    joined = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return joined.select(*df.columns, (F.col("_start") + inside).alias(name))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Each row with the columns of its group; `groups` has one row per key and its row count.

    Groups that hold HOT_SHARE of all rows or more, at most 1 / HOT_SHARE of them, are
    broadcast and their rows take no part in the shuffle. Keys are never null.
    """
    counted = groups.agg(F.sum(size).alias("n")).first()
    total = (counted.n if counted else 0) or 0
    hot = groups.where(F.col(size) > max(1.0, total * HOT_SHARE))
    columns = [c for c in groups.columns if c != key]
    packed = F.struct(*columns)
    marked = rows.join(F.broadcast(hot.select(key, packed.alias("_hot"))), key, "left")
    # a row of a hot group gets a key of its own that matches nothing
    spread = F.when(F.col("_hot").isNull(), F.struct(F.lit(0).cast("bigint").alias("s"), F.col(key).alias("k")))
    alone = F.struct((F.monotonically_increasing_id() + 1).alias("s"), F.col(key).alias("k"))
    marked = marked.withColumn("_key", F.coalesce(spread, alone))
    others = groups.where(F.col(size) <= max(1.0, total * HOT_SHARE)).select(
        F.struct(F.lit(0).cast("bigint").alias("s"), F.col(key).alias("k")).alias("_key"),
        packed.alias("_cold"),
    )
    joined = marked.join(others, "_key", "left").withColumn("_found", F.coalesce("_hot", "_cold"))
    return joined.select(*rows.columns, *[F.col(f"_found.{c}").alias(c) for c in columns])


def marked_by(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows with `_marked`: false where `ids` surely has not got the key.

    Ids set bits at their hashes, and the bits are broadcast; there are about 16 for each id,
    but at most 64 * MARK_WORDS. So of a large table few rows need be shuffled for a join.
    """
    words = min(MARK_WORDS, max(16, ids.count() // 4))
    place = F.pmod(F.xxhash64(key), F.lit(64 * words))
    places = ids.select(place.alias("_place")).distinct()
    word, bit = F.floor(F.col("_place") / 64).alias("_word"), (F.col("_place") % 64).cast("int")
    bits = places.groupBy(word).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("_bits"))
    looked = rows.withColumn("_place", place).withColumn("_word", F.floor(F.col("_place") / 64))
    found = looked.join(F.broadcast(checkpointed(bits)), "_word", "left")
    set_ = F.coalesce(F.getbit("_bits", bit) == 1, F.lit(False))
    return found.withColumn("_marked", set_).select(*rows.columns, "_marked")


def components(edges: DataFrame) -> DataFrame:
    """(v, root): the smallest vertex each vertex of an edge reaches.

    `edges` has columns a and b of one orderable type, in any direction and number.
    Every vertex points at a smaller one of its component; a round hooks roots to the
    smallest grandparent around them and halves the paths, and both sides of every
    join are plain tables, so adaptive execution splits vertices with many edges.
    """
    both = checkpointed(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    )
    parents = checkpointed(
        both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("p")).select("v", F.least("v", "p").alias("p"))
    )
    while True:
        above = parents.select(F.col("v").alias("p"), F.col("p").alias("g"))
        known = checkpointed(parents.join(above, "p").select("v", "p", "g"))
        near = (
            both.join(known.select(F.col("v").alias("b"), "g"), "b")
            .groupBy("a")
            .agg(F.min("g").alias("m"))
            .join(known.select(F.col("v").alias("a"), "p"), "a")
        )
        proposed = (
            known.select("v", "g")
            .union(near.select("a", "m"))
            .union(near.select("p", "m"))
            .groupBy("v")
            .agg(F.min("g").alias("p"))
        )
        changed = checkpointed(
            proposed.join(known.select("v", F.col("p").alias("old")), "v").select(
                "v", F.least("p", "old").alias("p"), "old"
            )
        )
        parents = changed.select("v", "p")
        if changed.where("p <> old").isEmpty():
            return parents.select("v", F.col("p").alias("root"))
