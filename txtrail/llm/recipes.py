"""Exact duplicates by content-defined chunk recipes.

A normalised text is cut where a rolling hash of the last 16 bytes says so. Its recipe is
the ordered list of its chunks' identifiers, and two texts are equal when their recipes
are. Long texts are moved once, as chunks that are combined in the task that made them
before any shuffle; from then on only recipes travel.

An identifier is the 128-bit hash of a chunk, verified: chunks are grouped by hash and
content, and a hash that stands for two contents loses its place as an identifier. The
content itself takes it, so the result is exact whatever the hash does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txtrail.llm.common import join_groups, sliced
from txtrail.session import checkpointed

WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
MIN_CHUNK = 256
MAX_CHUNK = 16_384
# a cut at one of 2048 places
CUT_BITS = 0x7FF << 4
# Bytes whose rolling hash is held at once.
STRETCH = 1 << 22

GEAR = np.random.default_rng(20_240).integers(0, 1 << 32, 256, dtype=np.uint32)


def normalised(data: bytes) -> bytes:
    """One space for each run of white space."""
    inner = b" ".join(data.split())
    if not inner:
        return b" " if data else b""
    return (b" " if data[0] in WHITE else b"") + inner + (b" " if data[-1] in WHITE else b"")


def cut_places(data: bytes) -> np.ndarray:
    """Places behind which the last 16 bytes say that a chunk may end."""
    found = []
    for start in range(0, len(data), STRETCH):
        skip = min(start, 15)
        h = GEAR[np.frombuffer(data, np.uint8, min(STRETCH + skip, len(data) - start + skip), start - skip)]
        for step in (1, 2, 4, 8):
            h[step:] += h[:-step] << np.uint32(step)
        places = np.nonzero((h & np.uint32(CUT_BITS)) == 0)[0] + (start - skip) + 1
        found.append(places[places > start])
    return np.concatenate(found) if found else np.empty(0, int)


def chunks(data: bytes) -> list[bytes]:
    out, start = [], 0
    for place in [*cut_places(data).tolist(), len(data)]:
        while place - start > MAX_CHUNK:
            out.append(data[start : start + MAX_CHUNK])
            start += MAX_CHUNK
        if place - start >= MIN_CHUNK or (place == len(data) and place > start):
            out.append(data[start:place])
            start = place
    return out


def identifier(chunk: bytes, size: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=size).digest()


def _text(value: pa.Scalar) -> bytes:
    return normalised(value.as_buffer().to_pybytes()) if value.is_valid else b""


def chunk_rows(docs: DataFrame, id_bytes: int) -> DataFrame:
    """(h, chunk): each chunk of every text, once for each slice of a task."""
    schema = T.StructType([T.StructField("h", T.BinaryType()), T.StructField("chunk", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = {c for text in batch.column(0) for c in chunks(_text(text))}
            hashes = [identifier(c, id_bytes) for c in found]
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array(list(found), pa.binary())], schema.names)

    return docs.select("text").mapInArrow(run, schema)


def ambiguous(docs: DataFrame, id_bytes: int) -> DataFrame:
    """(h): hashes that stand for more than one content."""
    contents = chunk_rows(docs, id_bytes).groupBy("h", "chunk").agg(F.count("*").alias("n"))
    return contents.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")


def recipes(docs: DataFrame, id_bytes: int = 16) -> DataFrame:
    """(doc_id, text_sha256, recipe) of each row; null text counts as empty."""
    schema = T.StructType(
        [docs.schema["doc_id"], T.StructField("text_sha256", T.StringType()), T.StructField("recipe", T.BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            digests, made = [], []
            for value in batch.column(1):
                text = _text(value)
                digests.append(hashlib.sha256(text).hexdigest())
                made.append(b"".join(identifier(c, id_bytes) for c in chunks(text)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string()), pa.array(made, pa.binary())], schema.names)

    unclear = checkpointed(ambiguous(docs, id_bytes))
    if unclear.isEmpty():
        return docs.select("doc_id", "text").mapInArrow(run, schema)
    return _spelled(docs, unclear, id_bytes)


def _spelled(docs: DataFrame, unclear: DataFrame, id_bytes: int) -> DataFrame:
    """Recipes that hold the content of each chunk whose hash is ambiguous."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row bigint, doc_id {id_type}, text_sha256 string, pos int, h binary, chunk binary"
    names = ["row", "doc_id", "text_sha256", "pos", "h", "chunk"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            for i in range(batch.num_rows):
                text = _text(batch.column(2)[i])
                parts = chunks(text) or [b""]
                n = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column(0)[i].as_py()] * n, pa.int64()),
                        pa.array([batch.column(1)[i].as_py()] * n, batch.schema.field(1).type),
                        pa.array([hashlib.sha256(text).hexdigest()] * n, pa.string()),
                        pa.array(range(n), pa.int32()),
                        pa.array([identifier(c, id_bytes) for c in parts], pa.binary()),
                        pa.array(parts, pa.binary()),
                    ],
                    names,
                )

    # the place of a row is fixed before the rows are cut up
    numbered = checkpointed(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))
    rows = numbered.mapInArrow(run, schema).join(unclear.withColumn("unclear", F.lit(True)), "h", "left")
    # the length comes first, so that the joined list can be read in one way only
    spelled = F.when(
        F.col("unclear"), F.concat(F.col("h"), F.encode(F.format_string("%012d", F.length("chunk")), "utf-8"), F.col("chunk"))
    ).otherwise(F.concat(F.col("h"), F.encode(F.lit("-" * 12), "utf-8")))
    listed = rows.groupBy("row", "doc_id", "text_sha256").agg(
        F.sort_array(F.collect_list(F.struct("pos", spelled.alias("id")))).alias("ids")
    )
    empty = F.expr("X''")
    return listed.select("doc_id", "text_sha256", F.aggregate("ids.id", empty, lambda a, b: F.concat(a, b)).alias("recipe"))


def exact_duplicates(docs: DataFrame, id_bytes: int = 16) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of each row, dropped ones too.

    Texts are equal when they are the same after each run of white space has become one
    space; null counts as empty, and empty texts are equal to each other. keep_id is the
    smallest doc_id of the group. Rows that repeat a doc_id with an equal text are one
    document and kept alike. Rows without doc_id count in their group but are kept only
    where no row of it has one; keep_id is null then. Columns besides doc_id and text are
    not looked at.
    """
    rows = checkpointed(recipes(docs, id_bytes))
    groups = checkpointed(rows.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    return join_groups(rows, groups, "recipe", "group_size").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def without_duplicates(docs: DataFrame) -> DataFrame:
    """The rows that stay, with the columns of docs, one of rows that repeat a document."""
    columns = docs.columns
    digest = F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ").cast("binary"), 256)
    keyed = docs.select(F.col("doc_id").alias("k_id"), digest.alias("k_text"), F.struct(*columns).alias("row"))
    kept = exact_duplicates(docs).where("kept").select(F.col("doc_id").alias("k_id"), F.col("text_sha256").alias("k_text")).distinct()
    same = keyed["k_id"].eqNullSafe(kept["k_id"]) & (keyed["k_text"] == kept["k_text"])
    return keyed.join(kept, same, "left_semi").dropDuplicates(["k_id", "k_text"]).select("row.*")
