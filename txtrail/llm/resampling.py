"""Importance resampling of documents towards a target distribution of n-grams.

A document is scanned once: its words, joined by one space, run through CRC-32, and the
value behind each word is stored. The CRC of any n-gram follows from two of these values,
as the one before it, shifted by the length of the n-gram over GF(2), cancels out of the
one behind it. CRCs deal the n-grams to buckets; the log ratio of a bucket's share in the
target and in the documents is its gain, and Gumbel noise on the summed gains draws
documents without replacement.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txtrail.llm.common import numbered, sliced, stored

BUCKETS = 10_000
LONGEST = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024

# fixed value: the CRC-32 polynomial, lowest bit first
POLYNOMIAL = 0xEDB88320
FULL = np.uint32(0xFFFFFFFF)
SPACE = 0x20


def _folded() -> np.ndarray:
    """Each byte as it counts: digits and bytes of other scripts stay, A-Z become a-z, the rest is a space."""
    table = np.full(256, SPACE, np.uint8)
    for first, last in (("0", "9"), ("a", "z")):
        table[ord(first) : ord(last) + 1] = np.arange(ord(first), ord(last) + 1)
    table[ord("A") : ord("Z") + 1] = table[ord("a") : ord("z") + 1]
    table[0x80:] = np.arange(0x80, 0x100)
    return table


FOLDED = _folded()


@lru_cache(maxsize=1)
def byte_step() -> np.ndarray:
    """What eight steps of the CRC register make of each low byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


@lru_cache(maxsize=40)
def shift_tables(k: int) -> np.ndarray:
    """For each of the four bytes of a CRC, its value moved on by 2**k zero bytes."""
    if k == 0:
        crcs = np.arange(256, dtype=np.uint32)[None, :] << np.uint32(8) * np.arange(4, dtype=np.uint32)[:, None]
        return byte_step()[crcs & 255] ^ (crcs >> np.uint32(8))
    half = shift_tables(k - 1)
    return _look_up(half, half)


def _look_up(tables: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    moved = tables[0][crcs & np.uint32(255)]
    for b in range(1, 4):
        moved = moved ^ tables[b][crcs >> np.uint32(8 * b) & np.uint32(255)]
    return moved


def shifted(crcs: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """Each CRC moved on by its number of bytes, one power of two at a time."""
    crcs, k = crcs.copy(), 0
    while (n_bytes >> k).any():
        at = np.flatnonzero(n_bytes >> k & 1)
        crcs[at] = _look_up(shift_tables(k), crcs[at])
        k += 1
    return crcs


def after_space(crcs: np.ndarray) -> np.ndarray:
    """Each CRC with one more space behind it."""
    register = crcs ^ FULL
    return byte_step()[(register ^ np.uint32(SPACE)) & np.uint32(255)] ^ (register >> np.uint32(8)) ^ FULL


class Scan:
    """Words of several texts with the running CRCs of their separator-normalised forms.

    For word i: doc[i] is its text, before[i] and behind[i] are the CRCs of that text up to
    the start and the end of the word, start[i] and end[i] its bytes in the normalised texts.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        folded = FOLDED[data]
        inside = folded != SPACE
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        opens[edges] |= inside[edges]
        closes[edges - 1] |= inside[edges - 1]
        start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.doc = np.searchsorted(offsets, start, side="right") - 1
        first = np.ones(len(start), bool)
        first[1:] = self.doc[1:] != self.doc[:-1]
        keep = inside
        keep[start[~first] - 1] = True
        place = np.cumsum(keep)
        normalised = memoryview(folded[keep].tobytes())
        self.end = place[end - 1] if len(end) else end
        self.start = self.end - (end - start)
        self.behind = np.empty(len(start), np.uint32)
        crc, at, crc32 = 0, 0, zlib.crc32
        running = []
        for is_first, stop in zip(first.tolist(), self.end.tolist()):
            # a slice starts with the space before the word
            crc = crc32(normalised[at:stop], 0 if is_first else crc)
            running.append(crc)
            at = stop
        self.behind[:] = running
        self.before = np.zeros(len(start), np.uint32)
        self.before[1:] = after_space(self.behind[:-1])
        self.before[first] = 0

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, CRC) of each run of n words."""
        heads = np.flatnonzero(self.doc[: len(self.doc) - n + 1] == self.doc[n - 1 :])
        tails = heads + n - 1
        return self.doc[heads], self.behind[tails] ^ shifted(self.before[heads], self.end[tails] - self.start[heads])


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of texts, null ones empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1 + texts.offset)[texts.offset :]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def features(docs: DataFrame, key: str = "doc_id", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(key, n_words, n_features, buckets, counts): how often each bucket occurs in each text.

    Words are runs of letters a-z (A-Z lower-cased), digits and characters beyond ASCII; the
    features are all runs of 1 to `longest` words. Null texts count as empty and have none.
    A text is held whole with about twelve bytes for each of its own.
    """
    schema = T.StructType(
        [
            docs.schema[key],
            T.StructField("n_words", T.LongType()),
            T.StructField("n_features", T.LongType()),
            T.StructField("buckets", T.ArrayType(T.IntegerType())),
            T.StructField("counts", T.ArrayType(T.IntegerType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            n = batch.num_rows
            scan = Scan(*_buffers(batch.column(1)))
            found = [scan.ngrams(size) for size in range(1, longest + 1)]
            pairs = np.concatenate([doc * buckets + crc % np.uint32(buckets) for doc, crc in found])
            pairs, counts = np.unique(pairs, return_counts=True)
            stops = np.searchsorted(pairs, np.arange(n + 1) * buckets).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.bincount(scan.doc, minlength=n)),
                    pa.array(np.bincount(np.concatenate([doc for doc, _ in found]), minlength=n)),
                    pa.ListArray.from_arrays(stops, (pairs % buckets).astype(np.int32)),
                    pa.ListArray.from_arrays(stops, counts.astype(np.int32)),
                ],
                schema.names,
            )

    return docs.select(key, "text").mapInArrow(run, schema)


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of lists, and where each list starts and the last one ends."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]


def bucket_counts(found: DataFrame, buckets: int, name: str) -> DataFrame:
    """(bucket, name): occurrences of each bucket in all texts, added up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            np.add.at(total, _flat(batch.column(0))[0], _flat(batch.column(1))[0])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", name])

    counted = found.select("buckets", "counts").mapInArrow(run, f"bucket int, {name} bigint")
    return counted.groupBy("bucket").agg(F.sum(name).alias(name))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket, in thousandths of a nat, rounded down; 0 where the raw texts have none."""
    s, t = bucket_counts(raw, buckets, "s"), bucket_counts(target, buckets, "t")
    counts = np.zeros((buckets, 2), np.int64)
    # at most `buckets` rows
    for row in s.join(t, "bucket", "full").collect():
        counts[row.bucket] = row.s or 0, row.t or 0
    s_all, t_all = (float(n + buckets) for n in counts.sum(axis=0))
    gained = np.zeros(buckets, np.int64)
    for bucket in np.flatnonzero(counts[:, 0]):
        s_one, t_one = counts[bucket] + 1.0
        gained[bucket] = math.floor(1000 * math.log(t_one * s_all / (s_one * t_all)))
    return gained


def weights(found: DataFrame, gained: np.ndarray, key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_features, weight): the summed gains of each text."""
    shared = found.sparkSession.sparkContext.broadcast(gained)
    schema = T.StructType([found.schema[c] for c in (key, "n_words", "n_features")] + [T.StructField("weight", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, stops = _flat(batch.column(3))
            sums = np.concatenate([[0], np.cumsum(shared.value[ids] * _flat(batch.column(4))[0])])
            weight = pa.array(sums[stops[1:]] - sums[stops[:-1]])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], weight], schema.names)

    return found.select(key, "n_words", "n_features", "buckets", "counts").mapInArrow(run, schema)


def resampled(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row of docs; rank is null if it is not drawn.

    `percent` of the documents with at least `least_words` words are drawn, those with the
    highest scores, ties to the smaller doc_id (null last), then to more features. Null and
    empty texts have no features and weight 0. Rows that repeat a doc_id have the same noise
    and are drawn one by one; a null doc_id is an empty text in the seed. Columns besides
    doc_id and text are not looked at, nor are those of `target` besides text. Without
    documents there are no rows, without a target every gain is taken against zero counts.
    """
    found = stored(features(docs, "doc_id", longest, buckets), "ngram-buckets")
    wanted = target.select(F.lit(0).alias("item"), "text")
    gained = gains(found, features(wanted, "item", longest, buckets), buckets)
    scored = weights(found, gained)

    seeded = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(seeded, 256), 1, 8), 16, 10).cast("bigint")
    uniform = (h + F.lit(0.5)) / F.lit(4294967296.0)
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log(uniform)))
    judged = scored.select(
        "doc_id",
        "n_features",
        "weight",
        (F.col("weight") + noise).alias("score"),
        (F.col("n_words") >= least_words).alias("fit"),
    )
    order = [F.desc("fit"), F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("n_features"), F.desc("weight")]
    placed = numbered(judged, order, "place")
    drawn = placed.where("fit").count() * percent // 100
    rank = F.when(F.col("fit") & (F.col("place") < drawn), F.col("place") + 1)
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
