"""Near duplicates by SimHash fingerprints whose segments are decoded with the Golay code.

A fingerprint is cut into three segments of 21 or 22 bits. The perfect (23, 12) Golay
code maps a segment to its nearest codeword, at most 3 bits away, and, where the segment
lies 3 bits away, to 5 more codewords at 4 bits. Two segments that differ in one bit share
the nearest codeword of one among the codewords of the other; two that differ in two bits
share one of their codewords.

Fingerprints that differ in 3 bits or fewer have at least two segments with at most one
error (pigeonhole), so a key is a pair of codeword indices, 24 bits, of two segments.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txtrail.llm.common import SLICE_CHARS, components, join_groups, marked_by, release_memory, sliced, slices
from txtrail.session import checkpointed

SPACE = re.compile(rb"[\x20\x09-\x0d]")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SEED = 42
MAX_BITS = 3

# Words of a text are taken up in steps of this many bytes.
STEP_BYTES = 1 << 20
# A key with more pairs than this is compared in blocks of BLOCK rows, one task each.
HOT_PAIRS = 4_000_000
BLOCK = 4096

# --- fingerprints ----------------------------------------------------------------


def word_runs(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in runs from bounded stretches of it."""
    start = 0
    while start < len(data):
        cut = SPACE.search(data, start + STEP_BYTES)
        stop = cut.start() if cut else len(data)
        words = data[start:stop].split()
        if words:
            yield words
        start = stop


def shingle_hashes(data: bytes, size: int) -> Iterator[np.ndarray]:
    """XXH64 of each shingle of `size` words, of all words where there are fewer."""
    digest = xxhash.xxh64_intdigest
    last: list[bytes] = []
    seen = False
    for words in word_runs(data):
        words = last + words
        if len(words) >= size:
            seen = True
            joined = map(b" ".join, zip(*(words[i:] for i in range(size))))
            yield np.fromiter((digest(s, SEED) for s in joined), np.uint64)
            last = words[len(words) - size + 1 :]
        else:
            last = words
    if last and not seen:
        yield np.array([digest(b" ".join(last), SEED)], np.uint64)


def mixed(hashes: np.ndarray, stream: int) -> np.ndarray:
    """Another 64 bits of a hash; stream 0 is the hash itself."""
    if stream == 0:
        return hashes
    with np.errstate(over="ignore"):
        x = hashes + np.uint64((0x9E3779B97F4A7C15 * stream) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Fingerprint:
    """Counts, per bit, the hashes that have it; a bit is set if over half of them do."""

    def __init__(self, words64: int = 1) -> None:
        self.counts = np.zeros((words64, 64), np.int64)
        self.n = 0

    def add(self, hashes: np.ndarray) -> None:
        for at in range(0, len(hashes), 65_536):
            part = hashes[at : at + 65_536]
            self.n += len(part)
            for k in range(len(self.counts)):
                octets = np.ascontiguousarray(mixed(part, k)).view(np.uint8).reshape(-1, 8)
                bits = np.unpackbits(octets, axis=1, bitorder="little")
                self.counts[k] += bits.sum(axis=0, dtype=np.uint32)

    def value(self) -> np.ndarray:
        return np.packbits(self.counts * 2 > self.n, axis=1, bitorder="little").view(np.int64).ravel()


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): 64 bits of each whole text; zero where it has no word."""
    from pyspark.sql import types as T

    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            values = []
            for text in batch.column(1):
                fp = Fingerprint()
                if text.is_valid:
                    for hashes in shingle_hashes(text.as_buffer().to_pybytes().translate(LOWER), shingle):
                        fp.add(hashes)
                values.append(fp.value()[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


# --- Golay code ------------------------------------------------------------------

GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, bits
SEGMENT_PAIRS = ((0, 1), (0, 2), (1, 2))


def high_syndromes() -> np.ndarray:
    """Remainder by the generator of the words whose lowest 11 bits are zero."""
    table = np.arange(1 << 12, dtype=np.uint32) << np.uint32(11)
    for bit in range(22, 10, -1):
        table ^= ((table >> np.uint32(bit)) & np.uint32(1)) * np.uint32(GENERATOR << (bit - 11))
    return table


class Golay:
    """Codewords near a 23-bit word. Built once in each Python worker."""

    _only: Golay | None = None

    def __init__(self) -> None:
        self.high = high_syndromes()
        self.leader = np.zeros(2048, np.uint32)
        others: dict[int, list[int]] = {}
        for weight in range(5):
            for bits in itertools.combinations(range(23), weight):
                error = sum(1 << b for b in bits)
                syndrome = int(self.syndromes(np.uint32(error)))
                if weight < 4:
                    self.leader[syndrome] = error
                else:
                    others.setdefault(syndrome, []).append(error)
        # error patterns of up to six codewords; the leader again where there are fewer
        self.errors = np.repeat(self.leader[:, None], 6, axis=1)
        for syndrome, errors in others.items():
            self.errors[syndrome, 1 : 1 + len(errors)] = errors
        self.n_errors = np.array([1 + len(others.get(s, ())) for s in range(2048)])

    @classmethod
    def get(cls) -> Golay:
        cls._only = cls._only or cls()
        return cls._only

    def syndromes(self, words: np.ndarray) -> np.ndarray:
        return self.high[words >> np.uint32(11)] ^ (words & np.uint32(0x7FF))

    def nearest(self, words: np.ndarray) -> np.ndarray:
        """Index of the codeword within 3 bits."""
        return (words ^ self.leader[self.syndromes(words)]) >> np.uint32(11)

    def near(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the codewords within 4 bits, and which of the six columns count."""
        syndromes = self.syndromes(words)
        return (words[:, None] ^ self.errors[syndromes]) >> np.uint32(11), (
            np.arange(6) < self.n_errors[syndromes][:, None]
        )


def segments(fps: np.ndarray) -> list[np.ndarray]:
    unsigned = fps.astype(np.int64).view(np.uint64)
    return [((unsigned >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.uint32) for at, n in SEGMENTS]


def golay_keys(fps: np.ndarray, role: str) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): "probe" keys meet "build" keys at up to one error in each of two
    segments; "both" keys meet each other at up to two errors in each; "nearest" is one
    key for each pair of segments."""
    code = Golay.get()
    parts = segments(fps)
    single = [code.nearest(p).astype(np.int64)[:, None] for p in parts]
    multiple = [(i.astype(np.int64), ok) for i, ok in map(code.near, parts)]
    one = np.ones((len(fps), 1), bool)
    rows, keys = [], []
    for n, (a, b) in enumerate(SEGMENT_PAIRS):
        left = (single[a], one) if role in ("build", "nearest") else multiple[a]
        right = (single[b], one) if role in ("probe", "nearest") else multiple[b]
        joined = (n << 24) | (left[0][:, :, None] << 12) | right[0][:, None, :]
        row, i, j = np.nonzero(left[1][:, :, None] & right[1][:, None, :])
        rows.append(row)
        keys.append(joined[row, i, j])
    return np.concatenate(rows), np.concatenate(keys)


def keyed(fps: DataFrame, role: str, fp: str = "fp") -> DataFrame:
    """Each row once for each of its keys."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("key", T.LongType()), *fps.schema.fields])
    at = fps.columns.index(fp)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                rows, keys = golay_keys(batch.column(at).to_numpy(zero_copy_only=False), role)
                taken = batch.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *taken.columns], schema.names)

    return fps.mapInArrow(run, schema)


# --- links -----------------------------------------------------------------------


def distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def forest(a: np.ndarray, b: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Edges that connect what pairs (one of a, one of b) within max_bits connect."""
    values, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = both[: len(a)], both[len(a) :]
    label = np.arange(len(values))
    x, y = a.view(np.uint64), b.view(np.uint64)
    while True:
        before = label.copy()
        for at in range(0, len(x), 256):
            rows = slice(at, at + 256)
            linked = np.bitwise_count(x[rows, None] ^ y[None, :]) <= max_bits
            low = np.where(linked, label[right][None, :], len(values)).min(axis=1)
            np.minimum.at(label, left[rows], low)
            low = np.where(linked, label[left[rows]][:, None], len(values)).min(axis=0)
            np.minimum.at(label, right, low)
        label = label[label]
        if (label == before).all():
            break
    far = np.nonzero(label != np.arange(len(values)))[0]
    return list(zip(values[label[far]].tolist(), values[far].tolist()))


def hot_links(probe: DataFrame, build: DataFrame, hot: DataFrame, max_bits: int, block: int) -> DataFrame:
    """Links within hot keys: each block of probes meets each block of builds in a group of
    its own, which gives edges of a spanning forest and never its pairs."""

    def dealt(side: DataFrame, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
        return (
            side.join(hot, "key")
            .withColumn(own, F.pmod(F.xxhash64("fp"), blocks(own_n)).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), blocks(other_n) - 1)))
            .select("key", "pb", "bb", "fp")
        )

    left = dealt(probe, "pb", "n_probe", "bb", "n_build").withColumn("probe", F.lit(True))
    right = dealt(build, "bb", "n_build", "pb", "n_probe").withColumn("probe", F.lit(False))

    def run(group: pa.Table) -> pa.Table:
        fps, side = group["fp"].to_numpy(), group["probe"].to_numpy()
        edges = forest(fps[side], fps[~side], max_bits)
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    return left.union(right).groupBy("key", "pb", "bb").applyInArrow(run, "a bigint, b bigint")


def links(
    fps: DataFrame, max_bits: int = MAX_BITS, hot_pairs: int = HOT_PAIRS, block: int = BLOCK
) -> DataFrame:
    """(a, b): edges whose components are those of all fingerprints within max_bits, at most 3.

    `fps` has each fingerprint once. Within a key of at most hot_pairs pairs every link is
    an edge; the rest goes through `hot_links`.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("the keys cover up to 3 differing bits")
    probe, build = keyed(fps, "probe"), keyed(fps, "build")
    sizes = (
        probe.select("key", F.lit(1).alias("p"), F.lit(0).alias("b"))
        .union(build.select("key", F.lit(0).alias("p"), F.lit(1).alias("b")))
        .groupBy("key")
        .agg(F.sum("p").alias("n_probe"), F.sum("b").alias("n_build"))
    )
    hot = checkpointed(sizes.where(F.col("n_probe") * F.col("n_build") > hot_pairs))
    any_hot = not hot.isEmpty()
    cold = probe.join(hot, "key", "left_anti") if any_hot else probe
    near = (
        cold.select("key", F.col("fp").alias("a"))
        .join(build.select("key", F.col("fp").alias("b")), "key")
        .where((F.col("a") < F.col("b")) & (distance("a", "b") <= max_bits))
        .select("a", "b")
    )
    return near.union(hot_links(probe, build, hot, max_bits, block)) if any_hot else near


def near_components(
    docs: DataFrame, shingle: int = 3, max_bits: int = MAX_BITS, hot_pairs: int = HOT_PAIRS, block: int = BLOCK
) -> DataFrame:
    """(doc_id, fingerprint, component_id, fp) of each document, on whole texts.

    Texts that are null, empty or without a word have fingerprint zero and are linked like
    any other. Repeated rows come once each. component_id is the smallest doc_id of the
    component, null only where no document of it has one. Columns besides doc_id and text
    are not looked at.
    """
    rows = checkpointed(fingerprints(docs, shingle))
    firsts = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    roots = components(links(firsts.select("fp"), max_bits, hot_pairs, block))
    members = firsts.join(roots.withColumnRenamed("v", "fp"), "fp", "left").select(
        "fp", "first", "n", F.coalesce("root", "fp").alias("root")
    )
    members = checkpointed(members)
    smallest = checkpointed(
        members.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n_fps"))
    )
    named = join_groups(members, smallest, "root", "n_fps").select("fp", "n", "component_id")
    return join_groups(rows, checkpointed(named), "fp", "n").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp"
    )


# --- near duplicates of a similarity ---------------------------------------------

SIMILARITY = 0.8
WIDE = 4  # 64-bit words of the fingerprint that prunes
# Bits beyond the mean at the similarity that a pair may differ in and still be verified;
# the standard deviation is about 6.5 bits.
MARGIN = 44
# Further keys: so many, each of the smallest of so many differently mixed shingle hashes.
# All differ for a pair of Jaccard similarity 0.64 (cosine 0.8 by appending) in 0.2 %.
BANDS, BAND_MINIMA = 20, 3


def shingle_counts(data: bytes, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All shingle hashes of a text, the distinct ones and how often each occurs."""
    every = np.concatenate([np.empty(0, np.uint64), *shingle_hashes(data, size)])
    return every, *np.unique(every, return_counts=True)


def counts_digest(distinct: np.ndarray, counts: np.ndarray) -> int:
    """64 bits that tell shingle counts apart."""
    with np.errstate(over="ignore"):
        total = (mixed(distinct, 101) * counts.astype(np.uint64)).sum(dtype=np.uint64, keepdims=True)
    return int(mixed(total, 102).view(np.int64)[0])


def band_keys(distinct: np.ndarray) -> np.ndarray:
    """One key for each band; texts share it with their Jaccard similarity to the power of
    BAND_MINIMA as probability. None for a text without a word."""
    if not len(distinct):
        return np.empty(0, np.int64)
    factors = mixed(np.arange(1, BANDS * BAND_MINIMA + 1, dtype=np.uint64), 103) | np.uint64(1)
    low = np.full(len(factors), 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(distinct), 4096):
            low = np.minimum(low, (distinct[None, at : at + 4096] * factors[:, None]).min(axis=1))
        keys = np.arange(BANDS, dtype=np.uint64)
        for minima in low.reshape(BANDS, BAND_MINIMA).T:
            keys = mixed(keys ^ minima, 104)
    return keys.view(np.int64)


def wide_fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, g, u, s, m, bands): a digest of the shingle counts, 64 bits over the distinct
    words of each whole text, 256 bits over its shingles, their number and keys."""
    from pyspark.sql import types as T

    longs = [T.StructField(n, T.LongType()) for n in ("g", "u", *SHINGLE_BITS, "m")]
    schema = T.StructType([docs.schema["doc_id"], *longs, T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows, bands = [], []
            for text in batch.column(1):
                of_words, of_shingles = Fingerprint(), Fingerprint(WIDE)
                data = text.as_buffer().to_pybytes().translate(LOWER) if text.is_valid else b""
                digests = [xxhash.xxh64_intdigest(w, SEED) for w in {w for run_ in word_runs(data) for w in run_}]
                of_words.add(np.array(digests, np.uint64))
                every, distinct, counts = shingle_counts(data, shingle)
                of_shingles.add(every)
                rows.append([counts_digest(distinct, counts), of_words.value()[0], *of_shingles.value(), len(every)])
                bands.append(band_keys(distinct))
            columns = [pa.array(np.ascontiguousarray(c)) for c in np.array(rows, np.int64).reshape(-1, 3 + WIDE).T]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(bands, pa.list_(pa.int64()))], schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


SHINGLE_BITS = [f"s{i}" for i in range(WIDE)]
# Texts that meet one text in one group; a text with more pairs is sent to several groups.
HUB_PAIRS = 1000
# A block of texts that are compared with each other has about so many shingles and texts at most.
BLOCK_SHINGLES, BLOCK_TEXTS = 1 << 20, 2048
# Shingles that two texts share are looked up in steps of about so many.
STEP_SHARED = 1 << 20


def wide_distance(a: str, b: str) -> Column:
    return sum((distance(f"{a}.{s}", f"{b}.{s}") for s in SHINGLE_BITS), F.lit(0))


def met_by(groups: DataFrame, role: str) -> DataFrame:
    """Each group once for each Golay key of its words and each key of its shingles."""
    rest = [c for c in groups.columns if c not in ("u", "bands")]
    by_shingles = groups.select(F.explode("bands").alias("key"), *rest)
    return keyed(groups.select(*rest, "u"), role, "u").drop("u").union(by_shingles)


def similar_to_hub(rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b): the hub of a group and the texts of the group with that cosine similarity to it.

    `rows` has (hub, salt, other, g, v, text): a group is a hub and a salt, its hub comes
    first. One text besides the hub is looked at at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, low, known, norm = None, None, (np.empty(0, np.uint64), np.empty(0, np.int64)), 0
        for batch in sliced(batches):
            left, right = [], []
            columns = [batch.column(i) for i in range(5)]
            for i, (hub, salt, other, g, v) in enumerate(zip(*(c.to_pylist() for c in columns))):
                if not other and group == (hub, salt):
                    continue  # the hub again
                text = batch.column(5)[i]
                data = text.as_buffer().to_pybytes().translate(LOWER) if text.is_valid else b""
                _, distinct, counts = shingle_counts(data, shingle)
                if counts_digest(distinct, counts) != g:
                    continue  # another text under the same doc_id
                square = int((counts.astype(np.int64) ** 2).sum())
                if not other:
                    group, low, known, norm = (hub, salt), v, (distinct, counts.astype(np.int64)), square
                elif group == (hub, salt):
                    _, here, there = np.intersect1d(known[0], distinct, assume_unique=True, return_indices=True)
                    product = int((known[1][here] * counts[there]).sum())
                    # a similarity of just that value is not lost to rounding
                    if product and product * (1 + 1e-12) >= similarity * np.sqrt(float(norm) * float(square)):
                        left.append(low)
                        right.append(v)
            kind = batch.column(4).type
            yield pa.RecordBatch.from_arrays([pa.array(left, kind), pa.array(right, kind)], ["a", "b"])

    id_type = rows.schema["v"].dataType.simpleString()
    return rows.select("hub", "salt", "other", "g", "v", "text").mapInArrow(run, f"a {id_type}, b {id_type}")


def verified(docs: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b): the documents of those pairs whose shingle counts have that cosine similarity.

    `pairs` has (xv, xg, yv, yg), documents and their groups. Texts travel and not their
    shingles, which take several times the room: each x is the hub of groups of at most about
    HUB_PAIRS texts, so one with very many pairs is not bound to one task.
    """
    pairs = checkpointed(pairs.select("xv", "xg", "yv", "yg").distinct())
    sizes = checkpointed(pairs.groupBy("xg").agg(F.count("*").alias("n_pairs")))
    salts = F.ceil(F.col("n_pairs") / HUB_PAIRS)
    dealt = join_groups(pairs, sizes, "xg", "n_pairs").withColumn("salt", F.pmod(F.xxhash64("yg"), salts))
    hubs = dealt.select(F.col("xv").alias("v"), F.col("xg").alias("g"), F.col("xg").alias("hub"), "salt", F.lit(False).alias("other"))
    others = dealt.select(F.col("yv").alias("v"), F.col("yg").alias("g"), F.col("xg").alias("hub"), "salt", F.lit(True).alias("other"))
    asked = checkpointed(hubs.distinct().union(others))
    texts = docs.select(F.col("doc_id").alias("v"), "text")
    met = marked_by(texts, asked, "v").where("_marked").drop("_marked").join(asked, "v")
    grouped = met.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "other")
    return similar_to_hub(grouped, shingle, similarity).distinct()


def with_candidates(rows: DataFrame, keys: DataFrame, most: int, hot_rows: int) -> DataFrame:
    """(key, v): the rows that have a row of another component within `most` bits under their key.

    `rows` has (key, v, s, c), `keys` (key, c) of the same rows. Pairs are looked for and not
    listed: a row comes out once, whatever the number of its candidates. Keys of more than
    hot_rows rows are dealt out to several tasks.
    """
    sizes = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("c").alias("low"), F.max("c").alias("high"))
    hot = checkpointed(sizes.where(F.col("n") > hot_rows))
    apart = (F.col("x.v") != F.col("y.v")) & (F.col("x.c") != F.col("y.c")) & (wide_distance("x", "y") <= most)

    def found(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in on]
        return left.alias("x").join(right.alias("y"), [*same, apart], "left_semi").select("key", "v")

    if hot.isEmpty():
        return found(rows, rows, ["key"])
    cold = rows.join(F.broadcast(hot.select("key")), "key", "left_anti")
    mixed_keys = hot.where("low <> high").select("key", F.ceil(F.col("n") / hot_rows).cast("int").alias("parts"))
    dealt = rows.join(F.broadcast(mixed_keys), "key")
    left = dealt.withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int")).drop("parts")
    right = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return found(cold, cold, ["key"]).union(found(left, right, ["key", "part"]))


def similar_in_block(
    texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, sides: np.ndarray | None, similarity: float
) -> list[tuple[int, int]]:
    """Pairs of places whose shingle counts have that cosine similarity, as many as connect
    what all such pairs of different labels connect; of different sides, if there are any."""
    n = len(texts)
    owner = np.repeat(np.arange(n), [len(d) for d, _ in texts])
    shingles = np.concatenate([np.empty(0, np.uint64), *(d for d, _ in texts)])
    counts = np.concatenate([np.empty(0, np.int64), *(c for _, c in texts)]).astype(np.float64)
    norms = np.bincount(owner, counts**2, n)
    # places of each shingle are next to each other; those of one text alone meet nothing
    _, at, times = np.unique(shingles, return_inverse=True, return_counts=True)
    several = times[at] > 1
    owner, counts, at = owner[several], counts[several], at[several]
    order = np.argsort(at, kind="stable")
    holders, held = owner[order], counts[order]
    ends = np.cumsum(np.bincount(at, minlength=len(times)))
    starts = ends - np.bincount(at, minlength=len(times))
    bounds = np.searchsorted(owner, np.arange(n + 1))
    labels, pairs = labels.copy(), []
    # of two labels, one is not the most frequent one
    values, frequent = np.unique(labels, return_counts=True)
    for x in np.nonzero(labels != values[frequent.argmax()])[0] if n else []:
        own, mine = at[bounds[x] : bounds[x + 1]], counts[bounds[x] : bounds[x + 1]]
        lengths = ends[own] - starts[own]
        product, steps = np.zeros(n), np.cumsum(lengths) // STEP_SHARED
        for part in np.split(np.arange(len(own)), np.nonzero(np.diff(steps))[0] + 1):
            size = lengths[part]
            places = np.repeat(starts[own[part]] - np.cumsum(size) + size, size) + np.arange(size.sum())
            product += np.bincount(holders[places], np.repeat(mine[part], size) * held[places], n)
        # a similarity of just that value is not lost to rounding
        linked = (product > 0) & (product * (1 + 1e-12) >= similarity * np.sqrt(norms[x] * norms))
        if sides is not None:
            linked &= sides != sides[x]
        for y in np.nonzero(linked & (labels != labels[x]))[0]:
            if labels[y] != labels[x]:
                pairs.append((int(x), int(y)))
                labels[labels == labels[y]] = labels[x]
    return pairs


def verified_in_groups(
    docs: DataFrame, groups: DataFrame, shingle: int, similarity: float, shingles: int, texts: int
) -> DataFrame:
    """(a, b): documents of one group with that cosine similarity, as many as connect what all
    such pairs of different components in a group connect.

    `groups` has (hub, v, g, c, m): hub names the group. Pairs are neither rows nor messages:
    a group is cut into blocks of about so many shingles and texts at most, and each two blocks
    meet in a task, which holds their texts and gives edges of a forest.
    """
    sizes = checkpointed(groups.groupBy("hub").agg(F.count("*").alias("n_hub"), F.sum("m").alias("m_hub")))
    blocks = F.least("n_hub", F.greatest(F.ceil(F.col("n_hub") / texts), F.ceil(F.col("m_hub") / shingles), F.lit(1)))
    several = checkpointed(sizes.where("n_hub > 1").select("hub", "n_hub", blocks.cast("int").alias("blocks")))
    dealt = (
        join_groups(groups, several, "hub", "n_hub")
        .where("blocks is not null")
        .withColumn("own", F.pmod(F.xxhash64("g"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("hub", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "v", "g", "c")
    )
    asked = checkpointed(dealt)
    rows = docs.select(F.col("doc_id").alias("v"), "text")
    met = marked_by(rows, asked, "v").where("_marked").drop("_marked").join(asked, "v")
    kind = asked.schema["v"].dataType

    def run(group: pa.Table) -> pa.Table:
        known, found = {}, []
        for batch in (part for whole in group.to_batches() if whole.num_rows for part in slices(whole)):
            columns = (batch[c].to_pylist() for c in ("v", "g", "c", "own"))
            for text, v, g, c, own in zip(batch["text"], *columns):
                if (v, g) in known:
                    continue  # the same row again
                data = text.as_buffer().to_pybytes().translate(LOWER) if text.is_valid else b""
                _, distinct, counts = shingle_counts(data, shingle)
                if counts_digest(distinct, counts) != g:
                    continue  # another text under the same doc_id
                known[v, g] = (c, own)
                found.append((distinct, counts))
        ids = [v for v, _ in known]
        names = {c: n for n, c in enumerate(dict.fromkeys(c for c, _ in known.values()))}
        labels = np.array([names[c] for c, _ in known.values()], np.int64)
        sides = np.array([own for _, own in known.values()], np.int64)
        across = group["i"][0].as_py() != group["j"][0].as_py()
        pairs = similar_in_block(found, labels, sides if across else None, similarity)
        columns = [pa.array([ids[p[k]] for p in pairs], group.schema.field("v").type) for k in (0, 1)]
        if group.nbytes > SLICE_CHARS:
            release_memory()
        return pa.table(columns, ["a", "b"])

    return met.groupBy("hub", "i", "j").applyInArrow(run, f"a {kind.simpleString()}, b {kind.simpleString()}").distinct()


def similar_components(
    docs: DataFrame,
    shingle: int = 5,
    similarity: float = SIMILARITY,
    hot_rows: int = BLOCK,
    block_shingles: int = BLOCK_SHINGLES,
    block_texts: int = BLOCK_TEXTS,
) -> DataFrame:
    """(doc_id, component_id) of each document with a doc_id.

    Two documents are linked when the cosine similarity of their shingle counts is at least
    `similarity`. It is computed for pairs that meet by a key and whose 256-bit fingerprints
    over shingles differ in at most MARGIN bits more than the mean at that similarity: 96
    bits at 0.8. Such fingerprints are too far apart for keys, so documents meet by a second
    fingerprint over distinct words, which one changed word moves much less: its segments
    are decoded to all codewords within 4 bits, and documents meet where two segments
    differ in up to two bits each. An appended passage moves that fingerprint, too, so
    documents also meet by any of BANDS keys of smallest shingle hashes. Texts with equal
    shingle counts are one group.

    Links to the smallest document of a key come first; from then on only pairs of different
    components are compared, and never listed, neither before their texts are looked at nor
    after: documents with a candidate are found by a semi join, go once to the smallest of
    them that shares a key, and a group is compared within its task. Rows for a key are as
    narrow as they can be, as there are dozens of them for each document.
    """
    most = int(256 * np.arccos(similarity) / np.pi) + MARGIN
    docs = docs.where(F.col("doc_id").isNotNull())
    rows = checkpointed(wide_fingerprints(docs, shingle))
    bits = ["u", *SHINGLE_BITS, "m"]
    least = rows.groupBy("g").agg(F.min(F.struct("doc_id", *bits, "bands")).alias("low"), F.count("*").alias("n"))
    groups = checkpointed(least.select(F.col("low.doc_id").alias("v"), "g", *[f"low.{c}" for c in (*bits, "bands")], "n"))

    near = met_by(groups.select("v", "u", "bands"), "nearest")
    lowest = near.groupBy("key").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n_key"))
    # as a rule a key of shingles has one document
    shared = checkpointed(lowest.where("low < high").drop("high"))
    likely = marked_by(near, shared, "key").where("_marked").drop("_marked")
    meeting = checkpointed(join_groups(likely, shared, "key", "n_key").where("low is not null").select("key", "v", "low"))
    stars = meeting.where("low < v").select(F.col("low").alias("xv"), F.col("v").alias("yv")).distinct()
    sides = groups.select("v", F.struct("g", *SHINGLE_BITS).alias("of"))
    with_sides = (
        stars.join(sides.select(F.col("v").alias("xv"), F.col("of").alias("x")), "xv")
        .join(sides.select(F.col("v").alias("yv"), F.col("of").alias("y")), "yv")
    )
    close = with_sides.where(wide_distance("x", "y") <= most)
    first = checkpointed(verified(docs, close.select("xv", F.col("x.g").alias("xg"), "yv", F.col("y.g").alias("yg")), shingle, similarity))

    roots = components(first)
    marked = groups.drop("n", "bands").join(roots, "v", "left").withColumn("c", F.coalesce("root", "v")).drop("root")
    marked = checkpointed(marked)
    # a row goes on for each of its keys, so what only pairs need is looked up for these
    narrow = marked.select("v", *SHINGLE_BITS, "c", "u")
    golay = keyed(narrow, "both", "u").drop("u")
    # keys of shingles are no Golay keys, and those that one document has meet nothing
    of_shingles = meeting.where(~F.col("key").between(0, (len(SEGMENT_PAIRS) << 24) - 1)).select("key", "v")
    every = golay.union(of_shingles.join(narrow.drop("u"), "v").select(*golay.columns))
    keys = keyed(marked.select("c", "u"), "both", "u").select("key", "c").union(of_shingles.join(marked.select("v", "c"), "v").select("key", "c"))
    close = checkpointed(with_candidates(every, keys, most, hot_rows))
    # both documents of a pair are among the rows of their key, so they share its smallest one
    hubs = checkpointed(close.groupBy("key").agg(F.min("v").alias("hub"), F.count("*").alias("n_key")))
    met = join_groups(close, hubs, "key", "n_key").select("hub", "v").distinct().join(marked.select("v", "g", "c", "m"), "v")
    second = verified_in_groups(docs, checkpointed(met), shingle, similarity, block_shingles, block_texts)
    joined = components(first.union(second))
    named = groups.join(joined, "v", "left").select("g", "n", F.coalesce("root", "v").alias("component_id"))
    return join_groups(rows.select("doc_id", "g"), checkpointed(named), "g", "n").select("doc_id", "component_id")


def without_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs without those that have a smaller doc_id in their component.

    Rows without a doc_id cannot be told apart and stay, as do rows that repeat a doc_id
    that stays.
    """
    found = similar_components(docs, shingle, similarity)
    gone = checkpointed(found.where("doc_id <> component_id").select("doc_id").distinct())
    marked = marked_by(docs, gone, "doc_id")
    # texts that surely stay are not shuffled
    kept = marked.where(~F.col("_marked")).select(*docs.columns)
    return kept.union(marked.where("_marked").join(gone, "doc_id", "left_anti").select(*docs.columns))
