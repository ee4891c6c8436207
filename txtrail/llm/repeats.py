"""Repeated byte strings: maximal repeats from the common-prefix interval tree of a sparse,
enhanced suffix array that is dealt out by content.

Anchors. In every window of `least` bytes the rightmost smallest hash of a K-byte gram
marks an anchor, so equal windows have equal anchors at equal offsets. Suffixes are taken
at anchors only. Anchors whose gram hash occurs once in the corpus cannot lie in a repeat
and go away first; each of the others keeps just the bytes of the windows it stands for.

Tree. Anchors with one hash share their first K bytes and form one bucket of the suffix
array. Inside a bucket the suffixes are sorted, their common prefixes computed, and a
stack-scan yields the intervals of the tree: right-maximal repeats with all occurrences.
The contexts to the left of an interval, read backwards, are split by the same scan: where
they are diverse, every class of equal left extension is a maximal repeat of its own.

Copies of a whole text are found by hash first, and only the first one is searched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txtrail.llm.common import join_groups, partitions_for, sliced
from txtrail.session import checkpointed

LEAST = 100
GRAM = 24
# Text per bucket of anchors, and anchors per bucket of the suffix array.
BUCKET_BYTES = 8 << 20
BUCKET_ANCHORS = 25_000
# Anchors a task holds before it deals them out.
HELD = 1 << 19
# A hash with more anchors is compared window by window over all tasks.
HOT_ANCHORS = 20_000
# Tasks that the occurrences of one frequent window are dealt to.
SALTS = 16
LAST = (1 << 63) - 1  # orders documents without an id behind all others

BASE = 0x9E3779B97F4A7C15
STRETCH = 1 << 18
MIX = 0x9E3779B97F4A7C15  # deals the two parts of an anchor's hash out evenly

# 32 bits of the hash, which tell anchors of one bucket apart; a false match only costs time
ANCHOR = np.dtype([("h", "<u4"), ("t", "<i8"), ("pos", "<i4"), ("lo", "u1"), ("hi", "u1")])
KNOWN = 0x80  # on hi: the task saw the hash twice


# --- anchors ---------------------------------------------------------------------


def gram_hashes(data: np.ndarray, gram: int, powers: np.ndarray, inverses: np.ndarray) -> np.ndarray:
    """Hash of the gram that starts at each place."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
        h = (sums[gram:] - sums[:-gram]) * inverses[: len(data) - gram + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """The last place of the smallest hash in the window that starts at each place."""
    low, at, span = h, np.arange(len(h), dtype=np.int32), 1
    while span * 2 <= width:
        later = low[span:] <= low[:-span]
        low, at = np.where(later, low[span:], low[:-span]), np.where(later, at[span:], at[:-span])
        span *= 2
    rest = width - span
    return np.where(low[rest:] <= low[: len(low) - rest], at[rest:], at[: len(at) - rest])


class Anchors:
    """Finds the anchors of texts; powers of the hash base are kept for all of them."""

    def __init__(self, least: int, gram: int, stretch: int = STRETCH) -> None:
        self.least, self.gram, self.width, self.stretch = least, gram, least - gram + 1, stretch
        with np.errstate(over="ignore"):
            n = stretch + 2 * least
            one = np.ones(1, np.uint64)
            self.powers = np.concatenate([one, np.cumprod(np.full(n, BASE, np.uint64))])
            inverse = np.uint64(pow(BASE, -1, 1 << 64))
            self.inverses = np.concatenate([one, np.cumprod(np.full(n, inverse, np.uint64))])

    def of(self, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(hash, place, smallest and largest offset of the windows it stands for)."""
        for start in range(0, max(len(data) - self.least + 1, 0), self.stretch):
            part = data[start : start + self.stretch + self.least - 1]
            h = gram_hashes(part, self.gram, self.powers, self.inverses)
            at = window_minima(h, self.width)
            runs = np.nonzero(np.concatenate([[True], at[1:] != at[:-1]]))[0]
            last = np.concatenate([runs[1:], [len(at)]]) - 1
            place = at[runs]
            yield h[place], place + start, place - last, place - runs


def anchor_rows(texts: DataFrame, least: int, gram: int, buckets: int, held: int, stretch: int) -> DataFrame:
    """(bucket, anchors, owners): packed anchors, dealt by hash.

    A hash that a task sees twice is known to repeat. All its anchors but one are then
    passed on by any bucket, with their own bucket in `owners`, so a frequent hash sends
    its bucket one anchor a task.
    """

    def dealt(hashes: np.ndarray, anchors: np.ndarray, salt: int) -> pa.RecordBatch:
        order = np.lexsort((anchors["pos"], anchors["t"], hashes))
        hashes, anchors = hashes[order], anchors[order]
        fresh = np.concatenate([[True], hashes[1:] != hashes[:-1]])
        sizes = np.diff(np.concatenate([np.nonzero(fresh)[0], [len(anchors)]]))
        anchors["hi"] |= np.repeat(np.where(sizes > 1, KNOWN, 0), sizes).astype(np.uint8)
        owner = ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        dealt_to = np.where(fresh, owner, buckets + salt)
        order = np.argsort(dealt_to, kind="stable")
        anchors, owner, dealt_to = anchors[order], owner[order], dealt_to[order]
        cuts = np.nonzero(np.concatenate([[True], dealt_to[1:] != dealt_to[:-1]]))[0]
        packed = [p.tobytes() for p in np.split(anchors, cuts[1:])]
        owners = [p.tobytes() if d >= buckets else b"" for p, d in zip(np.split(owner, cuts[1:]), dealt_to[cuts].tolist())]
        return pa.RecordBatch.from_arrays(
            [pa.array(dealt_to[cuts]), pa.array(packed, pa.binary()), pa.array(owners, pa.binary())], ["bucket", "anchors", "owners"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Anchors(least, gram, stretch)
        hashes: list[np.ndarray] = []
        found: list[np.ndarray] = []
        seen: set[int] = set()
        n = salt = 0
        for batch in sliced(batches):
            for t, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if t in seen or not text.is_valid:
                    continue
                seen.add(t)
                for h, place, low, high in finder.of(np.frombuffer(text.as_buffer(), np.uint8)):
                    rows = np.empty(len(h), ANCHOR)
                    rows["h"], rows["t"], rows["pos"], rows["lo"], rows["hi"] = h & np.uint64(0xFFFFFFFF), t, place, low, high
                    hashes.append(h)
                    found.append(rows)
                    n += len(h)
            if n >= held:
                yield dealt(np.concatenate(hashes), np.concatenate(found), salt % buckets)
                hashes, found, n, salt = [], [], 0, salt + 1
                seen = seen if len(seen) < 1_000_000 else set()
        if n:
            yield dealt(np.concatenate(hashes), np.concatenate(found), salt % buckets)

    return texts.select("t", "text").mapInArrow(run, "bucket bigint, anchors binary, owners binary")


def repeated_anchors(texts: DataFrame, least: int, gram: int, buckets: int, held: int, stretch: int) -> DataFrame:
    """(h, t, pos, lo, hi): anchors whose hash has another anchor; h is bucket and hash."""

    def run(group: pa.Table) -> pa.Table:
        bucket = group["bucket"][0].as_py()
        anchors = np.concatenate([np.frombuffer(b.as_buffer(), ANCHOR) for c in group["anchors"].chunks for b in c])
        if bucket < buckets:
            windows = anchors["hi"] & np.uint8(KNOWN - 1)
            anchors = anchors[np.lexsort((windows, anchors["lo"], anchors["pos"], anchors["t"], anchors["h"]))]
            owner = np.full(len(anchors), bucket, np.int64)
            same = anchors["h"][1:] == anchors["h"][:-1]
            place = same & (anchors["t"][1:] == anchors["t"][:-1]) & (anchors["pos"][1:] == anchors["pos"][:-1])
            windows = anchors["hi"] & np.uint8(KNOWN - 1)
            copy = place & (anchors["lo"][1:] == anchors["lo"][:-1]) & (windows[1:] == windows[:-1])
            known = anchors["hi"] >= KNOWN
            starts = np.nonzero(np.concatenate([[True], ~same]))[0]
            sizes = np.diff(np.concatenate([starts, [len(anchors)]]))
            distinct = np.add.reduceat(np.concatenate([[True], ~place]).astype(int), starts)
            repeated = (distinct > 1) | np.logical_or.reduceat(known, starts)
            chosen = np.repeat(repeated, sizes) & np.concatenate([[True], ~copy])
            anchors, owner = anchors[chosen], owner[chosen]
        else:
            owner = np.concatenate([np.frombuffer(b.as_buffer(), "<i8") for c in group["owners"].chunks for b in c])
        return pa.table(
            {
                "h": pa.array(owner << 32 | anchors["h"].astype(np.int64)),
                "t": pa.array(np.ascontiguousarray(anchors["t"])),
                "pos": pa.array(np.ascontiguousarray(anchors["pos"])),
                "lo": pa.array(anchors["lo"].astype(np.int32)),
                "hi": pa.array((anchors["hi"] & np.uint8(KNOWN - 1)).astype(np.int32)),
            }
        )

    rows = anchor_rows(texts, least, gram, buckets, held, stretch)
    return rows.groupBy("bucket").applyInArrow(run, "h bigint, t bigint, pos int, lo int, hi int")


# --- tree ------------------------------------------------------------------------


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(first, last, depth) of each common-prefix interval of at least that depth."""
    stack: list[tuple[int, int]] = [(0, 0)]
    for i in range(1, len(lcp) + 2):
        depth = lcp[i - 1] if i <= len(lcp) else 0
        first = i - 1
        while stack[-1][1] > depth:
            first, d = stack.pop()
            if d >= least:
                yield first, i - 1, d
        if stack[-1][1] < depth:
            stack.append((first, depth))


def words(rows: np.ndarray) -> list[np.ndarray]:
    """Rows of bytes as columns of big-endian words, the last first, as lexsort takes them."""
    pad = -rows.shape[1] % 8
    padded = np.pad(rows, ((0, 0), (0, pad)))
    return list(padded.view(">u8").astype(np.uint64).T[::-1])


def common(rows: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows a and b, pair by pair."""
    differ = rows[a] != rows[b]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.minimum(first, np.minimum(lengths[a], lengths[b]))


def maximal_repeats(
    h: np.ndarray, right: np.ndarray, n_right: np.ndarray, left: np.ndarray, n_left: np.ndarray, least: int
) -> Iterator[tuple[np.ndarray, int, int]]:
    """(occurrences, bytes to the left, bytes to the right) of each maximal repeat.

    `right` holds the bytes from each anchor on, `left` those before it, read backwards.
    """
    m = len(h)
    suffixes = np.lexsort((*words(right), h))
    prefixes = np.lexsort((*words(left), h))
    rank = np.empty(m, np.int64)
    rank[prefixes] = np.arange(m)

    def neighbours(order: np.ndarray, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        a, b = order[:-1], order[1:]
        return np.where(h[a] == h[b], common(rows, lengths, a, b), 0)

    lcp = neighbours(suffixes, right, n_right)
    left_lcp = neighbours(prefixes, left, n_left)
    beside = common(left, n_left, suffixes[:-1], suffixes[1:])
    sorted_h = h[suffixes]
    starts = np.nonzero(np.concatenate([[True], sorted_h[1:] != sorted_h[:-1]]))[0]
    sizes = np.diff(np.concatenate([starts, [m]]))
    most_left = left.shape[1]
    for start in starts[sizes == 2].tolist():
        if lcp[start] + beside[start] >= least:
            yield suffixes[start : start + 2], int(beside[start]), int(lcp[start])
    for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        for a, b, depth in intervals(lcp[start : start + size - 1].tolist(), least - most_left):
            a, b = a + start, b + start
            members = suffixes[a : b + 1]
            if b == a + 1:
                shared = int(beside[a])
                if shared + depth >= least:
                    yield members, shared, depth
                continue
            shared = int(beside[a:b].min())
            if shared + depth >= least:
                yield members, shared, depth
            if shared >= n_left[members].max():
                continue  # one left context: nothing extends further
            places = np.sort(rank[members])
            between = np.minimum.reduceat(left_lcp, places[:-1])
            between[-1] = left_lcp[places[-2] : places[-1]].min()
            for c, d, extent in intervals(between.tolist(), max(least - depth, shared + 1)):
                yield prefixes[places[c : d + 1]], extent, depth


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins."""
    large = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    begins = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column)]
    return np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8), begins.astype(np.int64)


def packed_contexts(joined: DataFrame, least: int, buckets: int) -> DataFrame:
    """(bucket, n, heads, bytes): anchors with the bytes of their windows, dealt by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            docs, ts = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            data, begins = text_bytes(batch.column(2))
            listed = batch.column(3)
            row = np.repeat(np.arange(len(docs)), listed.value_lengths().to_numpy(zero_copy_only=False))
            h, pos, low, high = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in listed.flatten().flatten())
            n = high - low + least
            owner = ((h.view(np.uint64) * np.uint64(MIX)) >> np.uint64(20)).astype(np.int64) % buckets
            order = np.argsort(owner, kind="stable")
            heads = np.stack([h, docs[row], ts[row], pos, high, n], axis=1)[order]
            begin, n, owner = (begins[row] + pos - high)[order], n[order], owner[order]
            cuts = np.nonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))[0]
            for first, last in zip(cuts.tolist(), [*cuts[1:].tolist(), len(owner)]):
                parts = n[first:last]
                place = np.repeat(begin[first:last] - (np.cumsum(parts) - parts), parts) + np.arange(parts.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(owner[first : first + 1]),
                        pa.array([heads[first:last].tobytes()], pa.binary()),
                        pa.array([data[place].tobytes()], pa.binary()),
                    ],
                    ["bucket", "heads", "bytes"],
                )

    return joined.select("doc", "t", "text", "anchors").mapInArrow(run, "bucket bigint, heads binary, bytes binary")


def unpacked(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Heads, and the place of each context in the bytes of all."""
    heads = np.concatenate([np.frombuffer(b.as_buffer(), np.int64).reshape(-1, 6) for c in group["heads"].chunks for b in c])
    data = np.concatenate([np.frombuffer(b.as_buffer(), np.uint8) for c in group["bytes"].chunks for b in c])
    return heads, data, np.concatenate([[0], np.cumsum(heads[:, 5])[:-1]])


OCCURRENCES = "group string, doc bigint, t bigint, start int, length int, earliest boolean"


def tree_repeats(contexts: DataFrame, least: int, gram: int) -> DataFrame:
    """Every occurrence of every maximal repeat of at least `least` bytes around an anchor."""
    most_left = least - gram

    def run(group: pa.Table) -> pa.Table:
        heads, data, at = unpacked(group)
        # repeated rows; an anchor has one row for its windows on each side of a stretch's end,
        # which share fewer than `least` bytes and so no repeat
        _, one = np.unique(heads, axis=0, return_index=True)
        heads, at = heads[one], at[one]
        h, doc, t, pos, n_left, n = heads.T
        n_right = n - n_left
        reach = np.arange(least)
        padded = np.concatenate([data, np.zeros(least, np.uint8)])
        right = padded[at[:, None] + n_left[:, None] + reach] * (reach < n_right[:, None])
        back = np.arange(most_left)
        left = padded[np.maximum(at[:, None] + n_left[:, None] - 1 - back, 0)] * (back < n_left[:, None])
        order = np.lexsort((pos, t, doc))
        age = np.empty(len(order), np.int64)
        age[order] = np.arange(len(order))
        names, members, starts, lengths, earliest = [], [], [], [], []
        bucket = group["bucket"][0].as_py()
        for number, (rows, before, behind) in enumerate(maximal_repeats(h, right, n_right, left, n_left, least)):
            names += [f"{bucket}-{number}"] * len(rows)
            members.append(rows)
            starts.append(pos[rows] - before)
            lengths += [before + behind] * len(rows)
            earliest.append(age[rows] == age[rows].min())
        none = [np.empty(0, np.int64)]
        rows = np.concatenate(members or none)
        return pa.table(
            {
                "group": pa.array(names, pa.string()),
                "doc": pa.array(doc[rows]),
                "t": pa.array(t[rows]),
                "start": pa.array(np.concatenate(starts or none).astype(np.int32)),
                "length": pa.array(lengths, pa.int32()),
                "earliest": pa.array(np.concatenate(earliest or none).astype(bool)),
            }
        )

    return contexts.groupBy("bucket").applyInArrow(run, OCCURRENCES)


def window_repeats(contexts: DataFrame, least: int) -> DataFrame:
    """The same for frequent anchors: each window is grouped by its 128-bit hash, combined in
    the task before the shuffle, so no task meets all occurrences of an anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                heads, data, at = unpacked(pa.Table.from_batches([batch.slice(row, 1)]))
                raw = data.tobytes()
                found = [
                    (hashlib.blake2b(raw[a + i : a + i + least], digest_size=16).digest(), doc, t, pos - before + i)
                    for (_, doc, t, pos, before, n), a in zip(heads.tolist(), at.tolist())
                    for i in range(n - least + 1)
                ]
                columns = zip(*found) if found else ([], [], [], [])
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["w", "doc", "t", "start"])

    # one lazy plan, so that the texts behind the contexts are shuffled once for all uses
    windows = contexts.mapInArrow(run, "w binary, doc bigint, t bigint, start int")
    ones = (
        windows.groupBy("w")
        .agg(F.min(F.struct("doc", "t", "start")).alias("one"), F.count("*").alias("n"))
        .where("n > 1")
        .withColumn("salt", F.explode(F.expr(f"sequence(0, {SALTS - 1})")))
    )
    salted = windows.withColumn("salt", F.pmod(F.xxhash64("doc", "start"), F.lit(SALTS)).cast("int"))
    return salted.join(ones, ["w", "salt"]).select(
        F.hex("w").alias("group"), "doc", "t", "start", F.lit(least).alias("length"),
        (F.struct("doc", "t", "start") == F.col("one")).alias("earliest"),
    )


# --- whole corpus ----------------------------------------------------------------


def _order(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("bigint"), F.lit(LAST))


def identified(docs: DataFrame, rest: list[str] | None = None) -> DataFrame:
    """(doc, t, text): order of the document and number of its text."""
    return docs.select(
        *([F.struct(*rest).alias("rest")] if rest else []),
        _order(F.col("doc_id")).alias("doc"), F.xxhash64(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("t"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def repeat_groups(
    docs: DataFrame, least: int = LEAST, gram: int = GRAM, hot_anchors: int = HOT_ANCHORS, held: int = HELD,
    stretch: int = STRETCH,
) -> tuple[DataFrame, DataFrame]:
    """(first copies, occurrences): the first document (doc, t) of each text, and every
    occurrence of every maximal repeat in them as (group, doc, t, start, length, earliest).

    A repeat longer than two windows appears once around each of its anchors, cut to the
    windows the anchor stands for; together these cover it. Documents are ordered by
    doc_id, null last, then by the hash of the text.
    """
    if not 0 < gram <= least <= gram + 127:
        raise ValueError("gram <= least <= gram + 127")
    texts = identified(docs)
    firsts = checkpointed(texts.groupBy("t").agg(F.min("doc").alias("doc"), F.max(F.octet_length("text")).alias("bytes")))
    total = firsts.agg(F.sum("bytes").alias("n")).first()
    buckets = partitions_for((total and total.n) or 0, BUCKET_BYTES, 8)
    anchors = checkpointed(repeated_anchors(texts, least, gram, buckets, held, stretch))
    n = anchors.count()
    hot = checkpointed(anchors.groupBy("h").agg(F.count("*").alias("n_h")).where(F.col("n_h") > hot_anchors))

    def contexts(chosen: DataFrame) -> DataFrame:
        listed = chosen.groupBy("t").agg(F.collect_list(F.struct("h", "pos", "lo", "hi")).alias("anchors"))
        where = listed.join(firsts.select("t", "doc"), "t")
        joined = texts.select("doc", "t", "text").join(where, ["t", "doc"])
        return packed_contexts(joined, least, partitions_for(n, BUCKET_ANCHORS, 8))

    if hot.isEmpty():
        return firsts, tree_repeats(contexts(anchors), least, gram)
    marked = checkpointed(join_groups(anchors, hot, "h", "n_h"))
    usual = tree_repeats(contexts(marked.where("n_h is null")), least, gram)
    return firsts, usual.union(window_repeats(contexts(marked.where("n_h is not null")), least))


def without_repeats(docs: DataFrame, least: int = LEAST, rest: list[str] | None = None, **options: int) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): each whole text without the bytes of
    strings of `least` bytes that also start earlier, in UTF-8; kept is binary. With `rest`,
    a struct column of that name holds these columns of the row.

    Null texts count as empty. A later copy of a whole text loses everything, unless it is
    shorter than `least`. Rows that repeat a doc_id with the same text are one document and
    get the same result. Among different texts with one doc_id the hash of the text says
    which is earlier; documents without a doc_id come last, one text counting once. Columns
    besides doc_id and text are not looked at.
    """
    firsts, occurrences = repeat_groups(docs, least, **options)
    gone = (
        occurrences.where("not earliest")
        .groupBy("t", "doc")
        .agg(F.collect_set(F.shiftleft(F.col("start").cast("bigint"), 32) + F.col("length")).alias("spans"))
    )
    known = firsts.select("t", "doc").join(gone, ["t", "doc"], "left").select("t", "doc", "spans", F.lit(True).alias("first"))
    texts = identified(docs, rest)
    # without other columns the texts are the same rows that the contexts were cut from, and
    # Spark reuses their shuffle
    doc_id = F.nullif(F.col("doc"), F.lit(LAST)).cast(docs.schema["doc_id"].dataType).alias("doc_id")
    joined = texts.join(known, ["t", "doc"], "left").select(doc_id, "text", "spans", "first", *(["rest"] if rest else []))
    schema = T.StructType(
        [
            docs.schema["doc_id"],
            *[T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")],
            T.StructField("kept", T.BinaryType()),
            *([joined.schema["rest"]] if rest else []),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            sizes = batch.column(2).value_lengths().fill_null(0).to_pylist()
            spans = batch.column(2).flatten().to_pylist()
            at = 0
            for text, size, first in zip(batch.column(1), sizes, batch.column(3)):
                data = text.as_buffer().to_pybytes()
                taken = [(x >> 32, (x >> 32) + (x & 0xFFFFFFFF)) for x in spans[at : at + size]]
                at += size
                if not first.is_valid and len(data) >= least:
                    taken = [(0, len(data))]
                rows.append(cut(data, taken))
            columns = list(zip(*rows)) if rows else [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            made = [pa.array(list(c), k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made, *batch.columns[4:]], schema.names)

    return joined.mapInArrow(run, schema)


def cut(data: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, int, bytes]:
    """Bytes, removed bytes, removed runs and what is left."""
    kept, at, removed, runs, end = [], 0, 0, 0, -1
    for start, stop in sorted(spans):
        if start > end:
            kept.append(data[at:start])
            runs += 1
            at = end = start
        if stop > end:
            removed += stop - end
            at = end = stop
    kept.append(data[at:])
    return len(data), removed, runs, b"".join(kept)
