"""Prefix trie of conversations with subtree totals by time-forward processing.

Turns are told apart by 128-bit digests; a node is the exclusive or of the (place, digest)
hashes of its turns, so a prefix and the one before it are known wherever a turn is. Totals
go up by time-forward processing: nodes are sorted by level, deepest first, and each sends
its totals to its parent through a priority queue that spills. Subtrees of bounded size
are dealt out to shards; what they send to nodes above them is added up by Spark, and those
nodes, the ends of all shards, are processed in the same way.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txtrail.llm.common import join_groups, numbered, partitions_for, stored

BLOCK = 100
HEADS = 6

# A subtree with at most this many turns below it stays in one shard.
SHARD_TURNS = 1_000_000

# Messages that a queue holds in memory, and rows it reads back from a run at once.
QUEUE_ROWS = 1_000_000
RUN_ROWS = 1 << 16

# Turns of one conversation that are chained in one go.
STRETCH = 1 << 16

# Characters of joined ids that go on as one row.
IDS_CHARS = 1 << 20

MESSAGE = np.dtype([("id", np.int64), ("children", np.int64), ("leaves", np.int64), ("saved", np.int64)])


# ---- rebuilt conversations


def turn_places(turns: DataFrame) -> DataFrame:
    """(conv_id, place, digest, chars) of each turn, place from 0 in the order of the conversation.

    Order: turn, null first, then role, then text; null role and text are empty. Turns that
    are equal in all three follow each other. Turns without conv_id belong to no conversation
    and are left out. A conversation may be cut by the sort: its turns are placed by where
    its first one is.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # the length of the role comes first, so that the joined text can be read in one way only
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    narrow = stored(
        ordered.select("conv_id", digest.alias("digest"), F.length("text").alias("chars"), F.monotonically_increasing_id().alias("id")),
        "turns",
    )
    part = F.shiftright("id", 33)
    cut = narrow.groupBy("conv_id", part.alias("part")).agg(F.min("id").alias("first_id"), F.count("*").alias("turns"))
    # one row for each range that a conversation reaches into
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.withColumn("earlier", F.coalesce(F.sum("turns").over(earlier), F.lit(0))).select("conv_id", "part", "first_id", "earlier")
    joined = narrow.withColumn("part", part).join(starts, ["conv_id", "part"])
    return joined.select("conv_id", (F.col("id") - F.col("first_id") + F.col("earlier")).alias("place"), "digest", "chars")


def own_from(conv_id: Column, heads: int = HEADS) -> Column:
    """How many first turns of a conversation are replaced by those of its block's first one."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(heads))


def rebuilt(turns: DataFrame, block: int = BLOCK, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, digest, chars) of all rebuilt turns, depth from 1, and (conv_id, length).

    The first h turns come from conversation c - c % block, all if it has fewer and none if
    there is none, the others are the own ones behind the first h.
    """
    placed = stored(turn_places(turns), "turn-places")
    sizes = placed.groupBy("conv_id").agg(F.count("*").alias("turns"))
    base = F.col("conv_id") - F.col("conv_id") % block
    convs = sizes.select("conv_id", "turns", own_from(F.col("conv_id"), heads).alias("h"), base.alias("base"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("turns").alias("base_turns"))
    known = stored(
        convs.join(bases, "base", "left").select(
            "conv_id", "turns", "h", "base", F.least("h", F.coalesce("base_turns", F.lit(0))).alias("taken")
        ),
        "conversations",
    )
    # at most `heads` turns of a conversation serve its block, which has at most `block` members
    first = placed.where((F.col("place") < heads - 1) & (F.col("conv_id") % block == 0)).select(
        F.col("conv_id").alias("base"), "place", "digest", "chars"
    )
    taken = known.where("taken > 0").join(first, "base").where("place < taken").select(
        "conv_id", (F.col("place") + 1).alias("depth"), "digest", "chars"
    )
    own = placed.join(known.select("conv_id", "h", "taken"), "conv_id").where("place >= h").select(
        "conv_id", (F.col("place") - F.col("h") + F.col("taken") + 1).alias("depth"), "digest", "chars"
    )
    lengths = known.select("conv_id", (F.col("taken") + F.greatest(F.col("turns") - F.col("h"), F.lit(0))).alias("length"))
    return taken.union(own), lengths


def prefixes(rows: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Each row with the keys (k1, k2) of the prefix up to it and (p1, p2) of the one before.

    A key is the exclusive or of two 64-bit hashes over (depth, digest) of its turns. A
    conversation is chained in stretches; the keys of all stretches before are added on.
    """
    h1, h2 = F.xxhash64("depth", "digest"), F.xxhash64("digest", "depth", F.lit("second"))
    cut = rows.select("*", F.floor((F.col("depth") - 1) / stretch).alias("stretch"), h1.alias("h1"), h2.alias("h2"))
    whole = cut.groupBy("conv_id", "stretch").agg(F.bit_xor("h1").alias("s1"), F.bit_xor("h2").alias("s2"))
    earlier = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = whole.select(
        "conv_id",
        "stretch",
        F.coalesce(F.bit_xor("s1").over(earlier), F.lit(0)).alias("s1"),
        F.coalesce(F.bit_xor("s2").over(earlier), F.lit(0)).alias("s2"),
    )
    upto = Window.partitionBy("conv_id", "stretch").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    chained = cut.select("*", F.bit_xor("h1").over(upto).alias("c1"), F.bit_xor("h2").over(upto).alias("c2"))
    k1, k2 = F.col("c1").bitwiseXOR(F.col("s1")), F.col("c2").bitwiseXOR(F.col("s2"))
    return chained.join(starts, ["conv_id", "stretch"]).select(
        "conv_id",
        "depth",
        "chars",
        k1.alias("k1"),
        k2.alias("k2"),
        k1.bitwiseXOR(F.col("h1")).alias("p1"),
        k2.bitwiseXOR(F.col("h2")).alias("p2"),
    )


# ---- time-forward processing


class MessageQueue:
    """Totals on their way to the nodes of one level, smallest id first.

    Messages are kept as sorted runs; beyond `limit` rows those in memory are added up by
    node and written to a scratch file of the task, where Spark spills, too. Runs are read
    back block by block, so memory holds `limit` rows and a block of each run.
    """

    def __init__(self, limit: int = QUEUE_ROWS, block: int = RUN_ROWS):
        self.limit, self.block = limit, block
        self.memory: list[np.ndarray] = []
        self.rows = 0
        self.file = None
        self.runs: list[list] = []

    def push(self, messages: np.ndarray) -> None:
        if not len(messages):
            return
        self.memory.append(added_up(messages))
        self.rows += len(self.memory[-1])
        if self.rows > self.limit:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            scratch = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
            self.file = tempfile.TemporaryFile(dir=scratch)
        run = added_up(np.concatenate(self.memory))
        self.file.seek(0, os.SEEK_END)
        self.runs.append([self.file.tell(), len(run), np.empty(0, MESSAGE)])
        self.file.write(run.tobytes())
        self.memory, self.rows = [], 0

    def pop(self, last: int | None = None) -> np.ndarray:
        """All messages to nodes up to `last`, one for each node, or all that are left."""
        taken = []
        for run in self.runs:
            while True:
                head = run[2]
                n = len(head) if last is None else int(np.searchsorted(head["id"], last, side="right"))
                taken.append(head[:n])
                run[2] = head[n:]
                if n < len(head) or not run[1]:
                    break
                rows = min(self.block, run[1])
                self.file.seek(run[0])
                run[2] = np.frombuffer(self.file.read(rows * MESSAGE.itemsize), MESSAGE)
                run[0], run[1] = run[0] + rows * MESSAGE.itemsize, run[1] - rows
        rest = []
        for run in self.memory:
            n = len(run) if last is None else int(np.searchsorted(run["id"], last, side="right"))
            taken.append(run[:n])
            rest.append(run[n:])
        self.memory = [r for r in rest if len(r)]
        self.rows = sum(map(len, self.memory))
        return added_up(np.concatenate(taken)) if taken else np.empty(0, MESSAGE)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def added_up(messages: np.ndarray) -> np.ndarray:
    """One message for each node, by id."""
    ids, at = np.unique(messages["id"], return_inverse=True)
    out = np.zeros(len(ids), MESSAGE)
    out["id"] = ids
    for field in ("children", "leaves", "saved"):
        np.add.at(out[field], at, messages[field])
    return out


TOTALS = "depth bigint, conv_id bigint, children bigint, leaves bigint, saved bigint, sent boolean"


def totals_of(nodes: DataFrame, limit: int = QUEUE_ROWS) -> DataFrame:
    """Totals of the nodes of each partition, and what leaves it (`sent`) for parents elsewhere.

    `nodes`: depth, conv_id, parent_id, children, leaves, saved: a node's own values with
    what came from other partitions. A node without children is a leaf. Partitions are
    sorted by (depth descending, conv_id); the root has a null parent_id.
    """
    names = ["depth", "conv_id", "children", "leaves", "saved", "sent"]

    def rows(depth: int, found: np.ndarray, sent: bool) -> pa.RecordBatch:
        n = len(found)
        columns = [np.full(n, depth), found["id"], found["children"], found["leaves"], found["saved"], np.full(n, sent)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, arriving, leaving = None, MessageQueue(limit), MessageQueue(limit)
        for batch in batches:
            depths = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(depths)) + 1).tolist(), len(depths)]
            for start, stop in zip(edges, edges[1:]):
                if start == stop:
                    continue
                depth, part = int(depths[start]), batch.slice(start, stop - start)
                if depth != level:
                    # nobody of this partition is left to take these
                    if level is not None:
                        yield rows(level, arriving.pop(), True)
                        arriving.close()
                        if depth != level - 1:
                            yield rows(level - 1, leaving.pop(), True)
                    level, arriving, leaving = depth, leaving, MessageQueue(limit)
                own = np.zeros(len(part), MESSAGE)
                for field, i in (("id", 1), ("children", 3), ("leaves", 4), ("saved", 5)):
                    own[field] = part.column(i).to_numpy()
                came = arriving.pop(int(own["id"][-1]))
                if len(came):
                    at = np.minimum(np.searchsorted(own["id"], came["id"]), len(own) - 1)
                    mine = own["id"][at] == came["id"]
                    for field in ("children", "leaves", "saved"):
                        own[field][at[mine]] += came[field][mine]
                    yield rows(depth, came[~mine], True)
                own["leaves"][own["children"] == 0] = 1
                yield rows(depth, own, False)
                up = own.copy()
                above = part.column(2)
                up["id"] = above.fill_null(0).to_numpy()
                up["children"] = 1
                leaving.push(up[above.is_valid().to_numpy(zero_copy_only=False)])
        if level is not None:
            yield rows(level, arriving.pop(), True)
            yield rows(level - 1, leaving.pop(), True)
        arriving.close()
        leaving.close()

    columns = ["depth", "conv_id", "parent_id", "children", "leaves", "saved"]
    return nodes.select(*columns).mapInArrow(run, TOTALS)


def with_sent(nodes: DataFrame, sent: DataFrame) -> DataFrame:
    """Nodes with the messages to them added to their own values."""
    sums = sent.groupBy("depth", "conv_id").agg(*[F.sum(c).alias(f"sent_{c}") for c in ("children", "leaves", "saved")])
    joined = nodes.join(sums, ["depth", "conv_id"], "left")
    more = [(F.col(c) + F.coalesce(f"sent_{c}", F.lit(0))).alias(c) for c in ("children", "leaves", "saved")]
    return joined.select("depth", "conv_id", "parent_id", *more)


def subtree_totals(
    nodes: DataFrame, rows: DataFrame, shard_turns: int = SHARD_TURNS, limit: int = QUEUE_ROWS
) -> DataFrame:
    """(depth, conv_id, children, leaves, saved) of each node, totals over its subtree.

    A node is named by its depth and smallest member. Nodes with at most `shard_turns` turns
    below them lie in one shard with the highest such node above; the others, at most
    turns / shard_turns of a level, follow in bands of as many nodes, deepest first.
    """
    own = nodes.select(
        "depth", "conv_id", "parent_id", "k1", "k2", F.lit(0).alias("children"), F.lit(0).alias("leaves"), "saved", "below"
    )
    heavy = stored(own.where((F.col("below") > shard_turns) | (F.col("depth") == 0)), "trie-heavy")
    n_heavy, n_nodes = heavy.count(), nodes.count()
    light = own.where((F.col("below") <= shard_turns) & (F.col("depth") > 0))
    # the heavy nodes are few: they are sent to all only where that is so
    keys = heavy.where("depth > 0").select("k1", "k2")
    outside = rows.join(F.broadcast(keys) if n_heavy <= limit // 10 else keys, ["k1", "k2"], "left_anti")
    tops = outside.groupBy("conv_id").agg(F.min(F.struct("depth", "k1", "k2")).alias("top"))
    shards = partitions_for(n_nodes, shard_turns)
    dealt = light.join(tops, "conv_id").repartition(shards, "top").sortWithinPartitions(F.desc("depth"), "conv_id")
    done = [stored(totals_of(dealt, limit), "trie-light")]

    if n_heavy <= shard_turns:
        bands = [heavy]
    else:
        ordered = stored(numbered(heavy, [F.desc("depth"), F.asc("conv_id")], "place"), "trie-bands")
        bands = [
            ordered.where((F.col("place") >= start) & (F.col("place") < start + shard_turns))
            for start in range(0, n_heavy, shard_turns)
        ]
    waiting = done[0].where("sent")
    for band in bands:
        above = with_sent(band, waiting).repartition(1).sortWithinPartitions(F.desc("depth"), "conv_id")
        found = stored(totals_of(above, limit), "trie-heavy-totals")
        done.append(found)
        waiting = waiting.union(found.where("sent"))
    every = done[0]
    for found in done[1:]:
        every = every.union(found)
    return every.where("NOT sent").drop("sent")


# ---- ids of the conversations that end at a node


def ends_digests(ends: DataFrame, chars: int = IDS_CHARS) -> DataFrame:
    """(k1, k2, ends_sha256) over the ascending ids of the conversations that end at a node.

    Ids are sorted by ranges and joined to long strings there; a node's strings then run
    through one digest, a row of about a million characters at a time.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, ids = (batch.column(i).to_numpy() for i in range(3))
            starts = np.concatenate([[0], np.flatnonzero((np.diff(k1) != 0) | (np.diff(k2) != 0)) + 1]) if len(ids) else np.empty(0, int)
            stops = [*starts[1:].tolist(), len(ids)]
            out: list[list] = [[], [], [], []]
            for start, stop in zip(starts.tolist(), stops):
                for at in range(start, stop, max(1, chars // 20)):
                    some = ids[at : min(stop, at + max(1, chars // 20))]
                    for column, value in zip(out, (k1[start], k2[start], some[0], ",".join(map(str, some.tolist())))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())],
                ["k1", "k2", "first_id", "ids"],
            )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for k1, k2, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)):
                if (k1, k2) != key:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = (k1, k2), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.as_buffer())
            yield _digests(out)
        if key is not None:
            yield _digests([(*key, state.hexdigest())])

    order = ["k1", "k2", "conv_id"]
    joined = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        join, "k1 bigint, k2 bigint, first_id bigint, ids string"
    )
    gathered = joined.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first_id")
    return gathered.mapInArrow(digest, "k1 bigint, k2 bigint, ends_sha256 string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    k1, k2, found = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(found, pa.string())], ["k1", "k2", "ends_sha256"]
    )


# ---- the trie


def trie(
    turns: DataFrame,
    block: int = BLOCK,
    heads: int = HEADS,
    shard_turns: int = SHARD_TURNS,
    limit: int = QUEUE_ROWS,
    stretch: int = STRETCH,
) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations, the empty one included.

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256. Null role and text are empty; turns
    without conv_id are left out; equal turns of a conversation follow each other. A text may
    be of any length, only its digest goes on. Columns besides conv_id, turn, role and text
    are not looked at. Without conversations there is no node.
    """
    made, sizes = rebuilt(turns, block, heads)
    lengths = stored(sizes, "trie-lengths")
    chained = prefixes(made, stretch).join(lengths, "conv_id")
    rows = stored(chained, "trie-rows")
    key = F.struct("k1", "k2").alias("key")
    below = stored(
        rows.groupBy("k1", "k2").agg(
            F.min("depth").alias("depth"),
            F.min("conv_id").alias("conv_id"),
            F.count("*").alias("n_convs"),
            F.max("chars").cast("bigint").alias("chars"),
            F.sum(F.col("length") - F.col("depth")).alias("below"),
            F.min("p1").alias("p1"),
            F.min("p2").alias("p2"),
        ),
        "trie-nodes",
    )
    root = lengths.agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.coalesce(F.sum("length"), F.lit(0)).alias("below")
    ).where("n_convs > 0")
    zero = F.lit(0).cast("bigint")
    none = F.lit(None).cast("bigint")
    top = root.select(
        zero.alias("k1"), zero.alias("k2"), zero.alias("depth"), "conv_id", "n_convs", zero.alias("chars"), "below",
        none.alias("p1"), none.alias("p2"),
    )
    nodes = below.unionByName(top)
    children = nodes.where("depth > 0").groupBy(F.struct(F.col("p1").alias("k1"), F.col("p2").alias("k2")).alias("key")).agg(
        F.count("*").alias("n_below")
    )
    parents = children.join(nodes.select(key, F.col("conv_id").alias("parent_id")), "key")
    under = join_groups(
        nodes.where("depth > 0").withColumn("key", F.struct(F.col("p1").alias("k1"), F.col("p2").alias("k2"))), stored(parents, "trie-parents"), "key", "n_below"
    )
    columns = ["depth", "conv_id", "parent_id", "k1", "k2", "n_convs", "below"]
    saved = ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")
    complete = stored(
        under.select(*columns, saved).union(top.withColumn("parent_id", none).select(*columns, saved)), "trie-with-parents"
    )
    totals = subtree_totals(complete, rows, shard_turns, limit)

    ended = rows.where("depth = length").select("k1", "k2", "conv_id").union(
        lengths.where("length = 0").select(zero.alias("k1"), zero.alias("k2"), "conv_id")
    )
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return (
        complete.select("depth", "conv_id", "parent_id", "k1", "k2", "n_convs")
        .join(totals, ["depth", "conv_id"])
        .join(ends_digests(ended), ["k1", "k2"], "left")
        .select(
            "conv_id",
            "depth",
            F.col("parent_id").alias("parent_conv_id"),
            "n_convs",
            F.col("children").alias("n_children"),
            F.col("leaves").alias("n_leaves"),
            F.col("saved").alias("saved_tokens"),
            F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
        )
    )
