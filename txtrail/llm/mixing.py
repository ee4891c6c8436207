"""Mixing sources to target weights by capped water-filling, with DataFrame functions alone.

A source may be repeated up to a number of epochs. Sources whose share exceeds that are
clamped, and the excess goes to the others by weight, until none is above. A target is
met by whole repetitions of a source and a seeded part of one more: its documents are
walked in the order of a seeded hash until the words are used up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txtrail.llm.common import join_groups, numbered, stored

WEIGHTS = (5, 2, 1)
PERCENT = 150
EPOCHS = 2
SEED = "mix-2024"

# hexadecimal digits of the seeded hash that make a bin; a source has at most 16 ** DIGITS bins
DIGITS = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = PERCENT, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, n_docs, target) for sizes of (source, source_size, n_docs).

    Sources in the order of their code points, null last, weigh `weights` over and over.
    Each round clamps the sources whose share by weight exceeds `epochs` times their size
    and shares what is left among the others; a round reads one row of sums. Once none is
    above, targets add up to `percent` of all sizes, or to all caps where these are less.
    """
    cap = F.col("source_size") * epochs
    cycle = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ordered = numbered(sizes, [F.asc_nulls_last("source")], "place")
    sources = stored(ordered.select("source", "source_size", "n_docs", cycle.alias("weight")), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    budget, level, clamped = total * percent / 100, -1.0, -1
    while True:
        above = F.col("weight") * F.lit(level) > cap
        sums = sources.agg(
            F.count_if(above).alias("n"),
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0)).alias("held"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)).alias("free"),
        ).first()
        if sums.n == clamped or sums.free == 0:
            break
        clamped, level = sums.n, (budget - sums.held) / sums.free
    target = F.when(above, cap.cast("double")).otherwise(F.col("weight") * F.lit(level))
    return sources.select("source", "source_size", "n_docs", target.alias("target"))


def mixed(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    percent: int = PERCENT,
    epochs: int = EPOCHS,
    seed: str = SEED,
    digits: int = DIGITS,
) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row of docs.

    size is the number of words between white space, 0 for null and empty texts. A source
    takes each document as often as its target holds it whole, and of one more repetition the
    documents that come first by a seeded hash of doc_id, until the words of the target,
    rounded down, are used up; the last of them may give only its first words. So taken adds
    up to the target of each source, less than a word short, and no document gives more than
    `epochs` times its size. Ties of the hash go to the smaller doc_id, then the smaller
    size; a null doc_id hashes as an empty text. Null is a source of its own. Rows that
    repeat a document count each for itself. Columns besides doc_id, source and text are
    not looked at.
    """
    seeded = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = stored(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), seeded.alias("h")), "mix-sizes")
    bins = stored(
        rows.groupBy("source", F.substring("h", 1, digits).alias("bin")).agg(
            F.sum("size").alias("bin_size"), F.count("*").alias("bin_docs")
        ),
        "mix-bins",
    )
    sizes = bins.groupBy("source").agg(F.sum("bin_size").alias("source_size"), F.sum("bin_docs").alias("n_docs"))
    wanted = targets(sizes, weights, percent, epochs).withColumn("same", F.struct(F.col("source").isNull(), F.coalesce("source", F.lit(""))))

    # a source has at most 16 ** digits bins
    earlier = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    before = bins.withColumn("bin_start", F.coalesce(F.sum("bin_size").over(earlier), F.lit(0)))
    same = F.struct(F.col("source").isNull(), F.coalesce("source", F.lit("")))
    placed = join_groups(before.withColumn("same", same), wanted.drop("source"), "same", "n_docs").select(
        F.struct(F.col("same"), F.col("bin")).alias("key"), "bin_start", "bin_docs", "source_size", "target"
    )
    keyed = rows.select("doc_id", "size", "h", F.struct(same.alias("same"), F.substring("h", 1, digits).alias("bin")).alias("key"))
    earlier = Window.partitionBy("key").orderBy("h", F.asc_nulls_last("doc_id"), "size").rowsBetween(Window.unboundedPreceding, -1)
    walked = keyed.withColumn("start", F.coalesce(F.sum("size").over(earlier), F.lit(0))).join(placed, "key")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    left = F.floor("target") - whole * F.col("source_size") - F.col("bin_start") - F.col("start")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least("size", left))
    return walked.select("doc_id", "size", "source_size", "target", taken.alias("taken"))
