"""Joins that stay balanced when one key holds a large share of all rows.

Adaptive execution splits a hot partition only where both inputs of the join come
straight from a shuffle. Joins with an aggregate are not split, so their hot keys
are found beforehand and joined without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fewer rows of one key than this are no burden for a task.
HOT_MIN_ROWS = 1_000_000
# A key is hot from this share of all rows on, which also bounds their number.
HOT_SHARE = 1 / 500

_SKETCH_ITEMS = 5_000
_SKETCH_GROUPS = 256


def hot_keys(df: DataFrame, key: str = "gtid") -> list[str]:
    """Keys with at least HOT_SHARE and HOT_MIN_ROWS of the rows: at most 1 / HOT_SHARE of them.

    Frequent-item sketches per task, merged in two steps: one pass over the key
    column that shuffles sketches, not keys. A key missed here only costs time.
    """
    group = (F.spark_partition_id() % _SKETCH_GROUPS).alias("_group")
    top = int(1 / HOT_SHARE)
    sketches = (
        df.where(F.col(key).isNotNull())
        .groupBy(group)
        .agg(
            F.expr(f"approx_top_k_accumulate({key}, {_SKETCH_ITEMS})").alias("_sketch"),
            F.count("*").alias("_n"),
        )
    )
    # grouped by a constant: without any input there is no row instead of a failure
    merged = sketches.groupBy(F.lit(0).alias("_all")).agg(
        F.expr(f"approx_top_k_combine(_sketch, {_SKETCH_ITEMS})").alias("_sketch"),
        F.sum("_n").alias("n"),
    )
    found = merged.select(F.expr(f"approx_top_k_estimate(_sketch, {top})").alias("top"), "n").first()
    if found is None:
        return []
    least = max(HOT_MIN_ROWS, found.n * HOT_SHARE)
    return sorted(item["item"] for item in found.top if item["count"] >= least)


def join_unique(
    left: DataFrame,
    right: DataFrame,
    how: str,
    key: str = "gtid",
    hot: list[str] | None = None,
) -> DataFrame:
    """Join with a side that has at most one row per key.

    Rows of hot keys stay in their tasks and meet a broadcast of the few right rows
    with these keys; all other rows are joined by shuffle.
    """
    hot = hot_keys(left, key) if hot is None else hot
    if not hot:
        return left.join(right, key, how)
    is_hot = F.col(key).isin(hot)
    usual = left.where(~F.coalesce(is_hot, F.lit(False))).join(right, key, how)
    return usual.unionByName(left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how))
