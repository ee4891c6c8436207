"""Changes to a snapshot of an operational table: append, soft delete, update by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txtrail.functions.predicates import in_args

# Status of a row in the example snapshot.
STATUS_NORMAL = 1
STATUS_DELETED = 0


def append_rows(snapshot: DataFrame, rows: DataFrame) -> DataFrame:
    return snapshot.unionByName(rows)


def soft_delete(snapshot: DataFrame, key: str, *keys: object) -> DataFrame:
    """Marks the rows with the given keys as deleted; no keys change nothing."""
    return snapshot.withColumn("status", _deleted_if(in_args(key, *keys)))


def soft_delete_by(snapshot: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The same for keys held in a DataFrame."""
    hits = keys.select(key).distinct().withColumn("_hit", F.lit(True))
    joined = snapshot.join(hits, key, "left")
    return joined.withColumn("status", _deleted_if(F.col("_hit"))).select(*snapshot.columns)


def _deleted_if(condition: Column) -> Column:
    return F.when(condition, F.lit(STATUS_DELETED)).otherwise(F.col("status"))


def update_by_key(
    snapshot: DataFrame, updates: DataFrame, key: str, fields: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Sets `fields` of the rows whose key has an update; the last by `order` wins."""
    last = F.max(F.struct(*order, *fields)).alias("_new")
    newest = updates.groupBy(key).agg(last)
    joined = snapshot.join(newest, key, "left")
    hit = F.col("_new").isNotNull()
    return joined.withColumns(
        {f: F.when(hit, F.col(f"_new.{f}")).otherwise(F.col(f)) for f in fields}
    ).select(*snapshot.columns)
