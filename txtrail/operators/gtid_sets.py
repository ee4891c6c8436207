"""Sets of transaction numbers: the intervals that many gtids cover together, and the gaps.

One server has as a rule most of all ids, so no server's intervals are brought into one
task: they are dealt out by ranges, and a range takes over from the ones before it how far
they reach and where their last island began.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txtrail.functions.gtid import gtid_intervals, gtid_uuid
from txtrail.session import checkpointed


def intervals(df: DataFrame, gtid: str = "gtid") -> DataFrame:
    """(server, lo, hi): the intervals of all ids, both ends included, each once.

    Intervals with a bound that is no number, a negative one, or with hi < lo hold nothing.
    """
    ids = df.select(gtid_uuid(gtid).alias("server"), F.explode(gtid_intervals(gtid)).alias("i"))
    return ids.select("server", "i.lo", "i.hi").where("lo >= 0 AND lo <= hi").distinct()


def executed_set(df: DataFrame, gtid: str = "gtid") -> DataFrame:
    """(server, lo, hi): the fewest intervals that cover the same transactions."""
    return islands(intervals(df, gtid))


def missing_ranges(df: DataFrame, gtid: str = "gtid") -> DataFrame:
    """(server, lo, hi): what no id covers between the first and the last transaction of a server."""
    begun = _begun(intervals(df, gtid)).where(F.col("begins") & F.col("reach").isNotNull())
    return begun.select("server", (F.col("reach") + 1).alias("lo"), (F.col("lo") - 1).alias("hi"))


def united(*sets: DataFrame) -> DataFrame:
    """Islands of several sets of (server, lo, hi)."""
    rows = sets[0].select("server", "lo", "hi")
    for other in sets[1:]:
        rows = rows.union(other.select("server", "lo", "hi"))
    return islands(rows)


def islands(rows: DataFrame) -> DataFrame:
    """Overlapping and adjacent intervals as one."""
    begun = _begun(rows)
    inside = Window.partitionBy("server", "part").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    start = F.when(F.col("begins"), F.col("lo"))
    local = begun.withColumn("island", F.max(start).over(inside))
    earlier = _carried(begun, F.max(start), "before")
    named = local.join(earlier, ["server", "part"]).select("server", F.coalesce("island", "before").alias("lo"), "hi")
    return named.groupBy("server", "lo").agg(F.max("hi").alias("hi"))


def _begun(rows: DataFrame) -> DataFrame:
    """(server, part, id, lo, hi, reach, begins): how far the intervals before a row reach,
    and whether it begins an island."""
    ordered = rows.repartitionByRange("server", "lo").sortWithinPartitions("server", "lo", "hi")
    placed = checkpointed(ordered.withColumn("id", F.monotonically_increasing_id()))
    # the upper bits of the id are the number of the range
    placed = placed.withColumn("part", F.shiftright("id", 33))
    inside = Window.partitionBy("server", "part").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("own", F.max("hi").over(inside))
    joined = local.join(_carried(placed, F.max("hi"), "before"), ["server", "part"])
    reach = F.greatest("own", "before")
    begins = F.coalesce(F.col("lo") - 1 > reach, F.lit(True))
    return checkpointed(joined.select("server", "part", "id", "lo", "hi", reach.alias("reach"), begins.alias("begins")))


def _carried(placed: DataFrame, most, name: str) -> DataFrame:
    """(server, part, name): the maximum over the parts of a server before each one."""
    per_part = placed.groupBy("server", "part").agg(most.alias("most"))
    # one row for each range that a server reaches into
    earlier = Window.partitionBy("server").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select("server", "part", F.max("most").over(earlier).alias(name))
