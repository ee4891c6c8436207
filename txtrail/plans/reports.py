"""Reports over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ingest_lag(events: DataFrame, alert_seconds: int) -> DataFrame:
    """Largest delay between event and ingest per table and minute of ingest.

    `alert` tells the minutes in which it went beyond `alert_seconds`.
    """
    lag = F.timestamp_diff("SECOND", F.col("event_time"), F.col("ingest_time"))
    minute = F.date_format(F.date_trunc("MINUTE", "ingest_time"), "yyyy-MM-dd HH:mm")
    return (
        events.groupBy("db", "table", minute.alias("minute"))
        .agg(F.max(lag).alias("max_lag_seconds"), F.count("*").alias("n_events"))
        .withColumn("alert", F.col("max_lag_seconds") > alert_seconds)
    )
