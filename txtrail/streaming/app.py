"""Entry points: build a trail from options, run it with a handler."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from txtrail.operators.records import without_redeliveries
from txtrail.options import KEYED_STATE, TrailOptions
from txtrail.session import apply_recommended
from txtrail.sources.handlers import Handler
from txtrail.sources.tables import read_audit, read_events, read_outcomes, read_tx_versions
from txtrail.streaming.ingest import start_ingest
from txtrail.streaming.keyed import start_online_state
from txtrail.streaming.lag import start_lag_alerts, start_lag_checks
from txtrail.streaming.online import start_online
from txtrail.streaming.reconcile import start_reconcile, start_upkeep


@dataclass(frozen=True)
class Trail:
    spark: SparkSession
    options: TrailOptions

    def run(self, handler: Handler | None = None) -> list[StreamingQuery]:
        """Starts the jobs; they run until stopped."""
        jobs = [
            start_ingest(self.spark, self.options),
            self._online(handler),
            start_reconcile(self.spark, self.options, handler),
        ]
        if self.options.upkeep_interval:
            jobs.append(start_upkeep(self.spark, self.options))
        if self.options.lag_alert_seconds is not None:
            jobs += [start_lag_checks(self.spark, self.options), start_lag_alerts(self.spark, self.options)]
        return jobs

    def run_available(self, handler: Handler | None = None) -> None:
        """Works through what the topics hold now: events first, then transactions."""
        once = {"availableNow": True}
        start_ingest(self.spark, self.options, once).awaitTermination()
        self._online(handler, once).awaitTermination()

    def _online(self, handler: Handler | None, trigger: dict | None = None) -> StreamingQuery:
        start = start_online_state if self.options.online == KEYED_STATE else start_online
        return start(self.spark, self.options, handler, trigger)

    def events(self) -> DataFrame:
        return read_events(self.spark, self.options.store)

    def tx_versions(self) -> DataFrame:
        return read_tx_versions(self.spark, self.options.store)

    def records(self) -> DataFrame:
        return without_redeliveries(read_audit(self.spark, self.options.store))

    def outcomes(self) -> DataFrame:
        """What each call of a per-record handler gave."""
        return read_outcomes(self.spark, self.options.store)


def build(spark: SparkSession, options: TrailOptions) -> Trail:
    return Trail(apply_recommended(spark), options)


def run(
    spark: SparkSession, options: TrailOptions, handler: Handler | None = None
) -> list[StreamingQuery]:
    return build(spark, options).run(handler)
