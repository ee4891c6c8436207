"""Session settings and the shared working folder."""

from __future__ import annotations

import functools
import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

# Shuffle files of a finished query are deleted, known to Spark from 4.1 on.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Settings the jobs are written for; a cluster sets its own sizes on top.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # sessions of one key are merged inside a task before they are shuffled
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    # stream state on disk instead of the heap
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def apply_recommended(spark: SparkSession) -> SparkSession:
    for key, value in RECOMMENDED.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named in `spark.checkpoint.dir`.

    Only a local session without that setting gets a folder of its own. Also makes
    sure that `DataFrame.checkpoint` has a folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_DIR, None) or context.getConf().get(CHECKPOINT_DIR)
    if not folder and context.getCheckpointDir():
        # Spark adds a folder of its own below the one that was set
        folder = context.getCheckpointDir().rsplit("/", 1)[0]
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="txtrail-", dir="/tmp")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@functools.lru_cache(maxsize=256)
def _query_id(spark: SparkSession, checkpoint: str) -> str:
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """Id of the streaming query as its checkpoint keeps it: another checkpoint, another id."""
    return _query_id(spark, checkpoint)


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that starts in here go as soon as it has run.

    Otherwise they stay until the driver happens to collect the plan as garbage.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder, with no lineage behind them."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
