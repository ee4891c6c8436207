"""The two topics: start position, decoding with quarantine, encoding."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txtrail.functions.payload import computed_once
from txtrail.options import TopicOptions
from txtrail.schemas import EVENT_ENVELOPE, RAW_CHANGE, TX_ENVELOPE
from txtrail.session import shuffles_released

CORRUPT = "_corrupt_record"


def start_position(topic: TopicOptions) -> dict[str, str]:
    """`startingOffsets`: explicit offsets, else oldest or newest.

    Only a query without a checkpoint looks at it; afterwards its saved offsets win.
    """
    if topic.offsets is not None:
        return {"startingOffsets": json.dumps({t: dict(p) for t, p in topic.offsets.items()})}
    return {"startingOffsets": "earliest" if topic.use_oldest else "latest"}


def read_topic(spark: SparkSession, topic: TopicOptions) -> DataFrame:
    """Stream with one STRING column `value`.

    Formats other than Kafka start where their own options say, files with the oldest;
    explicit offsets would be lost on them and are refused.
    """
    reader = spark.readStream.format(topic.format).options(**topic.options)
    if topic.format == "kafka":
        reader = reader.options(**start_position(topic))
        return reader.load().select(F.col("value").cast("string").alias("value"))
    if topic.offsets is not None:
        raise ValueError(f"a topic of format {topic.format!r} has no offsets to start from")
    return reader.load().select("value")


def decode_events(df: DataFrame, value: str = "value") -> DataFrame:
    """Envelope fields of row-change events, `data` as text, plus `_corrupt_record`.

    A missing or null field takes its zero value. Text that is no object of the
    right field types, or whose base64 is broken, has `_corrupt_record` set.
    """
    decoded = _decode(df, value, EVENT_ENVELOPE)
    return decoded.withColumn("data", F.col("data").cast("string"))


def decode_tx(df: DataFrame, value: str = "value") -> DataFrame:
    return _decode(df, value, TX_ENVELOPE)


def decode_raw(df: DataFrame, value: str = "value") -> DataFrame:
    """Raw row changes from JSON messages; row images as VARIANT, NULL when absent."""
    return _decode(df, value, RAW_CHANGE)


def _decode(df: DataFrame, value: str, envelope: T.StructType) -> DataFrame:
    schema = T.StructType([*envelope.fields, T.StructField(CORRUPT, T.StringType())])
    row = F.from_json(
        F.col("_text"), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    )
    # from_json reads the first element of a top-level array; the envelope is an object
    text = F.coalesce(F.col(value), F.lit(""))
    is_object = F.ltrim(F.col("_text")).startswith("{")
    parsed = computed_once(df.select(text.alias("_text")), "_row", F.when(is_object, row))
    fields = [_zero_filled(f).alias(f.name) for f in envelope.fields]
    corrupt = F.when(F.col("_row").isNull(), F.col("_text")).otherwise(F.col(f"_row.{CORRUPT}"))
    return parsed.select(*fields, corrupt.alias(CORRUPT))


def _zero_filled(field: T.StructField) -> Column:
    zero = {"string": F.lit(""), "binary": F.lit(b""), "int": F.lit(0), "bigint": F.lit(0)}
    name, value = field.dataType.simpleString(), F.col(f"_row.{field.name}")
    return F.coalesce(value, zero[name].cast(field.dataType)) if name in zero else value


def good_rows(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def quarantine(decoded: DataFrame) -> DataFrame:
    """The undecodable messages, whole."""
    return decoded.where(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("value"))


def encode_events(df: DataFrame) -> DataFrame:
    """One `value` per event: the JSON envelope with base64 `data`."""
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in EVENT_ENVELOPE.fields]
    return df.select(F.to_json(F.struct(*columns)).alias("value"))


def encode_tx(df: DataFrame) -> DataFrame:
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in TX_ENVELOPE.fields]
    return df.select(F.to_json(F.struct(*columns)).alias("value"))


def write_topic(df: DataFrame, format: str, options: dict[str, str]) -> None:
    """Appends encoded values to a topic (`kafka`) or to a folder (`text`)."""
    with shuffles_released(df.sparkSession):
        df.select("value").write.format(format).options(**options).mode("append").save()
