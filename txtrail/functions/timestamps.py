"""Epoch and text times: conversion, partition values, MySQL DATE/DATETIME/TIME text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted lengths of a DATE/DATETIME text, its all-zero form, and
# what the all-zero form stands for.
DATETIME_LENGTHS = [10, 19, 21, 22, 23, 24, 25, 26]
ZERO_TEXT = "0000-00-00 00:00:00.000000"
ZERO_TIME = "0001-01-01 00:00:00"

_DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
_DATETIME = rf"\A{_DATE}(?: [0-9]{{1,2}}:[0-9]{{2}}:[0-9]{{2}}(?:\.[0-9]+)?)?\z"
_DURATION = r"\A(-?)([0-9]+):([0-9]{2}):([0-9]{2})(?:\.([0-9]{1,6}))?\z"


def from_epoch(seconds: Column | str) -> Column:
    return F.timestamp_seconds(_col(seconds))


def day_value(time: Column | str, tz: str | None = None) -> Column:
    """`yyyyMMdd` of a TIMESTAMP in `tz`, or in the session zone."""
    return F.date_format(_in_zone(_col(time), tz), "yyyyMMdd")


def month_value(time: Column | str, tz: str | None = None) -> Column:
    return F.date_format(_in_zone(_col(time), tz), "yyyyMM")


def _in_zone(time: Column, tz: str | None) -> Column:
    return time if tz is None else F.convert_timezone(
        F.current_timezone(), F.lit(tz), time.cast("timestamp_ntz")
    )


def parse_datetime(text: Column | str, tz: str | None = None) -> Column:
    """STRUCT<value, error> for DATE/DATETIME text.

    NULL text gives NULL and no error. The all-zero text is the zero time, not
    NULL. Without `tz` the value is a TIMESTAMP_NTZ wall clock; with it, the
    TIMESTAMP of that wall clock in the zone.
    """
    text = _col(text)
    length = F.octet_length(text)
    shaped = length.isin(DATETIME_LENGTHS) & text.rlike(_DATETIME)
    zero = length.isin(DATETIME_LENGTHS) & (text == F.substring(F.lit(ZERO_TEXT), F.lit(1), length))
    if tz is None:
        parsed = text.try_cast("timestamp_ntz")
        zero_value = F.lit(ZERO_TIME).cast("timestamp_ntz")
    else:
        clock = F.when(length == 10, F.concat(text, F.lit(" 00:00:00"))).otherwise(text)
        parsed = F.concat(clock, F.lit(f" {tz}")).try_cast("timestamp")
        # the zero time is an instant, the same in every zone
        zero_value = F.lit(f"{ZERO_TIME} UTC").cast("timestamp")
    value = F.when(zero, zero_value).when(shaped, parsed)
    return F.struct(
        value.alias("value"),
        F.when(text.isNotNull() & value.isNull(), F.concat(F.lit("invalid time string: "), text))
        .alias("error"),
    )


def nullable_time(text: Column | str) -> Column:
    """STRUCT<time, valid, error>: NULL is not valid but no error, bad text is an error."""
    parsed = parse_datetime(text)
    return F.struct(
        parsed["value"].alias("time"),
        parsed["value"].isNotNull().alias("valid"),
        parsed["error"].alias("error"),
    )


def parse_duration(text: Column | str) -> Column:
    """TIME text (negative and beyond 24 hours allowed) as signed microseconds BIGINT.

    NULL for text that is no duration or does not fit.
    """
    text = _col(text)

    def part(group: int) -> Column:
        return F.regexp_extract(text, _DURATION, group)

    minutes, seconds = part(3).try_cast("bigint"), part(4).try_cast("bigint")
    micros = F.rpad(part(5), 6, "0").try_cast("bigint")
    below_hour = (minutes * 60 + seconds) * 1_000_000 + micros
    hours = F.try_multiply(part(2).try_cast("bigint"), F.lit(3_600_000_000))
    total = F.try_add(hours, below_hour)
    good = text.rlike(_DURATION) & (minutes < 60) & (seconds < 60)
    return F.when(good, F.when(part(1) == "-", -total).otherwise(total))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
