import datetime as dt

from pyspark.sql import functions as F

from txtrail.functions import timestamps as tm

ZERO = dt.datetime(1, 1, 1)


def test_datetime_text(column):
    vectors = {
        "1987-03-04": dt.datetime(1987, 3, 4),
        "1987-03-04 16:05:09": dt.datetime(1987, 3, 4, 16, 5, 9),
        "1987-03-04 16:05:09.1": dt.datetime(1987, 3, 4, 16, 5, 9, 100000),
        "1987-03-04 16:05:09.250001": dt.datetime(1987, 3, 4, 16, 5, 9, 250001),
        "0000-00-00": ZERO,
        "0000-00-00 00:00:00": ZERO,
        "0000-00-00 00:00:00.000000": ZERO,
    }
    got = column(list(vectors), tm.parse_datetime("c"))
    assert [r.value for r in got] == list(vectors.values())
    assert all(r.error is None for r in got)


def test_bad_datetime_text(column):
    bad = ["", "1234", "1987-03-04 16:05:09.", "1987-02-30", "1987-00-01", "1987-03-04T16:05:09",
           "1987-03-04 24:00:00", "1987-03-04 16:05:09.1234567", "19870304  "]
    got = column(bad, tm.nullable_time("c"))
    assert [(r.time, r.valid, r.error) for r in got] == [
        (None, False, f"invalid time string: {text}") for text in bad
    ]


def test_null_is_no_error(column):
    (row,) = column([None], tm.nullable_time("c"))
    assert (row.time, row.valid, row.error) == (None, False, None)


def test_datetime_in_zone(column):
    text = ["1987-03-04", "1987-03-04 16:05:09", "0000-00-00"]
    got = column(text, F.unix_timestamp(tm.parse_datetime("c", "Asia/Shanghai")["value"]))
    utc = dt.timezone.utc
    want = [dt.datetime(1987, 3, 3, 16), dt.datetime(1987, 3, 4, 8, 5, 9), ZERO]
    assert got == [int(t.replace(tzinfo=utc).timestamp()) for t in want]


def test_duration(column):
    vectors = {
        "07:08:09": 25_689_000_000,
        "-07:08:09.25": -25_689_250_000,
        "838:59:59": 3_020_399_000_000,
        "-838:59:58.9": -3_020_398_900_000,
        "00:00:00": 0,
        "07:60:00": None,
        "07:08": None,
        "99999999999999:00:00": None,
        "": None,
        None: None,
    }
    assert column(list(vectors), tm.parse_duration("c")) == list(vectors.values())


def test_partition_values_in_zone(column):
    # 2023-01-31 18:00 UTC is already February in the zone
    seconds = [1675188000]
    time = tm.from_epoch("c")
    assert column(seconds, tm.day_value(time, "Asia/Shanghai"), "bigint") == ["20230201"]
    assert column(seconds, tm.month_value(time, "Asia/Shanghai"), "bigint") == ["202302"]
    assert column(seconds, tm.day_value(time), "bigint") == ["20230131"]
