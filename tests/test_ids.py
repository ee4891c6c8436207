import uuid

from hypothesis import given
from hypothesis import strategies as st
import pandas as pd
import pytest
from pyspark.sql import functions as F

from txtrail.functions import ids
from txtrail.functions.predicates import flatten_args, in_args


def by_hand(u: str) -> str:
    """Base-58 with one leading '1' per leading zero byte."""
    data = bytes.fromhex(u.replace("-", ""))
    number, text = int.from_bytes(data, "big"), ""
    while number:
        number, digit = divmod(number, 58)
        text = ids.ALPHABET[digit] + text
    return "1" * (len(data) - len(data.lstrip(b"\0"))) + text


@given(st.lists(st.one_of(
    st.uuids().map(str),
    st.integers(0, 2**128 - 1).map(lambda n: str(uuid.UUID(int=n))),
    st.integers(0, 2**40).map(lambda n: str(uuid.UUID(int=n))),
), min_size=1, max_size=20))
def test_codec_is_exact(uuids):
    codes = ids._encode(pd.Series(uuids))
    assert list(codes) == [by_hand(u) for u in uuids]
    assert list(ids._decode(codes)) == uuids


def test_bad_codes_give_null(column):
    bad = ["0bad", "zzzzzzzzzzzzzzzzzzzzzz", "1", "", "2h1ooBWg", "1" * 17, "l" * 22, None, "a" * 23]
    assert column(bad, ids.decode_uuid("c")) == [None] * len(bad)
    assert column(["bad", None, "", "g" * 36], ids.encode_uuid("c")) == [None] * 4


def test_new_ids(spark):
    rows = spark.range(50).select(ids.new_uuid().alias("u"), ids.new_short_id().alias("s")).collect()
    assert len({r.u for r in rows}) == 50
    assert all(r.u[14] == "4" and r.u[19] in "4567" and len(r.s) == 8 for r in rows)


def test_flattened_arguments(spark):
    assert flatten_args("a", ["b", "c"], 1, [2, 3], True, None) == ["a", "b", "c", 1, 2, 3, True, None]
    for bad in (1.5, {"a": 1}, [1.5], [True], object()):
        with pytest.raises(TypeError):
            flatten_args(bad)


def test_empty_list_matches_nothing(spark):
    df = spark.range(3)
    assert df.where(in_args("id")).count() == 0
    assert df.where(in_args("id", 1, [2])).count() == 2
    assert df.where(in_args(F.col("id"), [])).count() == 0
