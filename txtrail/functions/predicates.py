"""Membership predicates from flattened scalar and list arguments."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCALARS = (str, int, bool, dt.datetime, type(None))


def flatten_args(*args: object) -> list:
    """One flat list from scalars and lists of str or int; other types are rejected."""
    flat: list = []
    for arg in args:
        if isinstance(arg, _SCALARS):
            flat.append(arg)
        elif isinstance(arg, (list, tuple)) and all(_is_list_element(e) for e in arg):
            flat.extend(arg)
        else:
            raise TypeError(f"unsupported argument: {arg!r}")
    return flat


def _is_list_element(e: object) -> bool:
    return e is None or isinstance(e, str) or (isinstance(e, int) and not isinstance(e, bool))


def in_args(column: Column | str, *args: object) -> Column:
    """`column IN (args...)`; an empty list is false for every row."""
    values = flatten_args(*args)
    if not values:
        return F.lit(False)
    return (F.col(column) if isinstance(column, str) else column).isin(values)
