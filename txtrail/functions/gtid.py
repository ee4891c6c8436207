"""Global transaction ids: `uuid:interval[:interval...]`, interval `n` or `n-m`.

Everything here is a built-in column expression. Validity uses regular
expressions only, so the filter stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted text forms of the server uuid, and the characters
# trimmed from both ends of an id before it is checked.
CANONICAL_UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
PLAIN_UUID = "[0-9a-fA-F]{32}"
BRACED_UUID = r"\{" + CANONICAL_UUID + r"\}"
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

LENIENT = "lenient"
STRICT = "strict"


def _int64_pattern() -> str:
    """Unsigned decimal text that fits a signed 64-bit integer."""
    top = str(2**63 - 1)
    smaller = [
        f"{top[:i]}[0-{int(d) - 1}][0-9]{{{len(top) - 1 - i}}}"
        for i, d in enumerate(top)
        if d != "0"
    ]
    return "0*(?:[0-9]{1,18}|" + "|".join([*smaller, top]) + ")"


_UUID = f"(?:{CANONICAL_UUID}|{PLAIN_UUID}|{BRACED_UUID})"
_INT = r"\+?" + _int64_pattern()


def trimmed_gtid(gtid: Column | str) -> Column:
    return F.btrim(_col(gtid), F.lit(WHITE_SPACE))


def gtid_valid(gtid: Column | str, mode: str = LENIENT) -> Column:
    """True for a well-formed id, false otherwise (also for NULL).

    `lenient` checks only the upper bound of an `n-m` interval, so `x-5` and `-5`
    pass; `strict` checks both bounds.
    """
    if mode not in (LENIENT, STRICT):
        raise ValueError(f"gtid mode must be {LENIENT!r} or {STRICT!r}, got {mode!r}")
    lower = "[^:-]*-" if mode == LENIENT else f"{_INT}-"
    one_interval = rf":(?:{lower})?{_INT}(?=:|\z)"
    text = trimmed_gtid(gtid)
    intervals = F.regexp_replace(text, rf"\A{_UUID}", "")
    # Well-formed intervals are taken out one by one; a bad one stays behind.
    left_over = F.regexp_replace(intervals, one_interval, "")
    return F.coalesce(text.rlike(rf"\A{_UUID}:") & (left_over == ""), F.lit(False))


def gtid_uuid(gtid: Column | str) -> Column:
    return F.substring_index(trimmed_gtid(gtid), ":", 1)


def gtid_intervals(gtid: Column | str) -> Column:
    """ARRAY<STRUCT<lo, hi>>, both ends included. A bound that is no number is NULL."""
    parts = F.split(trimmed_gtid(gtid), ":", -1)

    def bounds(text: Column) -> Column:
        ends = F.split(text, "-", -1)
        return F.struct(
            _to_int64(F.element_at(ends, 1)).alias("lo"),
            _to_int64(F.element_at(ends, -1)).alias("hi"),
        )

    return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), bounds)


def gtid_tx_count(gtid: Column | str) -> Column:
    """Number of transactions the id covers; NULL when a bound is no number."""
    return F.aggregate(
        gtid_intervals(gtid),
        F.lit(0).cast("bigint"),
        lambda total, i: total + (i["hi"] - i["lo"] + F.lit(1)),
    )


def _to_int64(text: Column) -> Column:
    return F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("bigint"))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
