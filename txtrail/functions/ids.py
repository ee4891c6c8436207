"""Compact ids: 128-bit uuids as base-58 text, and new random ids.

A 128-bit number exceeds every Spark integer, so the two conversions are Arrow
batch functions. Both work on whole batches as four 32-bit limbs per row; there
is no loop over rows.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Digits of the base-58 text, and the length of a short id.
ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
SHORT_ID_LENGTH = 8

_MAX_DIGITS = 22  # 58**22 > 2**128
_DIGIT_CODES = np.frombuffer(ALPHABET.encode(), dtype=np.uint8)
_UUID_TEXT = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


def _encode(uuids: pd.Series) -> pd.Series:
    good = uuids.str.fullmatch(_UUID_TEXT, na=False).to_numpy(dtype=bool)
    out = pd.Series([None] * len(uuids), dtype=object)
    if not good.any():
        return out
    raw = bytes.fromhex("".join(uuids[good].str.replace("-", "")))
    octets = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 16)
    limbs = octets.view(">u4").astype(np.uint64)
    digits = np.empty((len(octets), _MAX_DIGITS), dtype=np.uint8)
    for k in range(_MAX_DIGITS - 1, -1, -1):
        rest = np.zeros(len(octets), dtype=np.uint64)
        for j in range(4):
            value = (rest << np.uint64(32)) | limbs[:, j]
            limbs[:, j], rest = value // np.uint64(58), value % np.uint64(58)
        digits[:, k] = rest
    # One leading '1' per leading zero byte, none for leading zero digits.
    zero_digits = np.where(digits.any(axis=1), (digits != 0).argmax(axis=1), _MAX_DIGITS)
    zero_octets = np.where(octets.any(axis=1), (octets != 0).argmax(axis=1), 16)
    text = pd.Series(_DIGIT_CODES[digits].view(f"S{_MAX_DIGITS}").ravel()).str.decode("ascii")
    surplus = zero_digits - zero_octets
    for n in np.unique(surplus[surplus > 0]):
        text[surplus == n] = text[surplus == n].str.slice(n)
    out[good] = text.to_numpy()
    return out


def _decode(codes: pd.Series) -> pd.Series:
    shaped = codes.str.fullmatch(f"[{ALPHABET}]{{1,{_MAX_DIGITS}}}", na=False)
    good = shaped.to_numpy(dtype=bool)
    out = pd.Series([None] * len(codes), dtype=object)
    if not good.any():
        return out
    texts = codes[good]
    padded = "".join(texts.str.rjust(_MAX_DIGITS, ALPHABET[0])).encode()
    chars = np.frombuffer(padded, dtype=np.uint8).reshape(-1, _MAX_DIGITS)
    value_of = np.zeros(256, dtype=np.uint64)
    value_of[_DIGIT_CODES] = np.arange(58)
    limbs = np.zeros((len(chars), 4), dtype=np.uint64)
    overflow = np.zeros(len(chars), dtype=bool)
    for k in range(_MAX_DIGITS):
        carry = value_of[chars[:, k]]
        for j in range(3, -1, -1):
            value = limbs[:, j] * np.uint64(58) + carry
            limbs[:, j], carry = value & np.uint64(0xFFFFFFFF), value >> np.uint64(32)
        overflow |= carry > 0
    octets = limbs.astype(">u4").view(np.uint8).reshape(-1, 16)
    # A code stands for a uuid only when its leading ones match its zero bytes.
    leading_ones = texts.str.len().to_numpy() - texts.str.lstrip(ALPHABET[0]).str.len().to_numpy()
    zero_octets = np.where(octets.any(axis=1), (octets != 0).argmax(axis=1), 16)
    exact = ~overflow & (leading_ones == zero_octets)
    hexes = octets.tobytes().hex()
    plain = pd.Series([hexes[i : i + 32] for i in range(0, len(hexes), 32)])
    uuids = plain.str.replace(r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", r"\1-\2-\3-\4-\5", regex=True)
    out[good] = np.where(exact, uuids.to_numpy(), None)
    return out


@F.pandas_udf(T.StringType())
def _encode_udf(uuids: pd.Series) -> pd.Series:
    return _encode(uuids)


@F.pandas_udf(T.StringType())
def _decode_udf(codes: pd.Series) -> pd.Series:
    return _decode(codes)


def encode_uuid(uuid: Column | str) -> Column:
    """36-character uuid text to base-58 text of at most 22 characters; NULL if no uuid."""
    return _encode_udf(F.col(uuid) if isinstance(uuid, str) else uuid)


def decode_uuid(code: Column | str) -> Column:
    """Base-58 text to 36-character uuid text; NULL unless it stands for exactly 16 bytes.

    The variant bits are not looked at: ids made by `new_uuid` do not follow the RFC there.
    """
    return _decode_udf(F.col(code) if isinstance(code, str) else code)


def new_uuid() -> Column:
    """Random version-4 uuid whose variant bits are `01`, as all stored ids have them.

    Not deterministic: write the result before using it twice.
    """
    u = F.uuid()
    variant = F.translate(F.substring(u, 20, 1), "89ab", "4567")
    return F.concat(F.substring(u, 1, 19), variant, F.substring(u, 21, 16))


def short_id(code: Column, length: int = SHORT_ID_LENGTH) -> Column:
    return F.substring(code, 1, length)


def new_short_id() -> Column:
    return short_id(encode_uuid(new_uuid()))
