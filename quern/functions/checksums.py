"""Check digits and cyclic checksums of texts."""

from __future__ import annotations

import binascii

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import IntegerType


def weighted_rest(digits: Column, weights: list[int], modulus: int) -> Column:
    """Sum of the digits of a text times their weights, modulo a number; null where one of them is no digit."""
    parts = [F.substring(digits, i + 1, 1).try_cast("int") * w for i, w in enumerate(weights)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return (total % modulus).cast("int")


@F.pandas_udf(IntegerType())
def crc16(x: pd.Series) -> pd.Series:
    """CRC-16 of the UTF-8 bytes: polynomial 0x1021, start 0xFFFF, not reflected; null stays null."""
    return x.map(lambda s: binascii.crc_hqx(s.encode(), 0xFFFF) if isinstance(s, str) else None).astype("Int32")
