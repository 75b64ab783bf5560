"""Which keys are wanted, as a bitmap over their hashes: keeps most other rows out of a shuffle.

A bitmap has about ROOM bits for each wanted key, LEAST at least and MOST (32 MB) at most, whatever the input, so what is
broadcast is bounded. A bitmap never leaves out a wanted key; what it lets in wrongly the join behind it drops.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROOM, LEAST, MOST = 16, 1 << 20, 1 << 28
_PER = 8 * 4096  # bits of a bitmap that Spark aggregates


def spot(column: str, bits: int) -> Column:
    """The place of a key."""
    return F.pmod(F.xxhash64(column), F.lit(bits)).cast("long")


def bitmap(keys: DataFrame, column: str, count: int | None = None) -> tuple[int, np.ndarray]:
    """How many bits, and the bits, packed, of all keys in a column."""
    count = keys.count() if count is None else count
    bits = LEAST
    while bits < min(MOST, ROOM * count):
        bits *= 2
    # Spark counts from 1: value v stands in bitmap 1 + (v - 1) // _PER at (v - 1) % _PER.
    v = keys.select((spot(column, bits) + 1).alias("v"))
    maps = v.groupBy(F.expr("bitmap_bucket_number(v)").alias("n")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(v))").alias("m"))
    packed = np.zeros(max(bits, _PER) // 8, dtype=np.uint8)
    for r in maps.toLocalIterator():
        at = (r["n"] - 1) * (_PER // 8)
        packed[at : at + _PER // 8] = np.frombuffer(bytes(r["m"]), np.uint8)
    return bits, packed


def among(places: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Which places have their bit set."""
    return (packed[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1
