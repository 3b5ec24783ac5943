"""Hash functions. Digests are lower-case hex unless ``binary``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions._args import ColumnLike, col
from tessera.shipping import ship

_MASK = (1 << 64) - 1


def _digest(hexed: Column, binary: bool) -> Column:
    return F.unhex(hexed) if binary else hexed


def md5(c: ColumnLike, binary: bool = False) -> Column:
    return _digest(F.md5(col(c).cast("binary")), binary)


def sha1(c: ColumnLike, binary: bool = False) -> Column:
    return _digest(F.sha1(col(c).cast("binary")), binary)


def sha256(c: ColumnLike, binary: bool = False) -> Column:
    return _digest(F.sha2(col(c).cast("binary"), 256), binary)


def city_hash64(*columns: ColumnLike) -> Column:
    """A surrogate: 64 well-mixed bits by XXH64, in the JVM. Its values are not those of CityHash."""
    return F.xxhash64(*[col(c) for c in columns])


def _rotate(x: int, n: int) -> int:
    return ((x << n) | (x >> (64 - n))) & _MASK


def _rounds(v: list[int], n: int) -> None:
    for _ in range(n):
        v[0] = (v[0] + v[1]) & _MASK
        v[1] = _rotate(v[1], 13) ^ v[0]
        v[0] = _rotate(v[0], 32)
        v[2] = (v[2] + v[3]) & _MASK
        v[3] = _rotate(v[3], 16) ^ v[2]
        v[0] = (v[0] + v[3]) & _MASK
        v[3] = _rotate(v[3], 21) ^ v[0]
        v[2] = (v[2] + v[1]) & _MASK
        v[1] = _rotate(v[1], 17) ^ v[2]
        v[2] = _rotate(v[2], 32)


def sip_hash(data: bytes, k0: int = 0, k1: int = 0) -> int:
    """SipHash-2-4 as published, an unsigned 64-bit number."""
    # The initial state of the published algorithm.
    v = [k0 ^ 0x736F6D6570736575, k1 ^ 0x646F72616E646F6D, k0 ^ 0x6C7967656E657261, k1 ^ 0x7465646279746573]
    tail = len(data) % 8
    padded = data + bytes(7 - tail) + bytes([len(data) & 0xFF])
    for i in range(0, len(padded), 8):
        m = int.from_bytes(padded[i : i + 8], "little")
        v[3] ^= m
        _rounds(v, 2)
        v[0] ^= m
    v[2] ^= 0xFF
    _rounds(v, 4)
    return v[0] ^ v[1] ^ v[2] ^ v[3]


def sip_hash64(c: ColumnLike, k0: int = 0, k1: int = 0) -> Column:
    """SipHash-2-4 of the bytes as decimal(20, 0), in an Arrow batch UDF: Spark has no built-in."""
    ship()

    @F.pandas_udf("decimal(20,0)")
    def hashed(values: pd.Series) -> pd.Series:
        from decimal import Decimal

        return values.map(lambda b: None if b is None else Decimal(sip_hash(bytes(b), k0, k1)))

    return hashed(col(c).cast("binary"))
