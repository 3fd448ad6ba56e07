"""CRC-32C. Spark's crc32 is the other polynomial, so this one is an Arrow UDF.

All values of a batch go through a table of 256 entries together, a byte of each
in every step, longest first; nothing loops over single values.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

POLYNOMIAL = 0x82F63B78  # reflected
MASK_DELTA = 0xA282EAD8  # fixed by the log format


@cache
def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1)
    return t


def crc32c_bytes(values: list[bytes], start: int = 0) -> np.ndarray:
    """The checksums of many byte strings, each as if it followed bytes with checksum `start`."""
    order = sorted(range(len(values)), key=lambda k: -len(values[k]))
    sizes = np.array([len(values[k]) for k in order])
    raw = np.frombuffer(b"".join(values[k] for k in order) + b"\0", np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
    crc = np.full(len(order), ~np.uint32(start) & np.uint32(0xFFFFFFFF), np.uint32)
    table = _table()
    for t in range(int(sizes[0]) if len(sizes) else 0):
        on = int(np.searchsorted(-sizes, -t, "left"))  # those of more than t bytes
        crc[:on] = table[(crc[:on] ^ raw[starts[:on] + t]) & 255] ^ (crc[:on] >> 8)
    out = np.empty(len(order), np.uint32)
    out[order] = ~crc
    return out


def crc32c_extend(start: int, value: bytes) -> int:
    return int(crc32c_bytes([value], start)[0])


@F.arrow_udf(T.LongType())
def _crc32c(values: pa.Array) -> pa.Array:
    found = crc32c_bytes([v or b"" for v in values.to_pylist()])
    return pa.array(found.astype(np.int64), mask=np.asarray(values.is_null()))


def crc32c(value: Column) -> Column:
    """The checksum of a string's UTF-8, or of a binary, as a non-negative number; null for null."""
    return _crc32c(value.cast("binary"))


def crc32c_mask(crc: Column) -> Column:
    """As stored beside data that itself holds checksums: rotated by 15 and shifted by a constant."""
    turned = F.shiftright(crc, 15).bitwiseOR(F.shiftleft(crc, 17)).bitwiseAND(F.lit(0xFFFFFFFF))
    return (turned + MASK_DELTA) % (1 << 32)


def crc32c_unmask(masked: Column) -> Column:
    turned = F.pmod(masked - MASK_DELTA, F.lit(1 << 32))
    return F.shiftright(turned, 17).bitwiseOR(F.shiftleft(turned, 15)).bitwiseAND(F.lit(0xFFFFFFFF))
