"""Keys: folding, reduce keys, etags, packed versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Reduce key of a null (fixed by the data model).
NULL_KEY = "@null"
#: Type part of an event's etag (fixed by the data model).
ETAG_TYPE = 3


def fold(key: Column) -> Column:
    """Keys that are equal but for the case of ASCII letters become one; other letters keep their case."""
    return F.translate(key, UPPER, LOWER)


def reduce_key(value: Column, kind: T.DataType | None = None) -> Column:
    """The bucket of a reduce key: its text; null is @null; objects, arrays and the like are compact JSON.

    An integer and the string that writes it share a bucket.
    """
    text = F.to_json(value) if isinstance(kind, T.StructType | T.ArrayType | T.MapType) else value.cast("string")
    return F.coalesce(text, F.lit(NULL_KEY))


def result_key(view: str | Column, key: Column) -> Column:
    """The key that a view's result has in storage."""
    return F.concat(F.lit("results/"), F.lit(view) if isinstance(view, str) else view, F.lit("/"), key)


def event_key(etag_: Column) -> Column:
    return F.concat(F.lit("events/"), etag_)


def etag(number: Column, epoch: Column | int = 1) -> Column:
    """Fixed-width text of (epoch, number), whose order is theirs: 45 is 03000000-0000-0001-0000-00000000002D."""
    epoch = F.lit(epoch) if isinstance(epoch, int) else epoch
    high = F.lpad(F.hex(epoch.cast("bigint")), 12, "0")
    low = F.lpad(F.hex(number.cast("bigint")), 16, "0")
    return F.concat(
        F.lit(f"{ETAG_TYPE:02X}000000-"), F.substring(high, 5, 4), F.lit("-"), F.substring(high, 9, 4), F.lit("-"), F.substring(low, 1, 4), F.lit("-"), F.substring(low, 5, 12)
    )


def etag_number(text: Column) -> Column:
    """The number in an etag, or in a key that ends in one."""
    last = F.substring_index(text, "/", -1)
    return F.conv(F.concat(F.substring(last, 20, 4), F.substring(last, 25, 12)), 16, 10).cast("bigint")


def etag_text(number: int, epoch: int = 1) -> str:
    """The same as `etag`, of plain numbers."""
    high, low = f"{epoch:08X}", f"{number:016X}"
    return f"{ETAG_TYPE:02X}000000-{high[:4]}-{high[4:]}-{low[:4]}-{low[4:]}"


def etag_parts(text: str) -> tuple[int, int]:
    """(epoch, number) of an etag."""
    digits = text.replace("-", "")
    return int(digits[8:16], 16), int(digits[16:], 16)


def pack(seq: Column, op: Column) -> Column:
    """Sequence number and operation in one number; order by it is order by (seq, op)."""
    return F.shiftleft(seq.cast("bigint"), 8).bitwiseOR(op.cast("bigint"))


def unpack(packed: Column) -> tuple[Column, Column]:
    return F.shiftright(packed, 8), packed.bitwiseAND(F.lit(255)).cast("int")


def bench_key(number: Column) -> Column:
    """The 16-digit decimal key of the workloads."""
    return F.lpad(number.cast("string"), 16, "0")
