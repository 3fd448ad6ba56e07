"""Scalar and aggregate functions, as Column expressions wherever Spark has the means."""

from .bloom import BloomFilter
from .checksums import crc32c, crc32c_bytes, crc32c_extend, crc32c_mask, crc32c_unmask
from .histograms import BUCKETS, bucket_of, histogram, merge, percentile, summary
from .keys import bench_key, etag, etag_number, event_key, fold, pack, reduce_key, result_key, unpack
from .values import duration_seconds, field, payload, stamped, timestamp, unvarint, varint

__all__ = [
    "BUCKETS",
    "BloomFilter",
    "bench_key",
    "bucket_of",
    "crc32c",
    "crc32c_bytes",
    "crc32c_extend",
    "crc32c_mask",
    "crc32c_unmask",
    "duration_seconds",
    "etag",
    "etag_number",
    "event_key",
    "field",
    "fold",
    "histogram",
    "merge",
    "pack",
    "payload",
    "percentile",
    "reduce_key",
    "result_key",
    "stamped",
    "summary",
    "timestamp",
    "unpack",
    "unvarint",
    "varint",
]
