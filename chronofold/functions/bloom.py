"""Bloom filters over keys, built and asked by Spark expressions.

For pruning files Parquet's own filters do (`sources.parquet.with_bloom`); this
one is for sending a key set of bounded size to where it is asked.
"""

from __future__ import annotations

import json
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 10
LEAST_BITS = 64


class BloomFilter:
    """Words of 62 bits by number. Added keys always match; others seldom do."""

    WORD = 62

    def __init__(self, words: dict[int, int], bits: int, probes: int):
        self.words, self.bits, self.probes = words, bits, probes

    @classmethod
    def build(cls, keys: DataFrame, column: str, n_keys: int | None = None, bits_per_key: int = BITS_PER_KEY, most_bits: int = 1 << 26) -> BloomFilter:
        """A filter of the keys. Its size is checked: one that would need over `most_bits` raises."""
        n = keys.count() if n_keys is None else n_keys
        bits = max(LEAST_BITS, n * bits_per_key)
        if bits > most_bits:
            raise ValueError(f"{n} keys need a filter of {bits} bits; join on the keys instead")
        probes = min(30, max(1, int(bits_per_key * log(2))))
        places = keys.where(F.col(column).isNotNull()).select(F.explode(cls._places(F.col(column), bits, probes)).alias("p"))
        words = places.groupBy(F.floor(F.col("p") / cls.WORD).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("p") % cls.WORD).cast("int"))).alias("b"))
        return cls({r.w: r.b for r in words.collect()}, bits, probes)

    @staticmethod
    def _places(key: Column, bits: int, probes: int) -> Column:
        a, b = F.xxhash64(key), F.xxhash64(key, F.lit(1))
        return F.transform(F.sequence(F.lit(0), F.lit(probes - 1)), lambda k: F.pmod(F.pmod(a, F.lit(bits)) + k * F.pmod(b, F.lit(bits)), F.lit(bits)))

    def may_match(self, key: Column) -> Column:
        words = [self.words.get(k, 0) for k in range(-(-self.bits // self.WORD))]
        table = F.from_json(F.lit(json.dumps(words)), "array<bigint>")
        return F.forall(
            self._places(key, self.bits, self.probes),
            lambda p: F.getbit(F.get(table, F.floor(p / self.WORD).cast("int")), (p % self.WORD).cast("int")) == 1,
        )
