"""Compaction: which versions survive a rewrite.

A version goes when a newer one of its key isn't above the least snapshot that is
still wanted: nothing can read it any more. A delete that isn't above it goes too,
if nothing older is left elsewhere for it to hide. Reads at that snapshot or later
see the same before and after.

So of each key's versions up to the bound only the newest can stay: an argmax,
partly done before the shuffle. Versions above the bound, and those outside the
range of keys asked for, pass by without one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import fold
from .changelog import PUT, at


def compact(log: DataFrame, least_snapshot: int | None = None, begin: str | None = None, end: str | None = None, folded: bool = True, drop_deletes: bool = True) -> DataFrame:
    """The versions that stay. `least_snapshot`: the oldest snapshot still open (none: only the latest state is wanted).

    `begin` and `end` (both within) bound the keys that are rewritten; others stay as
    they are. `drop_deletes`: the log holds all versions of its keys that are older
    than those in it.
    """
    key, inside = at(log, folded), F.lit(True)
    if begin is not None:
        inside = inside & (key >= (fold(F.lit(begin)) if folded else F.lit(begin)))
    if end is not None:
        inside = inside & (key <= (fold(F.lit(end)) if folded else F.lit(end)))
    below = inside if least_snapshot is None else inside & (F.col("seq") <= least_snapshot)
    newest = log.where(below).groupBy(key.alias("_id")).agg(F.max_by(F.struct(*log.columns), "seq").alias("v")).select("v.*")
    if drop_deletes:
        newest = newest.where(F.col("op") == PUT)
    if begin is None and end is None and least_snapshot is None:
        return newest
    return newest.unionByName(log.where(~F.coalesce(below, F.lit(False))))
