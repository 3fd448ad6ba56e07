"""Reads over a change log: key STRING, seq BIGINT, op TINYINT (0 delete, 1 put), value.

One row is one version of a key. The newest version whose seq isn't above the
snapshot stands; a key whose newest version is a delete isn't there. With
`folded` (the store's default) keys that differ only in the case of ASCII letters
are one key, which shows in the spelling of its newest version. A log may hold
the form of the key that it is ordered and compared by as a column `at`, as the
store's files do; then filters reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import fold

DELETE, PUT = 0, 1
#: Keys a range that the bounds of ranges are taken from.
SAMPLE = 20


def at(log: DataFrame, folded: bool = True) -> Column:
    """What the keys of a log are ordered and compared by."""
    if "at" in log.columns:
        return F.col("at")
    return fold(F.col("key")) if folded else F.col("key")


def current(log: DataFrame, as_of: int | None = None, folded: bool = True) -> DataFrame:
    """key, seq, value: the keys there are at a snapshot (by default the latest).

    The newest version is an argmax, which is partly done before the shuffle, so a
    key with very many versions sends one row a task.
    """
    rows = log if as_of is None else log.where(F.col("seq") <= as_of)
    newest = F.max_by(F.struct("key", "seq", "op", "value"), "seq")
    found = rows.groupBy(at(rows, folded).alias("_id")).agg(newest.alias("v")).select("v.*")
    return found.where(F.col("op") == PUT).select("key", "seq", "value")


def get(log: DataFrame, key: str, as_of: int | None = None, folded: bool = True) -> DataFrame:
    """The row of one key; none if it is missing or deleted."""
    wanted = fold(F.lit(key)) if folded else F.lit(key)
    return current(log.where(at(log, folded) == wanted), as_of, folded)


def multi_get(log: DataFrame, keys: DataFrame, as_of: int | None = None, folded: bool = True) -> DataFrame:
    """The rows of those of `keys` (column key) that are there; the versions of others aren't shuffled for the argmax."""
    wanted = keys.select(at(keys, folded).alias("_id")).distinct()
    rows = log.withColumn("_id", at(log, folded)).join(wanted, "_id", "left_semi").drop("_id")
    return current(rows, as_of, folded)


def missing(log: DataFrame, keys: DataFrame, as_of: int | None = None, folded: bool = True) -> DataFrame:
    """Those of `keys` that are not there."""
    there = current(log, as_of, folded)
    there = there.select(at(there, folded).alias("_id"))
    return keys.withColumn("_id", at(keys, folded)).join(there, "_id", "left_anti").drop("_id")


def scan(log: DataFrame, begin: str | None = None, end: str | None = None, as_of: int | None = None, reverse: bool = False, folded: bool = True) -> DataFrame:
    """All keys in order, from `begin` up to and without `end`."""
    key, rows = at(log, folded), log
    if begin is not None:
        rows = rows.where(key >= (fold(F.lit(begin)) if folded else F.lit(begin)))
    if end is not None:
        rows = rows.where(key < (fold(F.lit(end)) if folded else F.lit(end)))
    found = current(rows, as_of, folded)
    return found.orderBy(at(found, folded).desc() if reverse else at(found, folded).asc())


def prefix(log: DataFrame, start: str, as_of: int | None = None, folded: bool = True) -> DataFrame:
    """Keys that begin with `start`, in order. Where to begin goes by the folded key, which keys belong by their own bytes."""
    near = log.where(at(log, folded).startswith(fold(F.lit(start)) if folded else F.lit(start)))
    found = current(near, as_of, folded).where(F.col("key").startswith(start))
    return found.orderBy(at(found, folded))


def first(log: DataFrame, n: int = 1, as_of: int | None = None, folded: bool = True) -> DataFrame:
    return scan(log, as_of=as_of, folded=folded).limit(n)


def last(log: DataFrame, n: int = 1, as_of: int | None = None, folded: bool = True) -> DataFrame:
    """The last n keys, the last one first."""
    return scan(log, as_of=as_of, reverse=True, folded=folded).limit(n)


def seek(log: DataFrame, key: str, as_of: int | None = None, folded: bool = True) -> DataFrame:
    """The first key that isn't below `key`."""
    return scan(log, begin=key, as_of=as_of, folded=folded).limit(1)


def seek_previous(log: DataFrame, key: str, as_of: int | None = None, folded: bool = True) -> DataFrame:
    """The last key below `key`: where a cursor stands that sought `key` and went one back."""
    return scan(log, end=key, as_of=as_of, reverse=True, folded=folded).limit(1)


def _bounds(keys: DataFrame, n: int) -> Column:
    """Up to n - 1 keys that cut a table into ranges of about equally many, from the SAMPLE keys a range that hash lowest."""
    rows = keys.select("at").where(F.col("at").isNotNull()).orderBy(F.xxhash64("at"), "at").limit(n * SAMPLE).collect()
    ordered = sorted((r["at"] for r in rows), key=lambda k: k.encode())
    cuts = sorted({ordered[len(ordered) * k // n] for k in range(1, n)}, key=lambda k: k.encode()) if ordered else []
    return F.array(*[F.lit(c) for c in cuts]).cast("array<string>")


def seek_each(log: DataFrame, probes: DataFrame, as_of: int | None = None, folded: bool = True, ranges: int | None = None) -> DataFrame:
    """probe, key: for each probe (column probe) the first key not below it, or null.

    Keys and probes are dealt to ranges of keys and merged by a window there. What a
    range's probes don't find in it is the first key of a later one, of which there
    is one a range; no probe is compared with all keys.
    """
    there = current(log, as_of, folded)
    there = there.select(at(there, folded).alias("at"), "key")
    n = ranges or int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = probes.select((fold(F.col("probe")) if folded else F.col("probe")).alias("at"), F.col("probe"))
    both = there.select("at", "key", F.lit(None).cast("string").alias("probe"), F.lit(1).alias("is_key")).unionByName(asked.select("at", F.lit(None).cast("string").alias("key"), "probe", F.lit(0).alias("is_key")))
    # by range of keys, and in it from the end: the nearest key at or after a row. The bounds are values, so that
    # every use of the ranges has the same ones
    bounds = _bounds(there, n)
    dealt = both.where(F.col("at").isNotNull()).withColumn("range", F.size(F.filter(bounds, lambda x: x <= F.col("at"))))
    after = Window.partitionBy("range").orderBy(F.col("at").desc(), F.col("is_key").desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = dealt.withColumn("hit", F.last("key", ignorenulls=True).over(after))
    heads = dealt.where("is_key = 1").groupBy("range").agg(F.min_by("key", "at").alias("head"))
    later = Window.orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = log.sparkSession.range(n).select(F.col("id").cast("int").alias("range")).join(heads, "range", "left")
    nexts = every.select("range", F.last("head", ignorenulls=True).over(later).alias("next"))
    rows = found.where("is_key = 0").join(F.broadcast(nexts), "range")  # a row a range
    return rows.select("probe", F.coalesce("hit", "next").alias("key"))


def as_batch(rows: DataFrame, base: int, order: str = "position") -> DataFrame:
    """A batch's operations as versions: each takes its own sequence number after `base`, so of equal keys the last one wins."""
    return rows.withColumn("seq", F.lit(base).cast("bigint") + F.col(order).cast("bigint") + 1)


def size_of(rows: DataFrame, *batch: Column) -> DataFrame:
    """operations, bytes of a batch; or of each, if columns say which one a row is of."""
    size = F.octet_length(F.col("key")) + F.coalesce(F.octet_length(F.col("value")), F.lit(0))
    return rows.groupBy(*batch).agg(F.count(F.lit(1)).alias("operations"), F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("bytes"))


def merge_runs(runs: list[DataFrame], *order: str) -> DataFrame:
    """Sorted runs as one sorted table; rows that are in several runs are kept as often."""
    whole = runs[0]
    for r in runs[1:]:
        whole = whole.unionByName(r)
    return whole.orderBy(*order)
