"""Histograms over fixed buckets: counts, extremes, mean, deviation, interpolated percentiles.

They merge by adding counts and sums, so partial histograms of many tasks or runs
are as good as one over all values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _limits() -> list[float]:
    """Upper limits: 1 to 10 by 1, then 12 to 9e9 in steps that grow with each decade; and one for all the rest."""
    steps = [1.2, 1.4, 1.6, 1.8, 2, 2.5, 3, 3.5, 4, 4.5, 5, 6, 7, 8, 9, 10]
    out = [float(k) for k in range(1, 11)]
    scale = 10.0
    while scale < 1e10:
        out += [round(scale * s, 6) for s in steps]
        scale *= 10
    return out[:-1] + [1e200]


#: 154 limits (fixed values of the data model, made by the rule above); the bucket of v is that of the first limit above v.
BUCKETS = _limits()


def bucket_of(value: Column) -> Column:
    """The number of a value's bucket: how many limits are not above it."""
    limits = F.array(*[F.lit(x) for x in BUCKETS[:-1]])
    return F.size(F.filter(limits, lambda x: x <= value))


def histogram(df: DataFrame, value: str) -> DataFrame:
    """bucket, low, high, n, lo, hi, total, squares: a row a bucket that has values (nulls have none)."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    found = rows.groupBy(bucket_of(F.col("v")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("v").alias("total"), F.sum(F.col("v") * F.col("v")).alias("squares")
    )
    limits = F.array(*[F.lit(x) for x in [0.0, *BUCKETS]])
    return found.select("bucket", F.get(limits, F.col("bucket")).alias("low"), F.get(limits, F.col("bucket") + 1).alias("high"), "n", "lo", "hi", "total", "squares")


def merge(histograms: DataFrame) -> DataFrame:
    return histograms.groupBy("bucket", "low", "high").agg(*[f(c).alias(c) for f, c in ((F.sum, "n"), (F.min, "lo"), (F.max, "hi"), (F.sum, "total"), (F.sum, "squares"))])


def summary(histograms: DataFrame) -> DataFrame:
    """n, lo, hi, mean, deviation (of the population) of a histogram."""
    n, mean = F.sum("n"), F.sum("total") / F.sum("n")
    return histograms.agg(n.alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.sum("squares") / n - mean * mean)).alias("deviation"))


def percentile(histograms: DataFrame, p: float) -> DataFrame:
    """value: the p-th percentile (0 to 100), by linear interpolation in its bucket, within the extremes. A row a bucket is all that one task sees."""
    by = Window.orderBy("bucket")
    rows = histograms.withColumns({"upto": F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(Window.partitionBy())})
    wanted = F.col("all") * (p / 100.0)
    ends = rows.agg(F.min("lo").alias("least"), F.max("hi").alias("most"))
    hit = rows.where(F.col("upto") >= wanted).orderBy("bucket").limit(1)
    share = (wanted - (F.col("upto") - F.col("n"))) / F.col("n")
    inside = F.col("low") + (F.col("high") - F.col("low")) * share
    return hit.crossJoin(F.broadcast(ends)).select(F.least(F.greatest(inside, "least"), "most").alias("value"))
