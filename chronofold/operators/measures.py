"""Measures of workloads: operations, bytes, time and rates, that add up over runs and workers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def roll_up(rows: DataFrame, op: Column, ops: Column, size: Column, elapsed: Column) -> DataFrame:
    """op, ops, bytes, elapsed, rate of workers that ran side by side: what they did is summed, the slowest sets the time; rate is bytes a unit of it."""
    found = rows.groupBy(op.alias("op")).agg(F.sum(ops).alias("ops"), F.sum(size).alias("bytes"), F.max(elapsed).alias("elapsed"))
    return found.withColumn("rate", F.try_divide(F.col("bytes").cast("double"), F.col("elapsed").cast("double")))
