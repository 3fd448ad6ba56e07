"""Files: their statistics, writing them with Bloom filters, other formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F


def file_statistics(spark: SparkSession, path: str, key: str | None = None, schema: str | None = None) -> DataFrame:
    """file, size, n, and the smallest and largest key of each Parquet file of a table."""
    rows = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    bounds = [F.min(key).alias("smallest"), F.max(key).alias("largest")] if key else []
    named = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), *([key] if key else []))
    return named.groupBy("file", "size").agg(F.count(F.lit(1)).alias("n"), *bounds)


def with_bloom(writer: DataFrameWriter, column: str, keys: int = 1_000_000) -> DataFrameWriter:
    """Let the Parquet files that are written hold a Bloom filter of a column, by which reads skip row groups."""
    return writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.expected.ndv#{column}", str(keys))


def read_fixed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a given schema; a line that doesn't fit is null but for _corrupt_record."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
