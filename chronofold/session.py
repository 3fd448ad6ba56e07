"""Sessions with the settings that the library relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: Times are UTC; plans are corrected while they run, skewed joins included.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.files.ignoreCorruptFiles": "false",
    "spark.sql.files.ignoreMissingFiles": "false",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session for `master` (or the one that spark-submit names) with SETTINGS and `settings` (dots as __)."""
    builder = SparkSession.builder.appName("chronofold")
    if master:
        builder = builder.master(master)
    for k, v in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by spark.checkpoint.dir. In local mode, where all is one machine, a temporary one if none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("on a cluster spark.checkpoint.dir must name a folder that driver and executors share")
    spark.conf.set("spark.checkpoint.dir", found := tempfile.mkdtemp(prefix="chronofold-"))
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
