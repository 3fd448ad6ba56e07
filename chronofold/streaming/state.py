"""A view's stored results and how far they go, published together.

Results lie in buckets by a hash of their reduce key. A batch rewrites the buckets
it touches into a new folder; one commit then names the folder of each bucket and
the last etag that is in them. So results and progress change in one step, a batch
that is repeated finds its etags done, and untouched results aren't read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.mapreduce import View, fold_into, map_rows, reduce_rows
from ..sources.commits import CommitLog

#: Parts that a view's results lie in, unless the engine is told otherwise. A view keeps the number it was made with; a
#: bucket is rewritten by one task, so there should be one for each 100 MB or so of results.
BUCKETS = 16


class State:
    def __init__(self, spark: SparkSession, path: str, view: View, buckets: int = BUCKETS):
        self.spark, self.path, self.view, self.buckets = spark, path.rstrip("/"), view, buckets
        self.commits = CommitLog(spark, f"{self.path}/_commits")

    def _last(self) -> tuple[int, dict]:
        return self.commits.last() or (0, {"etag": None, "folders": {}, "buckets": self.buckets})

    def progress(self) -> str | None:
        """The last etag whose event is in the results."""
        return self._last()[1]["etag"]

    def results(self) -> DataFrame | None:
        """All stored results; None before the first."""
        return self._read(self._last()[1]["folders"])

    def _read(self, folders: dict[str, str]) -> DataFrame | None:
        paths = [f"{self.path}/{name}/bucket={b}" for b, name in folders.items()]
        return self.spark.read.parquet(*paths) if paths else None

    def fold(self, events: DataFrame, upto: str, stops: dict[int, dict[int, str]] | None = None) -> None:
        """Take up events, all later than the progress, up to `upto`. stops: by a map's number, and then by batch, the etag that it doesn't go beyond."""
        number, last = self._last()
        self.buckets = last["buckets"]
        bucket = F.pmod(F.xxhash64("reduce_key"), F.lit(self.buckets)).cast("int")
        partial = reduce_rows(self.view, map_rows(self.view, events, stops)).persist()
        try:
            touched = [str(r.b) for r in partial.select(bucket.alias("b")).distinct().collect()]  # no more than there are buckets
            folders = dict(last["folders"])
            if touched:
                stored = self._read({b: f for b, f in folders.items() if b in touched})
                merged = fold_into(self.view, stored, partial)
                name = f"batch-{number + 1:010d}-{uuid.uuid4().hex[:8]}"
                merged.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}")
                folders |= dict.fromkeys(touched, name)
        finally:
            partial.unpersist()
        self.commits.commit(number + 1, {"etag": upto, "folders": folders, "buckets": self.buckets})
        self._clean(last, folders)

    def _clean(self, before: dict, now: dict[str, str]) -> None:
        """Folders that went out of use with the commit before this one; readers have had a batch's time to finish."""
        number, _ = self._last()
        older = [n for n in self.commits.numbers() if n < number - 1]
        used = set(now.values()) | set(before["folders"].values())
        for name in {f for n in older for f in self.commits.read(n)["folders"].values()} - used:
            self.commits.delete(f"{self.path}/{name}")
        self.commits.drop_before(number - 1)
