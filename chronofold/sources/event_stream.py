"""A stand-alone event stream: one topic, read from an etag inclusive, counted from metadata."""

from __future__ import annotations

import json
from collections.abc import Iterable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import field
from .event_log import EventLog

TOPIC = "stream"


class EventStream:
    def __init__(self, spark: SparkSession, path: str):
        self.log = EventLog(spark, path)

    def append(self, events: Iterable[dict] | DataFrame) -> str | None:
        """Append JSON objects, or a table's rows as such, each with the time of the append as @date."""
        now = datetime.now(UTC).isoformat()
        if isinstance(events, DataFrame):
            return self.log.append(TOPIC, events.select(F.to_json(F.struct(*events.columns, F.lit(now).alias("@date"))).alias("data")))
        return self.log.append(TOPIC, [json.dumps(e | {"@date": now}) for e in events])

    def read_from(self, start: str = "") -> DataFrame:
        """etag, date, data of the events at or after `start`, in order, each once."""
        before = max((f["last"] for f in self.log.folders() if f["last"] < start), default=None)
        rows = self.log.events(after=before).where(F.col("etag") >= start)
        return rows.select("etag", field(F.col("data"), "@date").alias("date"), "data").orderBy("etag")

    def count(self) -> int:
        """From the commits alone; no file is opened."""
        return self.log.count()

    def ranges(self) -> list[dict]:
        """first, last, n of each committed folder."""
        return self.log.folders()
