"""The append-only event log.

An event is a row (etag, topic, ts, data); data is its JSON with the topic in its
metadata. An append is one Spark write, by topic, into a folder of its own, and
then one commit that names the folder: all its events become visible together, in
order, with etags that go on from the last commit's. An append that another
writer outran is numbered anew from where that one ended.

Etags are dense. A table's rows are numbered without gathering them: each
partition's count, of which there is one a partition, gives its rows their start.
"""

from __future__ import annotations

import time
import uuid
from bisect import bisect_left
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import etag, etag_number, etag_parts, etag_text
from ..functions.values import ENTITY, stamped
from .commits import CommitLog, Conflict

#: Commits from one list of all folders to the next.
LISTED = 64

SCHEMA = T.StructType(
    [
        T.StructField("etag", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("data", T.StringType()),
        T.StructField("topic", T.StringType()),
    ]
)


class EventLog:
    """The log in folder `path`. Opening it begins a new epoch, as a number in etags that sorts before the event's own."""

    def __init__(self, spark: SparkSession, path: str, create_if_missing: bool = True, error_if_exists: bool = False, entity: str = ENTITY):
        self.spark, self.path, self.entity = spark, path.rstrip("/"), entity
        self.commits = CommitLog(spark, f"{self.path}/_commits")
        last = self.commits.last()
        if last is None and not create_if_missing:
            raise FileNotFoundError(f"there is no event log in {path}")
        if last is not None and error_if_exists:
            raise FileExistsError(f"there is an event log in {path}")
        number, state = last or (0, {"epoch": 0, "etag": None, "number": 0})
        self.epoch = state["epoch"] + 1
        self._publish(number, state, {"epoch": self.epoch})

    # -- commits: each names its own folder, and every LISTED-th one all folders before it ------------

    def _publish(self, number: int, state: dict, change: dict) -> None:
        new = {k: state[k] for k in ("epoch", "etag", "number")} | {"folder": None} | change
        if number % LISTED == 0:
            new["before"] = self._folders(number, state) if number else []
        self.commits.commit(number + 1, new)

    def _folders(self, number: int, state: dict, after: str | None = None) -> list[dict]:
        """Folders that a commit sees, those with later etags than `after`: back from it, no further than to the last list."""
        found = []
        while True:
            if state["folder"]:
                if after is not None and state["folder"]["last"] <= after:
                    break
                found.append(state["folder"])
            if "before" in state:
                found += [f for f in reversed(state["before"]) if after is None or f["last"] > after]
                break
            number -= 1
            state = self.commits.read(number)
        return found[::-1]

    def folders(self) -> list[dict]:
        """name, first and last etag, and count of each append."""
        return self._folders(*self._state())

    # -- reading ------------------------------------------------------------------------------------

    def _state(self) -> tuple[int, dict]:
        return self.commits.last()

    def last_etag(self) -> str | None:
        return self._state()[1]["etag"]

    def count(self) -> int:
        return self._state()[1]["number"]

    def events(self, after: str | None = None, topic: str | None = None, upto: str | None = None) -> DataFrame:
        """Events with a larger etag than `after`, as the log is now. Folders that hold none of them aren't listed, topics not asked for not read."""
        return self._read(self._folders(*self._state(), after), after, topic, upto)

    def cuts(self, after: str | None, upto: str, most: int) -> list[str]:
        """The etags at which to cut the events after `after`, up to `upto`, so that no part has more than `most`; the last is `upto`. From the commits alone."""
        out, held, last = [], 0, None
        for f in self._folders(*self._state(), after):
            if f["first"] > upto:
                break
            epoch, begin = etag_parts(f["first"])
            end = min(f["last"], upto)
            begin = max(begin, etag_parts(after)[1] + 1) if after is not None else begin
            n = etag_parts(end)[1] - begin + 1
            if held and held + n > most:
                out.append(last)
                held = 0
            while held + n > most:  # one append that is larger than a part
                begin, n = begin + most, n - most
                out.append(etag_text(begin - 1, epoch))
            held, last = held + n, end
        return [*out, upto] if not out or out[-1] != upto else out

    def batches(self, after: str | None, cuts: list[str], most: int) -> DataFrame:
        """The events up to the last of `cuts`, which are those of `most` after `after`, with the number of each one's part as batch."""
        folders = self._folders(*self._state(), after)
        ends, starts = [etag_parts(c)[1] for c in cuts], []
        for f in folders:
            begin = etag_parts(f["first"])[1]
            begin = max(begin, etag_parts(after)[1] + 1) if after is not None else begin
            starts.append((f["name"].removeprefix("commit="), bisect_left(ends, begin), begin))
        rows = self._read(folders, after, upto=cuts[-1], names=("commit", *SCHEMA.names))
        # a row a folder; one folder is cut into equal parts from its first event on, or not at all
        rows = rows.join(F.broadcast(self.spark.createDataFrame(starts, "commit string, part long, begin long")), "commit")
        batch = F.col("part") + F.floor((etag_number(F.col("etag")) - F.col("begin")) / most)
        return rows.select(*SCHEMA.names, batch.alias("batch"))

    def _read(self, folders: list[dict], after: str | None = None, topic: str | None = None, upto: str | None = None, names: Iterable[str] = SCHEMA.names) -> DataFrame:
        wanted = [f"{self.path}/{f['name']}" for f in folders if upto is None or f["first"] <= upto]
        if not wanted:
            return self.spark.createDataFrame([], SCHEMA)
        schema = T.StructType([*SCHEMA.fields[:-1], T.StructField("commit", T.StringType()), SCHEMA["topic"]])
        rows = self.spark.read.schema(schema).option("basePath", self.path).parquet(*wanted).select(*names)
        if after is not None:
            rows = rows.where(F.col("etag") > after)
        if upto is not None:
            rows = rows.where(F.col("etag") <= upto)
        if topic is not None:
            rows = rows.where(F.col("topic") == topic)
        return rows

    def scan(self, after: str | None = None, limit: int | None = None) -> DataFrame:
        """Events in order."""
        rows = self.events(after).orderBy("etag")
        return rows if limit is None else rows.limit(limit)

    def wait_for_append(self, after: str | None, timeout: float, poll: float = 0.2) -> bool:
        """Whether there is an event after `after` within `timeout` seconds."""
        end = time.monotonic() + timeout
        while True:
            last = self.last_etag()
            if last is not None and (after is None or last > after):
                return True
            if time.monotonic() >= end:
                return False
            time.sleep(poll)

    # -- writing ------------------------------------------------------------------------------------

    def append(self, topic: str, events: Iterable[str] | DataFrame | None, retries: int = 20) -> str | None:
        """Append JSON texts, or a table with a column data (and perhaps ts, topic), as one batch; the last etag, or None if there is nothing."""
        if events is None:
            return None
        if isinstance(events, DataFrame):
            rows = events
        else:
            listed = [(k, e) for k, e in enumerate(events)]
            rows = self.spark.createDataFrame(listed, "position int, data string").repartition(1).sortWithinPartitions("position") if listed else None
        if rows is None:
            return None
        data = F.col("data")
        name = F.col("topic") if "topic" in rows.columns else F.lit(topic)
        ts = F.col("ts") if "ts" in rows.columns else F.current_timestamp()
        draft = f"{self.path}/_drafts/{uuid.uuid4().hex}"
        # written once to fix the order in which the rows come, then numbered; stamped once, as an outrun append is numbered again
        rows.select(name.alias("topic"), ts.alias("ts"), stamped(data, name, self.entity).alias("data"), F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("arrival")).write.parquet(draft)
        try:
            for _ in range(retries):
                try:
                    return self._commit(self.spark.read.parquet(draft))
                except Conflict:
                    time.sleep(0.05)
            raise Conflict(f"{retries} appends to {self.path} were outrun by others")
        finally:
            self.commits.delete(draft)

    def _commit(self, draft: DataFrame) -> str | None:
        number, state = self._state()
        self.epoch = max(self.epoch, state["epoch"])
        counts = {r.p: (r.n, r.first) for r in draft.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.min("arrival").alias("first")).collect()}
        if not counts:
            return None
        base, starts = state["number"], []
        total = 0
        for p in sorted(counts):
            starts.append((p, base + total + 1 - counts[p][1]))
            total += counts[p][0]
        offsets = self.spark.createDataFrame(starts, "p int, start long")
        rows = draft.join(F.broadcast(offsets), "p")  # a row a partition
        folder = f"commit={number + 1:010d}-{uuid.uuid4().hex[:8]}"
        rows.select(etag(F.col("arrival") + F.col("start"), self.epoch).alias("etag"), "ts", "data", "topic").write.partitionBy("topic").parquet(f"{self.path}/{folder}")
        first, last = etag_text(base + 1, self.epoch), etag_text(base + total, self.epoch)
        try:
            self._publish(number, state, {"etag": last, "number": base + total, "folder": {"name": folder, "first": first, "last": last, "n": total}})
        except Conflict:
            self.commits.delete(f"{self.path}/{folder}")
            raise
        return last
