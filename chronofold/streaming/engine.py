"""The engine: an event log, and named views that follow it.

Each view is a streaming query of its own over the log's commits: a micro-batch is
some commits, its events are those between the view's progress and the last etag
committed there, and `foreachBatch` folds them in. They are cut into batches of at
most `events` events, and many batches are one fold, with the results that they
give one after the other; if a fold fails, its halves are tried, so a view ends
with the batch before the one that it can't take. A new view starts at the log's
beginning. The query's checkpoint only says which commits have been seen; what is
in the results, and so what a repeated batch leaves out, the state itself says.

Order is the log's. There is no watermark: a late event changes its result. Events
that fail a map's checks go to the view's rejects, and after ERRORS of them in a
row the map stops for the rest of that batch; an error that gets through ends the
view's query, and its readers get it.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.keys import LOWER, UPPER
from ..operators import mapreduce
from ..operators.mapreduce import ERRORS, View
from ..sources.commits import CommitLog
from ..sources.event_log import EventLog
from .state import BUCKETS, State

_FOLD = str.maketrans(UPPER, LOWER)
#: Commits in a micro-batch.
COMMITS = 16
#: Events of a batch, at most: failing ones in a row are counted within a batch.
EVENTS = 1 << 16
#: Batches that are folded in at once, at most. Each fold is a commit of the state; the driver lists where batches end and maps stop.
BATCHES = 1 << 12


class Following:
    """A view, its state, and the query that keeps it current."""

    def __init__(self, log: EventLog, path: str, view: View, events: int = EVENTS, errors: int = ERRORS, buckets: int = BUCKETS):
        self.log, self.path, self.view, self.events, self.errors = log, path, view, events, errors
        self.state = State(log.spark, f"{path}/state", view, buckets)
        self.query: StreamingQuery | None = None

    def describe(self) -> str:
        return self.view.describe()

    # -- keeping current ------------------------------------------------------------------------------

    def _start(self, **trigger) -> StreamingQuery:
        if self.query is not None and self.query.isActive:
            return self.query
        self.query = None  # an ended one says nothing about the one that begins

        def take(commits: DataFrame, _: int) -> None:
            upto = commits.agg(F.max("etag")).first()[0]
            done = self.state.progress()
            if upto is not None and (done is None or upto > done):
                cuts = self.log.cuts(done, upto, self.events)
                for k in range(0, len(cuts), BATCHES):
                    done = self._take(done, cuts[k : k + BATCHES])

        commits = self.log.spark.readStream.schema("etag string").option("maxFilesPerTrigger", COMMITS).json(f"{self.log.path}/_commits")
        writer = commits.writeStream.foreachBatch(take).option("checkpointLocation", f"{self.path}/checkpoint")
        self.query = writer.trigger(**trigger).start()
        return self.query

    def _take(self, done: str | None, cuts: list[str]) -> str:
        """Fold in the batches that end at `cuts`, all at once; where that fails, by halves, down to the batch that fails."""
        try:
            self._fold(done, cuts)
        except Exception:
            stopped = self.query is not None and not self.query.isActive
            if len(cuts) == 1 or stopped or self.state.progress() != done:
                raise
            half = len(cuts) // 2
            self._take(self._take(done, cuts[:half]), cuts[half:])
        return cuts[-1]

    def _fold(self, done: str | None, cuts: list[str]) -> None:
        upto = cuts[-1]
        if not any(m.checks for m in self.view.maps):
            self.state.fold(self.log.events(after=done, upto=upto), upto)
            return
        for name in self._rejected():  # of a fold that didn't end
            if done is None or name > f"upto={done}":
                self.log.commits.delete(f"{self.path}/rejects/{name}")
        events = self.log.batches(done, cuts, self.events)
        stops = mapreduce.stops(self.view, events, self.errors)
        mapreduce.rejects(self.view, events, stops).drop("batch").write.mode("overwrite").parquet(f"{self.path}/rejects/upto={upto}")
        self.state.fold(events, upto, stops)

    def _rejected(self) -> list[str]:
        return sorted(self.log.commits.folders(f"{self.path}/rejects", "upto="))

    def rejects(self) -> DataFrame | None:
        """map, rejected_by, etag, ts, data, topic of the events that a map's checks kept out; None if no map has checks, or before the first batch."""
        done = self.progress()
        found = [f"{self.path}/rejects/{name}" for name in self._rejected() if done is not None and name <= f"upto={done}"]
        if not found or not any(m.checks for m in self.view.maps):
            return None
        return self.log.spark.read.parquet(*found)

    def start(self, interval: str = "1 second") -> StreamingQuery:
        """Follow the log until stopped."""
        return self._start(processingTime=interval)

    def catch_up(self) -> None:
        """Take up all that is committed now, and return."""
        self._start(availableNow=True).awaitTermination()

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()

    def check(self) -> None:
        """Raise what ended the query, if an error did."""
        if self.query is not None and (error := self.query.exception()) is not None:
            raise error

    def wait_for(self, etag: str | None, timeout: float = 60.0, poll: float = 0.1) -> None:
        """Return when the event with this etag is in the results; raises on a timeout or if the query has failed."""
        end = time.monotonic() + timeout
        while etag is not None and (self.progress() or "") < etag:
            self.check()
            if time.monotonic() >= end:
                raise TimeoutError(f"{self.view.name} is at {self.progress()}, not yet at {etag}")
            time.sleep(poll)

    def metrics(self) -> list[dict]:
        """Of the query's recent micro-batches: their number, commits taken up, and milliseconds by step."""
        recent = self.query.recentProgress if self.query is not None else []
        return [{"batch": p["batchId"], "commits": p["numInputRows"], "milliseconds": dict(p["durationMs"])} for p in recent]

    # -- reading --------------------------------------------------------------------------------------

    def progress(self) -> str | None:
        return self.state.progress()

    def results(self) -> DataFrame | None:
        """All results by key, with result_key; None before the first."""
        self.check()
        found = self.state.results()
        return None if found is None else mapreduce.results(self.view, found)

    def result(self, key: object) -> dict | list[dict] | None:
        """One key's result, the list of them where several keys differ only in case, or None."""
        self.check()
        found = self.state.results()
        rows = [] if found is None else mapreduce.result(found, key).drop("reduce_key").collect()
        listed = [r.asDict(recursive=True) for r in rows]
        return listed[0] if len(listed) == 1 else listed or None


class Engine:
    """events, errors, buckets: of each view, the events of a batch, the failing ones in a row that stop a map in it, and the parts that its results lie in."""

    def __init__(self, spark: SparkSession, path: str, events: int = EVENTS, errors: int = ERRORS, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        self.settings = {"events": events, "errors": errors, "buckets": buckets}
        self.log = EventLog(spark, f"{self.path}/events")
        self.definitions = CommitLog(spark, f"{self.path}/definitions")
        self.views: dict[str, Following] = {}
        for text in (self.definitions.last() or (0, {}))[1].values():
            view = View.from_json(text)
            self.views[view.name.translate(_FOLD)] = self._follow(view)

    def _follow(self, view: View) -> Following:
        name = "".join(c if c.isalnum() else f"_{ord(c):x}_" for c in view.name.translate(_FOLD))
        return Following(self.log, f"{self.path}/views/{name}-{view.version()}", view, **self.settings)

    def append(self, topic: str, events) -> str | None:
        return self.log.append(topic, events)

    def create(self, view: View) -> Following:
        """Define a view, or redefine the one with its name (whatever the case). Another meaning starts from nothing; the same one goes on."""
        key = view.name.translate(_FOLD)
        old = self.views.get(key)
        number, known = self.definitions.last() or (0, {})
        self.definitions.commit(number + 1, known | {key: view.to_json()})
        if old is not None and old.view.version() == view.version():
            old.view = view
            return old
        self.views[key] = self._follow(view)
        if old is not None:
            self._drop(old)
        return self.views[key]

    def get(self, name: str) -> Following | None:
        return self.views.get(name.translate(_FOLD))

    def remove(self, name: str) -> bool:
        """Forget a view with its results; whether there was one."""
        key = name.translate(_FOLD)
        old = self.views.pop(key, None)
        if old is None:
            return False
        number, known = self.definitions.last() or (0, {})
        self.definitions.commit(number + 1, {k: v for k, v in known.items() if k != key})
        self._drop(old)
        return True

    def _drop(self, old: Following) -> None:
        old.stop()
        self.definitions.delete(old.path)

    def stop(self) -> None:
        for f in self.views.values():
            f.stop()
