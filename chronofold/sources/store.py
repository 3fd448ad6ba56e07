"""The versioned key/value store: batches of puts and deletes, reads at snapshots, compaction.

A write is one Parquet folder and one commit; its operations take consecutive
sequence numbers and become visible together. Batches that are written at the same
time share a folder and a commit. Snapshots are sequence numbers with names, kept
in the commits, and bound what compaction may drop.

Files hold, beside a key, what it is compared by (`at`: the folded key), are sorted
by it and carry a Bloom filter of it; a commit says between which keys each folder
lies. So a read opens only folders that may hold its keys, and the scan skips row
groups by their bounds and filters.

A write makes a folder of level 0. A level is due when it has LEVEL0 folders (level
0) or more bytes than its share, LEVEL_BYTES times ten to the level above 1.
Compaction writes a level's folders, with those of the next that they overlap, into
the next, and a commit puts the new folder in their place; a reader of the commit
before sees those. A store with auto_compact does that after each write, and a
writer that finds too many folders in level 0 waits, or compacts first.
"""

from __future__ import annotations

import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import LOWER, UPPER, fold
from ..operators import changelog
from ..operators.compaction import compact
from .commits import CommitLog, Conflict, Corrupted
from .files import file_statistics, with_bloom

VERSIONS = "key string, at string, seq bigint, op tinyint, value string"
EMPTY = {"seq": 0, "folders": [], "snapshots": {}, "folded": True, "compactions": {}}
#: Folders of level 0 that are due for compaction; that make a writer wait a moment; that make it compact first.
LEVEL0, SLOW, STOP = 4, 8, 12
#: Bytes of level 1; each further level has ten times as many.
LEVEL_BYTES = 10 << 30
#: Bytes of waiting batches that are written together.
GROUP_BYTES = 1 << 20
#: Seconds after which a folder that no commit names is a lost writer's.
ORPHAN_SECONDS = 86_400
_FOLD = str.maketrans(UPPER, LOWER)


class WriteBatch:
    """Operations in the order in which they are to apply."""

    def __init__(self):
        self.rows: list[tuple[str, int, str | None]] = []

    def put(self, key: str, value: str) -> WriteBatch:
        self.rows.append((key, changelog.PUT, value))
        return self

    def delete(self, key: str) -> WriteBatch:
        """A delete hides all older versions of the key; the key needn't be there."""
        self.rows.append((key, changelog.DELETE, None))
        return self

    @property
    def operations(self) -> int:
        return len(self.rows)

    @property
    def size(self) -> int:
        return sum(len(k.encode()) + len((v or "").encode()) for k, _, v in self.rows)


class _Waiting:
    """A batch that waits to be written with others."""

    def __init__(self, batch: WriteBatch):
        self.batch, self.seq, self.error = batch, None, None


class Store:
    """auto_compact: compact levels that are due after each write. verify: check the checksums of all pages read."""

    def __init__(self, spark: SparkSession, path: str, create_if_missing: bool = True, error_if_exists: bool = False, folded: bool = True, auto_compact: bool = False, verify: bool = False, level_bytes: int = LEVEL_BYTES):
        self.spark, self.path, self.auto_compact, self.verify, self.level_bytes = spark, path.rstrip("/"), auto_compact, verify, level_bytes
        self._queue: list[_Waiting] = []
        self._queue_lock, self._write_lock = threading.Lock(), threading.Lock()
        self.commits = CommitLog(spark, f"{self.path}/_commits")
        last = self.commits.last()
        if last is None:
            if not create_if_missing:
                raise FileNotFoundError(f"there is no store in {path}")
            self.commits.commit(1, EMPTY | {"folded": folded})
        elif error_if_exists:
            raise FileExistsError(f"there is a store in {path}")
        elif last[1]["folded"] != folded:
            raise ValueError(f"the store in {path} was made for {'folded' if last[1]['folded'] else 'bytewise'} keys")
        self.folded = folded

    def _state(self) -> tuple[int, dict]:
        return self.commits.last()

    def _change(self, change, retries: int = 20):
        """Commit change(number, state) -> (new state, result, folders written), anew if another writer was first."""
        for _ in range(retries):
            number, state = self._state()
            new, out, made = change(number, state)
            try:
                self.commits.commit(number + 1, new)
                return out
            except Conflict:
                for f in made:
                    self.commits.delete(f"{self.path}/{f['name']}")
                time.sleep(0.05)
        raise Conflict(f"{retries} changes of {self.path} were outrun by others")

    def _id(self, key: str) -> str:
        return key.translate(_FOLD) if self.folded else key

    # -- folders ------------------------------------------------------------------------------------

    def _write_folder(self, rows: DataFrame, number: int, level: int, known: dict | None = None) -> list[dict]:
        """The versions as a folder, described; none if there are none. known: n, smallest and largest of rows that the driver has made, as one file."""
        name = f"data-{number:010d}-{uuid.uuid4().hex[:8]}"
        path = f"{self.path}/{name}"
        with_bloom(rows.select("key", "at", "seq", "op", "value").sortWithinPartitions("at", F.col("seq").desc()).write, "at").parquet(path)
        if known is not None:
            return [{"name": name, "level": level, "files": 1, "size": self.commits.size(path)} | known]
        files = file_statistics(self.spark, path, "at", VERSIONS)
        found = files.agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.min("smallest").alias("smallest"), F.max("largest").alias("largest")).first()
        if not found.n:
            self.commits.delete(path)
            return []
        return [{"name": name, "level": level} | found.asDict()]

    def _read_folders(self, folders: list[dict]) -> DataFrame:
        paths = [f"{self.path}/{f['name']}" for f in folders]
        if lost := [p for p in paths if not self.commits.has(p)]:
            raise Corrupted(f"missing: {', '.join(lost)}")
        reader = self.spark.read.schema(VERSIONS).option("parquet.page.verify-checksum.enabled", str(self.verify).lower())
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], VERSIONS)

    @staticmethod
    def _between(folders: list[dict], begin: str | None, end: str | None) -> list[dict]:
        """Folders that may hold keys (as compared) from begin to end, both within. By bytes, as Spark orders strings."""
        low, high = (None if x is None else x.encode() for x in (begin, end))
        return [f for f in folders if (low is None or f["largest"].encode() >= low) and (high is None or f["smallest"].encode() <= high)]

    # -- writing ------------------------------------------------------------------------------------

    def write(self, batch: WriteBatch | DataFrame) -> int:
        """Apply a batch, or a table (key, op, value, position) whose positions are 0 to n - 1; the last sequence number."""
        if isinstance(batch, DataFrame):
            done = self._write_rows(batch)
        elif not batch.rows:
            return self._state()[1]["seq"]
        else:
            done = self._write_with_others(batch)
        if self.auto_compact:
            self.compact_if_needed()
        return done

    def _write_with_others(self, batch: WriteBatch) -> int:
        """Batches that came while another write was under way are written by the first of them that gets its turn."""
        mine = _Waiting(batch)
        with self._queue_lock:
            self._queue.append(mine)
        with self._write_lock:
            if mine.seq is None and mine.error is None:
                group, size = [], 0
                with self._queue_lock:
                    while self._queue and (not group or size + self._queue[0].batch.size <= GROUP_BYTES or mine not in group):
                        group.append(self._queue.pop(0))
                        size += group[-1].batch.size
                self._write_group(group)
        if mine.error is not None:
            raise mine.error
        return mine.seq

    def _write_group(self, group: list[_Waiting]) -> None:
        every = [row for w in group for row in w.batch.rows]
        rows = self.spark.createDataFrame([(k, op, v, p) for p, (k, op, v) in enumerate(every)], "key string, op int, value string, position bigint").coalesce(1)
        keys = sorted((self._id(k) for k, _, _ in every), key=str.encode)
        try:
            seq = self._write_rows(rows, {"n": len(every), "smallest": keys[0], "largest": keys[-1]}) - len(every)
        except Exception as e:
            for w in group:
                w.error = e
            return
        for w in group:
            seq += w.batch.operations
            w.seq = seq

    def _write_rows(self, rows: DataFrame, known: dict | None = None) -> int:
        self._hold_back()

        def change(number, state):
            base = state["seq"]
            key = fold(F.col("key")) if self.folded else F.col("key")
            numbered = changelog.as_batch(rows, base).select("key", key.alias("at"), "seq", F.col("op").cast("tinyint").alias("op"), F.col("value").cast("string").alias("value"))
            made = self._write_folder(numbered, number + 1, 0, known)
            if not made:
                return state, base, made
            n = made[0]["n"]
            if known is not None:
                return state | {"seq": base + n, "folders": [*state["folders"], *made]}, base + n, made
            seqs = self._read_folders(made).agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.count_distinct("seq").alias("n")).first()
            if (seqs.lo, seqs.hi, seqs.n) != (base + 1, base + n, n):
                self.commits.delete(f"{self.path}/{made[0]['name']}")
                raise ValueError("the positions of a batch's rows must be 0 to n - 1, each once")
            return state | {"seq": base + n, "folders": [*state["folders"], *made]}, base + n, made

        return self._change(change)

    def _hold_back(self) -> None:
        """Too many folders in level 0 make reads slow: a writer waits a moment, or compacts first."""
        if self.auto_compact:
            n = sum(f["level"] == 0 for f in self._state()[1]["folders"])
            if n >= STOP:
                self.compact_level(0)
            elif n >= SLOW:
                time.sleep(0.001)

    def put(self, key: str, value: str) -> int:
        return self.write(WriteBatch().put(key, value))

    def delete(self, key: str) -> int:
        return self.write(WriteBatch().delete(key))

    # -- reading ------------------------------------------------------------------------------------

    def versions(self, begin: str | None = None, end: str | None = None) -> DataFrame:
        """All versions there are; with bounds (of keys as compared, both within) those in folders that may hold such keys."""
        return self._read_folders(self._between(self._state()[1]["folders"], begin, end))

    def _as_of(self, snapshot: str | int | None) -> int:
        state = self._state()[1]
        if isinstance(snapshot, str):
            return state["snapshots"][snapshot]
        return state["seq"] if snapshot is None else snapshot

    def find(self, key: str, snapshot: str | int | None = None) -> DataFrame:
        """key, seq, value of one key, as a table."""
        at = self._id(key)
        return changelog.get(self.versions(at, at), key, self._as_of(snapshot), self.folded)

    def read(self, key: str, snapshot: str | int | None = None) -> str | None:
        row = self.find(key, snapshot).first()
        return row.value if row else None

    def read_all(self, keys: DataFrame, snapshot: str | int | None = None) -> DataFrame:
        """key, seq, value of those of `keys` (column key) that are there."""
        return changelog.multi_get(self.versions(), keys, self._as_of(snapshot), self.folded)

    def scan(self, begin: str | None = None, end: str | None = None, snapshot: str | int | None = None, reverse: bool = False) -> DataFrame:
        low, high = (None if x is None else self._id(x) for x in (begin, end))
        return changelog.scan(self.versions(low, high), begin, end, self._as_of(snapshot), reverse, self.folded)

    def prefix(self, start: str, snapshot: str | int | None = None) -> DataFrame:
        at = self._id(start)
        return changelog.prefix(self.versions(at, at + chr(0x10FFFF) * 8), start, self._as_of(snapshot), self.folded)

    def seek(self, key: str, snapshot: str | int | None = None) -> DataFrame:
        return changelog.seek(self.versions(self._id(key)), key, self._as_of(snapshot), self.folded)

    def seek_previous(self, key: str, snapshot: str | int | None = None) -> DataFrame:
        return changelog.seek_previous(self.versions(None, self._id(key)), key, self._as_of(snapshot), self.folded)

    # -- snapshots and maintenance ------------------------------------------------------------------

    def snapshot(self, name: str | None = None) -> str:
        """Keep what can be read now, under a name."""
        name = name or uuid.uuid4().hex
        return self._change(lambda _, s: (s | {"snapshots": s["snapshots"] | {name: s["seq"]}}, name, []))

    def release(self, name: str) -> None:
        self._change(lambda _, s: (s | {"snapshots": {k: v for k, v in s["snapshots"].items() if k != name}}, None, []))

    def _merge(self, number: int, state: dict, inputs: list[dict], level: int, begin: str | None, end: str | None) -> tuple[dict, None, list[dict]]:
        """The state with these folders' surviving versions as one folder of a level."""
        started = time.monotonic()
        least = min([state["seq"], *state["snapshots"].values()])
        others = [f for f in state["folders"] if f not in inputs]
        # a delete must stay while something older that it hides may lie deeper
        low, high = min(f["smallest"] for f in inputs), max(f["largest"] for f in inputs)
        alone = not any(f["level"] > level for f in self._between(others, low, high))
        left = compact(self._read_folders(inputs), least, begin, end, self.folded, alone)
        made = self._write_folder(left.repartitionByRange("at"), number + 1, level)
        was = state["compactions"].get(str(level), {"runs": 0, "milliseconds": 0, "read": 0, "written": 0})
        now = {"runs": 1, "milliseconds": round(1000 * (time.monotonic() - started)), "read": sum(f["size"] for f in inputs), "written": sum(f["size"] for f in made)}
        return state | {"folders": [*others, *made], "compactions": state["compactions"] | {str(level): {k: was[k] + now[k] for k in was}}}, None, made

    def compact(self, begin: str | None = None, end: str | None = None) -> None:
        """Drop the versions that no snapshot needs (of the keys from begin to end, both within). Folders that hold none of these keys stay as they are."""

        def change(number, state):
            inputs = self._between(state["folders"], *(None if x is None else self._id(x) for x in (begin, end)))
            if not inputs:
                return state, None, []
            return self._merge(number, state, inputs, max(1, *(f["level"] for f in inputs)), begin, end)

        self._change(change)

    def compact_level(self, level: int) -> None:
        """Move a level's versions into the next one, with the folders there that they overlap."""

        def change(number, state):
            own = [f for f in state["folders"] if f["level"] == level]
            if not own:
                return state, None, []
            low, high = (pick((f[k] for f in own), key=str.encode) for pick, k in ((min, "smallest"), (max, "largest")))
            below = [f for f in state["folders"] if f["level"] == level + 1]
            return self._merge(number, state, own + self._between(below, low, high), level + 1, None, None)

        self._change(change)

    def scores(self) -> dict[int, float]:
        """By level, how much of its share it has; from 1 on it is due for compaction."""
        out: dict[int, float] = {}
        for f in self._state()[1]["folders"]:
            out[f["level"]] = out.get(f["level"], 0) + (1 / LEVEL0 if f["level"] == 0 else f["size"] / (self.level_bytes * 10 ** (f["level"] - 1)))
        return out

    def compact_if_needed(self) -> list[int]:
        """Compact the level that is due most, until none is; the levels compacted."""
        done = []
        while (scores := self.scores()) and max(scores.values()) >= 1:
            done.append(max(scores, key=scores.get))
            self.compact_level(done[-1])
        return done

    def needs_compaction(self) -> bool:
        return any(x >= 1 for x in self.scores().values())

    def vacuum(self, orphan_seconds: float = ORPHAN_SECONDS) -> list[str]:
        """Delete folders that the state doesn't name, which readers of older states lose, and those of writers that were lost on the way."""
        number, state = self._state()
        named = {f["name"] for f in state["folders"]}
        old = {f["name"] for n in self.commits.numbers() for f in self.commits.read(n)["folders"]} - named
        lost = {name for name, at in self.commits.folders(self.path, "data-").items() if at < time.time() - orphan_seconds} - named
        for name in old | lost:
            self.commits.delete(f"{self.path}/{name}")
        self.commits.drop_before(number)
        return sorted(old | lost)

    def statistics(self) -> DataFrame:
        """level, n_files, size, n, smallest, largest, score. From the commit alone."""
        rows = [(f["level"], f["files"], f["size"], f["n"], f["smallest"], f["largest"]) for f in self._state()[1]["folders"]]
        folders = self.spark.createDataFrame(rows, "level int, n_files bigint, size bigint, n bigint, smallest string, largest string")
        whole = folders.groupBy("level").agg(F.sum("n_files").alias("n_files"), F.sum("size").alias("size"), F.sum("n").alias("n"), F.min("smallest").alias("smallest"), F.max("largest").alias("largest"))
        scores = self.spark.createDataFrame(list(self.scores().items()), "level int, score double")
        return whole.join(F.broadcast(scores), "level").orderBy("level")  # a row a level

    def compaction_statistics(self) -> DataFrame:
        """level written to, runs, milliseconds, bytes_read, bytes_written of all compactions so far."""
        rows = [(int(k), *(v[x] for x in ("runs", "milliseconds", "read", "written"))) for k, v in sorted(self._state()[1]["compactions"].items())]
        return self.spark.createDataFrame(rows, "level int, runs bigint, milliseconds bigint, bytes_read bigint, bytes_written bigint")
