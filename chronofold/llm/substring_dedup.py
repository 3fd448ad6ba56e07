"""Substring dedup with difference-cover anchors.

A passage of WINDOW words that also starts earlier is found without hashing all
windows: a difference cover D of a period v holds, for any two starts, a shift
under v that takes both to places in D modulo v. So anchors, runs of
WINDOW - v + 1 words hashed only at places in D, include for any two equal
windows one pair at the same distance from both starts. Only windows that hold an
anchor found twice or more are extended to their full length, hashed (96 bits) and
compared; the others can't be repeats.

Documents are dealt to parts, which are ranges of ids. A part sends the distinct
hashes of its anchors, once each however often they occur, to buckets by hash; a
bucket answers with one bit a hash: whether it occurs twice or more. The extended
windows go the same way, and the bit says whether the part is the first to hold
it. So a passage in a third of all documents costs a part one hash, not one a
document; no pairs are ever made, and the texts are shuffled once.

Order: by id, then start; rows with one id stand in the order of a hash of their
texts, null ids last. An id that fills several ranges is dealt to as many parts. Edge cases: a null text has no words; a text shorter than the window
loses none; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Ranges, give_back, shuffle_partitions, slices, text_rank, utf8
from .wordhash import Words, mix, runs

WINDOW = 20
#: Perfect difference covers by period (fixed values): each difference modulo the period is one of two members.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52)}
#: Words of an anchor at least, so that chance doesn't repeat it.
LEAST_ANCHOR = 8
#: Parts a shuffle partition. Each part sends a row to each bucket, and gets one back, so there are fewer of those: one to two partitions.
SPREAD = 2
SLICE_BYTES = 8 << 20

OUTPUT = "id bigint, n_words bigint, n_removed bigint, removed array<struct<start:int,end:int>>, kept string"


def period_for(window: int) -> int:
    return max((v for v in COVERS if window - v + 1 >= LEAST_ANCHOR), default=1)


def bucket_edges(hashes: np.ndarray, n: int) -> np.ndarray:
    """Where each of n buckets begins among sorted hashes (by their high bits), one more at the end."""
    lows = np.array([(k << 64) // n + ((k << 64) % n > 0) for k in range(n)], np.uint64)
    return np.append(np.searchsorted(hashes, lows), len(hashes))


def buckets(spark: SparkSession) -> int:
    return max(1, shuffle_partitions(spark) // 2)


class Part:
    """The documents of a part: their anchors, and the windows that repeated anchors lead to."""

    def __init__(self, table: pa.Table, window: int):
        ids, texts = table.column("id").to_pylist(), table.column("raw").to_pylist()
        ranks = table.column("rank").to_pylist()
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0, ranks[k], texts[k]))
        self.ids, self.texts = [ids[k] for k in order], [texts[k] for k in order]
        self.window, self.period = window, period_for(window)
        self.width = window - self.period + 1
        in_cover = np.zeros(self.period, bool)
        in_cover[list(COVERS[self.period])] = True
        self.slices, found = [], []
        for at in slices([len(t) for t in self.texts], SLICE_BYTES):
            words = Words(self.texts[at])
            h = words.hashes()
            enough = words.sizes[words.text] >= window
            starts = np.flatnonzero(in_cover[words.place % self.period] & enough & (words.left() >= self.width))
            found.append(runs(h, self.width)[starts])
            self.slices.append((at, words, h, starts))
        hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
        self.anchors, self.inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        self.twice = counts > 1

    def windows(self, repeated: np.ndarray) -> None:
        """repeated: a bit for each of `anchors`. Sets `first`, `second` (their hashes) and the places of the windows that stay."""
        found, done, before = [], 0, 0
        for _, words, h, starts in self.slices:
            marks = np.zeros(len(words) + 1, np.int64)
            mine = self.inverse[done : done + len(starts)]
            marks[starts[repeated[mine]] + 1] = 1
            done += len(starts)
            upto = np.cumsum(marks)
            every = np.arange(len(words))
            near = upto[np.minimum(every + self.period, len(words))] > upto[every]
            at = every[near & (words.left() >= self.window)]
            if len(at):
                second = runs(mix(h + np.uint64(0x632BE59BD9B4E019)), self.window, 0xD1342543DE82EF95)
                found.append((runs(h, self.window)[at], (second[at] >> np.uint64(32)).astype(np.uint32), at + before))
            before += len(words)
        none = (np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64))
        first, second, self.places = (np.concatenate(x) for x in zip(*(found or [none]), strict=True))
        order = np.lexsort((self.places, second, first))
        first, second = first[order], second[order]
        new = np.ones(len(order), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        self.first, self.second = first[new], second[new]
        self.kind = np.empty(len(order), np.int64)
        self.kind[order] = np.cumsum(new) - 1
        self.earliest = self.places[order[new]]  # of a kind, as places break ties

    def removed(self, owned: np.ndarray) -> np.ndarray:
        """owned: a bit for each window hash, whether the part is the first to hold it. Marks of words to remove."""
        n = sum(len(w) for _, w, _, _ in self.slices)
        again = self.places[~(owned[self.kind] & (self.earliest[self.kind] == self.places))]
        step = np.zeros(n + 1, np.int64)
        np.add.at(step, again, 1)
        np.add.at(step, again + self.window, -1)
        return np.cumsum(step[:-1]) > 0


def _send(part: int, n: int, hashes: np.ndarray, more: np.ndarray) -> pa.Table:
    edges = bucket_edges(hashes, n)
    full = np.flatnonzero(np.diff(edges))
    raw = [(hashes[edges[k] : edges[k + 1]].tobytes(), more[edges[k] : edges[k + 1]].tobytes()) for k in full]
    return pa.table(
        {
            "bucket": pa.array(full.astype(np.int32)),
            "part": pa.array([part] * len(full), pa.int32()),
            "hashes": pa.array([x[0] for x in raw], pa.binary()),
            "more": pa.array([x[1] for x in raw], pa.binary()),
        }
    )


SENT = "bucket int, part int, hashes binary, more binary"
ANSWER = "part int, kind int, bucket int, bits binary"


def _answer(kind: int):
    """What a bucket tells each part about the hashes it sent. kind 1, anchors: twice or more; kind 2, windows: first here."""

    def answer(table):
        bucket = table.column("bucket")[0].as_py()
        parts = np.asarray(table.column("part"))
        order = np.argsort(parts)
        raw = table.column("hashes").to_pylist()
        more = table.column("more").to_pylist()
        hashes = [np.frombuffer(raw[k], np.uint64) for k in order]
        extra = np.concatenate([np.frombuffer(more[k], np.uint32 if kind == 2 else bool) for k in order])
        ends = np.cumsum([len(h) for h in hashes])
        every = np.concatenate(hashes)
        if kind == 1:
            by = np.argsort(every, kind="stable")
            same = every[by][1:] == every[by][:-1]
        else:
            by = np.lexsort((extra, every))  # stable: equal ones stay in the order of parts
            same = (every[by][1:] == every[by][:-1]) & (extra[by][1:] == extra[by][:-1])
        bits = np.zeros(len(every), bool)
        if kind == 1:
            bits[by[1:][same]] = bits[by[:-1][same]] = True
            bits |= extra
        else:
            bits[by] = np.concatenate([[True], ~same])
        packed = [np.packbits(b).tobytes() for b in np.split(bits, ends[:-1])]
        return pa.table(
            {
                "part": pa.array(parts[order].astype(np.int32)),
                "kind": pa.array([kind] * len(order), pa.int32()),
                "bucket": pa.array([bucket] * len(order), pa.int32()),
                "bits": pa.array(packed, pa.binary()),
            }
        )

    return answer


def _bits(answers: pa.Table, kind: int, hashes: np.ndarray, n: int) -> np.ndarray:
    """The answers of one kind, in the order of the hashes sent."""
    sizes = np.diff(bucket_edges(hashes, n))
    rows = [(b, x) for k, b, x in zip(*(answers.column(c).to_pylist() for c in ("kind", "bucket", "bits")), strict=True) if k == kind]
    got = [np.unpackbits(np.frombuffer(x, np.uint8), count=sizes[b]).astype(bool) for b, x in sorted(rows)]
    bits = np.concatenate(got) if got else np.zeros(0, bool)
    if len(bits) != len(hashes):
        raise RuntimeError("a part's answers don't fit what it sent")
    return bits


def dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: id, n_words, n_removed, removed (runs of word numbers, end exclusive) and kept (words joined by one space)."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), utf8(F.col(text_col)).alias("raw"))
    ranges = Ranges(rows, "id", SPREAD, F.col("raw"))
    n = buckets(docs.sparkSession)
    dealt = rows.withColumns({"rank": text_rank(F.col("raw")), "part": ranges.number()})

    def send_anchors(key, table):
        give_back()
        p = Part(table, window)
        return _send(key[0].as_py(), n, p.anchors, p.twice)

    def send_windows(key, left, right):
        give_back()
        p = Part(left, window)
        p.windows(_bits(right, 1, p.anchors, n))
        return _send(key[0].as_py(), n, p.first, p.second)

    def finish(key, left, right):
        give_back()
        p = Part(left, window)
        p.windows(_bits(right, 1, p.anchors, n))
        marks = p.removed(_bits(right, 2, p.first, n))
        columns: list[list] = [[], [], [], []]
        before = 0
        for at, words, _, _ in p.slices:
            gone = marks[before : before + len(words)]
            before += len(words)
            for k in range(at.stop - at.start):
                own = gone[words.first[k] : words.first[k + 1]]
                turns = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]])))
                columns[0].append(len(own))
                columns[1].append(int(own.sum()))
                columns[2].append([{"start": a, "end": b} for a, b in turns.reshape(-1, 2).tolist()])
                columns[3].append(b" ".join(words.strings(~gone, k)).decode("utf-8", "replace"))
        ids = pa.array(p.ids, pa.int64())
        spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.table([ids, pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], spans), pa.array(columns[3], pa.string())], names=["id", "n_words", "n_removed", "removed", "kept"])

    anchors = dealt.groupBy("part").applyInArrow(send_anchors, SENT)
    repeated = anchors.groupBy("bucket").applyInArrow(_answer(1), ANSWER)
    windows = dealt.groupBy("part").cogroup(repeated.groupBy("part")).applyInArrow(send_windows, SENT)
    owned = windows.groupBy("bucket").applyInArrow(_answer(2), ANSWER)
    answers = repeated.unionByName(owned)
    done = dealt.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(finish, OUTPUT)
    return done.select(F.col("id").alias(id_col), "n_words", "n_removed", "removed", "kept")
