"""Byte-level BPE: ranked merges folded over the byte arrays of distinct words.

A task splits its texts into words (the vocabulary's pattern) and encodes each
distinct one once. The fold runs over all new words at a time, grouped by length:
a matrix of their bytes' ids, and in each step the ranks of neighbouring pairs
from the rank map, the lowest merged (the leftmost of equals), until no pair has
a rank. The documents take up their words' ids. Nothing is shuffled. Decoding is
a Spark expression: the ids' byte strings, from a literal array, concatenated.

Texts are first cut at single spaces between other characters, where no word of
the pattern can reach across; those pieces repeat, so the pattern runs once for
each distinct one (of the standard pattern a space and Latin letters are one word
anyway). A text with other white space beside a space is split whole.
A word of over LONG bytes (a run of thousands of letters) is merged by a heap
over the same ranks, as the matrix would take steps in proportion to its square.

The fold was first written as a Spark `aggregate` with a literal map. It gave
the same ids but took 57 to 150 microseconds a word, which no budget allows;
the README has the figures.

Edge cases: null and empty texts have no ids and decode to the empty string; a
special token's string is ordinary text.
"""

from __future__ import annotations

import base64
import heapq
import json
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from public_tokenizers import PATTERN
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, utf8

#: Bytes of a word up to which the matrix merges it.
LONG = 128
#: Distinct pieces of text whose ids a task keeps; past it the table starts anew, which costs time only.
KEPT = 200_000
#: First character beyond the Latin letters, whose classes no version of Unicode changes.
LATIN = "\u0250"
#: No rank; above every rank.
NONE = 1 << 30

OUTPUT = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class RankMap:
    """The rank of each two tokens whose bytes together are a token, by a hash table that arrays look up."""

    BITS = 20

    def __init__(self, ranks: dict[bytes, int]):
        found = []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    found.append((left << 32 | right, rank))
        keys, values = (np.array(x, np.int64) for x in zip(*found, strict=True))
        size = 1 << self.BITS
        if len(keys) * 2 > size:
            raise ValueError("the rank map is made for fewer pairs")
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):  # a round places the first of those that want a free slot; the others go on to the next one
            free = self.keys[at[left]] < 0
            slots, first = np.unique(at[left[free]], return_index=True)
            placed = left[free][first]
            self.keys[slots], self.values[slots] = keys[placed], values[placed]
            left = np.setdiff1d(left, placed)
            at[left] = (at[left] + 1) % size

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; NONE where there is none."""
        keys = left.astype(np.int64) << 32 | right
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, self.values[at], NONE)
        on = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0))
        while len(on):
            at[on] = (at[on] + 1) & ((1 << self.BITS) - 1)
            hit = self.keys[at[on]] == keys[on]
            out[on[hit]] = self.values[at[on[hit]]]
            on = on[~hit & (self.keys[at[on]] >= 0)]
        return out


def fold(ids: np.ndarray, table: RankMap) -> tuple[np.ndarray, np.ndarray]:
    """Merge words of one length: a row of byte ids each. Returns their ids, and how many of a row count."""
    n, width = ids.shape
    out, sizes = ids.copy(), np.full(n, width)
    rows = np.arange(n)
    ranks = np.full((n, width), NONE, np.int32)  # of the pair that starts here
    if width > 1:
        ranks[:, :-1] = table.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
    ids = ids.copy()
    counts = sizes.copy()
    while True:
        at = ranks.argmin(1)
        least = ranks[np.arange(len(rows)), at]
        on = least < NONE
        if not on.all():
            out[rows[~on]], sizes[rows[~on]] = ids[~on], counts[~on]
            rows, ids, ranks, counts, at, least = rows[on], ids[on], ranks[on], counts[on], at[on], least[on]
        if not len(rows):
            return out, sizes
        k, every = np.arange(width), np.arange(len(rows))
        source = np.minimum(k + (k > at[:, None]), width - 1)  # what stands after the pair moves up
        ids, ranks = np.take_along_axis(ids, source, 1), np.take_along_axis(ranks, source, 1)
        ids[every, at] = least
        counts = counts - 1
        ranks[every, counts - 1] = NONE
        for start, fits in ((at, at < counts - 1), (at - 1, at > 0)):
            r, s = every[fits], start[fits]
            ranks[r, s] = table.get(ids[r, s], ids[r, s + 1])


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for one long word: pairs wait in a heap by rank and place; one that has changed meanwhile is passed over."""
    n = len(word)
    ends, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at k; 0 for one merged away
    heap: list[tuple[int, int, int]] = []

    def offer(k: int) -> None:
        if k >= 0 and ends[k] < n and (r := ranks.get(word[k : ends[ends[k]]])) is not None:
            heapq.heappush(heap, (r, k, ends[ends[k]]))

    for k in range(n):
        offer(k)
    while heap:
        _, k, end = heapq.heappop(heap)
        if not ends[k] or ends[k] == n or ends[ends[k]] != end:
            continue
        ends[ends[k]], ends[k] = 0, end
        if end < n:
            before[end] = k
        offer(k)
        offer(before[k])
    ids, k = [], 0
    while k < n:
        ids.append(ranks[word[k : ends[k]]])
        k = ends[k]
    return ids


def ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The picked runs of `flat` one after another, and where each ends."""
    lengths = sizes[picks]
    ends = np.cumsum(lengths)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[picks] - (ends - lengths), lengths)
    return flat[at], ends


class Runs:
    """Numbered runs of ids, kept in one array that grows."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.flat, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, keys: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        ends = np.cumsum(sizes) + len(self.flat)
        self.number.update(zip(keys, range(len(self.number), len(self.number) + len(keys)), strict=True))
        self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
        self.starts = np.concatenate([self.starts, ends - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.table = ranks, RankMap(ranks)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.split = regex.compile(pattern).findall
        # of the standard pattern a space and letters are one word; of others nothing is taken for granted
        self.letters_are_words = pattern == PATTERN
        self.words, self.pieces = Runs(), Runs()

    def merged(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after another, and how many each has."""
        raw = [w.encode() for w in new]
        sizes = np.zeros(len(raw), np.int64)
        whole: dict[int, list[int]] = {}
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(raw):
            if (r := self.ranks.get(w)) is not None:
                whole[k] = [r]
            elif len(w) > LONG:
                whole[k] = merge_long(w, self.ranks)
            else:
                by_length.setdefault(len(w), []).append(k)
        for k, ids in whole.items():
            sizes[k] = len(ids)
        folded = []
        for width, at in by_length.items():
            ids = self.byte_ids[np.frombuffer(b"".join([raw[k] for k in at]), np.uint8)].reshape(len(at), width)
            out, n = fold(ids, self.table)
            sizes[at] = n
            folded.append((np.array(at), out, n))
        starts = np.cumsum(sizes) - sizes
        flat = np.zeros(int(sizes.sum()), np.int32)
        for at, out, n in folded:
            for j in range(out.shape[1]):
                has = n > j
                flat[starts[at[has]] + j] = out[has, j]
        for k, ids in whole.items():
            flat[starts[k] : starts[k] + len(ids)] = ids
        return flat, sizes

    def take(self, runs: Runs, picks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of rows of run numbers (so many a row, one after another), and how many each row has."""
        flat, ends = ragged(runs.flat, runs.starts, runs.sizes, picks)
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return flat, np.diff(edges)

    def by_words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = [self.split(t) for t in texts]
        words = list(chain.from_iterable(split))
        if new := list(set(words).difference(self.words.number)):
            self.words.add(new, *self.merged(new))
        picks = np.fromiter(map(self.words.number.__getitem__, words), np.int64, len(words))
        return self.take(self.words, picks, np.array([len(s) for s in split], np.int64))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has."""
        if len(self.pieces.number) > KEPT or len(self.words.number) > KEPT:
            self.words, self.pieces = Runs(), Runs()
        # a piece stands for itself with the space in front of it
        cut = [t.split(" ") for t in texts]
        first = [c.pop(0) for c in cut]
        pieces, counts, number = list(chain.from_iterable(cut)), np.array([len(c) for c in cut], np.int64), self.pieces.number
        clean = [p for p in set(pieces).difference(number) if p and not p[0].isspace() and not p[-1].isspace()]
        if self.letters_are_words:
            if plain := [p for p in clean if p.isalpha() and (p.isascii() or max(p) < LATIN)]:
                self.pieces.add(plain, *self.merged([" " + p for p in plain]))
                clean = [p for p in clean if p not in number]
        if clean:
            self.pieces.add(clean, *self.by_words([" " + p for p in clean]))
        # texts with a piece that isn't clean, or whose first one is empty or ends in white space, are split whole
        picks = np.fromiter(map(number.get, pieces, repeat(-1)), np.int64, len(pieces))
        owner = np.repeat(np.arange(len(texts)), counts)
        is_odd = np.array([not f or f[-1].isspace() for f in first], bool)
        is_odd[owner[picks < 0]] = True
        odd = np.flatnonzero(is_odd).tolist()
        first_flat, first_sizes = self.by_words(["" if o else f for f, o in zip(first, is_odd.tolist(), strict=True)])
        rest_flat, rest_sizes = self.take(self.pieces, picks[~is_odd[owner]], np.where(is_odd, 0, counts))
        odd_flat, odd_sizes = self.by_words([texts[k] for k in odd])
        sizes_odd = np.zeros(len(texts), np.int64)
        sizes_odd[odd] = odd_sizes
        parts = [(first_flat, first_sizes), (rest_flat, rest_sizes), (odd_flat, sizes_odd)]
        sizes = first_sizes + rest_sizes + sizes_odd
        starts = np.cumsum(sizes) - sizes
        flat, done = np.zeros(int(sizes.sum()), np.int32), np.zeros(len(texts), np.int64)
        for ids, n in parts:
            ends = np.cumsum(n)
            flat[np.arange(len(ids)) + np.repeat(starts + done - (ends - n), n)] = ids
            done += n
        return flat, sizes


def encode(docs: DataFrame, rank_path: str, pattern: str, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """`docs` with the column ids, the text's tokens; the text itself goes unless keep_text."""

    def make():
        encoder = Encoder(read_ranks(rank_path), pattern)

        def apply(texts):
            flat, sizes = encoder.encode([t.decode("utf-8", "replace") for t in texts])
            return [pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(flat))]

        return apply

    return append_columns(docs, make, [(text_col, utf8(F.col(text_col)))], OUTPUT, drop=() if keep_text else (text_col,))


def decode(ids: Column, rank_path: str) -> Column:
    """The bytes that the ids stand for."""
    ranks = read_ranks(rank_path)
    pieces = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token.hex()
    table = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    return F.unhex(F.array_join(F.transform(ids, lambda k: F.get(table, k)), ""))


def digest(encoded: DataFrame, rank_path: str) -> DataFrame:
    ids = F.col("ids")
    return encoded.select(
        "doc_id",
        F.size(ids).cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(decode(ids, rank_path), 256).alias("decoded_sha256"),
    )
