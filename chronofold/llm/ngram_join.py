"""N-gram Jaccard join by parity sketches.

A document's set holds its distinct shingles of SHINGLE words. Each shingle's hash
is XORed into one part of a sketch, so the XOR of two sketches is that of the
symmetric difference, and the parts (or bits) that differ are a lower bound of its
size. Sets with a Jaccard likeness of at least t differ in at most
(a + b) (1 - t) / (1 + t) shingles: with more parts than that one part must agree.
Sizes go by bands, each with its own number of parts; a set near the top of its
band also goes into the next one.

Equal sets are one node. Nodes that agree in a part form a group. Links are
wanted for connected components only, so no group is expanded into all its pairs:

1. Candidates. In a group of up to COMMON members those whose sizes and bit sketches
   allow a link are joined up. The hash of a larger group is a common one, as that
   of a part which holds nothing but shingles of a widespread passage. Two sets that
   differ in d parts share one of the d + 1 that each would keep in any order that
   both follow (prefix filter); so each leaves out its empty parts, then its most
   common hashes, as many as it has parts beyond that number. Nodes that still share
   a common hash are joined up as they are; mostly they are copies. Connected
   components of all this hold every link inside one of them.
2. Verification. A candidate component's sets meet in one call, in which nodes that
   aren't connected yet are compared by their sets. A large component is cut into
   calls of bounded size by hash; then one node of each of a call's components
   meets those of the other calls, in rounds.
3. The rest. Where a large component isn't connected after that, what isn't in its
   largest part is compared by bit sketches with all of it, two chunks in a call. The
   sets of nodes that these leave over a pair of go to calls of bounded size, each
   once a call however many such pairs it is in, and pairs that aren't connected yet
   are verified there.

So every two members of a group are either connected or compared, and no component
is missed. `join` yields components only; `links` yields all links between sets.

Documents are dealt to parts by a hash of id and text; a node is (part, row). What
is verified is kept as sets of hashes. Groups are kept as they are found, then the
candidates, then the sets, so that shuffled texts and messages are gone from disk
before groups become rows. The texts are read and shuffled twice for that, and must
be the same each time.

Edge cases: a null text, or one without words, has an empty set and is linked
with nothing; fewer than SHINGLE words are one shingle; repeated rows and ids
are rows of the result, the component is the least id of its rows (null if all
ids are null). Rows that are equal in id and text share a part.
"""

from __future__ import annotations

from collections import Counter
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, materialize, shuffle_partitions, slices, utf8
from .components import components, roots
from .substring_dedup import ANSWER, SENT, SLICE_BYTES, SPREAD, _answer, _bits, _send, bucket_edges
from .wordhash import Words, mix, runs

SHINGLE = 5
THRESHOLD = Fraction(4, 5)
#: Sizes at the top of one band and of the next, in proportion.
BAND = 1.6
#: Bits of the sketch that pairs are tried by before their sets are fetched: the power of two not under the size, in these bounds.
LEAST_BITS, MOST_BITS = 64, 4096
#: Members of a group that are compared by bit sketches. The hash of a larger group is a common one.
COMMON = 64
#: Nodes of one part with one hash that go to its bucket by number; of more the bucket gets their count only, and the hash
#: is a common one. So a bucket lists no more than this for each part, however many sets share a hash.
LISTED = 32
#: Sets, and shingles of them, of one call of the verification; a larger candidate component is cut into several calls.
CALL_SETS, CALL_SHINGLES = 512, 1 << 18
#: Members of a chunk of a component that isn't connected by then; a call has two chunks.
CHUNK = 1024
#: Bytes of a part's hash that are sent. Hashes that agree in them only make a group too many.
HASH_BYTES = 6

#: Bit of a node's number that says that a hash is of its next band.
UP = 62

#: A part's documents, as lists: id, set size, node (if the set's first document is this one), signature, the caller's mark, the hashes that a node may leave out (see Sent), its bit sketch.
DESCRIBED = "ids array<bigint>, sizes array<bigint>, nodes array<bigint>, firsts array<bigint>, seconds array<bigint>, marks array<bigint>, spares array<bigint>, sketches array<binary>"
#: Entries of groups: the group, for kind 1 its least member or else its size, and a member.
GROUP = f"kind int, groups array<bigint>, ns array<bigint>, members array<bigint>, {DESCRIBED}"
#: Entries in a row.
ROW_MEMBERS = 1 << 14
SETS = "node bigint, n bigint, shingles binary"


def bands(threshold: Fraction, largest: int) -> list[tuple[int, int, int]]:
    """(largest size, most differences, parts) of each band up to `largest`."""
    out, top, share = [], 8, (1 - threshold) / (1 + threshold)
    while not out or out[-1][0] < largest:
        most = int(2 * top * share)
        out.append((top, most, most + 3 + most // 12))
        top = int(top * BAND)
    return out


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all texts one after another, ascending in each, and how many each has."""
    flat, sizes = [], []
    for at in slices([len(t) for t in texts], SLICE_BYTES):
        words = Words([t.lower() for t in texts[at]])  # of bytes: A-Z only
        h = words.hashes()
        whole = runs(h, k)
        starts = np.flatnonzero(words.left()[: len(whole)] >= k)
        owner, found = words.text[starts], whole[starts]
        short = np.flatnonzero((words.sizes > 0) & (words.sizes < k))
        if len(short):
            ones = [runs(h[words.first[j] : words.first[j + 1]], int(words.sizes[j]))[0] for j in short]
            owner = np.concatenate([owner, short])
            found = np.concatenate([found, mix(np.array(ones, np.uint64) + words.sizes[short].astype(np.uint64))])
        order = np.lexsort((found, owner))
        owner, found = owner[order], found[order]
        new = np.ones(len(order), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])
        flat.append(found[new])
        sizes.append(np.bincount(owner[new], minlength=at.stop - at.start))
    return (np.concatenate(flat), np.concatenate(sizes)) if flat else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


class Part:
    def __init__(self, table: pa.Table, k: int):
        ids, texts = table.column("id").to_pylist(), table.column("raw").to_pylist()
        order = sorted(range(len(ids)), key=lambda j: (ids[j] is None, ids[j] or 0, texts[j]))
        self.ids, self.texts, self.k = [ids[j] for j in order], [texts[j] for j in order], k
        self.marks = table.column("mark").take(order).to_pylist()

    def sets(self, at: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        return shingle_sets(self.texts if at is None else [self.texts[j] for j in at], self.k)

    def signatures(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        """96 bits for each whole set; equal ones of the part once, at their first row."""
        owner = np.repeat(np.arange(len(sizes)), sizes)
        self.first, self.second = (np.zeros(len(sizes), np.uint64) for _ in range(2))
        np.bitwise_xor.at(self.first, owner, mix(flat + np.uint64(0x9E3779B97F4A7C15)))
        np.bitwise_xor.at(self.second, owner, mix(flat + np.uint64(0x632BE59BD9B4E019)))
        self.first = mix(self.first + sizes.astype(np.uint64))
        self.second = (self.second >> np.uint64(32)).astype(np.uint32)
        full = np.flatnonzero(sizes)
        order = full[np.lexsort((full, self.second[full], self.first[full]))]
        new = np.ones(len(order), bool)
        new[1:] = (self.first[order][1:] != self.first[order][:-1]) | (self.second[order][1:] != self.second[order][:-1])
        self.rows = order[new]  # of the part's nodes, by signature


class Sent(NamedTuple):
    """The sketch parts of some sets: hash, set number, and whether it is of the band above the set's own; by set and (own, next) band, how many of them it may leave out."""

    hashes: np.ndarray
    whose: np.ndarray
    up: np.ndarray
    spare: np.ndarray


def part_hashes(flat: np.ndarray, sizes: np.ndarray, threshold: Fraction) -> Sent:
    starts = np.cumsum(sizes) - sizes
    a, b = threshold.numerator, threshold.denominator
    # up to the largest set that any one here can be alike to, wherever that lies: a set's bands don't depend on its part
    every, found, whose, above = bands(threshold, int(sizes.max(initial=1)) * b // a), [], [], []
    tops = np.array([band[0] for band in every])
    own = np.searchsorted(tops, sizes)
    # into the next band, if a set of its least size could still be alike
    up = (own + 1 < len(every)) & (sizes * b >= (tops[own] + 1) * a)
    least = int(1 / (1 - threshold)) - 1  # sets under this size are alike only if they are equal
    spare = np.zeros((len(sizes), 2), np.int64)
    for k, (top, _, parts) in enumerate(every):
        at = np.flatnonzero((sizes >= least) & ((own == k) | (up & (own == k - 1))))
        if not len(at):
            continue
        n = sizes[at]
        ends = np.cumsum(n)
        h = flat[np.arange(ends[-1]) + np.repeat(starts[at] - (ends - n), n)]
        spread = mix(h ^ np.uint64(0xA0761D6478BD642F + k))
        key = np.repeat(np.arange(len(at)), n) * parts + ((spread >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        sketch = np.zeros(len(at) * parts, np.uint64)
        np.bitwise_xor.at(sketch, key, mix(h + np.uint64(0xE7037ED1A0B428DB)))
        held = np.bincount(key, minlength=len(sketch)).reshape(len(at), parts) > 0
        full = held.sum(1)
        # the most differences to any set of the band that it can be alike to
        most = (n + np.minimum(n * b // a, top)) * (b - a) // (b + a)
        # Two sets that differ in d parts share one of the d + 1 that each holds dear most, in any order that both follow.
        # In this one empty parts come last, the last of them at the very end; common hashes come before them.
        sent = held | (np.cumsum(~held, 1) <= np.maximum(0, most + 1 - full)[:, None])
        spare[at, (own[at] < k).astype(int)] = np.maximum(0, full - (most + 1))
        row, part = np.nonzero(sent)
        found.append(mix(sketch.reshape(len(at), parts)[row, part] ^ mix((np.uint64(k) << np.uint64(40)) + part.astype(np.uint64))))
        whose.append(at[row])
        above.append(own[at[row]] < k)
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool))
    return Sent(*(np.concatenate(x) if x else n for x, n in zip((found, whose, above), none, strict=True)), spare)


def bit_sketches(flat: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Parities of each set's shingles by bit. The sketch of half the width is the XOR of the halves (see `narrowed`)."""
    out, hashes, end = [], mix(flat + np.uint64(0x8EBC6AF09C88C6E3)), 0
    for n in sizes.tolist():
        bits = min(MOST_BITS, max(LEAST_BITS, 1 << max(0, n - 1).bit_length()))
        held = np.bincount((hashes[end : end + n] & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(held.astype(bool)).tobytes())
        end += n
    return out


class Sketches:
    """Bit sketches of any widths, from a column of binaries."""

    def __init__(self, column: pa.ChunkedArray):
        raw = column.to_pylist()
        self.words = np.frombuffer(b"".join(raw), np.uint64)
        self.widths = np.array([len(x) // 8 for x in raw], np.int64)  # of 64-bit numbers
        self.starts = np.cumsum(self.widths) - self.widths

    def at(self, rows: np.ndarray, width: int) -> np.ndarray:
        """The sketches of these rows, folded to a width that none is under, as a matrix."""
        out = np.zeros((len(rows), width), np.uint64)
        for w in np.unique(self.widths[rows]).tolist():
            mine = np.flatnonzero(self.widths[rows] == w)
            whole = self.words[self.starts[rows[mine]][:, None] + np.arange(w)]
            out[mine] = np.bitwise_xor.reduce(whole.reshape(len(mine), w // width, width), axis=1)
        return out

    def differ(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For each pair of rows, a lower bound of the size of their sets' symmetric difference."""
        width, out = np.minimum(self.widths[x], self.widths[y]), np.zeros(len(x), np.int64)
        for w in np.unique(width).tolist():
            mine = np.flatnonzero(width == w)
            out[mine] = np.bitwise_count(self.at(x[mine], w) ^ self.at(y[mine], w)).sum(1, dtype=np.int64)
        return out


def _node(part: int, rows: np.ndarray) -> np.ndarray:
    return (np.int64(part) << np.int64(32)) + rows.astype(np.int64)


_DESCRIBED = [*((c, pa.list_(pa.int64())) for c in ("ids", "sizes", "nodes", "firsts", "seconds", "marks", "spares")), ("sketches", pa.list_(pa.binary()))]
_GROUP = pa.schema([("kind", pa.int32()), *((c, pa.list_(pa.int64())) for c in ("groups", "ns", "members")), *_DESCRIBED])


def _nothing(n: int) -> list[pa.Array]:
    return [pa.nulls(n, t) for _, t in _DESCRIBED]


def _messages(part: int, n: int, hashes: np.ndarray, more: np.ndarray) -> list[tuple]:
    """(bucket, part, hashes, more) for each of n buckets that gets any of the sorted hashes."""
    edges = bucket_edges(hashes, n)
    runs_ = [(k, slice(edges[k], edges[k + 1])) for k in np.flatnonzero(np.diff(edges)).tolist()]
    return [(k, part, _packed(hashes[r]), more[r].tobytes()) for k, r in runs_]


def _packed(hashes: np.ndarray) -> bytes:
    hashes = np.ascontiguousarray(hashes)
    return hashes.view(np.uint8).reshape(-1, 8)[:, 8 - HASH_BYTES :].tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // HASH_BYTES, 8), np.uint8)
    out[:, 8 - HASH_BYTES :] = np.frombuffer(raw, np.uint8).reshape(-1, HASH_BYTES)
    return out.view(np.uint64).ravel()


def _numbered(part: int, more: bytes, n_hashes: int) -> np.ndarray:
    """The nodes that a message lists, with the bit UP."""
    rows = np.frombuffer(more, f"<u{len(more) // n_hashes}").astype(np.int64)
    return _node(part, rows >> 1) | (rows & 1) << UP


def _name(hashes: np.ndarray) -> np.ndarray:
    """What names a group: the bits of its hash that are sent."""
    return (hashes >> np.uint64(64 - 8 * HASH_BYTES)).astype(np.int64)


def _group_rows(rows: list[tuple]) -> pa.Table:
    """Groups (kind, group, n, members) as entries, many in a row; a group without members is one entry."""
    cut: list[tuple] = []
    for kind in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == kind]
        sizes = [max(1, len(r[3])) for r in own]
        groups, ns = (np.repeat(np.array([r[c] for r in own], np.int64), sizes) for c in (1, 2))
        members = pa.concat_arrays([pa.array(r[3] if len(r[3]) else [None], pa.int64()) for r in own])
        cut += [(kind, groups[k : k + ROW_MEMBERS], ns[k : k + ROW_MEMBERS], members.slice(k, ROW_MEMBERS)) for k in range(0, len(groups), ROW_MEMBERS)]
    lists = [pa.array([x[c].tolist() if c < 3 else x[c].to_pylist() for x in cut], pa.list_(pa.int64())) for c in (1, 2, 3)]
    return pa.table([pa.array([x[0] for x in cut], pa.int32()), *lists, *_nothing(len(cut))], schema=_GROUP)


def _find_groups(table: pa.Table, common: int) -> pa.Table:
    """In a bucket: nodes that sent one hash, as a group (kind 1). Those of more than `common`, or that a part holds back, with the bit UP in a group that the hash names (kind 3); and how many have a hash that parts hold back (kind 4)."""
    found: dict[int, np.ndarray] = {}  # by a hash of the members, as most groups come from several parts of a sketch
    counts: Counter[int] = Counter()
    hashes, nodes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for part, packed, more in zip(*(table.column(c).to_pylist() for c in ("part", "hashes", "more")), strict=True):
        own = _unpacked(packed)
        if part < 0:
            for name, n in zip(_name(own).tolist(), np.frombuffer(more, "<u4").tolist(), strict=True):
                counts[name] += n
        else:
            hashes.append(own)
            nodes.append(_numbered(part, more, len(own)))
    hashes, nodes = np.concatenate(hashes), np.concatenate(nodes)
    order = np.lexsort((nodes & (1 << UP) - 1, hashes))
    hashes, nodes = hashes[order], nodes[order]
    edges = _edges(hashes)
    names, sizes = _name(hashes[edges[:-1]]), np.diff(edges)
    wanted = (sizes > 1) | np.isin(names, np.array(sorted(counts), np.int64))
    rows = []
    for k in np.flatnonzero(wanted).tolist():
        members, name = nodes[edges[k] : edges[k + 1]], int(names[k])
        if name in counts:
            counts[name] += len(members)
        if name in counts or len(members) > common:
            rows.append((3, name, len(members), members))
            continue
        members = members & (1 << UP) - 1
        found.setdefault(int(np.bitwise_xor.reduce(mix(members.view(np.uint64) + np.uint64(len(members)))).view(np.int64)), members)
    rows += [(1, g, int(m[0]), m) for g, m in sorted(found.items())]
    return _group_rows(rows + [(4, name, n, []) for name, n in sorted(counts.items())])


def _allowed(size: np.ndarray, other: np.ndarray, differ: np.ndarray | int, threshold: Fraction) -> np.ndarray:
    """Whether sets of these sizes, with so many differences at least, can be alike."""
    a, b = threshold.numerator, threshold.denominator
    return (np.minimum(size, other) * b >= np.maximum(size, other) * a) & (differ * (a + b) <= (size + other) * (b - a))


def _edges(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal rows of sorted columns begin, and the end."""
    new = np.zeros(len(keys[0]) - 1, bool) if len(keys[0]) else np.zeros(0, bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    return np.flatnonzero(np.concatenate([[True], new, [True]])) if len(keys[0]) else np.zeros(1, np.int64)


def _pairs_within(sizes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i < j) of rows of one run, for runs of these sizes from these rows on."""
    x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in np.unique(sizes).tolist():
        i, j = np.triu_indices(n, 1)
        first = starts[sizes == n][:, None]
        x.append((first + i).ravel())
        y.append((first + j).ravel())
    return np.concatenate(x), np.concatenate(y)


#: Pairs of rows tried at once; bounds the memory of it.
PAIRS = 1 << 16


def _candidates(threshold: Fraction):
    """Rows (group, node, size, sketch): (node, root) of the nodes that the groups of the table join up."""

    def found(table):
        table = table.sort_by([("group", "ascending"), ("node", "ascending")])
        group, node, size = (table.column(c).to_numpy() for c in ("group", "node", "size"))
        edges, sketches = _edges(group), Sketches(table.column("sketch"))
        starts, sizes = edges[:-1], np.diff(edges)
        x, y = [node[:0]], [node[:0]]
        sums = np.cumsum(sizes * (sizes - 1) // 2)
        for at in np.split(np.arange(len(sizes)), np.searchsorted(sums, np.arange(PAIRS, int(sums[-1]) + 1, PAIRS))):
            p, q = _pairs_within(sizes[at], starts[at])
            for k in range(0, len(p), PAIRS):
                i, j = p[k : k + PAIRS], q[k : k + PAIRS]
                near = _allowed(size[i], size[j], 0, threshold)
                i, j = i[near], j[near]
                near = _allowed(size[i], size[j], sketches.differ(i, j), threshold)
                x.append(node[i[near]])
                y.append(node[j[near]])
        return pa.table(list(map(pa.array, roots(np.concatenate(x), np.concatenate(y)))), names=["node", "root"])

    return found


class Together:
    """The sets of one call."""

    def __init__(self, blobs: list[bytes], threshold: Fraction):
        self.sets, self.threshold = [np.frombuffer(x, np.uint64) for x in blobs], threshold
        self.sizes = np.array([len(x) for x in self.sets], np.int64)

    def common(self, k: int, others: np.ndarray) -> np.ndarray:
        """How many shingles set k has in common with each of the others."""
        own, flat = self.sets[k], np.concatenate([self.sets[j] for j in others])
        at = np.searchsorted(own, flat)
        hit = own[np.minimum(at, len(own) - 1)] == flat
        return np.bincount(np.repeat(np.arange(len(others)), self.sizes[others])[hit], minlength=len(others))

    def linked(self, k: int, others: np.ndarray) -> np.ndarray:
        a, b = self.threshold.numerator, self.threshold.denominator
        same = self.common(k, others)
        return others[same * b >= (self.sizes[k] + self.sizes[others] - same) * a]

    def sketches(self, wider: int = 1) -> np.ndarray:
        bits = min(MOST_BITS, max(LEAST_BITS, wider << int(self.sizes.max() - 1).bit_length()))
        place = (mix(np.concatenate(self.sets) + np.uint64(0x8EBC6AF09C88C6E3)) & np.uint64(bits - 1)).astype(np.int64)
        held = np.bincount(np.repeat(np.arange(len(self.sets)), self.sizes) * bits + place, minlength=len(self.sets) * bits) & 1
        return np.packbits(held.astype(bool)).view(np.uint64).reshape(len(self.sets), -1)

    def _later(self, k: int, label: np.ndarray, sketch: np.ndarray) -> np.ndarray:
        """The sets after k, of another label, that are alike to it."""
        rest = np.arange(k + 1, len(label))
        rest = rest[label[rest] != label[k]]
        differ = np.bitwise_count(sketch[k] ^ sketch[rest]).sum(1, dtype=np.int64)
        rest = rest[_allowed(self.sizes[k], self.sizes[rest], differ, self.threshold)]
        return self.linked(k, rest) if len(rest) else rest

    def links(self, label: np.ndarray, every: bool) -> tuple[np.ndarray, np.ndarray]:
        """Links between sets of different labels: all, or as many as join up the labels."""
        label, sketch, found = label.copy(), self.sketches(8), []
        for k in range(len(label) - 1):
            near = self._later(k, label, sketch)
            if len(near) and not every:
                near = near[np.unique(label[near], return_index=True)[1]]
                label[np.isin(label, label[near])] = label[k]
            found.append(near)
        return np.repeat(np.arange(len(found)), [len(x) for x in found]), np.concatenate([np.zeros(0, np.int64), *found])

    def components(self) -> np.ndarray:
        """For each set the one that stands for its component: the one with the most links found."""
        n = len(self.sets)
        if n == 2:
            return np.array([0, 0 if len(self.linked(0, np.array([1]))) else 1])
        label, links, sketch = np.arange(n), np.zeros(n, np.int64), self.sketches()
        for k in range(n - 1):
            if len(found := self._later(k, label, sketch)):
                links[k] += len(found)
                links[found] += 1
                label[np.isin(label, label[found])] = label[k]
        order = np.lexsort((np.arange(n), -links, label))
        first = order[_edges(label[order])[:-1]]
        return first[np.searchsorted(label[first], label)]


def _verified_calls(threshold: Fraction):
    """Rows (call, label, big, node, shingles): the node that stands for each one's component within its call; with its set, if there are other calls."""

    def found(table):
        table = table.sort_by([("call", "ascending"), ("node", "ascending")])
        node, shingles = table.column("node").to_numpy(), table.column("shingles").to_pylist()
        edges, root = _edges(table.column("call").to_numpy()), np.empty(len(node), np.int64)
        for i, j in zip(edges.tolist(), edges[1:].tolist(), strict=False):
            root[i:j] = node[i:j][Together(shingles[i:j], threshold).components()] if j > i + 1 else node[i:j]
        wanted = (root == node) & np.array(table.column("big").to_pylist(), bool)
        kept = pa.array([x if w else None for x, w in zip(shingles, wanted.tolist(), strict=True)], pa.binary())
        return pa.table([table.column("node"), pa.array(root), table.column("label"), table.column("big"), kept], names=["node", "root", "label", "big", "shingles"])

    return found


VERIFIED = "node bigint, root bigint, label bigint, big boolean, shingles binary"


def _in_calls(sets: DataFrame, per_label: DataFrame, threshold: Fraction) -> DataFrame:
    """`sets` (node, label, shingles) verified in calls; per_label: label, rows, shingles of each label."""
    cuts = F.ceil(F.greatest(F.col("rows") / CALL_SETS, F.col("total") / CALL_SHINGLES)).cast("bigint")
    big = materialize(per_label.select("label", cuts.alias("cuts")).where("cuts > 1"))
    dealt = sets.join(big, "label", "left") if not big.isEmpty() else sets.withColumn("cuts", F.lit(None).cast("bigint"))
    call = F.when(F.col("cuts").isNull(), F.col("label")).otherwise(F.xxhash64("label", F.pmod(F.xxhash64("node", F.lit(6)), "cuts")))
    dealt = dealt.select("node", "label", "shingles", F.col("cuts").isNotNull().alias("big"), call.alias("call"))
    return dealt.groupBy(F.pmod(F.xxhash64("call"), F.lit(8 * shuffle_partitions(sets.sparkSession)))).applyInArrow(_verified_calls(threshold), VERIFIED)


def _apart(members: DataFrame) -> DataFrame:
    """Of rows (group, node, label) those of groups with more than one label: main, whether the row has the label that most of the group have, and in how many chunks these and the others go."""
    each = members.groupBy("group", "label").agg(F.count(F.lit(1)).alias("n"))
    whole = each.groupBy("group").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    chunks = [F.ceil(n / CHUNK).cast("int").alias(name) for n, name in ((F.col("top.n"), "main_chunks"), (F.col("n") - F.col("top.n"), "rest_chunks"))]
    whole = materialize(whole.select("group", F.col("top.label").alias("top"), *chunks))
    return members.join(whole, "group").withColumn("main", F.col("label") == F.col("top")).drop("top")


def _bundled(rows: DataFrame):
    """Rows of `_apart` grouped for calls that compare them: a call has a chunk of the main ones and one of the others, or two of the others; `chunks` names it, `mixed` says which."""
    n = F.when(F.col("main"), F.col("main_chunks")).otherwise(F.col("rest_chunks"))
    own = F.pmod(F.xxhash64("node", F.lit(6)), n.cast("bigint")).cast("int")

    def call(mixed: bool, i: F.Column, j: F.Column) -> F.Column:
        return F.struct(F.xxhash64("group", F.lit(mixed), i, j).alias("chunks"), F.lit(mixed).alias("mixed"))

    def numbers(count: str) -> F.Column:
        return F.sequence(F.lit(0), F.col(count) - 1)

    of_main = F.transform(numbers("rest_chunks"), lambda j: call(True, own, j))
    of_rest = F.concat(F.transform(numbers("main_chunks"), lambda i: call(True, i, own)), F.transform(numbers("rest_chunks"), lambda j: call(False, F.least(own, j), F.greatest(own, j))))
    dealt = rows.withColumn("call", F.explode(F.when(F.col("main"), of_main).otherwise(of_rest))).select("node", "label", "size", "sketch", "main", "call.*")
    return dealt.groupBy(F.pmod("chunks", F.lit(8 * shuffle_partitions(rows.sparkSession))).alias("bundle"))


def _described(found: DataFrame, **columns: str) -> DataFrame:
    """Columns of the documents under other names, a row each."""
    d = found.where("kind = 0").select(F.explode(F.arrays_zip(*columns)).alias("d"))
    return d.select(*[F.col(f"d.{c}").alias(name) for c, name in columns.items()])


def _facts(found: DataFrame) -> DataFrame:
    """node, size, sketch."""
    return _described(found, nodes="node", sizes="size", sketches="sketch").where("node IS NOT NULL")


def _parts(docs: DataFrame, k: int, threshold: Fraction) -> tuple[DataFrame, DataFrame]:
    """The rows with their parts; and, checkpointed, the documents (kind 0, a row a part), groups of nodes (kinds 1 and 3) and sizes of common ones (kind 4)."""
    rows = docs.select("id", "raw", "mark")
    n = parts_ = shuffle_partitions(docs.sparkSession) * SPREAD  # as many buckets, so that partitions get about equally many
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("id", F.xxhash64("raw")), F.lit(parts_)).cast("int"))
    message, common, listed = f"{SENT}, {DESCRIBED}", COMMON, LISTED
    schema = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("hashes", pa.binary()), ("more", pa.binary()), *_DESCRIBED])

    def send_signatures(key, table):
        give_back()
        p = Part(table, k)
        p.signatures(*p.sets())
        return _send(key[0].as_py(), n, p.first[p.rows], p.second[p.rows])

    def send_parts(key, left, right):
        give_back()
        part = key[0].as_py()
        p = Part(left, k)
        flat, sizes = p.sets()
        p.signatures(flat, sizes)
        owned = p.rows[_bits(right, 2, p.first[p.rows], n)]
        mine = np.zeros(len(sizes), bool)
        mine[owned] = True
        keep = np.repeat(mine, sizes)
        sent = part_hashes(flat[keep], sizes[mine], threshold)
        order = np.argsort(sent.hashes)
        # a row's number, and in the last bit whether the hash is of the next band
        hashes, rows = sent.hashes[order], (np.flatnonzero(mine)[sent.whose[order]] * 2 + sent.up[order]).astype("<u2" if len(sizes) <= 1 << 15 else "<u4")
        edges = _edges(hashes)
        sizes_ = np.diff(edges)
        held = np.repeat(sizes_ > listed, sizes_)
        often = np.flatnonzero(sizes_ > listed)
        sent_rows = [
            *_messages(part, n, hashes[~held], rows[~held]),
            *_messages(-1 - part, n, hashes[edges[often]], sizes_[often].astype("<u4")),
            *((-1 - part, part, _packed(hashes[edges[k] : edges[k] + 1]), rows[edges[k] : edges[k + 1]].astype("<u4").tobytes()) for k in often.tolist()),
        ]
        first = [pa.array([r[c] for r in sent_rows], f.type) for c, f in enumerate(list(schema)[:4])]
        nodes = [int(x) if m else None for x, m in zip(_node(part, np.arange(len(sizes))), mine, strict=True)]
        spares = iter((sent.spare[:, 0] + (sent.spare[:, 1] << 32)).tolist())
        sketches = iter(bit_sketches(flat[keep], sizes[mine]))
        described = [p.ids, sizes.tolist(), nodes, p.first.view(np.int64).tolist(), p.second.astype(np.int64).tolist(), p.marks, [next(spares) if m else None for m in mine], [next(sketches) if m else None for m in mine]]
        out = pa.table([*first, *_nothing(len(sent_rows))], schema=schema)
        row = [pa.array([-1 - part], pa.int32()), pa.array([part], pa.int32()), pa.array([b""]), pa.array([b""]), *(pa.array([x], t) for x, (_, t) in zip(described, _DESCRIBED, strict=True))]
        return pa.concat_tables([out, pa.table(row, schema=schema)])

    def bucket(table):
        if table.column("bucket")[0].as_py() < 0:  # a part's documents, and what it holds back
            rows = table.filter(pc.is_valid(table.column("ids")))
            described = [rows.column(c).cast(t) for c, t in _DESCRIBED]
            own = pa.table([pa.array([0] * len(rows), pa.int32()), *(pa.nulls(len(rows), t) for t in _GROUP.types[1:4]), *described], schema=_GROUP)
            held = table.filter(pc.is_null(table.column("ids")))
            back = [_unpacked(h) for h in held.column("hashes").to_pylist()]
            lists = [_numbered(p, m, len(m) // 4) for p, m in zip(held.column("part").to_pylist(), held.column("more").to_pylist(), strict=True)]
            return pa.concat_tables([own, _group_rows([(3, int(_name(h)[0]), len(m), m) for h, m in zip(back, lists, strict=True)])])
        return _find_groups(table, common)

    signatures = dealt.groupBy("part").applyInArrow(send_signatures, SENT)
    owners = signatures.groupBy("bucket").applyInArrow(_answer(2), ANSWER)
    parts = dealt.groupBy("part").cogroup(owners.groupBy("part")).applyInArrow(send_parts, message)
    return dealt, materialize(parts.groupBy("bucket").applyInArrow(bucket, GROUP))


def _entries(found: DataFrame, kind: int) -> DataFrame:
    """group, n and member of the groups of a kind."""
    d = found.where(F.col("kind") == kind).select(F.explode(F.arrays_zip("groups", "ns", "members")).alias("d"))
    return d.select(F.col("d.groups").alias("group"), F.col("d.ns").alias("n"), F.col("d.members").alias("member"))


class Groups(NamedTuple):
    #: a row a part (kind 0), among rows of groups
    parts: DataFrame
    #: node, and what it is joined up with, a node or, under 0, a common hash
    candidates: DataFrame
    #: node, n, shingles of the nodes that candidates hold
    sets: DataFrame


def _groups(docs: DataFrame, k: int, threshold: Fraction) -> Groups:

    def fetch(key, left, right):
        give_back()
        at = sorted({x & 0xFFFFFFFF for x in right.column("node").to_pylist()})
        p = Part(left, k)
        flat, sizes = p.sets(at)
        ends = np.cumsum(sizes)
        blobs = [flat[a:b].tobytes() for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
        return pa.table([pa.array(_node(key[0].as_py(), np.array(at, np.int64)), pa.int64()), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())], names=["node", "n", "shingles"])

    dealt, found = _parts(docs, k, threshold)
    # groups of one cluster mostly share their least member, so a call joins them up
    # groups of the same members, which buckets find each for itself, are one
    members = _entries(found, 1).toDF("group", "least", "node").repartition("node").distinct().join(_facts(found), "node")
    small = members.groupBy(F.pmod(F.xxhash64("least"), F.lit(8 * shuffle_partitions(docs.sparkSession)))).applyInArrow(_candidates(threshold), "node bigint, root bigint")
    # of its common hashes a node leaves out the most common ones; by the others it is joined up with what has them
    least_bits = (1 << UP) - 1
    spare = F.when(F.col("up") == 0, F.col("spare").bitwiseAND(0xFFFFFFFF)).otherwise(F.shiftright("spare", 32))
    counted = _entries(found, 4).select("group", F.col("n").alias("whole"))
    often = _entries(found, 3).toDF("group", "n", "sent").join(counted, "group", "left").withColumn("n", F.coalesce("whole", "n"))
    often = often.select("group", "n", F.col("sent").bitwiseAND(least_bits).alias("node"), F.shiftright("sent", UP).alias("up"))
    often = often.join(_described(found, nodes="node", spares="spare").where("node IS NOT NULL"), "node")
    order = Window.partitionBy("node", "up").orderBy(F.col("n").desc(), "group")
    large = often.withColumn("place", F.row_number().over(order)).where(F.col("place") > spare).select("node", (-1 - F.col("group")).alias("root"))
    near = materialize(small.unionByName(large).repartition("node").distinct())
    wanted = near.groupBy("node").agg(F.min("root").alias("root")).withColumn("part", F.shiftright("node", 32).cast("int"))
    sets = materialize(dealt.groupBy("part").cogroup(wanted.groupBy("part")).applyInArrow(fetch, SETS))
    return Groups(found, near, sets)


def _blocks(sizes: np.ndarray) -> list[slice]:
    """Consecutive rows cut into runs of about CALL_SHINGLES shingles."""
    return list(slices(sizes.tolist(), CALL_SHINGLES))


def _last_calls(members: DataFrame, facts: DataFrame, threshold: Fraction) -> DataFrame:
    """Of rows (group, node, label): the nodes of each call that sizes and bit sketches leave over a pair of, of different labels and one group."""

    def left_over(table):
        table = table.sort_by([("chunks", "ascending"), ("main", "ascending"), ("node", "ascending")])
        chunks, node, label, size = (table.column(c).to_numpy() for c in ("chunks", "node", "label", "size"))
        main, mixed = (np.array(table.column(c).to_pylist(), bool) for c in ("main", "mixed"))
        edges, sketches, out = _edges(chunks), Sketches(table.column("sketch")), [np.zeros((0, 3), np.int64)]
        for i, j in zip(edges.tolist(), edges[1:].tolist(), strict=False):
            folded = sketches.at(np.arange(i, j), int(sketches.widths[i:j].min()))
            others = i + int((~main[i:j]).sum())  # the main ones stand behind them
            left = [(i + x.start, i + x.stop) for x in _blocks(size[i:others])]
            right = [(others + x.start, others + x.stop) for x in _blocks(size[others:j])] if mixed[i] else left
            for p, (a, b) in enumerate(left):
                for q, (c, d) in enumerate(right):
                    if not mixed[i] and q < p:
                        continue
                    wanted = np.zeros(j - i, bool)
                    for k in range(a, b):
                        first = c if mixed[i] or q > p else k + 1
                        differ = np.bitwise_count(folded[k - i] ^ folded[first - i : d - i]).sum(1, dtype=np.int64)
                        ok = _allowed(size[k], size[first:d], differ, threshold) & (label[first:d] != label[k])
                        wanted[first - i : d - i] |= ok
                        wanted[k - i] |= ok.any()
                    at = i + np.flatnonzero(wanted)
                    call = mix(np.array([chunks[i]]).view(np.uint64) + np.uint64((p << 32) + q)).view(np.int64)[0]
                    out.append(np.stack([np.full(len(at), call), node[at], label[at]], 1))
        found = np.concatenate(out)
        return pa.table([pa.array(found[:, c]) for c in range(3)], names=["call", "node", "label"])

    return _bundled(_apart(members).join(facts, "node")).applyInArrow(left_over, "call bigint, node bigint, label bigint")


def _last_links(calls: DataFrame, sets: DataFrame, threshold: Fraction, every: bool = False) -> DataFrame:
    """x, y, x < y: links between nodes of a call (call, node, label): all of different labels, or as many as join up the labels."""

    def found(table):
        table = table.sort_by([("call", "ascending"), ("node", "ascending")])
        node, label = (table.column(c).to_numpy() for c in ("node", "label"))
        edges, out = _edges(table.column("call").to_numpy()), [np.zeros((0, 2), np.int64)]
        for i, j in zip(edges.tolist(), edges[1:].tolist(), strict=False):
            x, y = Together(table.column("shingles").slice(i, j - i).to_pylist(), threshold).links(label[i:j], every)
            out.append(np.stack([node[i:j][x], node[i:j][y]], 1))
        links_ = np.concatenate(out)
        return pa.table([pa.array(links_[:, 0]), pa.array(links_[:, 1])], names=["x", "y"])

    dealt = calls.join(sets.select("node", "shingles"), "node")
    bundle = F.pmod(F.xxhash64("call"), F.lit(8 * shuffle_partitions(sets.sparkSession)))
    return dealt.groupBy(bundle).applyInArrow(found, "x bigint, y bigint").distinct()


def _rows(docs: DataFrame, id_col: str, text_col: str, mark=None) -> DataFrame:
    mark = F.lit(None) if mark is None else mark
    return docs.select(F.col(id_col).cast("bigint").alias("id"), utf8(F.col(text_col)).alias("raw"), mark.cast("bigint").alias("mark"))


def _documents(found: DataFrame) -> DataFrame:
    """A row a document."""
    return _described(found, ids="id", sizes="n_shingles", nodes="node", firsts="first", seconds="second", marks="mark")


def _candidate_labels(found: Groups) -> DataFrame:
    """node, label of a candidate component, size."""
    labels = components(found.candidates.where("node != root").select(F.col("root").alias("x"), F.col("node").alias("y")))
    return materialize(found.sets.select("node", F.col("n").alias("size")).join(labels, "node"))


def _verified_labels(found: Groups, threshold: Fraction) -> DataFrame:
    """node, comp of the nodes that candidates hold: those of one component have one comp, whichever."""
    labels = _candidate_labels(found)
    sets = found.sets.select("node", "shingles")
    per_label = labels.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("total"))
    done = materialize(_in_calls(sets.join(labels.select("node", "label"), "node"), per_label, threshold))
    out = done.select("node", F.col("root").alias("comp"))
    if done.where("big").isEmpty():
        return out
    large, level, n = done.where("big").select("node", "label", F.col("root").alias("comp")), done, 0
    # one node of each call's components meets those of other calls, in as many rounds as bring their number down
    while True:
        heads = level.where("big AND node = root").select("node", "label", "shingles")
        if (n_heads := heads.count()) == 0 or n and 2 * n_heads > n:
            break
        n = n_heads
        per_label = heads.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("shingles") / 8).alias("total"))
        level = materialize(_in_calls(heads, per_label, threshold))
        large = materialize(large.join(level.select(F.col("node").alias("comp"), F.col("root").alias("to")), "comp").select("node", "label", F.col("to").alias("comp")))
    out = done.where("NOT big").select("node", F.col("root").alias("comp")).unionByName(large.select("node", "comp"))
    last = materialize(_last_calls(large.select(F.col("label").alias("group"), "node", F.col("comp").alias("label")), _facts(found.parts), threshold))
    if last.isEmpty():
        return materialize(out)
    links = _last_links(last, sets, threshold)
    ends = links.join(out.toDF("x", "comp_x"), "x").join(out.toDF("y", "comp_y"), "y")
    more = components(ends.select(F.col("comp_x").alias("x"), F.col("comp_y").alias("y")))
    return materialize(out.join(more.toDF("comp", "label"), "comp", "left").select("node", F.coalesce("label", "comp").alias("comp")))


def _joined(rows: DataFrame, k: int, threshold: Fraction) -> DataFrame:
    """A row a document: id, mark, n_shingles, component_id, linked (to another row), and if so keeper: id (null last) and mark of its component's first row."""
    found = _groups(rows, k, threshold)
    near = _verified_labels(found, threshold)
    d = _documents(found.parts)
    # the first row of each set, then of each component of sets; most sets are their own component
    place = F.struct(F.isnull("id").alias("last"), "id", "mark")
    firsts = d.where("n_shingles > 0").groupBy("first", "second").agg(F.min(place).alias("own"), F.max("node").alias("node"), F.count(F.lit(1)).alias("rows"))
    named = materialize(firsts.join(near, "node", "left").where("comp IS NOT NULL OR rows > 1"))
    whole = materialize(named.where("comp IS NOT NULL").groupBy("comp").agg(F.min("own").alias("keeper")))
    several = materialize(named.join(whole, "comp", "left").select("first", "second", F.coalesce("keeper", "own").alias("keeper")))
    joined = d.join(several, ["first", "second"], "left")
    component = F.when(F.col("keeper").isNull(), F.col("id")).otherwise(F.col("keeper.id"))
    return joined.select("id", "mark", "n_shingles", component.alias("component_id"), F.struct("keeper.id", "keeper.mark").alias("keeper"), F.col("keeper").isNotNull().alias("linked"))


def join(docs: DataFrame, k: int = SHINGLE, threshold: Fraction = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: id, n_shingles, component_id. The links themselves: `links`."""
    return _joined(_rows(docs, id_col, text_col), k, threshold).select(F.col("id").alias(id_col), "n_shingles", "component_id")


def text_hash(text_col: str = "text") -> F.Column:
    """By which rows of one id are told apart; a null text is the empty one."""
    return F.xxhash64(utf8(F.col(text_col)))


def first_rows(docs: DataFrame, k: int = SHINGLE, threshold: Fraction = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: id, text_hash, kept, which is true for one row of each component, the first by id (null last) and text, and for rows equal to it in both."""
    found = materialize(_joined(_rows(docs, id_col, text_col, text_hash(text_col)), k, threshold))
    first = F.col("id").eqNullSafe(F.col("keeper.id"))
    tied = found.where("linked").where(first).groupBy("keeper").agg(F.min("mark").alias("lo"), F.max("mark").alias("hi")).where("lo != hi")
    several = materialize(found.where("linked").where(first).join(tied.select("keeper"), "keeper", "left_semi").select("keeper", "id", "mark").distinct())
    if not several.isEmpty():  # texts of one id in one component: the first of them stays
        texts = docs.select(F.col(id_col).alias("of"), text_hash(text_col).alias("hash"), utf8(F.col(text_col)).alias("raw"))
        texts = several.join(texts, F.col("id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("hash")))
        best = texts.groupBy("keeper").agg(F.min_by("mark", "raw").alias("best")).select(F.col("keeper").alias("of"), "best")
        found = found.join(best, F.col("linked") & F.col("keeper").eqNullSafe(F.col("of")), "left")
    else:
        found = found.withColumn("best", F.lit(None).cast("bigint"))
    kept = ~F.col("linked") | (first & (F.col("mark") == F.coalesce("best", "keeper.mark")))
    return found.select(F.col("id").alias(id_col), F.col("mark").alias("text_hash"), kept.alias("kept"))


class Links(NamedTuple):
    #: a row a document: id, n_shingles, node (one for equal sets; null for an empty one)
    members: DataFrame
    #: x, y: every two nodes with a likeness of at least the threshold, once, x < y; documents of one node are alike by 1
    links: DataFrame


def links(docs: DataFrame, k: int = SHINGLE, threshold: Fraction = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> Links:
    """All verified links, also those inside a component; of m members of a candidate component all m x m / 2 pairs are compared by bit sketches."""
    found = _groups(_rows(docs, id_col, text_col), k, threshold)
    labels, sets = _candidate_labels(found), found.sets.select("node", "shingles")
    calls = _last_calls(labels.select(F.col("label").alias("group"), "node", F.col("node").alias("label")), _facts(found.parts), threshold)
    d = _documents(found.parts).select("id", "n_shingles", "node", "first", "second")
    owners = d.where("node IS NOT NULL").select(F.col("first").alias("f"), F.col("second").alias("s"), F.col("node").alias("owner"))
    members = d.join(owners, (F.col("first") == F.col("f")) & (F.col("second") == F.col("s")) & (F.col("n_shingles") > 0), "left")
    return Links(members.select(F.col("id").alias(id_col), "n_shingles", F.col("owner").alias("node")), materialize(_last_links(calls, sets, threshold, every=True)))
