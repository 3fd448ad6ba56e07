"""Relational forms of the store's reads, of compaction, and of map/reduce views."""

from .changelog import (
    as_batch,
    current,
    first,
    get,
    last,
    merge_runs,
    missing,
    multi_get,
    prefix,
    scan,
    seek,
    seek_each,
    seek_previous,
    size_of,
)
from .compaction import compact
from .mapreduce import Map, View, fold_batches, fold_into, can_reduce_again, map_rows, map_with, reduce_checked, reduce_rows, reduce_with, rejects, results, run
from .measures import roll_up

__all__ = [
    "Map",
    "View",
    "as_batch",
    "can_reduce_again",
    "compact",
    "current",
    "first",
    "fold_batches",
    "fold_into",
    "get",
    "last",
    "map_rows",
    "map_with",
    "merge_runs",
    "missing",
    "multi_get",
    "prefix",
    "reduce_checked",
    "reduce_rows",
    "reduce_with",
    "rejects",
    "results",
    "roll_up",
    "run",
    "scan",
    "seek",
    "seek_each",
    "seek_previous",
    "size_of",
]
