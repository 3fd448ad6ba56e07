"""What the text operators share: reading, row-wise Arrow stages, materialising.

Defined edge cases for every operator built on these helpers: a null text counts
as described by the operator (usually as the empty text), repeated rows and
repeated ids each keep their own output row, an empty table gives an empty
result with the full schema, and an input column whose name a result column
needs is replaced by the result.
"""

from __future__ import annotations

import ctypes
import gc
import json
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_folder

#: Bytes of text that a Python worker takes up at once; bounds its memory.
BATCH_BYTES = 2 << 20


@cache
def _allocator():
    """The C library, told to return blocks of 4 MB and more as soon as they are free. What it keeps would else grow with the largest block so far. Other libraries than glibc have none of this."""
    found = ctypes.CDLL(None)
    if hasattr(found, "mallopt"):
        found.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
        found.mallopt(-1, 8 << 20)  # M_TRIM_THRESHOLD
    return found


_allocator()


def give_back() -> None:
    """Memory that is free in this worker goes back to the system, as workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(_allocator(), "malloc_trim"):
        _allocator().malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def materialize(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder all executors share, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    done = df.checkpoint(eager=True)
    # shuffle files of finished steps, this one if the caller doesn't hold it, go when the driver collects what held them, else only by chance
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return done


def literal(values: list, kind: str) -> F.Column:
    """An array of numbers as one literal of the plan, however many they are: the optimizer reads the text of it once."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def text_rank(text: F.Column) -> F.Column:
    """By which rows of one id are ordered: 31 bits of a hash of the text (or its bytes)."""
    return F.shiftrightunsigned(F.xxhash64(text.cast("binary")), 33)


class Ranges:
    """Ranges of ids, from the smallest on (null ids last), with about equally many rows each.

    An id that fills several ranges, as the null one may, is dealt to as many by the
    rank of the text, if that column is given; rows are then in order by id and rank.
    """

    def __init__(self, rows: DataFrame, column: str, per_partition: int, text: F.Column | None = None):
        n = shuffle_partitions(rows.sparkSession) * per_partition
        at = [k / n for k in range(1, n)]
        self.key, self.text = F.col(column).cast("double"), text
        found = rows.agg(F.percentile_approx(self.key, at, max(10_000, 10 * n)), F.count(F.lit(1)), F.count(self.key)).first()
        cuts = found[0] or []
        self.cuts: list[float] = sorted(set(cuts))
        times = [cuts.count(x) if text is not None else 1 for x in self.cuts] if len(self.cuts) < len(cuts) else [1] * len(self.cuts)
        # of the ids up to each cut (the cut's own id may fill several), of those above all, and of null
        self.widths = [*times, 1, max(1, round(n * (found[1] - found[2]) / max(1, found[1]))) if text is not None else 1]
        self.count, self.nulls = sum(self.widths), self.widths[-1]

    @property
    def by_text(self) -> bool:
        """Whether any id fills several ranges."""
        return max(self.widths) > 1

    def number(self) -> F.Column:
        """The range of a row: found in steps of the square root of their number, as Spark has no binary search."""
        step, key = max(1, int(len(self.cuts) ** 0.5)), self.key
        coarse = literal(self.cuts[::step], "array<double>")
        fine = literal([self.cuts[k : k + step] for k in range(0, len(self.cuts), step)], "array<array<double>>")
        at = F.size(F.filter(coarse, lambda x: x < key))
        inner = F.coalesce(F.size(F.filter(F.get(fine, at - 1), lambda x: x < key)), F.lit(0))
        place = F.when(key.isNull(), F.lit(len(self.cuts) + 1)).when(at == 0, F.lit(0)).otherwise((at - 1) * step + inner)
        if not self.by_text:
            return place
        first = literal([sum(self.widths[:k]) for k in range(len(self.widths))], "array<int>")
        width = F.get(literal(self.widths, "array<int>"), place)
        # of the ids up to a cut only the cut's own is spread; the others, which are smaller, come first
        spread = key.isNull() | (key == F.get(literal(self.cuts, "array<double>"), place))
        own = F.when(spread, F.floor(text_rank(self.text) * width / F.lit(1 << 31)).cast("int")).otherwise(0)
        return F.get(first, place) + own


def utf8(column) -> F.Column:
    """The text's UTF-8 bytes; empty for null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("binary")


def slices(sizes: Iterable[int], most: int = BATCH_BYTES) -> Iterator[slice]:
    """Cut consecutive rows into runs of about `most` bytes; a longer row stands alone."""
    first, held, k = 0, 0, -1
    for k, n in enumerate(sizes):
        if held and held + n > most:
            yield slice(first, k)
            first, held = k, 0
        held += n
    if k >= first:
        yield slice(first, k + 1)


def append_columns(
    df: DataFrame,
    make: Callable[[], Callable[..., list]],
    inputs: list[tuple[str, F.Column]],
    outputs: T.StructType,
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """Row-wise Arrow stage: `df` without `drop`, with the columns that the made function returns.

    `make()` runs once a task and returns f(*lists) -> list of columns (values in
    the order of `outputs`). It is called on runs of rows with about BATCH_BYTES
    in the first input, which must be binary or string.
    """
    names = {f.name for f in outputs}
    kept = [f for f in df.schema if f.name not in names and f.name not in drop]
    temp = [f"__in{k}" for k in range(len(inputs))]
    source = df.select(*[F.col(f"`{f.name}`") for f in kept], *[c.alias(t) for t, (_, c) in zip(temp, inputs, strict=True)])
    schema = T.StructType([*kept, *outputs])
    n_kept = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        apply = make()
        for batch in batches:
            first = batch.column(n_kept)
            sizes = pc.fill_null(pc.binary_length(first), 0).to_pylist()
            for at in slices(sizes):
                part = batch.slice(at.start, at.stop - at.start)
                ins = [part.column(n_kept + k).to_pylist() for k in range(len(temp))]
                made = apply(*ins)
                columns = [part.column(k) for k in range(n_kept)]
                columns += [v if isinstance(v, pa.Array) else pa.array(v, type=arrow.field(n_kept + k).type) for k, v in enumerate(made)]
                del made, ins
                yield pa.RecordBatch.from_arrays(
                    [c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
                )

        # the worker lives on with the next task: what this one gathered goes back to the system now
        del apply
        give_back()

    return source.mapInArrow(run, schema)
