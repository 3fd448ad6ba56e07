"""Map/reduce views: declared in SQL expressions, evaluated in one pass or folded batch by batch.

A view has maps, each a projection of the events of one topic (or of all), whose
rows are put together; a reduce, which groups them by its key and aggregates; and
so a result a key. `run` over all events is what a view means; the incremental
forms must give the same, which they do if the reduce can be applied to its own
results: each output is a column of the maps under that aggregate of itself that
gives the same whether rows come at once or in parts, a sum, a minimum or the like.
A view that isn't so is refused when it is made. An average is two sums, a count
the sum of a column of ones.

A map may name checks. An event that fails one isn't mapped and goes to the
rejects; the others go on. In a batch a map stops after ERRORS events in a row
that fail, for the rest of that batch. Events of many batches can be looked at
together: a column `batch` then says which one an event is of.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import NULL_KEY, fold, reduce_key, result_key

#: Events of a small batch.
BATCH = 1024
#: Events in a row that fail a map's checks and end it for the batch.
ERRORS = 50
#: What a key's result says if its reduce gave no row (fixed by the data model).
INVALID = "Invalid reduce result was generated"

#: Aggregates that give the same over parts' results as over all rows.
_AGAIN = "sum|min|max|first|first_value|any_value|bool_and|every|bool_or|some|any|bit_and|bit_or|bit_xor"
_CAST = re.compile(r"\s*cast\s*\((?P<inner>.*)\s+as\s+[\w\s(),]+\)\s*", re.I | re.S)
_CALL = re.compile(rf"\s*(?P<name>{_AGAIN})\s*\(\s*(?P<of>`[^`]+`|\w+)\s*(?:,\s*true\s*)?\)\s*", re.I)
_BY = re.compile(r"\s*(?P<name>min|max)_by\s*\(\s*(?P<of>`[^`]+`|\w+)\s*,\s*(?P<by>`[^`]+`|\w+)\s*\)\s*", re.I)


def _without_casts(expression: str) -> str:
    while m := _CAST.fullmatch(expression):
        expression = m["inner"]
    return expression.strip()


def _aggregate(expression: str) -> tuple[str, str] | None:
    """(aggregate, column) of an expression that is an aggregate of a column, casts aside."""
    m = _CALL.fullmatch(_without_casts(expression))
    return (m["name"].lower(), m["of"].strip("`")) if m else None


def can_reduce_again(name: str, reduce: dict[str, str], key: str) -> bool:
    """Whether the output `name` of a reduce is the same if it is applied to parts' results."""
    plain = _without_casts(reduce[name])
    if plain == key.strip() or plain.strip("`") == name:
        return True
    if m := _BY.fullmatch(plain):
        by = m["by"].strip("`")
        return m["of"].strip("`") == name and _aggregate(reduce.get(by, "")) == (m["name"].lower(), by)
    return (_aggregate(plain) or ("", ""))[1] == name


@dataclass(frozen=True)
class Map:
    """columns: name to SQL expression over an event (etag, topic, ts, data); topic: None for all events.

    checks: name to SQL condition that an event must meet to be mapped, such as
    "try_cast(get_json_object(data, '$.n') AS INT) IS NOT NULL"; null fails.
    """

    columns: dict[str, str]
    topic: str | None = None
    where: str | None = None
    checks: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class View:
    """reduce: name to SQL aggregate over the maps' columns; key: the SQL expression that rows are grouped by.

    The key's text is the reduce key. A column of the reduce that is the key itself
    (as by = "Key", reduce {"Key": "Key", ...}) passes through.
    """

    name: str
    maps: tuple[Map, ...]
    reduce: dict[str, str]
    key: str
    description: str = field(default="", compare=False)

    def __post_init__(self):
        if not self.name or not self.maps or not self.reduce:
            raise ValueError("a view needs a name, a map and a reduce")
        first = list(self.maps[0].columns)
        for m in self.maps[1:]:
            if sorted(m.columns) != sorted(first):
                raise ValueError(f"the maps of {self.name} have different columns: {first}, {list(m.columns)}")
        if open_ := [c for c in self.reduce if c not in first]:
            raise ValueError(f"the reduce of {self.name} can't be applied to its own results: no map has {', '.join(open_)}")
        if bad := [f"{e} AS {c}" for c, e in self.reduce.items() if not can_reduce_again(c, self.reduce, self.key)]:
            raise ValueError(f"the reduce of {self.name} gives something else if it is applied to its own results: {'; '.join(bad)}")

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> View:
        d = json.loads(text)
        return cls(d["name"], tuple(Map(**m) for m in d["maps"]), d["reduce"], d["key"], d.get("description", ""))

    def version(self) -> str:
        """Changes when the meaning does, and not with the name's spelling or the description."""
        d = asdict(self) | {"name": "", "description": ""}
        return hashlib.sha256(json.dumps(d, sort_keys=True).encode()).hexdigest()[:16]

    def describe(self) -> str:
        """The view as SQL text."""
        maps = []
        for m in self.maps:
            test = " AND ".join(x for x in (f"topic = '{m.topic}'" if m.topic else "", m.where or "") if x)
            maps.append("SELECT " + ", ".join(f"{e} AS {c}" for c, e in m.columns.items()) + " FROM events" + (f" WHERE {test}" if test else ""))
        return "SELECT " + ", ".join(f"{e} AS {c}" for c, e in self.reduce.items()) + "\nFROM (" + "\n  UNION ALL ".join(maps) + f")\nGROUP BY {self.key}"


def _mapped(m: Map, events: DataFrame) -> DataFrame:
    """The events of a map's topic that its condition leaves. A topic becomes a filter that reaches the scan's partitions."""
    rows = events if m.topic is None else events.where(F.col("topic") == m.topic)
    return rows.where(m.where) if m.where else rows


def _checks(m: Map) -> dict[str, Column]:
    return {name: F.expr(test) for name, test in m.checks.items()}


def _until(rows: DataFrame, stops: dict[int, str]) -> DataFrame:
    """Without what comes after a stop in its batch."""
    found = rows.sparkSession.createDataFrame(list(stops.items()), "batch long, stop string")
    rows = rows.join(F.broadcast(found), "batch", "left")  # a row a batch that stops
    return rows.where(F.col("stop").isNull() | (F.col("etag") <= F.col("stop"))).drop("stop")


def map_rows(view: View, events: DataFrame, stops: dict[int, dict[int, str]] | None = None, *extra: Column) -> DataFrame:
    """The rows of all maps, without events that fail a map's checks. stops: by a map's number, and then by batch, the etag that it doesn't go beyond."""
    parts = []
    for k, m in enumerate(view.maps):
        rows = _mapped(m, events)
        if m.checks:
            rows = tolerant(rows, _checks(m))[0]
        if stops and k in stops:
            rows = _until(rows, stops[k])
        parts.append(rows.select(*extra, *[F.expr(e).alias(c) for c, e in m.columns.items()]))
    return reduce(DataFrame.unionByName, parts)


def rejects(view: View, events: DataFrame, stops: dict[int, dict[int, str]] | None = None) -> DataFrame | None:
    """map (its number), rejected_by (the checks failed), and the event; None if no map has checks. stops: as for map_rows."""
    parts = []
    for k, m in enumerate(view.maps):
        if m.checks:
            rows = tolerant(_mapped(m, events), _checks(m))[1].withColumn("map", F.lit(k))
            parts.append(_until(rows, stops[k]) if stops and k in stops else rows)
    return reduce(DataFrame.unionByName, parts).select("map", "rejected_by", *events.columns) if parts else None


def stops(view: View, events: DataFrame, errors: int = ERRORS) -> dict[int, dict[int, str]]:
    """By a map's number, and then by batch, the etag where it has met `errors` failing events in a row. Looks at the rejects and, if a batch has enough, at the order in each batch."""
    from pyspark.sql import Window

    order = Window.partitionBy("batch").orderBy("etag")
    out = {}
    for k, m in enumerate(view.maps):
        if not m.checks:
            continue
        rows, bad = _mapped(m, events), F.lit(False)
        for ok in _checks(m).values():
            bad = bad | ~F.coalesce(ok, F.lit(False))
        enough = rows.where(bad).groupBy("batch").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= errors)
        if enough.isEmpty():
            continue
        # a batch is of one task; a row's place less that of the last good one is the number of failing ones in a row
        placed = rows.select("batch", "etag", bad.alias("bad")).withColumn("place", F.row_number().over(order))
        good = F.max(F.when(~F.col("bad"), F.col("place"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        full = placed.withColumn("n", F.col("place") - F.coalesce(good, F.lit(0))).where(F.col("n") == errors)
        if at := {r.batch: r.at for r in full.groupBy("batch").agg(F.min("etag").alias("at")).collect()}:  # a row a batch that stops
            out[k] = at
    return out


def reduce_rows(view: View, rows: DataFrame) -> DataFrame:
    """reduce_key and the reduce's columns; no rows give no result, also for a constant key."""
    keyed = rows.withColumn("__key", F.expr(view.key))
    kind = keyed.schema["__key"].dataType
    keyed = keyed.withColumn("reduce_key", reduce_key(F.col("__key"), kind))
    outputs = [F.expr(f"first({e}, true)" if e == view.key or e in rows.columns else e).alias(c) for c, e in view.reduce.items()]
    return keyed.groupBy("reduce_key").agg(*outputs)


def map_with(events: DataFrame, function, schema: str) -> DataFrame:
    """A map that expressions can't write: function takes and yields Arrow batches (none, one or many rows for each)."""
    return events.mapInArrow(lambda batches: (out for b in batches for out in function(b)), schema)


def reduce_with(rows: DataFrame, key: str, function, schema: str) -> DataFrame:
    """A reduce that expressions can't write: function takes the Arrow table of one key's rows and returns one of `schema`.

    All rows of a key go to one call, so a reduce that can be an aggregate should be one.
    """
    return rows.groupBy(F.expr(key).alias("__key")).applyInArrow(lambda table: function(table), schema)


def reduce_checked(rows: DataFrame, key: str, function, schema: str) -> DataFrame:
    """As reduce_with, with reduce_key and error: a key for which the function returns no row is a row of nulls with the error INVALID."""
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    named = rows.withColumn("__key", F.expr(key))
    named = named.withColumn("reduce_key", reduce_key(F.col("__key"), named.schema["__key"].dataType)).drop("__key")
    out = T.StructType([*T.StructType.fromDDL(schema).fields, T.StructField("reduce_key", T.StringType()), T.StructField("error", T.StringType())])
    wanted = to_arrow_schema(out)
    columns, invalid = wanted.names[:-2], INVALID

    def run_(key_, table):
        found = function(table.drop_columns(["reduce_key"]))
        n = found.num_rows
        values = [found.column(c) for c in columns] if n else [pa.nulls(1)] * len(columns)
        values += [pa.array([key_[0].as_py()] * max(n, 1)), pa.array([None] * n if n else [invalid], pa.string())]
        return pa.table([v.cast(f.type) for v, f in zip(values, wanted, strict=True)], names=wanted.names)

    return named.groupBy("reduce_key").applyInArrow(run_, out)


def run(view: View, events: DataFrame) -> DataFrame:
    """The view over all events at once."""
    return reduce_rows(view, map_rows(view, events))


def fold_into(view: View, state: DataFrame | None, partial: DataFrame) -> DataFrame:
    """The view after a batch: its partial results and the stored ones, reduced again."""
    rows = partial.drop("reduce_key")
    if state is not None:
        rows = state.drop("reduce_key").unionByName(rows)
    return reduce_rows(view, rows)


def fold_batches(view: View, events: DataFrame, batch: Column) -> DataFrame:
    """The view by partial results of each batch, reduced again: the incremental form as one query."""
    rows = map_rows(view, events, None, batch.alias("__batch"))
    outputs = [F.expr(f"first({e}, true)" if e == view.key or e in rows.columns else e).alias(c) for c, e in view.reduce.items()]
    partial = rows.withColumn("__key", F.expr(view.key)).groupBy("__batch", "__key").agg(*outputs)
    return reduce_rows(view, partial.select(*view.reduce))


def results(view: View, found: DataFrame) -> DataFrame:
    """All results in the order of their folded keys, with the key they have in storage."""
    return found.withColumn("result_key", result_key(view.name, F.col("reduce_key"))).orderBy(fold(F.col("reduce_key")), "reduce_key")


def result(found: DataFrame, key: object) -> DataFrame:
    """The result of one key, whatever its case; null asks for the null key."""
    return found.where(fold(F.col("reduce_key")) == fold(F.lit(NULL_KEY if key is None else str(key))))


def stored_together(found: DataFrame) -> DataFrame:
    """A row a folded key with the array of its results: one, or several where keys differ only in case."""
    columns = [c for c in found.columns if c != "reduce_key"]
    each = F.struct("reduce_key", *columns)
    return found.groupBy(fold(F.col("reduce_key")).alias("stored_key")).agg(F.array_sort(F.collect_list(each)).alias("results"))


def tolerant(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects): rows that fail a check go, with the names of those they fail, to a table of their own."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    marked = df.withColumn("rejected_by", failed)
    return marked.where(F.size("rejected_by") == 0).drop("rejected_by"), marked.where(F.size("rejected_by") > 0)


def over_budget(df: DataFrame, ok: Column, order: str, budget: int = 50) -> DataFrame:
    """Runs of at least `budget` consecutive rejected rows: first, last, n. A good row starts the count anew."""
    from pyspark.sql import Window

    # the place of a row less its place among the rejected is constant within a run; a batch has BATCH rows
    rows = df.select(F.col(order).alias("at"), (~F.coalesce(ok, F.lit(False))).alias("bad"))
    everyone, same = Window.orderBy("at"), Window.partitionBy("bad").orderBy("at")
    rows = rows.withColumn("run", F.row_number().over(everyone) - F.row_number().over(same)).where("bad")
    return rows.groupBy("run").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= budget).drop("run")
