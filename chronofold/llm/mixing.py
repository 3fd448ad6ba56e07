"""Mixing sources to target weights, by a low-discrepancy schedule of equal-token blocks.

Targets: the sources, by name (code points, null last), weigh 1, 2, 3, 1, 2, 3, ...
(or as the caller says) and share all tokens; one that would get more than
MAX_EPOCHS times its own tokens stops there, and the excess is shared by weight
among the others until none is above.

Order of a source: its documents by a hash of seed, id and text, laid end to end.
That line, repeated MAX_EPOCHS times, is cut into blocks of equally many tokens
(an epoch's last block may be shorter). Schedule: slot k of the mix maps the
golden-ratio point frac(k * phi) through the cumulative target weights to a
source, and the slot's rank among the source's slots says which block it takes;
a closing round gives each source the slots it still lacks. The last block is
cut at the target, so that every source's tokens come to its target, rounded
down.

All steps are Spark expressions. Running sums go by buckets: sums per bucket
first, then within each, so no task needs a whole source; only tables with a row
a source, or a row a bucket, are summed in one piece.

Edge cases: a null text has size 0; documents of size 0 take part with 0 taken;
repeated rows are each laid out; an empty table gives no rows. Null ids and
sources are groups like others.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
#: Blocks in the average document. Smaller blocks follow the weights more closely and cost rows.
BLOCKS_PER_DOC = 4
#: Documents in the average bucket of a running sum.
BUCKET_DOCS = 1000
#: Slots in a piece of the schedule.
PIECE = 4096
#: Fixed by the method: 2^32 divided by the golden ratio, odd, as frac(k * phi) in 32 bits.
GOLDEN, TURN = 2654435769, 1 << 32


class Mix(NamedTuple):
    #: document columns with size, source_size, target, taken
    documents: DataFrame
    #: slot, source, block, doc, from_token, to_token: the order of training
    schedule: DataFrame


def row_key(id_col: str = "doc_id", text_col: str = "text", seed: int = 5) -> Column:
    """The key of a row in `documents`: a hash of seed, id and text."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col), F.lit("")))))


def point(slot: Column) -> Column:
    """frac(slot * phi) in 32 bits. By the negative number that GOLDEN is modulo TURN, as the product by GOLDEN itself can leave 64 bits."""
    return F.pmod(slot % TURN * (GOLDEN - TURN), F.lit(TURN))


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size -> with weight and target. A row a source, so one window over all of them is small."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("weight", F.get(cycle, (F.row_number().over(by_name) - 1) % len(weights)))
    s = s.withColumn("cap", (F.col("source_size") * epochs).cast("double"))
    # filling all to the same level, target = weight * level, those with the least cap for their weight stop first
    full = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, every = full.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumns(
        {
            "all_words": F.sum("source_size").over(every).cast("double"),
            "stopped_cap": F.coalesce(F.sum("cap").over(upto), F.lit(0.0)),
            "other_weight": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)),
        }
    )
    # the level if exactly the sources before this one have stopped; the right one is the first that doesn't pass its own cap
    s = s.withColumn("level", (F.col("all_words") - F.col("stopped_cap")) / F.col("other_weight"))
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "source", "level"))).over(every)["level"])
    return s.select("source", "source_size", "weight", F.least(F.coalesce(F.col("level") * F.col("weight"), F.col("cap")), F.col("cap")).alias("target"))


def _running(df: DataFrame, group: list[str], bucket: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Running sum (before the row) of `value` in each group by bucket, then order: per bucket, then within each."""
    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(g).alias(f"_{g}") for g in group], F.col(bucket).alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    within = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    joined = rows.join(sums, same & (F.col(bucket) == F.col("_b")))
    return joined.withColumn(out, F.col("_before") + F.col("_within")).drop("_before", "_within", "_b", *[f"_{g}" for g in group])


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 5, blocks_per_doc: int = BLOCKS_PER_DOC) -> Mix:
    """The mix of all documents; `documents` has a row for each, `schedule` one for each part of a document that a slot takes."""
    key = row_key(id_col, text_col, seed)
    sized = materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(text_col).alias("size"), key.alias("key")))
    whole = sized.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()
    block = max(1, whole.words // max(1, whole.n * blocks_per_doc))
    buckets = max(1, whole.n // BUCKET_DOCS)

    sources = materialize(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))))
    per_epoch = F.ceil(F.col("source_size") / block)
    wanted = F.floor("target").cast("bigint")
    sources = sources.withColumns({"per_epoch": per_epoch, "wanted": wanted})
    left = F.col("wanted") % F.greatest(F.col("source_size"), F.lit(1))
    sources = sources.withColumn("slots", F.when(F.col("source_size") > 0, F.floor(F.col("wanted") / F.col("source_size")) * F.col("per_epoch") + F.ceil(left / block)).otherwise(0))

    # documents laid out in their sources, and the parts of them in each block
    prefix = F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint")
    laid = sized.withColumn("bucket", F.floor(prefix * buckets / TURN))
    laid = materialize(_running(laid, ["source"], "bucket", [F.col("key"), F.col("id"), F.col("size")], "size", "start").withColumn("row", F.monotonically_increasing_id()))
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    parts = laid.where(F.col("size") > 0).withColumn("block", F.explode(F.sequence(first, last)))

    # the schedule: points through the cumulative weights, ranked per source by pieces of the sequence
    total = sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    line = Window.orderBy(F.col("source").asc_nulls_last())
    share = F.try_divide(F.col("target"), F.sum("target").over(Window.partitionBy()))
    upper = F.floor(F.sum(share).over(line.rowsBetween(Window.unboundedPreceding, 0)) * TURN).cast("bigint")
    ranges = sources.where(F.col("slots") > 0).select("source", upper.alias("upper"))
    ranges = ranges.withColumn("lower", F.coalesce(F.lag("upper").over(line), F.lit(0)))
    at_end = F.lead("upper").over(line).isNull()
    ranges = ranges.withColumn("upper", F.when(at_end, F.lit(TURN)).otherwise(F.col("upper")))
    slots = docs.sparkSession.range(total).withColumn("point", point(F.col("id")))
    # a source's range goes into all cells of the circle that it touches, so that points find it by an equality;
    # there are more cells than sources, so that a point meets about one range
    cell = TURN >> min(30, max(10, (4 * sources.count()).bit_length()))
    spread = ranges.where(F.col("upper") > F.col("lower")).withColumn("cell", F.explode(F.sequence(F.floor(F.col("lower") / cell), F.floor((F.col("upper") - 1) / cell))))
    hit = slots.withColumn("cell", F.floor(F.col("point") / cell)).join(spread, "cell").where((F.col("point") >= F.col("lower")) & (F.col("point") < F.col("upper")))
    hit = hit.select(F.col("id").alias("slot"), "source", F.floor(F.col("id") / PIECE).alias("piece"), F.lit(1).alias("one"))
    ranked = _running(hit, ["source"], "piece", [F.col("slot")], "one", "rank").select("slot", "source", "rank")
    had = ranked.groupBy(F.col("source").alias("_source")).agg(F.count(F.lit(1)).alias("had"))
    lacking = sources.join(had, F.col("source").eqNullSafe(F.col("_source")), "left").withColumn("had", F.coalesce("had", F.lit(0))).where(F.col("had") < F.col("slots"))
    closing = lacking.select("source", F.explode(F.sequence(F.col("had"), F.col("slots") - 1)).alias("rank"))
    # a cut in a long plan, so that no job has all its stages
    ranked = materialize(ranked.unionByName(closing.withColumn("slot", F.lit(total) + F.col("rank"))))

    facts = sources.select(F.col("source").alias("_s"), "source_size", "target", "per_epoch", "wanted", "slots")
    named = ranked.join(facts, F.col("source").eqNullSafe(F.col("_s"))).where(F.col("rank") < F.col("slots"))
    named = named.select("slot", F.col("_s").alias("slot_source"), "source_size", "wanted", (F.col("rank") % F.col("per_epoch")).alias("slot_block"), F.floor(F.col("rank") / F.col("per_epoch")).alias("epoch"))
    taken = parts.join(named, F.col("source").eqNullSafe(F.col("slot_source")) & (F.col("block") == F.col("slot_block")))
    # a slot's tokens: the block's, but no more than the source still lacks
    begin = F.greatest(F.col("start"), F.col("block") * block)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block, F.col("wanted") - F.col("epoch") * F.col("source_size"))
    taken = taken.withColumns({"from_token": begin - F.col("start"), "to_token": end - F.col("start")}).where(F.col("to_token") > F.col("from_token"))
    schedule = taken.select("slot", "source", "block", "epoch", "row", F.col("id").alias(id_col), "from_token", "to_token")

    sums = taken.groupBy(F.col("row").alias("_row")).agg(F.sum(F.col("to_token") - F.col("from_token")).alias("taken"))
    rows = laid.join(sums, F.col("row") == F.col("_row"), "left").join(facts, F.col("source").eqNullSafe(F.col("_s")))
    documents = rows.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "key", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    return Mix(documents, schedule)
