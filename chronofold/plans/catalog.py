"""Queries over the driver's tables, one or more for each operator, with their SQL.

`events` plays the event log: event_type is the topic, event_id the etag's number,
props the document. `change_log` plays the versioned store: key 'u/' + user_id,
seq event_id + 1, a delete where event_type is 'error'. The queries named log_,
store_ and engine_ write them into a log or store of their own in the shared
folder first, and read them from there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import functions as fn
from ..functions import histograms as hist
from ..operators import changelog, mapreduce, measures
from ..operators.compaction import compact
from ..operators.mapreduce import Map, View
from ..session import scratch
from ..sources import EventLog, EventStream, Store
from ..streaming import Engine

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

SNAPSHOT = 5000


def query(sql: str | None):
    """Register a query under its function's name, with its SQL if it has one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(fn.etag(F.col("event_id")).alias("etag"), F.col("event_type").alias("topic"), "ts", F.col("props").alias("data"), "event_id", "user_id", "value")


def change_log(spark: SparkSession, sf_dir: str, mixed_case: bool = False) -> DataFrame:
    e = table(spark, sf_dir, "events")
    key = F.concat(F.lit("u/"), F.col("user_id").cast("string"))
    if mixed_case:
        key = F.concat(F.when(F.col("event_id") % 2 == 0, "U/Key").otherwise("u/kEY"), (F.col("event_id") % 750).cast("string"))
    op = F.when(F.col("event_type") == "error", changelog.DELETE).otherwise(changelog.PUT)
    return e.select(key.alias("key"), (F.col("event_id") + 1).alias("seq"), op.cast("tinyint").alias("op"), "value")


LOG = """log AS (SELECT 'u/' || CAST(user_id AS VARCHAR) AS key, event_id + 1 AS seq,
    CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS op, value FROM events)"""
NEWEST = "SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS place FROM log"
FOLD = "translate(key, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


# -- map/reduce views ---------------------------------------------------------------------------------

COUNT_ALL = View("Test", (Map({"Count": "1"}),), {"Count": "CAST(sum(Count) AS DOUBLE)"}, "1")


@query("SELECT '1' AS reduce_key, CAST(count(*) AS DOUBLE) AS \"Count\" FROM events HAVING count(*) > 0")
def mr_count_all(spark, sf_dir):
    return mapreduce.run(COUNT_ALL, event_log(spark, sf_dir))


_MONTH = "concat_ws('/', CAST(user_id AS STRING), CAST(year(ts) AS STRING), CAST(month(ts) AS STRING))"
MONTHLY = View(
    "Monthly",
    (
        Map({"Spent": "CAST(value AS DECIMAL(18,2))", "Clicks": "0", "Key": _MONTH}, "purchase"),
        Map({"Spent": "CAST(0 AS DECIMAL(18,2))", "Clicks": "1", "Key": _MONTH}, "click"),
    ),
    {"Spent": "CAST(sum(Spent) AS DOUBLE)", "Clicks": "CAST(sum(Clicks) AS DOUBLE)", "Key": "Key"},
    "Key",
)
_MONTH_SQL = "CAST(user_id AS VARCHAR) || '/' || CAST(year(ts) AS VARCHAR) || '/' || CAST(month(ts) AS VARCHAR)"


@query(f"""
    SELECT "Key" AS reduce_key, CAST(sum(spent) AS DOUBLE) AS "Spent", CAST(sum(clicks) AS DOUBLE) AS "Clicks", "Key"
    FROM (SELECT CAST(value AS DECIMAL(18,2)) AS spent, 0 AS clicks, {_MONTH_SQL} AS "Key" FROM events WHERE event_type = 'purchase'
          UNION ALL
          SELECT CAST(0 AS DECIMAL(18,2)), 1, {_MONTH_SQL} FROM events WHERE event_type = 'click')
    GROUP BY "Key" """)
def mr_multimap_monthly(spark, sf_dir):
    return mapreduce.run(MONTHLY, event_log(spark, sf_dir))


BY_TOPIC = View(
    "ByTopic",
    (Map({"Topic": "topic", "Count": "1L", "Total": "CAST(value AS DECIMAL(38,2))", "Least": "value", "Most": "value"}),),
    {"Topic": "Topic", "Count": "sum(Count)", "Total": "CAST(sum(Total) AS DECIMAL(38,2))", "Least": "min(Least)", "Most": "max(Most)"},
    "Topic",
)
BY_TOPIC_SQL = """
    SELECT event_type AS reduce_key, event_type AS "Topic", count(*) AS "Count",
           CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS "Total", min(value) AS "Least", max(value) AS "Most"
    FROM events GROUP BY event_type"""


@query(BY_TOPIC_SQL)
def mr_incremental_fold(spark, sf_dir):
    found = mapreduce.fold_batches(BY_TOPIC, event_log(spark, sf_dir), F.floor(F.col("event_id") / mapreduce.BATCH))
    return found.withColumn("Total", F.col("Total").cast("double"))


@query(BY_TOPIC_SQL)
def mr_backfill_equals_incremental(spark, sf_dir):
    return mapreduce.run(BY_TOPIC, event_log(spark, sf_dir)).withColumn("Total", F.col("Total").cast("double"))


@query("""
    SELECT coalesce(k, '@null') AS reduce_key, count(*) AS "Count"
    FROM (SELECT CASE WHEN event_id % 3 = 0 THEN NULL ELSE '1' END AS k FROM events) GROUP BY 1""")
def mr_reduce_key_null(spark, sf_dir):
    e = event_log(spark, sf_dir)
    # a null, the number 1 and the string "1": two buckets
    text = Map({"Key": "IF(event_id % 3 = 0, NULL, '1')", "Count": "1L"}, where="event_id % 3 < 2")
    number = Map({"Key": "CAST(1 AS STRING)", "Count": "1L"}, where="event_id % 3 = 2")
    return mapreduce.run(View("Nulls", (text, number), {"Key": "Key", "Count": "sum(Count)"}, "Key"), e).select("reduce_key", "Count")


@query("""
    WITH found AS (SELECT CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END AS k, count(*) AS n FROM events GROUP BY 1)
    SELECT translate(k, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS stored_key,
           array_to_string(list_sort(list(k || '=' || CAST(n AS VARCHAR))), ',') AS results FROM found GROUP BY 1""")
def mr_multi_result(spark, sf_dir):
    view = View("Cased", (Map({"Key": "IF(event_id % 2 = 0, upper(topic), topic)", "Count": "1L"}),), {"Key": "Key", "Count": "sum(Count)"}, "Key")
    found = mapreduce.stored_together(mapreduce.run(view, event_log(spark, sf_dir)))
    texts = F.transform("results", lambda r: F.concat(r["reduce_key"], F.lit("="), r["Count"].cast("string")))
    return found.select("stored_key", F.array_join(F.array_sort(texts), ",").alias("results"))


@query("SELECT event_type AS reduce_key, count(*) AS \"Count\" FROM events WHERE event_type = 'click' GROUP BY 1")
def mr_result_for_key(spark, sf_dir):
    return mapreduce.result(mapreduce.run(BY_TOPIC, event_log(spark, sf_dir)), "CLICK").select("reduce_key", "Count")


@query("SELECT 'results/ByTopic/' || event_type AS result_key, event_type AS reduce_key, count(*) AS \"Count\" FROM events GROUP BY event_type ORDER BY event_type")
def mr_results_ordered(spark, sf_dir):
    found = mapreduce.run(BY_TOPIC, event_log(spark, sf_dir))
    return mapreduce.results(BY_TOPIC, found).select("result_key", "reduce_key", "Count")


@query("""
    SELECT event_type AS topic, count(*) FILTER (WHERE ok) AS n_ok, count(*) FILTER (WHERE NOT ok) AS n_rejected
    FROM (SELECT event_type, try_cast(CASE WHEN event_id % 7 = 0 THEN 'x' || props ELSE CAST(value AS VARCHAR) END AS DOUBLE) IS NOT NULL AS ok FROM events)
    GROUP BY 1""")
def mr_tolerant_map(spark, sf_dir):
    text = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("x"), "data")).otherwise(F.col("value").cast("string"))
    rows = event_log(spark, sf_dir).withColumn("text", text)
    good, rejected = mapreduce.tolerant(rows, {"number": F.col("text").try_cast("double").isNotNull()})
    both = good.select("topic", F.lit(1).alias("ok")).unionByName(rejected.select("topic", F.lit(0).alias("ok")))
    return both.groupBy("topic").agg(F.sum("ok").alias("n_ok"), F.sum(1 - F.col("ok")).alias("n_rejected"))


@query("""
    SELECT json_extract_string(props, '$.k') AS reduce_key, count(*) AS "Count", json_extract_string(props, '$.none') AS "Missing"
    FROM events GROUP BY 1, 3""")
def mr_json_props(spark, sf_dir):
    e = event_log(spark, sf_dir).select("topic", fn.field(F.col("data"), "k", "bigint").alias("k"), fn.field(F.col("data"), "none").alias("none"))
    view = View("Props", (Map({"Key": "k", "Missing": "none", "Count": "1L"}),), {"Key": "Key", "Count": "sum(Count)", "Missing": "max(Missing)"}, "Key")
    return mapreduce.run(view, e).select("reduce_key", "Count", "Missing")


_SPAN = "lpad(CAST(event_id % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(event_id % 59 AS VARCHAR), 2, '0')"


@query(f"""
    SELECT CAST(user_id AS VARCHAR) AS reduce_key,
           CAST(sum(3600 * CAST(split_part(d, ':', 1) AS BIGINT) + 60 * CAST(split_part(d, ':', 2) AS BIGINT) + CAST(split_part(d, ':', 3) AS BIGINT)) AS DOUBLE) AS "Seconds"
    FROM (SELECT user_id, {_SPAN} AS d FROM events) GROUP BY 1""")
def mr_duration_seconds(spark, sf_dir):
    e = event_log(spark, sf_dir).withColumn("span", F.expr(_SPAN.replace("VARCHAR", "STRING"))).withColumn("seconds", fn.duration_seconds(F.col("span")))
    return mapreduce.run(View("Spans", (Map({"Key": "user_id", "Seconds": "seconds"}),), {"Key": "Key", "Seconds": "sum(Seconds)"}, "Key"), e).select("reduce_key", "Seconds")


# -- the event log ------------------------------------------------------------------------------------


@query("SELECT event_id, event_type AS topic FROM events WHERE event_id > 5000 ORDER BY event_id LIMIT 1024")
def events_after_etag(spark, sf_dir):
    after = fn.keys.etag_text(5000)
    return event_log(spark, sf_dir).where(F.col("etag") > after).orderBy("etag").limit(mapreduce.BATCH).select("event_id", "topic")


@query("""
    SELECT event_id, '03000000-0000-0001-' || substr(h, 1, 4) || '-' || substr(h, 5, 12) AS etag, event_id AS number
    FROM (SELECT event_id, lpad(upper(hex(event_id)), 16, '0') AS h FROM events)""")
def events_etag_text(spark, sf_dir):
    e = event_log(spark, sf_dir)
    return e.select("event_id", "etag", fn.etag_number(fn.event_key(F.col("etag"))).alias("number"))


@query("SELECT event_type AS topic, count(*) AS n, max(event_id) AS last_event FROM events GROUP BY event_type")
def events_topic_counts(spark, sf_dir):
    return event_log(spark, sf_dir).groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_event"))


@query("SELECT max(event_id) AS last_event FROM events")
def events_last_etag(spark, sf_dir):
    return event_log(spark, sf_dir).agg(F.max("etag").alias("etag")).select(fn.etag_number(F.col("etag")).alias("last_event"))


def _stream(spark: SparkSession, sf_dir: str, parts: int) -> EventStream:
    """Events in so many appends, each by id."""
    stream = EventStream(spark, scratch(spark, "stream"))
    e = table(spark, sf_dir, "events")
    n = e.count()
    for k in range(parts):
        part = e.where((F.col("event_id") >= n * k // parts) & (F.col("event_id") < n * (k + 1) // parts))
        stream.append(part.orderBy("event_id").select("event_id", F.col("event_type").alias("topic")))
    return stream


@query("""
    SELECT CAST(range_no AS INTEGER) AS range_no, count(*) AS n, min(event_id) + 1 AS first_number, max(event_id) + 1 AS last_number
    FROM (SELECT event_id, (event_id * 4 + 3) // (SELECT count(*) FROM events) AS range_no FROM events) GROUP BY 1""")
def stream_count_ranges(spark, sf_dir):
    """From the commits alone."""
    found = _stream(spark, sf_dir, 4).ranges()
    rows = [(k, f["n"], fn.keys.etag_parts(f["first"])[1], fn.keys.etag_parts(f["last"])[1]) for k, f in enumerate(found)]
    return spark.createDataFrame(rows, "range_no int, n bigint, first_number bigint, last_number bigint")


@query("SELECT event_id, event_type AS topic FROM events WHERE event_id >= (SELECT 9 * count(*) // 10 FROM events) ORDER BY event_id")
def stream_read_from(spark, sf_dir):
    stream = _stream(spark, sf_dir, 2)
    start = fn.keys.etag_text(9 * stream.count() // 10 + 1, stream.log.epoch)
    found = stream.read_from(start)
    return found.select(fn.field(F.col("data"), "event_id", "bigint").alias("event_id"), fn.field(F.col("data"), "topic").alias("topic"))


@query("SELECT event_id, event_type AS topic, json_extract_string(props, '$.k') AS k FROM events")
def events_stamped(spark, sf_dir):
    e = event_log(spark, sf_dir).withColumn("data", fn.stamped(F.col("data"), F.col("topic")))
    topic = F.get_json_object("data", "$['@metadata']['Entity-Name']")
    return e.select("event_id", topic.alias("topic"), fn.field(F.col("data"), "k").alias("k"))


# -- the versioned store --------------------------------------------------------------------------------


@query(f"WITH {LOG} SELECT key, seq, value FROM ({NEWEST}) WHERE place = 1 AND op = 1")
def kv_latest(spark, sf_dir):
    return changelog.current(change_log(spark, sf_dir))


@query(f"WITH {LOG} SELECT key, seq, value FROM ({NEWEST} WHERE seq <= {SNAPSHOT}) WHERE place = 1 AND op = 1")
def kv_snapshot(spark, sf_dir):
    return changelog.current(change_log(spark, sf_dir), as_of=SNAPSHOT)


_CASED = """log AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'U/Key' ELSE 'u/kEY' END || CAST(event_id % 750 AS VARCHAR) AS key, event_id + 1 AS seq,
    CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS op, value FROM events)"""


@query(f"WITH {_CASED} SELECT key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY {FOLD} ORDER BY seq DESC) AS place FROM log) WHERE place = 1 AND op = 1")
def kv_ci_latest(spark, sf_dir):
    return changelog.current(change_log(spark, sf_dir, mixed_case=True))


@query(f"WITH {LOG} SELECT key, seq, value FROM ({NEWEST}) WHERE place = 1 AND op = 1 AND key = 'u/17'")
def kv_get(spark, sf_dir):
    return changelog.get(change_log(spark, sf_dir), "U/17")


@query(f"WITH {LOG} SELECT key, seq, value FROM ({NEWEST}) WHERE place = 1 AND op = 1 AND starts_with(key, 'u/12') ORDER BY key")
def kv_prefix(spark, sf_dir):
    return changelog.prefix(change_log(spark, sf_dir), "u/12")


@query(f"WITH {LOG} SELECT key, seq, value FROM ({NEWEST}) WHERE place = 1 AND op = 1 AND key >= 'u/3' AND key < 'u/6' ORDER BY key")
def kv_scan(spark, sf_dir):
    return changelog.scan(change_log(spark, sf_dir), "u/3", "u/6")


@query(f"WITH {LOG} SELECT key, seq, value FROM ({NEWEST}) WHERE place = 1 AND op = 1 ORDER BY key DESC LIMIT 10")
def kv_reverse_topn(spark, sf_dir):
    return changelog.last(change_log(spark, sf_dir), 10)


@query(f"WITH {LOG} SELECT key, seq, value FROM ({NEWEST}) WHERE place = 1 AND op = 1 ORDER BY key LIMIT 10")
def kv_first_topn(spark, sf_dir):
    return changelog.first(change_log(spark, sf_dir), 10)


@query(f"WITH {LOG} SELECT max(key) AS key FROM ({NEWEST}) WHERE place = 1 AND op = 1 AND key < 'u/5'")
def kv_seek_prev(spark, sf_dir):
    return changelog.seek_previous(change_log(spark, sf_dir), "u/5").select("key")


@query(f"WITH {LOG} SELECT min(key) AS key FROM ({NEWEST}) WHERE place = 1 AND op = 1 AND key >= 'u/100x'")
def kv_seek(spark, sf_dir):
    return changelog.seek(change_log(spark, sf_dir), "u/100x").select("key")


@query(f"""
    WITH {LOG}, there AS (SELECT key FROM ({NEWEST}) WHERE place = 1 AND op = 1),
    probes AS (SELECT DISTINCT 'u/' || CAST(o_custkey AS VARCHAR) AS probe FROM orders)
    SELECT probe, (SELECT min(key) FROM there WHERE key >= probe) AS key FROM probes""")
def kv_seek_ge(spark, sf_dir):
    probes = table(spark, sf_dir, "orders").select(F.concat(F.lit("u/"), F.col("o_custkey").cast("string")).alias("probe")).distinct()
    return changelog.seek_each(change_log(spark, sf_dir), probes)


_PROBES = "probes AS (SELECT DISTINCT 'u/' || CAST(o_custkey AS VARCHAR) AS key FROM orders)"


def probe_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("u/"), F.col("o_custkey").cast("string")).alias("key")).distinct()


@query(f"WITH {LOG}, {_PROBES} SELECT key FROM probes WHERE key NOT IN (SELECT key FROM ({NEWEST}) WHERE place = 1 AND op = 1)")
def kv_missing(spark, sf_dir):
    return changelog.missing(change_log(spark, sf_dir), probe_keys(spark, sf_dir))


@query(f"WITH {LOG}, {_PROBES} SELECT key, seq, value FROM ({NEWEST}) WHERE place = 1 AND op = 1 AND key IN (SELECT key FROM probes)")
def kv_multiget(spark, sf_dir):
    return changelog.multi_get(change_log(spark, sf_dir), probe_keys(spark, sf_dir))


_COMPACT = f"""
    WITH {LOG}, seen AS (SELECT *, lag(seq) OVER (PARTITION BY key ORDER BY seq DESC) AS newer FROM log)
    SELECT key, seq, op, value FROM seen
    WHERE NOT coalesce(newer <= {SNAPSHOT}, false) AND NOT (op = 0 AND seq <= {SNAPSHOT})"""


@query(_COMPACT.replace("seq, op, value", "seq, CAST(op AS TINYINT) AS op, value"))
def kv_compact(spark, sf_dir):
    return compact(change_log(spark, sf_dir), least_snapshot=SNAPSHOT)


@query(f"WITH {LOG} SELECT key, seq, value FROM ({NEWEST} WHERE seq <= 7000) WHERE place = 1 AND op = 1")
def kv_compact_invariant(spark, sf_dir):
    return changelog.current(compact(change_log(spark, sf_dir), least_snapshot=SNAPSHOT), as_of=7000)


@query(f"""
    WITH {LOG}, seen AS (SELECT *, lag(seq) OVER (PARTITION BY key ORDER BY seq DESC) AS newer FROM log)
    SELECT key, seq, CAST(op AS TINYINT) AS op, value FROM seen
    WHERE NOT (key >= 'u/2' AND key <= 'u/5' AND (newer IS NOT NULL OR op = 0))""")
def kv_compact_range(spark, sf_dir):
    return compact(change_log(spark, sf_dir), begin="u/2", end="u/5")


@query("""
    WITH runs AS (SELECT o_orderkey AS k FROM orders UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)
    SELECT count(*) AS n, count(DISTINCT k) AS n_keys, CAST(0 AS BIGINT) AS out_of_order FROM runs""")
def kv_merge_runs(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    merged = changelog.merge_runs([orders.where(f"k % 3 = {i}") for i in range(3)] + [orders.where("k % 3 = 0")], "k")
    # order within a partition, and of the partitions: the sort deals ranges out in order
    placed = merged.withColumn("p", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    before = F.lag("k").over(Window.partitionBy("p").orderBy("at"))
    ends = placed.withColumn("bad", F.coalesce((F.col("k") < before).cast("bigint"), F.lit(0))).groupBy("p").agg(F.sum("bad").alias("bad"), F.min("k").alias("lo"), F.max("k").alias("hi"), F.count(F.lit(1)).alias("n"))
    across = F.coalesce((F.col("lo") < F.lag("hi").over(Window.orderBy("p"))).cast("bigint"), F.lit(0))
    total = ends.withColumn("across", across).agg(F.sum("n").alias("n"), F.sum(F.col("bad") + F.col("across")).alias("out_of_order"))
    return total.crossJoin(F.broadcast(merged.agg(F.count_distinct("k").alias("n_keys")))).select("n", "n_keys", "out_of_order")  # one row each


@query("SELECT event_id, CAST((event_id + 1) * 256 + CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS BIGINT) AS packed, event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS op FROM events")
def kv_pack(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", fn.pack(F.col("event_id") + 1, F.when(F.col("event_type") == "error", 0).otherwise(1)).alias("packed"))
    seq, op = fn.unpack(F.col("packed"))
    return e.select("event_id", "packed", seq.alias("seq"), op.alias("op"))


@query("""
    SELECT CAST(o_orderkey % 7 AS BIGINT) AS level, count(*) AS n_files, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS size,
           min(o_orderkey) AS smallest, max(o_orderkey) AS largest FROM orders GROUP BY 1""")
def kv_stats_by_level(spark, sf_dir):
    files = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 7).alias("level"), "o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("size"))
    return files.groupBy("level").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").cast("double").alias("size"), F.min("o_orderkey").alias("smallest"), F.max("o_orderkey").alias("largest"))


@query("""
    WITH numbered AS (SELECT event_id // 10 AS batch, event_id % 10 AS position, 'u/' || CAST(user_id AS VARCHAR) AS key, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS op, value FROM events)
    SELECT batch, key, position + 1 AS seq, value FROM (SELECT *, row_number() OVER (PARTITION BY batch, key ORDER BY position DESC) AS place FROM numbered) WHERE place = 1 AND op = 1""")
def batch_last_op_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "error", 0).otherwise(1)
    batch = F.expr("event_id div 10")
    # each batch has keys of its own, so that all of them can be applied at once
    key = F.concat_ws("/", batch.cast("string"), F.concat(F.lit("u/"), F.col("user_id").cast("string")))
    rows = e.select((F.col("event_id") % 10).alias("position"), key.alias("key"), op.alias("op"), F.struct("value", batch.alias("batch")).alias("value"))
    newest = changelog.current(changelog.as_batch(rows, 0))
    return newest.select("value.batch", F.substring_index("key", "/", -2).alias("key"), "seq", "value.value")


@query("""
    SELECT event_id // 1000 AS batch, count(*) AS operations,
           CAST(sum(octet_length(encode('u/' || CAST(user_id AS VARCHAR))) + octet_length(encode(props))) AS BIGINT) AS bytes FROM events GROUP BY 1""")
def batch_sizes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(F.expr("event_id div 1000").alias("batch"), F.concat(F.lit("u/"), F.col("user_id").cast("string")).alias("key"), F.col("props").alias("value"))
    return changelog.size_of(rows, F.col("batch"))


# -- workloads and measures --------------------------------------------------------------------------------


@query("SELECT event_id, lpad(CAST(event_id AS VARCHAR), 16, '0') AS key FROM events")
def bench_key(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", fn.bench_key(F.col("event_id")).alias("key"))


@query(f"""
    WITH limits AS (SELECT unnest([{", ".join(repr(x) for x in hist.BUCKETS[:-1])}]) AS l),
    binned AS (SELECT value, (SELECT count(*) FROM limits WHERE l <= value) AS bucket FROM events)
    SELECT CAST(bucket AS INTEGER) AS bucket, count(*) AS n, min(value) AS lo, max(value) AS hi, round(sum(value), 4) AS total FROM binned GROUP BY 1""")
def hist_value(spark, sf_dir):
    return fn.histogram(table(spark, sf_dir, "events"), "value").select("bucket", "n", "lo", "hi", F.round("total", 4).alias("total"))


@query("SELECT count(*) AS n, min(value) AS lo, max(value) AS hi, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS deviation FROM events")
def hist_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    parts = [fn.histogram(e.where(f"event_id % 3 = {k}"), "value") for k in range(3)]
    whole = fn.summary(fn.merge(parts[0].unionByName(parts[1]).unionByName(parts[2])))
    return whole.withColumns({c: F.round(c, 4) for c in ("mean", "deviation")})


_LIMITS = ", ".join(repr(x) for x in [0.0, *hist.BUCKETS])


@query(f"""
    WITH limits AS (SELECT [{_LIMITS}] AS l),
    binned AS (SELECT value, len(list_filter(l[2:154], lambda x: x <= value)) AS bucket FROM events, limits),
    counts AS (SELECT bucket, count(*) AS n FROM binned GROUP BY 1),
    running AS (SELECT *, sum(n) OVER (ORDER BY bucket) AS upto, sum(n) OVER () AS total FROM counts),
    hit AS (SELECT * FROM running WHERE upto >= total * 0.5 ORDER BY bucket LIMIT 1)
    SELECT round(least(greatest(l[bucket + 1] + (l[bucket + 2] - l[bucket + 1]) * ((total * 0.5 - (upto - n)) / n),
           (SELECT min(value) FROM events)), (SELECT max(value) FROM events)), 6) AS median FROM hit, limits""")
def hist_median(spark, sf_dir):
    return hist.percentile(fn.histogram(table(spark, sf_dir, "events"), "value"), 50).select(F.round("value", 6).alias("median"))


@query("SELECT o_orderpriority AS op, count(*) AS ops, CAST(sum(o_custkey) AS BIGINT) AS bytes, max(o_orderkey) AS elapsed, round(CAST(sum(o_custkey) AS DOUBLE) / max(o_orderkey), 6) AS rate FROM orders GROUP BY 1")
def bench_rollup(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    found = measures.roll_up(orders, F.col("o_orderpriority"), F.lit(1), F.col("o_custkey"), F.col("o_orderkey"))
    return found.withColumn("rate", F.round("rate", 6))


@query("""
    WITH bits AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 2197175160) ELSE c >> 1 END)) AS t),
    bytes AS (SELECT event_id, hex(encode(props)) AS h FROM events),
    listed AS (SELECT event_id, t, list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)) AS b FROM bytes, bits),
    crcs AS (SELECT event_id, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) AS crc FROM listed)
    SELECT event_id, crc, (((crc >> 15) | ((crc << 17) & 4294967295)) + 2726488792) % 4294967296 AS masked FROM crcs""")
def crc32c_text(spark, sf_dir):
    crc = fn.crc32c(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", crc.alias("crc"), fn.crc32c_mask(crc).alias("masked"))


@query("SELECT count(DISTINCT user_id) AS n, count(DISTINCT user_id) AS n_matched FROM events")
def bloom_no_false_negatives(spark, sf_dir):
    users = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key")).distinct()
    filter_ = fn.BloomFilter.build(users, "key")
    return users.agg(F.count(F.lit(1)).alias("n"), F.count_if(filter_.may_match(F.col("key"))).alias("n_matched"))


@query("""
    WITH numbers AS (SELECT event_id, event_id * event_id * 7 AS n FROM events)
    SELECT event_id, n, array_to_string(list_transform(range(greatest(1, (len(CAST(bin(n) AS VARCHAR)) + 6) // 7)), lambda i:
        printf('%02X', ((n >> CAST(7 * i AS BIGINT)) & 127) + CASE WHEN (n >> CAST(7 * i + 7 AS BIGINT)) > 0 THEN 128 ELSE 0 END)), '') AS written
    FROM numbers""")
def varint_numbers(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", fn.varint(F.col("event_id") * F.col("event_id") * 7).alias("v"))
    return rows.select("event_id", fn.unvarint(F.col("v")).alias("n"), F.hex("v").alias("written"))


@query("""
    WITH pieces AS (SELECT event_id, sha256('42/' || event_id || '/0') AS piece FROM events)
    SELECT event_id, substr(repeat(substr(piece, 1, 50), 2), 1, 100) AS value FROM pieces""")
def bench_payload(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", fn.payload(F.concat(F.lit("42/"), F.col("event_id")), 100).alias("value"))


# -- views through their engine, and reduces of other kinds ---------------------------------------------------


@query("SELECT 'mean' AS reduce_key, CAST(sum(event_id % 10) AS BIGINT) AS \"Sum\", count(*) AS \"Count\", CAST(sum(event_id % 10) AS DOUBLE) / count(*) AS \"Mean\" FROM events")
def mr_mean_is_two_sums(spark, sf_dir):
    view = View("Mean", (Map({"Sum": "event_id % 10", "Count": "1L"}),), {"Sum": "sum(Sum)", "Count": "sum(Count)"}, "'mean'")
    found = mapreduce.fold_batches(view, event_log(spark, sf_dir), F.floor(F.col("event_id") / mapreduce.BATCH))
    return found.select("reduce_key", "Sum", "Count", (F.col("Sum") / F.col("Count")).alias("Mean"))


@query("""
    SELECT CAST(user_id AS VARCHAR) AS reduce_key, CASE WHEN count(*) >= 10 THEN count(*) END AS n,
           CASE WHEN count(*) < 10 THEN 'Invalid reduce result was generated' END AS error FROM events GROUP BY user_id""")
def mr_invalid_reduce(spark, sf_dir):
    def often_only(rows):
        import pyarrow as pa

        return pa.table({"n": pa.array([rows.num_rows] if rows.num_rows >= 10 else [], pa.int64())})

    return mapreduce.reduce_checked(table(spark, sf_dir, "events").select("user_id"), "user_id", often_only, "n bigint").select("reduce_key", "n", "error")


def _ordered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as they are appended: by id, which the data keeps."""
    data = F.to_json(F.struct("event_id", "user_id", F.when(F.col("event_id") % 7 == 0, "x").otherwise(F.col("event_id").cast("string")).alias("text")))
    return table(spark, sf_dir, "events").orderBy("event_id").select(F.col("event_type").alias("topic"), "ts", data.alias("data"))


def _stored_log(spark: SparkSession, sf_dir: str) -> EventLog:
    log = EventLog(spark, scratch(spark, "log"))
    log.append("all", _ordered_events(spark, sf_dir))
    return log


@query("SELECT event_id, event_type AS topic FROM events ORDER BY event_id LIMIT 1024 OFFSET 500")
def log_after_etag(spark, sf_dir):
    log = _stored_log(spark, sf_dir)
    return log.scan(after=fn.keys.etag_text(500, log.epoch), limit=mapreduce.BATCH).select(fn.field(F.col("data"), "event_id", "bigint").alias("event_id"), "topic")


@query("SELECT event_type AS topic, count(*) AS n, count(DISTINCT event_id) AS n_etags FROM events WHERE event_type = 'click' GROUP BY 1")
def log_topic(spark, sf_dir):
    rows = _stored_log(spark, sf_dir).events(topic="click")
    return rows.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("etag").alias("n_etags"))


@query("SELECT 2 * count(*) AS n, 2 * count(*) AS last_number, 2 AS appends FROM events")
def log_counts(spark, sf_dir):
    """From the commits alone."""
    log = _stored_log(spark, sf_dir)
    log.append("all", _ordered_events(spark, sf_dir))
    return spark.createDataFrame([(log.count(), fn.keys.etag_parts(log.last_etag())[1], len(log.folders()))], "n bigint, last_number bigint, appends int")


_OK = "try_cast(get_json_object(data, '$.text') AS BIGINT) IS NOT NULL"


@query("""
    SELECT event_type AS reduce_key, count(*) FILTER (WHERE event_id % 7 != 0) AS "Count", CAST(sum(event_id) FILTER (WHERE event_id % 7 != 0) AS BIGINT) AS "Sum",
           count(*) FILTER (WHERE event_id % 7 = 0) AS rejected FROM events GROUP BY 1""")
def engine_tolerant_view(spark, sf_dir):
    engine = Engine(spark, scratch(spark, "engine"), events=4096)
    engine.append("all", _ordered_events(spark, sf_dir))
    maps = (Map({"Topic": "topic", "Count": "1L", "Sum": "CAST(get_json_object(data, '$.text') AS BIGINT)"}, checks={"number": _OK}),)
    view = engine.create(View("Tolerant", maps, {"Topic": "Topic", "Count": "sum(Count)", "Sum": "sum(Sum)"}, "Topic"))
    view.catch_up()
    kept_out = view.rejects().groupBy(F.col("topic").alias("reduce_key")).agg(F.count(F.lit(1)).alias("rejected"))
    return view.results().join(kept_out, "reduce_key").select("reduce_key", "Count", "Sum", "rejected")


# -- the store through its files ------------------------------------------------------------------------------


def _store(spark: SparkSession) -> Store:
    return Store(spark, scratch(spark, "store"))


def _write(store: Store, sf_dir: str, part: int, parts: int) -> Store:
    """Write one of so many equal parts of the change log, by order of event ids, as a batch."""
    n = table(store.spark, sf_dir, "events").count()
    low, high = n * part // parts, n * (part + 1) // parts
    rows = change_log(store.spark, sf_dir).where((F.col("seq") > low) & (F.col("seq") <= high))
    store.write(rows.select("key", "op", (F.col("seq") - 1).cast("string").alias("value"), (F.col("seq") - 1 - low).alias("position")))
    return store


_TEXT_LOG = LOG.replace("value FROM", "CAST(event_id AS VARCHAR) AS value FROM")


@query(f"WITH {_TEXT_LOG} SELECT key, seq, value FROM ({NEWEST}) WHERE place = 1 AND op = 1")
def store_scan(spark, sf_dir):
    return _write(_store(spark), sf_dir, 0, 1).scan()


@query(f"WITH {_TEXT_LOG} SELECT key, seq, value FROM ({NEWEST}) WHERE place = 1 AND op = 1 AND key = 'u/17'")
def store_get(spark, sf_dir):
    store = _store(spark)
    for k in range(2):
        _write(store, sf_dir, k, 2)
    return store.find("U/17")


@query(f"WITH {_TEXT_LOG} SELECT key, seq, value FROM ({NEWEST} WHERE seq <= (SELECT count(*) // 2 FROM events)) WHERE place = 1 AND op = 1 AND key >= 'u/2' AND key < 'u/4'")
def store_compacted_snapshot(spark, sf_dir):
    """What a snapshot sees doesn't change when what it doesn't need is compacted away."""
    store = _write(_store(spark), sf_dir, 0, 2)
    half = store.snapshot("half")
    _write(store, sf_dir, 1, 2).compact()
    return store.scan("U/2", "U/4", half)


@query(f"""
    WITH {_TEXT_LOG}, cut AS (SELECT 2 * count(*) // 3 AS n FROM events),
    below AS (SELECT key, seq, op FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS place FROM log, cut WHERE seq <= n) WHERE place = 1 AND op = 1),
    placed AS (SELECT 1 AS level, key FROM below UNION ALL SELECT 0, key FROM log, cut WHERE seq > n)
    SELECT level, count(*) AS n, min(key) AS smallest, max(key) AS largest FROM placed GROUP BY 1""")
def store_levels(spark, sf_dir):
    store = _store(spark)
    for k in range(2):
        _write(store, sf_dir, k, 3)
    store.compact_level(0)
    return _write(store, sf_dir, 2, 3).statistics().select("level", "n", "smallest", "largest")
