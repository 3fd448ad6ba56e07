import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronofold.operators import Map, View, fold_batches, fold_into, mapreduce, run
from chronofold.sources import EventLog, EventStream
from chronofold.streaming import Engine

COUNT = View("Test", (Map({"Count": "1"}),), {"Count": "CAST(sum(Count) AS DOUBLE)"}, "1")
_AT = "to_timestamp(get_json_object(data, '$.At'))"
_KEY = f"concat_ws('/', get_json_object(data, '$.From'), CAST(year({_AT}) AS STRING), CAST(month({_AT}) AS STRING))"
_SPAN = "split(get_json_object(data, '$.Duration'), ':')"
BILL = View(
    "Bill",
    (
        Map({"Calls": "0D", "Sms": "1", "Key": _KEY}, "Sms"),
        Map({"Calls": f"CAST({_SPAN}[0] * 3600 + {_SPAN}[1] * 60 + {_SPAN}[2] AS DOUBLE)", "Sms": "0", "Key": _KEY}, "Calls"),
    ),
    {"Calls": "sum(Calls)", "Sms": "CAST(sum(Sms) AS DOUBLE)", "Key": "Key"},
    "Key",
)
EXPECTED = {"1234/2013/6": (114, 12), "1234/2013/7": (961, 31), "1234/2013/8": (1620, 7)}
START = datetime(2013, 6, 19)


def sms():
    return [json.dumps({"From": "1234", "At": (START + timedelta(days=i)).isoformat()}) for i in range(50)]


def calls():
    return [json.dumps({"From": "1234", "At": (START + timedelta(days=i)).isoformat(), "Duration": str(timedelta(seconds=i + 4)).zfill(8)}) for i in range(70)]


def events(spark, rows):
    return spark.createDataFrame([(f"{k:05d}", t, None, d) for k, (t, d) in enumerate(rows)], "etag string, topic string, ts timestamp, data string")


def test_monthly_bill(spark):
    e = events(spark, [("Sms", d) for d in sms()] + [("Calls", d) for d in calls()])
    whole = {r.reduce_key: (r.Calls, r.Sms) for r in run(BILL, e).collect()}
    assert whole == EXPECTED
    parts = fold_batches(BILL, e, F.col("etag").cast("int") % 7)
    assert {r.reduce_key: (r.Calls, r.Sms) for r in parts.collect()} == whole
    state = None
    for k in range(3):
        state = fold_into(BILL, state, run(BILL, e.where(F.col("etag").cast("int") % 3 == k)))
    assert {r.reduce_key: (r.Calls, r.Sms) for r in state.collect()} == whole


def test_no_events_no_result(spark):
    assert run(COUNT, events(spark, [])).collect() == []
    assert [tuple(r) for r in run(COUNT, events(spark, [("x", "{}")] * 3)).collect()] == [("1", 3.0)]


def test_definitions_are_checked():
    with pytest.raises(ValueError):
        View("Open", (Map({"a": "1"}),), {"b": "sum(a)"}, "a")
    with pytest.raises(ValueError):
        View("Apart", (Map({"a": "1"}), Map({"b": "1"})), {"a": "sum(a)"}, "a")
    with pytest.raises(ValueError):
        View("None", (), {"a": "sum(a)"}, "a")
    assert View.from_json(BILL.to_json()) == BILL and "UNION ALL" in BILL.describe() and BILL.version() != COUNT.version()


def test_reduces_that_give_something_else_when_applied_again_are_refused():
    one = (Map({"n": "1", "v": "1D", "at": "etag"}),)
    for bad in ("avg(n)", "count(n)", "count(*)", "count(DISTINCT n)", "stddev(n)", "sum(DISTINCT n)", "sum(v)", "sum(n) / 2", "sum(n) + 1", "max_by(n, v)", "approx_count_distinct(n)", "percentile(n, 0.5)"):
        with pytest.raises(ValueError, match="own results"):
            View("Bad", one, {"n": bad, "v": "v", "at": "at"}, "at")
    View("Good", one, {"n": "CAST(sum(n) AS BIGINT)", "v": "max_by(v, at)", "at": "max(at)"}, "1")


def test_a_mean_is_two_sums(spark):
    e = events(spark, [("t", json.dumps({"v": v})) for v in (1, 1, 1, 9)])
    mean = View("Mean", (Map({"Sum": "CAST(get_json_object(data, '$.v') AS BIGINT)", "Count": "1L"}),), {"Sum": "sum(Sum)", "Count": "sum(Count)"}, "1")
    for found in (run(mean, e), fold_batches(mean, e, F.col("etag") > "00002")):
        assert [(r.Sum / r.Count) for r in found.collect()] == [3.0]


def test_a_reduce_without_a_row_says_so(spark):
    import pyarrow as pa

    def large_only(table):
        n = pa.compute.sum(table["n"]).as_py()
        return pa.table({"n": pa.array([n] if n > 2 else [], pa.int64())})

    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 5)], "k string, n long")
    found = {r.reduce_key: (r.n, r.error) for r in mapreduce.reduce_checked(rows, "k", large_only, "n bigint").collect()}
    assert found == {"a": (3, None), "b": (None, "Invalid reduce result was generated"), "@null": (5, None)}


def test_maps_may_give_many_rows_and_opaque_functions(spark):
    import pyarrow as pa

    e = events(spark, [("doc", '{"text":"a b a"}'), ("doc", '{"text":"b"}'), ("doc", "{}")])
    v = View("Words", (Map({"Word": "explode(split(get_json_object(data, '$.text'), ' '))", "Count": "1L"}, "doc"),), {"Word": "Word", "Count": "sum(Count)"}, "Word")
    assert {r.reduce_key: r.Count for r in run(v, e).collect()} == {"a": 2, "b": 2}

    def words(batch):
        found = [w for d in batch.column("data").to_pylist() for w in json.loads(d).get("text", "").split()]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["Word"])

    def longest(table):
        return pa.table({"Word": [table["Word"][0].as_py()], "Count": [table.num_rows]})

    mapped = mapreduce.map_with(e, words, "Word string")
    reduced = mapreduce.reduce_with(mapped, "Word", longest, "Word string, Count bigint")
    assert {r.Word: r.Count for r in reduced.collect()} == {"a": 2, "b": 2}


def test_results_of_keys_that_differ_in_case(spark):
    v = View("Case", (Map({"Key": "topic", "Count": "1L"}),), {"Key": "Key", "Count": "sum(Count)"}, "Key")
    found = run(v, events(spark, [("Foo", "{}"), ("foo", "{}"), ("foo", "{}"), ("bar", "{}")]))
    assert {r.stored_key: len(r.results) for r in mapreduce.stored_together(found).collect()} == {"foo": 2, "bar": 1}
    assert sorted(r.Count for r in mapreduce.result(found, "FOO").collect()) == [1, 2]
    assert [r.result_key for r in mapreduce.results(v, found).collect()][0] == "results/Case/bar"


def test_tolerant_maps(spark):
    d = spark.range(200).select("id", F.when((F.col("id") >= 20) & (F.col("id") < 90), "x").otherwise("1").alias("t"))
    ok = F.col("t").try_cast("int").isNotNull()
    good, bad = mapreduce.tolerant(d, {"t": ok})
    assert (good.count(), bad.count()) == (130, 70) and bad.first().rejected_by == ["t"]
    assert [tuple(r) for r in mapreduce.over_budget(d, ok, "id").collect()] == [(20, 89, 70)]


def test_event_log(spark, tmp_path):
    log = EventLog(spark, str(tmp_path / "log"))
    assert log.last_etag() is None and log.append("test", None) is None and log.append("test", []) is None
    last = log.append("test", [json.dumps({"Item": i}) for i in range(15)])
    assert last == log.last_etag() and log.count() == 15
    rows = log.scan().collect()
    assert [json.loads(r.data)["Item"] for r in rows] == list(range(15)) and all(r.etag for r in rows) and rows[-1].etag == last
    assert json.loads(rows[0].data)["@metadata"]["Entity-Name"] == "test"
    more = log.append("other", spark.range(40).select(F.to_json(F.struct("id")).alias("data")))
    assert log.scan(after=last).count() == 40 and log.events(topic="other").count() == 40 and log.scan(limit=3).count() == 3
    etags = [r.etag for r in log.scan().collect()]
    assert etags == sorted(set(etags)) and log.wait_for_append(last, 1) and not log.wait_for_append(more, 0.1)
    again = EventLog(spark, str(tmp_path / "log"))
    assert again.last_etag() == more and again.epoch == log.epoch + 1 and again.append("test", ["{}"]) > more
    with pytest.raises(FileExistsError):
        EventLog(spark, str(tmp_path / "log"), error_if_exists=True)
    with pytest.raises(FileNotFoundError):
        EventLog(spark, str(tmp_path / "none"), create_if_missing=False)


def test_folders_are_found_across_lists(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("chronofold.sources.event_log.LISTED", 3)
    log = EventLog(spark, str(tmp_path / "log"))
    etags = [log.append("t", ["{}"]) for _ in range(8)]
    assert [f["last"] for f in log.folders()] == etags and log.events().count() == 8
    assert [log.events(after=e).count() for e in etags] == [7, 6, 5, 4, 3, 2, 1, 0]
    assert [f["last"] for f in EventLog(spark, str(tmp_path / "log")).folders()] == etags


def test_appends_side_by_side(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    log = EventLog(spark, str(tmp_path / "log"))
    with ThreadPoolExecutor(4) as pool:
        etags = list(pool.map(lambda i: log.append("test", [json.dumps({"Item": i})]), range(8)))
    assert len(set(etags)) == 8 and log.count() == 8 and log.scan().count() == 8


def test_event_stream(spark, tmp_path):
    s = EventStream(spark, str(tmp_path / "s"))
    for k in range(3):
        s.append({"counter": 5 * k + i} for i in range(5))
    rows = s.read_from().collect()
    assert s.count() == 15 and [json.loads(r.data)["counter"] for r in rows] == list(range(15)) and rows[0].date
    assert s.read_from(rows[10].etag).count() == 5 and len(s.ranges()) == 3
    assert EventStream(spark, str(tmp_path / "s")).count() == 15


def test_engine_counts_each_round_and_goes_on_after_a_restart(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "db"))
    view = engine.create(COUNT)
    for j in range(3):
        last = engine.append("test", [json.dumps({"Item": i}) for i in range(15)])
        view.catch_up()
        view.wait_for(last, 5)
        assert engine.get("TEST").result("1") == {"Count": 15.0 * (j + 1)} and view.metrics()[-1]["commits"] >= 0
    again = Engine(spark, str(tmp_path / "db"))
    assert again.get("test").result(1) == {"Count": 45.0} and again.get("Test").progress() == last
    again.get("test").catch_up()
    assert again.get("test").result("1") == {"Count": 45.0}
    with pytest.raises(TimeoutError):
        again.get("test").wait_for(again.append("test", ["{}"]), 0.2)
    other = View("test", COUNT.maps, {"Count": "CAST(max(Count) AS DOUBLE)"}, "1")
    assert again.create(other).result("1") is None
    again.get("Test").catch_up()
    assert again.get("Test").result("1") == {"Count": 1.0} and "max(Count)" in again.get("test").describe()
    assert again.remove("TEST") and again.get("test") is None and not again.remove("test")
    assert Engine(spark, str(tmp_path / "db")).get("test") is None


def test_engine_folds_what_a_batch_view_gives(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "db"))
    engine.append("Sms", sms()[:20])
    view = engine.create(BILL)
    view.catch_up()
    engine.append("Calls", calls())
    query = view.start("200 milliseconds")
    view.wait_for(engine.append("Sms", sms()[20:]), 60)
    view.stop()
    assert not query.isActive
    found = {r.reduce_key: (r.Calls, r.Sms) for r in view.results().collect()}
    assert found == EXPECTED == {r.reduce_key: (r.Calls, r.Sms) for r in run(BILL, engine.log.events()).collect()}


NUMBERS = View(
    "Numbers",
    (Map({"Sum": "CAST(get_json_object(data, '$.n') AS BIGINT)"}, checks={"number": "try_cast(get_json_object(data, '$.n') AS BIGINT) IS NOT NULL"}),),
    {"Sum": "sum(Sum)"},
    "1",
)


@pytest.mark.parametrize(("bad", "at_once", "total", "rejected"), [(range(5, 9), 1000, 200 - 4, 4), (range(10, 100), 1000, 10, 50), (range(10, 100), 100, 10 + 60 + 40, 50 + 20)])
def test_bad_events_go_to_the_rejects(spark, tmp_path, bad, at_once, total, rejected):
    engine = Engine(spark, str(tmp_path / "db"), events=at_once)
    view = engine.create(NUMBERS)
    for k in range(0, 200, 40):
        last = engine.append("t", [json.dumps({"n": "x" if i in bad else 1}) for i in range(k, k + 40)])
    view.catch_up()
    view.wait_for(last, 5)
    # 90 in a row: those after the 50th that are in its batch aren't mapped
    assert view.result("1") == {"Sum": total}
    found = view.rejects().collect()
    assert len(found) == rejected and {tuple(r.rejected_by) for r in found} == {("number",)} and len({r.etag for r in found}) == rejected
    if len(bad) == 4:
        assert run(NUMBERS, engine.log.events()).first().Sum == total


def test_many_batches_are_one_fold(spark, tmp_path):
    """6 appends in batches of 10: one commit, with what the batches give one after the other, each map stopping in a batch after 3 failing events of its own."""
    n = "get_json_object(data, '$.n')"
    maps = tuple(Map({"Key": f"'{t or 'all'}'", "Sum": f"CAST({n} AS BIGINT)"}, t, checks={"number": f"try_cast({n} AS BIGINT) IS NOT NULL"}) for t in (None, "a"))
    engine = Engine(spark, str(tmp_path / "db"), events=10, errors=3)
    view = engine.create(View("Parts", maps, {"Key": "Key", "Sum": "sum(Sum)"}, "Key"))
    texts = ["x" if i % 37 in (3, 4, 5, 11, 12, 13, 14, 20, 22, 24, 29, 30, 31, 32) else "1" for i in range(100)]
    topics = ["ab"[i % 2] for i in range(100)]
    for lo, hi in [(0, 3), (3, 7), (7, 9), (9, 48), (48, 49), (49, 100)]:
        rows = spark.createDataFrame([(k, topics[k], json.dumps({"n": texts[k]})) for k in range(lo, hi)], "k long, topic string, data string")
        last = engine.append("", rows.repartition(1).sortWithinPartitions("k").select("topic", "data"))
    ends = [number_of(c) for c in engine.log.cuts(None, last, 10)]
    total, out = {"all": 0, "a": 0}, []
    for low, high in zip([0, *ends], ends):
        for m, key in enumerate(total):
            row = 0
            for k in range(low, high):
                if row < 3 and (m == 0 or topics[k] == "a"):
                    row = row + 1 if texts[k] == "x" else 0
                    total[key] += texts[k] == "1"
                    out += [(m, k + 1)] * (texts[k] == "x")
    view.catch_up()
    assert view.state.commits.last()[0] == 1 and view.progress() == last
    assert {r.reduce_key: r.Sum for r in view.results().collect()} == total
    assert sorted((r.map, number_of(r.etag)) for r in view.rejects().collect()) == sorted(out)
    assert any(total[k] < sum(t == "1" and (k == "all" or p == "a") for t, p in zip(texts, topics)) for k in total)
    labelled = engine.log.batches(None, engine.log.cuts(None, last, 10), 10).collect()
    assert {number_of(r.etag): r.batch for r in labelled} == {k: sum(e < k for e in ends) for k in range(1, 101)}


def number_of(text):
    return int(text.replace("-", "")[16:], 16)


def test_a_view_ends_with_the_batch_before_the_one_that_fails(spark, tmp_path):
    checked = Map({"Sum": "CAST(get_json_object(data, '$.n') AS BIGINT)"}, checks={"there": "get_json_object(data, '$.n') != 'x'"})
    engine = Engine(spark, str(tmp_path / "db"), events=5)
    view = engine.create(View("Ends", (checked,), {"Sum": "sum(Sum)"}, "1"))
    engine.append("t", [json.dumps({"n": {3: "x", 12: "y", 13: "x", 18: "x"}.get(i, 1)}) for i in range(30)])
    with pytest.raises(Exception):
        view.catch_up()
    assert number_of(view.progress()) == 10 and view.state.results().first().Sum == 9
    assert [number_of(r.etag) for r in view.rejects().collect()] == [4]


def test_batches_are_cut_by_events(spark, tmp_path):
    log = EventLog(spark, str(tmp_path / "log"))
    etags = [log.append("t", ["{}"] * n) for n in (3, 4, 25, 1)]
    every = [r.etag for r in log.scan().collect()]
    for after, upto in [(None, every[-1]), (every[1], every[-1]), (every[9], every[20]), (every[-2], every[-1])]:
        cuts, before = log.cuts(after, upto, 10), after
        assert cuts[-1] == upto and cuts == sorted(set(cuts))
        for c in cuts:
            assert 0 < log.events(after=before, upto=c).count() <= 10
            before = c
    assert log.cuts(None, etags[1], 100) == [etags[1]]


def test_a_failing_view_says_so(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "db"))
    bad = engine.create(View("Bad", (Map({"Count": "CAST(get_json_object(data, '$.x') AS INT)"}),), {"Count": "sum(Count)"}, "1"))
    last = engine.append("test", ['{"x":"no number"}'])
    with pytest.raises(Exception):
        bad.catch_up()
    with pytest.raises(Exception):
        bad.result("1")
    with pytest.raises(Exception):
        bad.wait_for(last, 5)
