import pytest

from chronofold.sources import CommitLog, Corrupted, Store, WriteBatch
from chronofold.sources.commits import Conflict


def test_snapshots_and_compaction(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.put("key1", "test1")
    before = s.snapshot()
    s.put("key1", "test2")
    for _ in range(2):
        assert s.read("KEY1") == "test2" and s.read("key1", before) == "test1"
        s.compact()
    s.release(before)
    s.compact()
    assert s.read("key1") == "test2" and s.versions().count() == 1
    assert s.statistics().first().asDict()["level"] == 1 and s.vacuum() and s.read("key1") == "test2"


def test_deletes_and_batches(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    batch = WriteBatch().put("a", "1").put("b", "2").delete("a").delete("none").put("b", "3")
    assert (batch.operations, batch.size) == (5, 11)
    assert s.write(batch) == 5
    assert s.read("a") is None and s.read("b") == "3" and s.read("none") is None and s.read("bb") is None
    assert s.write(WriteBatch()) == 5
    s.delete("b")
    assert s.scan().count() == 0
    s.compact()
    assert s.versions().count() == 0 and s.scan().count() == 0 and s.put("c", "4") == 7


def test_many_folders_newest_wins(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    for i in range(5):
        b = WriteBatch()
        for k in range(4):
            b.put(f"A{k}", f"{i},{k}")
        s.write(b)
    assert s.needs_compaction()
    s.compact("A1", "A2")
    assert s.read("a2") == "4,2" and [r.key for r in s.scan().collect()] == ["A0", "A1", "A2", "A3"]
    assert [r.key for r in s.prefix("A").collect()] == ["A0", "A1", "A2", "A3"] and s.seek_previous("A2").first().key == "A1" and s.seek("A11").first().key == "A2"
    assert Store(spark, str(tmp_path / "s")).read("A3") == "4,3" and not s.needs_compaction()


def pushed(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_reads_reach_the_scan(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    rows = lambda a, b: spark.range(a, b).selectExpr("printf('K%04d', id) AS key", "1 AS op", "string(id) AS value", f"id - {a} AS position")
    s.write(rows(0, 100))
    s.write(rows(100, 200))
    s.write(rows(150, 160))
    assert "EqualTo(at,k0042)" in pushed(s.find("k0042")) and "GreaterThanOrEqual(at,k0150)" in pushed(s.seek("K0150"))
    assert "StringStartsWith(at,k01)" in pushed(s.prefix("K01")) and "LessThan(at,k0007)" in pushed(s.scan(end="K0007"))
    # only folders that may hold the keys
    assert len(s.find("K0042")._jdf.inputFiles()) and all("data-0000000002" in f for f in s.find("K0042").inputFiles())
    assert s.versions("k0155", "k0155").count() == 110 and s.versions("k0300").count() == 0
    assert s.read("k0155") == "155" and s.find("K0155").first().seq == 206 and s.read("K0300") is None and s.seek("k0300").collect() == []
    assert s.prefix("K01").count() == 100 and s.scan("K0098", "K0102").count() == 4 and s.seek_previous("K0100").first().key == "K0099"
    keys = spark.createDataFrame([("k0001",), ("K0155",), ("none",)], "key string")
    assert {(r.key, r.value) for r in s.read_all(keys).collect()} == {("K0001", "1"), ("K0155", "155")}
    assert Store(spark, s.path, verify=True).read("K0001") == "1"


def test_files_have_bloom_filters(spark, tmp_path):
    import pyarrow.parquet as pq

    s = Store(spark, str(tmp_path / "s"))
    s.write(spark.range(5000).selectExpr("string(id * 2) AS key", "1 AS op", "'v' AS value", "id AS position"))
    files = [f.removeprefix("file:") for f in s.versions().inputFiles()]
    raw = [open(f, "rb").read() for f in files]
    # the filter lies between the data and the footer: the footer alone names it, its bits are some 1.2 bytes a key
    assert sum(map(len, raw)) > sum(m.row_group(g).column(c).total_compressed_size for f in files for m in [pq.read_metadata(f)] for g in range(m.num_row_groups) for c in range(5)) + 5000


def test_positions_are_checked(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    for bad in ([0, 0], [1, 2], [0, 2]):
        with pytest.raises(ValueError):
            s.write(spark.createDataFrame([("a", 1, "x", p) for p in bad], "key string, op int, value string, position long"))
    assert s.versions().count() == 0 and not s.commits.folders(s.path, "data-") and s.put("a", "1") == 1


def test_batches_side_by_side(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    s = Store(spark, str(tmp_path / "s"))
    with ThreadPoolExecutor(6) as pool:
        seqs = list(pool.map(lambda i: s.write(WriteBatch().put("k", str(i)).put(f"own{i}", "x")), range(12)))
    assert sorted(seqs) == list(range(2, 26, 2)) and s.scan().count() == 13
    assert s.read("k") == str(seqs.index(24)) and len(s.commits.numbers()) <= 13


def test_a_lost_writer_leaves_nothing(spark, tmp_path):
    s, other = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    commit, raced = s.commits.commit, []

    def outrun(number, content):
        if not raced:
            raced.append(other.put("b", "2"))
        return commit(number, content)

    s.commits.commit = outrun
    assert s.put("a", "1") == 2 and {r.key for r in s.scan().collect()} == {"a", "b"}
    assert len(s.commits.folders(s.path, "data-")) == 2
    spark.range(1).write.parquet(f"{s.path}/data-lost")
    assert s.vacuum() == [] and s.vacuum(orphan_seconds=-5) == ["data-lost"] and s.scan().count() == 2


def test_levels(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), auto_compact=True, level_bytes=4000)
    held = {}
    for i in range(14):
        batch = WriteBatch()
        for k in range(i % 3, 40, 3):
            batch.put(f"k{k}", f"{i}")
            held[f"k{k}"] = f"{i}"
        batch.delete(f"k{i}")
        held.pop(f"k{i}", None)
        s.write(batch)
        assert not s.needs_compaction()
    assert {r.key: r.value for r in s.scan().collect()} == held
    done = {r.level: r for r in s.compaction_statistics().collect()}
    assert done[1].runs >= 3 and max(done) >= 2 and all(r.bytes_read and r.bytes_written for r in done.values())
    assert all(0 < r.score < 1 for r in s.statistics().collect())
    # a delete hides what lies deeper, also after its own level is compacted
    s.delete("k39")
    s.compact_level(0)
    assert s.read("k39") is None
    s.compact()
    assert s.versions().count() == len(held) - ("k39" in held) and s.statistics().count() == 1


def test_a_range_leaves_other_folders(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    for k in "abc":
        s.write(WriteBatch().put(f"{k}1", "old").put(f"{k}1", "new"))
    before = {f["name"] for f in s._state()[1]["folders"]}
    s.compact("B", "b9")
    after = {f["name"] for f in s._state()[1]["folders"]}
    assert len(before & after) == 2 and s.versions().count() == 5 and s.read("b1") == "new"


def test_writers_are_held_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("chronofold.sources.store.LEVEL0", 100)
    monkeypatch.setattr("chronofold.sources.store.STOP", 3)
    s = Store(spark, str(tmp_path / "s"), auto_compact=True)
    for i in range(5):
        s.put("a", str(i))
        assert sum(f["level"] == 0 for f in s._state()[1]["folders"]) <= 3
    assert s.read("a") == "4" and s.compaction_statistics().first().runs == 1


def test_opening(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        Store(spark, str(tmp_path / "s"), create_if_missing=False)
    Store(spark, str(tmp_path / "s"))
    with pytest.raises(FileExistsError):
        Store(spark, str(tmp_path / "s"), error_if_exists=True)
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path / "s"), folded=False)


def test_lost_folders_are_an_error(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.put("a", "1")
    s.commits.delete(f"{s.path}/{s._state()[1]['folders'][0]['name']}")
    with pytest.raises(Corrupted):
        s.read("a")


def test_commit_log(spark, tmp_path):
    c = CommitLog(spark, str(tmp_path / "c"))
    assert c.last() is None and not c.exists()
    c.commit(1, {"a": 1})
    with pytest.raises(Conflict):
        c.commit(1, {"a": 2})
    c.commit(2, {"a": "ä"})
    assert c.last() == (2, {"a": "ä"}) and c.numbers() == [1, 2]
    c.drop_before(2)
    assert c.numbers() == [2]
