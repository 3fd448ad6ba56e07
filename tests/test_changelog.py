import random

import pytest
from pyspark.sql import functions as F

from chronofold.operators import changelog, compact

LOG = "key string, seq long, op tinyint, value string"


def log(spark, rows):
    return spark.createDataFrame(rows, LOG)


def test_visibility(spark):
    d = log(spark, [("k", 1, 1, "a")])
    assert changelog.get(d, "k", 1).first().value == changelog.get(d, "k", 2).first().value == "a"
    assert changelog.get(log(spark, [("k", 2, 1, "a")]), "k", 1).first() is None
    assert changelog.get(log(spark, [("k", 2, 1, "a"), ("k", 3, 0, None)]), "k", 5).first() is None
    assert changelog.current(log(spark, [])).collect() == []


def test_null_values_are_not_deletes(spark):
    assert changelog.get(log(spark, [("k", 1, 1, "a"), ("k", 2, 1, None)]), "K").first().seq == 2


def test_seek(spark):
    d = log(spark, [("A", 1, 1, "1"), ("B", 2, 1, "2"), ("D", 3, 1, "3")])
    assert changelog.seek_previous(d, "C").first().key == "B"
    assert changelog.seek(d, "c").first().key == "D"
    assert changelog.seek(d, "E").first() is None
    assert [r.key for r in changelog.last(d, 2).collect()] == ["D", "B"]


def test_prefix_goes_by_bytes_and_begins_by_fold(spark):
    d = log(spark, [("ab", 1, 1, "1"), ("AB", 2, 1, "2"), ("ac", 3, 1, "3"), ("Ad", 4, 1, "4")])
    assert [r.key for r in changelog.prefix(d, "a").collect()] == ["ac"]  # ab now is spelled AB
    assert [r.key for r in changelog.prefix(d, "a", folded=False).collect()] == ["ab", "ac"]


def test_seek_each(spark):
    rnd = random.Random(4)
    keys = sorted({f"{rnd.randrange(10000):05d}" for _ in range(400)})
    probes = [f"{rnd.randrange(10050):05d}" for _ in range(300)]
    d = log(spark, [(k, i + 1, 1, "v") for i, k in enumerate(keys)])
    found = changelog.seek_each(d, spark.createDataFrame([(p,) for p in probes], "probe string")).collect()
    assert sorted((r.probe, r.key) for r in found if r.key) == sorted((p, k) for p in probes if (k := next((k for k in keys if k >= p), None)))
    assert len(found) == len(probes)


def test_merge_runs(spark):
    rnd = random.Random(1)
    runs = [spark.createDataFrame([(f"{k:016d}",) for k in sorted(rnd.sample(range(10**6), 100))], "key string") for _ in range(10)]
    keys = [r.key for r in changelog.merge_runs(runs, "key").collect()]
    assert len(keys) == 1000 and keys == sorted(keys)


@pytest.mark.parametrize("seed", range(3))
def test_compaction_leaves_reads_alone(spark, seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice("abcdEFGH"), s, rnd.choice([0, 1, 1]), str(s)) for s in range(1, 120)]
    d, least = log(spark, rows), rnd.randrange(20, 100)
    small = compact(d, least)
    for as_of in (least, least + 7, 200):
        assert sorted(changelog.current(d, as_of).collect()) == sorted(changelog.current(small, as_of).collect())
    part = compact(d, least, "b", "f")
    assert sorted(changelog.current(d).collect()) == sorted(changelog.current(part).collect())
    assert sorted(part.where(F.lower("key") > "f").collect()) == sorted(d.where(F.lower("key") > "f").collect())
    assert small.count() < d.count()


def test_compaction_to_the_latest(spark):
    d = log(spark, [("foo", 1, 1, "v1"), ("foo", 2, 1, "v2"), ("bar", 3, 1, "x"), ("bar", 4, 0, None)])
    assert [tuple(r) for r in compact(d).collect()] == [("foo", 2, 1, "v2")]


def test_batches(spark):
    rows = spark.createDataFrame([("a", 1, "1", 0), ("b", 1, "2", 1), ("a", 1, "3", 2), ("b", 0, None, 3)], "key string, op int, value string, position long")
    d = changelog.as_batch(rows, 10)
    assert [tuple(r) for r in changelog.current(d).collect()] == [("a", 13, "3")]
    assert changelog.size_of(rows).first().asDict() == {"operations": 4, "bytes": 7}
