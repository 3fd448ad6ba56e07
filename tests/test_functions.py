import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronofold import functions as fn
from chronofold.functions import histograms
from chronofold.functions.keys import etag_text


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize("a,b,same", [("a", "A", True), ("A", "a", True), ("8", "A", False), ("A", "B", False), ("ą", "ą", True), ("ą", "Ą", False)])
def test_fold(spark, a, b, same):
    assert (one(spark, (fn.fold(F.lit(a)) == fn.fold(F.lit(b))).alias("x")).x) is same


def test_reduce_key(spark):
    row = one(spark, fn.reduce_key(F.lit(None).cast("string")).alias("n"), fn.reduce_key(F.lit(1)).alias("i"), fn.reduce_key(F.lit("1")).alias("s"))
    assert (row.n, row.i, row.s) == ("@null", "1", "1")
    d = spark.range(1).select(F.struct(F.lit(1).alias("a")).alias("k"))
    assert d.select(fn.reduce_key(F.col("k"), d.schema["k"].dataType).alias("x")).first().x == '{"a":1}'


def test_etag(spark):
    assert one(spark, fn.etag(F.lit(45)).alias("x")).x == "03000000-0000-0001-0000-00000000002D" == etag_text(45)
    numbers = [0, 1, 255, 65536, 1 << 47, (1 << 62) + 5]
    d = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", fn.etag(F.col("n"), 7).alias("e"))
    rows = d.select("*", fn.etag_number(fn.event_key(F.col("e"))).alias("back")).collect()
    assert all(r.n == r.back and r.e == etag_text(r.n, 7) for r in rows)
    assert [r.e for r in sorted(rows, key=lambda r: r.n)] == sorted(r.e for r in rows)
    assert etag_text(9, 1) < etag_text(1, 2)


VECTORS = [
    (bytes(32), 0x8A9136AA),
    (b"\xff" * 32, 0x62A8AB43),
    (bytes(range(32)), 0x46DD794E),
    (bytes(range(31, -1, -1)), 0x113FDB5C),
    (bytes.fromhex("01c00000" + "00" * 12 + "14000000" + "00000400" + "00000014" + "00000018" + "28000000" + "00000000" + "02000000" + "00000000"), 0xD9963A56),
]


def test_crc32c(spark):
    assert fn.crc32c_bytes([v for v, _ in VECTORS]).tolist() == [c for _, c in VECTORS]
    d = spark.createDataFrame([(bytearray(v), c) for v, c in VECTORS] + [(None, None)], "v binary, c long")
    crc = fn.crc32c(F.col("v"))
    for r in d.select("c", crc.alias("crc"), fn.crc32c_unmask(fn.crc32c_mask(crc)).alias("back"), fn.crc32c_mask(crc).alias("masked")).collect():
        assert r.crc == r.c and r.back == r.c and (r.c is None or r.masked != r.c)
    hello = int(fn.crc32c_bytes([b"hello "])[0])
    assert fn.crc32c_extend(hello, b"world") == int(fn.crc32c_bytes([b"hello world"])[0])


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=40), max_size=12))
def test_crc32c_batches(values):
    def plain(v):
        c = 0xFFFFFFFF
        for b in v:
            c ^= b
            for _ in range(8):
                c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    assert fn.crc32c_bytes(values).tolist() == [plain(v) for v in values]


def test_bloom(spark):
    keys = spark.range(5000).select(F.concat(F.lit("test/"), F.col("id").cast("string")).alias("key"))
    f = fn.BloomFilter.build(keys, "key")
    assert keys.where(~f.may_match(F.col("key"))).count() == 0
    others = spark.range(5000).select(F.concat(F.lit("other/"), F.col("id").cast("string")).alias("key"))
    assert others.where(f.may_match(F.col("key"))).count() < 250
    with pytest.raises(ValueError):
        fn.BloomFilter.build(keys, "key", n_keys=1 << 40)
    assert fn.BloomFilter.build(keys.limit(0), "key").words == {}


@pytest.mark.parametrize("text,seconds", [("00:00:04", 4.0), ("01:02:03.5", 3723.5), ("2.00:00:01", 172801.0), ("-00:01:00", -60.0), ("x", None), ("1:2:3", None), (None, None)])
def test_duration(spark, text, seconds):
    assert one(spark, fn.duration_seconds(F.lit(text).cast("string")).alias("x")).x == seconds


def test_stamped(spark):
    docs = ['{"a":1}', "{}", '{"@metadata":{"x":"y"},"a":2}', "not json", None]
    d = spark.createDataFrame([(k, x) for k, x in enumerate(docs)], "k int, d string").select("k", fn.stamped(F.col("d"), "Sms").alias("s"))
    found = {r.k: r.s for r in d.collect()}
    topic = lambda s: F.get_json_object(F.lit(s), "$['@metadata']['Entity-Name']")
    assert json.loads(found[0])["a"] == 1 and json.loads(found[1])["@metadata"]["Entity-Name"] == "Sms"
    assert one(spark, topic(found[0]).alias("x")).x == one(spark, topic(found[2]).alias("x")).x == "Sms"
    assert found[3] is None and found[4] is None


def test_pack(spark):
    d = spark.createDataFrame([(0, 0), (1, 1), ((1 << 55) - 1, 1)], "s long, o int")
    p = fn.pack(F.col("s"), F.col("o"))
    seq, op = fn.unpack(p)
    assert all((r.s, r.o) == (r.seq, r.op) for r in d.select("s", "o", seq.alias("seq"), op.alias("op")).collect())


def test_histogram(spark):
    assert len(fn.BUCKETS) == 154 and fn.BUCKETS[:10] == [float(k) for k in range(1, 11)]
    d = spark.range(1, 1001).select(F.col("id").cast("double").alias("v"))
    whole = fn.histogram(d, "v")
    halves = histograms.merge(fn.histogram(d.where("v <= 400"), "v").unionByName(fn.histogram(d.where("v > 400"), "v")))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, halves.collect()))
    s = histograms.summary(whole).first()
    assert (s.n, s.lo, s.hi, s["mean"]) == (1000, 1.0, 1000.0, 500.5) and abs(s.deviation - 288.675) < 0.01
    assert abs(fn.percentile(whole, 50).first().value - 500) < 5 and fn.percentile(whole, 100).first().value == 1000.0
    assert fn.percentile(fn.histogram(d.limit(0), "v"), 50).first() is None


def test_varint(spark):
    numbers = [0, 1, 127, 128, 300, 16383, 16384, 2**31, 2**56 - 1, 2**63 - 1]

    def plain(n):
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    d = spark.createDataFrame([(n,) for n in [*numbers, -1, None]], "n bigint").withColumn("v", fn.varint(F.col("n")))
    found = d.select("n", "v", fn.unvarint(F.col("v")).alias("back")).collect()
    assert [(bytes(r.v), r.back) for r in found[: len(numbers)]] == [(plain(n), n) for n in numbers]
    assert [(r.v, r.back) for r in found[len(numbers) :]] == [(None, None)] * 2


def test_payload(spark):
    d = spark.range(50).select(fn.payload(F.col("id"), 1000, 0.2).alias("v"), fn.payload(F.col("id"), 7, 1.0).alias("short"), fn.payload(F.col("id"), 300, 1.0).alias("all"))
    found = d.collect()
    assert {len(r.v) for r in found} == {1000} and len({r.v for r in found}) == 50 and all(r.v == (r.v[:200] * 5) for r in found)
    assert {len(r.short) for r in found} == {7} and {len(r.all) for r in found} == {300} and d.collect() == found


def test_roll_up(spark):
    from chronofold.operators import roll_up

    rows = spark.createDataFrame([("read", 5, 100, 2.0), ("read", 7, 300, 4.0), ("write", 1, 10, 0.0)], "op string, ops long, bytes long, elapsed double")
    found = {r.op: (r.ops, r.bytes, r.elapsed, r.rate) for r in roll_up(rows, *map(F.col, rows.columns)).collect()}
    assert found == {"read": (12, 400, 4.0, 100.0), "write": (1, 10, 0.0, None)}
