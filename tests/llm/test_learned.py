"""Language identification by held-out accuracy; the queries and the pipeline as a whole."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from chronofold.llm import language_id

SF = "/root/testdata/sf0.001"


def letters(lang, rnd, n):
    sound = {"xx": "aeiou", "yy": "öäüß", "zz": "ñóé"}[lang]
    return " ".join("".join(rnd.choice("bcdfglmn") + rnd.choice(sound) for _ in range(rnd.randrange(1, 4))) for _ in range(n))


def test_language_id(spark):
    rnd = random.Random(2)
    rows = [(k, letters(lang, rnd, 30), lang, "s") for k, lang in enumerate(["xx", "yy", "zz"] * 60)]
    rows += [(1000, None, "xx", "s"), (1001, "123 !?", "yy", "s"), (1002, letters("yy", rnd, 20), None, "s"), (None, letters("zz", rnd, 20), "zz", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = language_id.train(docs, language_id.held_out_rows())
    assert model.langs == ["xx", "yy", "zz"] and (model.weights == 0).mean() > 0.9
    found = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert len(found) == len(rows) and "text" not in language_id.predict(docs, model).columns
    assert all(found[k].lang_pred == lang for k, _, lang, _ in rows[:180]) and found[1002].lang_pred == "yy" and found[None].lang_pred == "zz"
    assert found[1000].lang_pred == found[1001].lang_pred == "und" and found[1000].score == 0
    assert all(0 <= r.score <= 1 for r in found.values())
    none = language_id.train(docs.limit(0), language_id.held_out_rows())
    assert none is None and language_id.predict(docs, none).where("lang_pred != 'und'").count() == 0
    one = language_id.train(docs.where("lang = 'xx'"), F.lit(False))
    assert language_id.predict(docs, one).where("doc_id = 1").first().lang_pred == "xx"


def test_the_sample_goes_by_row_and_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_PER_LANG", 50)
    rnd = random.Random(5)
    langs = ["xx", "yy", "zz"]
    # one id for all of a language, null ids, one row very often
    rows = [(4, letters("xx", rnd, 20), "xx") for _ in range(400)] + [(None, letters("yy", rnd, 20), "yy") for _ in range(400)] + [(9, "ñóéb ñóéc ñóéd", "zz")] * 400
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    found = language_id.sample(docs, "doc_id", "text", "lang")
    assert {x: sum(r[0] == x for r in found) for x in langs} == {"xx": 50, "yy": 50, "zz": 50}
    again = language_id.sample(docs.repartition(3), "doc_id", "text", "lang")
    assert [(a[0], a[1], a[2].tolist()) for a in found] == [(a[0], a[1], a[2].tolist()) for a in again]
    model = language_id.train(docs, F.lit(False))
    assert language_id.predict(docs.limit(900), model, keep_text=True).where("lang != lang_pred").count() == 0
    monkeypatch.setattr(language_id, "SAMPLE_LANGS", 2)
    assert language_id.train(docs.where("lang != 'yy' OR text < 'd'"), F.lit(False)).langs == ["xx", "zz"]


def test_features_and_fit_against_plain_python():
    import math

    import numpy as np

    def plain_counts(text):
        c = [32] + [ord(ch.lower()) if ch.isalpha() else 32 for ch in text]
        m, out = (1 << 32) - 1, {}
        for k in range(len(c)):
            grams = [c[k] * 0x27D4EB2F]
            if k >= 1:
                pair = (c[k - 1] * 0x9E3779B1 + c[k] + 0x51ED27) & m
                grams.append(pair * 0x165667B1)
            if k >= 2:
                before = (c[k - 2] * 0x9E3779B1 + c[k - 1] + 0x51ED27) & m
                grams.append(((before * 0x85EBCA6B + c[k] + 0xC2B2AE) & m) * 0x27D4EB2F)
            for j, g in enumerate(grams):
                if k or j:  # the leading space alone is no letter of the text
                    g &= m
                    g ^= g >> 15
                    f = ((g * 0x2C1B3C6D) & m) >> 18
                    out[f] = out.get(f, 0) + 1
        return out

    rnd = random.Random(1)
    texts = [(x, letters(x, rnd, 6)) for x in ("xx", "yy") for _ in range(8)]
    for _, t in [*texts, ("", "A bÄ"), ("", "x")]:
        at, n = language_id.counts(t)
        assert dict(zip(at.tolist(), n.tolist(), strict=True)) == plain_counts(t)

    counted = [(lang, plain_counts(t)) for lang, t in texts]
    df = {}
    for _, c in counted:
        for f in c:
            df[f] = df.get(f, 0) + 1
    examples = [(lang, False, np.array(sorted(c)), np.array([c[f] for f in sorted(c)], float)) for lang, c in counted]
    table = np.zeros(language_id.DIMS)
    for f, n in df.items():
        table[f] = n
    model = language_id.fit(examples, table, len(texts))

    # FTRL-proximal with dictionaries
    idf = {f: math.log((1 + len(texts)) / (1 + n)) + 1 for f, n in df.items()}
    z, s = [{}, {}], [{}, {}]

    def weight(k, f):
        zz = z[k].get(f, 0.0)
        if abs(zz) <= language_id.L1:
            return 0.0
        return -(zz - math.copysign(language_id.L1, zz)) / ((language_id.BETA + math.sqrt(s[k].get(f, 0.0))) / language_id.ALPHA + language_id.L2)

    rng = np.random.default_rng(8)
    for _ in range(language_id.EPOCHS):
        for i in rng.permutation(len(counted)):
            lang, c = counted[i]
            v = {f: (1 + math.log(n)) * idf[f] for f, n in c.items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            v = {f: x / norm for f, x in v.items()} | {language_id.DIMS: 1.0}
            w = [{f: weight(k, f) for f in v} for k in range(2)]
            score = [sum(w[k][f] * x for f, x in v.items()) for k in range(2)]
            e = [math.exp(x - max(score)) for x in score]
            for k in range(2):
                g0 = e[k] / sum(e) - (k == ["xx", "yy"].index(lang))
                for f, x in v.items():
                    g, old = g0 * x, s[k].get(f, 0.0)
                    sigma = (math.sqrt(old + g * g) - math.sqrt(old)) / language_id.ALPHA
                    z[k][f] = z[k].get(f, 0.0) + g - sigma * w[k][f]
                    s[k][f] = old + g * g
    for k in range(2):
        assert all(abs(model.weights[k, f] - weight(k, f)) < 1e-9 for f in df) and abs(model.bias[k] - weight(k, language_id.DIMS)) < 1e-9
        assert not np.delete(model.weights[k], list(df)).any()


def test_a_long_text_is_counted_in_steps(monkeypatch):
    text = "Das ist ein Beispiel mit vielen Wörtern. " * 50
    whole = language_id.counts(text)
    monkeypatch.setattr(language_id, "STEP", 64)
    steps = language_id.counts(text)
    assert (whole[0] == steps[0]).all() and (whole[1] == steps[1]).all()


def test_held_out_accuracy_on_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = __spark_entry__.queries()["op8_language_id"](spark, "/root/testdata/sf0.01")
    held = found.where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert held.where("lang = lang_pred").count() >= 0.98 * held.count() > 0


@pytest.mark.parametrize("name", sorted(n for n in __spark_entry__.queries() if n.startswith("op")))
def test_queries_have_a_row_for_each_document(spark, name):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    found = __spark_entry__.queries()[name](spark, SF)
    assert found.count() == n and found.select("doc_id").distinct().count() == n


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(10**6, None, "en", "src0", 0), (10**6 + 1, "123", None, None, 3), (10**6 + 2, docs.first().text, "en", None, 1)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / f"{k}")
        stage(spark, docs, SF).write.parquet(out)
        docs = spark.read.parquet(out)
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= ids and (k == 4 or docs.columns == columns)
        if name == "language_id":
            assert ids - now == {10**6, 10**6 + 1}
        if name == "near_duplicates":
            assert 10**6 + 2 not in now and docs.count() == len(now)
        if name == "pii":
            assert now == ids and docs.where("text rlike '[a-z]@mail'").count() == 0 and docs.where("n_chars != length(text)").count() == 0
        ids = now
    assert docs.where("n_tokens != size(ids) OR decoded IS NULL").count() == 0


def test_near_duplicates_go_by_row(spark, make_prose):
    rnd = random.Random(4)
    a, b, c, d, e = (make_prose(rnd, 60, 5000) for _ in range(5))
    rows = [
        (1, a), (None, a + " more"),  # a null id, near a kept one
        (None, b), (None, b + " more"), (None, c),  # null ids: two near ones and another
        (2, a + " again"), (2, d),  # one id: a near copy of 1, and a text like no other
        (3, e), (3, e + " more"), (3, e),  # one id: two near texts, one of them twice
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted((r.doc_id or 0, r.text) for r in found) == sorted([(1, a), (0, b), (0, c), (2, d), (3, e)])


def test_mixing_counts_by_row(spark):
    rnd = random.Random(6)
    rows = [(k // 4 if k < 200 else None, f"{k} " + "w " * rnd.randrange(5, 30), "en", "abc"[k % 3], 0) for k in range(240)]
    rows += [(900, "w " * 9, x, "b", 0) for x in ("en", "fr", "de")]  # equal in id, text and source
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    taken = corpus_pipeline.mixing.mix(docs).documents.where("size > 0").selectExpr("doc_id", "key", "CAST(floor(taken / size + 0.5) AS INT) AS times").collect()
    found = corpus_pipeline.mix_sources(spark, docs, SF).withColumn("key", corpus_pipeline.mixing.row_key()).groupBy("doc_id", "key").count().collect()
    wanted = {}
    for r in taken:
        wanted[(r.doc_id, r.key)] = wanted.get((r.doc_id, r.key), 0) + r.times
    assert {(r.doc_id, r.key): r["count"] for r in found} == {k: n for k, n in wanted.items() if n}


def test_only_unknown_languages_go(spark, monkeypatch):
    rnd = random.Random(8)
    rows = [(k, letters(lang, rnd, 30), lang) for k, lang in enumerate(["xx", "yy", "zz"] * 20)] + [(1000, "q", "xx"), (1002, "12", "xx"), (1003, None, "yy")]
    docs = spark.createDataFrame([(i, t, x, "s", 0) for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    train = language_id.train
    # as with many languages: all have about the same probability, a third
    monkeypatch.setattr(language_id, "train", lambda *a: train(*a)._replace(temperature=1e6))
    found = {r.doc_id for r in corpus_pipeline.keep_known_languages(spark, docs, SF).collect()}
    assert found == {i for i, _, _ in rows} - {1002, 1003}


@pytest.mark.parametrize("k", range(5))
def test_stages_take_empty_tables(spark, k):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert corpus_pipeline.STAGES[k][1](spark, docs, SF).count() == 0


@pytest.mark.parametrize("k", range(5))
def test_stages_alone_on_odd_tables(spark, make_prose, k):
    # null and repeated ids, null and empty texts, repeated rows, a long text, and columns with the names that stages use
    rnd = random.Random(3)
    long = make_prose(rnd, 30_000, 3000)
    rows = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (None, "a b c d e f g", None, None, 13), (2, None, "en", "s", None), (2, "", None, "t", 0), (3, long, "en", "t", len(long)), (4, make_prose(rnd, 50), "fr", "s", 5)]
    odd = [(*r, 7, "x", 1.0, True, [1], "y", 2, "z") for r in rows]
    names = "doc_id long, text string, lang string, source string, n_chars long, id long, hash string, times double, kept boolean, each array<int>, of string, epoch int, key string"
    out = corpus_pipeline.STAGES[k][1](spark, spark.createDataFrame(odd, names), SF)
    found = out.collect()
    assert k == 4 or out.columns == list(corpus_pipeline.COLUMNS)
    ids = [r.doc_id for r in found]
    if k == 0:
        assert len(found) == 5 and 2 not in ids
    if k == 1:  # the first of the texts that are alike, empty texts each
        assert sorted(map(str, ids)) == ["1", "2", "2", "3", "4", "None"]
    if k in (2, 4):
        assert len(found) == 7
    if k == 3:
        assert set(ids) <= {1, 3, 4, None} and 3 in ids
    if k == 4:
        assert sum(r.decoded == long for r in found) == 1
