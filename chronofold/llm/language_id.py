"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

A text's letters (lower case, all else a space) give 1- to 3-grams, hashed to DIMS
features. Document frequencies are counted over all eligible rows. The classifier
is fitted on a bounded sample of them, SAMPLE_PER_LANG rows of each of the
SAMPLE_LANGS most frequent languages, the same ones in every run, by FTRL-proximal
with elastic-net penalties, which leaves most weights at zero. A fifth of the
sample stays out of the fit and sets the temperature that divides the scores
before the softmax.

Eligible rows have a text, a language and, where the caller asks for it, a place
outside the held-out rows. Language, source and id are never inputs of a
prediction.

Edge cases: a null text, or one without a letter, is `und` with score 0; so is
every row if no row is eligible. With one language all others get that one. The
sample is drawn by a hash of id and text, so null and repeated ids count as any
other; of rows that are equal in both as many are drawn as there is room for. Of
equally frequent languages the ones that come first by name are learned, of
equally likely ones the first is predicted.
"""

from __future__ import annotations

from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, shuffle_partitions

UNKNOWN = "und"
DIMS = 1 << 14
#: Rows of each language that the classifier is fitted on, at most (the bound of the sample).
SAMPLE_PER_LANG = 400
#: Languages that are learned, at most: with SAMPLE_PER_LANG the bound of what the driver takes up, and of the model (8 DIMS bytes a language).
SAMPLE_LANGS = 256
EPOCHS = 4
#: FTRL-proximal: learning rate and its smoothing, and the penalties on sum and squares of the weights.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.01
#: Characters taken up at once, which bounds the memory that a very long text needs.
STEP = 1 << 20

OUTPUT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


class Model(NamedTuple):
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # language x feature
    bias: np.ndarray
    temperature: float


@cache
def letters() -> np.ndarray:
    """By code point of the first plane: the lower-case letter, or a space."""
    out = np.full(1 << 16, 32, np.uint32)
    for k in range(1 << 16):
        if chr(k).isalpha():
            low = chr(k).lower()
            out[k] = ord(low) if len(low) == 1 else k
    return out


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The features that a text has, and how often."""
    total = np.zeros(DIMS, np.int64)
    table = letters()
    for k in range(0, len(text), STEP):
        raw = np.frombuffer((" " if k == 0 else text[max(0, k - 2) : k]).encode("utf-32-le") + text[k : k + STEP].encode("utf-32-le", "replace"), np.uint32)
        c = np.where(raw < 1 << 16, table[np.minimum(raw, 0xFFFF)], raw)
        fresh = 1 if k == 0 else 2
        pair = c[:-1] * np.uint32(0x9E3779B1) + c[1:] + np.uint32(0x51ED27)
        triple = pair[:-1] * np.uint32(0x85EBCA6B) + c[2:] + np.uint32(0xC2B2AE)
        grams = np.concatenate([c[fresh:] * np.uint32(0x27D4EB2F), pair[max(0, fresh - 1) :] * np.uint32(0x165667B1), triple[max(0, fresh - 2) :] * np.uint32(0x27D4EB2F)])
        grams ^= grams >> np.uint32(15)
        total += np.bincount(((grams * np.uint32(0x2C1B3C6D)) >> np.uint32(18)), minlength=DIMS)
    at = np.flatnonzero(total)
    return at, total[at]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def vector(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1 + np.log(n)) * idf[at]
    return v / max(np.sqrt((v * v).sum()), 1e-12)


def eligible_rows(docs: DataFrame, held_out: Column, text_col: str, lang_col: str) -> DataFrame:
    return docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out)


def document_frequencies(rows: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """In how many of all rows a feature is, and the number of rows; a task sends one count a feature."""

    def run(batches):
        total, rows = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total[counts(text)[0]] += 1
                rows += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1], pa.int32()), pa.array([*total[at].tolist(), rows], pa.int64())], names=["feature", "n"])

    found = rows.select(text_col).mapInArrow(run, "feature int, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(DIMS)
    for r in found:
        if r.feature >= 0:
            df[r.feature] = r.n
    return df, sum(r.n for r in found if r.feature < 0)


def sample(rows: DataFrame, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, bool, np.ndarray, np.ndarray]]:
    """(language, kept out of the fit, features, counts) of the rows of each language that hash lowest."""

    def number(seed: int) -> Column:
        return F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), F.lit(seed))

    place = F.shiftrightunsigned(number(8), 11)
    sizes = rows.groupBy(F.col(lang_col).alias("_lang")).agg(F.count(F.lit(1)).alias("_n"))
    langs = sizes.orderBy(F.col("_n").desc(), "_lang").limit(SAMPLE_LANGS).select("_lang")
    named = rows.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_of"), F.col(text_col).alias("_text"), place.alias("_place"), (F.pmod(number(9), F.lit(5)) == 0).alias("_out"))

    groups = max(1, int(shuffle_partitions(rows.sparkSession) ** 0.5))

    def first(of: DataFrame) -> DataFrame:
        """Each task keeps no more than the sample, then each of some groups of tasks, then all together."""
        of = of.withColumn("_group", F.pmod(F.spark_partition_id(), F.lit(groups)))
        for keys in (("_of", "_group"), ("_of",)):
            rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_place"))
            of = of.withColumn("_rank", rank).where(F.col("_rank") <= SAMPLE_PER_LANG).drop("_rank")
        return of

    # how far the sample goes in each language, without the texts; then its rows, and what has the last one's hash
    upto = first(named.select("_of", "_place").join(F.broadcast(langs), F.col("_of") == F.col("_lang"))).groupBy("_lang").agg(F.max("_place").alias("_upto"))
    near = named.join(F.broadcast(upto), (F.col("_of") == F.col("_lang")) & (F.col("_place") <= F.col("_upto")))  # a row a language
    picked = first(near)

    def run(batches):
        for batch in batches:
            for lang, out, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, n = counts(text)
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([out]), pa.array([at.tolist()], pa.list_(pa.int32())), pa.array([n.tolist()], pa.list_(pa.int32()))], names=["lang", "out", "at", "n"])

    found = picked.select("_lang", "_out", "_text").mapInArrow(run, "lang string, out boolean, at array<int>, n array<int>").collect()
    found.sort(key=lambda r: (r.lang, r.out, len(r.at), r.at, r.n))
    return [(r.lang, r.out, np.array(r.at, np.int64), np.array(r.n, float)) for r in found]


def fit(examples: list[tuple[str, bool, np.ndarray, np.ndarray]], df: np.ndarray, n_rows: int) -> Model | None:
    if not examples:
        return None
    langs = sorted({e[0] for e in examples})
    idf = np.log((1 + n_rows) / (1 + df)) + 1
    data = [(langs.index(lang), at, vector(at, n, idf), out) for lang, out, at, n in examples]
    inside = [x for x in data if not x[3]] or data
    z, s = np.zeros((len(langs), DIMS + 1)), np.zeros((len(langs), DIMS + 1))
    rng = np.random.default_rng(8)

    def weights(at):
        zz, ss = z[:, at], s[:, at]
        w = -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(ss)) / ALPHA + L2)
        return np.where(np.abs(zz) <= L1, 0.0, w)

    for _ in range(EPOCHS):
        for k in rng.permutation(len(inside)):
            label, at, v, _ = inside[k]
            at, v = np.append(at, DIMS), np.append(v, 1.0)  # the last feature is the constant
            w = weights(at)
            p = softmax(w @ v)
            p[label] -= 1
            g = np.outer(p, v)
            sigma = (np.sqrt(s[:, at] + g * g) - np.sqrt(s[:, at])) / ALPHA
            z[:, at] += g - sigma * w
            s[:, at] += g * g
    w = weights(np.arange(DIMS + 1))
    outside = [x for x in data if x[3]]
    scores = [(label, w[:, at] @ v + w[:, DIMS]) for label, at, v, _ in outside]
    # targets short of 1, as a sample without errors would else ask for a temperature of 0
    sure = (len(scores) + 1) / (len(scores) + 2)
    rest = (1 - sure) / max(1, len(langs) - 1)

    def loss(t: float) -> float:
        logs = [(label, np.log(np.maximum(softmax(x / t), 1e-300))) for label, x in scores]
        return -sum((sure - rest) * lp[label] + rest * lp.sum() for label, lp in logs)

    losses = {t: loss(t) for t in np.geomspace(0.05, 20, 80)} if scores else {}
    return Model(langs, idf, w[:, :DIMS], w[:, DIMS], float(min(losses, key=losses.get)) if scores else 1.0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def train(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    rows = eligible_rows(docs, held_out, text_col, lang_col)
    return fit(sample(rows, id_col, text_col, lang_col), *document_frequencies(rows, text_col))


def predict_text(model: Model | None, text: str | None) -> tuple[str, float]:
    if model is None or not has_letter(text):
        return UNKNOWN, 0.0
    at, n = counts(text)
    p = softmax((model.weights[:, at] @ vector(at, n, model.idf) + model.bias) / model.temperature)
    return model.langs[int(p.argmax())], float(p.max())


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """`docs` with lang_pred and score (its probability); the text itself goes unless keep_text."""

    def make():
        return lambda texts: [list(c) for c in zip(*(predict_text(model, t) for t in texts), strict=True)]

    return append_columns(docs, make, [(text_col, F.col(text_col))], OUTPUT, drop=() if keep_text else (text_col,))


def held_out_rows(id_col: str = "doc_id") -> Column:
    """The fifth of the ids whose CRC-32 as text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
