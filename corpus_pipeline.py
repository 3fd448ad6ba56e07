"""The corpus pipeline: five stages over `documents`, each working on what the one before kept.

1. language_id: documents whose language can't be told (no text, or no letter) go.
   The probability of the likeliest language is no reason to go.
2. near_duplicates: of each group of documents linked by a 5-word shingle likeness
   of 0.8 or more, the one with the least id stays (null ids last, then by text).
   Rows are told apart by id and text: a null id is no reason to stay, texts of one
   id are judged each for itself, and rows with one id and text are one document.
3. pii: personal data in the texts is replaced by its kind in brackets.
4. mixing: a document is in the result as often as the mix takes it, counting an
   epoch of which it takes half or more; one that is taken less goes. Each row of
   an id has its own count.
5. byte_bpe: the texts become token ids, with the text that they decode to.

Stages 1 to 4 return the columns of documents (n_chars follows the text); other
columns of their input are left out. `run` checkpoints what each stage returns, so
that a lost executor, or the next stage's reading it twice, repeats one stage only.

Edge cases: a null text, or one without a letter, goes in stage 1; the later stages
take a null text as the empty one (stage 3 leaves it null), and each of them can be
used alone. Very long texts are taken whole. Null ids and sources are values like
others. Rows that are equal in id and text are one document after stage 2. An empty
table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.llm import byte_bpe, language_id, mixing, ngram_join, pii
from chronofold.llm.common import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    model = language_id.train(docs, language_id.held_out_rows())
    judged = language_id.predict(docs, model, keep_text=True)
    return judged.where(F.col("lang_pred") != language_id.UNKNOWN).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    linked = ngram_join.first_rows(docs)
    keys = linked.groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows"))
    keys = materialize(keys)  # three readers
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (ngram_join.text_hash() == F.col("hash"))
    kept = docs.join(keys.where("NOT kept"), same, "left_anti")
    # rows with one id and text: once; they are few, so most texts pass by
    repeated = keys.where("kept AND rows > 1")
    single, several = kept.join(repeated, same, "left_anti"), kept.join(repeated, same, "left_semi")
    return single.select(*COLUMNS).unionByName(several.dropDuplicates(["doc_id", "text"]).select(*COLUMNS))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    times = F.when(F.col("taken") > 0, F.expr("CAST(floor(taken / size + 0.5) AS INT)")).otherwise(0)
    taken = mixing.mix(docs).documents.select("key", F.col("source").alias("of"), times.alias("times"))
    taken = materialize(taken.groupBy("key", "of").agg(F.sort_array(F.collect_list("times"), asc=False).alias("each")).where("each[0] > 0"))
    found = docs.join(taken, (mixing.row_key() == F.col("key")) & F.col("source").eqNullSafe(F.col("of")))
    unlike = F.array_min("each") < F.array_max("each")
    counted = found.where(~unlike).withColumn("times", F.col("each")[0])
    if not taken.where(unlike).isEmpty():  # rows equal in id, text and source, of which the mix takes one more often
        number = F.row_number().over(Window.partitionBy("key", "of").orderBy("lang", "n_chars"))
        several = found.where(unlike).withColumn("times", F.get("each", number - 1))
        counted = counted.unionByName(several.where("times > 0"))
    return counted.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode(docs.select("doc_id", "text", "lang", "source"), ranks, public_tokenizers.PATTERN)
    return encoded.withColumn("n_tokens", F.size("ids").cast("bigint")).withColumn("decoded", byte_bpe.decode(F.col("ids"), ranks).cast("string"))


STAGES = [
    ("language_id", keep_known_languages),
    ("near_duplicates", drop_near_duplicates),
    ("pii", mask_pii),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: No SQL for a trained classifier or a CRF; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
