"""The queries of this subpackage: one opN_ query an operator, with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, fingerprints, language_id, mixing, ngram_join, pii, quality_rules, substring_dedup
from .common import table
from .license_scan import digest as license_digest
from .license_scan import scan_licenses
from .token_counts import count_tokens


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.dedup(table(spark, sf_dir, "documents"), window=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.digest(byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    wanted = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")
    return license_digest(scan_licenses(docs)).select(*wanted)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.documents.select("doc_id", "size", "source_size", "target", "taken")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_spans(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = language_id.held_out_rows()
    model = language_id.train(docs, held_out)
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    return language_id.predict(rows, model)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_rules.judge(docs, table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_fingerprints": op2_fingerprints,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_license_scan": op4_license_scan,
    "op5_mixing": op5_mixing,
    "op6_ngram_join": op6_ngram_join,
    "op7_pii": op7_pii,
    "op8_language_id": op8_language_id,
    "op9_quality_rules": op9_quality_rules,
    "op10_token_counts": op10_token_counts,
}

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": r"""
        WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS k FROM texts),
        windows AS (SELECT doc_id, k, row_number() OVER (PARTITION BY array_to_string(w[k:k + 19], ' ') ORDER BY doc_id, k) > 1 AS again FROM starts),
        gone AS (SELECT DISTINCT doc_id, k + step AS k FROM windows, range(20) t(step) WHERE again),
        words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM texts),
        kept AS (
            SELECT words.doc_id, count(gone.k) AS n_removed, string_agg(word, ' ' ORDER BY words.k) FILTER (WHERE gone.k IS NULL) AS kept
            FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.k = gone.k GROUP BY 1)
        SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM texts LEFT JOIN kept USING (doc_id)
    """,
    "op2_fingerprints": r"""
        WITH ordered AS (
            SELECT doc_id, coalesce(text, '') AS t, lead(coalesce(text, '')) OVER line AS following, first_value(coalesce(text, '')) OVER line AS top
            FROM documents WINDOW line AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
        pairs AS (SELECT doc_id, t, coalesce(following, top) AS n, len(t) // 2 AS half FROM ordered),
        edited AS (SELECT doc_id, t, n, substring(t, 1, len(t) - half) || substring(n, 1, half) AS e FROM pairs),
        texts AS (SELECT DISTINCT unnest([t, n, e]) AS x FROM edited),
        leaved AS (
            SELECT x, list_transform(regexp_split_to_array(x, '\n[ \t]*\n[ \t\n\x0B\f\r]*'), lambda s: list_transform(string_split(s, chr(10)), lambda p:
                list_transform(string_split(regexp_replace(p, '([nrkxzNRKXZ0-9[:punct:]])[ \t]+', '\1' || chr(57344), 'g'), chr(57344)), lambda w: substr(md5(w), 1, 8)))) AS tree
            FROM texts),
        written AS (
            SELECT x, list_distinct(flatten(flatten(tree))) AS leaves,
                   list_transform(tree, lambda s: list_transform(s, lambda p: substr(md5(array_to_string(p, '.')), 1, 16) || '=' || array_to_string(p, '.'))) AS lines FROM leaved),
        noded AS (
            SELECT x, leaves, list_transform(lines, lambda s: substr(md5(array_to_string(list_transform(s, lambda p: substr(p, 1, 16)), ',')), 1, 16) || '=' || array_to_string(s, ',')) AS parts
            FROM written),
        prints AS (
            SELECT x, CASE WHEN x = '' THEN [] ELSE leaves END AS leaves,
                   sha256(x) || ':' || CASE WHEN x = '' THEN sha256('') || ':' ELSE sha256(array_to_string(list_transform(parts, lambda p: substr(p, 1, 16)), '/')) || ':' || array_to_string(parts, '/') END AS print
            FROM noded)
        SELECT doc_id, len(t) AS n_chars, sha256(e) AS edited_sha256, own.print AS fingerprint, changed.print AS edited_fingerprint,
               CASE WHEN t = e THEN 1.0 ELSE 2.0::DOUBLE * len(list_intersect(own.leaves, changed.leaves)) / (len(own.leaves) + len(changed.leaves)) END AS near_edited,
               CASE WHEN t = n THEN 1.0 ELSE 2.0::DOUBLE * len(list_intersect(own.leaves, next.leaves)) / (len(own.leaves) + len(next.leaves)) END AS near_next
        FROM edited JOIN prints own ON own.x = t JOIN prints changed ON changed.x = e JOIN prints next ON next.x = n
    """,
    "op6_ngram_join": r"""
        WITH RECURSIVE texts AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) END AS s FROM texts),
        shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
        links AS (
            SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id != b.doc_id
            GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
        reached AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reached.x, links.y FROM reached JOIN links ON reached.y = links.x)
        SELECT doc_id, len(s) AS n_shingles, component_id FROM sets JOIN (SELECT x, min(y) AS component_id FROM reached GROUP BY x) ON x = doc_id
    """,
    # the schedule is not in it: whatever the order of slots, a source's line is taken from its start to its target
    "op5_mixing": r"""
        WITH sized AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
                   md5(concat_ws('|', '5', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))) AS key
            FROM documents),
        sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
        weighed AS (
            SELECT *, [1.0::DOUBLE, 2.0, 3.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight,
                   CAST(source_size * 3 AS DOUBLE) AS cap
            FROM sizes),
        levels AS (
            SELECT *, cap / weight AS ratio,
                   (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER before, 0))
                   / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
            FROM weighed
            WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        filled AS (
            SELECT (SELECT level FROM levels WHERE level * weight <= cap ORDER BY ratio, source NULLS LAST LIMIT 1) AS level),
        targets AS (
            SELECT source, source_size, least(coalesce(filled.level * weight, cap), cap) AS target FROM levels, filled),
        laid AS (
            SELECT doc_id, source, size, coalesce(sum(size) OVER (
                PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
            FROM sized)
        SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
               CAST(list_sum([greatest(0, least(start + size, floor(target) - e * source_size) - start) FOR e IN [0, 1, 2]]) AS BIGINT) AS taken
        FROM laid JOIN targets ON laid.source IS NOT DISTINCT FROM targets.source
    """,
}
