"""Licence scans: ordered signature rules behind a keyword prefilter.

Texts are taken with A-Z in lower case. One pass of an Aho-Corasick automaton
finds which keywords a text holds; only the rules of those keywords run. Of the
detections, those of higher priority (then longer, then earlier) stand first,
and one is suppressed when its interval lies within one that stands. Base
phrases are words standing consecutively; they are always reported, whatever
the rules say.

Edge cases: a null or empty text has no words, no labels ('') and score 0;
equal rules at one place count once.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import license_rules
from .common import append_columns, utf8

#: Fixed by the result's contract.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Score of a base phrase by itself.
PHRASE_SCORE = 0.5

OUTPUT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.ArrayType(T.StringType())),
        T.StructField(
            "detections",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("label", T.StringType()),
                        T.StructField("kind", T.StringType()),
                        T.StructField("start", T.LongType()),
                        T.StructField("end", T.LongType()),
                        T.StructField("score", T.DoubleType()),
                    ]
                )
            ),
        ),
    ]
)

#: By byte of lower-case UTF-8: 1 in words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
IN_WORD = np.zeros(256, bool)
IN_WORD[0x30:0x3A] = IN_WORD[0x61:0x7B] = IN_WORD[0x80:] = True


def phrase_pattern(phrase: str) -> re.Pattern:
    word, gap = rb"0-9a-z\x80-\xff", rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
    return re.compile(rb"(?<![" + word + rb"])" + gap.join(w.encode() for w in phrase.split()) + rb"(?![" + word + rb"])")


def resolve(found: list[tuple]) -> list[tuple]:
    """(label, kind, start, end, score, priority) without those within one that stands before them."""
    every = sorted(set(found), key=lambda x: (-x[5], x[2] - x[3], x[2], x[0]))
    rank = {start: k for k, start in enumerate(sorted({x[2] for x in every}), 1)}
    # the furthest end by start of those that stand, as maxima over runs of ranks whose lengths are powers of two
    furthest, standing = [-1] * (len(rank) + 1), []
    for x in every:
        k, most = rank[x[2]], -1
        while k:
            most = max(most, furthest[k])
            k &= k - 1
        if most >= x[3]:
            continue
        standing.append(x)
        k = rank[x[2]]
        while k <= len(rank):
            furthest[k] = max(furthest[k], x[3])
            k += k & -k
    return sorted(standing, key=lambda x: (x[2], x[3], x[0]))


def scanner():
    import ahocorasick

    rules = license_rules.rules()
    by_keyword: dict[str, list] = {}
    for r in rules:
        by_keyword.setdefault(r.keyword, []).append(r)
    automaton = ahocorasick.Automaton()
    for k in by_keyword:
        automaton.add_word(k, k)
    automaton.make_automaton()
    phrases = [(phrase.split()[0].encode(), phrase_pattern(phrase), label) for phrase, label in PHRASES.items()]

    def detections(text: str) -> list[tuple]:
        found = []
        for k in {k for _, k in automaton.iter(text)}:
            for r in by_keyword[k]:
                found += [(r.label, r.kind, *m.span(), r.score, r.priority) for m in r.pattern.finditer(text)]
        return [x[:5] for x in resolve(found)]

    def apply(texts):
        lower = [t.lower() for t in texts]  # of bytes: A-Z only
        whole = np.frombuffer(b" " + b" ".join(lower), np.uint8)
        inside = IN_WORD[whole]
        starts = np.flatnonzero(inside[1:] & ~inside[:-1])  # offsets from the first text on
        offsets = np.cumsum([0] + [len(t) + 1 for t in lower])
        before = np.searchsorted(starts, offsets)
        out = []
        for k, t in enumerate(lower):
            places, labels = [], set()
            for first, pattern, label in phrases:
                if first in t:
                    for m in pattern.finditer(t):
                        places.append(int(np.searchsorted(starts, offsets[k] + m.start()) - before[k]))
                        labels.add(label)
            out.append(
                (
                    int(before[k + 1] - before[k]),
                    len(places),
                    min(places, default=None),
                    max(places, default=None),
                    sorted(labels),
                    [dict(zip(("label", "kind", "start", "end", "score"), x, strict=True)) for x in detections(t.decode("utf-8", "replace"))],
                )
            )
        return [list(c) for c in zip(*out, strict=True)]

    return apply


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` without its text, with the columns of OUTPUT; starts and ends are code points, ends exclusive."""
    return append_columns(docs, scanner, [(text_col, utf8(F.col(text_col)))], OUTPUT, drop=(text_col,))


def digest(scanned: DataFrame) -> DataFrame:
    """base_labels and labels as sorted comma-joined text, and the score of the surest detection."""
    named = F.transform("detections", lambda d: d["label"])
    surest = F.coalesce(F.array_max(F.transform("detections", lambda d: d["score"])), F.lit(0.0))
    return scanned.withColumns(
        {
            "labels": F.array_join(F.array_sort(F.array_distinct(F.concat("base_labels", named))), ","),
            "score": F.greatest(surest, F.when(F.col("n_base") > 0, PHRASE_SCORE).otherwise(0.0)),
        }
    ).withColumn("base_labels", F.array_join("base_labels", ","))
