"""Quality rules: statistics of a text, and a decision list learned from labelled ones.

Sequential covering over the labelled rows: a rule grows by the threshold test
with the largest FOIL gain on the growing part until it takes no good row or has
MAX_TESTS tests, then loses tests from its end while that does not lower its
precision on the pruning part; it stands if its smoothed precision there is at
least MIN_PRECISION. Its thresholds then move towards the bad rows, which leaves a
margin to the good ones, if the moved rule stands that test too. Rows that the
emitted rule covers go, and the next rule grows on the others, until none stands.
Thresholds are quantiles over all labelled rows. Everything is counted by Spark
aggregations, of which the driver sees a row per statistic and bin, never a
document; the list itself becomes one ordered CASE expression.

Edge cases: a null text has no words and all counts 0. Repeated labels of an id
count once, the lowest; a null label doesn't count. Without labels, or with only
one class, the list is empty and only the base rule rejects.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Java's form of white space between words.
GAP = r"\x20\x09-\x0D"
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30

MAX_RULES, MAX_TESTS = 10, 4
MIN_PRECISION = 0.9
#: A rule must cover so many rows of the pruning part.
MIN_COVER = 5
BINS = 40

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Test(NamedTuple):
    """A statistic above (or not above) a threshold."""

    feature: str
    above: bool
    bin: int
    threshold: float

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


def _repeated(windows: Column) -> Column:
    """Words in windows (by their starts) that are found twice or more."""
    keyed = F.sort_array(F.transform(windows, lambda w, k: F.struct(F.xxhash64(w).alias("h"), k.alias("k"))))

    def starts(rows: Column) -> Column:
        def twice(x: Column, k: Column) -> Column:
            same = F.lit(False)
            for other in (F.get(rows, k - 1), F.get(rows, k + 1)):
                same = same | F.coalesce(other["h"] == x["h"], F.lit(False))
            return same

        return F.sort_array(F.transform(F.filter(rows, twice), lambda x: x["k"]))

    def covered(at: Column) -> Column:
        own = F.transform(at, lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - s, F.lit(WINDOW))))
        return F.aggregate(own, F.lit(0), lambda a, x: a + x)

    def let(value: Column, body) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    return let(let(keyed, starts), covered)


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` without its text, with COUNTS and the features that rules may test. Columns named _... or f_... go."""
    kept = [c for c in docs.columns if c != text_col and c not in COUNTS and not c.startswith(("f_", "_"))]
    text = F.coalesce(F.col(text_col), F.lit(""))
    # all white space between words as one space; where it is one already, nothing is replaced
    plain = F.trim(F.regexp_replace(text, rf"\x20[{GAP}]+|[\x09-\x0D][{GAP}]*", " "))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(rf"[^{GAP}]"))
    d = docs.select(*kept, text.alias("_text"), plain.alias("_plain"), lines.alias("_lines"))
    each = rf"(?=([^ ]++(?: [^ ]++){{{WINDOW - 1}}}))[^ ]++"
    d = d.select(
        *kept,
        F.length(F.replace("_plain", F.lit(" "), F.lit(""))).cast("bigint").alias("word_chars"),
        F.length("_plain").alias("_length"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.size("_lines").alias("_n_lines"),
        F.regexp_count("_text", F.lit(r"[A-Z]")).alias("_upper"),
        F.regexp_count("_text", F.lit(r"[!?]")).alias("_calls"),
        F.regexp_count("_text", F.lit(r"[0-9]")).alias("_digits"),
        F.size(F.array_distinct(F.split("_plain", " "))).alias("_distinct"),
        F.regexp_extract_all("_plain", F.lit(each), 1).alias("_windows"),
    )
    d = d.withColumn("n_words", F.when(F.col("_length") > 0, F.col("_length") - F.col("word_chars") + 1).otherwise(0).cast("bigint"))
    none_twice = F.size(F.array_distinct("_windows")) == F.size("_windows")
    d = d.withColumn("n_repeat_words", F.when(none_twice, F.lit(0)).otherwise(_repeated(F.col("_windows"))).cast("bigint"))

    def per(value: str, whole: str) -> Column:
        return F.coalesce(F.try_divide(F.col(value).cast("double"), F.col(whole).cast("double")), F.lit(0.0))

    return d.select(
        *kept,
        *COUNTS,
        F.col("n_words").cast("double").alias("f_words"),
        per("word_chars", "n_words").alias("f_mean_word"),
        per("n_symbols", "n_words").alias("f_symbols"),
        per("n_dup_lines", "_n_lines").alias("f_dup_lines"),
        per("n_repeat_words", "n_words").alias("f_repeat_words"),
        per("_upper", "word_chars").alias("f_upper"),
        per("_calls", "n_words").alias("f_calls"),
        per("_digits", "word_chars").alias("f_digits"),
        per("_distinct", "n_words").alias("f_distinct"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def learn(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> list[list[Test]]:
    """The rules, first to last, that find rows labelled 0."""
    features = [c for c in stats.columns if c.startswith("f_")]
    truth = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_label"))
    rows = stats.join(truth, F.col(id_col) == F.col("_id"))
    pruning = F.pmod(F.xxhash64(F.col("_id").cast("string"), F.lit(3)), F.lit(3)) == 0
    rows = materialize(rows.select("_label", pruning.alias("pruning"), *features))
    at = [k / BINS for k in range(1, BINS)]
    found = rows.agg(*[F.percentile_approx(c, at, 10_000).alias(c) for c in features]).first()
    cuts = {c: sorted(set(found[c] or [])) for c in features}
    # a row as the bins of its statistics; equal ones are counted once
    def bin_of(name: str) -> Column:
        edges = F.array(*[F.lit(x) for x in cuts[name]]).cast("array<double>")
        return F.coalesce(F.size(F.filter(edges, lambda x: x < F.col(name))), F.lit(0))

    bins = [bin_of(c) for c in features]

    def binned(rows: DataFrame) -> DataFrame:
        each = rows.select((F.col("_label") == 0).alias("bad"), "pruning", F.array(*bins).alias("bins"))
        return materialize(each.groupBy("bad", "pruning", "bins").agg(F.count(F.lit(1)).alias("n")))

    def holds(t: Test) -> Column:
        own = F.get("bins", F.lit(features.index(t.feature)))
        return own > t.bin if t.above else own <= t.bin

    def counts(rows: DataFrame) -> dict[tuple[int, int], tuple[int, int]]:
        """Bad and good rows by statistic and bin."""
        n = [F.sum(F.when(F.col("bad") == b, F.col("n")).otherwise(0)).alias(f"n{int(b)}") for b in (True, False)]
        return {(r.pos, r.col): (r.n1, r.n0) for r in rows.select("bad", "n", F.posexplode("bins")).groupBy("pos", "col").agg(*n).collect()}

    def total(by_bin: dict) -> tuple[int, int]:
        first = [v for (f, _), v in by_bin.items() if f == 0]
        return sum(b for b, _ in first), sum(g for _, g in first)

    rules: list[list[Test]] = []
    rest = binned(rows)
    while len(rules) < MAX_RULES:
        rule: list[Test] = []
        growing = rest.where(~F.col("pruning"))
        while len(rule) < MAX_TESTS:
            by_bin = counts(growing)
            bad, good = total(by_bin)
            if not bad or not good:
                break
            best = (0.0, None)
            for f, name in enumerate(features):
                for cut, threshold in enumerate(cuts[name]):
                    low = [v for (k, b), v in by_bin.items() if k == f and b <= cut]
                    p, n = sum(b for b, _ in low), sum(g for _, g in low)
                    for above, p1, n1 in ((False, p, n), (True, bad - p, good - n)):
                        if p1:
                            gain = p1 * (math.log2(p1 / (p1 + n1)) - math.log2(bad / (bad + good)))
                            if gain > best[0] + 1e-9:
                                best = (gain, Test(name, above, cut, threshold))
            if best[1] is None:
                break
            rule.append(best[1])
            growing = growing.where(holds(best[1]))
        if not rule:
            break
        # precision on the pruning part of the rule's beginnings, the shortest of the best
        scored = []
        part = rest.where(F.col("pruning"))
        for k, t in enumerate(rule, 1):
            part = part.where(holds(t))
            bad, good = total(counts(part))
            scored.append(((bad + 1) / (bad + good + 2), bad + good, k))
        precision, cover, length = max(scored, key=lambda x: (round(x[0], 4), -x[2]))
        if not _stands(precision, cover):
            break
        rule = rule[:length]
        moved = _with_margin(rule, rows)
        scores = rows.where(F.col("pruning") & _covers(moved)).agg(F.count_if(F.col("_label") == 0).alias("bad"), F.count(F.lit(1)).alias("n")).first()
        rules.append(moved if _stands((scores.bad + 1) / (scores.n + 2), scores.n) else rule)
        # what lies in the margin is still there for later rules; a moved threshold may lie inside a bin, so rows are counted anew
        rows = rows.where(~_covers(rules[-1]))
        rest = binned(rows)
    return rules


def _stands(precision: float, cover: int) -> bool:
    return cover >= MIN_COVER and precision >= MIN_PRECISION


def _covers(rule: list[Test]) -> Column:
    test = F.lit(True)
    for t in rule:
        test = test & (F.col(t.feature) > t.threshold if t.above else F.col(t.feature) <= t.threshold)
    return test


def _with_margin(rule: list[Test], rows: DataFrame) -> list[Test]:
    """Thresholds half way to where all but a twentieth of the bad rows that the rule covers lie: good rows near the old ones are spared."""
    ends = [F.percentile_approx(t.feature, 0.05 if t.above else 0.95, 10_000).alias(f"e{k}") for k, t in enumerate(rule)]
    found = rows.where((F.col("_label") == 0) & _covers(rule)).agg(*ends).first()
    return [t if found[k] is None else t._replace(threshold=(t.threshold + found[k]) / 2) for k, t in enumerate(rule)]


def verdict(rules: list[list[Test]]) -> Column:
    """The decision list as one ordered expression: true for a text that no rule rejects."""
    whole = None
    for rule in rules:
        whole = F.when(_covers(rule), False) if whole is None else whole.when(_covers(rule), False)
    return F.lit(True) if whole is None else whole.otherwise(True)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without its text, with its statistics, base_failed and kept."""
    stats = materialize(statistics(docs, text_col))
    rules = learn(stats, labels, id_col)
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))
