"""Personal data: fixed patterns, and a linear-chain CRF over word shapes.

The patterns give the base spans (email, ip, card, phone). The CRF labels words:
features are a word's shape, length, key before "=", and which cue of the small
labelled table (pii_examples) it is, or the words before and after it are.
Weights come from that table by gradient ascent on the regularised likelihood,
where no change of label may count for more than staying at O does; decoding is
Viterbi over many lines at a time in numpy. Its spans (name, secret, id) are
added where they don't overlap a base span.

A word's scores depend on its features only, so a task computes them once for
each distinct word. A text needs decoding only if some word could leave the
label O: `Tagger.hint` is a bound under which the best path is all O, so nothing
is lost by passing over the others.

Edge cases: a null text is empty and stays null when masked. Spans are in code
points, ends exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import cache
from itertools import accumulate, groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns
from .pii_examples import EXAMPLES

BASE = ("email", "ip", "card", "phone")
ADDED = ("name", "secret", "id")
KINDS = BASE + ADDED

#: Of the fit: steps of gradient ascent, their size, and the penalty on squares.
STEPS, RATE, PENALTY = 400, 0.2, 0.02
#: Distinct words whose scores a task keeps.
KEPT = 200_000

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
OUTPUT = T.StructType([T.StructField("spans", T.ArrayType(SPAN))])

# -- base spans ----------------------------------------------------------------------------------

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    doubled = [int(c) for c in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(2 * d - 9 * (d > 4) for d in doubled)) % 10 == 0


def emails(text: str):
    """As the leftmost non-overlapping matches of the whole pattern, but sought from each @, in linear time."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), leftmost non-overlapping within a kind; matches that fail their test are dropped."""
    found = [("email", *x) for x in emails(text)]
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")) ]
    for m in _CARD.finditer(text):
        if len(m[0]) >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", *m.span()))
    return found


# -- features --------------------------------------------------------------------------------------

_LABELLED = re.compile(r"\{(\w+) ([^}]*)\}|(\S+)")
#: Where a cue counts, seen from it: for the next word, the one after that, and the word before.
AWAY = (1, 2, -1)
CONTEXT = 1 + len(AWAY)
#: Score of a pair of labels that can't be.
NEVER = -50.0
LABELS = ("O", *(f"{p}-{k}" for k in ADDED for p in "BI"))
_TRIM = " \t.,;:!?()\"'"


def examples() -> list[tuple[list[str], list[int]]]:
    out = []
    for line in EXAMPLES.strip().splitlines():
        words, labels = [], []
        for kind, inside, word in _LABELLED.findall(line):
            part = inside.split() if kind else [word]
            words += part
            labels += [LABELS.index(f"{'BI'[k > 0]}-{kind}") if kind else 0 for k in range(len(part))]
        out.append((words, labels))
    return out


@cache
def lexicon() -> frozenset[str]:
    """Words in front of a labelled span: the only ones that are features as such."""
    cues = set()
    for words, labels in examples():
        cues |= {words[k].strip(_TRIM).lower() for k in range(len(words) - 1) if labels[k] == 0 and LABELS[labels[k + 1]][0] == "B"}
    plain = {w.strip(_TRIM).lower() for words, labels in examples() if not any(labels) for w in words}
    return frozenset(cues - plain - {""}) | {"name"}


def shape(word: str) -> str:
    """The kinds of the word's characters, each run once."""
    kinds = ("X" if c.isupper() else "x" if c.isalpha() else "d" if c.isdigit() else c if c.isascii() else "u" for c in word)
    return "".join(k for k, _ in groupby(kinds))


def features(word: str) -> tuple[str, ...]:
    core = word.strip(_TRIM)
    if core.isalpha() and (low := core.lower()) not in lexicon():  # the many plain words
        form = "x" if core == low else "Xx" if core[1:] == low[1:] else "X" if core.isupper() else "xX"
        return ("any", f"form={form}", "plain")
    out = ["any", f"size={min(6, len(core) // 4)}"]
    key, eq, value = core.partition("=")
    if eq:
        out.append(f"key={key.lower()}" if key.isidentifier() else "key")
        out.append("assigned")
    out.append(f"form={shape(core)}")
    if core.isalnum() and not core.isalpha() and not core.isdigit():
        out.append(f"mixed={'X' if core.upper() == core else 'x'}{min(6, len(core) // 4)}")
    if core[:4].isalpha() and core[:4].isupper() and len(core) > 4:
        out.append(f"head={core[:4]}" if core[:4] in ("AKIA", "ASIA") else "head")
    if core.lower() in lexicon():
        out.append(f"cue={core.lower()}")
    return tuple(out)


# -- the model -------------------------------------------------------------------------------------


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Weights of a word's own features, of those of its neighbours, and of label pairs."""

    def __init__(self):
        rows = examples()
        self.number: dict[str, int] = {}
        self.hints: dict[tuple[str, ...], bool] = {}
        for words, _ in rows:
            for w in words:
                for f in features(w):
                    self.number.setdefault(f, len(self.number))
        self._fit(rows)

    def ids(self, word: str) -> list[int]:
        return [self.number[f] for f in features(word) if f in self.number]

    def cues(self, word: str) -> list[int]:
        return [self.number[f] for f in features(word) if f in self.number and f.startswith("cue=")]

    def _fit(self, rows) -> None:
        n, width, k, n_labels = len(rows), max(len(w) for w, _ in rows), len(self.number), len(LABELS)
        x = np.zeros((CONTEXT, n, width, k))  # own features; cues one before, two before, one after
        y, mask = np.zeros((n, width), int), np.zeros((n, width))
        for i, (words, labels) in enumerate(rows):
            mask[i, : len(words)], y[i, : len(words)] = 1, labels
            for t, w in enumerate(words):
                x[0, i, t, self.ids(w)] = 1
                for c, away in enumerate(AWAY, 1):
                    if 0 <= t + away < len(words):
                        x[c, i, t + away, self.cues(w)] = 1
        x = np.concatenate(x, axis=-1)
        seen = np.eye(n_labels)[y] * mask[:, :, None]
        seen_pairs = np.einsum("nta,ntb->ab", seen[:, :-1], seen[:, 1:])
        allowed = np.array([[b[0] != "I" or a[1:] == b[1:] and a != "O" for b in LABELS] for a in LABELS])
        w, trans = np.zeros((CONTEXT * k, n_labels)), np.where(allowed, 0.0, NEVER)
        mw, vw, mt, vt = np.zeros_like(w), np.zeros_like(w), np.zeros_like(trans), np.zeros_like(trans)
        flat = x.reshape(n * width, CONTEXT * k)
        for step in range(1, STEPS + 1):
            e = (flat @ w).reshape(n, width, n_labels)
            alpha, beta = [e[:, 0]], [np.zeros((n, n_labels))]
            for t in range(1, width):
                on = mask[:, t, None]
                new = _logsumexp(alpha[-1][:, :, None] + trans, 1) + e[:, t]
                alpha.append(np.where(on, new, alpha[-1]))
            for t in range(width - 1, 0, -1):
                on = mask[:, t, None]
                new = _logsumexp(trans[None] + (e[:, t] + beta[0])[:, None, :], 2)
                beta.insert(0, np.where(on, new, beta[0]))
            z = _logsumexp(alpha[-1], 1)
            p = np.exp(np.stack(alpha, 1) + np.stack(beta, 1) - z[:, None, None]) * mask[:, :, None]
            pairs = np.zeros_like(trans)
            for t in range(1, width):
                joint = alpha[t - 1][:, :, None] + trans + (e[:, t] + beta[t])[:, None, :] - z[:, None, None]
                pairs += (np.exp(joint) * mask[:, t, None, None]).sum(0)
            gw = flat.T @ (seen - p).reshape(n * width, n_labels) - PENALTY * w
            gt = seen_pairs - pairs - PENALTY * trans
            for g, m, v, target in ((gw, mw, vw, w), (gt, mt, vt, trans)):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                target += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) * (1 - step / (STEPS + 1))
            trans[:] = np.where(allowed, np.minimum(trans, 0), NEVER)
            trans[0, 0] = 0
        self.weights, self.trans = w.reshape(CONTEXT, k, n_labels), trans

    def scores(self, word: str) -> np.ndarray:
        """CONTEXT x label: of the word itself, and for the words AWAY from it if it is a cue."""
        own, cue = self.ids(word), self.cues(word)
        return np.stack([self.weights[c][cue if c else own].sum(0) for c in range(CONTEXT)])

    def hint(self, word: str) -> bool:
        """Whether a label other than O may pay here or near. No change of label pays by itself: without a hint all is O."""
        key = features(word)
        if key not in self.hints:
            gains = (s := self.scores(word))[:, 1:].max(1) - s[:, 0]
            self.hints[key] = bool(gains[0] >= 0 or (gains[1:] > 0).any())
        return self.hints[key]

    def decode(self, lines: list[list[str]], known: dict[str, np.ndarray]) -> list[np.ndarray]:
        """The best labels of each line; lines of many lengths go side by side, the long ones first."""
        order = sorted(range(len(lines)), key=lambda k: -len(lines[k]))
        sizes = np.array([len(lines[k]) for k in order])
        out: list[np.ndarray] = [np.zeros(0, int)] * len(lines)
        width = int(sizes[0]) if len(sizes) else 0
        starts = np.concatenate([[0], np.cumsum(sizes)])
        for k in order:
            for w in lines[k]:
                if w not in known:
                    known[w] = self.scores(w)
        s = np.array([known[w] for k in order for w in lines[k]]).reshape(-1, CONTEXT, len(LABELS))
        e = s[:, 0].copy()
        line = np.repeat(np.arange(len(sizes)), sizes)
        for c, away in enumerate(AWAY, 1):
            a, b = (slice(away, None), slice(None, -away)) if away > 0 else (slice(None, away), slice(-away, None))
            e[a] += np.where((line[a] == line[b])[:, None], s[b, c], 0)
        back = np.zeros(e.shape, np.int8)
        best = e[starts[:-1][sizes > 0]] if width else e
        for t in range(1, width):
            on = int(np.searchsorted(-sizes, -t, "left"))  # lines of more than t words
            via = best[:on, :, None] + self.trans
            back[starts[:on] + t] = via.argmax(1)
            best[:on] = via.max(1) + e[starts[:on] + t]
        for i, k in enumerate(order):
            labels = np.zeros(sizes[i], int)
            if sizes[i]:
                labels[-1] = best[i].argmax()
                for t in range(sizes[i] - 1, 0, -1):
                    labels[t - 1] = back[starts[i] + t, labels[t]]
            out[k] = labels
        return out


@cache
def tagger() -> Tagger:
    return Tagger()


_WORD = re.compile(r"\S+")


def _core(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and text[start] in _TRIM:
        start += 1
    while end > start and text[end - 1] in _TRIM:
        end -= 1
    return start, end


def label_spans(text: str, places: list[tuple[int, int]], labels: np.ndarray) -> list[tuple[str, int, int]]:
    out, k = [], 0
    while k < len(labels):
        if labels[k]:
            kind, first = LABELS[labels[k]][2:], k
            while k + 1 < len(labels) and LABELS[labels[k + 1]] == f"I-{kind}":
                k += 1
            start, end = _core(text, places[first][0], places[k][1])
            if start < end:
                out.append((kind, start, end))
        k += 1
    return out


class Finder:
    """The spans of texts; what a task has learned about words is kept from one to the next."""

    def __init__(self):
        self.tagger = tagger()
        self.seen: set[str] = set()
        self.hints: set[str] = set()
        self.known: dict[str, np.ndarray] = {}

    def hinted(self, text: str) -> bool:
        words = text.split()
        new = set(words) - self.seen
        if new:
            self.hints |= {w for w in new if self.tagger.hint(w)}
            self.seen |= new
        return not self.hints.isdisjoint(words)

    def added_spans(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        lines, places = [], []
        for k, text in enumerate(texts):
            if not self.hinted(text):
                continue
            start = 0
            for line in text.split("\n"):
                words = line.split()
                if not self.hints.isdisjoint(words):
                    lines.append(words)
                    places.append((k, [(start + m.start(), start + m.end()) for m in _WORD.finditer(line)]))
                start += len(line) + 1
        out: list[list] = [[] for _ in texts]
        for (k, at), labels in zip(places, self.tagger.decode(lines, self.known) if lines else [], strict=True):
            if labels.any():
                out[k] += label_spans(texts[k], at, labels)
        if len(self.seen) > KEPT:
            self.seen, self.hints, self.known = set(), set(), {}
        return out

    def find(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """All spans of each text, by start, then kind as listed."""
        out = []
        for text, added in zip(texts, self.added_spans(texts), strict=True):
            base = sorted(base_spans(text), key=lambda x: x[1])
            starts, ends = [b[1] for b in base], [-1, *accumulate((b[2] for b in base), max)]
            # of the base spans that begin before its end, the furthest end
            free = [x for x in added if ends[bisect_left(starts, x[2])] <= x[1]]
            out.append(sorted(base + free, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))
        return out


def find_spans(docs: DataFrame, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """`docs` with the column spans; the text itself goes unless keep_text."""

    def make():
        finder = Finder()

        def apply(texts):
            found = finder.find([t or "" for t in texts])
            return [[[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in found]]

        return apply

    return append_columns(docs, make, [(text_col, F.col(text_col))], OUTPUT, drop=() if keep_text else (text_col,))


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span (of overlapping ones the first) replaced by its kind in brackets."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
            at = end
        elif end > at:  # what a later span covers beyond an earlier one goes too
            at = end
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with the spans in its text replaced."""
    field = T.StructType([T.StructField("__masked", T.StringType())])

    def make():
        finder = Finder()
        return lambda texts: [[None if t is None else masked(t, s) for t, s in zip(texts, finder.find([t or "" for t in texts]), strict=True)]]

    masked_docs = append_columns(docs, make, [(text_col, F.col(text_col))], field)
    return masked_docs.withColumn(text_col, F.col("__masked")).select(*docs.columns)


def digest(found: DataFrame) -> DataFrame:
    """Counts by base kind, the SHA-256 of the base spans, and all spans as text."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    counts = [F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(of(*BASE)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
