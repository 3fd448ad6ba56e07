"""Token counts without token ids.

The piece model replaces each space by U+2581, puts one in front of the text and
then merges neighbouring pieces. No piece of such a vocabulary holds U+2581 after
another character (`check_vocabulary` refuses one that does), so no merge crosses
the place in front of a run of U+2581: a text's tokens are those of its
pre-tokens, each a run of U+2581 and what follows it. A task keeps the token
counts of the pre-tokens it has seen, asks the model only for new ones, joins the
counts to each document's pre-token frequencies and sums. Nothing is shuffled,
and no document's ids are ever built.

Edge cases: null and empty texts have 0 bytes and 0 tokens; U+2581 in a text is
the same as a space, as in the library; strings like "<s>" are ordinary text.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, utf8

SPACE = "▁"
#: Pre-tokens whose counts a task keeps; past it the table starts anew, which costs time only.
KEPT = 200_000

OUTPUT = T.StructType(
    [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("over_limit", T.BooleanType()),
    ]
)


def load(model_path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_path)


def check_vocabulary(model) -> None:
    for k in range(model.get_piece_size()):
        if SPACE in model.id_to_piece(k).lstrip(SPACE):
            raise ValueError("a piece goes on after a space: pre-tokens can't be counted apart")


def pre_tokens(text: str) -> list[str | None]:
    """Each pre-token without its first space mark, which the model puts back; None for a mark alone."""
    text = text.replace(SPACE, " ")
    if not text:
        return []
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [p[1:] or None for p in re.findall(r" *[^ ]+| +", " " + text)]


def counter(model_path: str, limit: int):
    def make():
        model = load(model_path)
        check_vocabulary(model)
        known: dict[str | None, int] = {None: 1}

        def apply(texts):
            found = [Counter(pre_tokens(t.decode("utf-8", "replace"))) for t in texts]
            new = list({w for f in found for w in f if w not in known})
            known.update(zip(new, map(len, model.encode(new, num_threads=1)), strict=True))
            totals = [sum(n * known[w] for w, n in f.items()) for f in found]
            if len(known) > KEPT:
                known.clear()
                known[None] = 1
            return [[len(t) for t in texts], totals, [n > limit for n in totals]]

        return apply

    return make


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, text_col: str = "text") -> DataFrame:
    """`docs` without its text, with n_bytes, n_tokens and over_limit (n_tokens > limit)."""
    return append_columns(docs, counter(model_path, limit), [(text_col, utf8(F.col(text_col)))], OUTPUT, drop=(text_col,))
