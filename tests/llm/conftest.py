import random

import pytest

WORDS = "the of and a in to is was for on that with as it by at from his an are this which be or had not but what all were".split()


def prose(rnd, n, vocabulary=400):
    out = []
    for _ in range(n):
        w = rnd.choice(WORDS) if rnd.random() < 0.4 else f"w{rnd.randrange(vocabulary)}x"
        out.append(w.capitalize() if rnd.random() < 0.1 else w)
    return " ".join(out)


def corpus():
    """(id, text): prose, exact and near copies, shared passages, odd white space, null and empty texts, one very long."""
    rnd = random.Random(7)
    texts = [prose(rnd, rnd.choice([3, 6, 30, 80, 200])) for _ in range(60)]
    passage = prose(rnd, 45)
    texts += [f"{prose(rnd, 10)} {passage}\n{prose(rnd, 10)}" for _ in range(6)]
    texts += [texts[k] for k in range(0, 20, 2)]
    for k in range(20, 60, 3):
        words = texts[k].split()
        for _ in range(max(1, len(words) // 40)):
            words[rnd.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [None, None, "", " \t\n ", "one", "one", "ONE", "  a\tb\x0bc\x0c d\r\n e  ", "ß Ä ä é 日本語   x y", "a b c d", "a b c d e", "A b c d e"]
    line = prose(rnd, 12)
    texts += ["\n".join([line, line, prose(rnd, 9), line]), "go on " * 60, prose(rnd, 20_000, 3000)]
    return [(3 * k + (k % 3), t) for k, t in enumerate(texts)]


@pytest.fixture(scope="session")
def make_prose():
    return prose


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    # columns beside id and text, some with names that results also have
    return spark.createDataFrame([(i, t, "x", k, 0.5, [k]) for k, (i, t) in enumerate(rows)], "doc_id long, text string, labels string, n_tokens int, score double, spans array<int>").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def odd(spark):
    """Null and repeated ids, repeated rows."""
    text = "one two three four five six seven eight nine ten " * 4
    return spark.createDataFrame([(None, text), (None, None), (5, text), (5, text), (5, "other words here"), (1, None), (9, text + "more")], "doc_id long, text string")
