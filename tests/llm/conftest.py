import random

import pytest

NAMES = ("id", "doc", "tie", "key", "host", "mine", "line", "fp", "root", "words", "text_key", "h", "n", "part", "shard", "copy", "task", "item")


def words(rng, n):
    return " ".join(rng.choice(("alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma", "theta", "zeta", "iota", "été", "naïve")) + str(rng.randrange(60)) * rng.randrange(2) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source, n_chars): copies, near copies, ties, nulls, empty and long texts."""
    rng = random.Random(7)
    base = [words(rng, rng.randrange(40, 160)) for _ in range(30)]
    out = [(i, "\n".join(t[k:k + 150] for k in range(0, len(t), 150)), "en", "hot" if i % 3 else f"s{i % 5}", len(t)) for i, t in enumerate(base)]
    out += [(100 + i, out[i % 3][1], "en", "hot", 1) for i in range(8)]
    out += [(200 + i, out[4][1].replace("alpha", "alphas", 1 + i % 2), "en", "hot", 1) for i in range(4)]
    out += [(300, None, None, None, None), (301, "", "", "", 0), (302, " \t\n ", "en", "hot", 4), (303, "ab\x0bcd one", "en", "s1", 9), (304, "x" * 300, "en", "s1", 300),
            (305, "<|endoftext|> special   gaps\n\n and ‘quotes’ 日本語 ", "en", "s1", 40), (306, words(rng, 9000), "en", "hot", 1), (None, out[0][1], "en", "hot", 1), (None, None, "en", "hot", 1)]
    return out


@pytest.fixture(scope="session")
def messy(spark, corpus):
    """The corpus with repeated rows left out and columns whose names clash with those the operators use inside."""
    df = spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string, n_chars long")
    for name in NAMES:
        df = df.selectExpr("*", f"'x' AS {name}")
    return df.repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
