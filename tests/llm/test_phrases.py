import random
import re
from collections import Counter

import numpy as np

from panelweave.llm import phrases as p


def plain(rows, least, longest, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i:i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    big, out = {g: a for g, a in f.items() if a >= least}, {}
    inside = {(g[0], *g[i:j], a) for g, a in big.items() for i in range(1, len(g)) for j in range(i + 1, len(g) + 1) if j - i < len(g) - 1}
    for g, a in big.items():
        lang, *w = g
        if len(w) > 1 and (*g, a) not in inside:
            cuts = [(1000 * a * n[lang] // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    return sorted((lang, i + 1, t.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for i, (s, a, t, left, right) in enumerate(sorted(rows)[:top]))


def got(df, **limits):
    return sorted(tuple(r) for r in p.collocations(df, **limits).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_collocations(spark, messy, corpus):
    rng = random.Random(2)
    more = [(lang, " ".join(rng.choice(("Red", "blue,", "green", "ROT\tblau", "ünder", "to be", "or not; to be")) for _ in range(rng.randrange(300)))) for lang in ("en", "en", "de", None, "und", "fr") for _ in range(9)]
    more += [("xx", None), ("yy", ""), (None, "\x00 \x0b a\x00b " * 40), ("en", "go on " * 30000)]
    df = messy.unionByName(spark.createDataFrame(more, "lang string, text string"), allowMissingColumns=True).selectExpr("*", "1 AS a", "'x' AS phrase", "'x' AS length", "2 AS k")
    rows = [(r[2], r[1]) for r in corpus] + more
    for least, longest, top in ((5, 5, 2000), (12, 3, 7), (8, 2, 50)):
        want = plain(rows, least, longest, top)
        assert got(df, least=least, longest=longest, top=top) == want and want


def test_empty(spark, empty):
    assert got(empty) == []
    assert got(spark.createDataFrame([(None, None), ("en", "")], "lang string, text string"), least=1) == []


def test_summaries_keep_all_that_is_frequent():
    rng = np.random.default_rng(5)
    for least in (20, 50, 100):
        stream = rng.zipf(1.3, 60000) % 5000
        batches = np.array_split(stream, 40)
        s = p.MisraGries(len(stream) // least + 1)
        for b in batches:
            s.merge(*p.combined(b.astype(np.uint64), np.ones(len(b), np.int64)))
            assert len(s.n) <= s.capacity
        h, n = np.unique(stream, return_counts=True)
        assert set(h[n >= least].tolist()) <= set(s.possible(least).tolist()) and s.short < least and s.short > 0
