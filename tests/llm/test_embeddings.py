import numpy as np
import pytest

from panelweave.llm import embeddings as e

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, least):
    """All pairs of equal labels in double precision, then components."""
    ids, n, root = sorted(r[0] for r in rows), {}, {}
    good = {}
    for i, v, label in rows:
        n[i], root[i] = 0, i
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault((label, len(v)), []).append((i, np.array(v) / np.linalg.norm(v)))
    links = set()
    for group in good.values():
        m = np.array([v for _, v in group])
        links |= {(group[a][0], group[b][0]) for a, b in np.argwhere(m @ m.T >= least) if a < b}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(root[a], root[b])
            moved |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return [(i, n[i], root[i], i == root[i]) for i in ids]


def got(df, **limits):
    return sorted((tuple(r) for r in e.near_duplicate_vectors(df, **limits).select("vec_id", "n_links", "component_id", "kept").collect()), key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.fixture(scope="module")
def rows():
    """Random vectors, pairs and chains of near copies, exact copies, and one large group around one vector."""
    rng, out = np.random.default_rng(4), []
    base = rng.standard_normal((500, 32))
    out += [(i, v.tolist(), int(i % 3)) for i, v in enumerate(base)]
    for k in range(400):
        v = base[k % 90] + rng.standard_normal(32) * (0.02, 0.08, 0.12)[k % 3]
        out.append((1000 + k, v.tolist(), int((k % 90) % 3)))
    out += [(3000 + k, (base[7] * (1 + k)).tolist(), 1) for k in range(40)]
    out += [(4000 + k, (base[3] + rng.standard_normal(32) * 0.1).tolist(), 2) for k in range(700)]
    return [(int(i), v, label) for i, v, label in out]


def test_links_against_all_pairs(spark, rows, monkeypatch):
    want = plain(rows, 0.98)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS unit", "1 AS slot", "1 AS code", "'x' AS codes", "3 AS group", "4 AS root", "5 AS n").repartition(4)
    for chunk in (e.CHUNK, 100):
        monkeypatch.setattr(e, "CHUNK", chunk)  # 100: the large group is split
        have = got(df)
        assert [r[0] for r in have] == [r[0] for r in want]
        assert all(h[1] <= w[1] for h, w in zip(have, want, strict=True))
        assert sum(h[1] for h in have) >= 0.985 * sum(w[1] for w in want) > 200_000
        assert np.mean([h[2] == w[2] for h, w in zip(have, want, strict=True)]) > 0.99


def test_recall_at_the_least_cosine(spark):
    rng, out, least = np.random.default_rng(9), [], 0.98
    for k in range(1500):
        v, w = rng.standard_normal((2, 64))
        v /= np.linalg.norm(v)
        w -= w @ v * v
        w /= np.linalg.norm(w)
        out += [(2 * k, v.tolist(), 0), (2 * k + 1, (0.9802 * v + np.sqrt(1 - 0.9802**2) * w).tolist(), 0)]
    assert sum(r[1] for r in got(spark.createDataFrame(out, SCHEMA), least=least)) / 3000 >= 0.97


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (2, v, 0), (3, v, None), (4, None, 0), (5, [], 0), (6, [0.0, 0.0, 0.0], 0), (7, [1.0, None, 3.0], 0), (8, [1.0, nan, 3.0], 0), (9, [1.0, inf, 3.0], 0),
            (10, [1.0, 2.0], 0), (11, [1e300, 2e300, 3e300], 0), (12, [-1.0, -2.0, -3.0], 0), (13, v, 5)]
    want = plain([r for r in rows if r[0] != 11], 0.98)
    want = [(i, n + (i in (1, 2)), c, k) for i, n, c, k in want] + [(11, 2, 1, False)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == sorted(want)
    assert got(spark.createDataFrame([*rows, rows[0], (None, v, 0)], SCHEMA)) == [(None, 0, None, False), *sorted(want)]
    assert got(spark.createDataFrame([], SCHEMA)) == []
