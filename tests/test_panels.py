"""Block products against plain loops, and window summaries against recomputed windows."""
import math
import random
import statistics

import pytest

from panelweave.operators import blend, matrix, panels, sequence

DAYS = [f"2024-{m:02d}-{d:02d}" for m in range(1, 7) for d in range(1, 29)]


@pytest.fixture(scope="module")
def panel():
    rng = random.Random(11)
    rets = {(t, d): rng.choice((None, rng.gauss(0, 0.02), rng.gauss(0, 0.02), rng.gauss(0, 0.02))) for t in "ABCDEFG" for d in DAYS if rng.random() < 0.9}
    rets |= {("ALL" + str(i), d): rng.gauss(0, 0.01) for i in range(3) for d in DAYS}
    books = {f"p{i}": {t: rng.uniform(-0.2, 1) for t in rng.sample([*"ABCDEFG", "ALL0", "ALL1", "ALL2", "NONE"], rng.randrange(1, 6))} for i in range(40)}
    books |= {"full": {"ALL0": 0.5, "ALL1": 0.3, "ALL2": 0.2}, "none": {"NONE": 1.0}}
    return rets, books


@pytest.fixture(params=[1024, 7])
def frames(spark, panel, monkeypatch, request):
    monkeypatch.setattr(panels, "CHUNK", request.param)  # 7: several chunks of 40 portfolios (four a ticker)
    rets, books = panel
    r = spark.createDataFrame([(t, d, v) for (t, d), v in rets.items()], "ticker string, d string, ret double").selectExpr("ticker", "to_date(d) AS date", "ret", "'x' AS names", "1 AS chunk")
    w = spark.createDataFrame([(p, t, x) for p, b in books.items() for t, x in b.items()], "portfolio_id string, ticker string, weight double").selectExpr("*", "'x' AS kind", "2 AS values")
    return rets, books, r.repartition(4), w.repartition(3)


def close(got, want):
    assert got.keys() == want.keys()
    for k in got:
        assert (got[k] is None) == (want[k] is None) and (got[k] is None or math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-12)), k


def test_daily_sums(frames):
    rets, books, r, w = frames
    plain, spread = {}, {}
    for p, b in books.items():
        for d in DAYS:
            rows = [(x, rets[t, d]) for t, x in b.items() if (t, d) in rets]
            live = [(x, v) for x, v in rows if v is not None]
            if rows:
                plain[p, d] = sum(x * v for x, v in live) if live else None
            if live:
                total = sum(max(x, 0) for x, _ in live)
                spread[p, d] = sum(max(x, 0) * v for x, v in live) / total if total else 0.0
    close({(x.portfolio_id, str(x.date)): x.ret for x in blend.portfolio_returns(r, w).collect()}, plain)
    close({(x.portfolio_id, str(x.date)): x.ret for x in blend.renormalised_returns(r, w).collect()}, spread)


def test_portfolio_metrics(frames):
    rets, books, r, w = frames
    got = {x.portfolio_id: x for x in blend.portfolio_metrics(w, r).collect()}
    known = {t for t, _ in rets}
    for p, b in books.items():
        held = {t: x for t, x in b.items() if t in known}
        if not held:
            assert p not in got
            continue
        total = sum(held.values())
        days = [d for d in DAYS if all(rets.get((t, d)) is not None for t in held)]
        series = [sum(x / total * rets[t, d] for t, x in held.items()) for d in days]
        curve, v = [], 1.0
        for x in series:
            v *= 1 + x
            curve.append(v)
        x = got[p]
        assert x.num_holdings == sum(y / total > 1e-4 for y in held.values())
        if len(days) < 2 or min(curve[0], curve[-1]) <= 0:
            assert not x.valid
            continue
        vol = statistics.stdev(series) * math.sqrt(252)
        fall = min(c / max(curve[:i + 1]) - 1 for i, c in enumerate(curve))
        weighted = sum(y / total * statistics.stdev([rets[t, d] for d in days]) * math.sqrt(252) for t, y in held.items())
        for a, e in ((x.volatility, vol), (x.max_drawdown, fall), (x.total_return, curve[-1] - 1), (x.diversification_ratio, weighted / vol), (x.cagr, (curve[-1] / curve[0]) ** (252 / len(days)) - 1)):
            assert math.isclose(a, e, rel_tol=1e-7, abs_tol=1e-10), (p, a, e)


def test_risk_contributions(frames):
    _, books, r, w = frames
    cov = {(x.i, x.j): x.value for x in matrix.covariance(r.select("ticker", "date", "ret"), annual=False).collect()}
    known, want = {i for i, _ in cov}, {}
    for p, b in books.items():
        held = {t: x for t, x in b.items() if t in known}
        part = {t: x * sum(y * cov.get((t, o), 0.0) for o, y in held.items()) * 252 for t, x in held.items()}
        var = sum(part.values())
        want |= {(p, t): v / math.sqrt(var) if var > 0 else 0.0 for t, v in part.items()}
    long = matrix.covariance(r.select("ticker", "date", "ret"), annual=False)
    for form in (long, matrix.as_rows(long)):
        close({(x.portfolio_id, x.ticker): x.risk_contribution for x in blend.risk_contributions(w, form, 252.0).collect()}, want)


def test_empty_sides(spark, frames):
    _, _, r, w = frames
    assert blend.portfolio_returns(r, w.limit(0)).count() == 0 and blend.portfolio_returns(r.limit(0), w).count() == 0
    assert blend.portfolio_metrics(w, r.limit(0)).count() == 0


@pytest.mark.parametrize("window,need", [(1, None), (5, None), (5, 2), (40, 10)])
def test_rolling_drawdown(spark, window, need):
    rng = random.Random(window)
    data = {t: [rng.gauss(0, 0.05) for _ in range(n)] for t, n in (("A", 83), ("B", 40), ("C", 4), ("D", 1))}
    rows = [(t, DAYS[i], x) for t, v in data.items() for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "ticker string, d string, ret double").selectExpr("ticker", "to_date(d) AS date", "ret")
    want = {}
    for t, v in data.items():
        curve = [math.prod(1 + x for x in v[:i + 1]) for i in range(len(v))]
        for i in range(len(v)):
            part = curve[max(0, i + 1 - window):i + 1]
            want[t, DAYS[i]] = min(c / max(part[:j + 1]) - 1 for j, c in enumerate(part)) if len(part) >= (need or window) else None
    close({(x.ticker, str(x.date)): x.maxdd for x in sequence.rolling_drawdown(df, window, need).collect()}, want)
