"""Hand values and brute force for metrics, windows and cleaning."""
import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelweave.functions.expr import weekday_count
from panelweave.operators import clean, macro, matrix, merge, sequence, stats


def one(df):
    return df.collect()[0]


def test_constant_growth(series):
    m = one(stats.annualized_metrics(series({"A": [0.10 / 252] * 252})))
    assert m["cagr"] == pytest.approx(0.10, abs=0.01) and m["n"] == 252 and m["max_dd"] == 0.0


def test_total_loss_keeps_zero_curve(series):
    m = one(stats.annualized_metrics(series({"A": [0.1, -1.0, 0.5]})))
    assert m["cagr"] is None and m["max_dd"] == -1.0


def test_drawdown_peak_starts_at_first_point(series):
    assert one(stats.max_drawdown(series({"A": [-0.5, 0.1]})))["max_dd"] == 0.0


def test_beta_of_itself_and_guard(series):
    r = np.random.default_rng(1).normal(0, 0.01, 300)
    df = series({"A": r})
    b = df.select("date", "ret")
    assert one(stats.beta(df, b, "ticker"))["beta"] == pytest.approx(1.0)
    assert one(stats.beta(df, b, "ticker", 301))["beta"] is None


def test_var_and_calmar(series):
    r = np.random.default_rng(2).normal(0.0004, 0.01, 252)
    df = series({"A": r})
    assert one(stats.value_at_risk(df, "ticker"))["var"] == pytest.approx(np.quantile(r, 0.05))
    v = np.cumprod(1 + r)
    want = (v[-1] - 1) / abs((v / np.maximum.accumulate(v) - 1).min())
    assert one(stats.calmar(df, "ticker"))["calmar"] == pytest.approx(want)


def test_horizon_uses_all_when_short(series):
    rows = {r["horizon"]: r["n"] for r in stats.horizon_metrics(series({"A": [0.001] * 300}, key="portfolio_id")).collect()}
    assert rows == {"1y": 252, "3y": 300, "5y": 300, "10y": 300}


def test_robustness(series):
    steady = series({"A": np.cumprod([1.0004] * 300)}, value="value", key="portfolio_id")
    assert one(stats.robustness(steady))["robustness"] == pytest.approx(100.0)
    short = series({"A": [1.0] * 100}, value="value", key="portfolio_id")
    assert one(stats.robustness(short))["robustness"] == 50.0


def test_bootstrap_follows_its_draws(series):
    r = np.random.default_rng(3).normal(0, 0.01, 40)

    def draw(a, b):
        m = 1 << 32
        x = (a * 2654435761 + b * 2246822519 + 42) % m
        for shift, factor in ((16, 569420461), (15, 1935289751)):
            x = ((x ^ (x >> shift)) * factor) % m
        return (x ^ (x >> 15)) % 40

    stat = [np.prod([1 + r[draw(k, i)] for i in range(1, 41)]) ** (252 / 40) - 1 for k in range(300)]
    got = one(stats.bootstrap_interval(series({"A": r}), replicates=300))
    assert (got["lo"], got["hi"]) == pytest.approx(tuple(np.percentile(stat, [2.5, 97.5])))
    assert len({draw(7, i) for i in range(1, 41)}) < 40  # drawn with replacement


def test_anova_p_value_agrees_with_f(spark, series):
    r = np.random.default_rng(4).normal(0, 0.01, 90)
    df = series({"A": r})
    labels = df.select("date", F.concat(F.lit("g"), (F.dayofyear("date") % 3).cast("string")).alias("label"))
    t = one(stats.anova_p_value(df, labels, ["ticker"]))
    assert t["f"] == pytest.approx(one(stats.anova(df, labels, ["ticker"]))["f"])
    rng = np.random.default_rng(0)  # the tail, against simulated ratios of chi squares with the same degrees
    ratio = (rng.chisquare(2, 400_000) / 2) / (rng.chisquare(87, 400_000) / 87)
    assert t["p"] == pytest.approx(float((ratio > t["f"]).mean()), abs=0.004)


def test_covariance_tiles_and_gaps_match_pandas(series):
    rng = np.random.default_rng(5)
    data = {t: [x if rng.random() > 0.1 else None for x in rng.normal(0, 0.01, 120)] for t in "ABCDEFG"}
    wide = pd.DataFrame({t: pd.Series(xs, dtype=float) for t, xs in data.items()})
    want = wide.cov()
    for tiles in (1, 3):
        got = {(r["i"], r["j"]): r["value"] for r in matrix.covariance(series(data), annual=False, tiles=tiles).collect()}
        assert len(got) == 49
        for (i, j), v in got.items():
            assert v == pytest.approx(want.loc[i, j], rel=1e-9)
    corr = {(r["i"], r["j"]): r["value"] for r in matrix.correlation(series(data)).collect()}
    assert corr[("A", "B")] == pytest.approx(wide.corr().loc["A", "B"], rel=1e-9)


def test_shrinkage_formula(series):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 0.01, (80, 4))
    df = series({t: x[:, k] for k, t in enumerate("ABCD")})
    z = x - x.mean(0)
    n, p = z.shape
    s = z.T @ z / n
    m = np.trace(s) / p
    d = ((s - m * np.eye(p)) ** 2).sum() / p
    b = min(d, (((z ** 2).T @ (z ** 2)) / n - s ** 2).sum() / (p * n))
    want = 252 * ((1 - b / d) * s + b / d * m * np.eye(p))
    for r in matrix.shrunk_covariance(df).collect():
        assert r["value"] == pytest.approx(want["ABCD".index(r["i"]), "ABCD".index(r["j"])])


def test_rolling_drawdown_brute_force(series):
    r = np.random.default_rng(7).normal(0, 0.02, 60)
    got = [x["maxdd"] for x in sequence.rolling_drawdown(series({"A": r}), 10).orderBy("date").collect()]
    for i, g in enumerate(got):
        if i < 9:
            assert g is None
        else:
            c = np.cumprod(1 + r[i - 9:i + 1])
            assert g == pytest.approx((c / np.maximum.accumulate(c) - 1).min())


def test_returns_never_cross_a_panel_gap(series):
    df = series({"A": [100, None, 110, 121], "B": [10, 11, 12, 13]}, value="price")
    got = {(r["ticker"], r["date"].day): r["ret"] for r in clean.simple_returns(df).collect()}
    assert ("A", 2) not in got and ("A", 3) not in got
    assert got[("A", 4)] == pytest.approx(0.1) and len(got) == 4


def test_bounded_fill_stops_after_limit(series):
    df = series({"A": [1.0] + [None] * 8 + [2.0], "B": [1.0] * 12}, value="price")
    a = clean.bounded_fill(df).where("ticker = 'A'").collect()
    assert sorted(r["date"].day for r in a) == [1, 2, 3, 4, 5, 6, 10, 11, 12]


def test_overlap_preclean_brute_force(series):
    rng = np.random.default_rng(8)
    data = {t: [1.0 if rng.random() < q else None for _ in range(200)] for t, q in zip("ABCDEF", (1.0, 0.99, 0.97, 0.95, 0.6, 0.3))}
    wide = pd.DataFrame({t: pd.Series(x, dtype=float) for t, x in data.items()})
    ranked = sorted(data, key=lambda t: (-wide[t].notna().sum(), t))
    keep = ranked
    for n in range(len(ranked), 2, -1):
        w = wide[ranked[:n]].notna()
        if w.all(axis=1).sum() / w.any(axis=1).sum() >= 0.7:
            keep = ranked[:n]
            break
    got = {r["ticker"] for r in clean.overlap_preclean(series(data, value="price"), min_obs=20).where("kept").collect()}
    assert got == set(keep)


def test_winsorise_by_count(series):
    xs = list(range(1, 401))
    got = sorted(r["ret"] for r in clean.winsorise_by_count(series({"A": xs})).collect())
    assert got[:3] == [3, 3, 3] and got[-3:] == [398, 398, 398]


@pytest.mark.parametrize("a,b", [("2024-01-01", "2024-01-01"), ("2024-01-06", "2024-01-07"), ("1999-12-30", "2001-03-04"), ("1960-05-05", "1975-01-01")])
def test_weekday_count(spark, a, b):
    d = lambda s: F.lit(s).cast("date")
    got = spark.range(1).select(weekday_count(d(a), d(b)).alias("n")).collect()[0]["n"]
    assert got == len(pd.bdate_range(a, b))


def test_priority_union_and_upsert(spark):
    day = dt.date(2020, 1, 1)
    left = spark.createDataFrame([("A", day, 1.0)], "ticker string, date date, close double")
    right = spark.createDataFrame([("A", day, 2.0, 5.0), ("A", day + dt.timedelta(1), 3.0, 6.0)], "ticker string, date date, close double, volume double")
    got = [(r["close"], r["volume"]) for r in merge.priority_union([left, right]).orderBy("date").collect()]
    assert got == [(1.0, None), (3.0, 6.0)]
    assert [r["close"] for r in merge.upsert_newest(left, right.drop("volume")).orderBy("date").collect()] == [2.0, 3.0]


def test_xirr_known_rates(spark):
    d = dt.date
    rows = [(1, d(2020, 1, 1), -100.0), (1, d(2020, 12, 31), 110.0), (2, d(2020, 1, 1), -100.0), (2, d(2021, 1, 1), -5.0),
            (3, d(2020, 1, 1), -1000.0), (3, d(2022, 12, 31), 500.0)]
    got = {r["account_id"]: r["xirr"] for r in sequence.xirr(spark.createDataFrame(rows, "account_id int, date date, amount double")).collect()}
    assert got[1] == pytest.approx(0.10, abs=1e-6) and got[2] is None and got[3] == pytest.approx(0.5 ** (365 / 1095) - 1, abs=1e-6)


def test_dca_buys_on_last_row_of_month(series):
    curve = series({"P": [1.0] * 31 + [2.0] * 5}, value="value", key="portfolio_id")
    last = sequence.dca_value(curve, 100.0, 50.0).orderBy(F.desc("date")).first()
    assert last["invested"] == pytest.approx(250.0) and last["market_value"] == pytest.approx((50 + 100) * 2 + 100)


def test_current_regime_tie_is_alphabetical(spark):
    rows = [(dt.date(2020, 1, i + 1), x) for i, x in enumerate(["Tightening", "Disinflation"] * 5)]
    assert one(macro.current_regime(spark.createDataFrame(rows, "date date, regime string")))["regime"] == "Disinflation"


def test_cluster_labels_equal_plain_rounds(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (80, 5))
    days = [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(82)]
    rows = [(d, *map(float, r)) for d, r in zip(days, x)] + [(days[80], None, 0.0, 0.0, 0.0, 0.0)]
    f = spark.createDataFrame(rows, "date date, " + ", ".join(f"{c} double" for c in macro.FEATURES))
    at = {c: i for i, c in enumerate(macro.FEATURES)}
    order = np.lexsort((np.arange(80), x[:, at["cpi_yoy"]]))
    centres = np.array([x[run].mean(0) for run in np.array_split(order, 4)])
    while True:
        own = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        new = np.array([x[own == c].mean(0) for c in range(len(centres)) if (own == c).any()])
        if new.shape == centres.shape and np.allclose(new, centres, atol=1e-12):
            break
        centres = new
    u, d, y = (centres[:, at[c]] for c in ("unrate_6m_chg", "dgs10_6m_chg", "cpi_yoy"))
    names = np.where(u > 0.3, "Recessionary", np.where((d > 0.3) & (y > 0.3), "Tightening", np.where(y < -0.3, "Disinflation", "Risk-on")))
    got = {r["date"]: r["regime"] for r in macro.cluster_regimes(f).collect()}
    assert got == dict(zip(days, names[own])) and len(set(got.values())) > 1
    assert macro.cluster_regimes(f.limit(0)).collect() == []
