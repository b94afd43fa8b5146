"""Universes by step, searches and look-back covariances against plain loops; recommended rows hold whole portfolios."""
import datetime as dt
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.operators import blend, candidates as cand, matrix, panels, universe
from panelweave.plans import recommend

DAYS = [f"2023-{m:02d}-{d:02d}" for m in range(1, 13) for d in range(1, 29)]


def test_universes_by_step_equal_receipts(spark):
    rng = random.Random(8)
    vols = [0.1, 0.2, 0.2, 0.35, 0.05, None, 0.5, 0.8]
    quality = [(f"S{i}", i != 6, None, rng.choice((12.0, 12.0, 1.0)), 0.05, v, 0.5, -0.1) for i, v in enumerate(vols)]
    q = spark.createDataFrame(quality, "ticker string, valid boolean, reason string, years double, cagr double, volatility double, sharpe double, max_drawdown double")
    asked = spark.createDataFrame([(f"s{i}",) for i in range(9)], "symbol string")
    catalog = spark.createDataFrame([(f"S{i}", "equity", "core") for i in range(8)], "symbol string, asset_class string, core_or_satellite string")
    users = spark.createDataFrame([(i, v) for i, v in enumerate([None, 0.0, 0.049, 0.05, 0.1, 0.15, 0.2, 0.21, 0.35, 0.5, 3.0])], "user_id int, vol_max double")
    cfg = {"max_asset_vol_multiplier": 1.0, "core_min_years": 5.0, "max_asset_drawdown": -0.5, "min_asset_sharpe": 0.0}
    eligible = universe.eligible_assets(asked, q, catalog, cfg)
    placed = universe.with_volatility_step(users, eligible, F.col("vol_max") * 1.0)
    got = {r.user_id: r.symbols for r in placed.join(universe.volatility_universes(eligible), "step", "left").select("user_id", "symbols").collect()}
    want = {r.user_id: sorted(r.s) for r in universe.asset_receipts(asked, q, catalog, users, cfg).groupBy("user_id").agg(
        F.collect_list(F.when(F.col("passed"), F.col("symbol"))).alias("s")).collect()}
    assert {u: s or [] for u, s in got.items()} == want and len({tuple(s) for s in want.values()}) > 3


@pytest.fixture(scope="module")
def rets(spark):
    rng = random.Random(4)
    rows = [(t, d, rng.gauss(0.0004, 0.01 * (1 + i))) for i, t in enumerate("ABCDEF") for d in DAYS if rng.random() < (1, 1, 0.9, 0.8, 1, 1)[i] and not (t == "F" and d > "2023-03")]
    return rows, spark.createDataFrame(rows, "ticker string, d string, ret double").selectExpr("ticker", "to_date(d) AS date", "ret")


def test_lookback_covariance(rets):
    rows, df = rets
    days = sorted({d for _, d, _ in rows}, reverse=True)
    age = df.join(df.select("date").distinct().selectExpr("date", "row_number() OVER (ORDER BY date DESC) AS _age"), "date")
    got = {(r.lookback, r.i, r.j): r.value for r in matrix.lookback_covariance(age, [20, 100, 100000]).collect()}
    by = {t: {d: x for u, d, x in rows if u == t} for t in "ABCDEF"}
    for look in (20, 100, 100000):
        live = set(days[:look])
        for a in by:
            for b in by:
                both = sorted(by[a].keys() & by[b].keys() & live)
                if len(both) > 1:
                    want = statistics.covariance([by[a][d] for d in both], [by[b][d] for d in both]) * 252
                    assert math.isclose(got[look, a, b], want, rel_tol=1e-7, abs_tol=1e-12)


@pytest.mark.parametrize("cells", [4 << 20, 9])
def test_search_against_plain(spark, rets, monkeypatch, cells):
    monkeypatch.setattr(panels, "TILE_CELLS", cells)  # 9: the matrix is cut into tiles
    _, df = rets
    cov = matrix.covariance(df)
    mu = spark.createDataFrame([(t, 0.02 * i) for i, t in enumerate("ABCDEF")], "ticker string, ann_return double")
    books = {"one": "A", "two": "BD", "five": "ABCDE", "six": "ABCDEF", "half": "BCE"}
    held = spark.createDataFrame([(g, t) for g, ts in books.items() for t in ts], "portfolio_id string, ticker string")
    value = {(r.i, r.j): r.value or 0.0 for r in cov.collect()}
    gain = {r.ticker: r.ann_return for r in mu.collect()}
    m, ords = 4294967296, {t: i + 1 for i, t in enumerate("ABCDEF")}

    def draw(a, b, seed):
        x = (a * 2654435761 + b * 2246822519 + seed) % m
        for shift, factor in ((16, 569420461), (15, 1935289751)):
            x = ((x ^ (x >> shift)) * factor) % m
        return x ^ (x >> 15)

    def shares(size, lo, hi):
        n, fixed_ = len(size), set()
        if n * hi < 1:
            return {t: 1 / n for t in size}
        while True:  # water filling: what passes the high is set to it, the others share the rest
            room, total = 1 - n * lo - len(fixed_) * (hi - lo), sum(v for t, v in size.items() if t not in fixed_)
            over = {t for t, v in size.items() if t not in fixed_ and v * room > (hi - lo) * total * (1 + 1e-12)}
            if not over:
                return {t: hi if t in fixed_ else lo + v * room / total for t, v in size.items()}
            fixed_ |= over

    got = {(r.portfolio_id, r.optimizer, r.ticker): r for r in cand.searched_weights(held, cov, mu, 60, 0.01, 0.2, (0.05, 0.4)).collect()}
    assert len(got) == 3 * sum(map(len, books.values()))
    for g, names in books.items():
        made = []
        for s in range(60):
            w = shares({t: ((draw(s, ords[t], 42) % 1000 + 1) / 1000) ** 2 for t in names}, 0.05, 0.4)
            vol = math.sqrt(max(sum(w[a] * w[b] * value.get((a, b), 0.0) for a in names for b in names), 0.0))
            made.append((w, sum(w[t] * gain[t] for t in names), vol))
        rank = {"min_var": lambda x: -x[2], "max_sharpe": lambda x: (x[1] - 0.01) / x[2], "efficient_risk": lambda x: x[1] if x[2] <= 0.2 else -x[2] - 1000}
        for name, f in rank.items():
            best = max(map(f, made))
            w = {t: got[g, name, t].weight for t in names}
            r = got[g, name, names[0]]
            assert math.isclose(sum(w.values()), 1, rel_tol=1e-9) and math.isclose(f((w, r.ret, r.vol)), best, rel_tol=1e-9)
            assert all(math.isclose(w[t], made[r.sample][0][t], rel_tol=1e-9) for t in names)


def test_recommended_rows_hold_whole_portfolios(spark, rets):
    _, df = rets
    catalog = spark.createDataFrame([(t, c, "core") for t, c in zip("ABCDEF", ("equity", "bond", "cash", "equity", "bond", "reit"))], "symbol string, asset_class string, core_or_satellite string")
    users = spark.createDataFrame([(i, 50.0, 0.0, 0.1, v, 0.0, 0.05, "BALANCED") for i, v in enumerate((0.02, 0.2, 0.3, 5.0))], "user_id int, true_risk double, vol_min double, "
                                  "vol_target double, vol_max double, cagr_min double, cagr_target double, objective string")
    cfg = {"core_min_years": 0.2, "min_asset_sharpe": -9.0, "max_asset_drawdown": -1.0, "max_asset_vol_multiplier": 1.0, "max_risk_contribution": 1.0, "min_diversification_ratio": 0.0}
    run = recommend.build_recommendations(users, df, catalog, cfg=cfg, samples=16)
    rows = {(r.user_id, r.rank): r for r in run.recommended.collect()}
    held = {}
    for r in run.recommended_weights.collect():
        held.setdefault((r.user_id, r.rank), []).append(r)
    assert {u for u, _ in rows} == {0, 1, 2, 3} and held.keys() == rows.keys()
    for key, parts in held.items():
        assert math.isclose(sum(p.weight for p in parts), 1, rel_tol=1e-9) and len({p.ticker for p in parts}) == len(parts)
        assert all(p.asset_class in ("equity", "bond", "cash", "reit") for p in parts)
        row = rows[key]
        assert row.optimizer and row.volatility is not None and row.num_holdings
        if row.hard_fallback:
            assert row.optimizer == "equal_weight" and all(math.isclose(p.weight, row.sat_cap) and p.risk_contribution is None for p in parts)
        else:
            assert math.isclose(sum(p.risk_contribution for p in parts), row.volatility, rel_tol=0.2)
    poor = [k for k in rows if k[0] == 0]
    assert [rows[k].original_fail_reason for k in poor] == ["hard_fallback_insufficient_assets"] and sorted(p.ticker for p in held[poor[0]]) == ["A", "B", "C"]


def test_candidate_run_has_searched_methods(spark, rets):
    _, df = rets
    catalog = spark.createDataFrame([(t, c, a) for t, c, a in zip("ABCDEF", ("public_equity", "treasury_long", "tbills", "gold", "corporate_bond", "reit"), ("equity", "bond", "cash", "commodity", "bond", "reit"))],
                                    "symbol string, class string, asset_class string")
    regimes = df.select("date").distinct().withColumn("regime", F.lit("Risk-on"))
    ranked, pool = recommend.candidate_run(df, catalog, regimes, objectives=("balanced", "growth"), samples=20)
    made = {r.optimizer for r in pool.select("optimizer").distinct().collect()} if "optimizer" in pool.columns else {n.split(" - ")[0].lower() for n in (r.name for r in pool.select("name").distinct().collect())}
    assert {"max_sharpe", "min_var"} <= made and ranked.count() > 0
    assert all(math.isclose(r.w, 1, rel_tol=1e-6) for r in pool.groupBy("group_id", "name").agg(F.sum("weight").alias("w")).collect())


def test_scenarios_by_changes_equal_the_copied_panel(spark):
    rng = np.random.default_rng(4)
    days = [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(40)]
    panel = {(t, d): float(rng.normal(0, 0.02)) for t in ("AAA", "BBB", "CCC", "DDD") for d in days if not (t == "CCC" and d < days[5]) and not (t == "DDD" and d > days[0])}
    rets = spark.createDataFrame([(t, d, x) for (t, d), x in panel.items()], "ticker string, date date, ret double")
    kinds = [("AAA", "public_equity", "equity"), ("BBB", "treasury_long", "bonds"), ("CCC", "gold", "gold"), ("DDD", "public_equity", "equity")]
    classes = spark.createDataFrame(kinds, "symbol string, class string, asset_class string")
    scenarios = {"none": ["gold-5%"], "crash": ["equity-50%", "rates+100bp"]}
    shocked = {}
    for r in blend.apply_shocks(rets, scenarios, classes).collect():
        shocked.setdefault((r.scenario_id, r.ticker), {})[r.date] = r.ret
    day = blend.shocked_day(rets, scenarios, classes)
    vols = {(r.scenario_id, r.ticker): r.ann_vol for r in blend.shocked_volatility(rets, day, scenarios).collect()}
    want = {k: np.std(list(x.values()), ddof=1) * 252 ** 0.5 if len(x) > 1 else None for k, x in shocked.items()}
    assert vols == {k: x if x is None else pytest.approx(x) for k, x in want.items()}
    ranked, w, horizons = recommend.scenario_candidates(rets, classes, scenarios, regime=F.lit("Recessionary"), threshold=2.0)
    held = {}
    for r in w.collect():
        held.setdefault((r.scenario_id, r.optimizer), {})[r.ticker] = r.weight
    tilt = {"AAA": 0.95, "BBB": 1.05, "CCC": 1.02, "DDD": 0.95}
    assert held["crash", "equal_weight"] == pytest.approx({t: x / sum(tilt.values()) for t, x in tilt.items()})
    rows = ranked.collect()
    assert {(r.scenario_id, r.portfolio_id.split("#")[1]) for r in rows} == set(held) and len(rows) == 6
    for r in rows:
        mine = held[r.scenario_id, r.portfolio_id.split("#")[1]]
        curve = np.cumprod([1 + sum(x * shocked[r.scenario_id, t].get(d, 0.0) for t, x in mine.items()) for d in days])
        assert r.cagr == pytest.approx(curve[-1] ** (252 / 40) - 1) and r.max_dd == pytest.approx(min(curve / np.maximum.accumulate(curve) - 1))
        assert r.score == pytest.approx(r.sharpe - 0.2 * abs(r.max_dd))
    assert horizons.count() == 6 * 4
    few = recommend.scenario_candidates(rets, classes, scenarios, threshold=-1.0)[0].collect()
    assert [r["rank"] for r in few] == [1, 1] and all(r.shortlist for r in few)
    assert recommend.scenario_candidates(rets.limit(0), classes, scenarios)[0].count() == 0
    with pytest.raises(ValueError):
        recommend.scenario_candidates(rets, classes, scenarios, methods=("max_sharpe",))
