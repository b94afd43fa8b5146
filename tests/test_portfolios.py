"""Constraints, filters, selection and composed runs on small hand-made inputs."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.functions import expr, fixed
from panelweave.functions.expr import literal_table
from panelweave.operators import blend, candidates as cand, investors, matrix, universe
from panelweave.plans import recommend
from panelweave.plans.views import Views
from panelweave.sources import landing
from panelweave.sources.catalog import objective_tables


def weights(spark, w, **extra):
    cols = "portfolio_id string, ticker string, weight double" + "".join(f", {k} string" for k in extra)
    return spark.createDataFrame([("P", t, float(x), *[e[t] for e in extra.values()]) for t, x in w.items()], cols)


def test_commodity_cap_is_kept(spark):
    cls = {"SPY": "equity", "GLD": "commodity", "DBC": "commodity", "TLT": "bond"}
    w = weights(spark, {"SPY": 0.40, "GLD": 0.20, "DBC": 0.15, "TLT": 0.25}, asset_class=cls)
    got = {r["ticker"]: r["weight"] for r in cand.redistribute_class_caps(w, fixed.CLASS_CAPS).collect()}
    assert sum(got.values()) == pytest.approx(1.0) and got["GLD"] + got["DBC"] <= 0.20 + 1e-9
    assert got["GLD"] / got["DBC"] == pytest.approx(0.20 / 0.15)


def test_core_satellite_limits(spark):
    tier = {"A": "core", "B": "core", "C": "satellite", "D": "satellite"}
    got = cand.constrain_core_satellite(weights(spark, {"A": 0.1, "B": 0.1, "C": 0.5, "D": 0.3}, tier=tier)).collect()
    w = {r["ticker"]: r["weight"] for r in got}
    assert sum(w.values()) == pytest.approx(1.0) and max(w["C"], w["D"]) <= 0.07 + 1e-9 and w["A"] + w["B"] >= 0.65


def test_violation_texts(spark):
    tier = {"A": "core", "B": "satellite"}
    got = cand.weight_violations(weights(spark, {"A": 0.5, "B": 0.6}, tier=tier), single_max=0.07).first()["violations"]
    assert got == ["Weights sum to 1.100000, expected 1.0", "Core allocation 50.0% below 65.0% minimum",
                   "Satellite allocation 60.0% above 35.0% maximum", "Satellite position B (60.0%) exceeds 7.0% cap"]


def test_risk_contributions_sum_to_volatility(spark, series):
    rng = np.random.default_rng(1)
    rets = series({t: rng.normal(0, 0.01, 100) for t in "ABC"})
    w = weights(spark, {"A": 0.5, "B": 0.3, "C": 0.2})
    got = blend.risk_contributions(w, matrix.as_rows(matrix.covariance(rets, annual=False))).collect()
    assert sum(r["risk_contribution"] for r in got) == pytest.approx(got[0]["portfolio_volatility"])


def test_selection_widens_once(spark):
    rows = [("u", 50.0, f"c{i}", v, c) for i, (v, c) in enumerate(zip((0.06, 0.10, 0.15, 0.176, 0.20), (0.05, 0.06, 0.08, 0.10, 0.12)))]
    df = spark.createDataFrame(rows, "user_id string, true_risk double, name string, volatility double, cagr double")
    sel = cand.select_for_risk(df)
    assert [r["name"] for r in sel.orderBy("rank").collect()] == ["c2", "c3", "c4"]
    assert cand.pick_by_slider(sel, F.lit(0.0)).first()["name"] == "c2"
    assert cand.pick_by_slider(sel, F.lit(1.0)).first()["name"] == "c4"


def test_near_duplicates_walk_by_score(spark):
    rows = [("g", n, t, w) for n, ws in {"a": (0.5, 0.5), "b": (0.501, 0.499), "c": (1.0, 0.0)}.items() for t, w in zip("XY", ws)]
    w = spark.createDataFrame(rows, "group_id string, name string, ticker string, weight double")
    scores = spark.createDataFrame([("g", "a", 1.0), ("g", "b", 2.0), ("g", "c", 0.5)], "group_id string, name string, score double")
    kept = cand.drop_near_duplicates(scores.join(cand.conflicts(w), ["group_id", "name"]), "group_id")
    assert {r["name"] for r in kept.collect()} == {"b", "c"}


def test_shock_texts(spark):
    specs = ["equity-10%", "rates+100bp", "gold+5%", " Bonds-0.02"]
    df = spark.createDataFrame([(s,) for s in specs], "spec string").withColumns(blend.parse_shock(F.col("spec")))
    got = [(r["target"], r["direction"], pytest.approx(r["magnitude"])) for r in df.collect()]
    assert got == [("equity", "-", 0.10), ("rates", "+", 0.01), ("gold", "+", 0.05), ("bonds", "-", 0.02)]


def test_duration_table_drives_rate_shock(spark, series):
    rets = series({"TLT": [0.02, 0.01], "SPY": [0.02, 0.01]})
    cls = spark.createDataFrame([("TLT", "treasury_long"), ("SPY", "public_equity")], "symbol string, class string")
    got = {(r["ticker"], r["date"].day): r["ret"] for r in blend.apply_shocks(rets, {"s": ["rates+100bp"]}, cls).collect()}
    assert got[("TLT", 1)] == pytest.approx(0.02 * (1 - 17 * 0.01)) and got[("TLT", 2)] == 0.01 and got[("SPY", 1)] == 0.02


def test_growth_band_is_continuous_and_rising(spark):
    df = spark.range(0, 1001).select((F.col("id") / 10).alias("r"))
    lo, hi = investors.growth_band("r")
    rows = df.select("r", lo.alias("lo"), hi.alias("hi")).orderBy("r").collect()
    steps = np.diff([r["lo"] for r in rows])
    assert (steps >= -1e-12).all() and steps.max() < 2e-4
    at = {r["r"]: (r["lo"], r["hi"]) for r in rows}
    assert at[50.0] == pytest.approx((0.08, 0.09)) and at[100.0] == pytest.approx((0.10, 0.11))


def test_objectives_for_risk(spark):
    objectives, _ = objective_tables(spark, fixed.OBJECTIVES)
    users = spark.createDataFrame([(1, 50.0, "BALANCED"), (2, 25.0, "AGGRESSIVE"), (3, 80.0, "NOPE")], "user_id int, true_risk double, objective string")
    rec = {r["user_id"]: r["objective"] for r in investors.recommend_objectives(users, objectives).where("rank = 1").collect()}
    assert rec == {1: "BALANCED", 2: "CONSERVATIVE", 3: "GROWTH"}
    fit = {r["user_id"]: (r["fit"], r["suggested"]) for r in investors.objective_fit(users, objectives).collect()}
    assert fit == {1: ("match", None), 2: ("mismatch", "CONSERVATIVE"), 3: ("mismatch", None)}


def test_searched_portfolio_is_the_best_sample(spark, series):
    rng = np.random.default_rng(2)
    rets = series({t: rng.normal(0.0003, s, 150) for t, s in zip("ABCD", (0.005, 0.01, 0.02, 0.03))})
    w = spark.createDataFrame([("P", t) for t in "ABCD"], "portfolio_id string, ticker string")
    from panelweave.operators import stats
    found = cand.searched_weights(w, matrix.as_rows(matrix.covariance(rets)), stats.geometric_return(rets), 200, bounds=(0.0, 1.0)).collect()
    vol = {r["optimizer"]: r["vol"] for r in found}
    assert vol["min_var"] == min(vol.values())
    low = {r["ticker"]: r["weight"] for r in found if r["optimizer"] == "min_var"}
    assert sum(low.values()) == pytest.approx(1.0) and low["A"] > low["D"]


@pytest.fixture(scope="module")
def market(spark, series):
    rng = np.random.default_rng(3)
    names = {"EQ1": ("public_equity", "equity", 0.010), "EQ2": ("public_equity_intl", "equity", 0.011), "BOND1": ("treasury_long", "bond", 0.004),
             "BOND2": ("corporate_bond", "bond", 0.005), "GOLD": ("gold", "commodity", 0.008), "CASH": ("tbills", "cash", 0.002)}
    rets = series({t: rng.normal(0.0005, s, 1300) for t, (_, _, s) in names.items()})
    cat = spark.createDataFrame([(t, c, a, "satellite" if a == "commodity" else "core", i) for i, (t, (c, a, _)) in enumerate(names.items())],
                                "symbol string, class string, asset_class string, core_or_satellite string, ordinal int")
    rows = [(i, 0, r, v - 0.02, v, v + 0.02, 0.05, 0.06, o) for i, (r, v, o) in enumerate([(20.0, 0.08, "CONSERVATIVE"), (50.0, 0.10, "BALANCED"), (99.0, 0.9, "GROWTH")])]
    users = spark.createDataFrame(rows, "user_id int, nation_key int, true_risk double, vol_min double, vol_target double, vol_max double, "
                                        "cagr_min double, cagr_target double, objective string")
    return rets, cat, users


def test_recommendation_never_empty_and_staged(market):
    rets, cat, users = market
    run = recommend.build_recommendations(users, rets, cat, samples=32)
    rows = run.recommended.collect()
    assert {r["user_id"] for r in rows} == {0, 1, 2}
    for r in rows:
        assert (r["fallback_level"] == 4) == r["hard_fallback"]
    hard = recommend.build_recommendations(users, rets, cat, cfg={"core_min_years": 99.0, "sat_min_years": 99.0}, samples=8)
    assert {r["original_fail_reason"] for r in hard.recommended.collect()} == {"hard_fallback_insufficient_assets"}


def test_objective_run_keeps_bands_or_falls_back(spark, market):
    rets, cat, users = market
    objectives, bands = objective_tables(spark, fixed.OBJECTIVES)
    out, run = recommend.build_recommendations_for_objectives(users, rets, cat, objectives, bands, methods=("equal_weight", "risk_parity"))
    rows = out.collect()
    assert {r["user_id"] for r in rows} == {0, 1, 2}
    for u in {r["user_id"] for r in rows}:
        flags = {r["in_bands"] for r in rows if r["user_id"] == u}
        assert len(flags) == 1  # either only portfolios inside the bands, or the unfiltered list


def test_candidate_run_respects_caps_and_distinctness(spark, market):
    rets, cat, _ = market
    regimes = rets.select("date").distinct().withColumn("regime", F.lit("Risk-on"))
    ranked, pool = recommend.candidate_run(rets, cat, regimes, objectives=("balanced",), n=5)
    rows = ranked.collect()
    assert 1 <= len(rows) <= 5 and [r["rank"] for r in sorted(rows, key=lambda r: r["rank"])] == list(range(1, len(rows) + 1))
    books = {}
    for r in pool.collect():
        books.setdefault(r["name"], {})[r["ticker"]] = r["weight"]
    chosen = [books[r["name"]] for r in rows]
    for w in chosen:
        assert sum(w.values()) == pytest.approx(1.0)
        assert w.get("EQ1", 0) + w.get("EQ2", 0) <= 0.65 + 1e-3
    vec = np.array([[w.get(t, 0.0) for t in ("EQ1", "EQ2", "BOND1", "BOND2", "GOLD", "CASH")] for w in chosen])
    unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
    sim = unit @ unit.T - np.eye(len(unit))
    assert sim.max() < 0.995


def test_ledger_of_filing_names(spark):
    paths = ["file:/s/AAA/10-K/0001_2020-03-01_full.txt", "file:/s/AAA/10_Q/x_2019-01-01.html", "file:/s/AAA/8-K/readme.txt", "file:/s/AAA/10-K/a_2020-05-01_b.pdf"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = [(r["symbol"], r["form"], r["filings"]) for r in landing.filings_summary(df, F.lit("2020-06-01").cast("date"), 365).collect()]
    assert got == [("AAA", "10-K", 1)]


def test_landed_files_with_plain_names(spark, tmp_path):
    (tmp_path / "spy.csv").write_text("Date,Open,High,Low,Close,Volume\n2020-01-02,1,2,0.5,1.5,10\nbad,1,1,1,1,1\n2020-01-03,,,,,5\n")
    got = landing.canonical_bars(landing.scan_price_files(spark, [str(tmp_path)])).collect()
    assert [(r["ticker"], str(r["date"]), r["adj_close"]) for r in got] == [("SPY", "2020-01-02", 1.5)]


def test_literal_table_is_broadcast(spark):
    big = spark.range(1000).withColumn("k", F.concat(F.lit("a"), F.col("id").cast("string")))
    plan = big.join(literal_table(spark, [("a", 1)], "k v"), "k")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_credibility_rounds_ties_as_its_sql(spark):
    # rows of sf0.1 whose score lies on a tie up to the last bits of a double, with the score of the SQL
    rows = [(2216, 11.0, 11.0, 14.0, 61.0), (5468, 13.0, 8.0, 30.0, 63.7), (7628, 17.0, 5.0, 25.0, 63.3)]
    df = spark.createDataFrame(rows, "u long, nation double, horizon double, slider double, want double")
    parts = investors.credibility_parts(F.col("u") * 3, F.col("nation") / 20, F.col("horizon") / 2, F.col("nation") / 3.0 / 4, F.col("slider") / 50)
    got = df.select("u", "want", *[c.alias(n) for n, c in parts.items()]).collect()
    assert {r["u"]: r["score"] for r in got} == {r["u"]: r["want"] for r in got}


def test_artifacts_are_compared_in_one_pass(spark, monkeypatch):
    monkeypatch.setattr(expr, "ROWS_A_TASK", 2)
    files = lambda names: spark.createDataFrame([(n,) for n in names], "name string")
    got = blend.compare_artifacts(files(["a", "a", "b"]), files(["b", "c", "c"]))
    assert sorted(tuple(r) for r in got.collect()) == [("a", "only_in_1"), ("b", "common"), ("c", "only_in_2")]
    assert got.rdd.getNumPartitions() == 3  # by the number of rows, not by their compressed size


def test_customer_weights_are_dealt_by_the_number_of_lines(spark, monkeypatch):
    monkeypatch.setattr(expr, "ROWS_A_TASK", 1000)
    v = Views(spark, "/root/testdata/sf0.001")
    w = v.customer_weights()
    assert w.rdd.getNumPartitions() == -(-v.table("lineitem").count() // 1000)
    assert w.groupBy("portfolio_id").agg(F.sum("weight").alias("s")).where("abs(s - 1) > 1e-9").isEmpty()
    assert w.groupBy("portfolio_id", "ticker").count().where("count > 1").isEmpty()


def plan(spark, capsys, build):
    """Plan of ``build()`` where nothing is small enough to be broadcast unless asked for."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        capsys.readouterr()
        build().explain()
        return capsys.readouterr().out
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_subsets_are_not_shuffled_by_ticker(spark, capsys):
    assert "SortMergeJoin" not in plan(spark, capsys, lambda: cand.sampled_subsets(weights(spark, {"A": 0.5, "B": 0.5}), ["v1", "v2"]))


def test_inverse_volatility_is_not_shuffled_by_ticker(spark, capsys):
    vols = spark.createDataFrame([("A", 0.1), ("B", 0.3)], "ticker string, ann_vol double")
    w = weights(spark, {"A": 0.5, "B": 0.5})
    assert "SortMergeJoin" not in plan(spark, capsys, lambda: cand.inverse_volatility(w, vols))
    assert {r["ticker"]: r["weight"] for r in cand.inverse_volatility(w, vols).collect()} == pytest.approx({"A": 0.75, "B": 0.25})


def test_receipt_texts_are_made_per_symbol_and_user(spark, capsys):
    q = spark.createDataFrame([("A", True, 9.0, 0.1, 0.5, 1.0, -0.1), ("B", True, 9.0, 0.1, 0.2, 1.0, -0.9)],
                              "ticker string, valid boolean, years double, cagr double, volatility double, sharpe double, max_drawdown double").withColumn("reason", F.lit(None).cast("string"))
    asked = spark.createDataFrame([("A",), ("B",), ("C",)], "symbol string")
    cat = spark.createDataFrame([("A", "equity", "core"), ("B", "bond", "core")], "symbol string, asset_class string, core_or_satellite string")
    users = spark.createDataFrame([(1, 0.1), (2, 1.0)], "user_id long, vol_max double")
    build = lambda: universe.asset_receipts(asked, q, cat, users, {"max_asset_vol_multiplier": 2.0, "max_asset_drawdown": -0.5})
    above = plan(spark, capsys, build).split("Generate")[0]
    assert "format_string" not in above  # nothing is formatted for each of users x symbols
    got = {(r["user_id"], r["symbol"]): r["fail_reason"] for r in build().collect()}
    drawdown = "excessive drawdown: -90.0% < -50.0%"
    assert got == {(1, "A"): "excessive volatility: 50.00% > 20.00%", (2, "A"): None, (1, "B"): drawdown, (2, "B"): drawdown,
                   (1, "C"): "not in returns data", (2, "C"): "not in returns data"}


def test_snapshot_joins_nothing(spark, capsys):
    w = spark.createDataFrame([("P", "A", 0.3), ("P", "B", -0.2), ("Q", "Z", 1.0), ("R", None, 1.0)], "portfolio_id string, ticker string, weight double")
    syms = spark.createDataFrame([("A",), ("B",), ("C",), ("A",)], "ticker string")
    assert "Join" not in plan(spark, capsys, lambda: blend.weight_snapshot(w, syms))
    got = {(r["portfolio_id"], r["ticker"]): r["weight"] for r in blend.weight_snapshot(w, syms).collect()}
    assert got == {**{("P", t): x for t, x in zip("ABC", (1.0, 0.0, 0.0))}, **{(p, t): 0.3333 for p in "QR" for t in "ABC"}}


def test_class_bands_need_one_pass_by_portfolio(spark, capsys):
    rows = [("P", "x", "equity", 0.9), ("P", "x", "bond", 0.1), ("Q", "x", "equity", 0.5), ("Q", "x", "bond", 0.3), ("Q", "x", None, 0.2), ("R", "x", None, 1.0), ("S", "none", "equity", 1.0)]
    w = spark.createDataFrame(rows, "portfolio_id string, objective string, asset_class string, weight double")
    bands = spark.createDataFrame([("x", 1, "equity", 0.2, 0.6), ("x", 0, "bond", 0.2, 0.5)], "name string, band_order int, asset_class string, band_min double, band_max double")
    assert "SortMergeJoin" not in plan(spark, capsys, lambda: cand.class_band_check(w, bands))
    got = {r["portfolio_id"]: (r["passed"], r["fail_reason"]) for r in cand.class_band_check(w, bands).collect()}
    assert got == {"P": (False, "bond weight 10.0% < min 20.0%"), "Q": (True, None), "R": (False, "bond weight 0.0% < min 20.0%")}
