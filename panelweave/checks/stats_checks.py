"""A family: metrics, coverage, tests, report tables."""
from pyspark.sql import functions as F

from ..functions.expr import choose, mod
from ..operators import blend, clean, macro, matrix, merge, stats
from .ctes import CTES
from .registry import check

# ---- shared SQL -------------------------------------------------------------------------------
CTES["t_port"] = "SELECT portfolio_id, date, sum(weight * ret) AS ret FROM t_books JOIN t_ret USING (ticker) GROUP BY 1, 2"
CTES["t_portc"] = "SELECT portfolio_id, date, sum(weight * ret) AS ret FROM t_booksc JOIN t_retc USING (ticker) GROUP BY 1, 2"


def curve_sql(src: str, key: str) -> str:
    return f"SELECT *, product(1 + ret) OVER (PARTITION BY {key} ORDER BY date) AS value FROM {src}"


def facts_sql(src: str, key: str) -> str:
    return f"""SELECT {key}, count(*) AS n, arg_min(value, date) AS v0, arg_max(value, date) AS v1, avg(ret) AS mean, stddev_samp(ret) AS sd,
      min(dd) AS max_dd, min(date) AS start, max(date) AS "end" FROM (
        SELECT *, value / max(value) OVER (PARTITION BY {key} ORDER BY date) - 1 AS dd FROM ({curve_sql(src, key)})) GROUP BY {key}"""


def annual_sql(src: str, key: str, rf: float = 0.0, where: str = "") -> str:
    return f"""SELECT *, (cagr - {rf}) / nullif(volatility, 0) AS sharpe FROM (
      SELECT *, CASE WHEN v1 > 0 THEN v1 ** (252.0::DOUBLE / n) - 1 END AS cagr, sd * sqrt(252) AS volatility FROM ({facts_sql(src, key)}) {where})"""


CTES["t_facts"] = facts_sql("t_ret", "ticker")
CTES["t_pfacts"] = facts_sql("t_port", "portfolio_id")
CTES["t_pannual"] = annual_sql("t_port", "portfolio_id")
CTES["t_curve"] = curve_sql("t_port", "portfolio_id")
BENCH = "(SELECT date, ret AS b FROM t_retc WHERE ticker = 'AMERICA')"


def port(v):
    return blend.portfolio_returns(v.returns, v.books)


def portc(v):
    return blend.portfolio_returns(v.returns_class, v.books_class)


def bench(v):
    return v.returns_class.where("ticker = 'AMERICA'")


AM = "cagr~ volatility~ sharpe~ max_dd~ n# start@ end@"
check("a01_annualized_metrics", "ticker " + AM, lambda v: stats.annualized_metrics(v.returns, rf=0.02), annual_sql("t_ret", "ticker", 0.02))
check("a01_portfolio_metrics", "portfolio_id " + AM, lambda v: stats.annualized_metrics(port(v), "portfolio_id"), "SELECT * FROM t_pannual")

check("a02_quality_metrics", "ticker valid? reason years~ cagr~ volatility~ sharpe~ max_drawdown~ total_return~",
      lambda v: stats.quality_metrics(v.returns),
      """SELECT ticker, n >= 2 AS valid, CASE WHEN n < 2 THEN 'insufficient data' END AS reason, n / 252.0::DOUBLE AS years,
      (v1 / v0) ** (252.0::DOUBLE / n) - 1 AS cagr, sd * sqrt(252) AS volatility,
      coalesce(((v1 / v0) ** (252.0::DOUBLE / n) - 1 - 0.015) / nullif(sd * sqrt(252), 0), 0) AS sharpe, max_dd AS max_drawdown, v1 - 1 AS total_return FROM t_facts""")
check("a03_geometric_return", "ticker ann_return~", lambda v: stats.geometric_return(v.returns),
      "SELECT ticker, product(1 + ret) ** (252.0::DOUBLE / count(*)) - 1 AS ann_return FROM t_ret GROUP BY 1")
check("a04_annual_volatility", "ticker ann_vol~", lambda v: stats.annual_volatility(v.returns),
      "SELECT ticker, stddev_samp(ret) * sqrt(252) AS ann_vol FROM t_ret GROUP BY 1")
check("a05_max_drawdown", "portfolio_id max_dd~", lambda v: stats.max_drawdown(port(v), "portfolio_id"), "SELECT portfolio_id, max_dd FROM t_pfacts")
check("a06_arithmetic_sharpe", "ticker sharpe~", lambda v: stats.sharpe(v.returns, rf=0.015),
      "SELECT ticker, (avg(ret) - 0.015::DOUBLE / 252) * 252 / (stddev_samp(ret) * sqrt(252)) AS sharpe FROM t_ret GROUP BY 1")
CTES["t_bundle"] = """SELECT portfolio_id, v1 ** (252.0::DOUBLE / n) - 1 AS ann_return, sd * sqrt(252) AS ann_vol,
  (mean - 0.015::DOUBLE / 252) * 252 / (sd * sqrt(252)) AS sharpe, max_dd, n AS n_obs FROM t_pfacts"""
check("a07_risk_bundle", "portfolio_id ann_return~ ann_vol~ sharpe~ max_dd~ n_obs# n_assets#",
      lambda v: stats.risk_bundle(port(v), assets=v.books),
      "SELECT * FROM t_bundle JOIN (SELECT portfolio_id, count(DISTINCT ticker) AS n_assets FROM t_books GROUP BY 1) USING (portfolio_id)")
check("a08_backtest_summary", "portfolio_id cagr~4 vol~4 sharpe~2 max_dd~4 n#", lambda v: stats.backtest_summary(port(v)),
      "SELECT portfolio_id, ann_return AS cagr, ann_vol AS vol, sharpe, max_dd, n_obs AS n FROM t_bundle")

check("a09_quick_metrics", "portfolio_id cagr~4 max_dd~4 sharpe~2",
      lambda v: stats.quick_metrics(stats.equity_curve(port(v), "portfolio_id"), 3),
      """SELECT portfolio_id, (arg_max(value, date) / arg_min(value, date)) ** (1.0::DOUBLE / 3) - 1 AS cagr, min(dd) AS max_dd,
        avg(r) * 252 / (stddev_samp(r) * sqrt(252)) AS sharpe FROM (
        SELECT *, value / max(value) OVER w - 1 AS dd, value / lag(value) OVER w - 1 AS r FROM (
          SELECT * FROM t_curve QUALIFY date > max(date) OVER (PARTITION BY portfolio_id) - 1095) WINDOW w AS (PARTITION BY portfolio_id ORDER BY date)) GROUP BY 1""")

CTES["t_hor"] = """SELECT portfolio_id, horizon, date, ret FROM (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY date DESC) AS rn FROM t_port)
  JOIN (VALUES ('1y', 252), ('3y', 756), ('5y', 1260), ('10y', 2520)) h(horizon, days) ON rn <= days"""
check("a10_horizon_metrics", "portfolio_id horizon " + AM, lambda v: stats.horizon_metrics(port(v)), annual_sql("t_hor", "portfolio_id, horizon"))

CTES["t_lb"] = """SELECT portfolio_id, w AS win, date, ret FROM (SELECT *, max(date) OVER (PARTITION BY portfolio_id) AS last FROM (
    SELECT * FROM t_portc UNION ALL SELECT 'BENCH', date, ret FROM t_retc WHERE ticker = 'AMERICA'))
  JOIN (VALUES ('full', 99999), ('1y', 365), ('5y', 1825)) h(w, days) ON date >= last - days"""
check("a11_lookback_metrics", "portfolio_id window cagr~ max_dd~ sharpe~",
      lambda v: stats.lookback_metrics(portc(v).unionByName(bench(v).select(F.lit("BENCH").alias("portfolio_id"), "date", "ret"))),
      f"""SELECT portfolio_id, win AS "window", v1 ** (252.0::DOUBLE / n) - 1 AS cagr, max_dd, mean / sd * sqrt(252) AS sharpe
      FROM ({facts_sql("t_lb", "portfolio_id, win")})""")

check("a12_beta", "portfolio_id beta~", lambda v: stats.beta(port(v), bench(v)),
      f"""SELECT portfolio_id, CASE WHEN count(*) >= 252 THEN covar_samp(ret, b) / var_samp(b) END AS beta FROM t_port JOIN {BENCH} USING (date) GROUP BY 1""")
check("a12_beta_overlap_guard", "ticker beta~", lambda v: stats.beta(v.returns, bench(v), "ticker", 700),
      f"""SELECT ticker, CASE WHEN count(*) >= 700 THEN covar_samp(ret, b) / var_samp(b) END AS beta FROM t_ret JOIN {BENCH} USING (date) GROUP BY 1""")
check("a13_historical_var", "portfolio_id var~", lambda v: stats.value_at_risk(port(v)),
      "SELECT portfolio_id, quantile_cont(ret, 0.05) AS var FROM t_port GROUP BY 1")
check("a14_parametric_var", "portfolio_id var~", lambda v: stats.value_at_risk(port(v), parametric=True),
      "SELECT portfolio_id, avg(ret) - 1.6448536269514722::DOUBLE * stddev_samp(ret) AS var FROM t_port GROUP BY 1")
check("a15_calmar", "portfolio_id calmar~", lambda v: stats.calmar(port(v)),
      "SELECT portfolio_id, cagr / nullif(abs(max_dd), 0) AS calmar FROM t_pannual")

CTES["t_own"] = "SELECT * FROM (SELECT ticker, date, price / lag(price) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM t_prices) WHERE ret IS NOT NULL"
check("a16_asset_table", "ticker last_price~ ret_1m~ ret_1y~ ann_vol~ max_dd~", lambda v: stats.asset_table(v.prices),
      f"""SELECT * FROM (SELECT ticker, price AS last_price, price / m - 1 AS ret_1m, price / y - 1 AS ret_1y FROM (
        SELECT *, lag(price, 21) OVER w AS m, lag(price, 252) OVER w AS y, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn
        FROM t_prices WINDOW w AS (PARTITION BY ticker ORDER BY date)) WHERE rn = 1)
      LEFT JOIN (SELECT ticker, sd * sqrt(252) AS ann_vol, max_dd FROM ({facts_sql("t_own", "ticker")})) USING (ticker)""")

check("a17_holdings_detail", "portfolio_id ticker weight_pct~ cagr_pct~ vol_pct~ sharpe~",
      lambda v: stats.holdings_detail(v.weights, v.returns),
      """SELECT portfolio_id, ticker, weight * 100 AS weight_pct, cagr * 100 AS cagr_pct, vol * 100 AS vol_pct, cagr / vol AS sharpe FROM t_weights
      LEFT JOIN (SELECT ticker, product(1 + ret) ** (252.0::DOUBLE / count(*)) - 1 AS cagr, stddev_samp(ret) * sqrt(252) AS vol
        FROM t_ret GROUP BY 1 HAVING count(*) >= 252) USING (ticker) WHERE weight >= 0.001""")

CTES["t_cover"] = """SELECT ticker, min(date) AS first, max(date) AS last, round(greatest(0.0, 1.0 - count(*) / (SELECT count(DISTINCT date) FROM t_prices)), 4) AS nan_rate,
  count(*) AS n_points, round((max(date) - min(date)) / 365.25::DOUBLE, 1) AS hist_years FROM t_prices GROUP BY 1"""
check("a18_coverage_metrics", "ticker first@ last@ nan_rate~ n_points# hist_years~", lambda v: stats.coverage_metrics(v.prices), "SELECT * FROM t_cover")
CTES["t_rret"] = """SELECT ticker, CASE WHEN count(*) >= 600 THEN round(stddev_samp(r) * sqrt(252), 3) END AS ann_vol,
  CASE WHEN count(*) >= 600 THEN round(avg(r) * 252 / (stddev_samp(r) * sqrt(252)), 2) END AS sharpe FROM (
  SELECT ticker, price / lag(price) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM t_prices) GROUP BY 1"""
check("a19_receipt_returns", "ticker ann_vol~ sharpe~", lambda v: stats.receipt_returns(v.prices, 600), "SELECT * FROM t_rret")
check("a20_receipts", "ticker provider backfill_pct first@ last@ nan_rate~ n_points# hist_years~ ann_vol~ sharpe~",
      lambda v: stats.receipts(v.nations.select(F.col("n_name").alias("ticker")).union(v.nations.select("r_name")), v.prices, merge.provenance(v.prices_raw)),
      """SELECT q.ticker, coalesce(provider_map, 'stooq(+tiingo?)') AS provider, printf('%.2f', coalesce(backfill_pct, 0.0)) AS backfill_pct, c.first, c.last,
        coalesce(nan_rate, 1.0) AS nan_rate, coalesce(n_points, 0) AS n_points, hist_years, ann_vol, sharpe
      FROM (SELECT n_name AS ticker FROM nation UNION SELECT r_name FROM region) q LEFT JOIN t_cover c ON q.ticker = c.ticker
      LEFT JOIN (SELECT ticker, CASE WHEN count(*) >= 252 THEN round(stddev_samp(r) * sqrt(252), 3) END AS ann_vol,
        CASE WHEN count(*) >= 252 THEN round(avg(r) * 252 / (stddev_samp(r) * sqrt(252)), 2) END AS sharpe FROM (
        SELECT ticker, price / lag(price) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM t_prices) GROUP BY 1) r ON q.ticker = r.ticker
      LEFT JOIN t_prov p ON q.ticker = p.ticker""")
check("a21_panel_coverage", "coverage~", lambda v: stats.panel_coverage(v.prices),
      "SELECT count(price)::DOUBLE / (count(DISTINCT date) * count(DISTINCT ticker)) AS coverage FROM t_prices")
check("a22_length_coverage", "coverage~", lambda v: stats.length_coverage(v.prices),
      "SELECT avg(n) / max(n) AS coverage FROM (SELECT count(*)::DOUBLE AS n FROM t_prices GROUP BY ticker)")
check("a23_effective_assets", "portfolio_id effective_n~", lambda v: stats.effective_assets(v.weights),
      "SELECT portfolio_id, sum(weight) ** 2 / sum(weight * weight) AS effective_n FROM t_weights GROUP BY 1")

PAIRS = "{r} a JOIN {r} b USING (date)"
check("a24_sample_covariance", "i j value~", lambda v: matrix.covariance(v.returns),
      "SELECT a.ticker AS i, b.ticker AS j, covar_samp(a.ret, b.ret) * 252 AS value FROM t_ret a JOIN t_ret b USING (date) GROUP BY 1, 2")
check("a24_tiled_covariance", "i j value~", lambda v: matrix.covariance(v.returns, annual=False, tiles=3),
      "SELECT a.ticker AS i, b.ticker AS j, covar_samp(a.ret, b.ret) AS value FROM t_ret a JOIN t_ret b USING (date) GROUP BY 1, 2")
check("a25_expected_return", "ticker ann_return~", lambda v: stats.geometric_return(v.returns_class),
      "SELECT ticker, product(1 + ret) ** (252.0::DOUBLE / count(*)) - 1 AS ann_return FROM t_retc GROUP BY 1")

CTES["t_cc"] = "SELECT ticker, date, ret - avg(ret) OVER (PARTITION BY ticker) AS x FROM (SELECT * FROM t_retc QUALIFY count(*) OVER (PARTITION BY date) = (SELECT count(DISTINCT ticker) FROM t_retc))"
CTES["t_s"] = "SELECT a.ticker AS i, b.ticker AS j, count(*) AS n, avg(a.x * b.x) AS s, avg(a.x * a.x * b.x * b.x) AS q FROM t_cc a JOIN t_cc b USING (date) GROUP BY 1, 2"
CTES["t_shrunk"] = """SELECT i, j, 252 * ((1 - lam) * s + CASE WHEN i = j THEN lam * m ELSE 0 END) AS value FROM t_s, (
  SELECT m, least(d, b) / d AS lam FROM (SELECT m, sum((s - CASE WHEN i = j THEN m ELSE 0 END) ** 2) / p AS d, sum(q - s * s) / (p * n) AS b FROM t_s, (
    SELECT avg(s) AS m, count(*)::DOUBLE AS p FROM t_s WHERE i = j) GROUP BY m, p, n))"""
check("a26_shrunk_covariance", "i j value~", lambda v: matrix.shrunk_covariance(v.returns_class), "SELECT * FROM t_shrunk")
CTES["t_corr"] = "SELECT a.ticker AS i, b.ticker AS j, corr(a.ret, b.ret) AS value FROM t_ret a JOIN t_ret b USING (date) WHERE a.ticker < b.ticker GROUP BY 1, 2"
check("a27_correlation", "i j value~", lambda v: matrix.correlation(v.returns), "SELECT * FROM t_corr")
check("a27_correlation_summary", "avg_volatility~ avg_correlation~", lambda v: matrix.correlation_summary(v.returns),
      "SELECT (SELECT avg(v) FROM (SELECT stddev_pop(ret) * sqrt(252) AS v FROM t_ret GROUP BY ticker)) AS avg_volatility, (SELECT avg(value) FROM t_corr) AS avg_correlation")

check("a28_category_counts", "field label count#", lambda v: stats.category_counts(v.listing, ["sector", "asset_class", "core_or_satellite"]),
      """SELECT 'sector' AS field, coalesce(sector, 'unknown') AS label, count(*) AS count FROM t_listing GROUP BY 2 UNION ALL
      SELECT 'asset_class', asset_class, count(*) FROM t_listing GROUP BY 2 UNION ALL
      SELECT 'core_or_satellite', core_or_satellite, count(*) FROM t_listing GROUP BY 2""")
check("a29_spread", "min~ median~ max~", lambda v: stats.spread(stats.coverage_metrics(v.prices), "n_points"),
      "SELECT round(min(n_points), 2) AS min, round(median(n_points), 2) AS median, round(max(n_points), 2) AS max FROM t_cover")
check("a30_volatility_distribution", "count# min~ max~ mean~ median~ std~ p05~ p25~ p75~ p95~",
      lambda v: stats.volatility_distribution(stats.annualized_metrics(port(v), "portfolio_id")),
      """SELECT count(volatility) AS count, min(volatility) AS min, max(volatility) AS max, avg(volatility) AS mean, stddev_pop(volatility) AS std,
      quantile_cont(volatility, 0.05) AS p05, quantile_cont(volatility, 0.25) AS p25, median(volatility) AS median,
      quantile_cont(volatility, 0.75) AS p75, quantile_cont(volatility, 0.95) AS p95 FROM t_pannual""")


def regime_labels(v):
    return macro.label_regimes(macro.regime_features(clean.densify(v.macro, "series_id", "value")))


def labels(v):
    return v.prices_class.select("date").distinct().withColumn("label", F.concat(F.lit("Q"), F.quarter("date").cast("string")))


check("a31_anova", "portfolio_id k# n# f~", lambda v: stats.anova(port(v), labels(v)),
      """SELECT portfolio_id, count(*) AS k, sum(n) AS n, (sum(n * (m - g) ** 2) / (count(*) - 1)) / (sum(ss) / (sum(n) - count(*))) AS f FROM (
        SELECT p.portfolio_id, quarter(date) AS label, count(*) AS n, avg(ret) AS m, (count(*) - 1) * var_samp(ret) AS ss, any_value(g) AS g
        FROM t_port p JOIN (SELECT portfolio_id, avg(ret) AS g FROM t_port GROUP BY 1) o ON p.portfolio_id = o.portfolio_id GROUP BY 1, 2) GROUP BY 1""")
check("a31_anova_p_value", "portfolio_id f~ p~", lambda v: stats.anova_p_value(port(v), labels(v)))

def scatter_sql(a: str, b: str) -> str:
    x = f"(({a}) * 2654435761 + ({b}) * 2246822519 + 42) % 4294967296"
    for shift, factor in ((16, 569420461), (15, 1935289751)):
        x = f"(xor({x}, ({x}) >> {shift}) * {factor}) % 4294967296"
    return f"xor({x}, ({x}) >> 15)"


def draw_sql(a: str, b: str, n: str) -> str:
    return f"({scatter_sql(a, b)}) % ({n})"


CTES["t_seq"] = "SELECT ticker, ret, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n FROM t_ret"
CTES["t_boot"] = f"""SELECT d.ticker, d.rep, product(1 + ret) AS p, stddev_pop(ret) AS sd, any_value(d.n) AS n FROM (
  SELECT s.ticker, rep::BIGINT AS rep, s.n, {draw_sql('rep::BIGINT', 's.i + 1', 's.n')} AS pick FROM t_seq s, range(1000) r(rep) WHERE s.n >= 126) d
  JOIN t_seq s ON s.ticker = d.ticker AND s.i = d.pick GROUP BY 1, 2"""
check("a32_bootstrap_growth", "ticker lo~ hi~", lambda v: stats.bootstrap_interval(v.returns, replicates=1000, min_rows=126),
      """SELECT t.ticker, lo, hi FROM (SELECT DISTINCT ticker FROM t_ret) t LEFT JOIN (SELECT ticker, quantile_cont(c, 0.025) AS lo, quantile_cont(c, 0.975) AS hi
      FROM (SELECT ticker, p ** (252.0::DOUBLE / n) - 1 AS c FROM t_boot) GROUP BY 1) b ON t.ticker = b.ticker""")
check("a32_bootstrap_volatility", "ticker lo~ hi~", lambda v: stats.bootstrap_interval(v.returns, "ann_vol", replicates=1000, min_rows=126),
      """SELECT t.ticker, lo, hi FROM (SELECT DISTINCT ticker FROM t_ret) t LEFT JOIN (SELECT ticker, quantile_cont(c, 0.025) AS lo, quantile_cont(c, 0.975) AS hi
      FROM (SELECT ticker, sd * sqrt(252) AS c FROM t_boot) GROUP BY 1) b ON t.ticker = b.ticker""")

CTES["t_grp"] = """SELECT g, nm, date, ret FROM (SELECT split_part(portfolio_id, '|', 1) AS g, split_part(portfolio_id, '|', 2) AS nm, date, ret FROM t_portc)
  QUALIFY count(*) OVER (PARTITION BY g, date) = len(list(DISTINCT nm) OVER (PARTITION BY g))"""
CTES["t_grk"] = """SELECT *, row_number() OVER (PARTITION BY g ORDER BY like_ DESC, nm) AS rk FROM (
  SELECT g, nm, avg(ret) AS mean, coalesce(avg(ret) / nullif(stddev_samp(ret), 0), -1e9) AS like_, count(*) AS n FROM t_grp GROUP BY 1, 2)"""
CTES["t_gseq"] = """SELECT p.g, rk, list(ret ORDER BY date) AS r, any_value(n) AS n FROM t_grp p JOIN t_grk k ON p.g = k.g AND p.nm = k.nm WHERE n >= 60 GROUP BY p.g, rk"""
# how often a replicate draws each day: once per number of days, shared by all series of that length
CTES["t_gdraw"] = f"""SELECT n, rep, list(coalesce(c, 0)::DOUBLE ORDER BY i) AS drawn FROM (SELECT n, unnest(range(n)) AS i, rep FROM (SELECT DISTINCT n FROM t_gseq), range(2000) t(rep))
  LEFT JOIN (SELECT n, rep, pick AS i, count(*) AS c FROM (SELECT n, rep, {draw_sql('rep::BIGINT', 'i + 1', 'n')} AS pick FROM (SELECT n, unnest(range(n)) AS i, rep FROM (SELECT DISTINCT n FROM t_gseq), range(2000) t(rep)))
    GROUP BY 1, 2, 3) USING (n, rep, i) GROUP BY 1, 2"""
CTES["t_gboot"] = "SELECT g, rk, rep, list_inner_product(drawn, r) AS m FROM t_gseq JOIN t_gdraw USING (n)"
check("a33_bootstrap_winner", "group_id winner mean~ p_value~",
      lambda v: stats.bootstrap_winner(portc(v).select(F.split("portfolio_id", r"\|")[0].alias("group_id"),
                                                       F.split("portfolio_id", r"\|")[1].alias("name"), "date", "ret"), replicates=2000),
      """SELECT k.g AS group_id, nm AS winner, mean, p_value FROM t_grk k LEFT JOIN (SELECT o.g, avg((w.m - o.m <= 0)::INT::DOUBLE) AS p_value
        FROM t_gboot w JOIN t_gboot o ON w.g = o.g AND w.rep = o.rep WHERE w.rk = 1 AND o.rk > 1 GROUP BY 1) p ON k.g = p.g WHERE rk = 1""")
check("a34_normal_interval", "ticker lo~ hi~", lambda v: stats.normal_interval(v.returns),
      "SELECT ticker, avg(ret) - 1.96 * stddev_pop(ret) / sqrt(count(*)) AS lo, avg(ret) + 1.96 * stddev_pop(ret) / sqrt(count(*)) AS hi FROM t_ret GROUP BY 1")

CTES["t_allcurve"] = "SELECT *, product(1 + ret) OVER (PARTITION BY ticker ORDER BY date) AS value FROM t_ret"
CTES["t_robust"] = """SELECT {k}, CASE WHEN any_value(n) < 126 THEN 50.0 ELSE greatest(0, least(100, 100 * (1 - (stddev_samp(g) - 0.02) / 0.18::DOUBLE))) END AS robustness FROM (
  SELECT {k}, seg, any_value(n) AS n, (arg_max(value, date) / arg_min(value, date)) ** (252.0::DOUBLE / count(*)) - 1 AS g FROM (
    SELECT *, least(2, (rn - 1) // greatest(n // 3, 1)) AS seg FROM (SELECT *, count(*) OVER (PARTITION BY {k}) AS n, row_number() OVER (PARTITION BY {k} ORDER BY date) AS rn FROM {src}))
  GROUP BY 1, 2) GROUP BY 1"""
ROBUST = CTES.pop("t_robust")
check("a35_robustness", "portfolio_id robustness~", lambda v: stats.robustness(stats.equity_curve(port(v), "portfolio_id")),
      ROBUST.format(k="portfolio_id", src="t_curve"))
check("a35_robustness_by_ticker", "ticker robustness~", lambda v: stats.robustness(stats.equity_curve(v.returns), "ticker"),
      ROBUST.format(k="ticker", src="t_allcurve"))


def results(v):
    """Sensitivity results: one cell per book."""
    m = stats.annualized_metrics(port(v), "portfolio_id")
    n = F.split("portfolio_id", r"\|")[0].cast("long")
    return m.select(F.split("portfolio_id", r"\|")[1].alias("objective"), choose(["none", "equity-10%", "rates+100bp"], mod(n, 3)).alias("shock"),
                    (F.coalesce("sharpe", F.lit(0.0)) - F.lit(0.2) * F.abs("max_dd")).alias("top_score"),
                    F.concat(choose(["HRP", "MIN_VAR", "EQUAL_WEIGHT"], mod(n, 4) - F.floor(mod(n, 4) / 3)), F.lit(" - Sat 20%")).alias("top_name"))


CTES["t_results"] = """SELECT split_part(portfolio_id, '|', 2) AS objective, ['none','equity-10%','rates+100bp'][1 + k % 3] AS shock,
  coalesce(sharpe, 0) - 0.2 * abs(max_dd) AS top_score, ['HRP','MIN_VAR','EQUAL_WEIGHT'][1 + k % 4 - (k % 4) // 3] || ' - Sat 20%' AS top_name
  FROM (SELECT *, split_part(portfolio_id, '|', 1)::INT AS k FROM t_pannual)"""
check("a36_sensitivity_pivot", "objective none~ equity_10~ rates_100bp~",
      lambda v: stats.sensitivity_pivot(results(v), ["none", "equity-10%", "rates+100bp"])
      .withColumnsRenamed({"equity-10%": "equity_10", "rates+100bp": "rates_100bp"}),
      """SELECT objective, avg(top_score) FILTER (shock = 'none') AS none, avg(top_score) FILTER (shock = 'equity-10%') AS equity_10,
      avg(top_score) FILTER (shock = 'rates+100bp') AS rates_100bp FROM t_results GROUP BY 1""")
check("a36_top_optimizers", "optimizer count#", lambda v: stats.top_optimizer_counts(results(v)),
      "SELECT split_part(top_name, ' - ', 1) AS optimizer, count(*) AS count FROM t_results GROUP BY 1")

CTES["t_alloc"] = """SELECT * FROM (SELECT portfolio_id, asset_class, sum(weight) / sum(sum(weight)) OVER (PARTITION BY portfolio_id) AS share, count(*) AS holdings
  FROM t_weights JOIN t_catalog ON ticker = symbol GROUP BY 1, 2) WHERE share >= 0.001"""
check("a38_allocation_by_class", "portfolio_id asset_class share~ holdings#", lambda v: stats.allocation_by_class(v.weights, v.catalog), "SELECT * FROM t_alloc")
check("a38_top_classes", "portfolio_id asset_class holdings# rank#", lambda v: stats.top_classes(stats.allocation_by_class(v.weights, v.catalog), 2),
      "SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY holdings DESC, asset_class) AS rank FROM t_alloc QUALIFY rank <= 2")

CTES["t_year"] = "SELECT * FROM t_port WHERE date IN (SELECT DISTINCT date FROM t_port ORDER BY date DESC LIMIT 252)"
CTES["t_cand"] = f"""SELECT portfolio_id, holdings, round(cagr * 100, 2) AS cagr_1y, round(volatility * 100, 2) AS vol_1y, round(sharpe, 3) AS sharpe_1y,
  round(beta, 3) AS beta, round(var, 4) AS var95 FROM ({annual_sql("t_year", "portfolio_id")})
  JOIN (SELECT portfolio_id, quantile_cont(ret, 0.05) AS var FROM t_year GROUP BY 1) USING (portfolio_id)
  LEFT JOIN (SELECT portfolio_id, CASE WHEN count(*) >= 126 THEN covar_samp(ret, b) / var_samp(b) END AS beta FROM t_year JOIN {BENCH} USING (date) GROUP BY 1) USING (portfolio_id)
  JOIN (SELECT portfolio_id, count(*) FILTER (weight > 0.001) AS holdings FROM t_books GROUP BY 1) USING (portfolio_id)"""
CT = "portfolio_id holdings# cagr_1y~ vol_1y~ sharpe_1y~ beta~ var95~"
check("a39_candidate_table", CT, lambda v: stats.candidate_table(v.books, port(v), bench(v)), "SELECT * FROM t_cand")
check("a39_top_four", CT, lambda v: stats.best_by_growth(stats.candidate_table(v.books, port(v), bench(v))),
      "SELECT * FROM t_cand ORDER BY cagr_1y DESC NULLS LAST, portfolio_id LIMIT 4")
