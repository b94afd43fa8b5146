"""W family: windows and sequences; J family: joins; R family: macro regimes."""
from pyspark.sql import functions as F

from ..functions.expr import choose, lookup, mod
from ..operators import blend, clean, macro, matrix, merge, sequence, stats
from ..plans.views import PROVIDER_OF_FLAG
from .ctes import CTES
from .registry import check
from .stats_checks import annual_sql, bench, labels, port, portc, regime_labels

# ---- W ----------------------------------------------------------------------------------------
check("w01_rolling_risk", "ticker date@ vol~ sharpe~", lambda v: sequence.rolling_risk(v.returns, 252, rf=0.02, min_periods=40),
      """SELECT ticker, date, CASE WHEN c >= 40 THEN v END AS vol, CASE WHEN c >= 40 THEN (m - (1.02::DOUBLE ** (1.0::DOUBLE / 252) - 1)) * 252 / nullif(v, 0) END AS sharpe FROM (
      SELECT ticker, date, count(*) OVER w AS c, stddev_pop(ret) OVER w * sqrt(252) AS v, avg(ret) OVER w AS m FROM t_ret
      WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW))""")

check("w02_rolling_drawdown", "ticker date@ maxdd~", lambda v: sequence.rolling_drawdown(v.returns, 252),
      """WITH c AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn FROM t_allcurve)
      SELECT e.ticker, e.date, CASE WHEN e.rn >= 252 THEN m END AS maxdd FROM c e JOIN (SELECT ticker, rn, min(dd) AS m FROM (
        SELECT e.ticker, e.rn, k.value / max(k.value) OVER (PARTITION BY e.ticker, e.rn ORDER BY k.rn) - 1 AS dd
        FROM c e JOIN c k ON e.ticker = k.ticker AND k.rn BETWEEN e.rn - 251 AND e.rn) GROUP BY 1, 2) d ON e.ticker = d.ticker AND e.rn = d.rn""")

check("w03_equity_curve", "portfolio_id date@ value~", lambda v: stats.equity_curve(port(v), "portfolio_id"), "SELECT * FROM t_curve")
check("w04_drawdown_series", "ticker date@ drawdown~", lambda v: stats.drawdown_series(stats.equity_curve(v.returns)),
      "SELECT ticker, date, value / max(value) OVER (PARTITION BY ticker ORDER BY date) - 1 AS drawdown FROM t_allcurve")


def curves(v):
    c = stats.equity_curve(portc(v), "portfolio_id").select(F.col("portfolio_id").alias("series"), "date", "value")
    return c.unionByName(v.prices_class.select(F.col("ticker").alias("series"), "date", F.col("price").alias("value")))


CTES["t_curvec"] = "SELECT portfolio_id, date, product(1 + ret) OVER (PARTITION BY portfolio_id ORDER BY date) AS value FROM t_portc"
check("w05_rebased_history", "series date@ value~", lambda v: sequence.rebased_history(curves(v), 20),
      """SELECT series, date, value / first(value) OVER (PARTITION BY series ORDER BY date) * 100 AS value FROM (
        SELECT * FROM (SELECT portfolio_id AS series, date, value FROM t_curvec UNION ALL SELECT ticker, date, price FROM t_prices_class)
        QUALIFY date >= max(date) OVER (PARTITION BY series) - INTERVAL 20 YEAR)""")

CTES["t_buy"] = """SELECT *, date = max(date) OVER (PARTITION BY portfolio_id, date_trunc('month', date)) AS buy,
  date = min(date) OVER (PARTITION BY portfolio_id) AS first FROM t_curvec"""


def dca_sql(lump: str, monthly: str, src: str = "t_buy", extra: str = "") -> str:
    return f"""SELECT portfolio_id, {extra} date, sum(cash) OVER w AS invested, sum(cash / value) OVER w * value AS market_value FROM (
      SELECT *, CASE WHEN buy THEN {monthly} ELSE 0 END + CASE WHEN first THEN {lump} ELSE 0 END AS cash FROM {src})
      WINDOW w AS (PARTITION BY portfolio_id{', plan' if extra else ''} ORDER BY date)"""


def curve_c(v):
    return stats.equity_curve(portc(v), "portfolio_id")


check("w06_dca_value", "portfolio_id date@ invested~ market_value~4", lambda v: sequence.dca_value(curve_c(v), 750.0, 5000.0),
      dca_sql("5000.0::DOUBLE", "750.0::DOUBLE"))
check("w06_final_contribution_value", "portfolio_id final_value~4", lambda v: sequence.final_contribution_value(curve_c(v), 500.0),
      f"SELECT portfolio_id, arg_max(market_value, date) AS final_value FROM ({dca_sql('0.0::DOUBLE', '500.0::DOUBLE')}) GROUP BY 1")
check("w07_dca_plans", "portfolio_id plan date@ invested~ market_value~4",
      lambda v: sequence.dca_plans(curve_c(v), {"Baseline": (1000, 250), "Ambitious": (5000, 750)}),
      dca_sql("lump", "monthly", "(SELECT * FROM t_buy, (VALUES ('Baseline', 1000.0::DOUBLE, 250.0::DOUBLE), ('Ambitious', 5000, 750)) p(plan, lump, monthly))", "plan,"))
check("w08_rough_projection", "portfolio_id final_value~4", lambda v: sequence.rough_projection(curve_c(v), 5000, 750),
      """SELECT portfolio_id, (5000 / arg_min(value, date) + 750 * (count(*) // 21) / avg(value)) * arg_max(value, date) AS final_value FROM t_curvec GROUP BY 1""")


def daily(v):
    return clean.densify(v.macro, "series_id", "value")


def lag_sql(expr: str) -> str:
    return f"SELECT series_id, date, {expr} AS change FROM (SELECT *, lag(value, {{k}}) OVER (PARTITION BY series_id ORDER BY date) AS p FROM t_macrod)"


check("w09_change", "series_id date@ change~", lambda v: sequence.lookback_change(daily(v), 126), lag_sql("value - p").format(k=126))
check("w09_yearly_change", "series_id date@ change~", lambda v: sequence.lookback_change(daily(v), 252, kind="pct"), lag_sql("value / p - 1").format(k=252))
check("w09_growth", "series_id date@ change~", lambda v: sequence.lookback_change(daily(v), 6, kind="growth"), lag_sql("(value - p) / abs(p)").format(k=6))
check("w10_z_scores", "ticker date@ price~", lambda v: sequence.z_scores(v.prices, ["price"]),
      "SELECT ticker, date, (price - (SELECT avg(price) FROM t_prices)) / (SELECT stddev_samp(price) FROM t_prices) AS price FROM t_prices")
check("w11_latest_values", "series_id value~ date@ tail_rows#", lambda v: sequence.latest_values(v.macro),
      "SELECT series_id, arg_max(value, date) AS value, max(date) AS date, least(count(*), 365) AS tail_rows FROM t_macro GROUP BY 1")
check("w11_latest_row", "series_id value~ date@", lambda v: sequence.latest_row(v.macro),
      "SELECT series_id, arg_max(value, date) AS value, (SELECT max(date) FROM t_macro) AS date FROM t_macro GROUP BY 1")
check("w12_curve_consistency", "portfolio_id built~ stored~ consistent?",
      lambda v: sequence.curve_consistent(portc(v), curve_c(v).withColumn("value", F.col("value") * F.when(F.col("portfolio_id").endswith("MACHINERY"), 1.01).otherwise(1.0))),
      """SELECT portfolio_id, built, built * f AS stored, f = 1.0 AS consistent FROM (SELECT portfolio_id, arg_max(value, date) AS built,
      CASE WHEN portfolio_id LIKE '%MACHINERY' THEN 1.01::DOUBLE ELSE 1.0 END AS f FROM t_curvec GROUP BY 1)""")

CTES["t_f"] = "SELECT account_id, amount, (date - min(date) OVER (PARTITION BY account_id)) / 365.0::DOUBLE AS t FROM t_flows"
CTES["t_bis"] = """SELECT account_id, 0 AS k, -0.9999::DOUBLE AS lo, 10.0::DOUBLE AS hi, sum(amount / 0.0001::DOUBLE ** t) AS flo, sum(amount / 11.0::DOUBLE ** t) AS fhi FROM t_f GROUP BY 1"""
check("w13_xirr", "account_id# xirr~", lambda v: sequence.xirr(v.cash_flows),
      """WITH RECURSIVE b AS (SELECT account_id, k, lo, hi, flo FROM t_bis WHERE flo * fhi <= 0 UNION ALL
        SELECT b.account_id, any_value(b.k) + 1,
          CASE WHEN sum(amount / (1 + (lo + hi) / 2) ** t) * sign(any_value(flo)) < 0 THEN any_value(lo) ELSE any_value((lo + hi) / 2) END,
          CASE WHEN sum(amount / (1 + (lo + hi) / 2) ** t) * sign(any_value(flo)) < 0 THEN any_value((lo + hi) / 2) ELSE any_value(hi) END, any_value(flo)
        FROM b JOIN t_f f ON b.account_id = f.account_id WHERE k < 60 GROUP BY b.account_id)
      SELECT s.account_id, (b.lo + b.hi) / 2 AS xirr FROM t_bis s LEFT JOIN b ON s.account_id = b.account_id AND b.k = 60""")


def savers(v):
    return v.users.select("user_id", F.col("investable_amount").alias("lump"), (F.col("annual_income") / 120).alias("monthly"),
                          F.col("horizon_years").alias("years"),
                          sequence.base_growth(F.when(F.col("slider") > 15, F.col("slider") / 10), F.when(F.col("slider") <= 15, F.col("slider") / 400)).alias("base_cagr"))


check("w14_projection_table", "user_id# scenario year# value~2", lambda v: sequence.projection_table(savers(v)),
      """SELECT user_id, scenario, year, CASE WHEN year = 0 THEN lump WHEN r = 0 THEN lump + monthly * m ELSE lump * (1 + r) ** m + monthly * ((1 + r) ** m - 1) / r END AS value FROM (
        SELECT user_id, scenario, year, investable_amount AS lump, annual_income / 120 AS monthly, year * 12 AS m,
          CASE scenario WHEN 'Conservative' THEN greatest(0.01::DOUBLE, b - 0.02::DOUBLE) WHEN 'Base' THEN b ELSE b + 0.02::DOUBLE END / 12 AS r FROM (
          SELECT *, CASE WHEN slider IS NULL THEN 0.06 WHEN slider > 15 THEN slider / 1000 ELSE slider / 400 END::DOUBLE AS b,
            unnest(range(greatest(1, horizon_years) + 1)) AS year FROM t_users), (VALUES ('Conservative'), ('Base'), ('Optimistic')) s(scenario))""")

# ---- J ----------------------------------------------------------------------------------------
check("j01_portfolio_returns", "portfolio_id date@ ret~", port, "SELECT * FROM t_port")
check("j01_customer_portfolio_summary", "portfolio_id n# mean~ total~", lambda v: blend.portfolio_returns(v.returns_class, v.customer_weights("cls")).groupBy("portfolio_id").agg(
      F.count("*").alias("n"), F.avg("ret").alias("mean"), F.sum("ret").alias("total")),
      """SELECT portfolio_id, count(*) AS n, avg(ret) AS mean, sum(ret) AS total FROM (SELECT portfolio_id, date, sum(weight * ret) AS ret FROM (
        SELECT customer AS portfolio_id, cls AS ticker, sum(x) / sum(sum(x)) OVER (PARTITION BY customer) AS weight FROM t_spend GROUP BY 1, 2)
        JOIN t_retc USING (ticker) GROUP BY 1, 2) GROUP BY 1""")
check("j02_renormalised_returns", "portfolio_id date@ ret~", lambda v: blend.renormalised_returns(v.returns, v.books),
      "SELECT portfolio_id, date, sum(weight * ret) / sum(weight) AS ret FROM t_books JOIN t_ret USING (ticker) GROUP BY 1, 2")
check("j03_portfolio_curve", "portfolio_id date@ value~", lambda v: blend.portfolio_curve(v.prices, v.books, v.returns),
      """SELECT portfolio_id, date, product(1 + coalesce(ret, 0)) OVER (PARTITION BY portfolio_id ORDER BY date) AS value FROM (SELECT DISTINCT portfolio_id FROM t_books)
      CROSS JOIN (SELECT DISTINCT date FROM t_prices) LEFT JOIN t_port USING (portfolio_id, date)""")

CTES["t_full"] = """SELECT * FROM (SELECT portfolio_id, ticker, weight, date, ret, count(*) OVER (PARTITION BY portfolio_id, date) AS have, k
  FROM (SELECT *, count(*) OVER (PARTITION BY portfolio_id) AS k FROM t_booksc) JOIN t_retc USING (ticker)) WHERE have = k"""
CTES["t_fullp"] = "SELECT portfolio_id, date, sum(weight * ret) AS ret FROM t_full GROUP BY 1, 2"
CTES["t_pm"] = """SELECT portfolio_id, coalesce(n >= 2, false) AS valid, CASE WHEN n IS NULL THEN 'insufficient returns data' WHEN n < 2 THEN 'insufficient data' END AS reason,
  CASE WHEN n >= 2 THEN (v1 / v0) ** (252.0::DOUBLE / n) - 1 END AS cagr, CASE WHEN n >= 2 THEN sd * sqrt(252) END AS volatility,
  CASE WHEN n >= 2 THEN ((v1 / v0) ** (252.0::DOUBLE / n) - 1 - 0.015) / (sd * sqrt(252)) END AS sharpe, CASE WHEN n >= 2 THEN max_dd END AS max_drawdown,
  CASE WHEN n >= 2 THEN v1 - 1 END AS total_return, CASE WHEN n >= 2 THEN wv / (sd * sqrt(252)) END AS diversification_ratio, num_holdings
FROM (SELECT portfolio_id, count(*) FILTER (weight > 1e-4) AS num_holdings FROM t_booksc GROUP BY 1)
LEFT JOIN (SELECT portfolio_id, count(*) AS n, arg_min(value, date) AS v0, arg_max(value, date) AS v1, stddev_samp(ret) AS sd, min(dd) AS max_dd FROM (
    SELECT *, value / max(value) OVER (PARTITION BY portfolio_id ORDER BY date) - 1 AS dd FROM (
      SELECT *, product(1 + ret) OVER (PARTITION BY portfolio_id ORDER BY date) AS value FROM t_fullp)) GROUP BY 1) USING (portfolio_id)
LEFT JOIN (SELECT portfolio_id, sum(weight * sd) AS wv FROM (SELECT portfolio_id, ticker, any_value(weight) AS weight, stddev_samp(ret) * sqrt(252) AS sd
    FROM t_full GROUP BY 1, 2) GROUP BY 1) USING (portfolio_id)"""
PM = "portfolio_id valid? reason cagr~ volatility~ sharpe~ max_drawdown~ total_return~ diversification_ratio~ num_holdings#"
check("j04_portfolio_metrics", PM, lambda v: blend.portfolio_metrics(v.books_class, v.returns_class), "SELECT * FROM t_pm")

CTES["t_cov"] = "SELECT a.ticker AS i, b.ticker AS j, covar_samp(a.ret, b.ret) AS value FROM t_retc a JOIN t_retc b USING (date) GROUP BY 1, 2"
CTES["t_rc"] = """SELECT portfolio_id, ticker, weight, c / sqrt(sum(c) OVER (PARTITION BY portfolio_id)) AS risk_contribution,
  sqrt(sum(c) OVER (PARTITION BY portfolio_id)) AS portfolio_volatility FROM (
  SELECT a.portfolio_id, a.ticker, any_value(a.weight) AS weight, sum(a.weight * b.weight * value) * 252 AS c
  FROM t_booksc a JOIN t_booksc b ON a.portfolio_id = b.portfolio_id JOIN t_cov ON i = a.ticker AND j = b.ticker GROUP BY 1, 2)"""


def cov_rows(v):
    return matrix.covariance(v.returns_class, annual=False)


def contributions(v):
    return blend.risk_contributions(v.books_class_table, cov_rows(v), 252.0)


check("j05_risk_contributions", "portfolio_id ticker weight~ risk_contribution~ portfolio_volatility~", contributions, "SELECT * FROM t_rc")


def symbols(v):
    s = v.listing.select("symbol").union(v.nations.select("n_name")).union(v.nations.select("r_name"))
    known = F.explode(F.array(*[F.lit(x) for x in ("spy", "GLD", "VNQ", "BIL", "EWZ", "ZZZ")]))
    return s.union(v.table("region").select(known))


def fine_catalog(v):
    c = v.listing.where(mod(F.col("ordinal"), 5) != 0)
    names = ["equity_us", "bonds_ig", "high_yield", "cash", "gold", "reit", "odd"]
    return c.select("symbol", F.when(mod(F.col("ordinal"), 4) == 0, F.col("asset_class")).alias("asset_class"), choose(names, mod(F.col("ordinal"), 7)).alias("class"))


check("j06_asset_classes", "symbol asset_class", lambda v: blend.asset_classes(
      symbols(v), v.listing.where(mod(F.col("ordinal"), 3) == 0).select("symbol", "asset_class"), fine_catalog(v)),
      """SELECT s.symbol, coalesce(CASE WHEN ordinal % 3 = 0 THEN asset_class END, CASE WHEN ordinal % 5 <> 0 THEN coalesce(CASE WHEN ordinal % 4 = 0 THEN asset_class END,
        ['equity','bond','bond','cash','commodity','reit',NULL][1 + ordinal % 7]) END,
        CASE s.symbol WHEN 'SPY' THEN 'equity' WHEN 'EWZ' THEN 'equity' WHEN 'GLD' THEN 'commodity' WHEN 'VNQ' THEN 'reit' WHEN 'BIL' THEN 'cash' END, 'unknown') AS asset_class
      FROM (SELECT upper(symbol) AS symbol FROM t_listing UNION SELECT n_name FROM nation UNION SELECT r_name FROM region
        UNION SELECT * FROM (VALUES ('SPY'), ('GLD'), ('VNQ'), ('BIL'), ('EWZ'), ('ZZZ'))) s LEFT JOIN t_listing l ON upper(l.symbol) = s.symbol""")
check("j07_class_flags", "symbol is_equity? is_bond? is_cash? is_alt? is_equity_ticker? is_bond_ticker?", lambda v: blend.class_flags(v.listing),
      """SELECT symbol, class LIKE 'public_equity%' AS is_equity, class IN ('treasury_long','tbills','corporate_bond') AS is_bond, class = 'tbills' AS is_cash,
      class IN ('commodities','gold','reit') AS is_alt, false AS is_equity_ticker, false AS is_bond_ticker FROM t_listing""")

CTES["t_reg"] = """SELECT date, CASE WHEN cpi_yoy < -0.3 AND dgs10_6m_chg < 0.3 THEN 'Disinflation' WHEN dgs10_6m_chg > 0.5 AND cpi_yoy > 0.5 THEN 'Tightening'
  WHEN unrate_6m_chg > 0.5 AND dgs10_6m_chg < -0.3 THEN 'Recessionary' ELSE 'Risk-on' END AS regime FROM t_feat"""
_F = ["dgs10_level", "dgs10_6m_chg", "cpi_yoy", "unrate_6m_chg", "fedfunds_level"]
CTES["t_featraw"] = """SELECT date, max(CASE WHEN series_id = 'DGS10' THEN value END) AS dgs10_level, max(CASE WHEN series_id = 'DGS10' THEN value - d END) AS dgs10_6m_chg,
  max(CASE WHEN series_id = 'CPIAUCSL' THEN value / y - 1 END) AS cpi_yoy, max(CASE WHEN series_id = 'UNRATE' THEN value - d END) AS unrate_6m_chg,
  max(CASE WHEN series_id = 'FEDFUNDS' THEN value END) AS fedfunds_level FROM (
  SELECT *, lag(value, 126) OVER w AS d, lag(value, 252) OVER w AS y FROM t_macrod WINDOW w AS (PARTITION BY series_id ORDER BY date)) GROUP BY date"""
CTES["t_featfull"] = f"SELECT * FROM t_featraw WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _F)}"
CTES["t_feat"] = f"SELECT date, {', '.join(f'({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS {c}' for c in _F)} FROM t_featfull"
CTES["t_preg"] = "SELECT portfolio_id, regime, date, ret FROM t_portc JOIN t_reg USING (date)"
check("j08_regime_performance", "portfolio_id regime cagr~ sharpe~ n#", lambda v: blend.regime_performance(portc(v), regime_labels(v)),
      f"SELECT portfolio_id, regime, cagr, sharpe, n FROM ({annual_sql('t_preg', 'portfolio_id, regime')}) WHERE n >= 20")


def shock_specs(v):
    k = F.col("o_orderkey").cast("long")
    unit = mod(k, 3)
    size = F.when(unit == 2, (mod(k, 40) / 100).cast("string")).otherwise(mod(k, 40).cast("string"))
    text = F.concat(choose([" Equity", "rates", "gold "], mod(k, 5)), choose(["+", "-"], mod(k, 2)), size, choose(["%", "bp", ""], unit))
    return v.table("orders").select(k.alias("scenario_id"), text.alias("spec"))


check("j09_parse_shock", "scenario_id# target direction magnitude~", lambda v: shock_specs(v).withColumns(blend.parse_shock(F.col("spec"))),
      """SELECT o_orderkey AS scenario_id, CASE WHEN o_orderkey % 5 < 3 THEN ['equity','rates','gold'][1 + o_orderkey % 5] END AS target,
      CASE WHEN o_orderkey % 5 < 3 THEN ['+','-'][1 + o_orderkey % 2] END AS direction,
      CASE WHEN o_orderkey % 5 < 3 THEN (o_orderkey % 40) / [100.0, 10000.0, 100.0][1 + o_orderkey % 3] END AS magnitude FROM orders""")

SCENARIOS = {"crash": ["equity-10%", "gold+5%"], "hike": ["rates+100bp"], "mixed": ["bonds-0.01", "equity+3%", "equity-2%"]}
check("j10_apply_shocks", "scenario_id ticker date@ ret~", lambda v: blend.apply_shocks(v.returns, SCENARIOS, v.catalog.select("symbol", "class")),
      """SELECT scenario_id, ticker, date, ret * CASE WHEN date = (SELECT min(date) FROM t_ret) THEN
        CASE scenario_id WHEN 'crash' THEN CASE WHEN class LIKE 'public_equity%' THEN 0.9 WHEN class = 'gold' THEN 1.05 ELSE 1 END
          WHEN 'hike' THEN CASE WHEN class IN ('treasury_long','corporate_bond') THEN 1 - 7 * 0.01 ELSE 1 END
          ELSE CASE WHEN class IN ('treasury_long','corporate_bond') THEN 1 + 7 * 0.01 WHEN class LIKE 'public_equity%' THEN 1.03 * 0.98 ELSE 1 END END ELSE 1 END::DOUBLE AS ret
      FROM t_ret JOIN t_catalog ON ticker = symbol, (VALUES ('crash'), ('hike'), ('mixed')) s(scenario_id)""")


def tilt_classes(v):
    return v.catalog.select("symbol", F.when(F.col("asset_class") == "bond", "bonds_ig").when(F.col("asset_class") == "commodity", "gold")
                            .otherwise(F.col("asset_class")).alias("asset_class"))


def tilt_sql(eq: str, bond: str, gold: str, cash: str) -> str:
    return f"""SELECT portfolio_id, ticker, t / sum(t) OVER (PARTITION BY portfolio_id) AS weight FROM (SELECT portfolio_id, ticker, weight * (1 + CASE asset_class
      WHEN 'equity' THEN {eq} WHEN 'bond' THEN {bond} WHEN 'commodity' THEN {gold} WHEN 'cash' THEN {cash} ELSE 0 END::DOUBLE) AS t FROM t_weights JOIN t_catalog ON ticker = symbol)"""


check("j11_regime_tilt", "portfolio_id ticker weight~", lambda v: blend.tilt_weights(v.weights, tilt_classes(v), F.lit("recessionary")), tilt_sql("-0.05", "0.05", "0.02", "0"))
check("j11_regime_tilt_tightening", "portfolio_id ticker weight~", lambda v: blend.tilt_weights(v.weights, tilt_classes(v), F.lit("tightening")), tilt_sql("0", "-0.02", "0", "0.02"))


def neighbour_pairs(v):
    """Each customer's portfolio against the next customer's."""
    ids = v.weights.select("portfolio_id").distinct()
    nxt = ids.select((F.col("portfolio_id").cast("long") - 1).cast("string").alias("a"), F.col("portfolio_id").alias("b"))
    return ids.select(F.col("portfolio_id").alias("a")).join(nxt, "a")


check("j12_cosine_similarity", "a b similarity~ distinct?", lambda v: blend.cosine_similarity(v.weights, neighbour_pairs(v), 0.6),
      """WITH w AS (SELECT portfolio_id::BIGINT AS p, ticker, weight FROM t_weights), n AS (SELECT p, sqrt(sum(weight * weight)) AS n FROM w GROUP BY 1)
      SELECT a.p::VARCHAR AS a, b.p::VARCHAR AS b, coalesce(d, 0) / (a.n * b.n) AS similarity, coalesce(d, 0) / (a.n * b.n) <= 0.6 AS distinct
      FROM n a JOIN n b ON b.p = a.p + 1 LEFT JOIN (SELECT x.p, sum(x.weight * y.weight) AS d FROM w x JOIN w y ON y.p = x.p + 1 AND x.ticker = y.ticker GROUP BY 1) d ON d.p = a.p""")


def baseline(v):
    return v.weights.where(~F.col("ticker").endswith("4")).withColumn("weight", F.when(F.col("ticker").endswith("1"), F.col("weight") * 0.7).otherwise(F.col("weight")))


check("j13_weight_diff", "portfolio_id ticker delta~ flagged? max_delta~", lambda v: blend.weight_diff(v.weights, baseline(v)),
      """SELECT portfolio_id, ticker, d AS delta, d > 0.02 AS flagged, max(d) OVER (PARTITION BY portfolio_id) AS max_delta FROM (
      SELECT portfolio_id, ticker, CASE WHEN ticker LIKE '%4' THEN weight WHEN ticker LIKE '%1' THEN abs(weight - weight * 0.7::DOUBLE) ELSE 0 END AS d FROM t_weights)""")
check("j14_weight_snapshot", "portfolio_id ticker weight~", lambda v: blend.weight_snapshot(v.weights, v.prices),
      """SELECT portfolio_id, ticker, round(coalesce(weight, 0), 4) AS weight FROM (SELECT DISTINCT portfolio_id FROM t_weights)
      CROSS JOIN (SELECT DISTINCT ticker FROM t_prices) LEFT JOIN t_weights USING (portfolio_id, ticker)""")
check("j15_benchmark_join", "portfolio_id date@ ret~ benchmark_ret~", lambda v: blend.benchmark_join(portc(v), bench(v)),
      "SELECT portfolio_id, date, p.ret, b.ret AS benchmark_ret FROM t_portc p JOIN (SELECT * FROM t_retc WHERE ticker = 'AMERICA') b USING (date)")


def run(v, n):
    k = F.col("o_orderkey").cast("long")
    return v.table("orders").where(F.col("o_orderstatus") != ("F" if n == 1 else "O")).select(F.concat(F.lit("test_"), k.cast("string")).alias("name"), (mod(k, n + 1) != 0).alias("passed"))


check("j16_compare_results", "name run1? run2? change", lambda v: blend.compare_results(run(v, 1), run(v, 2)),
      """SELECT *, CASE WHEN run1 = run2 THEN 'SAME' WHEN run2 THEN 'FIXED' ELSE 'REGRESSION' END AS change FROM (SELECT 'test_' || o_orderkey AS name,
      o_orderstatus <> 'F' AND o_orderkey % 2 <> 0 AS run1, o_orderstatus <> 'O' AND o_orderkey % 3 <> 0 AS run2 FROM orders)""")
check("j16_compare_artifacts", "name found", lambda v: blend.compare_artifacts(run(v, 1), run(v, 2)),
      "SELECT 'test_' || o_orderkey AS name, CASE o_orderstatus WHEN 'F' THEN 'only_in_2' WHEN 'O' THEN 'only_in_1' ELSE 'common' END AS found FROM orders")


def asset_receipts_c(v):
    q = stats.quality_metrics(v.returns_class).select(F.col("ticker").alias("symbol"), "max_drawdown")
    ok = F.col("max_drawdown") >= -0.06
    return q.select("symbol", ok.alias("passed"), F.when(~ok, "excessive drawdown").alias("fail_reason")).where("symbol <> 'ASIA'")


check("j17_holding_receipts", "portfolio_id rank# ticker weight~ risk_contribution~ provider passed? fail_reason",
      lambda v: blend.holding_receipts(v.books_class_table, contributions(v), merge.provenance(v.fact.select(
          F.when(F.col("cls").isin("EUROPE", "ASIA"), F.col("cls")).otherwise(F.concat("cls", F.lit(" (old)"))).alias("ticker"), lookup(F.col("l_returnflag"), PROVIDER_OF_FLAG).alias("provider"), "date")), asset_receipts_c(v)),
      """SELECT r.portfolio_id, row_number() OVER (PARTITION BY r.portfolio_id ORDER BY weight DESC, ticker) AS rank, ticker, weight, risk_contribution,
        CASE WHEN ticker IN ('EUROPE', 'ASIA') THEN 'stooq+tiingo+yfinance' ELSE 'Unknown' END AS provider, m >= -0.06 AS passed, CASE WHEN m < -0.06 THEN 'excessive drawdown' END AS fail_reason
      FROM t_rc r LEFT JOIN (SELECT ticker, min(dd) AS m FROM (SELECT *, value / max(value) OVER (PARTITION BY ticker ORDER BY date) - 1 AS dd FROM (
        SELECT *, product(1 + ret) OVER (PARTITION BY ticker ORDER BY date) AS value FROM t_retc)) WHERE ticker <> 'ASIA' GROUP BY 1) USING (ticker)""")

# ---- R ----------------------------------------------------------------------------------------
check("r01_regime_features", "date@ " + " ".join(f"{c}~" for c in _F), lambda v: macro.regime_features(daily(v)), "SELECT * FROM t_feat")
check("r02_rule_labels", "date@ regime", regime_labels, "SELECT * FROM t_reg")
_APART = " + ".join(f"(f.{c} - r.{c}) ** 2" for c in _F)
_MEANS = ", ".join(f"avg(f.{c}) AS {c}" for c in _F)
CTES["t_lloyd"] = f"""SELECT * FROM (WITH RECURSIVE days AS MATERIALIZED (SELECT *, ntile(4) OVER (ORDER BY cpi_yoy, date) AS run FROM t_feat WHERE {" AND ".join(f"{c} IS NOT NULL" for c in _F)}),
  rounds AS (SELECT 0 AS step, run AS c, {_MEANS} FROM days f GROUP BY run UNION ALL
    SELECT a.step, a.c, {_MEANS} FROM (SELECT f.date, max(r.step) + 1 AS step, arg_min(r.c, {_APART}) AS c FROM days f, rounds r WHERE r.step < 100 GROUP BY f.date) a JOIN days f USING (date) GROUP BY 1, 2)
  SELECT * FROM rounds WHERE step = 100)"""
check("r03_cluster_labels", "date@ regime", lambda v: macro.cluster_regimes(macro.regime_features(daily(v))),
      f"""SELECT date, CASE WHEN u > 0.3 THEN 'Recessionary' WHEN d > 0.3 AND y > 0.3 THEN 'Tightening' WHEN y < -0.3 THEN 'Disinflation' ELSE 'Risk-on' END AS regime FROM (
      SELECT f.date, arg_min(r.unrate_6m_chg, {_APART}) AS u, arg_min(r.dgs10_6m_chg, {_APART}) AS d, arg_min(r.cpi_yoy, {_APART}) AS y FROM t_feat f, t_lloyd r GROUP BY f.date)""")
check("r04_current_regime", "regime", lambda v: macro.current_regime(regime_labels(v)),
      "SELECT regime FROM (SELECT regime FROM t_reg ORDER BY date DESC LIMIT 30) GROUP BY 1 ORDER BY count(*) DESC, regime LIMIT 1")
CTES["t_centred"] = "SELECT series_id, date, CASE WHEN series_id = 'T10Y2Y' THEN value - 49.5 ELSE value END AS value FROM t_macro"
CTES["t_tail"] = """SELECT series_id, avg(value) AS m60, max(value) FILTER (n = 1) AS v0, max(value) FILTER (n = 4) AS v3, max(value) FILTER (n = 7) AS v6 FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS n FROM t_centred) WHERE n <= 60 GROUP BY 1"""
CTES["t_scores"] = """SELECT least(1, greatest(0, s.m60 / 2) + greatest(0, -(u.v0 - u.v6) / abs(u.v6)) + greatest(0, -(c.v0 - c.v6) / abs(c.v6))) AS risk_on,
  least(1, greatest(0, (d.v0 - d.v3) / abs(d.v3)) + greatest(0, -(s.v0 - s.v3) / abs(s.v3))) AS tightening,
  least(1, greatest(0, -s.m60) + greatest(0, (u.v0 - u.v6) / abs(u.v6))) AS recessionary
FROM t_tail s, t_tail u, t_tail c, t_tail d WHERE s.series_id = 'T10Y2Y' AND u.series_id = 'UNRATE' AND c.series_id = 'CPIAUCSL' AND d.series_id = 'DGS10'"""


def centred(v):
    return v.macro.withColumn("value", F.when(F.col("series_id") == "T10Y2Y", F.col("value") - 49.5).otherwise(F.col("value")))


check("r05_macro_scores", "risk_on~ tightening~ recessionary~", lambda v: macro.macro_scores(centred(v)), "SELECT * FROM t_scores")
check("r06_regime_onehot", "regime score~ active?", lambda v: macro.regime_onehot(macro.macro_scores(centred(v))),
      """SELECT 'risk_on' AS regime, risk_on AS score, risk_on >= tightening AND risk_on >= recessionary AS active FROM t_scores UNION ALL
      SELECT 'tightening', tightening, tightening > risk_on AND tightening >= recessionary FROM t_scores UNION ALL
      SELECT 'recessionary', recessionary, recessionary > risk_on AND recessionary > tightening FROM t_scores""")
