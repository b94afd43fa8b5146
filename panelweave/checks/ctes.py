"""Shared SQL common table expressions for the oracle, over the driver's tables."""
from __future__ import annotations

CTES: dict[str, str] = {}

CTES["t_cls"] = """
SELECT * FROM (VALUES ('AFRICA','equity'),('AMERICA','bond'),('ASIA','reit'),('EUROPE','commodity'),('MIDDLE EAST','cash')) v(r, asset_class)"""

CTES["t_fact"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag,
       CAST(l_shipdate AS DATE) AS date, 100.0::DOUBLE * (0.95::DOUBLE + l_discount) AS px, n_name AS ticker, r_name AS cls
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey"""

CTES["t_raw"] = """
SELECT CASE l_returnflag WHEN 'A' THEN 'stooq' WHEN 'N' THEN 'tiingo' ELSE 'yfinance' END AS provider, ticker, date,
  CASE WHEN NOT (l_returnflag = 'N' AND day(date) = 1)
       THEN first(px ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) END AS open,
  max(px) AS high, min(px) AS low, avg(px) AS close,
  CASE WHEN l_returnflag <> 'R' THEN avg(px) END AS adj_close,
  CASE WHEN NOT (l_returnflag = 'A' AND day(date) <= 3) THEN sum(l_quantity) END AS volume
FROM t_fact GROUP BY l_returnflag, ticker, date"""

CTES["t_ohlcv"] = """
SELECT ticker, date, first(px ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS open, max(px) AS high,
  min(px) AS low, avg(px) AS close, avg(px) AS adj_close, sum(l_quantity) AS volume FROM t_fact GROUP BY ticker, date"""

CTES["t_prices"] = "SELECT ticker, date, avg(px) AS price FROM t_fact GROUP BY ticker, date"
CTES["t_prices_class"] = "SELECT cls AS ticker, date, avg(px) AS price FROM t_fact GROUP BY cls, date"


def returns_sql(prices: str, key: str = "ticker") -> str:
    return f"""
SELECT {key}, date, r AS ret FROM (
  SELECT p.{key}, p.date, price / lag(price) OVER w - 1 AS r, lag(p.date) OVER w AS d0, c.prev
  FROM {prices} p JOIN (SELECT date, lag(date) OVER (ORDER BY date) AS prev FROM (SELECT DISTINCT date FROM {prices})) c
    ON p.date = c.date WINDOW w AS (PARTITION BY p.{key} ORDER BY p.date)) WHERE d0 = prev"""


CTES["t_ret"] = returns_sql("t_prices")
CTES["t_retc"] = returns_sql("t_prices_class")

CTES["t_catalog"] = """
SELECT n_name AS symbol, asset_class,
  CASE asset_class WHEN 'equity' THEN if(n_nationkey % 2 = 0, 'public_equity', 'public_equity_intl')
    WHEN 'bond' THEN if(n_nationkey % 2 = 0, 'treasury_long', 'corporate_bond') WHEN 'reit' THEN 'reit'
    WHEN 'commodity' THEN if(n_nationkey % 2 = 0, 'gold', 'commodities') ELSE 'tbills' END AS class,
  if(n_nationkey % 2 = 0, 'core', 'satellite') AS core_or_satellite, n_nationkey AS ordinal
FROM nation JOIN region ON n_regionkey = r_regionkey JOIN t_cls ON r = r_name"""

CTES["t_catalog_class"] = """
SELECT r_name AS symbol, asset_class,
  if(r_name IN ('AFRICA','AMERICA','MIDDLE EAST'), 'core', 'satellite') AS core_or_satellite
FROM region JOIN t_cls ON r = r_name"""

CTES["t_listing"] = """
SELECT s_name AS symbol, 'Fund ' || s_suppkey AS name, asset_class,
  CASE WHEN s_suppkey % 7 = 0 THEN 'single_stock' ELSE
  CASE asset_class WHEN 'equity' THEN if(s_suppkey % 2 = 0, 'public_equity', 'public_equity_intl')
    WHEN 'bond' THEN if(s_suppkey % 2 = 0, 'treasury_long', 'corporate_bond') WHEN 'reit' THEN 'reit'
    WHEN 'commodity' THEN if(s_suppkey % 2 = 0, 'gold', 'commodities') ELSE 'tbills' END END AS class,
  CASE s_suppkey % 4 WHEN 1 THEN 'tech' WHEN 2 THEN 'energy' WHEN 3 THEN 'health' END AS sector,
  r_name AS region, n_name AS ticker, if(s_suppkey % 9 = 8, 'accredited', 'retail') AS eligibility,
  if(s_suppkey % 3 = 0, 'satellite', 'core') AS risk_bucket, if(s_suppkey % 3 = 0, 'satellite', 'core') AS core_or_satellite,
  0.1::DOUBLE + (s_suppkey % 5) * 0.25::DOUBLE AS max_weight, 5.0::DOUBLE + (s_suppkey % 4) * 5.0::DOUBLE AS min_history_years,
  s_suppkey AS ordinal
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN t_cls ON r = r_name"""

CTES["t_spend"] = """
SELECT CAST(o_custkey AS VARCHAR) AS customer, c_nationkey || '|' || c_mktsegment AS book, ticker, cls, l_extendedprice AS x
FROM t_fact JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"""


def _weights(portfolio: str, ticker: str) -> str:
    return f"""
SELECT portfolio_id, ticker, spend / sum(spend) OVER (PARTITION BY portfolio_id) AS weight
FROM (SELECT {portfolio} AS portfolio_id, {ticker} AS ticker, sum(x) AS spend FROM t_spend GROUP BY ALL)"""


CTES["t_weights"] = _weights("customer", "ticker")
CTES["t_books"] = _weights("book", "ticker")
CTES["t_booksc"] = _weights("book", "cls")

CTES["t_macro"] = """
SELECT CASE event_type WHEN 'click' THEN 'DGS10' WHEN 'view' THEN 'CPIAUCSL' WHEN 'error' THEN 'UNRATE'
  WHEN 'purchase' THEN 'FEDFUNDS' ELSE 'T10Y2Y' END AS series_id,
  DATE '2000-01-01' + CAST((date_diff('hour', TIMESTAMP '2024-01-01', date_trunc('hour', ts))) AS INTEGER) AS date,
  avg(value) AS value FROM events GROUP BY 1, 2"""

CTES["t_users"] = """
SELECT c_custkey AS user_id, c_nationkey AS nation_key, c_mktsegment,
  ['0–3 years','3–7 years','7–15 years','15+ years','(no answer)'][1 + (c_custkey * 3 % 80) // 16] AS q1_time_horizon,
  ['Very low','Low','Medium','High','Very high','(no answer)'][1 + (c_custkey * 4 % 96) // 16] AS q2_loss_tolerance,
  ['Sell everything immediately','Sell some to reduce risk','Hold and wait','Hold and might buy more',
   'Definitely buy more (opportunity)','(no answer)'][1 + (c_custkey * 5 % 96) // 16] AS q3_reaction_20_drop,
  ['Very unstable','Unstable','Moderate','Stable','Very stable','(no answer)'][1 + (c_custkey * 6 % 96) // 16] AS q4_income_stability,
  ['Critical for living expenses','Important but not critical','Helpful but have other income',
   'Nice-to-have growth money','(no answer)'][1 + (c_custkey * 7 % 80) // 16] AS q5_dependence_on_money,
  ['Beginner (first time)','Some experience (< 3 years)','Experienced (3-10 years)','Advanced (10+ years)',
   '(no answer)'][1 + (c_custkey * 8 % 80) // 16] AS q6_investing_experience,
  ['No emergency fund or insurance','Small emergency fund (< 3 months)','Moderate safety net (3-6 months)',
   'Strong safety net (6+ months)','(no answer)'][1 + (c_custkey * 9 % 80) // 16] AS q7_safety_net,
  ['Capital preservation (safety first)','Income generation (steady returns)','Balanced growth (moderate risk)',
   'Aggressive growth (max returns)','(no answer)'][1 + (c_custkey * 10 % 80) // 16] AS q8_goal_type,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Very stable' WHEN 'BUILDING' THEN 'Stable' WHEN 'FURNITURE' THEN 'Moderate'
    WHEN 'MACHINERY' THEN 'Unstable' WHEN 'HOUSEHOLD' THEN 'Very unstable' END AS income_stability,
  c_nationkey / 3.0::DOUBLE AS emergency_fund_months, greatest(c_acctbal, 0) * 10 AS investable_amount,
  CASE WHEN c_custkey % 50 = 0 THEN 0.0 ELSE 1000.0 + c_nationkey * 100 END::DOUBLE AS monthly_expenses,
  (greatest(-c_acctbal, 0) * 100 + (c_custkey % 7) * 20000)::DOUBLE AS outstanding_debt,
  ((c_custkey % 11) * 25000)::DOUBLE AS annual_income, c_acctbal * 3000 AS net_worth, c_custkey % 21 AS horizon_years,
  ['CONSERVATIVE','BALANCED','GROWTH','GROWTH_PLUS_INCOME','AGGRESSIVE','INCOME'][1 + c_nationkey % 6] AS objective,
  ['grow','grow_income','income','preserve','tax_efficiency','other'][1 + c_custkey % 6] AS goal,
  CASE WHEN c_custkey % 3 <> 0 THEN ((c_custkey * 7) % 121 - 10)::DOUBLE END AS slider
FROM customer"""

CTES["t_flow_out"] = """
SELECT o_custkey AS account_id, CAST(o_orderdate AS DATE) AS date, -sum(o_totalprice) AS amount FROM orders GROUP BY 1, 2"""
CTES["t_flows"] = """
SELECT * FROM t_flow_out UNION ALL
SELECT account_id, DATE '2003-01-01', -sum(amount) * (0.5::DOUBLE + (account_id % 10) * 0.15::DOUBLE) FROM t_flow_out
WHERE account_id % 13 <> 0 GROUP BY account_id"""
