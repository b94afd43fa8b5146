"""C family: reshape, cleaning, calendars."""
from pyspark.sql import functions as F

from ..operators import clean
from .ctes import CTES, returns_sql
from .registry import check

PANEL = "ticker date@ price~"
RET = "ticker date@ ret~"
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def messy(v):
    """Several rows per key, junk prices and blank symbols, as strings."""
    bad = F.dayofmonth("date") == 13
    return v.prices_raw.select(
        F.when(F.col("provider") == "yfinance", F.concat(F.lit(" "), "ticker")).otherwise(F.col("ticker")).alias("symbol"),
        F.col("date").cast("string").alias("Date"), F.when(bad, "n/a").otherwise(F.col("close").cast("string")).alias("close"),
        F.when(F.col("provider") == "stooq", 0).when(F.col("provider") == "tiingo", 1).otherwise(2).alias("seq"))


check("c01_tidy_prices", PANEL, lambda v: clean.tidy_prices(messy(v), seq="seq"),
      """SELECT ticker, date, close AS price FROM t_raw WHERE day(date) <> 13
      QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY provider) = 1""")

check("c02_to_wide", "date@ AFRICA~ AMERICA~ ASIA~ EUROPE~ MIDDLE_EAST~",
      lambda v: clean.to_wide(v.prices_class, REGIONS).withColumnRenamed("MIDDLE EAST", "MIDDLE_EAST"),
      "SELECT date, " + ", ".join(f"max(price) FILTER (ticker = '{r}') AS {r.replace(' ', '_')}" for r in REGIONS)
      + " FROM t_prices_class GROUP BY date")

NATIONS = [f"NATION_{i}" for i in range(25)]
check("c03_outer_align", "date@ " + " ".join(f"{n}~" for n in [*NATIONS, *(r.replace(" ", "_") for r in REGIONS)]), lambda v: clean.align_outer(
      {n: v.prices.where(F.col("ticker") == n) for n in NATIONS} | {r.replace(" ", "_"): v.prices_class.where(F.col("ticker") == r) for r in REGIONS}),
      "SELECT date, " + ", ".join([f"max(price) FILTER (ticker = '{n}') AS {n}" for n in NATIONS] + [f"max(price) FILTER (ticker = '{r}') AS {r.replace(' ', '_')}" for r in REGIONS])
      + " FROM (SELECT ticker, date, price FROM t_prices UNION ALL SELECT ticker, date, price FROM t_prices_class) GROUP BY date")

check("c04_melt", "date@ series value~", lambda v: clean.melt(clean.to_wide(v.prices_class, REGIONS), REGIONS),
      "SELECT date, ticker AS series, price AS value FROM t_prices_class")

check("c05_week_last", "ticker period_end@ price~", lambda v: clean.period_last(v.prices, "W"),
      "SELECT ticker, CAST(date_trunc('week', date) AS DATE) + 6 AS period_end, arg_max(price, date) AS price FROM t_prices GROUP BY 1, 2")
check("c05_month_last", "ticker period_end@ price~", lambda v: clean.period_last(v.prices, "M"),
      "SELECT ticker, last_day(date) AS period_end, arg_max(price, date) AS price FROM t_prices GROUP BY 1, 2")


def _dense(key, src, value, where=""):
    return f"""SELECT {key}, date, last_value({value} IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY date) AS {value} FROM (
      SELECT s.{key}, s.date, p.{value} FROM (SELECT {key}, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
        FROM {src} GROUP BY {key}) s LEFT JOIN {src} p ON s.{key} = p.{key} AND s.date = p.date {where})"""


check("c06_business_day_fill", PANEL, lambda v: clean.densify(v.prices, business_days=True),
      _dense("ticker", "t_prices", "price", "WHERE isodow(s.date) <= 5"))
CTES["t_macrod"] = _dense("series_id", "t_macro", "value")
check("c07_calendar_day_fill", "series_id date@ value~", lambda v: clean.densify(v.macro, "series_id", "value"),
      "SELECT * FROM t_macrod")

check("c08_simple_returns", RET, lambda v: v.returns, "SELECT * FROM t_ret")
CTES["t_pw"] = "SELECT ticker, CAST(date_trunc('week', date) AS DATE) + 6 AS date, arg_max(price, date) AS price FROM t_prices GROUP BY 1, 2"
check("c08_weekly_returns", RET, lambda v: clean.simple_returns(v.prices, "W"), returns_sql("t_pw"))
check("c08_own_row_returns", RET, lambda v: clean.own_returns(v.prices),
      "SELECT ticker, date, ret FROM (SELECT *, price / lag(price) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM t_prices) WHERE ret IS NOT NULL")


def _fill(src):
    return f"""SELECT ticker, date, price, filled FROM (
      SELECT ticker, date, p0, last_value(p0 IGNORE NULLS) OVER w AS price, p0 IS NULL AS filled,
        idx - last_value(CASE WHEN p0 IS NOT NULL THEN idx END IGNORE NULLS) OVER w AS gap FROM (
        SELECT t.ticker, c.date, c.idx, p.price AS p0 FROM (SELECT DISTINCT ticker FROM {src}) t
        CROSS JOIN (SELECT date, row_number() OVER (ORDER BY date) AS idx FROM (SELECT DISTINCT date FROM {src})) c
        LEFT JOIN {src} p ON p.ticker = t.ticker AND p.date = c.date)
      WINDOW w AS (PARTITION BY ticker ORDER BY date)) WHERE gap <= 5"""


CTES["t_fill"] = _fill("t_prices")
CTES["t_fillc"] = _fill("t_prices_class")
check("c09_bounded_fill", PANEL + " filled?", lambda v: clean.bounded_fill(v.prices), "SELECT * FROM t_fill")

check("c10_trailing_dates", PANEL, lambda v: clean.trailing_dates(v.prices, 300),
      "SELECT * FROM t_prices WHERE date IN (SELECT DISTINCT date FROM t_prices ORDER BY date DESC LIMIT 300)")

check("c11_min_observations", RET, lambda v: clean.min_observations(v.returns, 126),
      "SELECT * FROM t_ret QUALIFY count(*) OVER (PARTITION BY ticker) >= 126")
check("c11_dropped_symbols", "ticker reason", lambda v: clean.dropped_for_observations(v.prices, v.returns, 600),
      """SELECT DISTINCT ticker, 'too-few-points' AS reason FROM t_prices WHERE ticker NOT IN
      (SELECT ticker FROM t_ret GROUP BY 1 HAVING count(*) >= 600)""")

CLIP = "greatest(quantile_cont(ret, {p}) OVER (PARTITION BY ticker), least(quantile_cont(ret, 1 - {p}) OVER (PARTITION BY ticker), ret))"
check("c12_quantile_winsorise", RET, lambda v: clean.winsorise(v.returns, 0.01),
      """SELECT r.ticker, date, greatest(lo, least(hi, ret)) AS ret FROM t_ret r JOIN (SELECT ticker, quantile_cont(ret, 0.01) AS lo,
      quantile_cont(ret, 0.99) AS hi FROM t_ret GROUP BY 1) q ON r.ticker = q.ticker""")

check("c13_order_statistic_winsorise", RET, lambda v: clean.winsorise_by_count(v.returns, 0.02),
      """SELECT ticker, date, greatest(max(CASE WHEN rn = k + 1 THEN ret END) OVER w, least(max(CASE WHEN rn = n - k THEN ret END) OVER w, ret)) AS ret
      FROM (SELECT *, floor(n * 0.02) AS k FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ret, date) AS rn,
        count(*) OVER (PARTITION BY ticker) AS n FROM t_ret)) WINDOW w AS (PARTITION BY ticker)""")

check("c14_complete_case", RET, lambda v: clean.complete_case(v.returns_class),
      "SELECT * FROM t_retc QUALIFY count(*) OVER (PARTITION BY date) = (SELECT count(DISTINCT ticker) FROM t_retc)")

check("c15_zero_variance_drop", RET, lambda v: clean.drop_constant(
      v.returns.withColumn("ret", F.when(F.col("ticker").endswith("3"), 0.0).otherwise(F.col("ret")))),
      "SELECT * FROM t_ret WHERE ticker NOT LIKE '%3'")


def _strict(src, min_obs, p):
    return f"""SELECT ticker, date, ret FROM (SELECT r.ticker, date, greatest(lo, least(hi, ret)) AS ret FROM {src} r JOIN (
      SELECT ticker, quantile_cont(ret, {p}) AS lo, quantile_cont(ret, 1 - {p}) AS hi, count(*) AS n FROM {src} GROUP BY 1 HAVING n >= {min_obs}) q
      ON r.ticker = q.ticker) QUALIFY count(*) OVER (PARTITION BY date) = (SELECT count(*) FROM (SELECT 1 FROM {src} GROUP BY ticker HAVING count(*) >= {min_obs}))"""


CTES["t_strict"] = _strict("t_retc", 252, 0.005)
check("c16_strict_returns", RET, lambda v: clean.strict_returns(v.prices_class), "SELECT * FROM t_strict")

CTES["t_rfill"] = returns_sql("t_fillc")
CTES["t_rwin"] = """
SELECT * FROM t_rfill WHERE date IN (SELECT DISTINCT date FROM t_prices_class ORDER BY date DESC LIMIT 1260)
  AND ticker IN (SELECT ticker FROM t_rfill GROUP BY 1 HAVING count(*) >= 126)"""
check("c17_robust_returns", RET, lambda v: clean.robust_returns(v.prices_class), _strict("t_rwin", 126, 0.005))
CTES["t_rfilln"] = returns_sql("t_fill")
check("c17_robust_diagnostics", "ticker n_obs# n_window# reason", lambda v: clean.robust_diagnostics(v.prices, 400, 600),
      """SELECT *, CASE WHEN n_obs < 400 THEN 'too-few-points' WHEN n_window < 400 THEN 'too-few-points-window' END AS reason FROM (
      SELECT t.ticker, count(ret) AS n_obs, count(CASE WHEN date IN (SELECT DISTINCT date FROM t_prices ORDER BY date DESC LIMIT 600) THEN ret END) AS n_window
      FROM (SELECT DISTINCT ticker FROM t_prices) t LEFT JOIN t_rfilln r ON t.ticker = r.ticker GROUP BY 1)""")

CTES["t_win"] = "SELECT * FROM t_prices WHERE date IN (SELECT DISTINCT date FROM t_prices ORDER BY date DESC LIMIT 1260)"
CTES["t_rank"] = "SELECT ticker, n_obs, row_number() OVER (ORDER BY n_obs DESC, ticker) AS rk FROM (SELECT ticker, count(*) AS n_obs FROM t_win GROUP BY 1) WHERE n_obs >= 126"
CTES["t_try"] = """
SELECT n, sum((have = n)::INT) / count(*) AS ratio FROM (
  SELECT k.rk AS n, w.date, count(*) AS have FROM t_rank k JOIN t_rank r ON r.rk <= k.rk JOIN t_win w ON w.ticker = r.ticker GROUP BY 1, 2) GROUP BY n"""
check("c18_overlap_preclean", "ticker n_obs# coverage~ kept? reason", lambda v: clean.overlap_preclean(v.prices, min_overlap=0.10),
      """SELECT c.ticker, c.n_obs, c.n_obs / (SELECT count(DISTINCT date) FROM t_win) AS coverage, coalesce(rk <= take, false) AS kept,
        CASE WHEN rk IS NULL THEN 'only_' || c.n_obs || '_obs' WHEN rk > take
          THEN 'low_overlap_' || printf('%.1f%%', 100.0 * c.n_obs / (SELECT count(DISTINCT date) FROM t_win)) END AS reason
      FROM (SELECT ticker, count(*) AS n_obs FROM t_win GROUP BY 1) c LEFT JOIN t_rank r ON c.ticker = r.ticker,
      (SELECT coalesce((SELECT max(n) FROM t_try WHERE n >= 3 AND ratio >= 0.10), (SELECT max(rk) FROM t_rank)) AS take)""")

check("c19_numeric_clean", RET, lambda v: clean.numeric_clean(v.returns_class, 0.005), _strict("t_retc", 2, 0.005))

check("c20_unique_symbols", "symbol exchange_symbol ordinal#", lambda v: clean.unique_symbols(
      v.table("supplier").select(
          F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit(" nat"), F.chr(97 + F.col("s_nationkey")), F.lit(" ")))
          .otherwise(F.concat(F.lit("NAT"), (F.col("s_nationkey") % 7).cast("string"))).alias("symbol"),
          F.col("s_suppkey").alias("ordinal"))).withColumn("exchange_symbol", clean.normalise_symbol("symbol", True)),
      """SELECT symbol, ordinal, CASE WHEN regexp_full_match(lower(symbol), '[a-z]+') THEN lower(symbol) || '.us' ELSE lower(symbol) END AS exchange_symbol
      FROM (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'NAT' || upper(chr(97 + s_nationkey)) ELSE 'NAT' || (s_nationkey % 7) END AS symbol,
        s_suppkey AS ordinal FROM supplier) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ordinal) = 1""")
