"""S family: scans and sinks; V family: universe; Q family: gates."""
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.expr import choose, mod
from ..operators import gates, merge, stats, universe
from ..session import shared_folder
from ..sources import catalog as cat, landing, sinks
from .ctes import CTES
from .investor_checks import objectives, profiles
from .registry import check
from .stats_checks import annual_sql, port, portc

C = F.col
BAR = "ticker date@ open~ high~ low~ close~ adj_close~ volume~"


# ---- S ----------------------------------------------------------------------------------------
def landed(v):
    """The panel as per-symbol CSV folders in two header layouts, read back."""
    root = shared_folder(v.spark)
    odd = C("ticker").rlike("[13579]$")
    full = v.ohlcv.where(~odd).select(C("ticker").alias("symbol"), C("date").alias("Date"), C("open").alias("Open"), C("high").alias("High"),
                                      C("low").alias("Low"), C("close").alias("Close"), C("volume").alias("Volume"))
    full.repartition("symbol", F.year("Date")).write.partitionBy("symbol").option("header", True).csv(f"{root}/full")
    v.prices.where(odd).select(C("ticker").alias("symbol"), "date", "price").repartition("symbol").write.partitionBy("symbol").option("header", True).csv(f"{root}/short")
    return landing.canonical_bars(landing.scan_price_files(v.spark, [f"{root}/full", f"{root}/short"], start="1997-01-01", end="2000-06-30"))


check("s01_landed_price_files", BAR, landed,
      """SELECT ticker, date, CASE WHEN e THEN open END AS open, CASE WHEN e THEN high END AS high, CASE WHEN e THEN low END AS low, close, close AS adj_close,
      CASE WHEN e THEN volume END AS volume FROM (SELECT *, NOT regexp_matches(ticker, '[13579]$') AS e FROM t_ohlcv) WHERE date BETWEEN DATE '1997-01-01' AND DATE '2000-06-30'""")


def messy_bars(v):
    """Text columns with odd headers, unreadable numbers and dates, missing closes."""
    day = F.dayofmonth("date")
    t = lambda c: C(c).cast("string")
    return v.prices_raw.select(
        "provider", C("ticker").alias("Ticker"), F.when(day == 31, "not a date").otherwise(t("date")).alias("Date"), F.when(day == 13, "n/a").otherwise(t("open")).alias("Open"),
        F.when(day == 7, None).otherwise(t("high")).alias("HIGH"), t("low").alias("low"), F.when(day == 9, "NaN").otherwise(t("close")).alias("Close"),
        t("adj_close").alias("Adj Close"), t("volume").alias("Volume"))


check("s02_canonical_bars", BAR + " provider", lambda v: landing.canonical_bars(messy_bars(v)),
      """SELECT provider, ticker, date, CASE WHEN day(date) <> 13 THEN open END AS open, CASE WHEN day(date) <> 7 THEN high END AS high, low,
      CASE WHEN day(date) <> 9 THEN close END AS close, coalesce(adj_close, CASE WHEN day(date) <> 9 THEN close END) AS adj_close, volume FROM t_raw WHERE day(date) <> 31""")
SEQ = "row_number() OVER (PARTITION BY ticker, date ORDER BY provider {d}) = 1"
check("s03_dedupe_keep_last", BAR + " provider", lambda v: merge.dedupe_dates(v.prices_raw, "provider", "last"), f"SELECT * FROM t_raw QUALIFY {SEQ.format(d='DESC')}")
check("s03_dedupe_keep_first", BAR + " provider", lambda v: merge.dedupe_dates(v.prices_raw, "provider", "first"), f"SELECT * FROM t_raw QUALIFY {SEQ.format(d='')}")
check("s04_price_column", "provider ticker date@ price~", lambda v: v.prices_raw.withColumn("price", landing.price_column(v.prices_raw)),
      "SELECT provider, ticker, date, coalesce(adj_close, close) AS price FROM t_raw")


def payloads(v):
    k = C("o_orderkey").cast("long")
    texts = ["date,close\n2000-01-01,1 ", "Error: not found ", "You have exceeded the hourly limit ", "  ", '{"detail": "ERROR"} ', "<html>" + "x" * 400 + " Too many requests ", "date,close,error\n", '{"rows": []} ']
    note = F.when(mod(k, len(texts)) == 3, "").otherwise(F.concat_ws(" ", "o_orderpriority", "o_orderstatus"))
    return v.table("orders").select(k.alias("id"), F.concat(choose(texts, mod(k, len(texts))), note).alias("body"))


check("s05_payload_quarantine", "id# kind", lambda v: landing.split_payloads(payloads(v))[1].unionByName(
      landing.split_payloads(payloads(v))[0].withColumn("kind", F.lit("ok"))),
      "SELECT o_orderkey AS id, ['ok','error','rate_limit','error','error','rate_limit','ok','ok'][1 + o_orderkey % 8] AS kind FROM orders")


def aggregate_documents(v):
    ms = F.datediff("date", F.lit("1970-01-01").cast("date")).cast("long") * 86400000 + 18000000
    row = F.struct(ms.alias("t"), C("open").alias("o"), C("high").alias("h"), C("low").alias("l"), C("close").alias("c"), C("volume").alias("v"))
    return v.ohlcv.groupBy("ticker", F.year("date")).agg(F.to_json(F.struct(F.collect_list(row).alias("results"))).alias("body"))


check("s06_aggregate_documents", BAR, lambda v: landing.aggregate_bars(aggregate_documents(v)), "SELECT * FROM t_ohlcv")
check("s06_dividend_documents", "ticker ex_dividend_date cash_amount~ currency", lambda v: landing.reference_rows(
      v.prices.select(F.to_json(F.struct(F.array(F.struct(
          C("ticker"), C("date").cast("string").alias("ex_dividend_date"), (C("price") / 100).alias("cash_amount"))).alias("results"))).alias("body")), landing.DIVIDENDS),
      "SELECT ticker, CAST(date AS VARCHAR) AS ex_dividend_date, price / 100 AS cash_amount, CAST(NULL AS VARCHAR) AS currency FROM t_prices")


def documents(v):
    """Catalog documents, one per region, with a repeated lower-case symbol each."""
    a = F.struct(F.lower("symbol").alias("symbol"), "name", "class", "asset_class", "sector", "region", "eligibility", "risk_bucket", "core_or_satellite", "max_weight", "min_history_years")
    caps = F.create_map(*[F.lit(x) for kv in fixed.CLASS_CAPS.items() for x in kv])
    g = v.listing.groupBy("region").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", a.alias("a")))), lambda x: x["a"]).alias("a"))
    return g.select("region", F.to_json(F.struct(F.concat("a", F.slice("a", 1, 1)).alias("assets"), F.struct(caps.alias("asset_class")).alias("caps"))).alias("body"))


check("s07_catalog_assets", "symbol name class asset_class sector eligibility max_weight~", lambda v: cat.catalog_assets(documents(v)),
      "SELECT upper(symbol) AS symbol, name, class, asset_class, sector, eligibility, max_weight FROM t_listing")
check("s07_class_caps", "asset_class cap~ documents#", lambda v: cat.class_caps(documents(v)).groupBy("asset_class", "cap").agg(F.count("*").alias("documents")),
      """SELECT asset_class, cap, (SELECT count(DISTINCT region) FROM t_listing) AS documents FROM (VALUES ('equity', 0.65), ('bond', 0.70), ('commodity', 0.20), ('cash', 0.20), ('reit', 0.20)) c(asset_class, cap)""")
check("s08_universe_filter", "symbol asset_class min_history_years~", lambda v: cat.filter_universe(v.listing, ["equity", "bond"], 10.0, True),
      "SELECT * FROM t_listing WHERE asset_class IN ('equity','bond') AND min_history_years >= 10 AND core_or_satellite = 'core'")
check("s08_symbols_by_class", "asset_class symbols", lambda v: cat.symbols_by_class(v.listing).withColumn("symbols", F.array_join("symbols", ",")),
      "SELECT asset_class, string_agg(symbol, ',' ORDER BY ordinal) AS symbols FROM t_listing GROUP BY 1")


def landed_macro(v):
    root = shared_folder(v.spark)
    names = {"DGS10": ("date", "value"), "CPIAUCSL": ("DATE", "CPIAUCSL"), "UNRATE": ("Date", "VALUE"), "FEDFUNDS": ("date", "FEDFUNDS"), "T10Y2Y": ("DATE", "value")}
    paths = {}
    for s, (d, x) in names.items():
        paths[s] = f"{root}/{s}"
        v.macro.where(C("series_id") == s).select(C("date").alias(d), F.when(F.dayofmonth("date") == 5, ".").otherwise(C("value").cast("string")).alias(x)).write.option("header", True).csv(paths[s])
    return landing.scan_macro_files(v.spark, paths, start="2000-03-01")


check("s09_macro_files", "series_id date@ value~", landed_macro,
      "SELECT series_id, date, CASE WHEN day(date) <> 5 THEN value END AS value FROM t_macro WHERE date >= DATE '2000-03-01'")
check("s09_macro_wide", "date@ DGS10~ UNRATE~", lambda v: landing.macro_wide(v.macro, ["DGS10", "UNRATE"]).where("DGS10 IS NOT NULL OR UNRATE IS NOT NULL"),
      """SELECT date, max(value) FILTER (series_id = 'DGS10') AS "DGS10", max(value) FILTER (series_id = 'UNRATE') AS "UNRATE" FROM t_macro WHERE series_id IN ('DGS10','UNRATE') GROUP BY 1""")


def filing_paths(v):
    k = C("o_orderkey").cast("long")
    o = v.table("orders").join(v.table("customer"), C("o_custkey") == C("c_custkey"))
    return o.select(F.concat(F.lit("file:/sec/"), C("c_mktsegment"), F.lit("/"), choose(["10_K", "10-Q", "8_K", "S-1"], mod(k, 4)), F.lit("/"), k.cast("string"), F.lit("_"),
                             F.to_date("o_orderdate").cast("string"), choose(["_full.txt", ".html", "_x.pdf"], mod(k, 3))).alias("path"))


check("s10_filings_summary", "symbol form filings# last_date@", lambda v: landing.filings_summary(filing_paths(v), F.lit("2000-12-31").cast("date"), 730),
      """SELECT c_mktsegment AS symbol, ['10-K','10-Q','8-K'][1 + o_orderkey % 4] AS form, count(*) AS filings, max(CAST(o_orderdate AS DATE)) AS last_date
      FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 4 < 3 AND o_orderkey % 3 < 2 AND CAST(o_orderdate AS DATE) >= DATE '2000-12-31' - 730 GROUP BY 1, 2""")


def price_store(v):
    root = shared_folder(v.spark)
    one = merge.merge_providers(v.prices_raw, ["stooq", "tiingo", "yfinance"])
    sinks.write_price_store(one, root, F.lit("2001-12-31").cast("timestamp_ntz"), min_rows=1000)
    prices, manifest = sinks.read_price_store(v.spark, root)
    kept = prices.groupBy("ticker").agg(F.count("*").alias("stored"), F.sum("close").alias("close_sum"))
    return manifest.join(kept, "ticker")


check("s11_price_store", "ticker start@ end@ rows# stored# close_sum~3 source", price_store,
      f"""SELECT ticker, min(date) AS start, max(date) AS "end", count(*) AS rows, count(*) AS stored, sum(close) AS close_sum, min(provider) || '.api' AS source FROM (
      SELECT * FROM t_raw QUALIFY {SEQ.format(d='')}) GROUP BY 1 HAVING count(*) >= 1000""")


def scenario_files(v):
    root = shared_folder(v.spark)
    regions = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    h = stats.horizon_metrics(portc(v))
    m = stats.annualized_metrics(portc(v), "portfolio_id")
    sinks.write_scenario(m, v.books_class, h, regions, list(stats.HORIZONS), root)
    read = lambda n: v.spark.read.option("header", True).csv(f"{root}/{n}")
    w = read("weights").select("portfolio_id", *[C(f"`{r}`").cast("double").alias(r) for r in regions])
    w = w.select("portfolio_id", sum([C(f"`{r}`") for r in regions[1:]], C("AFRICA")).alias("total"), C("ASIA").alias("asia"))
    x = read("metrics").select("portfolio_id", C("`1y_volatility`").cast("double").alias("vol_1y"), C("`3y_max_dd`").cast("double").alias("dd_3y"))
    c = v.spark.read.schema("portfolio_id string, metrics struct<sharpe double, n long>, weights map<string, double>").json(f"{root}/candidates")
    return c.select("portfolio_id", "metrics.n", "metrics.sharpe", F.size("weights").alias("holdings")).join(w, "portfolio_id").join(x, "portfolio_id")


CTES["t_horc"] = """SELECT portfolio_id, horizon, date, ret FROM (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY date DESC) AS rn FROM t_portc)
  JOIN (VALUES ('1y', 252), ('3y', 756)) h(horizon, days) ON rn <= days"""
CTES["t_hm"] = annual_sql("t_horc", "portfolio_id, horizon")
check("s12_scenario_files", "portfolio_id n# sharpe~ holdings# total~ asia~ vol_1y~ dd_3y~", scenario_files,
      f"""SELECT * FROM (SELECT portfolio_id, n, sharpe FROM ({annual_sql("t_portc", "portfolio_id")}))
      JOIN (SELECT portfolio_id, count(*) AS holdings, sum(weight) AS total, coalesce(max(weight) FILTER (ticker = 'ASIA'), 0) AS asia FROM t_booksc GROUP BY 1) USING (portfolio_id)
      JOIN (SELECT portfolio_id, max(volatility) FILTER (horizon = '1y') AS vol_1y, max(max_dd) FILTER (horizon = '3y') AS dd_3y FROM t_hm GROUP BY 1) USING (portfolio_id)""")


# ---- V ----------------------------------------------------------------------------------------
def records(v):
    absent = v.table("region").select(C("r_name").alias("symbol"), F.lit("equity").alias("asset_class"), F.lit("satellite").alias("core_or_satellite"))
    return universe.validate_catalog(v.catalog.select("symbol", "asset_class", "core_or_satellite").union(absent), v.ohlcv, 6.8, 6.7, 45.0, 30.0)


CTES["t_rec0"] = """SELECT c.symbol, c.asset_class, core_or_satellite, start, "end", n, coalesce(("end" - start) / 365.25::DOUBLE, 0) AS years,
  greatest(0.0, (1 - n / expected) * 100) AS gap, vol, if(core_or_satellite = 'core', 6.8, 6.7) AS floor FROM (
  SELECT symbol, asset_class, core_or_satellite FROM t_catalog UNION ALL SELECT r_name, 'equity', 'satellite' FROM region) c
  LEFT JOIN (SELECT *, len(list_filter(generate_series(start, "end", INTERVAL 1 DAY), lambda x: isodow(x) <= 5))::DOUBLE AS expected FROM (
    SELECT ticker, min(date) AS start, max(date) AS "end", count(*) AS n, median(volume) AS vol FROM t_ohlcv GROUP BY 1)) g ON c.symbol = ticker"""
CTES["t_rec"] = """SELECT symbol, asset_class, core_or_satellite, start, "end", round(years, 2) AS history_years, if(n IS NULL, 100, round(gap, 2)) AS missing_pct,
  coalesce(n, 0) AS n_obs, floor(vol) AS median_volume, coalesce(h AND m AND l, false) AS valid,
  CASE WHEN n IS NULL THEN 'no_data' ELSE nullif(concat_ws(',', CASE WHEN NOT h THEN 'years<7' END, CASE WHEN NOT m THEN 'missing>' END, CASE WHEN NOT l THEN 'vol<30.0' END), '') END AS reason
FROM (SELECT *, years >= floor - 0.01 AS h, gap <= 45 AS m, vol >= 30 AS l FROM t_rec0)"""
REC = "symbol asset_class core_or_satellite start@ end@ history_years~ missing_pct~ n_obs# median_volume~ valid? reason"


def snapshot(v):
    root = shared_folder(v.spark)
    sinks.write_universe_snapshot(records(v), universe.universe_metrics(records(v), v.returns), root)
    good, metrics = sinks.read_universe_snapshot(v.spark, root)
    return good.withColumn("metric_rows", metrics.agg(F.count("*")).scalar())


check("s13_universe_snapshot", REC + " metric_rows#", snapshot,
      """SELECT *, (SELECT count(DISTINCT asset_class) + count(DISTINCT core_or_satellite) + 8 FROM t_rec WHERE valid) AS metric_rows FROM t_rec WHERE valid""")
check("s14_objective_bands", "user_id# label asset_class band_min~ band_max~ max_holdings#", lambda v: v.users.join(
      objectives(v)[0], C("objective") == C("name")).join(objectives(v)[1], "name"),
      """SELECT user_id, label, asset_class, band_min, band_max, CASE objective WHEN 'CONSERVATIVE' THEN 15 WHEN 'AGGRESSIVE' THEN 18 ELSE 20 END AS max_holdings
      FROM t_users JOIN t_obj o ON objective = o.name JOIN t_bands b ON b.name = o.name""")

RETAIL = "SELECT * FROM t_listing WHERE eligibility = 'retail'"
UNI = "SELECT symbol, if(risk_bucket = 'core', 0, 1) AS bucket, ordinal AS position FROM"
check("v01_build_universe", "symbol bucket# position#", lambda v: universe.build_universe(v.listing, sector_caps={"tech": 0.5, "health": 0.3}, min_size=3),
      f"""{UNI} (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY ordinal) AS k, count(*) OVER (PARTITION BY sector) AS n FROM ({RETAIL}))
      WHERE sector IS NULL OR k <= greatest(1, floor(CASE sector WHEN 'tech' THEN 0.5 WHEN 'health' THEN 0.3 END * n))""")
check("v01_preserve_universe", "symbol bucket# position#", lambda v: universe.build_universe(v.listing, "preserve", min_size=3), f"{UNI} ({RETAIL}) WHERE class <> 'single_stock'")
check("v02_validate_catalog", REC, records, "SELECT * FROM t_rec")
check("v03_universe_metrics", "metric label value~", lambda v: universe.universe_metrics(records(v), v.returns),
      """WITH ok AS (SELECT * FROM t_rec WHERE valid) SELECT 'asset_class_count' AS metric, asset_class AS label, count(*)::DOUBLE AS value FROM ok GROUP BY 2
      UNION ALL SELECT 'core_or_satellite_count', core_or_satellite, count(*) FROM ok GROUP BY 2
      UNION ALL SELECT 'history_years', unnest(['min','median','max']), unnest([round(min(history_years), 2), round(median(history_years), 2), round(max(history_years), 2)]) FROM ok
      UNION ALL SELECT 'median_volume', unnest(['min','median','max']), unnest([min(median_volume), round(median(median_volume), 0), max(median_volume)]) FROM ok
      UNION ALL SELECT 'avg_volatility', NULL, (SELECT avg(v) FROM (SELECT stddev_pop(ret) * sqrt(252) AS v FROM t_ret GROUP BY ticker))
      UNION ALL SELECT 'avg_correlation', NULL, (SELECT avg(value) FROM t_corr)""")


def broken(v):
    k = C("ordinal")
    named = F.when(C("asset_class") == "bond", "cash").otherwise(C("asset_class"))
    return v.listing.select(
        F.when(k == 3, "Supplier#000000000").otherwise(C("symbol")).alias("symbol"), F.when(mod(k, 10) == 5, "crypto").otherwise(named).alias("asset_class"),
        F.when(mod(k, 11) == 2, "edge").otherwise(C("core_or_satellite")).alias("core_or_satellite"), "max_weight")


check("v04_check_universe", "error item", lambda v: universe.check_universe(broken(v)),
      """WITH b AS (SELECT if(ordinal = 3, 'Supplier#000000000', symbol) AS symbol, if(ordinal % 10 = 5, 'crypto', if(asset_class = 'bond', 'cash', asset_class)) AS asset_class,
        if(ordinal % 11 = 2, 'edge', core_or_satellite) AS tier, max_weight FROM t_listing)
      SELECT 'duplicate symbol' AS error, symbol AS item FROM b GROUP BY 2 HAVING count(*) > 1
      UNION ALL SELECT DISTINCT 'invalid asset_class', asset_class FROM b WHERE asset_class = 'crypto'
      UNION ALL SELECT DISTINCT 'invalid core_satellite', tier FROM b WHERE tier = 'edge' UNION ALL SELECT 'invalid max_weight', symbol FROM b WHERE max_weight > 1
      UNION ALL SELECT 'missing class', 'bond' WHERE NOT EXISTS (SELECT 1 FROM b WHERE asset_class = 'bond')
      UNION ALL SELECT 'missing class', 'equity' WHERE NOT EXISTS (SELECT 1 FROM b WHERE asset_class = 'equity')""")
check("v05_income_universe", "symbol class", lambda v: universe.objective_universe(v.listing, "income"),
      "SELECT * FROM t_listing WHERE class IN ('treasury_long','corporate_bond','reit','tbills','public_equity','public_equity_intl')")
check("v05_growth_universe", "symbol class", lambda v: universe.objective_universe(v.listing, "growth"),
      """SELECT * FROM t_listing WHERE class IN ('public_equity','public_equity_intl') OR ordinal IN (SELECT ordinal FROM t_listing WHERE class IN ('corporate_bond','treasury_long') ORDER BY ordinal LIMIT 2)""")
check("v05_preserve_universe", "symbol class", lambda v: universe.objective_universe(v.listing, "preserve"),
      """SELECT * FROM t_listing WHERE class IN ('tbills','corporate_bond') OR ordinal IN (SELECT ordinal FROM t_listing WHERE class = 'public_equity' ORDER BY ordinal LIMIT 1)""")
check("v06_band_universe", "objective symbol asset_class", lambda v: universe.band_universe(v.listing, *objectives(v), v.prices.join(
      v.listing.select("ticker", C("symbol").alias("s")), "ticker").select(C("s").alias("ticker"))),
      """SELECT objective, symbol, asset_class FROM (SELECT o.name AS objective, symbol, l.asset_class, core_or_satellite, prefer_core, min_holdings,
        count(*) FILTER (core_or_satellite = 'core') OVER (PARTITION BY o.name) AS nc FROM t_listing l JOIN t_bands b ON l.asset_class = b.asset_class AND band_max > 0 JOIN t_obj o ON o.name = b.name)
      WHERE NOT (prefer_core AND nc >= min_holdings) OR core_or_satellite = 'core'""")

FILTERS = {"core_min_years": 1.5, "sat_min_years": 2.0, "min_asset_sharpe": -0.02, "max_asset_vol_multiplier": 3.4, "max_asset_drawdown": -0.66}
CTES["t_q"] = """SELECT ticker, n >= 2 AS valid, n / 252.0::DOUBLE AS years, (v1 / v0) ** (252.0::DOUBLE / n) - 1 AS cagr, sd * sqrt(252) AS volatility,
  coalesce(((v1 / v0) ** (252.0::DOUBLE / n) - 1 - 0.015) / nullif(sd * sqrt(252), 0), 0) AS sharpe, max_dd AS max_drawdown FROM t_facts"""
CTES["t_arec"] = """SELECT user_id, symbol, asset_class, core_or_satellite, coalesce(years, 0) AS years, cagr, volatility, sharpe, max_drawdown, why IS NULL AS passed, why AS fail_reason FROM (
  SELECT *, CASE WHEN valid IS NULL THEN 'not in returns data' WHEN years < need THEN printf('insufficient history: %.1fy < %.1fy required', years, need)
    WHEN sharpe < -0.02 THEN printf('low Sharpe: %.2f < -0.02', sharpe)
    WHEN volatility > vol_max * 3.4 THEN printf('excessive volatility: %.2f%% > %.2f%%', volatility * 100, vol_max * 3.4 * 100)
    WHEN max_drawdown < -0.66 THEN printf('excessive drawdown: %.1f%% < -66.0%%', max_drawdown * 100) END AS why FROM (
    SELECT user_id, vol_max, s.symbol, coalesce(asset_class, 'unknown') AS asset_class, coalesce(core_or_satellite, 'satellite') AS core_or_satellite,
      if(core_or_satellite = 'core', 1.5, 2.0) AS need, q.* FROM t_prof, (SELECT n_name AS symbol FROM nation UNION ALL SELECT r_name FROM region) s
      LEFT JOIN t_catalog c ON c.symbol = s.symbol LEFT JOIN t_q q ON q.ticker = s.symbol))"""


def receipts(v):
    asked = v.catalog.select("symbol").union(v.table("region").select("r_name"))
    return universe.asset_receipts(asked, stats.quality_metrics(v.returns), v.catalog, profiles(v), FILTERS)


check("v07_asset_filter", "reason passed? n#", lambda v: receipts(v).groupBy(F.split("fail_reason", ":")[0].alias("reason"), "passed").agg(F.count("*").alias("n")),
      "SELECT split_part(fail_reason, ':', 1) AS reason, passed, count(*) AS n FROM t_arec GROUP BY 1, 2")
check("v08_asset_receipts", "user_id# symbol asset_class core_or_satellite years~ cagr~ volatility~ sharpe~ max_drawdown~ passed? fail_reason", receipts, "SELECT * FROM t_arec")
check("v09_ordered_universe", "symbol position#", lambda v: universe.ordered_universe(
      v.prices.select(C("ticker").alias("symbol")), v.catalog.select(F.lower(F.when(mod(C("ordinal"), 3) == 1, F.concat("symbol", F.lit("_old"))).otherwise(C("symbol"))).alias("symbol"), (-C("ordinal")).alias("ordinal"))),
      """SELECT s AS symbol, row_number() OVER (ORDER BY o NULLS LAST, s) AS position FROM (SELECT DISTINCT ticker AS s FROM t_prices)
      LEFT JOIN (SELECT symbol, -ordinal AS o FROM t_catalog WHERE ordinal % 3 <> 1) ON symbol = s""")

# ---- Q ----------------------------------------------------------------------------------------
check("q01_price_gate", "ticker present? nan_ratio~ nan_ok? span_years~ span_ok? has_provenance?", lambda v: gates.price_gate(
      v.nations.select(C("n_name").alias("ticker")).union(v.nations.select("r_name")), v.prices, merge.provenance(v.prices_raw.withColumn("ticker", F.when(C("ticker") == "NATION_3", "NATION_3_old").otherwise(C("ticker")))), 0.30),
      """SELECT q.ticker, c IS NOT NULL AS present, 1 - c / n AS nan_ratio, coalesce(1 - c / n <= 0.30, false) AS nan_ok, y AS span_years, y >= 3 AS span_ok,
        c IS NOT NULL AND q.ticker <> 'NATION_3' AS has_provenance
      FROM (SELECT n_name AS ticker FROM nation UNION SELECT r_name FROM region) q LEFT JOIN (SELECT ticker, count(*)::DOUBLE AS c FROM t_prices GROUP BY 1) g ON g.ticker = q.ticker,
      (SELECT count(DISTINCT date) AS n, (max(date) - min(date)) / 365.25::DOUBLE AS y FROM t_prices)""")
check("q02_return_gate", "nan_count# inf_count# mean_abs~ passed?", lambda v: gates.return_gate(
      v.returns.withColumn("ret", F.when((C("ticker") == "NATION_5") & (F.dayofmonth("date") == 1), float("inf")).otherwise(C("ret")))),
      """SELECT count(DISTINCT ticker) * count(DISTINCT date) - count(*) AS nan_count, count(*) FILTER (ticker = 'NATION_5' AND day(date) = 1) AS inf_count,
      (SELECT avg(m) FROM (SELECT avg(abs(ret)) AS m FROM t_ret WHERE NOT (ticker = 'NATION_5' AND day(date) = 1) GROUP BY ticker)) AS mean_abs, false AS passed FROM t_ret""")
check("q03_candidate_gate", "portfolio_id total~ negatives# caps_broken# passed?", lambda v: gates.candidate_gate(
      v.weights.withColumn("weight", F.when(C("portfolio_id").endswith("7"), -C("weight")).when(C("portfolio_id").endswith("8"), C("weight") * 1.2).otherwise(C("weight"))),
      v.catalog, {"equity": 0.3, "cash": 0.25}),
      """SELECT *, negatives = 0 AND total BETWEEN 0.99 AND 1.01 AND caps_broken = 0 AS passed FROM (SELECT portfolio_id, sum(s) AS total, sum(neg) AS negatives,
        count(*) FILTER (s > CASE asset_class WHEN 'equity' THEN 0.3 WHEN 'cash' THEN 0.25 ELSE 1 END + 0.001) AS caps_broken FROM (
        SELECT portfolio_id, asset_class, sum(w) AS s, sum((w < 0)::INT) AS neg FROM (SELECT *, weight * CASE WHEN portfolio_id LIKE '%7' THEN -1 WHEN portfolio_id LIKE '%8' THEN 1.2 ELSE 1 END AS w
          FROM t_weights JOIN t_catalog ON ticker = symbol) GROUP BY 1, 2) GROUP BY 1)""")
check("q04_plausibility_gate", "portfolio_id metric value~", lambda v: gates.plausibility_gate(
      stats.annualized_metrics(port(v), "portfolio_id"), ranges={"cagr": (-0.03, 0.02), "sharpe": (-0.2, 0.3), "max_dd": (-0.5, -0.01)}),
      """SELECT portfolio_id, metric, value FROM (SELECT portfolio_id, 'cagr' AS metric, cagr AS value, -0.03 AS lo, 0.02 AS hi FROM t_pannual UNION ALL
      SELECT portfolio_id, 'sharpe', sharpe, -0.2, 0.3 FROM t_pannual UNION ALL SELECT portfolio_id, 'max_dd', max_dd, -0.5, -0.01 FROM t_pannual) WHERE value NOT BETWEEN lo AND hi""")
check("q05_receipt_gate", "receipts# absent_fields# bad_rates# requested# passed?", lambda v: gates.receipt_gate(
      stats.receipts(v.nations.select(C("n_name").alias("ticker")).union(v.nations.select("r_name")), v.prices, merge.provenance(v.prices_raw)), v.prices),
      """SELECT count(*) AS receipts, 2 * count(*) FILTER (t IS NULL) AS absent_fields, 0 AS bad_rates, count(t) AS requested, count(*) = count(t) AND count(*) FILTER (t IS NULL) = 0 AS passed
      FROM (SELECT n_name AS q FROM nation UNION SELECT r_name FROM region) LEFT JOIN (SELECT DISTINCT ticker AS t FROM t_prices) ON t = q""")
check("q06_light_gate", "tickers# cells# long_tickers# dates# nan_ratio~ passed?", lambda v: gates.light_gate(v.returns_class),
      """SELECT *, tickers >= 3 AND dates >= 252 AND nan_ratio <= 0.2 AND long_tickers >= 3 AS passed FROM (SELECT count(DISTINCT ticker) AS tickers, count(*) AS cells,
      (SELECT count(*) FROM (SELECT 1 FROM t_retc GROUP BY ticker HAVING count(*) > 126)) AS long_tickers, count(DISTINCT date) AS dates,
      1 - count(*)::DOUBLE / (count(DISTINCT date) * count(DISTINCT ticker)) AS nan_ratio FROM t_retc)""")
check("q07_backtest_audit", "ticker monotonic? constant? cagr~ sharpe~ max_dd~ plausible?", lambda v: gates.backtest_audit(v.returns),
      """SELECT ticker, true AS monotonic, sd = 0 AS constant, v1 ** (252.0::DOUBLE / n) - 1 AS cagr, mean / sd * sqrt(252) AS sharpe, max_dd,
      v1 ** (252.0::DOUBLE / n) - 1 BETWEEN -0.5 AND 0.5 AND mean / sd * sqrt(252) BETWEEN -1 AND 3 AND max_dd BETWEEN -0.95 AND -0.01 AS plausible FROM t_facts""")
