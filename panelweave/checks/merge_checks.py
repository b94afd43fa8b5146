"""M family: merging providers, provenance, freshness."""
from pyspark.sql import functions as F

from ..functions.expr import mod
from ..operators import merge
from .ctes import CTES
from .registry import check

PREF = ["stooq", "tiingo", "yfinance"]
BAR = "ticker date@ open~ high~ low~ close~ adj_close~ volume~"
RANK = "CASE provider WHEN 'stooq' THEN 1 WHEN 'tiingo' THEN 2 ELSE 3 END"
def as_of():
    return F.lit("2001-12-31").cast("date")


def by(v, p):
    return v.prices_raw.where(F.col("provider") == p)


check("m01_priority_union", BAR + " provider tag",
      lambda v: merge.priority_union([by(v, "stooq").withColumn("tag", F.lit("base")), by(v, "tiingo"), by(v, "yfinance")]),
      "SELECT *, CASE WHEN provider = 'stooq' THEN 'base' END AS tag FROM t_raw "
      f"QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY {RANK}) = 1")

check("m02_upsert_newest", BAR + " provider", lambda v: merge.upsert_newest(merge.upsert_newest(by(v, "stooq"), by(v, "tiingo")), by(v, "yfinance")),
      "SELECT * FROM t_raw "
      f"QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY {RANK} DESC) = 1")

check("m03_union_with_provenance", BAR + " provider provider_map source",
      lambda v: merge.merge_providers(v.prices_raw, PREF)
      .join(merge.provenance(v.prices_raw).select("ticker", "provider_map"), "ticker")
      .join(merge.source_tag(v.prices_raw), "ticker"),
      f"""SELECT b.*, provider_map, source FROM (SELECT * FROM t_raw
          QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY {RANK}) = 1) b
        JOIN (SELECT ticker, string_agg(DISTINCT provider, '+' ORDER BY provider) AS provider_map,
          CASE WHEN bool_or(provider = 'tiingo') AND bool_or(provider = 'stooq') THEN 'tiingo + stooq'
            WHEN bool_or(provider = 'tiingo') THEN 'tiingo' WHEN bool_or(provider = 'stooq') THEN 'stooq' ELSE 'none' END AS source
          FROM t_raw GROUP BY ticker) USING (ticker)""")

check("m03_provider_counts", "ticker provider rows#", lambda v: merge.provider_counts(v.prices_raw),
      "SELECT ticker, provider, count(*) AS rows FROM t_raw GROUP BY 1, 2")

COLS = ["open", "high", "low", "close", "adj_close", "volume"]
check("m04_common_start_sparse_drop", BAR, lambda v: merge.common_start(
      merge.merge_providers(v.prices_raw, ["yfinance", "stooq", "tiingo"]).drop("provider")),
      f"""SELECT ticker, date, {', '.join(f"CASE WHEN avg(({c} IS NULL)::INT) OVER w <= 0.20 THEN {c} END AS {c}" for c in COLS)}
      FROM (SELECT b.*, greatest({', '.join(f"min(CASE WHEN {c} IS NOT NULL THEN date END) OVER (PARTITION BY ticker)" for c in COLS)}) AS s
        FROM (SELECT * FROM t_raw QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY
          CASE provider WHEN 'yfinance' THEN 1 WHEN 'stooq' THEN 2 ELSE 3 END) = 1) b) WHERE date >= s
      WINDOW w AS (PARTITION BY ticker)""")

WEEKDAYS = "len(list_filter(generate_series(first, last, INTERVAL 1 DAY), lambda x: isodow(x) <= 5))"
CTES["t_valid"] = f"""
SELECT *, rows / expected AS ratio, coalesce(rows / expected >= 0.25, true) AS valid FROM (
  SELECT *, {WEEKDAYS} AS expected FROM (
    SELECT ticker, provider, count(*)::DOUBLE AS rows, min(date) AS first, max(date) AS last FROM t_raw GROUP BY 1, 2))"""
check("m05_provider_fallback", BAR + " provider",
      lambda v: merge.provider_fallback(v.prices_raw, ["tiingo", "stooq", "yfinance"], 100, 0.25),
      """SELECT r.* FROM t_raw r JOIN (SELECT ticker, provider FROM t_valid WHERE valid AND rows >= 100 QUALIFY row_number() OVER
      (PARTITION BY ticker ORDER BY CASE provider WHEN 'tiingo' THEN 1 WHEN 'stooq' THEN 2 ELSE 3 END) = 1) USING (ticker, provider)""")
check("m06_continuity", "ticker provider rows# first@ last@ expected# ratio~ valid?",
      lambda v: merge.bars_valid(v.prices_raw, min_ratio=0.25), "SELECT * FROM t_valid")

CTES["t_prov"] = """
SELECT ticker, string_agg(DISTINCT provider, '+' ORDER BY provider) AS provider_map,
  sum((provider = 'tiingo')::INT) * 100.0::DOUBLE / count(*) AS backfill_pct, min(date) AS first, max(date) AS last
FROM t_raw GROUP BY ticker"""
check("m07_provenance", "ticker provider_map backfill_pct~ first@ last@", lambda v: merge.provenance(v.prices_raw),
      "SELECT * FROM t_prov")

check("m08_fill_ticker", "n# ticker", lambda v: merge.fill_ticker(
      v.fact.select(F.when(F.col("l_returnflag") != "A", F.col("ticker")).alias("ticker"), F.col("cls").alias("symbol")), "symbol")
      .groupBy("ticker").agg(F.count("*").alias("n")),
      "SELECT CASE WHEN l_returnflag <> 'A' THEN ticker ELSE cls END AS ticker, count(*) AS n FROM t_fact GROUP BY 1")


def manifest(v):
    m = v.prices_raw.where("provider = 'stooq'").groupBy("ticker").agg(F.min("date").alias("start"), F.max("date").alias("end"))
    return m.withColumn("fetched_at", F.col("end").cast("timestamp_ntz"))


def required(v):
    return v.prices_raw.where("provider <> 'stooq'").groupBy("ticker").agg(
        F.date_add(F.min("date"), 4).alias("required_start"), F.date_sub(F.max("date"), 20).alias("required_end"))


check("m09_cache_fresh", "ticker age_days# fresh?", lambda v: merge.cache_fresh(manifest(v), required(v), as_of(), 90),
      """SELECT r.ticker, DATE '2001-12-31' - e AS age_days, coalesce(DATE '2001-12-31' - e <= 90 AND s <= rs AND e >= re, false) AS fresh
      FROM (SELECT ticker, min(date) + 4 AS rs, max(date) - 20 AS re FROM t_raw WHERE provider <> 'stooq' GROUP BY 1) r
      LEFT JOIN (SELECT ticker, min(date) AS s, max(date) AS e FROM t_raw WHERE provider = 'stooq' GROUP BY 1) m ON r.ticker = m.ticker""")

check("m10_missing_symbols", "ticker", lambda v: merge.missing_symbols(
      v.listing.select(F.when(mod(F.col("ordinal"), 10) == 0, F.concat("symbol", F.lit("-X"))).otherwise(F.col("symbol")).alias("ticker")),
      v.fact.drop("ticker")
      .join(v.listing.select("ordinal", F.col("symbol").alias("ticker")), F.col("l_suppkey") == F.col("ordinal"))),
      """SELECT CASE WHEN s_suppkey % 10 = 0 THEN s_name || '-X' ELSE s_name END AS ticker FROM supplier WHERE s_suppkey % 10 = 0 OR s_suppkey NOT IN (SELECT l_suppkey FROM t_fact)""")

check("m11_macro_staleness", "series_id last_date@ spacing# max_age# age# stale?",
      lambda v: merge.macro_staleness(v.macro, F.lit("2002-02-25").cast("date"), {"UNRATE": 66}),
      """SELECT series_id, max(date) AS last_date, floor(median(g)) AS spacing, DATE '2002-02-25' - max(date) AS age,
        CASE WHEN series_id = 'UNRATE' THEN 66 WHEN floor(median(g)) > 20 THEN 90 ELSE 60 END AS max_age,
        DATE '2002-02-25' - max(date) > CASE WHEN series_id = 'UNRATE' THEN 66 WHEN floor(median(g)) > 20 THEN 90 ELSE 60 END AS stale
      FROM (SELECT series_id, date, date - lag(date) OVER (PARTITION BY series_id ORDER BY date) AS g FROM (
        SELECT * FROM t_macro QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY date DESC) <= 12)) GROUP BY 1""")

check("m12_fetch_summary", "ticker provider rows# error", lambda v: merge.fetch_summary(
      v.nations.select(F.col("n_name").alias("ticker")).union(v.nations.select(F.col("r_name"))),
      merge.provider_fallback(v.prices_raw, PREF)),
      f"""SELECT q.ticker, provider, coalesce(rows, 0) AS rows, CASE WHEN rows IS NULL THEN 'all_providers_failed' END AS error
      FROM (SELECT n_name AS ticker FROM nation UNION SELECT r_name FROM region) q LEFT JOIN (
        SELECT ticker, provider, rows FROM (SELECT *, rows / expected >= 0.05 AS ok FROM t_valid) WHERE ok AND rows >= 100
        QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY {RANK}) = 1) p USING (ticker)""")
