"""Multi-source merge, provenance and freshness."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.expr import div, lookup, weekday_count

PRICE_COLUMNS = ["open", "high", "low", "close", "adj_close", "volume"]
BAR_KEY = ["ticker", "date"]


def _pick(df: DataFrame, *order: Column, key=BAR_KEY) -> DataFrame:
    """One row per key, by order. Key groups hold one row per source, so the window stays small."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def dedupe_dates(df: DataFrame, seq: str, keep: str = "last", key=BAR_KEY) -> DataFrame:
    return _pick(df, F.desc(seq) if keep == "last" else F.asc(seq), key=key)


def priority_union(frames: list[DataFrame], key=BAR_KEY) -> DataFrame:
    """Union of columns and rows; on an overlapping key the earlier frame wins."""
    tagged = [f.withColumn("_p", F.lit(i)) for i, f in enumerate(frames)]
    return _pick(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged), F.asc("_p"), key=key).drop("_p")


def upsert_newest(old: DataFrame, new: DataFrame, key=BAR_KEY) -> DataFrame:
    """New rows replace old ones on the key."""
    return priority_union([new, old], key)


def merge_providers(raw: DataFrame, precedence: list[str]) -> DataFrame:
    """All providers in one table folded to one bar per (ticker, date), tagged with the winner."""
    rank = F.array_position(F.array(*map(F.lit, precedence)), F.col("provider"))
    return _pick(raw.where(rank > 0), rank)


def provider_counts(raw: DataFrame) -> DataFrame:
    return raw.groupBy("ticker", "provider").agg(F.count("*").alias("rows"))


def source_tag(raw: DataFrame, order=("tiingo", "stooq")) -> DataFrame:
    """Contributing providers in fixed order, joined by ' + ', 'none' when neither did."""
    has = [F.max((F.col("provider") == p).cast("int")).alias(p) for p in order]
    tag = F.concat_ws(" + ", *[F.when(F.col(p) == 1, p) for p in order])
    return raw.groupBy("ticker").agg(*has).select("ticker", F.when(tag == "", "none").otherwise(tag).alias("source"))


def common_start(bars: DataFrame, columns=tuple(PRICE_COLUMNS), max_null: float = 0.20) -> DataFrame:
    """Rows from the date where every used column has begun; columns too sparse after it become null."""
    first = bars.groupBy("ticker").agg(*[F.min(F.when(F.col(c).isNotNull(), F.col("date"))).alias(f"_{c}") for c in columns])
    start = first.select("ticker", F.greatest(*[f"_{c}" for c in columns]).alias("_start"))
    kept = bars.join(start, "ticker").where("date >= _start").drop("_start")
    share = kept.groupBy("ticker").agg(*[F.avg(F.col(c).isNull().cast("double")).alias(f"_{c}") for c in columns])
    out = kept.join(share, "ticker")
    rest = [c for c in bars.columns if c not in columns]
    return out.select(*rest, *[F.when(F.col(f"_{c}") <= max_null, F.col(c)).alias(c) for c in columns])


def bars_valid(bars: DataFrame, by=("ticker", "provider"), min_ratio: float = 0.05) -> DataFrame:
    """Row count against expected weekdays per series."""
    stats = bars.groupBy(*by).agg(F.count("*").alias("rows"), F.min("date").alias("first"), F.max("date").alias("last"))
    stats = stats.withColumn("expected", weekday_count(F.col("first"), F.col("last")))
    ratio = div("rows", "expected")
    return stats.withColumn("ratio", ratio).withColumn("valid", F.coalesce(ratio >= min_ratio, F.lit(True)))


def provider_fallback(bars: DataFrame, precedence: list[str], min_rows: int = 100, min_ratio: float = 0.05) -> DataFrame:
    """Bars of the first provider in precedence whose series is long and dense enough."""
    rank = F.array_position(F.array(*map(F.lit, precedence)), F.col("provider"))
    good = bars_valid(bars, min_ratio=min_ratio).where(F.col("valid") & (F.col("rows") >= min_rows) & (rank > 0))
    chosen = _pick(good.withColumn("_rank", rank), F.asc("_rank"), key=["ticker"])
    return bars.join(chosen.select("ticker", "provider"), ["ticker", "provider"], "left_semi")


def provenance(raw: DataFrame, backfill: str = "tiingo") -> DataFrame:
    """Per ticker: sorted provider names, share of back-filled rows, first and last date."""
    share = div(F.sum((F.col("provider") == backfill).cast("long")) * 100.0, F.count("*"))
    return raw.groupBy("ticker").agg(
        F.array_join(F.array_sort(F.collect_set("provider")), "+").alias("provider_map"),  # a handful of names
        F.coalesce(share, F.lit(0.0)).alias("backfill_pct"),
        F.min("date").alias("first"), F.max("date").alias("last"))


def fill_ticker(df: DataFrame, symbol: str) -> DataFrame:
    known = F.col("ticker") if "ticker" in df.columns else F.lit(None).cast("string")
    return df.withColumn("ticker", F.coalesce(known, F.col(symbol)))


def cache_fresh(manifest: DataFrame, required: DataFrame, as_of: Column, ttl_days: int = 7) -> DataFrame:
    """Fresh means young enough and covering the required span; a ticker without manifest is stale."""
    m = required.join(manifest, "ticker", "left")
    age = F.datediff(as_of, F.to_date("fetched_at"))
    covers = (F.col("required_start").isNull() | F.col("start").isNull() | (F.col("start") <= F.col("required_start"))) & (
        F.col("required_end").isNull() | F.col("end").isNull() | (F.col("end") >= F.col("required_end")))
    return m.select("ticker", age.alias("age_days"),
                    F.coalesce((age <= ttl_days) & covers, F.lit(False)).alias("fresh"))


def missing_symbols(requested: DataFrame, stored: DataFrame) -> DataFrame:
    return requested.select("ticker").distinct().join(stored.select("ticker").distinct(), "ticker", "left_anti")


def macro_staleness(macro: DataFrame, as_of: Column, limits: dict[str, int] | None = None) -> DataFrame:
    """Age of each series against 90 days when monthly, 60 when denser, or against given limits."""
    last = W.partitionBy("series_id").orderBy(F.desc("date"))
    tail = macro.where("value is not null").withColumn("_n", F.row_number().over(last)).where("_n <= 12")
    gap = F.datediff("date", F.lead("date").over(last))
    s = tail.withColumn("_gap", gap).groupBy("series_id").agg(
        F.count("*").alias("_c"), F.max("date").alias("last_date"), F.percentile("_gap", F.lit(0.5)).alias("_m"))
    spacing = F.when(F.col("_c") >= 12, F.floor("_m")).otherwise(1)
    limit = F.when(spacing > 20, 90).otherwise(60)
    if limits:
        limit = F.coalesce(lookup(F.col("series_id"), limits), limit)
    age = F.datediff(as_of, F.col("last_date"))
    return s.select("series_id", "last_date", spacing.alias("spacing"), limit.alias("max_age"), age.alias("age"),
                    (age > limit).alias("stale"))


def fetch_summary(requested: DataFrame, bars: DataFrame) -> DataFrame:
    """Provider, rows and error per requested ticker; a ticker without rows is reported as failed."""
    got = bars.groupBy("ticker").agg(F.min("provider").alias("provider"), F.count("*").alias("rows"))
    return requested.select("ticker").distinct().join(got, "ticker", "left").select(
        "ticker", "provider", F.coalesce("rows", F.lit(0)).alias("rows"),
        F.when(F.col("rows").isNull(), "all_providers_failed").alias("error"))
