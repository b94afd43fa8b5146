"""Universe construction and validation."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import fixed
from ..functions.expr import div, weekday_count, years_between
from . import matrix, stats
from .blend import known_symbol_class

C = F.col


def build_universe(catalog: DataFrame, objective: str = "balanced", allow_single_names: bool = True,
                   sector_caps: dict[str, float] | None = None, min_size: int = 12) -> DataFrame:
    """Retail instruments, core (bucket 0) before satellite (1) and by position inside a bucket; a
    core list when too few are left.

    A capped sector keeps its first max(1, int(cap x n)) rows; sectors without a cap drop out.
    """
    df = catalog.where("eligibility = 'retail'")
    if objective == "preserve" or not allow_single_names:
        df = df.where("class <> 'single_stock'")
    if sector_caps:
        cap = F.coalesce(*[F.when(C("sector") == s, c) for s, c in sector_caps.items()])
        part = W.partitionBy("sector")
        ranked = df.withColumn("_k", F.row_number().over(part.orderBy("ordinal"))).withColumn("_n", F.count("*").over(part))
        fits = C("_k") <= F.greatest(F.lit(1), F.floor(cap * C("_n")))
        df = ranked.where(C("sector").isNull() | fits).drop("_k", "_n")
    bucket = F.when(C("risk_bucket") == "core", 0).when(C("risk_bucket") == "satellite", 1)
    named = df.withColumn("_b", bucket).where("_b is not null")
    size = named.agg(F.count("*")).scalar()
    back = F.array_position(F.array(*map(F.lit, fixed.FALLBACK_CORE)), C("symbol"))
    chosen = named.where(size >= min_size).select("symbol", "_b", C("ordinal").cast("long").alias("_o"))
    fallback = df.where((back > 0) & (size < min_size)).select("symbol", F.lit(0).alias("_b"), back.cast("long").alias("_o"))
    return chosen.unionByName(fallback).select("symbol", C("_b").alias("bucket"), C("_o").alias("position"))


def validate_catalog(catalog: DataFrame, bars: DataFrame, core_min_years: float = 10.0, sat_min_years: float = 7.0,
                     max_missing_pct: float = 10.0, min_median_volume: float = 0.0) -> DataFrame:
    """Coverage record per catalog symbol: history, gaps, liquidity, verdict and reasons."""
    g = bars.where("adj_close is not null").groupBy(C("ticker").alias("symbol")).agg(
        F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("n_obs"),
        F.percentile("volume", F.lit(0.5)).alias("_vol"), F.max("volume").alias("_vmax"))
    r = catalog.select("symbol", "asset_class", "core_or_satellite").join(g, "symbol", "left")
    years = F.coalesce(years_between(C("start"), C("end")), F.lit(0.0))
    expected = weekday_count(C("start"), C("end"))
    gap = F.coalesce(F.greatest(F.lit(0.0), (F.lit(1.0) - div("n_obs", expected)) * 100), F.lit(0.0))
    volume = F.when(C("_vmax") > 0, C("_vol"))
    floor = F.when(F.lower(F.coalesce("core_or_satellite", F.lit("satellite"))) == "core", core_min_years).otherwise(sat_min_years)
    r = r.withColumns({"_years": years, "_gap": gap, "_v": volume, "_floor": floor})
    history, sparse = C("_years") >= C("_floor") - 0.01, C("_gap") <= max_missing_pct
    liquid = F.coalesce(C("_v") >= min_median_volume, F.lit(False)) if min_median_volume else F.lit(True)
    none = C("n_obs").isNull()
    reason = F.concat_ws(",", F.when(~history, F.format_string("years<%.0f", "_floor")), F.when(~sparse, "missing>"),
                         F.when(~liquid, f"vol<{min_median_volume}"))
    return r.select(
        "symbol", "asset_class", "core_or_satellite", "start", "end", F.round("_years", 2).alias("history_years"),
        F.when(none, 100.0).otherwise(F.round("_gap", 2)).alias("missing_pct"), F.coalesce("n_obs", F.lit(0)).alias("n_obs"),
        F.floor("_v").alias("median_volume"), F.coalesce(~none & history & sparse & liquid, F.lit(False)).alias("valid"),
        F.when(none, "no_data").otherwise(F.nullif(reason, F.lit(""))).alias("reason"))


def universe_metrics(records: DataFrame, rets: DataFrame) -> DataFrame:
    """Aggregate metrics of the valid records as (metric, label, value) rows."""
    ok = records.where("valid")
    counts = stats.category_counts(ok, ["asset_class", "core_or_satellite"]).select(
        F.concat("field", F.lit("_count")).alias("metric"), "label", C("count").cast("double").alias("value"))

    def dist(column: str, digits: int) -> DataFrame:
        return stats.spread(ok, column, digits).unpivot([], ["min", "median", "max"], "label", "value").select(
            F.lit(column).alias("metric"), "label", C("value").cast("double").alias("value"))

    risk = matrix.correlation_summary(rets).unpivot([], ["avg_volatility", "avg_correlation"], "metric", "value")
    risk = risk.select("metric", F.lit(None).cast("string").alias("label"), "value")
    return counts.unionByName(dist("history_years", 2)).unionByName(dist("median_volume", 0)).unionByName(risk)


def check_universe(universe: DataFrame) -> DataFrame:
    """One row per configuration error and offending item; no rows means valid."""
    row = lambda df, error, item: df.select(F.lit(error).alias("error"), item.alias("item"))
    dup = universe.groupBy("symbol").count().where("count > 1")
    bad_class = universe.where(~C("asset_class").isin(fixed.ASSET_CLASSES)).select("asset_class").distinct()
    bad_tier = universe.where(~C("core_or_satellite").isin("core", "satellite")).select("core_or_satellite").distinct()
    bad_weight = universe.where((C("max_weight") <= 0) | (C("max_weight") > 1))
    has = universe.agg(F.count_if(C("asset_class") == "equity").alias("equity"), F.count_if(C("asset_class") == "bond").alias("bond"))
    lacking = has.unpivot([], ["equity", "bond"], "cls", "n").where("n = 0")
    return (row(dup, "duplicate symbol", C("symbol")).unionByName(row(bad_class, "invalid asset_class", C("asset_class")))
            .unionByName(row(bad_tier, "invalid core_satellite", C("core_or_satellite")))
            .unionByName(row(bad_weight, "invalid max_weight", C("symbol")))
            .unionByName(row(lacking, "missing class", C("cls"))))



def objective_universe(catalog: DataFrame, objective: str) -> DataFrame:
    """Symbols suited to income, growth (two bonds at most on top) or preservation (one equity at most)."""
    classes, symbols, extra, room = {
        "income": (*fixed.INCOME, [], 0), "growth": (*fixed.GROWTH, ["corporate_bond", "treasury_long"], 2),
        "preserve": (*fixed.PRESERVE, ["public_equity"], 1)}[objective]
    main = C("class").isin(classes) | F.upper("symbol").isin(symbols)
    # an always-included symbol of the side class uses up its room too
    first = catalog.where(C("class").isin(extra)).orderBy("ordinal").limit(room) if extra else catalog.limit(0)
    out = catalog.join(first.select("symbol", F.lit(True).alias("_side")), "symbol", "left")
    out = out.withColumn("_keep", main | F.coalesce("_side", F.lit(False)))
    kept = out.agg(F.count_if("_keep")).scalar()
    return out.where(C("_keep") | (kept == 0)).drop("_side", "_keep")


def band_universe(universe: DataFrame, objectives: DataFrame, bands: DataFrame, tickers: DataFrame) -> DataFrame:
    """Available symbols of the allowed classes per objective; core only where preferred and enough."""
    have = universe.select("symbol", "asset_class", "core_or_satellite").join(tickers.select(C("ticker").alias("symbol")).distinct(), "symbol", "left_semi")
    allowed = bands.where("band_max > 0").select("name", "asset_class").join(objectives.select("name", "min_holdings", "prefer_core"), "name")
    j = have.join(allowed, "asset_class")
    core = F.count_if(C("core_or_satellite") == "core").over(W.partitionBy("name"))
    j = j.withColumn("_core", core)
    return j.where(~(C("prefer_core") & (C("_core") >= C("min_holdings"))) | (C("core_or_satellite") == "core")).select(
        C("name").alias("objective"), "symbol", "asset_class", "core_or_satellite")




def asset_reasons(cfg: dict | None = None) -> tuple[Column, Column, Column]:
    """Texts of the quality tests before the volatility limit, of the volatility (up to the limit's own text) and of the tests after it."""
    c = {**fixed.ASSET_FILTER, **(cfg or {})}
    years = F.when(C("core_or_satellite") == "core", c["core_min_years"]).otherwise(c["sat_min_years"])
    f = F.format_string
    before = (F.when(C("valid").isNull(), "not in returns data")
              .when(~C("valid"), F.concat(F.lit("invalid metrics: "), F.coalesce("reason", F.lit("unknown"))))
              .when(C("years") < years, f("insufficient history: %.1fy < %.1fy required", C("years"), years))
              .when(C("sharpe") < c["min_asset_sharpe"], f(f"low Sharpe: %.2f < {c['min_asset_sharpe']:.2f}", C("sharpe"))))
    after = F.when(C("max_drawdown") < c["max_asset_drawdown"],
                   f("excessive drawdown: %.1f%% < %.1f%%", C("max_drawdown") * 100, F.lit(c["max_asset_drawdown"] * 100)))
    return before, f("excessive volatility: %.2f%% > ", C("volatility") * 100), after


def vol_limit(max_vol: Column, cfg: dict | None = None) -> tuple[Column, Column]:
    """A user's volatility limit of a single symbol, and its text."""
    limit = max_vol * {**fixed.ASSET_FILTER, **(cfg or {})}["max_asset_vol_multiplier"]
    return limit, F.format_string("%.2f%%", limit * 100)


def asset_fail_reason(cfg: dict | None = None, max_vol: Column | None = None) -> Column:
    """First quality test a symbol fails, as text; null when it passes all."""
    before, vol, after = asset_reasons(cfg)
    limit, text = vol_limit(C("vol_max") if max_vol is None else max_vol, cfg)
    return F.coalesce(before, F.when(C("volatility") > limit, F.concat(vol, text)), after)


def asset_facts(requested: DataFrame, quality: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row per requested symbol: class, tier and quality metrics, null where unknown."""
    a = requested.select(F.upper("symbol").alias("symbol")).distinct()
    a = a.join(catalog.select("symbol", "asset_class", "core_or_satellite"), "symbol", "left")
    a = a.withColumns({"asset_class": F.coalesce("asset_class", known_symbol_class(C("symbol")), F.lit("unknown")),
                       "core_or_satellite": F.coalesce("core_or_satellite", F.lit("satellite"))})
    return a.join(quality.withColumnRenamed("ticker", "symbol"), "symbol", "left")


def asset_receipts(requested: DataFrame, quality: DataFrame, catalog: DataFrame, users: DataFrame, cfg: dict | None = None) -> DataFrame:
    """Filter result of every requested symbol for every user, absent symbols included.

    The asset side is one row per symbol, its texts included; it is packed once into an array, so the users
    are expanded in place. Before that their id, limit and its text are dealt out evenly, as a few splits of the
    users' file make many rows. For the symbols that pass alone, see ``volatility_universes``.
    """
    before, vol, after = asset_reasons(cfg)
    a = asset_facts(requested, quality, catalog).withColumns({"_before": before, "_vol": vol, "_after": after})
    packed = a.agg(F.collect_list(F.struct(*a.columns))).scalar()
    limit, text = vol_limit(C("vol_max"), cfg)
    u = users.select("user_id", limit.alias("_limit"), text.alias("_text")).repartition("user_id")
    j = u.withColumn("_a", packed).select("user_id", "_limit", "_text", F.explode("_a").alias("a")).select("user_id", "_limit", "_text", "a.*")
    why = F.coalesce("_before", F.when(C("volatility") > C("_limit"), F.concat("_vol", "_text")), "_after")
    return j.select("user_id", "symbol", "asset_class", "core_or_satellite", F.coalesce("years", F.lit(0.0)).alias("years"), "cagr", "volatility",
                    "sharpe", "max_drawdown", why.isNull().alias("passed"), why.alias("fail_reason"))


def eligible_assets(requested: DataFrame, quality: DataFrame, catalog: DataFrame, cfg: dict | None = None) -> DataFrame:
    """(symbol, volatility) of the symbols that pass every test but the user's volatility limit."""
    a = asset_facts(requested, quality, catalog)
    return a.where(asset_fail_reason(cfg, F.lit(float("inf"))).isNull()).select("symbol", "volatility")


def volatility_universes(eligible: DataFrame) -> DataFrame:
    """(step, symbols): the universe of every volatility step, a sorted array.

    A user's limit decides by volatility alone, so there are as many universes as distinct volatilities, and one
    of those below all (step 0, symbols without a volatility). Step k holds the k lowest volatilities.
    """
    step = F.coalesce(F.dense_rank().over(W.orderBy(C("volatility").asc_nulls_first())) - F.max(C("volatility").isNull().cast("int")).over(W.partitionBy()), F.lit(0))
    so_far = W.orderBy("step").rangeBetween(W.unboundedPreceding, 0)  # eligible symbols of the catalog
    return eligible.withColumn("step", step).withColumn("symbols", F.sort_array(F.collect_list("symbol").over(so_far))).select("step", "symbols").distinct()


def with_volatility_step(users: DataFrame, eligible: DataFrame, limit: Column) -> DataFrame:
    """Users with the ``step`` of their volatility limit: how many distinct volatilities do not exceed it; all, where there is no limit.

    A binary search in the sorted breakpoints, one number a symbol of the catalog; users are not shuffled.
    """
    breaks = eligible.agg(F.sort_array(F.collect_set("volatility"))).scalar()
    ends = F.struct(F.lit(0).alias("lo"), F.size("_breaks").alias("hi"))  # the answer lies in [lo, hi]

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["lo"] + s["hi"] + 1, 1)
        fits = F.coalesce(F.get("_breaks", middle - 1) <= C("_limit"), F.lit(True))
        return F.struct(F.when(fits, middle).otherwise(s["lo"]).alias("lo"), F.when(fits, s["hi"]).otherwise(F.greatest(middle - 1, s["lo"])).alias("hi"))

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size("_breaks") + 1.0)).cast("int"))
    df = users.withColumns({"_breaks": breaks, "_limit": limit})
    return df.withColumn("step", F.aggregate(rounds, ends, halve)["lo"]).drop("_breaks", "_limit")


def ordered_universe(available: DataFrame, listed: DataFrame) -> DataFrame:
    """Configured order first, then whatever else is available, by symbol."""
    o = listed.groupBy(F.upper("symbol").alias("_s")).agg(F.min("ordinal").alias("_o"))
    j = available.select("symbol").distinct().join(o, F.upper("symbol") == C("_s"), "left")
    return j.select("symbol", F.row_number().over(W.orderBy(C("_o").asc_nulls_last(), "symbol")).alias("position"))  # list of symbols
