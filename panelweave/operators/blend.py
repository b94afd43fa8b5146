"""Joins of weights, returns, classes, regimes and scenarios."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import fixed
from ..functions.expr import col, dealt, div, keys_of, lookup, rounded
from . import panels, stats

# ---- portfolio returns ------------------------------------------------------------------------

def portfolio_returns(rets: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted sum per portfolio and date; a missing asset contributes nothing."""
    return panels.daily_sums(weights, rets).select("portfolio_id", "date", "ret")


def renormalised_returns(rets: DataFrame, weights: DataFrame) -> DataFrame:
    """Weights clipped at zero and spread each date over the assets present."""
    long_only = weights.withColumn("weight", F.greatest(F.lit(0.0), F.coalesce("weight", F.lit(0.0))))
    sums = panels.daily_sums(long_only, rets).where("n > 0")
    return sums.select("portfolio_id", "date", F.coalesce(div("ret", "held"), F.lit(0.0)).alias("ret"))


def on_every_date(port_rets: DataFrame, portfolios: DataFrame, dates: DataFrame) -> DataFrame:
    """Portfolio returns on all panel dates, zero where nothing moved. Each portfolio expands a
    sequence of date positions, which join back to the calendar by key."""
    cal = dates.select("date").distinct().withColumn("_i", F.row_number().over(W.orderBy("date")))  # calendar only
    n = cal.agg(F.count("*")).scalar()
    grid = portfolios.select("portfolio_id").distinct().withColumn("_n", n.cast("int")).select(
        "portfolio_id", F.explode(F.sequence(F.lit(1), "_n")).alias("_i"))
    return grid.join(cal, "_i").join(port_rets, ["portfolio_id", "date"], "left").select(
        "portfolio_id", "date", F.coalesce("ret", F.lit(0.0)).alias("ret"))


def portfolio_curve(panel: DataFrame, weights: DataFrame, rets: DataFrame) -> DataFrame:
    """Curve from 1.0 over every price date, missing returns as zero."""
    return stats.equity_curve(on_every_date(portfolio_returns(rets, weights), weights, panel), "portfolio_id")


def portfolio_metrics(weights: DataFrame, rets: DataFrame, rf: float = 0.015) -> DataFrame:
    """Quality metrics on each portfolio's complete dates, diversification ratio and holdings.

    One pass over blocks of the panel keeps a few numbers a portfolio: no row a date leaves it.
    """
    held = weights.join(rets.select("ticker").distinct(), "ticker", "left_semi")
    whole = F.sum("weight").over(W.partitionBy("portfolio_id"))
    held = held.select("portfolio_id", "ticker", (F.col("weight") / whole).alias("weight"))
    facts = panels.complete_facts(held, rets)
    q = stats.quality_of_facts(facts.withColumn("_wv", F.col("weighted_vol")), ["portfolio_id", "_wv"], rf)
    n = held.groupBy("portfolio_id").agg(F.count_if(F.col("weight") > 1e-4).alias("num_holdings"))
    out = n.join(q, "portfolio_id", "left")
    return out.select(
        "portfolio_id", F.coalesce("valid", F.lit(False)).alias("valid"), F.when(F.col("valid").isNull(), "insufficient returns data")
        .otherwise(F.col("reason")).alias("reason"), "cagr", "volatility", "sharpe", "max_drawdown", "total_return",
        F.when(F.col("valid"), F.coalesce(div("_wv", "volatility"), F.lit(1.0))).alias("diversification_ratio"), "num_holdings")


def risk_contributions(weights: DataFrame, cov: DataFrame, annual_factor: float = 1.0) -> DataFrame:
    """w * (Cov w) / sigma per holding; the parts add up to the portfolio's volatility.

    ``cov`` is a matrix in long form (i, j, value), or one map a row (i, row). It meets the portfolios in blocks, so
    a holding carries one number, not its matrix row. ``annual_factor`` scales a daily matrix to the time scale
    of the volatility it is compared with.
    """
    long = cov.select("i", F.explode("row").alias("j", "value")) if "row" in cov.columns else cov
    var = F.col("variance") * annual_factor
    return panels.matrix_shares(weights, long).select(
        "portfolio_id", "ticker", "weight", F.when(var > 0, F.col("share") * annual_factor / F.sqrt(var)).otherwise(0.0).alias("risk_contribution"),
        F.when(var > 0, F.sqrt(var)).otherwise(0.0).alias("portfolio_volatility"))


# ---- classes ----------------------------------------------------------------------------------

def known_symbol_class(symbol: Column) -> Column:
    s = F.upper(symbol)
    return F.coalesce(*[F.when(s.isin(*names), c) for c, names in fixed.SYMBOLS_BY_CLASS.items()])


def class_from_fine(fine: Column) -> Column:
    """Asset class implied by a fine class name."""
    return (F.when(fine.startswith("equity"), "equity")
            .when(fine.startswith("bond") | fine.isin("high_yield", "munis", "treasury_long", "tbills"), "bond")
            .when(fine == "cash", "cash").when(fine.isin("commodities", "gold"), "commodity").when(fine == "reit", "reit"))


def asset_classes(symbols: DataFrame, snapshot: DataFrame, catalog: DataFrame, unknown: str = "unknown") -> DataFrame:
    """First of: snapshot record, catalog asset class, fine class rule, well-known symbol, unknown."""
    s = symbols.select(F.upper("symbol").alias("symbol")).distinct()
    a = snapshot.select(F.upper("symbol").alias("symbol"), F.col("asset_class").alias("_a"))
    b = catalog.select(F.upper("symbol").alias("symbol"), F.col("asset_class").alias("_b"), F.col("class").alias("_c"))
    return s.join(a, "symbol", "left").join(b, "symbol", "left").select("symbol", F.coalesce(
        "_a", "_b", class_from_fine(F.col("_c")), known_symbol_class(F.col("symbol")), F.lit(unknown)).alias("asset_class"))


def class_flags(df: DataFrame, symbol="symbol", fine="class") -> DataFrame:
    """Bucket flags used by bounds and constraints."""
    s, c = F.upper(col(symbol)), col(fine)
    eq = c.startswith("public_equity")
    return df.withColumns({
        "is_equity": eq, "is_bond": c.isin(*fixed.BOND_CLASSES), "is_cash": s.isin("BIL", "SHY") | (c == "tbills"),
        "is_alt": c.isin(*fixed.ALT_CLASSES) | s.isin("GLD", "DBC", "VNQ"),
        "is_equity_ticker": s.isin(*fixed.EQUITY_TICKERS), "is_bond_ticker": s.isin(*fixed.BOND_TICKERS)})


# ---- regimes and scenarios --------------------------------------------------------------------

def regime_performance(port_rets: DataFrame, regimes: DataFrame, min_rows: int = 20) -> DataFrame:
    j = port_rets.join(regimes.select("date", "regime"), "date")
    m = stats.annualized_metrics(j, ["portfolio_id", "regime"]).where(F.col("n") >= min_rows)
    return m.select("portfolio_id", "regime", "cagr", "sharpe", "n")


def parse_shock(spec: Column) -> dict[str, Column]:
    """'equity-10%', 'rates+100bp', 'gold+0.05' as target, sign and decimal size."""
    s = F.lower(F.trim(spec))
    size = F.trim(F.regexp_extract(s, r"[+-]\s*(.*)$", 1))
    value = F.regexp_extract(size, r"^([0-9.]+)", 1).try_cast("double")
    return {"target": F.trim(F.regexp_extract(s, r"^([^+-]*)", 1)), "direction": F.regexp_extract(s, r"([+-])", 1),
            "magnitude": F.when(size.endswith("bp"), value / 10000.0).when(size.endswith("%"), value / 100.0).otherwise(value)}


def _shocks(classes: DataFrame, scenarios: dict[str, list[str]]) -> DataFrame:
    """Multiplier per scenario and affected ticker."""
    pairs = [F.struct(F.lit(n).alias("scenario_id"), F.lit(s).alias("spec")) for n, specs in scenarios.items() for s in specs]
    x = classes.withColumn("_x", F.explode(F.array(*pairs))).select("symbol", "class", "_x.scenario_id", "_x.spec")
    x = x.withColumns(parse_shock(F.col("spec")))
    kind = F.when(F.col("target") == "bonds", "rates").otherwise(F.col("target"))
    hit = F.lit(False)
    for name, fine in fixed.SHOCK_CLASSES.items():
        hit = hit | ((kind == name) & F.col("class").isin(*fine))
    hit = hit | ((kind == "gold") & F.upper("symbol").isin("GLD", "IAU"))
    signed = F.when(F.col("direction") == "+", F.col("magnitude")).otherwise(-F.col("magnitude"))
    duration = lookup(F.upper("symbol"), fixed.DURATIONS, 7.0)
    factor = F.when(kind == "rates", F.lit(1.0) - duration * signed).otherwise(signed + 1)
    return x.where(hit).groupBy("scenario_id", F.col("symbol").alias("ticker")).agg(F.product(factor).alias("factor"))


def apply_shocks(rets: DataFrame, scenarios: dict[str, list[str]], classes: DataFrame) -> DataFrame:
    """The panel under every scenario: the first panel date's returns are scaled."""
    first = rets.agg(F.min("date")).scalar()
    names = F.explode(F.array(*map(F.lit, scenarios)))
    x = rets.withColumn("scenario_id", names).join(_shocks(classes, scenarios), ["scenario_id", "ticker"], "left")
    return x.select("scenario_id", "ticker", "date", (F.col("ret") * F.when(F.col("date") == first, F.coalesce("factor", F.lit(1.0)))
                                                     .otherwise(1.0)).alias("ret"))


def shocked_day(rets: DataFrame, scenarios: dict[str, list[str]], classes: DataFrame) -> DataFrame:
    """What ``apply_shocks`` changes: the first panel date's returns under every scenario, one row a scenario and ticker."""
    first = rets.agg(F.min("date")).scalar()
    x = rets.where(F.col("date") == first).withColumn("scenario_id", F.explode(F.array(*map(F.lit, scenarios))))
    x = x.join(_shocks(classes, scenarios), ["scenario_id", "ticker"], "left")
    return x.select("scenario_id", "ticker", "date", (F.col("ret") * F.coalesce("factor", F.lit(1.0))).alias("ret"))


def shocked_volatility(rets: DataFrame, day: DataFrame, scenarios: dict[str, list[str]]) -> DataFrame:
    """Annual volatility of every ticker under every scenario, without the panel's copies.

    The moments of a ticker's other dates are summed once; each scenario adds its one changed return (``day``, from
    ``shocked_day``) to them. Null where fewer than two returns are left, like a sample deviation.
    """
    later = F.when(F.col("date") > rets.agg(F.min("date")).scalar(), F.col("ret"))
    base = rets.groupBy("ticker").agg(F.count(later).alias("_n"), F.avg(later).alias("_m"), (F.var_pop(later) * F.count(later)).alias("_q"))
    j = base.withColumn("scenario_id", F.explode(F.array(*map(F.lit, scenarios)))).join(day.select("scenario_id", "ticker", F.col("ret").alias("_x")), ["scenario_id", "ticker"], "left")
    gap = F.col("_x") - F.col("_m")
    var = F.when(F.col("_x").isNull(), div("_q", F.col("_n") - 1)).otherwise(div(F.col("_q") + div(gap * gap * F.col("_n"), F.col("_n") + 1), F.col("_n")))
    return j.select("scenario_id", "ticker", (F.sqrt(var) * stats.ROOT).alias("ann_vol"))


def regime_tilt(asset_class: Column, regime: Column) -> Column:
    """Small allocation tilt of a class under risk_on, tightening or recessionary."""
    on, tight, down = [F.when(regime == r, 1.0).otherwise(0.0) for r in ("risk_on", "tightening", "recessionary")]
    return (F.when(asset_class.startswith("equity"), on * 0.05 - down * 0.05)
            .when(asset_class.startswith("bonds"), down * 0.05 - on * 0.05 - tight * 0.02)
            .when(asset_class.isin("commodities", "gold"), down * 0.02).when(asset_class == "cash", tight * 0.02).otherwise(0.0))


def tilt_weights(weights: DataFrame, classes: DataFrame, regime: Column) -> DataFrame:
    """Weights times one plus tilt, clipped and re-normalised."""
    w = weights.join(classes.select(F.col("symbol").alias("ticker"), F.col("asset_class").alias("_c")), "ticker", "left")
    t = F.greatest(F.lit(0.0), F.col("weight") * (F.lit(1.0) + F.coalesce(regime_tilt(F.col("_c"), regime), F.lit(0.0))))
    w = w.withColumn("_t", t).withColumn("_s", F.sum("_t").over(W.partitionBy("portfolio_id")))
    return w.select("portfolio_id", "ticker", F.when(F.col("_s") > 0, F.col("_t") / F.col("_s")).otherwise(F.col("weight")).alias("weight"))


# ---- comparing portfolios ---------------------------------------------------------------------

def _norms(weights: DataFrame, key) -> DataFrame:
    return weights.groupBy(*key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_n"))


def cosine_similarity(weights: DataFrame, pairs: DataFrame, threshold: float = 0.995) -> DataFrame:
    """Similarity of the requested (a, b) portfolios over the union of their symbols.

    Only the listed pairs are formed; symbols held by one side add nothing to the product.
    """
    w = weights.select("portfolio_id", "ticker", "weight")
    left = pairs.join(w.select(F.col("portfolio_id").alias("a"), "ticker", F.col("weight").alias("_wa")), "a")
    both = left.join(w.select(F.col("portfolio_id").alias("b"), "ticker", F.col("weight").alias("_wb")), ["b", "ticker"])
    dot = both.groupBy("a", "b").agg(F.sum(F.col("_wa") * F.col("_wb")).alias("_dot"))
    n = _norms(w, ["portfolio_id"])
    out = pairs.join(n.select(F.col("portfolio_id").alias("a"), F.col("_n").alias("_na")), "a", "left")
    out = out.join(n.select(F.col("portfolio_id").alias("b"), F.col("_n").alias("_nb")), "b", "left").join(dot, ["a", "b"], "left")
    sim = F.coalesce(div(F.coalesce("_dot", F.lit(0.0)), F.col("_na") * F.col("_nb")), F.lit(0.0))
    return out.select("a", "b", sim.alias("similarity"), (sim <= threshold).alias("distinct"))


def weight_diff(current: DataFrame, baseline: DataFrame, threshold: float = 0.02, key="portfolio_id") -> DataFrame:
    """Absolute change per symbol, whether it exceeds the threshold, and the portfolio's largest."""
    k = keys_of(key)
    j = current.select(*k, "ticker", F.col("weight").alias("_c")).join(
        baseline.select(*k, "ticker", F.col("weight").alias("_b")), [*k, "ticker"], "full_outer")
    d = F.abs(F.coalesce("_c", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0)))
    return j.select(*k, "ticker", d.alias("delta"), (d > threshold).alias("flagged"), F.max(d).over(W.partitionBy(*k)).alias("max_delta"))


def weight_snapshot(weights: DataFrame, universe: DataFrame) -> DataFrame:
    """Every universe symbol per portfolio: clipped, normalised, rounded; equal weights when all are zero."""
    syms = universe.agg(F.sort_array(F.collect_set("ticker"))).scalar()  # the catalog, not the facts
    held = weights.groupBy("portfolio_id", "ticker").agg(F.max("weight").alias("weight")).groupBy("portfolio_id").agg(F.map_from_entries(
        F.collect_list(F.when(F.col("ticker").isNotNull(), F.struct("ticker", "weight")))).alias("_held"))
    own = F.transform("_u", lambda t: F.struct(t.alias("ticker"), F.greatest(F.lit(0.0), F.coalesce(F.try_element_at("_held", t), F.lit(0.0))).alias("w")))
    rows = held.withColumn("_u", syms).withColumn("_own", own).withColumn("_s", F.aggregate("_own", F.lit(0.0), lambda s, x: s + x["w"]))
    rows = rows.select("portfolio_id", "_s", F.size("_own").alias("_n"), F.explode("_own").alias("_o"))
    return rows.select("portfolio_id", "_o.ticker", rounded(F.when(F.col("_s") > 0, F.col("_o.w") / F.col("_s")).otherwise(F.lit(1.0) / F.col("_n")), 4).alias("weight"))


def benchmark_join(port_rets: DataFrame, benchmark: DataFrame) -> DataFrame:
    return port_rets.join(benchmark.select("date", F.col("ret").alias("benchmark_ret")), "date")


def compare_results(run1: DataFrame, run2: DataFrame, key: str = "name", value: str = "passed") -> DataFrame:
    """Test outcomes of two runs side by side; an absent test counts as failed."""
    a, b = run1.select(key, F.col(value).alias("_a")), run2.select(key, F.col(value).alias("_b"))
    j = a.join(b, key, "full_outer").select(key, F.coalesce("_a", F.lit(False)).alias("run1"), F.coalesce("_b", F.lit(False)).alias("run2"))
    return j.withColumn("change", F.when(F.col("run1") == F.col("run2"), "SAME").when(F.col("run2"), "FIXED").otherwise("REGRESSION"))


def compare_artifacts(files1: DataFrame, files2: DataFrame, key: str = "name") -> DataFrame:
    """Files only in the first run, only in the second, or in both."""
    both = files1.select(key, F.lit(True).alias("_a"), F.lit(False).alias("_b")).unionByName(files2.select(key, F.lit(False).alias("_a"), F.lit(True).alias("_b")))
    g = dealt(both, files1.count() + files2.count(), key).groupBy(key).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return g.select(key, F.when(~F.col("_b"), "only_in_1").when(~F.col("_a"), "only_in_2").otherwise("common").alias("found"))


def holding_receipts(weights: DataFrame, contributions: DataFrame, provenance: DataFrame, asset_receipts: DataFrame) -> DataFrame:
    """Per holding: weight, risk contribution, data source and asset filter result, largest first."""
    out = weights.join(contributions.select("portfolio_id", "ticker", "risk_contribution"), ["portfolio_id", "ticker"], "left")
    out = out.join(provenance.select("ticker", "provider_map"), "ticker", "left").join(
        asset_receipts.select(F.col("symbol").alias("ticker"), "passed", "fail_reason"), "ticker", "left")
    rank = F.row_number().over(W.partitionBy("portfolio_id").orderBy(F.desc("weight"), "ticker"))
    return out.select("portfolio_id", rank.alias("rank"), "ticker", "weight", F.coalesce("risk_contribution", F.lit(0.0)).alias("risk_contribution"),
                      F.coalesce("provider_map", F.lit("Unknown")).alias("provider"), "passed", "fail_reason")
