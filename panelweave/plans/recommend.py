"""End-to-end runs composed from the operators.

Users who keep the same symbols share a universe, and candidates are built once per universe, not
once per user: the heavy work grows with the distinct universes, the user side is a join.
The runs write their intermediate tables to the shared folder (``session.stored``), so no stage is
computed twice and a lost executor costs one stage at most.
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import fixed
from ..operators import blend, candidates as cand, clean, investors, macro, matrix, stats, universe
from ..session import stored
from ..sources import sinks

C = F.col
EMERGENCY = "EMERGENCY_FALLBACK - Equal Weight"
SIMPLE = ("equal_weight", "risk_parity", "max_diversification")
SEARCHED = ("max_sharpe", "min_var", "efficient_risk")
GRID_METHODS = ("max_sharpe", "min_var", "risk_parity", "max_diversification", "equal_weight")  # of candidate_run


@dataclass
class Recommendation:
    recommended: DataFrame
    all_candidates: DataFrame
    asset_receipts: DataFrame
    portfolio_receipts: DataFrame
    candidate_weights: DataFrame
    stats: DataFrame
    recommended_weights: DataFrame


def weights_by_method(holdings: DataFrame, rets: DataFrame, methods: list[str], key, samples: int = 256, rf: float = 0.015,
                      vols: DataFrame | None = None, on=("ticker",)) -> DataFrame:
    """Weights of every method on every group, tagged with the optimizer's name."""
    k = [key] if isinstance(key, str) else list(key)
    vols = stats.annual_volatility(rets, list(on)) if vols is None else vols
    simple = {"equal_weight": lambda: cand.equal_weight(holdings, k), "risk_parity": lambda: cand.inverse_volatility(holdings, vols, k, on),
              "max_diversification": lambda: cand.diversified(holdings, vols, k, on)}
    if unknown := set(methods) - set(simple) - set(SEARCHED):
        raise ValueError(f"unknown methods: {sorted(unknown)}")
    parts = [simple[m]().select(*k, F.lit(m).alias("optimizer"), "ticker", "weight") for m in methods if m in simple]
    searched = [m for m in methods if m in SEARCHED]
    if searched:
        found = cand.searched_weights(holdings, stored(matrix.shrunk_covariance(rets)), stats.geometric_return(rets), samples, rf, key=k)
        parts.append(found.where(C("optimizer").isin(searched)).select(*k, "optimizer", "ticker", "weight"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def build_recommendations(profiles: DataFrame, rets: DataFrame, catalog: DataFrame, *, cfg: dict | None = None, requested: DataFrame | None = None,
                          allowed: DataFrame | None = None, methods=tuple(cand.OPTIMIZERS), caps=tuple(cand.SAT_CAPS), n: int = 8,
                          rf: float = 0.015, samples: int = 256, min_assets: int = 3) -> Recommendation:
    """Asset filter, candidates per universe, portfolio filter, score and fallback for every user.

    ``allowed`` (objective, symbol) narrows the universe of each user's objective. A user's universe follows from
    the volatility limit by one range lookup; users meet universes and their candidates by two joins to tables of
    universe size. Who gets no candidate gets the emergency portfolio at equal weights: of the own universe if that
    holds ``min_assets`` symbols, else of the first three requested ones, by symbol; nothing where there are no two.
    ``recommended_weights`` has the holdings of every recommended row with risk contribution (none for an
    emergency portfolio) and asset class.
    """
    rets = stored(rets)
    asked = rets.select(C("ticker").alias("symbol")).distinct() if requested is None else requested
    quality = stored(stats.quality_metrics(rets, rf=rf))
    receipts = universe.asset_receipts(asked, quality, catalog, profiles, cfg)
    group = [] if allowed is None else ["objective"]
    listed = asked.select(F.upper("symbol").alias("symbol")).distinct()
    if allowed is not None:
        mine = profiles.select("user_id", "objective").join(allowed.select("objective", "symbol"), "objective")
        receipts = receipts.join(mine.select("user_id", "symbol"), ["user_id", "symbol"], "left_semi")
        listed = listed.join(allowed.select("objective", "symbol").distinct(), "symbol")
    eligible = universe.eligible_assets(asked, quality, catalog, cfg)
    limit = C("vol_max") * {**fixed.ASSET_FILTER, **(cfg or {})}["max_asset_vol_multiplier"]
    placed = universe.with_volatility_step(profiles, eligible, limit)
    steps = universe.volatility_universes(eligible)
    if allowed is not None:
        narrowed = allowed.groupBy("objective").agg(F.collect_set("symbol").alias("_a"))
        steps = placed.select("step", "objective").distinct().join(steps, "step").join(narrowed, "objective").withColumn("symbols", F.sort_array(F.array_intersect("symbols", "_a")))
    steps = steps.where(F.size("symbols") >= min_assets).select("step", *group, F.md5(F.array_join("symbols", "|")).alias("universe_id"), "symbols")
    universes = stored(steps)
    holdings = universes.select("universe_id", F.explode("symbols").alias("ticker")).distinct()
    base = weights_by_method(holdings, rets, list(methods), "universe_id", samples, rf)
    base = base.withColumn("portfolio_id", F.concat_ws("#", "universe_id", "optimizer"))
    # emergency portfolios: one a universe, one of the first three requested symbols
    first = listed.withColumn("_r", F.row_number().over(W.partitionBy(*group).orderBy("symbol"))).where("_r <= 3") if group else listed.orderBy("symbol").limit(3)
    first = first.select(F.concat_ws("!", F.lit("first"), *group).alias("universe_id"), C("symbol").alias("ticker"))
    two = first.groupBy("universe_id").agg(F.count("*").alias("_n")).where("_n >= 2").select("universe_id")
    rescue = cand.equal_weight(holdings.unionByName(first.join(two, "universe_id", "left_semi")), "universe_id")
    rescue = rescue.select("universe_id", F.lit("emergency").alias("optimizer"), "ticker", "weight", F.concat_ws("#", "universe_id", F.lit("emergency")).alias("portfolio_id"))
    base = stored(base.unionByName(rescue))
    held = base.select("portfolio_id", "ticker", "weight")
    rc = stored(blend.risk_contributions(held, matrix.covariance(rets, annual=False), float(stats.ANNUAL)))
    top = rc.groupBy("portfolio_id").agg(F.max("risk_contribution").alias("_rc"))
    metrics = stored(blend.portfolio_metrics(held, rets, rf).join(top, "portfolio_id", "left").withColumn("max_rc", F.col("_rc") / C("volatility")).drop("_rc"))
    ids = base.where("optimizer <> 'emergency'").select("universe_id", "optimizer", "portfolio_id").distinct()
    grid = cand.variant_grid(ids.select("universe_id", "portfolio_id", C("optimizer").alias("_o")), ("x",), caps).drop("optimizer", "shock", "name")
    grid = grid.withColumn("name", F.concat(F.upper("_o"), F.lit(" - Sat "), F.round(C("sat_cap") * 100, 0).cast("int").cast("string"), F.lit("%")))
    named = grid.withColumnRenamed("_o", "optimizer")
    weights = named.join(held, "portfolio_id")
    clash = cand.conflicts(weights, "universe_id", "name", inclusive=False)
    book = stored(named.join(metrics.where("valid"), "portfolio_id").join(clash, ["universe_id", "name"]))

    own = placed.join(universes.select("step", *group, "universe_id"), ["step", *group], "left")
    rows = own.drop("step").join(book, "universe_id")
    strict = cand.filter_portfolios(cand.strict_thresholds(rows, cfg), cfg).withColumn("composite_score", cand.composite_score())
    drop = ["min_cagr", "min_sharpe", "max_dd_limit", "vol_lower", "vol_upper"]
    both = cand.adaptive_thresholds(strict.drop(*drop), cfg).withColumn("relaxed", cand.fail_reason(cfg).isNull()).withColumn("strict", C("passed")).drop(*drop)
    plain = metrics.where(C("portfolio_id").endswith("#emergency")).join(base.groupBy("portfolio_id").agg(F.first("weight").alias("sat_cap")), "portfolio_id")
    plain = plain.withColumns({"optimizer": F.lit("equal_weight"), "name": F.lit(EMERGENCY)}).select(*cand.EMERGENCY_FACTS, "name")
    spare = own.select("user_id", "universe_id", F.concat_ws("#", F.coalesce("universe_id", F.concat_ws("!", F.lit("first"), *group)), F.lit("emergency")).alias("portfolio_id"))
    spare = spare.join(plain, "portfolio_id").withColumn("short", C("universe_id").isNull())
    recommended = cand.fallback_ladder(both.withColumn("short", F.lit(False)), spare, n, carry=(*cand.EMERGENCY_FACTS, "short"))
    recommended = recommended.withColumn("original_fail_reason", F.when(C("short"), "hard_fallback_insufficient_assets").otherwise(C("original_fail_reason"))).drop("short")
    shown = ["user_id", "name", "optimizer", "sat_cap", "cagr", "volatility", "sharpe", "max_drawdown", "diversification_ratio", "num_holdings",
             "composite_score", "passed", "fail_reason", "soft_band"]
    made = both.groupBy("user_id").agg(F.count("*").alias("total_candidates"), F.count_if("strict").alias("strict_passes"))
    got = recommended.groupBy("user_id").agg(F.count("*").alias("recommended"), F.count_if(C("fallback_level") > 1).alias("fallback_count"),
                                             F.count_if("hard_fallback").alias("hard_fallback_count"), F.max("fallback_level").alias("stage_used"))
    parts = held.join(rc.select("portfolio_id", "ticker", "risk_contribution"), ["portfolio_id", "ticker"], "left").join(
        catalog.select(C("symbol").alias("ticker"), "asset_class"), "ticker", "left")
    parts = parts.withColumn("asset_class", F.coalesce("asset_class", blend.known_symbol_class(C("ticker")), F.lit("unknown")))
    holds = recommended.select("user_id", "rank", "name", "hard_fallback", "portfolio_id").join(parts, "portfolio_id").select(
        "user_id", "rank", "name", "ticker", "weight", F.when(~C("hard_fallback"), C("risk_contribution")).alias("risk_contribution"), "asset_class")
    return Recommendation(recommended, both, receipts, both.select(*shown), weights, got.join(made, "user_id", "left").na.fill(0), holds)


def build_recommendations_for_objectives(profiles: DataFrame, rets: DataFrame, catalog: DataFrame, objectives: DataFrame, bands: DataFrame,
                                         **kw) -> tuple[DataFrame, Recommendation]:
    """The run narrowed to each user's objective: universe by class bands, band check on the result,
    fit, adjusted bands and stretch objective per user."""
    known = objectives.select(C("name").alias("_k"))
    p = profiles.join(known, C("objective") == C("_k"), "left").withColumn("objective", F.coalesce("_k", F.lit("BALANCED"))).drop("_k")
    p, rets = stored(p), stored(rets)
    fits = stored(universe.band_universe(catalog, objectives, bands, rets))
    enough = fits.groupBy("objective").agg(F.count("*").alias("_n")).join(objectives.select(C("name").alias("objective"), "min_holdings"), "objective", "right")
    small = enough.where(F.coalesce("_n", F.lit(0)) < C("min_holdings")).select("objective")
    whole = rets.agg(F.sort_array(F.collect_set("ticker"))).scalar()  # the catalog's symbols
    allowed = fits.join(small, "objective", "left_anti").select("objective", "symbol").unionByName(
        small.withColumn("_s", whole).select("objective", F.explode("_s").alias("symbol")))
    run = build_recommendations(p, rets, catalog, allowed=allowed, **kw)
    mine = run.all_candidates.select("user_id", "name", "universe_id", "objective")
    held = run.candidate_weights.join(catalog.select(C("symbol").alias("ticker"), "asset_class"), "ticker", "left")
    by_objective = mine.select("universe_id", "name", "objective").distinct().join(held, ["universe_id", "name"])
    by_objective = stored(by_objective)
    verdict = cand.class_band_check(by_objective, bands, ["universe_id", "name"]).select("universe_id", "name", "objective", C("passed").alias("in_bands"))
    checked = run.recommended.select(*[c for c in run.recommended.columns if c not in cand.EMERGENCY_FACTS]).join(mine, ["user_id", "name"], "left").join(verdict, ["universe_id", "name", "objective"], "left")
    ok = F.coalesce("in_bands", F.lit(False))
    any_ok = F.max(ok.cast("int")).over(W.partitionBy("user_id"))
    # without any portfolio in the bands the unfiltered list stands
    kept = checked.withColumn("_any", any_ok).where(ok | (C("_any") == 0)).drop("_any")
    fit, adj = investors.objective_fit(p, objectives), investors.adjusted_bands(p, objectives)
    out = kept.select("user_id", "rank", "name", "composite_score", "fallback_level", ok.alias("in_bands")).join(
        fit.select("user_id", "objective", "fit", "suggested"), "user_id").join(adj.drop("objective"), "user_id")
    return out.withColumn("stretch", F.when(C("fit") == "match", investors.stretch_objective())), run


def scenario_candidates(rets: DataFrame, classes: DataFrame, scenarios: dict[str, list[str]], methods=SIMPLE, n: int = 8,
                        regime: Column | None = None, threshold: float = 0.995) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ranked distinct candidates, their weights, their horizon metrics) under every shock scenario.

    A scenario changes the first panel date only, so the panel is never copied for it: volatilities take the
    changed return into moments summed once, and portfolio returns are block products of the one panel plus the
    changed date. With a ``regime`` (a label of ``macro.label_regimes``), weights are tilted by asset class, for which
    ``classes`` has ``asset_class`` beside ``symbol`` and ``class``. Candidates are scored by Sharpe less a fifth of the
    drawdown; of those with a cosine of ``threshold`` or more in a scenario the better one stays. An empty panel gives none.
    """
    if unknown := set(methods) - set(SIMPLE):
        raise ValueError(f"scenario_candidates has no method {sorted(unknown)}")
    first = rets.agg(F.min("date")).scalar()
    day = blend.shocked_day(rets, scenarios, classes)
    vols = blend.shocked_volatility(rets, day, scenarios)
    w = weights_by_method(vols.select("scenario_id", "ticker"), rets, list(methods), "scenario_id", vols=vols, on=("scenario_id", "ticker"))
    w = w.withColumn("portfolio_id", F.concat_ws("#", "scenario_id", "optimizer"))
    if regime is not None:
        named = w.withColumn("_regime", F.replace(F.lower(regime), F.lit("-"), F.lit("_")))  # once, not at every comparison
        tilted = blend.tilt_weights(named, classes, C("_regime"))
        w = w.drop("weight").join(tilted, ["portfolio_id", "ticker"])
    w = stored(w.select("scenario_id", "portfolio_id", "optimizer", "ticker", "weight"))
    changed = w.join(day, ["scenario_id", "ticker"]).groupBy("portfolio_id", "date").agg(F.sum(C("weight") * C("ret")).alias("ret"))
    port = stored(blend.portfolio_returns(rets.where(C("date") > first), w).unionByName(changed))
    m = stats.annualized_metrics(port, "portfolio_id").withColumn("score", C("sharpe") - F.abs("max_dd") * 0.2)
    m = m.join(cand.conflicts(w, "scenario_id", "portfolio_id", threshold), "portfolio_id")
    kept = cand.top_candidates(cand.drop_near_duplicates(m, "scenario_id", "portfolio_id").drop("conflicts"), n, "scenario_id", name="portfolio_id")
    mine = kept.select("portfolio_id")
    return kept, w.join(mine, "portfolio_id", "left_semi"), stats.horizon_metrics(port.join(mine, "portfolio_id", "left_semi"))


def scenario_run(prices: DataFrame, macro_series: DataFrame, classes: DataFrame, scenarios: dict[str, list[str]], path: str,
                 methods=SIMPLE, n: int = 8, regime: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Prices to scenario files: returns, current regime (or the given one), shocks, candidates, horizons, receipts.

    Candidates go to ``path`` as JSON lines, weights and horizon metrics as wide CSV tables, receipts (span and share of
    missing prices per ticker) as Parquet. Returns (candidates, weights, horizon metrics, receipts). The columns of the
    weight table are the tickers of ``classes``.
    """
    label = F.lit(regime) if regime else stored(macro.current_regime(macro.label_regimes(macro.regime_features(macro_series)))).scalar()
    found, w, horizons = scenario_candidates(clean.simple_returns(prices), classes, scenarios, methods, n, label)
    days = prices.agg(F.countDistinct("date")).scalar()
    receipts = prices.where("price is not null").groupBy("ticker").agg(F.min("date").alias("first"), F.max("date").alias("last"),
                                                                       F.round(F.lit(1.0) - F.count("*") / days, 4).alias("nan_rate"))
    names = [r[0] for r in classes.select("symbol").distinct().sort("symbol").collect()]  # the catalog, columns of a CSV
    sinks.write_scenario(found, w, horizons, names, list(stats.HORIZONS), path)
    receipts.write.mode("overwrite").parquet(f"{path}/receipts")
    return found, w, horizons, found.sparkSession.read.parquet(f"{path}/receipts")


def single_portfolios(holdings: DataFrame, rets: DataFrame, classes: DataFrame, method: str = "risk_parity", core_min: float = 0.65,
                      satellite_max: float = 0.35, single_max: float = 0.07) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(final weights, rounded metrics, bounds) of one method for every portfolio of ``holdings``.

    Needs portfolio_id, ticker and goal on the holdings. Missing returns count as zero.
    """
    live = clean.drop_constant(clean.winsorise_by_count(clean.drop_constant(rets)))
    mine = holdings.join(live.select("ticker").distinct(), "ticker", "left_semi")
    bounds = cand.repair_bounds(cand.symbol_bounds(mine, classes))
    w = cand.sanitise_weights(weights_by_method(mine, live, [method], "portfolio_id"))
    port = blend.on_every_date(blend.portfolio_returns(live, w), w, live)
    m = stats.curve_facts(port, "portfolio_id")
    cagr, vol = stats.growth(C("final"), C("n")), C("sd") * stats.ROOT
    metrics = m.select("portfolio_id", F.round(cagr, 4).alias("cagr"), F.round(vol, 4).alias("vol"),
                       F.round(F.coalesce(F.try_divide(cagr, vol), F.lit(0.0)), 2).alias("sharpe"), F.round("max_dd", 4).alias("max_dd"), "n")
    tiers = blend.class_flags(classes).select(C("symbol").alias("ticker"), F.when(C("is_alt"), "satellite").when(
        C("is_equity") | C("is_bond") | C("is_cash"), "core").otherwise("other").alias("tier"))
    limited = cand.constrain_core_satellite(w.join(tiers, "ticker", "left").na.fill("other", ["tier"]), core_min, satellite_max, single_max)
    return cand.sanitise_weights(limited), metrics, bounds


OBJECTIVE_BOUNDS = {"income": (0.70, 0.05), "growth": (0.65, 0.07), "balanced": (0.70, 0.06), "preserve": (0.80, 0.04)}  # core minimum, single cap


def candidate_run(rets: DataFrame, classes: DataFrame, regimes: DataFrame, *, objectives=tuple(OBJECTIVE_BOUNDS), methods=GRID_METHODS,
                  caps=tuple(cand.SAT_CAPS), class_caps: dict[str, float] | None = None, regime: str | None = None, n: int = 8,
                  seed: int = 42, samples: int = 256, rf: float = 0.015) -> tuple[DataFrame, DataFrame]:
    """(ranked distinct candidates, weights) per objective over the optimizer x cap grid.

    Subset and look-back per variant, method (max_sharpe and min_var: the best of ``samples`` sampled portfolios, by
    the covariance and growth of the variant's own look-back), regime tilt, core/satellite and class caps, metrics,
    diversity score, near-duplicate removal, one relaxed second grid for thin groups, top n.
    """
    if unknown := set(methods) - set(GRID_METHODS):
        raise ValueError(f"candidate_run has no method {sorted(unknown)}")
    live, regimes = stored(clean.drop_constant(rets)), stored(regimes)
    groups = live.select("ticker").distinct().withColumn("group_id", F.explode(F.array(*map(F.lit, objectives))))
    flags = blend.class_flags(classes)
    tiers = flags.select(C("symbol").alias("ticker"), "asset_class", F.when(C("is_alt"), "satellite").when(
        C("is_equity") | C("is_bond") | C("is_cash"), "core").otherwise("other").alias("tier"))
    core_min = F.coalesce(*[F.when(C("group_id") == o, a) for o, (a, _) in OBJECTIVE_BOUNDS.items()])
    single = F.coalesce(*[F.when(C("group_id") == o, b) for o, (_, b) in OBJECTIVE_BOUNDS.items()])
    kg = ["group_id", "name"]

    def finish(grid: DataFrame, subset: DataFrame) -> DataFrame:
        """Weights of the grid's variants on their symbols and look-back, constrained."""
        days = live.select("date").distinct().withColumn("_age", F.row_number().over(W.orderBy(F.desc("date"))))  # calendar only
        aged = live.join(days, "date")
        looks = F.array(*map(F.lit, sorted({*fixed.LOOKBACKS, 100000})))
        vols = aged.withColumn("lookback", F.explode(F.filter(looks, lambda x: x >= C("_age")))).groupBy("ticker", "lookback").agg(
            (F.stddev_samp("ret") * stats.ROOT).alias("ann_vol"))
        j = subset.join(vols, ["ticker", "lookback"]).where("ann_vol > 0").join(grid.select(*kg, "optimizer", "sat_cap"), kg)
        part = W.partitionBy(*kg)
        inv = (F.lit(1.0) / C("ann_vol")) / F.sum(F.lit(1.0) / C("ann_vol")).over(part)
        eq = F.lit(1.0) / F.count("*").over(part)
        w = j.where(~C("optimizer").isin(*SEARCHED)).withColumn("weight", F.when(C("optimizer") == "equal_weight", eq).when(C("optimizer") == "max_diversification", (inv + eq) / 2).otherwise(inv))
        if set(methods) & set(SEARCHED):
            # a ticker of a look-back is a name of its own, so one matrix serves the variants of all look-backs
            named = lambda c: F.concat_ws("|", "lookback", c)
            looked = sorted({*fixed.LOOKBACKS, 100000})
            cov = matrix.lookback_covariance(aged, looked).select(named("i").alias("i"), named("j").alias("j"), "value")
            mu = stats.geometric_return(aged.withColumn("lookback", F.explode(F.filter(looks, lambda x: x >= C("_age")))), ["lookback", "ticker"])
            mine = j.where(C("optimizer").isin(*SEARCHED))
            found = cand.searched_weights(mine.select(*kg, named("ticker").alias("ticker")), stored(cov), mu.select(named("ticker").alias("ticker"), "ann_return"), samples, rf, key=kg, seed=seed)
            best = found.select(*kg, "optimizer", F.split("ticker", r"\|", 2)[1].alias("ticker"), "weight")
            w = w.unionByName(mine.join(best, [*kg, "optimizer", "ticker"]).select(*w.columns))
        w = w.withColumn("portfolio_id", F.concat_ws("#", *kg)).drop("asset_class", "tier").join(tiers, "ticker", "left").na.fill("other", ["tier"])
        if regime is not None:
            t = F.greatest(F.lit(0.0), C("weight") * (F.lit(1.0) + blend.regime_tilt(C("asset_class"), F.lit(regime))))
            w = w.withColumn("_t", t).withColumn("weight", C("_t") / F.sum("_t").over(part)).drop("_t")
        limits = grid.select(F.concat_ws("#", *kg).alias("portfolio_id"), "sat_cap", "group_id").withColumns({"_c": core_min, "_1": single}).select("portfolio_id", "_c", "_1")
        w = cand.constrain_core_satellite(w.join(limits, "portfolio_id"), C("_c"), C("sat_cap"), C("_1"))
        w = w.join(tiers.select("ticker", "asset_class"), "ticker", "left").na.fill("unknown", ["asset_class"])
        return stored(cand.redistribute_class_caps(stored(w), class_caps or fixed.CLASS_CAPS).withColumns(
            {"group_id": F.split("portfolio_id", "#")[0], "name": F.split("portfolio_id", "#")[1]}))

    def score(w: DataFrame) -> DataFrame:
        port = stored(blend.portfolio_returns(live, w))
        perf = blend.regime_performance(port, regimes)
        now = perf.join(regimes.orderBy(F.desc("date")).limit(30).agg(F.mode("regime", True).alias("regime")), "regime", "left_semi")
        m = stats.annualized_metrics(port, "portfolio_id").where("volatility > 0")
        s = cand.diversity_score(m, w.select("portfolio_id", "ticker", "weight"), classes, now, F.split("portfolio_id", "#")[0])
        return m.join(s.drop("regime_sharpe"), "portfolio_id").withColumns({"group_id": F.split("portfolio_id", "#")[0], "name": F.split("portfolio_id", "#")[1]})

    grid = cand.variant_grid(groups.select("group_id").distinct(), methods, caps)
    names = [f"{m.upper()} - Sat {round(c * 100)}%" for m in methods for c in caps]
    subset = cand.sampled_subsets(groups, names, "group_id", seed).withColumnRenamed("variant", "name")
    whole = groups.withColumn("name", F.explode(F.array(*[F.lit(x) for x in names if x.startswith("EQUAL_WEIGHT")]))).withColumn("lookback", F.lit(100000))
    subset = subset.where(~C("name").startswith("EQUAL_WEIGHT")).unionByName(whole.select(*subset.columns))
    w1 = finish(grid, subset)
    s1 = stored(score(w1).join(cand.conflicts(w1), kg))
    kept = stored(cand.drop_near_duplicates(s1, "group_id"))
    more = stored(cand.relaxed_grid(kept.select("group_id"), groups, n))
    w2 = finish(more, groups.join(more.select(*kg, "lookback"), "group_id"))
    pool = w1.join(kept.select(*kg), kg, "left_semi").unionByName(w2)
    both = score(w2).select("portfolio_id", *kg, "cagr", "volatility", "sharpe", "max_dd", "score").withColumn("_second", F.lit(1)).unionByName(
        kept.select("portfolio_id", *kg, "cagr", "volatility", "sharpe", "max_dd", "score").withColumn("_second", F.lit(0)))
    both = stored(both).join(cand.conflicts(stored(pool)), kg).withColumn("_order", F.struct(-C("_second"), C("score")))  # first grid first
    final = cand.drop_near_duplicates(both, "group_id", score="_order")
    return cand.top_candidates(final.drop("conflicts", "_second"), n, "group_id", "_order").drop("_order"), pool


def flagship(prices: DataFrame, weights: DataFrame, top: int = 10) -> DataFrame:
    """Prices to returns to portfolio returns to metrics: the best portfolios by Sharpe."""
    m = stats.annualized_metrics(blend.portfolio_returns(clean.simple_returns(prices), weights), "portfolio_id")
    return m.orderBy(F.desc_nulls_last("sharpe"), "portfolio_id").limit(top)
