"""Candidate portfolios: generation, constraints, filters, ranking, fallback.

A candidate group is one variant grid (optimizers x satellite caps, some twenty rows), so per-group
arrays are bounded by the grid. Holdings are bounded by the universe of the group.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import fixed
from ..functions.expr import clamp, div, keys_of, ordinals, pct, scatter
from . import investors, panels
from .blend import class_flags

C = F.col
OPTIMIZERS = ["max_sharpe", "min_var", "risk_parity", "equal_weight"]
SAT_CAPS = [0.20, 0.25, 0.30, 0.35]


def _part(key):
    return W.partitionBy(*keys_of(key))


def _sum(c, key) -> Column:
    return F.sum(c).over(_part(key))


# ---- generation -------------------------------------------------------------------------------

def variant_grid(groups: DataFrame, optimizers=tuple(OPTIMIZERS), caps=tuple(SAT_CAPS), shocks=("none",)) -> DataFrame:
    """Every group times optimizer, satellite cap and shock, from literal arrays (no cross join)."""
    out = groups.withColumn("optimizer", F.explode(F.array(*map(F.lit, optimizers))))
    out = out.withColumn("sat_cap", F.explode(F.array(*map(F.lit, caps)))).withColumn("shock", F.explode(F.array(*map(F.lit, shocks))))
    whole = F.round(C("sat_cap") * 100, 0).cast("int").cast("string")
    return out.withColumn("name", F.concat(F.upper("optimizer"), F.lit(" - Sat "), whole, F.lit("%")))


def equal_weight(holdings: DataFrame, key="portfolio_id") -> DataFrame:
    return holdings.select(*keys_of(key), "ticker", (F.lit(1.0) / F.count("*").over(_part(key))).alias("weight"))


def inverse_volatility(holdings: DataFrame, vols: DataFrame, key="portfolio_id", on=("ticker",)) -> DataFrame:
    """Weights proportional to 1 / volatility; a volatility of zero or less counts as one.

    ``on`` names the columns volatilities are given by (for instance scenario and ticker). They are one row a
    ticker, sent to the tasks: holdings are not shuffled by a few tickers.
    """
    j = holdings.select(*keys_of(key), "ticker").join(F.broadcast(vols.select(*on, "ann_vol")), list(on))
    j = j.withColumn("_i", F.lit(1.0) / F.when(C("ann_vol") > 0, C("ann_vol")).otherwise(1.0))
    return j.select(*keys_of(key), "ticker", (C("_i") / _sum("_i", key)).alias("weight"))


def diversified(holdings: DataFrame, vols: DataFrame, key="portfolio_id", on=("ticker",)) -> DataFrame:
    """Half inverse volatility, half equal weight."""
    w = inverse_volatility(holdings, vols, key, on)
    return w.withColumn("weight", C("weight") * 0.5 + F.lit(0.5) / F.count("*").over(_part(key)))


def searched_weights(holdings: DataFrame, cov: DataFrame, mu: DataFrame, samples: int = 256, rf: float = 0.015,
                     target_vol: float = 0.12, bounds: tuple[float, float] = (0.0, 0.30), key="portfolio_id", seed: int = 42) -> DataFrame:
    """Best sampled long-only portfolios per group: least volatility, highest Sharpe, most return at
    the target volatility.

    Each sample is a repeatable random vector brought inside the bounds: every name has its low, the rest is
    shared out by size, and what would pass the high goes to the names below it. The samples of a group are one
    matrix, whose quadratic forms add up over blocks of ``cov`` (long form, or one map a row); neither sample nor
    matrix rows are shuffled. The result is the best of the samples, not a solver's optimum.
    """
    k = keys_of(key)
    long = cov.select("i", F.explode("row").alias("j", "value")) if "row" in cov.columns else cov
    rows = holdings.select(*k, "ticker").join(ordinals(holdings, "ticker"), "ticker").select(F.struct(*k).alias("portfolio_id"), "ticker", "ord")
    found = panels.searched(rows, long, mu, samples, rf, target_vol, bounds, seed)
    return found.select("portfolio_id.*", "optimizer", "sample", "ticker", "weight", "ret", "vol", "sharpe")


def sampled_subsets(holdings: DataFrame, variants: list[str], key="portfolio_id", seed: int = 42, min_symbols: int = 8) -> DataFrame:
    """Repeatable symbol subset and look-back per variant; small universes stay whole."""
    k = keys_of(key)
    v = F.posexplode(F.array(*map(F.lit, variants))).alias("_v", "variant")
    h = holdings.select(*k, "ticker").join(F.broadcast(ordinals(holdings, "ticker")), "ticker").select(*k, "ticker", "ord", v)
    h = h.withColumn("_n", F.count("*").over(_part([*k, "variant"])))
    at = lambda options, salt: F.get(F.array(*map(F.lit, options)), (scatter(C("_v"), F.lit(salt), seed) % len(options)).cast("int"))
    small = C("_n") < min_symbols
    size = F.when(small, C("_n")).otherwise(F.greatest(F.lit(5), F.floor(C("_n") * at(fixed.SHARES, 1000003))))
    rank = F.row_number().over(_part([*k, "variant"]).orderBy(scatter(C("_v") + 1, C("ord"), seed), "ticker"))
    return h.withColumn("_k", size).withColumn("_r", rank).where("_r <= _k").select(*k, "variant", "ticker", at(fixed.LOOKBACKS, 2000003).alias("lookback"))


def lookback_returns(rets: DataFrame, lookbacks: DataFrame, key="variant") -> DataFrame:
    """Returns of each variant's tickers on its own number of most recent panel dates."""
    days = rets.select("date").distinct().withColumn("_age", F.row_number().over(W.orderBy(F.desc("date"))))  # calendar only
    return rets.join(days, "date").join(lookbacks, "ticker").where("_age <= lookback").drop("_age")


# ---- bounds -----------------------------------------------------------------------------------

def symbol_bounds(holdings: DataFrame, classes: DataFrame, key="portfolio_id") -> DataFrame:
    """Class limits of the goal spread evenly over the members of each bucket.

    Needs a ``goal`` column on the holdings. Buckets overlap; the later one (equity, bond, cash,
    alternatives) decides. Cash keeps its whole limit per symbol.
    """
    k = keys_of(key)
    h = class_flags(holdings.join(classes.select(C("symbol").alias("ticker"), "class"), "ticker", "left").withColumn(
        "class", F.coalesce("class", F.lit("unknown"))), "ticker")
    names = ["eq_lo", "eq_hi", "bd_lo", "bd_hi", "ca_lo", "ca_hi", "al_lo", "al_hi"]
    limit = {n: F.coalesce(*[F.when(C("goal") == g, v[i]) for g, v in fixed.GOAL_LIMITS.items()], F.lit(fixed.GOAL_LIMITS["grow"][i]))
             for i, n in enumerate(names)}
    n = lambda flag: F.greatest(F.count(F.when(C(flag), 1)).over(_part(k)), F.lit(1))
    each = lambda a, flag: limit[a] / n(flag)
    lo = (F.when(C("is_alt"), each("al_lo", "is_alt")).when(C("is_cash"), each("ca_lo", "is_cash")).when(C("is_bond"), each("bd_lo", "is_bond"))
          .when(C("is_equity"), each("eq_lo", "is_equity")).otherwise(0.0))
    hi = (F.when(C("is_alt"), each("al_hi", "is_alt")).when(C("is_cash"), limit["ca_hi"]).when(C("is_bond"), each("bd_hi", "is_bond"))
          .when(C("is_equity"), each("eq_hi", "is_equity")).otherwise(1.0))
    return h.select(*k, "ticker", F.greatest(F.lit(0.0), lo).alias("lo"), F.least(F.lit(1.0), hi).alias("hi"))


def repair_bounds(bounds: DataFrame, key="portfolio_id") -> DataFrame:
    """Feasible bounds: inside [0, 1], ordered, lows summing to at most one and highs to at least one."""
    k = keys_of(key)
    a, b = clamp(F.coalesce("lo", F.lit(0.0)), 0.0, 1.0), clamp(F.coalesce("hi", F.lit(1.0)), 0.0, 1.0)
    r = bounds.select(*k, "ticker", F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
    r = r.withColumns({"_l": _sum("lo", k), "_h": _sum("hi", k), "_n": F.count("*").over(_part(k))})
    up = F.when(C("_h") < 1, F.least(F.lit(1.0), C("hi") + (F.lit(1.0) - C("_h")) / C("_n"))).otherwise(C("hi"))
    r = r.withColumn("_up", up).withColumn("_s", _sum("_up", k))
    return r.select(*k, "ticker", F.when(C("_l") > 1, C("lo") / C("_l")).otherwise(C("lo")).alias("lo"),
                    F.when(C("_s") < 1 - 1e-12, 1.0).otherwise(C("_up")).alias("hi"))


def sanitise_weights(weights: DataFrame, key="portfolio_id") -> DataFrame:
    """Missing or negative weights become zero; normalised; equal weights when nothing is left."""
    k = keys_of(key)
    w = weights.withColumn("_w", F.greatest(F.lit(0.0), F.coalesce(F.when(~F.isnan("weight"), C("weight")), F.lit(0.0))))
    w = w.withColumn("_s", _sum("_w", k))
    return w.select(*k, "ticker", F.when(C("_s") > 0, C("_w") / C("_s")).otherwise(F.lit(1.0) / F.count("*").over(_part(k))).alias("weight"))


# ---- constraints ------------------------------------------------------------------------------

def constrain_core_satellite(weights: DataFrame, core_min=0.65, satellite_max=0.35, single_max=0.07, key="portfolio_id",
                             core_symbols: list[str] | None = None) -> DataFrame:
    """Satellites scaled and capped, core lifted to its minimum, one final cap whose excess goes to core.

    Needs ``tier`` (core, satellite or other) per row; limits are numbers or columns. A portfolio without
    a core row gets ``core_symbols`` as core, at equal weights; without such a list all that it holds is core.
    """
    k = keys_of(key)
    weights = seed_core(weights, k, core_symbols)
    lim = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    core_min, satellite_max, single = lim(core_min), lim(satellite_max), lim(single_max)
    core, sat = C("tier") == "core", C("tier") == "satellite"
    of = lambda flag: F.coalesce(F.sum(F.when(flag, C("_w"))).over(_part(k)), F.lit(0.0))
    total = _sum("weight", k)
    w = weights.withColumn("_w", F.when(total > 0, C("weight") / total).otherwise(C("weight")))
    w = w.withColumn("_s", of(sat)).withColumn("_w", F.when(sat & (C("_s") > satellite_max), C("_w") * satellite_max / C("_s")).otherwise(C("_w")))
    w = w.withColumn("_w", F.when(sat, F.least(single, C("_w"))).otherwise(C("_w")))
    w = w.withColumns({"_c": of(core), "_s": of(sat), "_n": F.count(F.when(core, 1)).over(_part(k))})
    short = C("_c") < core_min
    lifted = F.when(C("_c") > 0, C("_w") * core_min / C("_c")).otherwise(core_min / C("_n"))
    room = F.greatest(F.lit(0.0), F.lit(1.0) - core_min)
    w = w.withColumn("_w", F.when(short & core, lifted).when(short & sat & (C("_s") > 0), C("_w") * room / C("_s")).otherwise(C("_w")))
    w = w.withColumn("_t", _sum("_w", k)).withColumn("_w", F.when(C("_t") > 0, C("_w") / C("_t")).otherwise(C("_w")))
    excess = F.when(sat, F.greatest(F.lit(0.0), C("_w") - single)).otherwise(0.0)
    w = w.withColumns({"_e": F.sum(excess).over(_part(k)), "_c": of(core)})
    w = w.withColumn("_w", F.when(sat, F.least(single, C("_w"))).when(core & (C("_c") > 0), C("_w") * (F.lit(1.0) + C("_e") / C("_c"))).otherwise(C("_w")))
    return w.where(F.abs("_w") > 1e-6).select(*k, "ticker", "tier", C("_w").alias("weight"))


def seed_core(weights: DataFrame, k: list[str], core_symbols: list[str] | None) -> DataFrame:
    """Portfolios without a core row get core rows of weight zero, or have all rows made core."""
    bare = F.count(F.when(C("tier") == "core", 1)).over(_part(k)) == 0
    if not core_symbols:
        return weights.withColumn("_b", bare).withColumn("tier", F.when(C("_b"), "core").otherwise(C("tier"))).drop("_b")
    rows = weights.withColumns({"_b": bare, "_1": F.row_number().over(_part(k).orderBy("ticker"))})
    names = F.array(*map(F.lit, core_symbols))
    held = rows.withColumn("tier", F.when(C("_b") & C("ticker").isin(core_symbols), "core").otherwise(C("tier")))
    held = held.withColumn("_held", F.when(C("_b"), F.collect_set("ticker").over(_part(k))))
    seeds = held.where("_b and _1 = 1").withColumn("ticker", F.explode(F.array_except(names, "_held"))).withColumns({"weight": F.lit(0.0), "tier": F.lit("core")})
    return held.unionByName(seeds).select(*weights.columns)


def weight_violations(weights: DataFrame, core_min: float = 0.65, satellite_max: float = 0.35, single_max: float | None = None,
                      tolerance: float = 1e-6, key="portfolio_id") -> DataFrame:
    """Texts of the broken core/satellite rules per portfolio; an empty list when all hold."""
    k = keys_of(key)
    sat = C("tier") == "satellite"
    per = [F.sum("weight").alias("_t"), F.coalesce(F.sum(F.when(C("tier") == "core", C("weight"))), F.lit(0.0)).alias("_c"),
           F.coalesce(F.sum(F.when(sat, C("weight"))), F.lit(0.0)).alias("_s")]
    big = F.lit(None).cast("array<struct<ticker:string,weight:double>>")
    if single_max:
        over = sat & (C("weight") > single_max + tolerance)
        per.append(F.sort_array(F.collect_list(F.when(over, F.struct("ticker", "weight")))).alias("_big"))
        big = C("_big")
    text = lambda cond, *parts: F.when(cond, F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]))
    g = weights.groupBy(*k).agg(*per)
    fixed_rules = F.array_compact(F.array(
        text(F.abs(C("_t") - 1) > tolerance, "Weights sum to ", F.format_string("%.6f", "_t"), ", expected 1.0"),
        text((C("_c") < core_min - tolerance) & (C("_t") != 0), "Core allocation ", pct(C("_c")), f" below {core_min:.1%} minimum"),
        text((C("_s") > satellite_max + tolerance) & (C("_t") != 0), "Satellite allocation ", pct(C("_s")), f" above {satellite_max:.1%} maximum")))
    singles = F.transform(F.coalesce(big, F.array().cast("array<struct<ticker:string,weight:double>>")), lambda x: F.concat(
        F.lit("Satellite position "), x["ticker"], F.lit(" ("), F.format_string("%.1f%%", x["weight"] * 100), F.lit(f") exceeds {single_max or 0:.1%} cap")))
    return g.select(*k, F.concat(fixed_rules, singles).alias("violations"))


CAP_SLACK = 1e-4


def _cap_round(t: Column) -> Column:
    """One round over a portfolio's class totals: classes over their cap go just below it, the freed
    weight goes to the others by headroom."""
    over = lambda x: x["total"] > x["cap"] + 1e-9
    cut = lambda x: F.greatest(F.lit(0.0), x["cap"] - CAP_SLACK)
    room = lambda x: F.when(x["cap"].isNull() | over(x), 0.0).otherwise(F.greatest(F.lit(0.0), x["cap"] - x["total"]))
    freed = F.aggregate(t, F.lit(0.0), lambda a, x: a + F.when(over(x), x["total"] - cut(x)).otherwise(0.0))
    space = F.aggregate(t, F.lit(0.0), lambda a, x: a + room(x))
    add = lambda x: F.when(space > 1e-9, freed * room(x) / space).otherwise(0.0)
    return F.transform(t, lambda x: F.struct(
        x["asset_class"].alias("asset_class"), F.when(over(x), cut(x)).otherwise(x["total"] + add(x)).alias("total"), x["cap"].alias("cap")))


def redistribute_class_caps(weights: DataFrame, caps: dict[str, float], rounds: int = 10, key="portfolio_id") -> DataFrame:
    """Weights under class caps: excess moves to classes with headroom, then a remaining deficit, then
    normalisation. Needs ``asset_class`` per row.

    Inside a class all weights move by one factor, so the rounds fold over the few class totals of
    a portfolio; the holdings are touched once, at the end.
    """
    k = keys_of(key)
    cap = F.coalesce(*[F.when(C("asset_class") == c, float(v)) for c, v in caps.items()])
    by = weights.groupBy(*k, "asset_class").agg(F.sum(F.greatest(F.lit(0.0), C("weight"))).alias("total"), F.count("*").alias("_m"))
    by = by.withColumn("cap", cap)
    packed = by.groupBy(*k).agg(F.sort_array(F.collect_list(F.struct("asset_class", "total", "cap"))).alias("_t"))
    packed = packed.withColumn("_t", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), C("_t"), lambda t, _: _cap_round(t)))
    total = F.aggregate("_t", F.lit(0.0), lambda a, x: a + x["total"])
    head = lambda x: F.coalesce(F.greatest(F.lit(0.0), x["cap"] - x["total"]), F.lit(0.0))
    packed = packed.withColumns({"_d": F.greatest(F.lit(0.0), F.lit(1.0) - total), "_h": F.aggregate("_t", F.lit(0.0), lambda a, x: a + head(x))})
    filled = F.transform("_t", lambda x: F.struct(x["asset_class"].alias("asset_class"), (
        x["total"] + F.when((C("_h") > 1e-9) & (C("_d") > 1e-6), C("_d") * head(x) / C("_h")).otherwise(0.0)).alias("total")))
    packed = packed.withColumn("_t", filled).withColumn("_sum", F.aggregate("_t", F.lit(0.0), lambda a, x: a + x["total"]))
    new = packed.select(*k, "_sum", F.explode("_t").alias("_x")).select(*k, C("_x.asset_class").alias("asset_class"), (
        C("_x.total") / F.when(C("_sum") > 0, C("_sum")).otherwise(1.0)).alias("_new"))
    old = by.select(*k, "asset_class", C("total").alias("_old"), "_m")
    j = weights.join(old.join(new, [*k, "asset_class"]), [*k, "asset_class"])
    share = F.when(C("_old") > 0, F.greatest(F.lit(0.0), C("weight")) / C("_old")).otherwise(F.lit(1.0) / C("_m"))
    return j.select(*k, "ticker", "asset_class", (C("_new") * share).alias("weight"))


def class_band_check(weights: DataFrame, bands: DataFrame, key="portfolio_id") -> DataFrame:
    """Class weights inside the objective's bands (one point tolerance); first reason in band order.

    Needs ``asset_class`` and ``objective`` per row.
    """
    k = [*keys_of(key), "objective"]
    by = weights.groupBy(*k, "asset_class").agg(F.sum("weight").alias("_w"))
    held = by.groupBy(*k).agg(F.collect_list(F.when(C("asset_class").isNotNull(), F.struct("asset_class", "_w"))).alias("_held"))  # one entry a class
    per = bands.groupBy(C("name").alias("objective")).agg(F.sort_array(F.collect_list(F.struct("band_order", "asset_class", "band_min", "band_max"))).alias("_bands"))

    def why(b: Column) -> Column:
        w = F.coalesce(F.try_element_at(F.map_from_entries("_held"), b["asset_class"]), F.lit(0.0))
        text = lambda sign, edge: F.concat(b["asset_class"], F.lit(" weight "), pct(w), F.lit(sign), pct(edge))
        return F.when(w < b["band_min"] - 0.01, text(" < min ", b["band_min"])).when(w > b["band_max"] + 0.01, text(" > max ", b["band_max"]))

    g = held.join(F.broadcast(per), "objective").select(*k, F.get(F.filter(F.transform("_bands", why), lambda x: x.isNotNull()), 0).alias("fail_reason"))
    return g.withColumn("passed", C("fail_reason").isNull())


# ---- filters and scores -----------------------------------------------------------------------



def strict_thresholds(profiles: DataFrame, cfg: dict | None = None) -> DataFrame:
    c = {**fixed.PORTFOLIO_FILTER, **(cfg or {})}
    return profiles.withColumns({
        "min_cagr": F.lit(c["min_portfolio_cagr"]), "min_sharpe": F.lit(c["min_portfolio_sharpe"]), "max_dd_limit": F.lit(c["max_portfolio_drawdown"]),
        "vol_lower": C("vol_min") * c["vol_soft_lower_factor"], "vol_upper": C("vol_max")})


def adaptive_thresholds(profiles: DataFrame, cfg: dict | None = None) -> DataFrame:
    """Relaxed limits that follow the user's risk; loosest for mid risk."""
    c = {**fixed.PORTFOLIO_FILTER, **(cfg or {})}
    r = {**fixed.RELAX_DEFAULTS, **c.get("stage2_relaxation", {})}
    x = C("true_risk") / 100.0
    centre = F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(x - 0.5) * 2.0)
    sharpe = clamp(F.lit(c["min_portfolio_sharpe"]) + (x - 0.5) * 0.20, 0.15, 0.50)
    dd = clamp(F.lit(c["max_portfolio_drawdown"]) - (x - 0.5) * 0.40, -0.80, -0.25)
    soft = max(0.3, min(c["vol_soft_lower_factor"], 0.9))
    return profiles.withColumns({
        "min_cagr": F.greatest(F.lit(r["min_cagr_floor"]), C("cagr_min") * (centre * r["cagr_multiplier_bonus"] + r["cagr_multiplier_base"])),
        "min_sharpe": F.greatest(F.lit(0.15), sharpe * (centre * r["sharpe_multiplier_bonus"] + r["sharpe_multiplier_base"])),
        "max_dd_limit": clamp(dd - (centre * r["drawdown_shift_bonus"] + r["drawdown_shift_base"]), -0.90, -0.20),
        "vol_lower": F.greatest(F.lit(r["vol_lower_floor"]), C("vol_min") * soft * (centre * r["vol_lower_bonus"] + r["vol_lower_multiplier"])),
        "vol_upper": C("vol_max")})


def fail_reason(cfg: dict | None = None) -> Column:
    """First portfolio test that fails, as text; null when all pass. Needs metrics, thresholds and
    ``max_rc`` (largest risk share, null when unknown) on the row."""
    c = {**fixed.PORTFOLIO_FILTER, **(cfg or {})}
    f, p2 = F.format_string, lambda x: x * 100
    rc, dr, h = c["max_risk_contribution"], c["min_diversification_ratio"], c["min_holdings"]
    return (F.when(~C("valid"), F.concat(F.lit("invalid portfolio metrics: "), F.coalesce("reason", F.lit("unknown"))))
            .when(C("sharpe") < C("min_sharpe"), f("low Sharpe: %.2f < %.2f", "sharpe", "min_sharpe"))
            .when(C("volatility") > C("vol_upper"), f("volatility too high: %.2f%% > %.2f%%", p2(C("volatility")), p2(C("vol_upper"))))
            .when(C("volatility") < C("vol_lower"), f("volatility too low: %.2f%% < %.2f%% (soft_lower)", p2(C("volatility")), p2(C("vol_lower"))))
            .when(C("max_drawdown") < C("max_dd_limit"), f("excessive drawdown: %.1f%% < %.1f%%", p2(C("max_drawdown")), p2(C("max_dd_limit"))))
            .when(C("cagr") < C("min_cagr"), f("low CAGR: %.2f%% < %.2f%%", p2(C("cagr")), p2(C("min_cagr"))))
            .when(C("max_rc") > rc, f(f"risk concentration: max asset RC %.1f%% > {rc * 100:.1f}%% threshold", p2(C("max_rc"))))
            .when(C("diversification_ratio") < dr, f(f"low diversification: %.2f < {dr:.2f}", "diversification_ratio"))
            .when(C("num_holdings") < h, f(f"too few holdings: %d < {h}", "num_holdings")))


def soft_band() -> Column:
    return (C("volatility") >= C("vol_lower")) & (C("volatility") < C("vol_min")) & (C("volatility") <= C("vol_upper")) & (C("sharpe") >= C("min_sharpe"))


def filter_portfolios(user_candidates: DataFrame, cfg: dict | None = None) -> DataFrame:
    """Verdict, reason and soft-band flag for rows of user x candidate."""
    why = fail_reason(cfg)
    return user_candidates.withColumns({"passed": why.isNull(), "fail_reason": why, "soft_band": F.coalesce(C("valid") & soft_band(), F.lit(False))})


def composite_score(penalty: float = 0.2, soft_penalty: float = 0.5) -> Column:
    """Sharpe less a share of the drawdown, less the gap to the band when only softly inside it."""
    gap = F.when(C("soft_band") & (C("vol_min") > 0) & (C("volatility") < C("vol_min")), (C("vol_min") - C("volatility")) * soft_penalty).otherwise(0.0)
    return C("sharpe") - F.abs("max_drawdown") * penalty - gap


def diversity_score(metrics: DataFrame, weights: DataFrame, classes: DataFrame, regime_sharpe: DataFrame, objective: Column,
                    key="portfolio_id") -> DataFrame:
    """Base score less concentration and sector penalties plus the current regime's Sharpe."""
    k = keys_of(key)
    w = weights.join(classes.select(C("symbol").alias("ticker"), "asset_class"), "ticker", "left").groupBy(*k).agg(
        F.max("weight").alias("_m"), F.coalesce(F.sum(F.when(C("asset_class") == "equity", C("weight"))), F.lit(0.0)).alias("_e"),
        F.coalesce(F.sum(F.when(C("asset_class") == "bond", C("weight"))), F.lit(0.0)).alias("_b"))
    zero = F.lit(0.0)
    sector = F.when(objective == "growth", F.greatest(zero, C("_e") - 0.80)).when(objective.isin("balanced", "income"), F.greatest(zero, F.lit(0.20) - C("_b"))).otherwise(0.0)
    j = metrics.join(w, k).join(regime_sharpe.select(*k, C("sharpe").alias("_rs")), k, "left")
    j = j.withColumns({"base_score": C("sharpe") - F.abs("max_dd") * 0.2, "concentration_penalty": F.greatest(zero, C("_m") - 0.20),
                       "sector_penalty": sector, "regime_sharpe": F.coalesce("_rs", zero)})
    score = C("base_score") - C("concentration_penalty") * 0.1 - C("sector_penalty") * 0.1 + C("regime_sharpe") * 0.1
    return j.withColumn("score", score).select(*k, "base_score", "concentration_penalty", "sector_penalty", "regime_sharpe", "score")


# ---- distinctness and ranking -----------------------------------------------------------------

def conflicts(weights: DataFrame, group="group_id", name="name", threshold: float = 0.995, inclusive: bool = True) -> DataFrame:
    """Per candidate the names in its group that are too similar to it (cosine over the threshold).

    A group's candidates are one bounded array; the comparison stays inside the row and only the
    conflicting names leave it.
    """
    book = weights.groupBy(group, name).agg(F.map_from_entries(F.collect_list(F.struct("ticker", "weight"))).alias("w"),
                                            F.sqrt(F.sum(C("weight") * C("weight"))).alias("n"))
    g = book.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(C(name).alias("name"), "n", F.map_entries("w").alias("e")))).alias("_g"))
    x = g.select(group, "_g", F.explode("_g").alias("_x")).withColumn("_m", F.map_from_entries("_x.e"))
    sim = lambda o: div(F.aggregate(o["e"], F.lit(0.0), lambda a, e: a + e["value"] * F.coalesce(F.try_element_at(C("_m"), e["key"]), F.lit(0.0))), o["n"] * C("_x.n"))
    near = (lambda s: s >= threshold) if inclusive else (lambda s: s > threshold)
    hit = F.filter("_g", lambda o: (o["name"] != C("_x.name")) & F.coalesce(near(sim(o)), F.lit(False)))
    return x.select(group, C("_x.name").alias(name), F.transform(hit, lambda o: o["name"]).alias("conflicts"))


def drop_near_duplicates(candidates: DataFrame, by, name="name", score="score") -> DataFrame:
    """Walk each group by score and keep a candidate unless it conflicts with one already kept.

    Needs ``conflicts`` per row. A group's rows travel as one array, bounded by its grid, and what is kept is
    taken from it: no join back.
    """
    k = keys_of(by)
    names = candidates.columns
    order = F.row_number().over(_part(k).orderBy(F.desc_nulls_last(score), name))
    g = candidates.withColumn("_o", order).groupBy(*k).agg(F.sort_array(F.collect_list(F.struct("_o", F.struct(*names).alias("r")))).alias("_g"))
    empty = F.filter("_g", lambda x: F.lit(False))
    clear = lambda a, x: ~F.coalesce(F.arrays_overlap(F.transform(a, lambda y: y["r"][name]), x["r"]["conflicts"]), F.lit(False))
    kept = F.aggregate("_g", empty, lambda a, x: F.when(clear(a, x), F.concat(a, F.array(x))).otherwise(a))
    return g.select(F.explode(kept).alias("_x")).select("_x.r.*")


EMERGENCY_FACTS = ("optimizer", "sat_cap", "cagr", "volatility", "sharpe", "max_drawdown", "diversification_ratio", "num_holdings", "portfolio_id")


def fallback_ladder(candidates: DataFrame, emergency: DataFrame, n: int = 8, by="user_id", carry=()) -> DataFrame:
    """Strict passes, else relaxed ones, else softly viable ones, else the emergency portfolio.

    Needs ``strict`` and ``relaxed`` flags, metrics, composite_score and conflicts per row;
    ``emergency`` holds one row per user with the name of the equal-weight portfolio. ``carry`` names further
    columns of both, which the result keeps.
    """
    k = keys_of(by)
    soft = (C("cagr") > 0) & (C("sharpe") > 0) & (C("max_drawdown") > -0.80)
    stage = F.when(C("strict"), 1).when(C("relaxed"), 2).when(soft, 3)
    c = candidates.withColumn("_s", stage).withColumn("_min", F.min("_s").over(_part(k)))
    # stage 3 judges every candidate by the soft test; below it only the first stage reached counts
    c = c.where(C("_s") == C("_min"))
    c = drop_near_duplicates(c.select(*k, "name", "composite_score", "conflicts", "_s", "fail_reason", *carry), k, score="composite_score")
    rank = F.row_number().over(_part(k).orderBy(F.desc("composite_score"), "name"))
    c = c.withColumn("rank", rank).where(C("rank") <= n).select(
        *k, "rank", "name", "composite_score", C("_s").alias("fallback_level"), F.lit(True).alias("passed"), F.lit(False).alias("hard_fallback"),
        F.when(C("_s") > 1, C("fail_reason")).alias("original_fail_reason"), *carry)
    reached = candidates.where(stage.isNotNull()).select(*k).distinct()
    last = emergency.join(reached, k, "left_anti").select(
        *k, F.lit(1).alias("rank"), "name", F.lit(0.0).alias("composite_score"), F.lit(4).alias("fallback_level"), F.lit(False).alias("passed"),
        F.lit(True).alias("hard_fallback"), F.lit("stage_4_emergency").alias("original_fail_reason"), *carry)
    return c.unionByName(last)


def select_for_risk(user_candidates: DataFrame, band: float = fixed.VOLATILITY_BAND, by="user_id") -> DataFrame:
    """Candidates within a band around the user's target volatility, widened once when under three;
    ordered by growth."""
    k = keys_of(by)
    gap = F.abs(C("volatility") - investors.target_sigma("true_risk"))
    c = user_candidates.withColumn("_g", gap).withColumn("_n", F.count(F.when(gap <= band, 1)).over(_part(k)))
    c = c.where(C("_g") <= F.when(C("_n") < 3, band * 1.5).otherwise(band))
    return c.withColumn("rank", F.row_number().over(_part(k).orderBy("cagr", "name"))).drop("_g", "_n")


def pick_by_slider(selected: DataFrame, slider: Column, by="user_id") -> DataFrame:
    """The selected candidate whose growth is nearest to the slider's point between lowest and highest."""
    k = keys_of(by)
    lo, hi = F.min("cagr").over(_part(k)), F.max("cagr").over(_part(k))
    c = selected.withColumn("_t", lo + clamp(slider, 0.0, 1.0) * (hi - lo)).withColumn("_d", F.abs(C("cagr") - C("_t")))
    return c.withColumn("_n", F.row_number().over(_part(k).orderBy("_d", "cagr", "name"))).where("_n = 1").drop("_n", "_t", "_d")


def closest_volatility(user_candidates: DataFrame, by="user_id") -> DataFrame:
    """Nearest candidate by volatility, for users whose band holds none."""
    d = F.abs(C("volatility") - investors.target_sigma("true_risk"))
    return user_candidates.groupBy(*keys_of(by)).agg(F.min_by("name", F.struct(d, C("name"))).alias("name"), F.min(d).alias("gap"))


def top_candidates(candidates: DataFrame, n: int, by="group_id", score="score", name="name") -> DataFrame:
    """Best n per group, the first one tagged for the shortlist."""
    c = candidates.withColumn("rank", F.row_number().over(_part(by).orderBy(F.desc_nulls_last(score), name))).where(C("rank") <= n)
    return c.withColumn("shortlist", C("rank") == 1)


def relaxed_grid(kept: DataFrame, groups: DataFrame, n: int = 8, by="group_id", caps=tuple(SAT_CAPS), lookbacks=(252, 504, 756)) -> DataFrame:
    """Second variant grid for groups with too few distinct candidates: higher caps, three simple
    methods, three look-backs."""
    counts = groups.select(by).distinct().join(kept.groupBy(by).agg(F.count("*").alias("_n")), by, "left")
    few = counts.where(F.coalesce("_n", F.lit(0)) < min(5, n)).select(by)
    g = variant_grid(few, ("risk_parity", "max_diversification", "equal_weight"), tuple(min(0.40, round(c + 0.05, 10)) for c in caps)).drop("shock")
    g = g.withColumn("lookback", F.explode(F.array(*map(F.lit, lookbacks))))
    return g.withColumn("name", F.concat("name", F.lit(" (relax,"), C("lookback").cast("string"), F.lit("d)")))
