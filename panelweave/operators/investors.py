"""Investor scoring, bands and objectives: projections over a users table, so they need no shuffle."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.expr import clamp, col, div, lerp, lookup, rounded
from ..functions.fixed import ANSWER_SCORES

C = F.col


def _ladder(x: Column, steps: list[tuple[float, float]], otherwise: float, below: bool = False) -> Column:
    """First matching threshold of a scale."""
    out = None
    for limit, points in steps:
        cond = x < limit if below else x >= limit
        out = F.when(cond, points) if out is None else out.when(cond, points)
    return out.otherwise(otherwise)


def score_answers(users: DataFrame) -> DataFrame:
    """Choice texts become scores; an unknown answer counts as 50."""
    return users.withColumns({q: lookup(C(q), table, 50.0) for q, table in ANSWER_SCORES.items()})


def questionnaire_score() -> Column:
    parts = [clamp(F.coalesce(C(q), F.lit(50.0)), 0.0, 100.0) * w for q, w in fixed.ANSWER_WEIGHTS.items()]
    return clamp(sum(parts[1:], parts[0]), 0.0, 100.0)


def facts_score() -> Column:
    """Income stability, emergency fund, surplus and debt, 25 points each."""
    stability = lookup(C("income_stability"), fixed.STABILITY_POINTS, 15.0)
    fund = _ladder(F.coalesce("emergency_fund_months", F.lit(0.0)), [(6.0, 25.0), (3.0, 15.0), (1.0, 8.0)], 0.0)
    spend = F.coalesce("monthly_expenses", F.lit(1.0)) * 12.0
    surplus = F.when(spend > 0, _ladder(div(F.coalesce("investable_amount", F.lit(0.0)), spend),
                                        [(2.0, 25.0), (1.0, 20.0), (0.5, 12.0), (0.2, 8.0)], 3.0)).otherwise(10.0)
    income = F.coalesce("annual_income", F.lit(1.0))
    debt = F.when(income > 0, _ladder(div(F.coalesce("outstanding_debt", F.lit(0.0)), income),
                                      [(0.1, 25.0), (0.5, 20.0), (1.5, 15.0), (3.0, 8.0)], 0.0, below=True)).otherwise(10.0)
    return clamp(stability + fund + surplus + debt, 0.0, 100.0)


def risk_label(score) -> Column:
    s = col(score)
    return (F.when(s < 20, "Very Conservative").when(s < 40, "Conservative").when(s < 60, "Moderate")
            .when(s < 80, "Growth-Oriented").otherwise("Aggressive"))


def growth_band(true_risk) -> tuple[Column, Column]:
    """(minimum, target) growth, linear between the anchors and flat outside them."""
    t = clamp(true_risk, 0.0, 100.0)
    (r0, *lo), (r1, *mid), (r2, *hi) = fixed.GROWTH_ANCHORS

    def part(i: int) -> Column:
        return (F.when(t <= r0, lo[i]).when(t <= r1, lerp(lo[i], mid[i], (t - r0) / (r1 - r0)))
                .when(t <= r2, lerp(mid[i], hi[i], (t - r1) / (r2 - r1))).otherwise(hi[i]))

    return part(0), part(1)


def target_sigma(risk) -> Column:
    return lerp(*fixed.VOLATILITY_RANGE, clamp(risk, 0.0, 100.0) / 100.0)


def volatility_band(risk) -> tuple[Column, Column, Column]:
    t = target_sigma(risk)
    return F.greatest(F.lit(0.0), t - fixed.VOLATILITY_BAND), t, t + fixed.VOLATILITY_BAND


def horizon(c="horizon_years") -> Column:
    return F.when(col(c) > 0, col(c)).otherwise(10)


def risk_profiles(users: DataFrame) -> DataFrame:
    """The full profile of every user from answers, facts and slider."""
    u = score_answers(users).withColumns({"questionnaire_score": questionnaire_score(), "facts_score": facts_score()})
    u = u.withColumn("combined_score", C("questionnaire_score") * 0.5 + C("facts_score") * 0.5)
    u = u.withColumn("slider_score", F.coalesce(clamp("slider", 0.0, 100.0), "combined_score"))
    risk = F.when(C("slider").isNull(), C("combined_score")).otherwise(C("combined_score") * 0.7 + C("slider_score") * 0.3)
    u = u.withColumn("true_risk", clamp(risk, 0.0, 100.0))
    vol, growth = volatility_band("true_risk"), growth_band("true_risk")
    return u.select(
        "user_id", "nation_key", "questionnaire_score", "facts_score", "combined_score", "slider_score", "true_risk",
        vol[0].alias("vol_min"), vol[1].alias("vol_target"), vol[2].alias("vol_max"), growth[0].alias("cagr_min"),
        growth[1].alias("cagr_target"), risk_label("true_risk").alias("label"), horizon().alias("horizon_years"),
        F.coalesce("objective", F.lit("Balanced")).alias("objective"))


def resolve_risk_fields(profiles: DataFrame) -> DataFrame:
    """Missing risk fields get their defaults."""
    return profiles.withColumns({c: F.coalesce(C(c), F.lit(d)) if c in profiles.columns else F.lit(d)
                                 for c, d in fixed.RISK_DEFAULTS.items()})


def contribution_plans(users: DataFrame) -> DataFrame:
    """Two or three savings plans per user from income, wealth, risk, goal and horizon."""
    k = lookup(C("goal"), fixed.PLAN_MULTIPLIERS, 1.0)
    years = F.coalesce(F.when(C("horizon_years") != 0, C("horizon_years")), F.lit(10))
    monthly = F.greatest(F.lit(0.0), "annual_income") * (C("true_risk") / 100 * 0.06 + 0.02) * k / 12
    lump = F.greatest(F.lit(0.0), "net_worth") * (C("true_risk") / 100 * 0.04 + 0.01) * F.least(F.lit(1.5), years / 20 + 0.5) * k
    offers = [F.struct(F.lit(n).alias("plan"), F.lit(a).alias("l"), F.lit(b).alias("m")) for n, a, b in fixed.PLANS]
    offered = F.when(C("true_risk") >= 40, F.array(*offers)).otherwise(F.array(*offers[:2]))
    return users.withColumns({"_m": monthly, "_l": lump, "_p": F.explode(offered)}).select(
        "user_id", "_p.plan", F.round(C("_l") * C("_p.l"), 2).alias("lump"), F.round(C("_m") * C("_p.m"), 2).alias("monthly"))


def investor_tier(income="annual_income", worth="net_worth") -> Column:
    i, w = col(income), col(worth)
    return (F.when(w >= 25_000_000, "institutional").when(w >= 5_000_000, "qualified_purchaser").when(w >= 2_200_000, "qualified_client")
            .when((w >= 1_000_000) | (i >= 200_000), "accredited").otherwise("retail"))


def allowed_tiers(tier) -> Column:
    """Tiers up to the user's own; an unknown tier counts as the lowest."""
    pos = F.array_position(F.array(*map(F.lit, fixed.TIERS)), col(tier))
    return F.slice(F.array(*map(F.lit, fixed.TIERS)), 1, F.greatest(pos, F.lit(1)).cast("int"))


def investment_budget(income="annual_income") -> dict[str, Column]:
    return {f"{n}_monthly": F.round(col(income) * r / 12.0, 2) for n, r in (("baseline", 0.10), ("ambitious", 0.20), ("aggressive", 0.30))}


def floored_risk(goal, risk) -> Column:
    """Risk percentage lifted to the goal's floor, in [0, 100]."""
    return clamp(F.greatest(lookup(col(goal), fixed.RISK_FLOORS, fixed.RISK_FLOORS["income"]), col(risk).cast("int")), 0, 100)


def validated_inputs(users: DataFrame) -> DataFrame:
    zero = lambda c: F.greatest(F.lit(0.0), C(c))
    return users.select("user_id", zero("annual_income").alias("income"), zero("net_worth").alias("net_worth"),
                        F.greatest(F.lit(0), "horizon_years").alias("horizon_years"),
                        floored_risk("goal", "risk_pct").alias("risk_pct"), "goal")


def constraint_bounds(attitude: Column, drawdown: Column, years: Column, income: Column) -> dict[str, Column]:
    """Core minimum, satellite maximum and single cap from four answers."""
    shift = lambda low, high, size: F.when(low, size).when(high, -size).otherwise(0.0)
    a_low, a_high = attitude.isin("very_low", "low"), attitude.isin("high", "very_high")
    move = (shift(a_low, a_high, 0.10) + shift(drawdown == "low", drawdown == "high", 0.05) + shift(years < 5, years > 15, 0.05)
            + F.when(income == "low", 0.05).otherwise(0.0))
    return {"core_min": clamp(F.lit(0.65) + move, 0.40, 0.90), "satellite_max": clamp(F.lit(0.35) - move, 0.10, 0.60),
            "single_max": clamp(F.lit(0.07) - shift(a_low, a_high, 0.02), 0.03, 0.12)}


def target_volatility(goal, risk_pct) -> Column:
    """Slider position on the goal's volatility range."""
    t = clamp(risk_pct, 0.0, 100.0) / 100.0
    out = lerp(0.12, 0.24, t)
    for name, (a, b) in fixed.GOAL_VOLATILITY.items():
        out = F.when(col(goal) == name, lerp(a, b, t)).otherwise(out)
    return out


def level_volatility(level) -> Column:
    return lookup(col(level), fixed.LEVEL_VOLATILITY, fixed.LEVEL_VOLATILITY["moderate"])


# ---- objectives -------------------------------------------------------------------------------

def _objective_list(objectives: DataFrame) -> Column:
    """The objectives (a handful of configuration rows) as one sorted array literal."""
    cols = ["position", *[c for c in objectives.columns if c != "position"]]
    return objectives.agg(F.sort_array(F.collect_list(F.struct(*cols)))).scalar()


def recommend_objectives(users: DataFrame, objectives: DataFrame) -> DataFrame:
    """Objectives whose risk range holds the user's score, nearest optimum first; else the closest."""
    r = C("true_risk")
    near = lambda o: F.abs(r - o["risk_optimal"])
    edge = lambda o: F.least(F.abs(r - o["risk_min"]), F.abs(r - o["risk_max"]), near(o))
    u = users.withColumn("_o", _objective_list(objectives))
    fits = F.filter("_o", lambda o: (o["risk_min"] <= r) & (r <= o["risk_max"]))
    by = lambda dist: lambda o: F.struct(dist(o).alias("distance"), o["position"].alias("position"), o["name"].alias("objective"))
    ranked = F.when(F.size(fits) > 0, F.array_sort(F.transform(fits, by(near)))).otherwise(
        F.slice(F.array_sort(F.transform("_o", by(edge))), 1, 1))
    return u.select("user_id", F.posexplode(ranked).alias("rank", "_x")).select(
        "user_id", (C("rank") + 1).alias("rank"), "_x.objective", "_x.distance")


def adjusted_bands(users: DataFrame, objectives: DataFrame) -> DataFrame:
    """Return and volatility band of the user's objective, scaled when the risk is off its optimum."""
    j = users.join(objectives, C("objective") == C("name"))
    d = C("true_risk") - C("risk_optimal")
    (rb, vb), (ra, va) = fixed.RISK_ADJUSTMENT["below"], fixed.RISK_ADJUSTMENT["above"]
    mult = lambda below, above: F.when(F.abs(d) <= fixed.RISK_ADJUSTMENT["zone"], 1.0).when(d < 0, below).otherwise(above)
    floor = lambda c: F.greatest(F.lit(0.01), c)
    r, v = mult(rb, ra), mult(vb, va)
    return j.select("user_id", "objective", floor(C("ret_min") * r).alias("ret_min"), (C("ret_max") * r).alias("ret_max"),
                    floor(C("vol_min_target") * v).alias("vol_min"), (C("vol_max_target") * v).alias("vol_max"))


def _whole(c: Column) -> Column:
    return F.bround(c, 0).cast("int").cast("string")


def objective_fit(users: DataFrame, objectives: DataFrame) -> DataFrame:
    """Does the requested objective match the user's risk, why, and what else is suggested."""
    best = recommend_objectives(users, objectives).groupBy("user_id").agg(
        F.min_by("objective", "rank").alias("_first"), F.collect_set("objective").alias("_all"))
    j = users.select("user_id", "objective", "true_risk").join(best, "user_id").join(objectives, C("objective") == C("name"), "left")
    r, known = C("true_risk"), C("name").isNotNull()
    inside = F.array_contains("_all", C("objective"))
    low, high = r < C("risk_min"), r > C("risk_max")
    span = F.concat(F.lit(" the recommended range ("), _whole(C("risk_min")), F.lit("-"), _whole(C("risk_max")), F.lit(") for "), C("label"))
    text = (F.when(~known, F.concat(F.lit("Unknown objective: "), C("objective")))
            .when(inside & (F.abs(r - C("risk_optimal")) <= 15), F.concat(F.lit("Risk profile aligns well with "), C("label"), F.lit(" objective")))
            .when(inside, F.concat(F.lit("Risk profile is compatible with "), C("label"), F.lit(" objective")))
            .when(low, F.concat(F.lit("Your risk score ("), _whole(r), F.lit(") is below"), span))
            .when(high, F.concat(F.lit("Your risk score ("), _whole(r), F.lit(") is above"), span))
            .otherwise(F.concat(F.lit("Risk profile fits "), C("label"), F.lit(" objective"))))
    off = ~known | (~inside & (low | high))
    return j.select("user_id", "objective", F.when(off, "mismatch").otherwise("match").alias("fit"), text.alias("explanation"),
                    F.when(off & known, C("_first")).alias("suggested"))


def stretch_objective(objective="objective") -> Column:
    p = fixed.PROGRESSION
    return lookup(col(objective), dict(zip(p, p[1:])))


# ---- credibility ------------------------------------------------------------------------------

def credibility(years, robustness, assets, passed) -> Column:
    part = lambda c, full: F.least(F.greatest(F.lit(0.0), col(c).cast("double")) / full, F.lit(1.0)) * 100.0
    score = (part(years, 20.0) * 0.30 + clamp(robustness, 0.0, 100.0) * 0.30 + part(assets, 20.0) * 0.20
             + F.when(col(passed), 100.0).otherwise(50.0) * 0.20)
    return clamp(score, 0.0, 100.0)


def credibility_parts(n_obs, coverage, effective_n, sharpe_in, sharpe_out) -> dict[str, Column]:
    """Weighted 0-100 score with its five parts; without an out-of-sample Sharpe that part is 0.7."""
    unit = lambda c: clamp(c, 0.0, 1.0)
    s = col(sharpe_in)
    size = F.least(F.lit(1.0), col(n_obs) / 2500.0)
    cov, div_ = unit(coverage), unit((col(effective_n) - 1) / 9.0)
    shp = unit(F.lit(0.2) + s * 0.3 + F.greatest(F.lit(0.0), s - 1) * 0.5)
    out = F.coalesce(F.when(col(sharpe_out).isNotNull(), F.greatest(F.lit(0.0), F.lit(1.0) - F.greatest(F.lit(0.0), s - col(sharpe_out)))), F.lit(0.7))
    parts = {"sample_size": size, "coverage_part": cov, "diversification": div_, "in_sample_sharpe": shp, "oos_penalty": out}
    score = size * 0.25 + cov * 0.20 + div_ * 0.20 + shp * 0.20 + out * 0.15
    return {"score": rounded(score * 100, 1), **{n: rounded(c * 100, 1) for n, c in parts.items()}}


def credibility_simple(*receipts) -> Column:
    """Mean of the clamped values, 0.6 without any."""
    vals = F.array_compact(F.array(*[clamp(c, 0.0, 1.0) for c in receipts]))
    total = F.aggregate(vals, F.lit(0.0), lambda a, x: a + x)
    return F.coalesce(div(total, F.size(vals)), F.lit(0.6))


def outcome_band(mu, sigma, score) -> tuple[Column, Column]:
    half = col(sigma) * (F.lit(1.0) + (F.lit(100.0) - col(score)) / 100.0)
    return col(mu) - half, col(mu) + half


def quality_label(hard_fallback, fallback_level) -> Column:
    return (F.when(col(hard_fallback), "Emergency fallback portfolio")
            .when(col(fallback_level) == 2, "Relaxed filters portfolio (still in your risk band)")
            .when(col(fallback_level) > 2, "Relaxed filters portfolio (soft guardrails)").otherwise("Strict-quality portfolio"))


def provenance_hash(*columns: str) -> Column:
    """Stable digest of the named inputs, independent of their order in the table."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)
