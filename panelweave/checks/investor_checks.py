"""U family: scoring, bands, objectives."""
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.expr import mod
from ..operators import investors as inv
from ..sources.catalog import objective_tables
from .ctes import CTES
from .registry import check

C = F.col


def _case(column: str, table: dict, default) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in table.items()) + f" ELSE {default}::DOUBLE END"


CTES["t_answers"] = "SELECT user_id, " + ", ".join(f"{_case(q, t, 50)} AS {q}" for q, t in fixed.ANSWER_SCORES.items()) + " FROM t_users"
CTES["t_score"] = f"""SELECT u.user_id, {' + '.join(f'{w} * a.{q}' for q, w in fixed.ANSWER_WEIGHTS.items())} AS questionnaire_score,
  {_case('income_stability', fixed.STABILITY_POINTS, 15)}
  + CASE WHEN emergency_fund_months >= 6 THEN 25 WHEN emergency_fund_months >= 3 THEN 15 WHEN emergency_fund_months >= 1 THEN 8 ELSE 0 END
  + CASE WHEN monthly_expenses <= 0 THEN 10 WHEN investable_amount / (monthly_expenses * 12) >= 2 THEN 25 WHEN investable_amount / (monthly_expenses * 12) >= 1 THEN 20
      WHEN investable_amount / (monthly_expenses * 12) >= 0.5 THEN 12 WHEN investable_amount / (monthly_expenses * 12) >= 0.2 THEN 8 ELSE 3 END
  + CASE WHEN annual_income <= 0 THEN 10 WHEN outstanding_debt / annual_income < 0.1 THEN 25 WHEN outstanding_debt / annual_income < 0.5 THEN 20
      WHEN outstanding_debt / annual_income < 1.5 THEN 15 WHEN outstanding_debt / annual_income < 3 THEN 8 ELSE 0 END AS facts_score
FROM t_users u JOIN t_answers a ON u.user_id = a.user_id"""
CTES["t_risk"] = """SELECT *, CASE WHEN slider IS NULL THEN combined_score ELSE 0.7 * combined_score + 0.3 * slider_score END AS true_risk FROM (
  SELECT *, 0.5 * questionnaire_score + 0.5 * facts_score AS combined_score,
    coalesce(greatest(0, least(100, slider)) + if(slider IS NULL, NULL, 0), 0.5 * questionnaire_score + 0.5 * facts_score) AS slider_score
  FROM t_users JOIN (SELECT * FROM t_score) USING (user_id))"""


def _band(lo: float, mid: float, hi: float) -> str:
    return f"""CASE WHEN true_risk <= 20 THEN {lo} WHEN true_risk <= 50 THEN {lo} + (true_risk - 20) / 30 * ({mid} - {lo})
      WHEN true_risk <= 80 THEN {mid} + (true_risk - 50) / 30 * ({hi} - {mid}) ELSE {hi} END"""


CTES["t_prof"] = f"""SELECT *, greatest(0, vt - 0.02) AS vol_min, vt AS vol_target, vt + 0.02 AS vol_max,
  {_band(0.05, 0.08, 0.10)} AS cagr_min, {_band(0.06, 0.09, 0.11)} AS cagr_target,
  CASE WHEN true_risk < 20 THEN 'Very Conservative' WHEN true_risk < 40 THEN 'Conservative' WHEN true_risk < 60 THEN 'Moderate'
    WHEN true_risk < 80 THEN 'Growth-Oriented' ELSE 'Aggressive' END AS label, if(horizon_years > 0, horizon_years, 10) AS horizon
FROM (SELECT *, 0.1271 + (0.2202 - 0.1271) * true_risk / 100.0 AS vt FROM t_risk)"""


def profiles(v):
    return inv.risk_profiles(v.users)


def with_risk(v):
    return v.users.join(profiles(v).select("user_id", "true_risk"), "user_id")


check("u01_answer_scores", "user_id# " + " ".join(f"{q}~" for q in fixed.ANSWER_SCORES), lambda v: inv.score_answers(v.users), "SELECT * FROM t_answers")
check("u02_questionnaire_score", "user_id# score~", lambda v: inv.score_answers(v.users).select("user_id", inv.questionnaire_score().alias("score")),
      "SELECT user_id, questionnaire_score AS score FROM t_score")
check("u03_facts_score", "user_id# score~", lambda v: v.users.select("user_id", inv.facts_score().alias("score")), "SELECT user_id, facts_score AS score FROM t_score")
check("u04_risk_profiles", "user_id# questionnaire_score~ facts_score~ combined_score~ slider_score~ true_risk~ vol_min~12 vol_target~12 vol_max~12 cagr_min~ cagr_target~ "
      "label horizon_years# objective", profiles, "SELECT * EXCLUDE (horizon_years), horizon AS horizon_years FROM t_prof")
check("u04_risk_field_defaults", "user_id# vol_min~12 vol_target~12 vol_max~12 true_risk~",
      lambda v: inv.resolve_risk_fields(profiles(v).select("user_id", "vol_min", F.when(C("true_risk") > 50, C("true_risk")).alias("true_risk"))),
      "SELECT user_id, vol_min, 0.12 AS vol_target, 0.30 AS vol_max, if(true_risk > 50, true_risk, 50.0) AS true_risk FROM t_prof")
check("u05_risk_label", "label users#", lambda v: profiles(v).groupBy(inv.risk_label("true_risk").alias("label")).agg(F.count("*").alias("users")),
      "SELECT label, count(*) AS users FROM t_prof GROUP BY 1")
check("u06_growth_band", "user_id# lo~ hi~", lambda v: with_risk(v).select("user_id", *[c.alias(n) for c, n in zip(inv.growth_band("true_risk"), ("lo", "hi"))]),
      "SELECT user_id, cagr_min AS lo, cagr_target AS hi FROM t_prof")
check("u07_volatility_band", "user_id# lo~12 mid~12 hi~12", lambda v: with_risk(v).select("user_id", *[c.alias(n) for c, n in zip(inv.volatility_band("true_risk"), ("lo", "mid", "hi"))]),
      "SELECT user_id, vol_min AS lo, vol_target AS mid, vol_max AS hi FROM t_prof")
check("u08_horizon_default", "user_id# years#", lambda v: v.users.select("user_id", inv.horizon().alias("years")),
      "SELECT user_id, if(horizon_years > 0, horizon_years, 10) AS years FROM t_users")

CTES["t_plan"] = """SELECT user_id, plan, l * kl AS lump, m * km AS monthly FROM (SELECT user_id, true_risk,
    greatest(0, annual_income * 1.000123457::DOUBLE) * (0.02 + true_risk / 100 * 0.06) * k / 12 AS m,
    greatest(0, net_worth * 1.000123457::DOUBLE) * (0.01 + true_risk / 100 * 0.04) * least(1.5, 0.5 + if(horizon_years = 0, 10, horizon_years) / 20.0) * k AS l
  FROM (SELECT *, CASE goal WHEN 'income' THEN 0.8 ELSE 1.0 END AS k FROM t_prof))
  JOIN (VALUES ('Baseline', 0.7, 0.8), ('Ambitious', 1.0, 1.0), ('Aggressive', 1.4, 1.3)) p(plan, kl, km) ON plan <> 'Aggressive' OR true_risk >= 40"""
check("u09_contribution_plans", "user_id# plan lump~2 monthly~2", lambda v: inv.contribution_plans(with_risk(v).withColumns(
      {c: C(c) * 1.000123457 for c in ("annual_income", "net_worth")})), "SELECT * FROM t_plan")
check("u10_investor_tier", "user_id# tier allowed baseline_monthly~ ambitious_monthly~ aggressive_monthly~",
      lambda v: v.users.withColumn("tier", inv.investor_tier()).withColumns({"allowed": F.array_join(inv.allowed_tiers("tier"), ","), **inv.investment_budget()}),
      """SELECT user_id, tier, array_to_string(['retail','accredited','qualified_client','qualified_purchaser','institutional'][:list_position(
        ['retail','accredited','qualified_client','qualified_purchaser','institutional'], tier)], ',') AS allowed,
        round(annual_income * 0.1 / 12, 2) AS baseline_monthly, round(annual_income * 0.2 / 12, 2) AS ambitious_monthly, round(annual_income * 0.3 / 12, 2) AS aggressive_monthly
      FROM (SELECT *, CASE WHEN net_worth >= 25000000 THEN 'institutional' WHEN net_worth >= 5000000 THEN 'qualified_purchaser' WHEN net_worth >= 2200000 THEN 'qualified_client'
        WHEN net_worth >= 1000000 OR annual_income >= 200000 THEN 'accredited' ELSE 'retail' END AS tier FROM t_users)""")
check("u10_validated_inputs", "user_id# income~ net_worth~ horizon_years# risk_pct# goal",
      lambda v: inv.validated_inputs(v.users.withColumns({"risk_pct": (mod(C("user_id"), 130) - 10).cast("int"), "horizon_years": C("horizon_years") - 5})),
      """SELECT user_id, greatest(0, annual_income) AS income, greatest(0, net_worth) AS net_worth, greatest(0, horizon_years - 5) AS horizon_years,
      least(100, greatest(CASE goal WHEN 'preserve' THEN 5 WHEN 'tax_efficiency' THEN 20 WHEN 'grow_income' THEN 35 WHEN 'grow' THEN 45 ELSE 15 END, user_id % 130 - 10)) AS risk_pct, goal FROM t_users""")


def attitudes(v):
    k = C("user_id")
    pick = lambda opts, n: F.get(F.array(*map(F.lit, opts)), mod(k, n).cast("int"))
    return v.users.withColumns(inv.constraint_bounds(
        pick(["very_low", "low", "moderate", "high", "very_high"], 5), pick(["low", "medium", "high"], 3), C("horizon_years"), pick(["low", "medium", "high", "medium"], 4)))


check("u11_constraint_bounds", "user_id# core_min~ satellite_max~ single_max~", attitudes,
      """SELECT user_id, least(0.9, greatest(0.4, 0.65 + m)) AS core_min, least(0.6, greatest(0.1, 0.35 - m)) AS satellite_max, least(0.12, greatest(0.03, 0.07 - s)) AS single_max FROM (
      SELECT user_id, [0.1, 0.1, 0, -0.1, -0.1][1 + user_id % 5] + [0.05, 0, -0.05][1 + user_id % 3] + CASE WHEN horizon_years < 5 THEN 0.05 WHEN horizon_years > 15 THEN -0.05 ELSE 0 END
        + CASE WHEN user_id % 4 = 0 THEN 0.05 ELSE 0 END AS m, [0.02, 0.02, 0, -0.02, -0.02][1 + user_id % 5] AS s FROM t_users)""")
check("u12_target_volatility", "user_id# by_goal~ by_level~", lambda v: with_risk(v).select(
      "user_id", inv.target_volatility("goal", "slider").alias("by_goal"), inv.level_volatility(F.lower("goal")).alias("by_level")),
      """SELECT user_id, lo + (hi - lo) * s / 100 AS by_goal, CASE goal WHEN 'income' THEN 0.12 WHEN 'preserve' THEN 0.07 ELSE 0.16 END AS by_level FROM (
      SELECT *, if(slider IS NULL, NULL, greatest(0, least(100, slider))) AS s FROM t_users) JOIN (VALUES ('grow', 0.14, 0.28), ('grow_income', 0.10, 0.22), ('income', 0.06, 0.16),
        ('preserve', 0.04, 0.10), ('tax_efficiency', 0.10, 0.24), ('other', 0.12, 0.24)) g(g, lo, hi) ON g = goal""")

CTES["t_obj"] = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{n}', '{o['label']}', {o['risk_score_min']}, {o['risk_score_max']}, {o['risk_score_optimal']}, {o['target_return']['min']}, {o['target_return']['max']}, "
    f"{o['target_volatility']['min']}, {o['target_volatility']['max']}, {o['min_holdings']}, {str(o['prefer_core_assets']).lower()})"
    for i, (n, o) in enumerate(fixed.OBJECTIVES.items())) + ") o(pos, name, label, r0, r1, ropt, ret0, ret1, v0, v1, min_holdings, prefer_core)"
CTES["t_bands"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{n}', {j}, '{c}', {b['min']}::DOUBLE, {b['max']}::DOUBLE)" for n, o in fixed.OBJECTIVES.items() for j, (c, b) in enumerate(o["asset_class_bands"].items())
) + ") b(name, ord, asset_class, band_min, band_max)"
CTES["t_orec"] = """SELECT user_id, name AS objective, CASE WHEN any_in THEN abs(true_risk - ropt) ELSE edge END AS distance,
    row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN any_in THEN abs(true_risk - ropt) ELSE edge END, pos) AS rank FROM (
  SELECT *, bool_or(true_risk BETWEEN r0 AND r1) OVER (PARTITION BY user_id) AS any_in,
    least(abs(true_risk - r0), abs(true_risk - r1), abs(true_risk - ropt)) AS edge FROM t_prof, t_obj)
  WHERE true_risk BETWEEN r0 AND r1 OR NOT any_in QUALIFY any_in OR rank = 1"""


def objectives(v):
    return objective_tables(v.spark, fixed.OBJECTIVES)


check("u13_recommended_objectives", "user_id# rank# objective distance~", lambda v: inv.recommend_objectives(profiles(v), objectives(v)[0]), "SELECT * FROM t_orec")
CTES["t_adj"] = """SELECT user_id, objective, greatest(0.01, ret0 * r) AS ret_min, ret1 * r AS ret_max, greatest(0.01, v0 * v) AS vol_min, v1 * v AS vol_max FROM (
  SELECT p.user_id, p.objective, ret0, ret1, v0, v1, CASE WHEN abs(true_risk - ropt) <= 15 THEN 1.0 WHEN true_risk < ropt THEN 0.85 ELSE 1.15 END AS r,
    CASE WHEN abs(true_risk - ropt) <= 15 THEN 1.0 WHEN true_risk < ropt THEN 0.8 ELSE 1.2 END AS v FROM t_prof p JOIN t_obj ON objective = name)"""
check("u14_adjusted_bands", "user_id# objective ret_min~ ret_max~ vol_min~ vol_max~", lambda v: inv.adjusted_bands(profiles(v), objectives(v)[0]), "SELECT * FROM t_adj")
CTES["t_fit"] = """SELECT user_id, objective, CASE WHEN o IS NULL OR (NOT inside AND (true_risk < r0 OR true_risk > r1)) THEN 'mismatch' ELSE 'match' END AS fit,
  CASE WHEN o IS NULL THEN 'Unknown objective: ' || objective WHEN inside AND abs(true_risk - ropt) <= 15 THEN 'Risk profile aligns well with ' || label || ' objective'
    WHEN inside THEN 'Risk profile is compatible with ' || label || ' objective'
    WHEN true_risk < r0 THEN printf('Your risk score (%.0f) is below the recommended range (%d-%d) for %s', true_risk, r0, r1, label)
    WHEN true_risk > r1 THEN printf('Your risk score (%.0f) is above the recommended range (%d-%d) for %s', true_risk, r0, r1, label)
    ELSE 'Risk profile fits ' || label || ' objective' END AS explanation,
  CASE WHEN o IS NOT NULL AND NOT inside AND (true_risk < r0 OR true_risk > r1) THEN top END AS suggested FROM (
  SELECT p.user_id, p.objective, true_risk, b.name AS o, b.label, r0, r1, ropt, top, list_contains(recs, p.objective) AS inside FROM t_prof p LEFT JOIN t_obj b ON p.objective = b.name
    JOIN (SELECT user_id, arg_min(objective, rank) AS top, list(objective) AS recs FROM t_orec GROUP BY 1) r ON r.user_id = p.user_id)"""
check("u15_objective_fit", "user_id# objective fit explanation suggested", lambda v: inv.objective_fit(profiles(v), objectives(v)[0]), "SELECT * FROM t_fit")
check("u16_stretch_objective", "user_id# stretch", lambda v: v.users.select("user_id", inv.stretch_objective().alias("stretch")),
      """SELECT user_id, CASE objective WHEN 'CONSERVATIVE' THEN 'BALANCED' WHEN 'BALANCED' THEN 'GROWTH_PLUS_INCOME' WHEN 'GROWTH_PLUS_INCOME' THEN 'GROWTH'
      WHEN 'GROWTH' THEN 'AGGRESSIVE' END AS stretch FROM t_users""")
check("u17_credibility", "user_id# full~ simple~", lambda v: v.users.select(
      "user_id", inv.credibility("horizon_years", F.coalesce("slider", F.lit(60.0)), "nation_key", mod(C("user_id"), 2) == 0).alias("full"),
      inv.credibility_simple(C("slider") / 100, C("horizon_years") / 15, F.when(C("user_id") % 5 == 0, C("emergency_fund_months"))).alias("simple")),
      """SELECT user_id, 0.3 * least(horizon_years / 20.0, 1) * 100 + 0.3 * greatest(0, least(100, coalesce(slider, 60))) + 0.2 * least(nation_key / 20.0, 1) * 100
        + 0.2 * if(user_id % 2 = 0, 100, 50) AS full,
        list_avg(list_transform(list_filter([slider / 100, horizon_years / 15.0::DOUBLE, CASE WHEN user_id % 5 = 0 THEN emergency_fund_months END], lambda x: x IS NOT NULL),
          lambda x: greatest(0.0, least(1.0, x)))) AS simple FROM t_users""")
check("u17_credibility_parts", "user_id# score~ sample_size~ coverage_part~ diversification~ in_sample_sharpe~ oos_penalty~",
      lambda v: v.users.select("user_id", *[c.alias(n) for n, c in inv.credibility_parts(
          C("user_id") * 3, C("nation_key") / 20, C("horizon_years") / 2, C("emergency_fund_months") / 4, C("slider") / 50).items()]),
      """SELECT user_id, round(100 * (0.25 * a + 0.2 * b + 0.2 * c + 0.2 * d + 0.15 * e), 1) AS score, round(100 * a, 1) AS sample_size, round(100 * b, 1) AS coverage_part,
        round(100 * c, 1) AS diversification, round(100 * d, 1) AS in_sample_sharpe, round(100 * e, 1) AS oos_penalty FROM (
        SELECT user_id, least(1.0, user_id * 3 / 2500.0) AS a, least(1, nation_key / 20.0) AS b, greatest(0, least(1, (horizon_years / 2.0 - 1) / 9)) AS c,
          greatest(0, least(1, 0.2 + 0.3 * s + 0.5 * greatest(0, s - 1))) AS d, CASE WHEN slider IS NULL THEN 0.7 ELSE greatest(0, 1 - greatest(0, s - slider / 50)) END AS e
        FROM (SELECT *, emergency_fund_months / 4 AS s FROM t_users))""")
check("u18_outcome_band", "user_id# low~13 high~13", lambda v: profiles(v).select("user_id", *[c.alias(n) for c, n in zip(
      inv.outcome_band("cagr_target", "vol_target", "facts_score"), ("low", "high"))]),
      "SELECT user_id, cagr_target - vol_target * (1 + (100 - facts_score) / 100) AS low, cagr_target + vol_target * (1 + (100 - facts_score) / 100) AS high FROM t_prof")
check("u19_quality_label", "user_id# label", lambda v: v.users.select("user_id", inv.quality_label(mod(C("user_id"), 7) == 0, mod(C("user_id"), 5)).alias("label")),
      """SELECT user_id, CASE WHEN user_id % 7 = 0 THEN 'Emergency fallback portfolio' WHEN user_id % 5 = 2 THEN 'Relaxed filters portfolio (still in your risk band)'
      WHEN user_id % 5 > 2 THEN 'Relaxed filters portfolio (soft guardrails)' ELSE 'Strict-quality portfolio' END AS label FROM t_users""")
check("u20_provenance_hash", "user_id# digest", lambda v: v.users.select("user_id", inv.provenance_hash("user_id", "objective", "goal", "horizon_years").alias("digest")),
      """SELECT user_id, sha256('{"goal":"' || goal || '","horizon_years":' || horizon_years || ',"objective":"' || objective || '","user_id":' || user_id || '}') AS digest FROM t_users""")
