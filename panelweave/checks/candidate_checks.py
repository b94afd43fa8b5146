"""P family: candidates, constraints, ranking and the composed runs."""
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.expr import mod
from ..operators import blend, candidates as cand, gates, macro, matrix, stats
from ..plans import recommend
from ..session import shared_folder, stored
from ..sources.catalog import objective_tables
from .ctes import CTES
from .investor_checks import profiles
from .registry import check
from .sequence_checks import SCENARIOS, daily, regime_labels, tilt_classes
from .stats_checks import annual_sql, draw_sql, facts_sql, port, portc, scatter_sql

C = F.col
W3 = "portfolio_id ticker weight~"
GRID = ["max_sharpe", "min_var", "risk_parity", "equal_weight"]
SATS = [20, 25, 30, 35]

check("p01_variant_grid", "user_id# optimizer sat_cap~ shock name", lambda v: cand.variant_grid(v.users.select("user_id"), shocks=("none", "equity-10%")),
      f"""SELECT user_id, o AS optimizer, s / 100.0 AS sat_cap, k AS shock, upper(o) || ' - Sat ' || s || '%' AS name FROM t_users, (SELECT unnest({GRID}) AS o), (SELECT unnest({SATS}) AS s),
      (SELECT unnest(['none', 'equity-10%']) AS k)""")
check("p02_equal_weight", W3, lambda v: cand.equal_weight(v.weights), "SELECT portfolio_id, ticker, 1.0::DOUBLE / count(*) OVER (PARTITION BY portfolio_id) AS weight FROM t_weights")
CTES["t_iv"] = """SELECT portfolio_id, ticker, (1 / v) / sum(1 / v) OVER (PARTITION BY portfolio_id) AS weight, count(*) OVER (PARTITION BY portfolio_id) AS n
  FROM t_weights JOIN (SELECT ticker, stddev_samp(ret) * sqrt(252) AS v FROM t_ret GROUP BY 1) USING (ticker)"""
check("p03_inverse_volatility", W3, lambda v: cand.inverse_volatility(v.weights, stats.annual_volatility(v.returns)), "SELECT * FROM t_iv")
check("p04_diversified", W3, lambda v: cand.diversified(v.weights, stats.annual_volatility(v.returns)), "SELECT portfolio_id, ticker, 0.5 * weight + 0.5 / n AS weight FROM t_iv")

CTES["t_smp"] = f"""SELECT sample, ticker, x, row_number() OVER (PARTITION BY sample ORDER BY x DESC, ticker) AS r, sum(x) OVER (PARTITION BY sample ORDER BY x DESC, ticker ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM (SELECT sample, ticker, y * y AS x FROM (
  SELECT s.sample::BIGINT AS sample, ticker, (({scatter_sql('s.sample::BIGINT', 'o.ord')}) % 1000 + 1) / 1000.0::DOUBLE AS y
  FROM range(256) s(sample), (SELECT ticker, row_number() OVER (ORDER BY ticker) AS ord FROM (SELECT DISTINCT ticker FROM t_booksc)) o))"""
CTES["t_smpw"] = """SELECT sample, ticker, CASE WHEN r <= k THEN 0.30::DOUBLE ELSE x * (1 - 0.30::DOUBLE * k) / sum(CASE WHEN r > k THEN x END) OVER (PARTITION BY sample) END AS weight
  FROM (SELECT *, count(*) FILTER (x * (1 - 0.30::DOUBLE * (r - 1)) > 0.30::DOUBLE * rest) OVER (PARTITION BY sample) AS k FROM t_smp)"""
CTES["t_smps"] = """SELECT *, (ret - 0.015) / vol AS sharpe FROM (SELECT a.sample, sqrt(sum(a.weight * b.weight * value)) AS vol, any_value(r.ret) AS ret FROM t_smpw a JOIN t_smpw b ON a.sample = b.sample
  JOIN t_shrunk ON i = a.ticker AND j = b.ticker JOIN (SELECT sample, sum(weight * m) AS ret FROM t_smpw JOIN (
    SELECT ticker, product(1 + ret) ** (252.0::DOUBLE / count(*)) - 1 AS m FROM t_retc GROUP BY 1) USING (ticker) GROUP BY 1) r ON r.sample = a.sample GROUP BY 1)"""
check("p05_searched_weights", "portfolio_id optimizer sample# ticker weight~ ret~ vol~ sharpe~", lambda v: cand.searched_weights(
      v.books_class_table, stored(matrix.shrunk_covariance(v.returns_class_table)), stats.geometric_return(v.returns_class_table), 256, target_vol=0.14),
      """SELECT portfolio_id, optimizer, s.sample, ticker, weight, ret, vol, sharpe FROM (
        SELECT 'min_var' AS optimizer, arg_min(sample, vol) AS sample FROM t_smps UNION ALL SELECT 'max_sharpe', arg_max(sample, sharpe) FROM t_smps
        UNION ALL SELECT 'efficient_risk', arg_max(sample, CASE WHEN vol <= 0.14 THEN ret ELSE -vol - 1000 END) FROM t_smps) s
      JOIN t_smpw USING (sample) JOIN t_smps USING (sample), (SELECT DISTINCT portfolio_id FROM t_booksc)""")

VARIANTS = ["A", "B", "C"]
CTES["t_sub0"] = f"""SELECT portfolio_id, ticker, v, ['A','B','C'][1 + v] AS variant, n, row_number() OVER (PARTITION BY portfolio_id, v ORDER BY {scatter_sql('v + 1', 'ord')}, ticker) AS r,
  [0.6, 0.7, 0.8, 0.9][1 + {draw_sql('v', '1000003', '4')}] AS p, [252, 504, 756, 1008][1 + {draw_sql('v', '2000003', '4')}] AS lookback
FROM (SELECT portfolio_id, ticker, ord, count(*) OVER (PARTITION BY portfolio_id) AS n FROM t_weights JOIN (
  SELECT ticker, row_number() OVER (ORDER BY ticker) AS ord FROM (SELECT DISTINCT ticker FROM t_weights)) USING (ticker)), (SELECT unnest([0, 1, 2])::BIGINT AS v)"""
check("p06_sampled_subsets", "portfolio_id variant ticker lookback#", lambda v: cand.sampled_subsets(v.weights, VARIANTS),
      "SELECT * FROM t_sub0 WHERE r <= CASE WHEN n < 8 THEN n ELSE greatest(5, floor(n * p)) END")


def goal_holdings(v):
    """Holdings of every customer with a goal by portfolio."""
    g = F.get(F.array(*[F.lit(x) for x in ("grow", "grow_income", "income", "preserve", "tax_efficiency", "other")]), mod(C("portfolio_id").cast("long"), 6).cast("int"))
    return v.weights.withColumn("goal", g)


LIM = "CASE portfolio_id::BIGINT % 6 WHEN 1 THEN {1} WHEN 2 THEN {2} WHEN 3 THEN {3} WHEN 4 THEN {4} ELSE {0} END"


def limit_sql(i: int) -> str:
    return LIM.format(*[v[i] for v in fixed.GOAL_LIMITS.values()])


CTES["t_bnd"] = f"""SELECT portfolio_id, ticker, greatest(0, CASE WHEN alt THEN {limit_sql(6)} / na WHEN cash THEN {limit_sql(4)} / nc WHEN bond THEN {limit_sql(2)} / nb WHEN eq THEN {limit_sql(0)} / ne ELSE 0 END)::DOUBLE AS lo,
  least(1, CASE WHEN alt THEN {limit_sql(7)} / na WHEN cash THEN {limit_sql(5)} WHEN bond THEN {limit_sql(3)} / nb WHEN eq THEN {limit_sql(1)} / ne ELSE 1 END)::DOUBLE AS hi FROM (
  SELECT *, greatest(1, count(*) FILTER (eq) OVER w) AS ne, greatest(1, count(*) FILTER (bond) OVER w) AS nb, greatest(1, count(*) FILTER (cash) OVER w) AS nc,
    greatest(1, count(*) FILTER (alt) OVER w) AS na FROM (SELECT portfolio_id, ticker, class LIKE 'public_equity%' AS eq, class IN ('treasury_long','corporate_bond','tbills') AS bond, class = 'tbills' AS cash,
      class IN ('gold','commodities','reit') AS alt FROM t_weights JOIN t_catalog ON ticker = symbol) WINDOW w AS (PARTITION BY portfolio_id))"""
check("p07_symbol_bounds", "portfolio_id ticker lo~ hi~", lambda v: cand.symbol_bounds(goal_holdings(v), v.catalog), "SELECT * FROM t_bnd")
check("p08_repaired_bounds", "portfolio_id ticker lo~ hi~", lambda v: cand.repair_bounds(cand.symbol_bounds(goal_holdings(v), v.catalog).select(
      "portfolio_id", "ticker", F.when(C("ticker").endswith("2"), C("hi") + 0.2).otherwise(C("lo")).alias("lo"), F.when(C("ticker").endswith("7"), None).otherwise(C("hi") * 0.5).alias("hi"))),
      """SELECT portfolio_id, ticker, CASE WHEN sl > 1 THEN lo / sl ELSE lo END AS lo, CASE WHEN sum(up) OVER (PARTITION BY portfolio_id) < 1 - 1e-12 THEN 1 ELSE up END AS hi FROM (
      SELECT *, CASE WHEN sh < 1 THEN least(1, hi + (1 - sh) / n) ELSE hi END AS up FROM (
        SELECT *, sum(lo) OVER w AS sl, sum(hi) OVER w AS sh, count(*) OVER w AS n FROM (SELECT portfolio_id, ticker, least(a, b) AS lo, greatest(a, b) AS hi FROM (
          SELECT portfolio_id, ticker, least(1, greatest(0, CASE WHEN ticker LIKE '%2' THEN hi + 0.2 ELSE lo END)) AS a,
            least(1, greatest(0, CASE WHEN ticker LIKE '%7' THEN 1 ELSE hi * 0.5 END)) AS b FROM t_bnd)) WINDOW w AS (PARTITION BY portfolio_id)))""")
check("p09_sanitised_weights", W3, lambda v: cand.sanitise_weights(v.weights.withColumn("weight", F.when(C("ticker").endswith("3"), None).when(
      C("ticker").endswith("4"), float("nan")).when(C("portfolio_id").endswith("5"), -C("weight")).otherwise(C("weight")))),
      """SELECT portfolio_id, ticker, coalesce(w / nullif(sum(w) OVER p, 0), 1.0 / count(*) OVER p) AS weight FROM (SELECT portfolio_id, ticker,
      CASE WHEN ticker LIKE '%3' OR ticker LIKE '%4' OR portfolio_id LIKE '%5' THEN 0 ELSE weight END AS w FROM t_weights) WINDOW p AS (PARTITION BY portfolio_id)""")


def tiered(v):
    """Customer weights with tiers; some customers hold no core at all."""
    t = F.when(C("portfolio_id").endswith("9") & (C("core_or_satellite") == "core"), "other").otherwise(C("core_or_satellite"))
    return v.weights.join(v.catalog.select(C("symbol").alias("ticker"), "core_or_satellite"), "ticker").withColumn("tier", t)


CTES["t_tier"] = "SELECT portfolio_id, ticker, weight, CASE WHEN portfolio_id LIKE '%9' AND core_or_satellite = 'core' THEN 'other' ELSE core_or_satellite END AS tier FROM t_weights JOIN t_catalog ON ticker = symbol"
_tw = "PARTITION BY portfolio_id"


CORE_SEEDS = ["NATION_1", "NATION_2", "NATION_3"]
CTES["t_bare"] = "SELECT portfolio_id FROM t_tier GROUP BY 1 HAVING count(*) FILTER (tier = 'core') = 0"
CTES["t_seeded"] = f"""SELECT portfolio_id, ticker, weight, CASE WHEN portfolio_id IN (SELECT portfolio_id FROM t_bare) AND ticker IN {tuple(CORE_SEEDS)} THEN 'core' ELSE tier END AS tier FROM t_tier
  UNION ALL SELECT portfolio_id, s, 0.0::DOUBLE, 'core' FROM t_bare, (SELECT unnest({CORE_SEEDS}) AS s) WHERE NOT EXISTS (FROM t_tier t WHERE t.portfolio_id = t_bare.portfolio_id AND t.ticker = s)"""


def core_sat_sql(src: str, core_min: str, sat_max: str, single: str) -> str:
    """Step by step, one nesting level per step."""
    sums = lambda inner: f"SELECT *, coalesce(sum(w) FILTER (tier = 'core') OVER p, 0) AS c, coalesce(sum(w) FILTER (tier = 'satellite') OVER p, 0) AS s, sum(w) OVER p AS t, count(*) FILTER (tier = 'core') OVER p AS nc FROM ({inner}) WINDOW p AS ({_tw})"
    keep = "SELECT * EXCLUDE (w, c, s, t, nc), {} AS w FROM ({})"
    x = f"SELECT *, weight / sum(weight) OVER ({_tw}) AS w FROM {src}"
    x = keep.format(f"CASE WHEN tier = 'satellite' AND s > {sat_max} THEN w * {sat_max} / s ELSE w END", sums(x))
    x = f"SELECT * EXCLUDE (w), CASE WHEN tier = 'satellite' THEN least(w, {single}) ELSE w END AS w FROM ({x})"
    x = keep.format(f"""CASE WHEN c < {core_min} AND tier = 'core' THEN CASE WHEN c > 0 THEN w * {core_min} / c ELSE {core_min} / nc END
      WHEN c < {core_min} AND tier = 'satellite' AND s > 0 THEN w * (1 - {core_min}) / s ELSE w END""", sums(x))
    x = keep.format("w / t", sums(x))
    x = f"SELECT *, sum(CASE WHEN tier = 'satellite' THEN greatest(0, w - {single}) ELSE 0 END) OVER ({_tw}) AS e FROM ({sums(x)})"
    return f"""SELECT portfolio_id, ticker, tier, w AS weight FROM (SELECT * EXCLUDE (w), CASE WHEN tier = 'satellite' THEN least(w, {single})
      WHEN tier = 'core' AND c > 0 THEN w * (1 + e / c) ELSE w END AS w FROM ({x})) WHERE abs(w) > 1e-6"""


check("p10_core_satellite_constraints", W3 + " tier", lambda v: cand.constrain_core_satellite(tiered(v), core_symbols=CORE_SEEDS), core_sat_sql("t_seeded", "0.65", "0.35", "0.07"))
check("p11_weight_violations", "portfolio_id violations", lambda v: cand.weight_violations(
      tiered(v).withColumn("weight", F.when(C("portfolio_id").endswith("1"), C("weight") * 1.1).otherwise(C("weight"))), 0.55, 0.45, 0.12)
      .withColumn("violations", F.array_join("violations", "; ")),
      """SELECT portfolio_id, concat_ws('; ', CASE WHEN abs(t - 1) > 1e-6 THEN printf('Weights sum to %.6f, expected 1.0', t) END,
        CASE WHEN c < 0.55 - 1e-6 THEN printf('Core allocation %.1f%% below 55.0%% minimum', c * 100) END,
        CASE WHEN s > 0.45 + 1e-6 THEN printf('Satellite allocation %.1f%% above 45.0%% maximum', s * 100) END, big) AS violations FROM (
        SELECT portfolio_id, sum(w) AS t, coalesce(sum(w) FILTER (tier = 'core'), 0) AS c, coalesce(sum(w) FILTER (tier = 'satellite'), 0) AS s,
          string_agg(printf('Satellite position %s (%.1f%%) exceeds 12.0%% cap', ticker, w * 100), '; ' ORDER BY ticker) FILTER (tier = 'satellite' AND w > 0.12 + 1e-6) AS big
        FROM (SELECT *, weight * CASE WHEN portfolio_id LIKE '%1' THEN 1.1 ELSE 1 END AS w FROM t_tier) GROUP BY 1)""")

CAPS = {"equity": 0.22, "bond": 0.25, "commodity": 0.20, "cash": 0.21}
CTES["t_cw"] = "SELECT portfolio_id, ticker, weight, asset_class FROM t_weights JOIN t_catalog ON ticker = symbol"
CTES["t_cap0"] = f"""SELECT portfolio_id, asset_class, sum(weight) AS old, sum(weight) AS t, CASE asset_class {' '.join(f"WHEN '{k}' THEN {x}::DOUBLE" for k, x in CAPS.items())} END AS cap FROM t_cw GROUP BY 1, 2"""
for _i in range(10):
    CTES[f"t_cap{_i + 1}"] = f"""SELECT portfolio_id, asset_class, old, CASE WHEN over_ THEN cap - 1e-4 ELSE t + CASE WHEN space > 1e-9 THEN freed * room / space ELSE 0 END END AS t, cap FROM (
      SELECT *, sum(CASE WHEN over_ THEN t - (cap - 1e-4) ELSE 0 END) OVER ({_tw}) AS freed, sum(room) OVER ({_tw}) AS space FROM (
        SELECT *, coalesce(t > cap + 1e-9, false) AS over_, CASE WHEN cap IS NULL OR t > cap + 1e-9 THEN 0 ELSE greatest(0, cap - t) END AS room FROM t_cap{_i}))"""
check("p12_class_cap_redistribution", W3 + " asset_class", lambda v: cand.redistribute_class_caps(
      v.weights.join(v.catalog.select(C("symbol").alias("ticker"), "asset_class"), "ticker"), CAPS),
      f"""SELECT w.portfolio_id, w.ticker, w.asset_class, weight / old * f / total AS weight FROM t_cw w JOIN (
        SELECT *, sum(f) OVER ({_tw}) AS total FROM (SELECT *, t + CASE WHEN h > 1e-9 AND 1 - s > 1e-6 THEN (1 - s) * coalesce(greatest(0, cap - t), 0) / h ELSE 0 END AS f FROM (
          SELECT *, sum(t) OVER ({_tw}) AS s, sum(coalesce(greatest(0, cap - t), 0)) OVER ({_tw}) AS h FROM t_cap10))) n ON n.portfolio_id = w.portfolio_id AND n.asset_class = w.asset_class""")


def objective_of(c):
    return F.get(F.array(*[F.lit(x) for x in fixed.PROGRESSION]), mod(c.cast("long"), 5).cast("int"))


check("p13_class_band_check", "portfolio_id objective passed? fail_reason", lambda v: cand.class_band_check(
      v.weights.join(v.catalog.select(C("symbol").alias("ticker"), "asset_class"), "ticker").withColumn("objective", objective_of(C("portfolio_id"))),
      objective_tables(v.spark, fixed.OBJECTIVES)[1]),
      """SELECT portfolio_id, objective, why IS NULL AS passed, why AS fail_reason FROM (SELECT portfolio_id, objective, arg_min(why, ord) FILTER (why IS NOT NULL) AS why FROM (
        SELECT p.portfolio_id, objective, ord, CASE WHEN coalesce(w, 0) < band_min - 0.01 THEN printf('%s weight %.1f%% < min %.1f%%', b.asset_class, coalesce(w, 0) * 100, band_min * 100)
          WHEN coalesce(w, 0) > band_max + 0.01 THEN printf('%s weight %.1f%% > max %.1f%%', b.asset_class, w * 100, band_max * 100) END AS why
        FROM (SELECT DISTINCT portfolio_id, ['CONSERVATIVE','BALANCED','GROWTH_PLUS_INCOME','GROWTH','AGGRESSIVE'][1 + portfolio_id::BIGINT % 5] AS objective FROM t_weights) p
        JOIN t_bands b ON b.name = objective LEFT JOIN (SELECT portfolio_id, asset_class, sum(weight) AS w FROM t_cw GROUP BY 1, 2) s ON s.portfolio_id = p.portfolio_id AND s.asset_class = b.asset_class) GROUP BY 1, 2)""")

# ---- users x candidates -----------------------------------------------------------------------
CFG = {"min_portfolio_sharpe": 0.232, "vol_soft_lower_factor": 0.88, "min_portfolio_cagr": 0.0499, "max_portfolio_drawdown": -0.09,
       "max_risk_contribution": 0.33, "min_diversification_ratio": 2.2}
T5 = "min_cagr~13 min_sharpe~13 max_dd_limit~13 vol_lower~15 vol_upper~13"
CTES["t_adapt"] = """SELECT *, greatest(0.045, cagr_min * (0.82 + 0.10 * ce)) AS min_cagr, greatest(0.15, least(0.5, greatest(0.15, 0.232 + (x - 0.5) * 0.2)) * (0.88 + 0.07 * ce)) AS min_sharpe,
  greatest(-0.9, least(-0.2, least(-0.25, greatest(-0.8, -0.09 - (x - 0.5) * 0.4)) - (0.03 + 0.04 * ce))) AS max_dd_limit,
  greatest(0.02, vol_min * 0.88 * (0.65 + 0.15 * ce)) AS vol_lower, vol_max AS vol_upper FROM (SELECT *, greatest(0, 1 - abs(x - 0.5) * 2) AS ce FROM (SELECT *, true_risk / 100 AS x FROM t_prof))"""
check("p14_adaptive_thresholds", "user_id# " + T5, lambda v: cand.adaptive_thresholds(profiles(v), CFG), "SELECT * FROM t_adapt")

CTES["t_cnd"] = """SELECT split_part(p.portfolio_id, '|', 1)::BIGINT AS nk, split_part(p.portfolio_id, '|', 2) AS name, p.*, rc / volatility AS max_rc FROM t_pm p LEFT JOIN (
  SELECT portfolio_id, max(risk_contribution) AS rc FROM t_rc GROUP BY 1) r ON r.portfolio_id = p.portfolio_id"""
CTES["t_uc"] = "SELECT user_id, nation_key, true_risk, vol_min, vol_max, cagr_min, c.* FROM t_prof JOIN t_cnd c ON nation_key = nk"


def why_sql(t: dict[str, str]) -> str:
    return f"""CASE WHEN NOT valid THEN 'invalid portfolio metrics: ' || coalesce(reason, 'unknown') WHEN sharpe < {t['s']} THEN printf('low Sharpe: %.2f < %.2f', sharpe, {t['s']})
      WHEN volatility > vol_max THEN printf('volatility too high: %.2f%% > %.2f%%', volatility * 100, vol_max * 100)
      WHEN volatility < {t['v']} THEN printf('volatility too low: %.2f%% < %.2f%% (soft_lower)', volatility * 100, {t['v']} * 100)
      WHEN max_drawdown < {t['d']} THEN printf('excessive drawdown: %.1f%% < %.1f%%', max_drawdown * 100, {t['d']} * 100)
      WHEN cagr < {t['c']} THEN printf('low CAGR: %.2f%% < %.2f%%', cagr * 100, {t['c']} * 100)
      WHEN max_rc > 0.33 THEN printf('risk concentration: max asset RC %.1f%% > 33.0%% threshold', max_rc * 100)
      WHEN diversification_ratio < 2.2 THEN printf('low diversification: %.2f < 2.20', diversification_ratio) WHEN num_holdings < 3 THEN 'too few holdings: ' || num_holdings || ' < 3' END"""


STRICT = {"s": "0.232::DOUBLE", "v": "(vol_min * 0.88)", "d": "(-0.09)::DOUBLE", "c": "0.0499::DOUBLE"}
CTES["t_st"] = f"""SELECT *, why IS NULL AS passed, why AS fail_reason, sharpe - 0.2 * abs(max_drawdown) - CASE WHEN soft THEN 0.5 * (vol_min - volatility) ELSE 0 END AS composite_score FROM (
  SELECT *, {why_sql(STRICT)} AS why, coalesce(valid AND volatility >= vol_min * 0.88 AND volatility < vol_min AND volatility <= vol_max AND sharpe >= 0.232, false) AS soft FROM t_uc)"""


def user_candidates(v):
    rets, books = v.returns_class_table, v.books_class_table
    m = blend.portfolio_metrics(books, rets)
    rc = blend.risk_contributions(books, matrix.covariance(rets, annual=False), 252.0).groupBy("portfolio_id").agg(F.max("risk_contribution").alias("_rc"))
    part = F.split("portfolio_id", r"\|")
    m = m.join(rc, "portfolio_id", "left").withColumns({"max_rc": C("_rc") / C("volatility"), "nation_key": part[0].cast("long"), "name": part[1]}).drop("_rc")
    return profiles(v).join(stored(m), "nation_key")


def filtered(v):
    return cand.filter_portfolios(cand.strict_thresholds(user_candidates(v), CFG), CFG).withColumn("composite_score", cand.composite_score())


check("p15_portfolio_filter", "user_id# name passed? fail_reason soft_band?", filtered, "SELECT *, soft AS soft_band FROM t_st")
check("p16_composite_score", "user_id# name composite_score~", filtered, "SELECT * FROM t_st")
check("a37_failure_reasons", "reason count#", lambda v: stats.failure_reasons(filtered(v).withColumn("fail_reason", F.split("fail_reason", ":")[0])),
      "SELECT split_part(fail_reason, ':', 1) AS reason, count(*) AS count FROM t_st WHERE NOT passed GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
check("a37_pass_counts", "passed# failed#", lambda v: stats.pass_counts(filtered(v)), "SELECT count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed FROM t_st")


def book_objective(c):
    return F.when(c.endswith("AUTOMOBILE"), "growth").when(c.endswith("BUILDING"), "balanced").when(c.endswith("FURNITURE"), "income").otherwise("preserve")


def diversity(v):
    ret = stored(portc(v))
    now = blend.regime_performance(ret, regime_labels(v)).where("regime = 'Risk-on'")
    return cand.diversity_score(stats.annualized_metrics(ret, "portfolio_id"), v.books_class, v.catalog_class, now, book_objective(C("portfolio_id")))


CTES["t_div"] = f"""SELECT *, base_score - 0.1 * concentration_penalty - 0.1 * sector_penalty + 0.1 * regime_sharpe AS score FROM (
  SELECT portfolio_id, m.sharpe - 0.2 * abs(max_dd) AS base_score, greatest(0, mx - 0.2) AS concentration_penalty, coalesce(r.sharpe, 0) AS regime_sharpe,
    CASE WHEN portfolio_id LIKE '%AUTOMOBILE' THEN greatest(0, e - 0.8) WHEN portfolio_id LIKE '%BUILDING' OR portfolio_id LIKE '%FURNITURE' THEN greatest(0, 0.2 - b) ELSE 0 END AS sector_penalty
  FROM ({annual_sql('t_portc', 'portfolio_id')}) m JOIN (SELECT portfolio_id, max(weight) AS mx, coalesce(sum(weight) FILTER (ticker = 'AFRICA'), 0) AS e, coalesce(sum(weight) FILTER (ticker = 'AMERICA'), 0) AS b
    FROM t_booksc GROUP BY 1) USING (portfolio_id) LEFT JOIN (SELECT portfolio_id, sharpe FROM ({annual_sql('t_preg', 'portfolio_id, regime')}) WHERE n >= 20 AND regime = 'Risk-on') r USING (portfolio_id))"""
DV = "portfolio_id base_score~ concentration_penalty~ sector_penalty~ regime_sharpe~ score~"
check("p17_diversity_score", DV, diversity, "SELECT * FROM t_div")


def grouped_books(v):
    part = F.split("portfolio_id", r"\|")
    return v.books.select(part[0].alias("group_id"), part[1].alias("name"), "ticker", "weight")


CTES["t_gb"] = "SELECT split_part(portfolio_id, '|', 1) AS g, split_part(portfolio_id, '|', 2) AS nm, ticker, weight FROM t_books"
CTES["t_conf"] = """SELECT a.g, a.nm, b.nm AS other, sum(a.weight * b.weight) / (any_value(na.n) * any_value(nb.n)) AS sim FROM t_gb a JOIN t_gb b ON a.g = b.g AND a.ticker = b.ticker AND a.nm <> b.nm
  JOIN (SELECT g, nm, sqrt(sum(weight * weight)) AS n FROM t_gb GROUP BY 1, 2) na ON na.g = a.g AND na.nm = a.nm
  JOIN (SELECT g, nm, sqrt(sum(weight * weight)) AS n FROM t_gb GROUP BY 1, 2) nb ON nb.g = b.g AND nb.nm = b.nm GROUP BY 1, 2, 3"""
CTES["t_gs"] = """SELECT k.g, k.nm, row_number() OVER (PARTITION BY k.g ORDER BY score DESC, k.nm) AS o, coalesce(c, []) AS c, score FROM (
    SELECT split_part(portfolio_id, '|', 1) AS g, split_part(portfolio_id, '|', 2) AS nm, score FROM t_div) k
  LEFT JOIN (SELECT g, nm, list(other) AS c FROM t_conf WHERE sim >= 0.93 GROUP BY 1, 2) x ON x.g = k.g AND x.nm = k.nm"""
KEEP_SQL = """WITH RECURSIVE f AS (SELECT g, 1::BIGINT AS o, [nm] AS kept FROM t_gs WHERE o = 1 UNION ALL
  SELECT f.g, f.o + 1, CASE WHEN list_has_any(f.kept, s.c) THEN f.kept ELSE list_append(f.kept, s.nm) END FROM f JOIN t_gs s ON s.g = f.g AND s.o = f.o + 1)
  SELECT g AS group_id, unnest(kept) AS name FROM (SELECT g, arg_max(kept, o) AS kept FROM f GROUP BY 1)"""


def kept_books(v):
    part = F.split("portfolio_id", r"\|")
    scored = diversity(v).select(part[0].alias("group_id"), part[1].alias("name"), "score")
    return cand.drop_near_duplicates(scored.join(cand.conflicts(grouped_books(v), threshold=0.93), ["group_id", "name"]), "group_id")


check("p18_conflicts", "group_id name conflicts", lambda v: cand.conflicts(grouped_books(v), threshold=0.93).withColumn("conflicts", F.array_join("conflicts", ",")),
      "SELECT k.g AS group_id, k.nm AS name, coalesce(c, '') AS conflicts FROM (SELECT DISTINCT g, nm FROM t_gb) k LEFT JOIN (SELECT g, nm, string_agg(other, ',' ORDER BY other) AS c FROM t_conf WHERE sim >= 0.93 GROUP BY 1, 2) x ON x.g = k.g AND x.nm = k.nm")
check("p18_greedy_distinct", "group_id name", kept_books, KEEP_SQL)
check("q03_candidate_count_gate", "group_id candidates# distinct_candidates# passed?", lambda v: gates.candidate_count_gate(grouped_books(v).select("group_id", "name").distinct(), kept_books(v), 4),
      f"""SELECT group_id, candidates, distinct_candidates, candidates >= 4 AND distinct_candidates >= 4 AS passed FROM (SELECT g AS group_id, count(DISTINCT nm) AS candidates FROM t_gb GROUP BY 1)
      JOIN (SELECT group_id, count(*) AS distinct_candidates FROM ({KEEP_SQL}) GROUP BY 1) USING (group_id)""")


def ladder(v):
    c = filtered(v)
    drop = ["min_cagr", "min_sharpe", "max_dd_limit", "vol_lower", "vol_upper"]
    c = cand.adaptive_thresholds(c.drop(*drop), CFG).withColumns({"relaxed": cand.fail_reason(CFG).isNull(), "strict": C("passed"), "conflicts": F.array().cast("array<string>")})
    # a third of the users see no viable candidate at all
    c = c.withColumn("cagr", F.when(mod(C("user_id"), 3) == 0, F.lit(-0.1)).otherwise(C("cagr")))
    c = c.withColumns({x: C(x) & (mod(C("user_id"), 3) != 0) for x in ("strict", "relaxed")})
    return cand.fallback_ladder(c, profiles(v).select("user_id", F.lit(recommend.EMERGENCY).alias("name")))


RELAX = {"s": "min_sharpe", "v": "vol_lower", "d": "max_dd_limit", "c": "min_cagr"}
CTES["t_lad"] = f"""SELECT s.user_id, s.name, composite_score, fail_reason, CASE WHEN passed AND s.user_id % 3 <> 0 THEN 1 WHEN relaxed AND s.user_id % 3 <> 0 THEN 2
    WHEN s.user_id % 3 <> 0 AND cagr > 0 AND sharpe > 0 AND max_drawdown > -0.8 THEN 3 END AS stage FROM t_st s JOIN (
  SELECT user_id, name, {why_sql(RELAX)} IS NULL AS relaxed FROM (SELECT u.*, min_sharpe, vol_lower, max_dd_limit, min_cagr FROM t_uc u JOIN (
    SELECT user_id AS uid, min_sharpe, vol_lower, max_dd_limit, min_cagr FROM t_adapt) ON uid = user_id)) r ON r.user_id = s.user_id AND r.name = s.name"""
check("p19_fallback_ladder", "user_id# rank# name composite_score~ fallback_level# passed? hard_fallback? original_fail_reason", ladder,
      """SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY composite_score DESC, name) AS rank, name, composite_score, stage AS fallback_level, true AS passed, false AS hard_fallback,
        CASE WHEN stage > 1 THEN fail_reason END AS original_fail_reason FROM (SELECT *, min(stage) OVER (PARTITION BY user_id) AS m FROM t_lad) WHERE stage = m QUALIFY rank <= 8
      UNION ALL SELECT user_id, 1, 'EMERGENCY_FALLBACK - Equal Weight', 0, 4, false, true, 'stage_4_emergency' FROM t_prof WHERE user_id NOT IN (SELECT user_id FROM t_lad WHERE stage IS NOT NULL)""")
check("a37_stage_counts", "stage count#", lambda v: stats.stage_counts(ladder(v)),
      """SELECT 'Stage ' || stage AS stage, count(*) AS count FROM (SELECT *, min(stage) OVER (PARTITION BY user_id) AS m, row_number() OVER (PARTITION BY user_id, stage ORDER BY composite_score DESC, name) AS r FROM t_lad)
        WHERE stage = m AND r <= 8 GROUP BY 1
      UNION ALL SELECT 'Stage 4', count(*) FROM t_prof WHERE user_id NOT IN (SELECT user_id FROM t_lad WHERE stage IS NOT NULL) HAVING count(*) > 0""")

CTES["t_sel"] = """SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY cagr, name) AS rank FROM (SELECT *, count(*) FILTER (g <= 0.02) OVER (PARTITION BY user_id) AS k FROM (
  SELECT *, abs(volatility - (0.1271 + (0.2202 - 0.1271) * true_risk / 100)) AS g FROM t_uc)) WHERE g <= CASE WHEN k < 3 THEN 0.03 ELSE 0.02 END"""
check("p20_select_for_risk", "user_id# name rank# cagr~", lambda v: cand.select_for_risk(user_candidates(v)), "SELECT * FROM t_sel")
check("p21_pick_by_slider", "user_id# name cagr~", lambda v: cand.pick_by_slider(cand.select_for_risk(user_candidates(v)), C("slider_score") / 100),
      """SELECT s.user_id, name, cagr FROM (SELECT *, min(cagr) OVER (PARTITION BY user_id) AS lo, max(cagr) OVER (PARTITION BY user_id) AS hi FROM t_sel) s
      JOIN (SELECT user_id, slider_score FROM t_prof) p ON p.user_id = s.user_id
      QUALIFY row_number() OVER (PARTITION BY s.user_id ORDER BY abs(cagr - (lo + greatest(0, least(1, slider_score / 100)) * (hi - lo))), cagr, name) = 1""")
check("p22_closest_volatility", "user_id# name gap~", lambda v: cand.closest_volatility(user_candidates(v)),
      """SELECT user_id, arg_min(name, g) AS name, min(g) AS gap FROM (SELECT *, abs(volatility - (0.1271 + (0.2202 - 0.1271) * true_risk / 100)) AS g FROM t_uc) GROUP BY 1""")
check("p23_top_candidates", "group_id portfolio_id score~ rank# shortlist?", lambda v: cand.top_candidates(
      diversity(v).withColumn("group_id", F.split("portfolio_id", r"\|")[1]), 4, name="portfolio_id"),
      """SELECT split_part(portfolio_id, '|', 2) AS group_id, portfolio_id, score, row_number() OVER (PARTITION BY split_part(portfolio_id, '|', 2) ORDER BY score DESC, portfolio_id) AS rank, rank = 1 AS shortlist
      FROM t_div QUALIFY rank <= 4""")
check("p24_relaxed_grid", "group_id name optimizer sat_cap~ lookback#", lambda v: cand.relaxed_grid(kept_books(v), grouped_books(v)),
      f"""SELECT group_id, upper(o) || ' - Sat ' || s || '% (relax,' || l || 'd)' AS name, o AS optimizer, s / 100.0 AS sat_cap, l AS lookback FROM (
        SELECT g AS group_id FROM (SELECT DISTINCT g FROM t_gb) LEFT JOIN (SELECT group_id, count(*) AS k FROM ({KEEP_SQL}) GROUP BY 1) ON g = group_id WHERE coalesce(k, 0) < 5),
      (SELECT unnest(['risk_parity','max_diversification','equal_weight']) AS o), (SELECT unnest([25, 30, 35, 40]) AS s), (SELECT unnest([252, 504, 756]) AS l)""")

# ---- composed runs ----------------------------------------------------------------------------
RUN = {"core_min_years": 5.0, "sat_min_years": 3.0, "max_asset_vol_multiplier": 1.75, "max_asset_drawdown": -0.60, "min_asset_sharpe": -0.5, **CFG,
       "min_portfolio_sharpe": 0.2, "vol_soft_lower_factor": 0.8, "min_portfolio_cagr": 0.0}


def run(v, **kw):
    return recommend.build_recommendations(profiles(v), v.returns_class, v.catalog_class, cfg=RUN, methods=("equal_weight", "risk_parity"), **kw)


RECS = "user_id# rank# name composite_score~ fallback_level# passed? hard_fallback? original_fail_reason"
CTES["t_qc"] = f"""SELECT ticker, n / 252.0::DOUBLE AS years, ((v1 / v0) ** (252.0::DOUBLE / n) - 1 - 0.015) / (sd * sqrt(252)) AS sharpe, sd * sqrt(252) AS vol, max_dd FROM ({facts_sql('t_retc', 'ticker')}) WHERE n >= 2"""
CTES["t_mine"] = """SELECT user_id, string_agg(ticker, '|' ORDER BY ticker) AS u, any_value(vol_min) AS vol_min, any_value(vol_max) AS vol_max, any_value(true_risk) AS true_risk, any_value(cagr_min) AS cagr_min
  FROM t_prof, t_qc JOIN t_catalog_class ON ticker = symbol WHERE years >= if(core_or_satellite = 'core', 5, 3) AND sharpe >= -0.5 AND vol <= vol_max * 1.75 AND max_dd >= -0.6 GROUP BY 1 HAVING count(*) >= 3"""
CTES["t_hold"] = "SELECT u, unnest(string_split(u, '|')) AS ticker FROM (SELECT DISTINCT u FROM t_mine)"
CTES["t_cwt"] = """SELECT u, 'EQUAL_WEIGHT' AS o, ticker, 1.0::DOUBLE / count(*) OVER (PARTITION BY u) AS w FROM t_hold UNION ALL
  SELECT u, 'RISK_PARITY', ticker, (1 / v) / sum(1 / v) OVER (PARTITION BY u) FROM t_hold JOIN (SELECT ticker, stddev_samp(ret) * sqrt(252) AS v FROM t_retc GROUP BY 1) USING (ticker)"""
CTES["t_cfull"] = "SELECT * FROM (SELECT u, o, ticker, w, date, ret, count(*) OVER (PARTITION BY u, o, date) AS have, k FROM (SELECT *, count(*) OVER (PARTITION BY u, o) AS k FROM t_cwt) JOIN t_retc USING (ticker)) WHERE have = k"
CTES["t_cport"] = "SELECT u, o, date, sum(w * ret) AS ret FROM t_cfull GROUP BY 1, 2, 3"
CTES["t_cmet"] = f"""SELECT m.u, m.o, n >= 2 AS valid, CAST(NULL AS VARCHAR) AS reason, (v1 / v0) ** (252.0::DOUBLE / n) - 1 AS cagr, sd * sqrt(252) AS volatility,
  ((v1 / v0) ** (252.0::DOUBLE / n) - 1 - 0.015) / (sd * sqrt(252)) AS sharpe, max_dd AS max_drawdown, wv / (sd * sqrt(252)) AS diversification_ratio, k AS num_holdings, rc / (sd * sqrt(252)) AS max_rc
FROM ({facts_sql('t_cport', 'u, o')}) m JOIN (SELECT u, o, sum(w * sd) AS wv, count(*) AS k FROM (SELECT u, o, ticker, any_value(w) AS w, stddev_samp(ret) * sqrt(252) AS sd FROM t_cfull GROUP BY 1, 2, 3) GROUP BY 1, 2) d ON d.u = m.u AND d.o = m.o
JOIN (SELECT u, o, max(c) / sqrt(sum(c)) AS rc FROM (SELECT a.u, a.o, a.ticker, sum(a.w * b.w * value) * 252 AS c FROM t_cwt a JOIN t_cwt b ON a.u = b.u AND a.o = b.o JOIN t_cov ON i = a.ticker AND j = b.ticker GROUP BY 1, 2, 3) GROUP BY 1, 2) r ON r.u = m.u AND r.o = m.o
WHERE n >= 2"""
CTES["t_csim"] = """SELECT a.u, sum(a.w * b.w) / (sqrt(sum(a.w * a.w)) * sqrt(sum(b.w * b.w))) AS sim FROM t_cwt a JOIN t_cwt b ON a.u = b.u AND a.ticker = b.ticker WHERE a.o = 'EQUAL_WEIGHT' AND b.o = 'RISK_PARITY' GROUP BY 1"""
RUN_T = {"s": "0.2::DOUBLE", "v": "(vol_min * 0.8)", "d": "(-0.09)::DOUBLE", "c": "0.0::DOUBLE"}
CTES["t_ru"] = "SELECT user_id, true_risk, vol_min, vol_max, cagr_min, c.* FROM t_mine m JOIN t_cmet c ON c.u = m.u"
CTES["t_rst"] = f"""SELECT *, why IS NULL AS strict, sharpe - 0.2 * abs(max_drawdown) - CASE WHEN volatility >= vol_min * 0.8 AND volatility < vol_min AND volatility <= vol_max AND sharpe >= 0.2 THEN 0.5 * (vol_min - volatility) ELSE 0 END AS score
  FROM (SELECT *, {why_sql(RUN_T)} AS why FROM t_ru)"""
CTES["t_radapt"] = """SELECT user_id AS uid, greatest(0.045, cagr_min * (0.82 + 0.10 * ce)) AS min_cagr, greatest(0.15, least(0.5, greatest(0.15, 0.2 + (x - 0.5) * 0.2)) * (0.88 + 0.07 * ce)) AS min_sharpe,
  greatest(-0.9, least(-0.2, least(-0.25, greatest(-0.8, -0.09 - (x - 0.5) * 0.4)) - (0.03 + 0.04 * ce))) AS max_dd_limit,
  greatest(0.02, vol_min * 0.8 * (0.65 + 0.15 * ce)) AS vol_lower FROM (SELECT *, greatest(0, 1 - abs(x - 0.5) * 2) AS ce FROM (SELECT *, true_risk / 100 AS x FROM t_prof))"""
CTES["t_rlad"] = f"""SELECT user_id, u, o, score, why, CASE WHEN strict THEN 1 WHEN {why_sql(RELAX)} IS NULL THEN 2 WHEN cagr > 0 AND sharpe > 0 AND max_drawdown > -0.8 THEN 3 END AS stage
  FROM t_rst JOIN t_radapt ON uid = user_id"""
# the four caps of one optimizer are duplicates, so one name per optimizer is left: the first by name
CTES["t_rtop"] = """SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, o) AS rank, o || ' - Sat 20%' AS name, score AS composite_score, stage AS fallback_level,
    CASE WHEN stage > 1 THEN why END AS original_fail_reason FROM (SELECT l.*, min(stage) OVER (PARTITION BY user_id) AS m, sim FROM t_rlad l JOIN t_csim s ON s.u = l.u)
  WHERE stage = m QUALIFY sim <= 0.995 OR rank = 1"""
CTES["t_rrec"] = """SELECT *, true AS passed, false AS hard_fallback FROM t_rtop UNION ALL
  SELECT user_id, 1, 'EMERGENCY_FALLBACK - Equal Weight', 0, 4, CASE WHEN user_id IN (SELECT user_id FROM t_mine) THEN 'stage_4_emergency' ELSE 'hard_fallback_insufficient_assets' END, false, true
  FROM t_prof WHERE user_id NOT IN (SELECT user_id FROM t_rtop)"""
check("p25_recommendations", RECS, lambda v: run(v).recommended, "SELECT * FROM t_rrec")
check("p25_portfolio_receipts", "user_id# name optimizer sat_cap~ cagr~ volatility~ sharpe~ max_drawdown~ diversification_ratio~ num_holdings# composite_score~ passed? fail_reason",
      lambda v: run(v).portfolio_receipts,
      """SELECT user_id, o || ' - Sat ' || s || '%' AS name, lower(o) AS optimizer, s / 100.0 AS sat_cap, cagr, volatility, sharpe, max_drawdown, diversification_ratio, num_holdings, score AS composite_score,
      strict AS passed, why AS fail_reason FROM t_rst, (SELECT unnest([20, 25, 30, 35]) AS s)""")
check("p25_stats", "user_id# total_candidates# strict_passes# recommended# fallback_count# hard_fallback_count# stage_used#", lambda v: run(v).stats,
      """SELECT r.user_id, coalesce(total, 0) AS total_candidates, coalesce(strict, 0) AS strict_passes, recommended, fallback_count, hard_fallback_count, stage_used FROM (
        SELECT user_id, count(*) AS recommended, count(*) FILTER (fallback_level > 1) AS fallback_count, count(*) FILTER (hard_fallback) AS hard_fallback_count, max(fallback_level) AS stage_used FROM t_rrec GROUP BY 1) r
      LEFT JOIN (SELECT user_id, 4 * count(*) AS total, 4 * count(*) FILTER (strict) AS strict FROM t_rst GROUP BY 1) c ON c.user_id = r.user_id""")
check("p25_recommended_holdings", "user_id# rank# name ticker weight~ risk_contribution~ asset_class", lambda v: run(v).recommended_weights,
      """SELECT r.user_id, rank, name, c.ticker, w AS weight, rc AS risk_contribution, asset_class FROM t_rrec r JOIN t_mine m ON m.user_id = r.user_id JOIN t_cwt c ON c.u = m.u AND name LIKE c.o || ' - %'
      JOIN (SELECT u, o, ticker, c / sqrt(sum(c) OVER (PARTITION BY u, o)) AS rc FROM (SELECT a.u, a.o, a.ticker, sum(a.w * b.w * value) * 252 AS c FROM t_cwt a JOIN t_cwt b ON a.u = b.u AND a.o = b.o
        JOIN t_cov ON i = a.ticker AND j = b.ticker GROUP BY 1, 2, 3)) x ON x.u = c.u AND x.o = c.o AND x.ticker = c.ticker JOIN t_catalog_class ON symbol = c.ticker WHERE NOT hard_fallback
      UNION ALL SELECT user_id, rank, name, ticker, 1.0::DOUBLE / count(*) OVER (PARTITION BY user_id), NULL, asset_class FROM (SELECT r.user_id, rank, name, unnest(coalesce(string_split(u, '|'),
        (SELECT list(ticker ORDER BY ticker)[:3] FROM (SELECT DISTINCT ticker FROM t_retc)))) AS ticker FROM t_rrec r LEFT JOIN t_mine m ON m.user_id = r.user_id WHERE hard_fallback) JOIN t_catalog_class ON symbol = ticker""")
check("p25_emergency_portfolios", "user_id# optimizer sat_cap~ cagr~ volatility~ sharpe~ max_drawdown~ num_holdings#",
      lambda v: run(v).recommended.where("hard_fallback"),
      f"""WITH h AS (SELECT r.user_id, unnest(coalesce(string_split(u, '|'), (SELECT list(ticker ORDER BY ticker)[:3] FROM (SELECT DISTINCT ticker FROM t_retc)))) AS ticker
        FROM t_rrec r LEFT JOIN t_mine m ON m.user_id = r.user_id WHERE hard_fallback),
      s AS (SELECT user_id, string_agg(ticker, '|' ORDER BY ticker) AS u, count(*) AS k FROM h GROUP BY 1),
      e AS (SELECT u, any_value(k) AS k, unnest(string_split(u, '|')) AS ticker FROM s GROUP BY u),
      p AS (SELECT u, date, avg(ret) AS ret FROM e JOIN t_retc USING (ticker) GROUP BY u, date, k HAVING count(*) = k),
      f AS ({facts_sql('p', 'u')})
      SELECT user_id, 'equal_weight' AS optimizer, 1.0::DOUBLE / k AS sat_cap, (v1 / v0) ** (252.0::DOUBLE / n) - 1 AS cagr, sd * sqrt(252) AS volatility,
        ((v1 / v0) ** (252.0::DOUBLE / n) - 1 - 0.015) / (sd * sqrt(252)) AS sharpe, max_dd AS max_drawdown, k AS num_holdings FROM s LEFT JOIN (FROM f WHERE n >= 2) USING (u)""")
check("p25_all_methods", RECS, lambda v: recommend.build_recommendations(profiles(v), v.returns_class, v.catalog_class, cfg=RUN).recommended)


def small_objectives(v):
    return objective_tables(v.spark, {k: {**o, "min_holdings": 3} for k, o in fixed.OBJECTIVES.items()})


check("p26_objective_recommendations", "user_id# rank# name composite_score~ fallback_level# in_bands? objective fit suggested ret_min~ vol_max~ stretch",
      lambda v: recommend.build_recommendations_for_objectives(profiles(v), v.returns_class, v.catalog_class, *small_objectives(v), cfg=RUN,
                                                               methods=("equal_weight", "risk_parity"))[0])

CTES["t_shk"] = """SELECT scenario_id, ticker, date, ret * CASE WHEN date = (SELECT min(date) FROM t_ret) THEN
    CASE scenario_id WHEN 'crash' THEN CASE WHEN class LIKE 'public_equity%' THEN 0.9 WHEN class = 'gold' THEN 1.05 ELSE 1 END
      WHEN 'hike' THEN CASE WHEN class IN ('treasury_long','corporate_bond') THEN 1 - 7 * 0.01 ELSE 1 END
      ELSE CASE WHEN class IN ('treasury_long','corporate_bond') THEN 1 + 7 * 0.01 WHEN class LIKE 'public_equity%' THEN 1.03 * 0.98 ELSE 1 END END ELSE 1 END::DOUBLE AS ret
  FROM t_ret JOIN t_catalog ON ticker = symbol, (VALUES ('crash'), ('hike'), ('mixed')) s(scenario_id)"""
CTES["t_shv"] = "SELECT scenario_id, ticker, 1 / stddev_samp(ret) AS i FROM t_shk GROUP BY 1, 2"
CTES["t_now"] = "SELECT regime FROM (SELECT regime FROM t_reg ORDER BY date DESC LIMIT 30) GROUP BY 1 ORDER BY count(*) DESC, regime LIMIT 1"
CTES["t_shw"] = """SELECT scenario_id, o, ticker, t / sum(t) OVER (PARTITION BY scenario_id, o) AS w FROM (
  SELECT scenario_id, o, ticker, CASE o WHEN 'equal_weight' THEN e WHEN 'risk_parity' THEN p ELSE (e + p) / 2 END * (1::DOUBLE + CASE asset_class
    WHEN 'equity' THEN CASE regime WHEN 'Risk-on' THEN 0.05 WHEN 'Recessionary' THEN -0.05 ELSE 0 END
    WHEN 'bond' THEN CASE regime WHEN 'Recessionary' THEN 0.05 WHEN 'Risk-on' THEN -0.05 WHEN 'Tightening' THEN -0.02 ELSE 0 END
    WHEN 'commodity' THEN CASE regime WHEN 'Recessionary' THEN 0.02 ELSE 0 END WHEN 'cash' THEN CASE regime WHEN 'Tightening' THEN 0.02 ELSE 0 END ELSE 0 END) AS t
  FROM (SELECT scenario_id, ticker, 1.0::DOUBLE / count(*) OVER (PARTITION BY scenario_id) AS e, i / sum(i) OVER (PARTITION BY scenario_id) AS p FROM t_shv)
    JOIN t_catalog ON symbol = ticker, t_now, (SELECT unnest(['equal_weight', 'risk_parity', 'max_diversification']) AS o))"""
CTES["t_shp"] = "SELECT scenario_id || '#' || o AS portfolio_id, date, sum(w * ret) AS ret FROM t_shw JOIN t_shk USING (scenario_id, ticker) GROUP BY 1, 2"
CTES["t_shm"] = annual_sql("t_shp", "portfolio_id")
# three candidates a scenario: the best stays, the others unless too similar to one that stays
CTES["t_shr"] = """SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY score DESC, portfolio_id) AS r FROM (
  SELECT split_part(portfolio_id, '#', 1) AS scenario_id, split_part(portfolio_id, '#', 2) AS o, portfolio_id, cagr, sharpe, max_dd, sharpe - 0.2 * abs(max_dd) AS score FROM t_shm)"""
CTES["t_shs"] = """SELECT scenario_id, max(sim) FILTER (x.r = 1 AND y.r = 2) >= 0.995 AS s12, max(sim) FILTER (x.r = 1 AND y.r = 3) >= 0.995 AS s13, max(sim) FILTER (x.r = 2 AND y.r = 3) >= 0.995 AS s23 FROM (
    SELECT scenario_id, a.o AS oa, b.o AS ob, sum(a.w * b.w) / sqrt(sum(a.w * a.w) * sum(b.w * b.w)) AS sim FROM t_shw a JOIN t_shw b USING (scenario_id, ticker) GROUP BY 1, 2, 3)
  JOIN t_shr x USING (scenario_id) JOIN t_shr y USING (scenario_id) WHERE x.o = oa AND y.o = ob GROUP BY 1"""
CTES["t_sht"] = """SELECT scenario_id, o, portfolio_id, cagr, sharpe, max_dd, score, row_number() OVER (PARTITION BY scenario_id ORDER BY r) AS rank FROM t_shr JOIN t_shs USING (scenario_id)
  WHERE r = 1 OR (r = 2 AND NOT s12) OR (r = 3 AND NOT s13 AND (s12 OR NOT s23))"""
CTES["t_shh"] = """SELECT portfolio_id, horizon, date, ret FROM (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY date DESC) AS rn FROM t_shp JOIN t_sht USING (portfolio_id))
  JOIN (VALUES ('1y', 252), ('3y', 756), ('5y', 1260), ('10y', 2520)) h(horizon, days) ON rn <= days"""


def scenario_classes(v):
    return v.catalog.select("symbol", "class").join(tilt_classes(v), "symbol")


def scenario_tables(v):
    return recommend.scenario_candidates(v.returns, scenario_classes(v), SCENARIOS, regime=stored(macro.current_regime(regime_labels(v))).scalar())


def scenario_receipts(v):
    root = shared_folder(v.spark)
    _, w, _, receipts = recommend.scenario_run(v.prices, daily(v), scenario_classes(v), SCENARIOS, root)
    files = v.spark.read.option("header", True).csv(f"{root}/weights")
    names = [c for c in files.columns if c != "portfolio_id"]
    total = files.select(F.explode(F.array(*[F.struct(F.lit(c).alias("ticker"), C(f"`{c}`").cast("double").alias("w")) for c in names])).alias("x"))
    return receipts.join(total.groupBy("x.ticker").agg(F.sum("x.w").alias("weight")), "ticker")


check("p27_scenario_candidates", "scenario_id portfolio_id cagr~ sharpe~ max_dd~ score~ rank# shortlist?", lambda v: scenario_tables(v)[0],
      "SELECT *, rank = 1 AS shortlist FROM t_sht")
check("p27_scenario_weights", "scenario_id portfolio_id optimizer ticker weight~", lambda v: scenario_tables(v)[1],
      "SELECT scenario_id, portfolio_id, o AS optimizer, ticker, w AS weight FROM t_shw JOIN t_sht USING (scenario_id, o)")
check("p27_scenario_horizons", "portfolio_id horizon n# cagr~ volatility~ sharpe~ max_dd~", lambda v: scenario_tables(v)[2], annual_sql("t_shh", "portfolio_id, horizon"))
check("p27_scenario_receipts", "ticker first@ last@ nan_rate~ weight~", scenario_receipts,
      """SELECT * FROM (SELECT ticker, min(date) AS first, max(date) AS last, round(1 - count(price) / any_value(n)::DOUBLE, 4) AS nan_rate FROM t_prices, (SELECT count(DISTINCT date) AS n FROM t_prices) WHERE price IS NOT NULL GROUP BY 1)
      JOIN (SELECT ticker, sum(w) AS weight FROM t_shw JOIN t_sht USING (scenario_id, o) GROUP BY 1) USING (ticker)""")

CTES["t_wz"] = """SELECT ticker, date, greatest(max(CASE WHEN rn = k + 1 THEN ret END) OVER w, least(max(CASE WHEN rn = n - k THEN ret END) OVER w, ret)) AS ret
  FROM (SELECT *, floor(n * 0.005) AS k FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ret, date) AS rn, count(*) OVER (PARTITION BY ticker) AS n FROM t_ret)) WINDOW w AS (PARTITION BY ticker)"""
CTES["t_s1"] = """SELECT portfolio_id, ticker, (1 / v) / sum(1 / v) OVER (PARTITION BY portfolio_id) AS weight, CASE WHEN class IN ('gold','commodities','reit') THEN 'satellite' ELSE 'core' END AS tier
  FROM t_books JOIN (SELECT ticker, stddev_samp(ret) AS v FROM t_wz GROUP BY 1) USING (ticker) JOIN t_catalog ON symbol = ticker"""
CTES["t_s1p"] = """SELECT portfolio_id, date, coalesce(sum(weight * ret), 0) AS ret FROM t_s1 CROSS JOIN (SELECT DISTINCT date FROM t_wz) LEFT JOIN t_wz USING (ticker, date) GROUP BY 1, 2"""


def book_goals(v):
    return v.books.withColumn("goal", F.when(C("portfolio_id").endswith("BUILDING"), "income").otherwise("grow"))


check("p28_single_portfolio_weights", W3, lambda v: recommend.single_portfolios(book_goals(v), v.returns, v.catalog)[0],
      f"SELECT portfolio_id, ticker, weight / sum(weight) OVER (PARTITION BY portfolio_id) AS weight FROM ({core_sat_sql('t_s1', '0.65', '0.35', '0.07')})")
check("p28_single_portfolio_metrics", "portfolio_id cagr~4 vol~4 sharpe~2 max_dd~4 n#", lambda v: recommend.single_portfolios(book_goals(v), v.returns, v.catalog)[1],
      f"SELECT portfolio_id, cagr, volatility AS vol, sharpe, max_dd, n FROM ({annual_sql('t_s1p', 'portfolio_id')})")
check("p29_candidate_run", "group_id name cagr~ volatility~ sharpe~ max_dd~ score~ rank# shortlist?",
      lambda v: recommend.candidate_run(v.returns, v.catalog, regime_labels(v), regime="risk_on")[0])
