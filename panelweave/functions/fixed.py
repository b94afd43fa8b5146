"""Scores, limits and bands that results depend on. Plain data, no logic."""

# ---- questionnaire answers -> score, and the weight of each question -----------------------------
ANSWER_SCORES = {
    "q1_time_horizon": {"0–3 years": 0.0, "3–7 years": 40.0, "7–15 years": 70.0, "15+ years": 100.0},
    "q2_loss_tolerance": {"Very low": 0.0, "Low": 25.0, "Medium": 50.0, "High": 75.0, "Very high": 100.0},
    "q3_reaction_20_drop": {"Sell everything immediately": 0.0, "Sell some to reduce risk": 20.0, "Hold and wait": 50.0,
                            "Hold and might buy more": 80.0, "Definitely buy more (opportunity)": 100.0},
    "q4_income_stability": {"Very unstable": 0.0, "Unstable": 25.0, "Moderate": 50.0, "Stable": 75.0, "Very stable": 100.0},
    "q5_dependence_on_money": {"Critical for living expenses": 0.0, "Important but not critical": 30.0,
                               "Helpful but have other income": 60.0, "Nice-to-have growth money": 100.0},
    "q6_investing_experience": {"Beginner (first time)": 0.0, "Some experience (< 3 years)": 35.0,
                                "Experienced (3-10 years)": 70.0, "Advanced (10+ years)": 100.0},
    "q7_safety_net": {"No emergency fund or insurance": 0.0, "Small emergency fund (< 3 months)": 30.0,
                      "Moderate safety net (3-6 months)": 60.0, "Strong safety net (6+ months)": 100.0},
    "q8_goal_type": {"Capital preservation (safety first)": 0.0, "Income generation (steady returns)": 30.0,
                     "Balanced growth (moderate risk)": 60.0, "Aggressive growth (max returns)": 100.0},
}
ANSWER_WEIGHTS = {
    "q1_time_horizon": 0.20, "q2_loss_tolerance": 0.20, "q3_reaction_20_drop": 0.15, "q4_income_stability": 0.10,
    "q5_dependence_on_money": 0.15, "q6_investing_experience": 0.10, "q7_safety_net": 0.05, "q8_goal_type": 0.05,
}
STABILITY_POINTS = {"Very stable": 25.0, "Stable": 20.0, "Moderate": 15.0, "Unstable": 10.0, "Very unstable": 5.0}

# ---- risk score -> growth and volatility bands ---------------------------------------------------
GROWTH_ANCHORS = [(20.0, 0.05, 0.06), (50.0, 0.08, 0.09), (80.0, 0.10, 0.11)]  # (risk, minimum, target)
VOLATILITY_RANGE = (0.1271, 0.2202)
VOLATILITY_BAND = 0.02
RISK_DEFAULTS = {"vol_min": 0.05, "vol_target": 0.12, "vol_max": 0.30, "true_risk": 50.0}

# ---- investors and goals -------------------------------------------------------------------------
TIERS = ["retail", "accredited", "qualified_client", "qualified_purchaser", "institutional"]
RISK_FLOORS = {"preserve": 5, "income": 15, "tax_efficiency": 20, "grow_income": 35, "grow": 45}
PLAN_MULTIPLIERS = {"preservation": 0.6, "income": 0.8, "balanced": 1.0, "growth": 1.2, "aggressive": 1.4}
PLANS = [("Baseline", 0.7, 0.8), ("Ambitious", 1.0, 1.0), ("Aggressive", 1.4, 1.3)]  # (name, lump, monthly)
GOAL_VOLATILITY = {"grow": (0.14, 0.28), "grow_income": (0.10, 0.22), "income": (0.06, 0.16),
                   "preserve": (0.04, 0.10), "tax_efficiency": (0.10, 0.24)}
LEVEL_VOLATILITY = {"aggressive": 0.24, "moderate": 0.16, "conservative": 0.10, "income": 0.12, "preserve": 0.07}
GOAL_LIMITS = {  # goal: (equity min, max, bond min, max, cash min, max, alternatives min, max)
    "grow": (0.70, 0.95, 0.00, 0.25, 0.00, 0.10, 0.00, 0.20),
    "grow_income": (0.55, 0.85, 0.10, 0.35, 0.00, 0.10, 0.00, 0.20),
    "income": (0.15, 0.45, 0.30, 0.70, 0.00, 0.20, 0.00, 0.15),
    "preserve": (0.00, 0.25, 0.40, 0.90, 0.05, 0.50, 0.00, 0.10),
    "tax_efficiency": (0.40, 0.80, 0.10, 0.40, 0.00, 0.10, 0.00, 0.20),
}

# ---- objectives (the parsed configuration) -------------------------------------------------------
OBJECTIVES = {
    "CONSERVATIVE": {
        "label": "Conservative", "risk_score_min": 0, "risk_score_max": 35, "risk_score_optimal": 20,
        "target_return": {"min": 0.03, "max": 0.06, "target": 0.045}, "target_volatility": {"min": 0.05, "max": 0.10, "target": 0.075},
        "asset_class_bands": {"equity": {"min": 0.15, "max": 0.35}, "bond": {"min": 0.45, "max": 0.70}, "reit": {"min": 0.00, "max": 0.10},
                              "commodity": {"min": 0.00, "max": 0.10}, "cash": {"min": 0.05, "max": 0.30}},
        "min_holdings": 6, "max_holdings": 15, "prefer_core_assets": True},
    "BALANCED": {
        "label": "Balanced", "risk_score_min": 30, "risk_score_max": 65, "risk_score_optimal": 50,
        "target_return": {"min": 0.05, "max": 0.09, "target": 0.07}, "target_volatility": {"min": 0.10, "max": 0.16, "target": 0.13},
        "asset_class_bands": {"equity": {"min": 0.40, "max": 0.70}, "bond": {"min": 0.20, "max": 0.50}, "reit": {"min": 0.00, "max": 0.15},
                              "commodity": {"min": 0.00, "max": 0.10}, "cash": {"min": 0.00, "max": 0.20}},
        "min_holdings": 8, "max_holdings": 20, "prefer_core_assets": False},
    "GROWTH": {
        "label": "Growth", "risk_score_min": 60, "risk_score_max": 100, "risk_score_optimal": 80,
        "target_return": {"min": 0.08, "max": 0.13, "target": 0.105}, "target_volatility": {"min": 0.14, "max": 0.22, "target": 0.18},
        "asset_class_bands": {"equity": {"min": 0.65, "max": 0.90}, "bond": {"min": 0.05, "max": 0.25}, "reit": {"min": 0.00, "max": 0.20},
                              "commodity": {"min": 0.00, "max": 0.15}, "cash": {"min": 0.00, "max": 0.10}},
        "min_holdings": 8, "max_holdings": 20, "prefer_core_assets": False},
    "GROWTH_PLUS_INCOME": {
        "label": "Growth + Income", "risk_score_min": 50, "risk_score_max": 85, "risk_score_optimal": 65,
        "target_return": {"min": 0.06, "max": 0.11, "target": 0.085}, "target_volatility": {"min": 0.12, "max": 0.19, "target": 0.155},
        "asset_class_bands": {"equity": {"min": 0.50, "max": 0.75}, "bond": {"min": 0.15, "max": 0.40}, "reit": {"min": 0.05, "max": 0.25},
                              "commodity": {"min": 0.00, "max": 0.10}, "cash": {"min": 0.00, "max": 0.15}},
        "min_holdings": 10, "max_holdings": 20, "prefer_core_assets": False},
    "AGGRESSIVE": {
        "label": "Aggressive", "risk_score_min": 75, "risk_score_max": 100, "risk_score_optimal": 90,
        "target_return": {"min": 0.10, "max": 0.16, "target": 0.13}, "target_volatility": {"min": 0.18, "max": 0.28, "target": 0.23},
        "asset_class_bands": {"equity": {"min": 0.75, "max": 0.95}, "bond": {"min": 0.00, "max": 0.15}, "reit": {"min": 0.00, "max": 0.15},
                              "commodity": {"min": 0.00, "max": 0.15}, "cash": {"min": 0.00, "max": 0.05}},
        "min_holdings": 6, "max_holdings": 18, "prefer_core_assets": False},
}
PROGRESSION = ["CONSERVATIVE", "BALANCED", "GROWTH_PLUS_INCOME", "GROWTH", "AGGRESSIVE"]
RISK_ADJUSTMENT = {"below": (0.85, 0.80), "above": (1.15, 1.20), "zone": 15.0}  # (return, volatility) multipliers

# ---- universe and class caps ---------------------------------------------------------------------
FALLBACK_CORE = [
    "SPY", "VTI", "QQQ", "DIA", "IWM", "VEA", "VXUS", "VWO", "TLT", "IEF", "AGG", "BND", "MUB", "BIL", "GLD", "DBC",
]
ASSET_CLASSES = ["equity", "bond", "reit", "commodity", "cash"]
CLASS_CAPS = {"equity": 0.65, "bond": 0.70, "commodity": 0.20, "cash": 0.20, "reit": 0.20}

# ---- well-known symbols, their asset class, durations -------------------------------------------
SYMBOLS_BY_CLASS = {
    "commodity": (
        "GLD", "IAU", "GLDM", "DBC", "PDBC", "GSG", "GCC",
    ),
    "reit": (
        "VNQ", "SCHH", "IYR",
    ),
    "cash": (
        "BIL", "SHY",
    ),
    "bond": (
        "AGG", "BND", "LQD", "HYG", "MUB", "TLT", "IEF", "IEI", "TIP", "SCHP", "BSV", "BIV", "VGIT", "VGLT", "VGSH", "EDV",
        "ZROZ", "GOVT", "IGSB", "IGIB", "JNK", "BNDX", "EMB",
    ),
    "equity": (
        "SPY", "VOO", "IVV", "VTI", "ITOT", "SCHB", "SPTM", "RSP", "SPLG", "SCHX", "VEA", "EFA", "VXUS", "VEU", "ACWI", "ACWX",
        "IEFA", "IEMG", "QQQ", "QQQM", "IWM", "IJR", "IJH", "IWB", "VUG", "VTV", "VBK", "VBR", "AVUV", "MTUM", "QUAL", "USMV",
        "SPLV", "SCHD", "VIG", "VYM", "DGRO", "SPYG", "SPYV", "IWF", "IWD", "VLUE", "SIZE", "XLF", "XLK", "XLY", "XLP", "XLV",
        "XLI", "XLU", "XLE", "XLRE", "XLB", "XLC", "VWO", "EEM", "EWJ", "INDA", "EWU", "EWQ", "EWC", "EWA", "EWG", "EWH", "EWY",
        "EWT", "EWZ", "EWS", "EZA", "EWW", "EWM", "EWD", "EWL", "EWI", "EWP", "VSS", "SCZ",
    ),
}
EQUITY_TICKERS = [
    "SPY", "QQQ", "IWM", "VTI", "VOO", "VTV", "VUG", "VGT", "XLK", "VEA", "VWO", "EEM", "EFA", "DIA", "VNQ", "AAPL", "MSFT",
    "GOOGL", "AMZN", "META", "TSLA", "NVDA",
]
BOND_TICKERS = [
    "TLT", "IEF", "SHY", "BIL", "AGG", "BND", "MUB", "LQD", "HYG", "TIP", "GOVT",
]
BOND_CLASSES = ["treasury_long", "tbills", "corporate_bond", "high_yield", "tax_eff_muni", "public_bond", "muni_bond"]
ALT_CLASSES = ["commodities", "gold", "reit", "public_equity_sector", "public_equity_style"]
SHOCK_CLASSES = {
    "equity": ["public_equity", "public_equity_intl", "public_equity_em", "public_equity_sector"],
    "rates": ["treasury_long", "treasury_short", "corporate_bond", "high_yield", "tax_eff_muni", "bond"],
    "gold": ["gold", "commodity"],
}
DURATIONS = {"TLT": 17.0, "IEF": 7.0, "SHY": 2.0, "BND": 6.5, "AGG": 6.5, "LQD": 8.0, "HYG": 4.0, "MUB": 5.0}

# ---- candidate thresholds, look-backs and subset shares -----------------------------------------
PORTFOLIO_FILTER = {"min_portfolio_sharpe": 0.3, "max_portfolio_drawdown": -0.50, "vol_soft_lower_factor": 0.6, "min_portfolio_cagr": 0.0,
                    "max_risk_contribution": 0.40, "min_diversification_ratio": 1.2, "min_holdings": 3}
RELAX_DEFAULTS = {"min_cagr_floor": 0.045, "cagr_multiplier_base": 0.82, "cagr_multiplier_bonus": 0.10, "sharpe_multiplier_base": 0.88,
                  "sharpe_multiplier_bonus": 0.07, "drawdown_shift_base": 0.03, "drawdown_shift_bonus": 0.04, "vol_lower_multiplier": 0.65,
                  "vol_lower_bonus": 0.15, "vol_lower_floor": 0.02}
LOOKBACKS = [252, 504, 756, 1008]
SHARES = [0.6, 0.7, 0.8, 0.9]

# ---- asset filter, objective universes, plausible ranges -----------------------------------------
ASSET_FILTER = {"core_min_years": 5.0, "sat_min_years": 3.0, "min_asset_sharpe": -0.5, "max_asset_vol_multiplier": 2.0, "max_asset_drawdown": -0.60}
INCOME = (["treasury_long", "corporate_bond", "high_yield", "tax_eff_muni", "reit", "tbills", "public_equity", "public_equity_intl"],
          ["VYM", "SCHD", "DVY", "DGRO"])
GROWTH = (["public_equity", "public_equity_intl", "public_equity_em"], ["QQQ", "VUG", "VGT", "XLK", "IWF"])
PRESERVE = (["tbills", "treasury_short", "corporate_bond", "tax_eff_muni"], ["BIL", "SHY", "BND", "LQD", "MUB", "GOVT"])
PLAUSIBLE = {"cagr": (-0.8, 0.8), "sharpe": (-1.5, 4.0), "max_dd": (-0.98, -0.01)}
