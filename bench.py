"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query starts without cached panels, so it reads and derives all it needs from the files.
"""

from __future__ import annotations

import json
import os
import time

from panelweave.checks.catalog import CHECKS
from panelweave.session import local_session

HEADLINE = [
    "s02_canonical_bars", "m03_union_with_provenance", "m05_provider_fallback", "c08_simple_returns", "c09_bounded_fill", "c17_robust_returns",
    "c18_overlap_preclean", "a01_annualized_metrics", "a24_sample_covariance", "a26_shrunk_covariance", "a32_bootstrap_growth", "w01_rolling_risk",
    "w02_rolling_drawdown", "w07_dca_plans", "w13_xirr", "j01_portfolio_returns", "j04_portfolio_metrics", "j05_risk_contributions",
    "j10_apply_shocks", "r02_rule_labels", "u04_risk_profiles", "u15_objective_fit", "v02_validate_catalog", "v08_asset_receipts",
    "p05_searched_weights", "p12_class_cap_redistribution", "p19_fallback_ladder", "p25_recommendations", "p27_scenario_candidates",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads before timing
    # untimed, over other data where there is any: start-up, first compilation, Python workers
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    for name in (HEADLINE[0], "j04_portfolio_metrics"):
        CHECKS[name].run(spark, small if os.path.isdir(small) else sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        spark.catalog.clearCache()
        t0 = time.perf_counter()
        CHECKS[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "panel_and_portfolio_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
