"""Registered queries take the library's own figures."""

import inspect
from unittest.mock import MagicMock

from panelweave.checks import candidate_checks, source_checks, stats_checks
from panelweave.checks.catalog import CHECKS
from panelweave.operators import stats
from panelweave.plans import recommend


def test_bootstrap_winner_replicates(spark, monkeypatch):
    default = inspect.signature(stats.bootstrap_winner).parameters["replicates"].default
    called = MagicMock()
    monkeypatch.setattr(stats_checks, "portc", MagicMock())
    monkeypatch.setattr(stats_checks.stats, "bootstrap_winner", called)
    CHECKS["a33_bootstrap_winner"].build(MagicMock())
    assert called.call_args.kwargs.get("replicates", default) == default == 2000


def test_samples_and_horizons(spark, monkeypatch):
    default = inspect.signature(recommend.build_recommendations).parameters["samples"].default
    called, written = MagicMock(), MagicMock()
    monkeypatch.setattr(candidate_checks, "profiles", MagicMock())
    monkeypatch.setattr(candidate_checks.recommend, "build_recommendations", called)
    CHECKS["p25_all_methods"].build(MagicMock())
    assert called.call_args.kwargs.get("samples", default) == default
    monkeypatch.setattr(source_checks.sinks, "write_scenario", written)
    for name in ("portc", "shared_folder"):
        monkeypatch.setattr(source_checks, name, MagicMock())
    for name in ("horizon_metrics", "annualized_metrics"):
        monkeypatch.setattr(source_checks.stats, name, MagicMock())
    CHECKS["s12_scenario_files"].build(MagicMock())
    assert written.call_args.args[4] == list(stats.HORIZONS) and len(stats.HORIZONS) == 4
