"""All registered queries; importing the families fills the registry."""
from importlib import import_module

from .registry import CHECKS

FAMILIES = ["merge_checks", "clean_checks", "stats_checks", "sequence_checks", "investor_checks", "source_checks", "candidate_checks"]
for _f in FAMILIES:
    import_module(f"{__package__}.{_f}")

__all__ = ["CHECKS"]
