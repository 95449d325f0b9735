"""Composed reports and the registry of checked queries."""

from .catalog import REGISTRY, Query


def load_all() -> dict:
    from . import decision_queries  # noqa: F401
    for mod in ("quality_queries", "profile_queries", "evaluation_queries", "feature_queries",
                "sampling_queries", "scoring_queries", "model_queries", "model_check_queries", "report_queries"):
        try:
            __import__(f"{__name__}.{mod}")
        except ModuleNotFoundError as e:
            if mod not in str(e):
                raise
    return REGISTRY


__all__ = ["REGISTRY", "Query", "load_all"]
