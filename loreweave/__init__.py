"""Project-knowledge analytics and training-data operators on PySpark.

The names below are read from their modules when they are asked for: workers that run one operator import no others.
"""

import importlib

_PLACES = {
    "settings": "functions.config",
    "package_roots": "operators.code",
    "resolve_calls": "operators.code",
    "resolve_import_files": "operators.code",
    "symbols": "operators.code",
    "blast_radius": "operators.graph",
    "blast_report": "operators.graph",
    "freshness": "operators.reconcile",
    "reindex": "operators.reconcile",
    "suggest": "operators.suggest",
    "suggest_with_memories": "operators.suggest",
}
__all__ = sorted(_PLACES)


def __getattr__(name: str):
    if name not in _PLACES:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(importlib.import_module(f"{__name__}.{_PLACES[name]}"), name)
