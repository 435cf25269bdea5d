"""Settings in layers: defaults, the user's, the repository's."""

from __future__ import annotations

import copy

#: Defaults of the settings that operators take as parameters.
DEFAULTS = {
    "aging": {"candidateToTrashedDays": 90, "deprecatedToTrashedDays": 180, "mergedIntoToTrashedDays": 90, "trashedToPurgedDays": 90, "lowConfidenceThreshold": 0.4, "lowSignalCaptureToTrashedDays": 14, "autoSweep": True},
    "intakeTierRouting": True,
    "ignoreWorktreePrefixes": ["/tmp/", "/private/tmp/"],
    "promotion": {k: {"reExtractionPromoteCount": n} for k, n in (("decision", 5), ("gotcha", 3), ("pattern", 2), ("how-to", 3))},
    "extractor": {"dedupCosine": 0.85, "reExtractionMatchCosine": 0.92},
    "ranking": {
        "weights": {"semantic": 0.5, "scope": 0.3, "status": 0.1, "confidence": 0.05, "recency": 0.05, "source": 0.1, "link": 0.05, "typeMismatchPenalty": 0.2},
        "recencyHalfLifeDays": 60,
        "candidatePoolSize": 200,
        "topK": 10,
    },
    "injection": {"pinnedHardCap": 20, "pinnedSoftWarn": 10, "autoInjectTopK": 5},
    "surface": {"tier2MinScore": 1, "dismissalThresholdK": 2, "reconcileGraceMs": 600_000},
}


def merged(*layers: dict | None) -> dict:
    """Later layers over earlier ones: objects meet key by key, anything else (lists too) is replaced; null layers say nothing."""
    out: dict = {}
    for layer in layers:
        for key, value in (layer or {}).items():
            both = isinstance(out.get(key), dict) and isinstance(value, dict)
            out[key] = merged(out[key], value) if both else copy.deepcopy(value)
    return out


def settings(user: dict | None = None, repository: dict | None = None) -> dict:
    """Defaults under the `memory` part of the user's file under that of the repository's."""
    return merged(DEFAULTS, (user or {}).get("memory"), (repository or {}).get("memory"))
