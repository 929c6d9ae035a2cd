"""Severity weights and escalation gates as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity weights and gate defaults.
SEVERITY_WEIGHTS = {"ERROR": 1.0, "WARNING": 0.7, "INFO": 0.3, "NONE": 0.0}
GATE_DEFAULTS = {"weight_static": 0.15, "weight_slm": 0.85, "threshold": 0.2, "override": False, "static_override": 1.0, "slm_override": 0.9}
PRODUCTION = {"weight_static": 0.4, "weight_slm": 0.6, "threshold": 0.52, "override": True}
# End of fixed values.


def severity_weight(severity: Column) -> Column:
    """The severity's weight; unknown and null severities weigh nothing."""
    out = F.lit(0.0)
    for name, weight in SEVERITY_WEIGHTS.items():
        out = F.when(severity == name, F.lit(weight)).otherwise(out)
    return out


def risk(sev: Column, slm: Column, weight_static: float | Column = 0.15, weight_slm: float | Column = 0.85) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return as_col(weight_static) * sev + as_col(weight_slm) * slm


def linear_gate(sev: Column, slm: Column, **params) -> Column:
    """Weighted risk at or above the threshold; with `override` also a severity at or above, or a score above, its own limit."""
    p = GATE_DEFAULTS | params
    base = risk(sev, slm, p["weight_static"], p["weight_slm"]) >= F.lit(float(p["threshold"]))
    return base | (sev >= F.lit(float(p["static_override"]))) | (slm > F.lit(float(p["slm_override"]))) if p["override"] else base


def static_only(sev: Column, slm: Column, least: float = 0.0) -> Column:
    return sev > F.lit(least)


def model_only(sev: Column, slm: Column, threshold: float = 0.5) -> Column:
    return slm >= F.lit(threshold)


def always(sev: Column, slm: Column) -> Column:
    return F.lit(True)


def static_or_model(sev: Column, slm: Column) -> Column:
    return static_only(sev, slm) | model_only(sev, slm)


def logistic_gate(sev: Column, slm: Column, bias: float = 0.0, weight_sev: float = 0.0, weight_slm: float = 0.0, threshold: float = 0.5) -> Column:
    return 1 / (1 + F.exp(-(F.lit(float(bias)) + F.lit(float(weight_sev)) * sev + F.lit(float(weight_slm)) * slm))) >= F.lit(threshold)


#: The named strategies: (severity weight, model score, parameters) -> boolean Column.
STRATEGIES: dict[str, Callable[..., Column]] = {
    "static_only": static_only,
    "model_only": model_only,
    "always": always,
    "static_or_model": static_or_model,
    "weighted": linear_gate,
    "weighted_override": lambda sev, slm, **p: linear_gate(sev, slm, **p | {"override": True}),
    "logistic": logistic_gate,
}


def multi_label_score(probabilities: Column, safe_index: int) -> Column:
    """From class probabilities: the greater of 1 - P(safe) and the highest other class."""
    others = F.filter(F.transform(probabilities, lambda p, i: F.when(i != safe_index, p)), lambda p: p.isNotNull())
    return F.greatest(1 - F.get(probabilities, F.lit(safe_index)), F.array_max(others))
