"""All registered queries of the library, by name."""

from __future__ import annotations

from reeltide.plans import choices, figures, lookups, scores, sequences, signals, tracks

MODULES = (scores, lookups, sequences, choices, figures, signals, tracks)


def queries() -> dict:
    out: dict = {}
    for module in MODULES:
        out.update(module.QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for module in MODULES:
        out.update(module.ORACLES)
    return out
