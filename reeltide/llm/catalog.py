"""The queries of this subpackage, by name."""

from __future__ import annotations

from reeltide.llm import convtrie, decontaminate, divergence, fingerprints, htmltext, langid, mixing, neardup, quality, secrets, substrings, tokencount, urlfilter

MODULES = (mixing, htmltext, fingerprints, quality, secrets, urlfilter, decontaminate, langid, neardup, substrings, convtrie, tokencount, divergence)


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
