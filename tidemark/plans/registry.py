"""All registered queries and their SQL."""

from __future__ import annotations

import importlib

#: Modules with QUERIES (name -> function of session and folder) and SQL (name -> text).
MODULES = ("problems", "scalars", "indicators", "sequences", "relational", "research", "stores", "forecasts", "rotations")


def _parts() -> list:
    return [importlib.import_module(f"tidemark.plans.{m}") for m in MODULES]


def queries() -> dict:
    out: dict = {}
    for m in _parts():
        clash = out.keys() & m.QUERIES.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for m in _parts():
        out |= m.SQL
    return out
