"""Registered queries over the given tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ("meeting", "records", "datasets", "calendar", "lookups", "responses", "training", "trajectories")


def _merged(attribute: str) -> dict:
    out: dict = {}
    for family in FAMILIES:
        part = getattr(import_module(f"planloom.plans.{family}"), attribute)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out |= part
    return out


def all_queries() -> dict:
    return _merged("QUERIES")


def all_sql() -> dict:
    return _merged("SQL")
