"""All queries by name, and the SQL that each has to agree with."""

from __future__ import annotations

from importlib import import_module

PARTS = ("tables", "scalars", "profiles", "preparation", "verdicts", "lifecycle")


def load_all():
    from tablewright.registry import core

    for part in PARTS:
        import_module(f"tablewright.registry.{part}")
    return dict(core.QUERIES), dict(core.ORACLES)
