"""Column names in a standard form."""

from __future__ import annotations

import re
from collections.abc import Iterable


def standard_name(name: str) -> str:
    """Lower case, runs of other characters become one underscore, never empty."""
    lowered = name.strip().lower()
    body = re.sub(r"_+", "_", "".join(ch if ch.isalnum() else "_" for ch in lowered)).strip("_")
    if not body:
        return "col"
    return f"col_{body}" if body[0] in "0123456789" else body


def numbered(base: str, taken: set[str], separator: str = "_") -> str:
    """``base``, or ``base_1``, ``base_2``, ... whichever is free first; marks it as taken."""
    candidate, n = base, 0
    while candidate in taken:
        n += 1
        candidate = f"{base}{separator}{n}"
    taken.add(candidate)
    return candidate


def standard_names(names: Iterable[str]) -> list[str]:
    taken: set[str] = set()
    return [numbered(standard_name(name), taken) for name in names]


def indicator_label(value: str, max_length: int = 32) -> str:
    """The part of a one-hot column name that stands for ``value``."""
    label = re.sub(r"_+", "_", re.sub(r"[^A-Za-z0-9]", "_", value)).strip("_")
    return (label or "value")[:max_length]
