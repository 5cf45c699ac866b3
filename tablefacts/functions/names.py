"""Column-name matching and cleanup."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def match_key(name: Column) -> Column:
    """Name with case and every kind of whitespace ignored."""
    return F.lower(F.regexp_replace(name, r"(?U)\s+", ""))


def match_key_of(name: str) -> str:
    """Driver-side twin of :func:`match_key`, for schema names."""
    return re.sub(r"\s+", "", name).lower()


def resolve_columns(requested: list[str], actual: list[str]) -> tuple[list[str], list[str]]:
    """Match requested names to actual ones; the first actual column of a key wins.

    Returns the matched actual names in request order, and the unmatched requests.
    """
    known = {match_key_of(a): a for a in reversed(actual)}
    found = [(r, known.get(match_key_of(r))) for r in requested]
    return [a for _, a in found if a is not None], [r for r, a in found if a is None]


def header_names(cells: list[str | None], width: int) -> list[str]:
    """Names from a header row: blanks become ``Unnamed: i``, repeats get ``.1``, ``.2``."""
    cells = list(cells[:width]) + [None] * (width - len(cells))
    names, used = [], set()
    for i, cell in enumerate(cells):
        base = cell if cell else f"Unnamed: {i}"
        name, n = base, 0
        while name in used:
            n += 1
            name = f"{base}.{n}"
        used.add(name)
        names.append(name)
    return names


def clean_names(names: list[str]) -> list[str]:
    """Trim names, number the unnamed ones, and keep names distinct ignoring case."""
    out, used = [], set()
    for position, name in enumerate(names, start=1):
        base = f"Column_{position}" if name.startswith("Unnamed") else name.strip()
        candidate, n = base, 1
        while candidate.lower() in used:
            n += 1
            candidate = f"{base}_{n}"
        used.add(candidate.lower())
        out.append(candidate)
    return out
