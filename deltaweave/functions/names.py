"""Column names that nothing else has."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def unused(hint: str, *taken: DataFrame | Iterable[str]) -> str:
    """``hint``, with underscores before it as long as one of the tables or lists has that name (in any case of letters)."""
    held = {c.lower() for t in taken for c in (t.columns if isinstance(t, DataFrame) else t)}
    while hint.lower() in held:
        hint = "_" + hint
    return hint
