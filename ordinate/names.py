"""Names of columns that operators add for a while: none that the caller's table has."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def free_name(df: DataFrame, name: str) -> str:
    """The name, or a longer one, that no column of df has, whatever its case."""
    return free_names(df, name)[0]


def free_names(df: DataFrame, *names: str, but: Iterable[str | None] = ()) -> list[str]:
    """free_name() of each, all different, and other than `but`, the names of columns yet to be added."""
    taken, out = {c.lower() for c in (*df.columns, *but) if c}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
