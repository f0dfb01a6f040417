"""Lookups in a schema."""

from __future__ import annotations

from pyspark.sql import DataFrame


def first_column(df: DataFrame, candidates: list[str], required: bool = True) -> str | None:
    """The first of the names that the frame has; without any an error, or None where it isn't required."""
    found = next((c for c in candidates if c in df.columns), None)
    if found is None and required:
        raise ValueError(f"none of {candidates} among {df.columns}")
    return found


def without_prefixes(df: DataFrame, prefixes: tuple[str, ...] = ("news_", "telegram_")) -> DataFrame:
    """The frame without columns of those prefixes."""
    return df.select([c for c in df.columns if not c.startswith(tuple(prefixes))])
