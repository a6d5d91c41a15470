"""Choosing, dropping and checking columns by name."""

import re

from pyspark.sql import DataFrame


def require_columns(df: DataFrame, names) -> DataFrame:
    """Raise before any work when a needed column is absent."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def exclude_matching(df: DataFrame, pattern: str) -> DataFrame:
    """Every column whose name does not match ``pattern`` from its start."""
    return df.select([c for c in df.columns if not re.match(pattern, c)])


def present(df: DataFrame, names) -> list[str]:
    """The names that exist in ``df``, in the order given."""
    return [n for n in names if n in df.columns]


def features_containing(names, fragments) -> list[str]:
    """Feature names that contain one of the fragments."""
    return [n for n in names if any(f in n for f in fragments)]
