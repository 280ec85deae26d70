"""Detector rows: filters on class and confidence before any region is made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def of_class(rows: DataFrame, names: dict[int, str], wanted: str) -> DataFrame:
    """Rows whose ``class_id`` is a class of the wanted name (case-insensitive). A model without that class is an error, not an empty result."""
    ids = [k for k, v in names.items() if v.lower() == wanted.lower()]
    if not ids:
        raise ValueError(f"the detector has no class {wanted!r}; it has {sorted(set(names.values()))}")
    return rows.where(F.col("class_id").isin(ids))


def confident(rows: DataFrame, threshold: float) -> DataFrame:
    """Rows with at least the confidence; unknown confidence is dropped."""
    return rows.where(F.col("det") >= threshold)
