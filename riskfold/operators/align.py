"""Align a frame to a selected feature list (plan-time column membership)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def select_member_columns(df: DataFrame, selected: list[str], keep: list[str] | None = None,
                          fill: float = 0.0) -> DataFrame:
    """Keep the selected columns in order; absent ones become ``fill``."""
    present = set(df.columns)
    cols = [F.col(c) for c in (keep or [])]
    cols += [F.col(c) if c in present else F.lit(fill).alias(c) for c in selected]
    return df.select(*cols)
