"""Data-quality rules: form bounds and allowed sets per field.

One aggregate pass counts, for every field, the checked (non-null) values and
the violations; the rule table is part of the plan (bounded by the number of
fields), so nothing is joined and nothing is shuffled beyond a one-row
partial aggregate.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C


def input_range_check(df: DataFrame, bounds=None, sets=None) -> DataFrame:
    bounds = bounds if bounds is not None else C.FORM_BOUNDS
    sets = sets if sets is not None else C.FORM_SETS
    aggs, fields = [], []
    for f, lo, hi in bounds:
        if f not in df.columns:
            continue
        x = F.col(f)
        aggs += [F.count(x).alias(f"n__{f}"),
                 F.count(F.when((x < lo) | (x > hi), 1)).alias(f"v__{f}")]
        fields.append(f)
    for f, allowed in sets:
        if f not in df.columns:
            continue
        x = F.col(f)
        aggs += [F.count(x).alias(f"n__{f}"),
                 F.count(F.when(~x.isin(*allowed), 1)).alias(f"v__{f}")]
        fields.append(f)
    stats = df.agg(*aggs)
    structs = [F.struct(F.lit(f).alias("field"), F.col(f"n__{f}").alias("n_checked"),
                        F.col(f"v__{f}").alias("n_violations")) for f in fields]
    return stats.select(F.inline(F.array(*structs)))


def violations_long(df: DataFrame, id_col: str = C.ID) -> DataFrame:
    """Row-level violations (id, field, value as text) for drill-down."""
    parts = []
    for f, lo, hi in C.FORM_BOUNDS:
        if f in df.columns:
            x = F.col(f)
            parts.append(F.when((x < lo) | (x > hi),
                                F.struct(F.lit(f).alias("field"), x.cast("string").alias("value"))))
    for f, allowed in C.FORM_SETS:
        if f in df.columns:
            x = F.col(f)
            parts.append(F.when(~x.isin(*allowed),
                                F.struct(F.lit(f).alias("field"), x.cast("string").alias("value"))))
    return (df.select(id_col, F.explode(F.array(*parts)).alias("v"))
            .where(F.col("v").isNotNull()).select(id_col, "v.field", "v.value"))
