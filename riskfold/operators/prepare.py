"""Preparation estimators: label encoding, imputation and scaling.

Each estimator has a ``fit`` that returns small fitted state (one value per
column, or a code table with one row per category) and an ``apply`` that is a
narrow column transform. Fits are aggregates with map-side partial
aggregation; nothing row-level is collected.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..session import cut_lineage
from .stats import column_stats, exact_quantiles

CODES_PER_RANGE = 200_000


def as_text(c: str):
    """Category as text; a missing category reads as 'nan' (astype(str))."""
    return F.coalesce(F.col(c).cast("string"), F.lit(C.MISSING_BIN))


# --------------------------------------------------------------------------
# label encoding: sorted distinct text -> 0..k-1
# --------------------------------------------------------------------------
def label_encode_fit(df: DataFrame, cols: list[str], per_range: int = CODES_PER_RANGE) -> DataFrame:
    """Code table (column, value, code); codes follow alphabetical order.

    The rank is two-level: the distinct values are written in sorted ranges of
    about ``per_range`` values, numbered inside their range, and shifted by the
    sizes of the column's earlier ranges (one row a range), so a column of many
    values has no task that sees them all. ``per_range`` never changes a code."""
    parts = [F.struct(F.lit(c).alias("column"), as_text(c).alias("value")) for c in cols]
    distinct = cut_lineage(df.select(F.inline(F.array(*parts))).distinct(), "codes-distinct")
    ranges = max(1, math.ceil(distinct.count() / per_range))
    dealt = (distinct.repartitionByRange(ranges, "column", "value")
             .withColumn("range", F.spark_partition_id()))
    dealt = cut_lineage(dealt, "codes-ranges")              # ranges are sampled: fixed by writing
    sizes = dealt.groupBy("column", "range").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("column").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("column", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("column", "range").orderBy("value")
    codes = (dealt.withColumn("place", F.row_number().over(inside) - 1).join(sizes, ["column", "range"])
             .select("column", "value", (F.col("before") + F.col("place")).cast("double").alias("code")))
    return cut_lineage(codes, "codes")


def label_encode_apply(df: DataFrame, codes: DataFrame, cols: list[str],
                       unseen_code: float = 0.0, keep_text: bool = False) -> DataFrame:
    """Replace each text column by its code, joined from the code table (Spark
    broadcasts a column's codes when they turn out small); unseen text takes the
    code of the first class (0), as the single-applicant path of the reference."""
    out = df
    for c in cols:
        m = codes.filter(F.col("column") == c).select(F.col("value").alias(f"__v_{c}"),
                                                       F.col("code").alias(f"__code_{c}"))
        out = out.join(m, as_text(c) == m[f"__v_{c}"], "left")
        new = F.coalesce(F.col(f"__code_{c}"), F.lit(unseen_code))
        out = out.withColumn(f"{c}_code" if keep_text else c, new).drop(f"__v_{c}", f"__code_{c}")
    return out


def unseen_categories(df: DataFrame, codes: DataFrame, cols: list[str], id_col: str = C.ID) -> DataFrame:
    """Rows whose category has no code (the anti-join side of the fallback)."""
    parts = [F.struct(F.lit(c).alias("column"), as_text(c).alias("value")) for c in cols]
    long = df.select(id_col, F.inline(F.array(*parts)))
    return long.join(codes.select("column", "value"), ["column", "value"], "left_anti")


# --------------------------------------------------------------------------
# imputation
# --------------------------------------------------------------------------
def impute_median_fit(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    q = exact_quantiles(df, cols, [0.5])
    return {c: q[(c, 0.5)] for c in cols}


def proven_mode(candidates: list[tuple[float, int]], least_listed: int, error: float) -> float | None:
    """The mode when no other value can be as frequent, else None.

    ``candidates``: exact (value, count) of the values that the sketch listed;
    a value that it didn't list has at most ``error`` rows more than
    ``least_listed``, the least listed estimate (0 when the list isn't full)."""
    if not candidates:
        return None
    best = max(n for _, n in candidates)
    others = least_listed + error
    return min(v for v, n in candidates if n == best) if best > others else None


def impute_most_frequent_fit(df: DataFrame, cols: list[str], listed: int = 32, tracked: int = 4096
                             ) -> dict[str, float | None]:
    """Mode per column, ties -> smallest value.

    One pass keeps a mergeable frequent-items sketch a column (``tracked`` items,
    so the shuffle is bounded by sketches). A second pass counts the listed
    candidates exactly. Where the sketch's error bound leaves a doubt that an
    unlisted value is as frequent (flat columns), and only there, all distinct
    values are counted."""
    def counted(names: list[str], only: dict[str, list[float]] | None = None) -> DataFrame:
        parts = []
        for c in names:
            v = F.col(c).cast("double")
            v = F.when(v.isin(only[c]), v) if only else v
            parts.append(F.struct(F.lit(c).alias("column"), v.alias("value")))
        long = df.select(F.inline(F.array(*parts))).where(F.col("value").isNotNull())
        return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    top = df.agg(*[F.expr(f"approx_top_k(cast(`{c}` as double), {listed}, {tracked})").alias(f"t_{i}")
                   for i, c in enumerate(cols)],
                 F.count(F.lit(1)).alias("n"),
                 *[F.count(F.col(c).cast("double")).alias(f"n_{i}") for i, c in enumerate(cols)]).first()
    lists = {c: [r for r in (top[f"t_{i}"] or []) if r["item"] is not None] for i, c in enumerate(cols)}
    some = [c for c in cols if lists[c]]
    exact: dict[str, list] = {c: [] for c in cols}
    if some:
        for r in counted(some, {c: [r["item"] for r in lists[c]] for c in some}).collect():  # listed x columns rows
            exact[r["column"]].append((r["value"], r["n"]))
    # the sketch's map holds a power of two of items, three quarters of it in use
    size = 1 << math.ceil(math.log2(tracked / 0.75))
    out: dict[str, float | None] = {}
    open_cols = []
    for i, c in enumerate(cols):
        got = top[f"t_{i}"] or []                           # NULL is listed like a value
        least = min(r["count"] for r in got) if len(got) >= listed else 0
        out[c] = proven_mode(exact[c], least, 3.5 * top["n"] / size if top["n"] > tracked else 0.0)
        if out[c] is None and top[f"n_{i}"]:
            open_cols.append(c)
    if open_cols:
        counts = counted(open_cols)
        best = counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("m"), "value")).alias("b"))
        out.update({r["column"]: r["b"]["value"] for r in best.collect()})                   # one row a column
    return out


def impute_apply(df: DataFrame, fill: dict[str, float | None]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v).cast("double"))
                           for c, v in fill.items() if v is not None})


# --------------------------------------------------------------------------
# scalers (fitted on training rows, applied anywhere)
# --------------------------------------------------------------------------
@dataclass
class Affine:
    """x -> (x - shift) / scale per column."""
    shift: dict[str, float]
    scale: dict[str, float]

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(self.shift[c])) / F.lit(self.scale[c])
                               for c in self.shift})

    def column(self, c: str):
        return (F.col(c) - F.lit(self.shift[c])) / F.lit(self.scale[c])


def _nonzero(v):
    return 1.0 if (v is None or v == 0 or v != v) else float(v)


def standard_scale_fit(df: DataFrame, cols: list[str]) -> Affine:
    """mean and population std (ddof 0); zero variance divides by 1."""
    r = df.agg(*[F.avg(F.col(c)).alias(f"m__{c}") for c in cols],
               *[F.stddev_pop(F.col(c)).alias(f"s__{c}") for c in cols]).first()
    return Affine({c: float(r[f"m__{c}"] or 0.0) for c in cols},
                  {c: _nonzero(r[f"s__{c}"]) for c in cols})


def minmax_scale_fit(df: DataFrame, cols: list[str]) -> Affine:
    st = column_stats(df, cols)
    return Affine({c: float(st[c][1]) for c in cols},
                  {c: _nonzero(st[c][2] - st[c][1]) for c in cols})


def robust_scale_fit(df: DataFrame, cols: list[str]) -> Affine:
    """(x - median) / IQR with exact quantiles; zero IQR divides by 1."""
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    return Affine({c: float(q[(c, 0.5)]) for c in cols},
                  {c: _nonzero(q[(c, 0.75)] - q[(c, 0.25)]) for c in cols})


def equal_width_histogram(df: DataFrame, col: str, bins: int, label: str = "series") -> DataFrame:
    """40-bin style histogram of one column over its own range."""
    st = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    lo, hi = st["lo"], st["hi"]
    if lo is None:
        return df.sparkSession.createDataFrame([], "series string, bin int, bin_lo double, count bigint")
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    b = F.least(F.floor((F.col(col) - F.lit(lo)) / F.lit(hi - lo) * bins), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (grid.join(counts, "bin", "left")
            .select(F.lit(label).alias("series"), "bin",
                    (F.lit(lo) + F.col("bin") * F.lit((hi - lo) / bins)).alias("bin_lo"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count")))
