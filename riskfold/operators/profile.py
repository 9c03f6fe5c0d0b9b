"""Table profiling: class counts, missing rates, describe, skewness,
correlations, crosstabs and per-class histograms.

Plan shape rules: every all-column statistic is ONE aggregate pass (partial
aggregation on the map side, a single-row result) followed by an in-memory
unpivot; group-wise outputs pre-aggregate before anything is joined.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from .. import constants as C
from ..functions.rules import label_name, log1p_clipped
from ..session import cut_lineage
from .stats import column_stats, exact_quantiles


def numeric_columns(df: DataFrame, exclude=(C.LABEL, C.ID)) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in exclude]


def string_columns(df: DataFrame, exclude=(C.LABEL, C.ID)) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, StringType) and f.name not in exclude]


def select_by_dtype(df: DataFrame) -> DataFrame:
    """(column_name, kind) for the feature columns: numeric or object."""
    spark = df.sparkSession
    rows = [(c, "numeric") for c in numeric_columns(df)] + [(c, "object") for c in string_columns(df)]
    return spark.createDataFrame(rows, "column_name string, kind string")


def _unpivot_one_row(stats: DataFrame, names: list[str], fields: dict[str, str]) -> DataFrame:
    """One-row frame with columns ``<field>__<name>`` -> one row per name."""
    structs = [F.struct(F.lit(n).alias("column_name"),
                        *[F.col(f"`{f}__{n}`").alias(f) for f in fields])
               for n in names]
    return stats.select(F.inline(F.array(*structs)))


# --------------------------------------------------------------------------
# classes
# --------------------------------------------------------------------------
def class_counts(df: DataFrame, label: str = C.LABEL) -> DataFrame:
    return (df.groupBy(label_name(label).alias("class_name"))
            .agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "class_name"))


def class_share(df: DataFrame, label: str = C.LABEL) -> DataFrame:
    counts = df.groupBy(label_name(label).alias("class_name")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.select(F.sum("n")).scalar()  # scalar subquery over <= #classes rows
    return counts.withColumn("share", F.col("n") / total)


def class_filter(df: DataFrame, k: int, label: str = C.LABEL) -> DataFrame:
    return df.filter(F.col(label) == k)


# --------------------------------------------------------------------------
# missing values, schema
# --------------------------------------------------------------------------
def missing_rate(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cols = cols or [c for c in df.columns if c != C.ID]
    stats = df.agg(*[(F.avg(F.col(c).isNull().cast("double")) * 100).alias(f"missing_pct__{c}")
                     for c in cols])
    return _unpivot_one_row(stats, cols, {"missing_pct": "double"})


def sort_missing(missing: DataFrame) -> DataFrame:
    return missing.orderBy(F.desc("missing_pct"), "column_name")


def filter_missing_positive(missing: DataFrame) -> DataFrame:
    return missing.filter(F.col("missing_pct") > 0)


def total_missing(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cols = cols or df.columns
    total = None
    for c in cols:
        term = F.sum(F.col(c).isNull().cast("bigint"))
        total = term if total is None else total + term
    return df.agg(total.alias("total_missing"))


def schema_info(df: DataFrame) -> DataFrame:
    cols = df.columns
    stats = df.agg(*[F.count(F.col(c)).alias(f"non_null__{c}") for c in cols])
    long = _unpivot_one_row(stats, cols, {"non_null": "bigint"})
    types = df.sparkSession.createDataFrame(
        [(f.name, f.dataType.simpleString(), i) for i, f in enumerate(df.schema.fields)],
        "column_name string, dtype string, position int")
    # both sides have one row per column: bounded by the schema width
    return long.join(F.broadcast(types), "column_name")


def drop_nulls_for_profile(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col).isNotNull() & ~F.isnan(F.col(col)))


# --------------------------------------------------------------------------
# describe, skewness, correlation
# --------------------------------------------------------------------------
def describe(df: DataFrame, cols: list[str] | None = None, digits: int = 2) -> DataFrame:
    """count, mean, std (ddof 1), min, exact quartiles, max; rounded half-even."""
    cols = cols or numeric_columns(df)
    df = cut_lineage(df.select(*cols), "describe")          # several passes follow
    st = column_stats(df, cols)
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75], stats=st)
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"mean__{c}"), F.stddev_samp(x).alias(f"std__{c}")]
    moments = df.agg(*aggs).first()
    rows = []
    for c in cols:
        n, mn, mx = st[c]
        rows.append((c, int(n), moments[f"mean__{c}"], moments[f"std__{c}"], mn,
                     q[(c, 0.25)], q[(c, 0.5)], q[(c, 0.75)], mx))
    out = df.sparkSession.createDataFrame(
        rows, "column_name string, count bigint, mean double, std double, min double, "
              "p25 double, p50 double, p75 double, max double")
    return out.select("column_name", "count",
                      *[F.bround(F.col(k), digits).alias(k)
                        for k in ["mean", "std", "min", "p25", "p50", "p75", "max"]])


def _skew_expr(x):
    # pandas / DuckDB report the bias-corrected sample skewness G1;
    # Spark's skewness is the population g1: G1 = g1 * sqrt(n(n-1)) / (n-2)
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def skewness(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cols = cols or numeric_columns(df)
    stats = df.agg(*[_skew_expr(F.col(c).cast("double")).alias(f"skewness__{c}") for c in cols])
    return _unpivot_one_row(stats, cols, {"skewness": "double"})


def sort_skew(skew: DataFrame) -> DataFrame:
    return skew.orderBy(F.desc("skewness"), "column_name")


def filter_high_skew(skew: DataFrame, limit: float = 1.0) -> DataFrame:
    return skew.filter(F.abs(F.col("skewness")) > limit)


def skew_before_after(df: DataFrame, cols: list[str] | None = None,
                      log_cols: list[str] | None = None) -> DataFrame:
    """Skewness before and after log1p in ONE pass (no second scan, no join)."""
    cols = cols or numeric_columns(df)
    log_cols = set(log_cols or C.LOG_FEATS)
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        after = log1p_clipped(x) if c in log_cols else x
        aggs += [_skew_expr(x).alias(f"before__{c}"), _skew_expr(after).alias(f"after__{c}")]
    stats = df.agg(*aggs)
    long = _unpivot_one_row(stats, cols, {"before": "double", "after": "double"})
    return long.fillna(0.0, subset=["before", "after"])


def align_by_name(before: DataFrame, after: DataFrame, key: str = "column_name") -> DataFrame:
    """Full outer join of two per-column results, missing -> 0 (small sides)."""
    return before.join(after, key, "full_outer").fillna(0.0)


def correlation_matrix(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Pearson, pairwise complete, all pairs in one aggregate; long form."""
    cols = cols or numeric_columns(df)
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    stats = df.agg(*[F.corr(F.col(cols[i]).cast("double"), F.col(cols[j]).cast("double"))
                     .alias(f"c_{i}_{j}") for i, j in pairs] or [F.lit(1).alias("dummy")])
    structs = []
    for i, j in pairs:
        v = F.col(f"c_{i}_{j}")
        structs += [F.struct(F.lit(cols[i]).alias("column_a"), F.lit(cols[j]).alias("column_b"),
                             F.lit(i).alias("pos_a"), F.lit(j).alias("pos_b"), v.alias("corr")),
                    F.struct(F.lit(cols[j]).alias("column_a"), F.lit(cols[i]).alias("column_b"),
                             F.lit(j).alias("pos_a"), F.lit(i).alias("pos_b"), v.alias("corr"))]
    structs += [F.struct(F.lit(c).alias("column_a"), F.lit(c).alias("column_b"),
                         F.lit(i).alias("pos_a"), F.lit(i).alias("pos_b"), F.lit(1.0).alias("corr"))
                for i, c in enumerate(cols)]
    return stats.select(F.inline(F.array(*structs)))


def correlation_lower_triangle(corr: DataFrame) -> DataFrame:
    return corr.filter(F.col("pos_a") > F.col("pos_b"))


# --------------------------------------------------------------------------
# crosstab, histogram
# --------------------------------------------------------------------------
def crosstab(df: DataFrame, feature: str, label: str = C.LABEL) -> DataFrame:
    """category x class counts; pivot values are given, so no extra job."""
    return (df.withColumn("__cls", label_name(label))
            .groupBy(F.col(feature).alias("value"))
            .pivot("__cls", C.CLASS_NAMES).agg(F.count(F.lit(1)))
            .fillna(0, subset=C.CLASS_NAMES)
            .select("value", *[F.col(c).cast("bigint").alias(c) for c in C.CLASS_NAMES]))


def histogram_by_class(df: DataFrame, feature: str, bins: int = C.HIST_BINS_EDA,
                       label: str = C.LABEL) -> DataFrame:
    """Equal-width density histogram per class, own range per class.

    A single-valued class uses the range v - 0.5 .. v + 0.5 (numpy rule).
    Empty bins are filled from ``sequence(0, bins-1)`` per class.
    """
    x = F.col(feature).cast("double")
    rows = df.select(F.col(label).alias("cls"), x.alias("x")).filter(F.col("x").isNotNull())
    rng = (rows.groupBy("cls").agg(F.min("x").alias("mn"), F.max("x").alias("mx"),
                                   F.count(F.lit(1)).alias("n_cls"))
           .withColumn("lo", F.when(F.col("mn") == F.col("mx"), F.col("mn") - 0.5).otherwise(F.col("mn")))
           .withColumn("hi", F.when(F.col("mn") == F.col("mx"), F.col("mx") + 0.5).otherwise(F.col("mx")))
           .drop("mn", "mx"))
    # one row per class: bounded by the label domain
    b = F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    counts = (rows.join(F.broadcast(rng), "cls")
              .withColumn("bin", F.least(b, F.lit(bins - 1)).cast("int"))
              .groupBy("cls", "bin").agg(F.count(F.lit(1)).alias("count")))
    grid = rng.select("cls", "lo", "hi", "n_cls",
                      F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    return (grid.join(counts, ["cls", "bin"], "left")
            .select(F.col("cls").cast("int").alias("class"), "bin",
                    (F.col("lo") + F.col("bin") * width).alias("bin_lo"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"),
                    (F.coalesce(F.col("count"), F.lit(0)) / (F.col("n_cls") * width)).alias("density")))


def class_profile(df: DataFrame, features: list[str], classes=(0, 2),
                  label: str = C.LABEL) -> DataFrame:
    """Mean of each feature per class, long form (class, feature, mean)."""
    agg = (df.filter(F.col(label).isin(*classes)).groupBy(label)
           .agg(*[F.avg(F.col(f).cast("double")).alias(f"mean__{f}") for f in features]))
    structs = [F.struct(F.lit(f).alias("feature"), F.col(f"`mean__{f}`").alias("mean")) for f in features]
    return agg.select(F.col(label).cast("int").alias("class"), F.inline(F.array(*structs)))
