"""Feature selection: binned mutual information, threshold selections.

Mutual information uses equal-frequency bins (exact decile edges from the
histogram-refinement quantiles, right-closed) and the plug-in estimate
sum p(b,y) ln(p(b,y) / (p(b) p(y))) over the contingency table. This is a
different estimator from a k-nearest-neighbour MI; it ranks features the
same way on monotone relations and is exact and repeatable.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..session import cut_lineage
from .stats import exact_quantiles

MI_BINS = 10


def quantile_bins(df: DataFrame, features: list[str], bins: int = MI_BINS) -> dict[str, list[float]]:
    probs = [i / bins for i in range(1, bins)]
    q = exact_quantiles(df, features, probs)
    return {f: [q[(f, p)] for p in probs] for f in features}


def bin_column(col: str, edges: list[float]):
    b = None
    for e in edges:
        t = (F.col(col) > F.lit(e)).cast("int")
        b = t if b is None else b + t
    return b


def mutual_information(df: DataFrame, features: list[str], label: str = C.LABEL,
                       bins: int = MI_BINS) -> DataFrame:
    edges = quantile_bins(df, features, bins)
    parts = [F.struct(F.lit(f).alias("feature"), bin_column(f, edges[f]).alias("bin")) for f in features]
    long = df.select(F.col(label).alias("y"), F.inline(F.array(*parts)))
    cont = long.groupBy("feature", "bin", "y").agg(F.count(F.lit(1)).alias("n"))
    # the contingency table is small (features x bins x classes)
    cont = cont.withColumns({
        "n_all": F.sum("n").over(Window.partitionBy("feature")),
        "n_bin": F.sum("n").over(Window.partitionBy("feature", "bin")),
        "n_y": F.sum("n").over(Window.partitionBy("feature", "y")),
    })
    pxy = F.col("n") / F.col("n_all")
    term = pxy * F.log(pxy / ((F.col("n_bin") / F.col("n_all")) * (F.col("n_y") / F.col("n_all"))))
    # one row a feature, read again by every threshold and pass over the scores
    return cut_lineage(cont.groupBy("feature").agg(F.sum(term).alias("mi")), "mi")


def quantile_threshold_select(scores: DataFrame, col: str = "mi", q: float = C.MI_QUANTILE) -> DataFrame:
    """Features whose score is above the q-quantile of all scores."""
    thr = exact_quantiles(scores, [col], [q])[(col, q)]
    return scores.filter(F.col(col) > F.lit(thr))


def mean_threshold_select(scores: DataFrame, col: str) -> DataFrame:
    """Features whose score is above the mean score (scalar subquery)."""
    return scores.filter(F.col(col) > scores.select(F.avg(col)).scalar())


def sorted_selection(selected: DataFrame) -> DataFrame:
    """Selected names in alphabetical order with their position: one sorted
    array per selection (a selection has at most one entry per feature)."""
    arr = selected.agg(F.array_sort(F.collect_list("feature")).alias("a"))
    return arr.select(F.posexplode("a").alias("position", "feature")).select(
        "feature", F.col("position").cast("int").alias("position"))
