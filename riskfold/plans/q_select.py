"""Registered queries: mutual information and threshold selections."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..operators import selection as SEL
from . import pipeline as PL
from .oracle_sql import cte, with_ctes
from .registry import register

ALL = C.ALL_FEATURES
B = SEL.MI_BINS
_P = [i / B for i in range(1, B)]

cte("miedges", "SELECT " + ", ".join(f"quantile_cont({f}, {p}) AS {f}_e{i}" for f in ALL for i, p in enumerate(_P))
    + " FROM scaled WHERE split = 'train'")
cte("milong", "\nUNION ALL\n".join(
    f"SELECT '{f}' AS feature, " + " + ".join(f"(CASE WHEN s.{f} > e.{f}_e{i} THEN 1 ELSE 0 END)" for i in range(len(_P)))
    + " AS bin, s.Credit_Score AS y FROM scaled s, miedges e WHERE s.split = 'train'" for f in ALL))
cte("mi", """
SELECT feature, sum(n / n_all * ln((n / n_all) / ((n_bin / n_all) * (n_y / n_all)))) AS mi
FROM (SELECT *, sum(n) OVER (PARTITION BY feature) AS n_all, sum(n) OVER (PARTITION BY feature, bin) AS n_bin,
             sum(n) OVER (PARTITION BY feature, y) AS n_y
      FROM (SELECT feature, bin, y, count(*) AS n FROM milong GROUP BY 1, 2, 3) c) t
GROUP BY feature""")
cte("misel", f"SELECT * FROM mi WHERE mi > (SELECT quantile_cont(mi, {C.MI_QUANTILE}) FROM mi)")


def _mi(spark, sf):
    df, _ = PL.prepared(spark, sf)
    return SEL.mutual_information(df.filter(F.col("split") == "train"), ALL)


@register("mutual_information", "feature string, mi double", with_ctes("misel", "SELECT * FROM mi"), ops=(94,))
def q_mi(spark, sf):
    return _mi(spark, sf)


@register("sort_mi", "feature string, mi double",
          with_ctes("misel", "SELECT * FROM mi ORDER BY mi DESC, feature"), ops=(59,))
def q_sort_mi(spark, sf):
    return _mi(spark, sf).orderBy(F.desc("mi"), "feature")


@register("quantile_threshold_select", "feature string, mi double", with_ctes("misel", "SELECT * FROM misel"),
          ops=(46,))
def q_qsel(spark, sf):
    return SEL.quantile_threshold_select(_mi(spark, sf), "mi")


@register("mean_threshold_select", "feature string, mi double",
          with_ctes("misel", "SELECT * FROM mi WHERE mi > (SELECT avg(mi) FROM mi)"), ops=(47,))
def q_msel(spark, sf):
    return SEL.mean_threshold_select(_mi(spark, sf), "mi")


@register("sorted_selected_features", "feature string, position int",
          with_ctes("misel", "SELECT feature, CAST(row_number() OVER (ORDER BY feature) - 1 AS INTEGER) AS position "
                             "FROM misel"), ops=(61,))
def q_sorted_sel(spark, sf):
    return SEL.sorted_selection(SEL.quantile_threshold_select(_mi(spark, sf), "mi"))
