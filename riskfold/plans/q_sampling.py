"""Registered queries: synthetic oversampling and its before/after counts."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..functions.draws import md5_uniform_sql
from ..operators.smote import oversample_counts, smote
from . import pipeline as PL
from .oracle_sql import cte, with_ctes
from .registry import register

ALL = C.ALL_FEATURES


def _dist_sql(a, b):
    return "sqrt(" + " + ".join(f"({a}.{f} - {b}.{f}) * ({a}.{f} - {b}.{f})" for f in ALL) + ")"


cte("smbase", "SELECT borrower_id, Credit_Score, " + ", ".join(ALL) + " FROM scaled WHERE split = 'train'")
cte("smcounts", "SELECT Credit_Score AS cls, count(*) AS n FROM smbase GROUP BY 1")
cte("smnn", f"""
SELECT * FROM (
  SELECT q.borrower_id AS qid, r.borrower_id AS rid,
         row_number() OVER (PARTITION BY q.borrower_id ORDER BY {_dist_sql('q', 'r')}, r.borrower_id) AS nn_rank
  FROM smbase q JOIN smbase r ON q.Credit_Score = r.Credit_Score AND q.borrower_id <> r.borrower_id) t
WHERE nn_rank <= {C.SMOTE_K}""")
cte("smranked", "SELECT *, row_number() OVER (PARTITION BY Credit_Score "
                "ORDER BY md5(CAST(borrower_id AS VARCHAR) || '-42')) - 1 AS base_rank FROM smbase")
_U = {p: md5_uniform_sql("CAST(cls AS VARCHAR)", "CAST(i AS VARCHAR)", "'42'", f"'{p}'")
      for p in ("base", "nn", "gap")}
cte("smdraw", f"""
SELECT cls, i, CAST(floor({_U['base']} * n) AS BIGINT) AS base_rank,
       CAST(floor({_U['nn']} * least({C.SMOTE_K}, n - 1)) AS INTEGER) + 1 AS nn_rank,
       {_U['gap']} AS gap
FROM (SELECT c.cls, c.n, r.i FROM smcounts c,
             range(0, (SELECT max(n) FROM smcounts)) r(i)
      WHERE r.i < (SELECT max(n) FROM smcounts) - c.n AND c.n > 1) q""")
cte("smsynth", "SELECT -(1 + d.i * 3 + d.cls) AS borrower_id, d.cls AS Credit_Score, " + ", ".join(
    f"x.{f} + d.gap * (y.{f} - x.{f}) AS {f}" for f in ALL) + """, 'synthetic' AS source
FROM smdraw d JOIN smranked x ON x.Credit_Score = d.cls AND x.base_rank = d.base_rank
JOIN smnn n ON n.qid = x.borrower_id AND n.nn_rank = d.nn_rank
JOIN smbase y ON y.borrower_id = n.rid""")
cte("smote", "SELECT borrower_id, Credit_Score, " + ", ".join(ALL) + ", 'original' AS source FROM smbase "
             "UNION ALL SELECT * FROM smsynth")

_SMOTE_SCHEMA = "borrower_id bigint, Credit_Score int, " + ", ".join(f"{f} double" for f in ALL) + ", source string"


def _smote(spark, sf):
    df, _ = PL.prepared(spark, sf)
    return smote(df.filter(F.col("split") == "train"), ALL)


@register("smote_oversample", _SMOTE_SCHEMA, with_ctes("smote", "SELECT * FROM smote"), ops=(93,))
def q_smote(spark, sf):
    return _smote(spark, sf)


@register("union_original_synthetic", "source string, Credit_Score int, n bigint",
          with_ctes("smote", "SELECT source, Credit_Score, count(*) AS n FROM smote GROUP BY 1, 2"), ops=(63,))
def q_union_os(spark, sf):
    return _smote(spark, sf).groupBy("source", C.LABEL).agg(F.count(F.lit(1)).alias("n"))


_COUNTS_SQL = ("SELECT Credit_Score, count(*) AS n, 'before' AS phase FROM smbase GROUP BY 1 "
               "UNION ALL SELECT Credit_Score, count(*) AS n, 'after' AS phase FROM smote GROUP BY 1")


@register("oversample_counts", "Credit_Score int, n bigint, phase string", with_ctes("smote", _COUNTS_SQL),
          ops=(38,))
def q_counts(spark, sf):
    df, _ = PL.prepared(spark, sf)
    tr = df.filter(F.col("split") == "train")
    return oversample_counts(tr, smote(tr, ALL))


@register("union_before_after", "class_name string, n bigint, phase string",
          with_ctes("smote", "SELECT CASE Credit_Score WHEN 0 THEN 'Poor' WHEN 1 THEN 'Standard' "
                             "WHEN 2 THEN 'Good' END || ' ' || phase AS class_name, n, phase "
                             f"FROM ({_COUNTS_SQL}) t"), ops=(62,))
def q_union_ba(spark, sf):
    from ..functions.rules import label_name
    c = q_counts(spark, sf)
    return c.select(F.concat_ws(" ", label_name(C.LABEL), F.col("phase")).alias("class_name"), "n", "phase")
