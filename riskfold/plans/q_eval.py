"""Registered queries: deterministic scorers (closed-form Gaussian naive Bayes,
exact kNN, soft voting) and every evaluation metric over their predictions.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..operators import evaluate as EV
from . import scorers as SC
from .oracle_sql import cte, label_name_sql, with_ctes
from .registry import register

ALL = C.ALL_FEATURES
K = [0, 1, 2]


def _j(parts, sep=",\n  "):
    return sep.join(parts)


# ---------------------------------------------------------------- NB in SQL
_nb_aggs = ["count(*) AS n"]
for _k in K:
    _nb_aggs.append(f"count(CASE WHEN Credit_Score = {_k} THEN 1 END) AS n_{_k}")
    for _f in ALL:
        _nb_aggs.append(f"avg(CASE WHEN Credit_Score = {_k} THEN {_f} END) AS m_{_k}_{_f}")
        _nb_aggs.append(f"var_pop(CASE WHEN Credit_Score = {_k} THEN {_f} END) AS v_{_k}_{_f}")
_nb_aggs.append("1e-9 * greatest(" + ", ".join(f"var_pop({f})" for f in ALL) + ") AS eps")
cte("nbraw", "SELECT " + _j(_nb_aggs) + " FROM scaled WHERE split = 'train'")
cte("nbstats", "SELECT n, eps, " + _j(
    [f"n_{k}" for k in K] + [f"m_{k}_{f}" for k in K for f in ALL]
    + [f"coalesce(v_{k}_{f}, 0e0) + eps AS v_{k}_{f}" for k in K for f in ALL]) + " FROM nbraw")


def _jll_sql(k):
    const = (f"ln(CAST(st.n_{k} AS DOUBLE) / st.n) - 0.5 * ("
             + " + ".join(f"ln(2 * pi() * st.v_{k}_{f})" for f in ALL) + ")")
    quad = " + ".join(f"(s.{f} - st.m_{k}_{f}) * (s.{f} - st.m_{k}_{f}) / st.v_{k}_{f}" for f in ALL)
    return f"({const}) - 0.5 * ({quad})"


def _argmax_sql(a, b, c):
    return (f"CASE WHEN {a} >= {b} AND {a} >= {c} THEN 0 WHEN {b} >= {c} THEN 1 ELSE 2 END")


cte("nbjll", "SELECT s.borrower_id, s.split, s.Credit_Score AS y, " + _j(
    [f"{_jll_sql(k)} AS j{k}" for k in K]) + " FROM scaled s, nbstats st")


def _softmax_sql(prefix, src):
    mx = f"greatest({prefix}0, {prefix}1, {prefix}2)"
    ex = [f"exp({prefix}{k} - {mx})" for k in K]
    tot = " + ".join(f"({e})" for e in ex)
    return _j([f"({e}) / ({tot}) AS p{k}" for k, e in enumerate(ex)])


cte("nbscored", f"""
SELECT 'Naive Bayes' AS model, borrower_id, split, y,
  CAST({_argmax_sql('j0', 'j1', 'j2')} AS INTEGER) AS pred,
  {_softmax_sql('j', 'nbjll')}
FROM nbjll""")

# ---------------------------------------------------------------- kNN in SQL (brute force)
def _dist_sql(a, b, feats=ALL):
    return "sqrt(" + " + ".join(f"({a}.{f} - {b}.{f}) * ({a}.{f} - {b}.{f})" for f in feats) + ")"


cte("knnnb", f"""
SELECT * FROM (
  SELECT q.borrower_id AS qid, q.Credit_Score AS y, r.borrower_id AS rid, r.Credit_Score AS rlab,
         {_dist_sql('q', 'r')} AS dist,
         row_number() OVER (PARTITION BY q.borrower_id ORDER BY {_dist_sql('q', 'r')}, r.borrower_id) AS nn_rank
  FROM scaled q JOIN scaled r ON r.split = 'train' WHERE q.split = 'test') t
WHERE nn_rank <= {C.KNN_K}""")

cte("knnscored", f"""
SELECT 'KNN' AS model, qid AS borrower_id, 'test' AS split, y,
  CAST({_argmax_sql('n0', 'n1', 'n2')} AS INTEGER) AS pred,
  n0 / {C.KNN_K}e0 AS p0, n1 / {C.KNN_K}e0 AS p1, n2 / {C.KNN_K}e0 AS p2
FROM (SELECT qid, y, count(CASE WHEN rlab = 0 THEN 1 END) AS n0, count(CASE WHEN rlab = 1 THEN 1 END) AS n1,
             count(CASE WHEN rlab = 2 THEN 1 END) AS n2 FROM knnnb GROUP BY qid, y) v""")

cte("basescored", "SELECT * FROM nbscored WHERE split = 'test' UNION ALL SELECT * FROM knnscored")

cte("votescored", f"""
SELECT 'Voting Ensemble' AS model, borrower_id, split, y,
  CAST({_argmax_sql('p0', 'p1', 'p2')} AS INTEGER) AS pred, p0, p1, p2
FROM (SELECT borrower_id, split, y, avg(p0) AS p0, avg(p1) AS p1, avg(p2) AS p2
      FROM basescored GROUP BY borrower_id, split, y) a""")

cte("scored", "SELECT * FROM basescored UNION ALL SELECT * FROM votescored")

SCORED_SCHEMA = "model string, borrower_id bigint, split string, y int, pred int, p0 double, p1 double, p2 double"


@register("model_naive_bayes", SCORED_SCHEMA, with_ctes("scored", "SELECT * FROM nbscored"), ops=(104,))
def q_nb(spark, sf):
    return SC.nb_scored(spark, sf, all_rows=True)


@register("knn_join", "borrower_id bigint, borrower_id_nn bigint, dist double, nn_rank int",
          with_ctes("scored", "SELECT qid AS borrower_id, rid AS borrower_id_nn, dist, CAST(nn_rank AS INTEGER) AS nn_rank "
                              "FROM knnnb"), ops=(24,))
def q_knn_join(spark, sf):
    return SC.knn_neighbours(spark, sf)


@register("model_knn", SCORED_SCHEMA, with_ctes("scored", "SELECT * FROM knnscored"), ops=(105,))
def q_knn(spark, sf):
    return SC.knn_scored(spark, sf)


@register("voting_soft", SCORED_SCHEMA, with_ctes("scored", "SELECT * FROM votescored"), ops=(107,))
def q_vote(spark, sf):
    return SC.scored(spark, sf).filter(F.col("model") == "Voting Ensemble")


# ---------------------------------------------------------------- metrics
T = "scored"


@register("confusion_matrix", "model string, y int, pred_0 bigint, pred_1 bigint, pred_2 bigint",
          with_ctes(T, "SELECT model, y, " + ", ".join(
              f"count(CASE WHEN pred = {k} THEN 1 END) AS pred_{k}" for k in K) + " FROM scored GROUP BY model, y"),
          ops=(39,))
def q_confusion(spark, sf):
    return EV.confusion_matrix(SC.scored(spark, sf))


@register("accuracy", "model string, accuracy double",
          with_ctes(T, "SELECT model, avg(CASE WHEN y = pred THEN 1e0 ELSE 0e0 END) AS accuracy FROM scored GROUP BY model"),
          ops=(40,))
def q_accuracy(spark, sf):
    return EV.accuracy(SC.scored(spark, sf))


_PC_SQL = """
pc AS (
  SELECT model, class, tp, fp, fn, support, precision, recall,
         CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0e0 END AS f1,
         support + fp > 0 AS present
  FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0e0 END AS precision,
                  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0e0 END AS recall
        FROM (SELECT model, k AS class,
                     sum(CASE WHEN y = k AND pred = k THEN 1 ELSE 0 END) AS tp,
                     sum(CASE WHEN y <> k AND pred = k THEN 1 ELSE 0 END) AS fp,
                     sum(CASE WHEN y = k AND pred <> k THEN 1 ELSE 0 END) AS fn,
                     sum(CASE WHEN y = k THEN 1 ELSE 0 END) AS support
              FROM scored, range(0, 3) r(k) GROUP BY model, k) c) d)"""

_MACRO_SQL = f"""
SELECT * FROM (WITH {_PC_SQL.strip()}
SELECT a.model, a.accuracy, m.precision_macro, m.recall_macro, m.f1_macro
FROM (SELECT model, avg(CASE WHEN y = pred THEN 1e0 ELSE 0e0 END) AS accuracy FROM scored GROUP BY model) a
JOIN (SELECT model, avg(precision) AS precision_macro, avg(recall) AS recall_macro, avg(f1) AS f1_macro
      FROM pc WHERE present GROUP BY model) m ON a.model = m.model) t"""


@register("precision_recall_f1_macro",
          "model string, accuracy double, precision_macro double, recall_macro double, f1_macro double",
          with_ctes(T, _MACRO_SQL), ops=(41,))
def q_macro(spark, sf):
    return EV.macro_metrics(SC.scored(spark, sf))


@register("classification_report",
          "model string, label string, precision double, recall double, f1 double, support bigint",
          with_ctes(T, f"""
SELECT * FROM (WITH {_PC_SQL.strip()}
SELECT model, {label_name_sql('class')} AS label, precision, recall, f1, support FROM pc
UNION ALL
SELECT model, 'accuracy', NULL, NULL, sum(tp) / sum(support), sum(support) FROM pc GROUP BY model
UNION ALL
SELECT model, 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM pc WHERE present GROUP BY model
UNION ALL
SELECT model, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
       sum(f1 * support) / sum(support), sum(support) FROM pc WHERE present GROUP BY model) t"""), ops=(42,))
def q_report(spark, sf):
    return EV.classification_report(SC.scored(spark, sf))


_HIST_SQL = """
hist AS (SELECT model, k AS class, CASE k WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS p,
                sum(CASE WHEN y = k THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN y = k THEN 0 ELSE 1 END) AS neg
         FROM scored, range(0, 3) r(k) GROUP BY 1, 2, 3),
cum AS (SELECT *, coalesce(sum(pos) OVER w, 0) AS before_pos, coalesce(sum(neg) OVER w, 0) AS before_neg
        FROM hist
        WINDOW w AS (PARTITION BY model, class ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""

_ROC_SQL = f"""
SELECT * FROM (WITH {_HIST_SQL.strip()}
SELECT c.model, c.class, c.p AS threshold, c.before_pos + c.pos AS tp, c.before_neg + c.neg AS fp,
       (c.before_pos + c.pos) / t.P AS tpr, (c.before_neg + c.neg) / t.N AS fpr
FROM cum c JOIN (SELECT model, class, sum(pos) AS P, sum(neg) AS N FROM hist GROUP BY 1, 2) t
ON c.model = t.model AND c.class = t.class
UNION ALL SELECT DISTINCT model, class, CAST('Infinity' AS DOUBLE), 0, 0, 0e0, 0e0 FROM hist) q"""

_ROC_SCHEMA = "model string, class int, threshold double, tp bigint, fp bigint, tpr double, fpr double"


@register("roc_curve", _ROC_SCHEMA, with_ctes(T, _ROC_SQL), ops=(43,))
def q_roc(spark, sf):
    return EV.roc_curve(SC.scored(spark, sf))


@register("cumulative_roc", "model string, class int, threshold double, tp bigint, fp bigint",
          with_ctes(T, f"SELECT model, class, threshold, tp, fp FROM ({_ROC_SQL}) r"), ops=(54,))
def q_cum_roc(spark, sf):
    return EV.roc_curve(SC.scored(spark, sf)).select("model", "class", "threshold", "tp", "fp")


_AUC_CLASS_SQL = f"""
SELECT * FROM (WITH {_HIST_SQL.strip()}
SELECT model, class, sum(neg * (before_pos + 0.5 * pos)) / (sum(pos) * sum(neg)) AS auc
FROM cum GROUP BY model, class) a"""


@register("roc_auc_by_class", "model string, class int, auc double", with_ctes(T, _AUC_CLASS_SQL), ops=(44,))
def q_auc_class(spark, sf):
    return EV.roc_auc_by_class(SC.scored(spark, sf))


_AUC_SQL = f"SELECT model, avg(auc) AS roc_auc FROM ({_AUC_CLASS_SQL}) b GROUP BY model"


@register("roc_auc_ovr_macro", "model string, roc_auc double", with_ctes(T, _AUC_SQL), ops=(44,))
def q_auc(spark, sf):
    return EV.roc_auc_ovr_macro(SC.scored(spark, sf))


@register("calibration_curve", "model string, class int, bin int, mean_predicted double, "
                               "fraction_positive double, n bigint",
          with_ctes(T, f"""
SELECT model, k AS class, CAST(greatest(ceil(p * 10) - 1, 0) AS INTEGER) AS bin, avg(p) AS mean_predicted,
       avg(CASE WHEN y = k THEN 1e0 ELSE 0e0 END) AS fraction_positive, count(*) AS n
FROM (SELECT model, y, k, CASE k WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS p
      FROM scored, range(0, 3) r(k)) o
GROUP BY 1, 2, 3"""), ops=(45,))
def q_calibration(spark, sf):
    return EV.calibration_curve(SC.scored(spark, sf))


_METRICS_SQL = f"""
SELECT m.*, a.roc_auc FROM ({_MACRO_SQL}) m JOIN ({_AUC_SQL}) a ON m.model = a.model"""
_METRICS_SCHEMA = ("model string, accuracy double, precision_macro double, recall_macro double, "
                   "f1_macro double, roc_auc double")


@register("leaderboard", _METRICS_SCHEMA,
          with_ctes(T, f"SELECT * FROM ({_METRICS_SQL}) x ORDER BY roc_auc DESC, model"), ops=(50, 59))
def q_leaderboard(spark, sf):
    return EV.leaderboard(EV.metrics_table(SC.scored(spark, sf)))


@register("best_model", "best_model string, roc_auc double",
          with_ctes(T, f"SELECT first(model ORDER BY roc_auc DESC, model) AS best_model, max(roc_auc) AS roc_auc FROM ({_METRICS_SQL}) x"),
          ops=(51,))
def q_best(spark, sf):
    return EV.best_model(EV.metrics_table(SC.scored(spark, sf)))


@register("top4_models", _METRICS_SCHEMA,
          with_ctes(T, f"SELECT * FROM ({_METRICS_SQL}) x ORDER BY roc_auc DESC, model LIMIT 4"), ops=(57,))
def q_top4(spark, sf):
    return EV.top_models(EV.metrics_table(SC.scored(spark, sf)), 4)


@register("top5_models", _METRICS_SCHEMA,
          with_ctes(T, f"SELECT * FROM ({_METRICS_SQL}) x ORDER BY roc_auc DESC, model LIMIT 5"), ops=(58,))
def q_top5(spark, sf):
    return EV.top_models(EV.metrics_table(SC.scored(spark, sf)), 5)
