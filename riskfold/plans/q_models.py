"""Registered queries over trained models (property-checked, no SQL)."""
from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import evaluate as EV
from ..operators import models as M
from ..operators import search as SE
from ..operators.rfe import forest_importance
from . import training as T
from .registry import register

SCORED = "model string, borrower_id bigint, split string, y int, pred int, p0 double, p1 double, p2 double"
METRICS = ("model string, accuracy double, precision_macro double, recall_macro double, f1_macro double, "
           "roc_auc double")


def _model_query(key, name, ops):
    def build(spark, sf):
        return T.model_scored(spark, sf, name)
    register(key, SCORED, None, ops=ops)(build)


for _key, _name, _op in [("model_logistic", "Logistic Regression", 98),
                         ("model_random_forest", "Random Forest", 99),
                         ("model_extra_trees", "Extra Trees", 100),
                         ("model_gradient_boosting", "Gradient Boosting", 101),
                         ("model_boosting_leafwise", "Gradient Boosting (200 rounds)", 102),
                         ("model_boosting_tuned", T.TUNED_BOOSTING, 103),
                         ("model_forest_tuned", T.TUNED_FOREST, 110),
                         ("model_svm", "SVM", 106)]:
    _model_query(_key, _name, (_op,))


@register("voting_ensemble_models", SCORED, None, ops=(107,))
def q_voting_models(spark, sf):
    return T.voting(spark, sf)


@register("stacking", SCORED, None, ops=(108,))
def q_stacking(spark, sf):
    return T.stacked(spark, sf)


@register("leaderboard_models", METRICS + ", cv_mean double, cv_std double", None, ops=(50, 51))
def q_leaderboard_models(spark, sf):
    return EV.leaderboard(T.ledger(spark, sf))


@register("leaderboard_boosting", METRICS, None, ops=(50,))
def q_leaderboard_boosting(spark, sf):
    return EV.leaderboard(T.boosting_ledger(spark, sf))


@register("cross_validate", "model string, fold int, roc_auc double", None, ops=(109,))
def q_cv(spark, sf):
    return T.cv_results(spark, sf)


@register("cross_validate_boosting", "model string, fold int, roc_auc double", None, ops=(109,))
def q_cv_boosting(spark, sf):
    return T.boosting_cv(spark, sf)


@register("cv_mean_std", "model string, cv_mean double, cv_std double", None, ops=(48,))
def q_cv_mean_std(spark, sf):
    return EV.cv_mean_std(T.cv_results(spark, sf))


_PARAMS = list(SE.SPACE)


@register("param_search", "number int, value double, rung int, row_share double, "
          + ", ".join(f"{p} double" for p in _PARAMS), None, ops=(110,))
def q_search(spark, sf):
    t = SE.history(spark, T.trials(spark, sf))
    return t.select("number", "value", "rung", "row_share", *[F.col("params")[p].alias(p) for p in _PARAMS])


@register("search_best_so_far", "number int, value double, rung int, best_so_far double", None, ops=(56,))
def q_best_so_far(spark, sf):
    # values are comparable on the same rows only: the best is that of the last rung
    t = SE.history(spark, T.trials(spark, sf))  # one row per trial: a single ordered window is bounded
    w = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    full = F.when(F.col("rung") == len(SE.RUNGS) - 1, F.col("value"))
    return t.select("number", "value", "rung", F.max(full).over(w).alias("best_so_far"))


@register("param_importance", "parameter string, importance double", None, ops=(111,))
def q_param_importance(spark, sf):
    # values of the first rung, on which all trials were measured
    rows = [(float(t.first), *[float(t.params[p]) for p in _PARAMS]) for t in T.trials(spark, sf)]
    t = spark.createDataFrame(rows, "value double, " + ", ".join(f"{p} double" for p in _PARAMS))
    v = VectorAssembler(inputCols=_PARAMS, outputCol="features").transform(t.coalesce(1))
    m = RandomForestRegressor(featuresCol="features", labelCol="value", numTrees=64, seed=C.SEED).fit(v)
    imp = m.featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(_PARAMS, [float(x) for x in imp])), "parameter string, importance double")


_CURVE = "train_share double, fold int, n_train bigint, train_auc double, val_auc double"


def _curve(spark, sf, name):
    b = T.base(spark, sf)
    return M.learning_curve(T.builder(spark, sf, name), T.folds(spark, sf, T.FOLDS), b["rows"], b["features"],
                            f"fold{T.FOLDS}", T.FOLDS)


@register("learning_curve", _CURVE, None, ops=(112,))
def q_learning_curve(spark, sf):
    """Of the logistic model, the cheapest to fit 40 times."""
    return _curve(spark, sf, "Logistic Regression")


@register("learning_curve_best", _CURVE, None, ops=(112,))
def q_learning_curve_best(spark, sf):
    """Of the best single model of the ledger."""
    return _curve(spark, sf, T.winner(spark, sf))


def _train_all(spark, sf):
    return T.train_table(spark, sf)[0]


@register("rf_importance", "feature string, importance double", None, ops=(95,))
def q_rf_importance(spark, sf):
    return forest_importance(_train_all(spark, sf), C.ALL_FEATURES)


@register("sort_importance", "feature string, importance double", None, ops=(59,))
def q_sort_importance(spark, sf):
    return forest_importance(_train_all(spark, sf), C.ALL_FEATURES).orderBy(F.desc("importance"), "feature")


@register("mean_threshold_select_rf", "feature string, importance double", None, ops=(47,))
def q_mean_sel_rf(spark, sf):
    from ..operators.selection import mean_threshold_select
    return mean_threshold_select(forest_importance(_train_all(spark, sf), C.ALL_FEATURES), "importance")


@register("rfecv", "n_features int, mean double, std double", None, ops=(96,))
def q_rfecv(spark, sf):
    return T.elimination(spark, sf)[1]


@register("rfecv_paths", "fold int, n_features int, f1 double, dropped string", None, ops=(96,))
def q_rfecv_paths(spark, sf):
    return T.elimination(spark, sf)[2]


@register("final_selection", "borrower_id bigint, feature string, value double", None, ops=(97,))
def q_final_selection(spark, sf):
    """The feature matrix that all models are trained on and scored with."""
    b = T.base(spark, sf)
    parts = [F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in b["features"]]
    return b["prepared"].select(C.ID, F.inline(F.array(*parts)))
