"""Training plan: prepared table -> features kept by the elimination ->
oversampled training rows -> every model -> ledger, cross-validation, search,
ensembles.

Results are memoised per (Spark application, data set): like the reference's
cached pipeline run, every query over models reuses one training run. Large
intermediate tables (oversampled rows, predictions, out-of-fold predictions)
are written once to the shared checkpoint folder.
"""
from __future__ import annotations

import threading
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import crossval as CV
from ..operators import evaluate as EV
from ..operators import models as M
from ..operators import search as SE
from ..operators.ensemble import soft_vote
from ..operators.rfe import rfecv
from ..operators.smote import smote
from ..session import cut_lineage
from . import pipeline as PL

_MEMO: dict = {}
_LOCK = threading.RLock()
FOLDS, SEARCH_FOLDS = 5, 3
TUNED_FOREST = "Random Forest (tuned)"
TUNED_BOOSTING = "Gradient Boosting (tuned trees)"
BASE_MODELS = [*M.MODEL_BUILDERS, TUNED_FOREST, TUNED_BOOSTING]
# also in a ledger and a cross-validation of their own
BOOSTERS = ["Gradient Boosting", "Gradient Boosting (200 rounds)", TUNED_BOOSTING]


def _key(spark: SparkSession, sf: str, what: str):
    return (spark.sparkContext.applicationId, sf, what)


_KEY_LOCKS: dict = {}


def _memo(spark, sf, what, fn):
    """Build once per key; a lock per key, so builds that fan out to other
    keys on worker threads never wait on a lock their caller holds."""
    k = _key(spark, sf, what)
    with _LOCK:
        lock = _KEY_LOCKS.setdefault(k, threading.Lock())
    with lock:
        if k not in _MEMO:
            _MEMO[k] = fn()
        return _MEMO[k]


def train_table(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, object]:
    """(training rows of all features in fit order, prepared table, its state)."""
    def build():
        df, state = PL.prepared(spark, sf)
        return CV.fit_table(df.filter(F.col("split") == "train"), "train-rows", [C.ID]), df, state
    return _memo(spark, sf, "train-rows", build)


def elimination(spark: SparkSession, sf: str):
    """(selected features, curve, paths) of the recursive elimination."""
    train = train_table(spark, sf)[0]
    return _memo(spark, sf, "rfecv", lambda: rfecv(train, C.ALL_FEATURES, "fold3", SEARCH_FOLDS))


def base(spark: SparkSession, sf: str) -> dict:
    """Prepared table, kept features, training rows, oversampled training rows, test rows."""
    def build():
        train, df, state = train_table(spark, sf)
        sel = elimination(spark, sf)[0]
        rows = train.select(C.ID, C.LABEL, "fold5", "fold3", *sel)
        sm = CV.fit_table(smote(rows, sel), "oversampled", [C.ID])
        test = df.filter(F.col("split") == "test").select(C.ID, C.LABEL, "split", *sel)
        return {"prepared": df, "state": state, "features": sel, "rows": rows, "train": sm, "test": test}
    return _memo(spark, sf, "base", build)


def folds(spark: SparkSession, sf: str, k: int) -> DataFrame:
    """Oversampled training rows of each of the k folds."""
    b = base(spark, sf)
    return _memo(spark, sf, f"folds:{k}", lambda: CV.fold_training(b["rows"], b["features"], f"fold{k}", k))


def trials(spark: SparkSession, sf: str) -> list[SE.Trial]:
    b = base(spark, sf)

    def build():
        evaluate = SE.forest_trials(folds(spark, sf, SEARCH_FOLDS), b["rows"], b["features"], f"fold{SEARCH_FOLDS}",
                                    SEARCH_FOLDS)
        return SE.search(evaluate)
    return _memo(spark, sf, "trials", build)


def builder(spark: SparkSession, sf: str, name: str):
    if name in (TUNED_FOREST, TUNED_BOOSTING):
        best = SE.best_trial(trials(spark, sf)).params
        return SE.forest_builder(best, name) if name == TUNED_FOREST else M.tuned_boosting(best, name)
    return M.MODEL_BUILDERS[name]


def fitted(spark: SparkSession, sf: str, name: str) -> M.Fitted:
    b = base(spark, sf)
    return _memo(spark, sf, f"fit:{name}", lambda: builder(spark, sf, name)(b["train"].drop("source"), b["features"]))


def model_scored(spark: SparkSession, sf: str, name: str) -> DataFrame:
    b = base(spark, sf)
    return _memo(spark, sf, f"scored:{name}", lambda: cut_lineage(
        M.scored_rows(fitted(spark, sf, name), b["test"]), "scored-model"))


def _union(parts: list[DataFrame]) -> DataFrame:
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u


def all_base_scored(spark: SparkSession, sf: str) -> DataFrame:
    def build():
        base(spark, sf)
        with ThreadPoolExecutor(len(BASE_MODELS)) as ex:
            return cut_lineage(_union(list(ex.map(lambda n: model_scored(spark, sf, n), BASE_MODELS))), "scored-base")
    return _memo(spark, sf, "scored:base", build)


def top4(spark: SparkSession, sf: str) -> list[str]:
    return _memo(spark, sf, "top4", lambda: [r["model"] for r in EV.top_models(
        EV.roc_auc_ovr_macro(all_base_scored(spark, sf)), 4).collect()])


def voting(spark: SparkSession, sf: str) -> DataFrame:
    members = spark.createDataFrame([(m,) for m in top4(spark, sf)], "model string")
    return soft_vote(all_base_scored(spark, sf), members, "Voting Ensemble")


def member_oof(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """Out-of-fold predictions of one model for every training row."""
    b = base(spark, sf)
    return _memo(spark, sf, f"oof:{name}", lambda: CV.out_of_fold(
        name, builder(spark, sf, name), folds(spark, sf, FOLDS), b["rows"], b["features"], f"fold{FOLDS}", FOLDS))


def oof(spark: SparkSession, sf: str, names: list[str]) -> DataFrame:
    folds(spark, sf, FOLDS)
    with ThreadPoolExecutor(4) as ex:
        return _union(list(ex.map(lambda n: member_oof(spark, sf, n), names)))


def stacked(spark: SparkSession, sf: str) -> DataFrame:
    def build():
        names = top4(spark, sf)
        return cut_lineage(CV.stacking(oof(spark, sf, names), all_base_scored(spark, sf), names), "scored-stacking")
    return _memo(spark, sf, "scored:stacking", build)


def all_scored(spark: SparkSession, sf: str) -> DataFrame:
    return all_base_scored(spark, sf).unionByName(voting(spark, sf)).unionByName(stacked(spark, sf))


def cv_results(spark: SparkSession, sf: str) -> DataFrame:
    """(model, fold, roc_auc) of all models and both ensembles."""
    def build():
        names = top4(spark, sf)
        rows = oof(spark, sf, BASE_MODELS)
        members = cut_lineage(rows.where(F.col("model").isin(names)), "oof-members")
        every = rows.unionByName(CV.vote_oof(members, names)).unionByName(CV.stacking_oof(members, names, FOLDS))
        return cut_lineage(CV.fold_scores(every), "cv")
    return _memo(spark, sf, "cv", build)


def boosting_cv(spark: SparkSession, sf: str) -> DataFrame:
    """(model, fold, roc_auc) of the boosters."""
    return _memo(spark, sf, "cv-boosting", lambda: cut_lineage(CV.fold_scores(oof(spark, sf, BOOSTERS)), "cv"))


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    """One row a model: test metrics, cross-validated mean and deviation."""
    return EV.metrics_table(all_scored(spark, sf)).join(EV.cv_mean_std(cv_results(spark, sf)), "model")


def boosting_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Test metrics of the boosters."""
    def build():
        base(spark, sf)
        with ThreadPoolExecutor(len(BOOSTERS)) as ex:
            return cut_lineage(_union(list(ex.map(lambda n: model_scored(spark, sf, n), BOOSTERS))), "scored-boosters")
    return EV.metrics_table(_memo(spark, sf, "scored:boosters", build))


def winner(spark: SparkSession, sf: str) -> str:
    """The single model of the best AUC (ensembles aside)."""
    return top4(spark, sf)[0]
