"""Classifiers and the learning curve.

Random forests, extra trees on pre-drawn split points and one-vs-rest gradient-
boosted trees (three binary models give normalised class probabilities) are
histogram trees (trees.py). The other fits are Spark MLlib estimators on an
assembled feature vector: multinomial logistic regression and linear SVMs on
random Fourier features with a Platt step; and there are the deterministic
scorers (closed-form naive Bayes, exact kNN). Independent fits (folds, trials) run
concurrently from a thread pool: Spark schedules their jobs side by side.
"""
from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Callable

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from . import trees as TR
from .evaluate import roc_auc_ovr_macro
from .knn_model import knn_vote
from .naive_bayes import argmax_first, gaussian_nb_fit, gaussian_nb_score

N_CLASSES = 3
PARALLELISM = 8


def _vec(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="keep").transform(df)


def _finish(df: DataFrame, prob_cols: list, keep: list[str]) -> DataFrame:
    d = df.select(*keep, *[c.alias(f"p{k}") for k, c in enumerate(prob_cols)])
    return d.withColumn("pred", argmax_first([F.col(f"p{k}") for k in range(N_CLASSES)]).cast("int"))


@dataclass
class Fitted:
    name: str
    predict: Callable[[DataFrame], DataFrame]   # rows -> rows + p0..p2, pred
    info: dict = field(default_factory=dict)


# --------------------------------------------------------------------------
# individual model families
# --------------------------------------------------------------------------
def fit_logistic(train: DataFrame, features: list[str], C_: float = 1.0, max_iter: int = 2000,
                 label: str = C.LABEL) -> Fitted:
    n = train.count()
    est = LogisticRegression(featuresCol="features", labelCol=label, family="multinomial", maxIter=max_iter,
                             regParam=1.0 / (C_ * n), elasticNetParam=0.0, standardization=False)
    m = est.fit(_vec(train, features))

    def predict(df):
        out = m.transform(_vec(df, features))
        arr = vector_to_array("probability")
        return _finish(out, [arr[k] for k in range(N_CLASSES)], df.columns)
    return Fitted("Logistic Regression", predict, {"coefficients": m.coefficientMatrix.toArray().tolist(),
                                                   "intercepts": list(m.interceptVector)})


def fit_forest(train: DataFrame, features: list[str], num_trees: int = 200, max_depth: int = 10,
               min_leaf: int = 1, bootstrap: bool = True, subset: str = "auto", seed: int = C.SEED,
               label: str = C.LABEL, name: str = "Random Forest", subsample: float = 1.0,
               min_gain: float = 0.0) -> Fitted:
    """A random forest of histogram trees (see trees.py)."""
    shape = TR.Shape(num_trees, max_depth, min_leaf, min_gain, TR.subset_size(subset, len(features)), bootstrap,
                     subsample, seed)
    cuts, n = TR.cut_points(train, features)
    trees = TR.grow_forest(TR.binned(train, features, cuts, label, []), n, len(features), N_CLASSES, shape)
    spark = train.sparkSession
    info = _Info({"model": lambda: TR.as_mllib(spark, trees, cuts, shape, N_CLASSES, label)}, {
        "importances": dict(zip(features, TR.importances(trees, len(features)).tolist())), "features": list(features)})
    return Fitted(name, _share_scorer(TR.ForestShares(trees, max_depth), features, cuts), info)


class _Info(dict):
    """What is known of a model; ``late`` values are made when first asked for."""

    def __init__(self, late: dict[str, Callable], known: dict):
        super().__init__(known)
        self.late = late

    def __missing__(self, key):
        self[key] = self.late[key]()
        return self[key]


def _share_scorer(shares, features: list[str], cuts) -> Callable[[DataFrame], DataFrame]:
    score = TR.scorer(shares, features, cuts, N_CLASSES)

    def predict(df):
        return _finish(score(df), [F.col(f"p{k}") for k in range(N_CLASSES)], df.columns)
    return predict


def forest_scorer(model, features: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Rows -> rows with the forest's probabilities and prediction."""
    def predict(df):
        out = model.transform(_vec(df, features))
        arr = vector_to_array("probability")
        return _finish(out, [arr[k] for k in range(N_CLASSES)], df.columns)
    return predict


def random_cuts(lo: np.ndarray, hi: np.ndarray, n_cuts: int, draw: int, seed: int = C.SEED) -> list[list[float]]:
    """Split points of one draw: per feature ``n_cuts`` uniform ones in (lo, hi)."""
    u = np.random.default_rng([seed, draw]).uniform(size=(len(lo), n_cuts))
    return [sorted({float(a + x * (b - a)) for x in row if a < b}) for a, b, row in zip(lo, hi, u)]


def fit_extra_trees(train: DataFrame, features: list[str], num_trees: int = 200, max_depth: int = 10,
                    min_leaf: int = 1, trees_per_draw: int = 10, n_cuts: int = 16, seed: int = C.SEED,
                    label: str = C.LABEL, name: str = "Extra Trees") -> Fitted:
    """Extremely randomised trees: no bootstrap, sqrt(features) a node and random
    split points, which are drawn first: each draw has ``n_cuts`` uniform points a
    feature, and ``trees_per_draw`` trees are fitted on the codes of a draw (the
    number of its points below a value), which can be split at the drawn points
    only. Blocks hold codes between the points of all draws; a draw's are looked
    up in these."""
    ends = train.agg(*[F.min(f).alias(f"lo_{f}") for f in features], *[F.max(f).alias(f"hi_{f}") for f in features],
                     F.count(F.lit(1)).alias("n")).first()
    lo, hi = (np.array([float(ends[f"{e}_{f}"]) for f in features]) for e in ("lo", "hi"))
    n_draws = math.ceil(num_trees / trees_per_draw)
    cuts = [random_cuts(lo, hi, n_cuts, d, seed) for d in range(n_draws)]
    every = [np.array(sorted({x for draw in cuts for x in draw[j]})) for j in range(len(features))]
    # a code of all draws stands for values above its split point number code - 1
    tables = [[np.searchsorted(np.array(draw[j]), np.append(every[j], np.inf), side="left").astype(np.uint8)
               for j in range(len(features))] for draw in cuts]
    n_sub = TR.subset_size("sqrt", len(features))
    shapes = [TR.Shape(min(trees_per_draw, num_trees - d * trees_per_draw), max_depth, min_leaf, 0.0, n_sub, False, 1.0,
                       seed + d) for d in range(n_draws)]
    draws = TR.grow_forests(TR.binned(train, features, every, label, []), 2 * ends["n"], len(features), N_CLASSES,
                            [(TR.DrawnRows(t), s) for t, s in zip(tables, shapes)])
    spark = train.sparkSession

    def members():
        """MLlib models of the draws, on their codes."""
        return [TR.as_mllib(spark, trees, [np.arange(len(c)) + 0.5 for c in draw], s, N_CLASSES, label)
                for trees, draw, s in zip(draws, cuts, shapes)]
    return Fitted(name, _share_scorer(TR.DrawnShares(draws, tables, max_depth), features, every),
                  _Info({"members": members}, {"draws": n_draws}))


def fit_ovr_gbt(train: DataFrame, features: list[str], max_iter: int = 100, max_depth: int = 5,
                step: float = 0.08, subsample: float = 1.0, subset: str = "all", min_leaf: int = 1,
                seed: int = C.SEED, label: str = C.LABEL, name: str = "Gradient Boosting") -> Fitted:
    """Three boosted models (class k vs rest) of histogram trees (see trees.py);
    the class probabilities are the members' positive-class probabilities
    normalised to sum to one."""
    shape = TR.Shape(max_iter, max_depth, min_leaf, 0.0, TR.subset_size(subset, len(features)), False, subsample, seed)
    cuts, n = TR.cut_points(train, features)
    members = TR.grow_boosted(TR.binned(train, features, cuts, label, []), n, len(features), N_CLASSES, shape, step)
    imp = np.mean([TR.importances(m, len(features), classes=False) for m in members], axis=0)
    return Fitted(name, _share_scorer(TR.BoostedShares(members, max_depth, step), features, cuts),
                  {"importances": dict(zip(features, imp.tolist()))})


def _rff_params(d: int, gamma: float, n_comp: int, seed: int):
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2 * gamma), size=(d, n_comp))
    b = rng.uniform(0.0, 2 * math.pi, size=n_comp)
    return w, b


def random_fourier_features(df: DataFrame, features: list[str], w: np.ndarray, b: np.ndarray,
                            keep: list[str]) -> DataFrame:
    """z(x) = sqrt(2/D) cos(x W + b), computed with numpy per Arrow batch."""
    from ..session import ship_package
    ship_package(df.sparkSession)
    n_comp = w.shape[1]
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]
                       + [f"__z{i} double" for i in range(n_comp)])
    scale = math.sqrt(2.0 / n_comp)

    def fn(batches):
        for pdf in batches:
            x = pdf[features].to_numpy(dtype=np.float64)
            z = scale * np.cos(x @ w + b)
            out = pdf[keep].reset_index(drop=True)
            out = pd.concat([out, pd.DataFrame(z, columns=[f"__z{i}" for i in range(n_comp)])], axis=1)
            yield out
    return df.select(*keep, *[f for f in features if f not in keep]).mapInPandas(fn, schema)


def calibration_half(id_col: str = C.ID, seed: int = C.SEED):
    """0 or 1: the half of a training row in the Platt step."""
    from ..functions.draws import md5_uniform
    return (md5_uniform(F.col(id_col), seed, "platt") * 2).cast("int")


def fit_svm_rff(train: DataFrame, features: list[str], C_: float = 1.0, n_comp: int = 200,
                seed: int = C.SEED, label: str = C.LABEL) -> Fitted:
    """RBF-kernel SVM approximated by random Fourier features (gamma='scale'
    = 1 / (d * var(X))), one linear SVM per class, Platt scaling by a
    one-feature logistic fit on margins of rows that the scoring machine was not
    fitted on (two halves by md5), probabilities normalised."""
    d = len(features)
    stats = train.agg(*[F.var_pop(f).alias(f) for f in features]).first()
    means = train.agg(*[F.avg(f).alias(f) for f in features]).first()
    # var(X) over all entries = mean of per-feature (var + mean^2) - overall mean^2
    m_all = float(np.mean([means[f] for f in features]))
    var = float(np.mean([stats[f] + means[f] ** 2 for f in features]) - m_all ** 2) or 1.0
    gamma = 1.0 / (d * var)
    w, b = _rff_params(d, gamma, n_comp, seed)
    zcols = [f"__z{i}" for i in range(n_comp)]
    ztr = random_fourier_features(train, features, w, b, keep=[C.ID, label])
    ztr = _vec(ztr, zcols).select(C.ID, label, "features").cache()
    n = ztr.count()

    def svm(rows, n_rows):
        return LinearSVC(featuresCol="features", labelCol="__yb", regParam=1.0 / (C_ * n_rows), maxIter=50).fit(rows)

    def margin(m, rows):
        return (m.transform(rows).withColumn("__m", vector_to_array("rawPrediction")[1])
                .drop("rawPrediction", "prediction"))

    def one(k):
        dk = ztr.withColumn("__yb", (F.col(label) == k).cast("double"))
        # out-of-fold margins: each half is scored by the machine of the other half
        halves = [dk.where(calibration_half(C.ID, seed) == h) for h in (0, 1)]
        margins = [margin(svm(halves[1 - h], n / 2), halves[h]) for h in (0, 1)]
        platt = LogisticRegression(featuresCol="__mv", labelCol="__yb", regParam=0.0).fit(
            _vec(margins[0].unionByName(margins[1]), ["__m"], "__mv"))
        return svm(dk, n), platt
    with ThreadPoolExecutor(N_CLASSES) as ex:
        members = list(ex.map(one, range(N_CLASSES)))
    ztr.unpersist()

    def predict(df):
        z = random_fourier_features(df, features, w, b, keep=df.columns)
        out = _vec(z, zcols)
        for k, (svm, platt) in enumerate(members):
            out = svm.setRawPredictionCol(f"__r{k}").setPredictionCol(f"__s{k}").transform(out)
            out = out.withColumn(f"__m{k}", vector_to_array(f"__r{k}")[1])
            out = _vec(out, [f"__m{k}"], f"__mv{k}")
            out = platt.setFeaturesCol(f"__mv{k}").setProbabilityCol(f"__pp{k}") \
                       .setRawPredictionCol(f"__pr{k}").setPredictionCol(f"__pd{k}").transform(out)
            out = out.withColumn(f"__q{k}", vector_to_array(f"__pp{k}")[1])
        tot = F.col("__q0") + F.col("__q1") + F.col("__q2")
        return _finish(out, [F.col(f"__q{k}") / tot for k in range(N_CLASSES)], df.columns)
    return Fitted("SVM", predict, {"gamma": gamma, "components": n_comp})


def fit_naive_bayes(train: DataFrame, features: list[str], label: str = C.LABEL) -> Fitted:
    nb = gaussian_nb_fit(train, features, label)
    return Fitted("Naive Bayes", lambda df: gaussian_nb_score(df, nb))


def fit_knn(train: DataFrame, features: list[str], k: int = C.KNN_K, label: str = C.LABEL) -> Fitted:
    ref = train.select(C.ID, label, *features)
    return Fitted("KNN", lambda df: knn_vote(df, ref, features, k=k, label=label))


# reference settings per model (app variant); MLlib grows level by level, so the
# leaf-wise booster's settings run as what they are here: 200 rounds of depth 6
MODEL_BUILDERS: dict[str, Callable[[DataFrame, list[str]], Fitted]] = {
    "Logistic Regression": lambda tr, f: fit_logistic(tr, f, 1.0, 2000),
    "Random Forest": lambda tr, f: fit_forest(tr, f, 200, 10, 4),
    "Extra Trees": lambda tr, f: fit_extra_trees(tr, f, 200, 10, 1),
    "Gradient Boosting": lambda tr, f: fit_ovr_gbt(tr, f, 100, 5, 0.08),
    "Gradient Boosting (200 rounds)": lambda tr, f: fit_ovr_gbt(tr, f, 200, 6, 0.05,
                                                                name="Gradient Boosting (200 rounds)"),
    "Naive Bayes": fit_naive_bayes,
    "KNN": fit_knn,
    "SVM": lambda tr, f: fit_svm_rff(tr, f, 1.0),
}


def tuned_boosting(params: dict, name: str = "Gradient Boosting (tuned trees)"):
    """One-vs-rest boosting of trees shaped like those of the search's winner
    (depth, row and feature share, least rows of a leaf), rounds and step of
    the plain booster."""
    return lambda tr, f: fit_ovr_gbt(tr, f, 100, int(params["maxDepth"]), 0.08, float(params["subsamplingRate"]),
                                     str(round(float(params["featureShare"]), 6)), int(params["minInstancesPerNode"]),
                                     name=name)


def scored_rows(fitted: Fitted, rows: DataFrame, label: str = C.LABEL) -> DataFrame:
    out = fitted.predict(rows)
    return out.select(F.lit(fitted.name).alias("model"), C.ID, "split", F.col(label).alias("y"),
                      "pred", "p0", "p1", "p2")


# --------------------------------------------------------------------------
# learning curve
# --------------------------------------------------------------------------
def learning_curve(builder, cv_train: DataFrame, valid: DataFrame, features: list[str], fold_col: str, k: int = 5,
                   sizes=tuple(np.linspace(0.1, 1.0, 8)), parallelism: int = PARALLELISM) -> DataFrame:
    """Train and validation AUC for nested training subsets (the first share of
    each fold's training rows by md5). ``cv_train``: see crossval.fold_training."""
    from ..functions.draws import md5_uniform
    from ..session import cut_lineage
    d = cv_train.drop("source").withColumn("__u", md5_uniform(F.col(C.ID), C.SEED, "lc"))
    jobs = [(i, f) for i in range(len(sizes)) for f in range(k)]

    def one(job):
        i, f = job
        tr = d.filter((F.col("cv_fold") == f) & (F.col("__u") < float(sizes[i]))).drop("cv_fold", "__u")
        m = builder(tr, features)
        both = (tr.select(*features, C.LABEL, F.lit("train").alias("part"))
                .unionByName(valid.filter(F.col(fold_col) == f).select(*features, C.LABEL, F.lit("val").alias("part"))))
        return m.predict(both).select(F.concat_ws("|", F.lit(str(i)), F.lit(str(f)), "part").alias("model"),
                                      F.col(C.LABEL).alias("y"), "pred", "p0", "p1", "p2")
    with ThreadPoolExecutor(parallelism) as ex:
        parts = list(ex.map(one, jobs))
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    scored = cut_lineage(scored, "learning-curve")
    key = F.split("model", "[|]")
    got = roc_auc_ovr_macro(scored).join(scored.groupBy("model").agg(F.count(F.lit(1)).alias("n")), "model")
    share = F.element_at(F.array(*[F.lit(float(s)) for s in sizes]), key[0].cast("int") + 1)
    pick = lambda part, c: F.max(F.when(F.col("part") == part, F.col(c)))
    return (got.select(share.alias("train_share"), key[1].cast("int").alias("fold"), key[2].alias("part"), "n", "roc_auc")
            .groupBy("train_share", "fold")
            .agg(pick("train", "n").alias("n_train"), pick("train", "roc_auc").alias("train_auc"),
                 pick("val", "roc_auc").alias("val_auc")))
