"""Cross-validation that oversamples inside the folds.

Oversampling before folding puts neighbours of validation rows among the
training rows. Here each fold's training rows are copied first (a row is in
the training set of all folds but its own) and every copy is balanced for
itself, so a synthetic row's parents are never in its validation fold. All
folds are oversampled in one pass.

``out_of_fold`` keeps one row per (model, training row): the prediction of the
model that did not see it. Fold scores, their mean and deviation, the cross-
validated vote and the stacking inputs all read this one table.
"""
from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..session import cut_lineage
from .evaluate import roc_auc_ovr_macro
from .smote import smote

FIT_BYTES = 4 << 20             # of a partition of a table that models are fitted on
OOF = ["model", C.ID, "fold", "y", "pred", "p0", "p1", "p2"]


def fit_table(df: DataFrame, name: str, order: list[str], width: int | None = None) -> DataFrame:
    """``df`` written in partitions of about FIT_BYTES and in a fixed order, so
    that a fit keeps the cores busy with full tasks and a rerun sees the same rows
    in each. ``width``: numbers a row, where a column holds a vector."""
    d = cut_lineage(df, name)
    n = max(1, math.ceil(d.count() * (width or len(d.columns)) * 8 / FIT_BYTES))
    return cut_lineage(d.repartition(n, *order).sortWithinPartitions(*order), name)


def fold_training(train: DataFrame, features: list[str], fold_col: str, k: int, label: str = C.LABEL,
                  id_col: str = C.ID) -> DataFrame:
    """(cv_fold, id, label, features, source): the oversampled training rows of
    each fold."""
    others = F.filter(F.sequence(F.lit(0), F.lit(k - 1)).cast("array<int>"), lambda x: x != F.col(fold_col))
    copies = train.select(id_col, label, *features, F.explode(others).alias("cv_fold"))
    return fit_table(smote(copies, features, label, id_col, within="cv_fold"), "cv-train", ["cv_fold", id_col])


def out_of_fold(name: str, builder, cv_train: DataFrame, valid: DataFrame, features: list[str], fold_col: str,
                k: int, label: str = C.LABEL, parallelism: int = 8) -> DataFrame:
    """(model, id, fold, y, pred, p0..p2) of every row of ``valid``, predicted by
    the model fitted on the other folds."""
    def one(f):
        m = builder(cv_train.where(F.col("cv_fold") == f).drop("cv_fold", "source"), features)
        return m.predict(valid.where(F.col(fold_col) == f)).select(
            F.lit(name).alias("model"), C.ID, F.lit(f).alias("fold"), F.col(label).alias("y"), "pred",
            "p0", "p1", "p2")
    with ThreadPoolExecutor(min(parallelism, k)) as ex:
        parts = list(ex.map(one, range(k)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return cut_lineage(out, "oof")


def fold_scores(oof: DataFrame) -> DataFrame:
    """(model, fold, roc_auc): one-vs-rest macro AUC of every fold."""
    key = F.concat_ws("\1", "model", F.col("fold").cast("string"))
    auc = roc_auc_ovr_macro(oof.withColumn("model", key))
    return auc.select(F.split("model", "\1")[0].alias("model"), F.split("model", "\1")[1].cast("int").alias("fold"),
                      "roc_auc")


def meta_table(scored: DataFrame, members: list[str], keep: list[str]) -> DataFrame:
    """One row per ``keep`` with the members' probabilities m<i>_p<class>."""
    cols = [F.max(F.when(F.col("model") == n, F.col(f"p{c}"))).alias(f"m{i}_p{c}")
            for i, n in enumerate(members) for c in range(3)]
    return scored.where(F.col("model").isin(members)).groupBy(*keep).agg(*cols)


def meta_columns(members: list[str]) -> list[str]:
    return [f"m{i}_p{c}" for i in range(len(members)) for c in range(3)]


def stacking(oof: DataFrame, test_scored: DataFrame, members: list[str], meta_C: float = 0.5,
             name: str = "Stacking") -> DataFrame:
    """Test rows scored by a multinomial logistic meta-model (no passthrough)
    that is fitted on the members' out-of-fold probabilities; the test rows'
    member probabilities come from the members fitted on all training rows."""
    from .models import fit_logistic
    cols = meta_columns(members)
    train = fit_table(meta_table(oof, members, [C.ID, "y"]).withColumnRenamed("y", C.LABEL), "stack-train", [C.ID])
    meta = fit_logistic(train, cols, C_=meta_C)
    out = meta.predict(meta_table(test_scored, members, [C.ID, "split", "y"]))
    return out.select(F.lit(name).alias("model"), C.ID, "split", "y", "pred", "p0", "p1", "p2")


def stacking_oof(oof: DataFrame, members: list[str], k: int, meta_C: float = 0.5, name: str = "Stacking",
                 parallelism: int = 8) -> DataFrame:
    """Out-of-fold rows of the stack itself: a fold's meta-model is fitted on the
    other folds' out-of-fold probabilities."""
    from .models import fit_logistic
    table = fit_table(meta_table(oof, members, [C.ID, "fold", "y"]).withColumnRenamed("y", C.LABEL), "stack-cv",
                      ["fold", C.ID])

    def builder(train, features):
        return fit_logistic(train, features, C_=meta_C)
    copies = table.withColumn("cv_fold", F.explode(F.filter(F.sequence(F.lit(0), F.lit(k - 1)),
                                                            lambda x: x != F.col("fold"))))
    return out_of_fold(name, builder, copies.drop("fold").withColumn("source", F.lit("original")), table,
                       meta_columns(members), "fold", k, parallelism=parallelism)


def vote_oof(oof: DataFrame, members: list[str], name: str = "Voting Ensemble") -> DataFrame:
    """Out-of-fold rows of the soft vote."""
    from .naive_bayes import argmax_first
    avg = (oof.where(F.col("model").isin(members)).groupBy(C.ID, "fold", "y")
           .agg(*[F.avg(f"p{c}").alias(f"p{c}") for c in range(3)]))
    return avg.select(F.lit(name).alias("model"), C.ID, "fold", "y",
                      argmax_first([F.col(f"p{c}") for c in range(3)]).cast("int").alias("pred"), "p0", "p1", "p2")
