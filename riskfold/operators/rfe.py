"""Recursive feature elimination with cross-validation, and forest importance.

Every fold walks its own path: a forest (60 trees, depth 6) is fitted on the
fold's training rows, its macro F1 on the validation rows is the score of that
feature count, and its least important feature goes. The folds' curves are
averaged; the best count wins, ties go to fewer features. A last path on all
training rows then drops features down to that count.
"""
from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from . import trees as TR


def forest_importance(train: DataFrame, features: list[str], num_trees: int = 100, max_depth: int = 8,
                      label: str = C.LABEL) -> DataFrame:
    """Of MLlib's forest."""
    from pyspark.ml.classification import RandomForestClassifier
    rows = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(train)
    imp = RandomForestClassifier(labelCol=label, numTrees=num_trees, maxDepth=max_depth, seed=C.SEED).fit(
        rows).featureImportances.toArray().tolist()
    return train.sparkSession.createDataFrame(list(zip(features, imp)), "feature string, importance double")


def macro_f1(counts: dict[tuple[int, int], int]) -> float:
    """Macro F1 of {(true class, predicted class): rows}; a class counts when it
    is in either."""
    classes = sorted({c for pair in counts for c in pair})
    out = []
    for c in classes:
        tp = counts.get((c, c), 0)
        wrong = sum(n for (y, p), n in counts.items() if (y == c) != (p == c))
        out.append(2 * tp / (2 * tp + wrong) if tp else 0.0)
    return float(np.mean(out)) if out else 0.0


def rfecv(train: DataFrame, features: list[str], fold_col: str, k: int = 3,
          min_features: int = C.RFECV_MIN_FEATURES, num_trees: int = 60, max_depth: int = 6,
          label: str = C.LABEL, parallelism: int = 8):
    """Returns (selected features, curve (n_features, mean, std), the folds'
    paths (fold, n_features, f1, dropped))."""
    from pyspark.ml.functions import vector_to_array
    from .crossval import fit_table
    n_classes = 3
    whole = VectorAssembler(inputCols=features, outputCol="all", handleInvalid="keep").transform(train)
    whole = fit_table(whole.select(C.ID, label, fold_col, "all"), "rfecv", [C.ID], width=len(features) + 3)
    whole = whole.withColumn("all", vector_to_array("all")).select(
        C.ID, label, fold_col, *[F.col("all")[j].alias(f) for j, f in enumerate(features)])
    cuts, n = TR.cut_points(whole, features)
    blocks = TR.binned(whole, features, cuts, label, [fold_col]).persist(StorageLevel.MEMORY_AND_DISK)

    def cut(places, fold, own):
        """Blocks of some features, of the rows of a fold or of all others."""
        def run(p):
            ids, y, x, folds = p
            mine = np.ones(len(y), bool) if fold is None else (folds == fold) == own
            return ids[mine], y[mine], x[:, mine][places]
        return blocks.mapValues(run)

    def fit(places, fold=None):
        """(trees, the least important feature) of a forest without a fold's rows."""
        shape = TR.Shape(num_trees, max_depth, n_sub=TR.subset_size("auto", len(places)))
        trees = TR.grow_forest(cut(places, fold, False), n, len(places), n_classes, shape)
        return trees, min(zip(places, TR.importances(trees, len(places)).tolist()), key=lambda x: (x[1], x[0]))[0]

    def score(trees, places, fold):
        shared = train.sparkSession.sparkContext.broadcast(trees)

        def run(kv):
            _, y, x = kv[1]
            pred = TR.class_shares(shared.value, x, max_depth).argmax(1)
            return np.bincount(y * n_classes + pred, minlength=n_classes ** 2)
        counts = cut(places, fold, True).map(run).fold(np.zeros(n_classes ** 2, np.int64), lambda a, b: a + b)
        shared.unpersist()
        return macro_f1({divmod(i, n_classes): int(c) for i, c in enumerate(counts) if c})

    def fold_path(f):
        places, path = list(range(len(features))), []
        while True:
            trees, weakest = fit(places, f)
            f1 = score(trees, places, f)
            if len(places) <= min_features:
                return [*path, (f, len(places), f1, None)]
            path.append((f, len(places), f1, features[weakest]))
            places = [p for p in places if p != weakest]

    def whole_path():
        places, sets = list(range(len(features))), {}
        while True:
            sets[len(places)] = [features[p] for p in places]
            if len(places) <= min_features:
                return sets
            weakest = fit(places)[1]
            places = [p for p in places if p != weakest]
    with ThreadPoolExecutor(min(parallelism, k + 1)) as ex:
        final = ex.submit(whole_path)
        paths = [p for path in ex.map(fold_path, range(k)) for p in path]
        sets = final.result()
    blocks.unpersist()
    curve = []
    for n in sorted({p[1] for p in paths}, reverse=True):
        f1 = [p[2] for p in paths if p[1] == n]
        curve.append((n, float(np.mean(f1)), float(np.std(f1))))
    best = max(curve, key=lambda r: (r[1], -r[0]))
    spark = train.sparkSession
    return (sorted(sets[best[0]]), spark.createDataFrame(curve, "n_features int, mean double, std double"),
            spark.createDataFrame(paths, "fold int, n_features int, f1 double, dropped string"))
