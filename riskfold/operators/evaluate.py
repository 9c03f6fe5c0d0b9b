"""Model evaluation on a scored table.

Input columns: ``model``, ``y`` (true class), ``pred`` and one probability
column per class (``p0``, ``p1``, ``p2``). Every metric pre-aggregates first
(confusion counts; per-score histograms for ROC/AUC/calibration), so the
windows only ever see aggregated rows, and large histograms go through the
two-level running sum.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.rules import label_name
from .ranking import running_sums

N_CLASSES = 3


def confusion_matrix(scored: DataFrame, n_classes: int = N_CLASSES) -> DataFrame:
    return (scored.groupBy("model", "y")
            .agg(*[F.count(F.when(F.col("pred") == k, 1)).alias(f"pred_{k}") for k in range(n_classes)]))


def class_counts(scored: DataFrame, n_classes: int = N_CLASSES) -> DataFrame:
    """(model, class, tp, fp, fn, support) from one grouped count."""
    cm = scored.groupBy("model", "y", "pred").agg(F.count(F.lit(1)).alias("n"))
    parts = []
    for k in range(n_classes):
        parts.append(cm.groupBy("model").agg(
            F.lit(k).alias("class"),
            F.sum(F.when((F.col("y") == k) & (F.col("pred") == k), F.col("n")).otherwise(0)).alias("tp"),
            F.sum(F.when((F.col("y") != k) & (F.col("pred") == k), F.col("n")).otherwise(0)).alias("fp"),
            F.sum(F.when((F.col("y") == k) & (F.col("pred") != k), F.col("n")).otherwise(0)).alias("fn"),
            F.sum(F.when(F.col("y") == k, F.col("n")).otherwise(0)).alias("support")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _per_class(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    d = counts.withColumns({"precision": prec, "recall": rec})
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    # a class counts for macro averages when it is in y or in pred
    return d.withColumns({"f1": f1, "present": (F.col("support") + fp > 0)})


def accuracy(scored: DataFrame) -> DataFrame:
    return scored.groupBy("model").agg(F.avg((F.col("y") == F.col("pred")).cast("double")).alias("accuracy"))


def macro_metrics(scored: DataFrame) -> DataFrame:
    pc = _per_class(class_counts(scored)).filter("present")
    m = pc.groupBy("model").agg(F.avg("precision").alias("precision_macro"),
                                F.avg("recall").alias("recall_macro"),
                                F.avg("f1").alias("f1_macro"))
    return accuracy(scored).join(m, "model")


def classification_report(scored: DataFrame) -> DataFrame:
    """Per class P/R/F1/support, then accuracy, macro avg and weighted avg."""
    pc = _per_class(class_counts(scored))
    rows = pc.select("model", label_name("class").alias("label"), "precision", "recall", "f1",
                     F.col("support").cast("bigint").alias("support"))
    present = pc.filter("present")
    tot = pc.groupBy("model").agg(F.sum("support").alias("n"), F.sum("tp").alias("tp"))
    acc = tot.select("model", F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"), (F.col("tp") / F.col("n")).alias("f1"),
                     F.col("n").cast("bigint").alias("support"))
    macro = present.groupBy("model").agg(
        F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
        F.avg("f1").alias("f1"), F.sum("support").cast("bigint").alias("support"))
    w = F.col("support")
    weighted = present.groupBy("model").agg(
        F.lit("weighted avg").alias("label"),
        (F.sum(F.col("precision") * w) / F.sum(w)).alias("precision"),
        (F.sum(F.col("recall") * w) / F.sum(w)).alias("recall"),
        (F.sum(F.col("f1") * w) / F.sum(w)).alias("f1"), F.sum(w).cast("bigint").alias("support"))
    return rows.unionByName(acc).unionByName(macro).unionByName(weighted)


def one_vs_rest(scored: DataFrame, n_classes: int = N_CLASSES) -> DataFrame:
    """Long form (model, class, y, p): the binarised label next to its score."""
    parts = [F.struct(F.lit(k).alias("class"), (F.col("y") == k).cast("int").alias("yb"),
                      F.col(f"p{k}").alias("p")) for k in range(n_classes)]
    return scored.select("model", F.inline(F.array(*parts)))


def score_histogram(scored: DataFrame) -> DataFrame:
    """(model, class, p, pos, neg) per distinct score: the pre-aggregation."""
    return (one_vs_rest(scored).groupBy("model", "class", "p")
            .agg(F.sum("yb").alias("pos"), F.sum(1 - F.col("yb")).alias("neg")))


def roc_curve(scored: DataFrame) -> DataFrame:
    """TPR/FPR at every distinct threshold (descending), one-vs-rest.

    Each curve starts at (0, 0) with an infinite threshold."""
    h = running_sums(score_histogram(scored), ["model", "class"], "p", ["pos", "neg"], descending=True)
    tot = h.groupBy("model", "class").agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    start = tot.select("model", "class", F.lit(float("inf")).alias("threshold"), F.lit(0).cast("bigint").alias("tp"),
                       F.lit(0).cast("bigint").alias("fp"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr"))
    h = h.join(tot, ["model", "class"])  # one row per (model, class)
    return h.select("model", "class", F.col("p").alias("threshold"),
                    (F.col("before_pos") + F.col("pos")).alias("tp"),
                    (F.col("before_neg") + F.col("neg")).alias("fp"),
                    F.try_divide(F.col("before_pos") + F.col("pos"), F.col("n_pos")).alias("tpr"),
                    F.try_divide(F.col("before_neg") + F.col("neg"), F.col("n_neg")).alias("fpr")).unionByName(start)


def roc_auc_by_class(scored: DataFrame) -> DataFrame:
    """Mann-Whitney AUC per (model, class); ties count one half."""
    h = running_sums(score_histogram(scored), ["model", "class"], "p", ["pos"], descending=True)
    return (h.groupBy("model", "class")
            .agg((F.sum(F.col("neg") * (F.col("before_pos") + 0.5 * F.col("pos")))
                  / (F.sum("pos") * F.sum("neg"))).alias("auc")))


def roc_auc_ovr_macro(scored: DataFrame) -> DataFrame:
    return roc_auc_by_class(scored).groupBy("model").agg(F.avg("auc").alias("roc_auc"))


def calibration_curve(scored: DataFrame, bins: int = C.CALIBRATION_BINS) -> DataFrame:
    """Mean predicted vs fraction positive in right-closed uniform bins."""
    o = one_vs_rest(scored)
    b = F.greatest(F.ceil(F.col("p") * bins) - 1, F.lit(0)).cast("int")
    return (o.groupBy("model", "class", b.alias("bin"))
            .agg(F.avg("p").alias("mean_predicted"), F.avg(F.col("yb").cast("double")).alias("fraction_positive"),
                 F.count(F.lit(1)).alias("n")))


def metrics_table(scored: DataFrame) -> DataFrame:
    """The result ledger: one row per model."""
    return macro_metrics(scored).join(roc_auc_ovr_macro(scored), "model")


def leaderboard(metrics: DataFrame) -> DataFrame:
    return metrics.orderBy(F.desc("roc_auc"), "model")


def top_models(metrics: DataFrame, k: int) -> DataFrame:
    return metrics.orderBy(F.desc("roc_auc"), "model").limit(k)


def best_model(metrics: DataFrame) -> DataFrame:
    """The leaderboard's first row: on equal AUC the first name."""
    top = F.min(F.struct((-F.col("roc_auc")).alias("k"), "model"))
    return metrics.agg(top["model"].alias("best_model"), F.max("roc_auc").alias("roc_auc"))


def cv_mean_std(cv: DataFrame, metric: str = "roc_auc") -> DataFrame:
    """Mean and population std (numpy default) of fold scores per model."""
    return cv.groupBy("model").agg(F.avg(metric).alias("cv_mean"), F.stddev_pop(metric).alias("cv_std"))
