"""Deterministic scorers whose predictions feed the metric queries:
closed-form Gaussian naive Bayes, exact kNN vote share, and soft voting."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import evaluate as EV
from ..operators.ensemble import soft_vote
from ..operators.knn_model import knn_vote
from ..operators.naive_bayes import gaussian_nb_fit, gaussian_nb_score
from ..operators.neighbors import knn_join
from ..session import cut_lineage
from . import pipeline as PL

SCORED_COLS = ["model", C.ID, "split", "y", "pred", "p0", "p1", "p2"]


def _as_scored(df: DataFrame, model: str) -> DataFrame:
    return df.select(F.lit(model).alias("model"), C.ID, "split", F.col(C.LABEL).alias("y"),
                     "pred", "p0", "p1", "p2")


def nb_scored(spark: SparkSession, sf: str, all_rows: bool = False, prepared=None) -> DataFrame:
    df, _ = prepared or PL.prepared(spark, sf)
    nb = gaussian_nb_fit(df.filter(F.col("split") == "train"), C.ALL_FEATURES)
    rows = df if all_rows else df.filter(F.col("split") == "test")
    return _as_scored(gaussian_nb_score(rows, nb), "Naive Bayes")


def knn_neighbours(spark: SparkSession, sf: str, prepared=None) -> DataFrame:
    df, _ = prepared or PL.prepared(spark, sf)
    tr, te = df.filter(F.col("split") == "train"), df.filter(F.col("split") == "test")
    return knn_join(te, tr, C.KNN_K, C.ALL_FEATURES, qid=C.ID, rid=C.ID)


def knn_scored(spark: SparkSession, sf: str, prepared=None) -> DataFrame:
    df, _ = prepared or PL.prepared(spark, sf)
    tr, te = df.filter(F.col("split") == "train"), df.filter(F.col("split") == "test")
    out = knn_vote(te, tr, C.ALL_FEATURES, k=C.KNN_K)
    return _as_scored(out, "KNN")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Test-row predictions of every deterministic scorer (one table):
    Naive Bayes, KNN and the soft vote of the top-4 of them by AUC."""
    prep = PL.prepared(spark, sf)
    base = cut_lineage(nb_scored(spark, sf, prepared=prep).unionByName(knn_scored(spark, sf, prepared=prep)),
                       "scored")
    top = EV.top_models(EV.roc_auc_ovr_macro(base), 4).select("model")
    vote = soft_vote(base, top, "Voting Ensemble")
    return base.unionByName(vote)
