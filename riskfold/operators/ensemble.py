"""Soft voting over stored predictions (stacking: see crossval)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .naive_bayes import argmax_first


def soft_vote(scored: DataFrame, members: DataFrame, name: str = "Voting Ensemble",
              n_classes: int = 3) -> DataFrame:
    """Mean class probabilities of the member models per row, argmax with
    ties to the lowest class. ``members`` is a small (model) table (top-k by
    AUC), joined by broadcast: its size is bounded by k."""
    s = scored.join(F.broadcast(members.select("model")), "model", "left_semi")
    avg = s.groupBy(C.ID, "split", "y").agg(*[F.avg(f"p{c}").alias(f"p{c}") for c in range(n_classes)])
    return avg.select(F.lit(name).alias("model"), C.ID, "split", "y",
                      argmax_first([F.col(f"p{c}") for c in range(n_classes)]).cast("int").alias("pred"),
                      *[f"p{c}" for c in range(n_classes)])
