"""Repeatable stratified split and k-fold assignment.

Both come from one exact rank of each row inside its class, ordered by
``md5(id || '-' || seed)`` (see ranking.py): the first round(share * n_c)
rows of class c are the test rows; the remaining rows get fold
``(rank - n_test) % k``. Any partitioning gives the same assignment, and
DuckDB reproduces it with row_number().
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .ranking import class_rank, md5_key


def stratified_split(df: DataFrame, label: str = C.LABEL, id_col: str = C.ID,
                     test_share: float = C.TEST_SHARE, seed: int = C.SEED,
                     folds: tuple[int, ...] = (5, 3)) -> DataFrame:
    """Add ``split`` ('train'/'test') and ``fold<k>`` (train rows only)."""
    r = class_rank(df, label, md5_key(id_col, seed), rank_col="__rank", count_col="__n")
    n_test = F.round(F.lit(test_share) * F.col("__n")).cast("bigint")
    is_test = F.col("__rank") < n_test
    cols = {"split": F.when(is_test, "test").otherwise("train")}
    for k in folds:
        cols[f"fold{k}"] = F.when(~is_test, ((F.col("__rank") - n_test) % k).cast("int"))
    return r.withColumns(cols).drop("__rank", "__n")


def stratified_kfold(df: DataFrame, k: int, label: str = C.LABEL, id_col: str = C.ID,
                     seed: int = C.SEED, col: str = "fold") -> DataFrame:
    """k folds over all rows of ``df``, balanced within every class."""
    r = class_rank(df, label, md5_key(id_col, seed), rank_col="__rank", count_col=None)
    return r.withColumn(col, (F.col("__rank") % k).cast("int")).drop("__rank")


def train_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col("split") == "train")


def test_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col("split") == "test")
