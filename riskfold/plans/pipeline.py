"""Feature preparation plan with explicit fitted state.

borrowers -> split -> log1p -> rebin -> label codes -> impute -> engineer ->
standard scale. ``fit_prepare`` learns the state (income max, code table,
fill values, scaler) and ``apply_prepare`` replays it on any frame with the
borrower input columns: the training table, a batch of applications or a
stream (state is never recomputed from a micro-batch).

Lineage is cut after encoding, with a table in the shared checkpoint folder;
every fit pass then scans that table instead of deriving and encoding its rows
again.
"""
from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import rules as R
from ..operators import prepare as PR
from ..operators.sampling import stratified_split
from ..session import cut_lineage
from ..sources.tables import borrowers

LEAST_ROWS, MOST_ROWS = 5_000, 1_000_000        # of a partition of the split borrowers


@dataclass
class PrepState:
    income_max: float
    codes: DataFrame
    fill: dict
    scaler: PR.Affine
    features: list

    def save(self, path: str) -> None:
        """The state as a file set: one JSON row of numbers and the code table."""
        spark = self.codes.sparkSession
        plain = json.dumps({"income_max": self.income_max, "fill": self.fill, "shift": self.scaler.shift,
                            "scale": self.scaler.scale, "features": self.features})
        spark.createDataFrame([(plain,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/numbers")
        self.codes.write.mode("overwrite").parquet(f"{path}/codes")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "PrepState":
        d = json.loads(spark.read.text(f"{path}/numbers").first()["value"])
        return PrepState(d["income_max"], spark.read.parquet(f"{path}/codes"), d["fill"],
                         PR.Affine(d["shift"], d["scale"]), d["features"])


def _encode(df: DataFrame, income_max: float, codes: DataFrame | None):
    lin = R.log1p_linearise(R.normalise_missing(df))        # NaN is missing, like NULL
    binned = R.rebin(lin, income_max)
    if codes is None:
        codes = PR.label_encode_fit(binned, C.CAT_COLS)
    return PR.label_encode_apply(binned, codes, C.CAT_COLS), codes


def fit_prepare(df: DataFrame, impute: str = "median", fit_on: str = "train",
                checkpoint: bool = True) -> tuple[DataFrame, PrepState]:
    """Fit on a frame that has ``split``; returns (prepared frame, state)."""
    lin_income = R.log1p_clipped("Annual_Income")
    income_max = df.agg(F.max(lin_income)).first()[0]
    enc, codes = _encode(df, income_max, None)
    if checkpoint:
        enc = cut_lineage(enc, "encoded")
    fit_rows = enc.filter(F.col("split") == "train") if fit_on == "train" else enc
    if impute == "median":
        fill = PR.impute_median_fit(fit_rows, C.ENCODED_FEATURES)
    else:
        fill = PR.impute_most_frequent_fit(fit_rows, C.ENCODED_FEATURES)
    eng = R.engineer(PR.impute_apply(enc, fill))
    scaler = PR.standard_scale_fit(eng.filter(F.col("split") == "train"), C.ALL_FEATURES)
    state = PrepState(income_max, codes, fill, scaler, list(C.ALL_FEATURES))
    return scaler.apply(eng), state


def apply_prepare(df: DataFrame, state: PrepState) -> DataFrame:
    enc, _ = _encode(df, state.income_max, state.codes)
    eng = R.engineer(PR.impute_apply(enc, state.fill))
    return state.scaler.apply(eng)


def split_borrowers(spark: SparkSession, sf_dir: str, materialise: bool = True) -> DataFrame:
    """Borrowers with split and folds, written once to the checkpoint folder
    (one row per customer: far smaller than the tables it is derived from);
    every later fit pass scans this table."""
    if not materialise:
        return stratified_split(borrowers(spark, sf_dir))
    b = cut_lineage(borrowers(spark, sf_dir), "borrowers")
    return cut_lineage(_spread(stratified_split(b), b.count()), "borrowers-split")


def _spread(df: DataFrame, rows: int) -> DataFrame:
    """``df`` dealt by id into partitions that keep all cores busy in the passes
    to come (few files otherwise: the shuffles before are small)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    n = max(math.ceil(rows / MOST_ROWS), min(2 * cores, math.ceil(rows / LEAST_ROWS)))
    return df.repartition(max(1, n), C.ID)


def prepared(spark: SparkSession, sf_dir: str, **kw) -> tuple[DataFrame, PrepState]:
    """Prepared table: id, label, split, folds and the scaled features."""
    df, state = fit_prepare(split_borrowers(spark, sf_dir), **kw)
    keep = [C.ID, C.LABEL, "split", "fold5", "fold3"] + C.ALL_FEATURES
    # written once: model fits, neighbour joins and scorers scan it many times
    return cut_lineage(df.select(*keep), "prepared"), state


def engineered_unscaled(spark: SparkSession, sf_dir: str, impute: str = "median") -> DataFrame:
    """Imputed and engineered features before scaling (with split)."""
    s = split_borrowers(spark, sf_dir)
    lin_income = R.log1p_clipped("Annual_Income")
    income_max = s.agg(F.max(lin_income)).first()[0]
    enc = cut_lineage(_encode(s, income_max, None)[0], "encoded")
    fit_rows = enc.filter(F.col("split") == "train")
    fill = (PR.impute_median_fit(fit_rows, C.ENCODED_FEATURES) if impute == "median"
            else PR.impute_most_frequent_fit(fit_rows, C.ENCODED_FEATURES))
    return R.engineer(PR.impute_apply(enc, fill))


def raw_engineered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw-unit inputs plus engineered ratios (for profiles and deviations)."""
    return R.engineer(split_borrowers(spark, sf_dir))
