"""What the plans over trained models take in."""
from pyspark.sql import functions as F

from riskfold import constants as C
from riskfold.plans import training as T


def _scored(spark, name):
    return spark.createDataFrame([(name, 1, "test", 0, 0, 1.0, 0.0, 0.0)], f"model string, {C.ID} bigint, split string, "
                                 "y int, pred int, p0 double, p1 double, p2 double")


def test_the_ledger_scores_every_single_model(spark, monkeypatch):
    monkeypatch.setattr(T, "base", lambda spark, sf: {})
    monkeypatch.setattr(T, "model_scored", lambda spark, sf, name: _scored(spark, name))
    got = [r["model"] for r in T.all_base_scored(spark, "every single model").collect()]
    assert sorted(got) == sorted(T.BASE_MODELS) and set(T.BOOSTERS) < set(got)


def test_cross_validation_covers_every_single_model_and_both_ensembles(spark, monkeypatch):
    def oof(spark, sf, names):
        rows = [(n, i, i % 2, i % 3, i % 3, 0.2, 0.3, 0.5) for n in names for i in range(12)]
        return spark.createDataFrame(rows, f"model string, {C.ID} bigint, fold int, y int, pred int, p0 double, p1 double, p2 double")
    monkeypatch.setattr(T, "oof", oof)
    monkeypatch.setattr(T, "top4", lambda spark, sf: T.BOOSTERS)
    monkeypatch.setattr(T.CV, "stacking_oof", lambda rows, names, k: rows.limit(12).withColumn("model", F.lit("Stacking")))
    got = {r["model"] for r in T.cv_results(spark, "every model").select("model").distinct().collect()}
    assert got == {*T.BASE_MODELS, "Voting Ensemble", "Stacking"}
