"""Hand-made edge rows (FIXTURES F2): bin edges, NULL/NaN, negatives,
unseen categories, zero denominators."""
import math

from pyspark.sql import functions as F

from riskfold.functions import rules as R
from riskfold.operators import prepare as PR


def _one(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def test_age_bins_right_closed(spark):
    df = _one(spark, "Age double", [(v,) for v in [17.0, 18.0, 25.0, 25.5, 35.0, 45.0, 60.0, 75.0, 76.0, None]])
    got = [r[0] for r in df.select(R.bin_age("Age")).collect()]
    assert got == ["nan", "18-25", "18-25", "26-35", "26-35", "36-45", "46-60", "61-75", "nan", "nan"]


def test_income_and_delay_bins(spark):
    df = _one(spark, "inc double, d double", [(0.0, -1.0), (30000.0, 0.0), (70000.0, 15.0), (120000.0, 30.0),
                                              (1e9, 62.0), (1e9 + 1, 63.0), (None, None)])
    got = df.select(R.bin_income("inc").alias("i"), R.bin_delay("d").alias("d")).collect()
    assert [r.i for r in got] == ["nan", "Low", "Medium", "High", "Very_High", "nan", "nan"]
    assert [r.d for r in got] == ["nan", "None", "Low", "Medium", "High", "nan", "None"]


def test_expm1_guard_only_when_logged(spark):
    df = _one(spark, "x double", [(math.log1p(50000.0),), (math.log1p(10.0),)])
    mx = df.select(F.max("x")).scalar()
    got = [r[0] for r in df.select(R.bin_income("x", mx)).collect()]
    assert got == ["Medium", "Low"]


def test_log1p_keeps_null_and_clips_negative(spark):
    df = _one(spark, "x double", [(-5.0,), (None,), (0.0,), (math.e - 1,)])
    got = [r[0] for r in df.select(R.log1p_clipped("x")).collect()]
    assert got[0] == 0.0 and got[1] is None and got[2] == 0.0 and abs(got[3] - 1.0) < 1e-12


def test_ratio_with_zero_denominator_is_null(spark):
    df = _one(spark, "a double, b double", [(1.0, -0.001), (2.0, 1.0)])
    got = [r[0] for r in df.select(R.ratio("a", "b", 1e-3)).collect()]
    assert got[0] is None and abs(got[1] - 2.0 / 1.001) < 1e-12


def test_unseen_category_takes_code_zero(spark):
    train = _one(spark, "Credit_Mix string", [("Bad",), ("Good",), ("Standard",)])
    codes = PR.label_encode_fit(train, ["Credit_Mix"])
    apps = _one(spark, "Credit_Mix string", [("Good",), ("Excellent",), (None,)])
    got = [r[0] for r in PR.label_encode_apply(apps, codes, ["Credit_Mix"]).collect()]
    assert got == [1.0, 0.0, 0.0]


def test_risk_dimensions_defaults(spark):
    cols = ("Num_of_Delayed_Payment double, Delay_from_due_date double, Outstanding_Debt double, "
            "Annual_Income double, Credit_History_Age double, Credit_Mix string, Num_Credit_Inquiries double, "
            "Credit_Utilization_Ratio double, Amount_invested_monthly double, Monthly_Inhand_Salary double")
    df = _one(spark, cols, [(None, None, None, None, None, "Excellent", None, 0.0, None, 0.0),
                            (22.0, 62.0, 5000.0, 1.0, 70.0, "Good", 17.0, 50.0, 100.0, 50.0)])
    r = R.risk_dimensions(df).collect()
    a, b = r[0], r[1]
    assert (a.risk_payment, a.risk_debt, a.risk_history, a.risk_mix, a.risk_activity, a.risk_savings) == \
        (100.0, 100.0, 0.0, 10.0, 100.0, 0.0)
    assert b.risk_payment == 0.0 and b.risk_debt == 0.0 and b.risk_history == 100.0
    assert b.risk_mix == 100.0 and b.risk_activity == 0.0 and b.risk_savings == 100.0


def test_insight_rules_order_and_fallback(spark):
    cols = ("Delay_from_due_date double, Outstanding_Debt double, Annual_Income double, "
            "Credit_Utilization_Ratio double, Credit_History_Age double, Credit_Mix string, "
            "Num_of_Delayed_Payment double, Num_Credit_Inquiries double, score bigint, range_lo bigint, range_hi bigint")
    df = _one(spark, cols, [(30.0, 5000.0, 1000.0, 45.0, 1.0, "Bad", 12.0, 9.0, 300, 400, 560),
                            (0.0, 0.0, 60000.0, 25.0, 10.0, "Good", 0.0, 0.0, 600, 540, 700)])
    got = [r[0] for r in df.select(R.insight_codes("score", "range_lo", "range_hi")).collect()]
    assert got[0] == ["high_delay", "debt_to_income", "high_utilisation", "short_history", "bad_mix",
                      "many_delayed", "many_inquiries", "below_range"]
    assert got[1] == ["fallback"]


def test_proba_to_score_truncates(spark):
    df = _one(spark, "p1 double, p2 double", [(0.5, 0.25), (0.0, 1.0), (1.0, 0.0)])
    got = [r[0] for r in df.select(R.proba_to_score("p1", "p2")).collect()]
    assert got == [537, 850, 500]


def test_deviation_pct_rules(spark):
    df = _one(spark, "u double, g double, p double", [(10.0, 5.0, 0.0), (10.0, 5.0, 7.0), (None, 5.0, 7.0)])
    got = [r[0] for r in df.select(R.deviation_pct("u", "g", "p", True)).collect()]
    assert abs(got[0] + 5.0 / (6.0 + 1e-9) * 100) < 1e-9
    assert abs(got[1] + 5.0 / (2.0 + 1e-9) * 100) < 1e-9
    assert got[2] is None
