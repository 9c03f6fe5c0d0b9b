"""Registered queries against their DuckDB SQL on the same parquet tables."""
import math

import pytest

import __spark_entry__ as E
from tools.oracle_check import compare

from .conftest import SF_SMALL

FAST = ["crosstab_delay_bucket", "borrowers_view", "label_map_on_read", "coerce_numeric", "expm1_guard",
        "input_range_check", "bin_income", "scorecard_label", "risk_dimensions", "class_share",
        "missing_rate", "describe", "skew_before_after", "crosstab_occupation", "histogram_by_class",
        "stratified_split", "impute_median", "standard_scale", "robust_scale", "model_naive_bayes",
        "knn_join", "roc_curve", "roc_auc_ovr_macro", "classification_report", "calibration_curve",
        "smote_oversample", "insight_rules", "profile_deviation", "score_report_sink"]


def test_every_query_has_a_builder_and_schema():
    qs, sqls = E.queries(), E.oracle_sql()
    assert len(qs) >= 90
    assert set(sqls) <= set(qs)


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["value", "Poor", "Standard", "Good"]


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, duck, name):
    con = duck(SF_SMALL)
    sdf = E.queries()[name](spark, SF_SMALL)
    s_rows = [tuple(r) for r in sdf.collect()]
    cur = con.execute(E.oracle_sql()[name])
    assert sdf.columns == [d[0] for d in cur.description]
    msg = compare(s_rows, cur.fetchall())
    assert msg is None, msg
