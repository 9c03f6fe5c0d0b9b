"""Registered queries: sources, row-level rules and the minimal slice."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..functions import rules as R
from ..operators import profile as P
from ..sources import files
from ..sources.tables import borrowers
from .oracle_sql import (BIN_AGE_SQL, BIN_DELAY_SQL, bin_income_sql, label_name_sql,
                         with_ctes)
from .registry import register

B = "borrowers"
BORROWER_SCHEMA = ("borrower_id bigint, Age double, Occupation string, Annual_Income double, "
                   "Monthly_Inhand_Salary double, Num_Bank_Accounts double, Num_Credit_Card double, "
                   "Interest_Rate double, Num_of_Loan double, Delay_from_due_date double, "
                   "Num_of_Delayed_Payment double, Changed_Credit_Limit double, "
                   "Num_Credit_Inquiries double, Credit_Mix string, Outstanding_Debt double, "
                   "Credit_Utilization_Ratio double, Credit_History_Age double, "
                   "Payment_of_Min_Amount string, Total_EMI_per_month double, "
                   "Amount_invested_monthly double, Monthly_Balance double, Credit_Score int")


# --------------------------------------------------------------------------
# minimal slice: payment-delay bucket by credit class
# --------------------------------------------------------------------------
def delay_bucket_by_class(spark, sf):
    b = borrowers(spark, sf).withColumn("Delay_Bucket", R.bin_delay())
    return P.crosstab(b, "Delay_Bucket")


register("crosstab_delay_bucket", "value string, Poor bigint, Standard bigint, Good bigint",
         with_ctes(B, f"""
SELECT {BIN_DELAY_SQL} AS value,
       count(CASE WHEN Credit_Score = 0 THEN 1 END) AS Poor,
       count(CASE WHEN Credit_Score = 1 THEN 1 END) AS Standard,
       count(CASE WHEN Credit_Score = 2 THEN 1 END) AS Good
FROM borrowers GROUP BY 1"""), ops=(35, 67))(delay_bucket_by_class)


@register("borrowers_view", BORROWER_SCHEMA, with_ctes(B, "SELECT * FROM borrowers"))
def q_borrowers(spark, sf):
    return borrowers(spark, sf)


# --------------------------------------------------------------------------
# 2.1 scans / sources
# --------------------------------------------------------------------------
@register("scan_csv", BORROWER_SCHEMA, with_ctes(B, "SELECT * FROM borrowers"), ops=(1,))
def q_scan_csv(spark, sf):
    """Borrowers written as CSV by Spark, read back with an explicit schema."""
    path = files.write_csv(borrowers(spark, sf), "borrowers_csv")
    return files.scan_csv(spark, path, BORROWER_SCHEMA)


_TEXT_LABEL_SQL = f"""
CASE WHEN borrower_id % 97 = 0 THEN 'Unknown' WHEN borrower_id % 89 = 0 THEN ''
     ELSE {label_name_sql('Credit_Score')} END"""


@register("label_map_on_read", "borrower_id bigint, label_text string, Credit_Score int",
          with_ctes(B, f"""
SELECT borrower_id, label_text,
       CASE label_text WHEN 'Poor' THEN 0 WHEN 'Standard' THEN 1 WHEN 'Good' THEN 2 END AS Credit_Score
FROM (SELECT borrower_id, {_TEXT_LABEL_SQL} AS label_text FROM borrowers) t"""), ops=(2,))
def q_label_map(spark, sf):
    """Text labels (with unknown and empty ones) round-trip through CSV."""
    b = borrowers(spark, sf)
    text = (F.when(F.col(C.ID) % 97 == 0, "Unknown").when(F.col(C.ID) % 89 == 0, "")
            .otherwise(R.label_name(C.LABEL)))
    path = files.write_csv(b.select(C.ID, text.alias("label_text")), "labels_csv")
    df = files.scan_csv(spark, path, "borrower_id bigint, label_text string")
    df = df.withColumn("label_text", F.coalesce(F.col("label_text"), F.lit("")))
    return df.withColumn(C.LABEL, R.label_map_on_read("label_text"))


@register("preview", BORROWER_SCHEMA,
          with_ctes(B, "SELECT * FROM borrowers ORDER BY borrower_id LIMIT 100"), ops=(3,))
def q_preview(spark, sf):
    return borrowers(spark, sf).orderBy(C.ID).limit(100)


@register("row_and_column_counts", "n_rows bigint, n_columns bigint, n_features bigint",
          with_ctes(B, "SELECT count(*) AS n_rows, 22 AS n_columns, 20 AS n_features FROM borrowers"),
          ops=(4,))
def q_counts(spark, sf):
    b = borrowers(spark, sf)
    n_cols = len(b.columns)
    n_feat = len([c for c in b.columns if c not in (C.ID, C.LABEL)])
    return b.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(n_cols).alias("n_columns"),
                 F.lit(n_feat).alias("n_features"))


# --------------------------------------------------------------------------
# 2.2 projections, filters, predicates
# --------------------------------------------------------------------------
_DIRTY = ["Num_of_Loan", "Num_Bank_Accounts", "Num_of_Delayed_Payment", "Annual_Income"]


def _dirty_sql(c):
    return (f"CASE WHEN borrower_id % 7 = 0 THEN CAST({c} AS VARCHAR) || '_' "
            f"WHEN borrower_id % 11 = 0 THEN 'abc' WHEN borrower_id % 13 = 0 THEN '' "
            f"ELSE CAST({c} AS VARCHAR) END")


@register("coerce_numeric",
          "borrower_id bigint, " + ", ".join(f"{c} double" for c in _DIRTY),
          with_ctes(B, "SELECT borrower_id, " + ", ".join(
              f"TRY_CAST(trim({_dirty_sql(c)}) AS DOUBLE) AS {c}" for c in _DIRTY) + " FROM borrowers"),
          ops=(6,))
def q_coerce(spark, sf):
    """Numeric columns as dirty text ('12_', 'abc', '') -> double, bad -> NULL."""
    b = borrowers(spark, sf)
    k = F.col(C.ID)
    dirty = {c: (F.when(k % 7 == 0, F.concat(F.col(c).cast("string"), F.lit("_")))
                 .when(k % 11 == 0, "abc").when(k % 13 == 0, "")
                 .otherwise(F.col(c).cast("string"))) for c in _DIRTY}
    return b.select(C.ID, *[R.coerce_numeric(v).alias(c) for c, v in dirty.items()])


@register("log1p_linearise", "borrower_id bigint, " + ", ".join(f"{c} double" for c in C.LOG_FEATS),
          with_ctes(B, "SELECT borrower_id, " + ", ".join(
              f"ln(1 + CASE WHEN {c} < 0 THEN 0e0 ELSE {c} END) AS {c}" for c in C.LOG_FEATS)
              + " FROM borrowers"), ops=(7,))
def q_linearise(spark, sf):
    return R.log1p_linearise(borrowers(spark, sf)).select(C.ID, *C.LOG_FEATS)


@register("expm1_guard", "borrower_id bigint, income_logged double, income_raw double",
          with_ctes(B, """
SELECT borrower_id, lg AS income_logged,
       CASE WHEN max(lg) OVER () < 30 THEN exp(lg) - 1 ELSE lg END AS income_raw
FROM (SELECT borrower_id, ln(1 + CASE WHEN Annual_Income < 0 THEN 0e0 ELSE Annual_Income END) AS lg
      FROM borrowers) t"""), ops=(8,))
def q_expm1(spark, sf):
    lin = R.log1p_linearise(borrowers(spark, sf)).select(C.ID, F.col("Annual_Income").alias("income_logged"))
    mx = lin.select(F.max("income_logged")).scalar()
    return lin.withColumn("income_raw", R.expm1_guard("income_logged", mx))


_NULLABLE = ["Annual_Income", "Num_Bank_Accounts", "Delay_from_due_date",
             "Num_of_Delayed_Payment", "Outstanding_Debt"]


@register("fill_zero", "borrower_id bigint, " + ", ".join(f"{c} double" for c in _NULLABLE),
          with_ctes(B, "SELECT borrower_id, " + ", ".join(f"coalesce({c}, 0e0) AS {c}" for c in _NULLABLE)
                    + " FROM borrowers"), ops=(9,))
def q_fill_zero(spark, sf):
    return borrowers(spark, sf).select(C.ID, *[R.fill_zero(c).alias(c) for c in _NULLABLE])


@register("drop_nulls_for_profile", "borrower_id bigint, Annual_Income double",
          with_ctes(B, "SELECT borrower_id, Annual_Income FROM borrowers WHERE Annual_Income IS NOT NULL"),
          ops=(10,))
def q_dropnull(spark, sf):
    return P.drop_nulls_for_profile(borrowers(spark, sf), "Annual_Income").select(C.ID, "Annual_Income")


_KINDS = [(c, "object" if c in ("Occupation", "Credit_Mix", "Payment_of_Min_Amount") else "numeric")
          for c in C.INPUT_COLUMNS]


@register("select_by_dtype", "column_name string, kind string, n_values bigint, n_distinct bigint",
          with_ctes(B, "\nUNION ALL\n".join(
              f"SELECT '{c}' AS column_name, '{k}' AS kind, count({c}) AS n_values, "
              f"count(DISTINCT {c}) AS n_distinct FROM borrowers" for c, k in _KINDS)), ops=(11,))
def q_dtype(spark, sf):
    """The columns picked by type, with what they hold."""
    b = borrowers(spark, sf)
    kinds = {r["column_name"]: r["kind"] for r in P.select_by_dtype(b).collect()}       # one row a column
    parts = [F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("kind"), F.col(c).cast("string").alias("value"))
             for c, k in kinds.items()]
    values = b.select(F.inline(F.array(*parts))).groupBy("column_name", "kind", "value").agg(F.count("value").alias("n"))
    return values.groupBy("column_name", "kind").agg(F.sum("n").alias("n_values"), F.count("value").alias("n_distinct"))


@register("class_filter", "borrower_id bigint, Credit_Score int",
          with_ctes(B, "SELECT borrower_id, Credit_Score FROM borrowers WHERE Credit_Score = 2"), ops=(12,))
def q_class_filter(spark, sf):
    return P.class_filter(borrowers(spark, sf), 2).select(C.ID, C.LABEL)


_FORM_SQL = []
for _f, _lo, _hi in C.FORM_BOUNDS:
    _FORM_SQL.append(f"SELECT '{_f}' AS field, count({_f}) AS n_checked, "
                     f"count(CASE WHEN {_f} < {_lo} OR {_f} > {_hi} THEN 1 END) AS n_violations FROM borrowers")
for _f, _vals in C.FORM_SETS:
    _in = ", ".join(f"'{v}'" for v in _vals)
    _FORM_SQL.append(f"SELECT '{_f}' AS field, count({_f}) AS n_checked, "
                     f"count(CASE WHEN {_f} NOT IN ({_in}) THEN 1 END) AS n_violations FROM borrowers")


@register("input_range_check", "field string, n_checked bigint, n_violations bigint",
          with_ctes(B, "\nUNION ALL\n".join(_FORM_SQL)), ops=(15,))
def q_range_check(spark, sf):
    from ..operators.quality import input_range_check
    return input_range_check(borrowers(spark, sf))


@register("derive_salary", "borrower_id bigint, Annual_Income double, Monthly_Salary double",
          with_ctes(B, "SELECT borrower_id, Annual_Income, Annual_Income / 12e0 AS Monthly_Salary FROM borrowers"),
          ops=(16,))
def q_salary(spark, sf):
    b = borrowers(spark, sf)
    return b.select(C.ID, "Annual_Income", R.derive_salary("Annual_Income").alias("Monthly_Salary"))


@register("round_metrics", "borrower_id bigint, util_2 double, rate_3 double, history_4 double",
          with_ctes(B, """
SELECT borrower_id, round_even(Credit_Utilization_Ratio, 2) AS util_2,
       round_even(Interest_Rate, 3) AS rate_3, round_even(Credit_History_Age, 4) AS history_4
FROM borrowers"""), ops=(17,))
def q_round(spark, sf):
    b = borrowers(spark, sf)
    return b.select(C.ID, F.bround("Credit_Utilization_Ratio", 2).alias("util_2"),
                    F.bround("Interest_Rate", 3).alias("rate_3"),
                    F.bround("Credit_History_Age", 4).alias("history_4"))


@register("label_name", "borrower_id bigint, Credit_Score int, class_name string",
          with_ctes(B, f"SELECT borrower_id, Credit_Score, {label_name_sql('Credit_Score')} AS class_name FROM borrowers"),
          ops=(18,))
def q_label_name(spark, sf):
    b = borrowers(spark, sf)
    return b.select(C.ID, C.LABEL, R.label_name(C.LABEL).alias("class_name"))


# --------------------------------------------------------------------------
# 2.8 binning, encoding, engineered features, label rules
# --------------------------------------------------------------------------
@register("bin_age", "borrower_id bigint, Age double, Age_Group string",
          with_ctes(B, f"SELECT borrower_id, Age, {BIN_AGE_SQL} AS Age_Group FROM borrowers"), ops=(65, 25))
def q_bin_age(spark, sf):
    return borrowers(spark, sf).select(C.ID, "Age", R.bin_age().alias("Age_Group"))


@register("bin_income", "borrower_id bigint, Annual_Income double, Income_Bracket string",
          with_ctes(B, f"""
SELECT borrower_id, Annual_Income,
       {bin_income_sql("CASE WHEN max(lg) OVER () < 30 THEN exp(lg) - 1 ELSE lg END")} AS Income_Bracket
FROM (SELECT borrower_id, Annual_Income,
             ln(1 + CASE WHEN Annual_Income < 0 THEN 0e0 ELSE Annual_Income END) AS lg FROM borrowers) t"""),
          ops=(66,))
def q_bin_income(spark, sf):
    """Income bracket computed from the log-transformed column (expm1 guard)."""
    b = borrowers(spark, sf).select(C.ID, "Annual_Income",
                                    R.log1p_clipped("Annual_Income").alias("lg"))
    mx = b.select(F.max("lg")).scalar()
    return b.select(C.ID, "Annual_Income", R.bin_income("lg", mx).alias("Income_Bracket"))


@register("bin_delay", "borrower_id bigint, Delay_from_due_date double, Delay_Bucket string",
          with_ctes(B, f"SELECT borrower_id, Delay_from_due_date, {BIN_DELAY_SQL} AS Delay_Bucket FROM borrowers"),
          ops=(67,))
def q_bin_delay(spark, sf):
    return borrowers(spark, sf).select(C.ID, "Delay_from_due_date", R.bin_delay().alias("Delay_Bucket"))


_ENG_SQL = {
    "engineer_debt_to_income": "Outstanding_Debt / (Annual_Income + 0.001e0)",
    "engineer_emi_to_income": "Total_EMI_per_month / (Monthly_Inhand_Salary + 0.001e0)",
    "engineer_delayed_per_loan": "Num_of_Delayed_Payment / (Num_of_Loan + 1e0)",
    "engineer_investment_to_income": "Amount_invested_monthly / (Monthly_Inhand_Salary + 0.001e0)",
    "engineer_cards_per_account": "Num_Credit_Card / (Num_Bank_Accounts + 1e0)",
    "engineer_util_x_delay": "Credit_Utilization_Ratio * coalesce(Delay_from_due_date, 0e0)",
    "engineer_debt_x_inquiries": "Outstanding_Debt * coalesce(Num_Credit_Inquiries, 0e0)",
}
_ENG_NAMES = dict(zip(_ENG_SQL, C.ENGINEERED))
_ENG_OPS = dict(zip(_ENG_SQL, range(69, 76)))


def _eng_builder(feature):
    def build(spark, sf):
        return R.engineer(borrowers(spark, sf)).select(C.ID, feature)
    return build


for _q, _expr in _ENG_SQL.items():
    _feat = _ENG_NAMES[_q]
    register(_q, f"borrower_id bigint, {_feat} double",
             with_ctes(B, f"SELECT borrower_id, {_expr} AS {_feat} FROM borrowers"),
             ops=(_ENG_OPS[_q],))(_eng_builder(_feat))


@register("scorecard_label", "borrower_id bigint, score double, Credit_Score int",
          with_ctes(B, """
SELECT b.borrower_id, CASE WHEN s.s_raw < 0 THEN 0e0 WHEN s.s_raw > 1 THEN 1e0 ELSE s.s_raw END AS score,
       b.Credit_Score
FROM borrowers b JOIN scored_raw s ON b.borrower_id = s.borrower_id"""), ops=(76,))
def q_scorecard(spark, sf):
    raw = borrowers(spark, sf, with_label=False)
    mx = raw.select(F.max("Annual_Income")).scalar()
    return (raw.withColumn("score", R.scorecard_score(mx))
            .transform(lambda d: R.scorecard_label(d, mx))
            .select(C.ID, "score", C.LABEL))


@register("expected_range", "borrower_id bigint, Annual_Income double, range_lo bigint, range_hi bigint, range_mid bigint",
          with_ctes(B, """
SELECT borrower_id, Annual_Income, lo AS range_lo, hi AS range_hi, CAST(floor((lo + hi) / 2) AS BIGINT) AS range_mid
FROM (SELECT borrower_id, Annual_Income,
        CASE WHEN Annual_Income < 30000 THEN 400 WHEN Annual_Income < 80000 THEN 540
             WHEN Annual_Income < 150000 THEN 650 WHEN Annual_Income IS NOT NULL THEN 700 END AS lo,
        CASE WHEN Annual_Income < 30000 THEN 560 WHEN Annual_Income < 80000 THEN 700
             WHEN Annual_Income < 150000 THEN 780 WHEN Annual_Income IS NOT NULL THEN 820 END AS hi
      FROM borrowers) t"""), ops=(79,))
def q_expected_range(spark, sf):
    b = borrowers(spark, sf).withColumn("r", R.expected_range("Annual_Income"))
    return b.select(C.ID, "Annual_Income", F.col("r.lo").alias("range_lo"), F.col("r.hi").alias("range_hi"),
                    R.range_midpoint("r.lo", "r.hi").alias("range_mid"))


def _od(c, d):
    return f"(CASE WHEN {c} IS NULL OR {c} = 0 THEN {d}e0 ELSE {c} END)"


_RISK_SQL = f"""
SELECT borrower_id,
  greatest(0e0, 100 - {_od('Num_of_Delayed_Payment', 0)} / 22 * 80 - {_od('Delay_from_due_date', 0)} / 62 * 20) AS risk_payment,
  greatest(0e0, 100 - {_od('Outstanding_Debt', 0)} / greatest(coalesce(Annual_Income, 1e0), 1e0) * 100) AS risk_debt,
  least(100e0, {_od('Credit_History_Age', 0)} / 35 * 100) AS risk_history,
  CASE Credit_Mix WHEN 'Good' THEN 100e0 WHEN 'Standard' THEN 55e0 WHEN 'Bad' THEN 10e0 ELSE 10e0 END AS risk_mix,
  greatest(0e0, 100 - {_od('Num_Credit_Inquiries', 0)} / 17 * 50
                - greatest(0e0, {_od('Credit_Utilization_Ratio', 30)} - 30) / 20 * 50) AS risk_activity,
  least(100e0, {_od('Amount_invested_monthly', 0)} / greatest({_od('Monthly_Inhand_Salary', 1)}, 1e0) * 80
               + least(20e0, {_od('Annual_Income', 0)} / 150000 * 20)) AS risk_savings
FROM borrowers"""


@register("risk_dimensions", "borrower_id bigint, " + ", ".join(f"risk_{d} double" for d in R.RISK_DIM_COLUMNS),
          with_ctes(B, _RISK_SQL), ops=(80,))
def q_risk(spark, sf):
    return R.risk_dimensions(borrowers(spark, sf)).select(C.ID, *[f"risk_{d}" for d in R.RISK_DIM_COLUMNS])


@register("label_binarize", "borrower_id bigint, y_0 int, y_1 int, y_2 int",
          with_ctes(B, """
SELECT borrower_id, CAST(Credit_Score = 0 AS INTEGER) AS y_0, CAST(Credit_Score = 1 AS INTEGER) AS y_1,
       CAST(Credit_Score = 2 AS INTEGER) AS y_2 FROM borrowers"""), ops=(85,))
def q_binarize(spark, sf):
    return R.label_binarize(borrowers(spark, sf)).select(C.ID, "y_0", "y_1", "y_2")
