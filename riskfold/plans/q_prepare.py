"""Registered queries: split, folds, encoding, imputation, scaling, profiles."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..functions import rules as R
from ..operators import prepare as PR
from ..operators import profile as P
from ..operators.binning import range_join_bins
from . import pipeline as PL
from .oracle_sql import BIN_AGE_SQL, BIN_DELAY_SQL, bin_income_sql, cte, with_ctes
from .registry import register

ENC = C.ENCODED_FEATURES
ALL = C.ALL_FEATURES
NUMERIC_ENC = [c for c in ENC if c not in C.CAT_COLS]


def _j(parts, sep=",\n  "):
    return sep.join(parts)


# ---------------------------------------------------------------- SQL chain
cte("ranked", """
SELECT *, row_number() OVER (PARTITION BY Credit_Score
                             ORDER BY md5(CAST(borrower_id AS VARCHAR) || '-42')) - 1 AS rnk,
       count(*) OVER (PARTITION BY Credit_Score) AS cls_n
FROM borrowers""")

cte("splitted", """
SELECT * EXCLUDE (rnk, cls_n, n_test),
  CASE WHEN rnk < n_test THEN 'test' ELSE 'train' END AS split,
  CASE WHEN rnk >= n_test THEN CAST((rnk - n_test) % 5 AS INTEGER) END AS fold5,
  CASE WHEN rnk >= n_test THEN CAST((rnk - n_test) % 3 AS INTEGER) END AS fold3
FROM (SELECT *, CAST(round(0.2e0 * cls_n) AS BIGINT) AS n_test FROM ranked) t""")

cte("lin", "SELECT * REPLACE (" + _j(
    f"ln(1 + CASE WHEN {c} < 0 THEN 0e0 ELSE {c} END) AS {c}" for c in C.LOG_FEATS) + ") FROM splitted")

cte("binned", f"""
SELECT *, {BIN_AGE_SQL} AS Age_Group,
  {bin_income_sql("CASE WHEN max(Annual_Income) OVER () < 30 THEN exp(Annual_Income) - 1 ELSE Annual_Income END")}
    AS Income_Bracket,
  {BIN_DELAY_SQL} AS Delay_Bucket
FROM lin""")


def _txt(c):
    return f"coalesce(CAST({c} AS VARCHAR), 'nan')"


cte("encoded", "SELECT * REPLACE (" + _j(
    f"CAST(dense_rank() OVER (ORDER BY {_txt(c)}) - 1 AS DOUBLE) AS {c}" for c in C.CAT_COLS)
    + ") FROM binned")

cte("fillv", "SELECT " + _j(f"quantile_cont({c}, 0.5) AS {c}" for c in ENC)
    + " FROM encoded WHERE split = 'train'")

cte("imputed", "SELECT e.* REPLACE (" + _j(
    f"coalesce(CAST(e.{c} AS DOUBLE), f.{c}) AS {c}" for c in ENC) + ") FROM encoded e, fillv f")

_ENG_EXPR = [
    "Outstanding_Debt / (Annual_Income + 0.001e0) AS Debt_to_Income",
    "Total_EMI_per_month / (Monthly_Inhand_Salary + 0.001e0) AS EMI_to_Income",
    "Num_of_Delayed_Payment / (Num_of_Loan + 1e0) AS Delayed_per_Loan",
    "Amount_invested_monthly / (Monthly_Inhand_Salary + 0.001e0) AS Investment_to_Income",
    "Num_Credit_Card / (Num_Bank_Accounts + 1e0) AS Cards_per_Account",
    "Credit_Utilization_Ratio * coalesce(Delay_from_due_date, 0e0) AS Util_x_Delay",
    "Outstanding_Debt * coalesce(Num_Credit_Inquiries, 0e0) AS Debt_x_Inquiries",
]
cte("engineered", "SELECT *, " + _j(_ENG_EXPR) + " FROM imputed")

cte("scalestats", "SELECT " + _j(
    [f"avg({c}) AS m_{c}" for c in ALL] + [f"stddev_pop({c}) AS s_{c}" for c in ALL])
    + " FROM engineered WHERE split = 'train'")


def _nz(x):
    return f"(CASE WHEN {x} IS NULL OR {x} = 0 OR isnan({x}) THEN 1e0 ELSE {x} END)"


cte("scaled", "SELECT e.borrower_id, e.Credit_Score, e.split, e.fold5, e.fold3, " + _j(
    f"(e.{c} - s.m_{c}) / {_nz('s.s_' + c)} AS {c}" for c in ALL) + " FROM engineered e, scalestats s")

# ---------------------------------------------------------------- queries
S = "scaled"


@register("stratified_split", "borrower_id bigint, Credit_Score int, split string",
          with_ctes(S, "SELECT borrower_id, Credit_Score, split FROM splitted"), ops=(52,))
def q_split(spark, sf):
    return PL.split_borrowers(spark, sf).select(C.ID, C.LABEL, "split")


@register("stratified_kfold", "borrower_id bigint, Credit_Score int, fold5 int, fold3 int",
          with_ctes(S, "SELECT borrower_id, Credit_Score, fold5, fold3 FROM splitted WHERE split = 'train'"),
          ops=(53,))
def q_kfold(spark, sf):
    s = PL.split_borrowers(spark, sf)
    return s.filter(F.col("split") == "train").select(C.ID, C.LABEL, "fold5", "fold3")


@register("label_encode", "borrower_id bigint, " + ", ".join(f"{c} double" for c in C.CAT_COLS),
          with_ctes(S, "SELECT borrower_id, " + ", ".join(C.CAT_COLS) + " FROM encoded"), ops=(68,))
def q_label_encode(spark, sf):
    s = PL.split_borrowers(spark, sf)
    enc, _ = PL._encode(s, s.agg(F.max(R.log1p_clipped("Annual_Income"))).first()[0], None)
    return enc.select(C.ID, *C.CAT_COLS)


_LOOKUP_SQL = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, v AS value, CAST(dense_rank() OVER (ORDER BY v) - 1 AS DOUBLE) AS code "
    f"FROM (SELECT DISTINCT {_txt(c)} AS v FROM binned) d" for c in C.CAT_COLS)


@register("encode_lookup", "column string, value string, code double", with_ctes(S, _LOOKUP_SQL), ops=(20,))
def q_lookup(spark, sf):
    s = PL.split_borrowers(spark, sf)
    binned = R.rebin(R.log1p_linearise(s))
    return PR.label_encode_fit(binned, C.CAT_COLS)


_UNSEEN_SQL = "\nUNION ALL\n".join(f"""
SELECT t.borrower_id, '{c}' AS column, t.v AS value, coalesce(k.code, 0e0) AS code,
       CASE WHEN k.code IS NULL THEN 1 ELSE 0 END AS unseen
FROM (SELECT borrower_id, {_txt(c)} AS v FROM binned WHERE split = 'test') t
LEFT JOIN (SELECT v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS DOUBLE) AS code
           FROM (SELECT DISTINCT {_txt(c)} AS v FROM binned WHERE split = 'train' AND Credit_Score = 1) d) k
ON t.v = k.v""" for c in C.CAT_COLS)


@register("encode_unseen_fallback", "borrower_id bigint, column string, value string, code double, unseen int",
          with_ctes(S, _UNSEEN_SQL), ops=(21,))
def q_unseen(spark, sf):
    """Codes fitted on the Standard-class training rows only, applied to the
    test rows: categories never seen fall back to code 0."""
    s = PL.split_borrowers(spark, sf)
    binned = R.rebin(R.log1p_linearise(s))
    fit = binned.filter((F.col("split") == "train") & (F.col(C.LABEL) == 1))
    codes = PR.label_encode_fit(fit, C.CAT_COLS)
    test = binned.filter(F.col("split") == "test")
    parts = [F.struct(F.lit(c).alias("column"), PR.as_text(c).alias("value")) for c in C.CAT_COLS]
    long = test.select(C.ID, F.inline(F.array(*parts)))
    j = long.join(codes, ["column", "value"], "left")
    return j.select(C.ID, "column", "value", F.coalesce(F.col("code"), F.lit(0.0)).alias("code"),
                    F.col("code").isNull().cast("int").alias("unseen"))


_MEMBER = ["Outstanding_Debt", "Delay_from_due_date", "Credit_History_Age", "Age_Group",
           "Debt_to_Income", "Num_Credit_Inquiries", "Income_Bracket", "Credit_Mix"]


@register("select_member_columns", "borrower_id bigint, " + ", ".join(
    f"{c} {'string' if c == 'Credit_Mix' else 'double'}" for c in _MEMBER),
    with_ctes(S, "SELECT borrower_id, " + ", ".join(
        c if c in ("Outstanding_Debt", "Delay_from_due_date", "Credit_History_Age",
                   "Num_Credit_Inquiries", "Credit_Mix") else f"0e0 AS {c}" for c in _MEMBER)
        + " FROM borrowers"), ops=(22,))
def q_member(spark, sf):
    """Align raw applications to a selected feature list: absent -> 0."""
    from ..operators.align import select_member_columns
    apps = PL.split_borrowers(spark, sf).drop(C.LABEL)
    return select_member_columns(apps, _MEMBER, keep=[C.ID])


@register("impute_median", "borrower_id bigint, split string, " + ", ".join(f"{c} double" for c in ENC),
          with_ctes(S, "SELECT borrower_id, split, " + ", ".join(ENC) + " FROM imputed"), ops=(87,))
def q_impute_median(spark, sf):
    eng = PL.engineered_unscaled(spark, sf, "median")
    return eng.select(C.ID, "split", *ENC)


_MODE_SQL = "\nUNION ALL\n".join(f"""
SELECT '{c}' AS column, min(v) AS mode FROM (
  SELECT v, n, max(n) OVER () AS top FROM (
    SELECT CAST({c} AS DOUBLE) AS v, count(*) AS n FROM encoded
    WHERE split = 'train' AND {c} IS NOT NULL GROUP BY 1) a) b
WHERE n = top""" for c in ENC)


@register("impute_most_frequent", "column string, mode double", with_ctes(S, _MODE_SQL), ops=(88,))
def q_impute_mode(spark, sf):
    s = PL.split_borrowers(spark, sf)
    enc, _ = PL._encode(s, s.agg(F.max(R.log1p_clipped("Annual_Income"))).first()[0], None)
    fill = PR.impute_most_frequent_fit(enc.filter(F.col("split") == "train"), ENC)
    return spark.createDataFrame([(c, fill[c]) for c in ENC], "column string, mode double")


@register("total_missing_after_impute", "total_missing bigint",
          with_ctes(S, "SELECT " + " + ".join(f"count(*) - count({c})" for c in ENC) + " AS total_missing FROM imputed"),
          ops=(29,))
def q_total_missing_after(spark, sf):
    eng = PL.engineered_unscaled(spark, sf)
    return P.total_missing(eng, ENC)


_SCALED = "borrower_id bigint, Credit_Score int, split string, " + ", ".join(f"{c} double" for c in ALL)


@register("standard_scale", _SCALED,
          with_ctes(S, "SELECT borrower_id, Credit_Score, split, " + ", ".join(ALL) + " FROM scaled"),
          ops=(89,))
def q_standard(spark, sf):
    df, _ = PL.prepared(spark, sf)
    return df


def _scaler_sql(kind):
    if kind == "minmax":
        stats = "SELECT " + _j([f"min({c}) AS a_{c}" for c in ALL] + [f"max({c}) - min({c}) AS b_{c}" for c in ALL])
    else:
        stats = "SELECT " + _j([f"quantile_cont({c}, 0.5) AS a_{c}" for c in ALL]
                               + [f"quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS b_{c}" for c in ALL])
    stats += " FROM engineered WHERE split = 'train'"
    return ("SELECT e.borrower_id, e.Credit_Score, e.split, " + _j(
        f"(e.{c} - s.a_{c}) / {_nz('s.b_' + c)} AS {c}" for c in ALL)
        + f" FROM engineered e, ({stats}) s")


@register("minmax_scale", _SCALED, with_ctes(S, _scaler_sql("minmax")), ops=(90,))
def q_minmax(spark, sf):
    eng = PL.engineered_unscaled(spark, sf)
    sc = PR.minmax_scale_fit(eng.filter(F.col("split") == "train"), ALL)
    return sc.apply(eng).select(C.ID, C.LABEL, "split", *ALL)


@register("robust_scale", _SCALED, with_ctes(S, _scaler_sql("robust")), ops=(91,))
def q_robust(spark, sf):
    eng = PL.engineered_unscaled(spark, sf)
    sc = PR.robust_scale_fit(eng.filter(F.col("split") == "train"), ALL)
    return sc.apply(eng).select(C.ID, C.LABEL, "split", *ALL)


def _hist_series_sql(name, expr_sql, bins=C.HIST_BINS_EDA):
    return f"""
SELECT '{name}' AS series, g.bin, r.lo + g.bin * ((r.hi - r.lo) / {bins}) AS bin_lo, coalesce(h.n, 0) AS count
FROM range(0, {bins}) g(bin)
CROSS JOIN (SELECT min(x) AS lo, max(x) AS hi FROM (SELECT {expr_sql} AS x FROM sc) a) r
LEFT JOIN (SELECT CAST(least(floor((x - r2.lo) / (r2.hi - r2.lo) * {bins}), {bins - 1}) AS INTEGER) AS bin, count(*) AS n
           FROM (SELECT {expr_sql} AS x FROM sc) a,
                (SELECT min(x) AS lo, max(x) AS hi FROM (SELECT {expr_sql} AS x FROM sc) a2) r2
           GROUP BY 1) h ON g.bin = h.bin"""


_CMP_FEATURE = "Annual_Income"
_CMP_SQL = f"""
SELECT * FROM (
WITH sc AS (
  SELECT e.{_CMP_FEATURE} AS x0,
         (e.{_CMP_FEATURE} - avg(e.{_CMP_FEATURE}) OVER ()) / {_nz(f'stddev_pop(e.{_CMP_FEATURE}) OVER ()')} AS x_std,
         (e.{_CMP_FEATURE} - min(e.{_CMP_FEATURE}) OVER ()) / {_nz(f'(max(e.{_CMP_FEATURE}) OVER () - min(e.{_CMP_FEATURE}) OVER ())')} AS x_mm,
         (e.{_CMP_FEATURE} - q.med) / {_nz('q.iqr')} AS x_rob
  FROM engineered e,
       (SELECT quantile_cont({_CMP_FEATURE}, 0.5) AS med,
               quantile_cont({_CMP_FEATURE}, 0.75) - quantile_cont({_CMP_FEATURE}, 0.25) AS iqr
        FROM engineered WHERE split = 'train') q
  WHERE e.split = 'train')
{_hist_series_sql('original', 'x0')}
UNION ALL {_hist_series_sql('standard', 'x_std')}
UNION ALL {_hist_series_sql('minmax', 'x_mm')}
UNION ALL {_hist_series_sql('robust', 'x_rob')}) t"""


@register("scaler_comparison", "series string, bin int, bin_lo double, count bigint",
          with_ctes(S, _CMP_SQL), ops=(92,))
def q_scaler_cmp(spark, sf):
    """Distribution of one feature (training rows) under three scalers."""
    eng = PL.engineered_unscaled(spark, sf)
    tr = eng.filter(F.col("split") == "train").select(_CMP_FEATURE)
    f = [_CMP_FEATURE]
    out = PR.equal_width_histogram(tr, _CMP_FEATURE, C.HIST_BINS_EDA, "original")
    for name, fit in (("standard", PR.standard_scale_fit), ("minmax", PR.minmax_scale_fit),
                      ("robust", PR.robust_scale_fit)):
        sc = fit(tr, f)
        out = out.unionByName(PR.equal_width_histogram(sc.apply(tr), _CMP_FEATURE, C.HIST_BINS_EDA, name))
    return out


@register("class_profile", "class int, feature string, mean double",
          with_ctes(S, "\nUNION ALL\n".join(
              f"SELECT Credit_Score AS class, '{c}' AS feature, avg({c}) AS mean FROM scaled "
              f"WHERE split = 'train' AND Credit_Score IN (0, 2) GROUP BY Credit_Score" for c in ALL)), ops=(37,))
def q_class_profile(spark, sf):
    df, _ = PL.prepared(spark, sf)
    return P.class_profile(df.filter(F.col("split") == "train"), ALL)


@register("features_minus_label", "borrower_id bigint, " + ", ".join(
    f"{c} {'string' if c in ('Occupation', 'Credit_Mix', 'Payment_of_Min_Amount') else 'double'}"
    for c in C.INPUT_COLUMNS), with_ctes(S, "SELECT * EXCLUDE (Credit_Score) FROM borrowers"), ops=(64,))
def q_minus_label(spark, sf):
    from ..sources.tables import borrowers
    return borrowers(spark, sf).drop(C.LABEL)


@register("bin_range_join", "borrower_id bigint, Age double, Age_Group string, Age_Group_join string",
          with_ctes(S, f"""
SELECT b.borrower_id, b.Age, {BIN_AGE_SQL.replace('Age', 'b.Age').replace("b.Age_", "Age_")} AS Age_Group,
       coalesce(r.label, 'nan') AS Age_Group_join
FROM borrowers b LEFT JOIN (VALUES {", ".join(f"({lo}e0, {hi}e0, '{lab}')" for lo, hi, lab in
                                        zip(C.AGE_EDGES[:-1], C.AGE_EDGES[1:], C.AGE_LABELS))}) r(lo, hi, label)
ON b.Age > r.lo AND b.Age <= r.hi"""), ops=(25,))
def q_bin_range_join(spark, sf):
    from ..sources.tables import borrowers
    b = borrowers(spark, sf).select(C.ID, "Age")
    j = range_join_bins(b, "Age", C.AGE_EDGES, C.AGE_LABELS, out="Age_Group_join")
    return j.withColumn("Age_Group", R.bin_age("Age"))
