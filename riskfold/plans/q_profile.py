"""Registered queries: profiling (class counts, missing values, describe,
skewness, correlation, crosstab, histogram)."""
from __future__ import annotations

from .. import constants as C
from ..functions.rules import name_cleanup
from ..operators import profile as P
from ..sources.tables import borrowers
from .oracle_sql import label_name_sql, with_ctes
from .registry import register

B = "borrowers"
NUM = C.NUMERIC_INPUTS  # numeric feature columns in schema order
ALL_COLS = [c for c in ("Age Occupation Annual_Income Monthly_Inhand_Salary Num_Bank_Accounts "
                        "Num_Credit_Card Interest_Rate Num_of_Loan Delay_from_due_date "
                        "Num_of_Delayed_Payment Changed_Credit_Limit Num_Credit_Inquiries Credit_Mix "
                        "Outstanding_Debt Credit_Utilization_Ratio Credit_History_Age "
                        "Payment_of_Min_Amount Total_EMI_per_month Amount_invested_monthly "
                        "Monthly_Balance Credit_Score").split()]


def _union(parts):
    return "\nUNION ALL\n".join(parts)


# --------------------------------------------------------------------------
# classes
# --------------------------------------------------------------------------
_CLASS_COUNTS_SQL = f"SELECT {label_name_sql('Credit_Score')} AS class_name, count(*) AS n FROM borrowers GROUP BY 1"


@register("class_counts", "class_name string, n bigint", with_ctes(B, _CLASS_COUNTS_SQL), ops=(26,))
def q_class_counts(spark, sf):
    return P.class_counts(borrowers(spark, sf))


@register("class_share", "class_name string, n bigint, share double",
          with_ctes(B, f"SELECT class_name, n, n / sum(n) OVER () AS share FROM ({_CLASS_COUNTS_SQL}) t"),
          ops=(27,))
def q_class_share(spark, sf):
    return P.class_share(borrowers(spark, sf))


# --------------------------------------------------------------------------
# missing values and schema
# --------------------------------------------------------------------------
_MISSING_SQL = _union([f"SELECT '{c}' AS column_name, avg(CASE WHEN {c} IS NULL THEN 1e0 ELSE 0e0 END) * 100 "
                       f"AS missing_pct FROM borrowers" for c in ALL_COLS])


@register("missing_rate", "column_name string, missing_pct double", with_ctes(B, _MISSING_SQL), ops=(28,))
def q_missing(spark, sf):
    return P.missing_rate(borrowers(spark, sf))


@register("sort_missing", "column_name string, missing_pct double",
          with_ctes(B, f"SELECT * FROM ({_MISSING_SQL}) t ORDER BY missing_pct DESC, column_name"), ops=(59,))
def q_sort_missing(spark, sf):
    return P.sort_missing(P.missing_rate(borrowers(spark, sf)))


@register("filter_missing_positive", "column_name string, display_name string, missing_pct double",
          with_ctes(B, f"""
SELECT column_name, replace(replace(column_name, '_', ' '), chr(10), ' ') AS display_name, missing_pct
FROM ({_MISSING_SQL}) t WHERE missing_pct > 0"""), ops=(13, 84))
def q_missing_pos(spark, sf):
    m = P.filter_missing_positive(P.missing_rate(borrowers(spark, sf)))
    return m.withColumn("display_name", name_cleanup("column_name"))


_SUM_NULLS = " + ".join(f"count(*) - count({c})" for c in ALL_COLS)


@register("total_missing", "total_missing bigint",
          with_ctes(B, f"SELECT {_SUM_NULLS} AS total_missing FROM borrowers"), ops=(29,))
def q_total_missing(spark, sf):
    return P.total_missing(borrowers(spark, sf), ALL_COLS)


_TYPE_SQL = ("CASE column_type WHEN 'DOUBLE' THEN 'double' WHEN 'BIGINT' THEN 'bigint' "
             "WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' ELSE lower(column_type) END")


@register("schema_info", "column_name string, dtype string, non_null bigint, position int",
          with_ctes(B, f"""
SELECT d.column_name, {_TYPE_SQL} AS dtype, n.non_null, CAST(d.position AS INTEGER) AS position
FROM (SELECT column_name, column_type, row_number() OVER () - 1 AS position
      FROM (DESCRIBE SELECT * FROM borrowers) x) d
JOIN ({_union([f"SELECT '{c}' AS column_name, count({c}) AS non_null FROM borrowers"
               for c in [C.ID] + ALL_COLS])}) n
ON d.column_name = n.column_name"""), ops=(30,))
def q_schema_info(spark, sf):
    return P.schema_info(borrowers(spark, sf))


# --------------------------------------------------------------------------
# describe, skewness
# --------------------------------------------------------------------------
def _describe_sql(c):
    r = "round_even"
    return (f"SELECT '{c}' AS column_name, count({c}) AS count, {r}(avg({c}), 2) AS mean, "
            f"{r}(stddev_samp({c}), 2) AS std, {r}(min({c}), 2) AS min, "
            f"{r}(quantile_cont({c}, 0.25), 2) AS p25, {r}(quantile_cont({c}, 0.5), 2) AS p50, "
            f"{r}(quantile_cont({c}, 0.75), 2) AS p75, {r}(max({c}), 2) AS max FROM borrowers")


@register("describe", "column_name string, count bigint, mean double, std double, min double, "
                      "p25 double, p50 double, p75 double, max double",
          with_ctes(B, _union([_describe_sql(c) for c in NUM])), ops=(31,))
def q_describe(spark, sf):
    return P.describe(borrowers(spark, sf), NUM)


_SKEW_SQL = _union([f"SELECT '{c}' AS column_name, skewness({c}) AS skewness FROM borrowers" for c in NUM])


@register("skewness", "column_name string, skewness double", with_ctes(B, _SKEW_SQL), ops=(32,))
def q_skew(spark, sf):
    return P.skewness(borrowers(spark, sf), NUM)


@register("sort_skew", "column_name string, skewness double",
          with_ctes(B, f"SELECT * FROM ({_SKEW_SQL}) t ORDER BY skewness DESC, column_name"), ops=(59,))
def q_sort_skew(spark, sf):
    return P.sort_skew(P.skewness(borrowers(spark, sf), NUM))


@register("filter_high_skew", "column_name string, skewness double",
          with_ctes(B, f"SELECT * FROM ({_SKEW_SQL}) t WHERE abs(skewness) > 1"), ops=(14,))
def q_high_skew(spark, sf):
    return P.filter_high_skew(P.skewness(borrowers(spark, sf), NUM))


def _after(c):
    return f"ln(1 + CASE WHEN {c} < 0 THEN 0e0 ELSE {c} END)" if c in C.LOG_FEATS else c


@register("skew_before_after", "column_name string, before double, after double",
          with_ctes(B, _union([f"SELECT '{c}' AS column_name, coalesce(skewness({c}), 0e0) AS before, "
                               f"coalesce(skewness({_after(c)}), 0e0) AS after FROM borrowers" for c in NUM])),
          ops=(19, 32))
def q_skew_ba(spark, sf):
    return P.skew_before_after(borrowers(spark, sf), NUM)


# --------------------------------------------------------------------------
# correlation
# --------------------------------------------------------------------------
_PAIRS = [(i, j) for i in range(len(NUM)) for j in range(i + 1, len(NUM))]
_CORR_ONE = "SELECT " + ", ".join(f"corr({NUM[i]}, {NUM[j]}) AS c_{i}_{j}" for i, j in _PAIRS) + " FROM borrowers"
_CORR_LONG = _union(
    [f"SELECT '{NUM[i]}' AS column_a, '{NUM[j]}' AS column_b, {i} AS pos_a, {j} AS pos_b, c_{i}_{j} AS corr FROM s"
     for i, j in _PAIRS]
    + [f"SELECT '{NUM[j]}' AS column_a, '{NUM[i]}' AS column_b, {j} AS pos_a, {i} AS pos_b, c_{i}_{j} AS corr FROM s"
       for i, j in _PAIRS]
    + [f"SELECT '{c}' AS column_a, '{c}' AS column_b, {i} AS pos_a, {i} AS pos_b, 1e0 AS corr FROM s"
       for i, c in enumerate(NUM)])
_CORR_SCHEMA = "column_a string, column_b string, pos_a int, pos_b int, corr double"


@register("correlation_matrix", _CORR_SCHEMA,
          with_ctes(B, f"SELECT * FROM (WITH s AS ({_CORR_ONE}) {_CORR_LONG}) t"), ops=(33,))
def q_corr(spark, sf):
    return P.correlation_matrix(borrowers(spark, sf), NUM)


@register("correlation_lower_triangle", _CORR_SCHEMA,
          with_ctes(B, f"SELECT * FROM (WITH s AS ({_CORR_ONE}) {_CORR_LONG}) t WHERE pos_a > pos_b"), ops=(34,))
def q_corr_lower(spark, sf):
    return P.correlation_lower_triangle(P.correlation_matrix(borrowers(spark, sf), NUM))


# --------------------------------------------------------------------------
# crosstab, histogram
# --------------------------------------------------------------------------
def _crosstab_sql(expr):
    return (f"SELECT {expr} AS value, count(CASE WHEN Credit_Score = 0 THEN 1 END) AS Poor, "
            f"count(CASE WHEN Credit_Score = 1 THEN 1 END) AS Standard, "
            f"count(CASE WHEN Credit_Score = 2 THEN 1 END) AS Good FROM borrowers GROUP BY 1")


_CT = "value string, Poor bigint, Standard bigint, Good bigint"


@register("crosstab_credit_mix", _CT, with_ctes(B, _crosstab_sql("Credit_Mix")), ops=(35,))
def q_ct_mix(spark, sf):
    return P.crosstab(borrowers(spark, sf), "Credit_Mix")


@register("crosstab_occupation", _CT, with_ctes(B, _crosstab_sql("Occupation")), ops=(35,))
def q_ct_occ(spark, sf):
    return P.crosstab(borrowers(spark, sf), "Occupation")


def _hist_sql(feature, bins):
    return f"""
SELECT g.cls AS class, g.bin, g.lo + g.bin * ((g.hi - g.lo) / {bins}) AS bin_lo,
       coalesce(h.cnt, 0) AS count,
       coalesce(h.cnt, 0) / (g.n_cls * ((g.hi - g.lo) / {bins})) AS density
FROM (SELECT r.*, b.bin FROM rng r, range(0, {bins}) b(bin)) g
LEFT JOIN (SELECT x.cls, CAST(least(floor((x.x - r.lo) / (r.hi - r.lo) * {bins}), {bins - 1}) AS INTEGER) AS bin,
                  count(*) AS cnt
           FROM xs x JOIN rng r ON x.cls = r.cls GROUP BY 1, 2) h
ON g.cls = h.cls AND g.bin = h.bin"""


def _hist_ctes(feature):
    return (f"xs AS (SELECT Credit_Score AS cls, CAST({feature} AS DOUBLE) AS x FROM borrowers "
            f"WHERE {feature} IS NOT NULL),\n"
            "rng AS (SELECT cls, CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo, "
            "CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi, count(*) AS n_cls "
            "FROM xs GROUP BY cls)")


def _hist_query(feature, bins):
    return with_ctes(B, f"SELECT * FROM (WITH {_hist_ctes(feature)} {_hist_sql(feature, bins)}) t")


_HIST = "class int, bin int, bin_lo double, count bigint, density double"


@register("histogram_by_class", _HIST, _hist_query("Annual_Income", C.HIST_BINS_EDA), ops=(36,))
def q_hist(spark, sf):
    return P.histogram_by_class(borrowers(spark, sf), "Annual_Income", C.HIST_BINS_EDA)


@register("histogram_by_class_delay", _HIST, _hist_query("Delay_from_due_date", C.HIST_BINS_PROFILE), ops=(36,))
def q_hist_delay(spark, sf):
    return P.histogram_by_class(borrowers(spark, sf), "Delay_from_due_date", C.HIST_BINS_PROFILE)
