"""SQL text (DuckDB dialect, ANSI where possible) for the correctness oracle.

The CTE chain mirrors the Spark plans step by step; each registered query
appends its own SELECT. Double literals carry an exponent (``20e0``) so no
engine reads them as DECIMAL.
"""
from __future__ import annotations

from .. import constants as C

_CTES: list[tuple[str, str]] = []


def cte(name: str, body: str) -> None:
    _CTES.append((name, body))


def with_ctes(upto: str, body: str) -> str:
    names = [n for n, _ in _CTES]
    k = names.index(upto) + 1
    parts = ",\n".join(f"{n} AS (\n{b}\n)" for n, b in _CTES[:k])
    return f"WITH {parts}\n{body}"


cte("o", """
SELECT o_custkey,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total,
       CAST(sum(CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE) AS open_total,
       count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS n_open,
       count(DISTINCT o_orderpriority) AS n_prio,
       count(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 END) AS n_urgent,
       min(o_orderdate) AS first_order,
       max(o_orderdate) AS last_order
FROM orders GROUP BY o_custkey""")

cte("l", """
SELECT o_custkey AS l_custkey,
       count(DISTINCT l_suppkey) AS n_supp,
       CAST(sum(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) / count(l_tax) AS avg_tax,
       sum(abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)))) AS sum_days,
       count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS n_returned,
       CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / count(l_discount) AS avg_disc,
       CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
GROUP BY o_custkey""")

cte("e", """
SELECT user_id, count(*) AS n_events,
       CAST(sum(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,2)) END) AS DOUBLE) AS purchase_value
FROM events GROUP BY user_id""")

cte("raw", """
SELECT c_custkey AS borrower_id,
  CAST(18 + c_custkey % 58 AS DOUBLE) AS Age,
  n_name AS Occupation,
  CASE WHEN c_custkey % 20 = 3 THEN NULL ELSE total / 20e0 END AS Annual_Income,
  CASE WHEN c_custkey % 20 = 3 THEN NULL ELSE total / 240e0 END AS Monthly_Inhand_Salary,
  CASE WHEN c_custkey % 20 = 7 THEN NULL
       ELSE CAST(1 + coalesce(n_prio, 0) + coalesce(n_supp, 0) % 5 AS DOUBLE) END AS Num_Bank_Accounts,
  CAST(n_urgent AS DOUBLE) AS Num_Credit_Card,
  1 + avg_tax * 400e0 AS Interest_Rate,
  CASE WHEN n_open IS NOT NULL THEN CAST(CASE WHEN n_open < 9 THEN n_open ELSE 9 END AS DOUBLE) END AS Num_of_Loan,
  CASE WHEN c_custkey % 20 = 11 THEN NULL ELSE CAST(sum_days % 63 AS DOUBLE) END AS Delay_from_due_date,
  CASE WHEN c_custkey % 20 = 13 THEN NULL ELSE CAST(n_returned % 23 AS DOUBLE) END AS Num_of_Delayed_Payment,
  avg_disc * 300e0 AS Changed_Credit_Limit,
  CAST(coalesce(n_events, 0) % 18 AS DOUBLE) AS Num_Credit_Inquiries,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'Bad'
       WHEN c_mktsegment IN ('AUTOMOBILE', 'FURNITURE') THEN 'Good'
       ELSE 'Standard' END AS Credit_Mix,
  CASE WHEN c_custkey % 20 = 17 THEN NULL ELSE coalesce(open_total, 0e0) / 800e0 END AS Outstanding_Debt,
  20e0 + 30e0 * coalesce(open_total, 0e0) / total AS Credit_Utilization_Ratio,
  CAST(date_diff('day', CAST(first_order AS DATE), CAST(last_order AS DATE)) AS DOUBLE) / 365.25e0 * 5e0
    AS Credit_History_Age,
  CASE WHEN c_acctbal < 0 THEN 'No' WHEN c_acctbal < 2000 THEN 'NM' ELSE 'Yes' END AS Payment_of_Min_Amount,
  sum_qty / 10e0 AS Total_EMI_per_month,
  coalesce(purchase_value, 0e0) / 50e0 AS Amount_invested_monthly,
  (c_acctbal + 1000e0) / 5.5e0 AS Monthly_Balance
FROM customer JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN o ON c_custkey = o.o_custkey
LEFT JOIN l ON c_custkey = l.l_custkey
LEFT JOIN e ON c_custkey = e.user_id""")

cte("scored_raw", """
SELECT raw.*,
  0.25e0 * coalesce(Annual_Income / (SELECT max(Annual_Income) FROM raw), 0e0)
  + 0.2e0 * (1 - coalesce(Outstanding_Debt, 2499e0) / 4998e0)
  + 0.15e0 * (1 - coalesce(Delay_from_due_date, 31e0) / 62e0)
  + 0.12e0 * (CASE WHEN Credit_History_Age IS NULL THEN 0e0
                  ELSE (CASE WHEN Credit_History_Age > 35e0 THEN 35e0 ELSE Credit_History_Age END) / 35e0 END)
  + 0.1e0 * (1 - coalesce(Num_of_Delayed_Payment, 11e0) / 22e0)
  + 0.08e0 * (CASE WHEN Credit_Mix = 'Good' THEN 1e0 WHEN Credit_Mix = 'Standard' THEN 0.5e0 ELSE 0e0 END)
  + 0.05e0 * (1 - coalesce(Credit_Utilization_Ratio, 35e0) / 50e0) AS s_raw
FROM raw""")

cte("borrowers", """
SELECT * EXCLUDE (s_raw, s),
  CAST(CASE WHEN s < 0.46e0 THEN 0 WHEN s < 0.58e0 THEN 1 ELSE 2 END AS INTEGER) AS Credit_Score
FROM (SELECT *, CASE WHEN s_raw < 0 THEN 0e0 WHEN s_raw > 1 THEN 1e0 ELSE s_raw END AS s FROM scored_raw) t""")

LABEL_NAME_SQL = ("CASE {c} WHEN 0 THEN 'Poor' WHEN 1 THEN 'Standard' WHEN 2 THEN 'Good' END")


def label_name_sql(c: str) -> str:
    return LABEL_NAME_SQL.format(c=c)


def bins_sql(x: str, edges, labels) -> str:
    parts = [f"WHEN {x} > {float(lo)!r}e0 AND {x} <= {float(hi)!r}e0 THEN '{lab}'"
             for lo, hi, lab in zip(edges[:-1], edges[1:], labels)]
    return "CASE " + " ".join(parts) + f" ELSE '{C.MISSING_BIN}' END"


BIN_AGE_SQL = bins_sql("Age", C.AGE_EDGES, C.AGE_LABELS)
BIN_DELAY_SQL = bins_sql("coalesce(Delay_from_due_date, 0e0)", C.DELAY_EDGES, C.DELAY_LABELS)


def bin_income_sql(x: str) -> str:
    return bins_sql(f"coalesce({x}, 0e0)", C.INCOME_EDGES, C.INCOME_LABELS)
