"""Driver tables and the derived ``borrowers`` table.

``borrowers`` gives one row per customer with the 20 borrower attributes and
the 3-class label. It is derived from customer, nation, orders, lineitem and
events with three pre-aggregates, so its cost grows with those tables:

* ``o``: orders per customer (one shuffle on o_custkey, map-side partial agg)
* ``l``: lineitem joined to orders on the unique order key, then per customer
  and group of suppliers, then per customer
* ``e``: events per user

Column rules are listed in FIXTURES.md (F1).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Money and rates carry two decimals: summing them as DECIMAL is exact, so the
# result does not depend on partitioning or summation order (a double sum
# does), and any engine produces the same bits after the final cast. The sums
# run over whole cents as BIGINT, which needs no big-number arithmetic a row.
MONEY = "decimal(18,2)"
SUPPLIER_GROUPS = 8             # a customer's line items are dealt over that many tasks


def cents(x: Column) -> Column:
    """``x`` (double) cast to MONEY, in cents. A double that is the nearest to a whole
    number of cents of at most 15 digits needs no cast; all others take it."""
    whole = F.rint(x * 100)
    return (F.when((F.abs(x) < 1e13) & (whole / 100 == x), whole.cast("bigint"))
            .otherwise((x.cast(MONEY) * 100).cast("bigint")))


def from_cents(s: Column) -> Column:
    """A sum of cents as the double nearest to the exact amount."""
    return (s.cast("decimal(19,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("double")


def _null_when(cond: Column, value: Column) -> Column:
    return F.when(cond, F.lit(None).cast("double")).otherwise(value)


def customer_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-customer raw aggregates (the pre-aggregates of the derived view)."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
        "o_orderdate", "o_orderpriority")
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_quantity", "l_discount", "l_tax",
        "l_returnflag", "l_shipdate")
    ev = table(spark, sf_dir, "events").select("user_id", "event_type", "value")

    is_open = F.col("o_orderstatus") == "O"
    price = cents(F.col("o_totalprice"))
    o = orders.groupBy("o_custkey").agg(
        from_cents(F.sum(price)).alias("total"),
        from_cents(F.sum(F.when(is_open, price))).alias("open_total"),
        F.count(F.when(is_open, 1)).alias("n_open"),
        F.countDistinct("o_orderpriority").alias("n_prio"),
        F.count(F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 1)).alias("n_urgent"),
        F.min("o_orderdate").alias("first_order"),
        F.max("o_orderdate").alias("last_order"),
    )
    # lineitem is joined to orders on the order key (unique on the orders
    # side, so no key skew). A customer meets a supplier about once, so partial
    # aggregates would save nothing: the joined rows are dealt by customer and group
    # of suppliers and aggregated where they land, a row a group is left to add up
    lo = li.join(orders.select("o_orderkey", "o_custkey", "o_orderdate"),
                 li.l_orderkey == orders.o_orderkey)
    days = F.abs(F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")))
    group = F.pmod(F.xxhash64("l_suppkey"), F.lit(SUPPLIER_GROUPS))
    dealt = (lo.select(F.col("o_custkey").alias("l_custkey"), "l_suppkey", group.cast("int").alias("grp"),
                       cents(F.col("l_tax")).alias("tax"), cents(F.col("l_discount")).alias("disc"),
                       cents(F.col("l_quantity")).alias("qty"), days.alias("days"),
                       (F.col("l_returnflag") == "R").alias("returned"), F.col("l_tax").isNotNull().alias("has_tax"),
                       F.col("l_discount").isNotNull().alias("has_disc"))
             .repartition("l_custkey", "grp"))
    per = dealt.groupBy("l_custkey", "grp").agg(
        F.countDistinct("l_suppkey").alias("n_supp"),
        F.sum("tax").alias("tax"), F.count(F.when(F.col("has_tax"), 1)).alias("n_tax"),
        F.sum("days").alias("days"), F.count(F.when(F.col("returned"), 1)).alias("n_returned"),
        F.sum("disc").alias("disc"), F.count(F.when(F.col("has_disc"), 1)).alias("n_disc"),
        F.sum("qty").alias("qty"))
    l = per.groupBy("l_custkey").agg(
        F.sum("n_supp").alias("n_supp"),
        (from_cents(F.sum("tax")) / F.sum("n_tax")).alias("avg_tax"),
        F.sum("days").alias("sum_days"),
        F.sum("n_returned").alias("n_returned"),
        (from_cents(F.sum("disc")) / F.sum("n_disc")).alias("avg_disc"),
        from_cents(F.sum("qty")).alias("sum_qty"),
    )
    e = ev.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        from_cents(F.sum(F.when(F.col("event_type") == "purchase", cents(F.col("value"))))).alias("purchase_value"),
    )
    return o, l, e


def borrowers(spark: SparkSession, sf_dir: str, with_label: bool = True) -> DataFrame:
    """The derived borrower table (schema of the reference input + key)."""
    o, l, e = customer_features(spark, sf_dir)
    cust = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    # nation has 25 rows by definition of the schema: a bounded broadcast
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    base = (cust.join(F.broadcast(nation), cust.c_nationkey == nation.n_nationkey)
            .join(o, cust.c_custkey == o.o_custkey, "left")
            .join(l, cust.c_custkey == l.l_custkey, "left")
            .join(e, cust.c_custkey == e.user_id, "left"))
    k = F.col("c_custkey")
    m20 = k % 20
    total = F.col("total")
    seg = F.col("c_mktsegment")
    bal = F.col("c_acctbal")
    hist_days = F.datediff(F.to_date("last_order"), F.to_date("first_order")).cast("double")
    out = base.select(
        k.alias(C.ID),
        (F.lit(18) + k % 58).cast("double").alias("Age"),
        F.col("n_name").alias("Occupation"),
        _null_when(m20 == 3, total / 20.0).alias("Annual_Income"),
        _null_when(m20 == 3, total / 240.0).alias("Monthly_Inhand_Salary"),
        _null_when(m20 == 7, (1 + F.coalesce(F.col("n_prio"), F.lit(0))
                              + F.coalesce(F.col("n_supp"), F.lit(0)) % 5).cast("double")
                   ).alias("Num_Bank_Accounts"),
        F.col("n_urgent").cast("double").alias("Num_Credit_Card"),
        (1 + F.col("avg_tax") * 400.0).alias("Interest_Rate"),
        F.when(F.col("n_open").isNotNull(), F.least(F.col("n_open"), F.lit(9)))
         .cast("double").alias("Num_of_Loan"),
        _null_when(m20 == 11, (F.col("sum_days") % 63).cast("double")).alias("Delay_from_due_date"),
        _null_when(m20 == 13, (F.col("n_returned") % 23).cast("double")).alias("Num_of_Delayed_Payment"),
        (F.col("avg_disc") * 300.0).alias("Changed_Credit_Limit"),
        (F.coalesce(F.col("n_events"), F.lit(0)) % 18).cast("double").alias("Num_Credit_Inquiries"),
        F.when(seg == "BUILDING", "Bad")
         .when(seg.isin("AUTOMOBILE", "FURNITURE"), "Good")
         .otherwise("Standard").alias("Credit_Mix"),
        _null_when(m20 == 17, F.coalesce(F.col("open_total"), F.lit(0.0)) / 800.0).alias("Outstanding_Debt"),
        (20.0 + 30.0 * F.coalesce(F.col("open_total"), F.lit(0.0)) / total).alias("Credit_Utilization_Ratio"),
        (hist_days / 365.25 * 5.0).alias("Credit_History_Age"),
        F.when(bal < 0, "No").when(bal < 2000, "NM").otherwise("Yes").alias("Payment_of_Min_Amount"),
        (F.col("sum_qty") / 10.0).alias("Total_EMI_per_month"),
        (F.coalesce(F.col("purchase_value"), F.lit(0.0)) / 50.0).alias("Amount_invested_monthly"),
        ((bal + 1000.0) / 5.5).alias("Monthly_Balance"),
    )
    if with_label:
        from ..functions.rules import scorecard_label
        out = out.transform(scorecard_label)
    return out


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Borrower inputs without the label (what a scoring request carries)."""
    return borrowers(spark, sf_dir, with_label=False)
