"""Value-to-interval assignment as a range join on a small bin table.

The column-expression form (``functions.rules.right_closed_bins``) is the one
used in plans; this join form exists for bin tables that are data (e.g. read
from a file). The bin table is bounded by the number of bins, so it is
broadcast and the join is a broadcast nested-loop join with a range
condition: no shuffle of the large side.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C


def bin_table(spark, edges, labels) -> DataFrame:
    rows = [(float(lo), float(hi), lab) for lo, hi, lab in zip(edges[:-1], edges[1:], labels)]
    return spark.createDataFrame(rows, "lo double, hi double, label string")


def range_join_bins(df: DataFrame, col: str, edges, labels, out: str = "bin",
                    missing: str = C.MISSING_BIN) -> DataFrame:
    bins = bin_table(df.sparkSession, edges, labels)
    x = F.col(col)
    j = df.join(F.broadcast(bins), (x > bins.lo) & (x <= bins.hi), "left")
    return j.withColumn(out, F.coalesce(F.col("label"), F.lit(missing))).drop("lo", "hi", "label")
