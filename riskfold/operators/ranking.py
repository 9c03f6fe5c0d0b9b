"""Exact, repeatable rank of rows inside a class without a one-task window.

Order key: ``md5(<id> || '-' || <seed>)`` as hex text, which DuckDB computes
identically, so the rank is reproducible in SQL with
``row_number() OVER (PARTITION BY class ORDER BY md5(...)) - 1``.

A class may hold a third of all rows, so the rank is built in two levels:
rows are cut into key ranges of bounded size (approximate quantiles of a
60-bit key prefix; approximation only affects bucket sizes, never the
result), ranked inside their range by a window partitioned by (class,
range), and shifted by the number of rows of the class in earlier ranges
(a small table of range counts). A NULL class is a class like any other, and
the number of ranges never changes the result: one path serves all sizes.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C


def md5_key(id_col: str = C.ID, seed: int | str = C.SEED) -> Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"-{seed}")))


def _join_null_safe(left: DataFrame, right: DataFrame, cols: list[str], how: str = "inner") -> DataFrame:
    """Join on equal ``cols``, NULL equal to NULL; the left columns are kept."""
    r = right.withColumnsRenamed({c: f"__on_{c}" for c in cols})
    on = None
    for c in cols:
        e = left[c].eqNullSafe(r[f"__on_{c}"])
        on = e if on is None else on & e
    return left.join(r, on, how).drop(*[f"__on_{c}" for c in cols])


def _free(name: str, taken) -> str:
    """``name`` with underscores appended while a column already uses it."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name += "_"
    return name


def class_rank(df: DataFrame, class_col: str = C.LABEL, key: Column | None = None,
               rank_col: str = "rank", count_col: str | None = "class_n",
               rows_per_range: int = 2_000_000) -> DataFrame:
    """Add the 0-based rank inside ``class_col`` by ``key`` (and class size).

    Rows of a NULL class are ranked among themselves."""
    key = key if key is not None else md5_key()
    taken = [*df.columns, rank_col, count_col or rank_col]
    k, p, r, off, local, c = (_free(n, taken) for n in ("__rk_key", "__rk_part", "__rk_range", "__rk_offset",
                                                         "__rk_local", "__rk_n"))
    d = df.withColumn(k, key)
    # 60-bit numeric prefix of the hex key, scaled to [0, 1): monotone in the key
    prefix = F.conv(F.substring(k, 1, 15), 16, 10).cast("double") / float(16 ** 15)
    d = d.withColumn(p, prefix)
    counts = {row[0]: row[1] for row in d.groupBy(class_col).agg(F.count(F.lit(1))).collect()}  # one row per class
    most = max(1, math.ceil(max(counts.values(), default=0) / rows_per_range))
    cuts: dict = {v: [] for v in counts}
    if most > 1:
        # range cut points per class from approximate quantiles (bounded state)
        probs = [i / most for i in range(1, most)]
        qs = d.groupBy(class_col).agg(F.percentile_approx(p, probs, 10_000)).collect()
        cuts = {row[0]: sorted({x for x in row[1] if 0.0 < x < 1.0}) for row in qs}
    # one sorted split list for all classes: class i occupies [2i, 2i+1)
    classes = sorted(cuts, key=lambda v: (v is None, 0 if v is None else v))
    at = F.lit(0.0)
    for i, v in enumerate(classes):
        same = F.col(class_col).isNull() if v is None else F.col(class_col).eqNullSafe(F.lit(v))
        at = F.when(same, F.lit(2.0 * i)).otherwise(at)
    splits = sorted({-float("inf"), float("inf"), *[2.0 * i for i in range(len(classes))],
                     *[2.0 * i + x for i, v in enumerate(classes) for x in cuts[v]]} | {0.0})
    from pyspark.ml.feature import Bucketizer  # binary search per row
    d = d.withColumn(p, at + F.col(p))
    d = (Bucketizer(splits=splits, inputCol=p, outputCol=r, handleInvalid="keep")
         .transform(d).withColumn(r, F.col(r).cast("int")).drop(p))
    # rows of the class in earlier ranges (table of size classes x ranges)
    rc = d.groupBy(class_col, r).agg(F.count(F.lit(1)).alias(c))
    wo = Window.partitionBy(class_col).orderBy(r).rowsBetween(Window.unboundedPreceding, -1)
    offs = rc.withColumn(off, F.coalesce(F.sum(c).over(wo), F.lit(0))).drop(c)
    w = Window.partitionBy(class_col, r).orderBy(k)
    ranked = d.withColumn(local, F.row_number().over(w) - 1)
    out = (_join_null_safe(ranked, offs, [class_col, r])
           .withColumn(rank_col, F.col(off) + F.col(local)).drop(r, off, local, k))
    if count_col:
        n = F.lit(None).cast("bigint")
        for v, number in counts.items():
            same = F.col(class_col).isNull() if v is None else F.col(class_col).eqNullSafe(F.lit(v))
            n = F.when(same, F.lit(number)).otherwise(n)
        out = out.withColumn(count_col, n.cast("bigint"))
    return out


def running_sums(df: DataFrame, part_cols: list[str], order_col: str, value_cols: list[str],
                 descending: bool = True, prefix: str = "before_",
                 rows_per_range: int = 2_000_000) -> DataFrame:
    """For each row, the sums of ``value_cols`` over the rows of its partition
    that come strictly earlier in ``order_col`` order (exclusive prefix sums).

    ``order_col`` must be unique within a partition (pre-aggregate first);
    NULL part columns form partitions of their own. Partitions are cut into
    value ranges (approximate quantiles), summed per range (a small table) and
    combined with a window that only spans one range; one range is the same
    path with no cuts.
    """
    sizes = df.groupBy(*part_cols).agg(F.count(F.lit(1)).alias("__n")).agg(F.max("__n")).first()[0] or 0
    n_ranges = max(1, math.ceil(sizes / rows_per_range))
    key = -F.col(order_col) if descending else F.col(order_col)
    d = df.withColumn("__key", key.cast("double"))
    if n_ranges > 1:
        probs = [i / n_ranges for i in range(1, n_ranges)]
        cuts = d.groupBy(*part_cols).agg(F.percentile_approx("__key", probs, 10_000).alias("__cuts"))
        d = _join_null_safe(d, F.broadcast(cuts), part_cols)  # one row per partition
        d = d.withColumn("__r", F.size(F.filter("__cuts", lambda c: c <= F.col("__key")))).drop("__cuts")
    else:
        d = d.withColumn("__r", F.lit(0))
    tot = d.groupBy(*part_cols, "__r").agg(*[F.sum(v).alias(f"__t_{v}") for v in value_cols])
    wo = Window.partitionBy(*part_cols).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*part_cols, "__r", *[F.coalesce(F.sum(f"__t_{v}").over(wo), F.lit(0)).alias(f"__o_{v}")
                                           for v in value_cols])
    w = Window.partitionBy(*part_cols, "__r").orderBy("__key").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumns({f"__l_{v}": F.coalesce(F.sum(v).over(w), F.lit(0)) for v in value_cols})
    d = _join_null_safe(d, offs, [*part_cols, "__r"])
    return d.withColumns({prefix + v: F.col(f"__o_{v}") + F.col(f"__l_{v}") for v in value_cols}).drop(
        "__key", "__r", *[f"__o_{v}" for v in value_cols], *[f"__l_{v}" for v in value_cols])
