"""Operator 10: mix sources to target weights by weighted fair queueing.

Every document of a source waits in that source's shuffled queue. Its virtual
finish time is (tokens of the source up to and with it) / (target of the
source); a pass over a source that is taken again starts where the last one
ended. All queued passes are range-sorted by finish time and served until the
running total reaches the total budget: the document at the cut is taken if its
middle lies before it, so a source that is one large document comes as near to
its target as it can.

Shuffle order is md5(doc_id ":" seed), so reruns, other partitionings and SQL
agree. Both running sums are two-level. Inside a source the leading hex digits
of the md5 cut even buckets; in the global order equal intervals of finish time
do (equal ratios beyond time 1). A window runs inside a bucket, and the buckets'
totals, a small table, give the offsets; a source with a third of all rows is
spread like any other. Only ids, sizes and ``keep`` columns are moved.

A pass that begins its service at time 1 or later is not queued: all that
finishes by time 1 totals at most the budget, each source at most its target.

Cases: null text, and text without words, has size 0 and is never counted; a
null source is a source of its own, ordered last; repeated rows queue one by
one; an empty table gives no rows; extra columns are ignored, or carried by
``keep`` (clashing names get an underscore); texts of any length are counted
whole.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, cut_lineage, fresh

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = "mix"
MAX_CUTS = 1 << 15             # intervals of finish time up to 1


def source_targets(light: DataFrame, weights=WEIGHTS, max_repeat=MAX_REPEAT) -> DataFrame:
    """(source, sid, source_size, target) with targets by water filling.

    Sum of targets = sum of sizes, split by weight; a target stops at
    ``max_repeat`` x size and the excess goes to the others by weight, until
    none is above. Each round is one aggregate over the small source table.
    """
    s = light.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row per source; code point order is the byte order of UTF-8
    w = Window.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("sid", F.row_number().over(w).cast("long"))
    pick = F.array(*[F.lit(float(x)) for x in weights])
    s = s.withColumn("weight", F.element_at(pick, ((F.col("sid") - 1) % len(weights) + 1).cast("int")))
    s = cut_lineage(s.withColumn("cap", F.col("source_size") * float(max_repeat)), "mix-sources")
    total = float(s.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        # sources capped at this level keep their cap; the rest share by weight
        capped = F.col("cap") <= F.col("weight") * F.lit(level)
        r = s.agg(F.sum(F.when(capped, F.col("cap")).otherwise(0.0)).alias("c"),
                  F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("w")).first()
        new = (total - r["c"]) / r["w"] if r and r["w"] else level
        if new == level:
            break
        level = new
    return s.select("source", "sid", "source_size",
                    F.least("cap", F.col("weight") * F.lit(level)).alias("target"))


def _before(by: list[str], order: str):
    """Sum of ``n`` over the rows of ``by`` that come earlier in ``order``."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("n").over(w), F.lit(0))


def serve(queue: DataFrame, budget: float, rows_per_bucket: int = 2000) -> DataFrame:
    """The queued passes (sid, size, at, target) that are served within
    ``budget``: those whose middle comes before it in the order of finish time
    at / target, ties by sid."""
    n = queue.count()
    cuts = min(MAX_CUTS, max(1, math.ceil(n / rows_per_bucket)))
    finish = F.col("at") / F.col("target")
    cut = F.when(finish <= 1, F.floor(finish * cuts)).otherwise(cuts + 1 + F.floor(F.log2(finish) * cuts))
    q = queue.withColumn("finish", finish).withColumn("cut", cut.cast("long"))
    before = q.groupBy("cut").agg(F.sum("size").alias("n")).withColumn("before", _before([], "cut")).drop("n")
    line = Window.partitionBy("cut").orderBy("finish", "sid").rowsBetween(Window.unboundedPreceding, 0)
    q = q.withColumn("run", F.sum("size").over(line)).join(before, "cut")
    upto = F.col("before") + F.col("run")
    return q.where((F.col("at") <= F.col("target")) | (upto - F.col("size") / 2 <= F.lit(budget + 1e-6)))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", weights=WEIGHTS, max_repeat: int = MAX_REPEAT,
        seed: str = SEED, rows_per_bucket: int = 2000, keep=()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, repeats, finish and the
    ``keep`` columns, one row a document.

    ``taken`` = size x repeats; ``finish`` is the virtual finish time of the
    first pass (null for size 0). ``rows_per_bucket`` only sets the work split.
    """
    own = ["doc_id", "source", "sid", "size", "source_size", "target", "taken", "repeats", "finish", "h", "bucket",
           "run", "before", "cum", "n"]
    kept = {c: fresh(c, own) for c in keep}
    light = cut_lineage(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(text_col, F.lit(SPACE)), F.lit(0)).cast("long").alias("size"),
        *[F.col(c).alias(a) for c, a in kept.items()]), "mix-light")
    src = cut_lineage(source_targets(light, weights, max_repeat), "mix-targets")
    n = light.count()
    digits = min(5, max(1, math.ceil(math.log(max(n / rows_per_bucket, 1), 16))))
    h = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")))
    q = (light.join(src, light["source"].eqNullSafe(src["source"])).drop(src["source"])
         .withColumn("h", h).withColumn("bucket", F.substring("h", 1, digits)))
    before = (q.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
              .withColumn("before", _before(["sid"], "bucket")).drop("n"))
    inside = (Window.partitionBy("sid", "bucket").orderBy("h", "size", "doc_id")
              .rowsBetween(Window.unboundedPreceding, 0))
    q = (q.withColumn("run", F.sum("size").over(inside)).join(before, ["sid", "bucket"])
         .withColumn("cum", F.col("before") + F.col("run")))
    q = cut_lineage(q.select("doc_id", "source", "sid", "size", "source_size", "target", "cum", *kept.values()),
                    "mix-queue")
    live = q.where("size > 0").select("sid", "cum", "size", "source_size", "target")
    passes = live.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(max_repeat - 1))))
    passes = (passes.withColumn("at", F.col("source_size") * F.col("pass") + F.col("cum"))
              .where(F.col("at") - F.col("size") < F.col("target")))
    budget = src.agg(F.sum("target")).first()[0] or 0.0
    served = serve(passes, budget, rows_per_bucket).groupBy("sid", "cum").agg(F.count(F.lit(1)).alias("repeats"))
    # cum tells the documents of a source apart, but for those without words
    out = q.join(served, ["sid", "cum"], "left")
    repeats = F.when(F.col("size") > 0, F.coalesce("repeats", F.lit(0))).otherwise(0).cast("int")
    return out.select("doc_id", "source", "size", "source_size", "target",
                      (F.col("size") * repeats).alias("taken"), repeats.alias("repeats"),
                      F.when(F.col("size") > 0, F.col("cum") / F.col("target")).alias("finish"), *kept.values())


def query(spark, sf_dir):
    from .common import prepare, table
    prepare(spark)
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


SQL = r"""
WITH light AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid
  FROM light GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((sid - 1) % 3 + 1)::INT]::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
o AS (
  SELECT *, coalesce(sum(cap) OVER o, 0)::DOUBLE AS c0, sum(weight) OVER t AS w0,
         sum(source_size) OVER () AS total
  FROM w
  WINDOW o AS (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         t AS (ORDER BY cap / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
lv AS (SELECT arg_min((total - c0)::DOUBLE / w0, [cap / weight, sid])
         FILTER (WHERE weight * ((total - c0)::DOUBLE / w0) < cap) AS level FROM o),
t AS (SELECT source, sid, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, weight * level) END AS target FROM w, lv),
q AS (
  SELECT l.doc_id, l.size, t.*,
         sum(l.size) OVER (PARTITION BY t.sid ORDER BY md5(coalesce(l.doc_id::VARCHAR, '') || ':mix'), l.size, l.doc_id
                           ROWS UNBOUNDED PRECEDING) AS cum
  FROM light l JOIN t ON l.source IS NOT DISTINCT FROM t.source),
e AS (
  SELECT q.*, k.k, k.k * source_size + cum AS fin
  FROM q, (SELECT unnest([0, 1, 2]) AS k) k),
g AS (
  SELECT *, sum(size) OVER (ORDER BY fin / target, sid ROWS UNBOUNDED PRECEDING) AS upto
  FROM e WHERE size > 0 AND fin - size < target),
taken AS (
  SELECT doc_id, sid, cum, count(*) AS n FROM g
  WHERE upto - size / 2.0::DOUBLE <= (SELECT sum(target) FROM t) + 1e-6 OR fin <= target GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size, round(q.target, 6) AS target,
       (q.size * coalesce(taken.n, 0))::BIGINT AS taken
FROM q LEFT JOIN taken ON q.doc_id = taken.doc_id AND q.sid = taken.sid AND q.cum = taken.cum AND q.size > 0
"""
