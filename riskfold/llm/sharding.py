"""Operator 11: shards by proportional stratified interleaving.

Rows are shuffled within their source and ranked there; row r (from 0) of a
source of n rows gets the fractional rank (r + u) / n, u in (0, 1) a draw of the
source. All rows sorted by fractional rank form one sequence in which every
stretch holds each source in proportion, and cutting it into equal stretches
gives shards of the same mixture: row counts differ by one at most (law
``rows``), and so do a source's counts in any two shards, plus one.

The shuffle key is (md5 of text and seed, md5 of id and seed): equal texts
stand together in a source, at nearly the same fractional rank in every source,
so copies fall into one shard as far as the laws let them.

Neither order needs one task. Rank in a source: the first hex digits of the key
cut a source into buckets; a text with more than a bucket of copies in a source
is cut again by the id's digits; a window runs inside a bucket and the buckets'
counts give the offsets. Global order: fractional ranks are spread evenly, so
equal intervals of them are buckets of equal size, again with a window inside
and counts as offsets. The number of intervals is bounded (MAX_CUTS).

Cases: null text has size 1 (no bytes, plus 1), crc32 0 and stands with the
other null texts; a null source is a source of its own; null and repeated ids
are rows like others (equal rows are interchangeable); an empty table gives no
rows; other columns are ignored, or passed through by ``keep`` (clashing names
get an underscore). Texts are read whole, once.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, fresh, small_enough

SHARDS = 8
SEED = "shard"
LAW = "rows"
ROWS_PER_BUCKET = 20_000
MAX_CUTS = 1 << 16


def _before(by: list[str], order: list[str]):
    """Sum of ``n`` over the rows of ``by`` that come earlier in ``order``."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("n").over(w), F.lit(0))


def assign_shards(docs: DataFrame, n_shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
                  source_col: str = "source", seed: str = SEED, keep=(),
                  rows_per_bucket: int = ROWS_PER_BUCKET, max_cuts: int = MAX_CUTS) -> DataFrame:
    """doc_id, source, size, text_crc32, fraction, position, shard, slot and the
    ``keep`` columns. ``position`` is the row's place (from 0) in the whole
    sequence, ``slot`` its place in the shard. The last two parameters set the
    split of the work, never the result.
    """
    text = F.col(text_col)
    raw = F.coalesce(text, F.lit("")).cast("binary")
    own = ["doc_id", "source", "size", "text_crc32", "th", "ih", "s", "part", "copy", "hot", "rank", "rows", "u",
           "fraction", "cut", "position", "shard", "slot", "before", "n", "hots"]
    kept = {c: fresh(c, own) for c in keep}
    d = cut_lineage(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.md5(F.concat(F.when(text.isNull(), F.lit(f"0{seed}")).otherwise(F.lit(f"1{seed}")).cast("binary"), raw))
        .alias("th"),
        F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}"))).alias("ih"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("s"),
        *[F.col(c).alias(a) for c, a in kept.items()]), "shard-light")
    n = d.count()
    digits = max(1, math.ceil(math.log(max(n / rows_per_bucket, 1), 16)))
    d = d.withColumn("part", F.substring("th", 1, digits))
    # texts with more copies in a source than a bucket holds cut its buckets
    hot = cut_lineage(d.groupBy("s", "part", "th").agg(F.count(F.lit(1)).alias("n"))
                      .where(F.col("n") > rows_per_bucket).groupBy("s", "part")
                      .agg(F.collect_list("th").alias("hots")), "shard-hot")
    d = d.join(F.broadcast(hot) if small_enough(hot, 256) else hot, ["s", "part"], "left")
    below = F.array_max(F.filter(F.coalesce("hots", F.array().cast("array<string>")), lambda x: x <= F.col("th")))
    d = d.withColumn("hot", F.coalesce(below, F.lit(""))).drop("hots")
    d = d.withColumn("copy", F.when(F.col("hot") == F.col("th"), F.substring("ih", 1, digits)).otherwise(F.lit("z")))
    place = ["s", "part", "hot", "copy"]                # "z" sorts after all hex digits
    draw = F.conv(F.substring(F.md5(F.concat("s", F.lit(f"/{seed}"))), 1, 12), 16, 10).cast("double")
    before = (d.groupBy(*place).agg(F.count(F.lit(1)).alias("n"))
              .withColumn("before", _before(["s"], place[1:]))
              .withColumn("rows", F.sum("n").over(Window.partitionBy("s")))
              .withColumn("u", (draw + 0.5) / float(16 ** 12)).drop("n"))
    inside = Window.partitionBy(*place).orderBy("th", "ih", "doc_id", "size")
    d = d.withColumn("rank", F.row_number().over(inside) - 1).join(before, place)
    cuts = min(max_cuts, max(1, math.ceil(n / rows_per_bucket)))
    d = (d.withColumn("fraction", (F.col("rank") + F.col("before") + F.col("u")) / F.col("rows"))
         .withColumn("cut", F.least(F.floor(F.col("fraction") * cuts), F.lit(cuts - 1)).cast("int"))
         .select("doc_id", "source", "size", "text_crc32", "s", "th", "ih", "fraction", "cut", *kept.values()))
    d = cut_lineage(d, "shard-fractions")
    # at most max_cuts rows in this window
    before = d.groupBy("cut").agg(F.count(F.lit(1)).alias("n")).withColumn("before", _before([], ["cut"])).drop("n")
    line = Window.partitionBy("cut").orderBy("fraction", "s", "th", "ih", "doc_id")
    d = d.withColumn("position", F.row_number().over(line) - 1).join(before, "cut")
    d = d.withColumn("position", (F.col("position") + F.col("before")).cast("long"))
    n = max(n, 1)
    shard = F.expr(f"position * {n_shards} div {n}").cast("int")
    first = F.expr(f"(shard * {n}L + {n_shards - 1}) div {n_shards}")
    return (d.withColumn("shard", shard).withColumn("slot", F.col("position") - first)
            .select("doc_id", "source", "size", "text_crc32", "fraction", "position", "shard", "slot",
                    *kept.values()))


def write_shards(sharded: DataFrame, path: str, tasks_per_shard: int = 4) -> None:
    """One folder a shard, rows in slot order in and across its files."""
    sizes = sharded.groupBy("shard").agg((F.max("slot") + 1).alias("__rows"))   # one row a shard
    d = sharded.join(F.broadcast(sizes), "shard")
    part = F.floor(F.col("slot") * tasks_per_shard / F.col("__rows")).cast("int")
    (d.withColumn("part", part).repartition("shard", "part").sortWithinPartitions("shard", "part", "slot")
     .drop("__rows").write.mode("overwrite").partitionBy("shard", "part").parquet(path))


def query(spark, sf_dir):
    from .common import prepare, table
    prepare(spark)
    return assign_shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
