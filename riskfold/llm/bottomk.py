"""Operator 8: bottom-k fingerprints of word shingles, in SQL functions only.

A fingerprint holds the K smallest 48-bit hashes of a text's distinct 5-word
shingles (words are separated by space and \\t..\\r; fewer than 5 words are one
shingle). Fingerprints of parts merge into that of the whole; two of them
estimate resemblance and containment, one the number of distinct shingles. Sets
below K are held whole, so their figures are exact.

``neighbours`` gives each document its successor by descending doc_id (the
first follows the last) without a global sort in one task: ids are cut into
ranges, a window runs inside a range, and the first row of each range is added
to the end of the range before it.

Cases: null text counts as empty; an empty or wordless text has the empty
fingerprint, which resembles only an empty one (1.0); a null doc_id comes last;
equal doc_ids are ordered by text; a table of one row follows itself; empty
table: no rows; other columns are ignored.
"""
from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 128
SHINGLE = 5
BITS = 48
MAX_RANGES = 10_000


def shingle_hashes(text: Column) -> Column:
    """array<bigint> of 48-bit hashes of all 5-word shingles (repeats kept)."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    # bound by one-element transforms, so words are split and hashed once
    hashed = F.transform(F.array(words), lambda w: F.transform(w, lambda x: F.xxhash64(x)))
    one = lambda h: F.shiftrightunsigned(F.xxhash64(h), 64 - BITS)
    return F.element_at(F.transform(hashed, lambda h: F.when(
        F.size(h) >= SHINGLE,
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(h) - (SHINGLE - 1), F.lit(1))),
                    lambda i: one(F.slice(h, i, SHINGLE))))
        .when(F.size(h) > 0, F.array(one(h)))
        .otherwise(F.array().cast("array<bigint>"))), 1)


def sketch(text: Column, k: int = K) -> Column:
    """Bottom-k sketch: the k smallest distinct shingle hashes, ascending."""
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(F.coalesce(text, F.lit(""))))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_parts(parts: DataFrame, key: str, sketch_col: str, k: int = K) -> DataFrame:
    """One sketch per key from many part sketches: hashes are made distinct by a
    shuffle, then only the k smallest of each key are gathered."""
    h = parts.select(key, F.explode(sketch_col).alias("h")).distinct()
    rank = F.row_number().over(Window.partitionBy(key).orderBy("h"))
    return (h.withColumn("r", rank).where(F.col("r") <= k).groupBy(key)
            .agg(F.sort_array(F.collect_list("h")).alias(sketch_col)))


def _sample(a: Column, b: Column, k: int) -> Column:
    whole = (F.size(a) < k) & (F.size(b) < k)          # both sets are known whole
    return F.slice(F.sort_array(F.array_union(a, b)), 1, F.when(whole, F.lit(2 * k)).otherwise(F.lit(k)))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of |A & B| / |A | B| (1.0 for two empty sets)."""
    u = _sample(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), u))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / F.size(u))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of |A & B| / |A|: the share of A's sampled hashes that B holds,
    below the least threshold that both sketches cover."""
    top = lambda s: F.when(F.size(s) < k, F.lit(2 ** BITS)).otherwise(F.element_at(s, -1))
    bar = F.least(F.when(F.size(a) == 0, F.lit(2 ** BITS)).otherwise(top(a)),
                  F.when(F.size(b) == 0, F.lit(2 ** BITS)).otherwise(top(b)))
    seen = F.filter(a, lambda x: x <= bar)
    return F.when(F.size(a) == 0, F.lit(1.0)).when(F.size(seen) == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(seen, b)) / F.size(seen))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles (exact below k)."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(
        F.lit(float(k - 1) * 2 ** BITS) / F.element_at(a, -1))


def to_string(a: Column) -> Column:
    return F.array_join(a.cast("array<string>"), ",")


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", derived=None,
               rows_per_range: int = 500) -> DataFrame:
    """doc_id, text, next_text (and, per name of ``derived`` {name: text ->
    Column}, name and next_name) with null texts as empty ones."""
    derived = derived or {}
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = d.select("doc_id").count()
    ranges = min(MAX_RANGES, max(1, n // rows_per_range))
    lowest = -1.7e308                       # nulls: below every id
    at = F.coalesce(F.col("doc_id").cast("double"), F.lit(lowest))
    cuts = []
    if ranges > 1:
        cuts = d.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)],
                                         min(10 * ranges, 100_000))).first()[0] or []
        cuts = sorted({float(x) for x in cuts})
    if cuts:
        cutter = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="at", outputCol="range")
        put = lambda x: cutter.transform(x.withColumn("at", at)).drop("at")
    else:
        put = lambda x: x.withColumn("range", F.lit(0.0))
    d = put(d)
    # highest id of each range (MAX_RANGES rows at most) and the range it also closes
    top = put(docs.select(F.col(id_col).alias("doc_id"))).groupBy("range").agg(F.max("doc_id").alias("top"))
    w = Window.orderBy("range")
    top = top.select("top", F.coalesce(F.lead("range").over(w), F.min("range").over(
        w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("closes"))
    last = (d.select("doc_id", "text").join(F.broadcast(top), F.col("doc_id").eqNullSafe(F.col("top")))
            .groupBy("closes").agg(F.min("text").alias("text"))
            .select(F.lit(None).cast(d.schema["doc_id"].dataType).alias("doc_id"), "text",
                    F.col("closes").alias("range"), F.lit(1).alias("end")))
    d = d.withColumn("end", F.lit(0)).unionByName(last)
    for name, f in derived.items():
        d = d.withColumn(name, f(F.col("text")))
    w = Window.partitionBy("range").orderBy("end", F.col("doc_id").desc_nulls_last(), "text")
    cols = ["text", *derived]
    d = d.select("doc_id", "end", *cols, *[F.lead(c).over(w).alias(f"next_{c}") for c in cols])
    return d.where("end = 0").drop("end")


def query(spark, sf_dir):
    from .common import prepare, sha_hex, table
    prepare(spark)
    d = neighbours(table(spark, sf_dir, "documents"), derived={"fp": sketch})
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.char_length("text") - half),
                      F.substring("next_text", F.lit(1), half))
    d = d.withColumn("edited", edited).withColumn("efp", sketch(F.col("edited")))
    return d.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), sha_hex(F.col("edited")).alias("edited_sha256"),
        to_string(F.col("fp")).alias("fingerprint"), to_string(F.col("efp")).alias("edited_fingerprint"),
        resemblance(F.col("fp"), F.col("efp")).alias("near_edited"),
        resemblance(F.col("fp"), F.col("next_fp")).alias("near_next"),
        distinct_count(F.col("fp")).alias("n_shingles_estimate"))
