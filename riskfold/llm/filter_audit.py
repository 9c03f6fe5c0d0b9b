"""Operator 12: interaction audit of filters by sorted posting lists.

Each filter keeps, per part, the sorted list of ids of the documents that fail
it. What an order of filters removes follows from sizes of unions alone: with
U(S) the ids that fail any filter of S, filter f after the filters S removes
U(S + f) \\ U(S), is redundant on |f| minus that, fails alone on
U(all) \\ U(all - f), and its Shapley value adds the removals of all orders. So
the audit needs |U(S)| for the 2^k sets S, per part, once in all, once among the
documents of each label.

Postings are dealt by ranges of (part, id): Spark samples the ranges, so a part
with a third of all rows spans many, and a task streams through its sorted ids
in blocks. In a block, U(S) is merged from U(S without its last filter) and that
filter's list: the shorter list gallops through the longer one (each id is
searched onwards from the last one's place). Blocks hold different ids, so
sizes add up; a part ends as 2^k triples.

Rows with equal (part, id, failed filters, labels) are one posting with a weight,
and postings of one id that differ elsewhere are kept apart, so repeated rows
and repeated ids count as documents of their own.

Cases: null text is the empty text; a null part is the part ""; a null id is no
duplicate of anything and makes nothing a duplicate (its rows get no labels);
equal ids with equal texts are not duplicates of each other (no smaller id);
null labels count as 0 and repeated labels by their largest; an empty table
gives no rows; other columns are ignored. Texts are read whole, once.
"""
from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut_lineage

FILTERS = "ABCDE"
MIN_WORDS = 200
ROWS_PER_TASK = 200_000


def duplicate_of_smaller(d: DataFrame, text_hash: str = "th", id_col: str = "doc_id") -> DataFrame:
    """``d`` with boolean ``later``: a smaller id has the same text.

    Each text's smallest id is joined back by (text, id), so a text with a third
    of all rows is spread by its ids."""
    first = (d.where(F.col(id_col).isNotNull()).groupBy(text_hash).agg(F.min(id_col).alias(id_col))
             .withColumn("__first", F.lit(True)))
    return (d.join(first, [text_hash, id_col], "left")
            .withColumn("later", F.col(id_col).isNotNull() & F.col("__first").isNull()).drop("__first"))


def text_failures(text: Column) -> dict[str, Column]:
    """Conditions A to D on a non-null text."""
    words = F.regexp_extract_all(text, F.lit(SPACE), F.lit(0))
    upper = F.char_length(text) - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": F.size(words) < MIN_WORDS,
            "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
            "C": 100 * upper > 2 * F.char_length(text),
            "D": text.rlike(r"[#$%&*|]")}


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             part_col: str = "source") -> DataFrame:
    """part, doc_id, mask (bit i: fails filter i), good, toxic: one row a document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bits = text_failures(text)
    mask = sum((F.when(bits[f], 1 << i).otherwise(0) for i, f in enumerate("ABCD")), F.lit(0))
    d = cut_lineage(docs.select(
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(id_col).alias("doc_id"),
        F.unhex(F.md5(text.cast("binary"))).alias("th"), mask.alias("mask")), "audit-texts")
    d = duplicate_of_smaller(d).withColumn("mask", F.col("mask") + F.when(F.col("later"), 1 << 4).otherwise(0))
    lab = (labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id")
           .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"),
                F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return d.join(lab, "doc_id", "left").select("part", "doc_id", "mask", zero("good").alias("good"),
                                                zero("toxic").alias("toxic"))


def gallop_absent(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in ``long``, mask) of the ids of ``short`` that ``long`` lacks.
    Both sorted: each search starts at the place of the one before it."""
    at = np.searchsorted(long, short)
    if not len(long):
        return at, np.ones(len(short), bool)
    return at, long[np.minimum(at, len(long) - 1)] != short


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sorted union of two sorted lists, by galloping the shorter through the other."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    at, new = gallop_absent(short, long)
    return np.insert(long, at[new], short[new])


def union_sizes(lists: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """Sums of the ``weights`` rows of U(S) for every set S of filters (bits).

    ``lists`` hold sorted ids, places in ``weights``."""
    out = np.zeros((1 << len(lists), weights.shape[1]), np.int64)
    unions = {0: np.zeros(0, np.int64)}
    for s in range(1, 1 << len(lists)):
        last = s.bit_length() - 1
        unions[s] = merge(unions[s & ~(1 << last)], lists[last])
        out[s] = weights[unions[s]].sum(0)
    return out


def posting_sums(postings: DataFrame, n_filters: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(part, failed, n, good, toxic): weights of U(failed) per part and block.

    ``postings``: part, doc_id, mask, good, toxic, weight, with mask > 0."""
    import pyarrow as pa
    postings = cut_lineage(postings, "audit-postings")
    n = postings.count()
    d = (postings.repartitionByRange(max(1, -(-n // rows_per_task)), "part", "doc_id", "mask", "good", "toxic")
         .sortWithinPartitions("part", "doc_id", "mask", "good", "toxic"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            mask, good, toxic, weight = (batch.column(c).to_numpy() for c in ("mask", "good", "toxic", "weight"))
            part = batch.column("part").dictionary_encode()
            code = part.indices.to_numpy()
            cut = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1], [True])))
            rows = []
            for lo, hi in zip(cut[:-1], cut[1:]):
                # rows are sorted by (id, variant): their places are the block's ids
                ids = np.arange(hi - lo, dtype=np.int64)
                w = np.stack([weight[lo:hi], weight[lo:hi] * good[lo:hi], weight[lo:hi] * toxic[lo:hi]], 1)
                lists = [ids[(mask[lo:hi] >> f) & 1 == 1] for f in range(n_filters)]
                rows.append((part.dictionary[int(code[lo])].as_py(), union_sizes(lists, w)))
            sizes = np.concatenate([x for _, x in rows])
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, x in rows for _ in range(len(x))], pa.string()),
                 pa.array(np.tile(np.arange(1 << n_filters, dtype=np.int32), len(rows))),
                 *[pa.array(np.ascontiguousarray(sizes[:, k])) for k in range(3)]],
                names=["part", "failed", "n", "good", "toxic"])
    return d.mapInArrow(run, "part string, failed int, n long, good long, toxic long")


def audit(rows: DataFrame, filters: str = FILTERS, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The audit of ``rows`` (part, doc_id, mask, good, toxic): per part, order of
    the filters and step the columns of the report."""
    k = len(filters)
    postings = (rows.where("mask > 0").groupBy("part", "doc_id", "mask", "good", "toxic")
                .agg(F.count(F.lit(1)).alias("weight")))
    sums = (posting_sums(postings, k, rows_per_task).groupBy("part", "failed")
            .agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")))
    one = sums.groupBy("part").agg(*[
        F.map_from_entries(F.collect_list(F.struct("failed", c))).alias(f"u_{c}")     # 2^k entries
        for c in ("n", "good", "toxic")])
    parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("docs")).join(one, "part", "left")
    orders = F.array(*[F.lit("".join(p)) for p in permutations(filters)])
    d = (parts.withColumn("filter_order", F.explode(orders))
         .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k)))))
    at = {f: F.instr("filter_order", f) for f in filters}
    d = d.withColumn("done", sum((F.when(at[f] < F.col("step"), 1 << i).otherwise(0)
                                  for i, f in enumerate(filters)), F.lit(0)))
    d = d.withColumn("own", sum((F.when(at[f] == F.col("step"), 1 << i).otherwise(0)
                                 for i, f in enumerate(filters)), F.lit(0)))
    size = lambda c, s: F.coalesce(F.try_element_at(f"u_{c}", s.cast("int")), F.lit(0)).cast("long")
    done, own, everything = F.col("done"), F.col("own"), F.lit((1 << k) - 1)
    gain = lambda c: size(c, done + own) - size(c, done)
    shapley = F.lit(0).cast("long")
    for s in range(1 << k):                 # orders in which exactly the filters s come before the step's
        times = factorial(bin(s).count("1")) * factorial(max(0, k - 1 - bin(s).count("1")))
        here = F.lit(s)
        shapley = shapley + F.when(here.bitwiseAND(own) == 0, times * (size("n", here + own) - size("n", here))
                                   ).otherwise(0)
    return d.select(
        "part", "filter_order", "step", (F.col("docs") - size("n", done + own)).alias("kept"),
        gain("n").alias("removed"), (size("n", own) - gain("n")).alias("redundant"),
        (size("n", everything) - size("n", everything - own)).alias("unique_fails"),
        gain("good").alias("good_lost"), gain("toxic").alias("toxic_lost"), shapley.cast("long").alias("shapley"))


def query(spark, sf_dir):
    from .common import prepare, table
    prepare(spark)
    rows = cut_lineage(failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), "audit-rows")
    return audit(rows)


SQL = r"""
WITH w AS (
  SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
lab AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic
        FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
         + 4 * (100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text))::INT
         + 8 * regexp_matches(text, '[#$%&*|]')::INT
         + 16 * coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), false)::INT AS mask
  FROM w LEFT JOIN lab ON w.doc_id = lab.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a JOIN f b ON b.f <> a.f JOIN f c ON c.f NOT IN (a.f, b.f) JOIN f d ON d.f NOT IN (a.f, b.f, c.f)
  JOIN f e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
s AS (SELECT filter_order, step::INT AS step, bits[step] AS own,
             coalesce(list_sum(bits[1:step - 1]), 0)::INT AS done FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
t AS (
  SELECT part, filter_order, step, own,
         sum(CASE WHEN mask & (done + own) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & done = 0 AND mask & own > 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & done > 0 AND mask & own > 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & done = 0 AND mask & own > 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & done = 0 AND mask & own > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM t
"""
