"""Helpers shared by the training-data operators.

Text reaches Python as Arrow batches (bounded by Spark's
``maxRecordsPerBatch`` / ``maxBytesPerBatch``); ``text_bytes`` exposes a
batch's UTF-8 buffer without decoding, so tokenising is byte translation,
``split`` or numpy, never a per-character Python loop.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, ensure_checkpoint_dir, ship_package
from ..sources.tables import table

__all__ = ["prepare", "table", "cut_lineage", "fresh", "sha_hex", "text_bytes",
           "crc_fold", "release", "small_enough", "with_row_key", "components", "SPACE"]

SPACE = r"[^\x20\x09-\x0D]+"       # a word of the white-space tokeniser


ARROW_BATCH_BYTES = 8 << 20     # of a batch that a Python worker gets


def release(spark: SparkSession) -> None:
    """Let go of what ended queries left: plans, broadcasts and shuffle files are
    only cleaned once the driver's collectors meet them."""
    import gc
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder, package for executors and small Arrow batches, so that
    a Python worker's memory does not depend on row counts (idempotent)."""
    release(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(name)).rstrip("b")) > ARROW_BATCH_BYTES:
        spark.conf.set(name, str(ARROW_BATCH_BYTES))
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def fresh(name: str, taken) -> str:
    """``name``, with underscores appended while a column already uses it."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name += "_"
    return name


def sha_hex(c: Column) -> Column:
    """Lowercase hex SHA-256 of a string's UTF-8 bytes."""
    return F.sha2(c.cast("binary"), 256)


def crc_fold(id_col: str) -> Column:
    """Fold 0..3 of a row: crc32 of the id's decimal text modulo 4."""
    return (F.crc32(F.col(id_col).cast("string").cast("binary")) % 4).cast("int")


def text_bytes(arr):
    """(data, offsets, valid) of an Arrow string array, no decoding.

    ``data[offsets[i]:offsets[i + 1]]`` are the UTF-8 bytes of row i (empty
    for null); ``valid`` is a boolean array.
    """
    import pyarrow as pa
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    n = len(arr)
    if n == 0:
        return b"", np.zeros(1, np.int64), np.zeros(0, bool)
    valid = np.asarray(arr.is_valid())
    if not valid.all():
        arr = arr.fill_null("")
    dt, w = (np.int64, 8) if pa.types.is_large_string(arr.type) else (np.int32, 4)
    bufs = arr.buffers()
    off = np.frombuffer(bufs[1], dt, n + 1, arr.offset * w).astype(np.int64)
    data = b"" if bufs[2] is None else bufs[2].to_pybytes()[off[0]:off[-1]]
    return data, off - off[0], valid


def with_row_key(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with two long columns that tell all its rows apart, equal ones
    too, and their names: the file and the place in it of a Parquet row. What is
    no plain read of Parquet is written first."""
    from pyspark.errors import AnalysisException
    names = [fresh("__file", docs.columns), fresh("__place", docs.columns)]

    def keyed(d):
        return d.select("*", F.xxhash64("_metadata.file_path").alias(names[0]),
                        F.col("_metadata.row_index").alias(names[1]))
    try:
        return keyed(docs), names
    except AnalysisException:
        return keyed(cut_lineage(docs, "rows")), names


def small_enough(df: DataFrame, row_bytes: int, limit: int = 32 << 20) -> bool:
    """True when ``df`` holds at most ``limit`` bytes at ``row_bytes`` a row.

    Only picks broadcast or shuffle for a join; both give the same rows.
    """
    return df.count() * row_bytes <= limit


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every end of ``edges``; equal roots = connected.

    Contraction: each node takes the least node among itself and its
    neighbours, edges are rewritten to those and repeated until none is
    left. Node ids here are hash values, so chains shrink by a constant factor
    a round. All rounds are joins and grouped minima; each is written to the
    shared folder, nothing is collected but the number of edges left.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    e = cut_lineage(e.distinct(), "cc-edges")
    nodes = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
    labels = cut_lineage(nodes.withColumn("root", F.col("node")), "cc-labels")
    while not e.isEmpty():
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("p"))
        ra = up.select(F.col("v").alias("a"), F.col("p").alias("pa"))
        rb = up.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        left = (e.join(ra, "a").join(rb, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
                .where("a <> b").distinct())
        labels = cut_lineage(
            labels.join(up.select(F.col("v").alias("root"), "p"), "root", "left")
            .select("node", F.coalesce("p", "root").alias("root")), "cc-labels")
        e = cut_lineage(left, "cc-edges")
    return labels


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, max_docs: int,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, y) of about ``max_docs`` labelled documents outside the
    held-out fold, taken by a hash of the id. Repeated labels: the largest
    counts; null ids, labels and texts are left out."""
    y = (labels.where(F.col(label_col).isNotNull() & (crc_fold("doc_id") != 2))
         .groupBy("doc_id").agg(F.max(F.col(label_col).cast("int")).alias("y")))
    n = y.count()
    if n > max_docs:
        y = y.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) < int((1 << 31) * max_docs / n))
    # about max_docs rows by the line above: a bounded broadcast
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    # of a repeated doc_id the least text, whatever the order of the rows
    return d.join(F.broadcast(y), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))


def add_score(docs: DataFrame, text_col: str, keep, make_scorer, name: str = "score") -> DataFrame:
    """``keep`` columns plus a double column ``name`` (its clashing name gets an
    underscore). ``make_scorer()`` runs once a task and returns a function from
    a list of texts (null as empty) to an array of scores."""
    import pyarrow as pa
    keep = list(keep)
    text = fresh("__text", keep)
    name = fresh(name, keep)
    d = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias(text))

    def run(batches):
        score = make_scorer()
        for batch in batches:
            t = batch.column(text)
            got = [score(t.slice(i, 500)) for i in range(0, len(t), 500)]
            got = np.concatenate(got) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(got, pa.float64())],
                                             names=keep + [name])
    from pyspark.sql import types as T
    return d.mapInArrow(run, T.StructType([d.schema[c] for c in keep] + [T.StructField(name, T.DoubleType())]))


def dual_coordinate_descent(rows, y: np.ndarray, dim: int, c: float = 1.0, epochs: int = 30, seed: int = 1):
    """Weights of an L2-regularised squared-hinge linear model (dual coordinate
    descent). ``rows``: per example (indices, values); ``y``: +1 or -1. The last
    of the ``dim`` + 1 weights is the bias. Classes weigh alike in total."""
    rng = np.random.default_rng(seed)
    w = np.zeros(dim + 1)
    n = len(y)
    pos = max(1, int((y > 0).sum()))
    cost = np.where(y > 0, c * n / (2 * pos), c * n / (2 * max(1, n - pos)))
    diag = 1 / (2 * cost)
    q = np.array([v @ v + 1.0 for _, v in rows]) + diag
    alpha = np.zeros(n)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(n):
            idx, v = rows[i]
            g = y[i] * (w[idx] @ v + w[dim]) - 1 + diag[i] * alpha[i]
            new = max(0.0, alpha[i] - g / q[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[idx] += step * v
                w[dim] += step
                worst = max(worst, abs(step))
                alpha[i] = new
        if worst < 1e-4:
            break
    return w


def platt(margin: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """(a, b) of the logistic calibration 1 / (1 + exp(-(a * margin + b))).

    Newton steps on the scaled margins, halved until the loss falls: full steps
    can overshoot to a calibration that is flat or upside down."""
    pos, neg = float((y > 0).sum()), float((y <= 0).sum())
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    unit = float(np.std(margin)) or 1.0
    x = margin / unit

    def loss(a, b):
        z = a * x + b
        return float((np.logaddexp(0, z) - t * z).sum())
    a, b = 0.0, float(np.log((pos + 1) / (neg + 1)))
    now = loss(a, b)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        s = np.maximum(p * (1 - p), 1e-12)
        h = np.array([[(s * x * x).sum() + 1e-9, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-9]])
        step = np.linalg.solve(h, [((t - p) * x).sum(), (t - p).sum()])
        size = 1.0
        while size > 1e-9 and not loss(a + size * step[0], b + size * step[1]) < now:
            size /= 2
        if size <= 1e-9:
            break
        a, b = a + size * step[0], b + size * step[1]
        before, now = now, loss(a, b)
        if before - now < 1e-9 * (1 + abs(now)):
            break
    return float(a / unit), float(b)
