"""Operator 5: quality by naive Bayes support vectors.

Features are indicators of n-grams (n = 1..3) over token shapes: letters become
``A`` or ``a``, digits ``0``, runs of one sign are cut to one, other signs stay,
and a token equal to the one before it is marked as a repeat. Shapes carry over
between vocabularies, where words do not. N-grams are hashed to 2 ** 18 columns.

Each indicator is scaled by its class log-count ratio, then an L2-regularised
squared-hinge linear model is fitted by dual coordinate descent, and its margin
is calibrated on a quarter of the sample that it did not see. The sample is
about MAX_FIT labelled documents outside the held-out fold, taken by hash;
scoring reads every whole text, in tasks of bounded batches.

Cases: null and empty texts score as texts without n-grams (the bias alone);
without labels of both classes every score is the share of label 1 (0.5 without
labels); repeated rows score alike; empty table: no rows; ``keep`` columns pass.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_score, crc_fold, dual_coordinate_descent, labelled_sample, platt, text_bytes
from .parity_join import _SPACE, _word_hashes, mix

BITS = 18
MAX_FIT = 8000                  # labelled documents in the fit, about
CUTOFF = 0.7
_U = np.uint64
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58], _SHAPE[128:] = 65, 97, 48, 97
_PIECE = 1 << 20


def _tokens(data: bytes) -> np.ndarray:
    """One hash per token: its shape and whether it repeats the token before."""
    out, at = [], 0
    last = None
    while at < len(data):
        end = min(len(data), at + _PIECE)
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        raw = np.frombuffer(data, np.uint8, end - at, at)
        none = np.zeros(len(raw), bool)
        word, _ = _word_hashes(raw, ~_SPACE[raw], none)
        shape = _SHAPE[raw].copy()
        shape[_SPACE[raw]] = 32
        keep = np.ones(len(raw), bool)
        keep[1:] = shape[1:] != shape[:-1]
        shape = shape[keep]
        code, _ = _word_hashes(shape, shape != 32, none[:len(shape)])
        if len(word):
            same = np.empty(len(word), bool)
            same[0] = last is not None and word[0] == last
            same[1:] = word[1:] == word[:-1]
            last = word[-1]
            out.append(code + same.astype(_U))
        at = end
    return np.concatenate(out) if out else np.zeros(0, _U)


def features(data: bytes) -> np.ndarray:
    """Sorted distinct feature columns of a text (UTF-8 bytes)."""
    t = _tokens(data)
    grams = [mix(t, 51)]
    if len(t) > 1:
        two = t[:-1] * _U(0xD6E8FEB86659FD93) + t[1:]
        grams.append(mix(two, 52))
        if len(t) > 2:
            grams.append(mix(two[:-1] * _U(0xD6E8FEB86659FD93) + t[2:], 53))
    return np.unique(np.concatenate(grams) >> _U(64 - BITS)).astype(np.int64)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_fit: int = MAX_FIT,
        id_col: str = "doc_id", text_col: str = "text", c: float = 1.0) -> dict:
    """{w, a, b}: column weights (with the log-count ratios multiplied in, bias
    last) and the calibration."""
    import pyarrow as pa
    sample = labelled_sample(docs, labels, label_col, max_fit, id_col, text_col)

    def run(batches):
        for batch in batches:
            data, off, _ = text_bytes(batch.column("text"))
            f = [features(data[a:b]) for a, b in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("y"), pa.array(f, pa.list_(pa.int64()))],
                names=["doc_id", "y", "f"])
    rows = sample.mapInArrow(run, "doc_id long, y int, f array<bigint>").collect()
    rows.sort(key=lambda r: r.doc_id)
    return train([np.array(r.f, np.int64) for r in rows], np.array([1 if r.y else -1 for r in rows]), c)


def train(feats, y: np.ndarray, c: float = 1.0) -> dict:
    dim = 1 << BITS
    if len(set(y.tolist())) < 2:
        share = float((y > 0).mean()) if len(y) else 0.5
        return {"w": np.zeros(dim + 1), "a": 0.0, "b": float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))}
    # log-count ratios of indicators, add-one
    p, q = np.ones(dim), np.ones(dim)
    for f, s in zip(feats, y):
        (p if s > 0 else q)[f] += 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    held = np.arange(len(y)) % 4 == 3
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.zeros(len(y), bool)
    # unit length: long and short texts weigh alike
    rows = []
    for f in feats:
        v = ratio[f]
        rows.append((f, v / max(np.sqrt(len(f)), 1.0)))
    w = dual_coordinate_descent([r for r, h in zip(rows, held) if not h], y[~held], dim, c)
    use = held if held.any() else np.ones(len(y), bool)
    margin = np.array([w[f] @ v + w[dim] for f, v in rows])
    a, b = platt(margin[use], y[use])
    w[:dim] *= ratio
    return {"w": w, "a": a, "b": b}


def score_texts(texts, model: dict) -> np.ndarray:
    """Scores of an Arrow string array."""
    data, off, _ = text_bytes(texts)
    w = model["w"]
    out = np.empty(len(off) - 1)
    for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
        f = features(data[a:b])
        out[i] = w[f].sum() / max(np.sqrt(len(f)), 1.0) + w[-1]
    return 1 / (1 + np.exp(-np.clip(model["a"] * out + model["b"], -40, 40)))


def score_documents(docs: DataFrame, labels: DataFrame, keep=("doc_id",), text_col: str = "text",
                    label_col: str = "quality", max_fit: int = MAX_FIT) -> DataFrame:
    """``keep`` columns and ``score`` (0 to 1, higher: label 1 likelier)."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label_col, max_fit, text_col=text_col))
    return add_score(docs, text_col, keep, lambda: lambda t: score_texts(t, model.value))


def query(spark, sf_dir):
    from .common import prepare, table
    prepare(spark)
    d = score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return d.select("doc_id", F.coalesce(crc_fold("doc_id") == 2, F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
