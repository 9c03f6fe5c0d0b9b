"""Registered query: streaming scorer over applications written as files."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..operators.naive_bayes import gaussian_nb_fit
from ..sources import files
from ..streaming.score_stream import forest_file_scorer, nb_scorer, run_stream
from . import pipeline as PL
from . import training as T
from .oracle_sql import with_ctes
from .registry import register


@register("stream_score", "borrower_id bigint, p1 double, p2 double, score bigint, range_lo bigint, "
                          "range_hi bigint, delta bigint",
          with_ctes("deviation", "SELECT borrower_id, p1, p2, score, range_lo, range_hi, score - range_mid AS delta "
                                 "FROM appsc"), ops=(86,))
def q_stream(spark, sf):
    """Applications (borrower inputs without label) are written by Spark as
    parquet files; a stream scores them with the saved scorer fitted on the
    training rows; the batch scorer gives the same rows (the SQL oracle)."""
    split = PL.split_borrowers(spark, sf)
    prep, state = PL.fit_prepare(split)
    nb = gaussian_nb_fit(prep.filter(F.col("split") == "train"), C.ALL_FEATURES)
    return _streamed(spark, split, nb_scorer(state, nb))


def _streamed(spark, split, scorer):
    apps = split.drop(C.LABEL, "split", "fold5", "fold3")
    src = files.scratch_path(spark, "applications")
    apps.write.mode("overwrite").parquet(src)
    saved = scorer.save(spark, files.scratch_path(spark, "scorer"))
    out, ckpt = files.scratch_path(spark, "stream-out"), files.scratch_path(spark, "stream-ckpt")
    return run_stream(spark, src, apps.schema, saved, out, ckpt)


@register("stream_score_best", "borrower_id bigint, p0 double, p1 double, p2 double, pred int, score bigint, "
                               "range_lo bigint, range_hi bigint, delta bigint", None, ops=(86,))
def q_stream_best(spark, sf):
    """The stream with the forest that the search selected."""
    b = T.base(spark, sf)
    scorer = forest_file_scorer(b["state"], T.fitted(spark, sf, T.TUNED_FOREST))
    return _streamed(spark, PL.split_borrowers(spark, sf), scorer)
