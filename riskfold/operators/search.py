"""Adaptive parameter search: Parzen estimators and successive halving.

A tree-structured Parzen estimator proposes trials: past trials are split into
the best share and the rest, each parameter gets a density of either (a mixture
of one kernel a trial and a flat prior), and of a few draws from the good
density the one with the largest ratio good / rest is taken. Trials run in
batches whose members know only earlier batches, so they are fitted
concurrently and a replay with the same seed is equal.

All trials are measured on the first rung: a nested prefix of the training rows
by md5, and the same share of the trial's trees. The better part goes on to the
next, larger rung, and the last one has all rows and trees. A trial's value is
that of the last rung it reached.
"""
from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Callable

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.draws import md5_uniform
from ..session import cut_lineage
from . import trees as TR

# The reference's space in terms of MLlib's forest: rounds, depth, row share,
# column share and least rows of a leaf; a least gain stands for its penalties.
SPACE = {
    "numTrees": ("int", 100, 400),
    "maxDepth": ("int", 3, 9),
    "subsamplingRate": ("float", 0.6, 1.0),
    "featureShare": ("float", 0.5, 1.0),
    "minInstancesPerNode": ("int", 1, 10),
    "minInfoGain": ("log", 1e-5, 1e-1),
}
TRIALS = 25
RUNGS = (1 / 9, 1 / 3, 1.0)
BATCH = 5
STARTUP = 10
GOOD_SHARE = 0.25
DRAWS = 24


@dataclass
class Trial:
    number: int
    params: dict
    value: float = float("nan")
    rung: int = -1
    first: float = float("nan")         # value on the first rung, on which all are compared
    extra: dict = field(default_factory=dict)


def _unit(spec, x: float) -> float:
    kind, lo, hi = spec
    if kind == "log":
        return (math.log(x) - math.log(lo)) / (math.log(hi) - math.log(lo))
    return (x - lo) / (hi - lo)


def _value(spec, u: float):
    kind, lo, hi = spec
    u = min(max(u, 0.0), 1.0)
    if kind == "log":
        return float(math.exp(math.log(lo) + u * (math.log(hi) - math.log(lo))))
    if kind == "int":
        return int(min(hi, max(lo, round(lo + u * (hi - lo)))))
    return float(lo + u * (hi - lo))


class Parzen:
    """Density on [0, 1]: a normal kernel a point, as wide as the larger gap to
    its neighbours, and one flat component."""

    def __init__(self, points):
        self.mu = np.sort(np.asarray(points, float))
        edges = np.concatenate(([0.0], self.mu, [1.0]))
        gap = np.maximum(edges[1:-1] - edges[:-2], edges[2:] - edges[1:-1])
        self.sigma = np.clip(gap, 1.0 / min(100, len(self.mu) + 1), 1.0)

    def draw(self, rng) -> float:
        k = int(rng.integers(0, len(self.mu) + 1))
        if k == len(self.mu):
            return float(rng.uniform())
        while True:
            x = rng.normal(self.mu[k], self.sigma[k])
            if 0 <= x <= 1:
                return float(x)

    def density(self, x: float) -> float:
        if not len(self.mu):
            return 1.0
        cdf = lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2)))
        inside = np.array([cdf((1 - m) / s) - cdf(-m / s) for m, s in zip(self.mu, self.sigma)])
        bell = np.exp(-0.5 * ((x - self.mu) / self.sigma) ** 2) / (self.sigma * math.sqrt(2 * math.pi))
        return float((bell / inside).sum() + 1.0) / (len(self.mu) + 1)


def suggest(history: list[Trial], number: int, seed: int = C.SEED, space: dict | None = None) -> dict:
    """Parameters of trial ``number`` given the trials measured so far."""
    space = space or SPACE
    rng = np.random.default_rng([seed, number])
    if len(history) < STARTUP:
        return {p: _value(spec, rng.uniform()) for p, spec in space.items()}
    ranked = sorted(history, key=lambda t: (-t.first, t.number))
    n_good = max(1, math.ceil(GOOD_SHARE * len(ranked)))
    out = {}
    for p, spec in space.items():
        good, rest = (Parzen([_unit(spec, t.params[p]) for t in part]) for part in (ranked[:n_good], ranked[n_good:]))
        draws = [good.draw(rng) for _ in range(DRAWS)]
        out[p] = _value(spec, max(draws, key=lambda u: good.density(u) / rest.density(u)))
    return out


def search(evaluate: Callable[[list[Trial], float], dict[int, float]], n_trials: int = TRIALS, rungs=RUNGS,
           keep: float = 1 / 3, batch: int = BATCH, seed: int = C.SEED, space: dict | None = None) -> list[Trial]:
    """All trials. ``evaluate(trials, share)`` gives the value (higher is better)
    of each trial's number on that share of the rows."""
    trials: list[Trial] = []
    while len(trials) < n_trials:
        new = [Trial(k, suggest(trials, k, seed, space)) for k in range(len(trials), min(n_trials, len(trials) + batch))]
        got = evaluate(new, rungs[0])
        for t in new:
            t.first = t.value = got[t.number]
            t.rung = 0
        trials += new
    alive = trials
    for r, share in enumerate(rungs[1:], 1):
        alive = sorted(alive, key=lambda t: (-t.value, t.number))[:max(1, math.ceil(keep * len(alive)))]
        got = evaluate(alive, share)
        for t in alive:
            t.value, t.rung = got[t.number], r
    return trials


def best_trial(trials: list[Trial]) -> Trial:
    last = max(t.rung for t in trials)
    return min((t for t in trials if t.rung == last), key=lambda t: (-t.value, t.number))


def forest_builder(params: dict, name: str = "Random Forest (tuned)"):
    from .models import fit_forest
    return lambda train, features: fit_forest(
        train, features, int(params["numTrees"]), int(params["maxDepth"]), int(params["minInstancesPerNode"]),
        subset=str(round(float(params["featureShare"]), 6)), subsample=float(params["subsamplingRate"]),
        min_gain=float(params["minInfoGain"]), name=name)


def forest_shape(params: dict, n_features: int) -> TR.Shape:
    return TR.Shape(int(params["numTrees"]), int(params["maxDepth"]), int(params["minInstancesPerNode"]),
                    float(params["minInfoGain"]), TR.subset_size(str(round(float(params["featureShare"]), 6)), n_features),
                    True, float(params["subsamplingRate"]))


class RungRows:
    """A view of blocks: a share of the rows of one fold's training set."""

    def __init__(self, fold: int, share: float):
        self.fold, self.share = fold, share

    def __call__(self, block: tuple) -> tuple:
        ids, y, x, fold, u = block
        mine = (fold == self.fold) & (u < self.share)
        return ids[mine], y[mine], x[:, mine]


def forest_trials(cv_train: DataFrame, valid: DataFrame, features: list[str], fold_col: str, k: int,
                  seed: int = C.SEED):
    """An ``evaluate`` for ``search``: mean AUC over the folds of a forest. The
    forests of all trials and folds are grown by one job; their predictions are
    written once and measured by one grouped query."""
    from .evaluate import roc_auc_ovr_macro
    cuts, n = TR.cut_points(cv_train, features)
    d = cv_train.withColumn("__u", md5_uniform(F.col(C.ID), seed, "rung"))
    blocks = TR.binned(d, features, cuts, C.LABEL, ["cv_fold", "__u"]).persist(StorageLevel.MEMORY_AND_DISK)
    spark = cv_train.sparkSession

    def scored(fits: dict[tuple[int, int], tuple]) -> DataFrame:
        """(model, y, pred, p0..p2): each row of ``valid`` by the forests of its fold."""
        import pyarrow as pa
        shared = spark.sparkContext.broadcast(fits)

        def run(batches):
            for b in batches:
                x = TR.codes(TR.columns(b, features), cuts)
                y, fold = (b.column(c).to_numpy(zero_copy_only=False) for c in (C.LABEL, fold_col))
                for (t, f), (trees, depth) in shared.value.items():
                    mine = fold == f
                    p = TR.class_shares(trees, x[:, mine], depth)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f"{t}|{f}"] * len(p)), pa.array(y[mine].astype(np.int32)),
                         pa.array(p.argmax(1).astype(np.int32)), *[pa.array(np.ascontiguousarray(p[:, c])) for c in range(3)]],
                        names=["model", "y", "pred", "p0", "p1", "p2"])
        return valid.select(C.LABEL, fold_col, *features).mapInArrow(
            run, "model string, y int, pred int, p0 double, p1 double, p2 double")

    def evaluate(trials: list[Trial], share: float) -> dict[int, float]:
        jobs = [(t, f) for t in trials for f in range(k)]
        shapes = [forest_shape({**t.params, "numTrees": max(10, round(t.params["numTrees"] * share))}, len(features))
                  for t, _ in jobs]
        grown = TR.grow_forests(blocks, n, len(features), 3, [(RungRows(f, share), s) for (_, f), s in zip(jobs, shapes)])
        fits = {(t.number, f): (trees, s.depth) for (t, f), trees, s in zip(jobs, grown, shapes)}
        scores: dict[int, list] = {}
        for r in roc_auc_ovr_macro(cut_lineage(scored(fits), "trials-scored")).collect():     # trials x folds rows
            scores.setdefault(int(r["model"].split("|")[0]), []).append((r["model"], r["roc_auc"] or 0.0))
        return {n: float(np.mean([x for _, x in sorted(v)])) for n, v in scores.items()}
    return evaluate


def history(spark, trials: list[Trial], rungs=RUNGS) -> DataFrame:
    """number, value, rung, row_share, params: one row a trial."""
    return spark.createDataFrame(
        [(t.number, float(t.value), t.rung, float(rungs[t.rung]), {k: float(v) for k, v in t.params.items()})
         for t in trials], "number int, value double, rung int, row_share double, params map<string,double>")
