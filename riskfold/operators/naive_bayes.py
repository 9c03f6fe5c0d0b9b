"""Gaussian naive Bayes in closed form.

Fit = one grouped aggregate (count, mean, population variance per class and
feature; variance smoothing 1e-9 x the largest feature variance). Scoring is
pure column arithmetic, so it stays in whole-stage codegen and a DuckDB
query can reproduce it term by term.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C

VAR_SMOOTHING = 1e-9


@dataclass
class GaussianNB:
    classes: list[int]
    n: dict[int, int]
    mean: dict[tuple[int, str], float]
    var: dict[tuple[int, str], float]   # smoothed
    features: list[str]

    def const(self, k: int) -> float:
        total = sum(self.n.values())
        s = math.log(self.n[k] / total)
        t = 0.0
        for f in self.features:
            t = t + math.log(2 * math.pi * self.var[(k, f)])
        return s - 0.5 * t

    def jll(self, k: int) -> Column:
        q = None
        for f in self.features:
            d = F.col(f) - F.lit(self.mean[(k, f)])
            term = d * d / F.lit(self.var[(k, f)])
            q = term if q is None else q + term
        return F.lit(self.const(k)) - 0.5 * q


def gaussian_nb_fit(train: DataFrame, features: list[str], label: str = C.LABEL) -> GaussianNB:
    aggs = [F.count(F.lit(1)).alias("n")]
    for f in features:
        aggs += [F.avg(f).alias(f"m__{f}"), F.var_pop(f).alias(f"v__{f}")]
    rows = train.groupBy(label).agg(*aggs).collect()  # one row per class
    overall = train.agg(*[F.var_pop(f).alias(f) for f in features]).first()
    eps = VAR_SMOOTHING * max((overall[f] or 0.0) for f in features)
    classes = sorted(r[label] for r in rows)
    byk = {r[label]: r for r in rows}
    return GaussianNB(
        classes, {k: byk[k]["n"] for k in classes},
        {(k, f): byk[k][f"m__{f}"] for k in classes for f in features},
        {(k, f): (byk[k][f"v__{f}"] or 0.0) + eps for k in classes for f in features},
        list(features))


def argmax_first(cols: list[Column]) -> Column:
    """Index of the largest value; ties go to the lowest index."""
    expr = None
    for i in range(len(cols) - 1, -1, -1):
        cond = None
        for j, c in enumerate(cols):
            if j == i:
                continue
            cmp = (cols[i] >= c) if j > i else (cols[i] > c)
            cond = cmp if cond is None else cond & cmp
        expr = F.when(cond, i) if expr is None else F.when(cond, i).otherwise(expr)
    return expr


def softmax_columns(scores: list[Column], prefix: str = "p") -> dict[str, Column]:
    mx = F.greatest(*scores)
    ex = [F.exp(s - mx) for s in scores]
    tot = ex[0]
    for e in ex[1:]:
        tot = tot + e
    return {f"{prefix}{i}": e / tot for i, e in enumerate(ex)}


def gaussian_nb_score(df: DataFrame, model: GaussianNB) -> DataFrame:
    d = df.withColumns({f"__jll{k}": model.jll(k) for k in model.classes})
    jll = [F.col(f"__jll{k}") for k in model.classes]
    d = d.withColumns(softmax_columns(jll))
    d = d.withColumn("pred", argmax_first(jll).cast("int"))
    return d.drop(*[f"__jll{k}" for k in model.classes])
