"""Exact order statistics without holding a column in one task.

``exact_quantiles`` returns the same numbers as pandas ``quantile`` /
DuckDB ``quantile_cont`` (linear interpolation between the order statistics
at floor(h) and floor(h)+1, h = (n-1) p) but works by histogram refinement:

1. one aggregate gives n, min, max per column (NaN counts as missing);
2. one aggregate of mergeable quantile sketches proposes a narrow interval
   around every wanted rank; it only saves passes and decides nothing;
3. each pass counts, per column, the values between all cut points of its open
   intervals (one scan, every value in one bucket, partial aggregation, at most
   columns x ``COLUMN_CUTS`` rows or so reach the driver) and narrows each
   interval to the least and largest value of the bucket holding its rank, until
   these are equal. Cut points are equally spaced and, in turn, equally many
   floating-point numbers apart, so values that spread over many magnitudes
   converge as well. Infinite values are counted apart.

No value list is ever fetched, and there is one path for all sizes. Spark's own
``percentile`` keeps every distinct value of a group in one buffer, which is
unbounded at scale; ``percentile_approx`` alone is not exact.
"""
from __future__ import annotations

import math
import struct
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SKETCH = 1000                   # accuracy of the proposed intervals
COLUMN_CUTS = 512               # cut points of a column in one pass, about


@dataclass
class _Target:
    col: str
    rank: int          # 0-based order statistic wanted
    lo: float          # least and largest value that it can be
    hi: float
    value: float | None = None


def number(c: str):
    """The column as double, NaN as NULL."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def _finite(c: str):
    x = number(c)
    return F.when(F.abs(x) < float("inf"), x)


def order_statistics(df: DataFrame, wanted: dict[str, list[int]], stats: dict,
                     buckets: int = 256, max_passes: int = 200) -> dict[tuple[str, int], float]:
    """Exact k-th smallest non-missing value for each (column, k)."""
    inf = float("inf")
    wide = [c for c in wanted if stats[c][0] and (stats[c][1] == -inf or stats[c][2] == inf)]
    ends = {c: (0, 0, *stats[c][1:]) for c in wanted}       # infinite values below and above, finite range
    if wide:
        r = df.agg(*[a for c in wide for a in (
            F.count(F.when(number(c) == -inf, 1)), F.count(F.when(number(c) == inf, 1)),
            F.min(_finite(c)), F.max(_finite(c)))]).first()
        ends.update({c: tuple(r[4 * i:4 * i + 4]) for i, c in enumerate(wide)})
    targets: list[_Target] = []
    for c, ranks in wanted.items():
        n, (low, high, lo, hi) = stats[c][0], ends[c]
        for r in sorted(set(ranks)):
            if n and r < low:
                targets.append(_Target(c, r, -inf, -inf, -inf))
            elif n and r >= n - high:
                targets.append(_Target(c, r, inf, inf, inf))
            elif n:
                targets.append(_Target(c, r, lo, hi, lo if lo == hi else None))
    for k in range(max_passes):
        open_t: dict[str, list[_Target]] = {}
        for t in targets:
            if t.value is None:
                open_t.setdefault(t.col, []).append(t)
        if not open_t:
            break
        cuts = _sketched(df, open_t, stats) if k == 0 else {
            c: _cuts(ts, min(buckets, max(2, COLUMN_CUTS // len({(t.lo, t.hi) for t in ts}))), k % 2 == 0)
            for c, ts in open_t.items()}
        _refine(df, open_t, cuts, {c: ends[c][0] for c in open_t})
    out: dict[tuple[str, int], float] = {}
    for t in targets:
        if t.value is None:
            raise RuntimeError(f"order statistic of {t.col} did not converge")
        out[(t.col, t.rank)] = t.value
    return out


def _sketched(df: DataFrame, open_t: dict, stats: dict) -> dict[str, list[float]]:
    """Cut points around the wanted ranks by a quantile sketch a column."""
    cols = list(open_t)
    aggs = []
    for i, c in enumerate(cols):
        at = [t.rank / stats[c][0] + d for t in open_t[c] for d in (-2 / SKETCH, 0.0, 2 / SKETCH)]
        aggs.append(F.percentile_approx(_finite(c), sorted({min(max(p, 0.0), 1.0) for p in at}), SKETCH).alias(f"q{i}"))
    r = df.agg(*aggs).first()
    out = {}
    for i, c in enumerate(cols):
        lo, hi = open_t[c][0].lo, open_t[c][0].hi
        # a value and its successor: what is held by many rows gets a bucket of its own
        near = {x for v in r[i] or [] for x in (v, math.nextafter(v, math.inf))}
        out[c] = sorted({x for x in near if lo < x <= hi} | {math.nextafter(lo, math.inf), hi})
    return out


def _place(x: float) -> int:
    """Number of the floating-point value in their order."""
    i = struct.unpack("<q", struct.pack("<d", x))[0]
    return i if i >= 0 else -(i & 0x7FFFFFFFFFFFFFFF)


def _at(place: int) -> float:
    x = struct.unpack("<d", struct.pack("<q", abs(place)))[0]
    return x if place >= 0 else -x


def _cuts(targets: list, parts: int, by_place: bool) -> list[float]:
    """Cut points in and around the open intervals of a column."""
    out = set()
    for lo, hi in {(t.lo, t.hi) for t in targets}:
        a, b = _place(lo), _place(hi)
        inner = (_at(a + (b - a) * k // parts) if by_place else lo * (1 - k / parts) + hi * (k / parts)
                 for k in range(1, parts))
        # lo and hi get buckets of their own, and what lies outside none of these
        out.update(x for x in (*inner, lo, math.nextafter(lo, math.inf), hi) if lo <= x <= hi)
        out.update(x for x in (math.nextafter(hi, math.inf),) if x < math.inf)
    return sorted(out)


def _refine(df: DataFrame, open_t: dict, cuts: dict, below: dict) -> None:
    """Narrows the open intervals by one count of all values between cut points.
    ``below``: infinite values that come before the finite ones."""
    cols = list(open_t)
    d = df.select(*[_finite(c).alias(f"x{i}") for i, c in enumerate(cols)])
    d = Bucketizer(splitsArray=[[-math.inf, *cuts[c], math.inf] for c in cols],
                   inputCols=[f"x{i}" for i in range(len(cols))], outputCols=[f"b{i}" for i in range(len(cols))],
                   handleInvalid="keep").transform(d)
    hist = (d.select(F.inline(F.array(*[F.struct(F.lit(i).alias("g"), F.col(f"b{i}").cast("int").alias("b"),
                                                 F.col(f"x{i}").alias("x")) for i in range(len(cols))])))
            .where(F.col("x").isNotNull())
            .groupBy("g", "b").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("mn"), F.max("x").alias("mx")))
    rows: dict[int, list] = {}
    for r in hist.collect():  # at most a row a cut point
        rows.setdefault(r.g, []).append((r.b, r.n, r.mn, r.mx))
    for i, c in enumerate(cols):
        acc, todo = below[c], sorted(open_t[c], key=lambda t: t.rank)
        for _, n, mn, mx in sorted(rows.get(i, [])):
            while todo and todo[0].rank < acc + n:
                t = todo.pop(0)
                t.lo, t.hi = mn, mx
                if mn == mx:
                    t.value = mn
            acc += n


def column_stats(df: DataFrame, cols: list[str]) -> dict[str, tuple[int, float, float]]:
    """n, min, max per column in one aggregate pass."""
    aggs = []
    for c in cols:
        x = number(c)
        aggs += [F.count(x).alias(f"n__{c}"), F.min(x).alias(f"mn__{c}"), F.max(x).alias(f"mx__{c}")]
    r = df.agg(*aggs).first()
    return {c: (r[f"n__{c}"], r[f"mn__{c}"], r[f"mx__{c}"]) for c in cols}


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float],
                    stats: dict | None = None, **kw) -> dict[tuple[str, float], float | None]:
    """quantile_cont(col, p) for every column and probability."""
    stats = stats or column_stats(df, cols)
    wanted: dict[str, list[int]] = {}
    plan = {}
    for c in cols:
        n = stats[c][0]
        for p in probs:
            if n == 0:
                plan[(c, p)] = None
                continue
            h = (n - 1) * p
            r0 = int(math.floor(h))
            r1 = min(r0 + 1, n - 1)
            plan[(c, p)] = (r0, r1, h - r0)
            wanted.setdefault(c, []).extend([r0, r1])
    os_ = order_statistics(df, wanted, stats, **kw)
    out = {}
    for (c, p), pl in plan.items():
        if pl is None:
            out[(c, p)] = None
            continue
        r0, r1, frac = pl
        v0, v1 = os_[(c, r0)], os_[(c, r1)]
        out[(c, p)] = v0 + (v1 - v0) * frac if frac else v0
    return out
