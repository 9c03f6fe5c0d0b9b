"""Exact k-nearest-neighbour join, one distributed path for every size.

Pivot partitioning with triangle-inequality pruning (the metric-space kNN
join of Lu et al., VLDB 2012), worked off in blocks:

1. Identical reference vectors of a group become one *vector* that carries its
   smallest ids (never more than can be needed), so a value held by a third of
   the rows costs one comparison a query.
2. Pivots are vectors taken by the smallest md5 (a bounded top-P). Each vector
   goes to its nearest pivot, its *cell*; a cell records its radius per group.
3. Round 1: each query is compared with its ``probe`` nearest cells; the k best
   give a bound d_k. Round 2: a cell can only hold a closer vector if
   dist(q, pivot) - radius <= d_k; exactly those cells are compared as well, so
   the result is that of brute force (ties broken by reference id).
4. A cell's queries and vectors are dealt into blocks of at most ``block`` rows;
   a task gets one block of each (the unit), finds the k best of every query with
   numpy and returns only those, in round 2 only those within d_k.
   ``row_number() <= k`` merges the units: Spark keeps a partial top-k before that
   shuffle.
5. Inside a unit a matrix product in single precision, less a proven bound of its
   rounding error, is a lower bound of all squared distances; only pairs that it
   leaves get their exact distance.

Nothing but pivots and radii (P and P x groups rows, bounded by MAX_PIVOTS)
passes through the driver. A row with a NULL or NaN feature, id or group takes
no part, on either side: queries of this kind get no neighbours.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

MAX_PIVOTS = 4096
CELL_ROWS = 65536               # a row travels once a cell or block of the other side: few large ones
LEAST_BLOCK = 8192              # blocks for small inputs, so that all cores have units
_TILE = 1 << 22                 # pairs of a matrix product
_GROUP = 128                    # columns whose least bound is looked at first
_EXACT = 1 << 18                # pairs whose exact distances are computed at once
_PIVOT_BYTES = 32 << 20         # of a distance matrix to the pivots


def euclidean(a_cols: list[Column], b_cols: list[Column]) -> Column:
    acc = None
    for a, b in zip(a_cols, b_cols):
        d = a - b
        acc = d * d if acc is None else acc + d * d
    return F.sqrt(acc)


def _rows(df: DataFrame, id_col: str, features: list[str], group: str | None, carry: str | None = None) -> DataFrame:
    """(id, g, v, c) of the rows that take part."""
    v = F.array(*[F.col(f).cast("double") for f in features])
    d = df.select(F.col(id_col).alias("id"), (F.col(group) if group else F.lit(0)).alias("g"), v.alias("v"),
                  (F.col(carry) if carry else F.lit(0)).alias("c"))
    return d.where(F.col("id").isNotNull() & F.col("g").isNotNull()
                   & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)))


def _vectors(refs: DataFrame, n_ids: int) -> DataFrame:
    """(g, v, ids): distinct vectors with their ``n_ids`` smallest (id, c)."""
    w = Window.partitionBy("g", "v").orderBy("id")
    first = refs.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n_ids)
    return (first.groupBy("g", "v")                         # at most n_ids each
            .agg(F.sort_array(F.collect_list(F.struct("id", "c"))).alias("ids")))


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(flat)
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(n, -1) if n else np.zeros((0, 0))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances, squares added feature by feature (as the SQL does)."""
    acc = np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):
        d = x[:, j:j + 1] - y[None, :, j]
        acc += d * d
    return np.sqrt(acc)


def _choose_pivots(vectors: DataFrame, n_pivots: int) -> np.ndarray:
    key = F.md5(F.concat_ws(",", F.transform("v", lambda x: x.cast("string"))))
    rows = vectors.select(key.alias("k"), "v").orderBy("k", "v").limit(n_pivots).collect()   # <= MAX_PIVOTS
    return np.array([r["v"] for r in rows], dtype=np.float64)


def _in_cells(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Vectors with ``cell``, their nearest pivot, and the distance to it."""
    step = max(1, _PIVOT_BYTES // (8 * len(pivots)))

    def run(batches):
        for b in batches:
            x = _matrix(b.column("v"))
            cell, dist = np.zeros(len(x), np.int32), np.zeros(len(x))
            for s in range(0, len(x), step):
                d = distances(x[s:s + step], pivots)
                cell[s:s + step] = d.argmin(1)
                dist[s:s + step] = d.min(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(dist)],
                                             names=[*b.schema.names, "cell", "dp"])
    from pyspark.sql import types as T
    return vectors.mapInArrow(run, T.StructType([*vectors.schema.fields, T.StructField("cell", T.IntegerType()),
                                                 T.StructField("dp", T.DoubleType())]))


def _to_cells(queries: DataFrame, pivots: np.ndarray, radius: dict, probe: int, pruned: bool) -> DataFrame:
    """Queries with ``cells``, those they are compared with: the ``probe`` nearest
    of their group, or with ``pruned`` all others that can hold a vector within
    ``dk``; queries without any are left out."""
    place = {g: k for k, g in enumerate(sorted({g for g, _ in radius}))}
    reach = np.full((len(place), len(pivots)), -np.inf)     # radius; -inf: no vector of the group
    for (g, c), r in radius.items():
        reach[place[g], c] = r
    step = max(1, _PIVOT_BYTES // (8 * len(pivots)))
    cols = queries.columns

    def run(batches):
        for b in batches:
            gs = np.array([place.get(g, -1) for g in b.column("g").to_pylist()], np.int64)
            x = _matrix(b.column("v"))
            for s in range(0, len(x), step):
                g = gs[s:s + step]
                d = distances(x[s:s + step], pivots)
                r = np.where(g[:, None] >= 0, reach[g], -np.inf)
                d = np.where(np.isinf(r), np.inf, d)
                order = np.argsort(d, axis=1, kind="stable")[:, :probe]
                near = np.zeros(d.shape, bool)
                near[np.arange(len(d))[:, None], order] = True
                near &= np.isfinite(d)
                if pruned:
                    dk = b.column("dk").to_numpy(zero_copy_only=False)[s:s + step].astype(float)
                    # a little slack: sums are rounded
                    near = np.isfinite(d) & ~near & (d - r <= dk[:, None] * (1 + 1e-9) + 1e-9)
                some = np.flatnonzero(near.any(1))
                if len(some):
                    ends = np.concatenate(([0], np.cumsum(near[some].sum(1)))).astype(np.int32)
                    cells = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.nonzero(near[some])[1].astype(np.int32)))
                    yield pa.RecordBatch.from_arrays(
                        [*[b.column(k).take(pa.array(some + s)) for k in cols], cells], names=[*cols, "cells"])
    from pyspark.sql import types as T
    return queries.mapInArrow(run, T.StructType([*queries.schema.fields,
                                                 T.StructField("cells", T.ArrayType(T.IntegerType()))]))


def _pair_distances(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``distances`` of the pairs (i, j) only."""
    out = np.empty(len(i))
    for s in range(0, len(i), _EXACT):
        a, b = x[i[s:s + _EXACT]], y[j[s:s + _EXACT]]
        acc = np.zeros(len(a))
        for f in range(x.shape[1]):
            d = a[:, f] - b[:, f]
            acc += d * d
        out[s:s + _EXACT] = np.sqrt(acc)
    return out


def near_pairs(x: np.ndarray, y: np.ndarray, m: int, within: np.ndarray):
    """Per tile (i, j, dist): all pairs of a query and a vector that can be among
    the query's ``m`` nearest and within its distance ``within``, and maybe more.

    Rows are taken relative to the median of ``y``. With ``s`` a bound of the relative
    error of the single-precision product, (1 - s)(xx + yy) - 2xy is at most the
    squared distance, and s * 2(xx + yy) more is at least it."""
    m = min(m, len(y))
    with np.errstate(all="ignore"):
        mid = np.median(y, axis=0)                          # outliers don't move it
        u, v = x - mid, y - mid
        uu, vv = (u * u).sum(1), (v * v).sum(1)
    plain = not (np.isfinite(uu).all() and np.isfinite(vv).all() and max(uu.max(), vv.max()) < 1e30)
    err = (2 * x.shape[1] + 20) * 1.2e-7
    if plain:                                               # beyond single precision
        step = max(1, (_TILE >> 3) // len(y))
        for s in range(0, len(x), step):
            d = distances(x[s:s + step], y)
            i, j = np.nonzero(d <= np.partition(d, m - 1, axis=1)[:, m - 1:m])
            yield i + s, j, d[i, j]
        return
    left = np.hstack([u, np.ones((len(u), 1))]).astype(np.float32)
    n_groups = -(-len(y) // _GROUP)
    right = np.zeros((x.shape[1] + 1, n_groups * _GROUP), np.float32)
    right[:, :len(y)] = np.hstack([-2 * v, ((1 - err) * vv)[:, None]]).T
    right[-1, len(y):] = np.inf                             # the last group is filled up
    step = min(max(1, _TILE // right.shape[1]), max(1, len(x)))
    buffer = np.empty((step, right.shape[1]), np.float32)
    for s in range(0, len(x), step):
        rows = left[s:s + step]
        low = np.matmul(rows, right, out=buffer[:len(rows)])
        grouped = low.reshape(len(rows), n_groups, _GROUP)
        least = grouped.min(2)
        xx, far = uu[s:s + step], within[s:s + step] ** 2 * (1 + 1e-9)
        open_ = np.flatnonzero(~np.isfinite(far))
        if len(open_):
            # any m vectors bound the m nearest: of the m least groups the best, if there are so many
            if n_groups > m:
                group = np.argpartition(least[open_], m - 1, axis=1)[:, :m]
                best = group * _GROUP + grouped[open_[:, None], group].argmin(2)
            else:
                best = np.argpartition(low[open_, :len(y)], m - 1, axis=1)[:, :m]
            high = low[open_[:, None], best] + 2 * err * vv[best]
            far[open_] = high.max(1) + (1 + err) * xx[open_]
        bar = far - (1 - err) * xx
        bar = (bar + 2.4e-7 * np.abs(bar) + 1e-30).astype(np.float32)
        i, g = np.nonzero(least <= bar[:, None])
        # of one dimension: far faster than nonzero of two
        at, place = np.divmod(np.flatnonzero(grouped[i, g] <= bar[i, None]), _GROUP)
        i, j = i[at], g[at] * _GROUP + place
        i, j = i[j < len(y)] + s, j[j < len(y)]
        yield i, j, _pair_distances(x, y, i, j)


def _best_of_unit(k: int, exclude_self: bool, types):
    """The k best references of every query of a unit."""
    names = ["id", "rid", "c", "dist"]

    def unit(t: pa.Table) -> pa.Table:
        q = t.filter(t.column("ids").is_null())
        r = t.filter(t.column("ids").is_valid())
        if not len(q) or not len(r):
            return pa.Table.from_arrays([pa.array([], x) for x in types], names=names)
        x, y = _matrix(q.column("v")), _matrix(r.column("v"))
        qid = q.column("id").combine_chunks()
        lists = r.column("ids").combine_chunks()
        counts = np.asarray(lists.value_lengths()).astype(np.int64)
        begin = np.cumsum(counts) - counts
        flat, carried = lists.flatten().flatten()
        rank = np.empty(len(flat), np.int64)                # order of the ids, whatever their type
        rank[np.asarray(pa.compute.sort_indices(flat))] = np.arange(len(flat))
        out = []
        within = q.column("dk").to_numpy().astype(float)
        for i, j, d in near_pairs(x, y, k + int(exclude_self), within):
            close = ~(d > within[i])
            i, j, d = i[close], j[close], d[close]
            n = counts[j]
            place = np.repeat(begin[j] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            i, dist = np.repeat(i, n), np.repeat(d, n)
            if exclude_self:
                other = np.asarray(pa.compute.not_equal(flat.take(pa.array(place)), qid.take(pa.array(i))))
                i, dist, place = i[other], dist[other], place[other]
            order = np.lexsort((rank[place], dist, i))
            i, dist, place = i[order], dist[order], place[order]
            first = np.searchsorted(i, i)
            keep = np.arange(len(i)) - first < k
            out.append((i[keep], place[keep], dist[keep]))
        i, place, dist = (np.concatenate(c) for c in zip(*out))
        place = pa.array(place)
        return pa.Table.from_arrays([qid.take(pa.array(i)), flat.take(place), carried.take(place), pa.array(dist)],
                                    names=names)
    return unit


def _compare(queries: DataFrame, vectors: DataFrame, k: int, exclude_self: bool, block: int) -> DataFrame:
    """(id, rid, dist): the k best of each query and unit, cells in blocks."""
    queries = cut_lineage(queries, "knn-queries")
    queries = queries.withColumn("cell", F.explode("cells")).drop("cells")
    sizes = (vectors.groupBy("g", "cell").agg(F.count(F.lit(1)).alias("nr"))
             .join(queries.groupBy("g", "cell").agg(F.count(F.lit(1)).alias("nq")), ["g", "cell"])
             .select("g", "cell", F.ceil(F.col("nr") / block).cast("int").alias("br"),
                     F.ceil(F.col("nq") / block).cast("int").alias("bq")))
    sizes = F.broadcast(sizes)                              # at most MAX_PIVOTS x groups rows
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    id_type = queries.schema["id"].dataType
    ids_type = vectors.schema["ids"].dataType.simpleString()
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = (queries.join(sizes, ["g", "cell"]).withColumn("i", own("id", "bq")).withColumn("j", every("br"))
            .select("g", "cell", "i", "j", "id", "v", F.lit(None).cast(ids_type).alias("ids"), "dk"))
    right = (vectors.join(sizes, ["g", "cell"]).withColumn("j", own("v", "br")).withColumn("i", every("bq"))
             .select("g", "cell", "i", "j", F.lit(None).cast(id_type).alias("id"), "v", "ids",
                     F.lit(None).cast("double").alias("dk")))
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type
    ref = vectors.schema["ids"].dataType.elementType
    out = T.StructType([T.StructField("id", id_type), T.StructField("rid", ref["id"].dataType),
                        T.StructField("c", ref["c"].dataType), T.StructField("dist", T.DoubleType())])
    unit = _best_of_unit(k, exclude_self, [to_arrow_type(f.dataType) for f in out])
    return left.unionByName(right).groupBy("g", "cell", "i", "j").applyInArrow(unit, out)


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("id").orderBy("dist", "rid")
    return found.withColumn("nn_rank", F.row_number().over(w)).where(F.col("nn_rank") <= k)


def knn_join(queries: DataFrame, refs: DataFrame, k: int, features: list[str], qid: str, rid: str,
             group: str | None = None, exclude_self: bool = False, carry: str | None = None, cell_rows: int = CELL_ROWS,
             probe: int = 2, block: int | None = None, max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """Exact k nearest references per query: (qid, rid, dist, nn_rank), and with
    ``carry`` that column of the reference (named like it, ``_nn`` appended).

    ``group``: only references of the same group qualify (e.g. the class, for
    oversampling). ``exclude_self``: a query never matches the reference with
    the same id (self-join). Ids must be unique on each side. The sizes
    (``cell_rows``, ``probe``, ``block``, ``max_pivots``) split the work and
    leave the result as it is."""
    from ..session import ship_package
    ship_package(queries.sparkSession)
    rname = rid if rid != qid else f"{rid}_nn"
    q = _rows(queries, qid, features, group).drop("c")
    vectors = cut_lineage(_vectors(_rows(refs, rid, features, group, carry), k + int(exclude_self)), "knn-vectors")
    n = vectors.count()
    if n == 0:
        best = q.select("id", F.lit(None).cast(refs.schema[rid].dataType).alias("rid"),
                        F.lit(None).cast(refs.schema[carry].dataType if carry else "int").alias("c"),
                        F.lit(0.0).alias("dist"), F.lit(0).alias("nn_rank")).limit(0)
    else:
        best = _nearest(q, vectors, n, k, exclude_self, cell_rows, probe, block, max_pivots)
    return best.select(F.col("id").alias(qid), F.col("rid").alias(rname), "dist", "nn_rank",
                       *([F.col("c").alias(f"{carry}_nn")] if carry else []))


def _nearest(q, vectors, n, k, exclude_self, cell_rows, probe, block, max_pivots) -> DataFrame:
    """(id, rid, c, dist, nn_rank) by the two rounds."""
    block = block or max(LEAST_BLOCK, min(CELL_ROWS, n // 32))
    pivots = _choose_pivots(vectors, max(1, min(max_pivots, math.ceil(n / cell_rows))))
    cells = _in_cells(vectors, pivots)
    if len(pivots) > 1:
        cells = cut_lineage(cells, "knn-cells")
    radius = {(r["g"], r["cell"]): r["r"] for r in
              cells.groupBy("g", "cell").agg(F.max("dp").alias("r")).collect()}     # groups x pivots
    q = q.withColumn("dk", F.lit(float("inf")))
    best = _top(_compare(_to_cells(q, pivots, radius, probe, False), cells, k, exclude_self, block), k)
    if len(pivots) <= probe:                                # every cell was searched
        return best
    first = cut_lineage(best, "knn-first")
    dk = first.where(F.col("nn_rank") == k).select("id", F.col("dist").alias("dk"))
    bounded = q.drop("dk").join(dk, "id", "left").withColumn("dk", F.coalesce("dk", F.lit(float("inf"))))
    more = _compare(_to_cells(bounded, pivots, radius, probe, True), cells, k, exclude_self, block)
    return _top(first.drop("nn_rank").unionByName(more), k)
