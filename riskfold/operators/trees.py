"""Histogram trees: forests and boosted trees on columns cut into at most 32 bins.

MLlib grows the trees of a forest together, a job a level, and visits the nodes
of all trees row by row; a boosted tree is a dozen small jobs. Here the columns
become one byte a value (``cut_points``, ``binned``), and a tree is grown from
histograms in numpy: one ``bincount`` a feature for all nodes of a level
(``level_counts``), then the best split of every node (``best_splits``). The
rules are MLlib's: Gini or variance, least rows of a child, least gain, feature
subsets a node, Poisson weights for the bootstrap, leaves of one parent merged
when they predict the same class, mean of the leaves' class shares, and logistic
loss in boosting. Draws are hashes of (seed, tree, row id or node, feature), so
a model is the same under any partitioning and after task retries.

Two schedules grow the same trees. While the binned rows of a fit are below
``TASK_BYTES``, the trees (of boosting: the classes) are dealt to tasks, and each
task holds one copy of the binned rows. Beyond that the rows stay where they are:
a job a level counts them, the counts of a tree are added up in a shuffle, and
only splits reach the driver.
"""
from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C

BINS = 32
POINTS = 1024                   # of a column that a partition brings to the cut points
BLOCK_ROWS = 1 << 16
TASK_BYTES = 256 << 20          # of binned rows that one task may hold


# --------------------------------------------------------------------------
# draws
# --------------------------------------------------------------------------
def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(ids: np.ndarray, *key: int) -> np.ndarray:
    """A number in [0, 1) for every id (int64) under ``key``."""
    h = np.zeros(1, np.uint64)
    for k in key:
        h = _mix(h + np.uint64(k & 0xFFFFFFFFFFFFFFFF) + np.uint64(0x9E3779B97F4A7C15))
    return (_mix(_mix(np.asarray(ids, np.int64).view(np.uint64) + h) + h) >> np.uint64(11)) * 2.0 ** -53


def poisson(u: np.ndarray, mean: float) -> np.ndarray:
    """Poisson counts of uniform numbers, by the inverse distribution."""
    p, total, steps = np.exp(-mean), 0.0, []
    for k in range(1, 40):
        total += p
        steps.append(total)
        p *= mean / k
    return np.searchsorted(np.array(steps), u, side="right").astype(np.float64)


def row_weights(ids: np.ndarray, bootstrap: bool, share: float, *key: int) -> np.ndarray | None:
    """How often a tree sees each row; None when it sees all of them once."""
    if bootstrap:
        return poisson(uniform(ids, *key, 0), share)
    return (uniform(ids, *key, 0) < share).astype(np.float64) if share < 1 else None


def node_features(heap: np.ndarray, n_features: int, n_sub: int, *key: int) -> np.ndarray | None:
    """The features that each node (by its number in the full binary tree) may
    be split at, in order; None for all."""
    if n_sub >= n_features:
        return None
    ids = heap[:, None] * n_features + np.arange(n_features)
    return np.sort(np.argsort(uniform(ids.reshape(-1), *key, 1).reshape(ids.shape), axis=1, kind="stable")[:, :n_sub], axis=1)


def subset_size(strategy: str, n_features: int) -> int:
    """MLlib's number of features a node for "auto" or "sqrt", "all" or a share in text."""
    if strategy in ("auto", "sqrt"):
        return int(np.ceil(np.sqrt(n_features)))
    share = 1.0 if strategy == "all" else float(strategy)
    return min(n_features, int(np.ceil(share * n_features)))


# --------------------------------------------------------------------------
# a tree
# --------------------------------------------------------------------------
@dataclass
class Tree:
    """Nodes as arrays, parents first; a leaf's feature is -1. ``cut``: the last
    bin that goes left. ``stats``: rows a class, or (rows, sum)."""
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    heap: np.ndarray
    stats: np.ndarray
    gain: np.ndarray

    @staticmethod
    def root(channels: int) -> "Tree":
        return Tree(np.array([-1]), np.array([0]), np.array([-1]), np.array([-1]), np.array([1]),
                    np.zeros((1, channels)), np.array([-1.0]))

    def walk(self, x: np.ndarray, depth: int) -> np.ndarray:
        """The node that each of the binned rows ends in; ``x``: features by rows."""
        n = x.shape[1]
        at, flat, node = np.arange(n), x.reshape(-1), np.zeros(n, np.int64)
        leaf = self.feature < 0
        own = np.arange(len(leaf))
        base = np.where(leaf, 0, self.feature) * n
        child = np.stack([np.where(leaf, own, self.left), np.where(leaf, own, self.right)], 1).reshape(-1)
        for _ in range(depth):
            node = child[2 * node + (flat[base[node] + at] > self.cut[node])]
        return node

    def split(self, front: np.ndarray, found) -> np.ndarray:
        """Children for the nodes of ``front`` that have a split; their numbers."""
        ok, feature, cut, gain, total, left = found
        self.stats[front] = total
        nodes = front[ok]
        first = len(self.feature) + 2 * np.arange(len(nodes))
        self.feature[nodes], self.cut[nodes], self.gain[nodes] = feature[ok], cut[ok], gain[ok]
        self.left[nodes], self.right[nodes] = first, first + 1
        k = 2 * len(nodes)
        add = lambda a, v: np.concatenate([a, np.full((k, *a.shape[1:]), v, a.dtype)])
        self.heap = np.concatenate([self.heap, np.stack([2 * self.heap[nodes], 2 * self.heap[nodes] + 1], 1).reshape(-1)])
        self.stats = np.concatenate([self.stats, np.stack([left[ok], total[ok] - left[ok]], 1).reshape(k, total.shape[1])])
        self.feature, self.cut, self.left, self.right, self.gain = (
            add(a, v) for a, v in ((self.feature, -1), (self.cut, 0), (self.left, -1), (self.right, -1), (self.gain, -1.0)))
        return np.arange(first[0], first[0] + k) if k else np.zeros(0, np.int64)

    def merged(self) -> "Tree":
        """Without splits whose two leaves predict the same class."""
        top = self.stats.argmax(1)
        for i in range(len(self.feature) - 1, -1, -1):
            a, b = self.left[i], self.right[i]
            if self.feature[i] >= 0 and self.feature[a] < 0 and self.feature[b] < 0 and top[a] == top[b]:
                self.feature[i], self.gain[i] = -1, -1.0
        return self

    def importance(self, n_features: int, classes: bool = True) -> np.ndarray:
        """Gain by rows and feature, of the nodes that are reached."""
        out, rows = np.zeros(n_features), self.stats.sum(1) if classes else self.stats[:, 0]
        stack = [0]
        while stack:
            i = stack.pop()
            if self.feature[i] >= 0:
                out[self.feature[i]] += self.gain[i] * rows[i]
                stack += [self.left[i], self.right[i]]
        return out


def level_counts(x: np.ndarray, slot: np.ndarray, rows: np.ndarray | None, kind: np.ndarray | None,
                 weight: np.ndarray | None, target: np.ndarray | None, sub: np.ndarray | None, m: int,
                 channels: int) -> np.ndarray:
    """What the rows of one block add to the histograms (feature, node, bin,
    channel) of a level of ``m`` nodes. ``slot``: the node of each of ``rows``;
    ``kind``: its class, with one channel a class; or ``target``: two channels,
    rows and sum. ``sub``: features a node, else all features."""
    n_features, n = x.shape
    few = sub is not None and 2 * sub.shape[1] <= n_features
    flat, at = x.reshape(-1), np.arange(n) if rows is None else rows
    classes = kind is not None
    out = np.zeros((sub.shape[1] if few else n_features, m, BINS, channels))
    base = slot * BINS
    for j in range(len(out)):
        if few:
            code = flat[sub[slot, j] * n + at]
        else:
            code = x[j] if rows is None else x[j][rows]
        i = base + code
        if classes:
            out[j] = np.bincount(i * channels + kind, weight, m * BINS * channels).reshape(m, BINS, channels)
        else:
            out[j, :, :, 0] = np.bincount(i, weight, m * BINS).reshape(m, BINS)
            out[j, :, :, 1] = np.bincount(i, target, m * BINS).reshape(m, BINS)
    return out


def best_splits(counts: np.ndarray, sub: np.ndarray | None, classes: bool, min_leaf: int, min_gain: float):
    """(has a split, feature, last bin to the left, gain, stats, stats of the left
    child) of every node of a level."""
    k, m, bins, channels = counts.shape
    few = sub is not None and k == sub.shape[1]
    total = counts[0].sum(1)                                        # node, channel
    left = counts.cumsum(2)[:, :, :-1]
    right = total[None, :, None, :] - left
    with np.errstate(divide="ignore", invalid="ignore"):
        if classes:
            nl, nr, n = left.sum(3), right.sum(3), total.sum(1)
            score = (left ** 2).sum(3) / nl + (right ** 2).sum(3) / nr
            gain = (score - ((total ** 2).sum(1) / n)[None, :, None]) / n[None, :, None]
        else:
            nl, nr, n = left[..., 0], right[..., 0], total[:, 0]
            score = left[..., 1] ** 2 / nl + right[..., 1] ** 2 / nr
            gain = (score - (total[:, 1] ** 2 / n)[None, :, None]) / n[None, :, None]
    gain = np.where((nl >= max(1, min_leaf)) & (nr >= max(1, min_leaf)), gain, -np.inf)
    if sub is not None and not few:
        allowed = np.zeros((m, k), bool)
        allowed[np.arange(m)[:, None], sub] = True
        gain = np.where(allowed.T[:, :, None], gain, -np.inf)
    flat = gain.transpose(1, 0, 2).reshape(m, -1)
    best = flat.argmax(1)
    j, cut, nodes = best // (bins - 1), best % (bins - 1), np.arange(m)
    top = flat[nodes, best]
    ok = (top > 1e-12) & (top >= min_gain)
    return ok, sub[nodes, j] if few else j, cut, top, total, left[j, nodes, cut]


def open_children(tree: Tree, new: np.ndarray, classes: bool, min_leaf: int) -> np.ndarray:
    """The nodes among ``new`` that a split is looked for."""
    s = tree.stats[new]
    n = s.sum(1) if classes else s[:, 0]
    more = n >= 2 * max(1, min_leaf)
    return new[more & (s.max(1) < n)] if classes else new[more]


def grow(blocks: list, weights: list, kinds: list | None, targets: list | None, channels: int, depth: int,
         min_leaf: int, min_gain: float, n_sub: int, key: tuple) -> Tree:
    """One tree on blocks of binned rows (features by rows) in this process."""
    tree, front, n_features = Tree.root(channels), np.array([0]), blocks[0].shape[0]
    classes = kinds is not None
    live = []
    for b, x in enumerate(blocks):
        w = weights[b]
        rows = None if w is None else np.flatnonzero(w)
        pick = lambda a, rows=rows: a if rows is None or a is None else a[rows]
        live.append([rows, np.zeros(x.shape[1] if rows is None else len(rows), np.int64),
                     pick(kinds[b]) if classes else None, pick(w), None if classes else pick(targets[b])])
    for d in range(depth):
        m = len(front)
        sub = node_features(tree.heap[front], n_features, n_sub, *key)
        counts = 0
        for x, (rows, slot, kind, w, t) in zip(blocks, live):
            counts = counts + level_counts(x, slot, rows, kind, w, t, sub, m, channels)
        found = best_splits(counts, sub, classes, min_leaf, min_gain)
        new = tree.split(front, found)
        goes_on = open_children(tree, new, classes, min_leaf) if d + 1 < depth else new[:0]
        if not len(goes_on):
            break
        place = np.full(len(tree.feature), -1)
        place[goes_on] = np.arange(len(goes_on))
        # what becomes of the rows of an old slot that go left and right
        to = np.stack([np.where(found[0], place[tree.left[front]], -1), np.where(found[0], place[tree.right[front]], -1)], 1)
        to, f, c = to.reshape(-1), found[1], found[2]
        for k, x in enumerate(blocks):
            rows, slot, kind, w, t = live[k]
            at = np.arange(x.shape[1]) if rows is None else rows
            slot = to[2 * slot + (x.reshape(-1)[f[slot] * x.shape[1] + at] > c[slot])]
            if (slot < 0).any():
                keep = np.flatnonzero(slot >= 0)
                rows, slot = at[keep], slot[keep]
                kind, w, t = (None if a is None else a[keep] for a in (kind, w, t))
            live[k] = [rows, slot, kind, w, t]
        front = goes_on
    return tree


# --------------------------------------------------------------------------
# binned rows
# --------------------------------------------------------------------------
def columns(batch, names: list[str]) -> list[np.ndarray]:
    return [batch.column(f).to_numpy(zero_copy_only=False).astype(np.float64, copy=False) for f in names]


def _points(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most POINTS values of a column and the rows that each stands for."""
    v, n = np.unique(x[~np.isnan(x)], return_counts=True)
    if len(v) <= POINTS:
        return v, n.astype(np.float64)
    total = n.sum()
    at = np.searchsorted(n.cumsum(), (np.arange(POINTS) + 0.5) * total / POINTS)
    return v[at], np.full(POINTS, total / POINTS)


def _cuts(points: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Split points of a column: between all values when these are few, else
    equally many rows apart."""
    v, inverse = np.unique(np.concatenate([p[0] for p in points]), return_inverse=True)
    n = np.bincount(inverse, np.concatenate([p[1] for p in points]), len(v))
    if len(v) <= BINS:
        at = np.arange(len(v) - 1)
    else:
        at = np.unique(np.searchsorted(n.cumsum(), np.arange(1, BINS) * n.sum() / BINS))
        at = at[at < len(v) - 1]
    return np.unique(v[at] / 2 + v[at + 1] / 2) if len(at) else np.zeros(0)


def cut_points(df: DataFrame, features: list[str]) -> tuple[list[np.ndarray], int]:
    """(split points of every feature, rows) from one pass over all rows: each
    partition brings POINTS equally spaced order statistics a feature."""
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        got = [columns(b, features) for b in batches]
        got = [c for c in got if len(c[0])]
        if got:
            cols = [np.concatenate([g[j] for g in got]) for j in range(len(features))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([len(cols[0])], pa.int64()),
                 pa.array([pickle.dumps([_points(c) for c in cols])], pa.binary())], names=["part", "n", "points"])
    rows = sorted(df.select(*features).mapInArrow(run, "part int, n bigint, points binary").collect())
    points = [pickle.loads(r["points"]) for r in rows]
    return ([_cuts([p[j] for p in points]) if points else np.zeros(0) for j in range(len(features))],
            sum(r["n"] for r in rows))


def codes(cols: list[np.ndarray], cuts: list[np.ndarray]) -> np.ndarray:
    """Binned rows, features by rows: the number of split points below a value."""
    small = np.uint8 if max(map(len, cuts), default=0) < 256 else np.uint16
    return np.stack([np.searchsorted(c, x, side="left").astype(small) for x, c in zip(cols, cuts)])


def row_keys(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    """What a row's draws hang on: its id and codes, since ids may be missing or repeat."""
    key = ids.astype(np.int64).view(np.uint64)
    for j, c in enumerate(x):
        key = key + c * (_mix(np.array([j + 1], np.uint64)) | np.uint64(1))
    return key.view(np.int64)


def binned(df: DataFrame, features: list[str], cuts: list[np.ndarray], label: str, extra: list[str]):
    """RDD of ((partition, number), (row keys, classes, codes, *extra)): blocks of rows."""
    import pyarrow as pa
    names = [C.ID, label, *extra]

    def run(batches):
        from pyspark import TaskContext
        part, held, n, k = TaskContext.get().partitionId(), [], 0, 0

        def block():
            ids, y, *more = (np.concatenate([h[0][j] for h in held]) for j in range(len(names)))
            if y.dtype.kind == "f" and np.isnan(y).any():
                raise ValueError(f"{label} is missing in rows that a model is fitted on")
            x = np.concatenate([h[1] for h in held], 1)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([k], pa.int32()),
                 pa.array([pickle.dumps((ids.astype(np.int64), y.astype(np.int64), x, *more), 5)], pa.binary())],
                names=["part", "number", "block"])
        for b in batches:
            if not b.num_rows:
                continue
            x = codes(columns(b, features), cuts)
            ids = b.column(C.ID).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
            held.append(([row_keys(ids, x), *[b.column(c).to_numpy(zero_copy_only=False) for c in names[1:]]], x))
            n += b.num_rows
            if n >= BLOCK_ROWS:
                yield block()
                held, n, k = [], 0, k + 1
        if held:
            yield block()
    return (df.select(*names, *features).mapInArrow(run, "part int, number int, block binary").rdd
            .map(lambda r: ((r[0], r[1]), pickle.loads(r[2]))))


def _together(blocks: list) -> list:
    """Small blocks put together, in order."""
    out, held, n = [], [], 0
    for b in blocks:
        held.append(b)
        n += len(b[0])
        if n >= BLOCK_ROWS:
            out.append(held)
            held, n = [], 0
    out += [held] if held else []
    return [tuple(np.concatenate([b[j] for b in h], -1) for j in range(len(h[0]))) for h in out]


def _dealt(blocks, n_groups: int, train):
    """``train(group, blocks)`` for every group, each in a task with all blocks."""
    def run(it):
        got: dict[int, list] = {}
        for g, kv in it:
            got.setdefault(g, []).append(kv)
        for g, kvs in got.items():
            yield from train(g, _together([v for _, v in sorted(kvs, key=lambda kv: kv[0])]))
    return (blocks.flatMap(lambda kv: [(g, kv) for g in range(n_groups)])
            .partitionBy(n_groups, lambda g: g).mapPartitions(run))


def _summed(blocks, state, part, finish) -> dict:
    """``part(state, block)`` gives (key, counts); ``finish(state, key, sum)`` of
    every key, the counts of all blocks added up in a shuffle."""
    sc = blocks.context
    shared = sc.broadcast(state)

    def run(it):
        total: dict = {}
        for _, b in it:
            for key, counts in part(shared.value, b):
                total[key] = total[key] + counts if key in total else counts
        return iter(total.items())
    n = max(1, min(sc.defaultParallelism, state["keys"]))
    got = dict(blocks.mapPartitions(run).reduceByKey(lambda a, b: a + b, n)
               .map(lambda kv: (kv[0], finish(shared.value, *kv))).collect())
    shared.unpersist()
    return got


# --------------------------------------------------------------------------
# forests
# --------------------------------------------------------------------------
@dataclass
class Shape:
    """How trees are grown."""
    trees: int
    depth: int
    min_leaf: int = 1
    min_gain: float = 0.0
    n_sub: int = 1
    bootstrap: bool = True
    share: float = 1.0
    seed: int = C.SEED


TREES_AT_ONCE = 10              # of a level counted by one job


def grow_forest(blocks, n_rows: int, n_features: int, n_classes: int, s: Shape, task_bytes: int | None = None) -> list[Tree]:
    """The trees of a forest on blocks of ``binned``."""
    return grow_forests(blocks, n_rows, n_features, n_classes, [(all_rows, s)], task_bytes)[0]


def all_rows(block: tuple) -> tuple:
    return block[:3]


def grow_forests(blocks, n_rows: int, n_features: int, n_classes: int, fits: list[tuple], task_bytes: int | None = None
                 ) -> list[list[Tree]]:
    """The trees of several forests. ``fits``: (view, Shape); ``view(block)`` gives
    the (ids, classes, codes) of a block that the forest is fitted on."""
    if n_rows * n_features <= (TASK_BYTES if task_bytes is None else task_bytes):
        items = [(k, t) for k, (_, s) in enumerate(fits) for t in range(s.trees)]
        n = min(len(items), blocks.context.defaultParallelism)

        def train(g, parts):
            last, view = None, []
            for k, t in items[g::n]:
                s = fits[k][1]
                if k != last:
                    last, view = k, [v for v in map(fits[k][0], parts) if len(v[0])]
                if view:
                    w = [row_weights(v[0], s.bootstrap, s.share, s.seed, t) for v in view]
                    tree = grow([v[2] for v in view], w, [v[1] for v in view], None, n_classes, s.depth, s.min_leaf,
                                s.min_gain, s.n_sub, (s.seed, t)).merged()
                else:
                    tree = Tree.root(n_classes)
                yield (k, t), tree
        got = dict(_dealt(blocks, n, train).collect())
        return [[got.get((k, t)) or Tree.root(n_classes) for t in range(s.trees)] for k, (_, s) in enumerate(fits)]
    return [_forest_by_levels(blocks.mapValues(view), n_features, n_classes, s) for view, s in fits]


def _forest_by_levels(blocks, n_features: int, n_classes: int, s: Shape) -> list[Tree]:
    def part(state, p):
        for t, (tree, front) in state["trees"].items():
            place = np.full(len(tree.feature), -1)
            place[front] = np.arange(len(front))
            slot = place[tree.walk(p[2], s.depth)]
            w = row_weights(p[0], s.bootstrap, s.share, s.seed, t)
            rows = np.flatnonzero((slot >= 0) if w is None else (slot >= 0) & (w > 0))
            sub = node_features(tree.heap[front], n_features, s.n_sub, s.seed, t)
            yield t, level_counts(p[2], slot[rows], rows, p[1][rows], None if w is None else w[rows], None, sub,
                                  len(front), n_classes)

    def finish(state, t, counts):
        tree, front = state["trees"][t]
        sub = node_features(tree.heap[front], n_features, s.n_sub, s.seed, t)
        return best_splits(counts, sub, True, s.min_leaf, s.min_gain)
    out = []
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    for first in range(0, s.trees, TREES_AT_ONCE):
        some = {t: (Tree.root(n_classes), np.array([0])) for t in range(first, min(s.trees, first + TREES_AT_ONCE))}
        grown = {t: tree for t, (tree, _) in some.items()}
        for d in range(s.depth):
            for t, found in _summed(blocks, {"trees": some, "keys": len(some)}, part, finish).items():
                new = grown[t].split(some[t][1], found)
                some[t] = (grown[t], open_children(grown[t], new, True, s.min_leaf))
            some = {t: x for t, x in some.items() if len(x[1])}
            if not some:
                break
        out += [grown[t].merged() for t in sorted(grown)]
    blocks.unpersist()
    return out


def class_shares(trees: list[Tree], x: np.ndarray, depth: int) -> np.ndarray:
    """Class shares of binned rows: the mean over the trees of their leaves',
    added up and scaled in MLlib's order."""
    total = np.zeros((x.shape[1], trees[0].stats.shape[1]))
    for t in trees:
        total += (t.stats / np.maximum(t.stats.sum(1, keepdims=True), 1e-300))[t.walk(x, depth)]
    n = total.cumsum(1)[:, -1:]
    return np.divide(total, n, out=np.zeros_like(total), where=n > 0)


def importances(trees: list[Tree], n_features: int, classes: bool = True) -> np.ndarray:
    """Gain by feature, scaled to a sum of one; in a forest (``classes``) that of
    every tree first."""
    total = np.zeros(n_features)
    for t in trees:
        one = t.importance(n_features, classes)
        total += one / one.sum() if classes and one.sum() > 0 else one
    return total / total.sum() if total.sum() > 0 else total


# --------------------------------------------------------------------------
# boosting
# --------------------------------------------------------------------------
def boost_weight(k: int, step: float) -> float:
    return 1.0 if k == 0 else step


def residual(sign: np.ndarray, margin: np.ndarray) -> np.ndarray:
    """Negative gradient of MLlib's logistic loss 2 log(1 + exp(-2 y F))."""
    return 4.0 * sign / (1.0 + np.exp(np.minimum(2.0 * sign * margin, 700.0)))


def leaf_means(tree: Tree) -> np.ndarray:
    return tree.stats[:, 1] / np.maximum(tree.stats[:, 0], 1e-300)


def grow_boosted(blocks, n_rows: int, n_features: int, n_classes: int, s: Shape, step: float,
                 task_bytes: int | None = None) -> list[list[Tree]]:
    """Boosted trees of every class against the others, on blocks of ``binned``.
    The first tree is fitted on -1 and 1, the others on the residuals."""
    if n_rows * n_features <= (TASK_BYTES if task_bytes is None else task_bytes):
        def train(c, parts):
            xs = [p[2] for p in parts]
            signs = [np.where(p[1] == c, 1.0, -1.0) for p in parts]
            margins, trees = [np.zeros(len(y)) for y in signs], []
            for k in range(s.trees):
                target = signs if k == 0 else [residual(y, m) for y, m in zip(signs, margins)]
                w = [row_weights(p[0], False, s.share, s.seed, k, c) for p in parts]
                t = grow(xs, w, None, target, 2, s.depth, s.min_leaf, s.min_gain, s.n_sub, (s.seed, k, c))
                mean = leaf_means(t) * boost_weight(k, step)
                margins = [m + mean[t.walk(x, s.depth)] for m, x in zip(margins, xs)]
                trees.append(t)
            yield c, trees
        got = dict(_dealt(blocks, n_classes, train).collect())
        return [got[c] for c in range(n_classes)]

    def part(state, b):
        p, margin = b
        for c, (tree, front) in state["trees"].items():
            sign = np.where(p[1] == c, 1.0, -1.0)
            place = np.full(len(tree.feature), -1)
            place[front] = np.arange(len(front))
            slot = place[tree.walk(p[2], s.depth)]
            w = row_weights(p[0], False, s.share, s.seed, state["round"], c)
            rows = np.flatnonzero((slot >= 0) if w is None else (slot >= 0) & (w > 0))
            target = (sign if state["round"] == 0 else residual(sign, margin[c]))[rows]
            sub = node_features(tree.heap[front], n_features, s.n_sub, s.seed, state["round"], c)
            yield c, level_counts(p[2], slot[rows], rows, None, None, target, sub, len(front), 2)

    def finish(state, c, counts):
        tree, front = state["trees"][c]
        sub = node_features(tree.heap[front], n_features, s.n_sub, s.seed, state["round"], c)
        return best_splits(counts, sub, False, s.min_leaf, s.min_gain)

    def moved(trees, weight):
        def run(b):
            p, margin = b
            return p, [m + (leaf_means(t) * weight)[t.walk(p[2], s.depth)] for m, t in zip(margin, trees)]
        return run
    out: list[list[Tree]] = [[] for _ in range(n_classes)]
    rows = blocks.mapValues(lambda p: (p, [np.zeros(len(p[0])) for _ in range(n_classes)])).persist(
        StorageLevel.MEMORY_AND_DISK)
    for k in range(s.trees):
        some = {c: (Tree.root(2), np.array([0])) for c in range(n_classes)}
        grown = {c: tree for c, (tree, _) in some.items()}
        for d in range(s.depth):
            for c, found in _summed(rows, {"trees": some, "keys": len(some), "round": k}, part, finish).items():
                new = grown[c].split(some[c][1], found)
                some[c] = (grown[c], open_children(grown[c], new, False, s.min_leaf))
            some = {c: x for c, x in some.items() if len(x[1])}
            if not some:
                break
        for c in range(n_classes):
            out[c].append(grown[c])
        last, rows = rows, rows.mapValues(moved([grown[c] for c in range(n_classes)], boost_weight(k, step))).persist(
            StorageLevel.MEMORY_AND_DISK)
        if k % 10 == 9:
            rows.checkpoint()           # in the shared folder: the lineage stays short
        rows.count()
        last.unpersist()
    rows.unpersist()
    return out


def boosted_shares(members: list[list[Tree]], x: np.ndarray, depth: int, step: float) -> np.ndarray:
    """Every class's probability against the others, scaled to a sum of one."""
    p = []
    for trees in members:
        margin = np.zeros(x.shape[1])
        for k, t in enumerate(trees):
            margin += (leaf_means(t) * boost_weight(k, step))[t.walk(x, depth)]
        p.append(1.0 / (1.0 + np.exp(np.clip(-2.0 * margin, -700.0, 700.0))))
    p = np.stack(p, 1)
    return p / p.sum(1, keepdims=True)


# --------------------------------------------------------------------------
# frames
# --------------------------------------------------------------------------
def scorer(shares, features: list[str], cuts: list[np.ndarray], n_classes: int):
    """Rows -> rows with p0.. by ``shares(codes)``, in Arrow batches."""
    from pyspark.sql import types as T

    def predict(df: DataFrame) -> DataFrame:
        import pyarrow as pa
        spark = df.sparkSession
        shared = spark.sparkContext.broadcast(shares)
        inputs = [f"__x{j}" for j in range(len(features))]

        def run(batches):
            for b in batches:
                p = shared.value(codes(columns(b, inputs), cuts)) if b.num_rows else np.zeros((0, n_classes))
                keep = [c for c in b.schema.names if c not in inputs]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep],
                                                  *[pa.array(np.ascontiguousarray(p[:, k])) for k in range(n_classes)]],
                                                 names=[*keep, *[f"p{k}" for k in range(n_classes)]])
        wide = df.select("*", *[F.col(f).cast("double").alias(i) for f, i in zip(features, inputs)])
        return wide.mapInArrow(run, T.StructType([*df.schema.fields, *[T.StructField(f"p{k}", T.DoubleType())
                                                                       for k in range(n_classes)]]))
    return predict


class ForestShares:
    def __init__(self, trees: list[Tree], depth: int):
        self.trees, self.depth = trees, depth

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return class_shares(self.trees, x, self.depth)


class DrawnShares:
    """Of trees on the codes of several draws; ``tables``: per draw and feature
    the draw's code of each code of all draws' split points."""

    def __init__(self, draws: list[list[Tree]], tables: list[list[np.ndarray]], depth: int):
        self.draws, self.tables, self.depth = draws, tables, depth

    def __call__(self, x: np.ndarray) -> np.ndarray:
        total, n = 0.0, sum(map(len, self.draws))
        for trees, table in zip(self.draws, self.tables):
            total = total + class_shares(trees, drawn_codes(x, table), self.depth) * (len(trees) / n)
        return total


def drawn_codes(x: np.ndarray, table: list[np.ndarray]) -> np.ndarray:
    return np.stack([t[c] for t, c in zip(table, x)])


class DrawnRows:
    """A view of blocks: the codes of one draw."""

    def __init__(self, table: list[np.ndarray]):
        self.table = table

    def __call__(self, block: tuple) -> tuple:
        return block[0], block[1], drawn_codes(block[2], self.table)


class BoostedShares:
    def __init__(self, members: list[list[Tree]], depth: int, step: float):
        self.members, self.depth, self.step = members, depth, step

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return boosted_shares(self.members, x, self.depth, self.step)


def as_mllib(spark, trees: list[Tree], cuts: list[np.ndarray], s: Shape, n_classes: int, label: str):
    """The forest as an MLlib model, by MLlib's saved form."""
    import json

    import pyarrow as pa
    from pyspark.ml.classification import RandomForestClassificationModel
    from ..sources.files import scratch_path
    path = scratch_path(spark, "model")
    cols: dict[str, list] = {k: [] for k in ("tree", "id", "prediction", "impurity", "stats", "n", "gain", "left", "right",
                                             "feature", "cut")}
    for number, t in enumerate(trees):
        order, stack = [], [0]
        while stack:                    # parents first, left before right
            i = stack.pop()
            order.append(i)
            if t.feature[i] >= 0:
                stack += [t.right[i], t.left[i]]
        new = {i: k for k, i in enumerate(order)}
        for i in order:
            n, inner = t.stats[i].sum(), t.feature[i] >= 0
            cols["tree"].append(number)
            cols["id"].append(new[i])
            cols["prediction"].append(float(t.stats[i].argmax()))
            cols["impurity"].append(float(1 - ((t.stats[i] / max(n, 1e-300)) ** 2).sum()))
            cols["stats"].append(t.stats[i].tolist())
            cols["n"].append(int(n))
            cols["gain"].append(float(t.gain[i]) if inner else -1.0)
            cols["left"].append(new[t.left[i]] if inner else -1)
            cols["right"].append(new[t.right[i]] if inner else -1)
            cols["feature"].append(int(t.feature[i]))
            cols["cut"].append([float(cuts[t.feature[i]][t.cut[i]])] if inner else [])
    arr = lambda k, kind: pa.array(cols[k], kind)
    i32, f64 = pa.int32(), pa.float64()
    split = pa.StructArray.from_arrays([arr("feature", i32), arr("cut", pa.list_(f64)), pa.array([-1] * len(cols["id"]), i32)],
                                       ["featureIndex", "leftCategoriesOrThreshold", "numCategories"])
    node = pa.StructArray.from_arrays(
        [arr("id", i32), arr("prediction", f64), arr("impurity", f64), arr("stats", pa.list_(f64)), arr("n", pa.int64()),
         arr("gain", f64), arr("left", i32), arr("right", i32), split],
        ["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"])
    spark.createDataFrame(pa.table({"treeID": arr("tree", i32), "nodeData": node})).write.parquet(f"{path}/data")
    about = {"timestamp": 0, "sparkVersion": spark.version, "defaultParamMap": {
        "featuresCol": "features", "labelCol": "label", "predictionCol": "prediction", "probabilityCol": "probability",
        "rawPredictionCol": "rawPrediction", "leafCol": "", "maxBins": BINS, "impurity": "gini"}}
    par = {"labelCol": label, "maxDepth": s.depth, "minInstancesPerNode": s.min_leaf, "minInfoGain": s.min_gain, "seed": s.seed}
    one = json.dumps({**about, "class": "org.apache.spark.ml.classification.DecisionTreeClassificationModel", "paramMap": par,
                      "uid": "dtc"})
    spark.createDataFrame([(k, one, 1.0) for k in range(len(trees))], "_1 int, _2 string, _3 double").write.parquet(
        f"{path}/treesMetadata")
    whole = {**about, "class": "org.apache.spark.ml.classification.RandomForestClassificationModel", "uid": "rfc",
             "paramMap": {**par, "numTrees": len(trees), "bootstrap": s.bootstrap, "subsamplingRate": s.share},
             "numFeatures": len(cuts), "numClasses": n_classes, "numTrees": len(trees)}
    spark.createDataFrame([(json.dumps(whole),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return RandomForestClassificationModel.load(path)
