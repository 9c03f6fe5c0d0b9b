"""Histogram trees: against plain definitions, MLlib, and under both schedules."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskfold import constants as C
from riskfold.operators import trees as TR

FEATS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 4))
    x[:, 3] = rng.integers(0, 4, 700)
    y = np.digitize(x[:, 0] + 0.6 * x[:, 1] * (x[:, 3] > 1) + 0.2 * rng.normal(size=700), [-0.7, 0.8])
    pdf = pd.DataFrame(x, columns=FEATS)
    pdf[C.ID], pdf[C.LABEL] = np.arange(700), y
    return spark.createDataFrame(pdf).withColumn(C.LABEL, F.col(C.LABEL).cast("int")).repartition(3, C.ID)


def _parts(table):
    cuts, n = TR.cut_points(table, FEATS)
    return TR.binned(table, FEATS, cuts, C.LABEL, []), cuts, n


def _same(a, b, exact=True):
    assert len(a) == len(b)
    for s, t in zip(a, b):
        assert (s.feature == t.feature).all() and (s.cut == t.cut).all() and (s.left == t.left).all()
        assert np.allclose(s.stats, t.stats, rtol=0, atol=0 if exact else 1e-7)


def test_cut_points_of_few_and_of_many_values():
    few = TR._cuts([(np.array([1.0, 2.0]), np.array([5.0, 1.0])), (np.array([2.0, 7.0]), np.array([1.0, 1.0]))])
    assert few.tolist() == [1.5, 4.5]
    x = np.random.default_rng(0).normal(size=60000)
    cuts = TR._cuts([TR._points(p) for p in np.array_split(x, 7)])
    share = np.bincount(TR.codes([x], [cuts])[0], minlength=32) / len(x)
    assert len(cuts) == 31 and abs(share - 1 / 32).max() < 0.003


@pytest.mark.parametrize("n_sub", [2, 3, 4])
def test_a_tree_takes_the_best_split_of_every_node(n_sub):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, (5, 400)).astype(np.uint8)
    y = ((x[0] > 2) * 1 + (x[1] > 3) * (x[2] > 1)).astype(np.int64)
    w = rng.poisson(1.0, 400).astype(float)
    tree = TR.grow([x[:, :150], x[:, 150:]], [w[:150], w[150:]], [y[:150], y[150:]], None, 3, 3, 4, 0.0, n_sub, (7, 1))
    gini = lambda r: 1 - sum((w[r & (y == c)].sum() / w[r].sum()) ** 2 for c in range(3))
    stack, seen = [(0, np.ones(400, bool), 0)], 0
    while stack:
        i, r, d = stack.pop()
        assert np.allclose(tree.stats[i], [w[r & (y == c)].sum() for c in range(3)])
        allowed = TR.node_features(tree.heap[[i]], 5, n_sub, 7, 1)
        best = {}
        for f in (range(5) if allowed is None else allowed[0]):
            for b in range(5):
                lo, hi = r & (x[f] <= b), r & (x[f] > b)
                if w[lo].sum() >= 4 and w[hi].sum() >= 4:
                    best[f, b] = gini(r) - (w[lo].sum() * gini(lo) + w[hi].sum() * gini(hi)) / w[r].sum()
        top = max(best.values(), default=0)
        if tree.feature[i] < 0:
            assert d == 3 or top < 1e-9
            continue
        seen += 1
        assert abs(best[tree.feature[i], tree.cut[i]] - top) < 1e-9 and abs(tree.gain[i] - top) < 1e-9
        left = x[tree.feature[i]] <= tree.cut[i]
        stack += [(tree.left[i], r & left, d + 1), (tree.right[i], r & ~left, d + 1)]
    assert seen >= 3


def test_a_tree_without_a_split_is_one_leaf():
    x, y = np.arange(8, dtype=np.uint8)[None], np.array([0, 1, 2, 0, 1, 2, 0, 1])
    tree = TR.grow([x], [None], [y], None, 3, 4, 1, 0.9, 1, (1,)).merged()
    assert tree.feature.tolist() == [-1] and tree.stats.tolist() == [[3, 3, 2]]
    assert np.allclose(TR.class_shares([tree], x, 4), [[3 / 8, 3 / 8, 2 / 8]] * 8)


def test_forest_is_the_same_under_both_schedules_and_any_partitioning(table):
    blocks, cuts, n = _parts(table)
    shape = TR.Shape(13, 5, 2, 1e-4, 2, True, 0.8)
    one = TR.grow_forest(blocks, n, 4, 3, shape)
    _same(one, TR.grow_forest(blocks, n, 4, 3, shape, task_bytes=0))
    other, cuts2, _ = _parts(table.repartition(5))
    assert all((a == b).all() for a, b in zip(cuts, cuts2))
    _same(one, TR.grow_forest(other, n, 4, 3, shape))
    plain = TR.Shape(3, 4, 1, 0.0, 4, False, 1.0)
    _same(TR.grow_forest(blocks, n, 4, 3, plain), TR.grow_forest(blocks, n, 4, 3, plain, task_bytes=0))


def test_boosting_is_the_same_under_both_schedules(table):
    blocks, _, n = _parts(table)
    for shape in (TR.Shape(12, 3, n_sub=4, bootstrap=False), TR.Shape(4, 3, 5, n_sub=2, bootstrap=False, share=0.7)):
        near, far = (TR.grow_boosted(blocks, n, 4, 3, shape, 0.1, task_bytes=b) for b in (TR.TASK_BYTES, 0))
        for a, b in zip(near, far):
            _same(a, b, exact=False)


def test_boosting_equals_mllib(spark, table):
    """The same trees as GBTClassifier on columns of few values (equal split points)."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from riskfold.operators import models as M
    coarse = table.withColumns({f: F.round(F.col(f) * 3) for f in FEATS[:3]})
    got = M.fit_ovr_gbt(coarse, FEATS, 6, 3, 0.3).predict(coarse).toPandas().sort_values(C.ID)
    v = VectorAssembler(inputCols=FEATS, outputCol="features").transform(coarse)
    want = []
    for k in range(3):
        d = v.withColumn("yb", (F.col(C.LABEL) == k).cast("double"))
        m = GBTClassifier(labelCol="yb", maxIter=6, maxDepth=3, stepSize=0.3, seed=1).fit(d)
        want.append([r[1] for r in sorted(m.transform(d).select(C.ID, vector_to_array("probability")[1]).collect())])
    want = np.array(want).T
    assert np.allclose(got[["p0", "p1", "p2"]], want / want.sum(1, keepdims=True), atol=1e-9)


def test_extra_trees_look_up_their_draws_codes(table):
    from riskfold.operators import models as M
    m = M.fit_extra_trees(table, FEATS, 9, 4, trees_per_draw=4, n_cuts=5)
    got = m.predict(table).toPandas().sort_values(C.ID)
    x = table.toPandas().sort_values(C.ID)[FEATS].to_numpy()
    cuts = [M.random_cuts(x.min(0), x.max(0), 5, d) for d in range(3)]
    total, shares = 0, m.info["members"]
    assert [s.getNumTrees for s in shares] == [4, 4, 1]
    from pyspark.ml.linalg import Vectors
    for i in range(0, 700, 50):
        p = sum(np.array(s.predictRaw(Vectors.dense([float(np.searchsorted(c, v)) for c, v in zip(draw, x[i])])))
                for s, draw in zip(shares, cuts))
        assert np.allclose(got[["p0", "p1", "p2"]].to_numpy()[i], p / 9, atol=1e-9)
        total += 1
    assert total == 14


def test_a_single_tree_equals_mllib(spark, table):
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from riskfold.operators import models as M
    coarse = table.withColumns({f: F.round(F.col(f) * 3) for f in FEATS[:3]})
    got = M.fit_forest(coarse, FEATS, 1, 5, 3, bootstrap=False, subset="all")
    v = VectorAssembler(inputCols=FEATS, outputCol="features").transform(coarse)
    tree = DecisionTreeClassifier(labelCol=C.LABEL, maxDepth=5, minInstancesPerNode=3).fit(v)
    want = sorted(tree.transform(v).select(C.ID, vector_to_array("probability")).collect())
    out = got.predict(coarse).toPandas().sort_values(C.ID)
    assert np.allclose(out[["p0", "p1", "p2"]], [r[1] for r in want], atol=1e-9)
    assert np.allclose(list(got.info["importances"].values()), tree.featureImportances.toArray(), atol=1e-9)


def test_the_mllib_form_of_a_forest_predicts_the_same(table):
    from riskfold.operators import models as M
    m = M.fit_forest(table, FEATS, 7, 4, 2)
    model = m.info["model"]
    assert model.getNumTrees == 7 and model.numClasses == 3
    a = m.predict(table).toPandas().sort_values(C.ID)
    b = M.forest_scorer(model, FEATS)(table).toPandas().sort_values(C.ID)
    assert np.allclose(a[["p0", "p1", "p2"]], b[["p0", "p1", "p2"]], atol=1e-12) and (a["pred"].values == b["pred"].values).all()
    assert np.allclose(list(m.info["importances"].values()), model.featureImportances.toArray(), atol=1e-9)


def test_a_missing_label_is_not_fitted(table):
    from riskfold.operators import models as M
    odd = table.withColumn(C.LABEL, F.when(F.col(C.ID) > 3, F.col(C.LABEL)))
    with pytest.raises(Exception, match="missing"):
        M.fit_forest(odd, FEATS, 2, 2)


def test_draws_are_even():
    ids = np.arange(-20000, 20000)
    u = TR.uniform(ids, 42, 3, 0)
    assert (u >= 0).all() and (u < 1).all() and abs(u.mean() - 0.5) < 0.01
    assert abs(np.corrcoef(u, TR.uniform(ids, 42, 4, 0))[0, 1]) < 0.02
    w = TR.poisson(u, 0.8)
    assert abs(w.mean() - 0.8) < 0.02 and abs(w.var() - 0.8) < 0.03
    sub = TR.node_features(np.arange(1, 3000), 6, 2, 42, 1)
    assert (np.diff(sub, axis=1) > 0).all() and abs(np.bincount(sub.reshape(-1)) / 2999 - 1 / 3).max() < 0.03


def test_rows_without_an_id_are_drawn_one_by_one(table):
    from riskfold.operators import models as M
    m = M.fit_forest(table.withColumn(C.ID, F.lit(None).cast("bigint")), FEATS, 8, 4)
    rows = [r["n"] for r in _roots(m)]
    assert all(500 < n < 900 for n in rows) and len(set(rows)) > 1


def _roots(m):
    from riskfold.operators import tree_shap as TS
    from pyspark.sql import SparkSession
    nodes = TS.saved_nodes(SparkSession.getActiveSession(), m.info["model"])
    return nodes.where("nodeData.id = 0").select(F.col("nodeData.rawCount").alias("n")).collect()
