"""Trained models, fold-wise oversampling, search and tree attributions on a
small table whose label follows two of its columns."""
from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskfold import constants as C
from riskfold.operators import crossval as CV
from riskfold.operators import evaluate as EV
from riskfold.operators import models as M
from riskfold.operators import search as SE
from riskfold.operators import tree_shap as TS
from riskfold.operators.rfe import macro_f1, rfecv

FEATS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(360, 4))
    s = x[:, 0] + 0.7 * x[:, 1] + 0.3 * rng.normal(size=360)
    y = np.digitize(s, [-0.9, 1.1])
    pdf = pd.DataFrame(x, columns=FEATS)
    pdf[C.ID], pdf[C.LABEL] = np.arange(360), y.astype("int32")
    pdf["fold5"], pdf["fold3"] = (pdf[C.ID] % 5).astype("int32"), (pdf[C.ID] % 3).astype("int32")
    return CV.fit_table(spark.createDataFrame(pdf).withColumns({
        C.LABEL: F.col(C.LABEL).cast("int"), "fold5": F.col("fold5").cast("int"), "fold3": F.col("fold3").cast("int")}),
        "rows", [C.ID])


@pytest.fixture(scope="module")
def parts(rows):
    return rows.where("borrower_id < 270"), rows.where("borrower_id >= 270").withColumn("split", F.lit("test"))


BUILDERS = {
    "Logistic Regression": lambda tr, f: M.fit_logistic(tr, f, 1.0, 200),
    "Random Forest": lambda tr, f: M.fit_forest(tr, f, 20, 5, 2),
    "Extra Trees": lambda tr, f: M.fit_extra_trees(tr, f, 20, 6, trees_per_draw=5),
    "Gradient Boosting": lambda tr, f: M.fit_ovr_gbt(tr, f, 8, 3, 0.3),
    "SVM": lambda tr, f: M.fit_svm_rff(tr, f, 1.0, n_comp=60),
    "Naive Bayes": M.fit_naive_bayes,
    "KNN": M.fit_knn,
}


@pytest.mark.parametrize("name", list(BUILDERS))
def test_models_keep_the_contract(parts, name):
    train, test = parts
    m = BUILDERS[name](train, FEATS)
    out = M.scored_rows(m, test).toPandas()
    assert sorted(out[C.ID]) == list(range(270, 360)) and out[C.ID].is_unique
    p = out[["p0", "p1", "p2"]].to_numpy()
    assert np.allclose(p.sum(1), 1, atol=1e-6) and (p >= 0).all()
    assert (out["pred"].to_numpy() == p.argmax(1)).all()
    auc = EV.roc_auc_ovr_macro(M.scored_rows(m, test)).first()["roc_auc"]
    majority = out["y"].value_counts().max() / len(out)
    assert auc > 0.85 and (out["pred"] == out["y"]).mean() > majority


def test_extra_trees_split_only_at_their_own_drawn_points(parts):
    train, _ = parts
    m = M.fit_extra_trees(train, FEATS, 10, 5, trees_per_draw=5, n_cuts=4)
    lo = np.array([train.agg(F.min(f)).first()[0] for f in FEATS])
    hi = np.array([train.agg(F.max(f)).first()[0] for f in FEATS])
    draws = [M.random_cuts(lo, hi, 4, d) for d in range(2)]
    for f in range(4):
        assert not set(draws[0][f]) & set(draws[1][f])
        assert all(lo[f] < x < hi[f] for d in draws for x in d[f])
    for member in m.info["members"]:
        assert member.getNumTrees == 5
        for line in member.toDebugString.splitlines():
            if "<=" in line and "If" in line:
                assert 0 <= float(line.split("<=")[1].strip(" )")) <= 4


def test_synthetic_parents_are_never_in_the_validation_fold(spark, rows):
    cv = CV.fold_training(rows, FEATS, "fold5", 5)
    got = cv.toPandas()
    for f in range(5):
        own = got[got["cv_fold"] == f]
        assert own.groupby(C.LABEL).size().nunique() == 1
        orig = own[own["source"] == "original"]
        assert sorted(orig[C.ID]) == [i for i in range(360) if i % 5 != f]
        syn = own[own["source"] == "synthetic"]
        assert len(syn) and (syn[C.ID] < 0).all()
        base = orig[[C.LABEL, *FEATS]]
        for _, r in syn.head(40).iterrows():            # on a segment between two training rows of its class
            x = base[base[C.LABEL] == r[C.LABEL]][FEATS].to_numpy()
            v = r[FEATS].to_numpy(float)
            d = np.linalg.norm(x - v, axis=1)
            near = np.argsort(d)[:40]
            assert min(abs(d[i] + d[j] - np.linalg.norm(x[i] - x[j])) for i in near for j in near) < 1e-9
    assert got[got["source"] == "synthetic"][C.ID].is_unique
    again = CV.fold_training(rows.repartition(6), FEATS, "fold5", 5).toPandas()
    key = ["cv_fold", C.ID]
    pd.testing.assert_frame_equal(got.sort_values(key).reset_index(drop=True), again.sort_values(key).reset_index(drop=True))


def test_out_of_fold_rows_are_scored_by_members_that_did_not_see_them(rows):
    cv = CV.fold_training(rows, FEATS, "fold3", 3)
    seen = {}

    def spy(train, features):
        m = M.fit_naive_bayes(train, features)
        ids = frozenset(r[0] for r in train.select(C.ID).collect())
        inner = m.predict

        def predict(df):
            here = {r[0] for r in df.select(C.ID).collect()}
            assert not here & ids
            seen.update({i: ids for i in here})
            return inner(df)
        m.predict = predict
        return m
    oof = CV.out_of_fold("Naive Bayes", spy, cv, rows, FEATS, "fold3", 3, parallelism=1)
    assert sorted(r[0] for r in oof.select(C.ID).collect()) == list(range(360)) and len(seen) == 360
    other = CV.out_of_fold("Logistic Regression", BUILDERS["Logistic Regression"], cv, rows, FEATS, "fold3", 3)
    both = oof.unionByName(other)
    members = ["Naive Bayes", "Logistic Regression"]
    meta = CV.meta_table(both, members, [C.ID, "y"])
    assert meta.count() == 360 and meta.dropna().count() == 360
    scores = {(r["model"], r["fold"]): r["roc_auc"] for r in CV.fold_scores(both).collect()}
    assert len(scores) == 6 and min(scores.values()) > 0.85
    for f in range(3):                                  # one fold by itself gives the same score
        alone = EV.roc_auc_ovr_macro(oof.where(F.col("fold") == f)).first()["roc_auc"]
        assert abs(alone - scores["Naive Bayes", f]) < 1e-12
    test = M.scored_rows(M.fit_naive_bayes(rows, FEATS), rows.withColumn("split", F.lit("test"))).unionByName(
        M.scored_rows(BUILDERS["Logistic Regression"](rows, FEATS), rows.withColumn("split", F.lit("test"))))
    stack = CV.stacking(both, test, members)
    assert stack.count() == 360 and EV.roc_auc_ovr_macro(stack).first()["roc_auc"] > 0.9
    nested = CV.stacking_oof(both, members, 3)
    assert nested.count() == 360 and CV.vote_oof(both, members).count() == 360


def test_platt_rows_are_not_fit_rows(spark):
    half = [r[0] for r in spark.range(2000).select(M.calibration_half("id")).collect()]
    assert set(half) == {0, 1} and 850 < sum(half) < 1150


def test_elimination_walks_a_path_per_fold(rows):
    assert abs(macro_f1({(0, 0): 3, (0, 1): 1, (1, 1): 4, (2, 1): 2}) - np.mean([6 / 7, 8 / 11, 0])) < 1e-12
    sel, curve, paths = rfecv(rows, FEATS, "fold3", 3, min_features=2, num_trees=8, max_depth=4)
    p = paths.toPandas()
    assert set(p["fold"]) == {0, 1, 2} and sorted(p["n_features"].unique()) == [2, 3, 4]
    c = curve.toPandas().set_index("n_features")
    for n, g in p.groupby("n_features"):
        assert abs(c.loc[n, "mean"] - g["f1"].mean()) < 1e-12 and abs(c.loc[n, "std"] - g["f1"].std(ddof=0)) < 1e-12
    best = max(c.index, key=lambda n: (c.loc[n, "mean"], -n))
    assert len(sel) == best and {"a", "b"} <= set(sel)


# ------------------------------------------------------------------ search
def _toy(trials, share):
    return {t.number: -(t.params["maxDepth"] - 6) ** 2 - abs(np.log10(t.params["minInfoGain"]) + 3) - (1 - share)
            for t in trials}


def test_search_halves_and_replays():
    seen = []

    def evaluate(trials, share):
        seen.append((len(trials), share))
        return _toy(trials, share)
    got = SE.search(evaluate)
    assert len(got) == 25 and seen[:5] == [(5, 1 / 9)] * 5
    assert seen[5:] == [(9, 1 / 3), (3, 1.0)] and sorted({t.rung for t in got}) == [0, 1, 2]
    again = SE.search(_toy)
    assert [(t.number, t.params, t.value, t.rung) for t in got] == [(t.number, t.params, t.value, t.rung) for t in again]
    for t in got:
        for p, (kind, lo, hi) in SE.SPACE.items():
            assert lo <= t.params[p] <= hi and (kind != "int" or isinstance(t.params[p], int))
    assert SE.best_trial(got).rung == 2


def test_search_finds_better_trials_than_random_draws():
    def mean_of(last, adaptive):
        best = []
        for seed in range(12):
            trials = SE.search(_toy, n_trials=60, rungs=(1.0,), seed=seed)
            if not adaptive:
                trials = [SE.Trial(k, SE.suggest([], k, seed)) for k in range(60)]
                for t in trials:
                    t.first = _toy([t], 1.0)[t.number]
            best.append(np.mean([t.first for t in trials[-last:]]))
        return np.mean(best)
    assert mean_of(30, True) > mean_of(30, False) + 1


def test_parzen_density_sums_to_one():
    p = SE.Parzen([0.1, 0.12, 0.7])
    grid = (np.arange(4000) + 0.5) / 4000
    assert abs(np.mean([p.density(x) for x in grid]) - 1) < 1e-3
    rng = np.random.default_rng(0)
    assert all(0 <= p.draw(rng) <= 1 for _ in range(200))


def test_forest_trials_measure_every_fold(rows):
    cv = CV.fold_training(rows, FEATS, "fold3", 3)
    small = {"numTrees": 20, "maxDepth": 3, "subsamplingRate": 1.0, "featureShare": 1.0, "minInstancesPerNode": 1,
             "minInfoGain": 1e-5}
    evaluate = SE.forest_trials(cv, rows, FEATS, "fold3", 3)
    trials = [SE.Trial(0, small), SE.Trial(1, {**small, "maxDepth": 5})]
    full = evaluate(trials, 1.0)
    assert set(full) == {0, 1} and min(full.values()) > 0.85 and evaluate(trials, 1.0) == full
    assert evaluate(trials, 0.2) != full


# ------------------------------------------------------------------ tree attributions
def _expected(nodes, x, known, i=None):
    left, right, f, threshold, n, value = nodes[min(nodes) if i is None else i]
    if left < 0:
        return np.asarray(value, float)
    if f in known:
        return _expected(nodes, x, known, left if x[f] <= threshold else right)
    return sum(nodes[c][4] / n * _expected(nodes, x, known, c) for c in (left, right))


def _brute(trees, weights, x, n_feat):
    f = lambda s: sum(w * _expected(t, x, set(s)) for t, w in zip(trees, weights))
    out = []
    for i in range(n_feat):
        rest = [j for j in range(n_feat) if j != i]
        out.append(sum(factorial(k) * factorial(n_feat - 1 - k) / factorial(n_feat) * (f([*s, i]) - f(s))
                       for k in range(n_feat) for s in combinations(rest, k)))
    return np.array(out), f([])


def _saved(spark, model):
    trees = {}
    for r in TS.saved_nodes(spark, model).select("treeID", "nodeData.*").collect():
        stats = np.array(r["impurityStats"], float)
        cut = r["split"]["leftCategoriesOrThreshold"]
        trees.setdefault(r["treeID"], {})[r["id"]] = (r["leftChild"], r["rightChild"], r["split"]["featureIndex"],
                                                      cut[0] if cut else None, stats.sum(), stats / stats.sum())
    return [trees[t] for t in sorted(trees)]


@pytest.mark.parametrize("depth,n_trees", [(2, 6), (5, 3)])
def test_tree_attributions_equal_all_subsets_and_add_up(spark, parts, depth, n_trees):
    train, test = parts
    m = M.fit_forest(train, FEATS, n_trees, depth, 2)
    leaves = TS.forest_leaves(spark, m.info["model"], FEATS)
    scored = m.predict(test)
    got = TS.tree_attribution(scored, leaves, keep=["p0", "p1", "p2", "pred"]).collect()
    assert len(got) == 90
    trees = _saved(spark, m.info["model"])
    xs = {r[C.ID]: [r[f] for f in FEATS] for r in test.collect()}
    for k, r in enumerate(got):
        phi = np.array([[a["value"] for a in c] for c in r["attr"]])    # class, feature
        assert np.allclose(phi.sum(1) + leaves.base, [r["p0"], r["p1"], r["p2"]], atol=1e-9)
        assert [a["feature"] for a in r["attr"][0]] == FEATS
        if k < 12:
            want, base = _brute(trees, [1 / n_trees] * n_trees, xs[r[C.ID]], 4)
            assert np.allclose(phi.T, want, atol=1e-9) and np.allclose(base, leaves.base, atol=1e-9)


def test_top_features_of_a_row_need_no_shuffle(spark, parts):
    from riskfold.operators import explain as X
    train, test = parts
    m = M.fit_forest(train, FEATS, 4, 4, 2)
    attr = TS.tree_attribution(m.predict(test), TS.forest_leaves(spark, m.info["model"], FEATS), keep=["pred"])
    top = X.for_applicant(attr, 3)
    assert "Exchange" not in top._jdf.queryExecution().executedPlan().toString()
    got = top.toPandas()
    assert (got.groupby(C.ID).size() == 3).all()
    for _, g in got.groupby(C.ID):
        assert list(g.sort_values("position")["value"]) == sorted(g["value"]) and sorted(g["rank"]) == [1, 2, 3]
        assert list(g.sort_values("rank")["value"].abs()) == sorted(g["value"].abs(), reverse=True)
