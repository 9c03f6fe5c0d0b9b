"""Property tests: exactness against brute force, invariants of sampling."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from riskfold import constants as C
from riskfold.operators.neighbors import knn_join
from riskfold.operators.ranking import class_rank, md5_key, running_sums
from riskfold.operators.sampling import stratified_split
from riskfold.operators.smote import smote
from riskfold.operators.stats import exact_quantiles
from riskfold.plans import pipeline as PL

from .conftest import SF_SMALL


def test_exact_quantiles_match_numpy_with_refinement(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.lognormal(3, 2, 3000), np.full(500, 5.0), [np.nan] * 20])
    pdf = pd.DataFrame({"x": x, "y": rng.integers(0, 5, len(x)).astype(float)})
    df = spark.createDataFrame(pdf).withColumn("x", F.when(F.isnan("x"), None).otherwise(F.col("x")))
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    # few buckets force several histogram refinement passes
    q = exact_quantiles(df, ["x", "y"], probs, buckets=8)
    for c in ("x", "y"):
        v = pdf[c].dropna().to_numpy()
        for p in probs:
            assert np.isclose(q[(c, p)], np.quantile(v, p), rtol=0, atol=1e-12)


def test_class_rank_two_level_equals_window(spark):
    df = spark.range(5000).select(F.col("id").alias(C.ID), (F.col("id") % 3).cast("int").alias(C.LABEL))
    a = class_rank(df, C.LABEL, md5_key(), rank_col="r1", count_col=None)
    b = class_rank(df, C.LABEL, md5_key(), rank_col="r2", count_col=None, rows_per_range=300)
    j = a.join(b, [C.ID, C.LABEL])
    assert j.filter(F.col("r1") != F.col("r2")).count() == 0
    assert j.count() == 5000


def test_running_sums_two_level(spark):
    pdf = pd.DataFrame({"g": [i % 2 for i in range(2000)], "p": np.arange(2000) / 2000.0,
                        "v": np.arange(2000) % 7})
    df = spark.createDataFrame(pdf)
    a = running_sums(df, ["g"], "p", ["v"], prefix="a_").select("g", "p", "a_v")
    b = running_sums(df, ["g"], "p", ["v"], prefix="b_", rows_per_range=100).select("g", "p", "b_v")
    j = a.join(b, ["g", "p"])
    assert j.filter(F.col("a_v") != F.col("b_v")).count() == 0


def test_split_disjoint_and_stratified(spark):
    s = PL.split_borrowers(spark, SF_SMALL)
    tr = s.filter("split = 'train'").select(C.ID)
    te = s.filter("split = 'test'").select(C.ID)
    assert tr.intersect(te).count() == 0
    counts = {(r[0], r[1]): r[2] for r in s.groupBy(C.LABEL, "split").count().collect()}
    for k in {c for c, _ in counts}:
        n = counts.get((k, "train"), 0) + counts.get((k, "test"), 0)
        assert counts.get((k, "test"), 0) == round(0.2 * n)
    folds = s.filter("split = 'train'").groupBy(C.LABEL, "fold5").count().toPandas()
    for _, g in folds.groupby(C.LABEL):
        assert g["count"].max() - g["count"].min() <= 1


def _brute(q, r, k, ids):
    d = np.sqrt(((q[:, None, :] - r[None, :, :]) ** 2).sum(-1))
    return [list(ids[np.lexsort((ids, d[i]))[:k]]) for i in range(len(q))]


def test_knn_join_equals_brute_force_at_every_size(spark):
    rng = np.random.default_rng(3)
    n, d = 400, 5
    x = np.round(rng.normal(size=(n, d)), 2)  # rounded: many distance ties
    x[100:220] = x[100]                       # one vector held by a third of the rows
    pdf = pd.DataFrame(x, columns=[f"f{i}" for i in range(d)])
    pdf["rid"] = np.arange(n)
    pdf["lab"] = pdf["rid"] % 3
    feats = [f"f{i}" for i in range(d)]
    refs = spark.createDataFrame(pdf)
    qs = refs.filter("rid % 4 = 0").withColumnRenamed("rid", "qid")
    qpdf = pdf[pdf.rid % 4 == 0]
    exp = _brute(qpdf[feats].to_numpy(), x, 7, pdf["rid"].to_numpy())
    bad = refs.limit(3).withColumns({"f0": F.when(F.col("rid") == 0, None).otherwise(float("nan")),
                                     "rid": F.col("rid") + 9000})
    for sizes in ({}, {"cell_rows": 20, "probe": 1, "block": 16}, {"cell_rows": 7, "probe": 3, "block": 1000},
                  {"cell_rows": 50, "max_pivots": 2}):
        res = knn_join(qs, refs.union(bad), 7, feats, qid="qid", rid="rid", carry="lab", **sizes).toPandas()
        got = res.sort_values(["qid", "nn_rank"]).groupby("qid")["rid"].apply(list)
        for q, e in zip(qpdf["rid"], exp):
            assert got[q] == e
        assert (res["lab_nn"] == res["rid"] % 3).all()
    lost = knn_join(bad.withColumnRenamed("rid", "qid"), refs, 7, feats, qid="qid", rid="rid")
    assert lost.count() == 0 and knn_join(qs, refs.limit(0), 7, feats, qid="qid", rid="rid").count() == 0


def test_near_pairs_lose_no_neighbour():
    """Far fewer pairs than all get an exact distance, whatever the units are."""
    from riskfold.operators.neighbors import distances, near_pairs
    rng = np.random.default_rng(0)
    for scale, off in ((1, 0), (1, 1e5), (1e-12, 0), (1e20, 0)):
        x, y = (rng.normal(size=(n, 30)) * scale + off for n in (100, 3000))
        y[:3] *= 1000
        y[50:90] = y[50]                                    # ties
        x[:5] = y[50]
        d = distances(x, y)
        kth = np.partition(d, 4, axis=1)[:, 4]
        need = {tuple(p) for p in np.argwhere(d <= kth[:, None]).tolist()}
        for within in (np.full(100, np.inf), kth):
            got = set()
            for i, j, dist in near_pairs(x, y, 5, within):
                assert (dist == d[i, j]).all()
                got |= set(zip(i.tolist(), j.tolist()))
            assert need <= got and len(got) < 0.02 * d.size


def test_knn_join_inside_groups_without_the_row_itself(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame(np.round(rng.normal(size=(200, 3)), 1), columns=["a", "b", "c"])
    pdf.loc[20:60, ["a", "b", "c"]] = 0.5
    pdf["id"] = np.arange(200)
    pdf["g"] = np.where(pdf["id"] < 195, (pdf["id"] % 2).map(str), "lone")
    pdf.loc[199, "g"] = "single"
    df = spark.createDataFrame(pdf)
    for sizes in ({}, {"cell_rows": 11, "probe": 1, "block": 8}):
        got = knn_join(df, df, 4, ["a", "b", "c"], "id", "id", group="g", exclude_self=True, **sizes).toPandas()
        got = got.sort_values(["id", "nn_rank"]).groupby("id")["id_nn"].apply(list)
        for _, r in pdf.iterrows():
            own = pdf[(pdf["g"] == r["g"]) & (pdf["id"] != r["id"])]
            e = _brute(r[["a", "b", "c"]].to_numpy(float)[None], own[["a", "b", "c"]].to_numpy(), 4, own["id"].to_numpy())
            assert got.get(r["id"], []) == e[0]


def test_smote_balances_and_interpolates(spark):
    df, _ = PL.prepared(spark, SF_SMALL)
    tr = df.filter("split = 'train'")
    feats = C.ALL_FEATURES[:6]
    out = smote(tr, feats)
    counts = [r[1] for r in out.groupBy(C.LABEL).count().collect()]
    assert len(set(counts)) == 1
    assert out.filter("source = 'original'").count() == tr.count()
    # synthetic rows lie inside the per-class bounding box of the originals
    box = tr.groupBy(C.LABEL).agg(*[F.min(f).alias(f"lo_{f}") for f in feats],
                                  *[F.max(f).alias(f"hi_{f}") for f in feats])
    syn = out.filter("source = 'synthetic'").join(box, C.LABEL)
    for f in feats:
        assert syn.filter((F.col(f) < F.col(f"lo_{f}") - 1e-9) | (F.col(f) > F.col(f"hi_{f}") + 1e-9)).count() == 0


def test_auc_of_negated_scores(spark):
    from riskfold.operators.evaluate import roc_auc_by_class
    rng = np.random.default_rng(1)
    n = 300
    p = rng.dirichlet([1, 1, 1], n)
    pdf = pd.DataFrame({"model": "m", C.ID: np.arange(n), "split": "test", "y": rng.integers(0, 3, n),
                        "pred": p.argmax(1), "p0": p[:, 0], "p1": p[:, 1], "p2": p[:, 2]})
    df = spark.createDataFrame(pdf)
    neg = df.select("model", C.ID, "split", "y", "pred", *[(-F.col(f"p{k}")).alias(f"p{k}") for k in range(3)])
    a = {r["class"]: r["auc"] for r in roc_auc_by_class(df).collect()}
    b = {r["class"]: r["auc"] for r in roc_auc_by_class(neg).collect()}
    for k in range(3):
        assert abs(a[k] + b[k] - 1) < 1e-12


def test_scaled_training_rows_have_mean0_std1(spark):
    df, _ = PL.prepared(spark, SF_SMALL)
    st = df.filter("split = 'train'").agg(*[F.avg(f).alias(f"m_{f}") for f in C.ALL_FEATURES],
                                          *[F.stddev_pop(f).alias(f"s_{f}") for f in C.ALL_FEATURES]).first()
    for f in C.ALL_FEATURES:
        assert abs(st[f"m_{f}"]) < 1e-9
        assert abs(st[f"s_{f}"] - 1) < 1e-9 or st[f"s_{f}"] == 0


def test_nb_attributions_sum_to_score_minus_mean(spark):
    from riskfold.operators.explain import nb_attribution
    from riskfold.operators.naive_bayes import gaussian_nb_fit
    df, _ = PL.prepared(spark, SF_SMALL)
    tr = df.filter("split = 'train'")
    feats = C.ALL_FEATURES[:8]
    nb = gaussian_nb_fit(tr, feats)
    attr = nb_attribution(tr, tr, nb)
    jll = tr.select(C.ID, *[nb.jll(k).alias(f"j{k}") for k in nb.classes])
    means = jll.agg(*[F.avg(f"j{k}").alias(f"m{k}") for k in nb.classes]).first()
    sums = attr.groupBy(C.ID, "class").agg(F.sum("value").alias("s")).join(jll, C.ID).collect()
    for r in sums:
        k = r["class"]
        assert abs(r["s"] - (r[f"j{k}"] - means[f"m{k}"])) < 1e-6


def test_stream_equals_batch(spark):
    from riskfold.operators.naive_bayes import gaussian_nb_fit
    from riskfold.sources import files
    from riskfold.streaming.score_stream import nb_scorer, run_stream, score_frame
    split = PL.split_borrowers(spark, SF_SMALL)
    prep, state = PL.fit_prepare(split)
    nb = gaussian_nb_fit(prep.filter("split = 'train'"), C.ALL_FEATURES)
    apps = split.drop(C.LABEL, "split", "fold5", "fold3")
    src = files.scratch_path(spark, "apps")
    apps.repartition(3).write.parquet(src)
    scorer = nb_scorer(state, nb)
    saved = scorer.save(spark, files.scratch_path(spark, "scorer"))
    out = run_stream(spark, src, apps.schema, saved, files.scratch_path(spark, "out"),
                     files.scratch_path(spark, "ckpt"))
    batch = score_frame(apps, scorer)
    cols = [C.ID, "score", "pred", "band"]
    assert out.select(*cols).exceptAll(batch.select(*cols)).count() == 0
    assert out.count() == batch.count() == apps.count()


def test_permuted_rows_deal_each_column_anew(spark):
    from riskfold.operators.explain import permuted_rows
    rows = spark.range(200).select(F.col("id").alias(C.ID), (F.col("id") * 1.0).alias("a"),
                                   (F.col("id") % 7 + 0.5).alias("b"), (F.col("id") % 3).cast("int").alias("rank"))
    out = permuted_rows(rows, ["a", "b"]).toPandas()
    assert sorted(out["model"].unique()) == ["", "a", "b"] and len(out) == 600
    for f, other in (("a", "b"), ("b", "a")):
        p = out[out["model"] == f].set_index(C.ID).sort_index()
        assert sorted(p[f]) == sorted(out[out["model"] == ""][f])
        assert (p[f].to_numpy() != out[out["model"] == ""].set_index(C.ID).sort_index()[f].to_numpy()).any()
        assert (p[other].to_numpy() == out[out["model"] == ""].set_index(C.ID).sort_index()[other].to_numpy()).all()
    again = permuted_rows(rows.repartition(7), ["a", "b"]).toPandas()
    assert sorted(map(tuple, again[out.columns].to_numpy().tolist())) == sorted(map(tuple, out.to_numpy().tolist()))


def test_near_pairs_leave_few_pairs_a_query():
    from riskfold.operators.neighbors import distances, near_pairs
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(200, 10)), rng.normal(size=(20_011, 10))
    want = np.sort(distances(x, y), axis=1)[:, :5]
    got = [[] for _ in x]
    for i, j, dist in near_pairs(x, y, 5, np.full(len(x), np.inf)):
        for q, d in zip(i, dist):
            got[q].append(d)
    assert all(sorted(g)[:5] == list(w) for g, w in zip(got, want))
    assert sum(map(len, got)) <= 8 * len(x)
