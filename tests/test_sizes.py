"""Size settings and missing values must not change results; literal values."""
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from riskfold import constants as C
from riskfold.functions import rules as R
from riskfold.operators import evaluate as EV
from riskfold.operators.ranking import class_rank, running_sums
from riskfold.operators.stats import exact_quantiles


def test_ranks_keep_null_classes_at_any_range_size(spark):
    rows = [(i, None if i % 10 == 0 else i % 3) for i in range(400)]
    d = spark.createDataFrame(rows, "borrower_id long, Credit_Score int")
    got = [sorted(map(tuple, class_rank(d, rows_per_range=n).collect()), key=str) for n in (2_000_000, 17)]
    assert got[0] == got[1] and len(got[0]) == 400
    nulls = [r for r in got[0] if r[1] is None]
    assert sorted(r[2] for r in nulls) == list(range(40)) and {r[3] for r in nulls} == {40}


def test_running_sums_keep_null_parts_at_any_range_size(spark):
    d = spark.createDataFrame([(None if i % 4 == 0 else "m", float(i), i) for i in range(100)], "g string, p double, v long")
    got = [sorted(map(tuple, running_sums(d, ["g"], "p", ["v"], rows_per_range=n).collect()), key=str) for n in (10 ** 6, 7)]
    assert got[0] == got[1] and len(got[0]) == 100


def test_quantiles_treat_nan_as_missing_and_converge(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate((rng.normal(size=50), 10.0 ** rng.uniform(-300, 300, 40), [0.0] * 9, [float("nan")], [5e-324]))
    d = spark.createDataFrame(pd.DataFrame({"x": x, "y": np.arange(len(x), dtype=float)}))
    q = exact_quantiles(d, ["x", "y"], [0.0, 0.25, 0.5, 0.9, 1.0])
    for p in (0.0, 0.25, 0.5, 0.9, 1.0):
        assert math.isclose(q[("x", p)], pd.Series(x).quantile(p), rel_tol=1e-12, abs_tol=1e-300)
        assert q[("y", p)] == pd.Series(np.arange(len(x))).quantile(p)


def test_numbers_and_labels_from_text(spark):
    t = ["12", " -5.5 ", "1e3", ".5", "12_", "abc", "", "1d", "1f", "NaN", "inf", "-Infinity", "0x1A", None]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(t)], "i int, x string")
    got = [r.v for r in d.select("i", R.coerce_numeric("x").alias("v")).orderBy("i").collect()]
    assert got == [12.0, -5.5, 1000.0, 0.5, None, None, None, None, None, None, math.inf, -math.inf, None, None]
    lab = spark.createDataFrame([("Poor",), (" Good",), ("7",), ("2",), ("",), (None,)], "x string")
    assert [r.v for r in lab.select(R.label_map_on_read("x").alias("v")).collect()] == [0, 2, None, None, None, None]


def test_fixed_values_literally(spark):
    d = spark.createDataFrame([("⚠️ a_b",), ("✅ ok",), ("💡 c",)], "x string")
    assert [r.v for r in d.select(R.name_cleanup("x").alias("v")).collect()] == ["[!] a b", "[OK] ok", "[>] c"]
    assert C.EXPECTED_RANGE == [(30000, 400, 560), (80000, 540, 700), (150000, 650, 780)]
    assert C.SCORE_ZONES == [300, 580, 670, 740, 800, 850]
    assert [k for k, lower, _ in C.DEVIATION_KEYS if not lower] == ["Credit_History_Age", "Annual_Income"]


def test_roc_starts_at_zero_and_best_model_is_first_of_the_board(spark):
    rows = [("b", 0, 0, .9, .1, .0), ("b", 1, 1, .1, .8, .1), ("b", 2, 2, .0, .2, .8)]
    d = spark.createDataFrame(rows + [("a", *r[1:]) for r in rows], "model string, y int, pred int, p0 double, p1 double, p2 double")
    start = EV.roc_curve(d).where(F.col("threshold") == float("inf")).collect()
    assert len(start) == 6 and {(r.tpr, r.fpr) for r in start} == {(0.0, 0.0)}
    m = EV.metrics_table(d)
    assert EV.best_model(m).first().best_model == EV.leaderboard(m).first().model == "a"


def test_label_codes_do_not_depend_on_the_ranges(spark):
    from riskfold.operators import prepare as PR
    d = spark.createDataFrame([(f"v{i * 7919 % 3000:04d}", None if i % 50 == 0 else f"w{i % 13}") for i in range(4000)],
                              "a string, b string")
    want = {("a", v): float(k) for k, v in enumerate(sorted({f"v{i:04d}" for i in range(3000)}))}
    want.update({("b", v): float(k) for k, v in enumerate(sorted({f"w{i}" for i in range(13)} | {"nan"}))})
    for per in (200_000, 100):
        codes = PR.label_encode_fit(d, ["a", "b"], per_range=per)
        assert {(r["column"], r["value"]): r["code"] for r in codes.collect()} == want
    got = PR.label_encode_apply(d.withColumn("t", F.col("a")), codes, ["a", "b"]).collect()
    assert all(r["a"] == want["a", r["t"]] for r in got)


def test_most_frequent_values_are_exact(spark):
    from riskfold.operators import prepare as PR
    rng = np.random.default_rng(2)
    n = 6000
    d = pd.DataFrame({"flat": np.arange(n, dtype=float) * 1.5, "zipf": rng.zipf(1.5, n).clip(0, 1e6).astype(float),
                      "tie": np.r_[np.full(n // 2, 9.0), np.full(n // 2, 4.0)], "hot": np.r_[np.full(n // 3, -1.0), rng.normal(size=n - n // 3)],
                      "none": np.full(n, np.nan)})
    d.loc[::17, "tie"] = np.nan
    df = spark.createDataFrame(d.where(d.notna(), None).astype(object), ", ".join(f"{c} double" for c in d.columns))
    for tracked in (4096, 64):
        got = PR.impute_most_frequent_fit(df, list(d.columns), listed=16, tracked=tracked)
        for c in d.columns:
            m = d[c].mode(dropna=True)
            assert got[c] == (m.iloc[0] if len(m) else None), c
    assert PR.proven_mode([(1.0, 50), (2.0, 50)], 10, 30.0) == 1.0
    assert PR.proven_mode([(1.0, 50), (2.0, 40)], 40, 10.0) is None and PR.proven_mode([], 0, 0.0) is None


def test_restarted_stream_writes_no_row_twice_and_equals_batch(spark, tmp_path):
    from riskfold.operators.models import fit_forest
    from riskfold.plans import pipeline as PL
    from riskfold.streaming import score_stream as ST
    split = PL.split_borrowers(spark, "/root/testdata/sf0.001")
    prep, state = PL.fit_prepare(split)
    feats = C.ALL_FEATURES[:8]
    scorer = ST.forest_file_scorer(state, fit_forest(prep.filter("split = 'train'"), feats, 5, 3))
    saved = scorer.save(spark, str(tmp_path / "scorer"))
    apps = split.drop(C.LABEL, "split", "fold5", "fold3")
    src, out, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    apps.where("borrower_id % 2 = 0").write.parquet(src)
    first = ST.run_stream(spark, src, apps.schema, saved, out, ckpt, files_per_trigger=1)
    assert first.count() == apps.where("borrower_id % 2 = 0").count()
    apps.where("borrower_id % 2 = 1").write.mode("append").parquet(src)
    import shutil
    again = str(tmp_path / "ckpt-again")    # without the commits the last batch looks unfinished: it runs again
    shutil.copytree(ckpt, again, ignore=shutil.ignore_patterns("commits"))
    got = ST.run_stream(spark, src, apps.schema, saved, out, again)
    batch = ST.score_frame(apps, ST.load_scorer(spark, saved))
    key = lambda d: sorted(map(tuple, d.select(*ST.SCORED).collect()))
    assert key(got) == key(batch) == key(ST.score_frame(apps, scorer)) and got.count() == apps.count()


def test_quantiles_of_many_columns_take_few_passes_and_keep_infinities(spark, monkeypatch):
    from riskfold.operators import stats as S
    rng = np.random.default_rng(5)
    x = {f"c{i}": rng.normal(size=3000) * 10.0 ** i for i in range(12)}
    x["c0"][:900], x["c0"][900:1500], x["c1"][:2000] = -np.inf, np.inf, 7.0
    d = spark.createDataFrame(pd.DataFrame(x)).repartition(3)
    passes, plain = [], S._refine
    monkeypatch.setattr(S, "_refine", lambda *a, **kw: (passes.append(1), plain(*a, **kw)))
    probs = [i / 10 for i in range(1, 10)]
    q = S.exact_quantiles(d, list(x), probs)
    assert len(passes) <= 6
    for c, v in x.items():
        for p in probs:
            s, h = np.sort(v), 2999 * p
            with np.errstate(invalid="ignore"):
                want = s[math.floor(h)] if h % 1 == 0 else s[math.floor(h)] + (s[math.floor(h) + 1] - s[math.floor(h)]) * (h % 1)
            assert math.isnan(want) or math.isclose(q[(c, p)], want, rel_tol=1e-9)
    assert q[("c1", 0.5)] == 7.0
    got = S.order_statistics(d, {"c0": [0, 899, 900, 2399, 2400]}, S.column_stats(d, ["c0"]))
    low, high = np.sort(x["c0"])[[900, 2399]]
    assert [got[("c0", r)] for r in (0, 899, 900, 2399, 2400)] == [-math.inf, -math.inf, low, high, math.inf]


def test_scores_and_encoded_rows_are_written_once(spark):
    from riskfold.operators import selection as SEL
    from riskfold.plans import pipeline as PL
    rows = [(i, i % 3, float(i % 7), float(i)) for i in range(90)]
    d = spark.createDataFrame(rows, f"id long, {C.LABEL} int, a double, b double")
    mi = SEL.mutual_information(d, ["a", "b"])
    assert mi.count() == 2 and "Aggregate" not in mi._jdf.queryExecution().optimizedPlan().toString()
    split = PL.split_borrowers(spark, "/root/testdata/sf0.001")
    prep, _ = PL.fit_prepare(split)
    assert prep.count() == split.count() and "Join" not in prep._jdf.queryExecution().optimizedPlan().toString()


def test_elimination_table_is_cut_by_the_width_of_its_vectors(spark, monkeypatch):
    from riskfold.operators import crossval as CV
    from riskfold.operators.rfe import rfecv
    d = spark.createDataFrame([(i, i % 3, i % 2, *[float(i * j % 7 + i % 3) for j in range(1, 8)]) for i in range(96)],
                              "borrower_id long, Credit_Score int, fold2 int, " + ", ".join(f"f{j} double" for j in range(7)))
    seen, plain = [], CV.fit_table

    def spy(*args, **kw):
        seen.append(plain(*args, **kw))
        return seen[-1]
    monkeypatch.setattr(CV, "fit_table", spy)
    monkeypatch.setattr(CV, "FIT_BYTES", 96 * 4 * 8)        # all rows, if a vector were one number
    rfecv(d, [f"f{j}" for j in range(7)], "fold2", k=2, min_features=6, num_trees=2, max_depth=2)
    assert len(seen) == 1 and len(seen[0].inputFiles()) == 3 and seen[0].count() == 96


def test_cents_are_those_of_the_decimal_cast(spark):
    from riskfold.sources.tables import MONEY, cents, from_cents
    odd = [0.1, 0.005, 1.005, 2.675, -1.005, -0.01, 0.0, -0.0, 1 / 3, 123456789012.34, 99999999999999.99, 5e14 + 0.25,
           1e-300, 33.335, None, float("nan"), float("inf"), 0.29, 4.35, 1.15]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "i int, x double")
    got = d.select("x", cents(F.col("x")).alias("c"), (F.col("x").cast(MONEY) * 100).cast("bigint").alias("want")).collect()
    assert [r.c for r in got] == [r.want for r in got]
    s = d.agg(from_cents(F.sum(cents(F.col("x")))).alias("got"), F.sum(F.col("x").cast(MONEY)).cast("double").alias("want"))
    assert s.first().got == s.first().want


def test_line_items_are_summed_without_decimals_a_row(spark, tmp_path):
    """Repeated suppliers, suppliers and customers that are NULL, a customer without taxes."""
    from riskfold.sources.tables import customer_features
    ts = "timestamp_ntz'2024-01-0{}'"
    spark.sql("SELECT * FROM VALUES " + ", ".join(
        f"({k}L, {c}, 'O', 10.1D, {ts.format(1)}, '{p}')" for k, c, p in
        [(1, "7L", "a"), (2, "7L", "b"), (3, "8L", "a"), (4, "CAST(NULL AS BIGINT)", "a")])
        + " AS t(o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority)"
    ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("SELECT * FROM VALUES " + ", ".join(
        f"({k}L, {s}, {q}D, {d}D, {t}, '{r}', {ts.format(3)})" for k, s, q, d, t, r in
        [(1, "5L", 1, 0.1, "0.02D", "R"), (2, "5L", 2, 0.2, "0.03D", "N"), (2, "6L", 3, 0.3, "CAST(NULL AS DOUBLE)", "R"),
         (1, "CAST(NULL AS BIGINT)", 4, 0.1, "0.01D", "N"), (3, "5L", 5, 0.1, "CAST(NULL AS DOUBLE)", "N"),
         (4, "5L", 6, 0.1, "0.01D", "N"), (9, "5L", 6, 0.1, "0.01D", "N")])
        + " AS t(l_orderkey, l_suppkey, l_quantity, l_discount, l_tax, l_returnflag, l_shipdate)"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql(f"SELECT 1L AS event_id, 7L AS user_id, 'purchase' AS event_type, 0.1D AS value "
              f"UNION ALL SELECT 2L, 7L, 'purchase', 0.2D UNION ALL SELECT 3L, 7L, 'view', 9D"
              ).write.parquet(f"{tmp_path}/events.parquet")
    o, l, e = customer_features(spark, str(tmp_path))
    got = {r.l_custkey: tuple(r)[1:] for r in l.collect()}
    assert got[7] == (2, 0.06 / 3, 8, 2, 0.7 / 4, 10.0)
    assert got[8] == (1, None, 2, 0, 0.1, 5.0)
    assert {r.o_custkey: (r.total, r.n_prio) for r in o.collect()}[7] == (20.2, 2)
    assert [tuple(r) for r in e.collect()] == [(7, 3, 0.3)]
    assert "sum(cast(" not in l._jdf.queryExecution().executedPlan().toString()
