"""Queries against their SQL, kernels against known values, and properties of fits."""

import math
import os
import warnings

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from entroflow.functions import frames
from entroflow.functions import kernels as K
from entroflow.operators import prep, steps
from entroflow.operators.classifier import EspaClassifier, converged
from entroflow.operators.information import feature_information, mutual_information
from entroflow.operators.scalers import MinMaxScaler, QuantileTransformer, melt
from entroflow.plans import registry
from entroflow.sources.tables import load_model, save_model

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    df = registry.QUERIES[name](spark, SF)
    rel = con.sql(registry.ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    order = [rel.columns.index(c) for c in cols]
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    want = sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or (isinstance(x, float) and float(x) == float(y)) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", ["quantile_fit", "quantile_transform", "quantile_interp", "quantile_inverse", "quantile_single", "mi_matrix"])
def test_order_in_pieces(spark, monkeypatch, name):
    """The same results when every column falls into many pieces."""
    from entroflow.functions import ordered

    monkeypatch.setattr(ordered, "PIECE_ROWS", 7)
    test_query_matches_sql(spark, name)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def arr(*v):
    return F.array(*(F.lit(float(x)) for x in v)) if v else F.array().cast("array<double>")


def test_kernels(spark):
    assert value(spark, K.safelog(F.lit(0.0))) == pytest.approx(math.log(K.EPS))
    assert value(spark, K.safelog(F.lit(-1.0), 1e-20)) == pytest.approx(math.log(1e-20))
    assert value(spark, K.entropy(arr(0.25, 0.25, 0.25, 0.25))) == pytest.approx(2 * math.log(2))
    assert value(spark, K.entropy(arr(0.5, 0.5, 0, 0))) == pytest.approx(math.log(2))
    assert value(spark, K.assign_closest(arr(3, 1, 1))) == 2
    assert value(spark, K.normalise(arr(0, 0, 0, 0))) == [0.25] * 4
    assert value(spark, K.normalise(arr())) == []
    assert value(spark, K.softmax(arr(-math.inf, -math.inf))) == [0.5, 0.5]
    assert value(spark, K.effective_dimension(arr(0))) == 1 and value(spark, K.effective_dimension(arr())) == 0
    assert value(spark, K.effective_dimension(arr(1, 0, 0, 0), True)) == pytest.approx(0.25)
    with pytest.raises(ValueError):
        K.softmax(arr(1), 0.0)
    with pytest.raises(Exception, match="differ in size"):
        value(spark, K.cross_entropy(arr(1), arr(1, 2)))
    exact = -0.5772156649015329
    for n in range(1, 40):
        assert value(spark, K.digamma(F.lit(n))) == pytest.approx(exact, abs=1e-9)
        exact += 1 / n


def test_effective_dimension_and_strength_are_inverse(spark):
    for d in (3, 10, 1000):
        for eps in (1e-2, 0.3, 5.0):
            assert value(spark, K.get_eps(K.get_eff(F.lit(eps), d), d)) == pytest.approx(eps, rel=1e-8)
    assert value(spark, K.get_eps(F.lit(1.0), 4)) == K.EPS and value(spark, K.get_eps(F.lit(4.0), 4)) == math.inf
    with pytest.raises(ValueError):
        K.get_eff(F.lit(1.0), 0)


def test_long_matrices(spark):
    m = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0), (2, 1, 3.0), (2, 2, 4.0), (1, 3, 0.0), (2, 3, 0.0)], "i int, j int, v double")
    got = {(r.i, r.j): r.v for r in frames.left_stochastic(m).collect()}
    assert got[1, 1] == 0.25 and got[2, 2] == pytest.approx(4 / 6) and got[1, 3] == 0.5


def test_minmax(spark):
    x = spark.createDataFrame([(1.0, 1.0), (1.0, 3.0), (1.0, None)], "a double, b double")
    s = MinMaxScaler((2.0, 4.0)).fit(x, ["a", "b"])
    out = s.transform(x)
    assert [tuple(r) for r in out.collect()] == [(2.0, 2.0), (2.0, 4.0), (2.0, None)]
    assert [tuple(r) for r in s.inverse_transform(out).collect()] == [(1.0, 1.0), (1.0, 3.0), (1.0, None)]
    nan = MinMaxScaler().fit(spark.createDataFrame([(1.0,), (math.nan,)], "a double"), ["a"])
    assert all(math.isnan(v) for v in nan.bounds["a"])
    with pytest.raises(ValueError):
        MinMaxScaler((1.0, 0.0))
    for odd in (x.drop("b"), x.withColumn("c", F.lit(1.0))):
        for step in (s.transform, s.inverse_transform):
            with pytest.raises(ValueError, match="columns differ"):
                step(odd)
    assert s.transform(x.withColumn("c", F.lit(1.0)), carry=["c"]).columns == ["a", "b", "c"]


def test_quantile(spark):
    x = spark.createDataFrame([(i, float(i), c) for i, c in enumerate([1.0, 1.0, 1.0, 5.0, 5.0, 5.0, 10.0, 10.0, 10.0, 10.0], 1)], "id int, a double, c double")
    q = QuantileTransformer().fit(x, ["a", "c"])
    out = {r.id: r for r in q.transform(x.select("id", "c", "a"), ["id"]).collect()}
    assert [round(out[i].a, 9) for i in range(1, 11)] == [round(i / 9, 9) for i in range(10)]
    assert out[1].c == 0 and out[4].c == 0.5 and out[10].c == 1
    new = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.5, 7.0), (3, 11.0, math.nan)], "id int, a double, c double")
    got = {r.id: (r.a, r.c) for r in q.transform(new, ["id"]).collect()}
    assert got == {1: (0.0, 0.0), 2: (0.5, pytest.approx(0.7)), 3: (1.0, 0.5)}
    back = {r.id: r.a for r in q.inverse_transform(q.transform(x, ["id"]), ["id"]).collect()}
    assert all(back[i] == pytest.approx(i, abs=1e-9) for i in back)
    empty = QuantileTransformer().fit(x.filter("a > 99"), ["a"])
    assert math.isnan(empty.inverse_long(melt(x.limit(1), ["id"], ["a"])).first()["v"])


def test_weights(spark):
    w = spark.createDataFrame([(1,), (2,), (3,)], "w int")
    assert sorted(r[0] for r in prep.normalised_weights(w, "w", "x").select("x").collect()) == pytest.approx([1 / 6, 2 / 6, 3 / 6])
    with pytest.raises(ValueError):
        prep.normalised_weights(spark.createDataFrame([("a",)], "w string"), "w")


def blobs(spark, n=90, d=3, seed=0):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % 3
    x = rng.normal(0, 0.15, (n, d)) + np.array([[0, 0, 0], [1, 1, 0], [0, 1, 0]])[y][:, :d]
    return spark.createDataFrame([(i, *map(float, x[i]), "abc"[y[i]], float(1 + i % 4)) for i in range(n)], "id int, x1 double, x2 double, x3 double, y string, w double")


X = ["x1", "x2", "x3"]


def test_information(spark):
    rng = np.random.default_rng(1)
    v = rng.uniform(size=2000)
    rows = [("step", str(x >= 0.5), float(x), i) for i, x in enumerate(v)] + [("none", str(i % 2), float(x), i) for i, x in enumerate(v)] + [("same", "q", float(x), i) for i, x in enumerate(v[:50])] + [("single", str(i), 1.0, i) for i in range(3)]
    got = {r.feature: r.mi for r in mutual_information(spark.createDataFrame(rows, "feature string, label string, v double, id int")).collect()}
    assert got["step"] == pytest.approx(math.log(2), abs=0.06) and got["none"] < 0.05 and got["same"] == 0 and got["single"] == 0
    mi = {r.feature: r.mi for r in feature_information(blobs(spark), X, "y", ["id"], noise=1).collect()}
    assert mi["x2"] > 0.2 > mi["x3"] and mi["x1"] > mi["x3"]


@pytest.mark.parametrize(("options", "weight"), [({}, "w"), ({"eps_w": math.inf}, None), ({"eps_c": 0.0, "kpp_init": False}, "w"), ({"lowering": "expr", "mi_init": False}, None)])
def test_fit_properties(spark, options, weight):
    df = blobs(spark)
    m = EspaClassifier(max_iter=6, verbosity=0, **options).fit(df, X, "y", ["id"], weight)
    p, losses = m.parameters, m.report.losses
    assert len(losses) == m.report.iterations and all(b <= a + 1e-10 for a, b in zip(losses, losses[1:]))
    assert sum(p.importances) == pytest.approx(1) and all(sum(r) == pytest.approx(1) for r in p.probabilities)
    again = EspaClassifier(max_iter=6, verbosity=0, **options).fit(df.repartition(7), X, "y", ["id"], weight).parameters
    assert np.allclose(again.centroids, p.centroids, atol=1e-9)
    out = m.predict(df).collect()
    assert all(sum(r["probabilities"]) == pytest.approx(1) for r in out)


def test_fused_step_equals_separate_steps(spark):
    df = blobs(spark)
    p = steps.Parameters(X, ["a", "b", "c"], [[0.1, 0.2, 0.0], [0.9, 0.8, 0.1], [0.2, 0.9, 0.1]], [0.5, 0.3, 0.2], [[0.6, 0.2, 0.2], [0.2, 0.6, 0.2], [0.2, 0.2, 0.6]])
    settings, w = EspaClassifier(eps_c=0.05), F.col("w") / 225.0
    total = df.agg(F.sum("w")).first()[0]
    w = F.col("w") / total
    g = steps.assign(df, p, 0.05, 90, "y", w)
    for lowering in ("arrow", "expr"):
        new, loss = settings._step(steps.statistics(df, p, "y", 0.05, 90, w, lowering), p, 90)
        wanted = {r.feature: r.w for r in steps.update_importances(g, p, w, 0.1).collect()}
        assert [wanted[f] for f in X] == pytest.approx(new.importances, abs=1e-10)
        c = {r.k: [r.x1, r.x2, r.x3] for r in steps.update_centroids(g, p, w).collect()}
        assert [c[k] for k in sorted(c)] == [pytest.approx(v, abs=1e-10) for v in new.centroids]
        assert steps.loss(g, new, "y", w, 90, 0.05, 0.1).first()[0] == pytest.approx(loss, abs=1e-10)


def test_pruned_cluster_is_gone(spark):
    df = blobs(spark)
    start = {"centroids": [[0.0, 0.0, 0.0], [1.0, 1.0, 0.0], [50.0, 50.0, 50.0]]}
    m = EspaClassifier(clusters=3, eps_c=0.0, mi_init=False, max_iter=20, verbosity=0, initial=start).fit(df, X, "y", ["id"])
    assert m.parameters.clusters == 2 == len(m.parameters.probabilities)
    blind = m.predict(df).groupBy("k").agg(F.count("*").alias("n")).orderBy("k").collect()
    assert [r.k for r in blind] == [1, 2]


def test_zero_weight_cluster_gets_zero_centroid():
    p = steps.Parameters(["a"], ["u"], [[1.0], [2.0]], [1.0], [[1.0], [1.0]])
    new, _ = EspaClassifier()._step({0: (1.0, np.array([0.5]), np.array([0.5]), np.array([3.0])), 1: (0.0, np.array([0.0]), np.array([0.0]), np.array([2.0]))}, p, 5)
    assert new.centroids == [[1.5], [0.0]]


def test_split_fit_equals_one(spark):
    df, start = blobs(spark), {"centroids": [[0.2, 0.1, 0.0], [0.6, 0.9, 0.1], [0.1, 0.7, 0.2]]}
    one = EspaClassifier(max_iter=2, tol=1e-300, unbias=False, verbosity=0, initial=start)
    whole = one.fit(df, X, "y", ["id"])
    part = EspaClassifier(max_iter=1, tol=1e-300, unbias=False, verbosity=0, initial=start)
    more = part.update(part.fit(df, X, "y", ["id"]), df, "y", ["id"], extra_iter=1)
    assert whole.report.iterations == more.report.iterations == 2
    assert more.report.losses == pytest.approx(whole.report.losses, abs=1e-10)
    assert np.allclose(more.parameters.centroids, whole.parameters.centroids, atol=1e-10)


def test_settings_and_convergence(spark):
    for bad in ({"clusters": 0}, {"eps_c": -1.0}, {"eps_w": 0.0}, {"max_iter": 0}, {"tol": 0.0}):
        with pytest.raises(ValueError):
            EspaClassifier(**bad)
    assert not converged(4, 99, 3.0, 2.5, 1e-4) and converged(7, 99, 2.0, 1.99999, 1e-4)
    assert converged(2, 2, 5, 1, 1e-9) and not converged(0, 9, 1, 1, 1)
    df = spark.createDataFrame([(1, 1.0, "a"), (2, math.nan, "b"), (3, 2.0, "b")], "id int, x double, y string")
    with pytest.raises(ValueError, match="NaN"):
        EspaClassifier().fit(df, ["x"], "y", ["id"])
    with pytest.raises(ValueError, match="clusters"):
        EspaClassifier(clusters=9).fit(df.filter("id <> 2"), ["x"], "y", ["id"])


def test_warnings_of_a_fit(spark):
    """Budgets that run out and losses that rise are told, unless the budget is one iteration or nobody listens."""
    df, start = blobs(spark), {"centroids": [[0.2, 0.1, 0.0], [0.6, 0.9, 0.1], [0.1, 0.7, 0.2]]}
    fit = lambda **o: EspaClassifier(mi_init=False, tol=1e-300, initial=start, **o).fit(df, X, "y", ["id"])
    with pytest.warns(UserWarning, match="no convergence within 2"):
        fit(max_iter=2)
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        fit(max_iter=1)
        fit(max_iter=2, verbosity=0)
    rising = iter([3.0, 2.0, 2.5])
    settings = EspaClassifier(max_iter=3)
    with pytest.MonkeyPatch.context() as patch, pytest.warns(UserWarning, match="rose from 2.0 to 2.5"):
        patch.setattr(EspaClassifier, "_step", lambda self, stats, p, rows: (p, next(rising)))
        settings._train(df, steps.Parameters(X, ["a", "b", "c"], start["centroids"], [0.3, 0.3, 0.4], [[0.4, 0.3, 0.3]] * 3), "y", None, 90, 9.0, 3, {})


def test_classes_that_occur(spark):
    m = EspaClassifier(max_iter=1, mi_init=False, verbosity=0).fit(blobs(spark).filter("y <> 'b'"), X, "y", ["id"], classes=["a", "b", "c"])
    assert m.report.classes_seen == ["a", "c"] and m.parameters.classes == ["a", "b", "c"] and all(r[1] == 0 for r in m.parameters.probabilities)


def test_model_is_saved_and_streams(spark, tmp_path):
    from entroflow.streaming.apply import predict, read

    df = blobs(spark)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        m = EspaClassifier(max_iter=3).fit(df, X, "y", ["id"])
    save_model(spark, m, str(tmp_path / "model"))
    same = load_model(spark, str(tmp_path / "model"))
    assert same.parameters == m.parameters and same.report.losses == m.report.losses
    df.write.parquet(str(tmp_path / "rows"))
    q = predict(read(spark, str(tmp_path / "rows"), df.schema), m).writeStream.format("memory").queryName("told").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("told").count() == 90
    assert m.predict(df.limit(0)).count() == 0


def test_both_assignments_agree(spark):
    """Literals and the broadcast matrix give the same clusters, with labels and weights and without, and ties go to the first."""
    df = blobs(spark, 300).withColumn("v", F.array(*X))
    for features in (X, "v"):
        p = steps.Parameters(features, ["a", "b", "c"], [[0.1, 0.2, 0.0], [0.9, 0.8, 0.1], [0.9, 0.8, 0.1]], [0.5, 0.3, 0.2], [[0.6, 0.2, 0.2], [0.2, 0.6, 0.2], [0.2, 0.2, 0.6]])
        for more in ({}, {"eps_c": 5.0, "rows": 300, "label": "y", "weight": F.col("w") / 700}):
            both = steps.assign(steps.assign(df, p, **more, lowering="expr", out="e"), p, **more, lowering="arrow", out="a")
            assert both.filter("e <> a").count() == 0 and both.select("a").distinct().count() == (3 if more else 2)


def test_large_models_predict(spark):
    """1,000 clusters of 100 features: the same clusters as brute force, also for rows that lie on centroids, two of them equal."""
    rng = np.random.default_rng(4)
    c = rng.normal(size=(1000, 100))
    c[500] = c[3]
    w = rng.uniform(size=100)
    x = np.concatenate([c[:40], rng.normal(size=(400, 100))])
    want = [int(((row - c) ** 2 @ w).argmin()) + 1 for row in x]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    probs = rng.uniform(size=(1000, 3))
    p = steps.Parameters("v", ["a", "b", "c"], c.tolist(), (w / w.sum()).tolist(), (probs / probs.sum(1, keepdims=True)).tolist())
    from entroflow.operators.classifier import Model

    got = {r.id: r for r in Model(p, EspaClassifier(), None).predict_mode(df).collect()}
    assert [got[i].k for i in range(len(x))] == want
    assert all(got[i].probabilities == pytest.approx(p.probabilities[k - 1]) and got[i].prediction == "abc"[int(np.argmax(p.probabilities[k - 1]))] for i, k in enumerate(want))


def test_wide_fit_with_many_classes(spark):
    """4,096 features, and 3,000 classes: sums are added array by array, classes found by lookup."""
    df = spark.range(40).select("id", F.transform(F.sequence(F.lit(1), F.lit(4096)), lambda j: (F.col("id") % 2) + j / 5000).alias("v"), (F.col("id") % 2).cast("string").alias("y"))
    m = EspaClassifier(clusters=2, max_iter=2, mi_init=False, verbosity=0).fit(df, "v", "y", ["id"])
    assert m.parameters.width == 4096 and m.predict_mode(df).filter("prediction <> y").count() == 0
    many = spark.range(6000).select("id", F.col("id").cast("double").alias("x"), F.pmod(F.col("id"), F.lit(3000)).alias("y"))
    m = EspaClassifier(clusters=2, max_iter=2, mi_init=False, verbosity=0).fit(many, ["x"], "y", ["id"])
    assert len(m.parameters.classes) == 3000 and m.predict(many.limit(5)).count() == 5
    with pytest.raises(ValueError, match="sums"):
        steps.statistics(many, m.parameters.change(centroids=[[0.0]] * 10_000, probabilities=m.parameters.probabilities[:1] * 10_000), "y", 0.0, 6000, None)


def test_fit_checks_its_input(spark):
    df = blobs(spark)
    fit = lambda d, x=X, w=None: EspaClassifier(max_iter=1, verbosity=0).fit(d, x, "y", ["id"], w)
    with pytest.raises(ValueError, match="numeric"):
        fit(df.withColumn("w", F.lit("1")), w="w")
    with pytest.raises(ValueError, match="null"):
        fit(df.withColumn("w", F.when(F.col("id") > 3, 1.0)), w="w")
    for odd in (math.inf, math.nan, None):
        with pytest.raises(ValueError, match="infinite"):
            fit(df.withColumn("x1", F.when(F.col("id") == 3, F.lit(odd).cast("double")).otherwise(F.col("x1"))))
        with pytest.raises(ValueError, match="infinite"):
            fit(df.withColumn("v", F.array("x1", F.when(F.col("id") == 3, F.lit(odd).cast("double")).otherwise(F.col("x2")))), "v")
    with pytest.raises(ValueError, match="arrays of"):
        fit(df.withColumn("v", F.when(F.col("id") == 3, F.array("x1")).otherwise(F.array("x1", "x2"))), "v")
    with pytest.raises(ValueError, match="outside"):
        EspaClassifier(max_iter=1).fit(df, X, "y", ["id"], classes=["a", "b"])


def test_array_and_columns_start_alike(spark):
    """The same features as columns and as an array give equal importances from mutual information, and equal fits."""
    df = blobs(spark).withColumn("v", F.array(*X))
    for name, features in (("columns", X), ("array", "v")):
        mi = {r.feature: r.mi for r in feature_information(df, features, "y", ["id"]).collect()}
        if name == "columns":
            want = [mi[x] for x in X]
    assert [mi[f"v_{n}"] for n in (1, 2, 3)] == pytest.approx(want) and want[1] > 0.2
    one, two = (EspaClassifier(max_iter=3, kpp_init=False, verbosity=0).fit(df, f, "y", ["id"]).parameters for f in (X, "v"))
    assert np.allclose(one.importances, two.importances, atol=1e-6) and np.allclose(one.centroids, two.centroids, atol=1e-6)


def test_information_of_ties_and_repeated_rows(spark):
    """Counts stand for rows: heavy ties, and rows without a key, against the pairwise form."""
    rng = np.random.default_rng(6)
    v = np.where(rng.uniform(size=300) < 0.4, 0.25, rng.integers(0, 30, 300) / 30.0)
    y = (v + rng.normal(size=300) / 5 > 0.4).astype(int)
    psi = lambda n: sum(1 / i for i in range(1, n)) - 0.5772156649015329
    total = 0.0
    for k in (1, 3, 5):
        total = 0.0
        for i in range(300):
            gaps = np.sort(np.abs(v[y == y[i]] - v[i]))[1:]
            j = min(k, len(gaps))
            r = gaps[j - 1]
            m = int((np.abs(v - v[i]) < r * (1 - 1e-11)).sum()) if r > K.EPS else int((np.abs(v - v[i]) <= K.EPS).sum())
            total += psi(j) - psi(len(gaps) + 1) - psi(max(m, 1))
        long = spark.createDataFrame([("f", int(b), float(a)) for a, b in zip(v, y)], "feature string, label int, v double")
        assert mutual_information(long, k).first().mi == pytest.approx(max(0.0, psi(300) + total / 300), abs=1e-6)


def test_seeds_beyond_a_block(spark, monkeypatch):
    """Distances written after every two seeds lead to the same seeds as those held all along."""
    from entroflow.operators import classifier

    df, p = blobs(spark), steps.Parameters(X, ["a"], [[0.0] * 3] * 7, [0.5, 0.3, 0.2], [[1.0]] * 7)
    want = EspaClassifier(clusters=7)._seeds_kpp(df, p, ["id"])
    monkeypatch.setattr(classifier, "SEEDS_HELD", 2)
    assert EspaClassifier(clusters=7)._seeds_kpp(df, p, ["id"]) == want and len({tuple(s) for s in want}) == 7


def test_stopped_fit_resumes(spark, tmp_path, monkeypatch):
    """A fit stopped in its third iteration goes on from the second and ends where an undisturbed one does."""
    df, path = blobs(spark), str(tmp_path / "state")
    settings = EspaClassifier(max_iter=5, tol=1e-300, verbosity=0)
    whole = settings.fit(df, X, "y", ["id"])
    step, calls = EspaClassifier._step, []

    def stopping(self, *args):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("the driver is gone")
        return step(self, *args)

    monkeypatch.setattr(EspaClassifier, "_step", stopping)
    with pytest.raises(RuntimeError, match="gone"):
        settings.fit(df, X, "y", ["id"], resume=path)
    more = settings.fit(df, X, "y", ["id"], resume=path)
    assert len(calls) == 3 + whole.report.iterations - 2 and more.report.losses == pytest.approx(whole.report.losses, abs=1e-12)
    assert np.allclose(more.parameters.centroids, whole.parameters.centroids, atol=1e-12)
    with pytest.raises(ValueError, match="another fit"):
        EspaClassifier(max_iter=5, eps_c=0.5, verbosity=0).fit(df, X, "y", ["id"], resume=path)


@pytest.mark.parametrize("held", [True, False])
def test_quantile_projection_and_store(spark, tmp_path, monkeypatch, held):
    """Knots in a broadcast and the search by sorting agree, saved mappings load, and the projection needs no key."""
    from entroflow.operators import scalers

    x = spark.createDataFrame([(i, float(i % 7), float(i)) for i in range(20)] + [(20, 3.0, math.nan), (21, None, 2.5)], "id int, a double, b double")
    q = QuantileTransformer((-1.0, 1.0)).fit(x, ["a", "b"])
    want = {r.id: (r.a, r.b) for r in q.transform(x, ["id"]).collect()}
    if not held:
        monkeypatch.setattr(scalers, "KNOTS_HELD", 0)
        assert not hasattr(QuantileTransformer((-1.0, 1.0)).fit(x, ["a"]).held(), "keys")
    scalers.save_scaler(spark, q, str(tmp_path / "q"))
    same = scalers.load_scaler(spark, str(tmp_path / "q"))
    out = same.transform(x, ["id"])
    assert {r.id: (r.a, r.b) for r in out.collect()} == {i: pytest.approx(v) if None not in v else v for i, v in want.items()}
    back = {r.id: (r.a, r.b) for r in same.inverse_transform(out, ["id"]).collect()}
    assert all(back[i] == pytest.approx((i % 7, i), abs=1e-9) for i in range(20)) and back[21] == (None, pytest.approx(2.5))
    if held:
        assert sorted(same.transform(x.drop("id")).collect(), key=repr) == sorted((r for r in same.transform(x, ["id"]).drop("id").collect()), key=repr)
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    else:
        for bad, match in ((x.drop("id"), "need a key"), (x.withColumn("id", F.lit(1)), "tell rows apart")):
            with pytest.raises(ValueError, match=match):
                same.transform(bad, [c for c in bad.columns if c == "id"])
    one = QuantileTransformer().fit(x.filter("id = 3"), ["a"])
    assert [r.v for r in one.inverse_long(melt(x.filter("id = 20").withColumn("a", F.lit(math.nan)), ["id"], ["a"])).collect()] == [3.0]
    mm = MinMaxScaler((0.0, 2.0)).fit(x.filter("id < 20").drop("id"), ["a", "b"])
    scalers.save_scaler(spark, mm, str(tmp_path / "m"))
    assert scalers.load_scaler(spark, str(tmp_path / "m")) == mm


def test_quantile_mapping_streams(spark, tmp_path):
    from entroflow.streaming.apply import predict, read

    df = blobs(spark).select("id", *X, "y")
    q = QuantileTransformer().fit(df, X)
    m = EspaClassifier(max_iter=2, verbosity=0).fit(q.transform(df, ["id", "y"]), X, "y", ["id"])
    df.write.parquet(str(tmp_path / "rows"))
    run = predict(read(spark, str(tmp_path / "rows"), df.schema), m, q, ("id", "y")).writeStream.format("memory").queryName("mapped").start()
    run.processAllAvailable()
    run.stop()
    want = {r.id: r.prediction for r in m.predict_mode(q.transform(df, ["id", "y"])).collect()}
    assert {r.id: r.prediction for r in spark.table("mapped").collect()} == want
