"""Small literal frames: nulls, ties, empty tables, degenerate columns, round trips."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars, vectors
from tessera.operators import blocks, frame, linalg, metrics, models, network, ordered, prep, quantiles, report, stats, timeseries, transformer, trees
from tessera.operators.pipeline import Pipeline
from tessera.sources import tables


def one(df):  # noqa: ANN001, ANN201
    return df.first()


def test_csv_rules(spark, tmp_path):  # noqa: ANN001
    path = tmp_path / "a.csv"
    path.write_text('a, b ,c,d\n1,"x",,7\n\n 2.5 ,NA,null,NaN\n3,y\n')
    got = tables.read_csv(spark, str(path))
    assert got.dtypes == [("a", "double"), ("b", "string"), ("c", "double"), ("d", "double")]
    assert sorted(got.collect(), key=lambda r: r.a) == [(1.0, "x", None, 7.0), (2.5, None, None, None), (3.0, "y", None, None)]


def test_csv_without_header_and_empty(spark, tmp_path):  # noqa: ANN001
    (tmp_path / "b.csv").write_text("1;x\n2;y\n")
    got = tables.read_csv(spark, str(tmp_path / "b.csv"), ";", header=False)
    assert got.dtypes == [("col_0", "double"), ("col_1", "string")]
    (tmp_path / "e.csv").write_text("")
    assert tables.read_csv(spark, str(tmp_path / "e.csv")).columns == []


def test_csv_written_and_saved(spark, tmp_path):  # noqa: ANN001
    df = spark.createDataFrame([(1.5, "a"), (None, None)], "x double, y string")
    tables.write_csv(df.coalesce(1), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert text.splitlines() == ["x,y", "1.500000,a", "NA,NA"]
    tables.save(df, str(tmp_path / "p"))
    assert sorted(tables.load(spark, str(tmp_path / "p")).collect(), key=str) == sorted(df.collect(), key=str)


def test_preview_and_vectors(spark):  # noqa: ANN001
    df = tables.from_vectors(spark, [[1, 2], [3]], ["a"])
    assert df.columns == ["a", "col_1"] and sorted(df.collect()) == [(1.0, 2.0), (3.0, 0.0)]
    assert "[20 rows x 1 columns]" in tables.preview(spark.range(20), ["id"], 4)


def test_drop_nulls_keeps_nan(spark):  # noqa: ANN001
    df = spark.createDataFrame([(1.0,), (None,), (math.nan,)], "x double")
    assert frame.drop_nulls(df).count() == 2
    assert frame.drop_nulls(df.limit(0)).count() == 0


def test_first_duplicate_by_order(spark):  # noqa: ANN001
    df = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (None, 2, "b"), (None, 5, "z")], "k int, o int, v string")
    assert sorted(r.v for r in frame.drop_duplicates(df, ["k"], ["o"]).collect()) == ["a", "b"]


def test_merge_nulls(spark):  # noqa: ANN001
    a, b = spark.createDataFrame([(1, 1), (None, 2)], "k int, v int"), spark.createDataFrame([(1, 5), (None, 6), (9, 7)], "k int, v int")
    assert frame.merge(a, b, "k").count() == 1
    assert frame.merge(a, b, "k", null_safe=True).columns == ["k", "v", "v_right"]
    assert frame.merge(a, b, "k", null_safe=True).count() == 2
    assert frame.merge(a, b, "k", "outer").count() == 4
    assert frame.merge(a, b, "k", "anti").count() == 1


def test_profiles_of_nothing(spark):  # noqa: ANN001
    empty = spark.createDataFrame([], "x double, s string")
    assert one(frame.null_report(empty)).null_pct == 0.0
    assert frame.describe(empty).count() == 8
    assert frame.quality_report(empty).count() == 2
    assert one(stats.summary(empty, "x"))["mean"] == 0.0


def test_running_sums(spark):  # noqa: ANN001
    rng = np.random.default_rng(3)
    rows = [(i, int(v)) for i, v in enumerate(rng.integers(-5, 9, 200))]
    df = spark.createDataFrame(rows, "k int, v int").repartition(7)
    got = {r.k: (r.s, r.n) for r in frame.running(df, [F.desc("k")], {"s": F.col("v"), "n": F.lit(1)}, 5).collect()}
    assert got == {k: (sum(v for j, v in rows if j >= k), 200 - k) for k, _ in rows}
    assert frame.running(df.limit(0), ["k"], {"s": F.col("v")}).count() == 0
    assert metrics.steps(spark.createDataFrame([], "y double, s double"), "y", "s").count() == 0


def test_running_sums_beyond_the_sample_of_ranges(spark):  # noqa: ANN001
    df = spark.range(20_000).select(((F.col("id") * 7919) % 20_000).alias("k"), F.when(F.col("id") % 5 == 0, F.col("id") % 11).alias("v"), F.col("id").cast("string").alias("carried.text"))
    rows = sorted(df.collect())
    for parts in (1, 2, 5):
        got = frame.running(df.repartition(3), ["k"], {"s": F.col("v"), "n": F.lit(1)}, parts).orderBy("k")
        assert got.columns == ["k", "v", "carried.text", "s", "n"]
        up, seen = 0, False
        for i, (r, row) in enumerate(zip(got.collect(), rows, strict=True)):
            up, seen = up + (row.v or 0), seen or row.v is not None
            assert tuple(r) == (*row, up if seen else None, i + 1)


def test_ks_normal_by_brute_force(spark):  # noqa: ANN001
    x = np.round(np.random.default_rng(5).normal(3, 2, 20_000), 3)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    values, counts = np.unique(x, return_counts=True)
    up, n = np.cumsum(counts), len(x)
    cdf = np.array([0.5 * math.erfc((x.mean() - v) / x.std(ddof=1) / math.sqrt(2)) for v in values])
    d = max(np.abs(up / n - cdf).max(), np.abs((up - counts) / n - cdf).max())
    assert one(stats.ks_normal(df, "x")).statistic == pytest.approx(d, abs=1e-6)


def test_positions_are_a_total_order(spark):  # noqa: ANN001
    df = spark.range(1000).withColumn("x", F.col("id") % 7)
    got = frame.positions(df, ["x", "id"], parts=5).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(1000)) and [(r.x, r.id) for r in got] == sorted((r.x, r.id) for r in got)


def test_ewm_batches_agree_with_fold(spark):  # noqa: ANN001
    df = spark.createDataFrame([(1, i, None if i % 3 == 0 else float(i)) for i in range(20)], "k int, t int, x double")
    a = ordered.ewm_mean(df, "x", 0.4, ["t"], ["k"]).orderBy("t").collect()
    b = ordered.ewm_mean(df, "x", 0.4, ["t"], ["k"], batches=True).orderBy("t").collect()
    assert a[0].ewm is None and [r.ewm for r in a] == [r.ewm for r in b]


def test_ewm_batches_hold_no_key_together(spark):  # noqa: ANN001
    rows = [(k, n, i, None if i is not None and i % 7 == 2 else float(((i or 0) * 13 + k) % 29)) for k in range(9) for n in ("a", None) for i in [*range(23), None]]
    df = spark.createDataFrame(rows, "k int, n string, t int, x double").repartition(3)
    with_size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
        made = ordered.ewm_mean(df, "x", 0.4, ["t"], ["k", "n"], batches=True)
        assert "FlatMapGroups" not in made._jdf.queryExecution().optimizedPlan().toString()
        got = {(r.k, r.n, r.t): r.ewm for r in made.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", with_size)
    assert len(got) == len(rows)
    y = None
    for k, n, t, x in rows:
        y = None if t == 0 else y
        y = y if x is None else x if y is None else 0.4 * x + (1 - 0.4) * y
        assert got[k, n, t] == y


def test_rolling_waits_for_a_full_window(spark):  # noqa: ANN001
    w = ordered.spec(["t"])
    df = spark.createDataFrame([(i, None if i == 1 else float(i)) for i in range(4)], "t int, x double")
    assert [r.m for r in df.select(ordered.rolling(F.col("x"), w, 2, "mean").alias("m")).collect()] == [None, 0.0, 2.0, 2.5]


def test_distributions():
    assert abs(stats.chi2_cdf(3.841459, 1) - 0.95) < 1e-6
    assert abs(stats.f_cdf(4.0, 3, 10) - 0.958610) < 1e-3
    assert abs(stats.regularized_beta(0.5, 2, 2) - 0.5) < 1e-9
    w, p = stats.shapiro_wilk(np.random.default_rng(0).normal(size=50))
    assert 0.9 < w <= 1 and p > 0.01
    assert stats.shapiro_wilk(np.random.default_rng(0).exponential(size=80))[1] < 1e-4


def test_normal_forms(spark):  # noqa: ANN001
    r = one(spark.range(1).select(scalars.normal_cdf(F.lit(1.96)).alias("c"), scalars.normal_quantile(F.lit(0.975)).alias("q"), scalars.t_cdf(F.lit(2.0), F.lit(10.0)).alias("t")))
    assert abs(r.c - 0.9750021) < 1e-6 and abs(r.q - 1.959964) < 5e-4 and abs(r.t - 0.963306) < 2e-3


def test_bootstrap_repeats(spark):  # noqa: ANN001
    df = spark.range(200).withColumn("x", F.col("id") * 1.0)
    a = stats.bootstrap_means(df, "x", "id", 20).orderBy("replicate").collect()
    assert a == stats.bootstrap_means(df.repartition(3), "x", "id", 20).orderBy("replicate").collect()
    ci = one(stats.bootstrap_interval(df, "x", "id", 50))
    assert ci.low < 99.5 < ci.high
    assert stats.bootstrap_statistic(df, "x", np.median, 5).count() == 5


def test_scalers_invert_and_spare_constants(spark):  # noqa: ANN001
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    for kind in prep.CENTERS:
        s = prep.Scaler.fit(df, ["a", "b"], kind)
        assert [r.b for r in s.transform(df).collect()] == [0.0, 0.0]
        assert sorted(s.inverse(s.transform(df)).collect()) == sorted(df.collect())


def test_resampling_counts(spark):  # noqa: ANN001
    df = spark.createDataFrame([(i, float(i), float(i % 3), int(i < 4)) for i in range(20)], "id int, a double, b double, y int")
    assert {r["y"]: r["count"] for r in prep.random_oversample(df, "y", "id").groupBy("y").count().collect()} == {0: 16, 1: 16}
    assert {r["y"]: r["count"] for r in prep.random_undersample(df, "y", "id").groupBy("y").count().collect()} == {0: 4, 1: 4}
    made = prep.smote(df, ["a", "b"], "y", "id", 2)
    assert {r["y"]: r["count"] for r in made.groupBy("y").count().collect()} == {0: 16, 1: 16}


def test_knn_impute(spark):  # noqa: ANN001
    df = spark.createDataFrame([(1, 0.0, 1.0), (2, 0.1, 3.0), (3, 9.0, 50.0), (4, 0.05, None)], "id int, a double, y double")
    assert {r.id: r.y for r in prep.impute_knn(df, "y", ["a"], "id", 2).collect()}[4] == 2.0


def test_dbscan_and_components(spark):  # noqa: ANN001
    points = [(i, [float(i % 2) * 10 + i * 0.01, 0.0]) for i in range(12)] + [(99, [500.0, 500.0])]
    df = spark.createDataFrame(points, "id int, features array<double>")
    got = {r.id: r.cluster for r in models.dbscan(df, "id", 0.5, 3).collect()}
    assert got[99] == -1 and got[0] == got[2] == 0 and got[1] == got[3] == 1
    chain = spark.createDataFrame([(i, i + 1) for i in range(30)], "a int, b int")
    assert {r.root for r in models.components(chain).collect()} == {0}


def test_kmeans_inertia_never_grows(spark):  # noqa: ANN001
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, [float(v) for v in rng.normal(i % 3 * 5, 1, 2)]) for i in range(60)], "id int, features array<double>")
    fit = models.kmeans(df, "id", 3, 10)
    assert all(a >= b - 1e-9 for a, b in zip(fit.inertia, fit.inertia[1:])) and fit.inertia[-1] < 200


def test_ols_against_numpy(spark):  # noqa: ANN001
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 2))
    y = 1 + x @ [2, -3] + rng.normal(size=50) * 0.1
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    fit = models.ols(df, ["a", "b"], "y")
    assert np.allclose(fit.weights, np.linalg.lstsq(np.column_stack([np.ones(50), x]), y, rcond=None)[0])
    assert fit.r2 > 0.99 and "r2=" in fit.summary()


def test_hierarchy_and_tsne():
    points = [[0, 0], [0, 1], [9, 9], [9, 8], [30, 0]]
    assert models.cut_dendrogram(models.agglomerative(points), 5, 3) == [0, 0, 1, 1, 2]
    assert models.tsne(points, 2, 20).shape == (5, 2)


def test_series():
    assert timeseries.fit_arima([2.0**-k for k in range(20)], 1).predict(1)[0] == pytest.approx(2.0**-20, abs=1e-4)
    assert timeseries.fit_arima([float(k) for k in range(20)], 1, 1).predict(2) == pytest.approx([20, 21], abs=0.2)
    fit = timeseries.holt_winters([10 + k % 4 for k in range(40)], 4)
    assert fit.predict(4) == pytest.approx([10, 11, 12, 13], abs=0.5)
    assert timeseries.partial_autocorrelation([1.0, 0.5, 0.25])[2] == pytest.approx(0, abs=1e-6)


def numeric_gradient(f, x, eps=1e-5):  # noqa: ANN001, ANN201
    g = np.zeros_like(x)
    for i in np.ndindex(x.shape):
        keep = x[i]
        x[i] = keep + eps
        up = f()
        x[i] = keep - eps
        g[i] = (up - f()) / (2 * eps)
        x[i] = keep
    return g


@pytest.mark.parametrize(("layer", "shape"), [(network.Dense(3, 2, "tanh"), (4, 3)), (network.Conv(2, 3, 2, 1, "sigmoid"), (2, 2, 4, 4)), (network.Conv(1, 2, 2, 2, "tanh"), (1, 1, 5, 5)), (network.Recurrent(2, 3), (2, 4, 2)), (network.LSTM(2, 3), (2, 4, 2))])
def test_layer_gradients(layer, shape):  # noqa: ANN001
    x = np.random.default_rng(0).normal(size=shape)
    w = np.random.default_rng(1).normal(size=layer.forward(x).shape)
    loss = lambda: float((layer.forward(x) * w).sum())
    layer.forward(x)
    gx = layer.backward(w.copy())
    grads = {k: v.copy() for k, v in layer.grads.items()}
    assert np.allclose(gx, numeric_gradient(loss, x), atol=1e-5)
    for k, p in layer.params.items():
        assert np.allclose(grads[k], numeric_gradient(loss, p), atol=1e-5)


def test_network_learns_and_restores(spark):  # noqa: ANN001
    x = np.array([[0, 0], [0, 1], [1, 0], [1, 1]], dtype=float)
    y = np.array([[0], [1], [1], [0]], dtype=float)
    net = network.Network([network.Dense(2, 8, "tanh", 3), network.Dense(8, 1, "sigmoid", 4)], "bce")
    losses = net.train(x, y, 300, 4, network.Adam(0.05))
    assert losses[-1] < 0.1 < losses[0]
    other = network.Network([network.Dense(2, 8, "tanh", 9), network.Dense(8, 1, "sigmoid", 9)], "bce").restore(net.table(spark))
    assert np.allclose(other.predict(x), net.predict(x))


def test_boxes():
    boxes = np.array([[0, 0, 2, 2], [0, 0, 2, 1.9], [5, 5, 6, 6]])
    assert network.non_max_suppression(boxes, np.array([0.9, 0.8, 0.7])) == [0, 2]


def test_decoder_cache_and_norm():
    m = transformer.Decoder(20, 8, 2, 2, 16)
    whole = m.forward([1, 2, 3])
    m.clear()
    steps = np.vstack([m.step([t]) for t in (1, 2, 3)])
    assert np.allclose(whole, steps)
    assert m.generate([1, 2], 4) == m.generate([1, 2], 4)
    x, g = np.random.default_rng(0).normal(size=(2, 6)), np.random.default_rng(1).normal(size=(2, 6))
    gamma, beta = np.linspace(0.5, 1.5, 6), np.zeros(6)
    assert np.allclose(transformer.layer_norm_gradient(x, gamma, g), numeric_gradient(lambda: float((transformer.layer_norm(x, gamma, beta) * g).sum()), x), atol=1e-5)


def test_tree_rows_round_trip(spark):  # noqa: ANN001
    df = spark.createDataFrame([(float(i), float(i > 5)) for i in range(10)], "x double, y double")
    model = trees.boost(df, ["x"], "y", rounds=20, rate=0.3, depth=1, penalty=0.0)
    got = df.select("y", model.raw().alias("p")).collect()
    assert all(abs(r.y - r.p) < 0.05 for r in got)
    assert trees.from_rows(model.trees[0].rows()) == model.trees[0]


def test_saved_parameters(spark, tmp_path):  # noqa: ANN001
    m = transformer.Decoder(20, 8, 2, 2, 16, seed=1)
    m.table(spark).write.parquet(str(tmp_path / "decoder"))
    saved = spark.read.parquet(str(tmp_path / "decoder"))
    other = transformer.Decoder(20, 8, 2, 2, 16, seed=2)
    assert not np.allclose(other.forward([1, 2]), m.forward([1, 2]))
    other.restore(saved, "embed")
    assert (other.params["embed"] == m.params["embed"]).all() and not (other.params["0.q"] == m.params["0.q"]).all()
    assert np.allclose(other.restore(saved).forward([1, 2]), m.forward([1, 2]))
    with pytest.raises(ValueError, match="values wanted"):
        transformer.Decoder(21, 8, 2, 2, 16).restore(saved)
    df = spark.createDataFrame([(float(i), float(i > 5)) for i in range(10)], "x double, y double")
    model = trees.boost(df, ["x"], "y", rounds=3, depth=2)
    model.table(spark).write.parquet(str(tmp_path / "trees"))
    assert trees.load_boosted(spark.read.parquet(str(tmp_path / "trees"))) == model


def test_detector(spark):  # noqa: ANN001
    fixed = network.Network([network.Flatten()])
    d = network.Detector(fixed, 2, 3, [(0.2, 0.4)])
    raw = np.full((2, 2, 1, 8), -9.0)
    raw[1, 0, 0] = [0, 0, 0, 0, 9, -9, 9, -9]
    raw[0, 1, 0] = [0, 0, np.log(2), 0, 4, 9, -9, -9]
    (a, b) = d.objects(raw.ravel())
    assert a[:4] == pytest.approx([0.15, 0.55, 0.35, 0.95]) and a[5] == 1 and a[4] > 0.99
    assert b[:4] == pytest.approx([0.55, 0.05, 0.95, 0.45]) and b[5] == 0 and 0.9 < b[4] < a[4]
    assert len(d.objects(raw.ravel(), least=0.999)) == 1 and len(d.objects(np.full(32, -9.0))) == 0
    assert d.loss(np.zeros(4), np.array([1.0, 0, 0, 1])) == 0.5
    rows = spark.createDataFrame([(1, raw.ravel().tolist())], "id int, x array<double>")
    got = d.predict_objects(rows, "x", (1, 4, 8)).first()
    assert np.allclose(got.objects, [a, b])


def test_texts_of_reports(spark):  # noqa: ANN001
    rows = spark.createDataFrame([(1.0, 0.9), (1.0, 0.2), (0.0, 0.1), (0.0, 0.8), (0.0, 0.3)], "y double, s double")
    said = report.confusion_text(metrics.rates(metrics.confusion(rows, "y", "s")))
    assert "true 1       1       1" in said and "accuracy: 0.6000" in said
    kinds = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "t int, g int")
    of = metrics.classification_report(kinds, "t", "g")
    said = report.class_report_text(of, metrics.report_means(of))
    assert said.startswith("classes\nclass") and "macro_f1: 0.6667" in said
    assert "mean: 2.0000\nspread: 1.4142" in report.folds_text(spark.createDataFrame([(0, 1.0), (1, 3.0)], "fold int, score double"))
    found = report.grid_search(spark, {"a": [1.0, 2.0, 3.0]}, lambda p: (p["a"] - 2) ** 2)
    assert "best: trial 1, score 0.0000, a=2" in report.search_text(found)
    assert "model" in report.frame_text("models", report.comparison(spark, [report.ModelReport("m", {"f1": 0.5})]))
    line = spark.createDataFrame([(float(i), float(i) + (-1) ** i, i) for i in range(20)], "y double, g double, k int")
    assert "durbin_watson: 3.8" in report.residuals_text(report.residuals(line, "y", "g", ["k"]))
    assert report.as_text("none", [], ["a"]) == "none\na\n"


def test_logistic_regression_by_numpy(spark):  # noqa: ANN001
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 2))
    y = (x[:, 0] - x[:, 1] + rng.normal(size=60) > 0).astype(float)
    w, a = np.zeros(3), np.column_stack([np.ones(60), x])
    for _ in range(8):
        w = w - 0.5 * (a.T @ (1 / (1 + np.exp(-a @ w)) - y) / 60 + 0.1 * np.array([0, *w[1:]]))
    df = spark.createDataFrame([(float(p), float(q), float(t)) for (p, q), t in zip(x, y)], "p double, q double, y double")
    got = models.logistic_regression(df, ["p", "q"], "y", 0.5, 8, 0.1)
    assert np.allclose(got, w, atol=1e-9)
    p = df.select(models.probability(["p", "q"], got).alias("p")).collect()
    assert np.allclose([r.p for r in p], 1 / (1 + np.exp(-a @ w)))


@pytest.mark.parametrize("share", [0.0, 0.5, 1.0])
def test_elastic_net_is_the_least_penalised_fit(spark, share):  # noqa: ANN001
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 2)) * [1.0, 5.0]
    y = 2 * x[:, 0] + 0.1 * x[:, 1] + rng.normal(size=80)
    df = spark.createDataFrame([(float(p), float(q), float(t)) for (p, q), t in zip(x, y)], "p double, q double, y double").coalesce(1)
    got = models.elastic_net(df, ["p", "q"], "y", 0.3, share)
    sx, sy = x.std(0), y.std()

    def cost(b: np.ndarray) -> float:  # squared error and penalty on standardised columns, as the library states them
        e = (y - y.mean()) / sy - ((x - x.mean(0)) / sx) @ b
        return float((e**2).mean() / 2 + 0.3 / sy * (share * np.abs(b).sum() + (1 - share) * (b**2).sum() / 2))

    own = np.array([float(c) for c in got.coefficients]) * sx / sy
    step = 1e-3
    assert all(cost(own) <= cost(own + step * np.array(d)) + 1e-9 for d in ((1, 0), (-1, 0), (0, 1), (0, -1)))


@pytest.mark.parametrize("blocks", [3, 1000])
def test_silhouette_by_numpy(spark, blocks):  # noqa: ANN001
    rng = np.random.default_rng(2)
    rows = [(i, i % 3 if i else 7, (rng.normal(size=4) + i % 3).tolist()) for i in range(25)]
    x, lab = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    d, out = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), []
    for i in range(25):
        same = (lab == lab[i]) & (np.arange(25) != i)
        a = d[i][same].mean() if same.any() else 0.0
        b = min(d[i][lab == k].mean() for k in set(lab) - {lab[i]})
        out.append((b - a) / (max(a, b) + 1e-10))
    df = spark.createDataFrame(rows, "id long, label int, features array<double>")
    assert models.silhouette(df, "id", "label", blocks).first()[0] == pytest.approx(np.mean(out))


def test_pipeline_round_trip(spark, tmp_path):  # noqa: ANN001
    df = spark.createDataFrame([(i, float(i), float(i * i)) for i in range(6)], "id int, a double, b double")
    p = Pipeline(["a", "b"]).add("impute", how="median").add("minmax").add("pca", parts=2)
    made = p.fit_transform(df)
    p.save(spark, str(tmp_path / "p"))
    assert Pipeline.load(spark, str(tmp_path / "p")).transform(df).collect() == made.collect()


def test_reports(spark, tmp_path):  # noqa: ANN001
    log = report.TrainingLog()
    log.add_epoch(1, 2)
    log.add_epoch(0.5, 1)
    log.save(spark, str(tmp_path / "log"))
    assert log.best == 1 and report.ModelReport("m", {"a": 1.0}).csv_row() == "m,1.000000"
    curve = report.learning_curve(spark.range(100), "id", [0.5, 1.0], lambda d: d.count())
    assert curve.orderBy("share").collect()[1].score == 100


def test_algebra(spark):  # noqa: ANN001
    assert linalg.solve([[1, 1], [1, 1]], [2, 2]) == pytest.approx([1, 1])
    assert linalg.transpose(linalg.eye(spark, 3)).count() == 3


def test_vectors(spark):  # noqa: ANN001
    a, b = vectors.literal([1, 0, 2]), vectors.literal([1, 1, 0])
    r = one(spark.range(1).select(vectors.hamming(a, b).alias("h"), vectors.mahalanobis(a, b, np.eye(3).tolist()).alias("m"), vectors.norm(a, 1).alias("n"), vectors.decode_one_hot(vectors.one_hot(F.lit(2), 4)).alias("d")))
    assert r.h == pytest.approx(2 / 3) and r.m == pytest.approx(5**0.5) and r.n == 3.0 and r.d == 2


@pytest.mark.parametrize("left", [0, 50, 200_000])
def test_quantiles_by_sorting(spark, monkeypatch, left):  # noqa: ANN001
    monkeypatch.setattr(quantiles, "LEFT", left)
    rng = np.random.default_rng(6)
    a = [float(v) for v in rng.normal(0, 1, 3000)] + [0.0, -0.0, 1e-310, -1e308, math.inf]
    b = [float(v) for v in rng.integers(-2, 3, 3000)] + [None, None, math.nan, math.inf, -math.inf]
    c = [1 + k * 2.0**-52 if k % 3 else None for k in range(3005)]
    df = spark.createDataFrame([(*t, None) for t in zip(a, b, c)], "a double, b double, c double, n double").repartition(5)
    shares = [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]
    got = quantiles.quantiles(df, {x: F.col(x) for x in "abcn"}, shares)
    for name, values in zip("abc", (a, b, c)):
        x = np.sort([v for v in values if v is not None])
        at = [s * (len(x) - 1) for s in shares]
        low, high = ([x[int(f(p))] for p in at] for f in (np.floor, np.ceil))
        assert [str(v) for v in got[name]] == [str(float(v if v == w or p == int(p) else v + (p - int(p)) * (w - v)) + 0.0) for v, w, p in zip(low, high, at)]
    assert got["n"] == [None] * 6
    assert prep.Scaler.fit(df.select("n"), ["n"], "robust").params == {"n": (0.0, 0.0)}


def test_profiles_hold_no_table_of_values(spark):  # noqa: ANN001
    df = spark.createDataFrame([(float(i), i % 3) for i in range(40)], "x double, k int")
    assert "percentile" not in frame.describe(df)._jdf.queryExecution().optimizedPlan().toString()
    got = {r.statistic: (r.x, r.k) for r in frame.describe(df).collect()}
    assert [got[s] for s in ("25%", "50%", "75%")] == [(9.75, 0.0), (19.5, 1.0), (29.25, 2.0)]


def test_layers_in_the_last_digit(spark):  # noqa: ANN001
    """Bit by bit what the C library's exp and log, sums in order and updated squares give, as SQL has them."""
    rng = np.random.default_rng(12)
    rows = [(i, rng.normal(0, 0.2, 16).tolist()) for i in range(300)] + [(300, []), (301, None), (302, [1.0, None]), (303, [800.0, 0.0])]
    df = spark.createDataFrame(rows, "k int, a array<double>")
    a = F.col("a")
    got = {r.k: r for r in df.select("k", vectors.softmax(a).alias("s"), vectors.log_softmax(a).alias("l"), vectors.layer_norm(a).alias("n")).collect()}
    for k, x in rows[:300]:
        e = [math.exp(v - max(x)) for v in x]
        s = m = q = 0.0
        for v in e:
            s += v
        for i, v in enumerate(x):
            d = v - m
            m += d / (i + 1)
            q += (v - m) * d
        mean = 0.0
        for v in x:
            mean += v
        mean, sd = mean / len(x), math.sqrt(q / len(x) + 1e-5)
        assert got[k].s == [v / s for v in e]
        assert got[k].l == [v - max(x) - math.log(s) for v in x]
        assert got[k].n == [(v - mean) / sd for v in x]
    assert (got[300].s, got[301].s, got[302].s, got[303].s) == ([], None, [None, None], [1.0, 0.0])
    assert (got[300].n, got[301].l, got[302].n, got[303].l) == ([], None, [None, None], [0.0, -800.0])


@pytest.mark.parametrize("least", [1, 3, 6])
def test_dbscan_by_brute_force(spark, least):  # noqa: ANN001
    rng = np.random.default_rng(9)
    x = np.r_[rng.normal(0, 1, (150, 3)), np.repeat(rng.normal(0, 1, (6, 3)), 8, axis=0) + rng.normal(0, 0.05, (48, 3)), np.repeat([[3.0, 3.0, 3.0]], 7, axis=0), np.linspace(4, 9, 60)[:, None] * [1, 0, 0]]
    keys = rng.permutation(len(x)).tolist()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= 0.4
    core, label = d.sum(1) >= least, {}
    order = np.argsort(keys)
    for k in order:
        if core[k] and k not in label:
            label[k], todo = len(set(label.values())), [k]
            while todo:
                for j in np.flatnonzero(d[todo.pop()] & core):
                    if j not in label:
                        label[j] = label[k]
                        todo.append(j)
    want = {keys[k]: label[k] if core[k] else min((label[j] for j in np.flatnonzero(d[k] & core)), default=-1) for k in range(len(x))}
    df = spark.createDataFrame([*zip(keys, x.tolist()), (900, None), (901, [math.nan, 0.0, 0.0]), (902, [1.0])], "id int, features array<double>")
    want |= {900: -1, 901: -1, 902: -1 if least > 1 else max(want.values()) + 1}
    got = {r.id: r.cluster for r in models.dbscan(df, "id", 0.4, least).collect()}
    assert got == want


def test_pairs_within_reach():
    x = np.random.default_rng(1).normal(0, 1, (3000, 5))
    asks = np.arange(0, 3000, 3)
    got = [p for i, j in blocks.within(x, asks, 0.5) for p in zip(i.tolist(), j.tolist())]
    d = np.sqrt(((x[asks][:, None] - x[None]) ** 2).sum(2))
    assert len(got) == len(set(got)) and set(got) == {(int(asks[i]), int(j)) for i, j in zip(*np.nonzero(d <= 0.5))}
