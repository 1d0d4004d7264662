"""Queries of preparation, series, models and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import models, prep, timeseries
from tessera.plans.registry import query, table
from tessera.plans.rounding import R, r, rounded


@query("SELECT c_custkey, coalesce(CAST(id AS INTEGER), -1) AS label, CASE WHEN id IS NOT NULL THEN c_mktsegment END AS back FROM customer LEFT JOIN (SELECT c_mktsegment AS s, row_number() OVER (ORDER BY min(c_custkey)) - 1 AS id FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1) ON s = c_mktsegment")
def label_encoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    ids = prep.label_ids(c.where("c_mktsegment <> 'BUILDING'"), "c_mktsegment", ["c_custkey"])
    return prep.inverse_labels(prep.transform_labels(c, "c_mktsegment", ids), "label", ids, "back").select("c_custkey", "label", "back")


@query(f"SELECT c_custkey, {R('(t + 10 * w) / (n + 10)')} AS encoded FROM customer JOIN (SELECT c_mktsegment AS s, sum(c_acctbal) AS t, count(*) AS n FROM customer GROUP BY 1) ON s = c_mktsegment, (SELECT avg(c_acctbal) AS w FROM customer)")
def target_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(prep.target_encode(table(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal", 10.0).select("c_custkey", "encoded"), "encoded")


@query('SELECT l_orderkey, l_linenumber, a, b, a * a AS "a*a", a * b AS "a*b", b * b AS "b*b", a * a * a AS "a^3", b * b * b AS "b^3" FROM (SELECT l_orderkey, l_linenumber, l_quantity AS a, l_tax AS b FROM lineitem)')
def polynomial_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("a"), F.col("l_tax").alias("b"))
    return prep.polynomial_features(rows, ["a", "b"], 3)


@query("SELECT event_id, CAST(least(floor((value - lo) / ((hi - lo + 1e-10) / 12)), 11) AS INTEGER) AS width_bin, CAST((value >= q1)::INTEGER + (value >= q2)::INTEGER + (value >= q3)::INTEGER AS INTEGER) AS quartile, CAST((value >= 10)::INTEGER + (value >= 40)::INTEGER AS INTEGER) AS own FROM events, (SELECT min(value) AS lo, max(value) AS hi, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM events)")
def bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "value")
    e = prep.equal_frequency_bins(prep.equal_width_bins(e, "value", 12, "width_bin"), "value", 4, "quartile")
    return prep.custom_bins(e, "value", [10, 40], "own").drop("value")


@query("SELECT event_id, abs((value - m) / s) > 1.5 AS z_out, value < q1 - 0.4 * (q3 - q1) OR value > q3 + 0.4 * (q3 - q1) AS iqr_out FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)")
def outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "value")
    return prep.iqr_outliers(prep.z_score_outliers(e, "value", 1.5, "z_out"), "value", 0.4, "iqr_out").drop("value")


SHUFFLED = "md5('42|' || CAST({k} AS VARCHAR))"


@query(f"SELECT o_orderkey, p >= n - floor(n * 0.2) AS is_test FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {SHUFFLED.format(k='o_orderkey')}, o_orderkey) - 1 AS p, count(*) OVER () AS n FROM orders)")
def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.train_test_split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", "is_test")


@query(f"SELECT vec_id, k > n - floor(n * 0.25) AS is_test FROM (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY {SHUFFLED.format(k='vec_id')}, vec_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM embeddings)")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.stratified_split(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", "vec_id", 0.25).select("vec_id", "is_test")


@query(f"SELECT o_orderkey, CAST(least(p // (n // 7), 6) AS INTEGER) AS fold FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {SHUFFLED.format(k='o_orderkey')}, o_orderkey) - 1 AS p, count(*) OVER () AS n FROM orders)")
def k_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.k_fold(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 7).select("o_orderkey", "fold")


@query(f"SELECT vec_id, CAST((row_number() OVER (PARTITION BY label ORDER BY {SHUFFLED.format(k='vec_id')}, vec_id) - 1) % 4 AS INTEGER) AS fold FROM embeddings")
def stratified_k_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.stratified_k_fold(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", "vec_id", 4).select("vec_id", "fold")


@query("SELECT event_id, CAST((dense_rank() OVER (ORDER BY user_id) - 1) % 5 AS INTEGER) AS fold FROM events")
def group_k_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.group_k_fold(table(spark, sf_dir, "events").select("event_id", "user_id"), "user_id").select("event_id", "fold")


@query("SELECT o_orderkey, CAST(s AS INTEGER) AS split, CASE WHEN p < (s + 1) * z THEN 'train' ELSE 'val' END AS role FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p, count(*) OVER () // 4 AS z FROM orders), (SELECT unnest(range(3)) AS s) WHERE p < (s + 1) * z OR (p >= (s + 1) * z + 10 AND p < (s + 1) * z + 10 + z)")
def time_series_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.time_series_split(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 3, 10).select("o_orderkey", "split", "role")


COUNTED = "(SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k, count(*) OVER (PARTITION BY label) AS n, (SELECT max(c) FROM (SELECT count(*) AS c FROM embeddings GROUP BY label)) AS most FROM embeddings)"


@query(f"SELECT vec_id, label, CAST(copy AS INTEGER) AS copy FROM (SELECT vec_id, label, unnest(range(most // n + (k <= most % n)::INTEGER)) AS copy FROM {COUNTED})")
def random_oversample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.random_oversample(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", "vec_id")


@query(f"SELECT vec_id, label FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY {SHUFFLED.format(k='vec_id')}, vec_id) <= (SELECT min(c) FROM (SELECT count(*) AS c FROM embeddings GROUP BY label))")
def random_undersample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.random_undersample(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", "vec_id")


def wide(spark: SparkSession, sf_dir: str, n: int = 6) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", *(F.col("embedding")[j].cast("double").alias(f"x{j}") for j in range(n)))


@query()
def smote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.smote(wide(spark, sf_dir), [f"x{j}" for j in range(4)], "label", "vec_id")


@query()
def isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.isolation_forest(wide(spark, sf_dir), ["x0", "x1", "x2"], "vec_id").select("vec_id", "anomaly")


WIDE = "(SELECT vec_id, label, " + ", ".join(f"embedding[{j + 1}]::DOUBLE AS x{j}" for j in range(6)) + " FROM embeddings)"


@query(" UNION ALL ".join(f"SELECT 'x{j}' AS feature, {R(f'((sum(n * m * m) - pow(sum(n * m), 2) / sum(n)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*)) + 1e-10)', 1e6)} AS score FROM (SELECT count(*)::DOUBLE AS n, avg(x{j}) AS m, var_pop(x{j}) AS v FROM {WIDE} GROUP BY label)" for j in range(6)))
def f_classif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(prep.f_classif(wide(spark, sf_dir), [f"x{j}" for j in range(6)], "label"), "score", scale=1e6)


@query(" UNION ALL ".join(f"SELECT 'x{j}' AS feature, {R(f'pow(corr(x{j}, x5), 2) / (1 - pow(corr(x{j}, x5), 2) + 1e-10) * (count(*) - 2)', 1e6)} AS score FROM {WIDE}" for j in range(5)) + " ORDER BY score DESC LIMIT 3")
def f_regression_k_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.select_k_best(rounded(prep.f_regression(wide(spark, sf_dir), [f"x{j}" for j in range(5)], "x5"), "score", scale=1e6), 3)


@query(
    " UNION ALL ".join(
        f"SELECT 'x{j}' AS feature, {R('sum(p * log2(p / (x * y)))', 1e6)} AS score FROM (SELECT n / CAST(sum(n) OVER () AS DOUBLE) AS p, sum(n) OVER (PARTITION BY b) / CAST(sum(n) OVER () AS DOUBLE) AS x, sum(n) OVER (PARTITION BY label) / CAST(sum(n) OVER () AS DOUBLE) AS y FROM (SELECT least(floor((x{j} - lo) / ((hi - lo + 1e-10) / 5)), 4) AS b, label, count(*) AS n FROM {WIDE}, (SELECT min(x{j}) AS lo, max(x{j}) AS hi FROM {WIDE}) GROUP BY ALL))"
        for j in range(2)
    )
)
def mutual_info_classif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(prep.mutual_info_classif(wide(spark, sf_dir), ["x0", "x1"], "label", 5), "score", scale=1e6)


@query(f"SELECT feature, variance FROM (UNPIVOT (SELECT " + ", ".join(f"{R(f'var_samp(x{j})', 1e6)} AS x{j}" for j in range(6)) + f" FROM {WIDE}) ON x0, x1, x2, x3, x4, x5 INTO NAME feature VALUE variance) WHERE variance > 0.01")  # noqa: F541
def variance_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = wide(spark, sf_dir)
    kept = prep.variance_threshold(w, [f"x{j}" for j in range(6)], 0.01)
    return rounded(w.agg(*(F.var_samp(c).alias(c) for c in kept)).unpivot([], kept, "feature", "variance"), "variance", scale=1e6)


@query("SELECT unnest(['l_quantity', 'l_discount', 'l_tax']) AS kept")
def remove_correlated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("double_quantity", F.col("l_quantity") * 2)
    kept = prep.remove_correlated(rows, ["l_quantity", "double_quantity", "l_discount", "l_tax"], 0.95)
    return spark.range(1).select(F.explode(F.array(*map(F.lit, kept))).alias("kept"))


DAILY = "(SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, sum(value) AS x FROM events GROUP BY 1)"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.floor(F.unix_timestamp("ts") / 86400).alias("day")).agg(F.sum("value").alias("x"))


LAGS = ", ".join(f"{{'lag': {k}, 'acf': " + (f"sum(d * l{k}) / sum(d * d)" if k else "1.0::DOUBLE") + "}" for k in range(6))


@query(f"SELECT CAST(a.lag AS INTEGER) AS lag, {R('a.acf', 1e6)} AS acf FROM (SELECT unnest([{LAGS}]) AS a FROM (SELECT d, " + ", ".join(f"lag(d, {k}) OVER (ORDER BY day) AS l{k}" for k in range(1, 6)) + f" FROM (SELECT day, x - avg(x) OVER () AS d FROM {DAILY})))")
def autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(timeseries.autocorrelation(daily(spark, sf_dir), "x", ["day"], 5), "acf", scale=1e6)


@query()
def partial_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    acf = [x["acf"] for x in timeseries.autocorrelation(daily(spark, sf_dir), "x", ["day"], 5).orderBy("lag").collect()]
    return spark.createDataFrame(list(enumerate(timeseries.partial_autocorrelation(acf))), "lag int, pacf double")


TREND = f"SELECT day, x, i, CASE WHEN i < 6 THEN x ELSE avg(x) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) END AS trend FROM (SELECT *, row_number() OVER (ORDER BY day) - 1 AS i FROM {DAILY})"


@query(f"SELECT day, {R('trend')} AS trend, {R('s')} AS seasonal, {R('x - trend - s')} AS residual FROM (SELECT *, avg(x - trend) OVER (PARTITION BY i % 7) AS s FROM ({TREND}))")
def seasonal_decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = timeseries.seasonal_decompose(daily(spark, sf_dir), "x", ["day"], 7)
    return rounded(got.select("day", "trend", "seasonal", "residual"), "trend", "seasonal", "residual")


@query(
    f"SELECT user_id, i, {R('score', 1e2)} AS score FROM (SELECT user_id, i, s * s / i + (t - s) * (t - s) / (n - i) - t * t / n AS score, n FROM (SELECT user_id, row_number() OVER w - 1 AS i, sum(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s, sum(value) OVER (PARTITION BY user_id) AS t, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) WHERE i >= 5 AND i < n - 5 AND score > 1"
)
def change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = timeseries.change_points(table(spark, sf_dir, "events"), "value", ["ts", "event_id"], 5, 0.0, ["user_id"])
    return rounded(got.where("score > 1").select("user_id", F.col("i").cast("bigint").alias("i"), "score"), "score", scale=1e2)


@query(
    f"""WITH n AS (SELECT user_id, event_id, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, avg(value) OVER (PARTITION BY user_id) AS m FROM events),
    c AS (SELECT *, lag(x - m, 1) OVER (PARTITION BY user_id ORDER BY k) AS d1, coalesce((x > m) <> lag(x > m) OVER (PARTITION BY user_id ORDER BY k), FALSE) AS c FROM n),
    g AS (SELECT *, sum(c::INTEGER) OVER (PARTITION BY user_id ORDER BY k) AS g FROM c),
    l AS (SELECT user_id, max(z) AS longest FROM (SELECT user_id, g, count(*) AS z FROM g WHERE x > m GROUP BY ALL) GROUP BY 1)
    SELECT user_id, {R('avg(x)')} AS mean, {R('stddev_samp(x)')} AS std, {R('sum((x - m) * d1) / sum((x - m) * (x - m))')} AS acf1, CAST(sum(c::INTEGER) AS BIGINT) AS crossings, any_value(longest) AS longest_run FROM g JOIN l USING (user_id) GROUP BY user_id"""
)
def series_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = timeseries.features(table(spark, sf_dir, "events"), "value", ["ts", "event_id"], ["user_id"])
    return rounded(got.select("user_id", "mean", "std", "acf1", F.col("crossings").cast("bigint").alias("crossings"), "longest_run"), "mean", "std", "acf1")


@query(f"SELECT {R('b / sqrt((yy - xy * xy / xx) / (n - 2) / xx)')} AS statistic FROM (SELECT regr_slope(x - l, l) AS b, regr_syy(x - l, l) AS yy, regr_sxx(x - l, l) AS xx, regr_sxy(x - l, l) AS xy, count(l) AS n FROM (SELECT x, lag(x) OVER (ORDER BY day) AS l FROM {DAILY}))")
def adf_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(timeseries.adf_statistic(daily(spark, sf_dir), "x", ["day"]).select("statistic"), "statistic")


@query()
def holt_winters_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fit = timeseries.holt_winters(pdf.sort_values(["ts", "event_id"])["value"], 7)
        return pd.DataFrame({"user_id": pdf["user_id"].iloc[0], "step": range(3), "forecast": fit.predict(3)})

    return models.by_key(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"), "user_id", run, "user_id bigint, step int, forecast double")


@query()
def arima_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fit = timeseries.fit_arima(pdf.sort_values(["ts", "event_id"])["value"], 1, 0, 1)
        return pd.DataFrame({"user_id": pdf["user_id"].iloc[0], "step": range(3), "forecast": fit.predict(3)})

    return models.by_key(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"), "user_id", run, "user_id bigint, step int, forecast double")


@query(f"SELECT {R('regr_intercept(l_extendedprice, l_quantity)')} AS intercept, {R('regr_slope(l_extendedprice, l_quantity)')} AS slope, {R('regr_r2(l_extendedprice, l_quantity)', 1e6)} AS r2, {R('sqrt((regr_syy(l_extendedprice, l_quantity) - pow(regr_sxy(l_extendedprice, l_quantity), 2) / regr_sxx(l_extendedprice, l_quantity)) / (count(*) - 2) / regr_sxx(l_extendedprice, l_quantity))')} AS slope_error FROM lineitem")
def ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = models.ols(table(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice")
    made = spark.createDataFrame([(float(fit.weights[0]), float(fit.weights[1]), fit.r2, float(fit.std_errors[1]))], "intercept double, slope double, r2 double, slope_error double")
    return rounded(rounded(made, "intercept", "slope", "slope_error"), "r2", scale=1e6)


@query()
def elastic_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").repartition(4)
    out = [(f"l1={share}", float(fit.intercept), [float(c) for c in fit.coefficients]) for share in (0.0, 0.5, 1.0) for fit in [models.elastic_net(rows, ["l_quantity", "l_discount"], "l_extendedprice", 0.1, share)]]
    return spark.createDataFrame(out, "model string, intercept double, weights array<double>")


@query()
def logistic_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = wide(spark, sf_dir).withColumn("y", (F.col("label") < 5).cast("double")).cache()
    weights = models.logistic_regression(w, ["x0", "x1"], "y", 0.5, 10)
    return w.select("vec_id", models.probability(["x0", "x1"], weights).alias("p"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", V.doubles("embedding").alias("features"))


NEAR = "(SELECT q.vec_id AS q, b.vec_id AS b, b.label AS label, list_distance(q.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS k FROM embeddings q JOIN embeddings b ON q.vec_id % 20 = 0)"


def asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Queries (ids divisible by 20) and all rows as their base, the query row itself among them."""
    v = vectors(spark, sf_dir)
    return v.where("vec_id % 20 = 0"), v.select(F.col("vec_id").alias("near_id"), "features", "label")


@query(f"SELECT q AS vec_id, b AS near_id, {R('d', 1e6)} AS distance FROM {NEAR} WHERE k <= 5")
def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, base = asked(spark, sf_dir)
    got = models.nearest(q.select("vec_id", "features"), base.drop("label"), "vec_id", "near_id", 5)
    return rounded(got.select("vec_id", "near_id", "distance"), "distance", scale=1e6)


@query(f"SELECT vec_id, label AS predicted FROM (SELECT q AS vec_id, label, row_number() OVER (PARTITION BY q ORDER BY count(*) DESC, label) AS r FROM {NEAR} WHERE k <= 5 GROUP BY q, label) WHERE r = 1")
def knn_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.knn_class(*asked(spark, sf_dir), "vec_id", "near_id", "label")


@query(f"SELECT q AS vec_id, {R('avg(label)', 1e6)} AS predicted FROM {NEAR} WHERE k <= 5 GROUP BY q")
def knn_regress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.knn_regress(*asked(spark, sf_dir), "vec_id", "near_id", "label"), "predicted", scale=1e6)


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, {R('list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])', 1e6)} AS distance FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id")
def pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.pairwise(vectors(spark, sf_dir), "vec_id"), "distance", scale=1e6)


@query(
    f"""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
    m AS (SELECT a.vec_id, a.label AS own, b.label AS other, avg(list_distance(a.v, b.v)) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY ALL),
    s AS (SELECT vec_id, coalesce(max(d) FILTER (WHERE own = other), 0) AS a, min(d) FILTER (WHERE own <> other) AS b FROM m GROUP BY 1)
    SELECT {R('avg((b - a) / (greatest(a, b) + 1e-10))', 1e6)} AS silhouette FROM s"""
)
def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.silhouette(vectors(spark, sf_dir), "vec_id", "label"), "silhouette", scale=1e6)


COORDS = "(SELECT vec_id, label, unnest(range(64)) AS j, unnest(embedding::DOUBLE[]) AS x FROM embeddings)"
CENTERS = f"(SELECT label, j, avg(x) AS c, count(*) AS n FROM {COORDS} GROUP BY label, j)"


@query(
    f"""WITH v AS MATERIALIZED {COORDS}, c AS MATERIALIZED {CENTERS},
    d AS (SELECT vec_id, v.label, sum((x - c) * (x - c)) AS q FROM v JOIN c ON v.label = c.label AND v.j = c.j GROUP BY ALL),
    s AS (SELECT label, avg(sqrt(q)) AS s, count(*) AS n, sum(q) AS w FROM d GROUP BY label),
    m AS (SELECT a.label AS a, b.label AS b, sqrt(sum((a.c - b.c) * (a.c - b.c))) AS m FROM c a JOIN c b ON a.j = b.j AND a.label <> b.label GROUP BY ALL),
    o AS (SELECT j, avg(x) AS o FROM v GROUP BY j),
    between_ AS (SELECT sum(n * (c - o) * (c - o)) AS b FROM c JOIN o ON c.j = o.j)
    SELECT (SELECT {R('avg(r)', 1e6)} FROM (SELECT max((x.s + y.s) / (m + 1e-10)) AS r FROM m JOIN s x ON x.label = m.a JOIN s y ON y.label = m.b GROUP BY m.a)) AS davies_bouldin,
           (SELECT {R('(SELECT b FROM between_) / (count(*) - 1) / (sum(w) / (sum(n) - count(*)))', 1e6)} FROM s) AS calinski_harabasz"""
)
def cluster_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).cache()
    return rounded(spark.createDataFrame([(models.davies_bouldin(v, "label", 64), models.calinski_harabasz(v, "label", 64))], "davies_bouldin double, calinski_harabasz double"), "davies_bouldin", "calinski_harabasz", scale=1e6)


NB = f"(SELECT label, ln(count(*) / (SELECT count(*) FROM embeddings)::DOUBLE) AS prior, " + ", ".join(f"avg(x{j}) AS m{j}, var_pop(x{j}) + 1e-9 AS v{j}" for j in range(6)) + f" FROM {WIDE} GROUP BY label)"  # noqa: F541
LIKE = "c.prior - (" + " + ".join(f"(ln(c.v{j} * 6.2832::DOUBLE) + (w.x{j} - c.m{j}) * (w.x{j} - c.m{j}) / c.v{j})" for j in range(6)) + ") / 2"


LIKES = f"(SELECT *, max(l) OVER (PARTITION BY vec_id) AS m FROM (SELECT w.vec_id, c.label, {LIKE} AS l FROM {WIDE} w, {NB} c))"


@query(f"SELECT vec_id, max_by(label, l) AS predicted, {R('1 / sum(exp(l - m))', 1e6)} AS posterior FROM {LIKES} GROUP BY vec_id")
def gaussian_nb(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = wide(spark, sf_dir).select("vec_id", "label", F.array(*(f"x{j}" for j in range(6))).alias("features"))
    got = models.gaussian_nb_predict(w, models.gaussian_nb_fit(w, "label", 6), "vec_id", "label")
    return rounded(got, "posterior", scale=1e6)


FIRST3 = "(SELECT vec_id, embedding::DOUBLE[] AS c, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM embeddings WHERE vec_id < 3)"


@query(f"SELECT CAST(cluster AS INTEGER) AS cluster, count(*) AS n, {R('sum(d * d)', 1e6)} AS inertia FROM (SELECT e.vec_id, min_by(f.k, list_distance(e.embedding::DOUBLE[], f.c)) AS cluster, min(list_distance(e.embedding::DOUBLE[], f.c)) AS d FROM embeddings e, {FIRST3} f GROUP BY e.vec_id) GROUP BY cluster")
def kmeans_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    import numpy as np

    v = vectors(spark, sf_dir)
    first = v.where("vec_id < 3").orderBy("vec_id").collect()
    got = models.kmeans_step(v, models.KMeans(np.array([x["features"] for x in first])))
    return rounded(got.select("cluster", "n", "inertia"), "inertia", scale=1e6)


@query()
def kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).cache()
    fit = models.kmeans(v, "vec_id", 5, steps=10)
    return v.select("vec_id", fit.assign(F.col("features")).alias("cluster"))


@query()
def dbscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.dbscan(vectors(spark, sf_dir).select("vec_id", "features"), "vec_id", 0.02, 4)


@query(f"SELECT {R('sum(v)', 1e6)} AS total_variance FROM (SELECT unnest([" + ", ".join(f"var_samp(x{j})" for j in range(6)) + f"]) AS v FROM {WIDE})")
def pca_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = wide(spark, sf_dir).select("vec_id", F.array(*(f"x{j}" for j in range(6))).alias("features"))
    fit = models.pca(w, 6, 6)
    return spark.range(1).select(r(F.lit(float(fit.variance.sum())), 1e6).alias("total_variance"))


@query(f"SELECT vec_id, [{', '.join(R(f'x{j}', 1e6) for j in range(6))}] AS back FROM {WIDE}")
def pca_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = wide(spark, sf_dir).select("vec_id", F.array(*(f"x{j}" for j in range(6))).alias("features"))
    fit = models.pca(w, 6, 6)
    back = fit.inverse(fit.transform(F.col("features")))
    return w.select("vec_id", F.transform(back, lambda x: r(x, 1e6)).alias("back"))
