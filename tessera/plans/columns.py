"""Queries of column functions: scalars, text, encoders, ordered functions, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.functions import vectors as V
from tessera.operators import ordered as O
from tessera.operators import prep
from tessera.operators.ordered import spec
from tessera.plans.registry import query, table
from tessera.plans.rounding import R, r
from tessera.plans.tables import HOLES, holes

BY, ORDER = ["user_id"], ["ts", "event_id"]
W = "OVER (PARTITION BY user_id ORDER BY ts, event_id"


@query(f"SELECT event_id, coalesce(value, 0.5) AS constant, {R('coalesce(value, (SELECT avg(value) FROM events WHERE event_id % 7 <> 0))')} AS by_mean, coalesce(value, (SELECT median(value) FROM events WHERE event_id % 7 <> 0)) AS by_median FROM ({HOLES})")
def fill_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = holes(spark, sf_dir).select("event_id", "value", F.col("value").alias("a"), F.col("value").alias("b"))
    h = prep.impute(prep.impute(h, ["a"], "mean"), ["b"], "median")
    return h.select("event_id", S.fill_null(F.col("value"), 0.5).alias("constant"), r(F.col("a")).alias("by_mean"), F.col("b").alias("by_median"))


@query(
    f"SELECT o_orderkey, {R('ln(o_totalprice + 1e-10)', 1e6)} AS logged, {R('sqrt(greatest(o_totalprice, 0))', 1e6)} AS rooted, greatest(1000.0::DOUBLE, least(200000.0::DOUBLE, o_totalprice)) AS clipped, abs(o_totalprice - 100000) AS distance FROM orders"
)
def scalar_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", r(S.log_transform(p), 1e6).alias("logged"), r(S.sqrt_transform(p), 1e6).alias("rooted"), S.clip(p, 1000, 200000).alias("clipped"), F.abs(p - 100000).alias("distance")
    )


STATS = "(SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s, min(o_totalprice) AS lo, max(o_totalprice) AS hi, median(o_totalprice) AS q2, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders)"


@query(f"SELECT o_orderkey, {R('(o_totalprice - lo) / (hi - lo)', 1e6)} AS normalized, {R('(o_totalprice - m) / s', 1e6)} AS standardized, {R('(o_totalprice - q2) / (q3 - q1)', 1e6)} AS robust FROM orders, {STATS}")
def scalers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", *(F.col("o_totalprice").alias(n) for n in ("normalized", "standardized", "robust")))
    for name, kind in (("normalized", "minmax"), ("standardized", "standard"), ("robust", "robust")):
        o = prep.Scaler.fit(o, [name], kind).transform(o)
    return o.select("o_orderkey", *(r(F.col(n), 1e6).alias(n) for n in ("normalized", "standardized", "robust")))


@query(f"SELECT o_orderkey, {R('o_totalprice')} AS minmax, {R('o_totalprice')} AS standard, {R('o_totalprice')} AS robust FROM orders")
def scaler_inverses(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", *(F.col("o_totalprice").alias(n) for n in ("minmax", "standard", "robust")))
    for kind in ("minmax", "standard", "robust"):
        fitted = prep.Scaler.fit(o, [kind], kind)
        o = fitted.inverse(fitted.transform(o))
    return o.select("o_orderkey", *(r(F.col(n)).alias(n) for n in ("minmax", "standard", "robust")))


@query("SELECT doc_id, lower(text) AS low, upper(source) AS up, CAST(strlen(text) AS DOUBLE) AS bytes, CASE WHEN contains(text, 'the') THEN 1.0::DOUBLE ELSE 0.0 END AS has_the, replace(text, 'the', 'THE') AS swapped FROM documents")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.lower(t).alias("low"), F.upper("source").alias("up"), S.str_len(t).alias("bytes"), S.str_contains(t, "the").alias("has_the"), S.str_replace(t, "the", "THE").alias("swapped"))


@query("SELECT c_custkey, CAST(id AS INTEGER) AS label FROM customer JOIN (SELECT c_mktsegment AS s, row_number() OVER (ORDER BY min(c_custkey)) - 1 AS id FROM customer GROUP BY 1) ON s = c_mktsegment")
def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.label_encode(table(spark, sf_dir, "customer"), "c_mktsegment", ["c_custkey"]).select("c_custkey", "label")


@query("SELECT event_id, CAST(event_type = 'click' AS INTEGER)::DOUBLE AS event_type_click, CAST(event_type = 'error' AS INTEGER)::DOUBLE AS event_type_error, CAST(event_type = 'purchase' AS INTEGER)::DOUBLE AS event_type_purchase, CAST(event_type = 'signup' AS INTEGER)::DOUBLE AS event_type_signup, CAST(event_type = 'view' AS INTEGER)::DOUBLE AS event_type_view FROM events")
def one_hot_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.one_hot_encode(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type").drop("event_type")


ACT = "SELECT event_id, value - 50 AS x FROM events"


@query(
    f"SELECT event_id, {R('1 / (1 + exp(-x / 25))', 1e9)} AS sig, {R('1 / (1 + exp(-x / 25)) * (1 - 1 / (1 + exp(-x / 25)))', 1e9)} AS dsig, greatest(x / 25, 0) AS rel, CASE WHEN x > 0 THEN 1.0::DOUBLE ELSE 0 END AS drel, {R('tanh(x / 25)', 1e9)} AS th, {R('1 - tanh(x / 25) * tanh(x / 25)', 1e9)} AS dth, x / 25 AS lin FROM ({ACT})"
)
def activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = (F.col("value") - 50) / 25
    a, d = S.activation, S.activation_derivative
    return table(spark, sf_dir, "events").select("event_id", r(a("Sigmoid")(x), 1e9).alias("sig"), r(d("sigmoid")(x), 1e9).alias("dsig"), a("relu")(x).alias("rel"), d("RELU")(x).alias("drel"), r(a("tanh")(x), 1e9).alias("th"), r(d("tanh")(x), 1e9).alias("dth"), a("linear")(x).alias("lin"))


@query(f"SELECT event_id, last_value(value IGNORE NULLS) {W} ROWS UNBOUNDED PRECEDING) AS forward, first_value(value IGNORE NULLS) {W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS backward FROM ({HOLES})")
def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = spec(ORDER, BY)
    return holes(spark, sf_dir).select("event_id", O.fill_forward(F.col("value"), w).alias("forward"), O.fill_backward(F.col("value"), w).alias("backward"))


@query(f"SELECT event_id, value - lag(value, 1) {W}) AS d1, value - lag(value, 3) {W}) AS d3, value - lead(value, 2) {W}) AS back, (value - lag(value) {W})) / nullif(lag(value) {W}), 0) AS pct, lag(value, 2) {W}) AS s2, lead(value, 1) {W}) AS ahead FROM ({HOLES})")
def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, v = spec(ORDER, BY), F.col("value")
    return holes(spark, sf_dir).select("event_id", O.diff(v, w).alias("d1"), O.diff(v, w, 3).alias("d3"), O.diff(v, w, -2).alias("back"), O.pct_change(v, w).alias("pct"), O.shift(v, w, 2).alias("s2"), O.shift(v, w, -1).alias("ahead"))


FRAME = f"{W} ROWS UNBOUNDED PRECEDING)"


@query(f"SELECT event_id, {R(f'coalesce(sum(value) {FRAME}, 0)')} AS total, {R(f'coalesce(product(1 + value / 10000) {FRAME}, 1)', 1e9)} AS grown FROM ({HOLES})")
def cumulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = spec(ORDER, BY)
    return holes(spark, sf_dir).select("event_id", r(O.cumsum(F.col("value"), w)).alias("total"), r(O.cumprod(1 + F.col("value") / 10000, w), 1e9).alias("grown"))


LAST5 = f"{W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
FULL = f"CASE WHEN row_number() {W}) >= 5 THEN "


@query(f"SELECT event_id, {FULL}{R(f'avg(value) {LAST5}')} END AS mean, {FULL}CASE WHEN count(value) {LAST5} > 1 THEN {R(f'stddev_pop(value) {LAST5}')} END END AS std, {FULL}min(value) {LAST5} END AS low, {FULL}max(value) {LAST5} END AS high FROM ({HOLES})")
def rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, v = spec(ORDER, BY), F.col("value")
    return holes(spark, sf_dir).select("event_id", r(O.rolling(v, w, 5, "mean")).alias("mean"), r(O.rolling(v, w, 5, "std")).alias("std"), O.rolling(v, w, 5, "min").alias("low"), O.rolling(v, w, 5, "max").alias("high"))


EWM = f"""
WITH RECURSIVE n AS (SELECT event_id, user_id, value, row_number() {W}) AS k FROM ({HOLES})),
e AS (SELECT event_id, user_id, k, value AS ewm FROM n WHERE k = 1
      UNION ALL SELECT n.event_id, n.user_id, n.k, CASE WHEN n.value IS NULL THEN e.ewm WHEN e.ewm IS NULL THEN n.value ELSE 0.3::DOUBLE * n.value + 0.7::DOUBLE * e.ewm END
      FROM e JOIN n ON n.user_id = e.user_id AND n.k = e.k + 1)
SELECT event_id, {R('ewm', 1e9)} AS ewm FROM e
"""


@query(EWM)
def ewm_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = O.ewm_mean(holes(spark, sf_dir).select("event_id", "ts", "user_id", "value"), "value", 0.3, ORDER, BY)
    return got.select("event_id", r(F.col("ewm"), 1e9).alias("ewm"))


@query(EWM)
def ewm_mean_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = O.ewm_mean(holes(spark, sf_dir).select("event_id", "ts", "user_id", "value"), "value", 0.3, ORDER, BY, batches=True)
    return got.select("event_id", r(F.col("ewm"), 1e9).alias("ewm"))


@query(f"SELECT event_id, {R(f'CASE WHEN row_number() {W}) < 4 THEN value ELSE avg(value) {W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) END')} AS sma, {R(f'(lag(value, 2) {W}) + 2 * lag(value, 1) {W}) + 3 * value) / 6')} AS wma, value - lag(value, 7) {W}) AS seasonal FROM events")
def moving_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.timeseries import seasonal_difference

    w, v = spec(ORDER, BY), F.col("value")
    return table(spark, sf_dir, "events").select("event_id", r(O.simple_moving_average(v, w, 4)).alias("sma"), r(O.weighted_moving_average(v, w, [1, 2, 3])).alias("wma"), seasonal_difference(v, ORDER, 7, BY).alias("seasonal"))


@query(f"SELECT event_id, (value - lag(value, 1) {W})) - (lag(value, 1) {W}) - lag(value, 2) {W})) AS value FROM events QUALIFY row_number() {W}) > 2")
def difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.difference(table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value"), "value", ORDER, 2, by=BY).select("event_id", "value")


PAIRS = "(SELECT a.vec_id, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    a = e.select("vec_id", V.doubles("embedding").alias("a"))
    return a.join(e.select((F.col("vec_id") - 1).alias("vec_id"), V.doubles("embedding").alias("b")), "vec_id")


def each(expr: str) -> str:
    return f"list_sum(list_transform(list_zip(a, b), lambda p: {expr}))"


@query(
    f"SELECT vec_id, {R('list_distance(a, b)', 1e6)} AS euclidean, {R(each('abs(p[1] - p[2])'), 1e6)} AS manhattan, list_max(list_transform(list_zip(a, b), lambda p: abs(p[1] - p[2]))) AS chebyshev, {R('pow(' + each('pow(abs(p[1] - p[2]), 3)') + ', 1 / 3.0::DOUBLE)', 1e6)} AS minkowski, "
    f"{R('list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)) + 1e-10)', 1e6)} AS cosine, {R('list_dot_product(a, b)', 1e6)} AS dot, {R('sqrt(list_dot_product(a, a))', 1e6)} AS norm FROM {PAIRS}"
)
def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return pairs(spark, sf_dir).select("vec_id", r(V.euclidean(a, b), 1e6).alias("euclidean"), r(V.manhattan(a, b), 1e6).alias("manhattan"), V.chebyshev(a, b).alias("chebyshev"), r(V.minkowski(a, b, 3), 1e6).alias("minkowski"), r(V.cosine_similarity(a, b), 1e6).alias("cosine"), r(V.dot(a, b), 1e6).alias("dot"), r(V.norm(a), 1e6).alias("norm"))


@query(
    f"SELECT vec_id, {R(each('CASE WHEN (p[1] > 0) <> (p[2] > 0) THEN 1.0 ELSE 0.0 END') + ' / len(a)', 1e6)} AS hamming, {R('1 - ' + each('least(abs(p[1]), abs(p[2]))') + ' / (' + each('greatest(abs(p[1]), abs(p[2]))') + ' + 1e-10)', 1e6)} AS jaccard, {R('1 - list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)) + 1e-10)', 1e6)} AS cosine_distance FROM {PAIRS}"
)
def set_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    sign = lambda c: F.transform(c, lambda x: (x > 0).cast("double"))
    size = lambda c: F.transform(c, F.abs)
    return pairs(spark, sf_dir).select("vec_id", r(V.hamming(sign(a), sign(b)), 1e6).alias("hamming"), r(V.jaccard(size(a), size(b)), 1e6).alias("jaccard"), r(V.cosine_distance(a, b), 1e6).alias("cosine_distance"))


@query(
    "SELECT vec_id, list_transform(list_zip(a, b), lambda p: p[1] + p[2]) AS added, list_transform(list_zip(a, b), lambda p: p[1] * p[2]) AS multiplied, list_transform(a, lambda x: x * 2.5::DOUBLE) AS scaled FROM " + PAIRS
)
def vector_maths(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return pairs(spark, sf_dir).select("vec_id", V.add(a, b).alias("added"), V.multiply(a, b).alias("multiplied"), V.scale(a, 2.5).alias("scaled"))


SOFT = "list_transform(a, lambda x: exp(x - list_max(a)))"


@query(
    f"SELECT vec_id, list_transform({SOFT}, lambda e: {R(f'e / list_sum({SOFT})', 1e9)}) AS soft, list_transform(a, lambda x: {R(f'x - list_max(a) - ln(list_sum({SOFT}))', 1e9)}) AS log_soft, "
    f"list_transform(a, lambda x: {R('(x - list_avg(a)) / sqrt(list_var_pop(a) + 1e-5)', 1e9)}) AS normed FROM {PAIRS}"
)
def softmax_layernorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("a")
    nine = lambda c: F.transform(c, lambda x: r(x, 1e9))
    return pairs(spark, sf_dir).select("vec_id", nine(V.softmax(a)).alias("soft"), nine(V.log_softmax(a)).alias("log_soft"), nine(V.layer_norm(a)).alias("normed"))


@query("SELECT [0.0::DOUBLE, 0.25, 0.5, 0.75, 1.0] AS line, [1.0::DOUBLE, 1.5, 2.0, 2.5] AS steps, [0.0::DOUBLE, 0.0, 0.0] AS none, [1.0::DOUBLE, 1.0] AS one")
def vector_makers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select(V.linspace(0, 1, 5).alias("line"), V.arange(1, 3, 0.5).alias("steps"), V.zeros(3).alias("none"), V.ones(2).alias("one"))


@query("SELECT vec_id, label, list_transform(range(10), lambda i: CASE WHEN i = label THEN 1.0::DOUBLE ELSE 0.0 END) AS hot, label AS back FROM embeddings")
def one_hot_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", V.one_hot(F.col("label"), 10).alias("hot")).withColumn("back", V.decode_one_hot(F.col("hot")))


@query(
    f"SELECT vec_id, list_transform(range(64), lambda i: {R('CASE WHEN i % 2 = 0 THEN a[i + 1] * cos((vec_id % 16) / pow(10000.0::DOUBLE, i / 64)) - a[i + 2] * sin((vec_id % 16) / pow(10000.0::DOUBLE, i / 64)) ELSE a[i] * sin((vec_id % 16) / pow(10000.0::DOUBLE, (i - 1) / 64)) + a[i + 1] * cos((vec_id % 16) / pow(10000.0::DOUBLE, (i - 1) / 64)) END', 1e9)}) AS turned FROM {PAIRS}"
)
def rope(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = V.rope(F.col("a"), F.col("vec_id") % 16)
    return pairs(spark, sf_dir).select("vec_id", F.transform(turned, lambda x: r(x, 1e9)).alias("turned"))


DENSE = [[0.1 * (i + 1) - 0.05 * j for j in range(8)] for i in range(3)]


@query("SELECT vec_id, [" + ", ".join(f"floor(greatest({' + '.join(f'a[{j + 1}] * {w!r}::DOUBLE' for j, w in enumerate(row))} + {0.1 * i!r}::DOUBLE, 0) * 1e6 + 0.5) / 1e6" for i, row in enumerate(DENSE)) + f"] AS out FROM {PAIRS}")
def dense_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = V.dense(DENSE, [0.1 * i for i in range(3)], F.slice("a", 1, 8), "relu")
    return pairs(spark, sf_dir).select("vec_id", F.transform(out, lambda x: r(x, 1e6)).alias("out"))
