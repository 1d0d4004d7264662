"""Queries of text, algebra, trees, networks, attention, reports, pipelines and streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import linalg, metrics, models, prep, report, text, trees, transformer
from tessera.operators.pipeline import Pipeline
from tessera.plans.learning import DAILY, WIDE, vectors, wide
from tessera.plans.registry import query, table
from tessera.plans.rounding import R, r, rounded
from tessera.streaming import events as streams

WORDS = "(SELECT doc_id, list_filter(regexp_split_to_array(trim(regexp_replace(lower(text), '[[:punct:]]', '', 'g')), '\\s+'), lambda w: w <> '') AS w FROM documents)"


@query(f"SELECT doc_id, len(w) AS n_tokens, md5(list_aggregate(w, 'string_agg', ' ')) AS joined FROM {WORDS}")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("w"))
    joined = F.when(F.size("w") > 0, F.md5(F.array_join("w", " ")))
    return t.select("doc_id", F.size("w").cast("bigint").alias("n_tokens"), joined.alias("joined"))


VOCAB = f"(SELECT token, df, row_number() OVER (ORDER BY df DESC, token DESC) + 1 AS id FROM (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS token FROM {WORDS}) GROUP BY token))"


@query(f"SELECT token, df, CAST(id AS INTEGER) AS id FROM {VOCAB} WHERE id <= 2001")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.vocabulary(table(spark, sf_dir, "documents"), "doc_id", "text", 2000)


@query(
    f"SELECT doc_id, list(coalesce(CASE WHEN k <= len(w) THEN coalesce(id, 1) END, 0) ORDER BY k)::INTEGER[] AS ids FROM (SELECT doc_id, w, unnest(range(1, 33)) AS k FROM {WORDS}) LEFT JOIN (SELECT * FROM {VOCAB} WHERE id <= 2001) ON token = w[k] GROUP BY doc_id"
)
def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return text.sequences(docs, "doc_id", "text", text.vocabulary(docs, "doc_id", "text", 2000), 32)


BAG = f"(SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(w) AS token FROM {WORDS}) GROUP BY ALL)"


@query(f"SELECT doc_id, token, n FROM {BAG}")
def bag_of_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.bag_of_words(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"SELECT doc_id, token, {R('n / CAST(s AS DOUBLE) * ln((SELECT count(*) FROM documents)::DOUBLE / df)', 1e9)} AS weight FROM (SELECT doc_id, token, n, sum(n) OVER (PARTITION BY doc_id) AS s, count(*) OVER (PARTITION BY token) AS df FROM {BAG})")
def tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(text.tfidf(table(spark, sf_dir, "documents"), "doc_id", "text"), "weight", scale=1e9)


CELLS = "(SELECT vec_id AS i, unnest(range(8)) AS j, unnest(embedding[1:8])::DOUBLE AS v FROM embeddings)"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linalg.cells(vectors(spark, sf_dir).withColumn("features", F.slice("features", 1, 8)), "vec_id", "features")


@query(f"SELECT a.j AS i, b.j AS j, {R('sum(a.v * b.v)', 1e6)} AS v FROM {CELLS} a JOIN {CELLS} b USING (i) GROUP BY a.j, b.j".replace("USING (i)", "ON a.i = b.i"))
def matmul(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    return rounded(linalg.matmul(linalg.transpose(c), c), "v", scale=1e6)


@query(f"SELECT i, {R('sum(v * (j + 1))', 1e6)} AS v FROM {CELLS} GROUP BY i")
def matvec(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spark.range(8).select(F.col("id").alias("j"), (F.col("id") + 1.0).alias("v"))
    return rounded(linalg.matvec(cells(spark, sf_dir), x), "v", scale=1e6)


@query("SELECT i, i AS j, CASE WHEN i < 3 THEN 2.0::DOUBLE ELSE 1.0 END AS v FROM range(5) t(i)")
def matrix_add_eye(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linalg.matrix_add(linalg.eye(spark, 5), linalg.eye(spark, 3))


@query("SELECT 5.0::DOUBLE AS determinant, 1.0::DOUBLE AS x0, 2.0::DOUBLE AS x1, 0.6::DOUBLE AS inverse00, 3.618034::DOUBLE AS top_eigen, 1.0::DOUBLE AS rebuilt")
def small_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    import numpy as np

    a = [[2.0, 1.0], [1.0, 3.0]]
    p, low, up = linalg.lu(a)
    u, s, v = linalg.svd(a)
    rebuilt = np.allclose(p.T @ low @ up, a) and np.allclose(u @ np.diag(s) @ v.T, a)
    x = linalg.solve(a, [4.0, 7.0])
    row = (linalg.determinant(a), float(x[0]), float(x[1]), float(linalg.inverse(a)[0][0]), float(linalg.eigen(a)[0][0]), float(rebuilt))
    got = spark.createDataFrame([row], "determinant double, x0 double, x1 double, inverse00 double, top_eigen double, rebuilt double")
    return got.select(*(r(F.col(c), 1e6).alias(c) for c in got.columns))


@query()
def random_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linalg.random_normal(spark, 100, 1.0, 2.0, 3).join(linalg.random_uniform(spark, 100, -1, 1, 3).withColumnRenamed("x", "u"), "id")


GRAD = "(SELECT *, 2 * (0.5 - label) AS g, 2.0::DOUBLE AS h FROM " + WIDE + ")"
SPLITS = " UNION ALL ".join(
    f"SELECT 'x{j}' AS feature, (x + nx) / 2 AS threshold, gl * gl / (hl + 1) + (ga - gl) * (ga - gl) / (ha - hl + 1) - ga * ga / (ha + 1) AS gain FROM (SELECT x{j} AS x, lead(x{j}) OVER w AS nx, sum(g) OVER (w ROWS UNBOUNDED PRECEDING) AS gl, sum(h) OVER (w ROWS UNBOUNDED PRECEDING) AS hl, sum(g) OVER () AS ga, sum(h) OVER () AS ha FROM {GRAD} WINDOW w AS (ORDER BY x{j}, vec_id)) WHERE nx > x"
    for j in range(3)
)


@query(f"SELECT feature, {R('threshold', 1e6)} AS threshold, {R('gain')} AS gain FROM ({SPLITS}) ORDER BY gain DESC, feature, threshold LIMIT 1")
def tree_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = wide(spark, sf_dir).withColumns({"g": 2 * (0.5 - F.col("label")), "h": F.lit(2.0)})
    return rounded(rounded(trees.best_split(w, ["x0", "x1", "x2"], "g", "h"), "gain"), "threshold", scale=1e6)


@query()
def boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = wide(spark, sf_dir).withColumn("y", (F.col("label") < 5).cast("double")).cache()
    model = trees.boost(w, [f"x{j}" for j in range(4)], "y", rounds=4, rate=0.3, depth=2)
    return w.select("vec_id", "y", model.raw().alias("score"))


ATT = "(SELECT vec_id // 10 AS s, vec_id % 10 AS p, embedding[1:4]::DOUBLE[] AS v FROM embeddings)"
SCORES = f"(SELECT q.s, q.p, k.v, exp(list_dot_product(q.v, k.v) / 2) AS e FROM {ATT} q JOIN {ATT} k ON q.s = k.s AND k.p <= q.p)"


@query(f"SELECT s, p, [{', '.join(R(f'sum(e * v[{c}]) / sum(e)', 1e9) for c in range(1, 5))}] AS out FROM {SCORES} GROUP BY s, p")
def attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("s"), (F.col("vec_id") % 10).alias("p"), V.doubles(F.slice("embedding", 1, 4)).alias("q"))
    got = transformer.attention(v.withColumns({"k": F.col("q"), "v": F.col("q")}), ["s"], "p", 4)
    return got.select("s", "p", F.transform("out", lambda x: r(x, 1e9)).alias("out"))


@query('SELECT doc_id, k AS "at", vector FROM (SELECT doc_id, unnest(range(5)) AS k FROM documents) JOIN (SELECT vec_id, embedding AS vector FROM embeddings) ON vec_id = (doc_id * 7 + k) % (SELECT max(vec_id) + 1 FROM embeddings)')
def embedding_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("token"), F.col("embedding").alias("vector"))
    n = F.broadcast(weights.agg((F.max("token") + 1).alias("n")))
    docs = table(spark, sf_dir, "documents").join(n).select("doc_id", F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.pmod(F.col("doc_id") * 7 + k, F.col("n"))).alias("ids"))
    return transformer.embed(docs, weights, "doc_id", "ids").select("doc_id", F.col("at").cast("bigint").alias("at"), "vector")


@query()
def decoder_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = transformer.Decoder(50, 16, 2, 4, 32, seed=1)
    prompts = table(spark, sf_dir, "documents").select("doc_id", F.array((F.col("doc_id") % 49 + 1).cast("int"), F.lit(3)).alias("prompt"))
    return transformer.generate(prompts, model, "prompt", 5)


@query()
def network_train_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    import numpy as np

    from tessera.operators.network import Adam, Dense, Network

    rows = vectors(spark, sf_dir).orderBy("vec_id").limit(200).collect()
    x, y = np.array([v["features"] for v in rows]), np.array([[float(v["label"] < 5)] for v in rows])
    net = Network([Dense(64, 8, "tanh", 1), Dense(8, 1, "sigmoid", 2)], "bce")
    net.train(x, y, epochs=5, batch=10, adam=Adam(0.01))
    return net.score(vectors(spark, sf_dir)).select("vec_id", "prediction")


@query()
def lstm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.network import LSTM, Dense, Last, Network

    net = Network([LSTM(8, 6, 1), Last(), Dense(6, 1, "sigmoid", 2)], "bce")
    return net.score(vectors(spark, sf_dir), shape=(8, 8)).select("vec_id", "prediction")


#: Bound of the example's training rows: documents of the labels, lowest by a hash.
EXAMPLE_ROWS = 400


@query()
def language_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled texts end to end: vocabulary over all documents, sequences, a split in 80 and 20, a
    recurrent network trained on a bounded part of the larger one, and a score for every document."""
    import numpy as np

    from tessera.operators.network import LSTM, Dense, Last, Network

    docs, length, width = table(spark, sf_dir, "documents").select("doc_id", "text"), 24, 8
    vocab = text.vocabulary(docs, "doc_id", "text", 2000)
    ids = text.sequences(docs, "doc_id", "text", vocab, length)
    embedding = np.random.default_rng(4).normal(0, 0.5, (2002, width))
    train = ids.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").where(F.pmod(F.xxhash64("doc_id"), F.lit(5)) != 0)
    rows = train.orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id").limit(EXAMPLE_ROWS).collect()
    net = Network([LSTM(width, 6, 1), Last(), Dense(6, 1, "sigmoid", 2)], "bce")
    if rows:
        net.train(embedding[np.array([r["ids"] for r in rows])], np.array([[float(r["quality"])] for r in rows]), epochs=3, batch=16)
    held = spark.sparkContext.broadcast((net, embedding))

    @F.pandas_udf("double")
    def scored(batch: pd.Series) -> pd.Series:
        model, table_ = held.value
        return pd.Series(model.predict(table_[np.stack(batch.to_list())]).ravel() if len(batch) else [], dtype="float64")

    got = ids.select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("held_out"), scored("ids").alias("score"))
    return got.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query()
def cnn_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.network import Conv, Dense, Flatten, Network

    net = Network([Conv(1, 2, 3, 1, "relu", 1), Flatten(), Dense(72, 2, "linear", 2)])
    return net.score(vectors(spark, sf_dir), shape=(1, 8, 8)).select("vec_id", "prediction")


@query(f"SELECT vec_id, {R('(x0 - m0) / s0', 1e6)} AS x0, {R('(x1 - m1) / s1', 1e6)} AS x1, {R('(x0 - m0) / s0 * ((x0 - m0) / s0)', 1e6)} AS \"x0*x0\", {R('(x0 - m0) / s0 * ((x1 - m1) / s1)', 1e6)} AS \"x0*x1\", {R('(x1 - m1) / s1 * ((x1 - m1) / s1)', 1e6)} AS \"x1*x1\" FROM {WIDE}, (SELECT avg(x0) AS m0, stddev_samp(x0) AS s0, avg(x1) AS m1, stddev_samp(x1) AS s1 FROM {WIDE})")
def pipeline_scale_poly(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pipeline(["x0", "x1"]).add("impute", how="mean").add("standard").add("poly", degree=2)
    got = p.fit_transform(wide(spark, sf_dir).select("vec_id", "x0", "x1"))
    return got.select("vec_id", *(r(F.col(f"`{c}`"), 1e6).alias(c) for c in got.columns if c != "vec_id"))


@query()
def pipeline_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pipeline([f"x{j}" for j in range(6)]).add("robust").add("pca", parts=2)
    return p.fit_transform(wide(spark, sf_dir).drop("label"))


@query()
def random_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.random_search(spark, [report.Range("a", -2, 2), report.Range("b", 1, 9, True)], lambda p: (p["a"] - 1) ** 2 + p["b"], 15).select("trial", "params", "score")


@query("SELECT a, b, CAST((a - 1) * (a - 1) + b AS DOUBLE) AS score FROM (SELECT unnest([0.0::DOUBLE, 1.0, 2.0]) AS a), (SELECT unnest([3.0::DOUBLE, 5.0]) AS b)")
def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = report.grid_search(spark, {"a": [0, 1, 2], "b": [3, 5]}, lambda p: (p["a"] - 1) ** 2 + p["b"])
    return got.select(F.col("params")["a"].alias("a"), F.col("params")["b"].alias("b"), "score")


@query()
def bayesian_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.bayesian_search(spark, [report.Range("a", -2, 2)], lambda p: (p["a"] - 1) ** 2, 12).select("trial", "params", "score")


@query()
def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("key", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"))
    fit = models.ols(rows, ["l_quantity", "l_discount"], "l_extendedprice")
    return report.permutation_importance(rows, ["l_quantity", "l_discount"], "key", fit.predict, lambda p: -F.avg(F.abs(p - F.col("l_extendedprice"))), 1)


@query(
    f"SELECT {R('avg(e)')} AS mean, {R('stddev_samp(e)')} AS std, {R('sum((e - b) * (e - b)) / (sum(e * e) + 1e-10)', 1e6)} AS durbin_watson FROM (SELECT e, lag(e) OVER (ORDER BY day) AS b FROM (SELECT day, x - 20000.0::DOUBLE AS e FROM {DAILY}))"
)
def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.plans.learning import daily

    got = report.residuals(daily(spark, sf_dir).withColumn("p", F.lit(20000.0)), "x", "p", ["day"]).select("mean", "std", "durbin_watson")
    return rounded(rounded(got, "mean", "std"), "durbin_watson", scale=1e6)


@query("SELECT 'a' AS model, 0.5::DOUBLE AS rmse, NULL::DOUBLE AS auc UNION ALL SELECT 'b', NULL, 0.75")
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.comparison(spark, [report.ModelReport("a", {"rmse": 0.5}), report.ModelReport("b", {"auc": 0.75})])


@query()
def training_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = report.TrainingLog()
    for k in range(5):
        log.add_epoch(1 / (k + 1), 1 / (k + 1) + 0.1)
    return log.frame(spark)


@query()
def cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = prep.k_fold(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", 3).cache()

    def score(train: DataFrame, val: DataFrame) -> float:
        fit = models.ols(train, ["o_custkey"], "o_totalprice")
        return metrics.regression(val.withColumn("p", fit.predict()), "o_totalprice", "p").first()["rmse"]

    return report.cross_validate(folds, 3, score)


@query(f"SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, {R('sum(value)')} AS total FROM events GROUP BY ALL")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(streams.tumbling(table(spark, sf_dir, "events"), "ts", "event_type", "value"), "total")


@query(f"SELECT start, user_id, {R('avg(value)')} AS mean FROM (SELECT user_id, value, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS start FROM events) GROUP BY ALL")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(streams.sliding(table(spark, sf_dir, "events"), "ts", "user_id", "value", "2 days", "1 day"), "mean")


@query('SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", user_id, count(*) AS n FROM (SELECT *, sum(CASE WHEN ts < p + INTERVAL 6 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) GROUP BY user_id, s')
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.sessions(table(spark, sf_dir, "events"), "ts", "user_id", "6 hours")


def drained(spark: SparkSession, df: DataFrame, mode: str = "append") -> DataFrame:
    """All rows of a stream over what is there now. Appended rows go to files in the folder that driver and
    executors share, and so does the state; a complete result, as small as its groups, is kept at the driver."""
    import uuid

    folder = f"{streams.shared(spark)}/stream-{uuid.uuid4().hex}"
    out = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        out.format("parquet").option("path", f"{folder}/rows").start().awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{folder}/rows")
    name = f"s{uuid.uuid4().hex}"
    out.format("memory").queryName(name).start().awaitTermination()
    return spark.table(name)


@query(f"SELECT event_type, count(*) AS n, {R('sum(value)')} AS total FROM events GROUP BY event_type")
def streamed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parque[t]")
    return rounded(drained(spark, stream.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")), "complete"), "total")


@query(f"SELECT user_id, event_id, {R('sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)')} AS total FROM events")
def streamed_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parque[t]")
    return rounded(drained(spark, streams.running(stream, "user_id", "event_id", "value", 0.3)).select("user_id", "event_id", "total"), "total")
