"""Queries of statistics, tests, metrics, preparation and series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import metrics, prep, stats, timeseries
from tessera.plans.registry import query, table
from tessera.plans.rounding import R, r, rounded
from tessera.plans.tables import HOLES, holes



def phi(z: str) -> str:
    """Normal distribution function in SQL."""
    t = f"(1 / (1 + abs({z}) * 0.2316419::DOUBLE))"
    poly = "1.330274429::DOUBLE"
    for c in (-1.821255978, 1.781477937, -0.356563782, 0.319381530):
        poly = f"({poly} * {t} + {c!r}::DOUBLE)"
    tail = f"(exp(({z}) * ({z}) * -0.5::DOUBLE) / sqrt(2 * pi()) * {t} * {poly})"
    return f"(CASE WHEN ({z}) >= 0 THEN 1 - {tail} ELSE {tail} END)"


def t_upper(t: str, df: str) -> str:
    """Two-sided p of t by the same trapezoids, or the normal law beyond 100 degrees."""
    kern = lambda x: f"pow(1 + ({x}) * ({x}) / ({df}), -(({df}) + 1) / 2.0::DOUBLE)"
    area = lambda hi: f"((({hi}) + 10.0::DOUBLE) / 1000 * (list_sum(list_transform(range(1, 1000), lambda k: {kern(f'((({hi}) + 10.0::DOUBLE) / 1000 * k - 10)')})) + ({kern('-10.0::DOUBLE')} + {kern(hi)}) / 2))"
    held = f"least(10.0::DOUBLE, abs({t}))"
    cdf = f"(CASE WHEN ({df}) > 100 THEN {phi(f'abs({t})')} ELSE {area(held)} / {area('10.0::DOUBLE')} END)"
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, 2 * (1 - {cdf})))"


@query(f"SELECT event_type, {R('skewness(value)')} AS skew, {R('kurtosis(value)')} AS kurt, {R('quantile_cont(value, 0.75) - quantile_cont(value, 0.25)')} AS iqr FROM events GROUP BY event_type")
def skew_kurt_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.frame import kurtosis, skewness

    return table(spark, sf_dir, "events").groupBy("event_type").agg(r(skewness("value")).alias("skew"), r(kurtosis("value")).alias("kurt"), r(F.percentile("value", 0.75) - F.percentile("value", 0.25)).alias("iqr"))


@query(f"SELECT {R('avg(value)')} AS mean, {R('var_samp(value)')} AS variance, {R('var_pop(value)')} AS variance_pop, {R('stddev_samp(value)')} AS std, {R('median(value)')} AS median, {R('quantile_cont(value, 0.75) - quantile_cont(value, 0.25)')} AS iqr, {R('skewness(value)')} AS skewness, {R('kurtosis(value)')} AS kurtosis FROM ({HOLES})")
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = stats.summary(holes(spark, sf_dir), "value")
    return rounded(got, *got.columns)


RANKS = "(SELECT l_quantity AS x, l_extendedprice AS y, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0::DOUBLE AS ry FROM lineitem)"


@query(f"SELECT {R('corr(rx, ry)', 1e6)} AS spearman FROM {RANKS}")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.spearman(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice"), "spearman", scale=1e6)


@query("SELECT event_id, rank() OVER (ORDER BY user_id) + (count(*) OVER (PARTITION BY user_id) - 1) / 2.0::DOUBLE AS rank FROM events")
def average_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.average_ranks(table(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", "rank").select("event_id", "rank")


@query(f"SELECT {R('-sum(p * log2(p))', 1e6)} AS entropy FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM customer GROUP BY c_mktsegment)")
def entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    p = c.groupBy("c_mktsegment").agg((F.count("*") / float(c.count())).alias("p"))
    return rounded(stats.entropy(p, "p"), "entropy", scale=1e6)


@query(
    f"""WITH e AS (SELECT min(l_quantity) a, max(l_quantity) b, min(l_extendedprice) c, max(l_extendedprice) d FROM lineitem),
    j AS (SELECT least(floor((l_quantity - a) / ((b - a + 1e-10) / 8)), 7) AS bx, least(floor((l_extendedprice - c) / ((d - c + 1e-10) / 8)), 7) AS bw, count(*) AS n FROM lineitem, e GROUP BY ALL),
    p AS (SELECT n / CAST(sum(n) OVER () AS DOUBLE) AS p, sum(n) OVER (PARTITION BY bx) / CAST(sum(n) OVER () AS DOUBLE) AS x, sum(n) OVER (PARTITION BY bw) / CAST(sum(n) OVER () AS DOUBLE) AS y FROM j)
    SELECT {R('sum(p * log2(p / (x * y)))', 1e6)} AS mutual_information FROM p"""
)
def mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.mutual_information(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", 8), "mutual_information", scale=1e6)


@query(f"SELECT event_id, {R(phi('(value - 50) / 20'), 1e9)} AS cdf, {R('exp((value - 50) / 20 * ((value - 50) / 20) * -0.5::DOUBLE) / (20 * sqrt(2 * pi()))', 1e9)} AS pdf FROM events")
def normal_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", r(S.normal_cdf(v, 50, 20), 1e9).alias("cdf"), r(S.normal_pdf(v, 50, 20), 1e9).alias("pdf"))


LOW = "(sqrt(ln(least(p, 1 - p)) * -2))"
Z = f"({LOW} - ((0.010328::DOUBLE * {LOW} + 0.802853::DOUBLE) * {LOW} + 2.515517::DOUBLE) / (((0.001308::DOUBLE * {LOW} + 0.189269::DOUBLE) * {LOW} + 1.432788::DOUBLE) * {LOW} + 1))"


@query(f"SELECT event_id, {R(f'CASE WHEN p < 0.5 THEN -{Z} ELSE {Z} END', 1e6)} AS quantile FROM (SELECT event_id, (event_id % 997 + 1) / 999.0::DOUBLE AS p FROM events)")
def normal_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", r(S.normal_quantile((F.col("event_id") % 997 + 1) / 999.0), 1e6).alias("quantile"))


def tested(df: DataFrame) -> DataFrame:
    return rounded(df, "statistic", "p_value", "df", scale=1e6)


def test_sql(rel: str, statistic: str, p: str, df: str) -> str:
    return f"SELECT {R(statistic, 1e6)} AS statistic, {R(p, 1e6)} AS p_value, {R(df, 1e6)} AS df FROM ({rel})"


@query(test_sql("SELECT *, (m - 50) / (s / sqrt(n) + 1e-10) AS t, n - 1 AS d FROM (SELECT count(value)::DOUBLE AS n, avg(value) AS m, stddev_samp(value) AS s FROM events)", "t", t_upper("t", "d"), "d"))
def t_test_one_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tested(stats.t_test_one_sample(table(spark, sf_dir, "events"), "value", 50.0))


TWO = "SELECT count(value) FILTER (WHERE event_type = 'click')::DOUBLE AS n1, avg(value) FILTER (WHERE event_type = 'click') AS m1, var_samp(value) FILTER (WHERE event_type = 'click') AS v1, count(value) FILTER (WHERE event_type = 'view')::DOUBLE AS n2, avg(value) FILTER (WHERE event_type = 'view') AS m2, var_samp(value) FILTER (WHERE event_type = 'view') AS v2 FROM events"


@query(test_sql(f"SELECT *, (m1 - m2) / (sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)) + 1e-10) AS t, n1 + n2 - 2 AS d FROM ({TWO})", "t", t_upper("t", "d"), "d"))
def t_test_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tested(stats.t_test_two_sample(table(spark, sf_dir, "events"), "value", "event_type", "click", "view"))


@query(test_sql(f"SELECT *, (m1 - m2) / (sqrt(v1 / n1 + v2 / n2) + 1e-10) AS t, floor((v1 / n1 + v2 / n2) * (v1 / n1 + v2 / n2) / ((v1 / n1) * (v1 / n1) / (n1 - 1) + (v2 / n2) * (v2 / n2) / (n2 - 1) + 1e-10)) AS d FROM ({TWO})", "t", t_upper("t", "d"), "d"))
def t_test_welch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tested(stats.t_test_two_sample(table(spark, sf_dir, "events"), "value", "event_type", "click", "view", equal_var=False))


@query(test_sql("SELECT *, m / (s / sqrt(n) + 1e-10) AS t, n - 1 AS d FROM (SELECT count(*)::DOUBLE AS n, avg(l_discount - l_tax) AS m, stddev_samp(l_discount - l_tax) AS s FROM lineitem)", "t", t_upper("t", "d"), "d"))
def t_test_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tested(stats.t_test_paired(table(spark, sf_dir, "lineitem"), "l_discount", "l_tax"))


CHI = "SELECT sum((o - e) * (o - e) / (e + 1e-10)) AS x, (count(*) - 1)::DOUBLE AS d FROM (SELECT count(*)::DOUBLE AS o, (SELECT count(*) FROM events) / 5.0::DOUBLE AS e FROM events GROUP BY event_type)"


@query(test_sql(CHI, "x", f"1 - {phi('((pow(x / d, 1 / 3.0::DOUBLE) - (1 - 2 / (9 * d))) / sqrt(2 / (9 * d)))')}", "d"))
def chi_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    cells = e.groupBy("event_type").agg(F.count("*").alias("o")).withColumn("e", F.lit(e.count() / 5.0))
    return tested(stats.chi_squared(cells, "o", "e"))


ANOVA = "SELECT count(*)::DOUBLE AS k, sum(n) AS n, sum(n * m) AS s, sum(n * m * m) AS q, sum(n * v) AS w FROM (SELECT count(value)::DOUBLE AS n, avg(value) AS m, var_pop(value) AS v FROM events GROUP BY event_type)"


@query(test_sql(f"SELECT *, ((q - s * s / n) / (k - 1)) / (w / (n - k) + 1e-10) AS f FROM ({ANOVA})", "f", f"1 - {phi('sqrt(f)')}", "k - 1"))
def anova(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tested(stats.anova(table(spark, sf_dir, "events"), "value", "event_type"))


U = "SELECT count(*) FILTER (WHERE g = 'click')::DOUBLE AS n1, count(*) FILTER (WHERE g = 'view')::DOUBLE AS n2, sum(rk) FILTER (WHERE g = 'click') AS s FROM (SELECT event_type AS g, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0::DOUBLE AS rk FROM events WHERE event_type IN ('click', 'view'))"


@query(test_sql(f"SELECT *, abs((u - n1 * n2 / 2) / (sqrt(n1 * n2 * (n1 + n2 + 1) / 12) + 1e-10)) AS z FROM (SELECT *, least(s - n1 * (n1 + 1) / 2, n1 * n2 - (s - n1 * (n1 + 1) / 2)) AS u FROM ({U}))", "u", f"greatest(0, least(1, 2 * (1 - {phi('z')})))", "0.0::DOUBLE"))
def mann_whitney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tested(stats.mann_whitney(table(spark, sf_dir, "events"), "value", "event_type", "click", "view"))


KS = f"SELECT max(greatest(abs(up / n - c), abs((up - k) / n - c))) AS d, max(n) AS n FROM (SELECT k, sum(k) OVER (ORDER BY value)::DOUBLE AS up, n, {phi('((value - m) / (s + 1e-10))')} AS c FROM (SELECT value, count(*)::DOUBLE AS k FROM events GROUP BY value), (SELECT avg(value) AS m, stddev_samp(value) AS s, count(value)::DOUBLE AS n FROM events))"
SERIES = " + ".join(f"{2 * (-1) ** (k - 1)}.0::DOUBLE * exp(x * x * {-2 * k * k}.0::DOUBLE)" for k in range(1, 6))


@query(test_sql(f"SELECT *, d * (sqrt(n) + 0.12::DOUBLE + 0.11::DOUBLE / sqrt(n)) AS x FROM ({KS})", "d", f"greatest(0, least(1, {SERIES}))", "0.0::DOUBLE"))
def ks_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tested(stats.ks_normal(table(spark, sf_dir, "events"), "value"))




@query(
    "WITH q AS (SELECT {z} AS z FROM (SELECT 0.975::DOUBLE AS p)), o AS (SELECT avg(value) AS m, stddev_samp(value) / sqrt(count(value)) AS se, avg(CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE 0 END) AS p, count(*)::DOUBLE AS n FROM events) SELECT {a} AS estimate, {b} AS low, {c} AS high, {d} AS share, {e} AS share_low, {f} AS share_high FROM o, q".format(
        z=Z, a=R("m"), b=R("m - z * se"), c=R("m + z * se"), d=R("p"), e=R("p - z * sqrt(p * (1 - p) / n)"), f=R("p + z * sqrt(p * (1 - p) / n)")
    )
)
def confidence_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    a = stats.interval_mean(e, "value")
    b = stats.interval_proportion(e, F.col("value") > 50).select(F.col("estimate").alias("share"), F.col("low").alias("share_low"), F.col("high").alias("share_high"))
    return rounded(a.join(F.broadcast(b)), "estimate", "low", "high", "share", "share_low", "share_high")


#: Truth and a score that depends on text length, on labelled documents.
SCORED = "(SELECT l.doc_id, l.quality::DOUBLE AS y, (d.n_chars % 101) / 100.0::DOUBLE AS s FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return table(spark, sf_dir, "labels").join(d, "doc_id").select("doc_id", F.col("quality").cast("double").alias("y"), ((F.col("n_chars") % 101) / 100.0).alias("s"))


REG = {"mse": "avg((y - s) * (y - s))", "rmse": "sqrt(avg((y - s) * (y - s)))", "mae": "avg(abs(y - s))", "mape": "avg(CASE WHEN y <> 0 THEN abs((y - s) / y) END) * 100", "r2": "1 - sum((y - s) * (y - s)) / (var_pop(y) * count(*))", "adjusted_r2": "1 - (sum((y - s) * (y - s)) / (var_pop(y) * count(*))) * (count(*) - 1) / (count(*) - 2)", "explained_variance": "1 - var_pop(y - s) / (var_pop(y) + 1e-10)", "max_error": "max(abs(y - s))", "median_absolute_error": "median(abs(y - s))"}


@query("SELECT " + ", ".join(f"{R(e, 1e6)} AS {n}" for n, e in REG.items()) + f" FROM {SCORED}")
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = metrics.regression(scored(spark, sf_dir), "y", "s")
    return rounded(got, *got.columns, scale=1e6)


CM = f"SELECT count(*) FILTER (WHERE y >= 0.5 AND s >= 0.4)::DOUBLE AS tp, count(*) FILTER (WHERE y < 0.5 AND s >= 0.4)::DOUBLE AS fp, count(*) FILTER (WHERE y < 0.5 AND s < 0.4)::DOUBLE AS tn, count(*) FILTER (WHERE y >= 0.5 AND s < 0.4)::DOUBLE AS fn FROM {SCORED}"
P, RC, E = "(tp / (tp + fp + 1e-10))", "(tp / (tp + fn + 1e-10))", "1e-10"
RATES = {"total": "tp + fp + tn + fn", "accuracy": "(tp + tn) / (tp + fp + tn + fn + 1e-10)", "precision": P, "recall": RC, "f1": f"2 * {P} * {RC} / ({P} + {RC} + 1e-10)", "fbeta": f"5 * {P} * {RC} / (4 * {P} + {RC} + 1e-10)", "specificity": "tn / (tn + fp + 1e-10)", "npv": "tn / (tn + fn + 1e-10)", "mcc": "(tp * tn - fp * fn) / (sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) + 1e-10)", "kappa": "((tp + tn) / (tp + fp + tn + fn + 1e-10) - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / ((tp + fp + tn + fn) * (tp + fp + tn + fn) + 1e-10)) / (1 - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / ((tp + fp + tn + fn) * (tp + fp + tn + fn) + 1e-10) + 1e-10)"}


@query("SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, tn::BIGINT AS tn, fn::BIGINT AS fn, " + ", ".join(f"{R(e, 1e6)} AS {n}" for n, e in RATES.items()) + f" FROM ({CM})")
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.rates(metrics.confusion(scored(spark, sf_dir), "y", "s", 0.4), beta=2.0), *RATES, scale=1e6)


@query(f"SELECT {R('avg(-(y * ln(greatest(1e-7, least(1 - 1e-7, s))) + (1 - y) * ln(1 - greatest(1e-7, least(1 - 1e-7, s)))))', 1e6)} AS log_loss, {R('avg(CASE WHEN (s > 0.5)::INTEGER = y THEN 1.0::DOUBLE ELSE 0 END)', 1e6)} AS accuracy FROM {SCORED}")
def log_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    return rounded(metrics.log_loss(s, "y", "s").join(F.broadcast(metrics.accuracy_binary(s, "y", "s"))), "log_loss", "accuracy", scale=1e6)


@query(f"SELECT {R('sum(CASE WHEN p.s > n.s THEN 1.0::DOUBLE WHEN p.s = n.s THEN 0.5 ELSE 0 END) / count(*)', 1e6)} AS auc_roc FROM {SCORED} p, {SCORED} n WHERE p.y = 1 AND n.y = 0")
def auc_roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.auc_roc(scored(spark, sf_dir), "y", "s"), "auc_roc", scale=1e6)


STEPS = f"(SELECT s, sum(y) OVER w AS tp, count(*) OVER w AS seen, (SELECT sum(y) FROM {SCORED}) AS p, (SELECT count(*) FROM {SCORED}) AS n, row_number() OVER (PARTITION BY s ORDER BY doc_id) AS k FROM {SCORED} WINDOW w AS (ORDER BY s DESC))"


@query(f"SELECT s AS threshold, {R('(seen - tp) / (n - p)', 1e6)} AS fpr, {R('tp / p', 1e6)} AS tpr FROM {STEPS} WHERE k = 1")
def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.roc_curve(scored(spark, sf_dir), "y", "s"), "fpr", "tpr", scale=1e6)


@query(f"SELECT s AS threshold, {R('tp / seen', 1e6)} AS precision, {R('tp / p', 1e6)} AS recall FROM {STEPS} WHERE k = 1")
def pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.pr_curve(scored(spark, sf_dir), "y", "s"), "precision", "recall", scale=1e6)


@query(f"SELECT {R('sum(abs(rc - r0) * (pr + p0) / 2)', 1e6)} AS auc_pr FROM (SELECT rc, pr, lag(rc) OVER (ORDER BY s DESC) AS r0, lag(pr) OVER (ORDER BY s DESC) AS p0 FROM (SELECT s, tp / seen AS pr, tp / p AS rc FROM {STEPS} WHERE k = 1))")
def auc_pr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.auc_pr(scored(spark, sf_dir), "y", "s"), "auc_pr", scale=1e6)


GUESSED = "(SELECT vec_id, label AS t, CAST((label + (vec_id % 4 = 0)::INTEGER) % 10 AS INTEGER) AS g FROM embeddings)"


def guessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("label").alias("t"), ((F.col("label") + (F.col("vec_id") % 4 == 0).cast("int")) % 10).cast("int").alias("g"))


CLASSES = f"SELECT a.t AS class, hit / (coalesce(guessed, 0) + 1e-10) AS p, hit / (support + 1e-10) AS rc, support FROM (SELECT t, count(*) AS support, count(*) FILTER (WHERE t = g)::DOUBLE AS hit FROM {GUESSED} GROUP BY t) a LEFT JOIN (SELECT g, count(*) AS guessed FROM {GUESSED} GROUP BY g) b ON a.t = b.g"


@query(f"SELECT class, {R('p', 1e6)} AS precision, {R('rc', 1e6)} AS recall, {R('2 * p * rc / (p + rc + 1e-10)', 1e6)} AS f1, support FROM ({CLASSES})")
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.classification_report(guessed(spark, sf_dir), "t", "g"), "precision", "recall", "f1", scale=1e6)


@query(f"SELECT {R('avg(p)', 1e6)} AS macro_precision, {R('avg(rc)', 1e6)} AS macro_recall, {R('avg(2 * p * rc / (p + rc + 1e-10))', 1e6)} AS macro_f1, {R('sum(2 * p * rc / (p + rc + 1e-10) * support) / sum(support)', 1e6)} AS weighted_f1 FROM ({CLASSES})")
def report_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = metrics.report_means(metrics.classification_report(guessed(spark, sf_dir), "t", "g"))
    return rounded(got, *got.columns, scale=1e6)


@query("SELECT t AS class, " + ", ".join(f"count(*) FILTER (WHERE g = {k}) AS c{k}" for k in range(10)) + f" FROM {GUESSED} GROUP BY t")
def confusion_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion_multi(guessed(spark, sf_dir), "t", "g", 10)


REL = "(SELECT user_id, event_id, CAST(event_id % 4 AS INTEGER) AS rel, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 4 DESC) AS best FROM events)"


@query(f"SELECT user_id, {R('CASE WHEN b = 0 THEN 0 ELSE a / b END', 1e6)} AS ndcg FROM (SELECT user_id, sum((pow(2.0, rel) - 1) / log2(k + 1)) FILTER (WHERE k <= 10) AS a, sum((pow(2.0, rel) - 1) / log2(best + 1)) FILTER (WHERE best <= 10) AS b FROM {REL} GROUP BY user_id)")
def ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value", (F.col("event_id") % 4).cast("int").alias("rel"))
    return rounded(metrics.ndcg(e, "rel", [F.desc("value"), "event_id"], 10, ["user_id"]), "ndcg", scale=1e6)


@query(f"SELECT {R('avg(CASE WHEN f IS NULL THEN 0 ELSE 1.0::DOUBLE / f END)', 1e6)} AS mrr, {R('avg(p)', 1e6)} AS precision_at_k FROM (SELECT user_id, min(k) FILTER (WHERE rel > 2) AS f, count(*) FILTER (WHERE rel > 2 AND k <= 10) / 10.0::DOUBLE AS p FROM {REL} GROUP BY user_id)")
def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.frame import rank

    e = table(spark, sf_dir, "events").select("user_id", "event_id", (-F.col("value")).alias("v"), F.greatest(F.col("event_id") % 4 - 2, F.lit(0)).alias("rel"))
    placed = rank(e, "v", ["event_id"], "k", ["user_id"])
    one = metrics.mean_reciprocal_rank(placed, "rel", "k", ["user_id"]).join(F.broadcast(metrics.precision_at_k(placed, "rel", "k", 10, ["user_id"])))
    return rounded(one, "mrr", "precision_at_k", scale=1e6)
