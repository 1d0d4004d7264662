"""Queries of selection, order, joins, grouping, pivots and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import frame
from tessera.plans.registry import query, table
from tessera.plans.rounding import R, r, rounded
from tessera.sources import tables as io

#: `events` with nulls: the value of every seventh row.
HOLES = "SELECT event_id, ts, user_id, event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events"


def holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", "user_id", "event_type", F.when(F.col("event_id") % 7 == 0, None).otherwise(F.col("value")).alias("value"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem WHERE l_quantity > 30 AND l_returnflag = 'R'")
def filter_select_derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where((F.col("l_quantity") > 30) & (F.col("l_returnflag") == "R"))
    rows = frame.apply_column(rows, "l_extendedprice", lambda c: c * (1 - F.col("l_discount")), "revenue")
    return frame.select(rows, ["l_orderkey", "l_linenumber", "l_partkey", "revenue", "not_there"])


@query("SELECT c_custkey, upper(c_name) AS name, CAST(c_custkey AS DOUBLE) AS key_as_float, CAST(trunc(c_acctbal) AS INTEGER) AS whole FROM customer")
def schema_rename_drop_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_name", "name").withColumnRenamed("absent", "x").drop("c_mktsegment", "absent")
    return c.select("c_custkey", F.upper("name").alias("name"), F.col("c_custkey").cast("double").alias("key_as_float"), F.col("c_acctbal").cast("int").alias("whole"))


@query("SELECT * FROM part WHERE contains(lower(p_name), 'a') AND length(p_name) > 5")
def filter_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.contains(F.lower("p_name"), F.lit("a")) & (F.length("p_name") > 5))


@query(f"SELECT event_id, value FROM ({HOLES}) WHERE value IS NOT NULL")
def drop_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.drop_nulls(holes(spark, sf_dir), ["value"]).select("event_id", "value")


@query("SELECT * EXCLUDE (k) FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem) WHERE k = 1")
def drop_duplicates_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return frame.drop_duplicates(table(spark, sf_dir, "lineitem").select(*cols), cols[:2], cols[2:])


@query("SELECT DISTINCT user_id, event_type FROM events")
def drop_duplicates_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.drop_duplicates(table(spark, sf_dir, "events").select("user_id", "event_type"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def sort_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.head(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 50, [F.desc("o_totalprice"), "o_orderkey"])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 50")
def tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.tail(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 50, ["o_orderkey"])


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 70 OFFSET 30")
def slice_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.slice_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 30, 100, ["o_orderkey"])


@query("SELECT o_orderkey FROM orders ORDER BY md5('7|' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 100")
def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.sample(table(spark, sf_dir, "orders").select("o_orderkey"), 100, "o_orderkey", 7)


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos FROM events")
def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.positions(table(spark, sf_dir, "events").select("event_id", "ts"), ["ts", "event_id"]).select("event_id", F.col("pos").cast("bigint").alias("pos"))


@query(f"SELECT event_id, row_number() OVER (ORDER BY value DESC NULLS LAST, event_type, event_id) AS place FROM ({HOLES})")
def sort_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = frame.positions(holes(spark, sf_dir), [F.col("value").desc_nulls_last(), "event_type", "event_id"])
    return placed.select("event_id", (F.col("pos") + 1).cast("bigint").alias("place"))


@query(f"SELECT event_id, CASE WHEN value IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY user_id ORDER BY value NULLS LAST, event_id) AS DOUBLE) END AS value_rank FROM ({HOLES})")
def rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.rank(holes(spark, sf_dir), "value", ["event_id"], partition_by=["user_id"]).select("event_id", "value_rank")


@query("SELECT o_orderkey, o_custkey, o_totalprice, c_name, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey")
def merge_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_acctbal")
    return frame.merge(o, c, "o_custkey")


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def merge_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return frame.merge(table(spark, sf_dir, "customer").select("c_custkey"), o, "c_custkey", "left")


@query("SELECT coalesce(a.k, b.k) AS k, a.v AS v, b.v AS v_right FROM (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 3 = 0) a FULL JOIN (SELECT s_suppkey AS k, s_acctbal AS v FROM supplier) b ON a.k = b.k")
def merge_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    return frame.merge(a, b, "k", "outer")


@query("SELECT a.k, a.n, b.m FROM (SELECT CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id END AS k, count(*) AS n FROM events GROUP BY 1) a JOIN (SELECT CASE WHEN user_id % 7 = 0 THEN NULL ELSE user_id END AS k, count(*) AS m FROM events GROUP BY 1) b ON a.k IS NOT DISTINCT FROM b.k")
def merge_null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda d, n: table(spark, sf_dir, "events").groupBy(F.when(F.col("user_id") % d == 0, None).otherwise(F.col("user_id")).alias("k")).agg(F.count("*").alias(n))
    return frame.merge(side(5, "n"), side(7, "m"), "k", null_safe=True)


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def merge_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return frame.merge(table(spark, sf_dir, "customer").select("c_custkey"), big, "c_custkey", "semi")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def merge_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return frame.merge(table(spark, sf_dir, "customer").select("c_custkey"), o, "c_custkey", "anti")


@query("SELECT a.event_id, a.user_id, a.ts, (SELECT max_by(b.value, b.ts) FROM events b WHERE b.event_type = 'purchase' AND b.user_id = a.user_id AND b.ts <= a.ts) AS value FROM events a WHERE a.event_type = 'click'")
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return frame.asof(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), e.where("event_type = 'purchase'").select("user_id", "ts", "value"), "ts", "value", ["user_id"]).select("event_id", "user_id", "ts", "value")


@query("SELECT event_type, sum(event_id) AS event_id_sum, min(value) AS value_min, max(value) AS value_max, median(value) AS value_median, count(value) AS value_count, " + f"{R('avg(value)')} AS value_mean, {R('stddev_samp(value)')} AS value_std FROM ({HOLES}) GROUP BY event_type")
def group_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = frame.group_agg(holes(spark, sf_dir), "event_type", {"event_id": ["sum"], "value": ["min", "max", "median", "count", "mean", "std"]})
    return rounded(got.withColumn("event_id_sum", F.col("event_id_sum").cast("bigint")), "value_mean", "value_std")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, " + R("sum(l_tax)") + " AS tax FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), r(F.sum("l_tax")).alias("tax"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).union(table(spark, sf_dir, "customer").select("c_custkey")).distinct()


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).intersect(table(spark, sf_dir, "orders").select("o_custkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf_dir, "orders").select("o_custkey"))


@query("SELECT n_nationkey AS k, n_name AS name, NULL::BIGINT AS extra FROM nation UNION ALL SELECT r_regionkey, r_name, 1 FROM region")
def add_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"), F.col("n_name").alias("name"))
    return frame.add_rows(a, table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("k"), F.col("r_name").alias("name"), F.lit(1).cast("bigint").alias("extra")))


@query("SELECT user_id, min_by(value, event_id) FILTER (WHERE event_type = 'click') AS click, min_by(value, event_id) FILTER (WHERE event_type = 'purchase') AS purchase, min_by(value, event_id) FILTER (WHERE event_type = 'view') AS view FROM events GROUP BY user_id")
def pivot_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.pivot(table(spark, sf_dir, "events"), "user_id", "event_type", "value", ["event_id"], ["click", "purchase", "view"])


@query("SELECT id, statistic, value FROM (SELECT event_id AS id, CAST(user_id AS DOUBLE) AS user_id, value FROM events) UNPIVOT (value FOR statistic IN (user_id, value))")
def unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("double").alias("user_id"), "value")
    return e.unpivot(["id"], ["user_id", "value"], "statistic", "value")


@query("SELECT c_mktsegment, CAST(count(*) AS INTEGER) AS count FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.value_counts(table(spark, sf_dir, "customer"), "c_mktsegment")


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS null_count, (count(*) - count({c})) / CAST(count(*) AS DOUBLE) * 100 AS null_pct, count({c}) AS valid_count FROM ({HOLES})"
        for c in ("event_id", "user_id", "value")
    )
)
def null_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.null_report(holes(spark, sf_dir).select("event_id", "user_id", "value"))


def statistic_sql(cols: list[str], rel: str) -> str:
    how = {"count": "CAST(count({c}) AS DOUBLE)", "mean": "avg({c})", "std": "stddev_samp({c})", "min": "CAST(min({c}) AS DOUBLE)", "25%": "quantile_cont({c}, 0.25)", "50%": "quantile_cont({c}, 0.5)", "75%": "quantile_cont({c}, 0.75)", "max": "CAST(max({c}) AS DOUBLE)"}
    return " UNION ALL ".join(f"SELECT '{s}' AS statistic, " + ", ".join(f"{R(e.format(c=c))} AS {c}" for c in cols) + f" FROM {rel}" for s, e in how.items())


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(statistic_sql(NUMBERS, "lineitem"))
def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(frame.describe(table(spark, sf_dir, "lineitem"), NUMBERS), *NUMBERS)


def matrix_sql(fn: str, cols: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS \"column\", " + ", ".join(f"{R(f'{fn}({a}, {b})')} AS {b}" for b in cols) + " FROM lineitem" for a in cols)


@query(matrix_sql("corr", NUMBERS))
def corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(frame.corr(table(spark, sf_dir, "lineitem"), NUMBERS), *NUMBERS)


@query(matrix_sql("covar_samp", NUMBERS))
def cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(frame.cov(table(spark, sf_dir, "lineitem"), NUMBERS), *NUMBERS)


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS null_count, {R(f'(count(*) - count({c})) / CAST(count(*) AS DOUBLE) * 100')} AS null_pct, count(DISTINCT {c}) AS distinct_count, "
        + ", ".join(f"{R(e) if n else '0.0::DOUBLE'} AS {k}" for k, e in (("mean", f"avg({c})"), ("std", f"stddev_samp({c})"), ("min", f"min({c})"), ("max", f"max({c})"), ("skewness", f"skewness({c})"), ("kurtosis", f"kurtosis({c})")))
        + f" FROM ({HOLES})"
        for c, n in (("event_type", False), ("value", True))
    ).replace("min(event_type)", "0").replace("max(event_type)", "0")
)
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(frame.quality_report(holes(spark, sf_dir).select("event_type", "value")), "null_pct", "mean", "std", "min", "max", "skewness", "kurtosis")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import tempfile

    path = f"{spark.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp(prefix='tessera-')}/csv-{abs(hash((sf_dir, id(spark)))):x}"
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    n.write.mode("overwrite").csv(path, header=True)
    back = io.read_csv(spark, path)
    return back.select(F.col("n_nationkey").cast(n.schema["n_nationkey"].dataType), "n_name", F.col("n_regionkey").cast(n.schema["n_regionkey"].dataType))


@query("SELECT event_id, [CAST(user_id AS DOUBLE), coalesce(value, 0.0)] AS features FROM (" + HOLES + ")")
def to_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.to_vectors(holes(spark, sf_dir), ["user_id", "value"]).select("event_id", "features")


@query("SELECT user_id, list(coalesce(value, 0.0) ORDER BY ts, event_id) AS value FROM (" + HOLES + ") GROUP BY user_id")
def column_to_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.collected(holes(spark, sf_dir), "value", ["ts", "event_id"], ["user_id"])


