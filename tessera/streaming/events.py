"""Streams of events: windowed aggregates with watermarks, and running state by key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, time: str, key: str, value: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Count and sum by window and key; rows later than the watermark are dropped by the stream alone."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, width), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def sliding(events: DataFrame, time: str, key: str, value: str, width: str, step: str, late: str = "1 day") -> DataFrame:
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, width, step), key).agg(F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), key, "mean")


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str = "1 day") -> DataFrame:
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


#: Folders of sessions for which none is set.
OWN: dict[str, str] = {}


def shared(spark: SparkSession) -> str:
    """This application's folder in the one that the cluster names; a local one only where none is set."""
    app = spark.sparkContext.applicationId
    named = spark.conf.get("spark.checkpoint.dir", None) or OWN.get(app)
    if not named:
        import tempfile

        named = OWN[app] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return f"{named.rstrip('/')}/tessera-{app}"


def running(events: DataFrame, key: str, order: str, value: str, alpha: float) -> DataFrame:
    """key, order, running sum and exponential mean of each event; the state is two numbers a key."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, ewm = state.get if state.exists else (0.0, None)
        rows = pd.concat(list(batches)).sort_values(order)
        x = rows[value].to_numpy(dtype=float)
        sums = np.cumsum(np.r_[total, np.where(np.isnan(x), 0.0, x)])[1:]
        means = []
        for v in x.tolist():
            if v == v:
                ewm = v if ewm is None else alpha * v + (1 - alpha) * ewm
            means.append(ewm)
        state.update((float(sums[-1]) if len(sums) else total, ewm))
        yield pd.DataFrame({key: [k[0]] * len(rows), order: rows[order].to_numpy(), "total": sums, "ewm": pd.Series(means, dtype="float64")})

    kinds = dict(events.dtypes)
    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, total double, ewm double"
    return events.groupBy(key).applyInPandasWithState(step, schema, "total double, ewm double", "append", GroupStateTimeout.NoTimeout)
