"""Anytime-valid monitoring of streams.

A stream's running count and sum per key are enough for its confidence sequence, so state is two numbers per key. sigma must
be given: the guarantee for finite samples rests on it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from assay.functions.prob import finite


def running_sequence(stream: DataFrame, key: str, value: str, sigma: float, *, alpha: float = 0.1, rho: float = 0.5) -> DataFrame:
    """(key, n, mean, lo, hi, decided) so far, for output mode update or complete; values that aren't finite are left out."""
    s = stream.filter(finite(F.col(value))).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    k = F.col("n") * (rho * rho) + 1
    radius = sigma * F.sqrt(2 * k / (F.col("n").cast("double") * F.col("n") * (rho * rho)) * F.log(F.sqrt(k) / alpha))
    out = s.withColumns({"lo": F.col("mean") - radius, "hi": F.col("mean") + radius})
    return out.withColumn("decided", (F.col("lo") > 0) | (F.col("hi") < 0))


def windowed_sequence(stream: DataFrame, key: str, value: str, time: str, sigma: float, *, window: str, late: str, alpha: float = 0.1, rho: float = 0.5) -> DataFrame:
    """running_sequence per key and window of event time; rows later than `late` behind the watermark are dropped by it."""
    marked = stream.withWatermark(time, late).filter(finite(F.col(value)))
    s = marked.groupBy(F.window(time, window).alias("window"), F.col(key).alias("key")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    k = F.col("n") * (rho * rho) + 1
    radius = sigma * F.sqrt(2 * k / (F.col("n").cast("double") * F.col("n") * (rho * rho)) * F.log(F.sqrt(k) / alpha))
    return s.select("window.start", "window.end", "key", "n", "mean", (F.col("mean") - radius).alias("lo"), (F.col("mean") + radius).alias("hi"))


def latched_sequence(stream: DataFrame, key: str, value: str, order: str, sigma: float, *, alpha: float = 0.1, rho: float = 0.5, min_n: int = 20) -> DataFrame:
    """(key, n, mean, crossed_at) per trigger: crossed_at is the number of values after which the sequence first excluded 0,
    and stays. Values of a key within one trigger are taken in the order given; a decision isn't taken back by late ones."""
    rows = stream.filter(finite(F.col(value))).select(F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("x"), F.col(order).cast("string").alias("o"))

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, crossed = state.get if state.exists else (0, 0.0, None)
        values = pd.concat(list(batches)).sort_values("o")["x"]
        for x in values:
            n, total = n + 1, total + x
            if crossed is None and n >= min_n:
                k = n * rho * rho + 1
                if abs(total / n) > sigma * math.sqrt(2 * k / (n * n * rho * rho) * math.log(math.sqrt(k) / alpha)):
                    crossed = n
        state.update((n, total, crossed))
        yield pd.DataFrame({"key": [name[0]], "n": [n], "mean": [total / n], "crossed_at": pd.array([crossed], dtype="Int64")})

    return rows.groupBy("key").applyInPandasWithState(
        step, "key string, n bigint, mean double, crossed_at bigint", "n bigint, total double, crossed bigint", "update", GroupStateTimeout.NoTimeout
    )
