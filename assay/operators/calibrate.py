"""Baseline calibration by equal-count bins, and residuals against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.prob import finite
from assay.operators.ordinal import with_ordinal
from assay.sources.tables import cut


def equal_count_bins(df: DataFrame, baseline: Column, uid: str, nbins: int = 15) -> DataFrame:
    """Adds bin: rows with a finite baseline in its order (ties by uid), cut into nbins of equal count."""
    rows = df.filter(finite(baseline)).withColumn("_b", baseline.cast("double"))
    numbered = cut(with_ordinal(rows, ["_b", uid], name="_o"))
    n = numbered.count()
    return numbered.withColumn("bin", F.least(F.lit(nbins - 1), F.floor(F.col("_o") * nbins / max(n, 1))).cast("int")).drop("_o")


def _outcome(outcome: Column) -> Column:
    return F.when(finite(outcome), outcome.cast("double")).otherwise(0.0)


def fit(df: DataFrame, baseline: Column, outcome: Column, uid: str, nbins: int = 15) -> DataFrame:
    """(bin, cut, rate, n), numbered without holes: the largest baseline and the mean outcome of each bin that has rows."""
    binned = equal_count_bins(df, baseline, uid, nbins)
    raw = binned.groupBy("bin").agg(F.max("_b").alias("cut"), F.avg(_outcome(outcome)).alias("rate"), F.count("*").alias("n"))
    return raw.withColumn("bin", F.row_number().over(Window.orderBy("bin")) - 1)  # at most nbins rows


def apply(df: DataFrame, fitted: DataFrame, baseline: Column, outcome: Column) -> DataFrame:
    """Adds resid: outcome less the rate of the first bin whose cut isn't below the baseline, or of the last bin.

    Rows without a finite baseline, and all rows where nothing was fitted, are left out. The fit has few rows; it is
    inlined, so that this is a projection."""
    bins = fitted.orderBy("bin").collect()
    if not bins:
        return df.limit(0).withColumn("resid", F.lit(0.0))
    rate = F.lit(bins[-1].rate)
    for b in reversed(bins):
        rate = F.when(baseline <= b.cut, b.rate).otherwise(rate)
    return df.filter(finite(baseline)).withColumn("resid", _outcome(outcome) - rate)


def in_sample(df: DataFrame, baseline: Column, outcome: Column, uid: str, nbins: int = 15) -> DataFrame:
    """Adds resid: outcome less the mean outcome of the row's own bin."""
    binned = cut(equal_count_bins(df, baseline, uid, nbins).withColumn("_y", _outcome(outcome)))
    rates = binned.groupBy("bin").agg(F.avg("_y").alias("_rate"))
    return binned.join(F.broadcast(rates), "bin").withColumn("resid", F.col("_y") - F.col("_rate")).drop("_y", "_rate", "_b")
