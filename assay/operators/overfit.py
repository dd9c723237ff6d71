"""Diagnostics against overfitting: Sharpe ratios, the probability of backtest overfitting, purged folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.prob import finite, guarded_skewness, norm_cdf, norm_ppf, pearson_kurtosis
from assay.operators.ordinal import with_ordinal
from assay.sources.tables import cut

EULER = 0.5772156649015329


def sharpe(df: DataFrame, value: Column, by: list[str]) -> DataFrame:
    """(by..., n, sharpe, skew, kurt): mean over sample deviation; 0 without spread; fewer than two values give no row."""
    s = df.filter(finite(value)).groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("sd"), guarded_skewness(value).alias("skew"), pearson_kurtosis(value).alias("kurt"))
    ratio = F.when(F.col("sd") > 0, F.col("m") / F.col("sd")).otherwise(0.0)
    return s.filter("n >= 2").select(*by, "n", ratio.alias("sharpe"), "skew", "kurt")


def _psr(benchmark: Column) -> Column:
    sr = F.col("sharpe")
    spread = F.sqrt(F.greatest(F.lit(1e-12), 1 - F.col("skew") * sr + (F.col("kurt") - 1) / 4 * sr * sr))
    return norm_cdf((sr - benchmark) * F.sqrt(F.col("n") - 1) / spread)


def probabilistic_sharpe(df: DataFrame, value: Column, by: list[str], benchmark: float = 0.0) -> DataFrame:
    """(by..., n, sharpe, psr): the chance that the true ratio exceeds the benchmark; values are taken as independent."""
    return sharpe(df, value, by).filter("n >= 3").select(*by, "n", "sharpe", _psr(F.lit(benchmark)).alias("psr"))


def deflated_sharpe(df: DataFrame, value: Column, by: list[str]) -> DataFrame:
    """(by..., n, sharpe, sr0, dsr): against the best ratio expected of as many trials as there are; fewer than two give none."""
    trials = cut(sharpe(df, value, by))
    over = trials.agg(F.var_pop("sharpe").alias("v"), F.count("*").cast("double").alias("k")).filter("k >= 2")
    best = (1 - EULER) * norm_ppf(1 - 1 / F.col("k")) + EULER * norm_ppf(1 - 1 / (F.col("k") * 2.718281828459045))
    sr0 = over.select((F.sqrt("v") * best).alias("sr0"))
    return trials.filter("n >= 3").join(F.broadcast(sr0)).select(*by, "n", "sharpe", "sr0", _psr(F.col("sr0")).alias("dsr"))


def pbo_cscv(perf: DataFrame, strategy: str, period: str, value: Column, n_blocks: int = 10) -> DataFrame:
    """(n_splits, pbo, median_logit) from (strategy, period, value), by symmetric splits into blocks of periods.

    Only periods that all strategies have count, in their order; the number of blocks is even and at most that of the
    periods. The best in sample is the first of equals by name; out of sample, equals count as worse. Sums per strategy
    and block are enough, so the splits don't touch the rows."""
    rows = perf.filter(finite(value)).groupBy(F.col(strategy).alias("s"), F.col(period).alias("p")).agg(F.avg(value).alias("v"))
    rows = cut(rows)
    k = rows.select("s").distinct().count()
    common = rows.groupBy("p").agg(F.count("*").alias("c")).filter(F.col("c") == k).select("p")
    t = common.count()
    nb = min(n_blocks, t)
    nb -= nb % 2
    empty = "n_splits bigint, pbo double, median_logit double"
    if nb < 2 or k < 2:
        return perf.sparkSession.createDataFrame([], empty)
    numbered = with_ordinal(common, ["p"])
    bounds = [round(i * t / nb) for i in range(nb + 1)]
    block = F.lit(0)
    for i, b in enumerate(bounds[1:-1], 1):
        block = F.when(F.col("ord") >= b, i).otherwise(block)
    sums = rows.join(numbered, "p").groupBy("s", block.alias("b")).agg(F.sum("v").alias("x"), F.count("*").alias("n"))
    spark = perf.sparkSession
    masks = spark.range(2**nb).filter(F.bit_count("id") == nb // 2).select(F.col("id").alias("mask"))  # C(nb, nb/2) rows
    inside = F.col("mask").bitwiseAND(F.expr("shiftleft(1L, b)")) != 0
    means = (
        cut(sums).join(F.broadcast(masks)).groupBy("mask", "s")
        .agg((F.sum(F.when(inside, F.col("x"))) / F.sum(F.when(inside, F.col("n")))).alias("ins"), (F.sum(F.when(~inside, F.col("x"))) / F.sum(F.when(~inside, F.col("n")))).alias("oos"))
    )
    picked = means.groupBy("mask").agg(F.min_by("oos", F.struct(-F.col("ins"), F.col("s"))).alias("best"), F.collect_list("oos").alias("all"))
    w = (1 + F.size(F.filter("all", lambda x: x < F.col("best")))) / (F.size("all") + 1)
    logits = picked.select(F.log(w / (1 - w)).alias("l")).agg(F.array_sort(F.collect_list("l")).alias("ls"))
    size = F.size("ls")
    return logits.select(size.cast("bigint").alias("n_splits"), (F.size(F.filter("ls", lambda x: x <= 0)) / size).alias("pbo"), F.element_at("ls", (F.floor(size / 2) + 1).cast("int")).alias("median_logit"))


def purged_kfold(df: DataFrame, uid: str, time: str, n_splits: int = 5, embargo: float = 0.01) -> DataFrame:
    """(fold, uid, role): test rows of each fold in order of time, and train rows outside of its times and its embargo.

    The embargo is a share of all rows after the test rows. Rows without time are left out; fewer rows than splits give none."""
    rows = cut(with_ordinal(df.filter(F.col(time).isNotNull()).select(F.col(uid).alias("uid"), F.col(time).alias("t")), ["t", "uid"]))
    n = rows.count()
    if n < n_splits or n_splits < 2:
        return df.sparkSession.createDataFrame([], f"fold int, uid {rows.schema['uid'].dataType.simpleString()}, role string")
    bounds = [round(i * n / n_splits) for i in range(n_splits + 1)]
    fold = F.lit(0)
    for i, b in enumerate(bounds[1:-1], 1):
        fold = F.when(F.col("ord") >= b, i).otherwise(fold)
    times = rows.groupBy(fold.alias("fold")).agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.min("ord").alias("first"), F.max("ord").alias("last"))  # n_splits rows
    spread = rows.join(F.broadcast(times))
    test = (F.col("ord") >= F.col("first")) & (F.col("ord") <= F.col("last"))
    near = (F.col("ord") > F.col("last")) & (F.col("ord") <= F.col("last") + int(n * embargo))
    role = F.when(test, "test").when(~near & ~F.col("t").between(F.col("lo"), F.col("hi")), "train")
    return spread.select("fold", "uid", role.alias("role")).filter("role is not null")


def fold_counts(folds: DataFrame) -> DataFrame:
    return folds.groupBy("fold", "role").agg(F.count("*").alias("n"))


