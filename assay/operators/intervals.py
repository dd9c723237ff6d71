"""Means, returns, anytime-valid sequences and power."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.prob import POWER_COEF, finite, guarded_skewness
from assay.operators.ordinal import with_ordinal
from assay.operators.resample import ratio_ci
from assay.sources.tables import cut


def mean_ci(df: DataFrame, key: Column, value: Column, **how) -> DataFrame:
    """Mean over rows with a finite value, resampled by group: larger groups weigh more."""
    return ratio_ci(df.filter(finite(value)), key, value, F.lit(1.0), **how)


def roi_ci(df: DataFrame, key: Column, cost: Column, payoff: Column, **how) -> DataFrame:
    """Return per 100 of cost over rows acted on (finite cost above 0), and hits, the rows that paid.

    A payoff that isn't finite counts as 0."""
    paid = F.when(finite(payoff), payoff.cast("double")).otherwise(0.0)
    acted = df.filter(finite(cost) & (cost > 0)).withColumn("_hit", (paid > 0).cast("int"))
    by = how.get("by") or []
    out = ratio_ci(acted, key, paid, cost, scale=100.0, null_value=100.0, **how)
    hits = acted.groupBy(*by).agg(F.sum("_hit").alias("hits"))
    return out.join(hits, by) if by else out.join(F.broadcast(hits))


def _radius(n: Column, sigma: Column, alpha: float, rho: float) -> Column:
    k = n * rho * rho + 1
    return sigma * F.sqrt(2 * k / (n * n * rho * rho) * F.log(F.sqrt(k) / alpha))


def confidence_sequence(df: DataFrame, value: Column, *, by: list[str] | None = None, alpha: float = 0.1, sigma: float | None = None, rho: float = 0.5) -> DataFrame:
    """(by..., n, mean, sigma, radius, lo, hi, degenerate, robust_positive, robust_negative, decided, validity) after all
    values, valid at any time of looking.

    With sigma given the guarantee holds for finite samples; else the population deviation stands in, and fewer than two
    values or no spread are degenerate: no bounds, undecided."""
    stats = df.filter(finite(value)).groupBy(*(by or [])).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd")).filter("n > 0")
    return _sequence(stats, alpha, sigma, rho)


def _sequence(stats: DataFrame, alpha: float, sigma: float | None, rho: float) -> DataFrame:
    s = F.lit(float(sigma)) if sigma is not None else F.col("sd")
    degenerate = (F.col("n") < 2) | (s <= 0)
    radius = F.when(~degenerate, _radius(F.col("n"), s, alpha, rho))
    out = stats.withColumns({"sigma": s, "radius": radius, "degenerate": degenerate}).drop("sd")
    out = out.withColumns({"lo": F.col("mean") - F.col("radius"), "hi": F.col("mean") + F.col("radius")})
    out = out.withColumns({"robust_positive": F.coalesce(F.col("lo") > 0, F.lit(False)), "robust_negative": F.coalesce(F.col("hi") < 0, F.lit(False))})
    return out.withColumns({"decided": F.col("robust_positive") | F.col("robust_negative"), "validity": F.lit("finite_sample" if sigma is not None else "asymptotic")})


#: Looks that are accumulated together before the sums of such runs are.
LOOKS_PER_RUN = 4096


def sequential_checkpoints(df: DataFrame, value: Column, order: list[str], *, by: list[str] | None = None, alpha: float = 0.1, sigma: float | None = None, rho: float = 0.5, min_n: int = 20, step: int = 10) -> DataFrame:
    """(by..., n, mean, lo, hi, decided, total): the sequence looked at after min_n, min_n + step... values in the order given.

    total is the number of all values. Values are summed per step, steps are accumulated within runs of looks, and runs
    by their sums, so a key with most values is spread over tasks. Fewer values than min_n give no row."""
    if step < 1:
        raise ValueError("step must be at least 1")
    by, first = by or [], max(1, min_n)
    rows = df.filter(finite(value)).select(*by, *order, value.cast("double").alias("x"))
    numbered = with_ordinal(rows, order, by=by)
    look = F.greatest(F.lit(0), F.ceil((F.col("ord") + 1 - first) / step)).cast("bigint")
    sums = numbered.withColumn("look", look).groupBy(*by, "look").agg(F.count("*").alias("c"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    sums = cut(sums.withColumn("run", F.floor(F.col("look") / LOOKS_PER_RUN)))
    runs = sums.groupBy(*by, "run").agg(*(F.sum(c).alias(c) for c in "csq"))
    before = Window.partitionBy(*by).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    ahead = runs.select(*by, "run", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in "csq"), F.sum("c").over(Window.partitionBy(*by)).alias("total"))
    w = Window.partitionBy(*by, "run").orderBy("look").rowsBetween(Window.unboundedPreceding, 0)
    within = sums.select(*by, "run", "look", *(F.sum(c).over(w).alias(c) for c in "csq"))
    same = F.col("a.run") == F.col("z.run")
    for b in by:
        same = same & F.col(f"a.{b}").eqNullSafe(F.col(f"z.{b}"))
    run = within.alias("a").join(ahead.alias("z"), same).select(*(F.col(f"a.{b}") for b in by), "look", "total", *((F.col(f"a.{c}") + F.col(f"z.{c}0")).alias(c) for c in "csq")).withColumnRenamed("c", "n")
    run = run.filter(F.col("n") == first + F.col("look") * step)
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - (F.col("s") / F.col("n")) * (F.col("s") / F.col("n"))))
    return _sequence(run.withColumns({"mean": F.col("s") / F.col("n"), "sd": sd}), alpha, sigma, rho).select(*by, "n", "mean", "lo", "hi", "decided", "total")


def sequential_scan(df: DataFrame, value: Column, order: list[str], *, by: list[str] | None = None, min_n: int = 20, **how) -> DataFrame:
    """(by..., n, looks, crossed_at) over sequential_checkpoints: crossed_at is the first look that decides, or null.

    A key with fewer than min_n values has no looks; without by, no values give no row."""
    by = by or []
    looked = sequential_checkpoints(df, value, order, by=by, min_n=min_n, **how)
    found = looked.groupBy(*by).agg(F.count("*").alias("looks"), F.min(F.when(F.col("decided"), F.col("n"))).alias("crossed_at"))
    total = df.filter(finite(value)).groupBy(*by).agg(F.count("*").alias("n"))
    out = total.join(found, by, "left") if by else total.filter("n > 0").join(F.broadcast(found), how="left")
    return out.select(*by, "n", F.coalesce("looks", F.lit(0)).alias("looks"), "crossed_at")


def power_roi(df: DataFrame, cost: Column, payoff: Column, *, target: float = 110.0, measurable_n: int = 5000) -> DataFrame:
    """(n, roi, sd, need_n, measurable, skew, heavy_tailed): rows needed to see the target return; costs should be about equal.

    Infinite where the target is 100; no spread or fewer than five rows acted on give no result."""
    acted = df.filter(finite(cost) & (cost > 0)).withColumn("_p", F.when(finite(payoff), payoff.cast("double")).otherwise(0.0)).withColumn("_c", cost.cast("double"))
    net = (F.col("_p") - F.col("_c")) / (F.col("_c") / 100)
    s = acted.withColumn("_x", net).agg(F.count("*").alias("n"), (F.sum("_p") / F.sum("_c") * 100).alias("roi"), F.stddev_samp("_x").alias("sd"), guarded_skewness(F.col("_x")).alias("skew"))
    edge = target - 100
    need = F.lit(float("inf")) if edge == 0 else F.pow(POWER_COEF * F.col("sd") / edge, F.lit(2.0))
    return s.filter("n >= 5 and sd > 0").withColumn("need_n", need).withColumns({"measurable": F.col("need_n") <= measurable_n, "heavy_tailed": F.abs("skew") > 2})


def power_mean(df: DataFrame, value: Column, mde: float, *, measurable_n: int = 5000, two_sample: bool = False) -> DataFrame:
    """(n, sd, need_n, measurable): values needed to see a difference of mde; infinite for 0, none without spread."""
    s = df.filter(finite(value)).agg(F.count("*").alias("n"), F.stddev_samp(value).alias("sd"))
    need = F.lit(float("inf")) if mde == 0 else (2 if two_sample else 1) * F.pow(POWER_COEF * F.col("sd") / abs(mde), F.lit(2.0))
    return s.filter("n >= 2 and sd > 0").withColumn("need_n", need).withColumn("measurable", F.col("need_n") <= measurable_n)
