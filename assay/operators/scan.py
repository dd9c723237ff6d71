"""Which features beat the baseline, in the sample and out of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.prob import MIN_GROUPS, two_sided_p
from assay.operators.calibrate import apply, fit, in_sample
from assay.operators.ordinal import with_ordinal
from assay.operators.resample import replicates
from assay.sources.tables import cut


def residual_stats(df: DataFrame, by: list[str], iters: int = 1000, seed: int = 42) -> DataFrame:
    """From (by..., key, resid): (by..., n, n_groups, resid, se, z); se is the deviation of the bootstrap means over groups.

    Fewer than 30 groups give no result; z is 0 without spread."""
    stats = df.groupBy(*by, "key").agg(F.sum("resid").alias("num"), F.count("resid").cast("double").alias("den"))
    stats = cut(stats)
    point = stats.groupBy(*by).agg(F.sum("den").cast("bigint").alias("n"), F.count("*").alias("n_groups"), F.try_divide(F.sum("num"), F.sum("den")).alias("resid")).filter(F.col("n_groups") >= MIN_GROUPS)
    se = replicates(cut(stats.join(point.select(*by), by, "left_semi")), iters, seed, by).groupBy(*by).agg(F.stddev_pop("v").alias("se"))
    return point.join(se, by).withColumn("z", F.coalesce(F.try_divide("resid", "se"), F.lit(0.0)))


def _labelled(df: DataFrame, specs: dict[str, Column], *keep: str) -> DataFrame:
    """A row per row and feature that holds for it."""
    hits = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in specs.items())))
    return df.withColumn("label", F.explode(hits)).select("label", *keep)


def residual_scan(df: DataFrame, specs: dict[str, Column], key: Column, baseline: Column, outcome: Column, uid: str, *, nbins: int = 15, iters: int = 1000, seed: int = 42) -> DataFrame:
    """(label, n, n_groups, resid, se, z) of each feature against the calibration of the same rows."""
    rows = in_sample(df, baseline, outcome, uid, nbins).withColumn("key", key)
    return residual_stats(_labelled(rows, specs, "key", "resid"), ["label"], iters, seed)


def split_times(df: DataFrame, time: Column, parts: int) -> list:
    """The first time of each part but the first: distinct times cut at multiples of their number; empty if too few."""
    times = df.filter(time.isNotNull()).select(time.alias("t")).distinct()
    n = times.count()
    if n < parts:
        return []
    at = [n * k // parts for k in range(1, parts)]
    found = {r.ord: r.t for r in with_ordinal(times, ["t"]).filter(F.col("ord").isin(at)).collect()}
    return [found[i] for i in at]


def _staged(df, specs, key, time, baseline, outcome, uid, cuts, nbins, iters, seed) -> DataFrame:
    stage = F.lit("s1")
    for k, t in enumerate(cuts):
        stage = F.when(time >= F.lit(t), f"s{k + 2}").otherwise(stage)
    rows = cut(df.filter(time.isNotNull()).withColumn("stage", stage).withColumn("key", key))
    fitted = fit(rows.filter("stage = 's1'"), baseline, outcome, uid, nbins)
    stats = residual_stats(_labelled(apply(rows, fitted, baseline, outcome), specs, "stage", "key", "resid"), ["label", "stage"], iters, seed)
    return stats.groupBy("label").pivot("stage", [f"s{k + 1}" for k in range(len(cuts) + 1)]).agg(F.first("resid").alias("resid"), F.first("z").alias("z"), F.first("n").alias("n"))


def holdout_scan(df: DataFrame, specs: dict[str, Column], key: Column, time: Column, baseline: Column, outcome: Column, uid: str, *, split=None, nbins: int = 15, iters: int = 1000, seed: int = 42) -> DataFrame:
    """(label, resid_d, z_d, n_d, resid_v, z_v, n_v, survives): fitted on the earlier rows only, tried on the later.

    A feature survives with |z| of 2 at discovery, and the same sign, |resid| of 0.02 and |z| of 1 at validation."""
    cuts = [split] if split is not None else split_times(df, time, 2)
    wide = _staged(df, specs, key, time, baseline, outcome, uid, cuts, nbins, iters, seed) if cuts else _staged(df.limit(0), specs, key, time, baseline, outcome, uid, ["9999-01-01"], nbins, iters, seed)
    ok = (F.abs("s1_z") >= 2) & (F.col("s1_resid") * F.col("s2_resid") > 0) & (F.abs("s2_resid") >= 0.02) & (F.abs("s2_z") >= 1)
    return wide.select("label", F.col("s1_resid").alias("resid_d"), F.col("s1_z").alias("z_d"), F.col("s1_n").alias("n_d"), F.col("s2_resid").alias("resid_v"), F.col("s2_z").alias("z_v"), F.col("s2_n").alias("n_v"), F.coalesce(ok, F.lit(False)).alias("survives"))


def staged_scan(df: DataFrame, specs: dict[str, Column], key: Column, time: Column, baseline: Column, outcome: Column, uid: str, *, estimand: str = "", nbins: int = 15, iters: int = 1000, seed: int = 42) -> DataFrame:
    """(label, z_d, z_v, z_c, confirmed, note): discovery, validation and confirmation on successive thirds of the times.

    Fewer than three times give no rows; a blank estimand is noted."""
    cuts = split_times(df, time, 3)
    wide = _staged(df if cuts else df.limit(0), specs, key, time, baseline, outcome, uid, cuts or ["9999-01-01", "9999-01-02"], nbins, iters, seed)
    same = lambda k: (F.signum(f"{k}_resid") == F.signum("s1_resid")) & (F.abs(f"{k}_z") >= 1)
    ok = (F.abs("s1_z") >= 2) & same("s2") & same("s3")
    note = "" if estimand.strip() else "no estimand was stated beforehand"
    return wide.select("label", F.col("s1_z").alias("z_d"), F.col("s2_z").alias("z_v"), F.col("s3_z").alias("z_c"), F.coalesce(ok, F.lit(False)).alias("confirmed"), F.lit(note).alias("note"))


def multiple_comparisons(tests: DataFrame, n: str = "n_tests", z: str = "z") -> DataFrame:
    """Adds p, expected_false (how many of n tests pass |z| by chance) and the Sidak level for five percent overall."""
    p = two_sided_p(F.col(z))
    return tests.withColumns({"p": p, "expected_false": F.col(n) * p, "sidak_alpha": 1 - F.pow(F.lit(0.95), F.try_divide(F.lit(1.0), F.col(n)))})
