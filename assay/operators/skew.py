"""Per-key results where a few keys hold most rows.

Rows are compressed to (key, value, weight) before anything is done per key, so that a hot key arrives at its final
aggregate as one partial row per task and not as its rows. Distinct counts, modes, means and percentiles are exact: they
are computed from the weighted values. Running weights for percentiles are taken over ranges of (key, value), so a key
with very many values is spread over tasks as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.sources.tables import cut


def value_frequencies(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """(key, value, weight): how many rows have this key and value; null keys and values are values like others."""
    return df.select(key.alias("key"), value.alias("value")).groupBy("key", "value").agg(F.count("*").alias("weight"))


def profile_by_key(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """One row per key: n rows, n_valued rows with a value, n_distinct values, mode (the smallest of equals), mean.

    Null, NaN and infinite values count in n only; the mean is null where a key has no value or values aren't numeric.
    Rows with a null key form one group under the null key. An empty table gives no rows."""
    kind = df.select(value.alias("value")).schema["value"].dataType.typeName()
    numeric = kind in ("double", "float", "integer", "long", "short", "byte")
    if kind in ("double", "float"):
        value = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    freq = value_frequencies(df, key, value)
    has = F.col("value").isNotNull()
    w = F.when(has, F.col("weight"))
    mean = F.try_divide(F.sum(F.col("value").cast("double") * F.col("weight")), F.sum(w)) if numeric else F.lit(None).cast("double")
    return freq.groupBy("key").agg(
        F.sum("weight").alias("n"),
        F.coalesce(F.sum(w), F.lit(0)).cast("bigint").alias("n_valued"),
        F.count("value").alias("n_distinct"),
        F.min_by("value", F.when(has, F.struct(-F.col("weight"), F.col("value")))).alias("mode"),
        mean.alias("mean"),
    )


def percentiles_by_key(df: DataFrame, key: Column, value: Column, shares: list[float]) -> DataFrame:
    """(key, share, percentile): the smallest value with at least that share of the key's rows at or below it.

    Null, NaN and infinite values are left out; a key without values has no row. Weighted values are laid out by range
    of (key, value); weights are summed within a range and carried over from the ranges before it."""
    x = F.col("value").cast("double")
    freq = value_frequencies(df, key, value).filter(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ranged = cut(freq.repartitionByRange("key", "value").withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy("key", "part").agg(F.sum("weight").alias("here"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("key", "part", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("before"), F.sum("here").over(Window.partitionBy("key")).alias("total"))
    within = Window.partitionBy("key", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ran = ranged.withColumn("run", F.sum("weight").over(within))
    same = ran["key"].eqNullSafe(sums["key"]) & (ran["part"] == sums["part"])
    cum = ran.join(sums, same).select(ran["key"], "value", "weight", (F.col("run") + F.col("before")).alias("upto"), "total")
    wanted = cum.withColumn("share", F.explode(F.array(*map(F.lit, shares))))
    rank = F.greatest(F.lit(1), F.ceil(F.col("share") * F.col("total")))
    return wanted.filter((rank <= F.col("upto")) & (rank > F.col("upto") - F.col("weight"))).select("key", "share", F.col("value").alias("percentile"))


#: Rows of one key from which on a join doesn't bring them to one task.
HOT_ROWS = 1_000_000


def join_hot(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", hot_rows: int = HOT_ROWS) -> DataFrame:
    """big joined to small, which has one row per key; how is inner or left. big is read twice, so it should be a table.

    Keys with over hot_rows rows of big (no more of them than rows of big by hot_rows) get small's rows by broadcast and
    stay where they are; all others are joined as usual. A null key matches nothing."""
    if big.count() <= hot_rows:
        return big.join(small, on, how)
    hot = cut(big.groupBy(*on).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_rows).select(*on).dropna())
    if hot.isEmpty():
        return big.join(small, on, how)
    few = small.join(F.broadcast(hot), on, "left_semi")
    warm = big.join(F.broadcast(hot), on, "left_semi").join(F.broadcast(few), on, how)
    return big.join(F.broadcast(hot), on, "left_anti").join(small, on, how).unionByName(warm)


def heavy_keys(profile: DataFrame, share: float) -> DataFrame:
    """Keys of a profile that hold at least this share of all rows, rows with a null key included in the whole; null is no key."""
    profile = cut(profile)
    total = profile.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return profile.filter(F.col("key").isNotNull() & (F.col("n") >= share * total))
