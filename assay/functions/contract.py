"""The verification contract: one row is one decision or observation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = {
    "group": "string", "time": "timestamp_ntz", "entity": "string", "baseline": "double", "outcome": "double",
    "cost": "double", "payoff": "double", "value": "double", "level": "double",
}
DEFAULTS = {"cost": 1.0}


def assert_contract(df: DataFrame, mandatory: list[str]) -> DataFrame:
    """The frame with the contract's missing columns added; fails where a mandatory one is missing.

    cost is 1 and payoff the outcome where their column is missing; other missing columns are null."""
    lacking = [c for c in mandatory if c not in df.columns]
    if lacking:
        raise ValueError(f"columns missing: {', '.join(lacking)}")
    for name, kind in FIELDS.items():
        if name not in df.columns:
            value = F.col("outcome") if name == "payoff" and "outcome" in df.columns else F.lit(DEFAULTS.get(name))
            df = df.withColumn(name, value.cast(kind))
    return df


def group_key(group: Column, uid: Column) -> Column:
    """The resampling unit: the group, or the row itself where it is null."""
    return F.coalesce(group.cast("string"), F.concat(F.lit("\x01"), uid.cast("string")))


def first_load(df: DataFrame, key: str, loaded: str) -> DataFrame:
    """One row per key, the one loaded first (a null time is the last); of rows loaded together, one by their hash. A null key is a key."""
    order = F.struct(F.col(loaded).isNull(), F.col(loaded), F.xxhash64(*df.columns))
    return df.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct("*"), order).alias("_row")).select("_row.*")
